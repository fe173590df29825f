"""Attached files: kinds by their bytes, a ladder of risks, and what a message's files come to. Columns only, but for the
listing of archives.

Bytes are looked at as Latin-1 text, a character a byte, so Spark's text functions apply to them.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

from ..functions import text as T

# First bytes of kinds; extensions by what they risk; groups of kinds and extensions; telling words.
HEADS = [
    ("MZ", "pe"), ("\x7fELF", "elf"), ("\xfe\xed\xfa\xce", "macho"), ("\xfe\xed\xfa\xcf", "macho"), ("\xcf\xfa\xed\xfe", "macho"), ("\xce\xfa\xed\xfe", "macho"),
    ("%PDF", "pdf"), ("Rar!\x1a\x07", "rar"), ("7z\xbc\xaf\x27\x1c", "7z"), ("\x1f\x8b", "gz"), ("BZh", "bz2"), ("\xfd7zXZ\x00", "xz"), ("MSCF", "cab"),
    ("\x89PNG", "png"), ("\xff\xd8\xff", "jpg"), ("GIF8", "gif"), ("{\\rtf", "rtf"), ("\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "ole"), ("L\x00\x00\x00\x01\x14\x02\x00", "lnk"),
]
ZIP_HEADS = ("PK\x03\x04", "PK\x05\x06", "PK\x07\x08")
EXTENSIONS = {
    "critical": "exe scr pif com bat cmd msi msp cpl dll vbs vbe js jse wsf wsh ps1 psm1 hta lnk",
    "high": "url reg inf chm jar apk iso img vhd vhdx one docm xlsm pptm dotm xltm xlam slk iqy ace arj cab shtml",
    "medium": "doc xls ppt rtf zip rar 7z gz tar z bz2 xz html htm svg",
    "low": "xml pdf docx xlsx pptx csv vcf",
    "info": "txt png jpg jpeg gif ics",
}
ARCHIVES, ARCHIVE_KINDS = "zip rar 7z gz tar bz2 xz ace arj cab z iso img".split(), "zip rar 7z gz bz2 xz iso cab".split()
IMAGES, IMAGE_KINDS, SNIFFABLE = "png jpg jpeg gif bmp webp svg".split(), "png jpg gif".split(), "png jpg jpeg gif".split()
MACRO_NAMES = "docm xlsm pptm dotm xltm xlam".split()
EXECUTABLE_KINDS, EXECUTABLES = "pe elf macho msi script hta lnk".split(), "exe dll scr com msi pif cpl sys drv ocx".split()
DOCUMENTS = "pdf doc docx xls xlsx ppt pptx jpg jpeg png gif txt csv zip html htm rtf odt ods mp3 mp4 avi".split()
PLAIN = "doc dot xls xlt ppt pdf rtf txt csv tsv log md html htm shtml xml svg json eml msg ics vcf".split()
PACKED_DOCUMENTS = "docx docm dotm xlsx xlsm xlam xltm pptx pptm odt ods odp".split()
SCRIPT_WORDS = "powershell|cmd.exe|wscript|cscript|createobject(|@echo off|set-executionpolicy|invoke-expression|iex(|rundll32|regsvr32|mshta".split("|")
RANKS = ["info", "low", "medium", "high", "critical"]
VALUES = [0.0, 0.15, 0.4, 0.75, 1.0]
THRESHOLD, MANY, NAMED = 7.0, 5, 8
ISO_AT, HEAD, SAMPLE, SCANNED = 0x8001, 512, 2048, 65_536
# ---


def latin(data: Column) -> Column:
    """Bytes as text, a character a byte; empty for null."""
    return F.decode(F.coalesce(data, F.lit(b"")), "ISO-8859-1")


@F.pandas_udf(StructType().add("ok", BooleanType()).add("members", ArrayType(StringType())).add("locked", BooleanType()))
def listing(data: pd.Series) -> pd.DataFrame:
    """What an archive says that it holds, 500 members at most; not ok for what is no archive."""

    def one(raw) -> tuple:
        try:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                infos = z.infolist()[:500]
                return True, [i.filename.encode("utf-8", "replace").decode() for i in infos], any(i.flag_bits & 1 for i in infos)
        except Exception:  # a hostile archive is none
            return False, [], False

    return pd.DataFrame([one(x) if x is not None and x[:2] == b"PK" else (False, [], False) for x in data], columns=["ok", "members", "locked"])


def _has_any(x: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, F.lit(w))
    return out


def _starts(x: Column, heads) -> Column:
    out = F.lit(False)
    for h in heads:
        out = out | F.startswith(x, F.lit(h))
    return out


def kind(data: Column, members: Column | None = None) -> Column:
    """A file's kind by its bytes; '' where they say nothing. members: of an archive, which tell office documents."""
    x = latin(data)
    sample = F.substring(x, 1, SAMPLE)
    start = F.translate(F.ltrim(sample, F.lit(" \t\n\r\x0b\x0c")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    head = F.substring(x, 1, HEAD)
    readable = F.length(F.regexp_replace(head, "[^\\x20-\\x7e\\t\\n\\r]", "")) / F.length(head) > 0.9
    office = F.array_contains(members, "[Content_Types].xml") if members is not None else F.lit(False)
    out = F.when(F.length(x) == 0, "")
    for h, name in HEADS:
        out = out.when(F.startswith(x, F.lit(h)), name)
    return (
        out.when(_starts(x, ZIP_HEADS), F.when(office, "ooxml").otherwise("zip"))
        .when(F.substring(x, ISO_AT + 1, 5) == "CD001", "iso")
        .when(F.startswith(start, F.lit("#!")), "script")
        .when(F.contains(start, F.lit("<hta:application")), "hta")
        .when(_starts(start, ("<!doctype html", "<html")) | _has_any(start, ("<script", "<body")), "html")
        .when(F.startswith(start, F.lit("<?xml")), F.when(F.contains(start, F.lit("<html")), "html").otherwise("xml"))
        .when(~F.contains(head, F.lit("\x00")) & readable, F.when(_has_any(start, SCRIPT_WORDS), "script").otherwise("text"))
        .otherwise("")
    )


def ole_macros(data: Column) -> Column:
    """Whether a legacy office document names macros, in UTF-16."""
    x = latin(data)
    wide = lambda s: F.contains(x, F.lit(s.encode("utf-16-le").decode("latin-1")))
    return wide("_VBA_PROJECT") | (wide("Macros") & wide("VBA"))


def extension_rank(ext: Column) -> Column:
    """What an extension risks, 0 to 4; 1 for unknown ones."""
    out = F.lit(1)
    for name, exts in EXTENSIONS.items():
        out = F.when(ext.isin(*exts.split()), RANKS.index(name)).otherwise(out)
    return out


def analysed(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Files (msg_id, name, content_type, data, inline) with what is found: ext, kind, mismatch, archive, macros,
    double_extension, entropy, high_entropy, payload, members_risky, locked, rank (0 to 4) and risk.

    The rank is the highest of those that apply; inline images that are what they say rank 0. Null data is empty, a null
    name or type says nothing. No row is dropped.
    """
    c, lit = F.col, F.lit
    f = files.withColumn("_zip", listing("data"))
    shown = F.regexp_replace(F.coalesce("name", lit("")), r"\s{2,}", " ")
    f = f.withColumns({"ext": T.file_extension(shown), "kind": kind(c("data"), c("_zip.members")), "_x": latin(c("data"))}).withColumn("_e", T.shannon(c("_x")))
    parts = F.split(F.replace(F.lower(shown), lit(" "), lit("")), r"\.")
    ext, k, some = c("ext"), c("kind"), c("kind") != ""
    runs = extension_rank(ext) >= 3
    odd = (
        ((ext == "pdf") & some & (k != "pdf"))
        | (ext.isin(*[e for e in IMAGES if e != "svg"]) & some & ~k.isin(*IMAGE_KINDS))
        | (ext.isin("docx", "xlsx", "pptx", "docm", "xlsm", "pptm") & some & ~k.isin("ooxml", "zip"))
        | (ext.isin("doc", "xls", "ppt") & some & ~k.isin("ole", "rtf", "text", "xml", "html"))
        | ((ext == "zip") & some & ~k.isin("zip", "ooxml"))
        | (F.coalesce(F.lower("content_type") == "application/pdf", lit(False)) & some & (k != "pdf"))
        | (k.isin(*EXECUTABLE_KINDS) & ~ext.isin(*EXECUTABLES))
    )
    looked_into = c("archive") & k.isin("zip", "ooxml", "") & (ext.isin("zip", "jar", "apk") | (k == "zip")) & c("_zip.ok")
    risky = F.exists("_zip.members", lambda m: (extension_rank(F.regexp_extract(F.lower(m), r"\.([^.]*)$", 1)) >= 3) & ~F.endswith(m, lit("/")))
    f = f.withColumns({"archive": ext.isin(*ARCHIVES) | k.isin(*ARCHIVE_KINDS), "double_extension": (F.size(parts) >= 3) & F.element_at(F.concat(F.array(lit(""), lit("")), parts), -2).isin(*DOCUMENTS) & runs, "mismatch": odd, "entropy": F.round("_e", 3)})
    vba = F.exists("_zip.members", lambda m: F.endswith(F.lower(m), lit("vbaproject.bin")))
    f = f.withColumns({"members_risky": looked_into & risky, "locked": looked_into & c("_zip.locked"), "high_entropy": c("_e") >= threshold, "macros": ((k == "ooxml") & vba) | ((k == "ole") & ole_macros(c("data"))) | ext.isin(*MACRO_NAMES)})
    unlike_image = F.when(ext.isin(*SNIFFABLE), ~k.isin(*IMAGE_KINDS)).when(ext.isin(*IMAGES), some & ~k.isin(*IMAGE_KINDS)).otherwise(lit(False))
    f = f.withColumn("payload", c("high_entropy") & ~k.isin(*EXECUTABLE_KINDS) & F.when(ext.isin(*PLAIN), True).when(ext.isin(*PACKED_DOCUMENTS), ~k.isin("ooxml", "zip")).otherwise(unlike_image))
    lowered = F.lower(F.substring("_x", 1, SCANNED))
    page = ((k == "html") | ext.isin("html", "htm", "shtml")) & _has_any(lowered, ("<script", "<form", "password"))
    script = (k == "script") & ~ext.isin("txt", "csv", "log", "md")
    closed = c("archive") & k.isin("rar", "7z", "iso", "cab") & ~k.isin("zip", "ooxml", "")
    ranks = [extension_rank(ext), F.when(c("double_extension") | c("mismatch") | c("macros") | c("locked") | c("payload") | page | script, 3).otherwise(0), F.when(k.isin(*EXECUTABLE_KINDS) | c("members_risky"), 4).otherwise(0), F.when(closed, 2).otherwise(0)]
    harmless = F.coalesce("inline", lit(False)) & (k.isin(*IMAGE_KINDS) | ext.isin(*IMAGES)) & ~c("mismatch")
    f = f.withColumn("rank", F.when(harmless, 0).otherwise(F.greatest(*ranks)))
    return f.withColumn("risk", F.get(F.array(*[lit(r) for r in RANKS]), c("rank"))).drop("_zip", "_x", "_e")


#: Findings of a message's files: id, severity (that of the worst file for the first), and which files make it.
FINDINGS = {
    "dangerous_attachment": (None, "rank >= 3"),
    "macro_document": ("high", "macros"),
    "archive_with_executable": ("critical", "members_risky"),
    "mime_mismatch": ("high", "mismatch"),
    "high_entropy_payload": ("high", "payload"),
    "double_extension": ("high", "double_extension"),
    "password_protected_archive": ("high", "locked"),
}


def summary(of: DataFrame, by: str = "msg_id") -> DataFrame:
    """(msg_id, score, findings array<struct<id, severity, n, names>>) of analysed files; names: eight at most, sorted.

    Inline files are listed in the inventory and count for nothing else. The score is the worst file's, and a twentieth
    for each further one of high risk.
    """
    counted = ~F.coalesce("inline", F.lit(False))
    values = F.array(*[F.lit(v) for v in VALUES])
    names = lambda test: F.slice(F.array_sort(F.collect_list(F.when(test, F.coalesce("name", F.lit(""))))), 1, NAMED)
    aggs = {"score": F.coalesce(F.max(F.when(counted, F.get(values, F.col("rank")))), F.lit(0.0)) + 0.05 * F.greatest(F.count_if(counted & (F.col("rank") >= 3)) - 1, F.lit(0)), "worst": F.max(F.when(counted, F.col("rank")))}
    for name, (_, test) in FINDINGS.items():
        aggs |= {f"n_{name}": F.count_if(counted & F.expr(test)), f"f_{name}": names(counted & F.expr(test))}
    aggs |= {"n_many_attachments": F.count_if(counted), "n_attachment_inventory": F.count("*"), "f_attachment_inventory": names(F.lit(True))}
    g = of.groupBy(by).agg(*[a.alias(k) for k, a in aggs.items()])
    one = lambda name, severity, test, files: F.when(test, F.struct(F.lit(name).alias("id"), severity.alias("severity"), F.col(f"n_{name}").alias("n"), files.alias("names")))
    worst = F.get(F.array(*[F.lit(r) for r in RANKS]), F.col("worst"))
    found = [one(name, worst if s is None else F.lit(s), F.col(f"n_{name}") > 0, F.col(f"f_{name}")) for name, (s, _) in FINDINGS.items()]
    found.append(one("many_attachments", F.lit("low"), F.col("n_many_attachments") > MANY, F.array().cast("array<string>")))
    found.append(one("attachment_inventory", F.lit("info"), F.lit(True), F.col("f_attachment_inventory")))
    return g.select(by, F.round(F.least(F.lit(1.0), "score"), 6).alias("score"), F.array_compact(F.array(*found)).alias("findings"))
