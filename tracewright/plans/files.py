"""Queries of attached files: documents are the files, with heads and names that their ids choose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import files as A
from ..session import table

_HEADS = ["MZ", "%PDF", "{\\rtf", "GIF8", "#!/bin/sh ", "<html>", "<?xml ", "", "Powershell ", "BZh", "<hta:application>", "MSCF"]
_NAMES = ["a.pdf", "report.pdf.exe", "x.docm", "photo.png", "page.html", "data.zip", "note.txt", "noext", "old  name.doc", "s.js"]
_TYPES = ["application/pdf", "text/plain", "Application/PDF", "image/png", "text/html"]
_THRESHOLD = 4.25


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as files of ASCII bytes, three to a message, some inline."""
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), (k % len(xs)).cast("int"))
    data = F.concat(pick(_HEADS), F.regexp_replace("text", "[^ -~\n]", ""))
    return d.select(F.floor(k / 3).alias("msg_id"), "doc_id", pick(_NAMES).alias("name"), pick(_TYPES).alias("content_type"), data.cast("binary").alias("data"), (k % 4 == 0).alias("inline"))


_LIST = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_RANK = "CASE " + " ".join(f"WHEN ext IN {_IN(exts.split())} THEN {A.RANKS.index(r)}" for r, exts in A.EXTENSIONS.items()) + " ELSE 1 END"
_FILES = f"""WITH files AS (
    SELECT CAST(floor(doc_id / 3) AS BIGINT) AS msg_id, doc_id, {_LIST(_NAMES)}[1 + doc_id % {len(_NAMES)}] AS name, {_LIST(_TYPES)}[1 + doc_id % {len(_TYPES)}] AS content_type,
           {_LIST(_HEADS)}[1 + doc_id % {len(_HEADS)}] || regexp_replace(text, '[^ -~\\n]', '', 'g') AS x, doc_id % 4 = 0 AS inline FROM documents
), sniffed AS (
    SELECT *, lower(ltrim(substring(x, 1, 2048), ' ' || chr(9) || chr(10) || chr(13))) AS s, regexp_extract(name, '\\.([a-z]+)$', 1) AS ext FROM files
), kinds AS (
    SELECT *, CASE WHEN x = '' THEN '' WHEN starts_with(x, 'MZ') THEN 'pe' WHEN starts_with(x, '%PDF') THEN 'pdf' WHEN starts_with(x, 'BZh') THEN 'bz2' WHEN starts_with(x, 'MSCF') THEN 'cab' WHEN starts_with(x, 'GIF8') THEN 'gif'
        WHEN starts_with(x, '{{\\rtf') THEN 'rtf' WHEN substring(x, 32770, 5) = 'CD001' THEN 'iso' WHEN starts_with(s, '#!') THEN 'script' WHEN contains(s, '<hta:application') THEN 'hta' WHEN starts_with(s, '<html') OR starts_with(s, '<!doctype html') OR contains(s, '<script') OR contains(s, '<body') THEN 'html'
        WHEN starts_with(s, '<?xml') THEN CASE WHEN contains(s, '<html') THEN 'html' ELSE 'xml' END WHEN regexp_matches(s, 'powershell|cmd\\.exe|wscript|cscript|createobject\\(|@echo off|set-executionpolicy|invoke-expression|iex\\(|rundll32|regsvr32|mshta') THEN 'script' ELSE 'text' END AS kind FROM sniffed
), bits AS (
    SELECT doc_id, -sum(c / n * log2(c / n)) AS e FROM (SELECT doc_id, n, ch, count(*)::DOUBLE AS c FROM (SELECT doc_id, length(x) AS n, unnest(string_split(x, '')) AS ch FROM files WHERE x <> '') GROUP BY ALL) GROUP BY doc_id
), flags AS (
    SELECT kinds.*, coalesce(e, 0) AS e, {_RANK} AS er,
        (ext = 'pdf' AND kind NOT IN ('', 'pdf')) OR (ext = 'png' AND kind NOT IN ('', 'gif')) OR (ext = 'docm' AND kind <> '') OR (ext = 'doc' AND kind NOT IN ('', 'rtf', 'text', 'xml', 'html')) OR (ext = 'zip' AND kind <> '')
            OR (lower(content_type) = 'application/pdf' AND kind NOT IN ('', 'pdf')) OR (kind IN ('pe', 'script', 'hta') AND ext <> 'exe') AS mismatch,
        name = 'report.pdf.exe' AS double_extension, ext = 'docm' AS macros
    FROM kinds LEFT JOIN bits USING (doc_id)
), paid AS (
    SELECT *, e >= {_THRESHOLD} AS high_entropy, e >= {_THRESHOLD} AND kind NOT IN ('pe', 'script', 'hta') AND (ext IN ('pdf', 'html', 'txt', 'doc') OR ext = 'docm' OR (ext = 'png' AND kind <> 'gif')) AS payload FROM flags
), analysed AS (
    SELECT *, CASE WHEN inline AND (kind = 'gif' OR ext = 'png') AND NOT mismatch THEN 0 ELSE greatest(er, CASE WHEN kind IN ('pe', 'script', 'hta') THEN 4 WHEN mismatch OR double_extension OR macros OR payload THEN 3
        WHEN (kind = 'html' OR ext = 'html') AND regexp_matches(lower(substring(x, 1, 65536)), '<script|<form|password') THEN 3 WHEN kind = 'cab' THEN 2 ELSE 0 END) END AS rank FROM paid
)"""


def analysed(spark: SparkSession, sf: str) -> DataFrame:
    return A.analysed(files(spark, sf), _THRESHOLD)


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    each = A.summary(analysed(spark, sf)).select("msg_id", "score", F.explode("findings").alias("f"))
    return each.select("msg_id", "score", "f.id", "f.severity", "f.n", F.array_join("f.names", ",").alias("names"))


QUERIES = {
    "att_magic": lambda s, d: files(s, d).select("doc_id", A.kind(F.col("data")).alias("kind")),
    "att_analyse": lambda s, d: analysed(s, d).select("doc_id", "ext", "kind", "mismatch", "macros", "double_extension", "high_entropy", "payload", F.round("entropy", 3).alias("entropy"), "risk"),
    "att_agg": _findings,
    "agg_group_findings": lambda s, d: _findings(s, d).groupBy("id", "severity").agg(F.count("*").alias("messages"), F.sum("n").alias("files")),
}

_ONE = lambda name, severity, test: f"SELECT msg_id, '{name}' AS id, {severity} AS severity, count(*) AS n, array_to_string(list_sort(list(name))[1:8], ',') AS names FROM analysed WHERE {test} GROUP BY msg_id"
_FOUND = (
    _FILES
    + ", scores AS (SELECT msg_id, round(least(1.0::DOUBLE, coalesce(max([0.0, 0.15, 0.4, 0.75, 1.0][rank + 1]::DOUBLE) FILTER (NOT inline), 0) + 0.05::DOUBLE * greatest(0, count(*) FILTER (NOT inline AND rank >= 3) - 1)), 6) AS score FROM analysed GROUP BY msg_id), found AS ("
    + " UNION ALL ".join(
        [
            _ONE("dangerous_attachment", "['info', 'low', 'medium', 'high', 'critical'][max(rank) + 1]", "NOT inline AND rank >= 3"),
            _ONE("macro_document", "'high'", "NOT inline AND macros"),
            _ONE("mime_mismatch", "'high'", "NOT inline AND mismatch"),
            _ONE("high_entropy_payload", "'high'", "NOT inline AND payload"),
            _ONE("double_extension", "'high'", "NOT inline AND double_extension"),
            _ONE("attachment_inventory", "'info'", "true"),
        ]
    )
    + ")"
)

ORACLE_SQL = {
    "att_magic": _FILES + " SELECT doc_id, kind FROM kinds",
    "att_analyse": _FILES + " SELECT doc_id, ext, kind, mismatch, macros, double_extension, high_entropy, payload, round(e, 3) AS entropy, ['info', 'low', 'medium', 'high', 'critical'][rank + 1] AS risk FROM analysed",
    "att_agg": _FOUND + " SELECT msg_id, score, id, severity, n, names FROM found JOIN scores USING (msg_id)",
    "agg_group_findings": _FOUND + " SELECT id, severity, count(*) AS messages, CAST(sum(n) AS BIGINT) AS files FROM found GROUP BY id, severity",
}
