"""Attached files: kinds, archives, macros, and the ladder of risks, on made bytes."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from tracewright.operators import files as A

SCHEMA = "msg_id long, name string, content_type string, data binary, inline boolean"


def packed(*names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, "x")
    return out.getvalue()


OLE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\x00" * 100
CASES = {
    "doc.docx": (packed("[Content_Types].xml", "word/document.xml"), "ooxml", "low"),
    "odd.docx": (packed("[Content_Types].xml", "word/vbaProject.bin"), "ooxml", "high"),
    "a.zip": (packed("readme.txt", "run/Setup.EXE"), "zip", "critical"),
    "b.zip": (packed("readme.txt"), "zip", "medium"),
    "old.doc": (OLE + "_VBA_PROJECT".encode("utf-16-le"), "ole", "high"),
    "plain.doc": (OLE, "ole", "medium"),
    "disc.iso": (b"\x00" * 0x8001 + b"CD001" + b"\x00" * 10, "iso", "high"),
    "x.lnk": (b"L\x00\x00\x00\x01\x14\x02\x00", "lnk", "critical"),
    "pic.png": (b"\x89PNG\r\n", "png", "info"),
    "page.html": (b"  <!DOCTYPE HTML><form>", "html", "high"),
    "calm.html": (b"<html>hello", "html", "medium"),
    "s.csv": (b"invoke-expression x", "script", "critical"),
    "none": (b"", "", "low"),
    "noise.pdf": (bytes(range(256)) * 8, "", "high"),
    "noise.bin": (bytes(range(256)) * 8, "", "low"),
}


def test_kinds_and_risks(spark):
    df = spark.createDataFrame([(1, n, "application/octet-stream", data, False) for n, (data, _, _) in CASES.items()], SCHEMA)
    got = {r.name: (r.kind, r.risk) for r in A.analysed(df).collect()}
    assert got == {n: (kind, risk) for n, (_, kind, risk) in CASES.items()}


def test_edge_cases(spark):
    rows = [(1, None, None, None, None), (1, "a.png", "image/png", b"\x89PNG", True), (2, "a.png", "image/png", b"MZ", True), (3, "invoice.pdf   .exe", None, b"MZ", False)]
    rows += [(4, f"{i}.txt", "text/plain", b"hello", False) for i in range(6)]
    of = A.analysed(spark.createDataFrame(rows, SCHEMA))
    got = {r.msg_id: r for r in A.summary(of).collect()}
    ids = {k: [f.id for f in r.findings] for k, r in got.items()}
    assert ids[1] == ["attachment_inventory"] and got[1].score == 0.15
    assert got[2].score == 0 and ids[2] == ["attachment_inventory"]
    assert ids[3] == ["dangerous_attachment", "double_extension", "attachment_inventory"] and got[3].score == 1.0
    assert ids[4] == ["many_attachments", "attachment_inventory"] and got[4].findings[0].n == 6
    assert A.summary(of.where(F.lit(False))).count() == 0
