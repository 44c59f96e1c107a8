"""Document formats as data sources: odd values there and back, ranges, columns left out, foreign files, failed jobs."""

import os
import zlib

import pytest

from tessera.sources import formats

ODD = ["", " ", "a\nb\n", "\n", "tab\tand\r\nreturn", "(par\\en) <hex> /F1 Tf", "é中\U0001f600﻿", "_x0041_ \x01", "x" * 70_000, None, "same", "same"]


@pytest.fixture(scope="module")
def known(spark):
    return formats.register(spark)


def test_pdf_there_and_back(known, tmp_path):
    path = f"{tmp_path}/pdf"
    df = known.createDataFrame([(str(i), s) for i, s in enumerate(ODD)], "label string, page_text string").coalesce(2)
    df.write.format("pages_pdf").option("rowsPerFile", 5).mode("append").save(path)
    got = known.read.format("pages_pdf").option("rangeBytes", 700).load(path)
    assert got.rdd.getNumPartitions() > len([f for f in os.listdir(path) if f.endswith(".pdf")]) >= 3
    assert {int(r.label): r.page_text for r in got.collect()} == {i: s or "" for i, s in enumerate(ODD)}
    numbers = known.read.format("pages_pdf").schema("name string, page_number long").load(path).groupBy("name").max("page_number").collect()
    assert sum(r[1] for r in numbers) == len(ODD) and not [f for f in os.listdir(path) if f.startswith("_temporary")]


def test_pdf_of_others(known, tmp_path):
    """A nested page tree, two content streams, ranges and ligatures in the font's map, literal strings, an older table."""
    cmap = b"1 beginbfrange\n<0001> <0003> <0061>\nendbfrange\n1 beginbfchar\n<0010> <00660069>\nendbfchar"
    packed = zlib.compress(b"BT /F9 8 Tf [<0001 0002> -20 <0010>] TJ ET")
    bodies = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 >>", 3: b"<< /Type /Pages /Kids [5 0 R] /Count 1 >>",
        4: b"<< /Type /Page /Contents 8 0 R >>", 5: b"<< /Type /Page /Resources << /Font << /F9 6 0 R >> >> /Contents [9 0 R 10 0 R] >>",
        6: b"<< /Type /Font /ToUnicode 7 0 R >>", 7: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap), 8: b"<< >>\nstream\nBT (one \\(1\\)) Tj T* (two) Tj ET\nendstream",
        9: b"<< /Filter /FlateDecode >>\nstream\n" + packed + b"\nendstream", 10: b"<< >>\nstream\nBT 0 -9 Td <0003> Tj ET\nendstream",
    }
    out, at = b"%PDF-1.4\n", {}
    for n, b in bodies.items():
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, b)
    first = len(out)
    out += b"xref\n0 9\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % at[n] for n in range(1, 9)) + b"trailer\n<< /Root 1 0 R >>\n"
    last = len(out)
    out += b"xref\n9 2\n" + b"".join(b"%010d 00000 n \n" % at[n] for n in (9, 10)) + b"trailer\n<< /Prev %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (first, last)
    (tmp_path / "f.pdf").write_bytes(out)
    got = known.read.format("pages_pdf").load(str(tmp_path)).orderBy("page_number").collect()
    assert [(r.page_number, r.label, r.page_text) for r in got] == [(1, None, "abfi\nc"), (2, None, "one (1)\ntwo")]


def test_workbook_there_and_back(known, tmp_path):
    path = f"{tmp_path}/xlsx"
    known.createDataFrame([(i, s, None) for i, s in enumerate(ODD)], "id long, text string, more string").write.format("rows_xlsx").option("rowsPerFile", 4).mode("append").save(path)
    got = {int(r.id): r.text for r in known.read.format("rows_xlsx").schema("text string, id string").load(path).collect()}
    assert got == dict(enumerate(ODD))
    assert [formats.column_at(f"{formats.column(i)}7", -1) for i in (0, 25, 26, 701, 702)] == [0, 25, 26, 701, 702]


def test_arrays_there_and_back(known, tmp_path):
    path = f"{tmp_path}/npz"
    rows = [(i, None if i % 7 == 0 else [float(x) / 3 for x in range(i % 5)], i % 2 == 0) for i in range(1000)]
    known.createDataFrame(rows, "id long, v array<double>, even boolean").coalesce(1).write.format("arrays_npz").option("rowsPerFile", 600).mode("append").save(path)
    x = known.read.format("arrays_npz").option("rangeBytes", 1000).schema("v array<double>, id long").load(path)
    assert x.rdd.getNumPartitions() > 4 and {r.id: r.v for r in x.collect()} == {i: v for i, v, _ in rows}
    assert known.read.format("arrays_npz").schema("even boolean").load(path).filter("even").count() == 500
    known.createDataFrame(rows[:3], "id long, v array<double>, even boolean").write.format("arrays_npz").mode("overwrite").save(path)
    assert known.read.format("arrays_npz").schema("id long").load(path).count() == 3


def test_failed_and_empty_jobs_leave_nothing(known, tmp_path):
    path = f"{tmp_path}/none"
    with pytest.raises(Exception, match="holds no numbers"):
        known.createDataFrame([("a",)], "s string").write.format("arrays_npz").mode("append").save(path)
    assert not os.path.exists(path) or not os.listdir(path)
    known.createDataFrame([], "label string, page_text string").write.format("pages_pdf").mode("append").save(path)
    assert known.read.format("pages_pdf").load(path).count() == 0
