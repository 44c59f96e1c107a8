"""Document files as Spark data sources: PDF pages, workbook rows and array archives, read in ranges and written by tasks.

`register(spark)` makes the formats `pages_pdf`, `rows_xlsx` and `arrays_npz` known to `spark.read` and `df.write`. A
reader lists the files on the driver and opens none: a file of more than `rangeBytes` bytes is given to several tasks,
each of which finds its own range of pages or rows. A writer streams rows into files of at most `rowsPerFile` rows under
a temporary name; only the driver's commit moves the files of the attempts that count, so retried tasks leave nothing.
Files are reached through Arrow's file systems, hence on shared and remote folders too.
"""

from __future__ import annotations

import re
import uuid
import zipfile
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

RANGE_BYTES = 32 << 20
ROWS_PER_FILE = 2_000
#: Rows that a task hands over at once.
BATCH = 256


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


@dataclass
class Range(InputPartition):
    """Part `i` of `n` of a file."""

    path: str
    i: int
    n: int

    def of(self, rows: int) -> range:
        return range(rows * self.i // self.n, rows * (self.i + 1) // self.n)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class Reader(DataSourceReader):
    """Ranges of the files below `path` with the format's ending; `columns`, a comma-joined list, leaves others unread."""

    ending = ""
    splits = True

    def __init__(self, options: dict[str, str], schema: T.StructType) -> None:
        self.path, self.options, self.schema = options["path"], options, schema
        self.bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        files, root = place(self.path)
        found = files.get_file_info(pafs.FileSelector(root, recursive=True)) if files.get_file_info(root).type == pafs.FileType.Directory else [files.get_file_info(root)]
        out = []
        for f in found:
            hidden = any(p[:1] in ("_", ".") for p in f.path[len(root) :].split("/"))
            if f.type == pafs.FileType.File and f.path.endswith(self.ending) and not hidden:
                n = max(1, -(-f.size // self.bytes)) if self.splits else 1
                out += [Range(f.path, i, n) for i in range(n)]
        return out or [Range("", 0, 1)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        files, _ = place(self.path)
        arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in self.schema])
        rows = []
        with files.open_input_file(part.path) as f:
            for row in self.rows(f, part):
                rows.append(row)
                if len(rows) == BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def rows(self, f: pa.NativeFile, part: Range) -> Iterator[dict]:
        raise NotImplementedError


class Writer(DataSourceWriter):
    """Files of at most `rowsPerFile` rows; nothing stands under its final name before the commit."""

    ending = ""

    def __init__(self, options: dict[str, str], schema: T.StructType, overwrite: bool) -> None:
        self.path, self.schema, self.overwrite = options["path"], schema, overwrite
        self.most = int(options.get("rowsperfile", ROWS_PER_FILE))
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[T.Row]) -> Written:
        files, root = place(self.path)
        files.create_dir(f"{root}/{self.job}", recursive=True)
        names: list[str] = []
        row = next(iterator, None)
        while row is not None:
            names.append(f"part-{uuid.uuid4().hex}{self.ending}")
            with files.open_output_stream(f"{root}/{self.job}/{names[-1]}", compression=None) as f:
                body, n = self.begin(f), 0
                while row is not None and n < self.most:
                    body.add(row)
                    row, n = next(iterator, None), n + 1
                body.close()
        return Written(names)

    def begin(self, f: pa.NativeFile):
        raise NotImplementedError

    def commit(self, messages: list[Written | None]) -> None:
        files, root = place(self.path)
        files.create_dir(root, recursive=True)
        if self.overwrite:
            for f in files.get_file_info(pafs.FileSelector(root)):
                if f.type == pafs.FileType.File:
                    files.delete_file(f.path)
        for name in (n for m in messages if m for n in m.names):
            files.move(f"{root}/{self.job}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, root = place(self.path)
        if files.get_file_info(f"{root}/{self.job}").type == pafs.FileType.Directory:
            files.delete_dir(f"{root}/{self.job}")


def _arrow(t: T.DataType) -> pa.DataType:
    plain = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_()}
    return pa.list_(_arrow(t.elementType)) if isinstance(t, T.ArrayType) else plain[t.simpleString()]


# -- PDF pages


class PdfPages:
    """A PDF file under way: each row (label, page_text) is a page, its label the page's label.

    Characters are glyphs of one composite font, numbered as they come, two bytes each; the font's ToUnicode map, written
    at the end, says what they stand for. Line feeds are moves to the next line. A null text is a page that shows nothing.
    """

    def __init__(self, f: pa.NativeFile) -> None:
        self.f, self.at, self.offsets, self.pages, self.labels = f, 0, {}, [], []
        self.glyphs, self.shown = np.full(1 << 16, -1, np.int32), []  # a glyph's number by code unit, and the other way round
        self._put(b"%PDF-1.7\n")

    def _put(self, b: bytes) -> None:
        self.f.write(b)
        self.at += len(b)

    def _object(self, number: int, body: bytes) -> None:
        self.offsets[number] = self.at
        self._put(b"%d 0 obj\n%s\nendobj\n" % (number, body))

    def _stream(self, number: int, data: bytes) -> None:
        packed = zlib.compress(data)
        self._object(number, b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed))

    def add(self, row: T.Row) -> None:
        number, lines = 5 + 2 * len(self.pages), []
        for line in [] if row["page_text"] is None else row["page_text"].split("\n"):
            units = np.frombuffer(line.encode("utf-16-be"), ">u2")
            new = np.unique(units[self.glyphs[units] < 0])
            self.glyphs[new] = np.arange(len(self.shown), len(self.shown) + len(new))
            self.shown += new.tolist()
            lines.append(b"<%s> Tj" % self.glyphs[units].astype(">u2").tobytes().hex().encode())
        self._stream(number, b"BT /F1 10 Tf 12 TL 40 800 Td\n%s\nET" % b" T*\n".join(lines) if lines else b"")
        self._object(number + 1, b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % number)
        self.pages.append(number + 1)
        self.labels.append(str(row["label"]).encode("utf-16-be").hex().upper().encode())

    def close(self) -> None:
        pairs = [b"<%04X> <%04X>" % (g, u) for g, u in enumerate(self.shown)]
        maps = b"".join(b"%d beginbfchar\n%s\nendbfchar\n" % (len(p), b"\n".join(p)) for p in (pairs[i : i + 100] for i in range(0, len(pairs), 100)))
        self._stream(4, b"/CIDInit /ProcSet findresource begin begincmap\n1 begincodespacerange <0000> <FFFF> endcodespacerange\n%sendcmap end" % maps)
        self._object(3, b"<< /Type /Font /Subtype /Type0 /BaseFont /Text /Encoding /Identity-H /DescendantFonts [<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Text /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> >>] /ToUnicode 4 0 R >>")
        self._object(2, b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(self.pages), b" ".join(b"%d 0 R" % p for p in self.pages)))
        nums = b" ".join(b"%d << /P <FEFF%s> >>" % (i, s) for i, s in enumerate(self.labels))
        self._object(1, b"<< /Type /Catalog /Pages 2 0 R /PageLabels << /Nums [%s] >> >>" % nums)
        start, n = self.at, max(self.offsets) + 1
        self._put(b"xref\n0 %d\n0000000000 65535 f \n%s" % (n, b"".join(b"%010d 00000 n \n" % self.offsets[i] for i in range(1, n))))
        self._put(b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (n, start))


class PdfFile:
    """Objects of a PDF file with a classic cross-reference table, read one by one at their offsets."""

    UNKNOWN: dict[int, bytes] = {}

    def __init__(self, f: pa.NativeFile) -> None:
        self.f, self.offsets, self.fonts, self.tables, self.root = f, {}, {}, {}, None
        size = f.size()
        tail = self._bytes(max(0, size - 2048), size)
        found = re.findall(rb"startxref\s+(\d+)", tail)
        at = int(found[-1]) if found else None
        while at is not None and at < size:  # newer tables come first, so the first offset of a number counts
            table = self._bytes(at, size)
            head, _, rest = table.partition(b"trailer")
            if not head.lstrip().startswith(b"xref"):
                raise ValueError("no classic cross-reference table")
            number = 0
            for line in head.splitlines()[1:]:
                cells = line.split()
                if len(cells) == 2:
                    number = int(cells[0])
                elif len(cells) == 3:
                    if cells[2] == b"n":
                        self.offsets.setdefault(number, int(cells[0]))
                    number += 1
            self.root = self.root or self._ref(rest, b"Root")
            before = re.search(rb"/Prev\s+(\d+)", rest)
            at = int(before[1]) if before and int(before[1]) != at else None
        self.ends = sorted([*self.offsets.values(), size])

    def _bytes(self, start: int, end: int) -> bytes:
        self.f.seek(start)
        return self.f.read(end - start)

    @staticmethod
    def _ref(body: bytes, key: bytes) -> int | None:
        m = re.search(rb"/" + key + rb"\s+(\d+)\s+\d+\s+R", body)
        return int(m[1]) if m else None

    def get(self, number: int | None) -> bytes:
        if number not in self.offsets:
            return b""
        start = self.offsets[number]
        return self._bytes(start, self.ends[bisect_right(self.ends, start)])

    def stream(self, number: int | None) -> bytes:
        m = re.search(rb"stream\r?\n", body := self.get(number))
        if not m:
            return b""
        head, data = body[: m.start()], body[m.end() : body.rindex(b"endstream")]
        return zlib.decompressobj().decompress(data) if b"FlateDecode" in head else data

    def pages(self) -> list[int]:
        """Page objects in order; inner nodes of the page tree are opened, leaves of a flat tree are not."""
        out, todo = [], [self._ref(self.get(self.root), b"Pages")]
        while todo:
            number = todo.pop()
            body = self.get(number)
            kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
            if not kids:
                out.append(number)
                continue
            below = [int(k) for k in re.findall(rb"(\d+)\s+\d+\s+R", kids[1])]
            count = re.search(rb"/Count\s+(\d+)", body)
            if count and int(count[1]) == len(below) and (not below or b"/Kids" not in self.get(below[0])):
                out += below
            else:
                todo += reversed(below)
        return out

    def labels(self) -> dict[int, str]:
        nums = re.search(rb"/PageLabels\s*<<\s*/Nums\s*\[(.*?)\]", self.get(self.root), re.S)
        found = re.findall(rb"(\d+)\s*<<\s*/P\s*<([0-9A-Fa-f]*)>\s*>>", nums[1]) if nums else []
        return {int(i): bytes.fromhex(h.decode()).decode("utf-16") for i, h in found}

    def unicode(self, number: int) -> dict[int, bytes]:
        """Codes of a font and what they stand for in UTF-16, from bfchar and bfrange of its ToUnicode map."""
        if number not in self.fonts:
            cmap, known = self.stream(self._ref(self.get(number), b"ToUnicode")), {}
            for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
                known |= {int(a, 16): bytes.fromhex(b.decode()) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
            for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
                for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                    first = bytes.fromhex(c.decode())
                    known |= {int(a, 16) + i: first[:-2] + (int.from_bytes(first[-2:], "big") + i).to_bytes(2, "big") for i in range(int(b, 16) - int(a, 16) + 1)}
            self.fonts[number] = known
        return self.fonts[number]

    def plain(self, font: dict[int, bytes]) -> np.ndarray | None:
        """The map of a font as a table of code units, if every code stands for just one."""
        if id(font) not in self.tables:
            table = np.arange(1 << 16).astype(">u2")
            single = all(len(v) == 2 for v in font.values())
            if single and font:
                table[list(font)] = np.frombuffer(b"".join(font.values()), ">u2")
            self.tables[id(font)] = table if single else None
        return self.tables[id(font)]

    def text(self, page: int) -> str:
        """What a page shows: hexadecimal strings by the font's map, literal ones as Latin-1 where the font has none."""
        body = self.get(page)
        fonts = {name: self.unicode(int(n)) for name, n in re.findall(rb"/(\w+)\s+(\d+)\s+0\s+R", (re.search(rb"/Font\s*<<(.*?)>>", body, re.S) or [b"", b""])[1])}
        inside = re.search(rb"/Contents\s*\[(.*?)\]", body, re.S)
        parts = [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", inside[1])] if inside else [self._ref(body, b"Contents")]
        out, font, shown = [], self.UNKNOWN, False
        for m in re.finditer(rb"/(?P<font>\w+)\s+[\d.]+\s+Tf|<(?P<hex>[0-9A-Fa-f\s]*)>|\((?P<lit>(?:\\.|[^\\()])*)\)|(?P<move>\bT\*|\bT[dD]\b|'|\")", b"\n".join(map(self.stream, parts)), re.S):
            if m["font"] is not None:
                font = fonts.get(m["font"], self.UNKNOWN)
            elif m["move"] is not None:
                out += [b"\x00\n"] if shown else []
            else:
                shown = True
                if m["hex"] is not None:
                    codes = np.frombuffer(bytes.fromhex(m["hex"].decode()), ">u2")
                    if (plain := self.plain(font)) is not None:
                        out.append(plain[codes].tobytes())
                        continue
                    codes = codes.tolist()
                else:
                    codes = re.sub(rb"\\(.)", lambda e: {b"n": b"\n", b"t": b"\t", b"r": b"\r"}.get(e[1], e[1]), m["lit"], flags=re.S)
                out += [font.get(c, c.to_bytes(2, "big")) for c in codes]
        return b"".join(out).decode("utf-16-be", "replace")


class PdfReader(Reader):
    ending = ".pdf"

    def rows(self, f: pa.NativeFile, part: Range) -> Iterator[dict]:
        pdf = PdfFile(f)
        pages, labels = pdf.pages(), pdf.labels()
        wanted = {c.name for c in self.schema}
        for i in part.of(len(pages)):
            yield {"name": part.path.rsplit("/", 1)[-1], "page_number": i + 1, "label": labels.get(i)} | ({"page_text": pdf.text(pages[i])} if "page_text" in wanted else {})


class PdfWriter(Writer):
    ending = ".pdf"

    def begin(self, f: pa.NativeFile) -> PdfPages:
        return PdfPages(f)


# -- workbooks

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="rows" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def to_cell(s: str) -> str:
    """A text as a cell holds it: characters that XML lacks or folds become _xHHHH_, and what looks like that is guarded."""
    s = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", s)
    return escape(re.sub(r"[\x00-\x08\x0b-\x1f￾￿]", lambda m: f"_x{ord(m[0]):04X}_", s))


def from_cell(s: str) -> str:
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), s)


class Workbook:
    """A workbook under way: a sheet with a header row and cells of text, null where there is none."""

    def __init__(self, f: pa.NativeFile, names: list[str]) -> None:
        self.zip = zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED)
        for name, body in _PARTS.items():
            self.zip.writestr(name, body)
        self.sheet, self.n = self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True), 0
        self.sheet.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>'.encode())
        self._row(names)

    def _row(self, values: list) -> None:
        self.n += 1
        cells = "".join(f'<c r="{column(i)}{self.n}" t="inlineStr"><is><t xml:space="preserve">{to_cell(str(v))}</t></is></c>' for i, v in enumerate(values) if v is not None)
        self.sheet.write(f'<row r="{self.n}">{cells}</row>'.encode())

    def add(self, row: T.Row) -> None:
        self._row(list(row))

    def close(self) -> None:
        self.sheet.write(b"</sheetData></worksheet>")
        self.sheet.close()
        self.zip.close()


def column(i: int) -> str:
    """Letters of column i, counted from 0."""
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def column_at(cell: str | None, k: int) -> int:
    """Number of the column that a cell such as AB12 names, else k."""
    at = 0
    for x in re.match(r"[A-Z]*", cell or "")[0]:
        at = at * 26 + ord(x) - 64
    return at - 1 if at else k


class XlsxReader(Reader):
    """Rows of the first sheet by its header; columns that the schema lacks are passed over, rows without text left out."""

    ending = ".xlsx"
    splits = False  # a sheet is one deflated stream

    def rows(self, f: pa.NativeFile, part: Range) -> Iterator[dict]:
        m = f"{{{_MAIN}}}"
        with zipfile.ZipFile(f) as z:
            shared: list[str] = []
            if "xl/sharedStrings.xml" in z.namelist():
                shared = ["".join(t.text or "" for t in s.iter(f"{m}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind(f"{m}si")]
            sheets = [n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
            names: dict[int, str] | None = None
            with z.open(min(sheets, key=lambda n: int(re.search(r"\d+", n)[0]))) as sheet:
                for _, row in ElementTree.iterparse(sheet):
                    if row.tag != f"{m}row":
                        continue
                    cells = {}
                    for k, c in enumerate(row.iterfind(f"{m}c")):
                        value = c.find(f"{m}v")
                        text = "".join(t.text or "" for t in c.iter(f"{m}t")) if value is None else value.text or ""
                        cells[column_at(c.get("r"), k)] = shared[int(text)] if c.get("t") == "s" else from_cell(text)
                    row.clear()
                    if not any(v.strip() for v in cells.values()):
                        continue
                    if names is None:
                        names = cells
                    else:
                        got = {names[k]: v for k, v in cells.items() if k in names}
                        yield {c.name: got.get(c.name) for c in self.schema}


class XlsxWriter(Writer):
    ending = ".xlsx"

    def begin(self, f: pa.NativeFile) -> Workbook:
        return Workbook(f, self.schema.fieldNames())


# -- arrays


class Archive:
    """An archive under way: a plain column is an array; a column of arrays is its values, the rows' ends and where it is null."""

    def __init__(self, f: pa.NativeFile, schema: T.StructType) -> None:
        self.f, self.schema, self.rows = f, schema, []

    def add(self, row: T.Row) -> None:
        self.rows.append(row)

    def close(self) -> None:
        arrays = {}
        for i, c in enumerate(self.schema):
            if not isinstance(getattr(c.dataType, "elementType", c.dataType), (T.NumericType, T.BooleanType)):
                raise ValueError(f"{c.name} holds no numbers")
            values = [r[i] for r in self.rows]
            if isinstance(c.dataType, T.ArrayType):
                arrays[f"{c.name}.null"] = np.array([v is None for v in values])
                arrays[f"{c.name}.ends"] = np.cumsum([0, *[len(v or ()) for v in values]])
                values = [x for v in values for x in v or ()]
                if any(x is None for x in values):
                    raise ValueError(f"{c.name} has null entries, which arrays of numbers cannot hold")
            kind = _arrow(c.dataType.elementType if isinstance(c.dataType, T.ArrayType) else c.dataType)
            arrays[c.name] = np.array(values, kind.to_pandas_dtype())
        np.savez(self.f, **arrays)


class NpzReader(Reader):
    """Rows of archives, read in ranges: members are stored, not deflated, so a range is one seek into each of them."""

    ending = ".npz"

    def rows(self, f: pa.NativeFile, part: Range) -> Iterator[dict]:
        with zipfile.ZipFile(f) as z:

            def cut(member: str, start: int, end: int) -> np.ndarray:
                with z.open(f"{member}.npy") as x:
                    _, _, kind = head = self.head(x)
                    if len(head[0]) != 1:
                        raise ValueError(f"{member} has {len(head[0])} dimensions")
                    x.seek(x.tell() + start * kind.itemsize)
                    return np.frombuffer(x.read((end - start) * kind.itemsize), kind)

            lists = [c.name for c in self.schema if isinstance(c.dataType, T.ArrayType)]
            with z.open(f"{self.schema[0].name + ('.null' if lists and self.schema[0].name == lists[0] else '')}.npy") as x:
                span = part.of(self.head(x)[0][0])
            for at in range(span.start, span.stop, BATCH):
                end = min(at + BATCH, span.stop)
                got = {}
                for c in self.schema:
                    if c.name in lists:
                        ends, null = cut(f"{c.name}.ends", at, end + 1), cut(f"{c.name}.null", at, end)
                        flat = cut(c.name, int(ends[0]), int(ends[-1]))
                        got[c.name] = [None if n else flat[a - ends[0] : b - ends[0]].tolist() for n, a, b in zip(null, ends[:-1], ends[1:], strict=True)]
                    else:
                        got[c.name] = cut(c.name, at, end).tolist()
                for i in range(end - at):
                    yield {k: v[i] for k, v in got.items()}

    @staticmethod
    def head(x) -> tuple:
        version = np.lib.format.read_magic(x)
        return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(x)


class NpzWriter(Writer):
    ending = ".npz"

    def begin(self, f: pa.NativeFile) -> Archive:
        return Archive(f, self.schema)


# -- the formats


class _Files(DataSource):
    kinds: tuple[type[Reader], type[Writer]]

    def reader(self, schema: T.StructType) -> Reader:
        return self.kinds[0]({k.lower(): v for k, v in self.options.items()}, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return self.kinds[1]({k.lower(): v for k, v in self.options.items()}, schema, overwrite)


class PagesPdf(_Files):
    """(name, page_number, label, page_text) of PDF files; written from (label, page_text). A schema without page_text reads no page."""

    kinds = (PdfReader, PdfWriter)

    @classmethod
    def name(cls) -> str:
        return "pages_pdf"

    def schema(self) -> str:
        return "name string, page_number long, label string, page_text string"


class RowsXlsx(_Files):
    """Rows of texts by the header's names; the schema must be given."""

    kinds = (XlsxReader, XlsxWriter)

    @classmethod
    def name(cls) -> str:
        return "rows_xlsx"


class ArraysNpz(_Files):
    """Rows of numbers and of arrays of numbers; the schema must be given and its members alone are read."""

    kinds = (NpzReader, NpzWriter)

    @classmethod
    def name(cls) -> str:
        return "arrays_npz"


def register(spark: SparkSession) -> SparkSession:
    for kind in (PagesPdf, RowsXlsx, ArraysNpz):
        spark.dataSource.register(kind)
    return spark
