"""Office files (DOCX, PPTX, XLSX) as rows of blocks, and blocks as office files.

``spark.read.format("office")`` reads files that the executors can open, in partitions of some files each; ``parsed`` reads the same from (path,
content) rows, as ``binaryFile`` gives them from any store.  Members of an archive are streamed, and their elements dropped
once they are read; what is held is one block (a table is one block) and a workbook's shared strings.

A file that cannot be read gives one row with ``error`` and nothing else; blocks read before the fault are kept.
"""

from __future__ import annotations

import datetime
import functools
import glob
import io
import os
import posixpath
import re
import struct
import zipfile
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from typing import IO
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, format string, page int, seq int, type string, text string, x0 double, y0 double, x1 double, y1 double, width double, height double, name string, error string"
FORMATS = ("docx", "pptx", "xlsx")
#: English metric units in a point.
EMU = 12700
#: The height of a block of text and the width of a page where a format has none.
LINE, PAGE_WIDTH = 20.0, 600.0
#: Members larger than this, unpacked, are taken for an attack.
MAX_MEMBER = 4 << 30
#: Members up to this size are often alike in many files: what they say is remembered.
SMALL = 1 << 16
#: Number formats of dates that workbooks need not declare.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


@functools.lru_cache(4096)
def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def attribute(e: ET.Element, name: str) -> str | None:
    """By local name, whatever its namespace."""
    return next((v for k, v in e.attrib.items() if local(k) == name), None)


class Small:
    """A package in memory, as far as it is plain: the little of ``ZipFile`` that readers ask for, at a part of its price.

    Small members are inflated at once, and checked; whatever is large, damaged or otherwise not plain is left to ``ZipFile``.
    """

    def __init__(self, data: bytes):
        self.data, self.infos = data, {}
        end = len(data) - 22
        mark, disk, first, here, n, size, at, comment = struct.unpack_from("<4s4H2LH", data, end) if end >= 0 else (b"",) * 8
        self.plain = mark == b"PK\5\6" and not (disk or first or comment) and here == n < 0xFFFF and at + size == end
        self.starts = [end if n == 0 else at] if self.plain else []
        for _ in range(n if self.plain else 0):
            if at + 46 > end:
                self.plain = False
                break
            mark, _, _, version, _, flags, method, _, _, crc, packed, full, named, extra, comment, _, _, _, start = struct.unpack_from("<4s4B4HL2L5H2L", data, at)
            name = data[at + 46 : at + 46 + named]
            # of the flags, only those of the level and of names in UTF-8 leave a member plain
            if mark != b"PK\1\2" or version > 20 or flags & ~0x806 or method not in (0, 8) or extra or comment or not name.isascii() or b"\0" in name:
                self.plain = False
                break
            self.infos[name.decode()] = (start, name, flags, method, crc, packed, full)
            self.starts.append(start)
            at += 46 + named
        self.plain = self.plain and at == end
        self.starts.sort()

    @functools.cached_property
    def whole(self) -> zipfile.ZipFile:
        return zipfile.ZipFile(io.BytesIO(self.data))

    def __enter__(self) -> Small | zipfile.ZipFile:
        return self if self.plain else self.whole

    def __exit__(self, *_) -> None:
        pass

    def namelist(self) -> list[str]:
        return list(self.infos)

    def getinfo(self, name: str) -> zipfile.ZipInfo:
        return self.whole.getinfo(name)

    def packed(self, name: str) -> tuple[bytes, int, int, int] | None:
        """Bytes as packed, method, checksum and size of a small member; none if it is not plain."""
        info = self.infos.get(name)
        if info is None:
            return None
        start, raw, flags, method, crc, packed, full = info
        begin = start + 30 + len(raw)
        after = bisect_right(self.starts, start)
        if full > SMALL or after == len(self.starts) or begin + packed > self.starts[after]:
            return None
        head = struct.unpack_from("<4s2B4H3L2H", self.data, start)
        if head[0] != b"PK\3\4" or head[3] != flags or head[11] or self.data[start + 30 : begin] != raw or head[10] != len(raw):
            return None
        return self.data[begin : begin + packed], method, crc, full

    def open(self, name: str) -> IO[bytes]:
        return self.whole.open(name)


def inflated(packed: bytes, method: int, crc: int, size: int) -> bytes | None:
    """None if checksum or size differ."""
    if method == 8:
        try:
            run = zlib.decompressobj(-15)
            packed = run.decompress(packed, size + 1)
        except zlib.error:
            return None
        if not run.eof:
            return None
    return packed if len(packed) == size and zlib.crc32(packed) == crc else None


def member(archive: zipfile.ZipFile | Small, name: str) -> IO[bytes]:
    packed = archive.packed(name) if isinstance(archive, Small) else None
    data = None if packed is None else inflated(*packed)
    if data is not None:
        return io.BytesIO(data)
    if archive.getinfo(name).file_size > MAX_MEMBER:
        raise ValueError(f"{name} is too large")
    return archive.open(name)


def children(source: IO[bytes], parent: str) -> Iterator[ET.Element]:
    """The children of the first element named ``parent``, each complete; forgotten after its turn.

    A small member is parsed at once, which is faster, unless it has a fault: then what comes before the fault is streamed.
    """
    try:
        data = source.read(SMALL + 1)
        if len(data) <= SMALL:
            yield from next((e for e in ET.fromstring(data).iter() if local(e.tag) == parent), ())
            return
    except (ET.ParseError, zipfile.BadZipFile, zipfile.zlib.error, EOFError):
        pass
    source.seek(0)
    depth, inside, at = 0, None, None
    for event, e in ET.iterparse(source, ("start", "end")):
        if event == "start":
            depth += 1
            if inside is None and local(e.tag) == parent:
                inside, at = depth, e
        else:
            if inside is not None and depth == inside + 1:
                yield e
                at.clear()
            elif depth == inside:
                return
            depth -= 1


def remembered(f: Callable) -> Callable:
    """``f`` of a member's stream, as a function of archive and name; small members of the same bytes are read once."""
    known = functools.lru_cache(256)(lambda data, *more: f(io.BytesIO(data), *more))
    # the same packed bytes need not be inflated again
    known_packed = functools.lru_cache(256)(lambda packed, *more: None if (data := inflated(*packed)) is None else (known(data, *more),))

    def run(archive: zipfile.ZipFile | Small, name: str, *more):
        packed = archive.packed(name) if isinstance(archive, Small) else None
        found = None if packed is None else known_packed(packed, *more)
        if found is not None:
            return found[0]
        with member(archive, name) as stream:
            return known(stream.read(), *more) if archive.getinfo(name).file_size <= SMALL else f(stream, *more)

    return run


def relations(archive: zipfile.ZipFile, of: str) -> dict[str, str]:
    """Targets by id of a member's relations, as names in the archive."""
    folder, base = posixpath.split(of)
    name = f"{folder}/_rels/{base}.rels"
    return targets_of(archive, name, folder) if name in archive.namelist() else {}


@remembered
def targets_of(stream: IO[bytes], folder: str) -> dict[str, str]:
    return {e.get("Id", ""): posixpath.normpath(posixpath.join("/", folder, e.get("Target", ""))).lstrip("/") for e in ET.parse(stream).getroot()}


def markdown(rows: list[list[str]]) -> str:
    """Rows as a table whose first row is its head; bars within cells are escaped."""
    wide = max((len(r) for r in rows), default=0)
    if not wide:
        return ""
    line = lambda r: "| " + " | ".join([c.replace("|", "\\|").strip() for c in r + [""] * (wide - len(r))]) + " |"
    return "\n".join([line(rows[0]), "|" + "---|" * wide, *map(line, rows[1:])])


# --- readers: each yields (page, type, text, (x0, y0, x1, y1), width, height, name)


def word_text(paragraph: ET.Element) -> str:
    out = []
    for e in paragraph.iter():
        tag = local(e.tag)
        if tag == "t":
            out.append(e.text or "")
        elif tag in ("tab", "br", "cr") and len(e.attrib) == 0 or tag == "br":
            out.append("\t" if tag == "tab" else "\n")
    return "".join(out)


def word_table(table: ET.Element) -> list[list[str]]:
    """Cells that span columns stand in each; those that go on downwards repeat the cell above."""
    rows: list[list[str]] = []
    for row in (e for e in table if local(e.tag) == "tr"):
        cells: list[str] = []
        for cell in (e for e in row if local(e.tag) == "tc"):
            span, goes_on = 1, False
            for e in cell.iter():
                if local(e.tag) == "gridSpan":
                    span = int(attribute(e, "val") or 1)
                elif local(e.tag) == "vMerge":
                    goes_on = attribute(e, "val") in (None, "continue")
            text = "\n".join(word_text(p) for p in cell if local(p.tag) == "p").strip()
            if goes_on and rows and len(cells) < len(rows[-1]):
                text = rows[-1][len(cells)]
            cells += [text] * span
        rows.append(cells)
    return rows


def word_kind(style: str) -> str:
    style = style.lower()
    if "heading 1" in style or "title" in style:
        return "title"
    return "subtitle" if re.match(r"heading\s+[2-9]", style) else "text"


@remembered
def styles_of(stream: IO[bytes]) -> dict[str, str]:
    """Names of styles by id."""
    styles: dict[str, str] = {}
    for style in children(stream, "styles"):
        named = next((attribute(e, "val") for e in style if local(e.tag) == "name"), None)
        if local(style.tag) == "style" and named:
            styles[attribute(style, "styleId") or ""] = named
    return styles


def read_docx(archive: zipfile.ZipFile) -> Iterator[tuple]:
    """Paragraphs and tables in order on one page; the page's height is not known before its end, so it is null."""
    styles: dict[str, str] = styles_of(archive, "word/styles.xml") if "word/styles.xml" in archive.namelist() else {}
    y = 0.0
    with member(archive, "word/document.xml") as f:
        for e in children(f, "body"):
            if local(e.tag) == "p":
                text = word_text(e).strip()
                if not text:
                    y += LINE / 2
                    continue
                own = next((attribute(s, "val") for s in e.iter() if local(s.tag) == "pStyle"), None) or ""
                yield 0, word_kind(styles.get(own, own)), text, (0.0, y, PAGE_WIDTH, y + LINE), PAGE_WIDTH, None, None
                y += LINE
            elif local(e.tag) == "tbl":
                rows = word_table(e)
                yield 0, "table", markdown(rows), (0.0, y, PAGE_WIDTH, y + LINE * len(rows)), PAGE_WIDTH, None, None
                y += LINE * len(rows)


def read_pptx(archive: zipfile.ZipFile) -> Iterator[tuple]:
    """A page for each slide; shapes with text, the title's placeholder told by its index."""
    width, height, order = 9144000, 6858000, []
    with member(archive, "ppt/presentation.xml") as f:
        for e in children(f, "presentation"):
            if local(e.tag) == "sldSz":
                width, height = int(e.get("cx", width)), int(e.get("cy", height))
            elif local(e.tag) == "sldIdLst":
                order = [next(v for k, v in s.attrib.items() if k.endswith("}id")) for s in e]
    targets = relations(archive, "ppt/presentation.xml")
    for page, slide in enumerate(targets[i] for i in order):
        with member(archive, slide) as f:
            for shape in children(f, "spTree"):
                if local(shape.tag) != "sp":
                    continue
                text, box, title = "", [0, 0, 0, 0], False
                for e in shape.iter():
                    tag = local(e.tag)
                    if tag == "ph":
                        title = e.get("idx", "0") == "0"
                    elif tag == "xfrm":
                        for part in e:
                            if local(part.tag) == "off":
                                box[:2] = int(part.get("x", 0)), int(part.get("y", 0))
                            elif local(part.tag) == "ext":
                                box[2:] = int(part.get("cx", 0)), int(part.get("cy", 0))
                    elif tag == "txBody":
                        text = "\n".join("".join((t.text or "") if local(t.tag) == "t" else "\v" for t in p.iter() if local(t.tag) in ("t", "br")) for p in e if local(p.tag) == "p").strip()
                if text:
                    x, y, w, h = box
                    yield page, "title" if title else "text", text, (x / EMU, y / EMU, (x + w) / EMU, (y + h) / EMU), width / EMU, height / EMU, None


@functools.lru_cache(4096)
def column_of(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


_WHOLE = re.compile(r"-?\d+").fullmatch


def cell_text(kind: str, value: str, shared: list[str], is_date: bool) -> str:
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind != "n" or not value:
        return value
    number = float(value)
    if is_date:
        moment = datetime.datetime(1899, 12, 30) + datetime.timedelta(seconds=round(number * 86400))
        return str(moment)
    return str(int(value)) if _WHOLE(value) else str(number)


@remembered
def sheets_of(stream: IO[bytes]) -> list[tuple[str, str]]:
    """Names and relations of a workbook's sheets."""
    return [(s.get("name", ""), attribute(s, "id") or "") for part in children(stream, "workbook") if local(part.tag) == "sheets" for s in part]


_PLAIN = "[^<>&\r\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]*+"
_CELL = rf'<c r="([A-Z]{{1,3}}[0-9]{{1,7}})"(?: s="([0-9]{{1,6}})")?(?: t="(n|s|b|e|str|inlineStr)")?>(?:<v>({_PLAIN})</v>|<is><t(?: xml:space="preserve")?>({_PLAIN})</t></is>)</c>'
_HEAD = r'(?:<\?xml version="1\.0" encoding="UTF-8"(?: standalone="yes")?\?>\n?)?<worksheet xmlns="[a-z0-9:/.]+"><sheetData>'
_CELLS, _ROWS = re.compile(_CELL).findall, re.compile(r'<row r="([0-9]{1,7})">(.*?)</row>', re.S).findall
_SHEET_OF_CELLS = re.compile(rf'{_HEAD}(?:<row r="[0-9]{{1,7}}">(?:{re.sub(r"[(](?![?])", "(?:", _CELL)})*+</row>)*+</sheetData></worksheet>').fullmatch


def sheet_rows(source: IO[bytes]) -> Iterator[tuple[str | None, list[tuple]]]:
    """(number, cells) of rows; a cell: reference, style, kind, value, inline text.

    A small sheet of nothing but rows of plain cells, without any escape, is taken apart by patterns; all others are parsed.
    """
    if isinstance(source, io.BytesIO):
        try:
            text = source.getvalue().decode()
        except UnicodeDecodeError:
            text = ""
        if _SHEET_OF_CELLS(text):
            for number, cells in _ROWS(text):
                yield number, _CELLS(cells)
            return
    for row in children(source, "sheetData"):
        cells = []
        for c in row:
            kind = c.get("t")
            if kind == "inlineStr":
                value, inline = "", "".join([t.text or "" for t in c.iter() if local(t.tag) == "t"])
            else:
                value, inline = next((v.text or "" for v in c if local(v.tag) == "v"), ""), ""
            cells.append((c.get("r"), c.get("s"), kind, value, inline))
        yield row.get("r"), cells


def read_xlsx(archive: zipfile.ZipFile) -> Iterator[tuple]:
    """A page with one table for each sheet."""
    shared: list[str] = []
    if "xl/sharedStrings.xml" in archive.namelist():
        with member(archive, "xl/sharedStrings.xml") as f:
            shared = ["".join(t.text or "" for t in e.iter() if local(t.tag) == "t") for e in children(f, "sst")]
    dates: list[bool] = []
    if "xl/styles.xml" in archive.namelist():
        own: set[int] = set()
        with member(archive, "xl/styles.xml") as f:
            for part in children(f, "styleSheet"):
                if local(part.tag) == "numFmts":
                    own = {int(e.get("numFmtId", 0)) for e in part if re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "")), re.I)}
                elif local(part.tag) == "cellXfs":
                    dates = [int(e.get("numFmtId", 0)) in DATE_FORMATS | own for e in part]
    targets = relations(archive, "xl/workbook.xml")
    sheets = [(name, targets[at]) for name, at in sheets_of(archive, "xl/workbook.xml")]
    for page, (name, target) in enumerate(sheets):
        rows: list[list[str]] = []
        with member(archive, target) as f:
            for number, found in sheet_rows(f):
                cells: list[str] = []
                for reference, style, kind, value, inline in found:
                    if reference:
                        at = column_of(reference)
                        if at > len(cells):
                            cells += [""] * (at - len(cells))
                    if kind == "inlineStr":
                        cells.append(inline)
                    else:
                        form = int(style or 0)
                        cells.append(cell_text(kind or "n", value, shared, form < len(dates) and dates[form]))
                number = int(number or len(rows) + 1)
                if number - 1 > len(rows):
                    rows += [[] for _ in range(number - 1 - len(rows))]
                rows.append(cells)
        width, height = max(max((len(r) for r in rows), default=1) * 80.0, 400.0), max(len(rows) * LINE, 100.0)
        yield page, "table", markdown(rows) if rows else "*Empty sheet*", (0.0, 0.0, width, height), width, height, name


READERS = {"docx": read_docx, "pptx": read_pptx, "xlsx": read_xlsx}


def rows_of(path: str, stream: IO[bytes] | bytes, kind: str) -> Iterator[tuple]:
    """Rows of SCHEMA of a file's stream or bytes; what goes wrong is the last row's ``error``."""
    seq = 0
    try:
        if kind not in READERS:
            raise ValueError("not an office file")
        with Small(stream) if isinstance(stream, bytes) else zipfile.ZipFile(stream) as archive:
            for page, block, text, box, width, height, name in READERS[kind](archive):
                yield path, kind, page, seq, block, text, *box, width, height, name, None
                seq += 1
    except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, IndexError, OverflowError, EOFError, OSError, NotImplementedError, RuntimeError, StopIteration, zipfile.zlib.error) as fault:
        yield path, kind, *[None] * 11, f"{type(fault).__name__}: {fault}"


def extension(path: str) -> str:
    return path.rpartition(".")[2].lower() if "." in posixpath.basename(path) else ""


# --- Spark


class FileRange(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class OfficeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.each = options.get("path", ""), max(1, int(options.get("filesPerPartition", 32)))
        self.kinds = [k.strip().lower() for k in options.get("formats", ",".join(FORMATS)).split(",")]

    def partitions(self) -> list[FileRange]:
        """Ranges of the files, in order of their names."""
        at = self.path.removeprefix("file://")
        if os.path.isdir(at):
            found = [os.path.join(d, n) for d, _, names in os.walk(at) for n in names]
        else:
            found = glob.glob(at, recursive=True)
            if not found and not glob.has_magic(at):
                raise FileNotFoundError(at)
        found = sorted(p for p in found if extension(p) in self.kinds and os.path.isfile(p) and not os.path.basename(p).startswith(("~$", ".", "_")))
        return [FileRange(found[i : i + self.each]) for i in range(0, len(found), self.each)] or [FileRange([])]

    def read(self, partition: FileRange) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                with open(path, "rb") as f:
                    yield from rows_of(path, f, extension(path))
            except OSError as fault:
                yield path, extension(path), *[None] * 11, f"{type(fault).__name__}: {fault}"


class OfficeSource(DataSource):
    """``format("office")``; options: path (a file, folder or pattern), formats (comma-separated), filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "office"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return OfficeReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``format("office")`` known to a session."""
    spark.dataSource.register(OfficeSource)


_NAMES = [c.strip().split()[0] for c in SCHEMA.split(",")]
_KINDS = {"page": pa.int32(), "seq": pa.int32(), **dict.fromkeys(("x0", "y0", "x1", "y1", "width", "height"), pa.float64())}


def blocks_of(files: Iterable[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA of files; many files of few blocks make one batch, long blocks end it early."""
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, _KINDS.get(n, pa.string())) for n, c in zip(_NAMES, zip(*rows))], _NAMES)
    held: list[tuple] = []
    size = 0
    for path, data in files:
        for row in rows_of(path, data, extension(path)):
            held.append(row)
            size += len(row[5] or "")
            if len(held) == 1024 or size > 1 << 20:
                yield batch(held)
                held, size = [], 0
    if held:
        yield batch(held)


def parsed(files: DataFrame) -> DataFrame:
    """Blocks of (path, content) rows; a null content is an error row, as is a path of another extension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def contents() -> Iterator[tuple[str, bytes]]:
            for b in batches:
                for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                    yield path or "", b"" if not content.is_valid else content.as_buffer().to_pybytes()

        return blocks_of(contents())

    return files.select("path", "content").mapInArrow(run, SCHEMA)


# --- writers

_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_SLIDE = "http://schemas.openxmlformats.org/presentationml/2006/main"
_DRAW = "http://schemas.openxmlformats.org/drawingml/2006/main"
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_KIND = "application/vnd.openxmlformats-officedocument"
#: Characters that XML cannot hold.
_BARRED = re.compile("[^\t\n\r\\x20-\\ud7ff\\ue000-\\ufffd\\U00010000-\\U0010ffff]")


def safe(text: str) -> str:
    if text.isalnum() and text.isascii():
        return text
    return escape(_BARRED.sub("\ufffd", text)).replace("\r", "&#13;")


def deflated(name: str, text: str, start: int) -> tuple[bytes, bytes]:
    """A member and its entry in the directory, as it stands at ``start``."""
    data, raw = text.encode(), name.encode()
    body = zlib.compress(data, 1, -15)
    # version 2.0, names in UTF-8, deflated, 1 January 1980
    about = struct.pack("<5H3L2H", 20, 0x800, 8, 0, 33, zlib.crc32(data), len(body), len(data), len(raw), 0)
    return b"".join((b"PK\3\4", about, raw, body)), b"".join((b"PK\1\2", b"\x14\0", about, struct.pack("<3H2L", 0, 0, 0, 0, start), raw))


@functools.lru_cache(64)
def opening(types: tuple[tuple[str, str], ...], main: str, members: tuple[tuple[str, str], ...]) -> tuple[bytes, bytes, int]:
    """The members that many packages begin with, their entries and number, packed once."""
    overrides = "".join(f'<Override PartName="/{name}" ContentType="{_KIND}.{kind}+xml"/>' for name, kind in types)
    defaults = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    first = {"[Content_Types].xml": f'<Types xmlns="{_TYPES}">{defaults}{overrides}</Types>', "_rels/.rels": f'<Relationships xmlns="{_RELS}"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="{main}"/></Relationships>'}
    out, entries = b"", b""
    for name, text in [*first.items(), *members]:
        body, entry = deflated(name, _XML + text, len(out))
        out, entries = out + body, entries + entry
    return out, entries, len(first) + len(members)


def archive(members: dict[str, str], types: dict[str, str], main: str, shared: dict[str, str] | None = None) -> bytes:
    """A package of the members; types: content type by member.  ``shared`` members are alike in many packages."""
    begun, entries, n = opening(tuple(types.items()), main, tuple((shared or {}).items()))
    n += len(members)
    out, listed, at = [begun], [entries], len(begun)
    if n >= 0xFFFF or sum(map(len, members.values())) >= 1 << 29:  # beyond the plain format
        return large(members, types, main, shared)
    for name, text in members.items():
        body, entry = deflated(name, _XML + text, at)
        out.append(body)
        listed.append(entry)
        at += len(body)
    return b"".join((*out, *listed, struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, n, n, sum(map(len, listed)), at, 0)))


def large(members: dict[str, str], types: dict[str, str], main: str, shared: dict[str, str] | None = None) -> bytes:
    """A package of any size."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, zipfile.ZipFile(io.BytesIO(archive({}, types, main, shared))) as begun:
        for name in begun.namelist():
            z.writestr(name, begun.read(name))
        for name, text in members.items():
            z.writestr(name, _XML + text)
    return out.getvalue()


def links(targets: list[tuple[str, str]]) -> str:
    return f'<Relationships xmlns="{_RELS}">' + "".join(f'<Relationship Id="r{i}" Type="{_OFFICE}/{kind}" Target={quoteattr(target)}/>' for i, (kind, target) in enumerate(targets, 1)) + "</Relationships>"


def docx(blocks: list[tuple[str, str | list[list[str]]]]) -> bytes:
    """blocks: (type, text), or ("table", rows)."""
    styles = {"title": "Heading1", "subtitle": "Heading2"}

    def paragraph(text: str, style: str | None = None) -> str:
        runs = "<w:br/>".join("<w:tab/>".join(f'<w:t xml:space="preserve">{safe(t)}</w:t>' for t in line.split("\t")) for line in text.split("\n"))
        return f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}<w:r>{runs}</w:r></w:p>'

    def table(rows: list[list[str]]) -> str:
        return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"

    body = "".join(table(x) if isinstance(x, list) else paragraph(x, styles.get(kind)) for kind, x in blocks)
    named = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{n}"><w:name w:val="heading {n}"/></w:style>' for n in (1, 2))
    shared = {"word/styles.xml": f'<w:styles xmlns:w="{_WORD}">{named}</w:styles>', "word/_rels/document.xml.rels": links([("styles", "styles.xml")])}
    members = {"word/document.xml": f'<w:document xmlns:w="{_WORD}"><w:body>{body}</w:body></w:document>'}
    return archive(members, {"word/document.xml": "wordprocessingml.document.main", "word/styles.xml": "wordprocessingml.styles"}, "word/document.xml", shared)


def pptx(slides: list[list[tuple[str, str, float, float, float, float]]], width: float = 720.0, height: float = 540.0) -> bytes:
    """slides: shapes (type, text, x0, y0, x1, y1) in points."""
    units = lambda v: round(v * EMU)
    members, targets = {}, []
    for n, shapes in enumerate(slides, 1):
        out = []
        for i, (kind, text, x0, y0, x1, y1) in enumerate(shapes, 2):
            place = '<p:ph type="title"/>' if kind == "title" else ""
            lines = "".join(f"<a:p><a:r><a:t>{safe(t)}</a:t></a:r></a:p>" for t in text.split("\n"))
            box = f'<a:xfrm><a:off x="{units(x0)}" y="{units(y0)}"/><a:ext cx="{units(x1) - units(x0)}" cy="{units(y1) - units(y0)}"/></a:xfrm>'
            out.append(f'<p:sp><p:nvSpPr><p:cNvPr id="{i}" name="s{i}"/><p:cNvSpPr/><p:nvPr>{place}</p:nvPr></p:nvSpPr><p:spPr>{box}</p:spPr><p:txBody><a:bodyPr/>{lines}</p:txBody></p:sp>')
        members[f"ppt/slides/slide{n}.xml"] = f'<p:sld xmlns:p="{_SLIDE}" xmlns:a="{_DRAW}"><p:cSld><p:spTree>{"".join(out)}</p:spTree></p:cSld></p:sld>'
        targets.append(("slide", f"slides/slide{n}.xml"))
    ids = "".join(f'<p:sldId id="{255 + n}" r:id="r{n}"/>' for n in range(1, len(slides) + 1))
    types = {name: "presentationml.slide" for name in members}
    members["ppt/presentation.xml"] = f'<p:presentation xmlns:p="{_SLIDE}" xmlns:r="{_OFFICE}"><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="{units(width)}" cy="{units(height)}"/></p:presentation>'
    members["ppt/_rels/presentation.xml.rels"] = links(targets)
    return archive(members, types | {"ppt/presentation.xml": "presentationml.presentation.main"}, "ppt/presentation.xml")


@functools.lru_cache(4096)
def column_name(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, rest = divmod(i - 1, 26)
        out = chr(65 + rest) + out
    return out


@functools.lru_cache(64)
def book(names: tuple[str, ...], targets: tuple[tuple[str, str], ...]) -> dict[str, str]:
    """The members of a workbook that name its sheets."""
    listed = "".join(f'<sheet name={quoteattr(name)} sheetId="{n}" r:id="r{n}"/>' for n, name in enumerate(names, 1))
    return {"xl/workbook.xml": f'<workbook xmlns="{_SHEET}" xmlns:r="{_OFFICE}"><sheets>{listed}</sheets></workbook>', "xl/_rels/workbook.xml.rels": links(list(targets))}


def xlsx(sheets: list[tuple[str, list[list]]]) -> bytes:
    """sheets: (name, rows); numbers stay numbers, null cells are left out."""
    members, targets = {}, []

    def cell(at: str, value) -> str:
        if value is None:
            return ""
        if isinstance(value, str):
            return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{safe(value)}</t></is></c>'
        if isinstance(value, bool):
            return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f'<c r="{at}"><v>{value!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{safe(str(value))}</t></is></c>'

    for n, (_, rows) in enumerate(sheets, 1):
        columns = [column_name(j) for j in range(max(map(len, rows), default=0))]
        data = "".join([f'<row r="{i}">{"".join([cell(f"{at}{i}", v) for at, v in zip(columns, r)])}</row>' for i, r in enumerate(rows, 1)])
        members[f"xl/worksheets/sheet{n}.xml"] = f'<worksheet xmlns="{_SHEET}"><sheetData>{data}</sheetData></worksheet>'
        targets.append(("worksheet", f"worksheets/sheet{n}.xml"))
    types = {name: "spreadsheetml.worksheet" for name in members}
    shared = book(tuple(name for name, _ in sheets), tuple(targets))
    return archive(members, types | {"xl/workbook.xml": "spreadsheetml.sheet.main"}, "xl/workbook.xml", shared)
