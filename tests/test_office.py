"""Office files through the data source and from rows: whole, damaged, missing and odd ones."""

import io
import random
import zipfile

import pytest

from docweave.sources import office as O

ROWS = [["h|1", "h2"], ["1", " two "]]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("office")
    (at / "sub").mkdir()
    (at / "a.docx").write_bytes(O.docx([("title", "T & <x>"), ("text", ""), ("text", "tab\there\nline"), ("table", ROWS), ("subtitle", "é 漢字"), ("text", "bad\x00char")]))
    (at / "sub" / "b.pptx").write_bytes(O.pptx([[("title", "Hi", 1, 2, 3.5, 4), ("text", "x\ny", 0, 0, 10, 10), ("text", " ", 0, 0, 1, 1)], [], [("text", "z", 1, 1, 2, 2)]]))
    (at / "c.xlsx").write_bytes(O.xlsx([("S&1", [["a", "b"], [1, 2.5], [None, "x|y"], [True, "  "]]), ("E", [])]))
    (at / "cut.docx").write_bytes((at / "a.docx").read_bytes()[:300])
    (at / "no.xlsx").write_bytes(b"not an archive")
    (at / "none.pptx").write_bytes(b"")
    (at / "~$lock.docx").write_bytes(b"x")
    (at / "other.txt").write_bytes(b"x")
    broken = io.BytesIO()
    with zipfile.ZipFile(broken, "w") as z:
        z.writestr("word/document.xml", "<w:document xmlns:w='w'><w:body><w:p><w:r><w:t>first</w:t></w:r></w:p><w:p><w:r></w:body>")
    (at / "broken.docx").write_bytes(broken.getvalue())
    return at


WANT = {
    "a.docx": [(0, 0, "title", "T & <x>", 0.0), (0, 1, "text", "tab\there\nline", 30.0), (0, 2, "table", "| h\\|1 | h2 |\n|---|---|\n| 1 | two |", 50.0), (0, 3, "subtitle", "é 漢字", 90.0), (0, 4, "text", "bad�char", 110.0)],
    "b.pptx": [(0, 0, "title", "Hi", 2.0), (0, 1, "text", "x\ny", 0.0), (2, 2, "text", "z", 1.0)],
    "c.xlsx": [(0, 0, "table", "| a | b |\n|---|---|\n| 1 | 2.5 |\n|  | x\\|y |\n| True |  |", 0.0), (1, 1, "table", "*Empty sheet*", 0.0)],
    "broken.docx": [(0, 0, "text", "first", 0.0)],
}
ERRORS = {"cut.docx": "BadZipFile", "no.xlsx": "BadZipFile", "none.pptx": "BadZipFile", "broken.docx": "ParseError"}


def held(df):
    out, errors = {}, {}
    for r in df.collect():
        name = r.path.rpartition("/")[2]
        if r.error is None:
            out.setdefault(name, []).append((r.page, r.seq, r.type, r.text, r.y0))
        else:
            errors[name] = r.error.split(":")[0]
            assert r.page is None and r.text is None and r.format == O.extension(name)
    return {k: sorted(v) for k, v in out.items()}, errors


def test_data_source(spark, folder):
    O.register(spark)
    for each in (1, 3, 100):
        df = spark.read.format("office").option("filesPerPartition", each).load(str(folder))
        assert held(df) == (WANT, ERRORS)
        assert df.rdd.getNumPartitions() == -(-7 // each)
    only = spark.read.format("office").option("formats", "pptx").load(f"file://{folder}")
    assert held(only) == ({"b.pptx": WANT["b.pptx"]}, {"none.pptx": "BadZipFile"})
    by_pattern = spark.read.format("office").load(f"{folder}/*.xlsx")
    assert held(by_pattern)[0] == {"c.xlsx": WANT["c.xlsx"]}
    assert spark.read.format("office").load(f"{folder}/*.ppt*x").where("error IS NULL").count() == 0 and spark.read.format("office").load(f"{folder}/*.none").count() == 0
    with pytest.raises(Exception, match="FileNotFoundError|not exist|No such"):
        spark.read.format("office").load(f"{folder}/nowhere").count()


def test_rows_of_any_store_read_the_same(spark, folder):
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!~]*.{docx,pptx,xlsx}").load(str(folder))
    assert held(O.parsed(files)) == (WANT, {k: v for k, v in ERRORS.items() if k != "none.pptx"})  # Spark leaves empty files out
    odd = spark.createDataFrame([("x.docx", None, 1), (None, bytearray(b"x"), 2), ("y.txt", bytearray(b"x"), 3)], "path string, content binary, page int")
    assert sorted((r.path, r.error.split(":")[0]) for r in O.parsed(odd).collect()) == [("", "ValueError"), ("x.docx", "BadZipFile"), ("y.txt", "ValueError")]
    assert O.parsed(odd.limit(0)).count() == 0


def rows(kind, members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return [r[2:6] if r[-1] is None else r[-1] for r in O.rows_of("p", io.BytesIO(out.getvalue()), kind)]


def test_merged_cells_and_nested_tables():
    cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"
    inner = "<w:tbl><w:tr>" + cell("inner") + "</w:tr></w:tbl>"
    table = "<w:tbl><w:tr>" + cell("wide", '<w:gridSpan w:val="2"/>') + cell("tall", '<w:vMerge w:val="restart"/>') + "</w:tr><w:tr>" + cell("a") + f"<w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p>{inner}</w:tc>" + cell("", "<w:vMerge/>") + "</w:tr></w:tbl>"
    got = rows("docx", {"word/document.xml": f"<w:document xmlns:w='w'><w:body>{table}<w:p><w:pPr><w:pStyle w:val='Heading3'/></w:pPr><w:r><w:t>h</w:t></w:r></w:p></w:body></w:document>", "word/styles.xml": "<w:styles xmlns:w='w'><w:style w:styleId='Heading3'><w:name w:val='heading 3'/></w:style></w:styles>"})
    assert got[0][3].split("\n")[0] == "| wide | wide | tall |" and got[0][3].split("\n")[2] == "| a | b | tall |"
    assert got[1][2:] == ("subtitle", "h")


def test_sheets_with_gaps_dates_and_shared_strings():
    sheet = "<worksheet xmlns='s'><sheetData><row r='2'><c r='B2' t='s'><v>1</v></c><c r='C2' s='1'><v>45000.5</v></c><c r='AA2' t='b'><v>0</v></c></row><row r='4'><c r='A4'><v>-7</v></c><c t='e'><v>#N/A</v></c><c r='D4'><f>1+1</f></c></row></sheetData></worksheet>"
    got = rows(
        "xlsx",
        {
            "xl/workbook.xml": "<workbook xmlns='s' xmlns:r='r'><sheets><sheet name='One' r:id='q'/></sheets></workbook>",
            "xl/_rels/workbook.xml.rels": "<Relationships xmlns='x'><Relationship Id='q' Target='/xl/worksheets/any.xml'/></Relationships>",
            "xl/worksheets/any.xml": sheet,
            "xl/sharedStrings.xml": "<sst xmlns='s'><si><t>zero</t></si><si><r><t>o</t></r><r><t>ne</t></r></si></sst>",
            "xl/styles.xml": "<styleSheet xmlns='s'><numFmts><numFmt numFmtId='170' formatCode='yyyy\\-mm'/></numFmts><cellXfs><xf numFmtId='0'/><xf numFmtId='170'/></cellXfs></styleSheet>",
        },
    )
    lines = got[0][3].split("\n")
    assert len(lines) == 5 and set(lines[0]) == {"|", " "}
    assert lines[2].split(" | ")[1:3] == ["one", "2023-03-15 12:00:00"] and lines[2].endswith("| False |")
    assert lines[4].startswith("| -7 | #N/A |  |  |")
    assert rows("xlsx", {"xl/workbook.xml": "<workbook xmlns='s'><sheets><sheet name='One' id='q'/></sheets></workbook>"}) == ["KeyError: 'q'"]


def test_archives_are_streamed(spark):
    many = O.docx([("text", f"line {i}") for i in range(20_000)])
    seen = 0
    for r in O.rows_of("p.docx", io.BytesIO(many), "docx"):
        seen += 1
    assert seen == 20_000 and r[3] == 19_999


def test_alike_members_are_packed_and_read_once():
    """Packages share what is alike, and each keeps its own names, relations and styles."""
    import io
    import zipfile

    from docweave.sources import office

    files = {n: office.xlsx([(n, [["a", i], ["b", i + 1]])]) for i, n in enumerate(("one", "two", "one more", "two & <three>"))}
    office.opening.cache_clear()
    for i, (n, data) in enumerate(files.items()):
        assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None
        (row,) = office.rows_of("x.xlsx", io.BytesIO(data), "xlsx")
        assert row[5] == f"| a | {i} |\n|---|---|\n| b | {i + 1} |" and row[12] == n and row[13] is None
    for _ in range(3):
        office.xlsx([("one", [[1]])])
    assert office.opening.cache_info().misses == 1
    large = "x" * office.SMALL
    (row,) = office.rows_of("x.xlsx", io.BytesIO(office.xlsx([(large, [["a"]])])), "xlsx")
    assert row[12] == large


def blocks(data, kind):
    """By the plain reader and by ZipFile."""
    plain = list(O.rows_of(f"a.{kind}", data, kind))
    assert [repr(r) for r in plain] == [repr(r) for r in O.rows_of(f"a.{kind}", io.BytesIO(data), kind)]
    return plain


def test_plain_packages_are_read_without_zipfile_and_others_alike(monkeypatch):
    """Every small file was opened by ZipFile and its sheet parsed before."""
    rows = [["item", "flag", "price"], [1, "A", 1.5], [2, None, -3], ["a<b", "x|y", True], ["", " é ", 1e300], [], ["]]>", "a\r\nb", "\u0001"]]
    for sheets in ([("items", rows[:3])], [("items", rows), ("other", [])], [("s", [["n"], [7]])]):
        data = O.xlsx(sheets)
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert z.testzip() is None and len(z.namelist()) == 4 + len(sheets)
        got = blocks(data, "xlsx")
        assert [g[12] for g in got] == [n for n, _ in sheets] and all(g[13] is None for g in got)
    data = O.xlsx([("items", rows[:3])])
    assert blocks(data, "xlsx")[0][5] == "| item | flag | price |\n|---|---|---|\n| 1 | A | 1.5 |\n| 2 |  | -3 |"
    # bytes changed, cut and added anywhere give the same rows or the same error
    rng = random.Random(3)
    for _ in range(400):
        at, torn = rng.randrange(len(data)), bytearray(data)
        how = rng.randrange(3)
        if how == 0:
            torn[at] ^= 1 << rng.randrange(8)
        elif how == 1:
            del torn[at : at + rng.randrange(1, 40)]
        else:
            torn[at:at] = b"x" * rng.randrange(1, 9)
        blocks(bytes(torn), "xlsx")
    for sheet in ('<row><c><v>4</v></c><c r="D1" t="b"><v>1</v></c></row>', '<row r="3"><c r="B3" s="0"><v>5</v></c></row>', '<row r="1"><c r="A1" t="s"><v>9</v></c></row>', '<row r="1"><c r="A1" t="inlineStr"><v>5</v></c><c r="B1"><is><t>x</t></is></c></row>', '<row r="1"><c r="A1"><v>5</c></row>', '<row r="1"><c r="A1" t="str"><v>a]]&gt;b</v></c></row>'):
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
            for name in old.namelist():
                new.writestr(name, f'<worksheet xmlns="m"><sheetData>{sheet}</sheetData></worksheet>' if "sheet1" in name else old.read(name))
        blocks(out.getvalue(), "xlsx")
    monkeypatch.setattr(zipfile, "ZipFile", None)
    monkeypatch.setattr(O.ET, "fromstring", None)
    assert list(O.rows_of("a.xlsx", data, "xlsx"))[0][13] is None
