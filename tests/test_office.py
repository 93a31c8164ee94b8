"""Office files: what a reader sees of them, and masks written back with all else as it was."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from maskwright.operators import assemble as D
from maskwright.operators import mask as M
from maskwright.plans import office_bytes as B
from maskwright.sources import archive, office

FILE = "doc_id long, filename string, file_type string, content binary"
HREF = '<w:hyperlink r:id="{}">{}</w:hyperlink>'
NOTE = '<w:r><w:rPr><w:i/></w:rPr><w:{}Reference w:id="{}"/></w:r>'


def rich_docx():
    merged = (
        '<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>' + B.paragraph(B.run("wide")) + '</w:tc><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr>' + B.paragraph(B.run("tall")) + B.paragraph(B.run("two"))
        + "</w:tc></w:tr><w:tr><w:tc>" + B.paragraph("") + "</w:tc><w:tc>" + B.paragraph(B.run("Ivan")) + "</w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr>" + B.paragraph("") + "</w:tc></w:tr></w:tbl>"
    )
    box = B.paragraph("<w:r><w:pict><w:txbxContent>" + B.paragraph(B.run("boxed Ivan")) + "</w:txbxContent></w:pict></w:r>" + B.run("after box"))
    body = (
        B.paragraph(B.run("Hello ") + HREF.format("r1", B.run("site")) + B.run(" and ") + HREF.format("r9", B.run("none")) + NOTE.format("footnote", 1) + NOTE.format("endnote", 7))
        + B.paragraph("") + B.paragraph('<w:r><w:t>tab</w:t><w:tab/><w:t>and</w:t><w:br/><w:t xml:space="preserve"> line </w:t></w:r>') + merged + box + "<w:sectPr/>"
    )
    notes = '<w:footnote w:type="separator" w:id="-1">' + B.paragraph(B.run("sep")) + '</w:footnote><w:footnote w:id="1">' + B.paragraph(B.run("a note")) + B.table([["x", "y"]]) + B.paragraph(B.run("end")) + "</w:footnote>"
    return B.docx(body, [("r1", "https://example.com/?a=1&b=2")], footnotes=notes, header1=B.paragraph(B.run("Page of Ivan")))


def rich_xlsx():
    cells = {
        "One": {1: {1: ("s", "0", 0), 3: ("n", "45000", 1)}, 4: {1: ("n", "3", 0), 2: ("n", "2.50", 0), 3: ("b", "1", 0), 4: ("f", "Ivan", 0)}, 5: {2: ("inlineStr", " Ivan & Co ", 1), 3: ("e", "#N/A", 0)}},
        "Empty": {},
    }
    return B.xlsx(cells, ["Ivan Petrov"])


@pytest.fixture(scope="module")
def files(spark):
    rows = [(1, "a.docx", "docx", rich_docx()), (2, "b.xlsx", "xlsx", rich_xlsx()), (3, "c.docx", "docx", b"no zip"), (4, "d.xlsx", "xlsx", B.zipped({"x": "y"})), (5, "e.docx", "docx", None)]
    return spark.createDataFrame(rows, FILE)


@pytest.fixture(scope="module")
def decoded(files):
    return office.decode(files)


def test_document_text(decoded):
    start, end = D.TABLE_START, D.TABLE_END
    note = f"a note {start}x | y{end}end"
    lines = [f'Hello <a href="https://example.com/?a=1&b=2">site</a> and <a href="">none</a> [СНОСКА: {note}]  [СНОСКА: Сноска не найдена]'.replace("\n", " "), "tab\tand  line"]
    lines += [start, "wide | wide | tall two", " | Ivan | tall two", end, "after box"]
    got = {r.doc_id: r.text for r in decoded.body_texts().collect()}
    assert got == {1: "\n".join(lines)}


def test_cells(decoded):
    got = {(r.sheet, r.row_no, r.col_no): (r.value, r.is_formula) for r in decoded.cells.collect()}
    values = {(r, c): v for (s, r, c), (v, _) in got.items() if s == "One" and v is not None}
    assert values == {(1, 1): "Ivan Petrov", (1, 3): "2023-03-15 00:00:00", (4, 1): "3", (4, 2): "2.5", (4, 3): "True", (4, 4): "Ivan", (5, 2): " Ivan & Co ", (5, 3): "#N/A"}
    assert got["One", 1, 2] == (None, False) and got["One", 4, 4][1] and ("Empty", 0, 0) in got
    texts = {(r.sheet, r.text) for r in D.assemble_sheet_text(decoded.cells).collect()}
    assert texts == {("One", "Ivan Petrov | 2023-03-15 00:00:00\n3 | 2.5 | True | Ivan\nIvan & Co | #N/A"), ("Empty", "")}
    sheets = D.assemble_sheet_text(decoded.cells).join(decoded.cells.select("doc_id", "sheet", "sheet_no").distinct(), ["doc_id", "sheet"])
    assert D.assemble_workbook_text(sheets).first().text.index("One") < D.assemble_workbook_text(sheets).first().text.index("Empty")


def test_broken_files_are_errors(decoded):
    assert sorted((r.doc_id, r.error.split(":")[0]) for r in decoded.errors.collect()) == [(3, "BadZipFile"), (4, "KeyError"), (5, "BadZipFile")]


def test_masks_written_back(spark, files, decoded):
    values = spark.createDataFrame([(d, "Ivan", "[P<1>]", 1) for d in (1, 2)], "doc_id long, original_text string, mask string, ord long")
    out = office.masked_files(files.filter("doc_id < 3"), M.mask_runs(decoded.runs, values), M.mask_cells(decoded.cells, values))
    new = {r.doc_id: r for r in out.collect()}
    before, after = (zipfile.ZipFile(io.BytesIO(x)) for x in (new[1].content, new[1].masked))
    assert before.namelist() == after.namelist() and after.testzip() is None
    assert {n for n in before.namelist() if before.read(n) != after.read(n)} == {"word/document.xml", "word/header1.xml"}
    assert b'<w:highlight w:val="yellow"/></w:rPr><w:t xml:space="preserve">[P&lt;1&gt;]</w:t>' in after.read("word/header1.xml")
    assert before.read("word/document.xml").replace(B.run("Ivan").encode(), b"") .split(b"</w:tbl>")[0].count(b"<w:p>") == after.read("word/document.xml").split(b"</w:tbl>")[0].count(b"<w:p>")
    again = office.decode(out.drop("content").withColumnRenamed("masked", "content"))
    texts = {r.part: r.t for r in again.runs.groupBy("part").agg(F.concat_ws("|", F.array_sort(F.collect_list("text"))).alias("t")).collect()}
    assert "Ivan" not in "".join(texts.values()) and "[P<1>]" in texts["word/header1.xml"] and "boxed " in texts["word/document.xml"]
    cells = {(r.row_no, r.col_no): r.value for r in again.cells.filter("sheet = 'One'").collect()}
    assert cells[1, 1] == "[P<1>] Petrov" and cells[5, 2] == " [P<1>] & Co " and cells[4, 4] == "Ivan"  # formulas stay
    book = zipfile.ZipFile(io.BytesIO(new[2].masked))
    sheet, styles = book.read("xl/worksheets/sheet1.xml").decode(), book.read("xl/styles.xml").decode()
    assert 'r="A1" s="2" t="inlineStr"' in sheet and 'r="B5" s="3"' in sheet and styles.count("<xf ") == 4 and 'fillId="1" applyFill="1"' in styles and "FFFFF2CC" in styles
    plain = office.masked_files(files.filter("doc_id = 2"), cells=M.mask_cells(decoded.cells, values), highlight_cells=False).first()
    assert 'r="A1" s="0" t="inlineStr"' in zipfile.ZipFile(io.BytesIO(plain.masked)).read("xl/worksheets/sheet1.xml").decode()


def test_unchanged_files_stay_byte_for_byte(files):
    out = office.masked_files(files)
    assert out.filter("masked <=> content").count() == 5


def test_files_in_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in {"A.DOCX": rich_docx(), "b.xlsx": rich_xlsx(), "c.txt": b"text"}.items():
        (tmp_path / "in" / name).write_bytes(data)
    found = office.office_files(spark, str(tmp_path))
    assert sorted((r.filename, r.file_type) for r in found.collect()) == [("A.DOCX", "docx"), ("b.xlsx", "xlsx")]
    assert office.decode(found, str(tmp_path / "parts")).body_texts().count() == 1
    assert office.decode(found.limit(0)).cells.count() == 0


def test_plain_text_takes_one_row_a_paragraph(spark):
    body = B.paragraph(B.run("a") + B.run("b")) + B.table([["x", "y"], ["", "z"]])
    parts = office.decode(spark.createDataFrame([(1, "a.docx", "docx", B.docx(body))], FILE), kinds=office.BODY)
    assert sorted((r.kind, r.text) for r in parts.parts.collect()) == [("paragraph", t) for t in ("", "ab", "x", "y", "z")]
    start, end = D.TABLE_START, D.TABLE_END
    assert parts.body_texts().first().text == "\n".join(["ab", start, "x | y", " | z", end])


def test_plain_tables_are_one_row_each(spark):
    """A table of plain cells is a row, whatever its size; one with a merged cell, a link or a note comes by its paragraphs. The texts are the same."""
    plain = B.table([["x", " y\n&z "], ["", "<w"]])
    two = "<w:tbl><w:tr><w:tc><w:tcPr><w:tcW w:w=\"9\"/></w:tcPr>" + B.paragraph(B.run(" a ")) + B.paragraph("") + B.paragraph(B.run("b") + B.run("c")) + "</w:tc></w:tr></w:tbl>"
    merged = '<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>' + B.paragraph(B.run("wide")) + "</w:tc></w:tr></w:tbl>"
    linked = "<w:tbl><w:tr><w:tc>" + B.paragraph(HREF.format("r1", B.run("site"))) + "</w:tc></w:tr></w:tbl>"
    body = B.paragraph(B.run("a") + B.run("b")) + plain + two + merged + linked + "<w:tbl></w:tbl>" + B.paragraph(B.run("end"))
    files = spark.createDataFrame([(1, "a.docx", "docx", B.docx(body, [("r1", "u")]))], FILE)
    by = {r.kind: r.n for r in office.decode(files, kinds=office.ELEMENTS).parts.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert by == {"link": 1, "paragraph": 4, "table": 3, "grid": 1, "piece": 1}
    start, end = D.TABLE_START, D.TABLE_END
    lines = ["ab", start, "x | y &z", " | <w", end, start, "a  bc", end, start, "wide | wide", end, start, '<a href="u">site</a>', end, "end"]
    for kinds in (office.ELEMENTS, office.BODY, None):
        assert office.decode(files, kinds=kinds).body_texts().first().text == "\n".join(lines)


@pytest.mark.parametrize("name_space", ["w:", ""])
def test_plain_blocks_are_what_the_events_give(monkeypatch, name_space):
    """Plain blocks are cut out before the parser sees a part; where they aren't blocks, or don't mean the format's own names, nothing is."""
    box = "<w:r><w:pict><w:txbxContent>" + B.paragraph(B.run("in")) + B.table([["t"]]) + "</w:txbxContent></w:pict></w:r>"
    nested = "<w:tbl><w:tr><w:tc>" + B.table([["deep"]]) + B.paragraph(B.run("x")) + "</w:tc></w:tr></w:tbl>"
    bodies = [
        B.paragraph(B.run("a") + B.run("") + B.run("b\r\n&amp;")) + B.table([["x", ""], ["y"]]) + B.paragraph(box + B.run("after")) + nested,
        '<w:p w:rsidR="1"><w:pPr><w:jc w:val="left"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>one</w:t><w:t>two</w:t></w:r></w:p><w:p/>' + B.paragraph("<w:r><w:tab/></w:r>"),
        "<!-- " + B.paragraph(B.run("no")) + " -->" + B.paragraph(B.run("yes")) + '<x xmlns:w="other">' + B.paragraph(B.run("other")) + "</x>",
        "<w:sdt><w:sdtContent>" + B.paragraph(B.run("inner")) + B.table([["c"]]) + "</w:sdtContent></w:sdt>" + B.paragraph(B.run("&#65;")) + "<w:tbl><w:tr></w:tr></w:tbl>",
        '<x xmlns:w="other">' + B.paragraph(B.run("other")) + "</x>" + B.paragraph("<w:r><w:t>\x01</w:t></w:r>" if name_space else B.run("fine")),
    ]

    def read(data):
        try:
            return list(office._docx(office.Archive(data), None))
        except office.expat.ExpatError:
            return "broken"

    files = [B.docx(x) for x in bodies]
    if not name_space:
        files = [B.zipped({n: z.read(n).decode().replace("<w:", "<").replace("</w:", "</").replace("xmlns:w=", "xmlns=", 1) for n in z.namelist()}) for z in (zipfile.ZipFile(io.BytesIO(x)) for x in files)]
    found = [read(x) for x in files]
    assert any(office._without_blocks(zipfile.ZipFile(io.BytesIO(x)).read("word/document.xml"))[1] for x in files[:2])
    monkeypatch.setattr(office, "_without_blocks", lambda data: None)
    monkeypatch.setattr(office, "SMALL", -1)  # so events alone
    assert found == [read(x) for x in files] and found[0] != "broken"


def test_archives_are_read_as_zipfile_reads_them():
    def outcome(opened):
        try:
            z = opened()
            return [(n, z.read(n)) for n in (z.names() if isinstance(z, archive.Archive) else z.namelist())]
        except Exception as e:  # noqa: BLE001
            return type(e), str(e)

    parts = {"a.xml": b"abcabc" * 9, "empty": b"", "b/c.xml": b"xyz" * 30}
    made = archive.zipped(parts)
    assert dict(outcome(lambda: zipfile.ZipFile(io.BytesIO(made)))) == parts
    for i in range(len(made)):  # whichever byte is damaged
        bad = made[:i] + bytes([made[i] ^ 0x55]) + made[i + 1 :]
        assert outcome(lambda: archive.Archive(bad)) == outcome(lambda: zipfile.ZipFile(io.BytesIO(bad))), i
    for data in (made, made[:-5], b"", made[:-22] + made[-22:-2] + b"\3\0abc"):
        assert outcome(lambda: archive.Archive(data)) == outcome(lambda: zipfile.ZipFile(io.BytesIO(data)))
    new = archive.Archive(made).with_parts({"a.xml": b"new", "b/c.xml": b""})
    assert dict(outcome(lambda: zipfile.ZipFile(io.BytesIO(new)))) == parts | {"a.xml": b"new", "b/c.xml": b""}


def test_a_single_kind_is_not_stored(files):
    cells = office.decode(files, kinds=["cell"])
    assert cells.cells.inputFiles() == [] and cells.cells.count() == office.decode(files).cells.count() > 0


def test_changed_cells_are_those_with_a_mask(spark, files, decoded):
    values = spark.createDataFrame([(2, "Ivan", "[P]", 1)], "doc_id long, original_text string, mask string, ord long")
    every = M.mask_cells(decoded.cells, values).filter("size(spans) > 0")
    few = M.changed_cells(decoded.cells, values)
    assert few.columns == ["doc_id", "sheet", "sheet_no", "part", "row_no", "col_no", "fragments"]
    assert sorted(few.collect()) == sorted(every.select(*few.columns).collect()) and few.count() == 2
    given = files.filter("doc_id = 2")
    old, new = (zipfile.ZipFile(io.BytesIO(office.masked_files(given, cells=x).first().masked)) for x in (every, few))
    assert {n: old.read(n) for n in old.namelist()} == {n: new.read(n) for n in new.namelist()}


def test_plain_rows_are_what_the_tree_gives(monkeypatch):
    """Plain rows are read without a tree, wanted cells found by their names; any other sheet goes the general way, with the same cells and places."""
    rich = '<c r="B1" s="1" t="inlineStr"><is><r><rPr><b/></rPr><t>a &amp; b</t></r><r><t xml:space="preserve"> c</t></r></is></c>'
    row = '<row r="1" spans="1:3"><c r="A1" s="0" t="s"><v>0</v></c>' + rich + '<c r="C1"><f>A1&gt;2</f><v>2.50</v></c></row>'
    sheets = [
        row + '<row r="7"><c r="AB7" t="str"><v>x</v></c><c r="AC7"/></row>',
        row + '<row><c><v>1</v></c><c t="inlineStr"><is><t>q</t></is></c></row>',
        row + '<!-- <row r="3"><c r="A3"><v>9</v></c></row> -->' + "<row r='4'><c r='A4'><v>4</v></c></row>",
        row + "\n" + row.replace("1", "2") + '<row r="3"><c s="1" r="B3"><v>&#49;</v></c></row>',
        row + '<x xmlns="other"><row r="9"><c r="A9"><v>9</v></c></row></x>',
        row + row,
        "",
    ]
    parts = [f"<worksheet {B.S}><cols><col min=\"1\" max=\"2\"/></cols><sheetData>{x}</sheetData></worksheet>".encode() for x in sheets]
    parts.append(parts[0].replace(b"<c", b"<z:c").replace(b"</c", b"</z:c").replace(b"xmlns=", b'xmlns:z="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns=', 1))

    def read():
        cells = [office._cells(x) for x in parts]
        places = [office._placed_cells(x, {(r, c[0]) for r, of in rows for c in of}) for x, rows in zip(parts, cells, strict=True)]
        return cells, [sorted(x, key=lambda c: c["from"]) for x in places]

    found = read()
    assert office._plain_rows(parts[0]) == found[0][0] and office._ordinary_cells(parts[0], {(1, 2)})[0]["ref"] == "B1"
    assert [c[3] for _, of in found[0][0] for c in of] == ["0", "a & b c", "2.50", "x", None] and found[0][0][0][1][2][4]
    monkeypatch.setattr(office, "_plain_rows", lambda data: None)
    monkeypatch.setattr(office, "_ordinary_cells", lambda data, wanted: None)
    assert found == read()


def test_plain_strings(spark):
    for strings in (["a", "", " b & <c> "], []):
        data = B.xlsx({"One": {1: {1: ("s", "0", 0)}} if strings else {}}, strings)
        assert office._strings(office.Archive(data)) == strings
        odd = zipfile.ZipFile(io.BytesIO(data)).read("xl/sharedStrings.xml").replace(b"</sst>", b"<si><t>x</t><rPh><t>no</t></rPh></si></sst>")
        assert office._strings(office.Archive(office.Archive(data).with_parts({"xl/sharedStrings.xml": odd}))) == [*strings, "x"]
