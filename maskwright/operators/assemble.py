"""Documents put together from cells, pages, body elements and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NOT_WS, py_strip

# fixed values
TABLE_START, TABLE_END = "\n[НАЧАЛО ТАБЛИЦЫ]\n", "\n[КОНЕЦ ТАБЛИЦЫ]\n"
SHEET, PAGE, NOTE, NO_NOTE = "=== Лист: {} ===\n", "--- Страница {} ---\n", " [СНОСКА: {}] ", "Сноска не найдена"


def around(template: str, c):
    head, tail = template.split("{}")
    return F.concat(F.lit(head), c.cast("string"), F.lit(tail))


def _rows(cells: DataFrame) -> DataFrame:
    """(doc_id, sheet, row_no, row): the stripped cell texts of every row."""
    value = F.coalesce(py_strip(F.col("value")), F.lit(""))
    rows = cells.groupBy("doc_id", "sheet", "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", value.alias("v")))).alias("c"))
    return rows.select("doc_id", "sheet", "row_no", F.transform("c", lambda x: x["v"]).alias("row"))


def sheet_rows(cells: DataFrame) -> DataFrame:
    """(doc_id, sheet, row_no, row): stripped cell texts of each row that has a non-empty one."""
    return _rows(cells).filter(F.exists("row", lambda v: F.length(v) > 0))


def assemble_sheet_text(cells: DataFrame) -> DataFrame:
    """(doc_id, sheet, text): non-empty cells joined by `` | ``, rows by line ends. The cells are read once, as they may be
    costly (masked, say); a sheet without a name or document has no text."""
    filled = F.exists("row", lambda v: F.length(v) > 0)
    line = F.array_join(F.filter("row", lambda v: F.length(v) > 0), " | ")
    rows = _rows(cells).groupBy("doc_id", "sheet").agg(F.array_sort(F.collect_list(F.when(filled, F.struct("row_no", line.alias("t"))))).alias("r"))
    text = F.array_join(F.transform("r", lambda x: x["t"]), "\n")
    return rows.select("doc_id", "sheet", F.when(F.col("doc_id").isNotNull() & F.col("sheet").isNotNull(), text).otherwise("").alias("text"))


def sheet_matrix(cells: DataFrame) -> DataFrame:
    """(doc_id, sheet, data): all cells of the rows, empty ones too; a sheet without rows has an empty table."""
    rows = sheet_rows(cells).groupBy("doc_id", "sheet").agg(F.array_sort(F.collect_list(F.struct("row_no", "row"))).alias("r"))
    data = rows.select("doc_id", "sheet", F.transform("r", lambda x: x["row"]).alias("data"))
    empty = F.array().cast("array<array<string>>")
    return cells.select("doc_id", "sheet").distinct().join(data, ["doc_id", "sheet"], "left").select("doc_id", "sheet", F.coalesce("data", empty).alias("data"))


def assemble_workbook_text(sheets: DataFrame) -> DataFrame:
    """D3: (doc_id, text) of ``sheets(doc_id, sheet, text)``, each under its heading, in order of ``sheet_no`` if they have it, else of name."""
    order = [c for c in ("sheet_no",) if c in sheets.columns]
    rows = sheets.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order, "sheet", "text"))).alias("s"))
    return rows.select("doc_id", F.array_join(F.transform("s", lambda x: F.concat(around(SHEET, x["sheet"]), x["text"])), "\n\n").alias("text"))


def assemble_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, text, pages): pages under their headings; ``pages`` is array<struct<name, text>>."""
    rows = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    return rows.select(
        "doc_id", F.array_join(F.transform("p", lambda x: F.concat(around(PAGE, x["page_no"]), x["text"])), "\n\n").alias("text"),
        F.transform("p", lambda x: F.struct(F.concat(F.lit("Page_"), x["page_no"].cast("string")).alias("name"), x["text"].alias("text"))).alias("pages"),
    )


def blank_page_fallback(pages: DataFrame, fallback: DataFrame) -> DataFrame:
    """``pages`` with ``text`` from ``fallback(doc_id, page_no, text)`` where it is blank
    and that isn't, and ``used_ocr``."""
    second = fallback.select("doc_id", "page_no", F.col("text").alias("_second"))
    rows = pages.join(second, ["doc_id", "page_no"], "left")
    used = ~F.coalesce(F.col("text").rlike(NOT_WS), F.lit(False)) & F.coalesce(F.col("_second").rlike(NOT_WS), F.lit(False))
    return rows.withColumn("used_ocr", used).withColumn("text", F.when(used, F.col("_second")).otherwise(F.coalesce("text", F.lit("")))).drop("_second")


def used_fallback(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.bool_or("used_ocr").alias("used_ocr"))


def clean_table_cells(tables: DataFrame) -> DataFrame:
    """``tables(…, data array<array<string>>)`` with stripped cells, null ones empty; empty tables go."""
    data = F.transform("data", lambda row: F.transform(row, lambda c: F.coalesce(py_strip(c), F.lit(""))))
    return tables.filter(F.size("data") > 0).withColumn("data", data)


def assemble_body_timeline(paragraphs: DataFrame, table_rows: DataFrame) -> DataFrame:
    """(doc_id, text) of ``paragraphs(doc_id, element_no, text)`` that aren't empty and
    ``table_rows(doc_id, element_no, row_no, cells)`` between table marks, in body order."""
    part = lambda df, sub, text: df.select("doc_id", F.struct("element_no", sub.cast("long").alias("sub"), text.alias("text")).alias("x"))
    first, last = F.lit(-1), F.lit(2**31)
    mark = lambda sub, text: F.array(F.struct(sub.cast("long").alias("sub"), F.lit(text).alias("text")))
    line = F.struct(F.col("row_no").cast("long").alias("sub"), table_line(F.col("cells")).alias("text"))
    tables = table_rows.groupBy("doc_id", "element_no").agg(F.collect_list(line).alias("r"))  # once for rows and marks
    tables = tables.select("doc_id", "element_no", F.explode(F.concat(mark(first, TABLE_START), "r", mark(last, TABLE_END))).alias("l"))
    rows = part(paragraphs.filter("length(text) > 0"), F.lit(0), F.col("text"))
    rows = rows.unionByName(part(tables, F.col("l.sub"), F.col("l.text")))
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return listed.select("doc_id", F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("text"))


def table_line(cells: Column) -> Column:
    return F.array_join(cells, " | ", "")


def table_text(lines: Column) -> Column:
    """D7's text of a table, of its rows' lines in order."""
    return F.concat(F.lit(TABLE_START + "\n"), F.array_join(lines, "\n"), F.lit("\n" + TABLE_END))


def table_texts(table_rows: DataFrame) -> DataFrame:
    """(doc_id, element_no, text) of the tables of ``table_rows(doc_id, element_no, row_no, cells)``."""
    tables = table_rows.groupBy("doc_id", "element_no").agg(F.array_sort(F.collect_list(F.struct("row_no", table_line(F.col("cells")).alias("line")))).alias("r"))
    return tables.select("doc_id", "element_no", table_text(F.col("r.line")).alias("text"))


def join_elements(elements: DataFrame) -> DataFrame:
    """(doc_id, text) of ``elements(doc_id, element_no, text)``, paragraphs and whole tables, that aren't empty: D7 where each has a number of its own."""
    listed = elements.filter("length(text) > 0").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("element_no", "text"))).alias("x"))
    return listed.select("doc_id", F.array_join("x.text", "\n").alias("text"))


def flatten_notes(notes: DataFrame) -> DataFrame:
    """(doc_id, kind, note_no, text). Within a note a row of several cells opens a table, more of
    them go on with it, a row of one cell closes it; a row without cells changes nothing."""
    n = F.size("cells")
    note = ["doc_id", "kind", "note_no"]
    before = Window.partitionBy(*note).orderBy("block_no", "para_no").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.last(F.when(n >= 1, n > 1), ignorenulls=True).over(before), F.lit(False))
    rows = notes.withColumn("opened", opened).withColumn("n", n)
    row, one = F.array_join("cells", " | "), F.concat(F.array_join("cells", ""), F.lit(" "))
    piece = (
        F.when(~F.col("opened") & (F.col("n") > 1), F.concat(F.lit(TABLE_START), row))
        .when(F.col("opened") & (F.col("n") == 1), F.concat(F.lit(TABLE_END), one))
        .when(F.col("opened") & (F.col("n") > 1), F.concat(F.lit("\n"), row))
        .otherwise(one)
    )
    state = F.max_by(F.col("n") > 1, F.when(F.col("n") >= 1, F.struct("block_no", "para_no")))
    listed = rows.withColumn("piece", piece).groupBy(*note).agg(F.array_sort(F.collect_list(F.struct("block_no", "para_no", "piece"))).alias("p"), state.alias("open"))
    text = py_strip(F.array_join(F.transform("p", lambda x: x["piece"]), ""))
    return listed.select(*note, F.concat(text, F.when(F.col("open"), F.lit(TABLE_END)).otherwise("")).alias("text"))


def one_line(text: Column) -> Column:
    return py_strip(F.replace(text, F.lit("\n"), F.lit(" ")))


def inline_note_refs(paragraphs: DataFrame, refs: DataFrame, notes: DataFrame) -> DataFrame:
    """``paragraphs(doc_id, para_no, text)`` with the notes of ``refs(doc_id, para_no, kind, ref_no,
    ref_id)`` behind the text: footnotes first, in order; line ends become spaces, ends are stripped."""
    asked = refs.filter(F.col("ref_id").rlike("^[0-9]+$")).withColumn("note_no", F.col("ref_id").cast("int"))
    known = notes.select("doc_id", "kind", "note_no", F.col("text").alias("note"))
    met = asked.join(known, ["doc_id", "kind", "note_no"], "left")
    order = F.struct((F.col("kind") != "footnote").alias("second"), "ref_no", around(NOTE, F.coalesce("note", F.lit(NO_NOTE))).alias("t"))
    tail = met.groupBy("doc_id", "para_no").agg(F.array_sort(F.collect_list(order)).alias("r"))
    rows = paragraphs.join(tail, ["doc_id", "para_no"], "left")
    text = F.concat("text", F.coalesce(F.array_join(F.transform("r", lambda x: x["t"]), ""), F.lit("")))
    return rows.withColumn("text", one_line(text)).drop("r")


def render_hyperlinks(runs: DataFrame, links: DataFrame) -> DataFrame:
    """``runs(doc_id, para_no, run_no, text, rel_id, is_link)`` with link runs as anchors;
    an unknown or missing relation has an empty address."""
    rows = runs.join(links.select("doc_id", "rel_id", "url"), ["doc_id", "rel_id"], "left")
    anchor = F.concat(F.lit('<a href="'), F.coalesce("url", F.lit("")), F.lit('">'), "text", F.lit("</a>"))
    return rows.withColumn("text", F.when(F.col("is_link"), anchor).otherwise(F.col("text"))).drop("url")


def document_metadata(segments: DataFrame, kinds=("paragraph", "table", "footnote", "endnote")) -> DataFrame:
    """(doc_id, metadata map<string,string>): counts of the segment kinds, distinct sheets' names and
    pages, and whether a page's text came from the fallback (``used_ocr``, as D5 gives it, if the segments have it)."""
    kind = F.col("seg_kind")
    ocr = F.coalesce(F.bool_or("used_ocr"), F.lit(False)) if "used_ocr" in segments.columns else F.lit(False)
    counts = segments.groupBy("doc_id").agg(
        *[F.count_if(kind == k).alias(f"{k}s_count") for k in kinds], F.count_distinct(F.when(kind == "page", F.col("seg_no"))).alias("pages_count"),
        F.array_sort(F.collect_set(F.when(kind == "sheet", F.col("seg_name")))).alias("sheet_names"), ocr.alias("used_ocr"),
    )
    names = [*[f"{k}s_count" for k in kinds], "pages_count", "used_ocr"]
    pairs = [x for n in names for x in (F.lit(n), F.col(n).cast("string"))]
    sheets = [F.lit("sheets_count"), F.size("sheet_names").cast("string"), F.lit("sheet_names"), F.array_join("sheet_names", ", ")]
    return counts.select("doc_id", F.create_map(*pairs, *sheets).alias("metadata"))
