"""Queries over .docx and .xlsx files: S2 and S3. The files are made of the given tables, a file for each document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import assemble as D
from ..operators import mask as M
from ..operators.meeting import plain
from ..sources import io, office
from . import office_bytes as B
from . import sqltext as S
from .catalog_docs import _END, _ROWS, _START
from .catalog_mask import CELLS, RUNS
from .fixtures import load, n_tasks

QUERIES, SQL = {}, {}
FILE = "doc_id long, filename string, file_type string, content binary"


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


def files(rows: DataFrame, kind: str, make: Callable[[list[tuple]], bytes], *order: str, read: list[Column] | None = None) -> DataFrame:
    """A file for each document: ``rows``, doc_id first, stream past by document, in order; make(rows of a document) is its content.
    read: what make gets of a row after its doc_id, if not all columns."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(done: list[tuple]) -> pa.RecordBatch:
            ids = [i for i, _ in done]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([f"{i}.{kind}" for i in ids], pa.string()), pa.array([kind] * len(ids), pa.string()), pa.array([make(x) for _, x in done], pa.binary())],
                                              names=["doc_id", "filename", "file_type", "content"])

        held: list[tuple] = []
        for batch in batches:
            done = []
            for x in zip(*map(plain, batch.columns), strict=True):
                if held and held[0][0] != x[0]:
                    done.append((held[0][0], held))
                    held = []
                held.append(x)
            yield made(done)
        yield made([(held[0][0], held)] if held else [])

    ordered = rows.repartition(n_tasks(rows.sparkSession), "doc_id").sortWithinPartitions("doc_id", *order)
    return (ordered if read is None else ordered.select("doc_id", *read)).mapInArrow(write, FILE)


def escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def stored(made: DataFrame) -> DataFrame:
    """Made once, however often they are read."""
    path = io.work_dir(made.sparkSession)
    made.write.parquet(path)
    return made.sparkSession.read.schema(FILE).parquet(path)


def workbooks(spark, d) -> DataFrame:
    """The cells of each customer's orders as a workbook: texts shared, amounts as text, formulas with their last value."""

    def write(rows: list[tuple]) -> bytes:
        strings, sheets = [], {}
        for _, sheet, row_no, col_no, text, is_formula in rows:
            by_row = sheets.get(sheet)
            if by_row is None:
                by_row = sheets[sheet] = {}
            cells = by_row.get(row_no)
            if cells is None:
                cells = by_row[row_no] = []
            if is_formula or text is None:
                cells.append(B.cell(row_no, col_no, "f" if is_formula else "n", text))
            else:
                cells.append(B.cell(row_no, col_no, "s", str(len(strings))))
                strings.append(text)
        return B.workbook({sheet: [(r, "".join(cells)) for r, cells in by_row.items()] for sheet, by_row in sheets.items()}, strings)

    rows = load(spark, d, "cells").select("doc_id", "sheet", "row_no", "col_no", "value", "is_formula")
    return files(rows, "xlsx", write, "sheet", "row_no", "col_no")


@query("s2_read_workbooks", S.with_("cells", more=_ROWS) + " select doc_id, sheet, text from sheets")
def s2x(spark, d):
    return D.assemble_sheet_text(office.decode(workbooks(spark, d), kinds=["cell"]).cells)


@query("s2_read_documents", S.with_("paragraphs", "table_rows", more=f"""
 parts as (select doc_id, element_no, -2 as sub, {S.strip("replace(text, chr(10), ' ')")} as text from paragraphs where len({S.strip("replace(text, chr(10), ' ')")}) > 0
 union all select doc_id, element_no, row_no, array_to_string(cells, ' | ') from table_rows
 union all select distinct doc_id, element_no, -1, {_START} from table_rows union all select distinct doc_id, element_no, 1000, {_END} from table_rows)""")
 + " select doc_id, string_agg(text, chr(10) order by element_no, sub) as text from parts group by doc_id")
def s2d(spark, d):
    def write(rows: list[tuple]) -> bytes:
        body, table = [], None
        for _, element, row_no, markup in rows:
            if table is not None and (row_no < 0 or element != table):
                body.append(close)
                table = None
            if row_no >= 0 and table is None:
                body.append(open_)
                table = element
            body.append(markup)
        return B.docx("".join([*body, close] if table is not None else body))

    # the rows' own markup is made by built-ins
    open_, close = "<w:tbl>", "</w:tbl>"
    before, after = B.paragraph(B.run("{}")).split("{}")
    cells = F.array_join(F.transform("cells", escaped), f"{after}</w:tc><w:tc>{before}")
    row = F.concat(F.lit(f"<w:tr><w:tc>{before}"), cells, F.lit(f"{after}</w:tc></w:tr>"))
    markup = F.when(F.col("row_no") < 0, F.concat(F.lit(before), escaped(F.col("text")), F.lit(after))).otherwise(row).alias("markup")
    paragraphs = load(spark, d, "paragraphs").select("doc_id", "element_no", F.lit(-1).cast("long").alias("row_no"), "text", F.lit(None).cast("array<string>").alias("cells"))
    rows = load(spark, d, "table_rows").select("doc_id", "element_no", F.col("row_no").cast("long").alias("row_no"), F.lit(None).cast("string").alias("text"), "cells")
    made = files(paragraphs.unionByName(rows), "docx", write, "element_no", "row_no", read=["element_no", "row_no", markup])
    return office.decode(made, kinds=office.ELEMENTS).body_texts()


@query("s3_masked_workbooks", S.with_("cells", "cell_values", more=CELLS) + " select doc_id, sheet, row_no, col_no, masked from done")
def s3x(spark, d):
    given = stored(workbooks(spark, d))
    cells = office.decode(given, kinds=["cell"]).cells.select("doc_id", "part", "row_no", "col_no", "value", "is_formula")
    masked = office.masked_files(given, cells=M.changed_cells(cells, load(spark, d, "cell_values")))
    again = office.decode(masked.drop("content").withColumnRenamed("masked", "content"), kinds=["cell"])
    return again.cells.select("doc_id", "sheet", "row_no", "col_no", F.col("value").alias("masked"))


@query("s3_masked_documents", S.with_("runs", "run_values", more=RUNS) + " select doc_id, string_agg(masked, '' order by run_no) as text from masked_runs group by doc_id")
def s3d(spark, d):
    def write(rows: list[tuple]) -> bytes:
        return B.docx(B.paragraph("".join(B.run(text, "<w:rPr><w:b/></w:rPr>", "<w:lastRenderedPageBreak/>" * is_complex) for _, _, text, is_complex in rows)))

    given = stored(files(load(spark, d, "runs").select("doc_id", "run_no", "text", "is_complex"), "docx", write, "run_no"))
    masked = M.mask_runs(office.decode(given, kinds=["run"]).runs, load(spark, d, "run_values"))
    again = office.decode(office.masked_files(given, runs=masked).drop("content").withColumnRenamed("masked", "content"), kinds=["run"])
    runs = again.runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("run_no", "text"))).alias("r"))
    return runs.select("doc_id", F.array_join("r.text", "").alias("text"))
