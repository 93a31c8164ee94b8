"""H1 to H3: reports per document and over the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: headings of the text report
RULE, THIN = "=" * 60, "-" * 60
TITLE, WHEN = "ОТЧЕТ О МАСКИРОВАНИИ КОНФИДЕНЦИАЛЬНЫХ ДАННЫХ", "Дата и время: "
SOURCE, RESULT = "Исходный файл: ", "Итоговый файл: "
FOUND, APPLIED, LIST = "Найдено сущностей (первично): ", "Применено замен (итого)     : ", "\n[ИТОГОВЫЙ СПИСОК ЗАМЕН]"

ITEM = "array<struct<text:string,type:string,mask:string>>"


def report_items(initial: DataFrame, final: DataFrame) -> DataFrame:
    """(doc_id, initial_replacements, final_replacements) from R2's and R3's rows."""
    item = F.struct("ord", "text", "type", "mask")
    last = final.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("f"))
    rows = initial.join(last, "doc_id", "full")
    names = ("text", "type", "mask")
    short = lambda c: F.transform(c, lambda x: F.struct(*[x[n].alias(n) for n in names]))
    none = F.array().cast(ITEM)
    return rows.select("doc_id", F.coalesce(short("items"), none).alias("initial_replacements"), F.coalesce(short("f"), none).alias("final_replacements"))


def json_report(docs: DataFrame, items: DataFrame, timestamp: str) -> DataFrame:
    """H1: (doc_id, report): one JSON object for each row of ``docs(doc_id, source_file,
    masked_file)``. The first count is of spans, the second of distinct values."""
    rows = docs.join(items, "doc_id", "left")
    none = F.array().cast(ITEM)
    first, last = F.coalesce("initial_replacements", none), F.coalesce("final_replacements", none)
    stats = F.struct(F.size(first).alias("initial_detected_count"), F.size(last).alias("final_masked_count"))
    report = F.struct(F.lit(timestamp).alias("timestamp"), "source_file", "masked_file", stats.alias("stats"), first.alias("initial_replacements"), last.alias("final_replacements"))
    return rows.select("doc_id", F.to_json(report, {"ignoreNullFields": "false"}).alias("report"))


def filled(*choices: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices])


def txt_report(docs: DataFrame, items: DataFrame, timestamp: str) -> DataFrame:
    """H2: (doc_id, report): the text report. Empty fields of the items get ``N/A``, ``UNKNOWN``, ``[MASKED]``."""
    rows = docs.join(items, "doc_id", "left")
    none = F.array().cast(ITEM)
    first, last = F.coalesce("initial_replacements", none), F.coalesce("final_replacements", none)
    head = [RULE, TITLE, RULE]
    lines = F.transform(
        last,
        lambda x, i: F.concat(
            (i + 1).cast("string"), F.lit(". ["), filled(x["type"], F.lit("UNKNOWN")), F.lit("] '"), filled(x["text"], F.lit("N/A")),
            F.lit("' -> '"), filled(x["mask"], F.lit("[MASKED]")), F.lit("'"),
        ),
    )
    before = F.array(
        *[F.lit(x) for x in head], F.lit(WHEN + timestamp), F.concat(F.lit(SOURCE), "source_file"), F.concat(F.lit(RESULT), "masked_file"), F.lit(THIN),
        F.concat(F.lit(FOUND), F.size(first).cast("string")), F.concat(F.lit(APPLIED), F.size(last).cast("string")), F.lit(RULE), F.lit(LIST),
    )
    return rows.select("doc_id", F.array_join(F.concat(before, lines, F.array(F.lit("\n" + RULE))), "\n").alias("report"))


def corpus_summary(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """H3: (file_type, entity_type, n_spans, n_texts, n_docs) over many documents."""
    rows = entities.join(docs.select("doc_id", "file_type"), "doc_id")
    return rows.groupBy("file_type", "entity_type").agg(F.count("*").alias("n_spans"), F.count_distinct("original_text").alias("n_texts"), F.count_distinct("doc_id").alias("n_docs"))


def summary_sketches(entities: DataFrame, docs: DataFrame, by: tuple[str, ...] = ("file_type", "entity_type"), lg_k: int = 14) -> DataFrame:
    """H3 in parts that can be stored and merged: (by, n_spans, texts, docs), the last two HyperLogLog sketches of the distinct values and documents.
    A day's sketches are a few kilobytes a group however many rows it has; the exact way has to see all values again. ``docs(doc_id, file_type, ...)``."""
    rows = entities.join(docs.select("doc_id", *[c for c in by if c not in entities.columns]), "doc_id")
    return rows.groupBy(*by).agg(F.count("*").alias("n_spans"), F.hll_sketch_agg("original_text", lg_k).alias("texts"), F.hll_sketch_agg(F.col("doc_id").cast("string"), lg_k).alias("docs"))


def merged_sketches(sketches: DataFrame, by: tuple[str, ...] = ("file_type", "entity_type")) -> DataFrame:
    """Sketches of several parts (days, file types) as those of their union."""
    return sketches.groupBy(*by).agg(F.sum("n_spans").alias("n_spans"), F.hll_union_agg("texts").alias("texts"), F.hll_union_agg("docs").alias("docs"))


def estimated_summary(sketches: DataFrame) -> DataFrame:
    """(..., n_spans, n_texts, n_docs), the last two estimated: with ``lg_k`` 14 the standard error is under 1 %."""
    rest = [c for c in sketches.columns if c not in ("texts", "docs")]
    return sketches.select(*rest, F.hll_sketch_estimate("texts").alias("n_texts"), F.hll_sketch_estimate("docs").alias("n_docs"))
