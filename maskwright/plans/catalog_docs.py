"""Queries over document assembly, reports, sinks and history: D*, H*, I*, S3 to S5, workloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assemble as D
from ..operators import dictionary as R
from ..operators import history as I
from ..operators import mask as M
from ..operators import pages as G
from ..operators import reports as H
from ..operators.history_store import HistoryStore
from ..sources import io
from . import sqltext as S
from .catalog_mask import CELLS, DEDUPED, FINAL, LOCATED, REDACTED, REPLACED, _detected
from .deidentify import deidentify
from .fixtures import load

QUERIES, SQL = {}, {}
WHEN = "2024-01-01T00:00:00"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


_ROWS = f"""vals as (select doc_id, sheet, row_no, col_no, coalesce({S.strip("value")}, '') as v from cells),
rows as (select doc_id, sheet, row_no, string_agg(v, ' | ' order by col_no) filter (v <> '') as line, string_agg(v, '~' order by col_no) as raw from vals group by all having max(len(v)) > 0),
sheets as (select doc_id, sheet, coalesce(string_agg(line, chr(10) order by row_no), '') as text, string_agg(raw, '#' order by row_no) as data from (select distinct doc_id, sheet from cells) left join rows using (doc_id, sheet) group by all)"""


@query("d1_assemble_sheet_text", S.with_("cells", more=_ROWS) + " select doc_id, sheet, text from sheets")
def d1(spark, d):
    return D.assemble_sheet_text(load(spark, d, "cells"))


@query("d2_sheet_matrix", S.with_("cells", more=_ROWS) + " select doc_id, sheet, data from sheets")
def d2(spark, d):
    rows = D.sheet_matrix(load(spark, d, "cells"))
    return rows.select("doc_id", "sheet", F.array_join(F.transform("data", lambda r: F.array_join(r, "~")), "#").alias("data"))


@query("d3_assemble_workbook_text", S.with_("cells", more=_ROWS) + " select doc_id, string_agg(concat('=== Лист: ', sheet, ' ===', chr(10), text), concat(chr(10), chr(10)) order by sheet) as text from sheets group by doc_id")
def d3(spark, d):
    return D.assemble_workbook_text(D.assemble_sheet_text(load(spark, d, "cells")))


@query("d4_assemble_pages", S.with_("pages") + """
 select doc_id, string_agg(concat('--- Страница ', page_no, ' ---', chr(10), text), concat(chr(10), chr(10)) order by page_no) as text, string_agg(name, ',' order by page_no) as names from pages group by doc_id""")
def d4(spark, d):
    return D.assemble_pages(load(spark, d, "pages")).select("doc_id", "text", F.array_join("pages.name", ",").alias("names"))


_FALLBACK = f"""filled as (select p.doc_id, p.page_no, not regexp_matches(p.text, '{T.NOT_WS}') and coalesce(regexp_matches(f.text, '{T.NOT_WS}'), false) as used_ocr, p.text as a, f.text as b
 from pages p left join fallback f using (doc_id, page_no))"""


@query("d5_blank_page_fallback", S.with_("pages", "fallback", more=_FALLBACK) + " select doc_id, page_no, used_ocr, case when used_ocr then b else a end as text from filled")
def d5(spark, d):
    return D.blank_page_fallback(load(spark, d, "pages"), load(spark, d, "fallback")).select("doc_id", "page_no", "used_ocr", "text")


@query("d5_used_fallback", S.with_("pages", "fallback", more=_FALLBACK) + " select doc_id, bool_or(used_ocr) as used_ocr from filled group by doc_id")
def d5u(spark, d):
    return D.used_fallback(D.blank_page_fallback(load(spark, d, "pages"), load(spark, d, "fallback")))


@query("d6_clean_table_cells", S.with_("table_rows") + f" select doc_id, element_no, row_no, array_to_string(list_transform(cells, lambda c: coalesce({S.strip('c')}, '')), '~') as row from table_rows")
def d6(spark, d):
    tables = load(spark, d, "table_rows").select("doc_id", "element_no", "row_no", F.array("cells").alias("data"))
    return D.clean_table_cells(tables).select("doc_id", "element_no", "row_no", F.array_join(F.col("data")[0], "~").alias("row"))


_START, _END = (f"concat(chr(10), '{x.strip()}', chr(10))" for x in (D.TABLE_START, D.TABLE_END))


@query("d7_assemble_body_timeline", S.with_("paragraphs", "table_rows", more=f"""
 parts as (select doc_id, element_no, 0 as sub, text from paragraphs where len(text) > 0
 union all select doc_id, element_no, row_no, array_to_string(cells, ' | ') from table_rows
 union all select distinct doc_id, element_no, -1, {_START} from table_rows union all select distinct doc_id, element_no, 1000, {_END} from table_rows)""")
 + " select doc_id, string_agg(text, chr(10) order by element_no, sub, text) as text from parts group by doc_id")
def d7(spark, d):
    return D.assemble_body_timeline(load(spark, d, "paragraphs"), load(spark, d, "table_rows"))


@query("d8_flatten_notes", S.with_("notes", more=f"""
 states as (select *, len(cells) as n, coalesce(last_value(case when len(cells) >= 1 then len(cells) > 1 end ignore nulls) over (partition by doc_id, kind, note_no order by block_no, para_no rows between unbounded preceding and 1 preceding), false) as opened from notes),
 pieces as (select *, case when not opened and n > 1 then concat({_START}, array_to_string(cells, ' | ')) when opened and n = 1 then concat({_END}, array_to_string(cells, ''), ' ')
  when opened and n > 1 then concat(chr(10), array_to_string(cells, ' | ')) else concat(array_to_string(cells, ''), ' ') end as piece from states),
 whole as (select doc_id, kind, note_no, string_agg(piece, '' order by block_no, para_no) as t, arg_max(n > 1, (block_no, para_no)) filter (n >= 1) as open from pieces group by all)""")
 + f" select doc_id, kind, note_no, concat({S.strip('t')}, case when open then {_END} else '' end) as text from whole")
def d8(spark, d):
    return D.flatten_notes(load(spark, d, "notes"))


@query("d9_inline_note_refs", S.with_("paragraphs", "note_refs", "note_texts", more="""
 tails as (select r.doc_id, para_no, string_agg(concat(' [СНОСКА: ', coalesce(t.text, 'Сноска не найдена'), '] '), '' order by r.kind <> 'footnote', ref_no) as tail
  from note_refs r left join note_texts t on t.doc_id = r.doc_id and t.kind = r.kind and cast(t.note_no as varchar) = r.ref_id where regexp_full_match(ref_id, '[0-9]+') group by all)""")
 + f" select doc_id, para_no, {S.strip('''replace(concat(text, coalesce(tail, '')), chr(10), ' ')''')} as text from paragraphs left join tails using (doc_id, para_no)")
def d9(spark, d):
    return D.inline_note_refs(load(spark, d, "paragraphs").drop("element_no"), load(spark, d, "note_refs"), load(spark, d, "note_texts"))


@query("d10_render_hyperlinks", S.with_("link_runs", "links") + """
 select r.doc_id, para_no, run_no, case when is_link then concat('<a href="', coalesce(url, ''), '">', text, '</a>') else text end as text from link_runs r left join links l on l.doc_id = r.doc_id and l.rel_id = r.rel_id""")
def d10(spark, d):
    return D.render_hyperlinks(load(spark, d, "link_runs"), load(spark, d, "links")).select("doc_id", "para_no", "run_no", "text")


@query("d11_document_metadata", S.with_("paragraphs", "cells", more="""
 segs as (select doc_id, 'paragraph' as k, element_no::int as n, null::varchar as s, null::boolean as o from paragraphs union all select doc_id, 'sheet', 1, sheet, null from cells union all select doc_id, 'page', (row_no % 3)::int, null, value is null from cells)""")
 + """ select doc_id, count_if(k = 'paragraph')::varchar as paragraphs, count(distinct case when k = 'page' then n end)::varchar as pages, count(distinct s)::varchar as sheets,
 coalesce(string_agg(distinct s, ', ' order by s), '') as sheet_names, coalesce(bool_or(o), false)::varchar as used_ocr from segs group by doc_id""")
def d11(spark, d):
    p = load(spark, d, "paragraphs").select("doc_id", F.lit("paragraph").alias("seg_kind"), F.col("para_no").alias("seg_no"), F.lit(None).cast("string").alias("seg_name"))
    c = load(spark, d, "cells")
    s = c.select("doc_id", F.lit("sheet").alias("seg_kind"), F.lit(1).alias("seg_no"), F.col("sheet").alias("seg_name"))
    g = c.select("doc_id", F.lit("page").alias("seg_kind"), (F.col("row_no") % 3).cast("int").alias("seg_no"), F.lit(None).cast("string").alias("seg_name"), F.isnull("value").alias("used_ocr"))
    m = D.document_metadata(p.unionByName(s).unionByName(g, allowMissingColumns=True))
    names = {"used_ocr": "used_ocr", "paragraphs": "paragraphs_count", "pages": "pages_count", "sheets": "sheets_count", "sheet_names": "sheet_names"}
    return m.select("doc_id", *[F.col("metadata")[v].alias(k) for k, v in names.items()])


# -- reports -------------------------------------------------------------------

_ITEMS = f"""{REPLACED.replace("@", "parties")}, {FINAL.replace("@", "parties")},
firsts as (select doc_id, count(*) as n, list(concat('{{"text":"', original_text, '","type":"', entity_type, '","mask":"', masked_text, '"}}') order by chunk_no, start_pos, end_pos) as j from parties group by doc_id),
lasts as (select doc_id, count(*) as n, list(concat('{{"text":"', text, '","type":"', type, '","mask":"', mask, '"}}') order by ord) as j,
 list(concat(ord, '. [', type, '] ''', text, ''' -> ''', mask, '''') order by ord) as lines from final group by doc_id),
files_of as (select c_custkey as doc_id, c_name as source_file, concat(c_name, '_masked') as masked_file from customer),
both_items as (select f.*, coalesce(a.n, 0) as n1, coalesce(b.n, 0) as n2, coalesce(a.j, []) as j1, coalesce(b.j, []) as j2, coalesce(b.lines, []) as lines
 from files_of f left join firsts a using (doc_id) left join lasts b using (doc_id))"""


def _report_inputs(spark, d):
    entities = load(spark, d, "parties")
    items = H.report_items(R.initial_items(entities), R.final_items(R.build_replacements(entities), entities))
    docs = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("source_file"), F.concat("c_name", F.lit("_masked")).alias("masked_file"))
    return docs, items


@query("h1_json_report", S.with_("parties", more=_ITEMS) + f"""
 select doc_id, concat('{{"timestamp":"{WHEN}","source_file":"', source_file, '","masked_file":"', masked_file, '","stats":{{"initial_detected_count":', n1, ',"final_masked_count":', n2,
  '}},"initial_replacements":[', array_to_string(j1, ','), '],"final_replacements":[', array_to_string(j2, ','), ']}}') as report from both_items""")
def h1(spark, d):
    return H.json_report(*_report_inputs(spark, d), WHEN)


@query("h2_txt_report", S.with_("parties", more=_ITEMS) + f"""
 select doc_id, array_to_string(list_concat([{S.q(H.RULE)}, {S.q(H.TITLE)}, {S.q(H.RULE)}, {S.q(H.WHEN + WHEN)}, concat({S.q(H.SOURCE)}, source_file), concat({S.q(H.RESULT)}, masked_file), {S.q(H.THIN)},
  concat({S.q(H.FOUND)}, n1), concat({S.q(H.APPLIED)}, n2), {S.q(H.RULE)}, {S.q(H.LIST)}], lines, [{S.q(chr(10) + H.RULE)}]), chr(10)) as report from both_items""")
def h2(spark, d):
    return H.txt_report(*_report_inputs(spark, d), WHEN)


_H1 = f"""concat('{{"timestamp":"{WHEN}","source_file":"', source_file, '","masked_file":"', masked_file, '","stats":{{"initial_detected_count":', n1, ',"final_masked_count":', n2,
  '}},"initial_replacements":[', array_to_string(j1, ','), '],"final_replacements":[', array_to_string(j2, ','), ']}}')"""


@query("s3_write_masked", S.with_("cells", "cell_values", more=CELLS + ", typed as (select case when sheet = '1-URGENT' then 'xls' else 'xlsx' end as file_type, doc_id, sheet, row_no, col_no, masked from done)") + " select * from typed")
def s3(spark, d):
    kind = F.when(F.col("sheet") == "1-URGENT", "xls").otherwise("xlsx")
    masked = M.mask_cells(load(spark, d, "cells"), load(spark, d, "cell_values"), spans=False).select(kind.alias("file_type"), "doc_id", "sheet", "row_no", "col_no", "masked")
    path = f"{io.work_dir(spark)}/masked"
    io.write_masked(masked, path)
    return spark.read.parquet(path)


@query("s4_write_json_reports", S.with_("parties", more=_ITEMS) + f" select {_H1} as report from both_items")
def s4(spark, d):
    path = f"{io.work_dir(spark)}/json"
    io.write_json_reports(H.json_report(*_report_inputs(spark, d), WHEN), path)
    return spark.read.text(path).withColumnRenamed("value", "report")


@query("s5_write_txt_reports", S.with_("parties", more=_ITEMS) + f"""
 select line, count(*) as n from (select unnest(list_concat([{S.q(H.RULE)}, {S.q(H.TITLE)}, {S.q(H.RULE)}, {S.q(H.WHEN + WHEN)}, concat({S.q(H.SOURCE)}, source_file), concat({S.q(H.RESULT)}, masked_file), {S.q(H.THIN)},
  concat({S.q(H.FOUND)}, n1), concat({S.q(H.APPLIED)}, n2), {S.q(H.RULE)}], string_split({S.q(H.LIST)}, chr(10)), lines, [{S.q(H.RULE)}])) as line from both_items) where len(line) > 0 group by line""")
def s5(spark, d):
    path = f"{io.work_dir(spark)}/txt"
    io.write_txt_reports(H.txt_report(*_report_inputs(spark, d), WHEN), path)
    return spark.read.text(path).filter("length(value) > 0").groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("h3_corpus_summary", S.with_("parties") + """
 select case when doc_id % 2 = 0 then 'docx' else 'pdf' end as file_type, entity_type, count(*) as n_spans, count(distinct original_text) as n_texts, count(distinct doc_id) as n_docs from parties group by all""")
def h3(spark, d):
    kind = F.when(F.col("c_custkey") % 2 == 0, "docx").otherwise("pdf")
    docs = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), kind.alias("file_type"))
    return H.corpus_summary(load(spark, d, "parties"), docs)


@query("h3_merged_sketches", S.with_("parties") + """
 select entity_type, count(*) as n_spans, count(distinct original_text) as n_texts, count(distinct doc_id) as n_docs, true as texts_within, true as docs_within from parties group by all""")
def h3s(spark, d):
    """Sketches stored by file type and merged, held against the exact counts: within 4 %."""
    entities = load(spark, d, "parties")
    docs = entities.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "docx").otherwise("pdf").alias("file_type")).distinct()
    path = io.work_dir(spark)
    H.summary_sketches(entities, docs).write.partitionBy("file_type").parquet(path)
    about = H.estimated_summary(H.merged_sketches(spark.read.parquet(path), ("entity_type",)))
    exact = entities.groupBy("entity_type").agg(F.count_distinct("original_text").alias("texts"), F.count_distinct("doc_id").alias("docs"))
    within = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.04 * F.col(b)
    met = about.join(exact, "entity_type")
    return met.select("entity_type", "n_spans", F.col("texts").alias("n_texts"), F.col("docs").alias("n_docs"), within("n_texts", "texts").alias("texts_within"), within("n_docs", "docs").alias("docs_within"))


# -- history -------------------------------------------------------------------

_LAST = "latest as (select seq, source_file from history qualify row_number() over (partition by lower(source_file) order by seq desc) = 1)"


@query("i1_history_upsert", S.with_("history", more=_LAST) + " select * from latest")
def i1(spark, d):
    history = load(spark, d, "history")
    return I.history_upsert(history.filter("seq % 2 = 0"), history.filter("seq % 2 = 1"))


@query("i1_history_store", S.with_("history", more=_LAST) + " select * from latest")
def i1s(spark, d):
    store, history = HistoryStore(spark, io.work_dir(spark), "seq long, source_file string", buckets=16), load(spark, d, "history")
    store.upsert(history.filter("seq % 2 = 0"))
    store.upsert(history.filter("seq % 2 = 1"))
    return store.rows()


@query("i2_history_list", S.with_("history", more=_LAST) + " select * from latest order by seq desc")
def i2(spark, d):
    return I.history_list(I.history_upsert(load(spark, d, "history")))


@query("i3_skip_processed", S.with_("history") + " select * from history where lower(source_file) not in (select lower(source_file) from history where source_file like '/Data/click/%')")
def i3(spark, d):
    history = load(spark, d, "history")
    return I.skip_processed(history, history.filter("source_file like '/Data/click/%'"))


@query("i3_already_processed", S.with_("history") + " select * from history where lower(source_file) in (select lower(source_file) from history where source_file like '/Data/click/%')")
def i3a(spark, d):
    history = load(spark, d, "history")
    return I.already_processed(history, history.filter("source_file like '/Data/click/%'"))


@query("i4_history_remove", S.with_("history") + " select * from history where lower(source_file) not in (select lower(source_file) from history where source_file like '/Data/view/%')")
def i4(spark, d):
    history = load(spark, d, "history")
    return I.history_remove(history, history.filter("source_file like '/Data/view/%'"))


@query("i5_versioned_names", S.with_("new_files", "taken_names", more="""
 wanted as (select seq, source_file, regexp_extract(source_file, '([^/]*)\\.docx$', 1) as stem, row_number() over (partition by regexp_extract(source_file, '([^/]*)\\.docx$', 1) order by seq) as k from new_files),
 tries as (select stem, v, concat(stem, '_masked', case when v > 1 then concat('_v', v) else '' end, '.docx') as name from (select distinct stem from wanted), range(1, 200) t(v)),
 free as (select stem, name, row_number() over (partition by stem order by v) as k from tries where name not in (select name from taken_names))""")
 + " select seq, source_file, name as masked_name from wanted join free using (stem, k)")
def i5(spark, d):
    return I.versioned_names(load(spark, d, "new_files"), load(spark, d, "taken_names"))


@query("i6_artifact_paths", S.with_("runs_done", "listing", more="""
 paths as (select seq, source_file, unnest([masked, report_json, report_txt]) as path from runs_done)""")
 + " select seq, source_file, count(*) as n_paths, count(l.path) as n_present from paths left join listing l using (path) where len(paths.path) > 0 group by all")
def i6(spark, d):
    return I.artifact_paths(load(spark, d, "runs_done"), load(spark, d, "listing"))


# -- whole workloads -----------------------------------------------------------

_W1 = f"""{_detected("documents")}, {REPLACED.replace("@", "detected")},
per_doc as (select doc_id, count(*) as n_spans, count(distinct original_text) as n_texts from detected group by doc_id)"""


@query("w1_deidentify_documents", f"""with {_W1}, dicts as ({S.dictionary("replaced")}),
 kept as (select doc_id, text, case when d is null then [] else {S.kept("text", "d")} end as k from documents left join dicts using (doc_id))
 select doc_id, len(k)::int as n_spans, case when len(k) > 0 then {S.glued(S.fragments("text", "k"))} else text end as masked from kept""")
def w1(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return deidentify(docs).masked.select("doc_id", F.size("spans").alias("n_spans"), "masked")


@query("w1_masked_by_language", f"""with {_W1}, by_lang as (select lang, count(*) as n_docs, count(p.doc_id) as n_changed, coalesce(sum(n_spans), 0)::bigint as n_fragments
 from documents left join per_doc p using (doc_id) group by lang) select * from by_lang""")
def w1_lang(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang")
    masked = deidentify(docs).masked
    return masked.groupBy("lang").agg(F.count("*").alias("n_docs"), F.count_if(F.size("spans") > 0).alias("n_changed"), F.sum(F.size("spans")).cast("long").alias("n_fragments"))


@query("w1_status", S.with_("parties") + """
 select status, count(*) as n from (select doc_id, case when bool_or(entity_type = 'BUYER') <> bool_or(entity_type = 'SUPPLIER') then 'NEEDS_CLARIFICATION' else 'COMPLETE' end as status from parties group by doc_id) group by status""")
def w1_status(spark, d):
    return R.party_completeness(load(spark, d, "parties")).groupBy("status").agg(F.count("*").alias("n"))


@query("w1_answers_and_detector", S.with_("contracts", "answered", more=f"""{LOCATED}, {DEDUPED}, {_detected("contracts")},
 named as (select * from deduped union all select doc_id, chunk_no, resp_no, cand_no, original_text, masked_text, start_pos, end_pos, entity_type, confidence from detected t
  where not exists (select 1 from deduped e where e.doc_id = t.doc_id and e.start_pos = t.start_pos and e.end_pos = t.end_pos)),
 {REPLACED.replace("@", "named")}, dicts as ({S.dictionary("replaced")}),
 kept as (select c.doc_id, text, {S.kept("text", "d")} as k from contracts c left join dicts using (doc_id))""")
 + f" select doc_id, {S.glued(S.fragments('text', 'k'))} as masked from kept")
def w1_answers(spark, d):
    return deidentify(load(spark, d, "contracts"), load(spark, d, "responses")).masked.select("doc_id", "masked")


@query("w3_redact_corpus", S.with_("page_words", "page_values", more=REDACTED + """,
 counts as (select p.doc_id, p.page_no, count(b.rank) as n_areas from (select distinct doc_id, page_no from page_words) p left join boxes b using (doc_id, page_no) group by all),
 texts_left as (select doc_id, page_no, string_agg(word, ' ' order by block_no, line_no, word_no) as masked from shown group by all)""")
 + " select doc_id, page_no, masked, n_areas from texts_left join counts using (doc_id, page_no)")
def w3(spark, d):
    words, boxes = load(spark, d, "page_words"), G.match_boxes(load(spark, d, "page_words"), load(spark, d, "page_values"))
    return G.redact_pages(words, boxes).join(G.page_area_counts(words, boxes), ["doc_id", "page_no"])


@query("w2_masked_workbook_text", S.with_("cells", "cell_values", more=f"""dicts as ({S.dictionary("cell_values")}),
 kept as (select c.*, case when value is not null and not is_formula and not starts_with(value, '=') then {S.kept("value", "d")} else [] end as k from cells c left join dicts using (doc_id)),
 done as (select doc_id, sheet, row_no, col_no, case when len(k) > 0 then {S.glued(S.fragments("value", "k"))} else value end as value from kept),
 vals as (select doc_id, sheet, row_no, col_no, coalesce({S.strip("value")}, '') as v from done),
 rows as (select doc_id, sheet, row_no, string_agg(v, ' | ' order by col_no) filter (v <> '') as line from vals group by all having max(len(v)) > 0)""")
 + " select doc_id, sheet, string_agg(line, chr(10) order by row_no) as text from rows group by all")
def w2(spark, d):
    masked = M.mask_cells(load(spark, d, "cells"), load(spark, d, "cell_values"), spans=False).withColumn("value", F.col("masked"))
    return D.assemble_sheet_text(masked)
