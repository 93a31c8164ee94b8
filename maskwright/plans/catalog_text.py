"""Queries over texts, chunks, requests and answers: S1, N*, C*, P*."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks as C
from ..operators import normalize as N
from ..operators import responses as P
from ..operators.answers import answer_with_store
from ..schemas import DEFAULT_TYPES
from ..sources import io
from . import sqltext as S
from .fixtures import load

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


_EXT = r"lower(regexp_extract(filename, '\.[^./]+$'))"


@query("s1_route_by_format", S.with_("files") + f"""
select seq, filename, case when {_EXT} in ('.docx', '.xlsx', '.pdf') then substr({_EXT}, 2) end as file_type,
 case when {_EXT} in ('.docx', '.xlsx', '.pdf') then null when {_EXT} = '' then 'no extension' else concat('unsupported format: ', {_EXT}) end as reason from files""")
def s1(spark, d):
    return io.route_by_format(load(spark, d, "files"))


@query("s2_read_corpus", "select doc_id, len(text) as n from documents")
def s2(spark, d):
    docs = io.read_corpus(spark, f"{d}/documents.parquet", schema="doc_id long, text string")
    return docs.select("doc_id", F.length("text").cast("long").alias("n"))


for _name, _step, _sql in [
    ("n1_strip_zero_width", "strip_zero_width", S.n1), ("n2_ascii_typography", "ascii_typography", S.n2), ("n3_join_hyphenated", "join_hyphenated", S.n3),
    ("n4_merge_wrapped_lines", "merge_wrapped_lines", S.n4), ("n5_fix_letter_spacing", "fix_letter_spacing", S.n5), ("n6_tidy_spaces", "tidy_spaces", S.n6),
    ("n7_normalize_text", "normalize_text", S.n7), ("n8_collapse_whitespace", "collapse_whitespace", S.n8),
]:
    QUERIES[_name] = lambda spark, d, step=_step: N.apply(load(spark, d, "dirty_text"), step)
    SQL[_name] = S.with_("dirty_text") + f" select doc_id, {_sql('text')} as text from dirty_text"


def _windows(size: int, overlap: int) -> str:
    return f"case when len(text) <= {size} then [0] else range(0, len(text), {max(1, size - overlap)}) end"


def _chunks(size: int, overlap: int, table: str = "documents") -> str:
    return (
        f"select doc_id, (i - 1)::int as chunk_no, text[w[i] + 1 : w[i] + {size}] as chunk from "
        f"(select doc_id, text, w, unnest(range(1, len(w) + 1)) as i from (select doc_id, text, {_windows(size, overlap)} as w from {table} where len(text) > 0))"
    )


@query("c1_chunk_sliding", _chunks(6000, 400))
def c1(spark, d):
    return C.chunk_sliding(spark.read.parquet(f"{d}/documents.parquet"))


_BY_PAGE = f"""
several as (select doc_id, page_no as chunk_no, concat('[', name, ']', chr(10), text) as chunk from pages
 where doc_id in (select doc_id from pages group by doc_id having count(*) > 1) and regexp_matches(text, '{T.NOT_WS}')),
one as (select doc_id, concat('--- Страница ', page_no, ' ---', chr(10), text) as text from pages where doc_id in (select doc_id from pages group by doc_id having count(*) = 1)),
chunks as (select * from several union all {_chunks(6000, 400, "one")})"""


@query("c2_chunk_by_page", S.with_("pages", more=_BY_PAGE) + " select doc_id, chunk_no, chunk from chunks")
def c2(spark, d):
    return C.chunk_by_page(load(spark, d, "pages"))


@query("c3_filter_short_chunks", S.with_("pages", more=_BY_PAGE) + f" select doc_id, chunk_no, {S.n8('chunk')} as chunk from chunks where len({S.n8('chunk')}) >= 20")
def c3(spark, d):
    return C.filter_short_chunks(C.chunk_by_page(load(spark, d, "pages")))


@query("c4_resolve_target_types", S.with_("job_types", more=f"""
 every as (select job_id, list_concat(ticked, list_filter(list_transform(string_split_regex(coalesce(custom, ''), '[,;\\n]'), lambda t: {S.strip('t')}), lambda t: len(t) > 0)) as e from job_types),
 rows as (select job_id, e[i] as type, i from (select job_id, e, unnest(range(1, len(e) + 1)) as i from every)),
 firsts as (select job_id, arg_min(type, i) as type, min(i) as i from rows group by job_id, lower(type))""") + """
 select job_id, string_agg(type, ',' order by i) as types from firsts group by job_id""")
def c4(spark, d):
    return C.resolve_target_types(load(spark, d, "job_types")).withColumn("types", F.array_join("types", ","))


_CHUNKED = f"chunks as ({_chunks(6000, 400)}), short as (select doc_id, chunk_no, {S.n8('chunk')} as chunk from chunks where len({S.n8('chunk')}) >= 20)"


@query("c5_extraction_requests", f"with {_CHUNKED} select doc_id, chunk_no, {S.filled(C.EXTRACTION, types=S.q(', '.join(DEFAULT_TYPES)), text='chunk')} as prompt from short")
def c5(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").filter(F.col("text").rlike(T.NOT_WS))
    return C.extraction_requests(C.filter_short_chunks(C.chunk_sliding(docs)))


@query("c6_validation_requests", S.with_("contracts", "old_values", more="""
 found as (select doc_id, concat('{', string_agg(concat('"', original_text, '":"', mask, '"'), ',' order by ord), '}') as found from old_values group by doc_id)""")
 + f" select c.doc_id, {S.filled(C.VALIDATION, found='found', text='text')} as prompt from contracts c left join found using (doc_id)")
def c6(spark, d):
    return C.validation_requests(load(spark, d, "contracts"), load(spark, d, "old_values"))


@query("c7_clarification_requests", S.with_("validated", "answers", more="""
 asked as (select doc_id, 1 as question_no, case kind when 1 then concat('Mask ', c_name, '?') else 'Which?' end as question from validated where kind in (1, 2)
  union all select doc_id, 2, 'More?' from validated where kind = 1)""")
 + f" select a.doc_id, a.question_no, {S.filled(C.CLARIFICATION, question='question', reply=S.strip('answer'))} as prompt from asked a join answers b on a.doc_id = b.doc_id and a.question_no = b.question_no where len({S.strip('answer')}) > 0")
def c7(spark, d):
    return C.clarification_requests(P.parse_validation(load(spark, d, "validations")), load(spark, d, "answers"))


_OBJECT = r"nullif(regexp_extract(raw, '(?s)\{.*\}'), '')"
_REPAIRED = rf"regexp_replace(regexp_replace({_OBJECT}, ',\s*([\]}}])', '\1', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')"


@query("p1_extract_json_object", S.with_("responses") + f" select doc_id, {_OBJECT} as object from responses")
def p1(spark, d):
    return load(spark, d, "responses").select("doc_id", P.extract_json_object(F.col("raw")).alias("object"))


@query("p2_parse_strict", S.with_("answered") + " select doc_id, coalesce(parse_level = 1, false) as strict from answered")
def p2(spark, d):
    return load(spark, d, "responses").select("doc_id", P.is_json(P.extract_json_object(F.col("raw"))).alias("strict"))


@query("p3_repair_json", S.with_("responses") + f" select doc_id, {_REPAIRED} as repaired from responses")
def p3(spark, d):
    return load(spark, d, "responses").select("doc_id", P.repair_json(P.extract_json_object(F.col("raw"))).alias("repaired"))


@query("p4_balanced_objects", S.with_("responses", "answered", more=f"objects as (select doc_id, {_OBJECT} as object from responses)")
 # the whole object, but for the answers with text between two and with one that isn't closed
 + " select o.doc_id, case kind when 4 then concat(regexp_extract(object, '^.*?\\]\\}'), '|{не json}') when 5 then '' else object end as objects from objects o join answered a using (doc_id) where object is not null")
def p4(spark, d):
    rows = load(spark, d, "responses").withColumn("object", P.extract_json_object(F.col("raw"))).filter("object is not null")
    return rows.select("doc_id", F.array_join(P.balanced_objects(F.col("object")), "|").alias("objects"))


_LOOSE = '"original_text"\\s*:\\s*"((?:[^"\\\\]|\\\\.)*?)"\\s*,\\s*"entity_type"\\s*:\\s*"([^"]*)"(?:\\s*,\\s*"confidence"\\s*:\\s*([0-9.]+))?'


@query("p5_parse_loose", S.with_("responses", more=f"hits as (select doc_id, unnest(regexp_extract_all(raw, {S.q('(?s)' + _LOOSE)})) as h from responses)") + f"""
 select doc_id, replace(regexp_extract(h, {S.q('(?s)' + _LOOSE)}, 1), '\\"', '"') as original_text, regexp_extract(h, {S.q('(?s)' + _LOOSE)}, 2) as entity_type,
  nullif(regexp_extract(h, {S.q('(?s)' + _LOOSE)}, 3), '') as confidence from hits""")
def p5(spark, d):
    rows = load(spark, d, "responses").select("doc_id", F.explode(P.loose_entities(F.col("raw"))).alias("e"))
    return rows.select("doc_id", "e.original_text", "e.entity_type", "e.confidence")


@query("p6_parse_responses", S.with_("answered") + " select doc_id, parse_level::int as parse_level, case when parse_level is not null then 1 end::int as n from answered")
def p6(spark, d):
    return P.parse_responses(load(spark, d, "responses")).select("doc_id", "parse_level", F.when(F.col("entities").isNotNull(), F.size("entities")).alias("n"))


@query("p6_level_counts", S.with_("answered") + " select parse_level::int as parse_level, count(*) as n from answered group by all")
def p6_levels(spark, d):
    return P.level_counts(P.parse_responses(load(spark, d, "responses")))


@query("p7_explode_entities", S.with_("answered") + " select doc_id, chunk_no, resp_no, original_text, entity_type, confidence from answered where parse_level is not null")
def p7(spark, d):
    return P.explode_entities(P.parse_responses(load(spark, d, "responses"))).drop("variants")


@query("p8_strip_value_prefix", S.with_("contracts", more="parts as (select doc_id, unnest(string_split_regex(text, '[,\\n]')) as part from contracts)") + f" select doc_id, part, {S.label_cut('part')} as value from parts")
def p8(spark, d):
    rows = load(spark, d, "contracts").select("doc_id", F.explode(F.split("text", "[,\\n]", -1)).alias("part"))
    return rows.select("doc_id", "part", T.strip_value_prefix(F.col("part")).alias("value"))


CANDIDATES = f"""candidates as (
 select doc_id, chunk_no, resp_no, 0 as cand_no, original_text as candidate, entity_type, confidence from answered where parse_level is not null
 union all select doc_id, chunk_no, resp_no, 1, {S.label_cut('original_text')}, entity_type, confidence from answered where parse_level is not null and {S.label_cut('original_text')} <> original_text)"""


@query("p9_entity_candidates", S.with_("answered", more=CANDIDATES) + " select doc_id, chunk_no, resp_no, cand_no, candidate, entity_type, confidence from candidates where len(candidate) >= 2")
def p9(spark, d):
    return P.entity_candidates(P.explode_entities(P.parse_responses(load(spark, d, "responses")))).drop("original_text")


@query("p10_parse_validation", S.with_("validated") + """
 select doc_id, parsed, status, (case kind when 1 then 2 when 2 then 1 else 0 end)::int as n_questions, (case when kind in (1, 2) then 1 when kind = 0 then 0 end)::int as n_missing from validated""")
def p10(spark, d):
    v = P.parse_validation(load(spark, d, "validations"))
    return v.select("doc_id", "parsed", "status", F.size("questions").alias("n_questions"), F.when(F.col("missing").isNotNull(), F.size("missing")).alias("n_missing"))


@query("p11_parse_clarifications", S.with_("pairs") + " select doc_id, question_no, pair_no, original_text, mask from pairs")
def p11(spark, d):
    return P.parse_clarifications(load(spark, d, "clarified"))


@query("u1_answer_requests", "with " + _CHUNKED + """ select doc_id, chunk_no, '{"entities": []}' as raw, null::varchar as error from short""")
def u1(spark, d):
    return P.answer_requests(c5(spark, d), P.offline).select("doc_id", "chunk_no", "raw", "error")


@query("u1_answers_kept", SQL["u1_answer_requests"])
def u1k(spark, d):
    return answer_with_store(c5(spark, d), P.offline, io.work_dir(spark), waves=2).select("doc_id", "chunk_no", "raw", "error")


@query("u2_answers_table", S.with_("validated", "answers") + f"""
 select doc_id, question_no, {S.strip('answer')} as reply from answers join validated using (doc_id)
 where (kind = 1 or kind = 2 and question_no = 1) and len({S.strip('answer')}) > 0""")
def u2(spark, d):
    asked = P.parse_validation(load(spark, d, "validations")).select("doc_id", F.posexplode("questions").alias("n", "question"))
    asked = asked.select("doc_id", (F.col("n") + 1).alias("question_no"))
    said = load(spark, d, "answers").select("doc_id", "question_no", T.py_strip(F.col("answer")).alias("reply"))
    return asked.join(said, ["doc_id", "question_no"]).filter("length(reply) > 0")
