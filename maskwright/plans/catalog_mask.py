"""Queries over places, dictionaries and masking: L*, R*, M*."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import dictionary as R
from ..operators import locate as L
from ..operators import mask as M
from ..operators import pages as G
from ..operators import responses as P
from . import sqltext as S
from .catalog_text import CANDIDATES
from .fixtures import load

QUERIES, SQL = {}, {}


def joined(c: str):
    return F.array_join(F.col(c).cast("array<string>"), ",")


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


@query("l1_find_occurrences", S.with_("contracts", more="asked as (select doc_id, text, unnest(['ООО «', 'ооо', concat('customer#', lpad(cast(doc_id as varchar), 9, '0')), 'ооо «customer', 'ИНН', '10']) as needle from contracts)")
 + f" select doc_id, needle, coalesce(array_to_string(list_transform({S.occurrences('needle', 'text')}, lambda s: s.s), ','), '') as starts, coalesce(array_to_string(list_transform({S.occurrences('needle', 'text')}, lambda s: s.e), ','), '') as ends from asked")
def l1(spark, d):
    needles = F.array(F.lit("ООО «"), F.lit("ооо"), F.concat(F.lit("customer#"), F.lpad(F.col("doc_id").cast("string"), 9, "0")), F.lit("ооо «customer"), F.lit("ИНН"), F.lit("10"))
    rows = load(spark, d, "contracts").select("doc_id", "text", F.explode(needles).alias("needle"))
    found = L.find_occurrences(F.col("needle"), F.col("text"))
    return rows.select("doc_id", "needle", found.alias("f")).select("doc_id", "needle", joined("f.start").alias("starts"), joined("f.end").alias("ends"))


LOCATED = f"""{CANDIDATES},
firsts as (select doc_id, candidate, arg_min(struct_pack(chunk_no := chunk_no, resp_no := resp_no, cand_no := cand_no, entity_type := entity_type, confidence := confidence), (chunk_no, resp_no, cand_no)) as c
 from candidates where len(candidate) >= 2 group by all),
spread as (select doc_id, c, text, unnest({S.occurrences("candidate", "text")}) as s from firsts join contracts using (doc_id)),
located as (select doc_id, c.chunk_no as chunk_no, c.resp_no as resp_no, c.cand_no as cand_no, text[s.s + 1 : s.e] as original_text, concat('[', c.entity_type, '_REDACTED]') as masked_text,
 s.s as start_pos, s.e as end_pos, c.entity_type as entity_type, c.confidence as confidence from spread)"""
_COLUMNS = "doc_id, chunk_no, resp_no, cand_no, original_text, masked_text, start_pos, end_pos, entity_type, confidence"
DEDUPED = f"deduped as (select {_COLUMNS} from located qualify row_number() over (partition by doc_id, start_pos, end_pos order by chunk_no, resp_no, cand_no) = 1)"


@query("l2_locate_entities", S.with_("contracts", "answered", more=LOCATED) + f" select {_COLUMNS} from located")
def l2(spark, d):
    candidates = P.entity_candidates(P.explode_entities(P.parse_responses(load(spark, d, "responses"))))
    return L.locate_entities(candidates, load(spark, d, "contracts")).drop("hit_no")


@query("l3_dedup_spans", S.with_("contracts", "answered", more=LOCATED + ", " + DEDUPED) + f" select {_COLUMNS} from deduped")
def l3(spark, d):
    candidates = P.entity_candidates(P.explode_entities(P.parse_responses(load(spark, d, "responses"))))
    return L.dedup_spans(L.locate_entities(candidates, load(spark, d, "contracts")))


def _detected(table: str) -> str:
    parts, names = [], []
    for k, p in [*L.PATTERNS.items(), ("DIGITS", L.TOKEN + "+")]:
        name = f"hits_{k.lower()}"
        kind = S.q(k) if k != "DIGITS" else "case len(hit) " + " ".join(f"when {n} then {S.q(t)}" for n, t in L.DIGITS.items()) + " end"
        keep = "hit is not null" if k != "DIGITS" else f"regexp_full_match(hit, '[0-9]+') and len(hit) in ({', '.join(map(str, L.DIGITS))})"
        cut = f"select doc_id, unnest(string_split_regex(text, {S.q(p)})) as part, unnest(regexp_extract_all(text, {S.q(p)})) as hit, unnest(range(0, len(regexp_extract_all(text, {S.q(p)})) + 1)) as i from {table}"
        placed = f"select doc_id, hit, i, (sum(len(part) + coalesce(len(hit), 0)) over (partition by doc_id order by i))::int as upto from ({cut})"
        parts.append(f"{name} as (select doc_id, hit, upto - len(hit) as s, upto as e, {kind} as t from ({placed}) where {keep})")
        names.append(f"select * from {name}")
    return ", ".join(parts) + f""", detected as (select doc_id, hit as original_text, concat('[', t, '_REDACTED]') as masked_text, s::int as start_pos, e::int as end_pos, t as entity_type, 1.0::double as confidence,
 0 as chunk_no, 0 as resp_no, 0 as cand_no from ({" union all ".join(names)}))"""


@query("l4_detect_structured", f"with {_detected('documents')} select * from detected")
def l4(spark, d):
    return L.detect_structured(spark.read.parquet(f"{d}/documents.parquet"))


@query("l4_detect_in_contracts", S.with_("contracts", more=_detected("contracts")) + " select * from detected")
def l4c(spark, d):
    return L.detect_structured(load(spark, d, "contracts"))


@query("l5_select_target_types", S.with_("contracts", more=_detected("contracts")) + " select * from detected where entity_type in ('INN', 'EMAIL')")
def l5(spark, d):
    return L.select_target_types(L.detect_structured(load(spark, d, "contracts")), ["INN", "EMAIL"])


@query("l6_extract_entities", S.with_("contracts", "answered", more=LOCATED + ", " + DEDUPED) + f" select {_COLUMNS} from deduped")
def l6(spark, d):
    return L.extract_entities(load(spark, d, "contracts"), load(spark, d, "responses"))


# -- dictionary ----------------------------------------------------------------

_PARTY_AT = "(chunk_no, start_pos, end_pos)"
REPLACED = f"""replaced as (select doc_id, original_text, arg_max(masked_text, {_PARTY_AT}) as mask,
 row_number() over (partition by doc_id order by min({_PARTY_AT})) as ord from @ group by doc_id, original_text)"""


@query("r1_build_replacements", S.with_("parties", more=REPLACED.replace("@", "parties")) + " select doc_id, original_text, mask, ord from replaced")
def r1(spark, d):
    return R.build_replacements(load(spark, d, "parties"))


@query("r2_initial_items", S.with_("parties") + """
 select doc_id, (row_number() over (partition by doc_id order by chunk_no, start_pos, end_pos) - 1)::int as at, original_text as text, entity_type as type, masked_text as mask, confidence from parties""")
def r2(spark, d):
    return R.initial_items(load(spark, d, "parties")).select("doc_id", F.posexplode("items").alias("at", "x")).select("doc_id", "at", "x.*")


FINAL = f"""kinds as (select doc_id, original_text, arg_min(entity_type, {_PARTY_AT}) as kind from @ group by all),
final as (select r.doc_id, ord, r.original_text as text, coalesce(kind, 'USER_ADDED') as type, mask, kind is not null and mask <> concat('[', kind, '_REDACTED]') as type_conflict
 from replaced r left join kinds using (doc_id, original_text))"""


@query("r3_final_items", S.with_("parties", more=(REPLACED + ", " + FINAL).replace("@", "parties")) + " select * from final")
def r3(spark, d):
    entities = load(spark, d, "parties")
    return R.final_items(R.build_replacements(entities), entities)


@query("r4_merge_clarifications", S.with_("old_values", "pairs", more="""
 every as (select doc_id, original_text, mask, 0 as q, ord as n from old_values union all select doc_id, original_text, mask, question_no, pair_no from pairs)""")
 + " select doc_id, original_text, arg_max(mask, (q, n)) as mask, row_number() over (partition by doc_id order by min((q, n))) as ord from every group by doc_id, original_text")
def r4(spark, d):
    return R.merge_clarifications(load(spark, d, "old_values"), P.parse_clarifications(load(spark, d, "clarified")))


@query("r5_validation_status", S.with_("validated") + " select doc_id, case kind when 0 then 'complete' when 1 then 'ask' when 2 then 'ask' when 3 then 'nothing' else 'unparsed' end as outcome from validated")
def r5(spark, d):
    return R.validation_status(P.parse_validation(load(spark, d, "validations")))


_GAPS = f"""{LOCATED}, {DEDUPED}, {_detected("contracts")},
gaps as (select doc_id, original_text, entity_type, start_pos, end_pos from detected t
 where exists (select 1 from deduped e where e.doc_id = t.doc_id and e.entity_type = t.entity_type)
 and not exists (select 1 from deduped e where e.doc_id = t.doc_id and e.start_pos = t.start_pos and e.end_pos = t.end_pos))"""


def _partial(spark, d):
    """Only the first place of each value, so the detector finds gaps."""
    docs = load(spark, d, "contracts")
    found = L.extract_entities(docs, load(spark, d, "responses"))
    return docs, found, found.groupBy("doc_id", "entity_type").agg(F.min("start_pos").alias("start_pos"), F.min("end_pos").alias("end_pos"))


@query("r6_coverage_gaps", S.with_("contracts", "answered", more=_GAPS.replace("from deduped e where e.doc_id = t.doc_id and e.start_pos", "from firsts_only e where e.doc_id = t.doc_id and e.start_pos").replace("gaps as (", "firsts_only as (select doc_id, entity_type, min(start_pos) as start_pos, min(end_pos) as end_pos from deduped group by all), gaps as ("))
 + " select * from gaps")
def r6(spark, d):
    docs, _, few = _partial(spark, d)
    return R.coverage_gaps(few, L.detect_structured(docs))


@query("r7_party_completeness", S.with_("parties") + """
 select doc_id, bool_or(entity_type = 'BUYER') as has_buyer, bool_or(entity_type = 'SUPPLIER') as has_supplier,
  case when bool_or(entity_type = 'BUYER') <> bool_or(entity_type = 'SUPPLIER') or bool_or(entity_type = 'EMAIL' and original_text = 'value 0') then 'NEEDS_CLARIFICATION' else 'COMPLETE' end as status from parties group by doc_id""")
def r7(spark, d):
    parties = load(spark, d, "parties")
    return R.party_completeness(parties, parties.filter("entity_type = 'EMAIL' and original_text = 'value 0'"))


@query("r8_missing_candidates", S.with_("validated", "old_values", more="""
 named as (select doc_id, c_name as original_text, 'PARTY' as entity_type, 'seen' as reason from validated where kind = 1
  union all select doc_id, cast(3600000000 + doc_id as varchar), 'INN', 'r' from validated where kind = 2)""")
 + " select * from named n where not exists (select 1 from old_values o where o.doc_id = n.doc_id and o.original_text = n.original_text)")
def r8(spark, d):
    return R.missing_candidates(P.parse_validation(load(spark, d, "validations")), load(spark, d, "old_values"))


# -- masking -------------------------------------------------------------------


@query("m1_rank_replacements", S.with_("page_values") + """
 select doc_id, original_text, mask, row_number() over (partition by doc_id order by len(original_text) desc, ord)::int as rank from page_values""")
def m1(spark, d):
    return M.rank_replacements(load(spark, d, "page_values"))


@query("m2_flexible_pattern", S.with_("page_values", "page_words", more=f"pats as (select doc_id, original_text, {S.flexible('original_text')} as p from page_values), lines as (select doc_id, line_no, string_agg(word, ' ' order by word_no) as line from page_words group by all)")
 + " select doc_id, original_text, line_no, regexp_matches(line, p) as hit from pats join lines using (doc_id)")
def m2(spark, d):
    from ..functions.text import flexible_pattern

    pats = load(spark, d, "page_values").select("doc_id", "original_text", flexible_pattern(F.col("original_text")).alias("p"))
    lines = load(spark, d, "page_words").groupBy("doc_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("word_no", "word"))).alias("w"))
    lines = lines.select("doc_id", "line_no", F.array_join("w.word", " ").alias("line"))
    return pats.join(lines, "doc_id").select("doc_id", "original_text", "line_no", F.regexp_like("line", F.col("p")).alias("hit"))


_DETECTED_VALUES = "detected_values as (select doc_id, original_text, mask, ord from replaced union all select doc_id, concat('ооо «customer#', lpad(cast(doc_id as varchar), 9, '0'), '»'), '[PARTY_REDACTED]', 100 from contracts)"
_MASKING = f"""{_detected("contracts")}, {REPLACED.replace("@", "detected")}, {_DETECTED_VALUES},
dicts as ({S.dictionary("detected_values")}),
kept as (select c.doc_id, text, d, {S.kept("text", "d")} as k from contracts c left join dicts using (doc_id))"""


def _values(spark, d):
    docs = load(spark, d, "contracts")
    found = R.build_replacements(L.detect_structured(docs))
    name = F.concat(F.lit("ооо «customer#"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit("»"))
    return docs, found.unionByName(docs.select("doc_id", name.alias("original_text"), F.lit("[PARTY_REDACTED]").alias("mask"), F.lit(100).cast("long").alias("ord")))


@query("m3_resolve_overlaps", S.with_("contracts", more=_MASKING) + " select doc_id, array_to_string(list_transform(k, lambda x: x.s), ',') as starts, array_to_string(list_transform(k, lambda x: x.e), ',') as ends, array_to_string(list_transform(k, lambda x: x.m), ',') as masks from kept")
def m3(spark, d):
    docs, values = _values(spark, d)
    rows = M.mask_segments(docs, values)
    return rows.select("doc_id", joined("spans.start").alias("starts"), joined("spans.end").alias("ends"), joined("spans.mask").alias("masks"))


@query("m4_mask_segments", S.with_("contracts", more=_MASKING) + f" select doc_id, {S.glued(S.fragments('text', 'k'))} as masked from kept")
def m4(spark, d):
    docs, values = _values(spark, d)
    return M.mask_segments(docs, values, salt=3).select("doc_id", "masked")


@query("m4_residual_hits", S.with_("contracts", more=_MASKING + f", done as (select doc_id, d, {S.glued(S.fragments('text', 'k'))} as masked from kept)")
 + f" select doc_id, len({S.kept('masked', 'd')})::bigint as residual_hits from done")
def m4r(spark, d):
    docs, values = _values(spark, d)
    return M.residual_hits(M.mask_segments(docs, values), values)


RUNS = f"""paras as (select doc_id, para_no, string_agg(text, '' order by run_no) as text from runs group by all),
 placed as (select *, (sum(len(text)) over (partition by doc_id, para_no order by run_no) - len(text))::int as a, (sum(len(text)) over (partition by doc_id, para_no order by run_no))::int as b from runs),
 dicts as ({S.dictionary("run_values")}), kept as (select doc_id, para_no, unnest({S.kept("text", "d")}) as k from paras join dicts using (doc_id)),
 simple as (select * from kept where not exists (select 1 from placed p where p.doc_id = kept.doc_id and p.para_no = kept.para_no and p.is_complex and kept.k.e > p.a and kept.k.s < p.b)),
 own as (select p.doc_id, p.para_no, p.run_no, list(struct_pack(s := greatest(k.s, a) - a, e := least(k.e, b) - a, m := case when k.s >= a then k.m else '' end) order by k.s) as k
  from simple s join placed p on p.doc_id = s.doc_id and p.para_no = s.para_no and s.k.e > a and s.k.s < b group by all),
 joined as (select p.doc_id, p.para_no, p.run_no, p.text, p.is_complex, coalesce(k, []) as k from placed p left join own using (doc_id, para_no, run_no)),
 masked_runs as (select doc_id, para_no, run_no, text, is_complex, {S.glued(S.fragments('text', 'k'))} as masked from joined)"""


@query("m5_mask_runs", S.with_("runs", "run_values", more=RUNS) + " select * from masked_runs")
def m5(spark, d):
    return M.mask_runs(load(spark, d, "runs"), load(spark, d, "run_values")).drop("spans", "fragments")


@query("m6_highlight_fragments", S.with_("contracts", more=_MASKING + f", f as (select doc_id, {S.fragments('text', 'k')} as f from kept where len(k) > 0)")
 + " select doc_id, array_to_string(list_transform(f, lambda x: x.text), '|') as texts, array_to_string(list_transform(f, lambda x: case when x.is_mask then 'm' else 'p' end), '') as masks from f")
def m6(spark, d):
    docs, values = _values(spark, d)
    return M.mask_segments(docs, values).filter("fragments is not null").select("doc_id", F.array_join("fragments.text", "|").alias("texts"), F.array_join(F.transform("fragments", lambda x: F.when(x["is_mask"], "m").otherwise("p")), "").alias("masks"))


CELLS = f"""dicts as ({S.dictionary("cell_values")}),
kept as (select c.*, case when value is not null and not is_formula and not starts_with(value, '=') then {S.kept("value", "d")} else [] end as k from cells c left join dicts using (doc_id)),
done as (select doc_id, sheet, row_no, col_no, case when len(k) > 0 then {S.glued(S.fragments("value", "k"))} else value end as masked, len(k) > 0 as modified, len(k) as n from kept)"""


@query("m7_mask_cells", S.with_("cells", "cell_values", more=CELLS) + " select doc_id, sheet, row_no, col_no, masked, modified from done")
def m7(spark, d):
    return M.mask_cells(load(spark, d, "cells"), load(spark, d, "cell_values"), salt=2, spans=False).select("doc_id", "sheet", "row_no", "col_no", "masked", "modified")


@query("m8_cell_stats", S.with_("cells", "cell_values", more=CELLS) + " select doc_id, sum(n)::bigint as n_fragments, count_if(modified)::bigint as n_cells from done group by doc_id")
def m8(spark, d):
    return M.cell_stats(M.mask_cells(load(spark, d, "cells"), load(spark, d, "cell_values")))


# -- pages ---------------------------------------------------------------------

_RANKED = "ranked as (select doc_id, original_text, mask, row_number() over (partition by doc_id order by len(original_text) desc, ord)::int as rank from page_values)"
_TEXTS = "texts as (select doc_id, page_no, string_agg(word, ' ' order by block_no, line_no, word_no) as text from page_words group by all)"
_FOLD = lambda c: S.spans("lower(text)", S.escape(f"lower({c})"))
_EXACT = f"""{_RANKED}, {_TEXTS},
levels as (select doc_id, page_no, rank, mask, original_text, {_FOLD(S.strip("original_text"))} as one, {_FOLD(f"regexp_replace({S.strip('original_text')}, '{S.WS}+', ' ', 'g')")} as two from texts join ranked using (doc_id)),
exact as (select doc_id, page_no, rank, mask, original_text, level, s.s as start, s.e as "end" from (
 select *, case when len(one) > 0 then 1 else 2 end as level, unnest(case when len(one) > 0 then one else two end) as s from levels))"""
_NORM = "lower(regexp_replace(w, '[^\\p{L}\\p{N}_]+', '', 'g'))"
_BY_WORD = f"""lines as (select doc_id, page_no, block_no, line_no, list({_NORM.replace("(w,", "(word,")} order by word_no) as line, list(word_no order by word_no) as numbers from page_words group by all),
targets as (select *, list_transform(string_split_regex({S.strip("original_text")}, '{S.WS}+'), lambda w: {_NORM}) as target from ranked),
starts as (select *, unnest(range(1, len(line) + 1)) as i from lines),
by_word as (select s.doc_id, page_no, rank, mask, original_text, block_no, line_no, numbers[i] as first, len(target)::int as n from starts s join targets t on t.doc_id = s.doc_id
 and len(target) >= 2 and line[i : i + len(target) - 1] = target)"""


def _pages(spark, d):
    return load(spark, d, "page_words"), load(spark, d, "page_values")


@query("m9_search_phrase_exact", S.with_("page_words", "page_values", more=_EXACT) + " select * from exact")
def m9(spark, d):
    words, values = _pages(spark, d)
    return G.search_phrase_exact(words, M.rank_replacements(values))


@query("m10_search_phrase_words", S.with_("page_words", "page_values", more=_EXACT + ", " + _BY_WORD) + " select * from by_word")
def m10(spark, d):
    words, values = _pages(spark, d)
    return G.search_phrase_words(words, M.rank_replacements(values))


_BOXES = f"""{_EXACT}, {_BY_WORD},
places as (select *, (sum(len(word) + 1) over (partition by doc_id, page_no order by block_no, line_no, word_no) - len(word) - 1)::int as pos from page_words),
one as (select e.doc_id, e.page_no, rank, mask, start, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from exact e join places p on p.doc_id = e.doc_id and p.page_no = e.page_no
 and pos < "end" and pos + len(word) > start group by all),
two as (select b.doc_id, b.page_no, rank, mask, b.line_no, first, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from by_word b join page_words p on p.doc_id = b.doc_id and p.page_no = b.page_no
 and p.block_no = b.block_no and p.line_no = b.line_no and word_no >= first and word_no < first + n
 where not exists (select 1 from exact e where e.doc_id = b.doc_id and e.page_no = b.page_no and e.rank = b.rank) group by all),
every as (select doc_id, page_no, rank, mask, x0, y0, x1, y1 from one union all select doc_id, page_no, rank, mask, x0, y0, x1, y1 from two),
boxes as (select doc_id, page_no, x0, y0, x1, y1, mask, rank from every qualify row_number() over (partition by doc_id, page_no, round(x0, 1), round(y0, 1), round(x1, 1), round(y1, 1) order by rank, x0) = 1)"""


@query("m11_match_boxes", S.with_("page_words", "page_values", more=_BOXES) + " select * from boxes")
def m11(spark, d):
    return G.match_boxes(*_pages(spark, d))


REDACTED = f"""{_BOXES},
under as (select w.*, (select min({{'r': rank, 'm': mask, 'a': b.x0, 'b': b.y0, 'c': b.x1, 'd': b.y1}}) from boxes b where b.doc_id = w.doc_id and b.page_no = w.page_no
 and (w.x0 + w.x1) / 2 between b.x0 and b.x1 and (w.y0 + w.y1) / 2 between b.y0 and b.y1) as box from page_words w),
shown as (select doc_id, page_no, block_no, line_no, word_no, word from under where box is null
 union all select doc_id, page_no, min(block_no), arg_min(line_no, (block_no, line_no, word_no)), arg_min(word_no, (block_no, line_no, word_no)), box.m from under where box is not null group by doc_id, page_no, box)"""


@query("m12_redact_pages", S.with_("page_words", "page_values", more=REDACTED) + " select doc_id, page_no, string_agg(word, ' ' order by block_no, line_no, word_no) as masked from shown group by all")
def m12(spark, d):
    words, values = _pages(spark, d)
    return G.redact_pages(words, G.match_boxes(words, values))


@query("m12_redact_pages_blank", S.with_("page_words", "page_values", more=REDACTED) + " select doc_id, page_no, string_agg(word, ' ' order by block_no, line_no, word_no) as masked from under where box is null group by all")
def m12b(spark, d):
    words, values = _pages(spark, d)
    return G.redact_pages(words, G.match_boxes(words, values), add_text_overlay=False)


@query("m13_page_area_counts", S.with_("page_words", "page_values", more=_BOXES) + """
 select p.doc_id, p.page_no, count(b.rank) as n_areas from (select distinct doc_id, page_no from page_words) p left join boxes b using (doc_id, page_no) group by all""")
def m13(spark, d):
    words, values = _pages(spark, d)
    return G.page_area_counts(words, G.match_boxes(words, values))


def _of_format(sql: str, *names: str) -> str:
    """The same query over the tables of one format."""
    for name, other in zip(names, ("format_values", "format_runs", "format_cells", "format_words")):
        sql = re.sub(rf"\b{name}\b", other, sql) if name else sql
    return sql


@query("m14_mask_by_format", S.with_("format_runs", "format_cells", "format_words", "format_values") + f"""
 select doc_id, 'docx' as file_type, para_no as seg_no, string_agg(masked, '' order by run_no) as masked from (with {_of_format(RUNS, "run_values", "runs")} select * from masked_runs) group by all
 union all select doc_id, 'xlsx', (row_number() over (partition by doc_id order by sheet, row_no, col_no))::int, masked from (with {_of_format(CELLS, "cell_values", "", "cells")} select * from done)
 union all select doc_id, 'pdf', page_no, string_agg(word, ' ' order by block_no, line_no, word_no) from (with {_of_format(REDACTED, "page_values", "", "", "page_words")} select * from shown) group by all""")
def m14(spark, d):
    return M.mask_by_format(*[load(spark, d, f"format_{x}") for x in ("cells", "runs", "words", "values")])
