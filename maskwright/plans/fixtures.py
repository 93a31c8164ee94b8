"""Input tables derived from the given ones, as SQL that both engines read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "contracts": """
select c_custkey as doc_id,
 concat('ДОГОВОР № ', cast(c_custkey as string), chr(10),
  'ООО «', c_name, '», ИНН ', lpad(cast(3600000000 + c_custkey as string),10,'0'),
  ', КПП ', cast(366000000 + c_custkey as string), ', ОГРН ', cast(1080000000000 + c_custkey as string), chr(10),
  'E-mail: c', cast(c_custkey as string), '@example.com Тел.: +7 (473) ', lpad(cast(c_custkey % 1000 as string),3,'0'), '-43-21', chr(10),
  'ПОКУПАТЕЛЬ: ООО  «', upper(c_name), '» ИНН: ', lpad(cast(3600000000 + c_custkey as string),10,'0')) as text
from @customer@""",
    "responses": """
select c_custkey as doc_id, 0 as chunk_no, case c_custkey % 8
 when 0 then concat('{"entities":[{"original_text":"ИНН: ', cast(3600000000 + c_custkey as string), '","entity_type":"INN","confidence":0.9}]}')
 when 1 then concat('```json', chr(10), '{"entities":[{"original_text":"c', cast(c_custkey as string), '@example.com","entity_type":"EMAIL","confidence":"0.8"}]}', chr(10), '```')
 when 2 then concat('{"entities":[{"original_text":"', c_name, '","entity_type":"PARTY",},]}')
 when 3 then concat('{"entities":[{"original_text":"', c_name, '","entity_type":"BUYER"}]} и {не json}')
 when 4 then concat('{"entities":[{"original_text":"', c_name, '","entity_type":"PARTY","confidence":0.7},{"original_text":"ООО "Вектор"","entity_type":"PARTY"')
 when 5 then concat('{"entities":["foo",{"original_text":"', c_name, '","entity_type":"PARTY","n":NaN},7,null]}')
 when 6 then concat('{"entities":[{"original_text":"c', cast(c_custkey as string), '@example.com","entity_type":"PARTY","entity_type":"EMAIL"}]}')
 else 'нет данных' end as raw
from @customer@""",
    # what the answers above hold, as a table: level, value, type, confidence
    "answered": """
select c_custkey as doc_id, 0 as chunk_no, 0 as resp_no, c_custkey % 8 + 1 as kind, c_name,
 case c_custkey % 8 when 0 then concat('ИНН: ', cast(3600000000 + c_custkey as string)) when 1 then concat('c', cast(c_custkey as string), '@example.com') when 6 then concat('c', cast(c_custkey as string), '@example.com') else c_name end as original_text,
 case c_custkey % 8 when 0 then 'INN' when 1 then 'EMAIL' when 3 then 'BUYER' when 6 then 'EMAIL' else 'PARTY' end as entity_type,
 cast(case c_custkey % 8 when 0 then 0.9 when 1 then 0.8 when 4 then 0.7 else 1.0 end as double) as confidence,
 case c_custkey % 8 when 0 then 1 when 1 then 1 when 2 then 2 when 3 then 3 when 4 then 4 when 5 then 1 when 6 then 1 end as parse_level
from @customer@""",
    "cells": """
select o_custkey as doc_id, o_orderpriority as sheet, o_orderkey as row_no, col_no, value, is_formula from (
 select o_custkey, o_orderpriority, o_orderkey, 1 as col_no,
   concat(' order of Customer#', lpad(cast(o_custkey as string),9,'0'), ' ') as value, false as is_formula from @orders@
 union all select o_custkey, o_orderpriority, o_orderkey, 2,
   case when o_orderkey % 7 = 0 then null else cast(cast(o_totalprice as decimal(15,2)) as string) end, false from @orders@
 union all select o_custkey, o_orderpriority, o_orderkey, 3, concat('=A', cast(o_orderkey as string)), true from @orders@) t""",
    "cell_values": """
select o_custkey as doc_id, concat('Customer#', lpad(cast(o_custkey as string),9,'0')) as original_text, '[PARTY_REDACTED]' as mask, cast(1 as bigint) as ord
from @orders@ group by o_custkey
union all
select o_custkey, concat('order of customer#', lpad(cast(o_custkey as string),9,'0')), '[ORDER_REDACTED]', cast(2 as bigint) from @orders@ group by o_custkey""",
    "history": """
select event_id as seq, concat('/Data/', event_type, '/', cast(user_id as string), case when event_id % 3 = 0 then '.DOCX' else '.docx' end) as source_file
from @events@""",
    "files": """
select event_id as seq, concat('/Data/', event_type, '/', cast(user_id as string), case event_id % 5 when 0 then '.DOCX' when 1 then '.xlsx' when 2 then '.pdf' when 3 then '.txt' else '' end) as filename
from @events@""",
    "dirty_text": """
select doc_id, concat(
  replace(replace(case when doc_id % 3 = 0 then replace(text, 'th', concat('t-', chr(10), 'h')) else text end, ', ', ' — '), '. ', '…​ «№'), ' , x  ;', chr(9), chr(10), 'И Н Н 3 6 6 6 1', chr(10), ' ') as text
from @documents@""".replace("\\u00a0", " ").replace("\\u200b", "​"),
    "pages": """
select conv_id as doc_id, cast(turn + 1 as int) as page_no, concat('Page_', cast(turn + 1 as string)) as name,
 case when turn % 5 = 4 then '  ' else text end as text from @conversations@""",
    "fallback": """
select conv_id as doc_id, cast(turn + 1 as int) as page_no, case when turn % 10 = 9 then '' else concat('ocr ', role) end as text from @conversations@""",
    "paragraphs": """
select o_custkey as doc_id, cast(o_orderkey as int) as para_no, o_orderkey as element_no,
 case when o_orderkey % 11 = 0 then '' else concat(' order ', cast(o_orderkey as string), chr(10), o_orderpriority) end as text from @orders@""",
    "table_rows": """
select o_custkey as doc_id, o_orderkey as element_no, r as row_no,
 array(o_orderstatus, case when r = 2 then '' else cast(o_orderkey as string) end, o_orderpriority) as cells
from @orders@ cross join (select 1 as r union all select 2 union all select 3) n""",
    "notes": """
select o_custkey as doc_id, case when o_orderkey % 2 = 0 then 'footnote' else 'endnote' end as kind, cast(1 as int) as note_no,
 cast(o_orderkey % 3 as int) as block_no, cast(o_orderkey as int) as para_no,
 case o_orderkey % 5 when 0 then array(o_orderstatus, o_orderpriority) when 1 then array(o_orderpriority) when 2 then array('a', 'b', o_orderstatus) when 3 then array('') else array(' x') end as cells
from @orders@""",
    "note_texts": """
select c_custkey as doc_id, k as kind, cast(c_custkey % 3 as int) as note_no, concat('note ', c_name) as text
from @customer@ cross join (select 'footnote' as k union all select 'endnote') n""",
    "note_refs": """
select o_custkey as doc_id, cast(o_orderkey as int) as para_no, case when n = 2 then 'endnote' else 'footnote' end as kind, n as ref_no,
 case when o_orderkey % 7 = 0 then 'x1' else cast(o_orderkey % 4 as string) end as ref_id
from @orders@ cross join (select 1 as n union all select 2 union all select 3) m""",
    "link_runs": """
select o_custkey as doc_id, cast(o_orderkey as int) as para_no, cast(1 as int) as run_no, o_orderpriority as text,
 case when o_orderkey % 5 = 0 then null else concat('r', cast(o_orderkey % 3 as string)) end as rel_id, o_orderkey % 2 = 0 as is_link from @orders@""",
    "links": """
select c_custkey as doc_id, r as rel_id, concat('https://example.com/', r, '/', cast(c_custkey as string)) as url
from @customer@ cross join (select 'r0' as r union all select 'r1') n""",
    "runs": """
select c_custkey as doc_id, cast(1 as int) as para_no, n as run_no,
 case n when 1 then 'Party: [' when 2 then substr(c_name, 1, 4) when 3 then substr(c_name, 5, 6) when 4 then concat(substr(c_name, 11), '], ') else concat(cast(3600000000 + c_custkey as string), ' end') end as text,
 n = 3 and c_custkey % 4 = 0 or n = 5 and c_custkey % 9 = 0 as is_complex
from @customer@ cross join (select 1 as n union all select 2 union all select 3 union all select 4 union all select 5) m""",
    "run_values": """
select c_custkey as doc_id, lower(c_name) as original_text, '[PARTY_REDACTED]' as mask, cast(1 as bigint) as ord from @customer@
union all select c_custkey, cast(3600000000 + c_custkey as string), '[INN_REDACTED]', cast(2 as bigint) from @customer@""",
    "page_words": """
select c_custkey as doc_id, cast(1 as int) as page_no, cast(1 as int) as block_no, cast(l as int) as line_no, cast(w as int) as word_no,
 case l * 10 + w when 11 then 'ООО' when 12 then concat('«', c_name, '»,') when 13 then 'ИНН' when 14 then cast(3600000000 + c_custkey as string)
  when 21 then 'ооо' when 22 then c_name when 23 then 'and' when 24 then 'again' when 31 then 'ООО' when 32 then concat('(', c_name, ')') when 33 then 'tel' else '+7' end as word,
 cast(w * 50 as double) as x0, cast(l * 10 as double) as y0, cast(w * 50 + 40 as double) as x1, cast(l * 10 + 8 as double) as y1
from @customer@ cross join (select 1 as l union all select 2 union all select 3) a cross join (select 1 as w union all select 2 union all select 3 union all select 4) b""",
    "page_values": """
select c_custkey as doc_id, case c_custkey % 3 when 0 then concat('ООО ', c_name) when 1 then concat('ООО  «', c_name, '»') else concat('ооо', chr(10), '«', lower(c_name)) end as original_text,
 '[PARTY_REDACTED]' as mask, cast(1 as bigint) as ord from @customer@
union all select c_custkey, cast(3600000000 + c_custkey as string), '[INN_REDACTED]', cast(2 as bigint) from @customer@
union all select c_custkey, 'again', '[X_REDACTED]', cast(3 as bigint) from @customer@ where c_acctbal >= 0""",
    "validations": """
select c_custkey as doc_id, case c_custkey % 5
 when 0 then '{"status":"COMPLETE","questions":[],"missing_entities_candidates":[]}'
 when 1 then concat('{"status":"NEEDS_CLARIFICATION","questions":["Mask ', c_name, '?","More?"],"missing_entities_candidates":[{"original_text":"', c_name, '","entity_type":"PARTY","reason":"seen"}]}')
 when 2 then concat('text {"status":"NEEDS_CLARIFICATION","questions":["Which?"],"missing_entities_candidates":[{"original_text":"', cast(3600000000 + c_custkey as string), '","entity_type":"INN","reason":"r"}]} text')
 when 3 then '{"status":"NEEDS_CLARIFICATION"}' else '{broken' end as raw
from @customer@""",
    "validated": """
select c_custkey as doc_id, c_custkey % 5 <> 4 as parsed,
 case c_custkey % 5 when 0 then 'COMPLETE' when 4 then null else 'NEEDS_CLARIFICATION' end as status, c_custkey % 5 as kind, c_name from @customer@""",
    "answers": """
select c_custkey as doc_id, cast(q as int) as question_no, case when (c_custkey + q) % 3 = 0 then '  ' else concat(' yes ', c_name, ' ') end as answer
from @customer@ cross join (select 1 as q union all select 2) n""",
    "clarified": """
select c_custkey as doc_id, cast(1 as int) as question_no, case when c_acctbal < 0 then 'no' else concat('so: {"', c_name, '":"[PARTY_REDACTED]","extra ', cast(c_custkey as string), '":"[NEW_REDACTED]","', c_name, '":"[BUYER_REDACTED]"}') end as raw from @customer@""",
    "pairs": """
select c_custkey as doc_id, cast(1 as int) as question_no, cast(p as int) as pair_no, case when p = 0 then c_name else concat('extra ', cast(c_custkey as string)) end as original_text,
 case when p = 0 then '[BUYER_REDACTED]' else '[NEW_REDACTED]' end as mask
from @customer@ cross join (select 0 as p union all select 1) n where c_acctbal >= 0""",
    "old_values": """
select c_custkey as doc_id, c_name as original_text, '[PARTY_REDACTED]' as mask, cast(1 as bigint) as ord from @customer@ where c_acctbal >= 0
union all select c_custkey, cast(c_custkey as string), '[ID_REDACTED]', cast(2 as bigint) from @customer@""",
    "job_types": """
select c_custkey as job_id, array('INN', 'EMAIL') as ticked,
 case c_custkey % 4 when 0 then null when 1 then concat(c_mktsegment, '; inn,', chr(10), ' Fio ,,FIO') when 2 then '' else concat('x', cast(c_custkey as string), ',X', cast(c_custkey as string)) end as custom
from @customer@""",
    "parties": """
select o_custkey as doc_id, cast(0 as int) as chunk_no, cast(o_orderkey as int) as start_pos, cast(o_orderkey + 9 as int) as end_pos,
 concat('value ', cast(o_orderkey % 3 as string)) as original_text, case o_orderkey % 5 when 0 then 'BUYER' when 1 then 'SUPPLIER' when 2 then 'INN' when 3 then 'EMAIL' else 'PARTY' end as entity_type,
 concat('[', case o_orderkey % 5 when 0 then 'BUYER' when 1 then 'SUPPLIER' when 2 then 'INN' when 3 then 'EMAIL' else 'PARTY' end, '_REDACTED]') as masked_text, cast(1.0 as double) as confidence
from @orders@""",
    "runs_done": """
select event_id as seq, concat('/Data/', cast(user_id as string), '.pdf') as source_file, concat('/out/', cast(event_id as string), '.pdf') as masked,
 case when event_id % 2 = 0 then '' else concat('/out/', cast(event_id as string), '.json') end as report_json, cast(null as string) as report_txt from @events@""",
    "listing": """select concat('/out/', cast(event_id as string), '.pdf') as path from @events@ where event_type = 'click'""",
    "taken_names": """
select concat(cast(c_custkey as string), '_masked', case c_custkey % 3 when 0 then '' when 1 then '_v2' else '_v4' end, '.docx') as name from @customer@""",
    "new_files": """
select event_id as seq, concat('/Data/', event_type, '/', cast(user_id as string), '.docx') as source_file from @events@""",
    # a corpus of three formats: each customer's contract is a file of one of them
    "format_runs": """select r.* from runs r where doc_id % 3 = 0""",
    "format_cells": """
select doc_id, 'Sheet' as sheet, cast(1 as bigint) as row_no, cast(1 as int) as col_no, text as value, doc_id % 2 = 0 as is_formula from contracts where doc_id % 3 = 1
union all select doc_id, 'Sheet', cast(2 as bigint), cast(1 as int), concat('ИНН ', cast(3600000000 + doc_id as string)), false from contracts where doc_id % 3 = 1""",
    "format_words": """select w.* from page_words w where doc_id % 3 = 2""",
    "format_values": """
select * from run_values where doc_id % 3 < 2 union all select * from page_values where doc_id % 3 = 2""",
}


def named(sql: str) -> list[str]:
    """The derived tables that a text names."""
    return [n for n in SQL if n != "pages" and re.search(rf"\b{n}\b", sql)]


def _whole(name: str) -> str:
    """A recipe with the recipes of the derived tables it reads."""
    text = SQL[name]
    for other in ("contracts", "runs", "run_values", "page_words", "page_values"):
        if other != name:
            text = re.sub(rf"\bfrom {other}\b", lambda m, other=other: f"from ({SQL[other]})", text)
    return text


#: tables whose small rows become texts that cost much more than they: their rows are dealt out first, as a scan of one row group is one task
SPREAD = {"customer": "c_custkey"}


def n_tasks(spark: SparkSession) -> int:
    """Two for each core."""
    return max(8, 2 * spark.sparkContext.defaultParallelism)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    def given(m: re.Match) -> str:
        path = f"parquet.`{sf_dir}/{m[1]}.parquet`"
        return f"(select /*+ REPARTITION({n_tasks(spark)}, {SPREAD[m[1]]}) */ * from {path})" if m[1] in SPREAD else path

    return spark.sql(re.sub(r"@(\w+)@", given, _whole(name)))


def duck(name: str) -> str:
    """The same recipe for DuckDB."""
    text = _whole(name)
    text = re.sub(r"@(\w+)@", r"\1", text)
    return re.sub(r"\barray\(([^()]*(?:\([^()]*\)[^()]*)*)\)", r"[\1]", text).replace("cast(o_orderkey as string)", "cast(o_orderkey as varchar)")
