"""Unit vectors, invariants and comparisons with plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.operators import assemble, chunks, dictionary, history, locate, mask, pages, reports, responses
from maskwright.plans.deidentify import deidentify
from maskwright.sources import io
from maskwright.streaming.incremental import mask_stream


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    return [r[0] for r in df.select(f(F.col("v")).alias("x"), "i").orderBy("i").select("x").collect()]


@pytest.mark.parametrize(
    "f, given, expected",
    [
        (T.strip_value_prefix, ["ИНН: 3666123456", "E-mail: sales@mail.ru", "ИНН:1", "ИНН: ", "тел.  5", "Адрес - г. N", "", "Директор X"], ["3666123456", "sales@mail.ru", "ИНН:1", "ИНН:", "5", "г. N", "", "Директор X"]),
        (T.fix_letter_spacing, ["И Н Н 3 6 6 6 1 2 3 4 5 6", "a b c d", "x\na b c d e\ny z"], ["ИНН3666123456", "a b c d", "x\nabcde\ny z"]),
        (T.join_hyphenated, ["теле-\nфон", "a- \nb"], ["телефон", "a- \nb"]),
        (T.merge_wrapped_lines, ["ИНН\n3666123456", "a:\nb", "a  \n\nb \nc", "", None], ["ИНН 3666123456", "a:\nb", "a\n\nb c", "", None]),
        (T.tidy_spaces, ["a , b", "a\n. b", "a \t b"], ["a, b", "a. b", "a b"]),
        (T.py_strip, ["\xa0 a\u2003\n", "\n\n"], ["a", ""]),
        (T.normalize_text, [None, ""], [None, ""]),
    ],
)
def test_vectors(spark, f, given, expected):
    assert apply(spark, f, given) == expected


def python_normalize(text):
    text = text.translate({ord(c): None for c in T.ZERO_WIDTH})
    for group, to in ((T.QUOTES, '"'), (T.DASHES, "-"), ("№", "N"), ("…", "..."), (T.SPACES, " ")):
        for c in group:
            text = text.replace(c, to)
    text = re.sub(r"(\w)-\n(\w)", r"\1\2", text)
    out = []
    for line in (x.rstrip() for x in text.split("\n")):
        if line and out and out[-1] and out[-1][-1] not in ".!?:;":
            out[-1] += " " + line
        else:
            out.append(line)
    fixed = []
    for line in out:
        parts = line.split(" ")
        wide = len(parts) >= 5 and sum(len(p) == 1 for p in parts) / len(parts) >= 0.6
        fixed.append("".join(parts) if wide else line)
    return re.sub(r"\s+([,.;:!?])", r"\1", re.sub(r"[ \t]+", " ", "\n".join(fixed)))


def test_normalize_like_plain_python(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab И1 \n\n-.,:\t«№…\u200b\xa0\u2003") for _ in range(rnd.randint(1, 40))) for _ in range(1500)]
    assert apply(spark, T.normalize_text, texts) == [python_normalize(t) for t in texts]


def python_occurrences(needle, text):
    found = {m.span() for m in re.finditer(re.escape(needle), text)}
    tokens = needle.split()
    if len(tokens) > 1:
        found |= {m.span() for m in re.finditer(r"\s+".join(map(re.escape, tokens)), text, re.I)}
    return sorted(found)


def python_mask(text, values):
    ranked = sorted(((k, m) for k, m in values if k.strip()), key=lambda x: -len(x[0]))
    hits = []
    for rank, (key, m) in enumerate(ranked):
        pattern = "".join(r"\s+" if c.isspace() else re.escape(c) for c in key.strip())
        hits += [(x.start(), x.start() - x.end(), rank, x.end(), m) for x in re.finditer(pattern, text, re.I)]
    out, upto, kept = "", 0, []
    for start, _, _, end, m in sorted(hits):
        if start >= upto:
            out += text[upto:start] + m
            upto = end
            kept.append((start, end))
    return out + text[upto:], kept


def test_find_and_mask_like_plain_python(spark):
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abAxИи .\n+$(") for _ in range(n))
    rows = []
    for i in range(400):
        values = {word(rnd.randint(1, 5)): f"[M{k}$1]" for k in range(rnd.randint(1, 4))}
        rows.append((i, word(rnd.randint(0, 40)), list(values.items())))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    values = spark.createDataFrame([(i, k, m, n) for i, _, vs in rows for n, (k, m) in enumerate(vs, 1)], "doc_id long, original_text string, mask string, ord long")
    got = {r.doc_id: r for r in mask.mask_segments(docs, values).collect()}
    for i, text, vs in rows:
        masked, kept = python_mask(text, vs)
        assert (got[i].masked, [(s.start, s.end) for s in got[i].spans]) == (masked, kept), (text, vs)
        assert not got[i].spans or "".join(f.text for f in got[i].fragments) == masked
    found = docs.join(values, "doc_id").select("doc_id", "original_text", locate.find_occurrences(F.col("original_text"), F.col("text")).alias("s")).collect()
    texts = {i: t for i, t, _ in rows}
    for r in found:
        assert [(x.start, x.end) for x in r.s] == python_occurrences(r.original_text, texts[r.doc_id]), (r.original_text, texts[r.doc_id])
    assert {r.doc_id: r.masked for r in mask.mask_segments(docs, values, salt=4).collect()} == {i: got[i].masked for i in got}


def test_stated_masking_cases(spark):
    cases = [("xaaa", ["xa", "aa"]), ("abcd", ["ab", "abc"]), ("a b a \n b", ["a  b"]), ("3666123456", ["366"])]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    values = spark.createDataFrame([(i, k, "[M]", n) for i, (_, ks) in enumerate(cases) for n, k in enumerate(ks)], "doc_id long, original_text string, mask string, ord long")
    got = {r.doc_id: r.masked for r in mask.mask_segments(docs, values).collect()}
    assert got == {0: "[M]aa", 1: "[M]d", 2: "a b [M]", 3: "[M]6123456"}


def test_run_spans_take_the_first_run_and_skip_complex_ones(spark):
    runs = [(1, 1, n, t, False) for n, t in enumerate(["So", "ko", "lov"])] + [(2, 1, n, t, n == 1) for n, t in enumerate(["So", "ko", "lov"])]
    df = spark.createDataFrame(runs, "doc_id long, para_no int, run_no int, text string, is_complex boolean")
    values = spark.createDataFrame([(1, "Sokolov", "[FIO_REDACTED]", 1), (2, "Sokolov", "[FIO_REDACTED]", 1)], "doc_id long, original_text string, mask string, ord long")
    got = {(r.doc_id, r.run_no): r.masked for r in mask.mask_runs(df, values).collect()}
    assert [got[1, n] for n in range(3)] == ["[FIO_REDACTED]", "", ""] and [got[2, n] for n in range(3)] == ["So", "ko", "lov"]


def test_chunk_counts(spark):
    docs = spark.createDataFrame([(n, "x" * n) for n in (1, 6000, 6001, 11300)], "doc_id long, text string")
    got = {r.doc_id: r["count"] for r in chunks.chunk_sliding(docs).groupBy("doc_id").count().collect()}
    assert got == {1: 1, 6000: 1, 6001: 2, 11300: 3}


def test_mask_and_type_can_disagree(spark):
    e = [(1, 0, 0, 3, "abc", "PARTY", "[PARTY_REDACTED]", 1.0), (1, 1, 0, 3, "abc", "BUYER", "[BUYER_REDACTED]", 1.0)]
    entities = spark.createDataFrame(e, "doc_id long, chunk_no int, start_pos int, end_pos int, original_text string, entity_type string, masked_text string, confidence double")
    r = dictionary.final_items(dictionary.build_replacements(entities), entities).first()
    assert (r.mask, r.type, r.type_conflict) == ("[BUYER_REDACTED]", "PARTY", True)


def test_report_defaults(spark):
    docs = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "doc_id long, source_file string, masked_file string")
    final = spark.createDataFrame([(1, 1, "", None, "")], "doc_id long, ord long, text string, type string, mask string")
    initial = spark.createDataFrame([], "doc_id long, items array<struct<text:string,type:string,mask:string,confidence:double>>")
    got = {r.doc_id: r.report for r in reports.txt_report(docs, reports.report_items(initial, final), "T").collect()}
    assert "1. [UNKNOWN] 'N/A' -> '[MASKED]'" in got[1] and len(got[2].split("\n")) == 14
    assert '"initial_detected_count":0' in reports.json_report(docs, reports.report_items(initial, final), "T").filter("doc_id = 2").first().report


def test_versioned_names_fill_gaps(spark):
    new = spark.createDataFrame([(1, "/a/f.docx"), (2, "/b/f.docx")], "seq long, source_file string")
    there = spark.createDataFrame([("f_masked.docx",), ("f_masked_v3.docx",)], "name string")
    assert [r.masked_name for r in history.versioned_names(new, there).orderBy("seq").collect()] == ["f_masked_v2.docx", "f_masked_v4.docx"]


def test_answers_that_fail_are_rows_with_an_error(spark):
    asked = spark.createDataFrame([(1, 0, "good"), (2, 0, "bad")], "doc_id long, chunk_no int, prompt string").coalesce(1)

    def model(prompts):
        if "bad" in list(prompts):
            raise ValueError("no")
        return prompts.str.upper()

    got = {r.doc_id: (r.raw, r.error) for r in responses.answer_requests(asked, model).collect()}
    assert got == {1: ("GOOD", None), 2: (None, "ValueError: no")}


def test_parse_levels(spark):
    raws = ['x {"entities":[]} y', '{"entities":[{"original_text":"a","entity_type":null,}]}', '{"a":1}{"entities":[{"original_text":7,"entity_type":"T"}]}', '{"entities":[{"original_text":"q\\"z","entity_type":"T","confidence":0.5},{', "none", None, '{"e":"}"} {']
    df = spark.createDataFrame(list(enumerate(raws)), "doc_id long, raw string").withColumn("chunk_no", F.lit(0))
    parsed = responses.parse_responses(df)
    assert {r.doc_id: r.parse_level for r in parsed.collect()} == {0: 1, 1: 2, 2: 3, 3: 4, 4: None, 5: None, 6: 1}
    got = {r.doc_id: (r.original_text, r.entity_type, r.confidence) for r in responses.explode_entities(parsed).collect()}
    assert got == {1: ("a", "UNKNOWN", 1.0), 2: ("7", "T", 1.0), 3: ('q"z', "T", 0.5)}


def test_note_tables(spark):
    rows = [(1, "f", 1, 0, n, c) for n, c in enumerate([["a", "b"], [], ["c", "d"], ["e"], ["g", "h"]])]
    df = spark.createDataFrame(rows, "doc_id long, kind string, note_no int, block_no int, para_no int, cells array<string>")
    s, e = assemble.TABLE_START, assemble.TABLE_END
    assert assemble.flatten_notes(df).first().text == (f"{s}a | b \nc | d{e}e {s}g | h").strip() + e


def test_pages_keep_words_outside_the_boxes(spark):
    words = spark.createDataFrame([(1, 1, 1, 1, n, w, n * 10.0, 0.0, n * 10.0 + 8, 8.0) for n, w in enumerate("pay Ivan, Petrov now".split())],
        "doc_id long, page_no int, block_no int, line_no int, word_no int, word string, x0 double, y0 double, x1 double, y1 double")
    values = spark.createDataFrame([(1, "Ivan Petrov", "[FIO_REDACTED]", 1)], "doc_id long, original_text string, mask string, ord long")
    boxes = pages.match_boxes(words, values)
    assert pages.redact_pages(words, boxes).first().masked == "pay [FIO_REDACTED] now"
    assert pages.redact_pages(words, boxes, add_text_overlay=False).first().masked == "pay now"


def test_hot_document(spark):
    rows = [(1 if n % 2 else n, n, f"Call {n} a@b.com") for n in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, seg_no int, text string")
    values = spark.createDataFrame([(1, "a@b.com", "[EMAIL_REDACTED]", 1)], "doc_id long, original_text string, mask string, ord long")
    got = mask.mask_segments(docs, values, salt=8)
    assert got.filter("masked like '%REDACTED%'").count() == 1000 and got.count() == 2000


def test_read_write_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "A: a@b.com, +7 (473) 123-45-67"), (2, "nothing"), (3, None)], "doc_id long, text string")
    r = deidentify(docs)
    io.write_masked(r.masked.select("doc_id", "masked").withColumn("file_type", F.lit("docx")), f"{tmp_path}/m")
    io.write_json_reports(r.json_reports, f"{tmp_path}/j")
    io.write_txt_reports(r.txt_reports, f"{tmp_path}/t")
    back = {x.doc_id: x.masked for x in io.read_corpus(spark, f"{tmp_path}/m").collect()}
    assert back == {1: "A: [EMAIL_REDACTED], [PHONE_REDACTED]", 2: "nothing", 3: None}
    assert spark.read.json(f"{tmp_path}/j").filter("stats.final_masked_count = 2").count() == 1
    assert io.read_corpus(spark, f"{tmp_path}/t", "text").count() >= 1


def test_stream_masks_new_files(spark, tmp_path):
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "a@b.com")], schema).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        mask_stream(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert [r.masked for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["[EMAIL_REDACTED]"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    r = deidentify(docs)
    assert [x.count() for x in (r.masked, r.entities, r.replacements, r.json_reports)] == [0, 0, 0, 0]


def test_odd_answers_lose_nothing_else(spark):
    raws = [
        '{"entities":["foo",{"original_text":"y1","entity_type":"A","n":NaN},3,null,[1],{"original_text":7,"confidence":"x","variants":["a"]}]}',
        '{"entities":[{"original_text":"z","entity_type":"A","entity_type":"B","confidence":0.5}]}',
        '{"entities":{"a":1}}', '{"x":-Infinity}', 'a {"entities":[{"original_text":"w","entity_type":"A","entity_type":"C"}]} b {c}', None, "", "{", '{"entities":[{"original_text":null}]}',
    ]
    df = spark.createDataFrame([(i, 0, r) for i, r in enumerate(raws)], "doc_id long, chunk_no int, raw string")
    parsed = responses.parse_responses(df)
    assert {r.doc_id: r.parse_level for r in parsed.collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 3, 5: None, 6: None, 7: None, 8: 1}
    got = sorted((r.doc_id, r.original_text, r.entity_type, r.confidence, r.variants) for r in responses.explode_entities(parsed).collect())
    assert got == [(0, "7", "UNKNOWN", 1.0, ["a"]), (0, "y1", "A", 1.0, None), (1, "z", "B", 0.5, None), (4, "w", "C", 1.0, None)]
    said = spark.createDataFrame([(1, 1, 'so {"a":"x","b":"y","a":"z"}'), (2, 1, '{"a":NaN}'), (3, 1, "no")], "doc_id long, question_no int, raw string")
    assert [tuple(r) for r in responses.parse_clarifications(said).orderBy("doc_id", "pair_no").collect()] == [(1, 1, 0, "a", "z"), (1, 1, 1, "b", "y"), (2, 1, 0, "a", "NaN")]


def test_balanced_objects_by_single_steps(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice('{}{}"\\a,') for _ in range(rnd.randint(0, 30))) for _ in range(1500)] + ["{" + '"a\\"}",' * 3000 + "}{}"]

    def plain(text):
        """Depth after each brace outside strings; a piece runs from a brace that leaves depth zero to the next that comes back to it."""
        found, depth, begin, i = [], 0, None, 0
        while i < len(text):
            if text[i] == '"':
                end = re.compile(r'(?:[^"\\]|\\.)*', re.S).match(text, i + 1).end()
                i = end + 1
                continue
            if text[i] == "{":
                begin = i if depth == 0 else begin
                depth += 1
            elif text[i] == "}":
                depth -= 1
                if depth == 0 and begin is not None:
                    found.append(text[begin : i + 1])
                    begin = None
            i += 1
        return found

    assert apply(spark, responses.balanced_objects, texts) == [plain(t) for t in texts]


def test_long_texts_with_many_hits(spark):
    import time

    n = 100_000
    text = " ".join(f"word a{i}@b.cc 36{i:08d}" for i in range(n))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    began = time.perf_counter()
    found = locate.detect_structured(docs)
    assert {(r.entity_type, r.n) for r in found.groupBy("entity_type").agg(F.count("*").alias("n")).collect()} == {("EMAIL", n), ("INN", n)}
    last = found.filter("entity_type = 'INN'").orderBy(F.desc("start_pos")).first()
    assert text[last.start_pos : last.end_pos] == last.original_text == f"36{n - 1:08d}"
    values = spark.createDataFrame([(1, "word", "[W]", 1), (1, "a7@b.cc", "[E]", 2)], "doc_id long, original_text string, mask string, ord long")
    row = mask.mask_segments(docs, values).filter("doc_id = 1").first()
    assert row.masked == text.replace("word", "[W]").replace("a7@b.cc", "[E]") and len(row.spans) == n + 1
    assert time.perf_counter() - began < 120


def test_whole_words_and_empty_texts(spark):
    key = spark.createDataFrame([("Ann",)], "k string").select(T.flexible_pattern(F.col("k"), whole_word=True).alias("p")).first().p
    hits = spark.createDataFrame([("ann Anna,ANN «Ann» Иann",)], "t string").select(F.regexp_extract_all("t", F.lit(key), F.lit(0)).alias("h")).first().h
    assert hits == ["ann", "ANN", "Ann"]
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "x")], "doc_id long, text string")
    assert [tuple(r) for r in chunks.chunk_sliding(docs).collect()] == [(3, 0, "x")]
    page = spark.createDataFrame([(1, 1, "Page_1", "text")], "doc_id long, page_no int, name string, text string")
    assert chunks.chunk_by_page(page).first().chunk == "--- Страница 1 ---\ntext"


def test_detector_and_answers_both_count(spark):
    docs = spark.createDataFrame([(1, "mail a@b.com to Ann, INN 3600000001")], "doc_id long, text string")
    raw = '{"entities":[{"original_text":"Ann","entity_type":"FIO"},{"original_text":"3600000001","entity_type":"TAX"}]}'
    answers = spark.createDataFrame([(1, 0, raw)], "doc_id long, chunk_no int, raw string")
    run = deidentify(docs, answers)
    assert run.masked.first().masked == "mail [EMAIL_REDACTED] to [FIO_REDACTED], INN [TAX_REDACTED]"
    assert run.gaps.count() == 0 and run.entities.count() == 3
