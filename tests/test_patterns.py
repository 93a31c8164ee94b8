"""The automaton against one regular expression a value, on random texts; costs that must not grow with the number of values, runs or boxes."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from maskwright.functions import patterns
from maskwright.functions.text import WS
from maskwright.operators import locate, mask, pages

SPACE = "[" + patterns._SET + "]"


def flexible(value):
    v = re.sub(f"^{SPACE}+|{SPACE}+$", "", value)
    return re.compile("".join(f"{SPACE}+" if re.match(SPACE, c) else re.escape(c) for c in v), re.I)


def kept(text, values):
    """The rule, value by value."""
    pooled = [(m.start(), m.end(), i) for i, v in enumerate(values) for m in flexible(v).finditer(text)]
    out, upto = [], 0
    for a, b, i in sorted(pooled, key=lambda x: (x[0], x[0] - x[1], x[2])):
        if a >= upto:
            out.append((a, b, i))
            upto = b
    return out


def words(rnd, alphabet, n):
    return "".join(rnd.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize("seed", range(40))
def test_flexible_values_equal_their_patterns(seed):
    rnd = random.Random(seed)
    alphabet = "abAB «.(+ \n\t  ИиНн" if seed % 2 else "ab  \n"
    values = [v for v in (words(rnd, alphabet, rnd.randint(1, 6)) for _ in range(8)) if patterns.strip(v)]
    for _ in range(30):
        text = words(rnd, alphabet, rnd.randint(0, 60))
        assert patterns.leftmost_longest(patterns.Flexible(values).hits(text)) == kept(text, values)


@pytest.mark.parametrize("seed", range(20))
def test_occurrences_equal_their_patterns(seed):
    rnd = random.Random(seed)
    alphabet = "abAB  \nÄä"
    needles = [words(rnd, alphabet, rnd.randint(1, 5)) for _ in range(6)]
    for _ in range(30):
        text = words(rnd, alphabet, rnd.randint(0, 50))
        got = patterns.Occurrences(needles).hits(text)
        for i, n in enumerate(needles):
            want = {m.span() for m in re.finditer(re.escape(n), text)}
            tokens = [re.escape(t) for t in n.split()]
            if len(tokens) > 1:
                want |= {m.span() for m in re.finditer(f"{SPACE}+".join(tokens), text, re.I)}
            assert got.get(i, []) == sorted(want)


def test_folding_keeps_places():
    text = "İstanbul ΣΑΣ ſtraße K ŉ ᾳ ẞ 😀 ϐ ı µ"
    assert len(patterns.fold(text)) == len(text)
    assert patterns.fold("ΣΑΣ") == "σασ" and patterns.fold("ς") == "σ" and patterns.fold("İI") == "ii" and patterns.fold("ſ") == "s"
    c = patterns.Collapsed("a \n b　 c")
    assert c.text == "a b c" and [c.place(i) for i in (0, 2, 4)] == [0, 4, 7]


def test_white_space_is_that_of_the_column_functions():
    every = [chr(i) for i in range(0x3100) if re.match(SPACE, chr(i))]
    listed = re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", WS)
    assert every == [chr(i) for i in range(0x3100) if re.match(listed, chr(i))] and len(every) == 29


def test_texts_of_single_spaces_stay_as_they_are():
    assert [c for c in map(chr, range(0x110000)) if c.isspace()] == [c for c in map(chr, range(0x110000)) if re.match(SPACE, c)]
    for text, collapsed in (("\n  a b c\t ", "\n  a b c\t "), ("a\xa0b", "a b"), ("a  b", "a b"), (" a \nb ", " a b "), ("", ""), (" \n", " \n")):
        assert patterns.Collapsed(text).text == collapsed


def test_cost_does_not_grow_with_the_number_of_values():
    rnd = random.Random(1)
    text = " ".join(words(rnd, "abcdefgh", 6) for _ in range(40_000))

    def cost(n):
        values = [words(rnd, "abcdefgh", 9) for _ in range(n)]
        held = patterns.Flexible(values)
        took = []
        for _ in range(3):
            began = time.perf_counter()
            list(held.hits(text))
            took.append(time.perf_counter() - began)
        return min(took)

    assert cost(1000) < 4 * cost(10) + 0.05


def test_a_paragraph_of_very_many_runs_and_spans():
    runs = [{"text": "ab", "is_complex": i % 10 == 0} for i in range(100_000)]
    spans = [{"start": 2 * i + 1, "end": 2 * i + 3, "mask": "M"} for i in range(0, 99_999, 2)]
    began = time.perf_counter()
    own = mask.spread_over_runs(runs, spans)
    assert time.perf_counter() - began < 3
    assert own[2] == [{"start": 1, "end": 2, "mask": "M"}] and own[3] == [{"start": 0, "end": 1, "mask": ""}] and own[0] == own[1] == []


def test_an_empty_run_inside_a_span():
    run = lambda t, c=False: {"text": t, "is_complex": c}
    span = [{"start": 1, "end": 3, "mask": "M"}]
    assert [len(x) for x in mask.spread_over_runs([run("ab"), run(""), run("cd")], span)] == [1, 1, 1]
    assert mask.spread_over_runs([run("ab"), run("", True), run("cd")], span) == [[], [], []]
    # at the span's edges an empty run is none of its own
    assert [len(x) for x in mask.spread_over_runs([run("a"), run("", True), run("bc"), run("", True), run("d")], span)] == [0, 0, 1, 0, 0]


def test_masking_of_odd_rows_and_salted_documents(spark):
    rows = [(1, "Ivan  Petrov and ivan petrov", "x"), (1, None, "x"), (1, "", "x"), (2, "Ivan Petrov", "x"), (None, "Ivan Petrov", "x"), *[(3, f"n{i} key", "y") for i in range(50)]]
    values = [(1, "Ivan Petrov", "[P]", 1), (1, "  ", "[B]", 2), (1, "and", None, 3), (None, "Ivan Petrov", "[N]", 1), (3, "key", "[K]", 1), (9, "unused", "[U]", 1)]
    df, v = spark.createDataFrame(rows, "doc_id long, text string, spans string"), spark.createDataFrame(values, "doc_id long, original_text string, mask string, ord long")
    for salt in (1, 4):
        got = mask.mask_segments(df, v, salt=salt)
        assert sorted((str(r.doc_id), str(r.masked)) for r in got.collect()) == sorted(
            [("1", "[P]  [P]"), ("1", "None"), ("1", ""), ("2", "Ivan Petrov"), ("None", "Ivan Petrov"), *[("3", f"n{i} [K]") for i in range(50)]]
        )
        assert got.columns == ["doc_id", "text", "spans", "fragments", "masked"]
    assert mask.mask_segments(df.limit(0), v).count() == 0 and mask.mask_segments(df, v.limit(0)).filter("not masked <=> text").count() == 0


def test_locating_many_candidates(spark):
    text = "Anna Smith met ANNA\nSMITH; the Smiths"
    found = [(1, "Anna Smith"), (1, "Smith"), (1, "absent"), (2, "Anna Smith")]
    candidates = spark.createDataFrame([(d, c, 0, 0, n, "FIO", 1.0) for n, (d, c) in enumerate(found)], "doc_id long, candidate string, chunk_no int, resp_no int, cand_no int, entity_type string, confidence double")
    docs = spark.createDataFrame([(1, text), (2, None), (3, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.original_text, r.start_pos, r.end_pos, r.hit_no) for r in locate.locate_entities(candidates, docs).collect())
    assert got == [(1, "ANNA\nSMITH", 15, 25, 1), (1, "Anna Smith", 0, 10, 0), (1, "Smith", 5, 10, 0), (1, "Smith", 31, 36, 1)]


def test_ten_thousand_words_and_boxes_on_a_page(spark):
    side = 100
    word = spark.range(side * side).select(
        F.lit(1).alias("doc_id"), F.lit(1).alias("page_no"), F.lit(0).alias("block_no"), (F.col("id") / side).cast("int").alias("line_no"), (F.col("id") % side).cast("int").alias("word_no"),
        F.concat(F.lit("w"), "id").alias("word"), (F.col("id") % side * 10).cast("double").alias("x0"), (F.floor(F.col("id") / side) * 10).cast("double").alias("y0"),
    ).withColumn("x1", F.col("x0") + 8).withColumn("y1", F.col("y0") + 8)
    box = word.filter("word_no % 2 = 0").select("doc_id", "page_no", "x0", "y0", "x1", "y1", F.lit("[M]").alias("mask"), F.col("word_no").alias("rank"))
    box = box.unionByName(box.withColumn("rank", F.col("rank") + 1000).withColumn("mask", F.lit("[later]")))
    began = time.perf_counter()
    text = pages.redact_pages(word, box).first().masked.split(" ")
    assert time.perf_counter() - began < 30
    assert text == ["[M]" if i % 2 == 0 else f"w{i}" for i in range(side * side)]


def test_boxes_at_the_edges_of_a_page(spark):
    word = spark.createDataFrame([(1, 1, 0, 0, i, f"w{i}", float(i), 0.0, float(i) + 1, 1.0) for i in range(9)], "doc_id int, page_no int, block_no int, line_no int, word_no int, word string, x0 double, y0 double, x1 double, y1 double")
    boxes = [(1, 1, -100.0, -100.0, 2.0, 100.0, "[A]", 1), (1, 1, 8.0, 0.0, 1000.0, 1.0, "[B]", 2), (1, 1, 1000.0, 0.0, 2000.0, 1.0, "[C]", 3), (1, 2, 0.0, 0.0, 9.0, 9.0, "[D]", 4)]
    b = spark.createDataFrame(boxes, "doc_id int, page_no int, x0 double, y0 double, x1 double, y1 double, mask string, rank int")
    assert pages.redact_pages(word, b).first().masked == "[A] w2 w3 w4 w5 w6 w7 [B]"
