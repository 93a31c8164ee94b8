"""What plans must not do at size: compute an expression twice, leave a costly derivation in one task."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from maskwright.functions.text import spans
from maskwright.operators import chunks as C
from maskwright.operators import locate as L
from maskwright.operators import mask as M
from maskwright.operators import responses as P
from maskwright.operators.assemble import assemble_sheet_text
from maskwright.operators.meeting import plain, small
from maskwright.operators.pages import left_words
from maskwright.plans.deidentify import deidentify
from maskwright.plans.fixtures import load


def test_detection_is_computed_once(spark):
    found = L.detect_structured(spark.createDataFrame([(1, "a@b.com")], "doc_id long, text string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 4  # one for each pattern


def test_clarifications_are_read_once(spark):
    said = spark.createDataFrame([(1, 1, 'so {"a":"x","b":"y","a":"z"}')], "doc_id long, question_no int, raw string")
    plan = P.parse_clarifications(said)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("from_json(") == 1  # a filter below the explosion did all of it before


def test_refused_answers_pass_python_once(spark):
    said = spark.createDataFrame([(1, 0, '{"entities":[{"original_text":"a b","entity_type":"T",}]}')], "doc_id long, chunk_no int, raw string")
    candidates = P.entity_candidates(P.explode_entities(P.parse_responses(said)))
    assert candidates._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_pieces_by_python_equal_those_by_built_ins(spark):
    random.seed(3)
    texts = ["".join(random.choices('{{}}""\\ab', k=random.randrange(40))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", P.balanced_objects(F.col("t")).alias("p")).collect()
    assert {r.i: list(r.p) for r in rows} == {i: list(P.balanced_pieces(t)) for i, t in enumerate(texts)}


def test_values_are_located_once_beside_the_detector(spark):
    docs = spark.createDataFrame([(1, "a@b.com and c@d.com"), (None, "e@f.com")], "doc_id long, text string")
    said = spark.createDataFrame([(1, 0, '{"entities":[{"original_text":"a@b.com","entity_type":"MAIL"}]}')], "doc_id long, chunk_no int, raw string")
    entities = deidentify(docs, said).entities
    assert sorted((r.original_text, r.masked_text) for r in entities.collect()) == [("a@b.com", "[MAIL_REDACTED]"), ("c@d.com", "[EMAIL_REDACTED]"), ("e@f.com", "[EMAIL_REDACTED]")]
    assert entities._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_masked_cells_of_a_sheet_are_made_once(spark):
    rows = [(1, "a", 2, 1, " Ivan ", False), (1, "a", 1, 2, "x", False), (1, "a", 1, 1, "y", False), (1, "a", 3, 1, " ", False), (1, "b", 1, 1, None, False), (2, None, 1, 1, "z", False)]
    cells = spark.createDataFrame(rows, "doc_id long, sheet string, row_no long, col_no int, value string, is_formula boolean")
    values = spark.createDataFrame([(1, "ivan", "[M]", 1)], "doc_id long, original_text string, mask string, ord long")
    texts = assemble_sheet_text(M.mask_cells(cells, values).withColumn("value", F.col("masked")))
    assert sorted(map(tuple, texts.collect()), key=str) == [(1, "a", "y | x\n[M]"), (1, "b", ""), (2, None, "")]
    assert texts._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_chunks_are_collapsed_once(spark):
    chunks = C.filter_short_chunks(spark.createDataFrame([(1, 0, " a  b " * 10), (1, 1, "  c  ")], "doc_id long, chunk_no int, chunk string"))
    assert [r.chunk for r in chunks.collect()] == [" ".join(["a b"] * 10)]
    assert chunks._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 2


def test_rows_of_one_row_group_become_many_tasks(spark, tmp_path):
    one = spark.range(100).select(F.col("id").alias("c_custkey"), F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("c_name"))
    one.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert L.detect_structured(load(spark, str(tmp_path), "contracts")).rdd.getNumPartitions() >= 8


def test_spans_of_texts_with_none_few_and_many_matches(spark):
    rows = spark.createDataFrame([(0, None), (1, ""), (2, "x"), (3, "a" * 16), (4, "xa" * 17), (5, "xxa" * 100)], "i int, t string")
    got = {r.i: [(s.start, s.end) for s in r.s] for r in rows.select("i", spans(F.col("t"), F.lit("a")).alias("s")).collect()}
    assert got == {0: [], 1: [], 2: [], 3: [(i, i + 1) for i in range(16)], 4: [(2 * i + 1, 2 * i + 2) for i in range(17)], 5: [(3 * i + 2, 3 * i + 3) for i in range(100)]}


def test_long_texts_come_in_small_pieces():
    batch = pa.RecordBatch.from_pydict({"t": ["x" * 100_000] * 200})
    pieces = list(small(iter([batch]), 1 << 20))
    assert sum(p.num_rows for p in pieces) == 200 and max(p.num_rows for p in pieces) <= 11


def test_plain_values_equal_those_of_arrow():
    item = pa.struct([("start", pa.int32()), ("mask", pa.string())])
    arrays = [
        pa.array([1, None, -(2**63)], pa.int64()), pa.array([1, 2], pa.int32()), pa.array([1.5, None, float("inf")]), pa.array(["a", None, "", "😀"]), pa.array([True, None, False]), pa.array([True]),
        pa.array([[{"start": 1, "mask": None}, None], None, [], [{"start": None, "mask": "m"}]], pa.list_(item)), pa.array([{"start": 1, "mask": "a"}, None, {"start": None, "mask": "b"}], item),
        pa.array([["a", None], None, []]), pa.array([None, None], pa.null()), pa.array([b"a", None]), pa.array([], pa.list_(item)),
    ]
    for a in arrays:
        for part in (a, a[1:], a[:1], a[1:2]):
            assert plain(part) == part.to_pylist() and list(map(type, plain(part))) == list(map(type, part.to_pylist()))


def test_cells_are_masked_without_the_spans_none_asks_for(spark):
    rows = [(1, 1, " Ivan  x ", False), (1, 2, "a Ivan\nx", True), (1, 3, "=Ivan", False), (1, 4, None, False), (1, 5, "ivan ivan x", None), (2, 1, "Ivan", False), (None, 1, "Ivan", False), (1, 6, "", False)]
    cells = spark.createDataFrame(rows, "doc_id long, row_no int, value string, is_formula boolean")
    values = spark.createDataFrame([(1, " Ivan x", "[M]", 1), (1, "ivan", None, 2)], "doc_id long, original_text string, mask string, ord long")
    few, every = (M.mask_cells(cells, values, salt=2, spans=x) for x in (False, True))
    assert few.columns == ["doc_id", "row_no", "value", "is_formula", "masked", "modified"] and set(every.columns) - set(few.columns) == {"spans", "fragments"}
    got = sorted(map(tuple, few.collect()), key=str)
    assert got == sorted(map(tuple, every.select(*few.columns).collect()), key=str)
    assert {r[1]: r[4] for r in got if r[0] == 1} == {1: " [M] ", 2: "a Ivan\nx", 3: "=Ivan", 4: None, 5: " [M]", 6: ""}
    assert [r[4:] for r in got if r[0] != 1] == [("Ivan", False)] * 2


def test_a_documents_values_last_over_pieces(spark):
    segments = spark.createDataFrame([(1, i, "Ivan " + "x" * 300_000) for i in range(60)], "doc_id long, n int, text string")
    values = spark.createDataFrame([(1, "ivan", "[M]", 1)], "doc_id long, original_text string, mask string, ord long")
    masked = M.mask_segments(segments, values).filter("masked like '[M] x%' and length(masked) = 300004")
    assert masked.count() == 60


def test_words_left_of_a_page_equal_those_by_brute_force():
    rnd = random.Random(7)
    for _ in range(200):
        words = [{"block_no": 1, "line_no": i // 5, "word_no": i % 5, "word": f"w{i}", "mx": rnd.choice([None, rnd.random() * 100]), "my": rnd.random() * 100} for i in range(rnd.randrange(1, 60))]
        boxes = []
        for n in range(rnd.randrange(5)):
            a, b = rnd.random() * 100, rnd.random() * 100
            boxes.append({"rank": n, "a": a, "b": b, "c": a + rnd.choice([0, 40, float("inf")]), "d": b + 40, "mask": f"[{n}]"})
        wanted, seen = [], set()
        for w in words:
            over = [b for b in boxes if w["mx"] is not None and b["a"] <= w["mx"] <= b["c"] and b["b"] <= w["my"] <= b["d"]]
            if not over:
                wanted.append(w["word"])
            elif over[0]["rank"] not in seen:
                seen.add(over[0]["rank"])
                wanted.append(over[0]["mask"])
        assert left_words(words, boxes) == wanted
