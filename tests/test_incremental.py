"""What must hold over several runs: answers asked once, folders that a batch doesn't touch, batches that are repeated, numbers of a stem of very many files."""

import os
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from maskwright.operators import answers, history, ranks, reports
from maskwright.operators.history_store import HistoryStore
from maskwright.sources import io
from maskwright.streaming import incremental

REQUESTS = "doc_id long, chunk_no int, prompt string"


def logging_model(folder, failing=()):
    """Each call leaves a file for each prompt; prompts of ``failing`` raise."""

    def model(prompts: pd.Series) -> pd.Series:
        import uuid

        for p in prompts:
            if p in failing:
                raise ValueError(f"no {p}")
        for p in prompts:
            open(f"{folder}/{p}-{uuid.uuid4().hex}", "w").close()
        return "answer to " + prompts

    return model


def asked(folder):
    return Counter(x.split("-")[0] for x in os.listdir(folder))


def test_answers_are_asked_once(spark, tmp_path):
    rows = [(i, 0, f"p{i % 7}") for i in range(50)] + [(99, 0, None)]
    requests = spark.createDataFrame(rows, REQUESTS).repartition(4)
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    first = answers.answer_with_store(requests, logging_model(str(calls), {"p3"}), store, waves=3, attempts=2, pause=0.01)
    got = {r.doc_id: (r.raw, r.error) for r in first.collect()}
    assert len(got) == 51 and got[0] == ("answer to p0", None) and got[3] == (None, "ValueError: no p3") and got[99] == (None, None)
    assert asked(calls) == {f"p{i}": 1 for i in range(7) if i != 3}
    # the next run asks what failed and what is new, and nothing else
    more = requests.unionByName(spark.createDataFrame([(100, 0, "p8")], REQUESTS))
    second = answers.answer_with_store(more, logging_model(str(calls)), store, waves=3)
    assert {r.raw for r in second.collect()} == {*(f"answer to p{i}" for i in (0, 1, 2, 3, 4, 5, 6, 8)), None}
    assert asked(calls) == {f"p{i}": 1 for i in (0, 1, 2, 3, 4, 5, 6, 8)}
    third = answers.answer_with_store(more, logging_model(str(calls), {f"p{i}" for i in range(9)}), store)
    assert third.filter("raw is null").count() == 1 and sum(asked(calls).values()) == 8


def test_a_killed_run_keeps_its_waves(spark, tmp_path, monkeypatch):
    requests = spark.createDataFrame([(i, 0, f"p{i}") for i in range(40)], REQUESTS)
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    real, seen = answers.asked_with_patience, []

    def dies(*args):
        if len(seen) == 2:
            raise KeyboardInterrupt
        seen.append(1)
        return real(*args)

    monkeypatch.setattr(answers, "asked_with_patience", dies)
    with pytest.raises(KeyboardInterrupt):
        answers.answer_with_store(requests, logging_model(str(calls)), store, waves=4)
    monkeypatch.undo()
    assert 0 < sum(asked(calls).values()) < 40
    done = answers.answer_with_store(requests, logging_model(str(calls)), store, waves=4)
    assert done.filter("raw is null").count() == 0 and set(asked(calls).values()) == {1}


def test_history_folders(spark, tmp_path):
    path = str(tmp_path / "history")
    store = HistoryStore(spark, path, "seq long, source_file string, masked string", buckets=64)
    assert store.rows().count() == 0 and store.upsert(store.rows()) == []
    make = lambda ids, seq: spark.createDataFrame([(seq + i, f"/Data/{i}.docx" if seq else f"/data/{i}.DOCX", f"m{seq}") for i in ids], "seq long, source_file string, masked string")
    store.upsert(make(range(500), 0))
    before = {x: os.stat(os.path.join(d, x)).st_mtime_ns for d, _, names in os.walk(path) for x in names if x.startswith("part")}
    written = store.upsert(make([*range(8), 1000, 1001], 10_000))
    after = {x for d, _, names in os.walk(path) for x in names if x.startswith("part")}
    assert len(written) <= 10 and len(set(before) - after) <= 10
    rows = {r.source_file: (r.seq, r.masked) for r in store.rows().collect()}
    assert len(rows) == 502 and rows["/Data/3.docx"] == (10_003, "m10000") and rows["/data/9.DOCX"] == (9, "m0")
    store.upsert(make(range(8), 10_000))  # once more changes nothing
    assert {r.source_file: (r.seq, r.masked) for r in store.rows().collect()} == rows
    ask = spark.createDataFrame([("/DATA/3.docx",), ("/data/new.docx",)], "source_file string")
    assert [r.source_file for r in store.new_sources(ask).collect()] == ["/data/new.docx"] and store.new_sources(ask, force=True).count() == 2
    plan = store.rows(store.touched(ask))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:80]
    store.remove(ask)
    assert store.rows().count() == 501
    store.remove(store.rows())
    assert store.rows().count() == 0


def test_a_repeated_batch_has_no_second_row(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, masked string")
    write = incremental.batch_writer(str(tmp_path / "out"), "cp", lambda df: df)
    for number in (0, 1, 1):
        write(rows, number)
    incremental.batch_writer(str(tmp_path / "out"), "another", lambda df: df)(rows, 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_sources_on_a_stream(spark, tmp_path):
    schema = "seq long, source_file string"
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    known = spark.createDataFrame([(0, "/A/Old.docx")], schema)
    for batch in ([(1, "/a/old.DOCX"), (2, "/a/x.docx"), (3, "/A/X.docx")], [(4, "/a/X.DOCX"), (5, "/a/y.docx")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        incremental.sources_stream(spark, source, schema, out, cp, known).awaitTermination()
    assert sorted(r.source_file.lower() for r in spark.read.parquet(out).collect()) == ["/a/x.docx", "/a/y.docx"]


def test_numbers_of_a_stem(spark):
    sources = spark.createDataFrame([(i, f"/d{i}/a.docx") for i in range(300)] + [(300, "/q/b"), (301, "/q/b"), (302, None), (303, "/q/a.pdf")], "seq long, source_file string").repartition(5)
    names = ["a_masked.docx", "a_masked_v1.docx", "a_masked_v02.docx", "a_masked_v3.docx", "a_masked_v3.docx", "a_masked_v5.docx", "a_masked_v250.docx", "b_masked", "other_masked.docx", "a_masked_v99999999999999999999.docx", None]
    got = {r.seq: r.masked_name for r in history.versioned_names(sources, spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    free = [v for v in range(1, 400) if v not in (1, 3, 5, 250)]
    assert [got[i] for i in range(300)] == [f"a_masked_v{v}.docx" for v in free[:300]]
    assert got[300] == "b_masked_v2" and got[301] == "b_masked_v3" and got[303] == "a_masked.pdf" and 302 not in got


def test_ranks_of_one_group_over_many_tasks(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g"), (F.col("id") * 7919 % 20011).alias("x")).repartition(6)
    out = ranks.ranked(df, "g", ["x"], "r", partitions=8)
    rows = out.collect()
    for g in "ab":
        own = sorted((r.x, r.r) for r in rows if r.g == g)
        assert [r for _, r in own] == list(range(len(own)))
    assert ranks.ranked(df.limit(0), "g", ["x"], "r").count() == 0


def test_sketches_of_parts_are_those_of_the_whole(spark):
    rows = spark.range(200_000).select((F.col("id") % 50_021).alias("doc_id"), F.concat(F.lit("v"), F.col("id") % 30_011).alias("original_text"), (F.col("id") % 3).cast("string").alias("entity_type"), (F.col("id") % 7).alias("day"))
    docs = rows.select("doc_id", F.lit("docx").alias("file_type")).distinct()
    by = ("entity_type",)
    whole = reports.estimated_summary(reports.summary_sketches(rows, docs, by)).orderBy("entity_type").collect()
    parts = reports.summary_sketches(rows, docs, ("day", "entity_type"))
    merged = reports.estimated_summary(reports.merged_sketches(parts, by)).orderBy("entity_type").collect()
    exact = rows.groupBy("entity_type").agg(F.count("*").alias("n"), F.count_distinct("original_text").alias("t"), F.count_distinct("doc_id").alias("d")).orderBy("entity_type").collect()
    for w, m, e in zip(whole, merged, exact, strict=True):
        assert w.n_spans == m.n_spans == e.n
        for x in (w, m):
            assert abs(x.n_texts - e.t) < 0.04 * e.t and abs(x.n_docs - e.d) < 0.04 * e.d
    none = rows.limit(0)
    assert reports.estimated_summary(reports.merged_sketches(reports.summary_sketches(none, docs, by), by)).count() == 0


def test_a_repeated_run_of_the_sinks_has_no_second_row(spark, tmp_path):
    masked = spark.createDataFrame([(1, "a", "docx"), (2, "b", "pdf")], "doc_id long, masked string, file_type string")
    reports_ = spark.createDataFrame([("{}",), ("{}",)], "report string")
    for run in ("r1", "r1", "r2"):
        io.write_masked(masked, f"{tmp_path}/m", run=run)
        io.write_json_reports(reports_, f"{tmp_path}/j", run=run)
        io.write_txt_reports(reports_, f"{tmp_path}/t", run=run)
    assert spark.read.parquet(f"{tmp_path}/m").count() == 4 and spark.read.text(f"{tmp_path}/j").count() == 4
    assert spark.read.text(f"{tmp_path}/t", lineSep="\n\n").count() == 4
