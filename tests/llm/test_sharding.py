"""Karmarkar-Karp sharding against the plain method, round numbers, and what must hold for any table."""

import heapq
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from maskwright.llm import sharding

SCHEMA = "doc_id long, text string, size string, shard int, slot int"


def plain(sizes, k):
    """The method with lists of members in place of permutations."""
    heap = [(-s, i, [(s, [i])] + [(0, []) for _ in range(k - 1)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    new = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)), key=lambda x: -x[0])
        heapq.heappush(heap, (both[-1][0] - both[0][0], new, both))
        new += 1
    return [x[0] for x in heap[0][2]]


@pytest.mark.parametrize("n, k", [(1, 4), (2, 2), (5, 2), (7, 3), (60, 5), (300, 40)])
def test_differencing_equals_the_plain_method(n, k):
    sizes = sorted(random.Random(n).choices(range(1, 1000), k=n), reverse=True)
    parts = np.zeros((n, k), dtype=np.int64)
    parts[:, 0] = sizes
    total, where = sharding.differenced(parts)
    assert total.tolist() == plain(sizes, k)
    assert np.bincount(where[:, 0], weights=sizes, minlength=k).tolist() == total.tolist()


def test_textbook_example():
    # 8, 7, 6, 5, 4 in two: differencing leaves a difference of 2
    parts = np.array([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]])
    assert sharding.differenced(parts)[0].tolist() == [16, 14]


def corpus(n=900):
    rnd = random.Random(4)
    texts = [None, None, "", "", "é" * 30, *["boilerplate " * 3] * (n // 30)]
    texts += ["".join(rnd.choices("abc é😀", k=int(rnd.paretovariate(1.2) * 20))) for _ in range(n)]
    ids = [None, None, 5, 5, *range(10, 10 + len(texts) - 4)]
    return [(i, t, "s", 1, 2) for i, t in zip(ids, texts, strict=True)]


def holds(rows, got, shards):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)} and all(0 <= r.shard < shards for r in got)
    by, texts = defaultdict(list), defaultdict(set)
    for r in got:
        by[r.shard].append(r)
        texts[r.text_crc32, r.size].add(r.shard)
    assert all(len(x) == 1 for x in texts.values())
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        ids = [r.doc_id for r in sorted(own, key=lambda r: r.slot)]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    return [sum(r.size for r in by[s]) for s in range(shards)]


@pytest.mark.parametrize("block, factor", [(20_000, 16), (50, 4), (7, 2)])
def test_shards_of_odd_rows(spark, block, factor):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sharding.assign(df, 8, block=block, factor=factor).collect()
    sums = holds(rows, got, 8)
    if block > 8:  # a block of fewer groups than shards evens nothing out
        assert max(sums) - min(sums) <= (16 if block > 1000 else 0.02 * sum(sums) / 8)
    again = sharding.assign(df.repartition(2), 8, block=block, factor=factor).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_large_groups_are_evened_out_by_small_ones_of_other_blocks(spark):
    sizes = [4000, 3000, 900, *[10 + i % 7 for i in range(3000)]]
    groups = spark.createDataFrame([(f"{i:06}".encode(), s) for i, s in enumerate(sizes)], "sha binary, bytes long")
    rows = sharding.balanced(groups, 10, block=100, factor=4).collect()
    sums = [sum(r.bytes for r in rows if r.shard == s) for s in range(10)]
    assert len(rows) == len(sizes) and sum(sums) == sum(sizes) and max(sums) - min(sums) < 100 and max(sums) > 4000


def test_tiers_are_bounded():
    assert sharding.tier_starts(1_000_000, 100, 10) == [10_000, 1_000, 100, 10, 0] and sharding.tier_starts(0, 100, 10) == [0]
    assert sharding._merged([5, 80, 30, 2, 500, 3], 100) == [0, 0, 2, 2, 4, 5]


def test_a_third_of_all_rows_in_one_group(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i} " + "x" * (i % 50), "s", 1, 2) for i in range(600)]
    got = sharding.assign(spark.createDataFrame(rows, SCHEMA), 4).collect()
    holds(rows, got, 4)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a", "s", 1, 2), (2, "bb", "s", 1, 2)], SCHEMA)
    assert len({r.shard for r in sharding.assign(df).collect()}) == 2
    assert sharding.assign(df.limit(0)).count() == 0


def test_written_shards(spark, tmp_path):
    rows = corpus(100)
    df = spark.createDataFrame(rows, SCHEMA)
    sharding.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.drop("_shard").collect())) == sorted(map(str, df.collect()))
    of = {(str(r.doc_id), r.size): r.shard for r in sharding.assign(df, 4).collect()}
    assert all(of[str(r.doc_id), len((r.text or "").encode()) + 16] == r["_shard"] for r in back.collect() if r.doc_id is not None)
