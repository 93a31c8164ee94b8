"""The conversation trie against plain Python: shared heads, deep and repeated conversations, odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from maskwright.llm import prefix_trie, ranks

SCHEMA = "conv_id long, turn long, role string, text string, n long, depth string, path string"


def conversations(seed=3):
    rnd = random.Random(seed)
    rows = [(None, 0, "user", "nobody's"), (7, None, None, None), (7, 0, "user", "x"), (7, 0, "user", "x"), (-3, 1, "user", "minus"), (300, 0, "a", "bc"), (301, 0, "ab", "c"), (302, 9, "ab", "c")]
    for c in [*range(100, 140), *range(200, 215), 1234, 4000]:
        opening = rnd.choice(["hello", "good day", "日本"])
        rows += [(c, t, ["user", "bot"][t % 2], opening if t == 0 else rnd.choice(["yes", "no", "maybe 😀", ""])) for t in range(rnd.choice([1, 2, 3, 6, 9]))]
    rows += [(c, t, "user", f"{t % 7}") for c in (500, 501, 502) for t in range(75)]  # three alike
    rows += [(c, t, "user", f"{t % 7}" if t < 40 else f"{c}-{t}") for c in (503, 504) for t in range(90)]
    rnd.shuffle(rows)
    return [(*r, 1, "d", "p") for r in rows]


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(x[2], x[3]) for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(convs):
        turns = tuple(convs[c])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
        ends[turns].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return sorted(
        (len(k), v[0], members[k[:-1]][0] if k else -1, len(v), len(children[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, v in members.items()
    )


def got(df):
    return sorted((r.depth, r.conv_id, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(conversations(), SCHEMA).repartition(5)


def test_against_plain_python(table):
    want = brute(rebuilt(conversations()))
    assert max(w[0] for w in want) > 80  # more than two bands and a band of bands are met below
    assert got(prefix_trie.shared_prefixes(table)) == want


@pytest.mark.parametrize("height", [2, 3])
def test_any_height_gives_the_same_totals(table, height):
    turns = prefix_trie.ordered_turns(table)
    own = prefix_trie.Trie(prefix_trie.with_shared_heads(turns), height)
    assert got(prefix_trie.nodes_with_digests(own)) == brute(rebuilt(conversations()))


def test_conversations_as_they_stand(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "b", "x"), (2, 0, "u", "a"), (2, 1, "b", "y"), (3, 0, "u", "a"), (4000, 0, "u", "a"), (9000, 0, "u", "a")]
    turns = prefix_trie.ordered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    trie = prefix_trie.Trie(prefix_trie.as_they_are(turns))
    assert got(prefix_trie.nodes_with_digests(trie)) == brute({1: [("u", "a"), ("b", "x")], 2: [("u", "a"), ("b", "y")], 3: [("u", "a")], 4000: [("u", "a")], 9000: [("u", "a")]})


def test_empty_and_nobodys_rows(table):
    assert prefix_trie.shared_prefixes(table.limit(0)).count() == 0
    assert prefix_trie.shared_prefixes(table.filter("conv_id is null")).count() == 0


def test_long_conversation_crosses_key_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "KEY_BLOCK", 4)
    rows = [(c, t, "u", f"{t}" if t < 30 else f"{c}.{t}") for c in (1, 2) for t in range(60)]
    turns = prefix_trie.ordered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7))
    nodes = prefix_trie.Trie(prefix_trie.as_they_are(turns)).nodes
    assert nodes.count() == 1 + 30 + 2 * 30 and nodes.filter("depth = 0").first().n_leaves == 2


def test_ranks_of_a_group_over_many_ranges(spark):
    df = spark.range(5000).select((F.col("id") % 10 == 0).cast("int").alias("g"), (F.col("id") * 7919 % 5003).alias("x")).repartition(6)
    rows = ranks.ranked(df, "g", ["x"], "r").collect()
    for g in (0, 1):
        own = sorted((r.x, r.r) for r in rows if r.g == g)
        assert [r for _, r in own] == list(range(len(own)))
