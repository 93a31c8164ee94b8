"""The trie of conversation prefixes, with subtree totals rolled up by bands of depths.

A node is a distinct sequence of first turns (role, text). The work:

1. *Turns* become 128-bit tokens (of SHA-256), and are numbered inside their conversation without
   bringing a conversation to one task (``ranks.ranked``). Texts are read once and never shuffled.
2. *Node keys*: the key of a prefix is the exclusive-or of hashes of (token, place), so that it can be summed up in blocks of
   ``KEY_BLOCK`` turns and carried from block to block: a conversation of any length is many short windows.
3. *Nodes* are a grouped minimum, count and maximum over the keys; equal prefixes combine before the shuffle.
4. *Rollup*: a node's own amounts go to its ancestors inside its band of ``height`` depths only, ``height`` - 1 at most. Then the band
   roots are a trie of their own, ``height`` times as shallow, whose totals are completed in the same way; each completed root is handed to the
   nodes of the band above. So a trie of depth D takes log(D) / log(height) rounds, and no row is multiplied by more than ``height``.

The ancestors of a node are prefixes of its smallest member, which the band's block of that conversation holds.

Rows without a conv_id belong to no conversation and are left out; repeated rows are turns of their own; turns of one number stand in order of
role, then of token. A null turn stands before all others; null roles and texts are empty. Other columns are ignored. Without any conversation there is no node.
Two prefixes with one key (two 64-bit hashes and the depth) would be taken for one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked
from .store import written

KEY_BLOCK = 1024
HEIGHT = 16
#: conversations of so many neighbouring numbers are one row of a node's list
CHUNK_BITS = 12
KEY = ["depth", "hi", "lo"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, token, n_chars, pos): the turns of each conversation, numbered from 0."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.unhex(F.substring(whole, 1, 32)).alias("token"), F.length(text).cast("long").alias("n_chars"),
    )
    return ranked(written(turns, "turns"), "conv_id", ["turn", "role", "token"], "pos").select("conv_id", "token", "n_chars", "pos")


def with_shared_heads(turns: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """(conv_id, depth, token, n_chars, ends): conversation c is rebuilt as the first h turns of conversation c - c % ``every`` (all if
    fewer, none if absent) and its own after its first h; h is crc32(c) % (``most`` + 1).

    ``ends`` marks the last turn. A conversation that has no turn left is one row of depth 0.
    """
    heads = (
        turns.filter(F.expr(f"conv_id % {every} = 0") & (F.col("pos") < most)).groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "token", "n_chars"))).alias("head"))
    )
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("base", F.expr(f"conv_id - conv_id % {every}"))
    kept = (
        convs.join(heads, "base", "left").withColumn("h", h)
        .withColumn("head", F.slice(F.coalesce("head", F.expr("cast(array() as array<struct<pos:bigint,token:binary,n_chars:bigint>>)")), F.lit(1), F.col("h").cast("int")))
        .withColumn("m", F.size("head").cast("long")).select("conv_id", "n", "h", "m", "head")
    )
    kept = written(kept, "heads")
    taken = kept.select("conv_id", "n", "h", "m", F.explode_outer("head").alias("t")).filter((F.col("m") > 0) | (F.col("n") <= F.col("h")))
    first = taken.select(
        "conv_id", F.coalesce(F.col("t.pos") + 1, F.lit(0)).alias("depth"), "t.token", F.coalesce("t.n_chars", F.lit(0)).alias("n_chars"),
        ((F.col("n") <= F.col("h")) & (F.coalesce(F.col("t.pos") + 1, F.lit(0)) == F.col("m"))).alias("ends"),
    )
    own = turns.join(kept.drop("head"), "conv_id").filter("pos >= h").select("conv_id", (F.expr("pos - h + m") + 1).alias("depth"), "token", "n_chars", (F.col("pos") == F.col("n") - 1).alias("ends"))
    return first.unionByName(own)


def as_they_are(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, token, n_chars, ends) of the conversations as they stand."""
    n = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    return turns.join(n, "conv_id").select("conv_id", (F.col("pos") + 1).alias("depth"), "token", "n_chars", (F.col("pos") == F.col("n") - 1).alias("ends"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, hi, lo, p_hi, p_lo, n_chars, ends): the key of each conversation's prefix of each depth, and its parent's."""
    hashes = [F.xxhash64("token", "depth").alias("t_hi"), F.xxhash64(F.lit("second"), "depth", "token").alias("t_lo")]
    rows = turns.select("conv_id", "depth", "n_chars", "ends", F.expr(f"(depth - 1) div {KEY_BLOCK}").alias("block"), *[F.when(F.col("depth") > 0, x).otherwise(0).alias(n) for x, n in zip(hashes, ["t_hi", "t_lo"], strict=True)])
    rows = written(rows, "places")
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.bit_xor(f"t_{x}").over(inside).alias(f"l_{x}") for x in ("hi", "lo")])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(*[F.bit_xor(f"t_{x}").alias(x) for x in ("hi", "lo")])
    carried = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(x).over(earlier), F.lit(0)).alias(f"e_{x}") for x in ("hi", "lo")])
    key = {x: F.col(f"l_{x}").bitwiseXOR(F.col(f"e_{x}")) for x in ("hi", "lo")}
    found = local.join(carried, ["conv_id", "block"]).select(
        "conv_id", "depth", key["hi"].alias("hi"), key["lo"].alias("lo"), key["hi"].bitwiseXOR(F.col("t_hi")).alias("p_hi"), key["lo"].bitwiseXOR(F.col("t_lo")).alias("p_lo"), "n_chars", "ends",
    )
    return written(found, "prefixes")


def _paths(places: DataFrame, height: int) -> DataFrame:
    """(conv_id, band, path): the keys of a conversation's places of one band in order of depth, ``height`` at most."""
    entry = F.struct("depth", "hi", "lo")
    return places.groupBy("conv_id", F.expr(f"depth div {height}").alias("band")).agg(F.sort_array(F.collect_list(entry)).alias("path"))


def _summed(given: DataFrame, amounts: list[str]) -> DataFrame:
    """given: (path, amounts). Each row's amounts go to all nodes of its path; their sums by node."""
    spread_out = given.select(F.explode("path").alias("a"), *amounts)
    return spread_out.groupBy(*[F.col(f"a.{k}").alias(k) for k in KEY]).agg(*[F.sum(x).alias(f"{x}_in") for x in amounts])


def _added(nodes: DataFrame, more: DataFrame, amounts: list[str]) -> DataFrame:
    rest = [c for c in nodes.columns if c not in KEY and c not in amounts]
    return nodes.join(more, KEY, "left").select(*KEY, *rest, *[(F.col(x) + F.coalesce(f"{x}_in", F.lit(0))).alias(x) for x in amounts])


def subtree_totals(nodes: DataFrame, places: DataFrame, amounts: list[str], height: int = HEIGHT) -> DataFrame:
    """nodes: (depth, hi, lo, conv_id, amounts), the smallest member in ``conv_id``; places: (conv_id, depth, hi, lo), every place of every conversation but the
    root's. ``nodes`` with each amount summed over the node's subtree."""
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None or deepest == 0:
        return nodes
    root = F.array(F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo")))
    paths = _paths(places, height).withColumn("path", F.when(F.col("band") == 0, F.concat(root, "path")).otherwise(F.col("path")))
    above = nodes.filter("depth > 0").select("conv_id", F.expr(f"depth div {height}").alias("band"), F.expr(f"cast(depth % {height} as int)").alias("k"), *amounts)
    inner = above.filter("k > 0").join(paths, ["conv_id", "band"]).select(F.slice("path", F.lit(1), F.col("k")).alias("path"), *amounts)
    part = written(_added(nodes, _summed(inner, amounts), amounts), "banded")
    if deepest < height:
        return part
    rooted = lambda df: df.filter(f"depth % {height} = 0").withColumn("depth", F.expr(f"depth div {height}"))
    whole = subtree_totals(rooted(part), rooted(places), amounts, height)
    handed = whole.filter("depth > 0").select("conv_id", (F.col("depth") - 1).alias("band"), *amounts).join(paths, ["conv_id", "band"]).select("path", *amounts)
    return written(_added(part, _summed(handed, amounts), amounts), "rolled")


class Trie:
    """nodes: (depth, hi, lo, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens); ends: (depth, hi, lo, conv_id), the conversations that end at a node."""

    def __init__(self, turns: DataFrame, height: int = HEIGHT):
        """turns: (conv_id, depth, token, n_chars, ends) as ``with_shared_heads`` and ``as_they_are`` give them."""
        rows = prefixes(turns)
        places, zero = rows.filter("depth > 0"), F.lit(0).cast("long")
        found = places.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_chars").alias("n_chars"), F.max("p_hi").alias("p_hi"), F.max("p_lo").alias("p_lo"))
        # of each conversation one place is its first or only one
        starts = rows.filter("depth <= 1")
        root = starts.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
        top = root.select(zero.alias("depth"), zero.alias("hi"), zero.alias("lo"), "conv_id", "n_convs", zero.alias("n_chars"), zero.alias("p_hi"), zero.alias("p_lo"))
        nodes = written(found.unionByName(top), "nodes")
        children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p_hi").alias("hi"), F.col("p_lo").alias("lo")).agg(F.count("*").alias("n_children"))
        nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        nodes = written(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("n_chars")), "own")
        totals = subtree_totals(nodes.drop("n_chars"), places.select("conv_id", *KEY), ["n_leaves", "saved_tokens"], height)
        parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("p_hi"), F.col("lo").alias("p_lo"), F.col("conv_id").alias("parent_conv_id"))
        self.nodes = totals.join(parents, ["depth", "p_hi", "p_lo"], "left").select(*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
        self.ends = rows.filter("ends").select(*KEY, "conv_id")


def id_digests(ends: DataFrame) -> DataFrame:
    """(depth, hi, lo, ends_sha256): SHA-256 of each node's conv_ids as decimals, ascending, joined by commas.

    Neighbouring numbers are joined to rows of text before the shuffle; a digest is one run over its
    node's rows, which stream through the task and are never held together.
    """
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))
    chunks = ends.groupBy(*KEY, F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.array_join(ids, ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None

        def row(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip([*KEY, "ends_sha256"], [*k, s], strict=True)) for k, s in done], schema=pa.schema([*[(c, pa.int64()) for c in KEY], ("ends_sha256", pa.string())]))

        for batch in batches:
            done = []
            for d, hi, lo, ids in zip(*[batch.column(c).to_pylist() for c in [*KEY, "ids"]], strict=True):
                if (d, hi, lo) != key:
                    if key is not None:
                        done.append((key, sha.hexdigest()))
                    key, sha = (d, hi, lo), hashlib.sha256(ids.encode())
                else:
                    sha.update(b",")
                    sha.update(ids.encode())
            yield row(done)
        if key is not None:
            yield row([(key, sha.hexdigest())])

    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").mapInArrow(digest, "depth long, hi long, lo long, ends_sha256 string")


def nodes_with_digests(trie: Trie) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node."""
    none: Column = F.lit(hashlib.sha256(b"").hexdigest())
    met = trie.nodes.join(id_digests(trie.ends), KEY, "left")
    return met.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def shared_prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` rebuilt with the shared heads of their hundreds."""
    return nodes_with_digests(Trie(with_shared_heads(ordered_turns(conversations))))
