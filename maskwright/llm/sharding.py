"""Shards of near equal bytes by Karmarkar-Karp differencing.

Equal texts are one group and stay on one shard. A *partial partition* is one sum for each shard, largest first; a single group is
(its bytes, 0, ... 0). Differencing takes the two partial partitions of the largest spread (largest sum less smallest) and adds them in opposite order, largest to
smallest, until one is left: what is uneven in one evens out the other. The work:

1. Sizes, checksums and digests of all texts go to a small table; groups are sums over the digest, combined before the shuffle.
2. Groups fall into *tiers* by size: those of a ``block``-th of all bytes or more (``block`` groups at most, whatever the input), then those
   of a ``FACTOR``-th of that, and so on. Tiers that are small together are one.
3. The first tier is differenced in one task. A later tier is dealt out by digest to blocks of about ``block`` groups, each a task of its own; a block gets, besides its groups, an
   equal share of what the shards hold so far as one more partial partition, so that its groups even out what larger ones left uneven, and its places are shards.
   The shards' sums after a tier are the next one's start: ``shards`` numbers are all that the driver sees. Of the last tier one block waits for the others' sums.

So tasks have bounded work, there are as many rounds as tiers (six for 10**11 groups), and what stays uneven is what the smallest groups leave. An input of up to
``block`` groups is one plain run of the method. ``block`` should be many times ``shards``.

Rows without text have no bytes and are in the group of empty texts. Every row counts ``overhead`` bytes besides its text. Of sums alike the order is fixed by the digest, so that
the shards depend on the texts alone. Slots number a shard's rows from 0 in order of doc_id, nulls first, then of digest, without bringing a shard to one task.
Null, repeated doc_ids are rows of their own; other columns are ignored by ``assign`` and kept by ``write_shards``. A group above a shard's even part can't be divided, and makes its shard the largest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import ranked
from .store import written

BLOCK, FACTOR, OVERHEAD = 20_000, 16, 16


def differenced(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """parts: a partial partition a row, each in falling order. The one partition they make, in falling order, and for each part where its sums went."""
    n, k = parts.shape
    if n == 1:
        return parts[0].copy(), np.arange(k)[None]
    sums = np.zeros((2 * n - 1, k), dtype=np.int64)
    sums[:n] = parts
    made: list[tuple[int, int, np.ndarray]] = []
    heap = [(-int(s), i) for i, s in enumerate(parts[:, 0] - parts[:, -1])]
    heapq.heapify(heap)
    new = n
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        at = np.empty(k, dtype=np.int64)
        at[order] = np.arange(k)
        sums[new] = both[order]
        heapq.heappush(heap, (int(sums[new][-1] - sums[new][0]), new))
        made.append((a, b, at))
        new += 1
    where = np.zeros((2 * n - 1, k), dtype=np.int64)
    where[-1] = np.arange(k)
    for i in range(len(made) - 1, -1, -1):
        a, b, at = made[i]
        where[a] = where[n + i][at]
        where[b] = where[a][::-1]
    return sums[-1], where[:n]


def sized(docs: DataFrame, overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, size, text_crc32, sha) of each row; size in UTF-8 bytes with ``overhead``."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("sha"))


def tier_starts(total: int, block: int, factor: int) -> list[int]:
    """The least bytes of a group of each tier; the last is 0."""
    starts, least = [], max(1, -(-total // block))
    while least > 1:
        starts.append(least)
        least //= factor
    return [*starts, 0]


def _merged(counts: list[int], block: int) -> list[int]:
    """The tier that each tier is merged into: neighbours of ``block`` groups together are one."""
    to, own = [], 0
    for i, n in enumerate(counts):
        if i and own + n > block:
            own = 0
            to.append(i)
        else:
            to.append(to[-1] if to else 0)
        own += n
    return to


def _round(groups: DataFrame, n: int, held: list[int], block: int) -> DataFrame:
    """groups: (sha, bytes), ``n`` of them; held: bytes of each shard so far. (sha, bytes, shard)."""
    shards, blocks = len(held), max(1, -(-n // block))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "sha"], ascending=[False, True], ignore_index=True)
        share = np.array([h * (key[0] + 1) // blocks - h * key[0] // blocks for h in held], dtype=np.int64)
        order = np.argsort(-share, kind="stable")
        parts = np.zeros((len(frame) + 1, shards), dtype=np.int64)
        parts[0], parts[1:, 0] = share[order], frame["bytes"]
        where = differenced(parts)[1]
        shard_of = np.empty(shards, dtype=np.int32)
        shard_of[where[0]] = order
        return pd.DataFrame({"sha": frame["sha"], "bytes": frame["bytes"], "shard": shard_of[where[1:, 0]]})

    dealt = groups.select("sha", "bytes", F.pmod(F.xxhash64("sha"), F.lit(blocks)).alias("part"))
    return written(dealt.groupBy("part").applyInPandas(run, "sha binary, bytes long, shard int"), "tier")


def balanced(groups: DataFrame, shards: int = 40, block: int = BLOCK, factor: int = FACTOR) -> DataFrame:
    """groups: (sha, bytes), stored, one row a group. (sha, bytes, shard)."""
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    starts = tier_starts(total, block, factor)
    tier = F.lit(len(starts) - 1)
    for i in range(len(starts) - 2, -1, -1):
        tier = F.when(F.col("bytes") >= starts[i], i).otherwise(tier)
    found = {r.tier: r.n for r in groups.groupBy(tier.alias("tier")).agg(F.count("*").alias("n")).collect()}
    counts = [found.get(i, 0) for i in range(len(starts))]
    to = _merged(counts, block)
    held, out = [0] * shards, None
    for i in sorted(set(to)):
        members = [t for t, x in enumerate(to) if x == i]
        n = sum(counts[t] for t in members)
        own, blocks = groups.filter(tier.between(min(members), max(members))), -(-n // block)
        rounds = [(own, n)] if n or i == 0 else []
        if blocks > 1 and not sum(counts[max(members) + 1 :]):  # a block of the smallest comes after the others and evens out what they leave together
            late = F.pmod(F.xxhash64("sha", F.lit(1)), F.lit(blocks)) == 0
            rounds = [(own.filter(~late), n - n // blocks), (own.filter(late), n // blocks)]
        for some, n in rounds:
            part = _round(some, n, held, block)
            sums = {r.shard: r.s for r in part.groupBy("shard").agg(F.sum("bytes").alias("s")).collect()}
            held = [h + sums.get(j, 0) for j, h in enumerate(held)]
            out = part if out is None else out.unionByName(part)
    return out


def assign(docs: DataFrame, shards: int = 40, overhead: int = OVERHEAD, block: int = BLOCK, factor: int = FACTOR) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: a row for each row of ``docs``; law is ``bytes``, grown_shard null."""
    rows = written(sized(docs, overhead), "sized")
    groups = written(rows.groupBy("sha").agg(F.sum("size").alias("bytes")), "groups")
    met = written(rows.join(balanced(groups, shards, block, factor).drop("bytes"), "sha").select("doc_id", "size", "text_crc32", "shard", "sha"), "sharded")
    return ranked(met, "shard", ["doc_id", "sha"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, files: int = 4, **options) -> None:
    """All columns of ``docs`` as Parquet under ``path``/_shard=<number>, ``files`` tasks a shard."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("_sha", F.unhex(F.sha2(text, 256)))
    groups = written(rows.groupBy("_sha").agg(F.sum(F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("bytes")).withColumnRenamed("_sha", "sha"), "groups")
    placed = balanced(groups, shards, **options).select(F.col("sha").alias("_sha"), F.col("shard").alias("_shard"))
    met = rows.join(placed, "_sha").drop("_sha")
    met.repartition(shards * files, "_shard", F.pmod(F.monotonically_increasing_id(), F.lit(files))).write.partitionBy("_shard").mode("overwrite").parquet(path)
