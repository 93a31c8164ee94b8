r"""Near-duplicate groups by MinHash with tensored banding.

A document's set holds its distinct shingles of ``size`` words (64-bit hashes of
words ``[^\x20\x09-\x0D]+``, A-Z lower-cased). Tensoring: two collections of ``m``
half keys, each of ``k`` minhashes, give ``m * m`` tables whose key is a pair
(half key i of the first, half key j of the second). So 2*m*k minhashes serve m*m
tables of 2*k-minhash keys, about the square root of what separate tables need. With m = 12
and k = 3 two sets at similarity 0.8 share a table with probability 0.9996, more above.

1. Rows with one set (128 bits of all its hashes) are one class; its first row by (doc_id, hash
   of the text), null doc_ids last, stands for it. Only representatives go on, numbered in that order.
2. Half keys that are alone in their collection are dropped (a grouped count
   per half key); table keys are made of the others only.
3. In each table, members are paired with three leaders: the smallest member, the largest, and
   the one whose half keys most others have, the likely centre of a group of variants
   (grouped min and max, combined before the shuffle). A bucket of n gives 3n pairs, never n*n.
4. Pairs are checked on the full sets: 100 * shared >= similarity% * union.
5. Links give components by iterated minimum labels; the smallest row names each.
6. Buckets of over three members (up to three, the leaders are all pairs) that lie in
   more than one component are open. All members of open buckets go through an exact
   join: two sets of a and b hashes that share s of them have a common one among the
   first a - s + 1 and b - s + 1, rarest first (prefix and length filter, hot hashes
   salted). Pairs of one component are settled. The links found join the components.

So two members of one bucket that are alike are always in one component, whoever led.

Null, empty and blank texts have an empty set and are linked with nothing; fewer
words than ``size`` give one shingle. Rows of one doc_id are told by their texts, so different
texts have components of their own. Rows with the component's doc_id count as kept. A null doc_id
names no component: its row belongs to its component's smallest doc_id, and has a null
component and is kept if there is none. :func:`keep_one` goes by rows: of each group exactly one
stays, of repeated rows too. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import drop, stored, written

M, K = 12, 3
_SALT = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, size=2 * M * K, dtype=np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct hashes of all rows, their ends by row)."""
    for a, b, buf, offs in W.slices(column, 2 << 20):
        low = W.LOWER[buf]
        s, e, first = W.spans(low, offs, W.NON_SPACE)
        word = W.mix(W.keys(low, s, e))
        n = np.diff(first)
        row = np.repeat(np.arange(b - a), n)
        hashes, rows = [], []
        wide = len(word) - size + 1
        if wide > 0:
            value = word[:wide]
            for k in range(1, size):
                value = W.mix(value) + word[k : k + wide]
            whole = row[:wide] == row[size - 1 :]
            hashes.append(W.mix(value[whole]))
            rows.append(row[:wide][whole])
        for r in np.flatnonzero((n > 0) & (n < size)).tolist():
            value = word[first[r]][None]
            for k in range(first[r] + 1, first[r + 1]):
                value = W.mix(value) + word[k]
            hashes.append(W.mix(value + np.uint64(n[r])))
            rows.append(np.array([r]))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        r = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        bounds = np.searchsorted(r[np.argsort(r, kind="stable")], np.arange(b - a + 1)) if len(hashes) > 1 else np.searchsorted(r, np.arange(b - a + 1))
        if len(hashes) > 1:
            h = h[np.argsort(r, kind="stable")]
        sets = [np.unique(h[x:y]) for x, y in zip(bounds[:-1], bounds[1:])]
        yield a, (np.concatenate(sets) if sets else h), np.cumsum([len(x) for x in sets])


def row_key() -> Column:
    """What tells a row, in the order that chooses representatives and names components."""
    return F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "mark")


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, mark, n_shingles, print, half): a hash of the text, the set's size, its 128-bit print
    and the 2*m half keys (null for an empty set)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, values, ends in shingle_sets(batch.column(2), size):
                starts = np.r_[0, ends[:-1]]
                n = ends - starts
                full = np.flatnonzero(n > 0)
                half = np.zeros((len(full), 2 * M), np.uint64)
                prints = np.zeros((len(full), 2), np.uint64)
                if len(full):
                    at = starts[full]
                    prints[:, 0] = np.add.reduceat(W.mix(values * np.uint64(0x9FB21C651E98DF25)), at)
                    prints[:, 1] = np.add.reduceat(W.mix(values ^ np.uint64(0x5851F42D4C957F2D)), at)
                    for i in range(2 * M):
                        for k in range(K):
                            h = values * _SALT[i * K + k]
                            low = np.minimum.reduceat(h ^ (h >> np.uint64(31)), at)
                            half[:, i] = W.mix(half[:, i] + low)
                mask = n == 0
                where = np.full(len(n), -1)
                where[full] = np.arange(len(full))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(half.view(np.int64).ravel()), 2 * M).cast(pa.list_(pa.int64()))
                prints = pa.array([x.tobytes() for x in prints], pa.binary())
                pick = pa.array(where, mask=mask)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(n)), batch.column(1).slice(a, len(n)), pa.array(n.astype(np.int64)), prints.take(pick), lists.take(pick)],
                    names=["doc_id", "mark", "n_shingles", "print", "half"],
                )

    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    return written(rows.mapInArrow(run, f"doc_id {kind}, mark long, n_shingles long, print binary, half array<long>"), "sketches")


def shared_buckets(reps: DataFrame) -> DataFrame:
    """(key, rep, weight) of the tables' keys that two or more representatives have. The weight
    tells how many others have the representative's half keys."""
    # a half key can only matter if another representative has it
    halves = reps.select("rep", F.posexplode("half").alias("slot", "value"))
    met = halves.groupBy("slot", "value").agg(F.count("*").alias("n")).filter("n > 1")
    some = written(halves.join(met, ["slot", "value"]), "halves")
    sides = some.groupBy("rep").agg(
        F.collect_list(F.when(F.col("slot") < M, F.struct("slot", "value"))).alias("a"),
        F.collect_list(F.when(F.col("slot") >= M, F.struct("slot", "value"))).alias("b"), F.sum("n").alias("weight"),
    )  # at most 2*M values a representative
    return sides.select("rep", "weight", F.explode("a").alias("x"), "b").select("rep", "weight", "x", F.explode("b").alias("y")).select(
        F.xxhash64("x.slot", "x.value", "y.slot", "y.value").alias("key"), "rep", "weight"
    )


def candidate_pairs(buckets: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """(lo, hi) pairs of members with their buckets' leaders."""
    heads = buckets.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.max(F.struct("weight", "rep")).alias("top")).filter("lo < hi")
    # a table of its own, here and below: the join's other side is then a scan, whose hot keys Spark can split
    heads = written(heads.select("key", F.array_distinct(F.array("lo", "hi", "top.rep")).alias("leaders")), "heads")
    stars = buckets.join(heads, "key").select("rep", F.explode("leaders").alias("leader")).filter("rep <> leader")
    pairs = stars.select(F.least("rep", "leader").alias("lo"), F.greatest("rep", "leader").alias("hi")).distinct()
    n = reps.select("rep", "n_shingles")
    sized = pairs.join(n.select(F.col("rep").alias("lo"), F.col("n_shingles").alias("n_lo")), "lo")
    sized = sized.join(n.select(F.col("rep").alias("hi"), F.col("n_shingles").alias("n_hi")), "hi")
    # a set can't be alike to one that is too small to hold that share of it
    return sized.filter(F.least("n_lo", "n_hi") >= F.lit(similarity - 1e-9) * F.greatest("n_lo", "n_hi")).select("lo", "hi")


def crowded(buckets: DataFrame) -> DataFrame:
    """(key, rep) of the buckets in which not all members are leaders."""
    buckets = buckets.select("key", "rep")
    return buckets.join(written(buckets.groupBy("key").count().filter("count > 3").select("key"), "keys"), "key")


def open_members(crowds: DataFrame, linked: DataFrame) -> DataFrame:
    """(rep, component) of all members of crowded buckets that lie in several components."""
    named = crowds.join(linked, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    keys = written(named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key"), "keys")
    return named.join(keys, "key").select("rep", "component").distinct()


def exact_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(lo, hi) pairs of members of different components whose sets may be alike: none
    that is alike is left out."""
    kind = members.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                piece = batch.slice(first, 256)
                values = [np.frombuffer(x.as_buffer(), np.int64) for x in piece.column(2)]
                n = np.array([len(x) for x in values])
                row = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(row), piece.column(1).take(row), pa.array(np.repeat(n, n)), pa.array(np.concatenate(values))],
                    names=["rep", "component", "n", "hash"],
                )

    hashes = written(members.join(sets, "rep").select("rep", "component", "members").mapInArrow(run, f"rep {kind}, component {kind}, n long, hash long"), "hashes")
    often = hashes.groupBy("hash").agg(F.count("*").alias("f")).filter("f > 1")
    # the hashes of one member only come first in its order and meet nothing
    own = hashes.join(often, "hash").groupBy("rep", "component", "n").agg(F.array_sort(F.collect_list(F.struct("f", "hash"))).alias("common"))
    alone = F.col("n") - F.size("common")
    # the longest prefix, against the smallest set that can be alike
    reach = F.floor(F.col("n") * (100 - percent) / F.lit(100)) + 1 - alone
    own = own.filter(reach > 0).select("rep", "component", "n", alone.alias("alone"), F.posexplode(F.slice("common", F.lit(1), reach.cast("int"))).alias("at", "x"))
    own = own.select("rep", "component", "n", "x.hash", (F.col("alone") + F.col("at")).alias("at"), F.ceil(F.col("x.f") / 256).cast("int").alias("parts"))
    prefix = written(own, "prefix")
    left = prefix.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    right = prefix.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    a, b = left.alias("a"), right.alias("b")
    least = percent * (F.col("a.n") + F.col("b.n"))  # over 100 + percent: the least number of shared hashes
    met = a.join(
        b,
        (F.col("a.hash") == F.col("b.hash")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.rep") < F.col("b.rep"))
        & (F.col("a.component") != F.col("b.component"))
        & ((100 + percent) * (F.col("a.n") - F.col("a.at")) >= least) & ((100 + percent) * (F.col("b.n") - F.col("b.at")) >= least),
    )
    return met.select(F.col("a.rep").alias("lo"), F.col("b.rep").alias("hi")).distinct()


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(rep, members): the sorted hashes of the sets of ``wanted(rep, doc_id, mark)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, values, ends in shingle_sets(batch.column(1), size):
                starts = np.r_[0, ends[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(ends)), pa.array([values[x:y].tobytes() for x, y in zip(starts, ends)], pa.binary())],
                    names=["rep", "members"],
                )

    # the candidates grow with the corpus, so this is a sort-merge join at every size
    asked = wanted.select("rep", F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).hint("merge")
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").join(asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    sets = written(rows.select("rep", "text").mapInArrow(run, "rep long, members binary"), "sets")
    return sets.dropDuplicates(["rep"]) if sets.groupBy("rep").count().filter("count > 1").head(1) else sets


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * shared >= percent * union."""
    kind = pairs.schema["lo"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                shared = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select(["lo", "hi"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("rep").alias("lo"), F.col("members").alias("a")), "lo")
    both = both.join(sets.select(F.col("rep").alias("hi"), F.col("members").alias("b")), "hi")
    return both.select("lo", "hi", "a", "b").mapInArrow(run, f"lo {kind}, hi {kind}")


def components(links: DataFrame) -> DataFrame:
    """(rep, component) of all linked nodes, by minimum labels that also follow
    their label's label, so long chains close in a logarithm of steps."""
    spark = links.sparkSession
    edges, edge_path = stored(links.unionByName(links.select(F.col("hi").alias("lo"), F.col("lo").alias("hi"))), "edges")
    labels, path = stored(edges.groupBy(F.col("lo").alias("rep")).agg(F.least(F.min("hi"), F.first("lo")).alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("rep").alias("hi"), "component"), "hi").groupBy(F.col("lo").alias("rep")).agg(F.min("component").alias("seen"))
        step = labels.join(near, "rep").select("rep", F.least("component", "seen").alias("next"), F.col("component").alias("was"))
        jump = step.select(F.col("rep").alias("next"), F.col("next").alias("further"))
        moved, next_path = stored(step.join(jump, "next", "left").select("rep", "was", F.least(F.col("next"), F.coalesce("further", "next")).alias("component")), "labels")
        drop(spark, path)  # the step before
        labels, path = moved.select("rep", "component"), next_path
        if not moved.filter("component <> was").head(1):
            drop(spark, edge_path)
            return labels


def joined_components(linked: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, component) once ``links`` between members of different components count too."""
    ends = links.join(members.select(F.col("rep").alias("lo"), F.col("component").alias("x")), "lo")
    ends = ends.join(members.select(F.col("rep").alias("hi"), F.col("component").alias("y")), "hi")
    tops = components(ends.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct())
    named = linked.unionByName(members).distinct().join(tops.select(F.col("rep").alias("component"), F.col("component").alias("top")), "component", "left")
    return named.select("rep", F.coalesce("top", "component").alias("component"))


def grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, mark, n_shingles, component): every row with the row that names its component (null
    for an empty set)."""
    rows = sketches(docs, size)
    reps = rows.filter("print is not null").groupBy("print").agg(F.min(F.struct(row_key().alias("row"), "half", "n_shingles")).alias("least"), F.count("*").alias("rows"))
    # numbers in the order of the rows: partitions are ranges, and the numbers grow with them
    reps = reps.select("print", "rows", "least.row", "least.half", "least.n_shingles").orderBy("row")
    reps = written(reps.select(F.monotonically_increasing_id().alias("rep"), "*"), "reps")
    buckets = written(shared_buckets(reps.select("rep", "half")), "buckets")
    pairs = written(candidate_pairs(buckets, reps, percent / 100), "pairs")
    crowds = written(crowded(buckets), "crowds")
    wanted = pairs.select(F.explode(F.array("lo", "hi")).alias("rep")).unionByName(crowds.select("rep")).distinct()
    named = reps.select("rep", "row.doc_id", "row.mark")
    sets = full_sets(docs, wanted.join(named, "rep"), size)
    links = written(verified(pairs, sets, percent), "links")
    linked = components(links)
    members = written(open_members(crowds, linked), "open")
    if members.head(1):
        more = written(verified(written(exact_pairs(members, sets, percent), "close"), sets, percent), "links")
        if more.head(1):
            linked = joined_components(linked, members, more)
    # classes of one row without links need no join back: only the others go
    found = reps.select("rep", "print", "rows").join(linked, "rep", "left").filter("rows > 1 or component is not null")
    found = found.select("print", F.coalesce("component", "rep").alias("number"))
    found = found.join(reps.select(F.col("rep").alias("number"), F.col("row").alias("component")), "number").drop("number")
    out = rows.select("doc_id", "mark", "n_shingles", "print").join(found, "print", "left")
    return out.select("doc_id", "mark", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", row_key())).alias("component"))


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    component = F.coalesce("component.doc_id", "doc_id")
    return grouped(docs, size, percent).select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates; all rows without words stay."""
    rows = written(grouped(docs, size, percent).filter("n_shingles > 0").select("doc_id", "mark", (F.col("component") == row_key()).alias("first")), "groups")
    names = [F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")]
    # by reference, as the documents may have columns of these names
    same = lambda keys: keys["_id"].eqNullSafe(docs["doc_id"]) & (keys["_mark"] == F.xxhash64(docs["text"]))
    gone = rows.filter("not first").select(*names).distinct()
    left = docs.join(gone, same(gone), "left_anti")
    repeats = written(rows.filter("first").groupBy(*names).count().filter("count > 1").drop("count"), "repeats")
    if repeats.head(1):  # rows alike in doc_id and text
        whole = F.struct(*[docs[c] for c in docs.columns]).alias("whole")
        one = left.join(repeats, same(repeats)).select(repeats["_id"].alias("id"), repeats["_mark"].alias("of"), whole).groupBy("id", "of").agg(F.first("whole").alias("whole"))
        left = left.join(repeats, same(repeats), "left_anti").unionByName(one.select("whole.*"))
    return left.select(docs.columns)
