r"""Benchmark decontamination by a stored positional inverted index.

1. *Index*: every task cuts its documents into segments of at most ``segment_bytes``
   (a longer text is one of its own) and writes the postings of all their words:
   a row for each term of a segment with its positions in ascending order. The rows of a file are
   sorted by term. One more row a segment lists its documents. The index depends on the
   documents only: it is made once and serves any test set.
2. *Ask*: a search reads the index once for each block of test windows. Up to ``PUSHED_TERMS`` terms are a
   filter of the scan, which then skips the pages of a file that hold none of them. The terms of a
   larger test set stand in every page, so that nothing could be skipped: they meet the rows in a broadcast join.
3. *Rarest first*: the asked terms' lists meet by segment. Their lengths there tell which terms of a phrase are rare
   in the segment and order them; a phrase without one of its terms in the segment is out at once.
4. *Intersect*: a phrase's rarest list, moved back by
   that term's offset, gives the places where it may start; these are intersected with the
   next rarer terms' lists, moved in the same way, until none is left or all terms agree.
   Proximity matches let up to ``slop`` other words stand between a phrase's words.

The shuffle carries lists of test terms only, dealt out by segment, so a document
or passage that is repeated any number of times is no hot key. The test set is read in blocks
of at most ``block_words`` words, each broadcast on its own; blocks only add matches to
document rows, so results are the same for any block size.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.

Null or empty texts have no words and no matches; an item without words matches
nothing; a null item id counts as the id ``null``; repeated items count once by
id; repeated documents, those of one doc_id or of none give a row each; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLOP = 2
PUSHED_TERMS = 64
_MUL_B = np.uint64(0xD6E8FEB86659FD93)


def lower_ascii(c):
    return F.translate(c, UPPER, LOWER)


def test_windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(item, start, words): all runs of ``size`` words, or the whole shorter item."""
    w = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
        F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORD), F.lit(0)).alias("w"),
    ).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return w.select("item", F.explode(starts).alias("start"), "w").select(
        "item", "start", F.slice("w", F.col("start") + 1, size).alias("words")
    )


# -- index ----------------------------------------------------------------------


def _term_rows(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The terms, the ends of their lists, and all lists of word numbers one after the other."""
    key, check = W.keys(low, s, e), W.keys(low, s, e, _MUL_B)
    at = np.argsort(key, kind="stable")
    key, check, size = key[at], check[at], (e - s)[at]
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (check[1:] != check[:-1]) | (size[1:] != size[:-1])]) if len(at) else at
    lengths, ends = size[new], np.cumsum(size[new])
    data = low[np.repeat(s[at[new]] - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(new), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(data)])
    return terms.cast(pa.binary()), np.r_[new[1:], len(at)] if len(new) else new, at.astype(np.int32)


def build_index(docs: DataFrame, segment_bytes: int = 8 << 20) -> DataFrame:
    """The stored index: (segment, term, n, positions) for each term of a segment, positions
    being word numbers in the segment, and a row with a null term and its documents
    (doc_ids, marks, n_words), whose words stand one after the other. A mark is a hash of the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["segment", "term", "n", "positions", "doc_ids", "marks", "n_words"]
    schema = f"segment long, term binary, n int, positions array<int>, doc_ids array<{kind}>, marks array<long>, n_words array<int>"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = batch.column(3)[0].as_py() if batch.num_rows else 0
            for a, b, buf, offs in W.slices(batch.column(2), segment_bytes):
                low = W.LOWER[buf]
                s, e, first = W.spans(low, offs, W.ALNUM)
                terms, ends, at = _term_rows(low, s, e)
                rows, ids = b - a, batch.column(0).slice(a, b - a)
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([base + a]), pa.nulls(1, pa.binary()), pa.array([rows], pa.int32()), pa.nulls(1, pa.list_(pa.int32())), one(ids), one(batch.column(1).slice(a, rows)), one(pa.array(np.diff(first), pa.int32()))],
                    names=names,
                )
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, base + a)), terms, pa.array(np.diff(np.r_[0, ends]), pa.int32()),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(at)),
                        pa.nulls(n, pa.list_(ids.type)), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32())),
                    ],
                    names=names,
                )

    # a segment is numbered by its first row; the numbers are fixed once the table is written
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text", F.monotonically_increasing_id().alias("row"))
    return written(rows.mapInArrow(index, schema).sortWithinPartitions("term"), "postings")


def documents(index: DataFrame) -> DataFrame:
    """(segment, row, doc_id, mark, n_words) of the indexed documents."""
    listed = index.filter("term is null").select("segment", F.posexplode(F.arrays_zip("doc_ids", "marks", "n_words")).alias("row", "d"))
    return listed.select("segment", "row", F.col("d.doc_ids").alias("doc_id"), F.col("d.marks").alias("mark"), F.col("d.n_words").cast("long").alias("n_words"))


# -- search ---------------------------------------------------------------------


def _plan(windows: list[tuple], slops: list[int]) -> dict:
    """A block of phrases: the numbers of their terms, in order and filled up with -1, their sizes and slops."""
    number = {w: i for i, w in enumerate(sorted({w for words in windows for w in words}))}
    sizes = np.array([len(words) for words in windows], np.int64)
    own = np.full((len(windows), int(sizes.max(initial=1))), -1)
    for i, words in enumerate(windows):
        own[i, : len(words)] = [number[w] for w in words]
    return {"number": number, "own": own, "sizes": sizes, "slops": np.array(slops, np.int64)}


def _ordered(plan: dict, counts: np.ndarray) -> dict:
    """The phrases whose terms all have a list, by their rarest term: terms and offsets with the
    rarest first, terms in their own order, and the phrase's number."""
    often = np.r_[counts, np.iinfo(np.int64).max][plan["own"]]  # what fills a shorter phrase up comes last
    phrase = np.flatnonzero((often > 0).all(axis=1))
    order = np.argsort(often[phrase], axis=1, kind="stable")
    terms = np.take_along_axis(plan["own"][phrase], order, axis=1)
    by_first = np.argsort(terms[:, 0], kind="stable")
    phrase = phrase[by_first]
    return {
        "terms": terms[by_first], "offsets": order[by_first], "own": plan["own"][phrase],
        "sizes": plan["sizes"][phrase], "slops": plan["slops"][phrase], "phrase": phrase,
    }


class _Segment:
    """The asked lists of one segment: ``held`` has term * words + position, ascending."""

    def __init__(self, numbers: np.ndarray, lists: np.ndarray, sizes: np.ndarray, n_words: np.ndarray):
        self.base = np.concatenate([[0], np.cumsum(n_words)])
        self.total = int(self.base[-1]) + 1
        self.term, self.at = np.repeat(numbers, sizes), lists.astype(np.int64)
        self.held = np.sort(self.term * self.total + self.at)
        self.counts = lambda n: np.bincount(numbers, sizes, n).astype(np.int64)  # of terms 0 to n - 1

    def has(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        want = term * self.total + at
        k = np.minimum(np.searchsorted(self.held, want), len(self.held) - 1)
        return self.held[k] == want

    def after(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The next place of each term behind ``at``; past the end if there is none."""
        k = np.searchsorted(self.held, term * self.total + at, side="right")
        found = np.where(k < len(self.held), self.held[np.minimum(k, len(self.held) - 1)], -1) - term * self.total
        return np.where((found >= 0) & (found < self.total), found, self.total)


def _seeds(p: _Segment, plan: dict, room: int = 1 << 20):
    """(phrase, start, row) for each place of a phrase's rarest term, a bounded number at a time."""
    rare = plan["terms"][:, 0]
    lo, hi = np.searchsorted(rare, p.term, "left"), np.searchsorted(rare, p.term, "right")
    asked = np.flatnonzero(hi > lo)
    times = (hi - lo)[asked]
    upto = np.cumsum(times)
    begin = 0
    while begin < len(asked):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + room, "right")))
        n, some = times[begin:end], asked[begin:end]
        which = np.repeat(some, n)
        phrase = np.repeat(lo[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield phrase, p.at[which] - plan["offsets"][phrase, 0], np.searchsorted(p.base, p.at[which], "right") - 1
        begin = end


def _exact(p: _Segment, plan: dict, phrase, start, row):
    """Those of the seeds at which all terms stand at their offsets."""
    ok = (start >= p.base[row]) & (start + plan["sizes"][phrase] <= p.base[row + 1])
    phrase, start, row = phrase[ok], start[ok], row[ok]
    for k in range(1, plan["terms"].shape[1]):
        if not len(phrase):
            break
        term = plan["terms"][phrase, k]
        ok = (term < 0) | p.has(term, start + plan["offsets"][phrase, k])
        phrase, start, row = phrase[ok], start[ok], row[ok]
    return phrase, start, row


def _near(p: _Segment, plan: dict, phrase, start, row):
    """(phrase, start, last, row) where the terms stand in order within the phrase's size and slop, first word at ``start``."""
    some = plan["slops"][phrase] > 0
    phrase, start, row = phrase[some], start[some], row[some]
    most = int(plan["slops"].max(initial=0))
    phrase, start, row = (np.tile(x, most + 1) for x in (phrase, start, row))
    back = np.repeat(np.arange(most + 1), len(phrase) // (most + 1))  # words between the first and the rarest one
    start = start - back
    ok = (back <= plan["slops"][phrase]) & (start >= p.base[row])
    phrase, start, row = phrase[ok], start[ok], row[ok]
    ok = p.has(plan["own"][phrase, 0], start)
    phrase, start, row = phrase[ok], start[ok], row[ok]
    last = start
    for k in range(1, plan["own"].shape[1]):
        if not len(phrase):
            break
        term = plan["own"][phrase, k]
        last = np.where(term < 0, last, p.after(np.maximum(term, 0), last))
        ok = (last < p.base[row + 1]) & ((term < 0) | (last - start <= k + plan["slops"][phrase]))
        phrase, start, last, row = phrase[ok], start[ok], last[ok], row[ok]
    return phrase, start, last, row


def search(index: DataFrame, windows: list[tuple[tuple, list]], slops: list[int]) -> DataFrame:
    """(segment, row, phrase, start, last, exact): the places of a block of phrases (its numbers
    are those in the list), exact ones and near ones that aren't exact."""
    spark = index.sparkSession
    plan = spark.sparkContext.broadcast(_plan([words for words, _ in windows], slops))
    number = {w.encode(): i for w, i in plan.value["number"].items()}
    held = index.filter("term is not null")
    if 0 < len(number) <= PUSHED_TERMS:
        held = held.filter(reduce(or_, [F.col("term") == F.lit(w) for w in number]))
    known = spark.createDataFrame(list(number.items()), "term binary, number int")  # at most block_words rows
    lists = held.select("segment", "term", "positions").join(F.broadcast(known), "term").select("segment", "number", "positions")
    bounds = index.filter("term is null").select("segment", F.lit(-1).alias("number"), F.col("n_words").alias("positions"))
    dealt = lists.unionByName(bounds).repartition("segment").sortWithinPartitions("segment", "number")

    def found(p: _Segment) -> Iterator[pa.RecordBatch]:
        asked = _ordered(plan.value, p.counts(len(plan.value["number"])))
        for phrase, start, row in _seeds(p, asked):
            w, s, r = _exact(p, asked, phrase, start, row)
            nw, ns, nl, nr = _near(p, asked, phrase, start, row)
            apart = nl - ns + 1 > asked["sizes"][nw]
            nw, ns, nl, nr = nw[apart], ns[apart], nl[apart], nr[apart]
            rows = np.concatenate([r, nr])
            last = np.concatenate([s + asked["sizes"][w] - 1, nl]) - p.base[rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows, pa.int32()), pa.array(asked["phrase"][np.concatenate([w, nw])], pa.int32()),
                    pa.array(np.concatenate([s, ns]) - p.base[rows], pa.int32()), pa.array(last, pa.int32()), pa.array(np.r_[np.ones(len(w), bool), np.zeros(len(nw), bool)]),
                ],
                names=["row", "phrase", "start", "last", "exact"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close():
            if n_words is not None and numbers:
                p = _Segment(np.concatenate(numbers), np.concatenate(lists), np.concatenate(sizes), n_words)
                for out in found(p):
                    if out.num_rows:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(out.num_rows, segment)), *out.columns], names=["segment", *out.schema.names])

        segment, n_words, numbers, lists, sizes = None, None, [], [], []
        for batch in batches:
            own = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]).tolist() if len(own) else []
            for a, b in zip(edges, [*edges[1:], len(own)]):
                if own[a] != segment:
                    yield from close()
                    segment, n_words, numbers, lists, sizes = own[a], None, [], [], []
                piece = batch.slice(a, b - a)
                number, values = piece.column(1).to_numpy(), piece.column(2)
                if number[0] < 0:  # the segment's documents come first
                    n_words = values[0].values.to_numpy()
                    piece = piece.slice(1)
                    number, values = piece.column(1).to_numpy(), piece.column(2)
                if len(number):
                    numbers.append(number.astype(np.int64))
                    lists.append(values.flatten().to_numpy())
                    sizes.append(np.diff(values.offsets.to_numpy()))
        yield from close()

    return dealt.mapInArrow(run, "segment long, row int, phrase int, start int, last int, exact boolean")


def _blocks(benchmark: DataFrame, size: int, block_words: int):
    """The distinct test windows with their items, in blocks of bounded size, never all at once."""
    block, n = {}, 0
    for item, _, words in test_windows(benchmark, size).toLocalIterator():
        block.setdefault(tuple(words), set()).add(item)
        n += len(words)
        if n >= block_words:
            yield block
            block, n = {}, 0
    if block:
        yield block


def phrase_matches(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_words: int = 2_000_000, slop: int = SLOP) -> DataFrame:
    """Per document row: ``doc_id, mark, n_words, n_hit`` (words inside any exact match), ``spans``
    (start, end of the exact matches, each once), ``items`` (their distinct ids, in string order), and
    ``near, near_items`` of proximity matches of windows of ``size`` words, by first word."""
    spark = docs.sparkSession
    index = build_index(docs.select("doc_id", "text"))
    found = spark.createDataFrame([], "segment long, row int, exact boolean, spans array<struct<start:int,end:int>>, items array<string>")
    for block in _blocks(benchmark, size, block_words):
        windows = sorted(block.items())
        places = search(index, windows, [slop if len(words) == size else 0 for words, _ in windows])
        items = spark.createDataFrame([(i, sorted(own)) for i, (_, own) in enumerate(windows)], "phrase int, items array<string>")
        # by row first, so that a window's many places aren't joined one by one
        rows = places.groupBy("segment", "row", "phrase", "exact").agg(F.collect_set(F.struct("start", (F.col("last") + 1).alias("end"))).alias("spans"))
        rows = rows.join(F.broadcast(items), "phrase")  # at most block_words items
        found = found.unionByName(written(rows.select("segment", "row", "exact", "spans", "items"), "matches"))
    exact = F.col("exact")
    merged = found.groupBy("segment", "row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(exact, F.col("spans")))))).alias("spans"),
        F.flatten(F.collect_set(F.when(exact, F.col("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(~exact, F.col("spans.start")))))).alias("near"),
        F.flatten(F.collect_set(F.when(~exact, F.col("items")))).alias("near_items"),
    )
    hit = F.aggregate(
        "spans", F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["upto"], x["end"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["upto"], x["start"]))).alias("n")),
        lambda a: a["n"],
    )
    strings = lambda c: F.coalesce(F.array_sort(F.array_distinct(c)), F.array().cast("array<string>"))
    rows = documents(index).join(merged, ["segment", "row"], "left")
    return rows.select(
        "doc_id", "mark", "n_words", F.coalesce(hit, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"), strings("items").alias("items"),
        F.coalesce("near", F.array().cast("array<int>")).alias("near"), strings("near_items").alias("near_items"),
    )


def proximity_matches(docs: DataFrame, phrases: list[str], slop: int) -> DataFrame:
    """(doc_id, phrase, start, end): every place of a phrase's first word from which its words
    stand in order (end: the last one, each word at its next place) with at most ``slop`` other words
    between them, none included. The phrases are a small stated list."""
    index = build_index(docs.select("doc_id", "text"))
    asked = [(tuple(w), p) for p in phrases if (w := re.findall(WORD, p.translate(str.maketrans(UPPER, LOWER))))]
    places = search(index, asked, [slop] * len(asked)).select("segment", "row", "phrase", "start", "last").distinct()
    named = docs.sparkSession.createDataFrame([(i, p) for i, (_, p) in enumerate(asked)], "number int, name string")
    rows = places.join(F.broadcast(named), F.col("phrase") == F.col("number")).join(documents(index), ["segment", "row"])
    return rows.select("doc_id", F.col("name").alias("phrase"), "start", F.col("last").alias("end"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (first
    words of proximity matches), near_items (their item ids, comma-joined)."""
    m = phrase_matches(docs, benchmark, size)
    return m.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"), F.array_join("near_items", ",").alias("near_items"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """``docs`` without the rows that hold a test phrase. Rows are told by doc_id and text, so
    others of the same doc_id, or without one, stay."""
    dirty = phrase_matches(docs, benchmark, size, slop=0).filter("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    return docs.join(dirty, docs["doc_id"].eqNullSafe(dirty["_id"]) & (F.xxhash64(docs["text"]) == dirty["_mark"]), "left_anti")
