"""Repeated passages: winnowing over line hashes.

A *gram* is the shortest run of lines from a line on with at least ``gram_words``
words, a *window* the shortest one with at least ``min_words``. Of the grams inside
each window the one with the least hash is a fingerprint (the last of equal ones), so
two documents that share a run of lines of ``min_words`` words or more share a
fingerprint inside it, wherever the run stands.

Lines without words count neither in grams nor in keys. A fingerprint's key takes in the
line before or the line after the gram (two keys), or the gram alone if that has ``min_words`` words. Keys that stand in one place only
are dropped. Fingerprints left are hints: the shortest runs of ``min_words`` words from
each line on and up to each line that hold one are compared as a whole, by a 128-bit hash, and
each run but the first in the order of (doc_id, text hash, line) is removed. Every line of
a longer repeat is in such a run inside it. First places are found by a grouped minimum,
so a passage in any number of documents gives a row for each place, never pairs of them.

Lines are cut at ``\\n`` and compared without white space at their ends; words are
runs of non-space characters. A line is only removed if an equal line stands
earlier in the order above. Null texts have no lines. Null doc_ids take no part.
Rows with one doc_id and text are one document; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written


def fingerprints(hashes: np.ndarray, words: list[int], gram_words: int, min_words: int) -> list[tuple[int, int]]:
    """(line, key) of the selected grams. Lines without words are left out here, so a window has
    at most ``min_words`` lines and the work is linear whatever stands between them."""
    spoken = [i for i, n in enumerate(words) if n]
    n = len(spoken)
    total = np.concatenate([[0], np.cumsum([words[i] for i in spoken])])
    if total[-1] < min_words:
        return []
    gram_end = np.searchsorted(total, total[:-1] + gram_words).tolist()  # one past the last line
    window_end = np.searchsorted(total, total[:-1] + min_words).tolist()
    data = np.asarray(hashes, np.uint64)[spoken]
    digest = lambda i, j, seed=0: xxhash.xxh3_64_intdigest(data[i:j].tobytes(), seed)
    grams = [digest(i, j) if j <= n else None for i, j in enumerate(gram_end)]
    chosen = set()
    for start, end in enumerate(window_end):
        if end > n:
            break
        at = start
        for i in range(start + 1, end):
            if gram_end[i] > end:
                break
            if grams[i] <= grams[at]:
                at = i
        chosen.add(at)
    out = []
    for at in sorted(chosen):
        end = gram_end[at]
        if total[end] - total[at] >= min_words:
            out.append((spoken[at], grams[at]))
            continue
        if at:
            out.append((spoken[at], digest(at - 1, end, 1)))
        if end < n:
            out.append((spoken[at], digest(at, end + 1, 2)))
    return out


def line_table(docs: DataFrame, gram_words: int, min_words: int) -> DataFrame:
    """(doc_id, mark, lines, words, at, keys): 128-bit line hashes (two numbers each) and word counts of
    each document, and its fingerprints."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                piece = batch.slice(first, 512)
                lines, words, at, keys = [], [], [], []
                for text in piece.column(2).to_pylist():
                    rows = [x.strip() for x in text.split("\n")]
                    hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in rows]), np.int64)
                    counts = [len(x.split()) for x in rows]
                    found = fingerprints(hashes[::2].view(np.uint64), counts, gram_words, min_words)
                    lines.append(hashes)
                    words.append(counts)
                    at.append([x[0] for x in found])
                    keys.append(np.array([x[1] for x in found], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0), piece.column(1), pa.array(lines, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32())),
                        pa.array(at, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "mark", "lines", "words", "at", "keys"],
                )

    rows = docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("mark"), "text")
    schema = f"doc_id {kind}, mark long, lines array<long>, words array<int>, at array<int>, keys array<long>"
    return written(rows.mapInArrow(run, schema), "lines")


def runs(hashes: np.ndarray, words: np.ndarray, hints: np.ndarray, min_words: int) -> list[tuple[int, int, bytes]]:
    """From a row of hashes a line: (line, end, key) of the shortest runs of ``min_words`` words from a line on or up to a
    line that hold a hinted line. Runs that begin or end with blank lines are keyed by
    the run between them and the number of these lines."""
    total = np.concatenate([[0], np.cumsum(words)])
    n, size = len(words), int(total[-1])
    hinted = np.concatenate([[0], np.cumsum(np.bincount(hints, minlength=n))])
    spoken = np.flatnonzero(words)
    ends = np.searchsorted(total, total[spoken] + min_words)
    spans = {(i, j): (0, 0) for i, j in zip(spoken.tolist(), ends.tolist()) if total[i] + min_words <= size}
    begins = np.searchsorted(total, total[spoken + 1] - min_words, side="right") - 1
    spans |= {(int(i), j): (0, 0) for i, j in zip(begins, (spoken + 1).tolist()) if total[j] >= min_words}
    out = []
    before = np.concatenate([[0], spoken + 1])  # one past the last line with words, by number of such lines
    after = np.concatenate([spoken, [n]])
    rank = np.searchsorted(spoken, np.arange(n + 1))
    for i, j in spans:
        if hinted[j] == hinted[i]:
            continue
        core = xxhash.xxh3_128_digest(hashes[i:j].tobytes())
        out.append((i, j, core))
        for k in range(1, i - int(before[rank[i]]) + 1):
            out.append((i - k, j, xxhash.xxh3_128_digest(core + k.to_bytes(8, "little"), 1)))
        for k in range(1, int(after[rank[j]]) - j + 1):
            out.append((i, j + k, xxhash.xxh3_128_digest(core + k.to_bytes(8, "little"), 2)))
    return out


def repeated_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, mark, removed): the numbers of the lines to remove, in order."""
    table = line_table(docs, -(-min_words // 2), min_words)
    kind = docs.schema["doc_id"].dataType.simpleString()
    doc = F.struct("doc_id", "mark").alias("doc")
    places = table.select(doc, F.explode(F.arrays_zip("at", "keys")).alias("f"))
    places = places.select("doc", F.col("f.at").alias("at"), F.col("f.keys").alias("key"))
    place = F.struct("doc", "at")
    # a table of its own, as the heads below: the join's other side is then a scan, whose hot keys Spark can split
    shared = written(places.groupBy("key").agg(F.min(place).alias("head"), F.max(place).alias("tail")).filter("head < tail").select("key"), "shared")
    # equal rows are one document
    hints = places.join(shared, "key").groupBy("doc").agg(F.collect_set("at").alias("hints"))
    own = table.select(doc, "lines", "words").dropDuplicates(["doc"])
    hinted = hints.join(own, "doc").select("doc.doc_id", "doc.mark", "lines", "words", "hints")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                piece = batch.slice(first, 256)
                row, found = [], []
                for i in range(piece.num_rows):
                    lines, words, hints = (piece.column(k)[i].values.to_numpy() for k in (2, 3, 4))
                    some = runs(lines.reshape(-1, 2), words, hints, min_words)
                    row += [i] * len(some)
                    found += some
                pick = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(pick), piece.column(1).take(pick), *(pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary())))],
                    names=["doc_id", "mark", "at", "end", "key"],
                )

    whole = written(hinted.mapInArrow(run, f"doc_id {kind}, mark long, at int, end int, key binary"), "runs").select(doc, "at", "end", "key")
    heads = written(whole.groupBy("key").agg(F.min(place).alias("head"), F.max(place).alias("tail")).filter("head < tail").select("key", "head"), "heads")
    later = whole.join(heads, "key").filter(place > F.col("head")).select("doc.doc_id", "doc.mark", "at", "end")
    gone = later.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("at", "end")).alias("runs"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(2):
                at, end = (value.values.field(k).to_numpy() for k in (0, 1))
                size = int(end.max()) + 1
                out.append(np.flatnonzero(np.cumsum(np.bincount(at, minlength=size) - np.bincount(end, minlength=size))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "mark", "removed"])

    return gone.mapInArrow(merge, f"doc_id {kind}, mark long, removed array<int>")


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines of these ascending numbers, of the slices between them."""
    lines = F.split(text, "\n", -1)
    edges = F.concat(F.array(F.lit(-1)), removed, F.array(F.size(lines)))

    def join(t: Column) -> Column:
        edge = lambda i: F.element_at(t["edges"], i)
        at = F.sequence(F.lit(1), F.size(t["edges"]) - 1)
        return F.array_join(F.flatten(F.transform(at, lambda i: F.slice(t["lines"], edge(i) + 2, edge(i + 1) - edge(i) - 1))), "\n")

    # as the only item of a list, so that the text is split once and not for each slice
    return F.transform(F.array(F.struct(lines.alias("lines"), edges.alias("edges"))), join)[0]


def remove_repeats(docs: DataFrame, min_words: int = 50, drop_empty: bool = False, into: str | None = "removed") -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and their numbers in the
    column ``into`` (null if none; it takes the place of a column of that name; None: no such column).
    With ``drop_empty`` documents that lost lines and have no word left are dropped."""
    gone = repeated_lines(docs.select("doc_id", "text"), min_words).select(
        F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("removed").alias("_removed")
    )
    rows = docs.join(gone, (docs["doc_id"] == gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_mark"]), "left")
    removed = gone["_removed"]
    text = F.when(removed.isNull(), docs["text"]).otherwise(without_lines(docs["text"], removed))
    if drop_empty:
        rows = rows.filter(removed.isNull() | text.rlike("\\S"))
    kept = [text.alias("text") if c == "text" else docs[c] for c in docs.columns if c != into]
    return rows.select(*kept, *([removed.alias(into)] if into else []))


def deduplicate_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, removed, text (what is left)."""
    rows = remove_repeats(docs.select("doc_id", "text", F.size(F.split("text", "\n", -1)).alias("n_lines")), min_words)
    empty = F.array().cast("array<int>")
    return rows.select(
        "doc_id", F.when(F.col("n_lines") > 0, F.col("n_lines")).otherwise(0).cast("long").alias("n_lines"),
        F.size(F.coalesce("removed", empty)).cast("long").alias("n_removed"),
        F.coalesce("removed", empty).alias("removed"), "text",
    )
