"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every character that is no letter becomes a space and runs of
spaces one, then n-grams of 1 to ``max_n`` characters are hashed to ``buckets``.
*Fit*: each task sums its counts of (language, bucket), Spark adds them up and makes each language's column of
smoothed log-probabilities, a task a language; the matrix (languages x buckets, a size that grows with the number of languages alone) is broadcast in blocks of
``BLOCK`` languages, of which the driver holds one at a time. *Score*: each batch's n-grams pick their rows of a
block in numpy and are summed document by document; the best language and the sum of likelihoods are carried from block to block.

Prediction sees the text only. ``und`` with score 0 if a text is null or has no
letter, or if nothing was learned. Of equal scores the first language in string
order wins. Score: the posterior of the language under equal priors, with the
log-likelihood per n-gram times at most ``evidence`` n-grams, so it stays telling
for long texts. Repeated rows are rows of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .words import mix

BLOCK = 400  # languages: a matrix of 105 MB at 65,536 buckets
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For every code point: itself in lower case if a letter, else a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_TABLE: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_letters())
    return _TABLE[0]


def gram_buckets(texts: list[str], buckets: int, max_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and document of every n-gram, and whether each document has a letter."""
    # every text stands between two spaces of its own
    code = letters()[np.frombuffer("".join([f" {t} " for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)]
    row = np.repeat(np.arange(len(texts)), np.array([len(t) + 2 for t in texts], np.int64))
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    keep[1:] |= row[1:] != row[:-1]
    code, row = code[keep].astype(np.uint64), row[keep]
    has = np.bincount(row[code != 32], minlength=len(texts)) > 0
    found, rows, value = [], [], np.zeros(len(code), np.uint64)
    for n in range(1, max_n + 1):
        if len(code) < n:
            break
        head = value[: len(code) - n + 1] * np.uint64(0x110003) + code[n - 1 :]
        value = head
        ok = row[: len(head)] == row[n - 1 :]
        if n == 1:
            ok &= code != 32
        found.append((mix(head[ok] + np.uint64(n << 56)) & np.uint64(buckets - 1)).astype(np.int64))
        rows.append(row[: len(head)][ok])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    return np.concatenate(found), np.concatenate(rows), has


def _some(column: pa.Array, rows: int = 256) -> Iterator[list[str]]:
    """A batch's texts a few at a time, nulls as empty: as Python strings all of them would take several times the batch."""
    for at in range(0, len(column), rows):
        yield pc.fill_null(column.slice(at, rows), "").to_pylist()


def _runs(texts: list[str], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` characters; a longer text is one of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


@dataclass
class Model:
    languages: list[list[str]]  # by block, all in string order
    logp: list[Broadcast]  # buckets x languages of a block
    buckets: int
    max_n: int


def fit(labelled: DataFrame, buckets: int = 1 << 16, max_n: int = 3, smoothing: float = 0.5) -> Model:
    """Learns from the ``text`` of all rows with a non-null ``lang``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, done = np.array(batch.column(1).to_pylist(), object), 0
            for texts in _some(batch.column(0)):
                for a, b in _runs(texts):
                    bucket, row, _ = gram_buckets(texts[a:b], buckets, max_n)
                    names, code = np.unique(langs[done + a : done + b].astype(str), return_inverse=True)
                    table = np.bincount(code[row] * buckets + bucket, minlength=len(names) * buckets).reshape(len(names), buckets)
                    for name, x in zip(names.tolist(), table):
                        counts[name] = counts[name] + x if name in counts else x.copy()
                done += len(texts)
        for name, x in counts.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(x[at], pa.int64())], names=["lang", "bucket", "n"])

    rows = labelled.filter("lang is not null").select("text", "lang").mapInArrow(count, "lang string, bucket long, n long")
    total = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))

    def column(group: pa.Table) -> pa.Table:  # at most a row a bucket
        count = np.full(buckets, smoothing)
        count[group["bucket"].to_numpy()] += group["n"].to_numpy()
        return pa.table({"lang": group["lang"][:1], "logp": pa.array([np.log(count / count.sum()).astype("<f4").tobytes()], pa.binary())})

    columns = written(total.groupBy("lang").applyInArrow(column, "lang string, logp binary"), "languages")
    # a language whose texts have no letter has no column: all buckets are alike
    languages = sorted(r.lang for r in labelled.filter("lang is not null").select("lang").distinct().collect())
    blocks = [languages[i : i + BLOCK] for i in range(0, len(languages), BLOCK)]
    shared = []
    for block in blocks:
        logp = np.full((buckets, len(block)), np.log(1 / buckets), np.float32)
        number = {g: k for k, g in enumerate(block)}
        for r in columns.filter(F.col("lang").between(block[0], block[-1])).toLocalIterator():
            logp[:, number[r.lang]] = np.frombuffer(r.logp, "<f4")
        shared.append(labelled.sparkSession.sparkContext.broadcast(logp))
    return Model(blocks, shared, buckets, max_n)


def score_column(column: pa.Array, model: Model) -> tuple[list[str], list[float]]:
    """The language of each text of a batch, and its score."""
    langs, scores = [], []
    for texts in _some(column):
        own = score_texts(texts, model)
        langs += own[0]
        scores += own[1]
    return langs, scores


def score_texts(texts: list[str], model: Model, evidence: int = 200) -> tuple[list[str], list[float]]:
    langs, scores = [], []
    for a, b in _runs(texts):
        bucket, row, has = gram_buckets(texts[a:b], model.buckets, model.max_n)
        share = np.minimum(1, evidence / np.maximum(np.bincount(row, minlength=b - a)[: b - a, None], 1))
        top, odds, best = np.full(b - a, -np.inf), np.zeros(b - a), np.full(b - a, UNKNOWN, object)
        for names, logp in zip(model.languages, model.logp, strict=True):
            matrix = logp.value
            total = np.stack([np.bincount(row, matrix[bucket, k], minlength=b - a)[: b - a] for k in range(len(names))], 1) * share
            most = np.maximum(top, total.max(1))
            with np.errstate(invalid="ignore"):
                odds = np.where(np.isfinite(top), odds * np.exp(top - most), 0) + np.exp(total - most[:, None]).sum(1)
            best = np.where(total.max(1) > top, np.array(names, object)[total.argmax(1)], best)  # of equal ones the first
            top = most
        known = has & np.isfinite(top)
        langs += [x if h else UNKNOWN for x, h in zip(best.tolist(), known.tolist())]
        scores += np.where(known, 1 / np.maximum(odds, 1), 0.0).tolist()
    return langs, scores


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = score_column(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the rows that aren't held out, then predicts all of them:
    doc_id, held_out, lang_pred, score."""
    model = fit(docs.filter(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``docs`` without those whose language can't be told: ``und``, or a score below ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            at = batch.schema.get_field_index("text") if at is None else at
            langs, scores = score_column(batch.column(at), model)
            yield batch.filter(pa.array([g != UNKNOWN and s >= least for g, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
