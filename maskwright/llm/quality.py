"""Quality and toxicity: document evidence under hierarchical empirical Bayes sites.

*Document classifier*: logistic regression on what stands in a text or doesn't: hashed
words, single other characters, and the binned shape of the text (length, share of
capitals, of other characters, of distinct words, of the commonest word, mean word
length). It learns from at most ``train_rows`` labelled rows (those with the least hash
of doc_id; a stated parameter). Tasks count the features by label first; only those
whose shares in the two classes differ by ``z_least`` standard errors are used, and only
these features of the sample's rows come to the driver, where the weights are fitted.

*Sites*: labelled documents, all of them, are counted by host and by path below the host.
The global rate is the prior of the hosts, each host's posterior the prior of
its paths; how strongly is estimated from the spread between sites (method of moments
on grouped sums), so a site with few labels stays near its parent. Here ``source`` is
the host and ``lang`` the path.

*Together*: the document's log odds without the classifier's prior, plus the log odds of its
path's posterior.

Null texts are empty; null hosts and paths are the sites ''. Rows without label are
scored alike. Null labels, and labels of unknown documents, teach nothing; if a label is given
twice for a document each counts. Without labels of both kinds every score is the
global rate (0.5 without any). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import written

BUCKETS = 1 << 18
SALTS = 32
SHAPES = 6
BINS = 12
TASKS = ("quality", "toxic")


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row, bucket): the distinct features of every row."""
    for a, b, buf, offs in W.slices(column):
        rows = b - a
        low = W.LOWER[buf]
        s, e, first = W.spans(low, offs, W.ALNUM)
        n = np.diff(first)
        row = np.repeat(np.arange(rows), n)
        key = W.mix(W.keys(low, s, e)) % np.uint64(BUCKETS)
        # a row's words, once each, with how often they stand
        code, times = np.unique(row * np.int64(BUCKETS) + key.astype(np.int64), return_counts=True)
        word_row = code // BUCKETS
        distinct = np.bincount(word_row, minlength=rows)
        most = np.zeros(rows)
        np.maximum.at(most, word_row, times)
        size = np.diff(offs)
        byte_row = np.repeat(np.arange(rows), size)
        share = lambda x, of: np.divide(x, np.maximum(of, 1))
        capital = np.bincount(byte_row[(buf >= 65) & (buf <= 90)], minlength=rows)
        letter = np.bincount(byte_row[(low >= 97) & (low <= 122)], minlength=rows)
        sign = ~W.ALNUM[low] & W.NON_SPACE[low]
        signs = np.bincount(byte_row[sign], minlength=rows)
        shape = np.stack([
            np.minimum(np.log2(n + 1), BINS - 1), share(capital, letter) * (BINS - 1), np.minimum(share(signs, size) * 4, 1) * (BINS - 1),
            share(distinct, n) * (BINS - 1), share(most, n) * (BINS - 1), np.minimum(share(np.bincount(row, e - s, minlength=rows), n), BINS - 1),
        ], 1).astype(np.int64)
        shape = BUCKETS + 256 + shape + np.arange(SHAPES) * BINS
        marks = np.unique(byte_row[sign] * np.int64(256) + low[sign])
        yield (
            a, rows, np.concatenate([word_row, marks // 256, np.repeat(np.arange(rows), SHAPES)]),
            np.concatenate([code % BUCKETS, BUCKETS + marks % 256, shape.ravel()]),
        )


WIDTH = BUCKETS + 256 + SHAPES * BINS


def sample(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """(text, y_quality, y_toxic) of the labelled rows to learn from."""
    ids = labels.filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    asked = ids.select("doc_id", *[F.col(t).cast("int").alias(f"y_{t}") for t in TASKS])
    # at most train_rows small rows
    return docs.select("doc_id", "text").join(F.broadcast(asked), "doc_id").select("text", *[f"y_{t}" for t in TASKS])


def _labels(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.array([-1 if y is None else y for y in batch.column(1 + t).to_pylist()], np.int64) for t in range(len(TASKS))]


def telling(rows: DataFrame, z_least: float) -> list[np.ndarray]:
    """For each task the features whose shares in the classes differ."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size = np.zeros((len(TASKS), 2, WIDTH), np.int64), np.zeros((len(TASKS), 2), np.int64)
        for batch in batches:
            ys = _labels(batch)
            for a, n, row, bucket in features(batch.column(0)):
                for t, y in enumerate(ys):
                    here = y[a : a + n]
                    for c in (0, 1):
                        size[t, c] += (here == c).sum()
                        got[t, c] += np.bincount(bucket[here[row] == c], minlength=WIDTH)
        for t in range(len(TASKS)):
            for c in (0, 1):
                at = np.flatnonzero(got[t, c])
                columns = [np.full(len(at) + 1, t), np.full(len(at) + 1, c), np.r_[at, -1], np.r_[got[t, c][at], size[t, c]]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["task", "y", "bucket", "n"])

    parts = rows.mapInArrow(count, "task long, y long, bucket long, n long")
    both = [F.sum(F.when(F.col("y") == c, F.col("n"))).alias(f"n{c}") for c in (0, 1)]
    counted = written(parts.groupBy("task", "bucket").agg(*both).na.fill(0), "counts")
    sizes = {r.task: (r.n0, r.n1) for r in counted.filter("bucket = -1").collect()}
    found = []
    for t in range(len(TASKS)):
        n0, n1 = sizes.get(t, (0, 0))
        if not n0 or not n1:
            found.append(np.zeros(0, np.int64))
            continue
        p = (F.col("n0") + F.col("n1")) / (n0 + n1)
        z = (F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n0 + 1 / n1))
        far = counted.filter(F.col("task") == t).filter("bucket >= 0").filter(F.abs(z) >= z_least).select("bucket")
        found.append(np.sort(far.toArrow().column(0).to_numpy().astype(np.int64)))
    return found


def logistic(row: np.ndarray, feature: np.ndarray, y: np.ndarray, width: int, ridge: float = 0.3, steps: int = 300) -> np.ndarray:
    """Weights of present features, and the intercept at the end."""
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        score = np.bincount(row, w[feature], minlength=len(y)) + w[-1]
        miss = 1 / (1 + np.exp(-np.clip(score, -40, 40))) - y
        slope = np.r_[np.bincount(feature, miss[row], minlength=width), miss.sum()] + ridge * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, z_least: float = 4.0) -> np.ndarray:
    """(feature x task) weights: log odds without the classes' prior; the last row has the intercepts."""
    rows = sample(docs, labels, train_rows)
    chosen = telling(rows, z_least)
    every = np.unique(np.concatenate(chosen))
    weights = np.zeros((WIDTH + 1, len(TASKS)))
    if not len(every):
        return weights

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys = _labels(batch)
            for a, n, row, bucket in features(batch.column(0)):
                at = np.minimum(np.searchsorted(every, bucket), len(every) - 1)
                own = every[at] == bucket
                order = np.argsort(row[own], kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[own], minlength=n))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(at[own][order].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(y[a : a + n].astype(np.int32)) for y in ys] + [lists], names=[*TASKS, "has"])

    table = rows.mapInArrow(pick, f"{', '.join(f'{t} int' for t in TASKS)}, has array<int>").toArrow()  # at most train_rows rows
    has = table["has"].combine_chunks()
    feature, row = has.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(table)), np.diff(has.offsets.to_numpy()))
    for t, name in enumerate(TASKS):
        use = np.flatnonzero(table[name].to_numpy() >= 0)
        if not len(chosen[t]):
            continue
        place = np.full(len(every), -1)
        place[np.searchsorted(every, chosen[t])] = np.arange(len(chosen[t]))
        number = np.full(len(table), -1)
        number[use] = np.arange(len(use))
        keep = (place[feature] >= 0) & (number[row] >= 0)
        y = table[name].to_numpy()[use].astype(float)
        w = logistic(number[row[keep]], place[feature[keep]], y, len(chosen[t]))
        weights[chosen[t], t] = w[:-1]
        weights[-1, t] = w[-1] - np.log(y.sum() / (len(y) - y.sum()))
    return weights


def evidence(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, host, path, w_quality, w_toxic): the documents' log odds without prior."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n, row, bucket in features(batch.column(1)):
                w = shared.value[bucket]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), batch.column(2).slice(a, n), batch.column(3).slice(a, n)]
                    + [pa.array(np.bincount(row, w[:, t], minlength=n)[:n] + shared.value[-1, t]) for t in range(len(TASKS))],
                    names=["doc_id", "host", "path", "w_quality", "w_toxic"],
                )

    site = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in (("source", "host"), ("lang", "path"))]
    return docs.select("doc_id", "text", *site).mapInArrow(run, f"doc_id {kind}, host string, path string, w_quality double, w_toxic double")


def strength(groups: DataFrame, n: str, good: str, rate: float) -> float:
    """How many labels the parent's rate is worth: from the spread of the groups' rates."""
    s = groups.filter(F.col(n) > 0).agg(
        F.count("*").alias("g"), F.sum(n).alias("n"), F.sum(F.col(n) * F.col(n)).alias("n2"),
        F.sum(F.col(n) * F.pow(F.col(good) / F.col(n) - rate, F.lit(2.0))).alias("ss"),
    ).first()
    noise = rate * (1 - rate)
    if not s.g or s.g < 2 or noise <= 0:
        return 1e6
    between = (s.ss - (s.g - 1) * noise) / max(s.n - s.n2 / s.n, 1e-9)
    return 1e6 if between <= noise / 1e6 else min(1e6, max(1.0, noise / between - 1))


def sites(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """(host, path, p_quality, p_toxic) of every labelled path, and the global rates."""
    place = docs.select("doc_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in (("source", "host"), ("lang", "path"))])
    rows = labels.select("doc_id", *TASKS).join(place, "doc_id")
    sums = [x for t in TASKS for x in (F.count(t).alias(f"n_{t}"), F.coalesce(F.sum(F.col(t).cast("long")), F.lit(0)).alias(f"g_{t}"))]
    paths = rows.groupBy("host", "path").agg(*sums)
    up = [F.sum(f"{x}_{t}").alias(f"{x}_{t}") for t in TASKS for x in "ng"]
    hosts = paths.groupBy("host").agg(*up)
    whole = hosts.agg(*up).first()
    rates = {t: (whole[f"g_{t}"] / whole[f"n_{t}"] if whole[f"n_{t}"] else 0.5) for t in TASKS}
    k_host = {t: strength(hosts, f"n_{t}", f"g_{t}", rates[t]) for t in TASKS}
    k_path = {t: strength(paths, f"n_{t}", f"g_{t}", rates[t]) for t in TASKS}
    up_to = lambda n, g, k, prior: (F.col(g) + k * prior) / (F.col(n) + k)
    host = hosts.select("host", *[up_to(f"n_{t}", f"g_{t}", k_host[t], F.lit(rates[t])).alias(f"h_{t}") for t in TASKS])
    path = paths.join(host, "host").select(
        "host", "path", *[up_to(f"n_{t}", f"g_{t}", k_path[t], F.col(f"h_{t}")).alias(f"s_{t}") for t in TASKS], *[f"h_{t}" for t in TASKS]
    )
    return path, {**rates, **{f"k_host_{t}": k_host[t] for t in TASKS}, **{f"k_path_{t}": k_path[t] for t in TASKS}}


def logit(p):
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def score(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000) -> DataFrame:
    """Per document: doc_id, host, path, site_quality, site_toxic, p_quality, p_toxic, kept
    (p_quality at least 0.5 and p_toxic below 0.5)."""
    weights = fit(docs, labels, train_rows)
    path, rates = sites(docs, labels)
    # one host may have a third of the documents: they meet SALTS copies of its few rows
    rows = evidence(docs, weights).withColumn("salt", F.pmod(F.xxhash64("doc_id", "w_quality"), F.lit(SALTS)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    rows = rows.join(path.select("host", "path", *[f"s_{t}" for t in TASKS], salts), ["host", "path", "salt"], "left")
    hosts = path.groupBy("host").agg(*[F.first(f"h_{t}").alias(f"h_{t}") for t in TASKS])
    rows = rows.join(hosts.select("*", salts), ["host", "salt"], "left")
    for t in TASKS:
        rows = rows.withColumn(f"site_{t}", F.coalesce(f"s_{t}", f"h_{t}", F.lit(rates[t])))
        rows = rows.withColumn(f"p_{t}", 1 / (1 + F.exp(-F.least(F.greatest(F.col(f"w_{t}") + logit(F.col(f"site_{t}")), F.lit(-50.0)), F.lit(50.0)))))
    kept = (F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5)
    return rows.select("doc_id", "host", "path", *[f"site_{t}" for t in TASKS], *[f"p_{t}" for t in TASKS], kept.alias("kept"))
