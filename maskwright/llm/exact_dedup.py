r"""Exact deduplication by Grace hash partitioning.

Texts are equal when they are identical after every character of
``[\x20\x09-\x0D]`` is deleted. The work:

1. *Digest* every document (SHA-256 of the normalised text, its size in bytes and
   code points) into a small table in the shared folder.
2. *Collapse before the shuffle*: each map task keeps an open-addressing table
   (Python's ``dict``: probing on hash, equality on the complete content) of bounded size and
   sends one record for each distinct content with a count and the best row so far, so a
   group of copies of any size costs each bucket at most a few records per map task.
3. *Partition*: records are dealt out and sorted by bucket (a hash of the digest; so many that
   they are a quarter full on average and few outgrow ``bucket_bytes``). A task takes its buckets one
   after the other.
4. *Merge* each bucket in a table of its own, comparing complete contents. A bucket that outgrows
   ``bucket_bytes`` is spilled: its records, merged so far, go to a spill table in the shared
   folder, and from there to smaller buckets by other bits in a further pass, until every
   bucket fits or holds one content. Two contents with one digest stop the job instead of
   being merged.
5. Groups of two or more rows are joined back to the digest table.

The row with the most code points in the original text, then the smallest doc_id,
stays; of rows alike in both, exactly one. Null texts count as empty, and all empty ones are
equal. Null doc_ids rank after others. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import spread, written

SPACES = b" \t\n\x0b\x0c\r"
FAN = 16  # parts of a spilled bucket
FILL = 4  # times the room that all bytes need
BATCH_BYTES = 4 << 20  # of contents that go on to a further pass


def digests(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_chars, n_bytes, sha): one row for each document, numbered."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            flat = [x.translate(None, SPACES) for x in text.cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pc.utf8_length(text).cast(pa.int64()),
                    pa.array([len(x) for x in flat], pa.int64()),
                    pa.array([hashlib.sha256(x).digest() for x in flat], pa.binary()),
                ],
                names=["doc_id", "n_chars", "n_bytes", "sha"],
            )

    rows = docs.select("doc_id", "text").mapInArrow(digest, f"doc_id {kind}, n_chars long, n_bytes long, sha binary")
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "digests")


_RECORD = "bucket long, sha binary, content binary, n long, best_chars long, best_id {kind}"
_NAMES = ["bucket", "sha", "content", "n", "best_chars", "best_id"]


def _better(a: tuple, b: tuple) -> tuple:
    """The row that stays of two (code points, doc_id)."""
    if a[0] != b[0]:
        return a if a[0] > b[0] else b
    if a[1] is None or b[1] is None:
        return b if a[1] is None else a
    return a if a[1] <= b[1] else b


def _records(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), kind]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=_NAMES)


def collapsed(docs: DataFrame, table_bytes: int = 8 << 20) -> DataFrame:
    """Records of distinct contents, as far as a map task sees them: no bucket yet."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, ids = {}, 0, None
        rows = lambda: _records([(None, sha, flat, n, *best) for flat, (sha, n, best) in table.items()], ids)
        for batch in batches:
            ids = batch.schema.field(0).type
            text = pc.fill_null(batch.column(1), "")
            for key, size, raw in zip(batch.column(0).to_pylist(), pc.utf8_length(text).to_pylist(), text.cast(pa.large_binary()).to_pylist()):
                flat = raw.translate(None, SPACES)
                if flat in table:
                    sha, count, best = table[flat]
                    table[flat] = (sha, count + 1, _better(best, (size, key)))
                else:
                    table[flat] = (hashlib.sha256(flat).digest(), 1, (size, key))
                    held += len(flat) + 300
                    if held > table_bytes:
                        yield rows()
                        table, held = {}, 0
        if table:
            yield rows()

    return docs.select("doc_id", "text").mapInArrow(collapse, _RECORD.format(kind=kind))


def merged(records: DataFrame, bucket_bytes: int) -> DataFrame:
    """Of records dealt out and sorted by bucket: the groups (no content, two rows or more) and the
    records of buckets that outgrow ``bucket_bytes``, merged as far as memory went."""
    kind = records.schema["best_id"].dataType.simpleString()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, by_sha, held, bucket, spilled, out, waiting, ids = {}, {}, 0, None, False, [], 0, None
        for batch in batches:
            ids = batch.schema.field(5).type
            for own, sha, content, count, size, key in zip(*(c.to_pylist() for c in batch.columns)):
                if own != bucket:
                    out += [(bucket, sha_, None, n, *best) for sha_, n, best in table.values() if n > 1]
                    table, by_sha, held, bucket, spilled = {}, {}, 0, own, False
                if spilled:
                    out.append((own, sha, content, count, size, key))
                    waiting += len(content)
                elif content in table:
                    _, had, best = table[content]
                    table[content] = (sha, had + count, _better(best, (size, key)))
                else:
                    if by_sha.setdefault(sha, content) is not content:
                        raise ValueError(f"two contents have the digest {sha.hex()}")
                    table[content] = (sha, count, (size, key))
                    held += len(content) + 300
                    if held > bucket_bytes and len(table) > 1:
                        out += [(own, sha_, flat, n, *best) for flat, (sha_, n, best) in table.items()]
                        waiting += held
                        table, by_sha, spilled = {}, {}, True
                if len(out) >= 1000 or waiting > BATCH_BYTES:
                    yield _records(out, ids)
                    out, waiting = [], 0
        out += [(bucket, sha_, None, n, *best) for sha_, n, best in table.values() if n > 1]
        if out:
            yield _records(out, ids)

    return records.mapInArrow(merge, _RECORD.format(kind=kind))


def duplicate_groups(docs: DataFrame, n_bytes: int, bucket_bytes: int = 32 << 20) -> DataFrame:
    """(sha, group_size, keep_id, keep_chars) of every distinct content that two or more rows have."""
    parts, level = spread(docs), 0
    records = collapsed(docs).withColumn("bucket", F.pmod(F.xxhash64("sha"), F.lit(max(FILL * parts, -(-FILL * n_bytes // bucket_bytes)))))
    found = []
    while True:
        passed = written(merged(records.repartition(parts, "bucket").sortWithinPartitions("bucket"), bucket_bytes), "spill")
        found.append(passed.filter("content is null"))
        records = passed.filter("content is not null")
        if not records.head(1):
            break
        level += 1
        records = records.withColumn("bucket", F.xxhash64("bucket", F.lit(level), F.pmod(F.xxhash64("sha", F.lit(level)), F.lit(FAN))))
    groups = functools.reduce(DataFrame.unionByName, found)
    return groups.select("sha", F.col("n").alias("group_size"), F.col("best_id").alias("keep_id"), F.col("best_chars").alias("keep_chars"))


def deduplicate(docs: DataFrame, bucket_bytes: int = 32 << 20) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = digests(docs)
    groups = duplicate_groups(docs, keys.agg(F.sum("n_bytes")).first()[0] or 0, bucket_bytes)
    rows = keys.select("row", "doc_id", "n_chars", "sha")
    # the row that stays is one of these; all but a few groups have one of them. The doc_id is in the key, so that the copies of a text aren't one key
    same = (rows["sha"] == groups["sha"]) & rows["doc_id"].eqNullSafe(groups["keep_id"]) & (rows["n_chars"] == groups["keep_chars"])
    first = rows.join(groups, same).groupBy(rows["sha"]).agg(F.min("row").alias("first"))
    known = written(groups.join(first, "sha"), "groups")
    alone = F.col("group_size").isNull()
    return rows.join(known, "sha", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | F.coalesce(F.col("row") == F.col("first"), F.lit(False))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )
