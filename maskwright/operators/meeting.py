"""Rows of a document meet its values in one sorted stream.

Both sides are dealt out by ``doc_id`` and sorted , a document's values before its rows. A task reads the values once, makes what it needs of them
(an automaton, say) and holds that while the document's rows pass: the values aren't copied to each row, as a join would, and no document's rows
are held together. ``salt`` spreads a document of very many rows over so many tasks, each of which gets its values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def small(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most`` bytes, as a batch has so many rows however long their texts."""
    for batch in batches:
        n = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for i in range(0, batch.num_rows, n):
            yield batch.slice(i, n)


def plain(array: pa.Array) -> list:
    """``array.to_pylist()`` column by column, as that makes an object of Arrow's own for each value first."""
    kind = array.type
    if pa.types.is_struct(kind):
        names = [f.name for f in kind]
        rows = [dict(zip(names, x)) for x in zip(*map(plain, array.flatten()))] if names else [{}] * len(array)
        return [x if valid else None for x, valid in zip(rows, plain(array.is_valid()))] if array.null_count else rows
    if pa.types.is_list(kind):
        items, lengths = plain(array.flatten()), plain(array.value_lengths())
        ends = accumulate(n or 0 for n in lengths)
        return [None if n is None else items[end - n : end] for n, end in zip(lengths, ends)]
    if pa.types.is_integer(kind) or pa.types.is_floating(kind):
        if not array.null_count:
            return array.to_numpy(zero_copy_only=False).tolist()
        return [x if valid else None for x, valid in zip(plain(array.fill_null(0)), plain(array.is_valid()))]
    if pa.types.is_string(kind) or pa.types.is_boolean(kind):
        return array.to_numpy(zero_copy_only=False).tolist()
    return array.to_pylist()


def meet(rows: DataFrame, values: DataFrame, make: Callable[[list[dict]], object], use: Callable[..., list[tuple]], read: list[str], add: T.StructType, keep: list[str] | None = None, salt: int = 1, left: bool = True) -> DataFrame:
    """``rows`` with the columns of ``add``, which replace those of their names.

    make(entries): what is held for a document, of its rows of ``values`` (in order of their columns). use(held, *row): the values of ``add``, in its order, for each
    result row of a row, of which it gets the columns ``read``; held is None where a document has no values. left: such rows are results too (with what ``use`` gives), else they go.
    A null doc_id has no values.
    """
    keep = [c for c in (rows.columns if keep is None else keep) if c not in add.fieldNames()]
    of = [c for c in values.columns if c != "doc_id"]
    number = F.pmod(F.xxhash64(*rows.columns), F.lit(salt)).cast("int") if salt > 1 else F.lit(0)
    passed = list(dict.fromkeys([*keep, *read]))
    row = rows.select(F.col("doc_id").alias("_key"), number.alias("_salt"), F.struct(*passed).alias("_row"))
    # one row for a document's values, so that the salt repeats and the sort moves as many rows as there are documents
    listed = F.sort_array(F.collect_list(F.struct(*of))).alias("_entry")
    entry = values.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_key")).agg(listed)
    entry = entry.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))) if salt > 1 else F.lit(0))
    both = entry.unionByName(row, allowMissingColumns=True)
    both = both.repartition("_key", "_salt").sortWithinPartitions("_key", "_salt", F.col("_entry").isNull())
    to = T.StructType([*[rows.schema[c] for c in keep], *add.fields])
    to = T.StructType([T.StructField(f.name, f.dataType, True) for f in to.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(to)
        key, entries, held, ready = None, [], None, False
        for batch in small(batches):
            of_row = batch.column("_row")
            listed = iter(plain(batch.column("_entry").drop_null()))
            take, new = [], []
            keys = zip(plain(batch.column("_key")), plain(batch.column("_salt")), strict=True)
            for i, (k, is_row, row) in enumerate(zip(keys, plain(of_row.is_valid()), zip(*[plain(of_row.field(c)) for c in read], strict=True), strict=True)):
                if k != key:
                    key, entries, ready = k, [], False
                if not is_row:
                    entries = next(listed)
                    continue
                if not ready:
                    held, ready = make(entries) if entries else None, True
                    entries = []
                if left or held is not None:
                    for x in use(held, *row):
                        take.append(i)
                        new.append(x)
            places = pa.array(take, pa.int64())
            old = [of_row.field(c).take(places).cast(kinds.field(c).type) for c in keep]
            made = zip(*new, strict=True) if new else [()] * len(add)
            yield pa.RecordBatch.from_arrays([*old, *[pa.array(x, kinds.field(f.name).type) for x, f in zip(made, add.fields, strict=True)]], schema=kinds)

    return both.select("_key", "_salt", "_row", "_entry").mapInArrow(run, to)
