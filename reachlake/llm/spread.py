"""Lookups that stay balanced when one key holds a large part of the rows, and runs of sorted rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reachlake.llm.textvec import release_memory

# Ids that may be sent to every task to thin out a scan; 16 bytes each, so at most about 32 MB.
MAX_BROADCAST_IDS = 2_000_000


def lookup(big: DataFrame, small: DataFrame, keys: Sequence[str], count: str, rows: int) -> DataFrame:
    """Inner join of ``big`` with ``small``, which has one row per key and the key's rows in ``count``.

    Keys with more rows than a quarter of an even partition's share are joined by broadcast. As all
    keys together have ``rows`` rows, there are at most four of them per shuffle partition, whatever
    the data. All other keys meet in a usual join, none of which can fill a task. Give written tables:
    ``big`` and ``small`` are each read twice.
    """
    keys = list(keys)
    partitions = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = max(1, rows // (4 * partitions))
    hot = F.broadcast(small.where(F.col(count) > limit))
    cold = small.where(F.col(count) <= limit)
    return big.join(hot, keys).unionByName(
        big.join(F.broadcast(small.where(F.col(count) > limit).select(*keys)), keys, "left_anti").join(cold, keys))


def only_ids(rows: DataFrame, ids: DataFrame, key: str, n: int, inside: bool = True) -> DataFrame:
    """Rows whose ``key`` is in ``ids`` (a written table of ``n`` different ids), or is not."""
    other = F.broadcast(ids) if n <= MAX_BROADCAST_IDS else ids
    return rows.join(other, key, "left_semi" if inside else "left_anti")


def sorted_groups(stream, keys: Sequence[str], most: int = 1 << 62):
    """Tables with whole groups of rows with equal ``keys`` from batches sorted by them.

    A table ends where a group ends, once it has ``most`` rows; yields ``(table, first)`` with the
    places where groups begin and the number of rows at the end.
    """
    held: list[pa.RecordBatch] = []

    def cut(table):
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    for batch in stream:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        first = cut(table)
        if len(first) > 2:
            done = table.slice(0, first[-2])
            yield done, first[:-1]
            held = table.slice(first[-2]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, cut(table)
    held, table = [], None
    release_memory()


def sample_per_key(rows: DataFrame, key: str, ident: str, most: int) -> DataFrame:
    """``key, ident, n``: up to ``most`` rows of each key in the order of their ids' hashes, numbered from 1.

    Hashes above one and a half times a key's share are dropped where they are read, so that no key
    brings more than about that many rows to a task. ``rows`` has few different keys and is read twice.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    share = F.least(F.lit(1.0), F.lit(1.5 * most) / F.col("_rows")) * (1 << 30)
    some = rows.join(F.broadcast(counts), key).where(F.pmod(F.xxhash64(ident), F.lit(1 << 30)) <= share)
    order = Window.partitionBy(key).orderBy(F.xxhash64(ident), ident)
    return some.select(key, ident, F.row_number().over(order).alias("n")).where(F.col("n") <= most)
