"""Joins and ordered scans that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reachlake.session import written

# A key with more rows than this is spread over several tasks.
DEFAULT_HOT_ROWS = 1_000_000
# At most so many keys are salted; a key must hold more than rows / MAX_HOT_KEYS for it, which only
# matters beyond two million times the row limit. The table of hot keys is broadcast, and so bounded.
MAX_HOT_KEYS = 2_000_000


def _setting(spark: SparkSession, name: str, default: int) -> int:
    return int(spark.conf.get(name, str(default)))


def hot_row_limit(spark: SparkSession) -> int:
    return _setting(spark, "reachlake.hot.rows", DEFAULT_HOT_ROWS)


# Keys are counted by so many hashes first, which shuffles a bounded number of rows a task.
COUNTED_HASHES = 1 << 16


def rows_and_bound(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """The number of rows, and one that no key has more rows than."""
    if not keys:
        n = df.count()
        return n, n
    by_hash = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(COUNTED_HASHES)).alias("_h")).count()
    top = by_hash.agg(F.sum("count").alias("n"), F.max("count").alias("m")).first()
    return top["n"] or 0, top["m"] or 0


def any_hot(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether some key is above the row limit; keys are only counted one by one if their hashes leave it open."""
    limit = hot_row_limit(df.sparkSession)
    if rows_and_bound(df, keys)[1] <= limit:
        return False
    return not keys or df.groupBy(*keys).count().agg(F.max("count")).first()[0] > limit


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Keys above the row limit with their ``_salts``, or None. At most ``MAX_HOT_KEYS`` rows."""
    return hot_keys_and_rows(df, keys)[0]


def hot_keys_and_rows(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame | None, int]:
    """:func:`hot_keys` and the number of rows, from one pass.

    A key gets as many salts as its rows hold the limit, and one more.
    """
    limit = hot_row_limit(df.sparkSession)
    rows, most = rows_and_bound(df, keys)
    if most <= limit:
        return None, rows
    counts = df.groupBy(*keys).count()
    if counts.agg(F.max("count")).first()[0] <= limit:
        return None, rows
    bound = max(limit, rows // MAX_HOT_KEYS)
    salts = (F.ceil(F.col("count") / bound) + 1).cast("int").alias("_salts")
    return written(counts.where(F.col("count") > bound).select(*keys, salts), "hot"), rows


def with_salt(df: DataFrame, keys: Sequence[str], hot: DataFrame, spread: Sequence[str]) -> DataFrame:
    """Column ``_salt``: 0 for usual keys, a hash of ``spread`` for hot ones."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.col("_salts").cast("long")).cast("int")
    return (
        df.join(F.broadcast(hot), list(keys), "left")
        .withColumn("_salt", F.coalesce(salt, F.lit(0)))
        .drop("_salts")
    )


def with_all_salts(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """Repeat rows with a hot key once per salt, the other side of :func:`with_salt`."""
    last = F.coalesce(F.col("_salts") - 1, F.lit(0))
    return (
        df.join(F.broadcast(hot), list(keys), "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
        .drop("_salts")
    )


def salted_join(
    big: DataFrame, other: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which hot keys of ``big`` are split over tasks by a hash of ``spread``.

    ``how`` may be inner, left, left_semi or left_anti, all exact because every row of ``big``
    meets the whole of ``other`` for its key. In an inner join hot keys of ``other`` are split where
    ``big`` has none.
    """
    keys = list(keys)
    hot = hot_keys(big, keys)
    if hot is None and how == "inner" and (hot := hot_keys(other, keys)) is not None:
        rest = [c for c in other.columns if c not in keys]
        right = with_salt(other, keys, hot, rest or keys)
        return with_all_salts(big, keys, hot).join(right, [*keys, "_salt"]).drop("_salt")
    if hot is None:
        return big.join(other, keys, how)
    left = with_salt(big, keys, hot, spread)
    right = with_all_salts(other, keys, hot)
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


class OrderedScan:
    """Row index, lag, lead, running sum and gap filling per key in a given order.

    When no key is above the row limit these are plain window functions. Otherwise rows are range
    partitioned by ``(keys, order)``, each range is scanned on its own, and a summary with one row
    per key and range carries totals and edge values from one range to the next, so a key of any
    size is spread over all tasks. ``order`` must not tie within a key. ``blocked`` says which of the
    two it is where that is known.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], blocked: bool | None = None):
        self.keys = list(keys)
        self.order = list(order)
        self.blocked = any_hot(df, self.keys) if blocked is None else blocked
        if self.blocked:
            n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            ranged = df.repartitionByRange(n, *self.keys, *self.order)
            df = written(ranged.withColumn("_block", F.spark_partition_id()), "ranges")
        self.df = df
        self._local: dict[str, Column] = {}
        self._carry: dict[str, tuple[Column, Column]] = {}
        self._final: dict[str, Column] = {}

    @property
    def _win(self):
        part = [*self.keys, "_block"] if self.blocked else self.keys
        return W.partitionBy(*part).orderBy(*self.order)

    def _order_key(self) -> Column:
        return F.struct(*[F.col(c) for c in self.order])

    def index(self, name: str) -> "OrderedScan":
        """0-based position within the key."""
        self._local[name] = (F.row_number().over(self._win) - 1).cast("long")
        if self.blocked:
            self._carry[name] = (F.count(F.lit(1)), None)
            self._final[name] = F.col(name) + F.coalesce(F.col(f"_c_{name}"), F.lit(0))
        return self

    def running_sum(self, name: str, value: Column) -> "OrderedScan":
        rows = self._win.rowsBetween(W.unboundedPreceding, W.currentRow)
        self._local[name] = F.sum(value).over(rows)
        if self.blocked:
            self._carry[name] = (F.sum(value), None)
            self._final[name] = F.col(name) + F.coalesce(F.col(f"_c_{name}"), F.lit(0))
        return self

    def running_max(self, name: str, value: Column) -> "OrderedScan":
        rows = self._win.rowsBetween(W.unboundedPreceding, W.currentRow)
        self._local[name] = F.max(value).over(rows)
        if self.blocked:
            self._carry[name] = (F.max(value), "max")
            self._final[name] = F.greatest(F.col(name), F.col(f"_c_{name}"))
        return self

    def lag(self, name: str, value: Column) -> "OrderedScan":
        """Value of the row before, null on the first row of the key."""
        return self._edge(name, value, F.lag, F.max_by, "prev")

    def lead(self, name: str, value: Column) -> "OrderedScan":
        """Value of the row after, null on the last row of the key."""
        return self._edge(name, value, F.lead, F.min_by, "next")

    def _edge(self, name, value, shift, pick, side) -> "OrderedScan":
        boxed = F.struct(value.alias("v"))
        self._local[name] = shift(boxed).over(self._win)
        if self.blocked:
            self._carry[name] = (pick(boxed, self._order_key()), side)
            self._final[name] = F.coalesce(F.col(name), F.col(f"_c_{name}"))["v"]
        else:
            self._final[name] = F.col(name)["v"]
        return self

    def fill_next(self, name: str, value: Column) -> "OrderedScan":
        """First non-null value at or after the row."""
        # Read from the end: a window that reaches to the end of the key is worked out anew for every row.
        part = [*self.keys, "_block"] if self.blocked else self.keys
        back = W.partitionBy(*part).orderBy(*[F.desc(c) for c in self.order])
        self._local[name] = F.last(value, ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, W.currentRow))
        if self.blocked:
            first = F.min_by(value, F.when(value.isNotNull(), self._order_key()))
            self._carry[name] = (first, "fill_next")
            self._final[name] = F.coalesce(F.col(name), F.col(f"_c_{name}"))
        return self

    def frame(self) -> DataFrame:
        out = self.df.select("*", *[c.alias(n) for n, c in self._local.items()])
        if self.blocked:
            parts = self.df.groupBy(*self.keys, "_block").agg(
                *[c.alias(f"_a_{n}") for n, (c, _) in self._carry.items()]
            )
            # One row per key and range: at most as many rows per key as there are ranges.
            by = W.partitionBy(*self.keys).orderBy("_block")
            before = by.rowsBetween(W.unboundedPreceding, -1)
            after = by.rowsBetween(1, W.unboundedFollowing)
            over = {
                None: lambda c: F.sum(c).over(before),
                "max": lambda c: F.max(c).over(before),
                "prev": lambda c: F.lag(c).over(by),
                "next": lambda c: F.lead(c).over(by),
                "fill_next": lambda c: F.first(c, ignorenulls=True).over(after),
            }
            carry = parts.select(
                *self.keys,
                "_block",
                *[over[s](F.col(f"_a_{n}")).alias(f"_c_{n}") for n, (_, s) in self._carry.items()],
            )
            out = out.join(carry, [*self.keys, "_block"])
        keep = [c for c in self.df.columns if c != "_block"]
        made = [self._final.get(n, F.col(n)).alias(n) for n in self._local]
        return out.select(*keep, *made)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the last row of every key in ``order``; partial aggregation, no group is gathered."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_r")
    return df.groupBy(*keys).agg(pick).select(*keys, "_r.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_r")
    return df.groupBy(*keys).agg(pick).select(*keys, "_r.*").select(*df.columns)


def in_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], item: Column,
              size: int = 1000, name: str = "items") -> DataFrame:
    """Ordered lists per key in numbered pieces of at most ``size`` items.

    A key with few rows gives one piece that holds its whole list; no list grows without bound.
    """
    rows = OrderedScan(df, keys, order).index("_i").frame()
    pairs = F.sort_array(F.collect_list(F.struct(F.col("_i"), item.alias("v"))))
    return (
        rows.groupBy(*keys, F.floor(F.col("_i") / size).cast("long").alias("piece"))
        .agg(F.transform(pairs, lambda p: p["v"]).alias(name))
    )
