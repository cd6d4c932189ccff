"""Hard negatives of anchors by score windows, with bounds that travel along a spanning tree of the anchors.

Anchors are grouped by their nearest pivot, and every group gets a minimum spanning tree. All rows are
dealt into slabs; each slab's task reads its rows and then one group of anchors after the other. At the
root of a tree all scores are worked out. From a parent with the score ``s`` of a row, or bounds of it,
the child's score of that row is within ``s`` plus or minus the length of the tree's edge times the
row's norm, as (child - parent) . row is at most that. Only rows whose bounds reach into a window that is
still open are scored again, exactly, in integers. A first pass finds the positives of each anchor, a
second one the negatives in the window of each positive; a slab hands on the few best of each window.

Vectors are compared as integers, floor(scale * x), cut off at +-2^27. A row takes part if its id, its
label and all components are there and finite; rows that are equal in all three count once, rows with
one id but other contents are rows of their own, and an anchor's other rows are those with other ids.
Vectors of unequal lengths are compared over the shorter one. Ties go to the smaller id. An anchor
without a positive, or a positive without a negative, gives no row, an empty table an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reachlake.llm.spread import sorted_groups
from reachlake.llm.textvec import kept_columns, release_memory
from reachlake.session import written, written_with_count

POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100  # the window of a negative's score, in hundredths of the positive's
SCALE = 256.0
PIVOTS, GROUP = 64, 512  # pivots, and anchors of a group on average at most
BLOCK = 2048  # rows of a slab that are scored at once
SLAB_ROWS = 262_144  # rows of a slab at most, on average
LEAST_SLAB = 4096  # smaller slabs aren't made for the sake of more tasks
CUT = 1 << 27
OPEN = np.iinfo(np.int64).min


def usable(vector: Column) -> Column:
    """Vectors that are there, with finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.greatest(F.lit(-CUT), F.least(F.lit(CUT), F.floor(F.lit(SCALE) * x.cast("double")))).cast("int"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of integers as rows, short ones filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = lists.value_lengths().to_numpy().astype(np.int64)
    flat = lists.flatten().to_numpy()
    out = np.zeros((len(lists), int(size.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(lists)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def products(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Exact inner products; in doubles where these hold every sum."""
    d = min(rows.shape[1], len(vector))
    rows, vector = rows[:, :d], vector[:d]
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(vector).max(initial=0)) * max(d, 1)
    if rows.dtype == np.float64 and most >= 2**53:
        rows = rows.astype(np.int64)
    return (rows @ vector.astype(rows.dtype)).astype(np.int64)


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, parent (a place in that order, -1 for the root) and edge length of a minimum spanning tree."""
    x = x.astype(np.float64)
    square = (x * x).sum(axis=1)
    far = np.maximum(0.0, square[:, None] + square[None, :] - 2 * (x @ x.T))
    root = int(np.argmin(np.sqrt(far).sum(axis=1)))
    order, place, parent = [root], {root: 0}, [-1]
    near, nearest = far[root].copy(), np.full(len(x), root)
    near[root] = np.inf
    while len(order) < len(x):
        k = int(np.argmin(near))
        place[k] = len(order)
        order.append(k)
        parent.append(place[int(nearest[k])])
        closer = far[k] < near
        closer[order] = False
        near[closer], nearest[closer] = far[k][closer], k
        near[k] = np.inf
    order = np.array(order)
    up = np.array(parent)
    edge = np.sqrt(((x[order] - x[order[np.maximum(up, 0)]]) ** 2).sum(axis=1))
    return order, up, edge


class Best:
    """The first few (score, id) by falling score, then rising id."""

    def __init__(self, most: int):
        self.most = most
        self.score = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ident: np.ndarray) -> None:
        if len(score):
            score, ident = np.append(self.score, score), np.append(self.id, ident)
            first = np.lexsort((ident, -score))[: self.most]
            self.score, self.id = score[first], ident[first]

    @property
    def least(self) -> int:
        """The score that a further row must reach."""
        return int(self.score[-1]) if len(self.score) == self.most else OPEN


class Anchors:
    """A group of anchors in the order of its tree, with the windows that are open for each."""

    def __init__(self, rows: pa.Table, negatives: bool):
        self.id, self.label = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        self.x = matrix(rows.column("vec"))
        self.parent, self.edge = rows.column("parent").to_numpy(), rows.column("edge").to_numpy()
        self.negatives = negatives
        targets = rows.column("targets").to_pylist() if negatives else [[None]] * len(self.id)
        # Of each window: lowest and highest score, and the best found.
        self.windows = [[(OPEN, None, Best(POSITIVES)) if t is None else (-((-LOW * t) // 100), (HIGH * t) // 100, Best(NEGATIVES))
                         for t in row or []] for row in targets]

    def meet(self, ident: np.ndarray, label: np.ndarray, x: np.ndarray, norm: np.ndarray) -> int:
        """Take in a block of rows; returns how many scores were worked out."""
        g, m = len(self.id), len(ident)
        low, high = np.empty((g, m)), np.empty((g, m))
        scored = 0
        for k in range(g):
            up = self.parent[k]
            if up < 0:
                wide = np.ones(m, bool)
            else:
                reach = self.edge[k] * norm
                reach += 1 + 1e-9 * (reach + np.abs(low[up]))
                low[k], high[k] = low[up] - reach, high[up] + reach
                wide = np.zeros(m, bool)
                for least, most, best in self.windows[k]:
                    reaches = high[k] >= max(least, best.least)
                    wide |= reaches if most is None else reaches & (low[k] <= most)
                other = label != self.label[k]
                wide &= other if self.negatives else ~other & (ident != self.id[k])
            at = np.flatnonzero(wide)
            scored += len(at)
            if not len(at):
                continue
            score = products(x if len(at) == m else x[at], self.x[k])
            low[k, at] = high[k, at] = score
            fits = label[at] != self.label[k] if self.negatives else (label[at] == self.label[k]) & (ident[at] != self.id[k])
            score, who = score[fits], ident[at][fits]
            for least, most, best in self.windows[k]:
                inside = score >= max(least, best.least)
                if most is not None:
                    inside &= score <= most
                best.add(score[inside], who[inside])
        return scored


FOUND = pa.schema([("gid", pa.int64()), ("at", pa.int32()), ("target", pa.int32()), ("other", pa.int64()), ("score", pa.int64())])


def scan(negatives: bool):
    """Arrow job over rows sorted by slab, anchors after the slab's rows, and these by group and place."""

    def found(anchors: Anchors, gid: int) -> pa.RecordBatch:
        out = [[], [], [], []]
        for k, windows in enumerate(anchors.windows):
            for j, (_, _, best) in enumerate(windows):
                for col, v in zip(out, (np.full(len(best.id), k), np.full(len(best.id), j), best.id, best.score)):
                    col.append(v)
        at, target, other, score = (np.concatenate([np.zeros(0, np.int64), *c]) for c in out)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), gid)), pa.array(at.astype(np.int32)), pa.array(target.astype(np.int32)), pa.array(other), pa.array(score)],
            schema=FOUND)

    def run(stream):
        slab, blocks = None, []
        for table, first in sorted_groups(stream, ["slab", "gid", "part"]):
            for a, b in zip(first[:-1], first[1:]):
                rows = table.slice(a, b - a)
                if rows.column("slab")[0].as_py() != slab:
                    slab, blocks = rows.column("slab")[0].as_py(), []
                gid = rows.column("gid")[0].as_py()
                if gid < 0:
                    x = matrix(rows.column("vec")).astype(np.float64)
                    blocks.append((rows.column("id").to_numpy(), rows.column("label").to_numpy(), x, np.sqrt((x * x).sum(axis=1))))
                    continue
                anchors = Anchors(rows, negatives)
                for block in blocks:
                    anchors.meet(*block)
                yield found(anchors, gid)
        blocks = []
        release_memory()

    return run


def grouped_anchors(anchors: DataFrame) -> DataFrame:
    """``gid, at, id, label, vec, parent, edge``: anchors near to one another, each group as a tree."""
    order = F.xxhash64("id", "vec", "label")
    pivots = [np.array(r["vec"], np.float64) for r in anchors.orderBy(order, "id").limit(PIVOTS).collect()]
    width = max((len(p) for p in pivots), default=0)
    centre = np.array([np.pad(p, (0, width - len(p))) for p in pivots]).reshape(len(pivots), width)

    def nearest(stream):
        for batch in stream:
            x = matrix(batch.column("vec"))[:, :width].astype(np.float64)
            c = centre[:, : x.shape[1]]
            far = (centre * centre).sum(axis=1)[None, :] - 2 * (x @ c.T)
            yield batch.append_column("cell", pa.array(far.argmin(axis=1).astype(np.int64)))

    fields = "id long, label long, vec array<int>"
    dealt = written(anchors.select("id", "label", "vec").mapInArrow(nearest, f"{fields}, cell long"), "anchors")
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))  # PIVOTS rows at most
    gid = F.col("cell") * (1 << 40) + F.pmod(order, F.col("parts"))
    grouped = dealt.join(F.broadcast(sizes), "cell").select(gid.alias("gid"), "id", "label", "vec")

    def tree(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("id", "ascending"), ("label", "ascending")])
        order, parent, edge = spanning_tree(matrix(rows.column("vec")))
        rows = rows.take(pa.array(order))
        return (rows.append_column("at", pa.array(np.arange(len(order), dtype=np.int32)))
                .append_column("parent", pa.array(parent.astype(np.int32))).append_column("edge", pa.array(edge)))

    return grouped.groupBy("gid").applyInArrow(tree, f"gid long, {fields}, at int, parent int, edge double")


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` is a condition on the column ``id``. Of each anchor the ``POSITIVES`` best other rows of
    its label count, of each positive the ``NEGATIVES`` best rows of other labels whose score is from
    ``LOW`` to ``HIGH`` hundredths of the positive's. Labels are integers.
    """
    rows = kept_columns(vectors, {"id": id_col, "vector": vector_col, "label": label_col})
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    rows = rows.select(F.col("id").cast("long"), F.col("label").cast("long"), quantised(F.col("vector")).alias("vec"))
    rows, n = written_with_count(rows.groupBy("id", "label", "vec").agg(F.lit(0).alias("_")).drop("_"), "vectors")
    anchors = written(grouped_anchors(rows.where(anchor)), "anchor-trees")

    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slabs = max(1, -(-n // SLAB_ROWS), min(partitions, n // LEAST_SLAB))
    place = F.xxhash64("id", "label", "vec")
    blocks = max(1, -(-n // (slabs * BLOCK)))
    none = F.lit(None)
    dealt = rows.select(
        F.pmod(place, F.lit(slabs)).cast("int").alias("slab"), F.lit(-1).cast("long").alias("gid"),
        F.pmod(F.xxhash64(place), F.lit(blocks)).cast("int").alias("part"), none.cast("int").alias("at"), "id", "label", "vec",
        none.cast("int").alias("parent"), none.cast("double").alias("edge"), none.cast("array<long>").alias("targets"))

    def search(with_targets: DataFrame, negatives: bool, label: str) -> DataFrame:
        asking = with_targets.select(
            F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"), "gid", F.lit(0).alias("part"), "at", "id", "label", "vec",
            "parent", "edge", "targets")
        together = dealt.unionByName(asking).repartition(slabs, "slab").sortWithinPartitions("slab", "gid", "part", "at")
        hits = together.mapInArrow(scan(negatives), "gid long, at int, target int, other long, score long")
        best = Window.partitionBy("gid", "at", "target").orderBy(F.desc("score"), "other")
        most = NEGATIVES if negatives else POSITIVES
        return written(hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most), label)

    positives = search(anchors.withColumn("targets", none.cast("array<long>")), False, "positives")
    scores = F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"])
    asked = anchors.join(positives.groupBy("gid", "at").agg(scores.alias("targets")), ["gid", "at"])
    negatives = search(asked, True, "negatives")
    pairs = positives.join(anchors.select("gid", "at", F.col("id").alias("anchor_id")), ["gid", "at"]).select(
        "gid", "at", (F.col("rank") - 1).alias("target"), "anchor_id", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(pairs, ["gid", "at", "target"]).select(
        "anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", moved), F.col("id") % 100 == 0)


SQL = """
with rows as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) q from embeddings
    where vec_id is not null and label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (select a.vec_id anchor_id, b.vec_id other, a.label = b.label same, cast(list_inner_product(a.q, b.q) as bigint) score
    from rows a join rows b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positives as (select anchor_id, other positive_id, score positive_score from scores where same
    qualify row_number() over (partition by anchor_id order by score desc, other) <= 5),
found as (select p.*, n.other negative_id, n.score negative_score,
        row_number() over (partition by p.anchor_id, positive_id order by n.score desc, n.other) k
    from positives p join scores n on n.anchor_id = p.anchor_id and not same
        and 80 * positive_score <= 100 * n.score and n.score <= positive_score)
select anchor_id, positive_id, cast(k as int) rank, negative_id, positive_score, negative_score from found where k <= 5"""
