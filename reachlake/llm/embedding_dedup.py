"""Near-duplicate embeddings by search in a robust-pruned flat graph that is built on overlapping shards.

Vectors with equal labels are dealt into shards around pivots, each into the shards of its nearest
ones. Every shard's members get a robust-pruned adjacency list, the lists of a vector from all its
shards are joined, and each vector is searched for in its shards from itself and the medoids of the
graph's parts: the best members found are expanded, and all that lie within the range always, with
lists that hold every member within the range. So two members of one shard that link are always
found. Links are verified in double precision, and recall is audited against brute force.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlake.llm.spread import lookup, sorted_groups
from reachlake.llm.textvec import kept_columns
from reachlake.operators.graph.components import connected_components
from reachlake.session import written, written_with_count

LEAST_COSINE = 0.98
SHARD_CAP, SHARD_TARGET, OVERLAP, LEVELS = 768, 192, 3, 3
MAX_SAMPLE = 40_000  # vectors that the driver picks pivots from, at most, in each level
NEAREST, DEGREE, ALPHA, BEAM = 48, 20, 1.2, 32
AUDITED = 300  # queries of the recall audit, at most


def usable(vector, label):
    """Labelled vectors of finite components that are not all zero."""
    good = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(label.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: pa.Array) -> np.ndarray:
    """Rows scaled to length 1 in double precision; all of one length."""
    x = vectors.flatten().to_numpy().astype(np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def robust_prune(x: np.ndarray) -> np.ndarray:
    """``[members, DEGREE]`` neighbours, -1 where there are fewer.

    From its nearest members each takes the nearest one left, which rules out those that are ALPHA
    times nearer to it than to the member itself.
    """
    m = len(x)
    sims = x @ x.T
    np.fill_diagonal(sims, -np.inf)
    k = min(NEAREST, m - 1)
    if k < 1:
        return np.full((m, DEGREE), -1)
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, axis=1), axis=1, kind="stable"), axis=1)
    own = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sims, near, axis=1)))
    left = np.ones((m, k), bool)
    out = np.full((m, DEGREE), -1)
    rows = np.arange(m)
    for d in range(DEGREE):
        some = left.any(axis=1)
        if not some.any():
            break
        pick = left.argmax(axis=1)
        chosen = near[rows, pick]
        out[some, d] = chosen[some]
        between = np.sqrt(np.maximum(0, 2 - 2 * np.maximum(sims[chosen[:, None], near], -1)))
        left &= ALPHA * between > own
        left[rows, pick] = False
    return out


def lowest_reached(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of ``m`` members that each hangs together with by the pairs ``a, b``."""
    low = np.arange(m)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def cosines(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair, summed up by itself, so that it comes out alike in every shard that holds it."""
    out = np.empty(len(a))
    for at in range(0, len(a), 200_000):
        i, j = a[at : at + 200_000], b[at : at + 200_000]
        out[at : at + 200_000] = np.einsum("ij,ij->i", x[i], x[j])
    return out


def links_within(x: np.ndarray, least: float) -> np.ndarray:
    """0/1 matrix of the pairs within the range; the product of all only picks candidates."""
    a, b = np.nonzero(np.triu(x @ x.T >= least - 1e-9, 1))
    out = np.zeros((len(x), len(x)), np.float32)
    out[a, b] = cosines(x, a, b) >= least
    return np.maximum(out, out.T)


def entries(x: np.ndarray, graph: np.ndarray) -> np.ndarray:
    """The medoid of each part of the graph; edges to the first one join the parts, in place."""
    part = lowest_reached(len(x), *np.nonzero(graph))
    out = []
    for p in np.unique(part):
        at = np.flatnonzero(part == p)
        out.append(at[np.argmax(x[at] @ x[at].sum(axis=0))])
    out = np.array(out)
    graph[out[0], out[1:]] = graph[out[1:], out[0]] = 1
    return out


def range_search(x: np.ndarray, graph: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(query, member)`` within the range, query before member, as found through the graph.

    ``graph`` is the members' adjacency as a 0/1 matrix. Its lists are cut at ``DEGREE``; members within
    the range are added to them whole, so that no link depends on the cut, and the parts it falls into
    are joined. All members are queries at once; each starts at itself and at the parts' medoids. A
    round expands the best member not yet expanded, if it is among the ``BEAM`` best seen, and every
    member within the range.
    """
    m = len(x)
    graph = np.maximum(graph, links_within(x, least))
    start = entries(x, graph)
    seen = np.zeros((m, m), bool)
    done = np.zeros((m, m), bool)
    score = np.full((m, m), -np.inf)
    rows = np.arange(m)
    seen[:, start] = True
    seen[rows, rows] = True
    q, v = np.nonzero(seen)
    score[q, v] = cosines(x, q, v)
    while True:
        open_ = np.where(done, -np.inf, score)
        best = open_.argmax(axis=1)
        value = open_[rows, best]
        bar = -np.partition(-score, BEAM - 1, axis=1)[:, BEAM - 1] if m > BEAM else np.full(m, -np.inf)
        grow = (open_ >= least)
        go = np.isfinite(value) & (value >= bar)
        grow[rows[go], best[go]] = True
        active = np.flatnonzero(grow.any(axis=1))
        if not len(active):
            break
        done |= grow
        new = (grow[active].astype(np.float32) @ graph > 0) & ~seen[active]
        q, v = np.nonzero(new)
        q = active[q]
        seen[q, v] = True
        score[q, v] = cosines(x, q, v)
    found = score >= least
    found |= found.T
    return np.nonzero(np.triu(found, 1))


def _pivots(vectors: np.ndarray, k: int, rounds: int = 3) -> np.ndarray:
    """Centres of ``k`` clusters of a sample, from its first rows."""
    centre = vectors[:k].copy()
    for _ in range(rounds):
        of = (vectors @ centre.T).argmax(axis=1)
        for j in range(k):
            if (of == j).any():
                s = vectors[of == j].sum(axis=0)
                centre[j] = s / max(1e-12, np.linalg.norm(s))
    return centre


def shards_of(classes: DataFrame) -> DataFrame:
    """``shard, shards, cls, n, vector``: each vector once per shard, with all its shards.

    Shards beyond ``SHARD_CAP`` are split around pivots, up to ``LEVELS`` times. What still is larger,
    such as many near copies of one vector, is dealt into blocks, and every two blocks of a shard are a
    shard, so that all members still meet.
    """
    now = classes.select(F.xxhash64("label", F.size("vector")).alias("shard"), "cls", "vector")
    for _ in range(LEVELS):
        now = written(now, "shards")
        large = written(now.groupBy("shard").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > SHARD_CAP), "large-shards")
        rows = large.agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("k")).first()
        if not rows["k"]:
            break
        # About 16 sampled vectors per pivot and MAX_SAMPLE in all, chosen by hash.
        want = min(1.0, 16 / SHARD_TARGET, MAX_SAMPLE / rows["m"])
        picked = now.join(large, "shard").where(F.pmod(F.xxhash64("cls", "shard"), F.lit(1 << 30)) < int(want * (1 << 30)))
        sample = picked.select("shard", "m", "vector", F.xxhash64("cls").alias("h")).limit(2 * MAX_SAMPLE).collect()
        by: dict[int, list] = {}
        for r in sorted(sample, key=lambda r: (r["shard"], r["h"])):
            by.setdefault(r["shard"], []).append(r)
        pivots = {}
        for shard, some in by.items():
            x = np.array([r["vector"] for r in some], np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            k = min(len(x), -(-some[0]["m"] // SHARD_TARGET))
            if k > OVERLAP:
                pivots[shard] = _pivots(x, k)
        if not pivots:
            break
        shared = classes.sparkSession.sparkContext.broadcast(pivots)

        def deal(stream, shared=shared):
            for b in stream:
                shard, take, to = b.column("shard").to_numpy(), [], []
                for s in np.unique(shard):
                    at = np.flatnonzero(shard == s)
                    if (p := shared.value.get(int(s))) is None:
                        take.append(at)
                        to.append(shard[at])
                        continue
                    near = np.argsort(-(unit(b.column("vector").take(pa.array(at))) @ p.T), axis=1, kind="stable")[:, :OVERLAP]
                    take.append(np.repeat(at, OVERLAP))
                    to.append((np.array([[s]], np.int64) * 1_000_003 + near + 1).ravel())
                take = pa.array(np.concatenate(take))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to)), b.column("cls").take(take), b.column("vector").take(take)],
                                                 ["shard", "cls", "vector"])

        now = now.mapInArrow(deal, now.schema)
    now = written(now, "shards")
    sizes = now.groupBy("shard").agg(F.count(F.lit(1)).alias("m"))
    blocks = F.when(F.col("m") > SHARD_CAP, F.ceil(F.col("m") * 2 / SHARD_CAP)).otherwise(1).cast("int")
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                        lambda j: F.xxhash64("shard", F.least(F.col("own"), j), F.greatest(F.col("own"), j)))
    placed = now.join(sizes, "shard").withColumn("blocks", blocks).withColumn("own", own).select(
        "cls", F.explode(pairs).alias("shard"))
    placed = written(placed, "placed")
    all_ = placed.groupBy("cls").agg(F.sort_array(F.collect_set("shard")).alias("shards"))
    return written(placed.join(all_, "cls").join(classes.select("cls", "n", "vector"), "cls"), "shard-members")


def graph_of(members: DataFrame) -> DataFrame:
    """``cls, near``: the union of a vector's robust-pruned lists of all its shards."""
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def build(stream):
        for table, first in sorted_groups(stream, ["shard"]):
            cls = table.column("cls").to_numpy()
            vectors = table.column("vector").combine_chunks()
            lists = []
            for i, j in zip(first, first[1:]):
                near = robust_prune(unit(vectors.slice(i, j - i)))
                lists += [cls[i + row[row >= 0]].tolist() for row in near]
            yield pa.RecordBatch.from_arrays([table.column("cls").combine_chunks(), pa.array(lists, pa.list_(pa.int64()))], ["cls", "near"])

    lists = (members.select("shard", "cls", "vector").repartition(partitions, "shard").sortWithinPartitions("shard", "cls")
             .mapInArrow(build, "cls long, near array<long>"))
    return lists.groupBy("cls").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def search(members: DataFrame, graph: DataFrame, least: float) -> DataFrame:
    """``cls, other, links``: per shard and vector, the rows it links to, and one member it hangs together with.

    A pair of which both are in several shards counts in the first of these alone. ``other`` leads to
    the least member of the vector's component in the shard, so the result has a row per vector and shard.
    """
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = members.join(graph, "cls").repartition(partitions, "shard").sortWithinPartitions("shard", "cls")

    def run(stream):
        for table, first in sorted_groups(stream, ["shard"]):
            cls, weight = table.column("cls").to_numpy(), table.column("n").to_numpy()
            vectors, shard = table.column("vector").combine_chunks(), table.column("shard").to_numpy()
            near, shards = table.column("near").combine_chunks(), table.column("shards").combine_chunks()
            out_cls, out_other, out_links = [], [], []
            for i, j in zip(first, first[1:]):
                m, own = j - i, cls[i:j]
                part = near.slice(i, m)
                target = part.flatten().to_numpy()
                source = np.repeat(np.arange(m), np.diff(part.offsets.to_numpy()))
                at = np.minimum(np.searchsorted(own, target), m - 1)
                here = own[at] == target
                graph_ = np.zeros((m, m), np.float32)
                graph_[source[here], at[here]] = 1
                graph_ = np.maximum(graph_, graph_.T)
                a, b = range_search(unit(vectors.slice(i, m)), graph_, least)
                low = lowest_reached(m, a, b)
                sets = shards.slice(i, m).to_pylist()
                if any(len(s) > 1 for s in sets):
                    home = shard[i]
                    keep = np.array([next(s for s in sets[x] if s in sets[y]) == home for x, y in zip(a, b)], bool)
                    a, b = (a[keep], b[keep]) if len(a) else (a, b)
                links = np.bincount(a, weight[i + b], m) + np.bincount(b, weight[i + a], m)
                some = np.flatnonzero((links > 0) | (low != np.arange(m)))
                out_cls.append(own[some])
                out_other.append(own[low[some]])
                out_links.append(links[some].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_cls, out_other, out_links)], ["cls", "other", "links"])

    return placed.mapInArrow(run, "cls long, other long, links long")


def audit(classes: DataFrame, found: DataFrame, least: float, most: int = AUDITED) -> float:
    """Share of the links of at most ``most`` vectors, chosen by hash, that were found."""
    total = classes.count()
    share = min(1.0, 0.7 * most / max(1, total))
    picked = classes.where(F.pmod(F.xxhash64("cls", F.lit(7)), F.lit(1 << 30)) <= int(share * (1 << 30))).limit(most)
    queries = picked.join(found, "cls", "left").select("cls", "label", "vector", F.coalesce("links", F.lit(0)).alias("links")).collect()
    if not queries:
        return 1.0
    by: dict[tuple, np.ndarray] = {}
    for r in queries:
        by.setdefault((r["label"], len(r["vector"])), []).append(r["vector"])
    by = {k: unit(pa.array(v, pa.list_(pa.float64()))) for k, v in by.items()}
    shared = classes.sparkSession.sparkContext.broadcast(by)

    def count(stream):
        for b in stream:
            n, labels = 0, b.column("label").to_numpy()
            size = b.column("vector").value_lengths().to_numpy()
            for (label, d), q in shared.value.items():
                at = np.flatnonzero((labels == label) & (size == d))
                if len(at):
                    hit = (q @ unit(b.column("vector").take(pa.array(at))).T >= least).sum(axis=0)
                    n += int((hit * b.column("n").to_numpy()[at]).sum())
            yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    true = classes.select("label", "vector", "n").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    own = classes.join(F.broadcast(picked.select("cls")), "cls").agg(F.sum("n")).first()[0]
    return 1.0 if true <= own else min(1.0, sum(r["links"] for r in queries) / (true - own))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    least: float = LEAST_COSINE) -> DataFrame:
    """``id_col, n_links, component_id, kept, audited_recall`` for every row.

    Two rows link if their labels and numbers of components are equal and their cosine in double
    precision is at least ``least``. Rows with a null label or vector, with null or non-finite
    components or only zeros link with nothing and are their own component. Equal vectors are one node
    of the graph, with as many links as they have copies. Repeated ids count as rows each. Other columns
    are ignored, an empty table gives an empty result.
    """
    rows = kept_columns(vectors, {"id": id_col, "vector": vector_col, "label": label_col})
    rows = rows.withColumn("_good", usable(F.col("vector"), F.col("label")))
    rows = rows.withColumn("cls", F.when(F.col("_good"), F.xxhash64("label", "vector")))
    good, n_rows = written_with_count(rows.where("_good").select("id", "label", "cls", F.col("vector").cast("array<double>").alias("vector")), "vectors")
    classes = written(good.groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"),
                                              F.first("vector").alias("vector")), "vector-classes")
    members = shards_of(classes)
    graph = written(graph_of(members), "graph")
    found = written(search(members, graph, least), "found")
    links = written(found.groupBy("cls").agg(F.sum("links").alias("links")), "links")
    recall = audit(classes, links, least)
    edges = found.where("cls <> other").select(F.col("cls").alias("src"), F.col("other").alias("dst")).distinct()
    groups = connected_components(classes.select(F.col("cls").alias("id")), edges).withColumnRenamed("id", "cls")
    named = written(groups.join(classes.select("cls", "rep", "n"), "cls"), "vector-groups")
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    table = written(named.join(lowest, "component").join(links, "cls", "left").select(
        "cls", "n", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "vector-names")
    out = lookup(good.select("id", "cls"), table, ["cls"], "n", n_rows).select("id", "n_links", "component_id")
    rest = rows.where("not _good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(rest).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"),
        F.lit(recall).alias("audited_recall"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
