"""Near-duplicate documents by consistent weighted samples of TF-IDF shingles, banded and verified.

A shingle is five words. Its weight in a text is the times it occurs, times 1 for shingles held by at
most a thousandth of the documents and down to 0.8 for those held by all. So idf is the same for all
rare shingles, and only common ones, whose number doesn't grow with the corpus, must be known.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlake.llm.spread import lookup, only_ids, sorted_groups
from reachlake.llm.textvec import Words, batches_of, kept_columns, mix, per_text, shingles, utf8
from reachlake.llm.weighted_samples import signatures
from reachlake.operators.graph.components import connected_components
from reachlake.session import written, written_with_count

U64 = np.uint64
SIZE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 3
# Texts that share a band are sampled again, this many times; a byte is kept of each sample.
SKETCH = 512


def least_agreeing(least: float) -> float:
    """The share of a sketch's samples in which pairs to be verified agree.

    It lies four standard errors below ``least``, so one pair of just that similarity in 30,000 falls below.
    """
    return least - 4 * (least * (1 - least) / SKETCH) ** 0.5


LEAST_AGREEING = least_agreeing(SIMILARITY)
COMMON_SHARE = 1 / 1000
IDF_SHARE = 0.2
# Members of a band's bucket that one group holds, and members of a larger bucket that all its groups hold.
MAX_GROUP, LEADERS = 256, 16
# Texts, and their words, that are verified against each other in one go (on average; blocks are dealt by hash).
MAX_BLOCK, MAX_WORDS = 512, 1 << 20


class Weights:
    """Weight factors of common shingles, those that at least ``COMMON_SHARE`` of the documents hold.

    A document of n words holds fewer than n shingles, so there are at most (mean words of a document)
    / ``COMMON_SHARE`` of them for any number of documents.
    """

    def __init__(self, keys: np.ndarray, df: np.ndarray, n_docs: int):
        order = np.argsort(keys)
        self.keys = keys[order]
        idf = np.log(np.maximum(n_docs, 1) / np.minimum(df[order], n_docs)) / max(1e-9, np.log(max(n_docs, 2) / least_common(n_docs)))
        self.factor = 1 - IDF_SHARE + IDF_SHARE * np.clip(idf, 0, 1)

    def of(self, terms: np.ndarray, count: np.ndarray) -> np.ndarray:
        out = count.astype(np.float64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, terms), len(self.keys) - 1)
            hit = self.keys[at] == terms
            out[hit] *= self.factor[at[hit]]
        return out


def least_common(n_docs: int) -> float:
    return max(2.0, n_docs * COMMON_SHARE)


def bags(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a batch; its distinct (48-bit shingle, text) with counts."""
    words = Words(*utf8(texts))
    return words, *per_text(*shingles(words, len(texts), SIZE))


def text_keys(words: Words) -> np.ndarray:
    """A hash of each text's sequence of lower-cased words."""
    place = (np.arange(len(words.hash)) - np.repeat(words.first[:-1], np.diff(words.first))).astype(np.uint64)
    mixed = mix(words.hash + mix(place * U64(0x9E3779B97F4A7C15) + U64(1)))
    sums = np.append(U64(0), np.cumsum(mixed))
    return mix(sums[words.first[1:]] - sums[words.first[:-1]] + np.diff(words.first).astype(np.uint64)).view(np.int64)


def common_shingles(rows: DataFrame, n_docs: int) -> Weights:
    """Document counts of all shingles, of which only the common ones are kept.

    Each task sends its sorted shingles with counts in one block per range of shingles; a range's
    blocks are added up by one task. The number of ranges follows ``spark.sql.shuffle.partitions``.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(6, int(np.ceil(np.log2(4 * partitions))))
    least = least_common(n_docs)

    def send(stream):
        held, size = [], 0

        def blocks():
            keys, count = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << U64(48 - bits))
            cuts = np.append(cuts, len(keys))
            low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            some = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)),
                 pa.array([np.ascontiguousarray(low[cuts[i] : cuts[i + 1]].T).tobytes() for i in some], pa.binary()),
                 pa.array([count[cuts[i] : cuts[i + 1]].astype("<u4").tobytes() for i in some], pa.binary())],
                ["range", "keys", "counts"])

        for b in batches_of(stream, 512, 1 << 20):
            _, term, _, _ = bags(b.column("text").combine_chunks())
            held.append(term)
            size += len(term)
            if size >= 1_000_000:
                yield from blocks()
                held, size = [], 0
        if size:
            yield from blocks()

    def add(pdf):
        import pandas as pd

        parts = []
        for raw in pdf["keys"]:
            low = np.frombuffer(raw, np.uint8).reshape(6, -1).T
            parts.append(np.concatenate([low, np.zeros((len(low), 2), np.uint8)], axis=1).view("<u8").ravel())
        keys = np.concatenate(parts)
        count = np.concatenate([np.frombuffer(c, "<u4") for c in pdf["counts"]]).astype(np.int64)
        order = np.argsort(keys)
        keys, count = keys[order], count[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        total = np.add.reduceat(count, at)
        ok = total >= least
        return pd.DataFrame({"key": keys[at[ok]].astype(np.int64), "df": total[ok]})

    sent = rows.select("text").mapInArrow(send, "range int, keys binary, counts binary")
    found = written(sent.groupBy("range").applyInPandas(add, "key long, df long"), "common-shingles").toPandas()
    return Weights(found["key"].to_numpy(np.uint64), found["df"].to_numpy(np.float64), n_docs)


def sample_texts(rows: DataFrame, weights: Weights) -> DataFrame:
    """``id, cls, sig`` of texts with words: the hash of all words, and the samples as bytes."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(stream):
        weights = shared.value
        for b in batches_of(stream, 512, 1 << 20):
            words, term, doc, count = bags(b.column("text").combine_chunks())
            first = np.searchsorted(doc, np.arange(b.num_rows + 1))
            sig = signatures(term * U64(0x9E3779B97F4A7C15), np.log(weights.of(term, count)), first, BANDS * ROWS)
            full = np.flatnonzero(np.diff(words.first))
            yield pa.RecordBatch.from_arrays(
                [b.column("id").combine_chunks().take(pa.array(full)), pa.array(text_keys(words)[full]),
                 pa.array([sig[i].astype("<u4").tobytes() for i in full], pa.binary())], ["id", "cls", "sig"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, cls long, sig binary")


def _band_keys(classes: DataFrame) -> DataFrame:
    """``key, cls``: one row per class and band."""

    def run(stream):
        for b in stream:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u4").reshape(-1, BANDS, ROWS).astype(np.uint64)
            h = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :]
            for r in range(ROWS):
                h = mix(h * U64(0x9E3779B97F4A7C15) + sig[:, :, r])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.ravel().view(np.int64)), pa.array(np.repeat(b.column("cls").to_numpy(), BANDS))], ["key", "cls"])

    return classes.select("cls", "sig").mapInArrow(run, "key long, cls long")


def sketches_of(hit: DataFrame, classes: DataFrame, rows: DataFrame, weights: Weights) -> DataFrame:
    """``cls, sig, words``: a byte of each of ``SKETCH`` samples of the classes that share a band with others."""
    some, _ = written_with_count(hit.select("cls").distinct(), "sharing")
    ids, n = written_with_count(classes.join(some, "cls").select(F.col("rep").alias("id")).distinct(), "sharing-texts")
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(stream):
        weights = shared.value
        for b in batches_of(stream, 512, 1 << 20):
            words, term, doc, count = bags(b.column("text").combine_chunks())
            first = np.searchsorted(doc, np.arange(b.num_rows + 1))
            sig = signatures(term * U64(0x9E3779B97F4A7C15), np.log(weights.of(term, count)), first, SKETCH)
            sig = (sig * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
            full = np.flatnonzero(np.diff(words.first))
            yield pa.RecordBatch.from_arrays(
                [pa.array(text_keys(words)[full]), pa.array([sig[i].tobytes() for i in full], pa.binary()),
                 pa.array(np.diff(words.first)[full], pa.int64())], ["cls", "sig", "words"])

    found = only_ids(rows, ids, "id", n).mapInArrow(run, "cls long, sig binary, words long")
    return written(found.groupBy("cls").agg(F.first("sig").alias("sig"), F.first("words").alias("words")), "sketches")


def spanning_pairs(cls: np.ndarray, sig: np.ndarray, agreeing: float = LEAST_AGREEING) -> list[tuple[int, int]]:
    """First round: of the pairs that agree in enough samples, at most two per member that keep what hangs together.

    Members join one by one, each time the one most alike to any before it, with its links to the two
    members most alike. So each member has its strongest link and one to spare, and no group sends
    more than twice as many pairs as it has members.
    """
    n = len(cls)
    if n == 2:
        return [(0, 1)] if (sig[0] == sig[1]).mean() >= agreeing else []
    best = np.full((2, n), -1.0)
    who = np.zeros((2, n), np.int64)
    open_ = np.ones(n, bool)
    out, at = [], 0
    for _ in range(n):
        open_[at] = False
        for k in (0, 1):
            if best[k, at] >= agreeing:
                out.append((int(who[k, at]), int(at)))
        alike = (sig == sig[at]).mean(axis=1)
        more = alike > best[0]
        best[1], who[1] = np.where(more, best[0], np.maximum(best[1], alike)), np.where(more, who[0], np.where(alike > best[1], at, who[1]))
        best[0], who[0] = np.where(more, alike, best[0]), np.where(more, at, who[0])
        left = np.flatnonzero(open_)
        if not len(left):
            break
        at = int(left[np.argmax(best[0, left])])
    return out


def bucket_members(classes: DataFrame, n_classes: int) -> DataFrame:
    """``key, cls, n``: classes that share a band with others, and how many do."""
    keys = written(_band_keys(classes), "bands")
    sizes = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "band-sizes")
    return written(lookup(keys, sizes, ["key"], "n", BANDS * n_classes), "buckets")


def candidate_pairs(hit: DataFrame, sketches: DataFrame, agreeing: float = LEAST_AGREEING) -> DataFrame:
    """``a, b``: classes that share a band and agree in enough samples, for the first round.

    Buckets beyond ``MAX_GROUP`` members are dealt into groups, all of which also hold the bucket's
    leaders (about ``LEADERS`` members chosen by hash), so that most alike members of different groups
    meet through these. What is left apart meets in later rounds.
    """
    groups = F.ceil(F.col("n") / MAX_GROUP).cast("int")
    leads = (groups > 1) & (F.pmod(F.xxhash64("cls", F.lit(1)), F.col("n")) < LEADERS)
    own = F.pmod(F.xxhash64("cls"), groups).cast("int")
    hit = hit.select("key", "cls", F.explode(F.when(leads, F.sequence(F.lit(0), groups - 1)).otherwise(F.array(own))).alias("part"))
    partitions = int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (hit.join(sketches.select("cls", "sig"), "cls").repartition(partitions, "key", "part")
              .sortWithinPartitions("key", "part", "cls"))

    def run(stream):
        for table, first in sorted_groups(stream, ["key", "part"]):
            cls = table.column("cls").to_numpy()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(cls), -1)
            a, b = [], []
            for i, j in zip(first, first[1:]):
                if j - i > 1:
                    for x, y in spanning_pairs(cls[i:j], sig[i:j], agreeing):
                        a.append(min(cls[i + x], cls[i + y]))
                        b.append(max(cls[i + x], cls[i + y]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return placed.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def best_untested(sig: np.ndarray, component: np.ndarray, agreeing: float = LEAST_AGREEING) -> list[tuple[int, int]]:
    """Each member with the member of another component most alike, if the two agree enough."""
    out = []
    for i in range(len(sig)):
        at = np.flatnonzero(component != component[i])
        if len(at):
            alike = (sig[at] == sig[i]).mean(axis=1)
            best = int(np.argmax(alike))
            if alike[best] >= agreeing:
                out.append((i, int(at[best])))
    return out


def dealt(members: DataFrame, sizes: DataFrame, key: str, rows: int) -> DataFrame:
    """``members`` with the cells ``lo, hi`` in which every two of a key meet but those of its main component.

    ``members`` hold ``key, cls, component``; ``sizes`` the keys to deal, each with its rows in ``n``, its
    main component, and the number of blocks of that one (``mains``) and of all others (``rest``); a
    key with ``mains`` 0 is one block. The row count is that of the key times the blocks of the others.
    """
    some, place = lookup(members, sizes, [key], "n", rows), F.xxhash64("cls", F.lit(2))
    main, whole = F.col("component") == F.col("main"), F.col("mains") == 0
    own = F.when(whole, 0).when(main, F.pmod(place, "mains")).otherwise(F.col("mains") + F.pmod(place, "rest")).cast("int")
    others = F.when(whole, F.array(F.lit(0))).otherwise(
        F.sequence(F.when(main, F.col("mains")).otherwise(0), F.col("mains") + F.col("rest") - 1))
    return some.select(key, "cls", "component", own.alias("own"), F.explode(others).alias("other")).select(
        key, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "cls", "component")


def main_components(members: DataFrame, key: str, *sums) -> DataFrame:
    """``key, n, main, m`` of keys with several components: rows, the largest component and its rows, and ``sums``."""
    parts = members.groupBy(key, "component").agg(F.count(F.lit(1)).alias("m"), *[F.sum(c).alias(c) for c in sums])
    found = parts.groupBy(key).agg(F.max(F.struct("m", "component", *sums)).alias("largest"), F.sum("m").alias("n"),
                                   F.count(F.lit(1)).alias("k"), *[F.sum(c).alias(c) for c in sums])
    return found.where("k > 1").select(key, "n", F.col("largest.component").alias("main"), F.col("largest.m").alias("m"),
                                       *sums, *[F.col(f"largest.{c}").alias(f"main_{c}") for c in sums])


def untested_pairs(hit: DataFrame, sketches: DataFrame, groups: DataFrame, n_classes: int,
                   agreeing: float = LEAST_AGREEING) -> DataFrame:
    """``a, b``: classes of one bucket and different components that agree in enough samples, one pair a member at most.

    There are none if and only if no such classes are left. Only buckets with several components are
    looked at. One beyond ``MAX_GROUP`` members is dealt into blocks, those of its largest component
    apart from the others, and every two blocks meet but those of the largest component.
    """
    named = written(hit.select("key", "cls").join(groups.withColumnRenamed("id", "cls"), "cls"), "bucket-components")
    half, large = max(1, MAX_GROUP // 2), F.col("n") > MAX_GROUP
    mixed = written(main_components(named, "key").select(
        "key", "n", "main", F.when(large, F.ceil(F.col("m") / half)).otherwise(0).cast("int").alias("mains"),
        F.ceil((F.col("n") - F.col("m")) / half).cast("int").alias("rest")), "mixed-buckets")
    partitions = int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (dealt(named, mixed, "key", BANDS * n_classes).join(sketches.select("cls", "sig"), "cls")
              .repartition(partitions, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "cls"))

    def run(stream):
        for table, first in sorted_groups(stream, ["key", "lo", "hi"]):
            cls, component = table.column("cls").to_numpy(), table.column("component").to_numpy()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(cls), -1)
            a, b = [], []
            for i, j in zip(first, first[1:]):
                for x, y in best_untested(sig[i:j], component[i:j], agreeing):
                    a.append(min(cls[i + x], cls[i + y]))
                    b.append(max(cls[i + x], cls[i + y]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return placed.mapInArrow(run, "a long, b long").distinct()


def similarities(term: np.ndarray, text: np.ndarray, count: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Weighted Jaccard similarity of every two of ``n`` texts, given as (term, text) with count and weight.

    A term's weights are its counts times one factor, so the smaller of two weights is a sum over the
    steps between different counts, and each step's sum over terms is a matrix product.
    """
    factor, both, below = weight / count, np.zeros((n, n)), 0
    for step in np.unique(count):
        at = np.flatnonzero(count >= step)
        _, col, held = np.unique(term[at], return_inverse=True, return_counts=True)
        shared = held > 1
        at, col = at[shared[col]], (np.cumsum(shared) - 1)[col[shared[col]]]
        if not len(at):
            break
        order = np.argsort(col, kind="stable")
        at, col, wide = at[order], col[order], max(1, (1 << 21) // n)
        for low in range(0, int(col[-1]) + 1, wide):
            i, j = np.searchsorted(col, (low, low + wide))
            part = np.zeros((n, min(wide, int(col[-1]) + 1 - low)))
            part[text[at[i:j]], col[i:j] - low] = factor[at[i:j]]
            both += (step - below) * (part @ (part != 0).T.astype(np.float64))
        below = step
    total = np.bincount(text, weight, n)
    every = total[:, None] + total[None, :] - both
    return np.divide(both, every, out=np.zeros((n, n)), where=every > 0)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """As few of the links of a symmetric matrix as keep together what hangs together."""
    seen, out = np.zeros(len(linked), bool), []
    for start in range(len(linked)):
        if seen[start]:
            continue
        seen[start], open_ = True, [start]
        while open_:
            i = open_.pop()
            new = np.flatnonzero(linked[i] & ~seen)
            seen[new] = True
            out.extend((i, int(j)) for j in new)
            open_.extend(new.tolist())
    return out


def verified_links(cells: DataFrame, rows: DataFrame, reps: DataFrame, weights: Weights, least: float) -> DataFrame:
    """``a, b``: links between classes that meet in a cell, of different components where they have one.

    ``cells`` hold ``part, lo, hi, cls, component``. Each text is sent to its cells, where all pairs
    are compared by their whole texts; of the links found a cell hands on fewer than it has members.
    """
    ids, n = written_with_count(reps.join(cells.select("cls").distinct(), "cls").select("id").distinct(), "cell-texts")
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def keyed(stream):
        seen = set()
        for b in batches_of(stream, 512, 1 << 20):
            texts = b.column("text").combine_chunks()
            keys = text_keys(Words(*utf8(texts)))
            # A text that several rows with its id hold goes once per task.
            new = []
            for i, k in enumerate(keys.tolist()):
                if k not in seen:
                    seen.add(k)
                    new.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(keys[new]), texts.take(pa.array(new, pa.int64()))], ["cls", "text"])

    texts = only_ids(rows, ids, "id", n).mapInArrow(keyed, "cls long, text string")
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (texts.join(cells, "cls").select("part", "lo", "hi", "cls", "component", "text")
              .repartition(partitions, "part", "lo", "hi").sortWithinPartitions("part", "lo", "hi", "cls"))

    def check(stream):
        weights = shared.value
        for table, first in sorted_groups(stream, ["part", "lo", "hi"]):
            cls, component = table.column("cls").to_numpy(), table.column("component").to_numpy(zero_copy_only=False)
            new = np.append(True, cls[1:] != cls[:-1])
            new[first[:-1]] = True
            a, b, at = [], [], 0
            while at < len(first) - 1:
                end = max(at + 1, int(np.searchsorted(first, first[at] + MAX_BLOCK, "right")) - 1)
                members = first[at] + np.flatnonzero(new[first[at] : first[end]])
                _, term, doc, count = bags(table.column("text").take(pa.array(members)).combine_chunks())
                weight, cut = weights.of(term, count), np.searchsorted(members, first[at : end + 1])
                entry = np.searchsorted(doc, cut)
                for (i, j), (x, y) in zip(zip(cut, cut[1:]), zip(entry, entry[1:])):
                    who = members[i:j]
                    linked = similarities(term[x:y], doc[x:y] - i, count[x:y], weight[x:y], int(j - i)) >= least
                    linked &= component[who][:, None] != component[who][None, :]
                    for s, t in forest(linked):
                        a.append(min(cls[who[s]], cls[who[t]]))
                        b.append(max(cls[who[s]], cls[who[t]]))
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return placed.mapInArrow(check, "a long, b long").distinct()


def alike_parts(hit: DataFrame, sketches: DataFrame, n_classes: int, agreeing: float) -> DataFrame:
    """``cls, part``: what hangs together by pairs that share a band and agree in enough samples.

    Every such pair ends up in one part, so no two parts have to be compared by their texts.
    """
    vertices = sketches.select(F.col("cls").alias("id"))
    edges = None
    pairs = written(candidate_pairs(hit, sketches, agreeing), "pairs")
    while True:
        more = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        edges = more if edges is None else edges.unionByName(more)
        groups = written(connected_components(vertices, edges), "parts")
        pairs, n = written_with_count(untested_pairs(hit, sketches, groups, n_classes, agreeing), "pairs")
        if not n:
            return groups.select(F.col("id").alias("cls"), F.col("component").alias("part"))


def linked_groups(classes: DataFrame, n_classes: int, rows: DataFrame, weights: Weights, least: float) -> tuple[DataFrame, DataFrame]:
    """Verified links, and ``id, component`` of the classes.

    The texts of a part meet in one cell. A larger part is dealt into blocks that also hold its
    leaders; then the members that are not in its largest component meet all others. After that every
    pair of a part is compared or in one component.
    """
    reps, vertices = classes.select("cls", F.col("rep").alias("id")), classes.select(F.col("cls").alias("id"))
    hit = bucket_members(classes, n_classes)
    sketches, agreeing = sketches_of(hit, classes, rows, weights), least_agreeing(least)
    parts = written(alike_parts(hit, sketches, n_classes, agreeing).join(sketches.select("cls", "words"), "cls"), "alike")

    def blocks(members, words):
        return F.greatest(F.ceil(members / MAX_BLOCK), F.ceil(words / MAX_WORDS)).cast("int")

    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words")).where("n > 1")
    sizes = written(sizes.select("part", "n", blocks(F.col("n"), F.col("words")).alias("blocks")), "alike-sizes")
    large, place = F.col("blocks") > 1, F.xxhash64("cls", F.lit(2))
    leads = large & (F.pmod(F.xxhash64("cls", F.lit(1)), F.col("n")) < LEADERS)
    cells = lookup(parts, sizes, ["part"], "n", n_classes).select(
        "part", "cls", F.col("cls").alias("component"),
        F.explode(F.when(leads, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(place, "blocks").cast("int")))).alias("lo"))
    cells = written(cells.withColumn("hi", F.col("lo")), "cells")
    links = written(verified_links(cells, rows, reps, weights, least), "links")

    def joined(found):
        return written(connected_components(vertices, found.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "groups")

    groups = joined(links)
    split = parts.join(sizes.where(large).select("part"), "part", "left_semi")
    named, n = written_with_count(split.join(groups.withColumnRenamed("id", "cls"), "cls"), "large-parts")
    if not n:
        return links, groups
    rest = blocks(F.col("n") - F.col("m"), F.col("words") - F.col("main_words"))
    mixed = written(main_components(named, "part", "words").select(
        "part", "n", "main", blocks(F.col("m"), F.col("main_words")).alias("mains"), rest.alias("rest")), "mixed-parts")
    cells, n = written_with_count(dealt(named.drop("words"), mixed, "part", n), "cells")
    if not n:
        return links, groups
    links = written(links.unionByName(verified_links(cells, rows, reps, weights, least)).distinct(), "links")
    return links, joined(links)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``id_col, copy_of, group_id, n_links, kept`` for every row.

    ``copy_of`` is the smallest id among texts with the same lower-cased words, ``n_links`` the number
    of verified links of that text to different texts, ``group_id`` the smallest id that links lead to
    and ``kept`` whether it is the row's own. Links hold a weighted Jaccard similarity of at least
    ``least`` over five-word shingles (of all words, for shorter texts). No two groups hold texts of a
    common bucket that agree enough and are not verified; within a group only the links that made it
    count. Null texts and texts without words are in a group by
    themselves. A null id groups with the others and never names a group; rows that repeat an id and
    text stay together. Other columns are ignored, an empty table gives an empty result.
    """
    rows = kept_columns(docs, {"id": id_col, "text": text_col})
    n_docs = rows.where(F.col("text").isNotNull()).count()
    weights = common_shingles(rows, n_docs)
    samples, n = written_with_count(sample_texts(rows, weights), "samples")
    classes, n_classes = written_with_count(
        samples.groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("sig").alias("sig")), "classes")
    links, groups = linked_groups(classes, n_classes, rows, weights, least)
    edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    named = groups.withColumnsRenamed({"id": "cls"}).join(classes.select("cls", "rep", "n"), "cls")
    degree = edges.select(F.explode(F.array("src", "dst")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
    lowest = named.groupBy("component").agg(F.min("rep").alias("group"))
    table = written(named.join(lowest, "component").join(degree, "cls", "left").select(
        "cls", "n", F.col("rep").alias("copy_of"), F.col("group").alias("group_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "group-names")
    found = lookup(samples.select("id", "cls"), table, ["cls"], "n", n).select("id", "copy_of", "group_id", "n_links")
    wordless = rows.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).select(
        "id", F.col("id").alias("copy_of"), F.col("id").alias("group_id"), F.lit(0).cast("long").alias("n_links"))
    out = found.unionByName(wordless)
    return out.select(F.col("id").alias(id_col), "copy_of", "group_id", "n_links",
                      F.col("group_id").eqNullSafe(F.col("id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
