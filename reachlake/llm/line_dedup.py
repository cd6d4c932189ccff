"""Line dedup by pairwise alignment: a later document loses the blocks of lines it shares with an earlier one.

Documents that overlap are found by the hashes of their lines: a rare line pairs all its holders, a
common one pairs each holder with the earliest. The two documents of a pair are aligned by patience
diff, and the later one loses the aligned blocks, with the short and repeated lines inside them. An
exact copy of an earlier text goes whole.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from reachlake.llm.spread import lookup
from reachlake.llm.textvec import batches_of
from reachlake.session import written, written_with_count

MIN_WORDS = 5
# A line in at most this many texts pairs all of them, at most 6 pairs a line; any other line pairs
# each of its holders with the earliest.
RARE = 4
# A pair meets in windows of its documents: so many lines and as many as ``MARGIN`` on either side.
# Most documents are one window; of longer ones only the windows with shared lines are sent.
WINDOW, MARGIN = 128, 64
# Line numbers that may be sent to every task with their documents; at most about 64 MB.
MAX_BROADCAST_LINES = 4_000_000


def aligned(here: list[int], there: list[int]) -> list[int]:
    """Members of ``here`` in the longest alignment: places ascend here and never descend there.

    ``here`` is ascending; ``there[i]`` is the place of line ``here[i]`` in the earlier document. Piles
    are those of patience sorting; of equally long alignments the one that ends lowest is taken.
    """
    tops: list[int] = []
    pile_end: list[int] = []
    back: list[int] = []
    for i, x in enumerate(there):
        p = bisect_right(tops, x)
        back.append(pile_end[p - 1] if p else -1)
        if p == len(tops):
            tops.append(x)
            pile_end.append(i)
        else:
            tops[p], pile_end[p] = x, i
    out, i = [], pile_end[-1] if pile_end else -1
    while i >= 0:
        out.append(here[i])
        i = back[i]
    return out[::-1]


def patience(here: list[int], there: list[int], strong: list[bool]) -> list[tuple[int, int]]:
    """Places ``(i, j)`` of equal lines, by patience diff.

    Equal lines at both ends of a range match. Strong lines found once on both sides are its anchors,
    of which the longest run in order is kept; the gaps between anchors are ranges again. In a range
    without anchors strong lines repeated here match the first such line there, in ascending order.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(here), 0, len(there))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and here[a] == there[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and here[b - 1] == there[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b:
            continue
        at: dict[int, int] = {}
        often: set[int] = set()
        for j in range(c, d):
            if there[j] in at:
                often.add(there[j])
            else:
                at[there[j]] = j
        shared = [i for i in range(a, b) if strong[i] and here[i] in at]
        times: dict[int, int] = {}
        for i in shared:
            times[here[i]] = times.get(here[i], 0) + 1
        single = [i for i in shared if times[here[i]] == 1 and here[i] not in often]
        if not single:
            # The matched lines on either side of the range count too: they may be repeated here alone.
            for j in (c - 1, d):
                if 0 <= j < len(there):
                    at.setdefault(there[j], j)
            shared = [i for i in range(a, b) if strong[i] and here[i] in at]
            out.extend((i, at[here[i]]) for i in aligned(shared, [at[here[i]] for i in shared]))
            continue
        x, y = a, c
        for i in aligned(single, [at[here[i]] for i in single]):
            j = at[here[i]]
            out.append((i, j))
            todo.append((x, i, y, j))
            x, y = i + 1, j + 1
        todo.append((x, b, y, d))
    return sorted(out)


def blocks(matches: list[tuple[int, int]], strong: list[bool]) -> list[int]:
    """Places of the matched blocks (places that follow one another on both sides) that hold a strong line."""
    out: list[int] = []
    k = 0
    while k < len(matches):
        m = k + 1
        while m < len(matches) and matches[m] == (matches[m - 1][0] + 1, matches[m - 1][1] + 1):
            m += 1
        if any(strong[i] for i, _ in matches[k:m]):
            out.extend(i for i, _ in matches[k:m])
        k = m
    return out


def texts_as_lines(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """``id, t, u, lines, strong, whole``: hashes of a text and of its lines without outer white space.

    ``strong`` tells lines of at least ``min_words`` words, ``whole`` whether the text has as many.
    """
    text = F.col(text_col)
    words = rf"\S+(\s+\S+){{{min_words - 1}}}" if min_words > 1 else r"\S"
    rows = docs.where(text.isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("t"), F.hash(text).alias("u"), text.rlike(words).alias("whole"),
        F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")).alias("parts"))
    return rows.select("id", "t", "u", F.transform("parts", lambda x: F.xxhash64(x)).alias("lines"),
                       F.transform("parts", lambda x: x.rlike(words)).alias("strong"), "whole")


def overlapping(texts: DataFrame) -> DataFrame:
    """``id, t, u, s, oid, ot, ou, os``: windows ``s`` and ``os`` of a text and an earlier one with a line in common."""
    lines = texts.select("id", "t", "u", "strong", F.posexplode("lines").alias("pos", "h")).where(F.col("strong")[F.col("pos")])
    place = F.struct("id", "t", "u", (F.col("pos") / WINDOW).cast("int").alias("s"))
    lines, n = written_with_count(lines.select("h", place.alias("at")).distinct(), "lines")
    holders = written(lines.groupBy("h").agg(F.min("at").alias("first"), F.max("at.id").alias("last"), F.count(F.lit(1)).alias("n"))
                      .where(F.col("last") > F.col("first.id")).select("h", "first", "n"), "line-holders")
    common = lookup(lines, holders.where(F.col("n") > RARE), ["h"], "n", n).select("at", "first")
    # At most RARE places a line.
    rare = lines.join(holders.where(F.col("n") <= RARE).select("h"), "h").groupBy("h").agg(F.collect_list("at").alias("all"))
    rare = rare.select(F.explode("all").alias("at"), "all").select("at", F.explode("all").alias("first"))
    pairs = common.unionByName(rare).where(F.col("at.id") > F.col("first.id"))
    return pairs.select("at.*", *[F.col(f"first.{c}").alias(f"o{c}") for c in ("id", "t", "u", "s")]).distinct()


def windows(texts: DataFrame) -> DataFrame:
    """``t, u, s, start, lines, strong``: the windows of each text."""
    rows = texts.select("t", "u", "lines", "strong", F.explode(F.sequence(F.lit(0), ((F.size("lines") - 1) / WINDOW).cast("int"))).alias("s"))
    start = F.greatest(F.lit(0), F.col("s") * WINDOW - MARGIN)
    size = F.col("s") * WINDOW + WINDOW + MARGIN - start
    return rows.select("t", "u", "s", start.alias("start"), F.slice("lines", start + 1, size).alias("lines"),
                       F.slice("strong", start + 1, size).alias("strong"))


def shared_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``id, t, removed, sources``: the line numbers each document loses, and the documents that have them.

    ``t`` is the hash of the whole text, which tells rows with one id apart.
    """
    rows, n_rows = written_with_count(texts_as_lines(docs, id_col, text_col, min_words), "texts-as-lines")
    texts = written(rows.groupBy("t", "u").agg(F.min("id").alias("id"), F.first("lines").alias("lines"), F.first("strong").alias("strong"),
                                               F.first("whole").alias("whole"), F.count(F.lit(1)).alias("n")), "different-texts")
    pairs, n_pairs = written_with_count(overlapping(texts), "overlapping")
    parts = windows(texts)
    owned = pairs.groupBy("ot", "ou", "os").agg(F.count(F.lit(1)).alias("n"))
    owned = written(owned.join(parts.select(F.col("t").alias("ot"), F.col("u").alias("ou"), F.col("s").alias("os"),
                                            F.col("lines").alias("there")), ["ot", "ou", "os"]), "owned-windows")
    both = lookup(pairs, owned, ["ot", "ou", "os"], "n", n_pairs).join(parts, ["t", "u", "s"])

    def run(stream):
        for b in stream:
            here, there, strong = (b.column(c).to_pylist() for c in ("lines", "there", "strong"))
            gone = [blocks(patience(x, y, z), z) for x, y, z in zip(here, there, strong)]
            gone = [[i + at for i in v] for v, at in zip(gone, b.column("start").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("t"), b.column("u"), b.column("oid"), pa.array(gone, pa.list_(pa.int32()))],
                                             ["t", "u", "oid", "gone"])

    found = both.select("t", "u", "oid", "start", "lines", "strong", "there").mapInArrow(run, "t long, u int, oid long, gone array<int>")
    found = found.select("t", "u", "oid", F.explode("gone").alias("pos")).groupBy("t", "u").agg(
        F.sort_array(F.collect_set("pos")).alias("removed"), F.sort_array(F.collect_set("oid")).alias("sources"))
    info = texts.select("t", "u", "n", "whole", F.col("id").alias("first"), F.size("lines").alias("size")).join(found, ["t", "u"], "left")
    info = written(info.where(F.col("removed").isNotNull() | (F.col("whole") & (F.col("n") > 1))), "text-blocks")
    copy = F.col("id") > F.col("first")
    out = lookup(rows.select("id", "t", "u"), info, ["t", "u"], "n", n_rows).where(copy | F.col("removed").isNotNull())
    return out.select("id", "t", F.when(copy, F.sequence(F.lit(0), F.col("size") - 1)).otherwise(F.col("removed")).alias("removed"),
                      F.when(copy, F.array("first")).otherwise(F.col("sources")).alias("sources")).dropDuplicates(["id", "t"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` with the text left over, and ``_n_lines, _removed, _sources``.

    Lines are compared exactly but for outer white space; only those of at least ``min_words`` words
    make pairs and anchors, and a block of aligned lines goes if it holds one. The document with the
    smallest whole-number id keeps its lines. A text of at least ``min_words`` words that an earlier
    document also has goes whole. Lines in another order than the longest aligned one stay, and so do
    lines repeated within a document unless an earlier document has them. A null text stays null and has
    no lines, a null id takes no part. Rows with one id and different texts lose each their own lines,
    and none to one another; equal rows lose the same. An empty table gives an empty result.
    """
    found, n = written_with_count(shared_blocks(docs, id_col, text_col, min_words), "line-blocks")
    size = found.agg(F.sum(F.size("removed") + F.size("sources")).alias("s")).first()["s"] or 0
    found = found.withColumnsRenamed({"id": "_ld_id", "t": "_ld_t", "removed": "_removed", "sources": "_sources"})
    other = F.broadcast(found) if n + size <= MAX_BROADCAST_LINES else found
    own = (docs[id_col].cast("long") == F.col("_ld_id")) & (F.xxhash64(docs[text_col]) == F.col("_ld_t"))
    joined = docs.join(other, own, "left").drop("_ld_id", "_ld_t")
    names = joined.columns
    schema = StructType([*docs.schema.fields, StructField("_n_lines", LongType()),
                         StructField("_removed", ArrayType(IntegerType())), StructField("_sources", ArrayType(LongType()))])
    text_at = docs.columns.index(text_col)

    def run(stream):
        for b in batches_of(stream, 2048, 8 << 20):
            texts, n_lines = b.column(text_at).to_pylist(), []
            removed = b.column(len(names) - 2).to_pylist()
            for i, (t, gone) in enumerate(zip(texts, removed)):
                n_lines.append(0 if t is None else t.count("\n") + 1)
                if gone:
                    drop = set(gone)
                    texts[i] = "\n".join([x for k, x in enumerate(t.split("\n")) if k not in drop])
            columns = [b.column(i).combine_chunks() for i in range(len(names))]
            columns[text_at] = pa.array(texts, b.schema.field(text_at).type)
            yield pa.RecordBatch.from_arrays([*columns[:-2], pa.array(n_lines, pa.int64()), *columns[-2:]],
                                             [*names[:-2], "_n_lines", *names[-2:]])

    return joined.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    empty = F.array().cast("array<int>")
    return out.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.coalesce(F.size("_removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("_removed", empty).alias("removed"), F.coalesce("_sources", empty.cast("array<long>")).alias("sources"), "text")
