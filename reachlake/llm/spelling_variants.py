"""Spelling variants: words one edit apart, found by walking a trie's edge table with joins.

The trie of all words is a table of edges ``(node, letter, next)``; a node is its prefix and ``next``
holds the letters that follow the child, with ``END`` where a word ends there. A state ``(word,
position, node)`` has spent no edit as long as its node is the word's own prefix. From there, one join
with the edge table replaces the next letter or inserts another before it; the states so made then take
one edge per round, all of them level by level, until they end at a word, which is a neighbour. A state
is only made if the child has the letter that the state needs next. Near the root nearly every letter
goes on, so edits are only made in a word's second half; those in its first half are made in a trie of
the words read backwards, where they are in the second. Deletions are insertions seen from the other
side, and a letter is only inserted before a different one, so no pair comes up twice.

Nodes near the root are few and hold most states: their edges are broadcast as long as they are at most
``MAX_BROADCAST_EDGES``; deeper nodes are joined by shuffles in which hot nodes are salted. A node has at
most one edge per letter of the alphabet, so no state meets an unbounded number of edges. Words longer
than ``MAX_DEPTH`` code points, for which the trie would need too many rounds, are compared by hashes of
all their single deletions and verified, which finds the same pairs.

Words are runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lowered; null and empty texts have none, a
null id counts as empty, and equal rows count each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlake.llm.textvec import kept_columns
from reachlake.operators.skew import hot_row_limit, salted_join
from reachlake.session import written, written_with_count

LEAST_LENGTH, LEAST_COUNT = 5, 3
MAX_DEPTH = 64
MAX_BROADCAST_EDGES = 100_000  # of at most some 300 bytes each
END = "$"
RUN = r"[A-Za-z\x{00C0}-\x{00FF}]+"


def lowered(run: Column) -> Column:
    """A-Z lowered; the quick function is right where all letters take one byte."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(
        F.translate(run, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def runs_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, run``: one row per occurrence of a run long enough to be a word."""
    rows = kept_columns(docs, {"id": id_col, "text": text_col})
    runs = rows.select("id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    return runs.where(F.length("run") >= LEAST_LENGTH).select("id", lowered(F.col("run")).alias("run"))


def misspelt(ident: Column, run: Column) -> Column:
    """The run without one letter where the checksum of id and run says so."""
    h = F.crc32(F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % 97 == 0, cut).otherwise(run)


def count_words(words: DataFrame) -> DataFrame:
    """``word, n`` of a column ``word`` with one row per occurrence."""
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


def letter(word: Column, at: Column) -> Column:
    """The letter at a place from 0, ``END`` after the last one."""
    return F.substring(F.concat(word, F.lit(END)), at + 1, F.lit(1))


def trie_edges(words: DataFrame) -> DataFrame:
    """``node, letter, next, depth``: one row per node and letter that follows it."""
    word, at = F.col("word"), F.col("at")
    steps = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("at"))
    steps = steps.select(F.substring(word, F.lit(1), at).alias("node"), letter(word, at).alias("letter"), letter(word, at + 1).alias("then"))
    out = steps.groupBy("node", "letter").agg(F.array_join(F.collect_set("then"), "").alias("next"))
    return out.withColumn("depth", F.length("node"))


class EdgeTable:
    """The edges, with those near the root apart, which are few enough to be broadcast."""

    def __init__(self, edges: DataFrame):
        self.edges = edges
        sizes = sorted((r["depth"], r["count"]) for r in edges.groupBy("depth").count().collect())  # MAX_DEPTH rows
        self.shallow, total = 0, 0
        for depth, n in sizes:
            total += n
            if total > MAX_BROADCAST_EDGES:
                break
            self.shallow = depth + 1

    def join(self, states: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
        """``n`` states, each with the edges of its ``keys``."""
        edges = self.edges.drop("depth")
        near = states.where(F.length("node") < self.shallow).join(F.broadcast(edges.where(F.col("depth") < self.shallow)), list(keys))
        deep, below = states.where(F.length("node") >= self.shallow), edges.where(F.col("depth") >= self.shallow)
        if n > hot_row_limit(states.sparkSession):
            far = salted_join(deep, below, keys, ["word"])
        else:
            far = deep.join(below, list(keys))
        return near.unionByName(far)


def half_neighbours(words: DataFrame, n_letters: int, backward: bool) -> DataFrame:
    """``word, other, longer``: pairs with the edit in the second half of the words, or, for words given backwards, in the first.

    Replacements come in both directions, insertions as (word, longer word).
    """
    table = EdgeTable(written(trie_edges(words), "trie-edges"))
    word, at, size = F.col("word"), F.col("at"), F.length("word")
    first = size - F.floor(size / 2).cast("int") if backward else F.floor(size / 2).cast("int")
    fresh = words.select("word", F.explode(F.sequence(first, size)).alias("at"))
    fresh = fresh.select("word", "at", F.substring(word, F.lit(1), at).alias("node"))
    met = table.join(fresh, ["node"], n_letters)
    # Read forwards, the letter after the inserted one must differ from it.
    apart = (at > first) & (F.col("letter") != letter(word, at - 1)) if backward else F.col("letter") != letter(word, at)
    ways = F.array(
        F.struct((at + 1).alias("at"), F.lit(False).alias("longer"), ((at < size) & (F.col("letter") != letter(word, at))).alias("right")),
        F.struct(at.alias("at"), F.lit(True).alias("longer"), apart.alias("right")))
    made = met.select("word", F.concat("node", "letter").alias("node"), "next", F.explode(ways).alias("w")).where("w.right")
    made = made.select("word", "node", "next", "w.at", "w.longer")

    def alive(states: DataFrame) -> tuple[DataFrame, int]:
        needed = states.withColumn("letter", letter(word, at))
        return written_with_count(needed.where(F.instr("next", F.col("letter")) > 0).drop("next"), "trie-states")

    found = []
    states, n = alive(made)
    while n:
        found.append(states.where(F.col("letter") == END).select("word", F.col("node").alias("other"), "longer"))
        going = table.join(states.where(F.col("letter") != END), ["node", "letter"], n)
        states, n = alive(going.select("word", (at + 1).alias("at"), F.concat("node", "letter").alias("node"), "longer", "next"))
    out = words.select("word", F.col("word").alias("other"), F.lit(False).alias("longer")).limit(0)
    for part in found:
        out = out.unionByName(part)
    return out


def short_neighbours(words: DataFrame, n_letters: int) -> DataFrame:
    """``word, other, longer`` for words of at most ``MAX_DEPTH`` letters."""
    turned = words.select(F.reverse("word").alias("word"))
    early = half_neighbours(turned, n_letters, True).select(F.reverse("word").alias("word"), F.reverse("other").alias("other"), "longer")
    return half_neighbours(words, n_letters, False).unionByName(early)


_PRIME = (1 << 61) - 1
_BASE = 1_000_003


def deletions(stream):
    """Hash of each word (place -1) and of the word without each of its letters."""
    for batch in stream:
        out = [[], [], [], []]
        for wid, word in zip(batch.column("wid").to_pylist(), batch.column("word").to_pylist()):
            size = len(word)
            head = [0]
            for c in word:
                head.append((head[-1] * _BASE + ord(c)) % _PRIME)
            out[0].append(head[-1]), out[1].append(size), out[2].append(-1), out[3].append(wid)
            tail, power = 0, 1
            for i in range(size - 1, -1, -1):
                out[0].append((head[i] * power + tail) % _PRIME), out[1].append(size - 1), out[2].append(i), out[3].append(wid)
                tail = (tail + ord(word[i]) * power) % _PRIME
                power = power * _BASE % _PRIME
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64())],
            names=["h", "size", "at", "wid"])


def long_neighbours(words: DataFrame) -> DataFrame:
    """Like :func:`short_neighbours`, for pairs of which one word at least is longer than ``MAX_DEPTH``."""
    rows = words.select("word", F.xxhash64("word").alias("wid"))
    cuts = written(rows.mapInArrow(deletions, "h long, size int, at int, wid long"), "deletions")
    without = cuts.where("at >= 0")
    replaced = without.alias("a").join(without.alias("b"), ["h", "size", "at"]).where("a.wid <> b.wid")
    inserted = cuts.where("at < 0").alias("a").join(without.alias("b"), ["h", "size"])
    pairs = replaced.select(F.col("a.wid").alias("wid"), F.col("b.wid").alias("other_wid"), F.lit(False).alias("longer")).unionByName(
        inserted.select(F.col("a.wid").alias("wid"), F.col("b.wid").alias("other_wid"), F.lit(True).alias("longer"))).distinct()
    named = pairs.join(rows, "wid").join(rows.select(F.col("wid").alias("other_wid"), F.col("word").alias("other")), "other_wid")
    apart = F.length("other") - F.length("word") == F.col("longer").cast("int")
    near = apart & (F.greatest(F.length("word"), F.length("other")) > MAX_DEPTH) & (F.levenshtein("word", "other", 1) == 1)
    return named.where(near).select("word", "other", "longer")


def neighbours(words: DataFrame) -> DataFrame:
    """``word, other``: all pairs of different words one edit apart, in both directions. ``words`` is a written table."""
    size = F.length("word")
    told = words.agg(F.max(size).alias("longest"), F.sum(size + 1).alias("letters")).first()
    short = words.where(size <= MAX_DEPTH).select("word")
    pairs = short_neighbours(short, told["letters"] or 0)
    if (told["longest"] or 0) > MAX_DEPTH:
        pairs = pairs.unionByName(long_neighbours(words.where(size >= MAX_DEPTH).select("word")))
    back = pairs.where("longer").select(F.col("other").alias("word"), F.col("word").alias("other"))
    return pairs.select("word", "other").unionByName(back)


def last_forms(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms(word, form)``: the end of each chain, by jumps that double.

    A word without a form is not in the table; chains don't run in circles, as a form is more frequent
    than its word.
    """
    state, n = written_with_count(forms.select("word", F.col("form").alias("root")), "roots")
    moved = n
    while moved:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if n > hot_row_limit(forms.sparkSession):
            joined = salted_join(state, ahead, ["root"], ["word"], "left")
        else:
            joined = state.join(ahead, ["root"], "left")
        moved_rows = joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = written(moved_rows, "roots")
        moved = step.where("moved").limit(1).count()
        state = step.drop("moved")
    return state


def group_variants(words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``words(word, n)``.

    A word's form is its most frequent neighbour (ties: the first in code-point order) if that is at
    least twice as frequent; its root is the last of the forms that follow one another.
    """
    words = written(words, "words")
    near = neighbours(words).join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best")
    told = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    counted = words.join(told, "word", "left")
    has_form = F.coalesce(-F.col("best.n") >= 2 * F.col("n"), F.lit(False))
    out = written(counted.select(
        "word", F.when(has_form, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, -F.col("best.n")).alias("form_n")), "forms")
    roots = last_forms(out.where(F.col("form").isNotNull()).select("word", "form"))
    return out.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = runs_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return group_variants(count_words(runs.select(misspelt(F.col("id"), F.col("run")).alias("word"))))


# The checksum is worked out bit by bit (reflected polynomial 0xEDB88320).
SQL = rf"""
with recursive runs as (select coalesce(cast(doc_id as varchar), '') id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') run, count(*) c
    from (select doc_id, unnest(regexp_extract_all(text, '{RUN}')) run from documents) where length(run) >= {LEAST_LENGTH} group by 1, 2),
bytes as (select *, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: case when unicode(x) < 128 then [unicode(x)]
    else [192 + unicode(x) // 64, 128 + unicode(x) % 64] end)) b from runs),
sums as (select run, c, xor(4294967295, list_reduce(list_transform(range(8 * len(b)), lambda i: cast((b[i // 8 + 1] >> (i % 8)) & 1 as bigint)),
    lambda s, bit: xor(s >> 1, 3988292384 * (xor(s, bit) & 1)), cast(4294967295 as bigint))) h from bytes),
words as materialized (select word, cast(sum(c) as bigint) n from (select c, case when h % 97 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end word
    from sums) where length(word) >= {LEAST_LENGTH} group by word having sum(c) >= {LEAST_COUNT}),
cuts as materialized (select word, i, left(word, i) || substr(word, i + 2) cut from (select word, unnest(range(length(word))) i from words)),
near as materialized (
    select a.word, b.word other from cuts a join cuts b using (i, cut) where a.word <> b.word
    union select word, cut from cuts where cut in (select word from words)
    union select cut, word from cuts where cut in (select word from words)),
best as (select near.word, count(*) over (partition by near.word) n_near, other, words.n other_n from near join words on words.word = other
    qualify row_number() over (partition by near.word order by words.n desc, encode(other)) = 1),
forms as materialized (select word, n, coalesce(n_near, 0) n_near, case when other_n >= 2 * n then other end form, case when other_n >= 2 * n then other_n end form_n
    from words left join best using (word)),
chain as (select word, word as root, form from forms union all
    select chain.word, chain.form, forms.form from chain join forms on forms.word = chain.form)
select word, forms.form, chain.root, n, cast(n_near as bigint) n_near, form_n from forms join chain using (word) where chain.form is null"""
