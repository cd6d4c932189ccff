"""Language model scores by a hierarchical Pitman-Yor process over words and the words before them.

The restaurant of a context serves the words that follow one word; all of them share the root
restaurant of single words as parent, whose base is uniform over the known words and one unknown.
Everything a word needs, in all contexts, is in one shard, so the seating of its customers is sampled
by Gibbs within a task. A restaurant's customers and tables are spread over the shards of its words:
each shard sends its share of every context it has to the context's range, where shares are added up,
and gets back the sums. That is a shuffle; no list of contexts is collected or broadcast.

A word that would fill a good part of a shard is frequent: each of its (word, context) pairs goes to a
shard of its own choice, whole, and only the word's sums for the root are shared. A pair that is
frequent itself has a part in each block of texts; the parts' customers sit at tables of their own,
and the pair's probability comes from the sums over its parts.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlake.llm.textvec import U64, Words, batches_of, held_out, kept_columns, mix, planes, unplaned, utf8
from reachlake.session import hashed_table, written

CONTEXTS = 256  # contexts that totals have room for where nothing else is said
ROUNDS = 8  # a sweep seats every customer anew, in so many rounds
TOTAL_SWEEPS, BURN_IN, SAMPLES = 2, 2, 2
STRENGTH = 1.0
SHARD_TOKENS = 3_000_000
BLOCK_DOCS, BLOCK_TOKENS = 60_000, 1_500_000
SEATED_AT_ONCE = 500_000  # customers of a shard, by whole words, that a task holds seats for
SHARDS_PER_RANGE = 4  # shards for each range of contexts
CONTEXT_BITS = 48  # of the hash of the word before
END = mix(np.array([0xE0D], np.uint64))[0]
START = mix(np.array([0x57A], np.uint64))[0]


def token_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, context (the word before, or the start) and text number of every token; each text ends with an end token."""
    words = Words(*utf8(texts))
    n, d = len(words.hash), len(texts)
    token, doc = np.empty(n + d, np.uint64), np.empty(n + d, np.int64)
    ends = words.first[1:] + np.arange(d)
    at = np.arange(n) + words.doc
    token[at], doc[at] = words.hash, words.doc
    token[ends], doc[ends] = END, np.arange(d)
    before = np.empty(n + d, np.uint64)
    before[1:] = token[:-1]
    before[words.first[:-1] + np.arange(d)] = START
    return token, before >> U64(64 - CONTEXT_BITS), doc


def sixes(values: np.ndarray) -> bytes:
    """The six low bytes of each number."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unsixed(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


class Frequent(NamedTuple):
    """Hashes of frequent words, and of their frequent pairs with a context, in order."""

    words: np.ndarray
    pairs: np.ndarray


def pair_hash(token: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix(token + mix(context))


def number_in(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash in ``known``, from 1; 0 if it isn't there."""
    if not len(known):
        return np.zeros(len(hashes), np.int32)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at + 1, 0).astype(np.int32)


def frequent_words(rows: DataFrame, tokens: float, limit: float) -> Frequent:
    """Words, and pairs of a word and its context, with ``limit`` or more tokens; at most ``2 * tokens / limit`` of each.

    They have their share of the tokens in some block at least, so only those that do are counted.
    """
    share = limit / max(1.0, tokens)
    if share >= 1:
        return Frequent(np.zeros(0, np.uint64), np.zeros(0, np.uint64))

    def run(stream):
        held, n = [], 0
        for b in batches_of(stream, 512, 1 << 20):
            held.append(token_stream(b.column("text").combine_chunks())[:2])
            n += len(held[-1][0])
            if n >= BLOCK_TOKENS:
                yield often(held, n)
                held, n = [], 0
        if held:
            yield often(held, n)

    def often(held, n):
        token, context = (np.concatenate(x) for x in zip(*held))
        word, count = np.unique(token, return_counts=True)
        ok = count >= max(2, n * share)
        word, count = word[ok], count[ok]
        of = number_in(word, token) > 0
        pair, times = np.unique(pair_hash(token[of], context[of]), return_counts=True)
        ok = times >= max(2, n * share)
        key = np.concatenate([word, pair[ok]]).view(np.int64)
        kind = np.arange(len(key)) >= len(word)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(kind), pa.array(np.concatenate([count, times[ok]]))], ["key", "pair", "n"])

    found = rows.select("text").mapInArrow(run, "key long, pair boolean, n long").groupBy("pair", "key").agg(F.sum("n").alias("n"))
    found = found.where(F.col("n") >= limit / 2).collect()
    return Frequent(*[np.sort(np.array([r["key"] for r in found if r["pair"] == p], np.int64).view(np.uint64)) for p in (False, True)])


def shard_rows(rows: DataFrame, shards: int, frequent: Frequent) -> DataFrame:
    """Per task and block of texts, one row per shard of words, and one with the block's texts.

    Of a shard: its different words, the contexts of each, and the texts of each (word, context).
    """
    bits = shards.bit_length() - 1
    id_type = rows.schema["id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(rows.schema["id"].dataType)
    names = ["shard", "block", "words", "contexts_of", "context", "texts_of", "trained", "text", "frequent", "pair", "ids", "held", "n_tokens"]
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 8, pa.list_(id_arrow), pa.list_(pa.bool_()), pa.list_(pa.int64())]

    def run(stream):
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        docs = tokens = 0

        def block():
            token, context, doc = (np.concatenate(x) for x in list(zip(*held))[:3])
            flags = np.concatenate([h[4] for h in held])
            at = part << 24 | number
            often = number_in(frequent.words, token)
            of = np.flatnonzero(often)
            pairs = np.zeros(len(token), np.int32)
            token[of] = pair_hash(token[of], context[of])
            pairs[of] = number_in(frequent.pairs, token[of])
            of = np.flatnonzero(pairs)
            token[of] = mix(token[of] + mix(np.array([at], np.uint64)))
            order = np.lexsort((context, token))
            often, pairs = often[order], pairs[order]
            token, context, doc = token[order], context[order], doc[order].astype("<u2")
            new_word = np.append(True, token[1:] != token[:-1])
            new_pair = new_word.copy()
            new_pair[1:] |= context[1:] != context[:-1]
            pair, word = np.flatnonzero(new_pair), np.flatnonzero(new_word)
            texts_of = np.diff(np.append(pair, len(token)))
            trained = np.add.reduceat((~flags[doc]).astype(np.int64), pair)
            contexts_of = np.diff(np.append(np.searchsorted(pair, word), len(pair)))
            cuts = np.searchsorted(token[word], np.arange(shards, dtype=np.uint64) << U64(64 - bits)) if bits else np.array([0])
            cuts = np.append(cuts, len(word))
            word_pair = np.append(np.searchsorted(pair, word), len(pair))
            pair_text = np.append(pair, len(token))
            out = []
            for s in np.flatnonzero(np.diff(cuts)):
                w = slice(cuts[s], cuts[s + 1])
                p = slice(word_pair[w.start], word_pair[w.stop])
                t = slice(pair_text[p.start], pair_text[p.stop])
                out.append((int(s), at, token[word[w]].astype("<u8").tobytes(), planes(contexts_of[w]),
                            sixes(context[pair[p]]), planes(texts_of[p]), planes(trained[p]), planes(doc[t], 2),
                            planes(often[word[w]]), planes(pairs[word[w]]), None, None, None))
            ids = [i for h in held for i in h[3]]
            out.append((-1 - at, at, *[b""] * 8, ids, flags.tolist(), np.concatenate([h[5] for h in held]).tolist()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for b in batches_of(stream, 512, 1 << 20):
            token, context, doc = token_stream(b.column("text").combine_chunks())
            flags = b.column("held").to_numpy(zero_copy_only=False).astype(bool)
            held.append((token, context, doc + docs, b.column("id").to_pylist(), flags, np.bincount(doc, minlength=b.num_rows)))
            docs += b.num_rows
            tokens += len(token)
            if docs + 512 > BLOCK_DOCS or tokens >= BLOCK_TOKENS:
                yield block()
                held, docs, tokens, number = [], 0, 0, number + 1
        if held:
            yield block()

    return rows.mapInArrow(run, "shard long, block long, words binary, contexts_of binary, context binary, texts_of binary, "
                           f"trained binary, text binary, frequent binary, pair binary, ids array<{id_type}>, held array<boolean>, n_tokens array<long>")


def merge_shard(pdf):
    """All blocks of a shard: each (word, context) once, and per block which of them its texts hold.

    Rows with a block's texts pass unchanged.
    """
    import pandas as pd

    if pdf["shard"].iloc[0] < 0:
        one = pdf.iloc[0]
        return pd.DataFrame([(one["shard"], one["block"], *[b""] * 10, one["ids"], one["held"], one["n_tokens"])], columns=_MERGED)
    pdf = pdf.sort_values("block")
    word, context, often, pairs, sizes, texts = [], [], [], [], [], []
    for r in pdf.itertuples():
        contexts_of = unplaned(r.contexts_of)
        word.append(np.repeat(np.frombuffer(r.words, "<u8"), contexts_of))
        often.append(np.repeat(unplaned(r.frequent).astype(np.int32), contexts_of))
        pairs.append(np.repeat(unplaned(r.pair).astype(np.int32), contexts_of))
        context.append(unsixed(r.context))
        sizes.append(len(context[-1]))
        texts.append(unplaned(r.text, 2).astype("<u2"))
    word, context = np.concatenate(word), np.concatenate(context)
    trained = np.concatenate([unplaned(x) for x in pdf["trained"]])
    order = np.lexsort((context, word))
    w, c = word[order], context[order]
    new = np.append(True, (w[1:] != w[:-1]) | (c[1:] != c[:-1]))
    number = np.empty(len(w), np.int64)
    number[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    count = np.add.reduceat(trained[order], at)
    new_word = np.append(True, w[at][1:] != w[at][:-1])
    contexts_of = np.diff(np.append(np.flatnonzero(new_word), len(at)))
    often, pairs = (np.concatenate(x)[order][at][new_word] for x in (often, pairs))
    contexts, context = np.unique(c[at], return_inverse=True)
    # Places ascend within a block, so their steps are small.
    steps, k = [], 0
    for n in sizes:
        steps.append(np.diff(number[k : k + n], prepend=0))
        k += n
    return pd.DataFrame([(
        pdf["shard"].iloc[0], 0, planes(contexts_of), planes(often), planes(pairs), steps_of(contexts), planes(context), planes(count),
        planes(np.concatenate(steps)), planes(np.concatenate([unplaned(x) for x in pdf["texts_of"]])), planes(np.concatenate(texts), 2),
        np.array([pdf["block"].to_numpy(), sizes, [len(x) for x in texts]], dtype="<i8").tobytes(), None, None, None)], columns=_MERGED)


_STATE = ["contexts_of", "frequent", "pair", "contexts", "context", "count"]
_MERGED = ["shard", "block", *_STATE, "places", "texts_of", "text", "blocks", "ids", "held", "n_tokens"]


def steps_of(ascending: np.ndarray) -> bytes:
    """Ascending contexts by the steps between them."""
    return planes(np.diff(ascending, prepend=np.uint64(0)), 6)


def unstepped(raw: bytes) -> np.ndarray:
    return np.cumsum(unplaned(raw, 6).astype(np.uint64), dtype=np.uint64)


class Totals:
    """What shards share: customers and tables of each restaurant, of frequent words and pairs, and the discounts.

    Numbers come at the places of one long vector: customers and tables of ``contexts`` restaurants (of
    a shard, in its order), eight for the root, and then for each of ``frequent`` words its tokens and its
    customers at the root, for each of ``pairs`` its customers and tables.
    """

    def __init__(self, v: np.ndarray, frequent: int, pairs: int = 0, contexts: int = CONTEXTS):
        self.frequent, self.pairs, self.contexts = frequent, pairs, contexts
        self.customers, self.tables = v[:contexts], v[contexts : 2 * contexts]
        (self.root_customers, self.root_tables, self.train_tokens, self.words, n1, n2, m1, m2) = v[2 * contexts : 2 * contexts + FIXED]
        self._frequent(v)
        # Of things seen once and twice, as for absolute discounting.
        self.discount = float(np.clip(n1 / max(1.0, n1 + 2 * n2), 0.1, 0.95))
        self.root_discount = float(np.clip(m1 / max(1.0, m1 + 2 * m2), 0.1, 0.95))
        # Frequent words are counted here, their pairs were not.
        self.often_root_tables = (self.often_customers > 0).astype(float)
        self.words += self.often_root_tables.sum()
        self.root_tables += self.often_root_tables.sum()

    def _frequent(self, v: np.ndarray) -> None:
        n, p, k = self.frequent, self.pairs, 2 * self.contexts + FIXED
        self.often_customers, self.often_root_customers = v[k : k + n], v[k + n : k + 2 * n]
        k += 2 * n
        self.pair_customers, self.pair_tables = v[k : k + p], v[k + p : k + 2 * p]

    def with_tables(self, v: np.ndarray) -> "Totals":
        """The same customers with tables of a later seating; frequent words are seated at the root here."""
        fresh = self.fresh
        self.tables = v[self.contexts : 2 * self.contexts]
        self.root_customers, self.root_tables = v[2 * self.contexts], v[2 * self.contexts + 1]
        often, pairs = self.often_customers, self.pair_customers
        self._frequent(v)
        self.often_customers, self.pair_customers = often, pairs
        self.often_root_tables = root_seats(self.often_root_customers.astype(np.int64), fresh, self.root_discount, np.random.default_rng(7))
        self.root_tables = self.root_tables + self.often_root_tables.sum()
        return self

    @staticmethod
    def places(frequent: int, pairs: int = 0, contexts: int = CONTEXTS) -> int:
        return 2 * contexts + FIXED + 2 * frequent + 2 * pairs

    @property
    def base(self) -> float:
        return 1 / (self.words + 1)

    @property
    def fresh(self) -> float:
        """Weight of a new table at the root, for any word."""
        return (STRENGTH + self.root_discount * self.root_tables) * self.base


FIXED = 8


def root_seats(customers: np.ndarray, fresh: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each word at the root, after its customers are seated one after the other.

    Beyond the 64th, a word's customers come in groups of an eighth of those seated.
    """
    left, seated, tables = customers.copy(), np.zeros(len(customers), np.int64), np.zeros(len(customers), np.int64)
    w = np.flatnonzero(left)
    while len(w):
        step = np.minimum(left[w], np.where(seated[w] < 64, 1, seated[w] // 8))
        old = np.maximum(0, seated[w] - discount * tables[w])
        tables[w] += rng.binomial(step, fresh / (fresh + old))
        seated[w] += step
        left[w] -= step
        w = w[left[w] > 0]
    return tables


class Seating:
    """Seats of all customers of a shard's (word, context) pairs, and the tables of its words at the root."""

    def __init__(self, contexts_of: np.ndarray, frequent: np.ndarray, context: np.ndarray, count: np.ndarray, totals: Totals, seed: int,
                 pairs: np.ndarray | None = None):
        self.totals, self.rng = totals, np.random.default_rng(seed)
        self.context, self.count = context.astype(np.int64), count
        self.word = np.repeat(np.arange(len(contexts_of)), contexts_of)
        self.n_words = len(contexts_of)
        # Numbers of the frequent words and pairs that words belong to, from 1.
        self.frequent = frequent
        self.pairs = np.zeros(len(frequent), np.int64) if pairs is None else pairs
        # All customers of a pair start at one table; a pair with one customer never changes.
        self.tables = (count > 0).astype(np.int64)
        self.active = np.flatnonzero(count > 1)
        c = count[self.active]
        self.first = np.cumsum(c) - c
        # One entry per customer, so in small types.
        self.pair = np.repeat(np.arange(len(c), dtype=np.int32), c)
        place = np.arange(len(self.pair), dtype=np.int32)
        place -= self.first.astype(np.int32)[self.pair]
        self.seat = np.zeros(len(self.pair), np.int32)
        self.at_table = np.zeros(len(self.pair), np.int32)
        self.at_table[self.first] = c
        self.round = ((place + self.rng.integers(0, ROUNDS, len(c), dtype=np.int32)[self.pair]) % ROUNDS).astype(np.uint8)
        # Labels of empty tables, a stack per pair.
        place += 1
        self.empty = place
        self.n_empty = c - 1
        self.context_tables = totals.tables.astype(np.float64).copy()
        self.root_tables = np.zeros(self.n_words, np.int64)
        self.seat_root()

    def seat_root(self) -> None:
        """Seat the customers that the contexts' tables send to the root; those of frequent words come from many shards."""
        t = self.totals
        self.root_customers = np.bincount(self.word, self.tables, self.n_words).astype(np.int64)
        own = np.where(self.frequent > 0, 0, self.root_customers)
        self.root_tables = root_seats(own, t.fresh, t.root_discount, self.rng)

    def root_probability(self) -> np.ndarray:
        t = self.totals
        customers, tables = self.root_customers.astype(float), self.root_tables.astype(float)
        part = np.flatnonzero(self.frequent)
        customers[part] = t.often_root_customers[self.frequent[part] - 1]
        tables[part] = t.often_root_tables[self.frequent[part] - 1]
        return (np.maximum(customers - t.root_discount * tables, 0) + t.fresh) / (STRENGTH + t.root_customers)

    def whole_counts(self) -> np.ndarray:
        """Training tokens of each pair, for parts of a frequent pair those of the pair."""
        of = self.pairs[self.word]
        out = self.count.astype(float)
        at = np.flatnonzero(of)
        out[at] = self.totals.pair_customers[of[at] - 1]
        return out

    def word_counts(self) -> np.ndarray:
        """Training tokens of each word, for pairs of a frequent word those of the word."""
        out = np.bincount(self.word, self.count, self.n_words)
        part = np.flatnonzero(self.frequent)
        out[part] = self.totals.often_customers[self.frequent[part] - 1]
        return out

    def sweep(self) -> None:
        """Every customer of a pair with several leaves its table and is seated anew."""
        if len(self.active):
            parent = self.root_probability()[self.word[self.active]]
            for r in range(ROUNDS):
                self._reseat(np.flatnonzero(self.round == r), parent)
        self.seat_root()

    def _reseat(self, who: np.ndarray, parent: np.ndarray) -> None:
        if not len(who):
            return
        d, rng, n = self.totals.discount, self.rng, len(self.active)
        pair = self.pair[who]
        tables = self.tables[self.active]
        count = self.count[self.active]
        slot = self.first[pair] + self.seat[who]
        np.subtract.at(self.at_table, slot, 1)
        gone = np.unique(slot[self.at_table[slot] == 0])
        gone_pair = self.pair[gone]
        lost = np.bincount(gone_pair, minlength=n)
        rank = np.arange(len(gone)) - np.searchsorted(gone_pair, gone_pair)
        self.empty[self.first[gone_pair] + self.n_empty[gone_pair] + rank] = gone - self.first[gone_pair]
        self.n_empty += lost
        tables = tables - lost
        self.seat[who] = -1
        staying = (count - np.bincount(pair, minlength=n))[pair]
        context = self.context[self.active][pair]
        fresh = (STRENGTH + d * self.context_tables[context]) * parent[pair]
        old = np.maximum(0, staying - d * tables[pair])
        new = rng.random(len(who)) * (fresh + old) < fresh
        new |= staying == 0
        label = np.full(len(who), -1)
        open_ = np.flatnonzero(~new)
        while len(open_):
            # A table is as likely as its customers less the discount: take a customer's, keep it or try again.
            p = pair[open_]
            other = self.first[p] + (rng.random(len(open_)) * count[p]).astype(np.int64)
            seat = self.seat[other]
            at = np.maximum(self.at_table[self.first[p] + np.maximum(seat, 0)], 1)
            ok = (seat >= 0) & (rng.random(len(open_)) * at < at - d)
            label[open_[ok]] = seat[ok]
            open_ = open_[~ok]
        made = np.flatnonzero(new)
        made = made[np.argsort(pair[made], kind="stable")]
        made_pair = pair[made]
        rank = np.arange(len(made)) - np.searchsorted(made_pair, made_pair)
        label[made] = self.empty[self.first[made_pair] + self.n_empty[made_pair] - 1 - rank]
        gained = np.bincount(made_pair, minlength=n)
        self.n_empty -= gained
        self.seat[who] = label
        np.add.at(self.at_table, self.first[pair] + label, 1)
        self.tables[self.active] = tables + gained
        self.context_tables += np.bincount(self.context[self.active], gained - lost, self.totals.contexts)

    def probability(self) -> np.ndarray:
        """Predictive probability of every pair's word after its context."""
        t = self.totals
        up = (STRENGTH + t.discount * t.tables[self.context]) * self.root_probability()[self.word]
        of, tables = self.pairs[self.word], self.tables.astype(float)
        at = np.flatnonzero(of)
        tables[at] = t.pair_tables[of[at] - 1]
        return (np.maximum(self.whole_counts() - t.discount * tables, 0) + up) / (STRENGTH + t.customers[self.context])

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of :class:`Totals` that seating changes; those of the restaurants come first."""
        t = self.totals
        k = 2 * t.contexts + FIXED + t.frequent
        word, pair = np.flatnonzero(self.frequent), np.flatnonzero(self.pairs)
        place = np.concatenate([np.arange(t.contexts, 2 * t.contexts + 2), k + self.frequent[word] - 1,
                                k + t.frequent + t.pairs + self.pairs[pair] - 1])
        value = np.concatenate([np.bincount(self.context, self.tables, t.contexts), [self.root_customers.sum(), self.root_tables.sum()],
                                self.root_customers[word], self.root_customers[pair]])
        return place, value.astype(float)


_SHARES = "range long, shard long, contexts binary, numbers binary"


def _shares(shard: int, contexts: np.ndarray, numbers: list[np.ndarray], bits: int, rest: np.ndarray) -> list[tuple]:
    """A shard's numbers of its contexts, a row per range of contexts, and ``rest`` for all, in range -1."""
    cuts = np.searchsorted(contexts, np.arange(1 << bits, dtype=np.uint64) << U64(CONTEXT_BITS - bits))
    cuts = np.append(cuts, len(contexts))
    out = [(r, shard, steps_of(contexts[a:z]), planes(np.concatenate([x[a:z] for x in numbers])))
           for r, (a, z) in enumerate(zip(cuts, cuts[1:])) if z > a]
    return [*out, (-1, shard, b"", rest.astype("<f8").tobytes())]


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows), kinds)], ["range", "shard", "contexts", "numbers"])


def _meet(pdf):
    """Sums over the shards of a range's contexts, for each shard those of its contexts in its order."""
    import pandas as pd

    at = int(pdf["range"].iloc[0])
    if at < 0:
        total = np.sum([np.frombuffer(x, "<f8") for x in pdf["numbers"]], axis=0)
        return pd.DataFrame({"shard": [-1], "range": [at], "numbers": [total.astype("<f8").tobytes()]})
    contexts = [unstepped(x) for x in pdf["contexts"]]
    numbers = [unplaned(x).reshape(-1, len(c)) for x, c in zip(pdf["numbers"], contexts)]
    _, of = np.unique(np.concatenate(contexts), return_inverse=True)
    sums = np.stack([np.bincount(of, x) for x in np.concatenate(numbers, axis=1)]).astype(np.int64)
    out, k = [], 0
    for c in contexts:
        out.append(planes(sums[:, of[k : k + len(c)]].ravel(), 6))
        k += len(c)
    return pd.DataFrame({"shard": pdf["shard"], "range": at, "numbers": out})


def _exchanged(shares: DataFrame, name: str) -> tuple[DataFrame, np.ndarray]:
    """Per shard the sums for its contexts, a list in order of ranges named ``name``, and the sums of what all share."""
    met = written(shares.groupBy("range").applyInPandas(_meet, "shard long, range long, numbers binary"), "met")
    root = met.where("shard = -1").select("numbers").first()
    lists = met.where("shard >= 0").groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("range", "numbers")))["numbers"].alias(name))
    return lists, np.frombuffer(bytes(root["numbers"]), "<f8") if root else np.zeros(0)


def _numbers(parts: list[bytes], contexts: int, kinds: int) -> np.ndarray:
    out = [unplaned(x, 6).reshape(kinds, -1) for x in parts]
    return (np.concatenate(out, axis=1) if out else np.zeros((kinds, 0))).astype(float).reshape(kinds, contexts)


class Shard:
    """Row ``i`` of a batch of merged shards."""

    def __init__(self, b: pa.RecordBatch, i: int):
        self.number = b.column("shard")[i].as_py()
        one = {c: b.column(c)[i].as_py() for c in _STATE}
        self.contexts = unstepped(one.pop("contexts"))
        self.contexts_of, self.frequent, self.pair, self.context, self.count = (unplaned(x) for x in one.values())

    def totals(self, sizes: tuple[int, int], counted: list[bytes], root: np.ndarray) -> Totals:
        """``counted`` and ``root``: what :func:`_exchanged` gave of the customers."""
        k = len(self.contexts)
        return Totals(np.concatenate([_numbers(counted, k, 2).ravel(), root]), *sizes, k)

    def counts(self, sizes: tuple[int, int]) -> tuple[list[np.ndarray], np.ndarray]:
        """Customers and first tables (one a pair) of the contexts, and the numbers behind them in :class:`Totals`."""
        word = np.repeat(np.arange(len(self.contexts_of)), self.contexts_of)
        count, k = self.count, len(self.contexts)
        tokens = np.bincount(word, count, len(self.contexts_of))
        kinds = np.bincount(word, count > 0, len(self.contexts_of))
        own = self.frequent == 0
        known = (own & (tokens > 0)).sum()
        words, pairs = np.flatnonzero(self.frequent), np.flatnonzero(self.pair)
        rest = [np.bincount(of[at] - 1, v[at], n) for n, of, at in ((sizes[0], self.frequent, words), (sizes[1], self.pair, pairs))
                for v in (tokens, kinds)]
        root = [kinds.sum(), known, count.sum(), known, (count == 1).sum(), (count == 2).sum(), (own & (kinds == 1)).sum(), (own & (kinds == 2)).sum()]
        return [np.bincount(self.context, x, k).astype(np.int64) for x in (count, count > 0)], np.concatenate([root, *rest])

    def seatings(self, totals: Totals, run: int):
        """Seatings of the shard's words, some after the other, which keeps the seats in memory few."""
        first = np.append(0, np.cumsum(self.contexts_of))
        group = np.cumsum(np.add.reduceat(self.count, first[:-1])) // SEATED_AT_ONCE
        cuts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
        for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
            of = slice(first[x], first[y])
            yield Seating(self.contexts_of[x:y], self.frequent[x:y], self.context[of], self.count[of], totals,
                          seed=(self.number * 1000 + k) * 10 + run, pairs=self.pair[x:y])


def score(docs: DataFrame, held: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every whole text.

    The model learns from rows whose boolean column ``held`` is not true (all, without one). Tokens
    are lower-cased (A-Z) words between white space, and an end token per text, so that a null or
    empty text has one token. ``score`` is log10 of the product of the tokens' predictive
    probabilities, averaged over seatings; ``base_score`` that of add-one unigrams. Repeated rows count
    and are scored each. Other columns are ignored, an empty table gives an empty result.
    """
    rows = kept_columns(docs, {"id": id_col, "text": text_col, **({"held": held} if held else {})})
    rows = rows.select("id", "text", F.coalesce("held", F.lit(False)).alias("held") if held else F.lit(False).alias("held"))
    id_type = rows.schema["id"].dataType.simpleString()
    size = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    shards = 1 << max(6, int(np.ceil(np.log2(max(1, size / 6 / SHARD_TOKENS)))))
    ranges = max(4, (shards // SHARDS_PER_RANGE).bit_length() - 1)
    merged = "shard long, block long, " + ", ".join(f"{c} binary" for c in _MERGED[2:-3]) + (
        f", ids array<{id_type}>, held array<boolean>, n_tokens array<long>")
    frequent = frequent_words(rows, size / 6, SHARD_TOKENS / 2)
    sizes = len(frequent.words), len(frequent.pairs)
    dealt = shard_rows(rows, shards, frequent).repartition(shards, "shard")
    table = hashed_table(dealt.groupBy("shard").applyInPandas(merge_shard, merged), "shards", ["shard"], shards)
    state = table.where("shard >= 0").select("shard", *_STATE)

    def counts(stream):
        for b in stream:
            out = []
            for i in range(b.num_rows):
                s = Shard(b, i)
                numbers, rest = s.counts(sizes)
                out += _shares(s.number, s.contexts, numbers, ranges, rest)
            if out:
                yield _batch_of(out)

    counted, root = _exchanged(state.mapInArrow(counts, _SHARES), "counted")

    def tables(stream):
        for b in stream:
            out = []
            for i in range(b.num_rows):
                s = Shard(b, i)
                t = s.totals(sizes, b.column("counted")[i].as_py(), root)
                k, v = t.contexts, np.zeros(Totals.places(*sizes, t.contexts))
                for seats in s.seatings(t, 0):
                    for _ in range(TOTAL_SWEEPS):
                        seats.sweep()
                    np.add.at(v, *seats.sums())
                out += _shares(s.number, s.contexts, [v[k : 2 * k].astype(np.int64)], ranges, v[2 * k :])
            if out:
                yield _batch_of(out)

    # The few numbers of each shard's contexts come to the shards, which stay where they are.
    seated, later = _exchanged(state.join(counted.hint("shuffle_hash"), "shard").mapInArrow(tables, _SHARES), "seated")

    def parts(stream):
        for b in stream:
            for i in range(b.num_rows):
                log_p, c = [], []
                shard = Shard(b, i)
                t = shard.totals(sizes, b.column("counted")[i].as_py(), root)
                k = t.contexts
                t.with_tables(np.concatenate([np.zeros(k), _numbers(b.column("seated")[i].as_py(), k, 1)[0], later]))
                for s in shard.seatings(t, 1):
                    for _ in range(BURN_IN):
                        s.sweep()
                    p = 0
                    for _ in range(SAMPLES):
                        s.sweep()
                        p = p + s.probability() / SAMPLES
                    log_p.append(np.log10(p))
                    c.append(s.word_counts()[s.word])
                log_p, c = np.concatenate(log_p), np.concatenate(c)
                base = np.log10((c + 1) / (t.train_tokens + t.words + 1))
                blocks, n_pairs, n_texts = np.frombuffer(b.column("blocks")[i].as_py(), "<i8").reshape(3, -1)
                places, times, k, m = unplaned(b.column("places")[i].as_py()), unplaned(b.column("texts_of")[i].as_py()), 0, 0
                text = unplaned(b.column("text")[i].as_py(), 2)
                out = []
                for block, n, texts in zip(blocks, n_pairs, n_texts):
                    pair = np.repeat(np.cumsum(places[k : k + n]), times[k : k + n])
                    doc = text[m : m + texts]
                    have = np.flatnonzero(np.bincount(doc))
                    out.append((int(block), have.astype("<u2").tobytes(), *[np.bincount(doc, v[pair])[have].astype("<f8").tobytes()
                                                                           for v in (log_p, base, (c > 0).astype(float))]))
                    k, m = k + n, m + texts
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out), [pa.int64(), *[pa.binary()] * 4])],
                                                 ["block", "doc", "score", "base", "known"])

    whole = table.where("shard >= 0").select("shard", *_MERGED[2:-3])
    whole = whole.join(counted.hint("shuffle_hash"), "shard").join(seated.hint("shuffle_hash"), "shard")
    sums = whole.mapInArrow(
        parts, "block long, doc binary, score binary, base binary, known binary")
    texts = table.where("shard < 0").select("block", "ids", "held", "n_tokens")
    train_tokens = int(root[2]) if len(root) else 0

    def gather(pdf):
        import pandas as pd

        of = pdf[pdf["ids"].notna()].iloc[0]
        n = len(of["n_tokens"])
        out = np.zeros((3, n))
        for r in pdf[pdf["doc"].notna()].itertuples():
            doc = np.frombuffer(r.doc, "<u2")
            for k, raw in enumerate((r.score, r.base, r.known)):
                out[k, doc] += np.frombuffer(raw, "<f8")
        return pd.DataFrame({
            id_col: pd.Series(list(of["ids"]), dtype="object" if any(x is None for x in of["ids"]) else None), "held_out": of["held"],
            "n_tokens": of["n_tokens"], "n_known": out[2].round().astype(np.int64), "train_tokens": train_tokens,
            "base_score": out[1], "score": out[0]})

    both = sums.unionByName(texts, allowMissingColumns=True)
    return both.groupBy("block").applyInPandas(
        gather, f"`{id_col}` {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs.withColumn("held", held_out(F.col("doc_id"), 7, 2)), held="held")
