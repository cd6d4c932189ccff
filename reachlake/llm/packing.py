"""Best-fit packing of token lists into sequences of fixed length by exact-complement hashing.

Only the number of pieces of each length decides how sequences are filled, and there are at most
``size`` lengths. So the plan is made from that histogram, whatever the number of documents, as
ranges of pieces of a length; the pieces then find their sequences by their rank within the length.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reachlake.llm.bpe import byte_letters
from reachlake.llm.textvec import batches_of, kept_columns, utf8
from reachlake.session import written

END_ID = 0


class ComplementIndex:
    """Pieces still available by length, with the sums of two that can be formed."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()  # index 0 is unused
        self.size = len(counts) - 1
        self._pairs: np.ndarray | None = None

    def take(self, lengths: Sequence[int], times: int) -> None:
        for x in lengths:
            self.left[x] -= times
            if self.left[x] < 2:
                self._pairs = None

    def times(self, lengths: Sequence[int]) -> int:
        """How often the combination can be formed."""
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        return min(int(self.left[x]) // n for x, n in need.items())

    def single(self, gap: int, base: tuple[int, ...]) -> tuple[int, ...] | None:
        return (gap,) if self.times((*base, gap)) else None

    def pair(self, gap: int, base: tuple[int, ...]) -> tuple[int, ...] | None:
        """The pair with this sum whose larger piece is largest."""
        big = np.arange(gap - 1, (gap - 1) // 2, -1)
        if not len(big):
            return None
        ok = big[(self.left[big] > 0) & (self.left[gap - big] > 0)]
        for a in ok[: 2 + len(base)]:
            if self.times((*base, int(a), int(gap - a))):
                return int(a), int(gap - a)
        return None

    def pair_sums(self) -> np.ndarray:
        """Whether a sum up to ``size`` is that of two available pieces."""
        if self._pairs is None:
            have = (self.left > 0).astype(float)
            n = 4 * (len(have) + 1)
            f = np.fft.rfft(have, n)
            ways = np.fft.irfft(f * f, n)[: self.size + 1]
            once = np.flatnonzero(self.left == 1)
            once = once[2 * once <= self.size]
            ways[2 * once] -= 1  # a single piece doesn't make a pair with itself
            self._pairs = ways > 0.5
        return self._pairs

    def triple(self, gap: int, base: tuple[int, ...]) -> tuple[int, ...] | None:
        """A triple with this sum whose largest piece is largest, looked up by its pair sum."""
        top = np.arange(gap - 2, 0, -1)
        if not len(top):
            return None
        ok = top[(self.left[top] > 0) & self.pair_sums()[gap - top]]
        for a in ok:
            if rest := self.pair(int(gap - a), (*base, int(a))):
                return (int(a), *rest)
        return None

    def exact(self, gap: int, base: tuple[int, ...]) -> tuple[int, ...] | None:
        return self.single(gap, base) or self.pair(gap, base) or self.triple(gap, base)


def plan_packing(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths, times)``: what sequences hold. ``counts[n]`` is the number of pieces of length n.

    The longest piece left opens a sequence. A single, pair or triple that fills its gap exactly is
    used as often as its pieces last; without one the longest piece that fits is added, and the
    rest of the gap is tried again. Each step uses up a length or the last combination of it, so the
    plan is bounded by the number of lengths and not by that of pieces.
    """
    index = ComplementIndex(counts)
    out: list[tuple[tuple[int, ...], int]] = []
    top = index.size
    while True:
        while top and not index.left[top]:
            top -= 1
        if not top:
            return out
        held, gap = (top,), index.size - top
        while gap:
            fill = index.exact(gap, held)
            if fill:
                held, gap = (*held, *fill), 0
                break
            at = np.flatnonzero(index.left[1 : gap + 1]) + 1
            best = next((int(x) for x in at[::-1] if index.times((*held, int(x)))), None)
            if best is None:
                break
            # As many of it as still fit and last, so that small pieces need few steps.
            held, gap = (*held, best), gap - best
        times = index.times(held)
        index.take(held, times)
        out.append((held, times))


def _runs(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows ``(length, first rank, first sequence, pieces of the length per sequence, offset)``."""
    rows, used, sequence = [], {}, 0
    for lengths, times in plan:
        at = 0
        for x in sorted(set(lengths), reverse=True):
            k = lengths.count(x)
            rows.append((x, used.get(x, 0), sequence, k, at))
            used[x] = used.get(x, 0) + k * times
            at += k * x
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack_pieces(pieces: DataFrame, size: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table with ``_part, length, _rank``.

    ``_rank`` numbers the pieces of one length within ``_part`` from 0. The driver sees one count per
    length. Places of parts within a length come from a window over (part, length) counts.
    """
    by = pieces.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n"))
    by = written(by, "packing-counts")
    histogram = {r["length"]: r["n"] for r in by.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    runs = _runs(plan_packing(counts))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = by.select("length", "_part", before.alias("_before"))
    placed = pieces.join(starts, ["length", "_part"])
    shared = pieces.sparkSession.sparkContext.broadcast(runs)
    names = [c for c in pieces.columns if c not in ("_part", "_rank")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in names)

    def run(stream):
        runs = shared.value
        key = runs[:, 0] << 44 | runs[:, 1]
        for b in stream:
            length = b.column("length").to_numpy()
            rank = b.column("_rank").to_numpy() + b.column("_before").to_numpy()
            at = np.searchsorted(key, length << 44 | rank, side="right") - 1
            step = rank - runs[at, 1]
            sequence = runs[at, 2] + step // runs[at, 3]
            offset = runs[at, 4] + step % runs[at, 3] * length
            yield pa.RecordBatch.from_arrays(
                [*[b.column(n) for n in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return placed.mapInArrow(run, f"{schema}, sequence_id long, offset long")


# Words of printable ASCII and Latin letters: they hold no mark that could combine with another.
_LATIN = re.compile(r"[!-~\u00c0-\u024f]+")
_LATIN_LINES = re.compile(r"[\n!-~\u00c0-\u024f]+")


# Texts of ASCII and letters with lead bytes C3-C9, for which marks can be told from letters by bytes.
_PLAIN = bytes([*range(9, 14), *range(32, 127), *range(0x80, 0xC0), *range(0xC3, 0xCA)])
# Punctuation as a dot, all else in such texts as a letter.
_KINDS = bytes(ord(".") if 32 < c < 127 and not chr(c).isalnum() else c if c <= 32 else ord("a") for c in range(256))


def parted(text: bytes) -> bytes:
    """The text in lower case (A-Z) with single marks after a word set apart by a space.

    Ids stay the same and far fewer different words come up. Texts in which marks touch one another,
    or that hold other characters, are only returned as they are.
    """
    if text.translate(None, _PLAIN) or b"<|" in text or b"\xc3\x97" in text or b"\xc4\xb0" in text or b"\xc3\xb7" in text or b".." in text.translate(_KINDS):
        return text
    text = text.lower()
    for mark in (b",", b"."):
        text = text.replace(mark + b" ", b" " + mark + b" ").replace(mark + b"\n", b" " + mark + b"\n")
    return text


NO_RANK = 1 << 48  # above any rank and id


class PairTable:
    """Rank and id of merges by pair, for many pairs at once: open addressing over numpy arrays."""

    def __init__(self, merges: dict[int, int]):
        keys, values = (np.fromiter(x, np.int64, len(merges)) for x in (merges.keys(), merges.values()))
        self.bits = max(8, (8 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int64)
        slot = self.slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == -1)
            self.keys[slot[free]] = keys[free]  # of several in one slot the last stays
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & (len(self.keys) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """``rank << 20 | id`` of each pair, or ``NO_RANK``."""
        slot = self.slots(keys)
        there, out = self.keys.take(slot), self.values.take(slot)
        out[there != keys] = NO_RANK
        look = np.flatnonzero((there != keys) & (there != -1))
        while len(look):
            slot[look] = (slot[look] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[look]]
            hit = there == keys[look]
            out[look[hit]] = self.values[slot[look[hit]]]
            look = look[~hit & (there != -1)]
        return out


class WordIds:
    """Token ids of whole texts as the tokenizers library gives them, each different word encoded once.

    The vocabulary drops white space and never joins across it, so ids of a text are those of its
    runs of other bytes; added tokens hold no white space either. New words in Latin letters are
    merged here, many at once, from the vocabulary's own table; the library encodes all others. Caches are bounded.
    """

    def __init__(self, spec: str, max_cached: int = 150_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        whole = json.loads(spec)
        model, vocab = whole["model"], whole["model"]["vocab"]
        self.added = [t["content"].encode() for t in whole["added_tokens"]]
        end = model["end_of_word_suffix"]
        split = whole["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split)
        self.inner = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.last = np.array([vocab[c + end] for c in byte_letters()], np.int64)
        merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            merges.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        self.merges = PairTable(merges)
        self.cache: dict[bytes, bytes] = {}
        self.of_piece: dict[str, bytes] = {}
        self.max_cached = max_cached

    def merge(self, pieces: Sequence[str]) -> list[bytes]:
        """Ids of each piece (of fewer than 256 bytes): the lowest rank first, leftmost first, one merge a piece and round."""
        data, size = utf8(pa.array(pieces, pa.string()))
        size = np.diff(size)
        begin = np.cumsum(size) - size
        out = self.inner.take(data)
        out[begin + size - 1] = self.last.take(data[begin + size - 1])
        # What is left of the pieces that may still merge: symbols, ranks of pairs by their left one, and which pieces.
        symbols, piece, left = out, np.arange(len(pieces)), size.copy()
        rank = np.full(len(out), NO_RANK)
        rank[:-1] = self.merges.find(out[:-1] << 20 | out[1:])
        rank[begin + size - 1] = NO_RANK
        first = begin
        while len(piece):
            place = np.arange(len(symbols)) - np.repeat(first, left)
            best = np.minimum.reduceat(rank << 8 | place, first)
            done = best >> 8 == NO_RANK
            gone = np.repeat(done, left)
            ended = np.flatnonzero(gone)
            out[np.repeat(begin[piece[done]], left[done]) + place[ended]] = symbols[ended]
            size[piece[done]] = left[done]
            symbols, rank = symbols[~gone], rank[~gone]
            piece, left, best = piece[~done], left[~done], best[~done]
            if not len(piece):
                break
            at = np.cumsum(left) - left + (best & 255)
            symbols[at] = best >> 8 & 0xFFFFF
            rank[at] = rank[at + 1]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            symbols, rank = symbols[stays], rank[stays]
            at -= np.arange(len(at))  # one symbol of each piece before it is gone
            left -= 1
            first = np.cumsum(left) - left
            inner = at[at + 1 < first + left]
            rank[inner] = self.merges.find(symbols[inner] << 20 | symbols[inner + 1])
            rank[at[at + 1 == first + left]] = NO_RANK
            inner = at[at > first]
            rank[inner - 1] = self.merges.find(symbols[inner - 1] << 20 | symbols[inner])
        raw = out.astype("<u4").tobytes()
        return [raw[4 * i : 4 * (i + n)] for i, n in zip(begin.tolist(), size.tolist())]

    def learn(self, words: Sequence[bytes]) -> None:
        """Put the ids of new words into the cache."""
        if not words:
            return
        whole = b"\n".join(words)
        texts = whole.decode().split("\n")
        if max(map(len, words)) > 64 or not _LATIN_LINES.fullmatch(whole.decode()) or any(t in whole for t in self.added):
            own = [len(raw) <= 64 and bool(_LATIN.fullmatch(text)) and not any(t in raw for t in self.added) for raw, text in zip(words, texts)]
            for raw, text, here in zip(words, texts, own):
                if not here:
                    ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                    self.cache[raw] = struct.pack(f"<{len(ids)}I", *ids)
            words, texts = [*compress(words, own)], [*compress(texts, own)]
        texts = [*map(str.lower, texts)]
        one = [*map(str.isalpha, texts)]
        cut = {raw: self.pieces.findall(text) for raw, text, alone in zip(words, texts, one) if not alone}
        known = self.of_piece
        new = [*set(compress(texts, one)).union(*cut.values()).difference(known)]
        if new:
            known.update(zip(new, self.merge(new)))
        self.cache.update(zip(compress(words, one), map(known.__getitem__, compress(texts, one))))
        for raw, pieces in cut.items():
            self.cache[raw] = b"".join(map(known.__getitem__, pieces))

    def encode(self, texts: Sequence[bytes]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers.

        Words of all texts are numbered by Arrow, so that each different one is looked up once a call.
        """
        cache = self.cache
        words = pc.ascii_split_whitespace(pa.array([*map(parted, texts)], pa.large_binary()).cast(pa.large_string()))
        numbered = words.flatten().dictionary_encode()
        if len(cache) > self.max_cached:
            cache.clear()
        if len(self.of_piece) > self.max_cached // 2:
            self.of_piece.clear()
        known = numbered.dictionary.cast(pa.large_binary()).to_pylist()
        self.learn([w for w in known if w not in cache])
        ids = [*map(cache.__getitem__, known)]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        all_ids = np.frombuffer(b"".join(ids), "<u4")
        if not len(all_ids):
            return [b""] * len(texts)
        number = numbered.indices.to_numpy()
        count = size.take(number)
        end = np.cumsum(count)
        # From the place of an id in the texts to that among the ids of all different words.
        shift = (np.cumsum(size) - size).take(number) - (end - count)
        flat = all_ids.take(np.repeat(shift, count) + np.arange(end[-1]))
        bounds = np.append(0, end).take(words.offsets.to_numpy()).tolist()
        return [flat[i:j].tobytes() for i, j in zip(bounds, bounds[1:])]


_LOADED: dict[tuple, WordIds] = {}


def _word_ids(shared) -> WordIds:
    key = (len(shared.value), hash(shared.value))
    if key not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED.clear()
        _LOADED[key] = WordIds(shared.value)
    return _LOADED[key]


def _ids_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4")


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text",
                   columns: dict | None = None) -> DataFrame:
    """Pieces of all texts with their places: ``id_col, piece, start, length, ..., sequence_id, offset``.

    A text gives its ids and then ``END_ID``; only longer lists are cut, after every ``size`` ids. A
    null text is empty and gives one piece of length 1. Repeated rows are packed each, equal ids or
    not. Other columns are ignored, an empty table gives an empty result. By default a piece carries
    its ``ids``; ``columns`` (name -> (SQL type, function of the ids as little-endian bytes)) replaces
    them by digests made on the spot. Sequence numbers are dense but in no particular order.
    """
    rows = kept_columns(docs, {"id": id_col, "text": text_col})
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    columns = columns or {"ids": ("array<int>", lambda raw: _ids_of(raw).astype(np.int32))}
    kinds = {"array<int>": pa.list_(pa.int32()), "long": pa.int64(), "string": pa.string()}
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, piece int, start long, length long, " + ", ".join(
        f"`{n}` {t}" for n, (t, _) in columns.items()) + ", _part int, _rank long"

    def run(stream):
        words, part = _word_ids(shared), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        cut = 4 * size
        for b in batches_of(stream, 512, 4 << 20):
            ids = words.encode([(t or "").encode() for t in b.column("text").to_pylist()])
            doc, piece, length, rank, made = [], [], [], [], [[] for _ in columns]
            for i, raw in enumerate(ids):
                raw += END_ID.to_bytes(4, "little")
                for k in range(0, len(raw), cut):
                    one = raw[k : k + cut]
                    n = len(one) // 4
                    doc.append(i)
                    piece.append(k // cut)
                    length.append(n)
                    rank.append(seen.get(n, 0))
                    seen[n] = rank[-1] + 1
                    for out, (_, f) in zip(made, columns.values()):
                        out.append(f(one))
            piece = pa.array(piece, pa.int32())
            start = pa.array(np.array(piece, np.int64) * size)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").combine_chunks().take(pa.array(doc, pa.int64())), piece, start, pa.array(length, pa.int64()),
                 *[pa.array(m, kinds[t]) for m, (t, _) in zip(made, columns.values())],
                 pa.array([part] * len(doc), pa.int32()), pa.array(rank, pa.int64())],
                [id_col, "piece", "start", "length", *columns, "_part", "_rank"])

    return pack_pieces(written(rows.mapInArrow(run, schema), "pieces"), size)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, vocabulary or default_vocabulary(), columns={"ids_crc32": ("long", zlib.crc32)})
