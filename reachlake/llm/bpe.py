"""Byte-level BPE: encoding with a queue of merge ranks over a linked list of symbols, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from reachlake.llm.textvec import batches_of, kept_columns

# The published split of byte-level BPE, and the code points with the White_Space property.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Bits of an id, and of a place in a piece, in packed numbers.
BITS = 20
PLACE = 40
LAST = (1 << PLACE) - 1


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class ByteBpe:
    """Encoder and decoder from the text of a vocabulary file; caches are bounded by entry counts."""

    def __init__(self, spec: str, max_cached: int = 600_000):
        model = json.loads(spec)
        vocab: dict[str, int] = model["model"]["vocab"]
        letters = byte_letters()
        as_byte = {c: b for b, c in enumerate(letters)}
        self.byte_id = [vocab[c] for c in letters]
        # left id and right id in one number -> rank and id of the joined symbol in one number
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[a] << BITS | vocab[b], rank << BITS | vocab[a + b])
        self.added = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.bytes_of = [b""] * (1 + max(*vocab.values(), *self.added.values()))
        for t, i in vocab.items():
            if all(c in as_byte for c in t):
                self.bytes_of[i] = bytes(map(as_byte.__getitem__, t))
        for t, i in self.added.items():
            self.bytes_of[i] = t.encode()
        self._split_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self._pieces = regex.compile(PIECES.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
        # White space with what follows it is split into pieces without looking at its neighbours.
        self._chunks = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self._of_chunk: dict[str, tuple[int, ...]] = {}
        self._of_piece: dict[bytes, tuple[int, ...]] = {}
        self.max_cached = max_cached

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece: the lowest rank, leftmost first, until no neighbours can merge."""
        ids = [*map(self.byte_id.__getitem__, piece)]
        n = len(ids)
        if n < 2:
            return tuple(ids)
        find, mask = self.merges.get, (1 << BITS) - 1
        queue = [hit >> BITS << PLACE | i for i in range(n - 1) if (hit := find(ids[i] << BITS | ids[i + 1])) is not None]
        heapq.heapify(queue)
        nxt, prv = [*range(1, n + 1)], [*range(-1, n - 1)]
        while queue:
            entry = heapq.heappop(queue)
            i = entry & LAST
            j = nxt[i]
            # An entry is stale once its symbols were merged away or joined to others.
            if ids[i] < 0 or j >= n:
                continue
            hit = find(ids[i] << BITS | ids[j])
            if hit is None or hit >> BITS != entry >> PLACE:
                continue
            joined = hit & mask
            ids[i], ids[j] = joined, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (hit := find(joined << BITS | ids[k])) is not None:
                    heapq.heappush(queue, hit >> BITS << PLACE | i)
            h = prv[i]
            if h >= 0 and (hit := find(ids[h] << BITS | joined)) is not None:
                heapq.heappush(queue, hit >> BITS << PLACE | h)
        return tuple([x for x in ids if x >= 0])

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        out: list[int] = []
        # Letters after at most one space are one piece.
        one = chunk.isascii() and (chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()))
        for piece in [chunk] if one else self._pieces.findall(chunk):
            raw = piece.encode()
            got = self._of_piece.get(raw)
            if got is None:
                got = self.merge(raw)
                if len(raw) <= 64:
                    if len(self._of_piece) >= self.max_cached // 2:
                        self._of_piece.clear()
                    self._of_piece[raw] = got
            out += got
        return tuple(out)

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        cache = self._of_chunk
        for chunk in self._chunks.findall(text):
            got = cache.get(chunk)
            if got is None:
                got = self._chunk(chunk)
                if len(chunk) <= 64:
                    if len(cache) >= self.max_cached:
                        cache.clear()
                    cache[chunk] = got
            out += got
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of the text; the strings of added tokens in it become their ids."""
        if self._split_added is None or not any(t in text for t in self.added):
            return self._plain(text)
        out, at = [], 0
        for m in self._split_added.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.added[m.group()])
            at = m.end()
        return out + self._plain(text[at:])

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[tuple, ByteBpe] = {}


def _encoder(shared) -> ByteBpe:
    """One encoder per Python worker, kept between tasks for its caches."""
    key = (len(shared.value), hash(shared.value))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(shared.value)
    return _LOADED[key]


def tokenize(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
             columns: dict | None = None) -> DataFrame:
    """Encode and decode every text. ``vocabulary`` is the path of a byte-level BPE file on the driver.

    By default ``id_col, ids, decoded``. ``columns`` (name -> (SQL type, function of (ids, decoded)))
    replaces the two by digests made where the ids are, so that long lists need not travel. A null
    text is empty and has no ids; repeated rows are encoded each; texts of any length are encoded
    whole; other columns are ignored. Only the vocabulary, whose size doesn't depend on the data, is
    sent to the tasks.
    """
    rows = kept_columns(docs, {"id": id_col, "text": text_col})
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    columns = columns or {"ids": ("array<int>", lambda ids, _: ids), "decoded": ("string", lambda _, decoded: decoded)}
    kinds = {"array<int>": pa.list_(pa.int32()), "string": pa.string(), "long": pa.int64()}
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{n} {t}" for n, (t, _) in columns.items())

    def run(stream):
        bpe = _encoder(shared)
        for b in batches_of(stream, 1024, 4 << 20):
            made: list[list] = [[] for _ in columns]
            for text in b.column("text").to_pylist():
                ids = bpe.encode(text or "")
                decoded = bpe.decode(ids)
                for out, (_, f) in zip(made, columns.values()):
                    out.append(f(ids, decoded))
            arrays = [b.column("id").combine_chunks()] + [pa.array(m, kinds[t]) for m, (t, _) in zip(made, columns.values())]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, *columns])

    return rows.mapInArrow(run, schema)


_DECIMAL: list[str] = []


def _decimals(ids: list[int]) -> str:
    if not _DECIMAL:
        _DECIMAL.extend(map(str, range(1 << 17)))
    return ",".join(map(_DECIMAL.__getitem__, ids))


def _sha(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return tokenize(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary,
        columns={
            "n_tokens": ("long", lambda ids, _: len(ids)),
            "ids_sha256": ("string", lambda ids, _: _sha(_decimals(ids))),
            "decoded_sha256": ("string", lambda _, decoded: _sha(decoded)),
        })
