"""Word and token operators against the libraries and plain Python."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reachlake.llm import bpe, fingerprints, packing, pitman_yor, textvec, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = ["", " ", "a", "  The quick\tbrown\n\nfox, the.", "é" * 40, "word " * 3000, "x" * 5000, "A.. b ., c", "don't <|endoftext|> İ, \x85 \u3000?",
       "Straße, Œuvre.\nété.", "🙂 ok", None]


def table(spark, texts, extra=True):
    rows = [(i, t, "clash", 1.0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, score double")
    return df if extra else df.select("doc_id", "text")


def fuzz(n, seed):
    rnd = random.Random(seed)
    parts = list("ab Aé..,, '\n\t\r!?19ñßüΩ中文🙂ΣÀ") + ["'s", "'LL", "  ", "\x85", "\xa0", "\u3000", "\x1c", "e\u0301", "\u200b", "İ", "ŉ", "×",
                                                     "<|endoftext|>", "<|ENDOFTEXT|>", "<|endof", "the ", "ing"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_words_and_shingles_are_those_of_plain_splitting():
    texts = [t or "" for t in ODD] + fuzz(300, 1)
    w = textvec.Words(*textvec.utf8(pa.array(texts)))
    split = [[x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x] for t in texts]
    assert np.diff(w.first).tolist() == [len(s) for s in split]
    seen = {}
    for h, word in zip(w.hash.tolist(), [x for s in split for x in s]):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)
        assert seen.setdefault(low, h) == h
    assert len(set(seen.values())) == len(seen)
    _, doc = textvec.shingles(w, len(texts))
    assert np.bincount(doc, minlength=len(texts)).tolist() == [max(len(s) - 4, min(len(s), 1)) for s in split]


def test_byte_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, lib = bpe.ByteBpe(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    for t in [x or "" for x in ODD] + fuzz(3000, 2):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_query_columns(spark, tmp_path):
    table(spark, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in bpe.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(ODD) and got[0]["n_tokens"] == 0 and got[len(ODD) - 1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert all(got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(ODD))
    assert bpe.tokenize(table(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    own, lib = packing.WordIds(open(path, encoding="utf-8").read(), max_cached=500), Tokenizer.from_file(path)
    for t in [x or "" for x in ODD] + fuzz(4000, 3):
        assert np.frombuffer(own.encode([t.encode()])[0], "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_many_pieces_are_merged_at_once():
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    own, lib = packing.WordIds(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    pieces = sorted({w.lower() for t in fuzz(600, 5) for w in t.split() if w.lower().isalpha() and packing._LATIN.fullmatch(w)} | {"a", "ab", "aaaaaaaa", "thethethe", "\u00e9" * 40})
    for p, ids in zip(pieces, own.merge(pieces)):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(p, add_special_tokens=False).ids, p
    texts = [x or "" for x in ODD] + fuzz(300, 6)
    for t, ids in zip(texts, own.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t
    assert own.encode([]) == [] and own.encode([b"", b" \n"]) == [b"", b""]


@pytest.mark.parametrize("n", [0, 1, 7, 500, 50_000])
def test_plan_uses_every_piece_once_and_few_sequences(n):
    rng = np.random.default_rng(n)
    length = np.clip(rng.lognormal(6.3, 1.1, n).astype(int), 1, 2048)
    counts = np.bincount(length, minlength=2049)
    plan = packing.plan_packing(counts)
    used = Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 2048
        for x in lengths:
            used[x] += times
    assert used == Counter(length.tolist())
    least = max(math.ceil(length.sum() / 2048), int((length > 1024).sum()))
    assert sum(t for _, t in plan) <= least * 1.05 + 1


def test_plan_finds_exact_singles_pairs_and_triples():
    counts = np.zeros(11, int)
    for x in (7, 3, 8, 1, 1, 5, 2, 2, 1):
        counts[x] += 1
    assert sum(t for _, t in packing.plan_packing(counts)) == 3


def test_every_triple_that_fills_a_gap_is_found():
    # With one piece of each length many sums of two need the same piece twice, or the one held.
    rng = np.random.default_rng(4)
    for _ in range(200):
        lengths = sorted(rng.choice(np.arange(1, 200), 24, replace=False).tolist())
        counts = np.zeros(201, np.int64)
        counts[lengths] = 1
        index, held = packing.ComplementIndex(counts), (lengths[12],)
        sums = {sum(c) for c in itertools.combinations(set(lengths) - set(held), 3)}
        for gap in range(1, 200):
            got = index.triple(gap, held)
            assert (got is not None) == (gap in sums)
            assert got is None or sum(got) == gap and index.times((*held, *got)) == 1


def test_triple_after_many_sums_of_one_piece_twice():
    # 1000 is twice a power of 2 and its complement, of which there is one each, or 400 + 350 + 250.
    twos = [2**k for k in range(9)]
    counts = np.zeros(2049, np.int64)
    counts[[1048, 400, 350, 250, *twos, *(1000 - 2 * x for x in twos)]] = 1
    assert packing.ComplementIndex(counts).triple(1000, (1048,)) == (400, 350, 250)


def test_packing_places_every_piece(spark):
    docs = table(spark, [*ODD, "same text here", "same text here"])
    docs = docs.unionByName(docs.limit(1))
    rows = packing.pack_documents(docs, packing.default_vocabulary(), size=64).collect()
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(packing.default_vocabulary())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by_seq, pieces = {}, Counter()
    for r in rows:
        ids = lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [0]
        assert r["ids"] == ids[r["start"] : r["start"] + r["length"]] and r["start"] == 64 * r["piece"]
        pieces[r["doc_id"]] += 1
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(pieces[d] == -(-(len(lib.encode(t or "", add_special_tokens=False).ids) + 1) // 64) * (2 if d == 0 else 1) for d, t in texts.items())
    for seq in by_seq.values():
        end = 0
        for offset, length in sorted(seq):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack_documents(table(spark, []), packing.default_vocabulary()).count() == 0


def test_fingerprints_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, 300, p=np.arange(400, 0, -1) / 80200)) for _ in range(40)]
    texts += [" ".join(t.split()[: 30 * k]) for k, t in enumerate(texts[:10], 1)]
    parts = fingerprints.fingerprint_array(pa.array(texts), 1000)
    weight = [{w: 1 + math.log(c) for w, c in Counter(t.split()).items()} for t in texts]
    for i in range(10):
        for j in (i + 1, 40 + i):
            a, b = weight[i], weight[j]
            keys = a.keys() | b.keys()
            true = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
            assert abs(fingerprints.likeness(parts[i : i + 1], parts[j : j + 1])[0] - true) < 0.08


@pytest.mark.parametrize("ids", [[5], [9, 3, 7, None, 3, 100, 50, -4], []])
def test_next_text_by_id(spark, ids):
    rows = [(i, None if k == 1 else f"text {k} of {'many ' * k}words", 0) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    got = fingerprints.compare_with_edits(df).collect()
    order = sorted([(-math.inf if i is None else i, t or "") for i, t, _ in rows])
    want = Counter()
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        cut = len(t) // 2
        want[(None if i == -math.inf else i, hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want
    one = fingerprints.fingerprint(df).collect()
    assert Counter(r["fingerprint"] for r in one) == Counter(r["fingerprint"] for r in got)


@pytest.mark.parametrize("shard_tokens", [3_000_000, 40])
def test_language_model_counts_and_normalisation(spark, monkeypatch, shard_tokens):
    # With small shards, words like "the" are frequent and have parts.
    monkeypatch.setattr(pitman_yor, "SHARD_TOKENS", shard_tokens)
    texts = [None, "", "a b a b a b", "A B c", "a b c d", "zzz a b", "a b a b a b"] + [f"the cat sat on mat {i % 7}" for i in range(60)]
    docs = table(spark, texts).withColumn("out", F.col("doc_id") % 5 == 4)
    got = {r["doc_id"]: r for r in pitman_yor.score(docs, held="out").collect()}
    tokens = {i: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split() + [None] for i, t in enumerate(texts)}
    count = Counter(w for i, v in tokens.items() if i % 5 != 4 for w in v)
    n, v = sum(count.values()), len(count)
    for i, words in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i % 5 == 4, len(words), sum(count[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words))
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())
    assert pitman_yor.score(table(spark, [])).count() == 0


def test_each_word_has_a_restaurant_of_its_own(spark):
    # Of 1500 words each is followed by one other; a model that mixes contexts can't tell which.
    n = 1500
    token, context, _ = pitman_yor.token_stream(pa.array([f"c{i} w{i}" for i in range(n)]))
    assert len(set(context.tolist())) == 2 * n + 1
    texts = [f"c{i} w{i}" for i in range(n)] * 4 + [f"c{i} w{i}" for i in range(0, n, 10)] + [f"c{i} w{i + 1}" for i in range(0, n, 10)]
    docs = table(spark, texts).withColumn("out", F.col("doc_id") >= 4 * n)
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score(docs, held="out").collect()}
    right, wrong = (np.array([got[4 * n + k * (n // 10) + i] for i in range(n // 10)]) for k in (0, 1))
    assert (right > wrong + 2).all()
    # The first word is one of n, the other two follow from the word before in more than half of the cases.
    assert (right > -math.log10(n) + 2 * math.log10(0.5) - 0.3).all()


@pytest.mark.parametrize("limit", [3_000_000, 60])
def test_pairs_of_frequent_words_score_alike(spark, monkeypatch, limit):
    # Frequent words are dealt by their contexts, and frequent pairs by blocks; known pairs stay likelier than others.
    monkeypatch.setattr(pitman_yor, "SHARD_TOKENS", limit)
    monkeypatch.setattr(pitman_yor, "BLOCK_TOKENS", 300)
    texts = [f"the a{i % 9} of the b{i % 5}" for i in range(400)] + ["the a1 of the b2", "a1 the the b2 of"]
    docs = table(spark, texts).withColumn("out", F.col("doc_id") >= 400)
    got = {r["doc_id"]: r for r in pitman_yor.score(docs, held="out").collect()}
    assert got[400]["n_known"] == got[401]["n_known"] == 6
    assert got[400]["base_score"] == pytest.approx(got[401]["base_score"])
    # the | start, a1 | the, of | a1, the | of, b2 | the, end | b2
    assert got[400]["score"] == pytest.approx(math.log10(1 / 18 * 1 / 10), abs=0.15)
    assert got[401]["score"] < got[400]["score"] - 4


def test_seating_stays_consistent_and_sums_to_one():
    rng = np.random.default_rng(6)
    words, k = 40, pitman_yor.CONTEXTS
    context = np.tile(np.arange(5), words)
    count = rng.geometric(0.2, 5 * words) * (rng.random(5 * words) < 0.8)
    known = int((count.reshape(words, 5).sum(axis=1) > 0).sum())
    v = np.zeros(2 * k + 8)
    v[:k] = np.bincount(context, count, k)
    v[k : 2 * k] = np.bincount(context, count > 0, k)
    v[2 * k :] = [(count > 0).sum(), known, count.sum(), known, 10, 5, 10, 5]
    totals = pitman_yor.Totals(v, 0)
    s = pitman_yor.Seating(np.full(words, 5), np.zeros(words, int), context, count, totals, 3)
    for _ in range(5):
        s.sweep()
        at = np.add.reduceat(s.at_table, s.first)
        assert (at == s.count[s.active]).all() and (s.at_table >= 0).all()
        assert (np.add.reduceat((s.at_table > 0).astype(int), s.first) == s.tables[s.active]).all()
    place, value = s.sums()
    tables = np.zeros(pitman_yor.Totals.places(0))
    tables[place] = value
    totals.with_tables(tables)
    fresh = (pitman_yor.STRENGTH + totals.root_discount * totals.root_tables) * totals.base
    root = s.root_probability()
    unknown = fresh / (pitman_yor.STRENGTH + totals.root_customers)
    absent = root[count.reshape(words, 5).sum(axis=1) == 0].sum()
    assert root.sum() - absent + unknown == pytest.approx(1)
    p = s.probability().reshape(words, 5)
    gone = (count.reshape(words, 5).sum(axis=1) == 0)
    up = (pitman_yor.STRENGTH + totals.discount * totals.tables[:5]) / (pitman_yor.STRENGTH + totals.customers[:5])
    assert (p[~gone].sum(axis=0) + up * unknown) == pytest.approx(np.ones(5))


RULES = url_filter.parse_rules([("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"),
                                ("block", "b.example.org"), ("allow", "example.com/de/ok"), ("allow", "net/")])
URLS = ["http://example.net/en/1", "https://EXAMPLE.net/de", "http://a.example.com/de/x?y#z", "http://a.example.com/de/okay", "http://notexample.com/de/",
        "http://x.org/fr/", "http://b.example.org", "http://b.example.org?q=://net/", "ftp://net", "net/", None, "", "a://", "x://net/#", "http://net:80/a",
        "http://example.net/en", "http://c.net/\n/en"]


def test_url_rules_by_trie_and_join(spark):
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(URLS + URLS[:2])], "page_id long, url string, rule string")
    trie = {tuple(r) for r in url_filter.judge_urls(df, RULES).collect()}
    assert trie == {tuple(r) for r in url_filter.judge_urls(df, RULES, max_broadcast_rules=0).collect()}
    for i, host, path, rule, verdict in trie:
        url = (URLS + URLS[:2])[i]
        _, sep, rest = (url or "").partition("://")
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        tail = rest[cut:]
        end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
        assert (host, path) == ((rest[:cut].lower(), tail[:end]) if sep else ("", ""))
        fit = [(len(r.text), r.verdict == "block", r.text, r.verdict) for r in RULES
               if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        assert (rule, verdict) == (max(fit)[2:] if fit else (None, "allow"))
    assert url_filter.judge_urls(df.limit(0), RULES).count() == 0


def test_held_out_is_crc32_of_the_id(spark):
    df = spark.range(200)
    got = df.select("id", textvec.held_out(F.col("id"), 7, 2).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 7 == 2) for r in got)
