"""Duplicate operators, classifiers and the pipeline against plain Python on small tables."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from reachlake.llm import embedding_dedup, language_id, line_dedup, minhash_dedup, toxicity


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus(n=60, seed=1):
    """Texts with exact and near copies, shared lines, odd rows and one long text."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["ka", "lo", "mi", "ter", "us", "en"]) for _ in range(rnd.randint(1, 4)))
    line = lambda k: " ".join(word() for _ in range(k))
    shared = [line(rnd.randint(6, 70)) for _ in range(6)]
    texts = []
    for i in range(n):
        lines = [line(rnd.randint(2, 30)) for _ in range(rnd.randint(1, 6))]
        for s in rnd.sample(shared, rnd.randint(0, 3)):
            lines.insert(rnd.randint(0, len(lines)), s)
        texts.append("\n".join(lines))
        if i % 6 == 5:
            w = rnd.choice(texts).split(" ")
            if len(w) > 60:
                w[rnd.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    return texts + [None, "", " \n", "one", "one", "One", line(8000), texts[0], texts[0].upper()]


def docs_of(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "clash", True) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, kept boolean")


def patience_by_recursion(a, b, strong, x=0, y=0):
    """Matched places of two lists of plain lines, ends first, then anchors, then the gaps."""
    if not a:
        return set()
    if b and a[0] == b[0]:
        return {(x, y)} | patience_by_recursion(a[1:], b[1:], strong[1:], x + 1, y + 1)
    if b and a[-1] == b[-1]:
        return {(x + len(a) - 1, y + len(b) - 1)} | patience_by_recursion(a[:-1], b[:-1], strong[:-1], x, y)
    both = [i for i, v in enumerate(a) if strong[i] and a.count(v) == 1 and b.count(v) == 1]
    if not both:
        return set()
    place = [b.index(a[i]) for i in both]
    best = max((c for c in itertools.chain.from_iterable(itertools.combinations(range(len(both)), n) for n in range(len(both) + 1))
                if all(place[p] < place[q] for p, q in zip(c, c[1:]))), key=lambda c: (len(c), [-place[q] for q in reversed(c)]))
    out, i, j = set(), 0, 0
    for q in best:
        out |= {(x + both[q], y + place[q])} | patience_by_recursion(a[i : both[q]], b[j : place[q]], strong[i : both[q]], x + i, y + j)
        i, j = both[q] + 1, place[q] + 1
    return out | patience_by_recursion(a[i:], b[j:], strong[i:], x + i, y + j)


def lost_lines(texts):
    """Line numbers each text loses, over all pairs of texts that the lines' holders make."""
    lines = {i: [x.strip() for x in t.split("\n")] for i, t in enumerate(texts) if t is not None}
    enough = lambda x: len(x.split()) >= line_dedup.MIN_WORDS
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    holders = defaultdict(set)
    for i in lines:
        if first[texts[i]] == i:
            for x in filter(enough, lines[i]):
                holders[x].add(i)
    pairs = {(i, j) for v in holders.values() for i in v for j in (v if len(v) <= line_dedup.RARE else [min(v)]) if j < i}
    out = {i: set() for i in lines}
    for i, j in pairs:
        strong = [enough(x) for x in lines[i]]
        found = patience_by_recursion(lines[i], lines[j], strong)
        for x, y in found:
            block = [(x, y)]
            while (block[-1][0] + 1, block[-1][1] + 1) in found:
                block.append((block[-1][0] + 1, block[-1][1] + 1))
            while (block[0][0] - 1, block[0][1] - 1) in found:
                block.insert(0, (block[0][0] - 1, block[0][1] - 1))
            if any(strong[p] for p, _ in block):
                out[i].add(x)
    for i in lines:
        if first[texts[i]] < i and enough(texts[i]):
            out[i] = set(range(len(lines[i])))
    return out


def check_lines(texts, rows):
    want = lost_lines(texts)
    for i, t in enumerate(texts):
        if t is None:
            assert rows[i]["text"] is None and rows[i]["_removed"] is None
            continue
        assert set(rows[i]["_removed"] or []) == want[i], i
        assert rows[i]["text"] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i])


def test_line_dedup(spark):
    texts = corpus()
    df = docs_of(spark, texts)
    out = line_dedup.dedup_lines(df)
    assert out.columns[: len(df.columns)] == df.columns
    check_lines(texts, {r["doc_id"]: r for r in out.collect()})
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("there,want", [([], 0), ([3, 1, 2], 2), ([1, 1, 1], 3), ([5, 4, 3], 1), ([1, 9, 2, 3, 8, 4], 4)])
def test_alignment_is_longest(there, want):
    got = line_dedup.aligned(list(range(len(there))), there)
    assert len(got) == want and [there[i] for i in got] == sorted(there[i] for i in got)


def groups_by_brute_force(texts):
    """Smallest id per group by weighted Jaccard similarity over all pairs."""
    bags = []
    for t in texts:
        w = low(t).replace("\n", " ").split(" ")
        w = [x for x in w if x]
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else []))
    n = sum(t is not None for t in texts)
    df = Counter(k for b in bags for k in b)
    least = minhash_dedup.least_common(n)
    factor = {k: 1 - minhash_dedup.IDF_SHARE + minhash_dedup.IDF_SHARE * min(1, max(0, np.log(n / min(c, n)) / np.log(n / least))) if c >= least else 1
              for k, c in df.items()}
    low_id = list(range(len(texts)))

    def root(i):
        while low_id[i] != i:
            i = low_id[i]
        return i

    for i in range(len(bags)):
        for j in range(i):
            if bags[i] and bags[j] and bags[i].keys() & bags[j].keys():
                both = sum(factor[k] * min(bags[i][k], bags[j][k]) for k in bags[i].keys() & bags[j].keys())
                every = sum(factor[k] * max(bags[i][k], bags[j][k]) for k in bags[i].keys() | bags[j].keys())
                if both / every >= minhash_dedup.SIMILARITY:
                    a, b = root(i), root(j)
                    low_id[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def test_near_duplicates(spark):
    texts = corpus(80, 2)
    df = docs_of(spark, texts)
    got = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(df).collect()}
    want = groups_by_brute_force(texts)
    assert [got[i]["group_id"] for i in range(len(texts))] == want
    assert len(set(want)) < len(texts) - 10 and all(got[i]["kept"] == (want[i] == i) for i in got)
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_large_buckets_are_dealt_into_groups(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "MAX_GROUP", 8)
    base = " ".join(f"w{i}" for i in range(300))
    texts = [base.replace(f"w{k} ", f"x{k} ") for k in range(10, 70)]
    got = minhash_dedup.near_duplicates(docs_of(spark, texts)).collect()
    assert {r["group_id"] for r in got} == {0} and max(r["n_links"] for r in got) >= 1


@pytest.mark.parametrize("block", [512, 16])
def test_partners_that_fail_do_not_hide_others(spark, monkeypatch, block):
    # Texts with few or many edits: most pairs lie just below the least similarity, and few above.
    monkeypatch.setattr(minhash_dedup, "MAX_GROUP", 16)
    monkeypatch.setattr(minhash_dedup, "MAX_BLOCK", block)
    monkeypatch.setattr(minhash_dedup, "LEADERS", 4)
    rnd = random.Random(6)
    texts = []
    for i in range(90):
        w = [f"w{k}" for k in range(300)]
        for k in rnd.sample(range(5, 295), rnd.choice([3, 4, 4, 5])):
            w[k] = f"x{i}y{k}"
        texts.append(" ".join(w))
    got = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(docs_of(spark, texts)).collect()}
    want = groups_by_brute_force(texts)
    assert 5 < len(set(want)) < 80
    assert [got[i]["group_id"] for i in range(90)] == want


def test_similarities_are_those_of_pairs():
    rng = np.random.default_rng(5)
    terms, n = 60, 9
    count = rng.integers(0, 4, (n, terms)) * (rng.random((n, terms)) < 0.6)
    count[3], factor = 0, rng.uniform(0.8, 1, terms)
    count[4] = count[5]
    text, term = np.nonzero(count)
    got = minhash_dedup.similarities(term.astype(np.uint64), text, count[text, term], count[text, term] * factor[term], n)
    for i, j in itertools.combinations(range(n), 2):
        every = (np.maximum(count[i], count[j]) * factor).sum()
        assert abs(got[i, j] - (np.minimum(count[i], count[j]) * factor).sum() / every) < 1e-12
    assert abs(got[4, 5] - 1) < 1e-12 and minhash_dedup.similarities(np.zeros(0, np.uint64), *[np.zeros(0, int)] * 2, np.zeros(0), 2).max() == 0


def test_forest_keeps_what_hangs_together():
    linked = np.zeros((7, 7), bool)
    for a, b in [(0, 3), (3, 5), (0, 5), (1, 6), (3, 4), (4, 5)]:
        linked[a, b] = linked[b, a] = True
    links = minhash_dedup.forest(linked)
    assert len(links) == 4 and all(linked[a, b] for a, b in links)
    assert {x for a, b in links if 1 not in (a, b) for x in (a, b)} == {0, 3, 4, 5}


def test_spanning_pairs_keep_what_hangs_together():
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 1 << 32, (40, 36), dtype=np.uint64).astype("<u4")
    for i in range(1, 20):
        sig[i] = np.where(rng.random(36) < 0.9, sig[i - 1], sig[i])
    pairs = minhash_dedup.spanning_pairs(np.arange(40), sig)
    assert len(pairs) <= 80 and all((sig[a] == sig[b]).mean() >= 0.5 for a, b in pairs)
    reach = {0}
    for _ in range(40):
        reach |= {y for a, b in pairs if a in reach or b in reach for y in (a, b)}
    assert reach == set(range(20))


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD_CAP", 60)
    monkeypatch.setattr(embedding_dedup, "SHARD_TARGET", 20)
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (400, 16))
    x[200:260] = x[0] + rng.normal(0, 0.05, (60, 16))  # a dense group beyond the cap
    for i in range(300, 340):
        x[i] = x[i - 200] * 3 + rng.normal(0, 0.02, 16)
    x[350:355] = x[10]
    label = [int(k) if k < 3 else 0 for k in rng.integers(0, 12, 400)]
    rows = [(i, v.tolist(), c, "z") for i, (v, c) in enumerate(zip(x, label))]
    rows += [(1000, None, 1, ""), (1001, [0.0] * 16, 1, ""), (1002, [1.0, None], 1, ""), (1003, [float("nan")] * 16, 0, ""),
             (1004, x[0].tolist(), None, ""), (1005, [1e300] * 16, 0, ""), (1006, [1.0] * 16, 0, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, kept string").repartition(5)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    x = np.concatenate([x, np.zeros((5, 16)), np.ones((2, 16))])
    ids, labels = [r[0] for r in rows], [r[2] for r in rows]
    ok = [i for i, r in enumerate(rows) if r[0] not in (1000, 1001, 1002, 1003, 1004)]
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    near = np.zeros((len(rows), len(rows)), bool)
    for i in ok:
        for j in ok:
            near[i, j] = i != j and labels[i] == labels[j] and unit[i] @ unit[j] >= 0.98
    found, true = sum(r["n_links"] for r in got.values()), int(near.sum())
    assert all(got[ids[i]]["n_links"] <= near[i].sum() for i in range(len(rows)))
    assert true > 2000 and found >= 0.97 * true
    assert got[1005]["component_id"] == 1005 and got[1006]["component_id"] == 1005
    assert all(got[k]["kept"] and got[k]["n_links"] == 0 for k in (1000, 1001, 1002, 1003, 1004))
    assert all(got[got[k]["component_id"]]["kept"] for k in got) and got[0]["audited_recall"] >= 0.9
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def links_by_brute_force(x, least=0.98):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    return near


def test_clumps_in_one_shard_all_link(spark):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(0, 1, (5, 32)), 60, axis=0) + rng.normal(0, 0.02, (300, 32))
    x = x[rng.permutation(300)]
    near = links_by_brute_force(x)
    df = spark.createDataFrame([(i, v.tolist(), 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert near.sum(axis=1).min() == 59
    assert [got[i]["n_links"] for i in range(300)] == near.sum(axis=1).tolist()
    assert sum(r["kept"] for r in got.values()) == 5 and got[0]["audited_recall"] == 1.0


def test_links_of_vectors_in_several_shards_count_once(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD_CAP", 300)
    monkeypatch.setattr(embedding_dedup, "SHARD_TARGET", 100)
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(0, 1, (16, 16)), 60, axis=0) + rng.normal(0, 0.05, (960, 16))
    x = x[rng.permutation(960)]
    classes = spark.createDataFrame([(i, i, 1, 0, v.tolist()) for i, v in enumerate(x)], "cls long, rep long, n long, label int, vector array<double>")
    members = embedding_dedup.shards_of(classes)
    shards = {r["cls"]: set(r["shards"]) for r in members.collect()}
    near = links_by_brute_force(x)
    want = [sum(near[i, j] and bool(shards[i] & shards[j]) for j in range(960)) for i in range(960)]
    found = embedding_dedup.search(members, embedding_dedup.graph_of(members), 0.98).groupBy("cls").sum("links").collect()
    got = {r[0]: r[1] for r in found}
    assert sum(want) > 10000 and any(len(shards[i] & shards[j]) > 1 for i in range(960) for j in range(i))
    assert [got.get(i, 0) for i in range(960)] == want


def test_parts_of_a_graph_are_joined():
    x = np.repeat(np.eye(4), 3, axis=0)
    graph = np.kron(np.eye(4), np.ones((3, 3)) - np.eye(3)).astype(np.float32)
    assert len(embedding_dedup.entries(x, graph)) == 4
    assert not embedding_dedup.lowest_reached(12, *np.nonzero(graph)).any()


LETTERS = {"en": "the and with", "fr": "les être où", "de": "der über groß"}


def sentences(lang, n, seed):
    rnd = random.Random(seed)
    words = LETTERS[lang].split()
    return [" ".join(rnd.choice(words) + rnd.choice(["", "en", "er"]) for _ in range(rnd.randint(3, 60))) for _ in range(n)]


def test_language_network(spark):
    rows = [(lang, t) for k, lang in enumerate(LETTERS) for t in sentences(lang, 60, k)]
    random.Random(1).shuffle(rows)
    rows += [("en", None), ("en", ""), ("fr", "12 !!"), (None, "the and with the"), ("de", "über groß " * 3000)]
    df = spark.createDataFrame([(i, t, lang, 0) for i, (lang, t) in enumerate(rows)], "id long, text string, lang string, score int")
    model = language_id.train(df.where("id % 4 <> 2"))
    got = {r["id"]: r for r in language_id.identify(df, model, id_col="id").collect()}
    assert len(got) == len(rows)
    test = [i for i in range(180) if i % 4 == 2]
    assert sum(got[i]["lang_pred"] == rows[i][0] for i in test) >= 0.95 * len(test)
    assert [got[180 + k]["lang_pred"] for k in range(5)] == ["und", "und", "und", "en", "de"]
    assert all(0 <= r["score"] <= 1 and 0 <= r["label_share"] <= 1 for r in got.values())
    none = language_id.train(df.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(df, none, id_col="id").collect()} == {"und"}


@pytest.mark.parametrize("module", ["language_id", "toxicity"])
def test_kept_text_is_sent_once(spark, monkeypatch, module):
    module = {"language_id": language_id, "toxicity": toxicity}[module]
    sent, real = [], module.kept_columns
    monkeypatch.setattr(module, "kept_columns", lambda df, needed: sent.append(dict(needed)) or real(df, needed))
    df = spark.createDataFrame([(1, "one text", "en"), (2, None, None)], "doc_id long, text string, lang string")
    if module is language_id:
        out = language_id.identify(df, language_id.ByteGru(["en", "de"]), keep={"_c0": "text", "_c1": "lang"})
    else:
        none = toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
        sent.clear()
        out = toxicity.score_texts(df, none, keep={"_c0": "text", "_c1": "lang"})
    assert sorted((r["doc_id"], r["_c0"], r["_c1"]) for r in out.collect()) == [(1, "one text", "en"), (2, None, None)]
    assert list(sent[-1].values()).count("text") == 1


def test_gradients_of_the_language_network():
    rng = np.random.default_rng(2)
    model = language_id.ByteGru(["a", "b", "c"], hidden=3)
    symbols, label = rng.integers(0, 257, (4, 12)).astype(np.int16), np.array([0, 1, 2, 1])
    _, g = model.gradients(symbols, label)
    for name in model.p:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        keep = model.p[name][at]
        model.p[name][at] = keep + 0.01
        up, _ = model.gradients(symbols, label)
        model.p[name][at] = keep - 0.01
        down, _ = model.gradients(symbols, label)
        model.p[name][at] = keep
        assert (up - down) / 0.02 == pytest.approx(g[name][at], rel=0.02, abs=1e-4)


def test_pooling_is_the_mean_over_all_positions():
    model = language_id.ByteGru(["a", "b"])
    texts = ["x", "", "some text " * 40, "short"]
    from reachlake.llm.textvec import utf8

    prob, labels = model.pooled(*utf8(pa.array(texts)))
    assert labels.sum(axis=1).tolist() == [len(t) for t in texts]
    assert prob.sum(axis=1) == pytest.approx([1, 0, 1, 1], abs=1e-5)


def test_toxicity_network(spark):
    rnd = random.Random(4)
    bad = ["vile", "scum", "rotten"]
    rows, marks = [], []
    for i in range(400):
        lang = rnd.choice(list(LETTERS))
        words = sentences(lang, 1, i)[0].split()
        toxic = int(rnd.random() < 0.3)
        for _ in range(3 * toxic):
            words.insert(rnd.randint(0, len(words)), rnd.choice(bad) + rnd.choice(["", ",", "."]))
        rows.append((i, " ".join(words), lang, "x"))
        marks.append((i, 1, toxic if i % 3 else None))
    rows += [(900, None, "en", ""), (901, "", None, ""), (902, "the " * 30000, "en", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, predicted string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_texts(docs, toxicity.train(docs, labels)).collect()}
    right = sum(got[i]["predicted"] == any(b in rows[i][1] for b in bad) for i in range(400))
    assert len(got) == len(rows) and right >= 390
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert got[902]["predicted"] == 0
    empty = toxicity.score_texts(docs, toxicity.train(docs, labels.limit(0)))
    assert {r["predicted"] for r in empty.collect()} == {0}


def test_toxicity_tasks_send_only_what_they_changed():
    import pandas as pd

    rng = np.random.default_rng(4)
    moved = np.zeros((5, 20 * toxicity.CHUNK + 7), "<f4")
    for m in moved:
        m[rng.integers(0, moved.shape[1], 40)] = rng.normal(size=40)
    moved[0, -1] = 3
    sent = pd.DataFrame([r for m in moved for r in toxicity._changed(m)], columns=["chunk", "moved"])
    # Numbers that didn't change cost a bit, and chunks without a change nothing.
    assert sent["moved"].map(len).sum() <= len(sent) * toxicity.CHUNK // 8 + 41 * 5 * 4
    got = np.zeros(21 * toxicity.CHUNK, "<f4")
    for c, rows in sent.groupby("chunk"):
        got[c : c + toxicity.CHUNK] = np.frombuffer(toxicity._add_chunks(rows)["moved"][0], "<f4")
    assert np.allclose(got[: moved.shape[1]], moved.sum(axis=0)) and not got[moved.shape[1] :].any()


def test_toxicity_counts_every_labelled_text(spark, monkeypatch):
    """Words of the last of many texts and of the end of a long one are known, and tasks share what they learn."""
    monkeypatch.setattr(toxicity, "TEXTS_PER_TASK", 1500)
    texts = [(i, f"plain words here {i % 7} " + ("vile" if i % 10 == 0 else "kind")) for i in range(7000)]
    texts += [(7000 + i, "quiet " * 40000 + "farewell") for i in range(8)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0 and i < 7000)) for i, _ in texts], "doc_id long, toxic int")
    own = toxicity.labelled_texts(docs.withColumnRenamed("doc_id", "id"), labels.withColumnRenamed("doc_id", "id"))
    assert own.count() == len(texts)
    model = toxicity.fit_texts(own)
    from reachlake.llm.textvec import utf8

    words = toxicity.Words(*utf8(pa.array(["vile kind farewell quiet never"])), breaks=toxicity.MARKS)
    assert (model.lookup(words.hash) > 0).tolist() == [True, True, True, True, False]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_texts(docs, model).collect()}
    assert all(got[i] == int(i % 10 == 0 and i < 7000) for i in got)


def test_pipeline(spark, tmp_path):
    texts = corpus(40, 7)
    texts[3] += " vile vile scum"
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen.append(docs.count())
        if name == "packing":
            assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}
            continue
        assert docs.columns == columns
        rows = {r["doc_id"]: r for r in docs.collect()}
        if name == "language_id":
            assert set(rows) == {i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
        if name == "toxicity":
            assert len(rows) == before.count()
        if name == "line_dedup":
            old = {r["doc_id"]: r["text"] for r in before.collect()}
            assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
            first = {}
            for i in sorted(old):
                for x in old[i].split("\n"):
                    if len(x.split()) >= line_dedup.MIN_WORDS:
                        first.setdefault(x.strip(), i)
            # What is gone is held by an earlier document, and nothing unique is gone.
            for i, t in old.items():
                kept = Counter(x.strip() for x in rows[i]["text"].split("\n")) if i in rows else Counter()
                assert all(first[x] < i for x in (Counter(y.strip() for y in t.split("\n")) - kept) if len(x.split()) >= 5)
        if name == "near_dedup":
            ids = sorted(r["doc_id"] for r in before.collect())
            old = {r["doc_id"]: r["text"] for r in before.collect()}
            want = groups_by_brute_force([old[i] for i in ids])
            assert set(rows) == {ids[k] for k in set(want)}
    assert seen[0] >= seen[1] >= seen[2] >= seen[3] > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[4]


def test_pipeline_on_empty_tables(spark, tmp_path):
    docs_of(spark, ["a"]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_with_one_id_lose_their_own_lines_only(spark):
    """A line shared with an earlier document goes from the row that has it, not from all rows of its id."""
    shared, own = "the quick brown fox jumps over", "some unique words that nobody else has"
    texts = [(0, shared), (1, shared), (1, own), (1, own), (2, own + "\n" + shared), (2, "no shared line stands in this text")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect())
    assert got == [(0, shared), (1, ""), (1, own), (1, own), (2, ""), (2, "no shared line stands in this text")]


def test_copies_go_whole_whatever_their_lines(spark):
    """Refrains, short lines and a third text with the same lines in another order don't save parts of a copy."""
    refrain, verses = "the refrain of this song is sung again", [f"verse {i} has its own words here" for i in range(15)]
    song = "\n".join(x for i, v in enumerate(verses) for x in ([v, refrain] if i % 3 == 0 else [v]))
    short = "\n".join(f"ab {i}" for i in range(30))
    texts = ["\n".join(verses[::-1]), song, song, short, short, "hi", "hi"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert (got[2], got[4], got[6]) == ("", "", "hi") and got[3] == short


def test_short_and_repeated_lines_go_with_their_block(spark):
    block = "a first line of the shared passage\nshort\na second line of the shared passage\nshort\na third line of the shared passage"
    texts = ["own opening\n" + block + "\nown end", "short\nquite another opening\n" + block + "\nthe end", "a first line of the shared passage\n" * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {0: texts[0], 1: "short\nquite another opening\nthe end", 2: ""}


def test_passages_of_long_documents_meet_in_windows(spark):
    own = lambda k: [f"document {k} says this in line {i} alone" for i in range(700)]
    passage = [x for i in range(100) for x in (f"a passage that two documents share {i}", "short")]
    here, there = own(1), own(2)
    here[90:90], there[555:555] = passage, passage
    docs = spark.createDataFrame([(1, "\n".join(here)), (2, "\n".join(there))], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: "\n".join(here), 2: "\n".join(own(2))}


def test_equal_rows_and_null_ids(spark):
    text = "six words stand in this line"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(docs).collect())
    assert got == [(0, text), (1, text), (1, text), (2, ""), (2, "")]


def test_sketches_tell_similarities_apart(spark):
    """Sketches agree about as often as the weighted sets are alike, so pairs well below the bound are not sent."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(base), " ".join(base[:390] + [f"x{i}" for i in range(10)]), " ".join(base[:300] + [f"y{i}" for i in range(100)])]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    weights = minhash_dedup.common_shingles(rows, 10_000)
    classes = minhash_dedup.sample_texts(rows, weights).withColumnRenamed("id", "rep")
    got = {r.cls: np.frombuffer(r.sig, np.uint8) for r in minhash_dedup.sketches_of(classes, classes, rows, weights).collect()}
    sig = [got[r.cls] for r in sorted(classes.collect(), key=lambda r: r.rep)]
    assert len(sig[0]) == minhash_dedup.SKETCH
    for other, want in ((1, 386 / 406), (2, 296 / 496)):
        assert abs((sig[0] == sig[other]).mean() - want) < 0.09
    assert (sig[0] == sig[1]).mean() >= minhash_dedup.LEAST_AGREEING > (sig[0] == sig[2]).mean()
