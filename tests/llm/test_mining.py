"""Spelling variants, hard negatives and line-first cleaning against plain Python on small tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from conftest import rows
from reachlake.llm import hard_negatives as H
from reachlake.llm import quality_rules as Q
from reachlake.llm import spelling_variants as V

GAP = re.compile("[ \t-\r]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# Spelling variants


def plain_variants(counts):
    words = {w: n for w, n in counts.items() if len(w) >= V.LEAST_LENGTH and n >= V.LEAST_COUNT}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v.encode()), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out, key=str)


def counted(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def test_variants_equal_brute_force(spark):
    rnd = random.Random(5)
    stems = ["".join(rnd.choice("abé") for _ in range(rnd.randint(5, 8))) for _ in range(60)]
    counts = Counter()
    for s in stems:
        counts[s] += rnd.randint(3, 400)
        for _ in range(4):
            w = list(rnd.choice([s, *counts]))
            i = rnd.randrange(len(w))
            kind = rnd.randrange(3)
            w[i : i + (kind > 0)] = [] if kind == 1 else [rnd.choice("abcéü")]
            counts["".join(w)] += rnd.randint(1, 60)
    got = sorted([tuple(r) for r in V.group_variants(V.count_words(counted(spark, counts).selectExpr("explode(array_repeat(word, int(n))) as word"))).select(
        "word", "form", "root", "n", "n_near", "form_n").collect()], key=str)
    assert got == plain_variants(counts)


def test_variants_with_hot_nodes_and_small_broadcasts(spark, hot, monkeypatch):
    monkeypatch.setattr(V, "MAX_BROADCAST_EDGES", 3)
    counts = {f"prefix{a}{b}": 3 + 7 * i + 100 * j for i, a in enumerate("abcde") for j, b in enumerate("abcde")}
    got = sorted([tuple(r) for r in V.group_variants(counted(spark, counts)).collect()], key=str)
    assert got == plain_variants(counts)


def test_variants_of_words_beyond_the_trie(spark):
    base = "x" * 30 + "abc" * 30
    long = "ab" * 3000
    edge = "q" * 30 + "r" * (V.MAX_DEPTH - 30)
    counts = {base: 90, base[:40] + "z" + base[41:]: 9, base + "d": 8, base[1:]: 40, long: 50, long[:3000] + long[3001:]: 5,
              edge: 70, edge + "r": 30, edge[:-1]: 7, edge[1:] + "s": 3}
    got = sorted([tuple(r) for r in V.group_variants(counted(spark, counts)).collect()], key=str)
    assert got == plain_variants(counts)


def test_variant_chains_end_at_their_last_form(spark):
    words = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb", "bbbbbb"]
    counts = {w: 3 * 2**i for i, w in enumerate(words)}
    got = {r.word: r.root for r in V.group_variants(counted(spark, counts)).collect()}
    assert got == {w: words[-1] for w in words}


def test_runs_and_misspellings(spark):
    texts = [(i, "Über-Alles naïve WORLD_wide straße ×÷ abc " + chr(0x100) + "hello") for i in range(200)]
    texts += [(None, "Hello hello"), (3, None), (4, ""), (None, "Hello hello"), (9, "e" * 50_000)]
    docs = spark.createDataFrame([(t, i, "clash", 1) for i, t in texts], "text string, doc_id long, run string, n int")
    want = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    runs = V.runs_of(docs, "doc_id", "text").withColumn("id", V.F.col("id"))
    got = V.count_words(runs.select(V.misspelt(V.F.col("id"), V.F.col("run")).alias("word")))
    assert {r.word: r.n for r in got.collect()} == want


def test_variants_of_nothing(spark):
    out = V.group_variants(counted(spark, {"w": 1}).where("false"))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0


# Hard negatives


def plain_negatives(vectors):
    seen = {}
    for i, v, label in vectors:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            q = tuple(int(max(-H.CUT, min(H.CUT, np.floor(256 * float(x))))) for x in v)
            seen[i, q, label] = None
    out = []
    for i, q, label in seen:
        if i % 10:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, p)), j, m) for j, p, m in seen if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            hits = [(n, -t) for t, n, m in scored if m != label and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(i, j, r + 1, n, -s, t) for r, (n, t) in enumerate(hits[:5])]
    return sorted(out)


def mined(spark, vectors):
    df = spark.createDataFrame([(i, v, m, "x", 0) for i, v, m in vectors], "vec_id long, embedding array<float>, label int, id string, gid int")
    return rows(H.mine(df, H.F.col("id") % 10 == 0))


@pytest.mark.parametrize("group,block", [(512, 2048), (4, 8)])
def test_negatives_equal_brute_force(spark, monkeypatch, group, block):
    monkeypatch.setattr(H, "GROUP", group)
    monkeypatch.setattr(H, "BLOCK", block)
    monkeypatch.setattr(H, "LEAST_SLAB", 40)
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(6, 8))
    vectors = [(i, [float(x) for x in centres[i % 6] + 0.3 * rnd.normal(size=8)], int(rnd.integers(3))) for i in range(240)]
    vectors += [(i, vectors[i - 240][1], i % 3) for i in range(240, 300)]  # equal vectors: ties
    vectors += [vectors[0], vectors[0], (10, vectors[3][1], 2), (310, None, 1), (320, [0.1, None], 1), (330, [float("nan")] * 8, 1), (340, [float("inf")] * 8, 0),
                (350, vectors[1][1], None), (None, vectors[1][1], 1), (360, [0.0] * 8, 1), (370, [3e30] * 8, 1), (371, [-3e30] * 8, 1), (380, [], 0)]
    vectors = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v], m) for i, v, m in vectors]
    got, want = mined(spark, vectors), plain_negatives(vectors)
    assert want and got == want


def test_bounds_spare_most_scores():
    rnd = np.random.default_rng(2)
    centres = 900 * rnd.normal(size=(8, 16))
    x = np.concatenate([c + 9 * rnd.normal(size=(120, 16)) for c in centres]).astype(np.int64)
    label = np.repeat(np.arange(8) % 4, 120)
    order, parent, edge = H.spanning_tree(x[::12])
    assert sorted(order) == list(range(80)) and (parent[1:] < np.arange(1, 80)).all() and parent[0] == -1
    anchors = H.Anchors.__new__(H.Anchors)
    anchors.id, anchors.label, anchors.x = np.arange(len(x))[::12][order], label[::12][order], x[::12][order]
    anchors.parent, anchors.edge, anchors.negatives = parent, edge, False
    anchors.windows = [[(H.OPEN, None, H.Best(5))] for _ in order]
    rows_ = x.astype(np.float64)
    scored = anchors.meet(np.arange(len(x)), label, rows_, np.sqrt((rows_ * rows_).sum(axis=1)))
    exact = x[::12][order] @ x.T
    for k in range(80):
        fits = (label == anchors.label[k]) & (np.arange(len(x)) != anchors.id[k])
        want = sorted((-s, i) for i, s in enumerate(exact[k]) if fits[i])[:5]
        best = anchors.windows[k][0][2]
        assert [(-s, i) for s, i in zip(best.score, best.id)] == want
    assert scored < 0.5 * exact.size


def test_negatives_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert H.mine(df, H.F.col("id") % 10 == 0).count() == 0
    assert mined(spark, [(0, [1.0, 2.0], 1)]) == []


# Line-first cleaning


def plain_counts(text):
    text = text or ""
    words = [w for w in GAP.split(text) if w]
    lines = [x for x in text.split("\n") if GAP.sub("", x)]
    seen = Counter(zip(words, words[1:], words[2:]))
    twice = {p + j for p in range(len(words) - 2) if seen[tuple(words[p : p + 3])] > 1 for j in range(3)}
    n = len(words)
    return (n, len("".join(words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice), n < 50 or 100 * len(twice) > 50 * n)


def judged(spark, texts):
    df = spark.createDataFrame([(i, t, "clash", True) for i, t in texts], "doc_id long, text string, cleaned string, kept boolean")
    return Q.clean(df).collect()


def test_counts_equal_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice(["ka", "Lo.", "mé", "#ter*", "us|", "\U0001f600", "en"])
    texts = ["".join(word() + rnd.choice([" ", " ", "\n", "\t", "\x0b", "\r\n", "  "]) for _ in range(rnd.randint(0, 140))) for _ in range(40)]
    texts += [None, "", " \n\t", "a b", "a a a a", "same line\nsame line\n\n \nsame line", "x" * 100_000, "w " * 20_000, "   "]
    got = judged(spark, list(enumerate(texts)))
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(texts[r.doc_id])


@pytest.mark.parametrize("line,rule", [
    ("Home | News | Contact", "navigation"), ("one » two » three go on", "navigation"), (" MENU  login ", "navigation"),
    ("We use cookies to make this site better for all of you.", "boilerplate"), ("All Rights Reserved by nobody at all in the world.", "boilerplate"),
    ("reed*** of### the$$$ and&&& for%%%", "punctuation"), ("Only a heading", "punctuation"), ("It ended.", None), ('"Is it so?"', None),
    ("Überall endet die Zeile…", None), ("a line of at least eight words without any mark", None), ("", None), (" \t\r", None),
    ("we share this", "boilerplate"), ("they reshare this one.", None), ("a > b.", None),
])
def test_line_rules(spark, line, rule):
    df = spark.createDataFrame([(line,)], "line string")
    assert df.select(Q.line_fault(Q.F.col("line"))).first()[0] == rule


def test_cleaned_text_and_verdict(spark):
    body = [f"alpha{i} beta{i} went{i} and gamma{i} came home{i} late{i}." for i in range(12)]
    bars = [f"Home{i} | News{i} | Sport{i} | Video{i} | Contact{i} with{i} all{i} our{i} pages{i}" for i in range(9)]
    texts = [(1, "\n".join(["Home | News | Sport", *body, "", "click here"])), (2, "\n".join([*body, *bars])), (2, "\n".join(body)), (None, "\n".join(body))]
    got = {(r.doc_id, r.n_words): r for r in judged(spark, texts)}
    first = next(r for k, r in got.items() if k[0] == 1)
    assert first.kept and first.cleaned == "\n".join([*body, ""])
    assert [(x.line, x.rule) for x in first.removed] == [(0, "navigation"), (14, "boilerplate")]
    twos = sorted((r.n_words, r.kept, r.base_failed) for k, r in got.items() if k[0] == 2)
    assert [t[1] for t in twos] == [True, False] and not any(t[2] for t in twos)
    assert next(r for k, r in got.items() if k[0] is None).kept


def test_cleaning_nothing(spark):
    out = Q.clean(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and "cleaned" in out.columns
