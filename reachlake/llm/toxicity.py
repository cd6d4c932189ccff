"""Toxicity of texts by a convolutional network over hashed words, with thresholds per language.

Words are hashed, and the hashes that occur in several training texts have an embedding of their own;
all others share one. Filters of several widths slide over the whole text, the largest value of each
is kept, and a linear layer turns these into a score. The language that selects the threshold is read
from the text by the same words, never from a column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlake.llm.textvec import MARKS, Words, batches_of, held_out, kept_columns, planes, unplaned, utf8
from reachlake.session import written

WIDTHS = (1, 2, 3)
FILTERS = 8
DIMENSIONS = 8
# Every labelled text is counted and fitted; the driver holds what is known of words, never texts.
TEXTS_PER_TASK, WORDS_PER_TASK = 8000, 4_000_000
LEAST_TEXTS, LEAST_SHARE = 3, 50_000  # a word with an embedding is in so many texts, and in one of so many
SEEN = 40_000  # texts that the epochs show in all, between two and six times each
BATCH, RATE = 48, 0.02
CHUNK = 1 << 14  # numbers of a model that are added up together
STEPS_PER_LOGIT = 1000  # resolution of thresholds
MAX_LANGUAGES = 64


class WordCnn:
    """Embedding table, filters and output weights; row 0 of the table is for unknown words."""

    def __init__(self, seed: int = 5):
        self.seed = seed
        self.keys = np.zeros(0, np.uint64)
        self.languages: list[str] = [""]
        self.language_odds = np.zeros((1, 1), np.float32)
        self.threshold = np.zeros(1)
        self.trained = False
        self.tables = None  # products for scoring, made where they are used

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at + 1, 0)

    def _products(self, embedding: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """The product of embeddings and each filter's part, a row per word."""
        return {(w, k): embedding @ self.filters[w][k] for w in WIDTHS for k in range(w)}

    def features(self, index: np.ndarray, first: np.ndarray, where: bool = False):
        """Largest filter value per text ``[texts, filters]``; with ``where`` also its word's place.

        A filter of width w sees the word and the w - 1 after it, as far as the text goes.
        """
        n, texts = len(index), len(first) - 1
        count = np.diff(first)
        full = np.flatnonzero(count > 0)
        out = np.zeros((texts, FILTERS * len(WIDTHS)), np.float32)
        place = np.zeros((texts, FILTERS * len(WIDTHS)), np.int64)
        if not n:
            return out, place
        last = np.repeat(first[1:][full], count[full])
        if where:
            # Few words of the table are in a batch of training.
            used, index = np.unique(index, return_inverse=True)
            tables = self._products(self.embedding[used])
        else:
            tables = self.tables = self._products(self.embedding) if self.tables is None else self.tables
        for i, w in enumerate(WIDTHS):
            cols = slice(i * FILTERS, (i + 1) * FILTERS)
            value = np.zeros((n, FILTERS), np.float32)
            for k in range(w):
                inside = np.arange(n - k) + k < last[: n - k]
                value[: n - k] += tables[w, k].take(index[k:], axis=0) * inside[:, None]
            out[full, cols] = np.maximum.reduceat(value, first[:-1][full], axis=0)
            if where:
                for j in range(FILTERS):
                    hit = np.flatnonzero(value[:, j] == np.repeat(out[full, i * FILTERS + j], count[full]))
                    d = np.searchsorted(first, hit, side="right") - 1
                    place[d[::-1], i * FILTERS + j] = hit[::-1]
        return out, place

    def logits(self, index: np.ndarray, first: np.ndarray) -> np.ndarray:
        value, _ = self.features(index, first)
        return np.maximum(value + self.bias, 0) @ self.out + self.shift

    def language(self, index: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Number of the likeliest language of each text by the odds of its words."""
        texts = len(first) - 1
        sums = np.zeros((texts, len(self.languages)))
        doc = np.repeat(np.arange(texts), np.diff(first))
        for j in range(len(self.languages)):
            sums[:, j] = np.bincount(doc, self.language_odds[:, j].take(index), texts)
        return sums.argmax(axis=1)

    def scores(self, index: np.ndarray, first: np.ndarray) -> np.ndarray:
        """0 to 1; 0.5 is the threshold of the text's language."""
        if not self.trained:
            return np.zeros(len(first) - 1)
        z = self.logits(index, first) - self.threshold[self.language(index, first)]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def start(self, keys: np.ndarray, in_class: np.ndarray, texts_of: np.ndarray) -> "WordCnn":
        """Weights before training, from the fitted texts of each class that hold a word and all of each class.

        The first dimension of an embedding starts at the log odds of the word in toxic and other texts.
        """
        rng = np.random.default_rng(self.seed)
        self.keys, v = keys, len(keys) + 1
        n0, n1 = np.maximum(1, texts_of)
        odds = np.log((in_class[1] + 0.3) / (n1 + 0.6)) - np.log((in_class[0] + 0.3) / (n0 + 0.6))
        self.embedding = rng.normal(0, 0.05, (v, DIMENSIONS)).astype(np.float32)
        self.embedding[1:, 0] = odds / 3
        self.embedding[0] = 0
        self.filters = {w: rng.normal(0, 0.1, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS}
        for w in WIDTHS:
            self.filters[w][0, 0] += 1
        k = FILTERS * len(WIDTHS)
        self.bias = np.full(k, -0.5, np.float32)
        self.out = rng.normal(1.0 / k, 0.1 / k, k).astype(np.float32)
        self.shift = np.float32(0)
        self.trained = True
        return self

    def vector(self) -> np.ndarray:
        """All trained numbers, one after the other."""
        return np.concatenate([x.ravel() for x in (self.bias, self.out, np.array([self.shift]), *self.filters.values(), self.embedding)])

    def set_vector(self, v: np.ndarray) -> None:
        at, self.tables = 0, None

        def take(shape):
            nonlocal at
            n = int(np.prod(shape))
            at += n
            return v[at - n : at].reshape(shape).astype(np.float32)

        self.bias, self.out = take(self.bias.shape), take(self.out.shape)
        self.shift = take((1,))[0]
        self.filters = {w: take(f.shape) for w, f in self.filters.items()}
        self.embedding = take(self.embedding.shape)

    def epoch(self, index: list[np.ndarray], toxic: np.ndarray, rate: float, seed: int) -> None:
        """One pass over all texts (arrays of rows of the table); the smaller class is shown several times."""
        rng = np.random.default_rng([self.seed, seed])
        classes = [c for c in (np.flatnonzero(toxic == 1), np.flatnonzero(toxic == 0)) if len(c)]
        each = BATCH // len(classes)
        steps = max(10, -(-max(map(len, classes)) // each))
        shown = [np.concatenate([rng.permutation(c) for _ in range(-(-steps * each // len(c)))]) for c in classes]
        slow = {}

        def adam(name, value, g, lr):
            m, s = slow.get(name, (0.0, 0.0))
            slow[name] = m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            return (value - lr * m / (np.sqrt(s) + 1e-4)).astype(np.float32)

        for step in range(steps):
            pick = np.concatenate([x[step * each : (step + 1) * each] for x in shown])
            part = [index[i] for i in pick]
            first = np.append(0, np.cumsum([len(x) for x in part]))
            flat = np.concatenate(part)
            value, place = self.features(flat, first, where=True)
            act = np.maximum(value + self.bias, 0)
            z = act @ self.out + self.shift
            dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - toxic[pick]) / len(pick)
            dact = np.outer(dz, self.out) * (value + self.bias > 0)
            dact[np.diff(first) == 0] = 0
            new_filters, g_embed = {}, []
            for i, w in enumerate(WIDTHS):
                g = dact[:, i * FILTERS : (i + 1) * FILTERS]
                at = place[:, i * FILTERS : (i + 1) * FILTERS]
                gf = np.zeros_like(self.filters[w])
                for c in range(w):
                    spot = at + c
                    ok = spot < first[1:, None]
                    word = np.where(ok, flat[np.minimum(spot, len(flat) - 1)], 0) if len(flat) else np.zeros_like(spot)
                    gg = g * ok
                    gf[c] = np.einsum("btd,bt->dt", self.embedding[word], gg)
                    g_embed.append((word.ravel(), (gg[:, :, None] * self.filters[w][c].T[None]).reshape(-1, DIMENSIONS)))
                new_filters[w] = adam(f"f{w}", self.filters[w], gf + 1e-4 * self.filters[w], rate)
            self.out = adam("out", self.out, act.T @ dz + 1e-3 * self.out, rate)
            self.bias = adam("bias", self.bias, dact.sum(axis=0), rate)
            self.shift = np.float32(adam("shift", np.array([self.shift]), np.array([dz.sum()]), rate)[0])
            self.filters = new_filters
            for word, g in g_embed:
                keep = word > 0
                np.add.at(self.embedding, word[keep], (-2 * rate * g[keep]).astype(np.float32))

    def set_languages(self, names: list[str], seen: np.ndarray) -> None:
        """Odds of the languages of each row of the table, from the words counted in each."""
        self.languages = names or [""]
        seen = seen + 0.1
        odds = np.log(seen / seen.sum(axis=0))
        self.language_odds = (odds - odds.mean(axis=1, keepdims=True)).astype(np.float32)
        self.language_odds[0] = 0
        self.threshold = np.zeros(len(self.languages))

    def set_thresholds(self, lang: np.ndarray, z: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> None:
        """For each language the logit with the fewest errors, both classes weighted as they occur.

        ``n`` check texts have the language, logit and class. All languages' texts count a little, so that
        one with few of them stays near the rest. The threshold lies in the middle of the best gap.
        """
        values, at = np.unique(z, return_inverse=True)
        cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
        gap = np.diff(np.concatenate([[cuts[0] - 1], values, [cuts[-1] + 1]]))
        for j in range(len(self.languages)):
            weight = np.where(lang == j, 1.0, 0.1) * n
            bad, good = (np.append(0, np.cumsum(np.bincount(at, weight * (toxic == c), len(values)))) for c in (1, 0))
            wrong = bad + good[-1] - good
            best = np.flatnonzero(wrong <= wrong.min() + 1e-6)
            self.threshold[j] = cuts[best[np.argmax(gap[best])]]


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``id, text, toxic, lang, check`` of all texts ``id, text, lang`` with a label ``id, toxic``.

    One id in five sets the thresholds (``check``) and is not fitted.
    """
    marks = labels.where(F.col("toxic").isin(0, 1)).groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    # Sent by id at every size: labels grow with the texts, so a broadcast of them would too.
    return docs.join(marks.hint("merge"), "id").select(
        "id", "text", "toxic", F.coalesce("lang", F.lit("")).alias("lang"), (F.pmod(F.xxhash64("id"), F.lit(5)) == 0).alias("check"))


def _count_words(stream):
    """Texts and occurrences of each word per language, class and use, one batch after the other."""
    kinds = ["lang", "toxic", "check"]
    for b in batches_of(stream, 512, 2 << 20):
        words = Words(*utf8(b.column("text")), breaks=MARKS)
        if not len(words.hash):
            continue
        kind = b.select(kinds).to_pandas()
        group = kind.groupby(kinds, sort=True).ngroup().to_numpy()
        order = np.lexsort((words.doc, words.hash))
        word, doc = words.hash[order], words.doc[order]
        at = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])))
        times, word, of = np.diff(np.append(at, len(word))), word[at], group[doc[at]]
        order = np.lexsort((of, word))
        word, of, times = word[order], of[order], times[order]
        at = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (of[1:] != of[:-1])))
        row = np.unique(group, return_index=True)[1][of[at]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(word[at].view(np.int64)), *[b.column(c).combine_chunks().take(pa.array(row)) for c in kinds],
             pa.array(np.diff(np.append(at, len(word)))), pa.array(np.add.reduceat(times, at))], ["word", *kinds, "texts", "times"])


def _changed(moved: np.ndarray) -> list[tuple[int, bytes]]:
    """The chunks of a vector that aren't zero, each as a bit per number and the numbers other than zero.

    A task meets a bounded number of words however many a model knows, so what it sends is bounded too.
    """
    out = []
    for c in range(0, len(moved), CHUNK):
        part = np.zeros(CHUNK, "<f4")
        part[: len(moved) - c] = moved[c : c + CHUNK]
        if part.any():
            out.append((c, np.packbits(part != 0).tobytes() + part[part != 0].tobytes()))
    return out


def _add_chunks(pdf):
    import pandas as pd

    total = np.zeros(CHUNK)
    for raw in pdf["moved"]:
        total[np.unpackbits(np.frombuffer(raw, np.uint8, CHUNK // 8)).astype(bool)] += np.frombuffer(raw, "<f4", offset=CHUNK // 8)
    return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "moved": [total.astype("<f4").tobytes()]})


def _one_row(stream):
    """All texts of a task as one row, so that they stay together wherever they are read."""
    words, kinds = [], []
    for b in stream:
        words += b.column("words").to_pylist()
        kinds.append(np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.uint8) for c in ("toxic", "check")]))
    if words:
        toxic, check = np.concatenate(kinds, axis=1)
        sizes = np.array([len(x) // 4 for x in words])
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (
            planes(np.frombuffer(b"".join(words), "<i4")), planes(sizes), toxic.tobytes(), check.tobytes())], ["words", "sizes", "toxic", "check"])


def _texts_of(stream):
    """Per row of :func:`_one_row` the texts' words and their classes and uses."""
    for b in stream:
        for words, sizes, toxic, check in zip(*(b.column(c).to_pylist() for c in ("words", "sizes", "toxic", "check"))):
            texts = np.split(unplaned(words).astype("<i4"), np.cumsum(unplaned(sizes))[:-1])
            yield texts, np.frombuffer(toxic, np.uint8).astype(np.int32), np.frombuffer(check, np.uint8).astype(bool)


def fit_texts(texts: DataFrame) -> WordCnn:
    """A network fitted on all ``texts`` of :func:`labelled_texts`.

    Words are counted by Spark. In each epoch every task passes over all its texts from the same weights;
    the mean of what the tasks have learnt, weighted by their texts, starts the next epoch.
    """
    texts = written(texts, "labelled")
    model = WordCnn()
    share = texts.sparkSession.sparkContext.broadcast
    sizes = texts.groupBy("toxic", "check").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars")).collect()
    n_of = {(r["toxic"], r["check"]): r["n"] for r in sizes}
    rows = sum(n_of.values())
    if len({c for c, _ in n_of}) < 2:
        return model
    names = [r["lang"] for r in texts.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES).collect()]
    # A class without check texts, or without others, is used for both.
    both = any((c, k) not in n_of for c in (0, 1) for k in (True, False))
    fitted = F.lit(True) if both else ~F.col("check")
    counts = texts.select("text", "lang", "toxic", "check").mapInArrow(
        _count_words, "word long, lang string, toxic int, check boolean, texts long, times long")
    in_lang = [F.sum(F.when(F.col("lang") == x, F.col("times")).otherwise(0)).alias(f"l{j}") for j, x in enumerate(names)]
    in_class = [F.sum(F.when((F.col("toxic") == c) & fitted, F.col("texts")).otherwise(0)).alias(f"c{c}") for c in (0, 1)]
    words = written(counts.groupBy("word").agg(F.sum("texts").alias("texts"), *in_class, *in_lang), "word-counts")
    known = words.where(F.col("texts") >= max(LEAST_TEXTS, rows // LEAST_SHARE)).toArrow()
    rest = words.where(F.col("texts") < max(LEAST_TEXTS, rows // LEAST_SHARE)).agg(*[F.sum(f"l{j}") for j in range(len(names))]).first()
    keys = known.column("word").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    of = {c: known.column(c).to_numpy()[order] for c in known.column_names if c not in ("word", "texts")}
    n_fit = np.array([sum(n for (t, check), n in n_of.items() if t == c and (both or not check)) for c in (0, 1)])
    model.start(keys[order], np.stack([of["c0"], of["c1"]]), n_fit)
    model.set_languages(names, np.stack([np.append(rest[j] or 0, of[f"l{j}"]) for j in range(len(names))], axis=1).astype(float))
    tasks = int(max(1, rows // TEXTS_PER_TASK, sum(r["chars"] for r in sizes) // 6 // WORDS_PER_TASK))
    shared = share(model)

    def indexed(stream):
        for b in batches_of(stream, 512, 2 << 20):
            words = Words(*utf8(b.column("text")), breaks=MARKS)
            index = shared.value.lookup(words.hash).astype("<i4")
            parts = [index[a:z].tobytes() for a, z in zip(words.first, words.first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()), *[b.column(c).combine_chunks() for c in ("toxic", "check")]],
                                             ["words", "toxic", "check"])

    table = written(texts.select("text", "toxic", "check").mapInArrow(indexed, "words binary, toxic int, check boolean")
                    .repartition(tasks, "words").mapInArrow(_one_row, "words binary, sizes binary, toxic binary, check binary"), "indexed")
    epochs = int(np.clip(-(-SEEN // rows), 2, 6))
    for e in range(epochs):
        shared = share(model)

        def learn(stream, shared=shared, rate=RATE * (1 - e / epochs), seed=e):
            for index, toxic, check in _texts_of(stream):
                order = sorted(np.flatnonzero(~check | both), key=lambda i: (index[i].tobytes(), toxic[i]))
                if not order:
                    continue
                own = WordCnn()
                own.__dict__.update(shared.value.__dict__)
                own.embedding = own.embedding.copy()
                before = own.vector()
                own.epoch([index[i] for i in order], toxic[order], rate, seed)
                for c, moved in _changed(((own.vector() - before) * len(order)).astype("<f4")):
                    yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([moved], pa.binary())], ["chunk", "moved"])

        sums = table.mapInArrow(learn, "chunk long, moved binary").groupBy("chunk").applyInPandas(_add_chunks, "chunk long, moved binary")
        v = model.vector().astype(float)
        for r in sums.collect():
            part = np.frombuffer(bytes(r["moved"]), "<f4")[: len(v) - r["chunk"]]
            v[r["chunk"] : r["chunk"] + len(part)] += part / n_fit.sum()
        model.set_vector(v)
    shared = share(model)

    def logits(stream, shared=shared):
        m = shared.value
        for index, toxic, check in _texts_of(stream):
            used = np.flatnonzero(check | both)
            for rows in np.split(used, range(512, len(used), 512)):
                if not len(rows):
                    continue
                first = np.append(0, np.cumsum([len(index[i]) for i in rows]))
                flat = np.concatenate([index[i] for i in rows])
                z = np.round(m.logits(flat, first) * STEPS_PER_LOGIT).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(m.language(flat, first)), pa.array(z), pa.array(toxic[rows])], ["lang", "z", "toxic"])

    checked = table.mapInArrow(logits, "lang long, z long, toxic int")
    found = checked.groupBy("lang", "z", "toxic").agg(F.count("*").alias("n")).toArrow()
    lang, z, toxic, n = (found.column(c).to_numpy() for c in ("lang", "z", "toxic", "n"))
    model.set_thresholds(lang, z / STEPS_PER_LOGIT, toxic, n)
    return model


def train(docs: DataFrame, labels: DataFrame) -> WordCnn:
    """A network fitted on all labelled documents, without those whose crc32 of the id mod 5 is 0."""
    own = docs.select(F.col("doc_id").alias("id"), "text", "lang").where(~held_out(F.col("doc_id"), 5, 0))
    return fit_texts(labelled_texts(own, labels.select(F.col("doc_id").alias("id"), "toxic")))


def score_texts(docs: DataFrame, model: WordCnn, id_col: str = "doc_id", text_col: str = "text",
                keep: dict[str, str] | None = None) -> DataFrame:
    """``id_col, score, predicted`` for every row; ``predicted`` is 1 from a score of 0.5 on.

    Whole texts are scored. Null and empty texts have no words and get the score of the filters'
    zero values; without a model of both labels every score is 0. Repeated rows are scored each;
    other columns are ignored unless named in ``keep`` (our name -> theirs).
    """
    keep = keep or {}
    # A kept column that is the text itself is sent once.
    of = {n: "text" if theirs == text_col else n for n, theirs in keep.items()}
    rows = kept_columns(docs, {"id": id_col, "text": text_col, **{n: c for n, c in keep.items() if of[n] == n}})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = [f"`{n}` {rows.schema[of[n]].dataType.simpleString()}" for n in keep]
    schema = ", ".join([f"`{id_col}` {rows.schema['id'].dataType.simpleString()}", *extra, "score double, predicted int"])

    def run(stream):
        model = shared.value
        for b in batches_of(stream, 1024, 1 << 20):
            words = Words(*utf8(b.column("text")), breaks=MARKS)
            score = model.scores(model.lookup(words.hash), words.first)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").combine_chunks(), *[b.column(of[n]).combine_chunks() for n in keep], pa.array(score),
                 pa.array((score >= 0.5).astype(np.int32))], [id_col, *keep, "score", "predicted"])

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    flagged = docs.select("doc_id", "text", held_out(F.col("doc_id"), 5, 0).alias("held_out"))
    return score_texts(flagged, model, keep={"held_out": "held_out"})
