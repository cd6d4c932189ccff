"""Language of texts by a bidirectional gated recurrent network over bytes.

Every byte position gets language probabilities; a document's are their mean over all positions.
Texts are read in windows with a margin on both sides, so a long text costs its length and no more
memory than a batch of windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlake.llm.spread import sample_per_key
from reachlake.llm.textvec import batches_of, held_out, kept_columns, utf8

OUTSIDE = 256  # the symbol for positions before or after a text
CORE, MARGIN = 112, 8  # positions labelled by a window, and read besides on each side
SPAN = CORE + 2 * MARGIN
UNDETERMINED = "und"
# Bounds of the training sample, all that the driver ever holds of the corpus.
DOCS_PER_LANGUAGE = 400
SNIPPET_CHARS = 512
MAX_LANGUAGES = 256


def _halved(u: np.ndarray, hidden: int) -> np.ndarray:
    out = u.copy()
    out[..., : 2 * hidden] *= 0.5
    return out


class ByteGru:
    """Parameters of both directions and of the output layer, as numpy arrays."""

    def __init__(self, languages: list[str], hidden: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = list(languages), hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (257, 3 * hidden)).astype(np.float32)
            self.p[f"u{d}"] = (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.p["w"] = (rng.normal(0, 1, (2 * hidden, len(languages))) / np.sqrt(2 * hidden)).astype(np.float32)
        self.p["c"] = np.zeros(len(languages), np.float32)

    def states(self, symbols: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        """Hidden states ``[steps, windows, hidden]`` of one direction for ``symbols[windows, steps]``.

        The update and reset gates use tanh at half scale for the logistic function.
        """
        h3, k = 3 * self.hidden, self.hidden
        x, u = _halved(self.p[f"x{d}"], k), _halved(self.p[f"u{d}"], k)
        n, steps = symbols.shape
        out = np.empty((steps, n, k), np.float32)
        h = np.zeros((n, k), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = x.take(symbols[:, t], axis=0)
            hu = h @ u
            gates = a[:, : 2 * k] + hu[:, : 2 * k]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:, :k], gates[:, k:]
            cand = np.tanh(a[:, 2 * k : h3] + r * hu[:, 2 * k :])
            if trace is not None:
                trace.append((t, h, z, r, cand, hu[:, 2 * k :]))
            h = cand + z * (h - cand)
            out[t] = h
        return out

    def probabilities(self, symbols: np.ndarray) -> np.ndarray:
        """``[steps, windows, languages]``."""
        s = np.concatenate([self.states(symbols, "f"), self.states(symbols, "b")], axis=2)
        logit = s @ self.p["w"] + self.p["c"]
        logit -= logit.max(axis=2, keepdims=True)
        np.exp(logit, out=logit)
        logit /= logit.sum(axis=2, keepdims=True)
        return logit

    def gradients(self, symbols: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over positions inside texts, and its gradients by backpropagation through time."""
        k, g = self.hidden, {n: np.zeros_like(v) for n, v in self.p.items()}
        traces = {d: [] for d in "fb"}
        s = np.concatenate([self.states(symbols, d, traces[d]) for d in "fb"], axis=2)
        logit = s @ self.p["w"] + self.p["c"]
        logit -= logit.max(axis=2, keepdims=True)
        prob = np.exp(logit)
        prob /= prob.sum(axis=2, keepdims=True)
        inside = (symbols != OUTSIDE).T.astype(np.float32)
        total = max(1.0, float(inside.sum()))
        true = np.take_along_axis(prob, label[None, :, None], axis=2)[:, :, 0]
        loss = float(-(np.log(true + 1e-9) * inside).sum() / total)
        prob[:, np.arange(len(label)), label] -= 1
        prob *= inside[:, :, None] / total
        g["w"] = np.einsum("tbi,tbj->ij", s, prob, optimize=True)
        g["c"] = prob.sum(axis=(0, 1))
        ds = prob @ self.p["w"].T
        for i, d in enumerate("fb"):
            u, dh = self.p[f"u{d}"], np.zeros((symbols.shape[0], k), np.float32)
            for t, h, z, r, cand, hn in reversed(traces[d]):
                dh = dh + ds[t, :, i * k : (i + 1) * k]
                dn = dh * (1 - z) * (1 - cand * cand)
                dz = dh * (h - cand) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                da = np.concatenate([dz, dr, dn], axis=1)
                dhu = np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(g[f"x{d}"], symbols[:, t], da)
                g[f"u{d}"] += h.T @ dhu
                dh = dh * z + dhu @ u.T
        return loss, g

    def fit(self, windows: np.ndarray, label: np.ndarray, steps: int = 200, batch: int = 64, rate: float = 0.03,
            seed: int = 11) -> "ByteGru":
        """Adam with a falling rate; the same number of windows of every language in each batch."""
        rng = np.random.default_rng(seed)
        of = [np.flatnonzero(label == c) for c in range(len(self.languages))]
        of = [x for x in of if len(x)]
        if not of:
            return self
        m = {n: np.zeros_like(v) for n, v in self.p.items()}
        v = {n: np.zeros_like(x) for n, x in self.p.items()}
        each = max(1, batch // len(of))
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(x, each) for x in of])
            _, g = self.gradients(windows[pick], label[pick])
            lr = rate * (1 - (step - 1) / steps)
            for n in self.p:
                m[n] = 0.9 * m[n] + 0.1 * g[n]
                v[n] = 0.99 * v[n] + 0.01 * g[n] * g[n]
                self.p[n] = (self.p[n] - lr * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def pooled(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean probabilities ``[texts, languages]`` over all positions, and the number of positions with each label."""
        n, c = len(offs) - 1, len(self.languages)
        total, labels = np.zeros((n, c)), np.zeros((n, c))
        size = np.diff(offs)
        count = -(-size // CORE)
        doc = np.repeat(np.arange(n), count)
        first = np.cumsum(count) - count
        start = offs[doc] + (np.arange(len(doc)) - first[doc]) * CORE
        symbols_of = np.append(data.astype(np.int16), np.int16(OUTSIDE))
        for at in range(0, len(doc), 2048):
            d, s = doc[at : at + 2048], start[at : at + 2048]
            place = s[:, None] + np.arange(-MARGIN, CORE + MARGIN)
            inside = (place >= offs[d][:, None]) & (place < offs[d + 1][:, None])
            symbols = symbols_of[np.where(inside, place, len(data))]
            prob = self.probabilities(symbols)[MARGIN : MARGIN + CORE]
            own = inside[:, MARGIN : MARGIN + CORE].T.astype(np.float32)
            prob *= own[:, :, None]
            summed = prob.sum(axis=0)
            # Ties go to the first language; positions outside have no probability and no label.
            best = prob.argmax(axis=2).astype(np.int32)
            best[own == 0] = c
            windows = len(d)
            tally = np.bincount((np.arange(windows, dtype=np.int32) * (c + 1) + best).ravel(), minlength=windows * (c + 1)).reshape(windows, c + 1)
            for j in range(c):
                total[:, j] += np.bincount(d, summed[:, j], n)
                labels[:, j] += np.bincount(d, tally[:, j], n)
        return total / np.maximum(size, 1)[:, None], labels


def windows_of(texts: list[str], per_text: int = 4, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Training windows at random places of each text, with the number of their text."""
    rng = np.random.default_rng(seed)
    out, doc = [], []
    for i, text in enumerate(texts):
        raw = np.frombuffer(text.encode(), np.uint8).astype(np.int16)
        for _ in range(per_text):
            at = int(rng.integers(-MARGIN, max(1, len(raw) - CORE)))
            w = np.full(SPAN, OUTSIDE, np.int16)
            lo, hi = max(0, at), min(len(raw), at + SPAN)
            w[lo - at : hi - at] = raw[lo:hi]
            out.append(w)
            doc.append(i)
    return np.array(out).reshape(-1, SPAN), np.array(doc, np.int64)


def training_sample(rows: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> list[tuple[str, str]]:
    """``(lang, snippet)`` of at most ``per_language`` rows of each language, chosen by a hash of the id.

    Of a text at most ``SNIPPET_CHARS`` characters from a hashed place on; at most ``MAX_LANGUAGES``
    languages, those with most rows.
    """
    rows = rows.where(F.col("lang").isNotNull())
    names = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()]
    if not names:
        return []
    # Ids are chosen first, so that no text is shuffled; they are bounded as the sample is.
    chosen = sample_per_key(rows.where(F.col("lang").isin(names)).select("lang", "id"), "lang", "id", per_language)
    chosen = chosen.select("lang", "id").distinct()
    start = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.length("text") - SNIPPET_CHARS)).cast("int") + 1
    texts = rows.join(F.broadcast(chosen), ["lang", "id"]).where(F.col("text").rlike(r"\p{L}"))
    found = texts.select("lang", F.substring(F.col("text"), start, F.lit(SNIPPET_CHARS)).alias("text"))
    return sorted((r["lang"], r["text"]) for r in found.limit(2 * per_language * len(names)).collect())


def train(rows: DataFrame, per_language: int = DOCS_PER_LANGUAGE, **options) -> ByteGru:
    """A network fitted on the sample of rows ``id, text, lang``."""
    sample = training_sample(rows, per_language)
    languages = sorted({lang for lang, _ in sample})
    model = ByteGru(languages)
    if sample:
        windows, doc = windows_of([t for _, t in sample])
        label = np.array([languages.index(lang) for lang, _ in sample])[doc]
        model.fit(windows, label, **options)
    return model


def identify(docs: DataFrame, model: ByteGru, id_col: str = "doc_id", text_col: str = "text",
             keep: dict[str, str] | None = None) -> DataFrame:
    """``id_col, lang_pred, score, label_share`` for every row.

    ``score`` is the mean probability of the predicted language over all positions of the whole
    text, ``label_share`` the share of positions that are labelled with it. Null texts and texts
    without a letter get ``und``, score 0 and share 0, and so does every text if nothing was learned.
    Ties go to the language first by name. Repeated rows are judged each; other columns are ignored
    unless named in ``keep`` (our name -> theirs).
    """
    keep = keep or {}
    # A kept column that is the text itself is sent once.
    of = {n: "text" if theirs == text_col else n for n, theirs in keep.items()}
    rows = kept_columns(docs, {"id": id_col, "text": text_col, **{n: c for n, c in keep.items() if of[n] == n}})
    rows = rows.withColumn("_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = [f"`{n}` {rows.schema[of[n]].dataType.simpleString()}" for n in keep]
    schema = ", ".join([f"`{id_col}` {rows.schema['id'].dataType.simpleString()}", *extra, "lang_pred string, score double, label_share double"])

    def run(stream):
        model = shared.value
        names = np.array([*model.languages, UNDETERMINED], dtype=object)
        for b in batches_of(stream, 4096, 2 << 20):
            letter = b.column("_letter").to_numpy(zero_copy_only=False).astype(bool) & bool(model.languages)
            score, share = np.zeros(len(letter)), np.zeros(len(letter))
            pick = np.full(len(letter), len(model.languages))
            at = np.flatnonzero(letter)
            if len(at):
                data, offs = utf8(b.column("text").take(pa.array(at)))
                prob, labels = model.pooled(data, offs)
                best = prob.argmax(axis=1)
                pick[at] = best
                score[at] = np.clip(prob[np.arange(len(at)), best], 0, 1)
                share[at] = labels[np.arange(len(at)), best] / labels.sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").combine_chunks(), *[b.column(of[n]).combine_chunks() for n in keep],
                 pa.array(list(names[pick]), pa.string()), pa.array(score), pa.array(share)],
                [id_col, *keep, "lang_pred", "score", "label_share"])

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.select(F.col("doc_id").alias("id"), "text", "lang").where(~held_out(F.col("doc_id"), 4, 2))
    model = train(rows)
    flagged = docs.select("doc_id", "text", held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    out = identify(flagged, model, keep={"held_out": "held_out"})
    return out.select("doc_id", "held_out", "lang_pred", "score", "label_share")
