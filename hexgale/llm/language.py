"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by back-propagation through time on a bounded sample of labelled rows; every byte position gets a language
distribution and a document pools the probabilities of all its positions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexgale.llm.common import pick

#: The bounded fitting sample: labelled documents per language, and code points of one window of each.
FIT_DOCS, FIT_CHARS = 400, 512
HIDDEN, SPAN, BATCH, STEPS, RATE = 6, 64, 192, 250, 0.02
#: Bytes of one sequence when predicting, and sequences worked on side by side.
SEGMENT, LANES = 256, 2048
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class ByteGRU:
    """Two gated recurrent layers, left to right and right to left, and a softmax over languages at each byte."""

    def __init__(self, n_labels: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        h, self.hidden, self.n_labels = hidden, hidden, n_labels
        self.w: dict[str, np.ndarray] = {"V": rng.normal(0, 0.3, (2 * h, n_labels)), "c": np.zeros(n_labels)}
        for d in "fb":
            # The byte table is the input layer: update gate, reset gate and candidate side by side.
            self.w |= {f"X{d}": rng.normal(0, 0.3, (256, 3 * h)), f"U{d}": rng.normal(0, 0.3, (h, 3 * h)), f"a{d}": np.zeros(h)}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _layer(self, codes: np.ndarray, d: str, keep: list) -> np.ndarray:
        """States after each position, (time, lane, hidden), keeping what back-propagation needs."""
        n, lanes, h = *codes.shape, self.hidden
        x, u, a = self.w[f"X{d}"], self.w[f"U{d}"], self.w[f"a{d}"]
        out, state = np.zeros((n, lanes, h), np.float32), np.zeros((lanes, h), np.float32)
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            g, s = x[codes[t]], state @ u
            gates = _sigmoid(g[:, : 2 * h] + s[:, : 2 * h])
            inner = s[:, 2 * h :] + a
            new = np.tanh(g[:, 2 * h :] + gates[:, h:] * inner)
            keep.append((t, state, gates, inner, new))
            state = new + gates[:, :h] * (state - new)
            out[t] = state
        return out

    def _states(self, codes: np.ndarray, d: str, active: np.ndarray):
        """Yield (position, states (hidden, lane)) in the layer's direction; lanes lie side by side in memory.

        ``active``: how many lanes have a byte at each position; they are a prefix, as lanes are sorted by length.
        """
        n, lanes, h = *codes.shape, self.hidden
        x, u = np.ascontiguousarray(self.w[f"X{d}"].T), np.ascontiguousarray(self.w[f"U{d}"].T)
        a, state = self.w[f"a{d}"][:, None], np.zeros((h, lanes), np.float32)
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            m = active[t]
            g = np.take(x, codes[t, :m], axis=1, mode="clip")
            before = state[:, :m]
            s = u @ before
            gates = g[: 2 * h]
            gates += s[: 2 * h]
            gates = _sigmoid(gates)
            new = s[2 * h :]
            new += a
            new *= gates[h:]
            new += g[2 * h :]
            np.tanh(new, out=new)
            before -= new
            before *= gates[:h]
            before += new
            yield t, before

    def positions(self, codes: np.ndarray, active: np.ndarray):
        """Yield (position, language probabilities (label, lane)) from the last position to the first."""
        forward = np.empty((len(codes), self.hidden, codes.shape[1]), np.float32)
        for t, state in self._states(codes, "f", active):
            forward[t, :, : active[t]] = state
        vf, vb = self.w["V"][: self.hidden].T, self.w["V"][self.hidden :].T
        c = self.w["c"][:, None]
        for t, state in self._states(codes, "b", active):
            p = vf @ forward[t, :, : active[t]]
            p += vb @ state
            p += c
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            yield t, p

    def gradient(self, codes: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean cross-entropy of all positions, back-propagated through time in both directions."""
        n, lanes, h = *codes.shape, self.hidden
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._layer(codes, d, kept[d]) for d in "fb"], axis=2)
        p = both @ self.w["V"] + self.w["c"]
        p = np.exp(p - p.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(lanes), labels] -= 1
        p /= n * lanes
        g = {"V": both.reshape(-1, 2 * h).T @ p.reshape(-1, self.n_labels), "c": p.sum((0, 1))}
        outer = p @ self.w["V"].T
        for k, d in enumerate("fb"):
            u = self.w[f"U{d}"]
            du, da, dx = np.zeros_like(u), np.zeros(h, np.float32), np.zeros((256, 3 * h), np.float32)
            flow = np.zeros((lanes, h), np.float32)
            for t, before, gates, inner, new in reversed(kept[d]):
                flow = flow + outer[t, :, k * h : (k + 1) * h]
                z, r = gates[:, :h], gates[:, h:]
                dnew = flow * (1 - z) * (1 - new * new)
                dz = flow * (before - new) * z * (1 - z)
                dr = dnew * inner * r * (1 - r)
                ds = np.concatenate((dz, dr, dnew * r), axis=1)
                du += before.T @ ds
                da += ds[:, 2 * h :].sum(0)
                np.add.at(dx, codes[t], np.concatenate((dz, dr, dnew), axis=1))
                flow = flow * z + ds @ u.T
            g |= {f"U{d}": du, f"a{d}": da, f"X{d}": dx}
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 11) -> ByteGRU:
        """Adam on random spans; every language is drawn equally often."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(labels == k) for k in range(self.n_labels)]
        m1 = {k: np.zeros_like(v) for k, v in self.w.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, steps + 1):
            y = rng.integers(0, self.n_labels, BATCH)
            codes = np.full((BATCH, SPAN), 32, np.uint8)
            for i, k in enumerate(y):
                b = texts[by[k][rng.integers(len(by[k]))]]
                at = rng.integers(0, max(1, len(b) - SPAN + 1))
                part = np.frombuffer(b[at : at + SPAN], np.uint8)
                codes[i, : len(part)] = part
            rate = RATE * (1 - step / (steps + 1))
            for k, g in self.gradient(codes.T, y).items():
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.01 * (g * g - m2[k])
                self.w[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """Mean language probabilities over all positions of each text; all bytes take part."""
        total = np.zeros((len(texts), self.n_labels))
        owner, start, size = [], [], []
        for i, b in enumerate(texts):
            parts = -(-len(b) // SEGMENT)
            at = np.linspace(0, len(b), parts + 1).astype(np.int64) if parts else np.zeros(1, np.int64)
            owner.append(np.full(parts, i))
            start.append(at[:-1])
            size.append(np.diff(at))
        owner, start, size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, start, size))
        base = np.concatenate(([0], np.cumsum([len(b) for b in texts])))
        data = np.frombuffer(b"".join(texts) + bytes(SEGMENT), np.uint8)
        order = np.argsort(-size, kind="stable")
        for lot in range(0, len(order), LANES):
            mine = order[lot : lot + LANES]
            n = int(size[mine[0]])
            codes = data[(base[owner[mine]] + start[mine])[None, :] + np.arange(n)[:, None]]
            active = np.searchsorted(-size[mine], -np.arange(n), side="left")
            lanes = np.zeros((self.n_labels, len(mine)))
            for t, p in self.positions(codes, active):
                lanes[:, : active[t]] += p
            np.add.at(total, owner[mine], lanes.T)
        lengths = np.array([max(1, len(b)) for b in texts], dtype=float)
        return total / lengths[:, None]


def held_out(doc_id: Column) -> Column:
    """Rows never fitted on: crc32 of the id as text leaves 1 when divided by 3. A NULL id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_language_model(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[ByteGRU | None, list[str]]:
    """Fit on at most ``fit_docs`` labelled documents of each language that are not held out, one window of each.

    The sample is taken by a hash of the id before anything is shuffled whole; it is the only thing the driver receives.
    Without labelled rows there is no model.
    """
    rows = pick(docs, doc_id=doc_id, text=text, lang=lang)
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    draw = F.xxhash64("doc_id", F.length("text"))
    part = F.substring("text", F.lit(1) + F.pmod(draw, F.greatest(F.length("text") - fit_chars, F.lit(0)) + 1).cast("int"), F.lit(fit_chars))
    drawn = usable.select("lang", part.alias("part"), draw.alias("draw"))
    by_lang = Window.partitionBy("lang").orderBy("draw", "part")
    sample = drawn.withColumn("n", F.row_number().over(by_lang)).where(F.col("n") <= fit_docs).select("lang", "part", "n").toPandas()
    sample = sample.sort_values(["lang", "n"], ignore_index=True)
    langs = sorted(sample["lang"].unique())
    if not langs:
        return None, []
    labels = pd.Categorical(sample["lang"], categories=langs).codes
    return ByteGRU(len(langs)).fit([t.encode() for t in sample["part"]], np.asarray(labels)), langs


def _answers(values, model: ByteGRU | None, langs: list[str]) -> tuple[list[str], list[float]]:
    lang, score = [UNKNOWN] * len(values), [0.0] * len(values)
    known = [i for i, v in enumerate(values) if v and model is not None and LETTER.search(v)]
    at = 0
    while at < len(known):  # some 4 MB of text at a time
        lot, held = [], 0
        while at < len(known) and (not lot or held < LANES * SEGMENT * 8):
            lot.append(known[at])
            held += len(values[known[at]])
            at += 1
        mean = model.pool([values[i].encode() for i in lot])
        for i, p in zip(lot, mean):
            k = int(p.argmax())
            lang[i], score[i] = langs[k], float(min(1.0, max(0.0, p[k])))
    return lang, score


def label_rows(docs: DataFrame, model: ByteGRU | None, langs: list[str], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; columns of these names are replaced. See ``identify_language``."""
    rows = docs.drop("lang_pred", "score")
    fields = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = rows.columns.index(text)

    def run(batches):
        for batch in batches:
            lang, score = _answers(batch.column(at).to_pylist(), model, langs)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=fields.names)

    return rows.mapInArrow(run, fields)


def identify_language(docs: DataFrame, model: ByteGRU | None, langs: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): the language with the largest pooled probability, and that probability.

    A map without a shuffle; the model travels with the tasks (some 60 kB). NULL text, text without a letter, and any text
    if nothing could be learned give ``und`` with score 0. Equal texts get equal answers up to float rounding; NULL and
    repeated ids and repeated rows pass through row by row; other columns are left out.
    """
    rows = pick(docs, doc_id=doc_id, text=text).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return label_rows(rows, model, langs).select("doc_id", "held_out", "lang_pred", "score")
