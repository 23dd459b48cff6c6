"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is read as lower-cased words (runs of ASCII letters, digits and all non-ASCII bytes). A word enters as a word
embedding next to the mean embedding of its character trigrams, both in hashed tables, so unknown words still have
their characters. Windows of ``WINDOW`` words, ``STRIDE`` apart, cover the whole text; a gated recurrent layer runs over each
in both directions, attention pools its states, one unit gives the window's logit. The text has the greatest logit
of its windows, so a few bad words in a long text are not averaged away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, batch_of, mix, slices

WINDOW, STRIDE = 32, 24
WORDS, TRIGRAMS, WIDTH, HIDDEN = 1 << 14, 1 << 12, 8, 8
#: The model is fitted on at most this many labelled texts of each label, of at most LONGEST characters each.
SAMPLE = {1: 1500, 0: 3000}
LONGEST = 20_000
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.01, 7
#: Steps of training at least: a small sample is gone through more often.
STEPS = 250
#: Bytes of text that are scored at once.
PART_BYTES = 1 << 20

GAPS = np.ones(256, bool)
GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Inputs:
    """The words of a slice as numbers of distinct words, and what the model needs of each distinct word."""

    def __init__(self, texts: list[str | None]):
        words = Words(texts, lower=True, gaps=GAPS)
        self.at = words.at
        self.code, names = pd.factorize(words.hash)
        first = np.zeros(len(names), np.int64)
        first[self.code[::-1]] = np.arange(len(self.code))[::-1]
        self.word = (names % np.uint64(WORDS)).astype(np.int64)
        start, size = words.start[first], (words.stop - words.start)[first]
        self.ends = np.cumsum(size)
        place = np.arange(self.ends[-1] if len(size) else 0) + np.repeat(start - 1 - (self.ends - size), size)
        plain = np.where(GAPS, 0, np.arange(256)).astype(np.uint64)[words.bytes]
        three = plain[place] | plain[place + 1] << np.uint64(8) | plain[place + 2] << np.uint64(16)
        self.trigram = (mix(three) % np.uint64(TRIGRAMS)).astype(np.int64)
        self.size = size

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of words and text of each window."""
        n = np.diff(self.at)
        count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
        text = np.repeat(np.arange(len(n)), count)
        step = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        first = self.at[text] + step * STRIDE
        return first, np.minimum(WINDOW, self.at[text + 1] - first), text

    def positions(self, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct word by window and step, and whether the step is inside the window."""
        inside = np.arange(WINDOW) < size[:, None]
        at = np.where(inside, first[:, None] + np.arange(WINDOW), 0)
        return self.code[at], inside


class Model:
    def __init__(self, seed: int = SEED):
        g = np.random.default_rng(seed)
        draw = lambda *shape: (g.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        h = HIDDEN
        self.p = {
            "word": (0.3 * g.standard_normal((WORDS, WIDTH))).astype(np.float32),
            "trigram": (0.3 * g.standard_normal((TRIGRAMS, WIDTH))).astype(np.float32),
            "attend": draw(2 * h, h), "tilt": np.zeros(h, np.float32), "focus": draw(h), "out": draw(2 * h),
            "bias": np.array([-2], np.float32),
        }
        for d in "fb":
            self.p |= {f"in_{d}": draw(2 * WIDTH, 3 * h), f"bias_{d}": np.zeros(3 * h, np.float32), f"rec_{d}": draw(h, 3 * h)}
        #: share of label 1 among the learned rows: what a text without words scores, below 0.5 in any case
        self.prior = 0.5

    def embed(self, x: Inputs) -> np.ndarray:
        if not len(x.word):
            return np.empty((0, 2 * WIDTH), np.float32)
        sums = np.add.reduceat(self.p["trigram"][x.trigram], x.ends - x.size, axis=0)
        return np.concatenate((self.p["word"][x.word], sums / x.size[:, None].astype(np.float32)), axis=1)

    def scan(self, d: str, table: np.ndarray, code: np.ndarray, inside: np.ndarray, keep: bool):
        """States of one direction by step; with ``keep`` also what the way back needs."""
        h, n = HIDDEN, len(code)
        state, states, trail = np.zeros((n, h), np.float32), np.zeros((WINDOW, n, h), np.float32), []
        rec, whole = self.p[f"rec_{d}"], inside.all()
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            x, u = table[code[:, t]], state @ rec
            gates = sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            c = np.tanh(x[:, 2 * h :] + r * u[:, 2 * h :])
            m = z if whole else z * inside[:, t, None]
            if keep:
                trail.append((t, state, z, r, c, u[:, 2 * h :], m))
            state = state + m * (c - state)
            states[t] = state
        return states, trail

    def forward(self, tables: dict, code: np.ndarray, inside: np.ndarray, keep: bool = False):
        runs = {d: self.scan(d, tables[d], code, inside, keep) for d in "fb"}
        states = np.concatenate((runs["f"][0], runs["b"][0]), axis=2)
        look = np.tanh(states @ self.p["attend"] + self.p["tilt"])
        weight = np.where(inside.T, look @ self.p["focus"], -1e9)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return logit, (runs, states, look, weight, pooled)

    def tables(self, embedded: np.ndarray) -> dict:
        return {d: embedded @ self.p[f"in_{d}"] + self.p[f"bias_{d}"] for d in "fb"}

    def logits(self, x: Inputs, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word, size, text and logit of every window."""
        first, size, text = x.windows()
        out, tables = np.zeros(len(first), np.float32), self.tables(self.embed(x))
        # whole windows need no mask and come first
        order = np.argsort(size < WINDOW, kind="stable")
        for i in range(0, len(first), chunk):
            part = order[i : i + chunk]
            out[part] = self.forward(tables, *x.positions(first[part], size[part]))[0]
        return first, size, text, out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = Inputs(texts)
        *_, text, logit = self.logits(x)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, text, logit)
        return np.where(np.isfinite(best), sigmoid(np.clip(best, -60, 60)), min(self.prior, 0.49))

    def back(self, x: Inputs, embedded: np.ndarray, tables: dict, first, size, label) -> dict:
        """Gradient of the mean logistic loss of the given windows."""
        code, inside = x.positions(first, size)
        logit, (runs, states, look, weight, pooled) = self.forward(tables, code, inside, keep=True)
        h, n, p, g = HIDDEN, len(first), self.p, {}
        d_logit = ((sigmoid(logit) - label) / n).astype(np.float32)
        g["out"], g["bias"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pool = d_logit[:, None] * p["out"]
        d_weight = np.einsum("nh,tnh->tn", d_pool, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["focus"] = np.einsum("tn,tnh->h", d_score, look)
        d_look = d_score[..., None] * p["focus"] * (1 - look**2)
        g["attend"], g["tilt"] = np.einsum("tni,tnj->ij", states, d_look), d_look.sum(axis=(0, 1))
        d_states = weight[..., None] * d_pool + d_look @ p["attend"].T
        d_embed = np.zeros_like(embedded)
        for k, d in enumerate("fb"):
            rec, d_state, d_table = p[f"rec_{d}"], np.zeros((n, h), np.float32), np.zeros_like(tables[d])
            g[f"rec_{d}"] = np.zeros_like(rec)
            for t, before, z, r, c, u, m in reversed(runs[d][1]):
                d_state = d_state + d_states[t][:, k * h : (k + 1) * h]
                mask = inside[:, t, None]
                d_z = d_state * (c - before) * mask * z * (1 - z)
                d_c = d_state * m * (1 - c**2)
                d_r = d_c * u * r * (1 - r)
                d_in = np.concatenate((d_z, d_r, d_c), axis=1)
                d_u = np.concatenate((d_z, d_r, d_c * r), axis=1)
                np.add.at(d_table, code[:, t], d_in * mask)
                g[f"rec_{d}"] += before.T @ d_u
                d_state = d_state * (1 - m) + d_u @ rec.T
            g[f"in_{d}"], g[f"bias_{d}"] = embedded.T @ d_table, d_table.sum(axis=0)
            d_embed += d_table @ p[f"in_{d}"].T
        g["word"], g["trigram"] = np.zeros_like(p["word"]), np.zeros_like(p["trigram"])
        used = np.flatnonzero(np.abs(d_embed).sum(axis=1))
        np.add.at(g["word"], x.word[used], d_embed[used, :WIDTH])
        share = d_embed[:, WIDTH:] / x.size[:, None].astype(np.float32)
        owner = np.repeat(np.arange(len(x.size)), x.size)
        hot = np.isin(owner, used)
        np.add.at(g["trigram"], x.trigram[hot], share[owner[hot]])
        return g


def fit(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Adam on the window of the greatest logit of each text; in the first epoch on a random window of each."""
    model, rng = Model(seed), np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    if not len(labels):
        return model
    model.prior = float(labels.mean())
    m, v, step = {k: np.zeros_like(x) for k, x in model.p.items()}, {k: np.zeros_like(x) for k, x in model.p.items()}, 0
    for epoch in range(max(epochs, -(-STEPS * BATCH // len(texts)))):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            x = Inputs([texts[k] for k in order[i : i + BATCH]])
            y = labels[order[i : i + BATCH]]
            first, size, text, logit = model.logits(x)
            if not len(first):
                continue
            pull = rng.random(len(first)) if epoch == 0 else logit
            by = np.lexsort((pull, text))
            pick = by[np.flatnonzero(np.append(text[by][1:] != text[by][:-1], True))]
            embedded = model.embed(x)
            g = model.back(x, embedded, model.tables(embedded), first[pick], size[pick], y[text[pick]])
            step += 1
            for k, d in g.items():
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.001 * (d * d - v[k])
                model.p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-6)
    return model


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Model:
    """Fit on the bounded sample: per label, the rows that come first by a hash of their id.

    Rows of null label, or of a text that is null or longer than ``LONGEST``, are not learned from; rows equal in id and
    text count once. ``labels`` has one row per id. Texts are not shuffled: the sample is drawn on ids and hashes of texts.
    """
    text = F.col(text_col)
    keyed = docs.where(F.length(text) <= LONGEST).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tid"), text.alias("text"))
    label = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(*SAMPLE))
    drawn = keyed.select("id", "tid", F.xxhash64(F.lit(SEED), "id").alias("draw")).join(label, "id").distinct()
    picks = [r for k, most in SAMPLE.items() for r in drawn.where(F.col("label") == k).orderBy("draw", "tid").limit(most).collect()]
    if not picks:
        return fit([], [])
    # SAMPLE bounds the rows that are broadcast, LONGEST the texts that reach the driver
    some = F.broadcast(docs.sparkSession.createDataFrame(picks, drawn.schema).select("id", "tid"))
    found = keyed.join(some, ["id", "tid"]).dropDuplicates(["id", "tid"]).toArrow().to_pylist()
    by_key = {(r["id"], r["tid"]): r["text"] for r in found}
    return fit([by_key[r["id"], r["tid"]] for r in picks], [r["label"] for r in picks])


def score(docs: DataFrame, model: Model, text_col: str, out: str) -> DataFrame:
    """``docs`` with the column ``out``: the probability of label 1 of each whole text, 0 to 1.

    A null text, or one without words, scores the share of label 1 among the learned rows. All other columns stay as they
    are, whatever their names and types; a column of the name ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            parts = [shared.value.scores(b.column("text").to_pylist()) for b in slices([batch_of(text=batch)], "text", PART_BYTES)]
            yield pa.array(np.concatenate(parts) if parts else np.empty(0))

    return docs.withColumn(out, F.arrow_udf(run, "double")(F.col(text_col).cast("string")))
