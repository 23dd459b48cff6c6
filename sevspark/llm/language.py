"""Language identification by error-correcting output codes over hashed byte n-grams.

Each language has a binary codeword, chosen so that codewords lie far apart. One linear classifier per bit predicts it
from the relative frequencies of the text's byte trigrams; decoding takes the codeword of least total logistic loss, each
bit weighted by how well its classifier separated the sample. A small gap to the next codeword is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, slices

BUCKETS, BITS, SEED = 1 << 13, 15, 11
#: The classifiers are fitted on at most this many labelled texts, of at most LONGEST characters each.
SAMPLE, LONGEST = 3000, 20_000
STEPS, RATE = 80, 0.05
#: Gap in normalised score below which the two best languages count as ambiguous.
AMBIGUOUS = 0.2
#: Scores are odds of the mean loss times this.
CONTRAST = 4
UNDETERMINED = "und"

#: ASCII capitals lower-cased, digits and ASCII signs as spaces.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[65:91] += 32
PLAIN[[*range(65), *range(91, 97), *range(123, 128)]] = 32


def codewords(classes: int, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """``classes`` rows of +1 and -1; of many random draws the one whose nearest rows are farthest apart.

    No column is constant; the width grows with the number of classes so that distinct rows exist.
    """
    g, best, far = np.random.default_rng(seed), None, -1
    bits = max(bits, 3 * int(np.ceil(np.log2(max(classes, 2)))))
    for _ in range(200 if classes <= 64 else 5):
        code = np.where(g.random((classes, bits)) < 0.5, -1.0, 1.0).astype(np.float32)
        if classes > 1:
            flat = np.abs(code.sum(axis=0)) == classes
            code[g.integers(classes, size=int(flat.sum())), np.flatnonzero(flat)] *= -1
            gaps = (bits - code @ code.T) / 2 + bits * np.eye(classes)
            if gaps.min() > far:
                best, far = code, gaps.min()
        else:
            best = code
    return best


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of all texts, and the bounds by text. Texts are set off by spaces."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = PLAIN[np.frombuffer(b"  " + b"  ".join(parts) + b"    ", np.uint8)].astype(np.uint32)
    three = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
    bucket = (three * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
    # a text starts one space early and ends one space late
    bounds = np.cumsum([1] + [len(p) + 2 for p in parts])
    return bucket, bounds


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, weight: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weight, self.bias, self.trust = languages, code, weight, bias, trust

    def margins(self, texts: list[str]) -> np.ndarray:
        bucket, bounds = grams(texts)
        out = np.empty((len(texts), len(self.bias)), np.float32)
        for i in range(len(texts)):
            own = bucket[bounds[i] : bounds[i + 1]]
            # one long text is summed part by part
            total = sum(self.weight[own[k : k + 65536]].sum(axis=0) for k in range(0, max(1, len(own)), 65536))
            out[i] = total / max(1, len(own)) + self.bias
        return out

    def decode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the best language, its score, and its lead over the next."""
        z = self.margins(texts)[:, None, :] * self.code[None]
        loss = CONTRAST * (np.logaddexp(0, -z) * self.trust).sum(axis=2) / self.trust.sum()
        odds = np.exp(loss.min(axis=1, keepdims=True) - loss)
        odds /= odds.sum(axis=1, keepdims=True)
        top = np.sort(odds, axis=1)
        lead = top[:, -1] - (top[:, -2] if odds.shape[1] > 1 else 0)
        return odds.argmax(axis=1), odds.max(axis=1), lead


def fit(texts: list[str], languages: list[str], steps: int = STEPS) -> Model | None:
    """All bit classifiers at once, by Adam on the logistic loss over the sample; None without a sample."""
    if not texts:
        return None
    names = sorted(set(languages))
    code = codewords(len(names))
    bucket, bounds = grams(texts)
    x = np.stack([np.bincount(bucket[a:z], minlength=BUCKETS) / max(1, z - a) for a, z in zip(bounds, bounds[1:])]).astype(np.float32)
    # short texts must not be ruled by buckets that hardly occur
    scale = (1 / np.sqrt(x.mean(axis=0) + 1e-4)).astype(np.float32)
    x *= scale
    at = np.searchsorted(names, languages)
    count = np.bincount(at)
    share = (1 / (len(names) * count[at])).astype(np.float32)[:, None]
    y = code[at]
    w, b = np.zeros((BUCKETS, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for step in range(1, steps + 1):
        d = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) * share
        for k, (p, g) in enumerate(((w, x.T @ d + 1e-6 * w), (b, d.sum(axis=0)))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 10 * RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    hit = (((x @ w + b) * y > 0) * share).sum(axis=0)
    return Model(names, code, w * scale[:, None], b, np.maximum(hit - 0.5, 0.01).astype(np.float32) * 2)


def learn(labelled: DataFrame, text_col: str, language_col: str, draw: Column) -> Model | None:
    """Fit on a bounded sample, the rows that come first by ``draw``; null languages and long texts stay out."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(language_col).cast("string").alias("language"), draw.alias("draw"))
    rows = rows.where(F.col("language").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= LONGEST))
    # keys are sorted by every task; at most SAMPLE texts of at most LONGEST characters reach the driver
    found = rows.orderBy("draw", "text").limit(SAMPLE).toArrow()
    return fit(found.column("text").to_pylist(), found.column("language").to_pylist())


def predict(docs: DataFrame, model: Model | None, id_col: str, text_col: str) -> DataFrame:
    """``(id, lang_pred, score, ambiguous)`` for every row, from the whole text alone.

    A text that is null or has no letter is ``und`` with score 0; so is every text where nothing could be learned. Ties
    take the first language by name. Other columns are dropped, so clashing names do no harm.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches, "text"):
            texts = b.column("text").to_pylist()
            known = np.array([t is not None and model is not None for t in texts], bool)
            name, score, lead = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts)), np.ones(len(texts))
            if known.any():
                best, odds, gap = model.decode([t for t, k in zip(texts, known) if k])
                name[known], score[known], lead[known] = np.array(model.languages, object)[best], odds, gap
            yield batch_of(
                id=b.column("id"), lang_pred=pa.array(name, pa.string()), score=pa.array(score), ambiguous=pa.array(lead < AMBIGUOUS)
            )

    return rows.mapInArrow(run, "id long, lang_pred string, score double, ambiguous boolean")
