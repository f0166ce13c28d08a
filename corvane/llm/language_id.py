"""Language identification by a convolutional network over bytes, trained in numpy.

One-hot bytes, filters of several widths, max pooling over a fixed-length window, ReLU and softmax. A text is cut into
windows that cover all of it; its probabilities are the windows' mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import others, unused

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Labelled texts that training reads at most, the same number of each language (those of the lowest hash), and windows taken from each, spread evenly.
MAX_TEXTS = 3_000
#: Most languages that can be learned.
MAX_LABELS = 500
WINDOWS_PER_TEXT = 4
EPOCHS = 10
UNKNOWN = "und"

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_LETTER = regex.compile(r"\p{L}")


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(windows of bytes, padded with 0; the text of each). Windows cover the texts without overlap."""
    count = [max(1, -(-len(t) // WINDOW)) for t in texts]
    padded = b"".join(t + bytes(n * WINDOW - len(t)) for t, n in zip(texts, count, strict=True))
    return _LOWER[np.frombuffer(padded, np.uint8)].reshape(-1, WINDOW), np.repeat(np.arange(len(texts)), count)


class ByteCnn:
    """tables[w][t] has the weights of filters of width w for each byte value at offset t."""

    def __init__(self, labels: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.tables = [[rng.normal(0, 0.5, (256, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def pooled(self, x: np.ndarray, where: bool = False):
        """Largest response of each filter in each window, and its position if asked for."""
        best, places = [], []
        for w, tables in zip(WIDTHS, self.tables, strict=True):
            n = x.shape[1] - w + 1
            z = np.take(tables[0], x[:, :n], axis=0)
            for t in range(1, w):
                z += np.take(tables[t], x[:, t : t + n], axis=0)
            best.append(z.max(axis=1))
            if where:
                places.append(z.argmax(axis=1))
        return np.concatenate(best, axis=1) + self.bias, places

    def probabilities(self, x: np.ndarray, block: int = 256) -> np.ndarray:
        found = [self.pooled(x[i : i + block])[0] for i in range(0, len(x), block)]
        z = np.maximum(np.concatenate(found), 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, batch: int = 128, seed: int = 3) -> ByteCnn:
        """Adam on the cross entropy, classes weighted against their frequency."""
        rng = np.random.default_rng(seed)
        weight = (len(y) / (len(self.labels) * np.maximum(np.bincount(y, minlength=len(self.labels)), 1))).astype(np.float32)
        params = [t for ts in self.tables for t in ts] + [self.bias, self.out, self.out_bias]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                xs, ys = x[order[i : i + batch]], y[order[i : i + batch]]
                z, places = self.pooled(xs, where=True)
                h = np.maximum(z, 0)
                logits = h @ self.out + self.out_bias
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(ys)), ys] -= 1
                p *= (weight[ys] / len(ys))[:, None]
                back = (p @ self.out.T) * (z > 0)
                grads, k = [], 0
                for w, place in zip(WIDTHS, places, strict=True):
                    own = back[:, k : k + FILTERS]
                    for t in range(w):
                        g = np.zeros((256, FILTERS), np.float32)
                        np.add.at(g, (np.take_along_axis(xs, place + t, axis=1), np.arange(FILTERS)[None, :]), own)
                        grads.append(g)
                    k += FILTERS
                grads += [back.sum(axis=0), h.T @ p, p.sum(axis=0)]
                step += 1
                for q, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_texts: int = MAX_TEXTS) -> ByteCnn | None:
    """Learn from rows with text and label: at most `max_texts`, of each language an even share, those whose text has the lowest hash. None without any."""
    text = F.col(text_col)
    rows = labelled.where(text.isNotNull() & F.col(lang_col).isNotNull()).select(text.alias("text"), F.col(lang_col).alias("lang"))
    # Windows are cut and rows are thinned by hash before anything reaches the driver, so its share is bounded.
    different = rows.select("lang", F.xxhash64("text")).distinct()  # copies of a text count once
    counts = {r["lang"]: r["count"] for r in different.groupBy("lang").count().limit(MAX_LABELS + 1).collect()}
    if len(counts) > MAX_LABELS:
        raise ValueError(f"over {MAX_LABELS} languages")
    if not counts:
        return None
    share, place = max(1, max_texts // len(counts)), F.xxhash64("text")
    lowest = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, -(1 << 63) + min((1 << 64) - 1, int((1 << 64) * (1.2 * share + 100) / n)))])
    step = F.greatest(F.length("text") / F.lit(WINDOWS_PER_TEXT), F.lit(1))
    pieces = F.array(*[F.substr("text", (step * i).cast("int") + 1, F.lit(WINDOW)) for i in range(WINDOWS_PER_TEXT)])
    rows = rows.select(place.alias("place"), "lang", F.array_distinct(pieces).alias("pieces")).where(F.col("place") <= lowest[F.col("lang")])
    rows = rows.groupBy("place", "lang").agg(F.first("pieces").alias("pieces"))
    found: dict[str, list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["place"], r["lang"], r["pieces"])):
        found.setdefault(r["lang"], []).append(r["pieces"])
    got = [(lang, p.encode()[:WINDOW]) for lang in sorted(found) for own in found[lang][:share] for p in own if _LETTER.search(p)]
    if not got:
        return None
    labels = sorted({k for k, _ in got})
    x, _ = windows([p for _, p in got])
    return ByteCnn(labels).fit(x, np.array([labels.index(k) for k, _ in got]))


def predict(docs: DataFrame, model: ByteCnn | None, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and score (the mean probability of that language over the text's windows).

    Null text and text without letters: `und`, score 0; an empty table gives an empty one. So is all text if there is no model. Ties go to the label
    that sorts first. Columns of these names in `docs`, in any case, are replaced.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def classify(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net: ByteCnn | None = sent.value
        for column in columns:
            lang, score = np.full(len(column), UNKNOWN, object), np.zeros(len(column))
            group, texts, size = [], [], 0
            for i in range(len(column) if net else 0):
                text = column[i].as_py()  # one at a time, so that a batch is not held twice
                if text and _LETTER.search(text):
                    group.append(i)
                    texts.append(text.encode())
                    size += len(text)
                if group and (size >= 1 << 20 or i + 1 == len(column)):
                    x, of = windows(texts)
                    p = net.probabilities(x)
                    at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                    mean = np.add.reduceat(p.astype(np.float64), at, axis=0) / np.diff(np.r_[at, len(of)])[:, None]
                    lang[group] = np.array(net.labels, object)[mean.argmax(axis=1)]
                    score[group] = np.clip(mean.max(axis=1), 0, 1)
                    group, texts, size = [], [], 0
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], names=["lang_pred", "score"])
            del column
        pa.default_memory_pool().release_unused()  # a worker that waits for its next task keeps it otherwise

    keep, found = [F.col(f"`{c}`") for c in others(docs.columns, ("lang_pred", "score"), (text_col,))], unused(docs.columns, "found")
    return docs.select(*keep, classify(F.col(text_col)).alias(found)).select(*keep, f"{found}.lang_pred", f"{found}.score")


def held_out(id_col: str = "doc_id"):
    """Documents that training never sees: crc32 of the id as text, modulo 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
