"""Benchmark decontamination: short test items inside long documents.

Containment search by MinHash, partitioned by size: an item of s word shingles belongs to the class S, the power of two
with S / 2 < s <= S, and is sought in windows of 2 S shingles, S apart, so any verbatim occurrence lies inside a window
that is at most about four times its size, however long the document is. A window is a candidate if one of
N_HASHES minima equals the item's. Items of up to FEW shingles are too small for that, so each of their shingles is looked up.
Candidates are verified by exact containment in the whole document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import words as W

SHINGLE = 5
THRESHOLD = 0.8
N_HASHES = 48
#: Shingles in a block; minima of windows are put together from those of blocks.
BLOCK = 8
#: Shingles of an item up to which they are looked up themselves.
FEW = BLOCK
#: Shingles of items that are broadcast at once (8 bytes each); more items take more passes over the documents.
MAX_BROADCAST = 2_000_000

_rng = np.random.default_rng(5)
_A = _rng.integers(0, 1 << 63, N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, N_HASHES, dtype=np.uint64)


class _Items:
    """The sketches and shingle sets of a block of items."""

    def __init__(self, ids: list, texts: list):
        self.ids, self.sets, self.short, self.few, classes = ids, [], {}, {}, {}
        self.length = np.full(len(ids), SHINGLE)  # words of an item's shingles
        for i, text in enumerate(texts):
            data = np.frombuffer((text or "").encode(), np.uint8)
            w, first = W.word_hashes(data, np.array([0, len(data)]))
            s, _ = W.shingles(w, first, SHINGLE)
            s = np.unique(s)
            self.sets.append(s)
            if 0 < len(w) < SHINGLE:
                self.short.setdefault(len(w), []).append(i)
                self.length[i] = len(w)
            elif 0 < len(s) <= FEW:
                for k in s.tolist():
                    self.few.setdefault(k, []).append(i)
            elif len(w):
                classes.setdefault(max(BLOCK, 1 << (len(s) - 1).bit_length()), []).append(i)
        self.few_keys = np.array(sorted(self.few), np.uint64)
        #: {class: for each hash function, (sorted minima, items in that order)}
        self.classes = {}
        for size, members in sorted(classes.items()):
            minima = np.array([[(self.sets[i] * a + b).min() for a, b in zip(_A, _B, strict=True)] for i in members])
            order = np.argsort(minima, axis=0)
            self.classes[size] = [(minima[order[:, j], j], np.array(members)[order[:, j]]) for j in range(N_HASHES)]

    def candidates(self, words: np.ndarray, first: np.ndarray, s: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs of a slice."""
        found: set[tuple[int, int]] = set()
        for n, members in self.short.items():
            g = W.grams(words, n)
            own = np.array([self.sets[i][0] for i in members])
            for k in np.flatnonzero(np.isin(g, own)):
                d = int(np.searchsorted(first, k, "right")) - 1
                if k + n <= first[d + 1]:
                    found |= {(d, i) for i in members if self.sets[i][0] == g[k]}
        if self.few:
            hits = np.flatnonzero(np.isin(s, self.few_keys))
            for k, d in zip(s[hits].tolist(), (np.searchsorted(at, hits, "right") - 1).tolist(), strict=True):
                found.update((d, i) for i in self.few[k])
        if not len(s) or not self.classes:
            return found
        count = np.diff(at)
        n_blocks = -(-count // BLOCK)
        block_at = np.concatenate([[0], np.cumsum(n_blocks)])
        doc_of = np.repeat(np.arange(len(count)), n_blocks)
        begins = at[:-1][doc_of] + (np.arange(block_at[-1]) - block_at[:-1][doc_of]) * BLOCK
        # Positions of the windows' halves in each class are the same for all hash functions.
        plans = []
        for size in self.classes:
            per = size // BLOCK
            n_half = -(-n_blocks // per)
            half_doc = np.repeat(np.arange(len(count)), n_half)
            half_at = np.concatenate([[0], np.cumsum(n_half)])
            half_begins = block_at[:-1][half_doc] + (np.arange(half_at[-1]) - half_at[:-1][half_doc]) * per
            joined = np.concatenate([half_doc[1:] == half_doc[:-1], [False]])
            plans.append((size, half_begins, half_doc, np.flatnonzero(joined)))
        for j in range(N_HASHES):
            blocks = np.minimum.reduceat(s * _A[j] + _B[j], begins)
            for size, half_begins, half_doc, joined in plans:
                minima, members = self.classes[size][j]
                window = np.minimum.reduceat(blocks, half_begins)
                window[joined] = np.minimum(window[joined], window[joined + 1])  # the right side is read before it is written
                low = np.searchsorted(minima, window)
                hit = np.flatnonzero(minima[np.minimum(low, len(minima) - 1)] == window)
                for k in hit:
                    m = low[k]
                    while m < len(minima) and minima[m] == window[k]:
                        found.add((int(half_doc[k]), int(members[m])))
                        m += 1
        return found


    def held(self, text: pa.Array, threshold: float) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, its shingles, those that the row's text holds) of every row and item with at least `threshold` of them."""
        for row, _, data, offsets in W.slices(text):
            w, first = W.word_hashes(data, offsets)
            s, at = W.shingles(w, first, SHINGLE)
            for d, i in sorted(self.candidates(w, first, s, at)):
                own, n = self.sets[i], self.length[i]
                have = s[at[d] : at[d + 1]] if n == SHINGLE or first[d + 1] - first[d] <= n else W.grams(w[first[d] : first[d + 1]], n)
                shared = int(np.isin(own, have).sum())
                if shared >= threshold * len(own):
                    yield row + d, i, len(own), shared


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    """Items in blocks of at most MAX_BROADCAST words, read one partition at a time."""
    ids, texts, n = [], [], 0
    for item, text in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        ids.append(item)
        texts.append(text)
        n += len((text or "").split()) + 1
        if n >= MAX_BROADCAST:
            yield ids, texts
            ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document and an item of whose distinct word shingles it holds at least `threshold`.

    Columns: document and item id, n_item (the item's distinct shingles), n_shared, containment. Words are runs of
    ASCII letters and digits and non-ASCII characters, ASCII lower-cased. An item of under five words is one shingle
    of its own length; one without words is in no document. Null texts have no words. Repeated rows give repeated
    pairs. Empty tables give an empty table. The items are the queries: they go out in blocks of bounded size.
    """
    kinds = {f.name: f.dataType for f in docs.schema.fields}, {f.name: f.dataType for f in items.schema.fields}
    schema = T.StructType([T.StructField("doc", kinds[0][doc_id]), T.StructField("item", kinds[1][item_id]), T.StructField("n_item", T.LongType()), T.StructField("n_shared", T.LongType())])
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for ids, texts in _blocks(items, item_id, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(_Items(ids, texts))

        def search(batches, sent=sent):
            block: _Items = sent.value
            for batch in batches:
                doc_ids = batch.column(0)
                hits = list(block.held(batch.column(1), threshold))
                if hits:
                    at_doc, at_item, n_item, n_shared = zip(*hits, strict=True)
                    item_ids = pa.array([block.ids[i] for i in at_item], type=sent_type)
                    yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(at_doc, pa.int64())), item_ids, pa.array(n_item, pa.int64()), pa.array(n_shared, pa.int64())], names=["doc", "item", "n_item", "n_shared"])

        sent_type = pa.string() if kinds[1][item_id] == T.StringType() else pa.int64() if kinds[1][item_id] == T.LongType() else pa.int32() if kinds[1][item_id] == T.IntegerType() else None
        out = out.unionByName(rows.mapInArrow(search, schema))
    return out.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id if item_id != doc_id else f"item_{item_id}"), "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_text: str = "text", item_text: str = "text", item_id: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the rows whose text holds an item, as `contained_items` judges it.

    Each row is judged by its own text, so ids play no part: rows of one id, or without one, are kept or dropped each for itself, repeated rows alike. All columns stay, whatever their names; only the text goes to Python.
    Null, empty and wordless texts hold no item and stay; a text of any length is searched whole. Without items all rows stay; an empty table gives an empty one.
    """
    kept = docs

    def leaky(sent: Broadcast):
        @F.arrow_udf("boolean")
        def holds(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                found = np.zeros(len(column), bool)
                found[[row for row, *_ in sent.value.held(column, threshold)]] = True
                yield pa.array(found)

        return holds

    for ids, texts in _blocks(items, item_id, item_text):
        holds = leaky(docs.sparkSession.sparkContext.broadcast(_Items(ids, texts)))
        kept = kept.where(~holds(F.col(doc_text)))
    return kept
