"""Near-duplicate classes by Order MinHash.

Of each text's 3-word shingles, labelled by occurrence, N_BANDS hash functions sample the MINIMA lowest each and keep
them in the order of the text: texts agree in such a band with a probability that follows edit similarity, not only set
overlap. A short text has too few shingles for that, so it also gets keys by pigeonhole: of t + 1 segments of the shorter text one is left
whole by t edits, and stands in the other text near its own place. Texts that agree in a band or key are candidates, verified by banded alignment of their words; verified links
are closed to classes.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import words as W
from corvane.llm.graph import components
from corvane.llm.shared import counted, merged, others, scratch, shuffles_removed, stored, unused
from corvane.sources import storage

#: Short shingles and few minima: a text with every fifth word changed keeps half of its 3-word shingles.
SHINGLE = 3
THRESHOLD = 0.8
N_BANDS = 24
#: Shingles sampled for a band.
MINIMA = 2
#: Bits of a text's parities, see `_parities`, and of the finer ones that texts of over a quarter as many words as PARITIES have besides: in a few cells the words of a long text even out.
PARITIES, FINE = 1_024, 4_096
#: Edits that an alignment first allows for.
BAND = 32
#: Words of a text up to which all texts of at least that similarity are found, whatever the bands say.
SHORT = 24
#: Edits up to which short texts meet by what is left without the edited words; beyond by whole segments.
FEW_EDITS = 2
#: Texts of a bucket up to which each is compared with each; those of larger ones with the first and their neighbours, then by their rare bigrams.
SMALL = 8
#: Orders of texts in buckets, see `_neighbours`.
ORDERS = 4
#: Rare bigrams before each one that it is sent with, by which pairs are told that have met already.
BEFORE = 8
#: Texts whose bigrams are sent to be counted together.
PART_TEXTS = 1_000
#: Rare bigrams of a batch, or one text's where they are more.
BATCH_ROWS = 4_096

_rng = np.random.default_rng(11)
_A = _rng.integers(0, 1 << 63, N_BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, N_BANDS, dtype=np.uint64)
_TOP = np.uint64((1 << 64) - 1)


def order_minhash(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(documents, N_BANDS) band values; documents without shingles get zeros."""
    n = len(at) - 1
    out = np.zeros((n, N_BANDS), np.int64)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    begins, count = at[:-1][full], np.diff(at)[full]
    # Label by occurrence: equal shingles of a document become different elements.
    keyed = shingles + np.repeat(W.mix(full.astype(np.uint64) + np.uint64(1)), count)
    order = np.argsort(keyed, kind="stable")
    run = np.flatnonzero(np.r_[True, keyed[order][1:] != keyed[order][:-1]])
    occurrence = np.zeros(len(order), np.uint64)
    occurrence[order] = np.arange(len(order)) - np.repeat(run, np.diff(np.r_[run, len(order)]))
    labelled = W.mix(shingles + occurrence * np.uint64(0xD6E8FEB86659FD93))
    for j in range(N_BANDS):
        h = np.minimum(labelled * _A[j] + _B[j], _TOP - np.uint64(1))
        places = []
        for _ in range(MINIMA):
            low = np.minimum.reduceat(h, begins)
            spots = np.flatnonzero(h == np.repeat(low, count))
            place = spots[np.searchsorted(spots, begins)]
            places.append(place)
            h[place] = _TOP
        value = np.full(len(full), _B[j])
        for place in np.sort(places, axis=0):
            value = W.mix(value * np.uint64(0xA0761D6478BD642F) + shingles[place])
        out[full, j] = value.view(np.int64)
    return out


def _edits(n: int) -> int:
    """Edits by which a text may differ from one of `n` words, if neither is longer."""
    return int((1 - THRESHOLD) * n + 1e-9)


def _segments(n: int, parts: int) -> list[tuple[int, int]]:
    """(begin, length) of `parts` segments of n words, as even as can be."""
    edges = [n * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def short_keys(words: np.ndarray) -> np.ndarray:
    """Keys of a text of hashed words: two different texts that are THRESHOLD similar, the shorter of at most SHORT words, have one in common.

    Up to FEW_EDITS edits, the keys are what is left of a text without up to so many of its words: without those that an edit has touched two such texts are the same. For t edits beyond, the shorter text is
    cut into t + 1 segments, and one of them is in the longer text as it is. The i-th such segment (from 0) can have moved by i
    words at most, counting from either text's begin, and by t - i counting from the ends.
    """
    n, keys = len(words), []
    key = lambda part, *what: xxhash.xxh3_64_intdigest(part.tobytes() + bytes(what))
    allowed = {_edits(m) for m in range(n, int(n / THRESHOLD + 1e-9) + 1)} if n <= SHORT else set()  # as the shorter text
    own = _edits(n)  # as the longer one
    few = max([t for t in {*allowed, own} if t <= FEW_EDITS], default=0)
    for t in range(few + 1) if few else ():
        keys += [key(np.delete(words, gone)) for gone in combinations(range(n), t)]
    for t in allowed:
        if t > FEW_EDITS:
            keys += [key(words[at : at + size], n, t, i) for i, (at, size) in enumerate(_segments(n, t + 1))]
    for length in range(n - own, min(n, SHORT) + 1) if own > FEW_EDITS else ():
        for i, (at, size) in enumerate(_segments(length, own + 1)):
            more = n - length
            low, high = max(0, at - i, at + more - (own - i)), min(n - size, at + i, at + more + (own - i))
            keys += [key(words[q : q + size], length, own, i) for q in range(low, high + 1)]
    return np.unique(np.array(keys, np.uint64)).view(np.int64)


def _apart(a: np.ndarray, b: np.ndarray, cells: int) -> int:
    """In how many elements two multisets of 32-bit hashes differ, or fewer where some share one of so many cells, a power of 2. Nothing is sorted for it."""
    one, other = (np.bincount(x & np.uint32(cells - 1), minlength=cells) for x in (a, b))
    return int(np.abs(one - other).sum())


def _pairs_of(x: np.ndarray) -> np.ndarray:
    return x[:-1].astype(np.uint64) << np.uint64(32) | x[1:].astype(np.uint64)


def _banded(longer: np.ndarray, shorter: np.ndarray, band: int) -> int:
    """The edit distance of two sequences if it is at most `band`, else some larger number. `longer` has more than `band` words, and at most `band` more than `shorter`.

    A column's steps from one row to the next are bits of whole numbers, and only the 2 * band + 1 rows around the diagonal are kept (bit-parallel
    alignment within a band). The distance is followed along the lowest diagonal until it meets the last row, and then along that row.
    """
    where: dict[int, int] = {}
    for i, w in enumerate(longer.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    width = 2 * band + 1
    full, low = (1 << width) - 1, 1 << (width - 1)
    up, down = (1 << (band + 1)) - 1 << band, 0  # rows that are one more, or one less, than the row above
    distance, most, row = band, 2 * band + len(shorter) - len(longer), low >> 1
    last, columns, found = len(longer) - band, shorter.tolist(), where.get
    for j, w in enumerate(columns):
        same = found(w, 0)
        if same:
            same = (same >> (j - band) if j >= band else same << (band - j)) & full
        free = (((same & up) + up) ^ up | same | down) & full  # a step down the diagonal costs nothing
        more, less = down | full ^ (free | up), free & up
        if j < last:
            if not free & low:
                distance += 1
                if distance > most:
                    return band + 1
        else:
            distance += bool(more & row) - bool(less & row)
            row >>= 1
            if distance > most:
                return band + 1
        free >>= 1
        up, down = less | full ^ (free | more), free & more
    return distance


def edit_distances(pairs: list[tuple[np.ndarray, np.ndarray]], limits: list[int]) -> list[bool]:
    """Whether the edit distance of each pair of word sequences is at most its limit: bounds by common words and bigrams first, then bands of growing width."""
    result = [False] * len(pairs)
    for i, (x, y) in enumerate(pairs):
        n = max(len(x), len(y))
        if abs(len(x) - len(y)) > limits[i]:
            continue
        m, cells = min(len(x), len(y)), 1 << max(10, (4 * n).bit_length())
        changed = (_apart(x, y, cells) + n - m + 1) // 2  # words of the longer that an edit must have changed, or fewer
        if changed > limits[i]:
            continue  # an edit changes at most one word of the longer and two bigrams
        if m > 1 and _apart(*(z[:-1] * np.uint32(0x9E3779B1) + z[1:] for z in (x, y)), cells) > m - n + 4 * limits[i]:
            continue
        differ = np.flatnonzero(x[:m] != y[:m])
        head = int(differ[0]) if len(differ) else m
        x, y = x[head:], y[head:]
        m = min(len(x), len(y))
        differ = np.flatnonzero(x[::-1][:m] != y[::-1][:m])
        tail = int(differ[0]) if len(differ) else m
        x, y = x[: len(x) - tail], y[: len(y) - tail]
        if not len(x) or not len(y) or max(len(x), len(y)) <= limits[i]:
            result[i] = max(len(x), len(y)) <= limits[i]
        else:
            x, y = (x, y) if len(x) >= len(y) else (y, x)
            band, least = min(max(BAND, changed + changed // 4), limits[i]), len(x) - len(y)
            while least <= limits[i]:
                if least <= band and _banded(x, y, band) <= band:
                    result[i] = True
                    break
                if band == limits[i]:
                    break
                band = min(4 * band, limits[i])
    return result


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, n, bands, keys) of each document: t is the text's MD5, n its words; both null for null text."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("t", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for row, end, data, offsets in W.slices(batch.column(2)):
                w, first = W.word_hashes(data, offsets)
                bands = order_minhash(*W.shingles(w, first, SHINGLE))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, N_BANDS), pa.int32()), pa.array(bands.ravel()))
                n = np.diff(first)
                keys = [short_keys(w[a:b]) if 0 < b - a <= SHORT / THRESHOLD else np.zeros(0, np.int64) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), pa.array(n.astype(np.int32)), lists, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))], names=schema.names)

    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("t"), text.alias("text")).mapInArrow(run, schema)


def _sequences(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(t, words) for each wanted text: the 32-bit hashes of its words, in order."""

    def run(batches):
        for batch in batches:
            for row, end, data, offsets in W.slices(batch.column(1)):
                w, first = W.word_hashes(data, offsets)
                w = w.astype(np.uint32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array([w[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["t", "words"])

    texts = docs.select(F.col(text_col).alias("text")).where("text is not null").select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("t"), "text")
    # Equal texts are one by the join's own key, so only texts are shuffled and not their words again.
    return texts.join(wanted, "t", "left_semi").dropDuplicates(["t"]).mapInArrow(run, "t binary, words binary")


def _verified(pairs: DataFrame, sequences: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Those of `pairs` (a, b: texts, and the columns `more`, binary) whose words are at least THRESHOLD similar: 1 - edit distance / longer length."""
    names = ["a", "b", *(more or [])]
    left = sequences.select(F.col("t").alias("a"), F.col("words").alias("x"))
    right = sequences.select(F.col("t").alias("b"), F.col("words").alias("y"))

    def run(batches):
        for batch in batches:
            x, y = ([np.frombuffer(w, np.uint32) for w in batch.column(c).to_pylist()] for c in ("x", "y"))
            limits = [int((1 - THRESHOLD) * max(len(i), len(j)) + 1e-9) for i, j in zip(x, y, strict=True)]
            good = pa.array(edit_distances(list(zip(x, y, strict=True)), limits))
            yield batch.select(names).filter(good)

    # Both joins are by a single key without more above, so Spark splits a text that has many pairs.
    both = merged(merged(pairs, left, "a"), right, "b")
    return both.select(*names, "x", "y").mapInArrow(run, ", ".join(f"{c} binary" for c in names))


def _close_lengths(n: str, m: str) -> Column:
    """Whether texts of so many words can be THRESHOLD similar."""
    return F.least(n, m) >= F.ceil(F.greatest(n, m) * F.lit(THRESHOLD) - F.lit(1e-6))


def _pairs_within(members: DataFrame, key: str) -> DataFrame:
    """Each pair of texts (a, b, their roots p and q) of different roots that share a `key` and can be similar by length, once for each key they share.

    Of rare bigrams (see `_rare_bigrams`), so many must follow in both texts as a similar pair has in common, pairs must be plausible by parities, and not share a bigram right before: they have met there.
    """
    one, other = (members.select(key, *[F.col(c).alias(f"{side}_{c}") for c in members.columns if c != key]) for side in "xy")
    # What meets can outgrow what Spark expects of it by far, so neither side is broadcast.
    apart = (F.col("x_t") < F.col("y_t")) & _close_lengths("x_n", "y_n") & (F.col("x_root") != F.col("y_root"))
    if "rest" in members.columns:  # the cheap tests first
        n = F.greatest("x_n", "y_n")
        odd = F.aggregate(F.zip_with("x_fine", "y_fine", lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda total, some: total + some)
        apart = ((F.col("x_last") != F.col("y_last")) | (F.col("x_last") == 0)) & apart & (F.least("x_rest", "y_rest") >= n - 2 - 2 * _allowed(n)) & _few_odd("x_n", "y_n", "x_bits", "y_bits")
        apart = apart & ~F.arrays_overlap("x_before", "y_before") & F.coalesce(odd <= _most_odd("x_n", "y_n"), F.lit(True))  # null where one of the two has no finer parities
    met = merged(one, other, key).where(apart)
    return met.select(F.col("x_t").alias("a"), F.col("y_t").alias("b"), F.col("x_root").alias("p"), F.col("y_root").alias("q"))


def _neighbours(members: DataFrame) -> DataFrame:
    """Pairs of texts (a, b) that stand next to each other in a bucket and can be similar by length; ORDERS orders by chance, of which each bucket has one.

    Near copies are in many buckets together, so each gets several neighbours by chance, and that links most of a class whatever its size. Buckets are split where
    Spark cuts the sorted rows; two texts on either side of a cut are no neighbours.
    """

    def run(batches):
        last = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            v = rows.column("v").to_numpy()
            at = np.flatnonzero(v[:-1] == v[1:])
            one, other = rows.take(at), rows.take(at + 1)
            yield from pa.table({"x_t": one["t"], "x_n": one["n"], "y_t": other["t"], "y_n": other["n"]}).to_batches()
            last = batch.slice(batch.num_rows - 1)

    dealt = members.select("v", F.xxhash64(F.pmod("v", F.lit(ORDERS)), "t").alias("o"), "t", "n").repartitionByRange("v", "o").sortWithinPartitions("v", "o")
    beside = dealt.mapInArrow(run, "x_t binary, x_n long, y_t binary, y_n long").where((F.col("x_t") != F.col("y_t")) & _close_lengths("x_n", "y_n"))
    return beside.select(F.least("x_t", "y_t").alias("a"), F.greatest("x_t", "y_t").alias("b"))


def _occurrences(values: np.ndarray) -> np.ndarray:
    """How many equal values stand before each one."""
    order = np.argsort(values, kind="stable")
    run = np.flatnonzero(np.r_[True, values[order][1:] != values[order][:-1]])
    occurrence = np.zeros(len(values), np.uint64)
    occurrence[order] = np.arange(len(values)) - np.repeat(run, np.diff(np.r_[run, len(values)]))
    return occurrence


def _labelled(words: bytes) -> np.ndarray:
    """64-bit elements of a text: its words, equal ones told apart by their occurrence."""
    w = np.frombuffer(words, np.uint32).astype(np.uint64)
    return W.mix(w + (_occurrences(w) << np.uint64(32)))


def _bigrams(words: bytes) -> np.ndarray:
    """64-bit elements of a text: each two words in a row (of a single word: that), equal ones told apart by their occurrence."""
    w = np.frombuffer(words, np.uint32)
    pairs = _pairs_of(w) if len(w) > 1 else w.astype(np.uint64)
    return W.mix(W.mix(pairs) + _occurrences(pairs))


def _bits(labelled: np.ndarray, cells: int = PARITIES) -> np.ndarray:
    """Whether an odd number of elements falls into each of so many cells, as 64-bit integers."""
    return np.packbits((np.bincount((labelled % np.uint64(cells)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)).view(np.int64)


def _lists(bits: list[np.ndarray]) -> pa.Array:
    """A list column of parities."""
    values = np.concatenate([np.zeros(0, np.int64), *bits])
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, PARITIES // 64), pa.int32()), pa.array(values))


def _allowed(n: Column) -> Column:
    """Edits by which a text may differ from one of `n` words, if neither is longer."""
    return F.floor(n * F.lit(1 - THRESHOLD) + F.lit(1e-9))


def _most_odd(n: str, m: str) -> Column:
    """In how many bits similar texts of so many words can differ. An edit changes two labelled words at most, and each of them one bit; as many edits as one text is longer add a word or take one away, which changes one."""
    return 2 * _allowed(F.greatest(n, m)) - (F.greatest(n, m) - F.least(n, m))


def _few_odd(n: str, m: str, bits: str, other: str) -> Column:
    """Whether parities leave it open that texts of so many words are THRESHOLD similar."""
    apart = sum((F.bit_count(F.col(bits)[i].bitwiseXOR(F.col(other)[i])) for i in range(PARITIES // 64)), F.lit(0))
    return apart <= _most_odd(n, m)


def _parities(sequences: DataFrame) -> DataFrame:
    """(t, n, bits) of each of `sequences`: its words, and for each of PARITIES cells whether an odd number of its labelled words falls into it.

    So texts that differ in more bits than edits can change (see `_most_odd`) are not similar, whatever the words.
    """

    def run(batches):
        for batch in batches:
            own = [_labelled(words) for words in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array([len(h) for h in own], pa.int64()), _lists([_bits(h) for h in own])], names=["t", "n", "bits"])

    return sequences.mapInArrow(run, "t binary, n long, bits array<long>")


def _plausible(pairs: DataFrame, parities: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b and any other columns) whose parities leave it open that they are similar. They are some bytes a text, so most pairs go before words are sent."""
    one, other = (parities.select(F.col("t").alias(c), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits")) for c in ("a", "b"))
    met = merged(merged(pairs, one, "a"), other, "b")
    return met.where(_few_odd("a_n", "b_n", "a_bits", "b_bits")).select(pairs.columns)


def _parts_of(batches):
    """(number, rows) of parts of a partition's batches; the number is the same whenever they are read."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for i in range(0, batch.num_rows, PART_TEXTS):
            yield number, batch.slice(i, PART_TEXTS)
            number += 1


def _bigrams_by_bucket(texts: DataFrame, buckets: int) -> DataFrame:
    """(part, bucket, data): the distinct pairs of a bigram and a root in each part of `texts`, in buckets by the bigram; data has the bigrams, then the roots' hashes."""

    def run(batches):
        for number, rows in _parts_of(batches):
            own = [_bigrams(words.as_py()) for words in rows.column("words")]
            w = np.concatenate(own)
            root = np.repeat(np.array([xxhash.xxh3_64_intdigest(x.as_py()) for x in rows.column("root")], np.uint64), [len(x) for x in own])
            w, root = _distinct_pairs(w, root)
            bucket = (w % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            data = [w[order[i:j]].tobytes() + root[order[i:j]].tobytes() for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(data), number)), pa.array(bucket[order[edges[:-1]]]), pa.array(data, pa.binary())], names=["part", "bucket", "data"])

    return texts.mapInArrow(run, "part long, bucket int, data binary")


def _distinct_pairs(w: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((root, w))
    w, root = w[order], root[order]
    fresh = np.r_[True, (w[1:] != w[:-1]) | (root[1:] != root[:-1])] if len(w) else np.zeros(0, bool)
    return w[fresh], root[fresh]


def _shared_bigrams(pairs: DataFrame) -> DataFrame:
    """(part, bucket, data): for each part the bigrams that texts of several roots have, then of how many. A Spark partition's share of the bigrams is in memory at once."""

    def run(batches):
        rows = [(p.as_py(), b.as_py(), np.frombuffer(d.as_py(), np.uint64)) for batch in batches for p, b, d in zip(batch.column(0), batch.column(1), batch.column(2), strict=True)]
        if not rows:
            return
        w, _ = _distinct_pairs(*(np.concatenate([d.reshape(2, -1)[i] for _, _, d in rows]) for i in (0, 1)))
        known, count = np.unique(w, return_counts=True)
        known, count = known[count > 1], count[count > 1].astype(np.uint64)
        if not len(known):
            return
        found, size = [], 0
        for part, bucket, d in rows:
            # Each bigram is looked up among the partition's, so the work is that of the row and not of the partition.
            own = d.reshape(2, -1)[0]
            own = own[np.r_[True, own[1:] != own[:-1]]]  # in order already
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            again = known[place] == own
            if again.any():
                found.append((part, bucket, own[again].tobytes() + count[place[again]].tobytes()))
                size += len(found[-1][2])
                if size >= W.SLICE_BYTES:
                    yield batch_of(found)
                    found, size = [], 0
        if found:
            yield batch_of(found)

    def batch_of(found):
        part, bucket, data = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(bucket, pa.int32()), pa.array(data, pa.binary())], names=["part", "bucket", "data"])

    return pairs.mapInArrow(run, "part long, bucket int, data binary")


def _rare_bigrams(texts: DataFrame) -> DataFrame:
    """(t, n, root, bits, fine, before, last, rest, w): of the 2 * (n // 5) + 2 rarest bigrams of each text those that a text of another root has too, from rare to frequent. Rare are bigrams of few roots.

    `bits` and `fine` are the text's parities, `before` up to BEFORE of those bigrams that come right before, `last` the last of them or 0, `rest` how many of all the text's bigrams come after.
    """
    spark = texts.sparkSession
    shared = _shared_bigrams(_bigrams_by_bucket(texts, 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))).repartition("bucket"))
    names = ["part", "bucket", "t", "n", "root", "data"]

    def tag(batches):
        for number, rows in _parts_of(batches):
            ends = [pa.array(np.full(rows.num_rows, number)), pa.array(np.full(rows.num_rows, 1 << 30, np.int32))]
            yield pa.RecordBatch.from_arrays([*ends, *(rows.column(c) for c in ("t", "n", "root", "words"))], names=names)

    def rarest(words, known, count):
        """(bigrams, how many come after each) of a text."""
        h = _bigrams(words)
        c = np.ones(len(h), np.uint64)
        if len(known):
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            c = np.where(known[place] == h, count[place], c)
        first = np.lexsort((h, c))[: 2 * (len(words) // 20) + 2]  # a word has 4 bytes
        other = c[first] > 1
        return h[first][other], len(h) - 1 - np.flatnonzero(other)

    def table(texts, found):
        """The rows of `texts`; `found` has their words, bigrams and how many come after."""
        sizes = [len(w) for _, w, _ in found]
        labelled = [_labelled(words) for words, _, _ in found]
        bits = [np.tile(_bits(h), size) for h, size in zip(labelled, sizes, strict=True)]
        fine = [_bits(h, FINE) if 4 * len(h) > PARITIES else np.zeros(0, np.int64) for h in labelled]
        w, place = np.concatenate([w for _, w, _ in found]), np.concatenate([np.arange(size) for size in sizes])
        lengths = np.minimum(place, BEFORE)
        at = np.repeat(np.arange(len(w)) - lengths - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        recent = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(w[at].view(np.int64)))
        ends = np.concatenate([[0], np.cumsum(np.repeat([len(b) for b in fine], sizes))])
        finer = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.tile(b, size) for b, size in zip(fine, sizes, strict=True)])))
        last = np.where(place > 0, np.roll(w, 1), np.uint64(0)).view(np.int64)
        rest = np.concatenate([rest for _, _, rest in found])
        own = texts.take(pa.array(np.repeat(np.arange(len(found)), sizes)))
        return pa.RecordBatch.from_arrays([*own.columns, _lists(bits), finer, recent, pa.array(last), pa.array(rest, pa.int64()), pa.array(w.view(np.int64))], names=["t", "n", "root", "bits", "fine", "before", "last", "rest", "w"])

    def run(batches):
        part, known, count = None, [], []
        for batch in batches:
            begin, found, size = 0, [], 0
            for i in range(batch.num_rows):
                if batch.column("part")[i].as_py() != part:
                    part, known, count = batch.column("part")[i].as_py(), [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
                data = batch.column("data")[i].as_py()
                if batch.column("bucket")[i].as_py() < 1 << 30:
                    w, c = np.frombuffer(data, np.uint64).reshape(2, -1)
                    known.append(w)
                    count.append(c)
                    found.append((b"", w[:0], w[:0].view(np.int64)))  # no row of a text
                else:
                    if len(known) != 1:  # the first text after its part's bigrams
                        w, c = np.concatenate(known), np.concatenate(count)
                        order = np.argsort(w)
                        known, count = [w[order]], [c[order]]
                    found.append((data, *rarest(data, known[0], count[0])))
                size += len(found[-1][1])
                if size >= BATCH_ROWS or i + 1 == batch.num_rows:
                    yield table(batch.select(["t", "n", "root"]).slice(begin, i + 1 - begin), found)
                    begin, found, size = i + 1, [], 0

    tagged = texts.mapInArrow(tag, "part long, bucket int, t binary, n long, root binary, data binary")
    none = {c: F.lit(None).cast(kind) for c, kind in (("t", "binary"), ("n", "long"), ("root", "binary"))}
    rows = tagged.unionByName(shared.withColumns(none)).repartition("part").sortWithinPartitions("part", "bucket")
    return rows.mapInArrow(run, "t binary, n long, root binary, bits array<long>, fine array<long>, before array<long>, last long, rest long, w long")


def _rare_pairs(hot: DataFrame, sequences: DataFrame, below: str) -> DataFrame:
    """All pairs (a, b, p, q) of the texts `hot` (t, n, root) that may be similar and are of different roots p and q. What is made on the way goes to `below`.

    An edit changes at most two bigrams of a text, so similar texts of n words and more share all but 2 * (n / 5) + 1 of their labelled bigrams, and whatever the order of bigrams, they have one in
    common among the 2 * (n // 5) + 2 first of each. The order is from bigrams of few roots to those of
    many, so a text with enough bigrams of its own root alone meets nobody. A pair meets at the first bigram in common, and again only after a gap of over BEFORE bigrams.
    """
    texts = stored(sequences.join(hot, "t").select("t", "n", "root", "words"), below)
    return _pairs_within(stored(_rare_bigrams(texts), below), "w")


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """Each of `pairs` (a, b, p, q) once, without those of `tried` (a, b)."""
    known = tried.select("a", "b", *[F.lit(None).cast("binary").alias(c) for c in "pq"], F.lit(True).alias("tried"))
    met = pairs.withColumn("tried", F.lit(False)).unionByName(known).groupBy("a", "b").agg(F.max("p").alias("p"), F.max("q").alias("q"), F.max("tried").alias("tried"))
    return met.where("not tried").drop("tried")


def _text_classes(docs: DataFrame, sketched: DataFrame, text_col: str) -> DataFrame:
    """(t, root, low, class_id) of each text: root names its class, low is its lowest id, class_id that of its class. What is made on the way is removed when classes are written."""
    spark = docs.sparkSession
    below = scratch(spark, "near")
    texts = sketched.where("t is not null").groupBy("t").agg(F.min("id").alias("low"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("keys").alias("keys"))
    values = F.concat(F.transform("bands", lambda band, j: F.xxhash64(j, band)), "keys")
    bucketed = texts.where("n > 0").select("t", F.col("n").cast("long").alias("n"), F.explode(values).alias("v"))
    counts = bucketed.groupBy("v").agg(F.count("*").alias("m")).where("m > 1")
    members = stored(bucketed.join(counts, "v").select("v", "t", "n", "m"), below)
    large = members.where(F.col("m") > SMALL)
    leads = large.groupBy("v").agg(F.min(F.struct("n", "t")).alias("lead"))
    led = large.join(leads, "v").where((F.col("t") != F.col("lead.t")) & _close_lengths("n", "lead.n"))
    led = led.select(F.least("t", "lead.t").alias("a"), F.greatest("t", "lead.t").alias("b"))
    tried = stored(led.unionByName(_neighbours(members)).distinct(), below)
    sequences = stored(_sequences(docs, text_col, members.select("t").distinct()), below)
    roots = components(stored(_verified(tried, sequences), below))
    # Then all other pairs whose texts are not of one class by now.
    rooted = stored(merged(members, roots.withColumnRenamed("node", "t"), "t", "left").select("v", "t", "n", "m", F.coalesce("root", "t").alias("root")), below)
    apart = _plausible(_untried(_pairs_within(rooted.where(F.col("m") <= SMALL).drop("m"), "v"), tried), stored(_parities(sequences), below))
    hot, n_hot = counted(rooted.where(F.col("m") > SMALL).select("t", "n", "root").distinct(), below=below)
    if n_hot:
        apart = apart.unionByName(_untried(_rare_pairs(hot, sequences, below), tried)).distinct()
    apart, n_apart = counted(apart, below=below)
    closures = [roots]
    if n_apart:
        closures.append(components(_verified(apart, sequences, ["p", "q"]).select(F.col("p").alias("a"), F.col("q").alias("b"))))
    named = _named(texts, closures)
    storage.delete(spark, below)
    return named


def _named(texts: DataFrame, closures: list[DataFrame]) -> DataFrame:
    """(t, root, low, class_id) of `texts`, whose roots are those of the first of `closures` (node, root), theirs those of the next, and so on."""
    named = texts.select("t", F.col("t").alias("root"), "low")
    for found in closures:
        named = merged(named, found.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("t", F.coalesce("top", "root").alias("root"), "low")
    named = stored(named)
    lowest = stored(named.groupBy("root").agg(F.min("low").alias("class_id")))
    return named.join(lowest, "root").select("t", "root", "low", "class_id")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: the id column and class_id, the lowest id of its class.

    Two different texts are linked if they agree in a band or a key of short texts and are at least THRESHOLD similar: 1 - edit distance / longer
    length, in words; of texts that have a hot bucket also if they agree in a rare bigram. So no link is missed where the shorter text has up to SHORT words, or both have a hot bucket. Classes are the connected components of links and equal texts, so pairs that are
    of one class already need no alignment. Texts without words have no links, but equal ones are one class; each
    row of null text is one for itself. Null ids count for nothing unless a class has no other; then its class_id is null. Repeated
    ids are rows of their own, and go by their texts. Other columns are not read; an empty table gives an empty one.
    Texts are first compared with neighbours in their buckets, and those of buckets of over SMALL texts with the bucket's first. Of texts that
    are of different classes after that, all that share a smaller bucket are compared, and all with a larger one that share a
    rare bigram, which misses no link.
    """
    others([], ("class_id",), (id_col,))
    with shuffles_removed(docs.sparkSession):
        sketched = stored(sketch(docs, id_col, text_col))
        classes = _text_classes(docs, sketched, text_col).select("t", "class_id")
    out = sketched.select("id", "t").join(classes, "t", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("t").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each class: that of the lowest id, of several texts of that id the one of the lowest hash. Rows of null text all stay.

    Rows of equal id and text are one; which of them stays is open where their other columns differ. Null ids come after all
    others. Columns of any name are kept; an empty table gives an empty one.
    """
    with shuffles_removed(docs.sparkSession):
        classes = _text_classes(docs, stored(sketch(docs, id_col, text_col)), text_col)
    kept = classes.groupBy("root").agg(F.min(F.struct(F.col("low").isNull().alias("last"), "low", "t")).alias("first"))
    own, text, low, number = (unused(docs.columns, c) for c in ("t", "text", "low", "number"))
    kept = kept.select(F.col("first.t").alias(text), F.col("first.low").alias(low))
    rows = docs.withColumn(own, F.unhex(F.md5(F.col(text_col).cast("binary"))))
    met = rows.join(kept, (F.col(own) == F.col(text)) & F.col(id_col).eqNullSafe(F.col(low)), "left").where(F.col(own).isNull() | F.col(text).isNotNull())
    nth = F.row_number().over(Window.partitionBy(own, id_col).orderBy(own))  # by the join's own keys, so nothing is shuffled again
    return met.withColumn(number, nth).where(F.col(own).isNull() | (F.col(number) == 1)).select(*[F.col(f"`{c}`") for c in docs.columns])
