"""Byte-level BPE encoding and decoding.

A pattern cuts the texts of a block of documents into words. Each distinct word of the table is folded once: blocks send
their words to the bucket of the word's hash, Spark higher-order functions fold the ranked merges over the bytes of a
bucket's distinct words by a literal map of ranks, and the ids go back to the blocks, which put their documents
together from them. A word comes from a block at most once, however frequent it is, so no bucket is hot; nothing
passes through the driver but the ranks. Decoding concatenates the binary pieces of the ids.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.shared import tidy

#: Characters of text whose distinct words are looked up together; a longer text is a block of its own.
BLOCK_CHARS = 12_000_000
#: Characters of text that are cut at once.
SLICE_CHARS = 1_000_000
#: Bytes of a word up to which Spark folds it; every merge of the fold passes over the word, so longer ones take a heap instead.
LONG_WORD = 1_000
#: Buckets of words for each shuffle partition.
SPREAD = 3
#: Parts of the rank map. A Spark map is searched from end to end, so there is one for each hash value.
N_MAPS = 1 << 15
#: Ids, of whole documents, that are put together or decoded at once.
OUT_IDS = 1 << 19
#: Words or pieces whose ids are gathered at once.
GATHERED = 1 << 18
#: What a text has if its white space is more than single spaces and newlines between others, or if it is empty.
ODD_SPACES = r"^[ \n]|[ \n]$|[ \n][ \n]|^$|[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Most ranks that are sent as a literal.
MAX_RANKS = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token, from a file of lines with a token in base64 and its rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if missing := 256 - sum(bytes([b]) in ranks for b in range(256)):
        raise ValueError(f"{path}: {missing} single bytes have no rank")
    if len(ranks) > MAX_RANKS or max(ranks.values()) >= MAX_RANKS:
        raise ValueError(f"{path}: {len(ranks)} ranks; at most {MAX_RANKS} fit the fold's numbers")
    return ranks


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal: an array of maps from the hexadecimal form of a token, at its CRC modulo N_MAPS."""
    maps: list[dict[str, int]] = [{} for _ in range(N_MAPS)]
    for token, rank in ranks.items():
        maps[zlib.crc32(token) % N_MAPS][token.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")  # folded to a value before the query runs


def fold_merges(word: Column, ranks: Column) -> Column:
    """Ids of a word of at most LONG_WORD bytes: one that is a token is that token; else the pair of the lowest rank, the first such, is merged until no pair has a rank.

    The fold's state is an array with a number for each part: from the high bits down the rank of the part joined with
    the next, where the part starts, where it ends, and where the next one ends (0 for the last part). So the lowest number is
    the pair to merge, and a merge changes only the parts that touch it.
    """
    none, bits, some = 1 << 22, 10, F.lit(1023).cast("long")

    def bind(value: Column, use: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(value), use)[0]

    def rank(start: Column, end: Column) -> Column:
        piece = F.substring(word, start.cast("int"), (end - start).cast("int"))
        return bind(piece, lambda p: F.try_element_at(F.get(ranks, F.pmod(F.crc32(p), F.lit(N_MAPS)).cast("int")), F.hex(p)))

    def part(start: Column, end: Column, following: Column) -> Column:
        high = F.shiftleft(F.coalesce(rank(start, following), F.lit(none)).cast("long"), 3 * bits)
        return high.bitwiseOR(F.shiftleft(start, 2 * bits)).bitwiseOR(F.shiftleft(end, bits)).bitwiseOR(following)

    start_of = lambda x: F.shiftright(x, 2 * bits).bitwiseAND(some)
    end_of = lambda x: F.shiftright(x, bits).bitwiseAND(some)
    following_of = lambda x: x.bitwiseAND(some)

    def merge(state: Column, _: Column) -> Column:
        return bind(F.array_min(state), lambda low: F.when(low < F.lit(none << 3 * bits), bind(start_of(low), lambda a: bind(end_of(low), lambda b: merged(state, low, a, b)))).otherwise(state))

    def merged(state: Column, low: Column, start: Column, end: Column) -> Column:
        rest = F.filter(state, lambda x: x != low)
        own, before = lambda x: part(start, following_of(low), following_of(x)), lambda x: part(start_of(x), start, following_of(low))
        return F.transform(rest, lambda x: F.when(start_of(x) == end, own(x)).when(end_of(x) == start, before(x)).otherwise(x))

    n = F.length(word).cast("long")
    numbers = F.sequence(F.lit(1).cast("long"), n)
    begin = F.transform(numbers, lambda i: part(i, i + 1, F.when(i < n, i + 2).otherwise(F.lit(0).cast("long"))))
    parts = F.transform(F.aggregate(F.sequence(F.lit(2).cast("long"), n), begin, merge), lambda x: rank(start_of(x), end_of(x)))
    return bind(rank(F.lit(1).cast("long"), n + 1), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(parts))


def heap_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids that fold_merges gives, in time that hardly outgrows the word."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at each place

    def rank(at: int) -> int | None:
        middle = following[at]
        return ranks.get(word[at : following[middle]]) if middle < n else None

    heap = [(r, i) for i in range(n - 1) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        r, at = heapq.heappop(heap)
        if gone[at] or rank(at) != r:
            continue
        middle = following[at]
        gone[middle] = 1
        following[at] = end = following[middle]
        if end < n:
            before[end] = at
        for i in (before[at], at):
            if i >= 0 and (new := rank(i)) is not None:
                heapq.heappush(heap, (new, i))
    return [ranks[word[i : following[i]]] for i in range(n) if not gone[i]]


def _squeeze(*parts: bytes) -> bytes:
    sizes = np.array([len(parts), *map(len, parts)], "<i8").tobytes()
    return zstandard.compress(sizes + b"".join(parts), 1)


def _parts(squeezed: bytes) -> list[bytes]:
    raw = zstandard.decompress(squeezed)
    n = int.from_bytes(raw[:8], "little")
    ends = np.cumsum(np.frombuffer(raw, "<i8", n, 8)) + 8 * (n + 1)
    return [raw[a:b] for a, b in zip([8 * (n + 1), *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers, all first bytes before all second ones: small numbers compress well so."""
    return np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _coded(numbers: np.ndarray) -> list[bytes]:
    """Numbers that were given in order of first use, in few bytes: how often each occurs, and in each place 0 for a first use, else one more than the rank by frequency."""
    often = np.bincount(numbers)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(-often, kind="stable")] = np.arange(len(often))
    new = numbers > np.maximum.accumulate(np.concatenate([[-1], numbers]))[:-1]
    return [_planes(often), _planes(np.where(new, 0, rank[numbers] + 1))]


def _decoded(often: bytes, coded: bytes) -> np.ndarray:
    coded = _from_planes(coded)
    of_rank = np.argsort(-_from_planes(often), kind="stable")
    out = np.cumsum(coded == 0, dtype=np.int32) - 1
    known = coded > 0
    out[known] = of_rank[coded[known] - 1]
    return out


class _Codes(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class _Block:
    """Documents as numbered pieces, and the words of each piece.

    A text whose white space is single spaces and newlines is cut before spaces and around newlines, where the pattern
    always cuts too; any other text is cut by the pattern at once. So the pattern runs over distinct pieces only.
    """

    def __init__(self, pattern: regex.Pattern, cuts_at_spaces: bool):
        self.pattern, self.cuts = pattern, cuts_at_spaces
        self.ids, self.pieces, self.counts, self.spaced, self.chars = [], [], [], [], 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        """Documents of some ids and texts, large strings without nulls. Their pieces are numbered at once, so that only distinct ones are kept."""
        plain = ~np.asarray(pc.match_substring_regex(texts, ODD_SPACES)) if self.cuts else np.zeros(len(texts), bool)
        edges = [*np.flatnonzero(np.diff(plain, prepend=~plain[:1])).tolist(), len(texts)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = texts.slice(a, b - a)
            if plain[a]:
                own = pc.split_pattern(pc.replace_substring(own, "\n", " \n "), " ")
            else:
                own = pa.array([self.pattern.findall(t) for t in own.to_pylist()], pa.list_(pa.large_string()))
            self.pieces.append(own.flatten().dictionary_encode())
            self.counts.append(np.asarray(own.value_lengths(), np.int32))
            self.spaced.append(plain[a:b])
        self.ids.append(ids)

    def _codes(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(distinct pieces, pieces of each document, in each place twice a piece's number, and one more if a space stands before it)."""
        chunks = pa.chunked_array(self.pieces).unify_dictionaries().chunks
        names = chunks[0].dictionary
        self.pieces.clear()
        counts, codes = np.concatenate(self.counts), np.concatenate([c.indices for c in chunks])
        bare = ~np.repeat(np.concatenate(self.spaced), counts)
        newline = codes == pc.index(names, pa.scalar("\n", pa.large_string())).as_py()
        bare |= newline
        bare[1:] |= newline[:-1]
        begins = np.cumsum(counts) - counts
        bare[begins[counts > 0]] = True
        return names, counts, 2 * codes + ~bare

    def words(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct words, words in each piece, words of all pieces, pieces of each document, number of the piece in each place)."""
        names, counts, codes = self._codes()
        first = np.full(2 * len(names), -1)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        used = np.flatnonzero(first >= 0)
        used = used[np.argsort(first[used])]
        first[used] = np.arange(len(used))  # numbers in order of first use
        codes = first[codes].astype(np.int32)
        bare = names.take(pa.array(used >> 1))
        space = pa.array(np.where(used & 1, " ", ""), pa.large_string())
        pieces = pc.binary_join_element_wise(space, bare, pa.scalar("", pa.large_string()))
        letters = self.cuts and self.pattern.findall("ab é") == ["ab", " é"]
        whole = np.asarray(pc.ascii_is_alpha(bare)) if letters else np.zeros(len(used), bool)
        rest = np.flatnonzero(~whole)
        with_space, without = (x.take(pa.array(rest)).to_numpy(zero_copy_only=False) for x in (pieces, bare))
        found = [[p] if letters and name.isalpha() else self.pattern.findall(p) for p, name in zip(with_space, without, strict=True)]
        each = np.ones(len(used), np.int32)
        each[rest] = [len(f) for f in found]
        begins = np.cumsum(each) - each
        at = np.empty(int(each.sum()), np.int64)
        at[begins[whole]] = np.flatnonzero(whole)
        at[_places(begins[rest], each[rest])] = len(used) + np.arange(int(each[rest].sum()))
        more = pa.array([w for f in found for w in f], pa.large_string())
        of = pa.concat_arrays([pieces, more]).take(pa.array(at)).dictionary_encode()
        return of.dictionary.cast(pa.large_binary()), each, np.asarray(of.indices), counts, codes


def _blocks(batches, pattern: str) -> Iterator[_Block]:
    compiled = regex.compile(pattern)
    cuts = compiled.findall("a b\nc .\n.") == ["a", " b", "\n", "c", " .", "\n", "."]
    block = _Block(compiled, cuts)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.large_string()).fill_null("")
        ends, a = np.cumsum(np.asarray(pc.utf8_length(texts), np.int64)), 0
        while a < len(texts):
            before = int(ends[a - 1]) if a else 0
            b = min(len(texts), int(np.searchsorted(ends, before + min(SLICE_CHARS, BLOCK_CHARS - block.chars))) + 1)
            block.add(ids.slice(a, b - a), texts.slice(a, b - a))
            block.chars += int(ends[b - 1]) - before
            a = b
            if block.chars >= BLOCK_CHARS:
                yield block
                block = _Block(compiled, cuts)
                pa.default_memory_pool().release_unused()
    if block.ids:
        yield block


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places from each start on, as many as its length, one after another."""
    ends = np.cumsum(lengths, dtype=np.int64)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def _gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start : start + length] of each start and length, one after another."""
    out, done = np.empty(int(lengths.sum(dtype=np.int64)), values.dtype), 0
    for i in range(0, len(starts), GATHERED):
        own = values[_places(starts[i : i + GATHERED], lengths[i : i + GATHERED])]
        out[done : done + len(own)] = own
        done += len(own)
    return out


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that end at these bytes of `data`, each where the one before ends."""
    if ends[-1] > np.iinfo(np.int32).max:
        raise ValueError("a document of over 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _ragged(flat: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _grown(have: np.ndarray, n: int) -> np.ndarray:
    """`have`, with room for n values at least."""
    return have if n <= len(have) else np.concatenate([have, np.zeros(max(n, 2 * len(have)) - len(have), have.dtype)])


def _split(texts: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """(key, block, bucket, ids, data): a row of each block with its documents' ids and codes, bucket -1, and rows with its words of each bucket."""
    kind = texts.schema["id"].dataType
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("data", T.BinaryType())])

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        for k, block in enumerate(_blocks(batches, pattern), first):
            words, each, of, counts, codes = block.words()
            ids = pa.concat_arrays(block.ids)
            del block
            own = _squeeze(np.array([len(words)], np.int64).tobytes(), _planes(counts), _planes(each), *_coded(of), *_coded(codes))
            own_ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            del each, of, counts, codes
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([k]), pa.array([-1], pa.int32()), own_ids, pa.array([own], pa.binary())], names=schema.names)
            bucket = np.fromiter(map(zlib.crc32, words.to_numpy(zero_copy_only=False)), np.int64, len(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            words = words.take(pa.array(order))
            at, flat = (np.frombuffer(words.buffers()[1], np.int64, len(words) + 1), memoryview(words.buffers()[2])) if len(words) else (np.zeros(1, np.int64), b"")
            rows = [_squeeze(_planes(np.diff(order[a:b], prepend=0)), _planes(np.diff(at[a : b + 1])), flat[at[a] : at[b]]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            found = bucket[order[edges[:-1]]]
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(rows), k)), pa.array(found.astype(np.int32)), pa.nulls(len(rows), pa.list_(ids.type)), pa.array(rows, pa.binary())], names=schema.names)

    return texts.mapInArrow(tidy(run), schema)


def _distinct(rows: DataFrame) -> DataFrame:
    """`rows` with `words`, those that this partition has not had before; data: places in the block, then numbers of the partition's words."""
    schema = T.StructType([*rows.schema.fields, T.StructField("words", T.ArrayType(T.BinaryType()))])

    def run(batches):
        number = _Codes()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                new: list[bytes] = []
                if row.column("bucket")[0].as_py() >= 0:
                    places, lengths, flat = _parts(row.column("data")[0].as_py())
                    known = len(number)
                    words = _ragged(flat, _from_planes(lengths))
                    at = np.fromiter(map(number.__getitem__, words), "<i4", len(words))
                    new = [w for w, k in zip(words, at.tolist(), strict=True) if k >= known]  # a block has a word once
                    row = row.set_column(row.schema.get_field_index("data"), "data", pa.array([places + at.tobytes()], pa.binary()))
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([new], pa.list_(pa.binary()))], names=schema.names)

    return rows.mapInArrow(tidy(run), schema)


def _addressed(rows: DataFrame, long_words) -> DataFrame:
    """(block, bucket, ids, data) for the blocks: data has the places of their words, the lengths of the words' ids, and the ids."""
    schema = T.StructType([f for f in rows.schema.fields if f.name in ("block", "bucket", "ids", "data")])

    def run(batches):
        flat, ends, n = np.zeros(1 << 16, "<u4"), np.zeros(1 << 12, np.int64), 0  # ids of all words so far, and where those of each end
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                folded = row.column("folded")[0].values
                if len(folded):
                    own, sizes = np.asarray(folded.flatten(), "<u4"), np.asarray(folded.value_lengths(), np.int64)
                    if not sizes.all():  # words that were too long to be folded
                        words, at = row.column("words")[0].values, np.cumsum(sizes)
                        each = [own[b - s : b] if s else np.array(heap_merges(words[j].as_py(), long_words.value), "<u4") for j, (b, s) in enumerate(zip(at.tolist(), sizes.tolist(), strict=True))]
                        own, sizes = np.concatenate(each), np.array([len(x) for x in each], np.int64)
                    have, end = int(ends[n]), n + len(sizes)
                    flat, ends = _grown(flat, have + len(own)), _grown(ends, end + 1)
                    flat[have : have + len(own)] = own
                    ends[n + 1 : end + 1] = have + np.cumsum(sizes)
                    n = end
                out = row.select(schema.names)
                if row.column("bucket")[0].as_py() >= 0:
                    raw = row.column("data")[0].as_py()
                    places, at = raw[: len(raw) // 2], np.frombuffer(raw, "<i4", offset=len(raw) // 2)
                    sizes = ends[at + 1] - ends[at]
                    data = _squeeze(places, _planes(sizes), _planes(_gathered(flat, ends[at], sizes)))
                    out = out.set_column(out.schema.get_field_index("data"), "data", pa.array([data], pa.binary()))
                yield out

    return rows.mapInArrow(tidy(run), schema)


def _put_together(rows: DataFrame, kind: T.DataType) -> DataFrame:
    """(id, n_tokens, tokens) of the documents of sorted `rows`: the row of each block, then those with the ids of its words."""
    schema = T.StructType([T.StructField("id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.BinaryType())])

    def finish(ids, own: list[bytes], found: list[tuple[np.ndarray, ...]]):
        counts, each = map(_from_planes, own[1:3])
        of, codes = _decoded(*own[3:5]), _decoded(*own[5:7])
        sizes = np.full(int.from_bytes(own[0], "little"), -1)
        starts = np.zeros(len(sizes), np.int64)
        flat, n = np.zeros(sum(len(ids_of) for _, _, ids_of in found), "<u4"), 0
        for places, lengths, ids_of in found:
            sizes[places], starts[places] = lengths, n + np.cumsum(lengths) - lengths
            flat[n : n + len(ids_of)] = ids_of
            n += len(ids_of)
        if (sizes < 0).any():
            raise ValueError("a block lacks words: its documents did not come in the same order twice")
        # The ids of each piece, then those of each document.
        flat = _gathered(flat, starts[of], sizes[of])
        ends = np.r_[0, np.cumsum(sizes[of])][np.r_[0, np.cumsum(each)]]
        starts, sizes = ends[:-1], np.diff(ends)
        at = np.r_[0, np.cumsum(counts)]
        ends, first = np.r_[0, np.cumsum(sizes[codes])][at], 0
        while first < len(ids):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + OUT_IDS, "right")) - 1)
            some = codes[at[first] : at[last]]
            tokens, until = _gathered(flat, starts[some], sizes[some]), ends[first : last + 1] - ends[first]
            yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(np.diff(until)), _binaries(tokens, 4 * until)], names=schema.names)
            first = last

    def run(batches):
        ids, own, found = None, None, []
        for batch in batches:
            for i in range(batch.num_rows):
                parts = _parts(batch.column("data")[i].as_py())
                if batch.column("bucket")[i].as_py() < 0:
                    if own is not None:
                        yield from finish(ids, own, found)
                    ids, own, found = batch.column("ids")[i].values, parts, []
                else:
                    places, lengths, flat = map(_from_planes, parts)
                    found.append((np.cumsum(places), lengths, flat))
        if own is not None:
            yield from finish(ids, own, found)

    return rows.mapInArrow(tidy(run), schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, n_tokens (long) and ids (binary, little-endian unsigned 32-bit), one row for each row of `docs`.

    As tiktoken without special tokens. Null text is empty: no ids. Null and repeated document ids are harmless, an
    empty table gives an empty one, other columns of `docs` are not read, a text of any length is whole. `ranks_path` is read on the
    driver. Blocks are cut where the rows of `docs` come in the same order again if a task is repeated, as from a table.
    """
    spark, kind, ranks = docs.sparkSession, docs.schema[id_col].dataType, read_ranks(ranks_path)
    literal, for_long = rank_map(ranks), spark.sparkContext.broadcast(ranks)
    buckets = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    met = _distinct(_split(texts, pattern, buckets).repartition("key"))
    short = lambda w, known: F.when(F.length(w) <= LONG_WORD, fold_merges(w, known)).otherwise(F.array().cast("array<int>"))
    # The literal stands in the plan once; the fold's many look-ups go to it by the name of a lambda's variable.
    ids_of_words = F.transform(F.array(literal), lambda known: F.transform("words", lambda w: short(w, known)))[0]
    folded = _addressed(met.select("block", "bucket", "ids", "data", "words", ids_of_words.alias("folded")), for_long)
    whole = _put_together(folded.repartition("block").sortWithinPartitions("block", "bucket"), kind)
    return whole.select(F.col("id").alias(id_col), "n_tokens", F.col("tokens").alias("ids"))


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """`encoded` with `decoded` (binary): the pieces of its ids, concatenated. Null ids: null. An id without a piece is an error. A column `decoded` is replaced."""
    ranks = read_ranks(ranks_path)
    pieces: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    sent = encoded.sparkSession.sparkContext.broadcast(pieces)
    rest = [c for c in encoded.columns if c != "decoded"]
    schema = T.StructType([*[encoded.schema[c] for c in rest], T.StructField("decoded", T.BinaryType())])

    def run(batches):
        of = pa.array(sent.value, pa.large_binary())
        for batch in batches:
            column = batch.column(ids_col).cast(pa.large_binary())
            valid = np.asarray(column.is_valid())
            column = column.fill_null(b"")
            at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
            if (np.diff(at) % 4).any():
                raise ValueError("ids that are not 32-bit numbers")
            first = 0
            while first < len(column):
                last = max(first + 1, int(np.searchsorted(at, at[first] + 4 * OUT_IDS, "right")) - 1)
                n = int(at[last] - at[first]) // 4
                found = of.take(pa.array(np.frombuffer(column.buffers()[2], "<u4", n, int(at[first])) if n else np.zeros(0, "<u4")))
                if found.null_count:
                    raise ValueError("an id without a piece")
                ends = np.frombuffer(found.buffers()[1], np.int64, n + 1)[(at[first : last + 1] - at[first]) // 4] if n else np.zeros(last - first + 1, np.int64)
                decoded = _binaries(np.frombuffer(found.buffers()[2] or b"", np.uint8)[: ends[-1]], ends)
                if not valid[first:last].all():
                    decoded = pc.if_else(pa.array(valid[first:last]), decoded, None)
                yield pa.RecordBatch.from_arrays([*batch.slice(first, last - first).columns, decoded], names=schema.names)
                first = last

    return encoded.select(*rest).mapInArrow(tidy(run), schema)
