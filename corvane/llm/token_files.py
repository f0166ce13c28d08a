"""Token ids of documents as Arrow stream files of equal-length sequences.

A folder holds one pair of files for each range of document ids, and `manifest`, a Parquet table that lists the
valid ones in order:

* `*.tokens.arrow`: an Arrow stream whose batches have the fixed-size-list columns `tokens` (uint16, or uint32 for over
  65,536 ids) and `mask` (bool, a bit each, false for padding) of LENGTH values a row. The documents of the range follow each other without gaps; only
  the last sequence is padded. All batches but the last have BATCH rows, so sequence i is row i % BATCH of batch
  i // BATCH, and a memory-mapped file gives it without a copy.
* `*.index.arrow`: an Arrow stream with doc_id, start (in the file's tokens) and n_tokens of each document.

Each task attempt writes files of its own name; only those of the attempts that Spark accepted get into the manifest.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LENGTH = 2048
BATCH = 64
#: Words whose ids a worker remembers at most; more are encoded anew.
CACHE_WORDS = 1_000_000
#: Texts are encoded in groups of about so many characters.
GROUP_CHARS = 1 << 20


class WordEncoder:
    """Ids of whole texts from the tokenizers library, which sees each distinct word once per group.

    The byte-level pre-tokenizer always parts a text before a space and around a newline that stand between two
    non-space characters. So a text whose white space is single spaces and newlines has the ids of its words, each taken
    with the space before it. Any other text, and any that holds one of the tokenizer's added tokens, goes to the library as a whole. A special token that
    stands in a text becomes its id, as the library has it; with `encode_special_tokens` it is encoded as any other text.
    """

    def __init__(self, path: str, encode_special_tokens: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism here
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = encode_special_tokens
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.newline = self._ids(["\n"])[0]
        whole, *parts = self._ids(["a b\nc .\n.", "a", " b", "\n", "c", " .", "\n", "."])
        self.cuts = whole == b"".join(parts)  # else texts go to the library as they are

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str], into: dict[str, bytes], before: str) -> None:
        missing = list(words.difference(into))
        into.update(zip(missing, self._ids([before + w for w in missing]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        if len(self.plain) + len(self.spaced) > CACHE_WORDS:
            self.plain, self.spaced = {}, {}
        cut: list[tuple[list[str], list[int]] | None] = []
        first: set[str] = set()
        rest: set[str] = set()
        for text in texts:
            if not self.cuts or any(a in text for a in self.added) or " ".join(text.split()) != text.replace("\n", " "):
                cut.append(None)
                continue
            words = text.replace("\n", " \n ").split(" ")
            breaks, at = [], -1
            for _ in range(text.count("\n")):
                breaks.append(at := words.index("\n", at + 1))
            rest.update(words)
            first.update([words[0], *[words[i + 1] for i in breaks]])
            cut.append((words, breaks))
        self._learn(first, self.plain, "")
        self._learn(rest, self.spaced, " ")
        out = []
        for text, own in zip(texts, cut, strict=True):
            if own is None:
                out += self._ids([text])
                continue
            words, breaks = own
            parts = list(map(self.spaced.__getitem__, words))
            parts[0] = self.plain[words[0]]
            for i in breaks:
                parts[i], parts[i + 1] = self.newline, self.plain[words[i + 1]]
            out.append(b"".join(parts))
        return out


_encoders: dict[tuple[str, bool], WordEncoder] = {}


def _encoder(path: str, encode_special_tokens: bool) -> WordEncoder:
    key = path, encode_special_tokens
    if key not in _encoders:
        _encoders[key] = WordEncoder(*key)
    return _encoders[key]


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= GROUP_CHARS:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


class _Writer:
    """Packs ids into fixed-length rows and streams them out in batches."""

    def __init__(self, sink, length: int, kind: type):
        self.length, self.kind, self.left, self.n = length, kind, [], 0
        self.schema = pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.held = 0

    def add(self, ids: np.ndarray) -> None:
        self.left.append(ids)
        self.held += len(ids)
        self.n += len(ids)
        if self.held >= BATCH * self.length:
            whole = np.concatenate(self.left)
            step = BATCH * self.length
            for at in range(0, len(whole) - step + 1, step):
                self._write(whole[at : at + step], step)
            rest = whole[len(whole) // step * step :]
            self.left, self.held = [rest], len(rest)

    def _write(self, ids: np.ndarray, n: int) -> None:
        mask = np.arange(len(ids)) < n
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(a), self.length) for a in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            ids = np.zeros(-(-self.held // self.length) * self.length, self.kind)
            ids[: self.held] = np.concatenate(self.left)
            self._write(ids, self.held)
        self.out.close()


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, length: int = LENGTH, encode_special_tokens: bool = False) -> DataFrame:
    """Encode all texts, each with `end_id` appended, into `folder` in ascending id order. Returns the manifest.

    `folder` is a URI that driver and executors reach (what pyarrow.fs opens: file, hdfs, s3, gs). Null text: the end
    id alone. A special token written in a text becomes its id, unless `encode_special_tokens`; other columns are not read. Null ids come first; rows of equal id are ordered by text. An empty table gives an empty manifest.
    The manifest: part, tokens, index (file URIs), n_docs, n_tokens, start (ids in all parts before).
    """
    spark, folder = docs.sparkSession, folder.rstrip("/")
    kind = docs.schema[id_col].dataType
    run = uuid.uuid4().hex

    def write(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"{run}-{task.partitionId():06d}-{task.taskAttemptId()}"
        encoder, index, writer, n_docs = _encoder(tokenizer_path, encode_special_tokens), None, None, 0
        kind_of_ids = np.uint16 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                token_sink = store.open_output_stream(f"{base}/{name}.tokens.arrow")
                index_sink = store.open_output_stream(f"{base}/{name}.index.arrow")
                writer = _Writer(token_sink, length, kind_of_ids)
                index_schema = pa.schema([("doc_id", batch.schema.field(0).type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                index = pa.ipc.new_stream(index_sink, index_schema)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            starts, counts = [], []
            for i, j in _groups(texts):
                for ids in encoder.encode(texts[i:j]):
                    ids = np.append(np.frombuffer(ids, "<u4").astype(kind_of_ids), kind_of_ids(end_id))
                    starts.append(writer.n)
                    counts.append(len(ids))
                    writer.add(ids)
            index.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=index_schema))
            n_docs += batch.num_rows
        if writer is not None:
            for closing in (writer, index, token_sink, index_sink):
                closing.close()
            row = {"part": [task.partitionId()], "tokens": [f"{folder}/{name}.tokens.arrow"], "index": [f"{folder}/{name}.index.arrow"], "n_docs": [n_docs], "n_tokens": [writer.n]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("tokens", pa.string()), ("index", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    order = [F.col("id"), F.xxhash64("text"), F.col("text")]
    rows = docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).alias("text")).repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    written = rows.mapInArrow(write, "part int, tokens string, index string, n_docs long, n_tokens long")
    written.write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    parts = spark.read.parquet(f"{folder.rstrip('/')}/manifest")
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    return parts.select("*", F.coalesce(before, F.lit(0)).alias("start"))


class TokenFile:
    """Random access to one pair of files. From a local file, sequences and masks are views of the mapped memory."""

    def __init__(self, tokens: str, index: str):
        self._sources = [self._open(tokens), self._open(index)]
        batches = list(pa.ipc.open_stream(self._sources[0]))
        self.index = pa.ipc.open_stream(self._sources[1]).read_all()
        self.batches = [(b.column(0).flatten().to_numpy(zero_copy_only=True), b.column(1).flatten()) for b in batches]
        self.length = batches[0].schema.field(0).type.list_size if batches else LENGTH

    @staticmethod
    def _open(uri: str):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        return pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Tokens and mask of sequence i, both views."""
        b, row = divmod(i, BATCH)
        return tuple(a[row * self.length : (row + 1) * self.length] for a in self.batches[b])

    def spans(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views that make up tokens start to start + n."""
        step = BATCH * self.length
        while n > 0:
            b, at = divmod(start, step)
            view = self.batches[b][0][at : at + n]
            yield view
            start, n = start + len(view), n - len(view)


def read_digests(manifest: DataFrame, id_type: T.DataType) -> DataFrame:
    """One row a document, read back from the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""

    def read(batches):
        for batch in batches:
            for tokens, index, base in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                file = TokenFile(tokens, index)
                for part in file.index.to_batches():
                    crcs = []
                    for start, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                        crc = 0
                        for view in file.spans(start, n):
                            crc = zlib.crc32(view.astype("<u4", copy=False), crc)
                        crcs.append(crc)
                    starts = pa.array(np.asarray(part.column(1)) + base, pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0), starts, part.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = T.StructType([T.StructField("doc_id", id_type), *[T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")]])
    files = manifest.select("tokens", "index", "start", "part")
    return files.repartitionByRange(max(1, files.count()), "part").mapInArrow(read, schema)
