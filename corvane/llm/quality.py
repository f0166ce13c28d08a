"""Line-first cleaning: judge every line, remove those that fail, reject documents that lose too much text.

Lines fail by one of three kinds of rules. Punctuation: a long line without any sentence mark, or one in which marks
or symbols crowd out the words. Navigation: separators between a few words each. Boilerplate: fixed phrases of notices.
A document is rejected if it is too short or repeats itself (base rules), or if over MAX_LOST of its characters were in
removed lines.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import words as W
from corvane.llm.shared import others

MIN_WORDS = 20
#: Words in windows that count as repeated when found again.
WINDOW = 8
#: Percent of words that may lie in repeated windows.
MAX_REPEAT = 30
#: Part of the code points in words that removed lines may hold.
MAX_LOST = 0.4
#: Words of a line from which it must have a sentence mark.
LONG_LINE = 12
#: Separators a word from which a line is navigation, if it has at least MIN_SEPARATORS.
NAVIGATION = 0.3
MIN_SEPARATORS = 3
#: Marks of emphasis (! or ?) or symbols a word from which a line fails.
CROWDED = 0.5
# Phrases of notices and page furniture.
PHRASES = [
    "all rights reserved", "accept cookies", "click here", "cookie policy", "enable javascript", "forgot password", "log in to", "lorem ipsum",
    "privacy policy", "sign up for", "subscribe to our", "terms of service", "terms of use", "use of cookies",
]
_PHRASE = re.compile(b"|".join(re.escape(p.encode()) for p in PHRASES))


def _flags(chars: str) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[np.frombuffer(chars.encode("latin-1"), np.uint8)] = 1
    return table


_SYMBOL, _SENTENCE, _EMPHASIS, _SEPARATOR = _flags("#*$%&|<>"), _flags(".!?:;,"), _flags("!?"), _flags("|>")
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values[start:end] of each span; spans may be empty."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends] - total[starts]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(those that occur more than once, those that occurred earlier)."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    later[order[1:][same]] = True
    return again, later


def _judge(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each document of a slice, and its lines: `line_doc`, `line_start`, `line_end`, `line_failed`."""
    n = len(offsets) - 1
    doc_salt = W.mix(np.arange(1, n + 1, dtype=np.uint64))
    mapped, starts, ends, first = W.word_spans(data, offsets, W.NON_SPACE)
    n_words = np.diff(first)
    letter = (mapped != 0) & ((data & 0xC0) != 0x80)  # one byte of each code point in a word
    # Words in windows found twice or more.
    hashes = W.span_hashes(mapped, starts, ends)
    repeat = np.zeros(n, np.int64)
    g = W.grams(hashes, WINDOW)
    if len(g):
        doc_of_word = np.repeat(np.arange(n), n_words)
        whole = np.arange(len(g)) + WINDOW <= first[1:][doc_of_word[: len(g)]]
        at = np.flatnonzero(whole)
        again, _ = _repeated(g[at] + doc_salt[doc_of_word[at]])
        cover = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(cover, at[again], 1)
        np.add.at(cover, at[again] + WINDOW, -1)
        repeat = np.bincount(doc_of_word[np.cumsum(cover[:-1]) > 0], minlength=n)
    # Lines: the pieces between newlines of each document.
    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    doc = np.searchsorted(breaks, offsets)
    line_doc = np.repeat(np.arange(n), np.diff(doc) + 1)
    line_end = np.concatenate([line_start[1:], offsets[-1:]])
    last = np.concatenate([line_doc[1:] != line_doc[:-1], [True]]) if len(line_doc) else np.zeros(0, bool)
    line_end = np.where(last, line_end, line_end - 1)
    line_words = np.searchsorted(starts, line_end) - np.searchsorted(starts, line_start)
    solid = np.flatnonzero(line_words > 0)
    keys = W.span_hashes(data, line_start[solid], line_end[solid]) + doc_salt[line_doc[solid]]
    dup = np.bincount(line_doc[solid][_repeated(keys)[1]], minlength=n)
    # Line rules.
    count = {k: _sums(t[data], line_start, line_end) for k, t in (("symbol", _SYMBOL), ("sentence", _SENTENCE), ("emphasis", _EMPHASIS), ("separator", _SEPARATOR))}
    lower = _LOWER[data].tobytes()
    phrase = np.zeros(len(line_start), bool)
    hits = np.array([m.start() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in _PHRASE.finditer(lower, a, b)], np.int64)  # none from one text into the next
    phrase[np.searchsorted(line_start, hits, "right") - 1] = True
    w = np.maximum(line_words, 1)
    bare = (line_words >= LONG_LINE) & (count["sentence"] == 0)
    crowded = (line_words >= 3) & ((count["emphasis"] > CROWDED * w) | (count["symbol"] > CROWDED * w))
    navigation = (count["separator"] >= MIN_SEPARATORS) & (count["separator"] > NAVIGATION * w)
    failed = (line_words > 0) & (bare | crowded | navigation | phrase)
    chars = _sums(letter, line_start, line_end)
    return {
        "n_words": n_words, "word_chars": _sums(letter, offsets[:-1], offsets[1:]), "n_symbols": _sums(_SYMBOL[data], offsets[:-1], offsets[1:]),
        "n_dup_lines": dup, "n_repeat_words": repeat, "lost": np.bincount(line_doc[failed], chars[failed], minlength=n).astype(np.int64),
        "n_failed_lines": np.bincount(line_doc[failed], minlength=n),
        "line_doc": line_doc, "line_start": line_start, "line_end": line_end, "line_failed": failed,
    }


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines", "lost_chars"]


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row a document: its id, COUNTS (long), base_failed, kept (boolean), and with `with_text` cleaned_text.

    Words are runs of characters other than 0x20 and 0x09 to 0x0D. n_dup_lines counts lines with a word that equal
    an earlier line of the document; n_repeat_words counts words inside 8-word windows found more than once in it.
    Null text: no words, so base_failed; its cleaned_text is null. Repeated rows are judged alike, null ids are ids like others, and other columns
    are not read. An empty table gives an empty one.
    """
    others([], (*COUNTS, "base_failed", "kept", "cleaned_text"), (id_col,))
    text_type = [T.StructField("cleaned_text", T.StringType())] if with_text else []
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), *text_type])

    def run(batches):
        for batch in batches:
            for row, end, data, offsets in W.slices(batch.column(1)):
                j = _judge(data, offsets)
                base = (j["n_words"] < MIN_WORDS) | (100 * j["n_repeat_words"] > MAX_REPEAT * j["n_words"])
                kept = ~base & (j["lost"] <= MAX_LOST * j["word_chars"])
                columns = [batch.column(0).slice(row, end - row), *[pa.array(j[c].astype(np.int64)) for c in [*COUNTS[:-1], "lost"]], pa.array(base), pa.array(kept)]
                if with_text:
                    raw, texts = data.tobytes(), []
                    valid = batch.column(1).slice(row, end - row).is_valid().to_pylist()
                    at = np.searchsorted(j["line_doc"], np.arange(len(offsets)))
                    for d, ok in enumerate(valid):
                        own = range(at[d], at[d + 1])
                        texts.append(b"\n".join(raw[j["line_start"][i] : j["line_end"][i]] for i in own if not j["line_failed"][i]).decode() if ok else None)
                    columns.append(pa.array(texts, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), *schema.names[1:])
