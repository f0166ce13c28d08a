"""The corpus queries over the smallest tables, against plain Python."""

import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    return lambda name: {r[0]: r for r in entry.queries()[name](spark, sf_dir).collect()}


@pytest.fixture(scope="module")
def documents(sf_dir):
    table = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    return {r["doc_id"]: r for r in table}


def test_op1_token_files(run, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, start = run("op1_token_files"), 0
    assert len(got) == len(documents)
    for d in sorted(documents):
        ids = [*t.encode(documents[d]["text"] or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), crc)
        start += len(ids)


def test_op2_suffix_dedup(run, documents):
    length, got = 200, run("op2_suffix_dedup")
    data = {d: (r["text"] or "").encode() for d, r in documents.items()}
    count = Counter(hash(x[i : i + length]) for x in data.values() for i in range(len(x) - length + 1))
    assert len(got) == len(data)
    for d, x in data.items():
        flags = np.zeros(len(x) + 1, int)
        for i in range(len(x) - length + 1):
            if count[hash(x[i : i + length])] > 1:
                flags[i] += 1
                flags[i + length] -= 1
        gone = np.cumsum(flags[:-1]) > 0
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_op3_byte_bpe(run, documents):
    import tiktoken

    from corvane.llm.byte_bpe import read_ranks

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = run("op3_byte_bpe")
    assert len(got) == len(documents)
    for d, r in documents.items():
        ids = own.encode_ordinary(r["text"] or "")
        assert got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_op5_decontamination(run, documents, sf_dir, spark):
    words = lambda t: re.findall("[a-z0-9\u0080-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    own = {d: words(r["text"]) for d, r in documents.items()}
    want = set()
    for item in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist():
        w = words(item["text"])
        n = min(5, len(w))
        g = grams(w, n) if n else set()
        want |= {(d, item["item_id"]) for d, x in own.items() if g and len(g & grams(x, n)) >= 0.8 * len(g)}
    got = {(r.doc_id, r.item_id) for r in entry.queries()["op5_decontamination"](spark, sf_dir).collect()}
    assert got == want and want


RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def test_op6_url_filter(run, sf_dir):
    got = run("op6_url_filter")
    pages = pq.read_table(f"{sf_dir}/pages.parquet", columns=["page_id", "url"]).to_pylist()
    assert len(got) == len(pages)
    for p in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", p["url"] or "")
        host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert (got[p["page_id"]].host, got[p["page_id"]].path, got[p["page_id"]].rule) == (host, path, rule)
        assert got[p["page_id"]].verdict in ((RULES[rule],) if rule else ("allow", "block"))


def test_op7_quality_rules(run, documents):
    got = run("op7_quality_rules")
    assert len(got) == len(documents)
    for d, r in documents.items():
        text = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))
        assert (got[d].n_words, got[d].word_chars, got[d].n_symbols, got[d].n_dup_lines, got[d].n_repeat_words) == want
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        assert got[d].base_failed == failed and not (failed and got[d].kept)
    fine = [d for d in got if not got[d].base_failed]
    assert sum(got[d].kept for d in fine) > 0.9 * len(fine)


def test_op7_lines_against_plain(run, documents):
    """n_failed_lines, lost_chars and kept by the rules written out for one line at a time."""
    from corvane.llm import quality as Q

    got = run("op7_quality_rules")
    for d, r in documents.items():
        lost = failed = 0
        for line in (r["text"] or "").split("\n"):
            w = re.findall(r"[^\x20\x09-\x0D]+", line)
            count = lambda marks, line=line: sum(line.count(m) for m in marks)
            bare = len(w) >= Q.LONG_LINE and not count(".!?:;,")
            crowded = len(w) >= 3 and max(count("!?"), count("#*$%&|<>")) > Q.CROWDED * len(w)
            navigation = count("|>") >= Q.MIN_SEPARATORS and count("|>") > Q.NAVIGATION * len(w)
            low = re.sub("[A-Z]", lambda m: m[0].lower(), line)
            if w and (bare or crowded or navigation or any(p in low for p in Q.PHRASES)):
                failed += 1
                lost += sum(map(len, w))
        assert (got[d].n_failed_lines, got[d].lost_chars) == (failed, lost), d
        assert got[d].kept == (not got[d].base_failed and lost <= Q.MAX_LOST * got[d].word_chars)
    assert sum(r.n_failed_lines > 0 for r in got.values()) > 5


def test_op12_fingerprints(run, documents):
    from corvane.llm import fingerprint as X

    got = run("op12_fingerprints")
    assert set(got) == set(documents)
    order = sorted(documents)
    marks = dict(zip(order, X.fingerprint_all([(documents[d]["text"] or "").encode() for d in order]), strict=True))
    for d, following in zip(order, order[1:] + order[:1], strict=True):
        text, other = documents[d]["text"] or "", documents[following]["text"] or ""
        half = len(text) // 2
        changed = (text[: len(text) - half] + other[:half]).encode()
        r = got[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(changed).hexdigest(), marks[d], X.fingerprint_all([changed])[0])
        assert r.near_edited == X.likeness(marks[d], r.edited_fingerprint) and r.near_next == X.likeness(marks[d], marks[following])
        assert 0 <= r.near_next <= 1 and (r.near_next == 1 or text != other)
    apart = [d for d, f in zip(order, order[1:], strict=False) if not set((documents[d]["text"] or "").split()) & set((documents[f]["text"] or "").split())]
    assert all(got[d].near_next < 0.3 for d in apart)
    assert np.mean([got[d].near_edited for d in order]) > 0.45 > 0.1 > np.median([got[d].near_next for d in order])


def test_op8_language_id(run, documents):
    got = run("op8_language_id")
    assert len(got) == len(documents)
    tested = [d for d in documents if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(got[d].held_out == (d in set(tested)) for d in documents)
    right = sum(got[d].lang_pred == documents[d]["lang"] for d in tested)
    assert right >= 0.95 * len(tested)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_op9_sharding(run, documents):
    got = run("op9_sharding")
    assert len(got) == len(documents)
    slots, sizes = {}, Counter()
    for d, r in documents.items():
        data = (r["text"] or "").encode()
        assert (got[d].size, got[d].text_crc32, got[d].law, got[d].grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        slots.setdefault(got[d].shard, set()).add(got[d].slot)
        sizes[got[d].shard] += got[d].size
    assert set(slots) <= set(range(40)) and all(s == set(range(len(s))) for s in slots.values())
    even, longest = sum(sizes.values()) / 40, max(r.size for r in got.values())
    assert max(sizes.values()) <= even * 1.02 + longest


def test_op10_line_dedup(run, documents):
    sites = {}
    for r in documents.values():
        for line in (r["text"] or "").split("\n"):
            if line.strip(" ") and r["source"] is not None:
                sites.setdefault(line.strip(" "), set()).add(r["source"])
    bad = {line for line, own in sites.items() if len(own) >= 10}
    got = run("op10_line_dedup")
    for d, r in documents.items():
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if x.strip(" ") not in bad]
        whole = not any(x.strip(" ") for x in kept)
        kept = lines if whole else kept
        assert got[d].n_removed == len(lines) - len(kept)
        assert got[d].kept_md5 == hashlib.md5("\n".join(kept).encode()).hexdigest()
    assert bad


def test_op4_near_dedup(run, documents):
    """Against all pairs: edit similarity of words."""
    words = {d: re.findall("[a-z0-9\u0080-\U0010ffff]+", (r["text"] or "").lower()) for d, r in documents.items()}

    def close(a, b):
        limit = int(0.2 * max(len(a), len(b)) + 1e-9)
        if abs(len(a) - len(b)) > limit or sum((Counter(a) & Counter(b)).values()) < max(len(a), len(b)) - limit:
            return False
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1] <= limit

    got, ids = run("op4_near_dedup"), sorted(documents)
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if documents[a]["text"] == documents[b]["text"] or words[a] and words[b] and close(words[a], words[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {d: find(d) for d in ids}
    assert len(got) == len(ids)
    found = {d: got[d].class_id for d in ids}
    assert sum(found[d] == want[d] for d in ids) >= 0.99 * len(ids)
    assert all(want[d] == want[found[d]] for d in ids)  # no class joins what brute force parts
    assert len(set(want.values())) < len(ids)


def test_registry_is_complete():
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in entry.queries()}
    assert set(entry.oracle_sql()) <= set(entry.queries())
    json.dumps(sorted(entry.queries()))
