"""Operators on hand-made rows: nulls, empty and repeated texts, ties, extra columns, empty tables."""

import hashlib
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import byte_bpe, decontaminate, fingerprint, hard_negatives, language_id, line_dedup, merkle, near_dedup, quality, sharding, suffix_dedup, token_files, url_filter
from corvane.llm.graph import components
from corvane.llm.shared import scratch

public_tokenizers = pytest.importorskip("public_tokenizers")

LONG = " ".join(f"word{i} stays" for i in range(3000))
ROWS = [(1, "A small text.\nTwo lines.", "en", "s1"), (1, "A small text.\nTwo lines.", "en", "s1"), (2, None, None, None), (None, "", "de", "s2"), (3, " \t\n ", None, "s3"), (4, LONG, "fr", None), (5, "a" * 5000, "en", "s4")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 9, "x") for r in ROWS], "doc_id long, text string, lang string, source string, id int, t string")


def test_sequences_are_views(spark, odd):
    manifest = token_files.write_tokens(odd, public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "test"), length=64)
    part = manifest.first()
    file = token_files.TokenFile(part["tokens"], part["index"])
    tokens, mask = file.sequence(0)
    assert len(tokens) == len(mask) == 64 and tokens.base is not None
    digests = token_files.read_digests(manifest, odd.schema["doc_id"].dataType).collect()
    assert len(digests) == len(ROWS) and sum(r.n_tokens for r in digests) == manifest.agg(F.sum("n_tokens")).first()[0]
    assert token_files.write_tokens(odd.limit(0), public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "test")).count() == 0


def test_suffix_dedup(odd):
    got = suffix_dedup.remove_repeats(odd, length=20, k=8).collect()
    assert len(got) == len(ROWS)
    by = {(r.doc_id, r.n_bytes): r for r in got}
    assert by[1, 24].n_removed == 24 and by[2, 0].kept == b"" and by[5, 5000].n_removed == 5000
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_suffix_dedup_spreads_a_hot_hash(spark, monkeypatch):
    """A notice of 150 bytes in 300 differing texts: no bucket gets the pieces of its hash together, and the result is that of brute force."""
    bound, largest, merge, length = 20_000, [], suffix_dedup._merge_transforms, 200
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", bound, raising=False)

    def watched(strings, *rest):
        largest.append(strings.groupBy("h").agg(F.sum(F.octet_length("data")).alias("x")).agg(F.max("x")).first()[0] or 0)
        return merge(strings, *rest)

    monkeypatch.setattr(suffix_dedup, "_merge_transforms", watched)
    rng = np.random.default_rng(4)
    some = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    notice, after = some(150), some(70)
    texts = [some(300) + notice + (after if i % 10 == 0 else "") + some(200) for i in range(300)]
    count = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            count[t[k : k + length]] = count.get(t[k : k + length], 0) + 1
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(spark.createDataFrame(enumerate(texts), "doc_id long, text string")).collect()}
    want = {}
    for i, t in enumerate(texts):
        want[i] = len({x for k in range(len(t) - length + 1) if count[t[k : k + length]] > 1 for x in range(k, k + length)})
    assert got == want and want[0] >= 220
    assert max(largest) <= bound


def test_byte_bpe(spark, odd):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    extra = odd.select("doc_id", F.concat("text", F.lit("  naïve\t\u00a0x's 漢字 \n\n 12 ")).alias("text"), F.lit(1).alias("block"), F.lit("k").alias("decoded"))
    got = byte_bpe.decode(byte_bpe.encode(extra, path, public_tokenizers.PATTERN), path).collect()
    texts = [r[1] + "  naïve\t\u00a0x's 漢字 \n\n 12 " if r[1] is not None else "" for r in ROWS]
    assert sorted(r.ids for r in got) == sorted(np.array(own.encode_ordinary(t), "<u4").tobytes() for t in texts)
    assert sorted(bytes(r.decoded) for r in got) == sorted(t.encode() for t in texts)
    assert byte_bpe.encode(odd.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_cuts_texts_faster_than_one_piece_at_a_time():
    """Cutting a block into numbered pieces and words takes less time than numbering its pieces in a dictionary alone."""
    rng = np.random.default_rng(5)
    vocabulary = np.array([bytes(rng.integers(97, 123, int(n), dtype=np.uint8)).decode() for n in rng.integers(2, 12, 150_000)])
    texts = [" ".join(vocabulary[(150_000 * rng.random(350) ** 3).astype(int)]) + "." for _ in range(2_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])

    def seconds(work) -> float:
        begin = time.thread_time()
        work()
        return time.thread_time() - begin

    def one_by_one():
        number = {}
        for t in texts:
            assert " ".join(t.split()) == t
            for piece in t.split(" "):
                number.setdefault(piece, len(number))

    ours = min(seconds(lambda: [b.words() for b in byte_bpe._blocks([batch], public_tokenizers.PATTERN)]) for _ in range(4))
    assert ours < min(seconds(one_by_one) for _ in range(4))


def test_byte_bpe_decodes_few_documents_at_once(spark):
    """A task decodes about half a million ids at once, not a whole batch; null and empty ids stay, and a document of more ids is whole."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = {rank: token for token, rank in byte_bpe.read_ranks(path).items()}
    rng = np.random.default_rng(1)
    ids = [rng.choice(sorted(pieces), int(k)).astype("<u4") if k >= 0 else None for k in [*[50_000] * 30, 0, -1, 700_000, -1, 3]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(ids))), pa.array([None if x is None else x.tobytes() for x in ids], pa.binary())], names=["doc_id", "ids"])

    class Task:
        schema = spark.createDataFrame([], "doc_id int, ids binary").schema
        columns, sparkSession = schema.names, spark

        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return list(run(iter([batch.slice(1)])))

    out = byte_bpe.decode(Task(), path)
    assert all(sum(len(x) // 4 for x in b.column("ids").to_pylist() if x) <= 1 << 19 or b.num_rows == 1 for b in out)
    got = {d: x for b in out for d, x in zip(b.column("doc_id").to_pylist(), b.column("decoded").to_pylist(), strict=True)}
    assert got == {d: None if x is None else b"".join(pieces[k] for k in x.tolist()) for d, x in enumerate(ids) if d}


def test_byte_bpe_folds_words_of_any_length(spark, monkeypatch):
    """The fold and the heap give tiktoken's ids; a word of 200,000 letters and a text of 60,000 words are encoded whole, over blocks of any size."""
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(8)
    some = lambda n: bytes(rng.choice(np.frombuffer(b"etaoinshr", np.uint8), n)).decode()
    assert all(byte_bpe.heap_merges(w, ranks) == own.encode_ordinary(w.decode()) for w in (some(n).encode() for n in range(1, 300)))
    texts = [some(200_000), " ".join(some(int(n)) for n in rng.integers(1, 12, 60_000)), some(byte_bpe.LONG_WORD), some(byte_bpe.LONG_WORD + 1), "".join(f"{x} " for x in range(5000))]
    want = [np.array(own.encode_ordinary(t), "<u4").tobytes() for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for chars in (50_000, byte_bpe.BLOCK_CHARS):
        monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", chars)
        got = {r.doc_id: r.ids for r in byte_bpe.encode(docs, path, public_tokenizers.PATTERN).collect()}
        assert [bytes(got[i]) for i in range(len(texts))] == want


def test_near_dedup(spark, odd):
    got = near_dedup.near_classes(odd).collect()
    assert len(got) == len(ROWS) and {r.class_id for r in got if r.doc_id == 1} == {1}
    words = [f"w{i}" for i in range(300)]
    near = [" ".join([*words[:k], "new", *words[k + 1 :]]) for k in range(0, 300, 10)]
    docs = spark.createDataFrame([*enumerate(near), (100, " ".join(f"v{i}" for i in range(300))), (101, None)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()} == {**dict.fromkeys(range(30), 0), 100: 100, 101: 101}
    assert {r.doc_id for r in near_dedup.keep_one(docs).collect()} == {0, 100, 101}
    assert near_dedup.near_classes(odd.limit(0)).count() == 0 == near_dedup.keep_one(odd.limit(0)).count()
    rows = [(1, "same words"), (1, "same words"), (None, "same words"), (None, "same words"), (2, "same words"), (3, None), (3, None), (None, "alone"), (None, "alone"), (4, " "), (4, "other text")]
    rows = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, _t int, text2 string")
    kept = near_dedup.keep_one(rows)
    assert kept.columns == rows.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "same words"), (3, None), (3, None), (None, "alone"), (4, " "), (4, "other text")], key=str)


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(40)] + [(1000 + int(a), 1000 + int(b)) for a, b in rng.integers(0, 100, (80, 2))] + [(5000, 5001 + i) for i in range(300)] + [(7, 7), (5000, 5001)]
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links for x in (a, b) if any(p != q and x in (p, q) for p, q in [(a, b)])}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_bands_find_scattered_changes():
    """Texts of 200 words with 20, 15 and 10 % of them changed agree in a band."""
    rng = np.random.default_rng(1)
    for share, least in ((0.2, 0.9), (0.15, 0.95), (0.1, 0.98)):
        words = np.repeat(rng.integers(1, 1 << 62, (100, 1, 200)).astype(np.uint64), 2, axis=1)
        for pair in words:
            pair[1, rng.choice(200, int(share * 200), replace=False)] = rng.integers(1, 1 << 62, int(share * 200))
        shingles = near_dedup.W.shingles(words.ravel(), np.arange(201) * 200, near_dedup.SHINGLE)
        bands = near_dedup.order_minhash(*shingles)
        assert (bands[::2] == bands[1::2]).any(axis=1).mean() >= least


def test_near_dedup_partners_in_a_template(spark):
    """600 texts share 78 % of their words, and each two neighbours 82 %: every pair is found, and nothing else."""
    template, texts = [f"t{i}" for i in range(78)], []
    for i in range(600):
        shared = [f"p{i // 2}x{j}" for j in range(4)]
        texts.append((i, " ".join([*template, *shared, *[f"o{i}x{j}" for j in range(18)]])))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()} == {i: i // 2 * 2 for i in range(600)}


def test_edit_distances_against_plain():
    rng = np.random.default_rng(0)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + int(x != y)))
            row = new
        return row[-1]

    pairs = []
    for _ in range(200):
        a = rng.integers(0, 50, rng.integers(1, 60)).astype(np.uint32)
        b = np.delete(a, rng.integers(0, len(a), rng.integers(0, 6))) if rng.random() < 0.7 else rng.integers(0, 50, rng.integers(1, 60)).astype(np.uint32)
        pairs.append((a, b.astype(np.uint32)))
    limits = [int(0.2 * max(len(a), len(b))) for a, b in pairs]
    assert near_dedup.edit_distances(pairs, limits) == [plain(a, b) <= n for (a, b), n in zip(pairs, limits, strict=True)]


def test_decontaminate(spark, odd):
    items = spark.createDataFrame([(1, "word7 stays word8 stays word9 stays"), (2, "two lines"), (3, None), (4, "not in there at all today")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(odd, items).collect()}
    assert got == {(4, 1), (1, 2)}
    assert sorted(str(r.doc_id) for r in decontaminate.drop_contaminated(odd, items).collect()) == ["2", "3", "5", "None"]
    assert decontaminate.drop_contaminated(odd.limit(0), items).count() == 0 and decontaminate.drop_contaminated(odd, items.limit(0)).count() == len(ROWS)
    assert decontaminate.contained_items(odd.limit(0), items).count() == 0 == decontaminate.contained_items(odd, items.limit(0)).count()


def test_clean_rows_of_leaky_ids_stay(spark):
    """Ids say nothing about a row: null and repeated ones keep their clean rows, with columns of any names; a text of 3 MB is searched to its end."""
    item = "a passage that the test set holds word for word"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, f"see {item} here"), (None, "clean"), (5, item), (5, "clean too"), (6, "clean as well"), (7, "filler words " * 120_000 + item), (8, "filler words " * 120_000), (None, None), (5, item), (6, "clean as well")]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, item_id int, _leaky string, containment int")
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([r for i, r in enumerate(rows) if i in (1, 3, 4, 6, 7, 9)], key=str)


def test_decontaminate_finds_every_small_item(spark):
    rng = np.random.default_rng(2)
    docs, items = [], []
    for i in range(1200):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, 400)]
        n, at = 5 + i % 3, int(rng.integers(0, 390))
        docs.append((i, " ".join(words)))
        items.append((i, " ".join(words[at : at + n])))
    found = decontaminate.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(i, i) for i in range(1200)]


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?q", "https://net", "x://example.com/de/", "http://b.org/fr/1#f", "http://b.org/frx", "http://notnet/"]
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    got = {r.page_id: r for r in url_filter.judge_urls(rows, rules).collect()}
    assert [got[i].rule for i in range(len(urls))] == [None, None, None, "example.net/en/", None, "example.com/de/", "org/fr/", None, None]
    assert got[3].host == "a.example.net" and got[3].path == "/en/x" and got[2].host == "" and all(r.verdict in ("allow", "block") for r in got.values())
    assert url_filter.judge_urls(rows.limit(0), rules).count() == 0


def test_quality_and_language(spark, odd):
    got = quality.clean_lines(odd).collect()
    assert len(got) == len(ROWS) and not any(r.kept for r in got if r.n_words < 20)
    docs = spark.createDataFrame([(i, "der und die das ist nicht ein " * 5 if i % 2 else "the and of is not a to be " * 5, "de" if i % 2 else "en") for i in range(60)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    found = {r.doc_id: r for r in language_id.predict(docs.unionByName(odd.select("doc_id", "text", "lang").where("doc_id in (2, 3)").withColumn("doc_id", F.col("doc_id") + 100)), model).collect()}
    assert found[0].lang_pred == "en" and found[1].lang_pred == "de" and found[102].lang_pred == found[103].lang_pred == "und"
    assert language_id.train(docs.limit(0)) is None and language_id.predict(docs.limit(1), None).first().lang_pred == "und"


def test_quality_does_not_depend_on_neighbours(spark):
    texts = ["please do not click", " here is a text", "click here", "", None, "a\nclick\nhere", "x sign up for"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, many = ({r.doc_id: r for r in quality.clean_lines(docs.repartition(n)).collect()} for n in (1, 50))
    assert one == many
    assert [one[i].n_failed_lines for i in range(7)] == [0, 0, 1, 0, 0, 0, 1] and one[5].cleaned_text == "a\nclick\nhere" and one[4].cleaned_text is None


def test_letters_and_rare_languages(spark):
    docs = [(i, "the and of is not a to be " * 5, "en") for i in range(400)] + [(500 + i, "der und die das ist nicht ein " * (5 + i), "de") for i in range(3)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.train(docs, max_texts=100)
    assert model.labels == ["de", "en"]
    odd = spark.createDataFrame([(1, "½ ² ① 12"), (2, "é")], "doc_id long, text string").withColumn("_found", F.lit(1))
    found = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert found[1].lang_pred == "und" and found[1].score == 0 and found[2].lang_pred in ("de", "en") and found[1]["_found"] == 1


def test_lines_with_clashing_columns(spark):
    pages = spark.createDataFrame([(i, f"own line {i}\nshared", f"s{i}", 1, 2, "k") for i in range(12)], "doc_id long, text string, source string, _bad int, n_removed int, line string")
    got = line_dedup.remove_boilerplate(pages)
    assert sorted(got.columns) == sorted([*pages.columns, "n_lines", "kept_text"]) and {(r.n_removed, r["_bad"]) for r in got.collect()} == {(1, 1)}


def test_sharding_and_lines(spark, odd):
    got = sharding.shard_by_bytes(odd, 3).collect()
    assert len(got) == len(ROWS) and {r.shard for r in got} <= {0, 1, 2}
    assert sharding.shard_by_bytes(odd.limit(0), 3).count() == 0
    same = spark.createDataFrame([(i, "same text " * 20) for i in range(300)], "doc_id long, text string")
    sizes = [r["count"] for r in sharding.shard_by_bytes(same, 3).groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 12  # one hot group is cut inside
    pages = spark.createDataFrame([(i, f"own line {i}\n shared ", f"s{i}") for i in range(12)] + [(50, " shared", "s1"), (51, None, "s1"), (52, "x", None)], "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept_text for r in line_dedup.remove_boilerplate(pages).collect()}
    assert kept[0] == "own line 0" and kept[50] == " shared" and kept[51] is None and kept[52] == "x"
    assert line_dedup.remove_boilerplate(pages.limit(0)).count() == 0


def test_components_keep_a_true_size(spark):
    """A chain takes many doublings; the size that Spark expects of the roots stays that of a table, whatever joins made them."""
    roots = components(spark.range(400).selectExpr("id a", "id + 1 b"))
    assert {(r.node, r.root) for r in roots.collect()} == {(i, 0) for i in range(401)}
    assert roots._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 63


def _digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _plain_tree(nodes):
    """(root, for each leaf the place and siblings of each level)."""
    proofs, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, o in enumerate(own):
            run, place = divmod(o, 8)
            met = nodes[run * 8 : run * 8 + 8]
            proofs[i].append((place, "".join(met[:place] + met[place + 1 :])))
        own, nodes = [o // 8 for o in own], [_digest(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
    return nodes[0], proofs


@pytest.mark.parametrize("per_part", [3, 64, 10_000])
def test_manifest_against_plain_trees(spark, monkeypatch, per_part):
    """Groups over any number of partitions, of one leaf, of 8 and 9, with a null key, repeated rows and null or repeated ids, over bounded stretches."""
    monkeypatch.setattr(merkle, "ROWS", per_part)
    monkeypatch.setattr(merkle, "BATCH", 50)
    rows = [(i, g, f"text {i}") for g, n in (("de", 1), ("en", 530), (None, 9), ("fr", 8), ("zz\u00e9", 65), ("", 2)) for i in range(n)]
    rows += [(3, "en", "text 3")] * 20 + [(None, "en", None)] * 3 + [(None, None, "")]
    docs = spark.createDataFrame(rows, "doc_id int, lang string, text string").withColumn("root_", F.lit(1)).repartition(5)
    leaf = merkle.leaf_of(F.col("doc_id"), F.col("text"))
    found = merkle.manifest(docs, leaf, keep=["text", "root_"])
    folded = found.withColumn("again", merkle.fold(F.col("leaf"), F.col("proof"))).withColumn("p", merkle.proof_digest(F.col("proof")))
    got = sorted((str(r.doc_id), str(r.lang), str(r.text), r.leaf, r.subroot, r.root, r.p, r.again) for r in folded.collect())
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for i, g, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, _digest(said(r[0]), said(r[2])))):
        groups.setdefault(g, []).append((i, t, _digest(said(i), said(t))))
    trees = {g: _plain_tree([x[2] for x in own]) for g, own in groups.items()}
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    root, tops = _plain_tree([trees[g][0] for g in order])
    want = [(str(i), str(g), str(t), h, trees[g][0], root, _digest(*[s for _, s in p + tops[order.index(g)]]), root) for g, own in groups.items() for (i, t, h), p in zip(own, trees[g][1], strict=True)]
    assert got == sorted(want)


def test_manifest_edges(spark, odd):
    leaf = merkle.leaf_of(*[F.col(c) for c in ("doc_id", "source", "lang", "text")])
    assert merkle.manifest(odd.limit(0), leaf).count() == 0
    found = merkle.manifest(odd, leaf, keep=["id", "t"]).withColumn("again", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    assert len(found) == len(ROWS) and all(r.again == r.root for r in found) and len({r.root for r in found}) == 1
    assert found[0].leaf in {_digest("1:1", "2:s1", "2:en", "24:A small text.\nTwo lines."), *[r.leaf for r in found]} and _digest("1:2", "-", "-", "-") in {r.leaf for r in found}
    forged = [r for r in merkle.manifest(odd, leaf).withColumn("again", merkle.fold(merkle.leaf_of(F.lit("x")), F.col("proof"))).collect()]
    assert all(r.again != r.root for r in forged)
    with pytest.raises(ValueError, match="one name"):
        merkle.manifest(odd.withColumn("Leaf", F.lit(1)), leaf, keep=["Leaf"])


def test_fingerprints_do_not_depend_on_how_they_are_hashed(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(97, 123, int(n), dtype=np.uint8)) for n in rng.integers(1, 4000, 60)] + [b"", b"a", b"a" * 5000, b"ab" * 3000, "naïve 漢字 ".encode() * 90]
    whole = fingerprint.fingerprint_all(texts)
    assert fingerprint.fingerprint_all(texts[::-1]) == whole[::-1] and [fingerprint.fingerprint_all([t])[0] for t in texts] == whole
    monkeypatch.setattr(fingerprint, "SLICE", 100)
    assert fingerprint.fingerprint_all(texts) == whole
    assert all(len(p) <= fingerprint.PIECES * fingerprint.SYMBOL for f in whole for p in f.split(":")[1:])
    for a in range(0, 60, 7):  # a piece's symbols depend on its own bytes only, so what is shared at an end stays
        changed = fingerprint.fingerprint_all([b"other start of it " + texts[a]])[0]
        assert len(texts[a]) < 200 or fingerprint.likeness(whole[a], changed) > 0.7


def test_likeness_against_plain():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] if x == y else 1 + min(row[j], new[-1]))
            row = new
        return row[-1]

    rng = np.random.default_rng(1)
    cut = lambda s: [s[i : i + 2] for i in range(0, len(s), 2)]
    for _ in range(100):
        a, b = ("".join(f"A{x}" for x in rng.integers(0, 9, rng.integers(1, 150))) for _ in range(2))
        got = fingerprint.likeness(f"8:{a}::", f"8:{b}::")
        assert got == (1.0 if a == b else pytest.approx(1 - plain(cut(a), cut(b)) / (len(cut(a)) + len(cut(b)))))
    assert fingerprint.likeness("4:AA:BB:CC", "16:CC:DD:EE") == 1.0 and fingerprint.likeness("4:AA:BB:CC", "32:CC:DD:EE") == 0.0
    assert fingerprint.likeness(None, "4:::") is None and fingerprint.likeness("4:::", "4:::") == 1.0 and fingerprint.likeness("4:::", "4:AA:A:A") == 0.0


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_edit_probe_against_plain(spark, odd, parts):
    """Neighbours across partitions, also empty ones; nulls, empty texts and repeated ids; one text of 3 MB."""
    rng = np.random.default_rng(parts)
    rows = [(int(i) * 3, "".join(chr(int(c)) for c in rng.integers(97, 800, int(n)))) for i, n in enumerate(rng.integers(0, 400, 90))]
    rows += [(2000, None), (2001, ""), (2002, "word " * 600_000), (None, "first"), (2001, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("part", F.lit(2)).repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.doc_id, r.fingerprint): r for r in fingerprint.edit_probe(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plain = sorted(((i, t or "") for i, t in rows if i != 2001), key=lambda r: (r[0] is not None, r[0] or 0))
    at = next(k for k, r in enumerate(plain) if r[0] == 2002)
    two = [(2001, ""), (2001, "again")]
    for middle in (two, two[::-1]):  # rows of one id follow by a hash of their texts
        ordered = plain[:at] + middle + plain[at:]
        marks = fingerprint.fingerprint_all([t.encode() for _, t in ordered])
        want = {}
        for (i, t), m, (_, f), n in zip(ordered, marks, ordered[1:] + ordered[:1], marks[1:] + marks[:1], strict=True):
            changed = t[: len(t) - len(t) // 2] + f[: len(t) // 2]
            other = fingerprint.fingerprint_all([changed.encode()])[0]
            want[i, m] = (len(t), hashlib.sha256(changed.encode()).hexdigest(), other, fingerprint.likeness(m, other), fingerprint.likeness(m, n))
        if (two[0] == middle[0]) == (got[2000, marks[at - 1]].edited_sha256 == want[2000, marks[at - 1]][1]) and {k: tuple(r)[1:3] + tuple(r)[4:] for k, r in got.items()} == want:
            break
    else:
        raise AssertionError("neither order of the two rows fits")
    assert fingerprint.edit_probe(docs.limit(0)).count() == 0
    one = fingerprint.edit_probe(docs.where("doc_id = 2000")).first()
    assert one.near_next == one.near_edited == 1.0 and one.n_chars == 0
    assert len(fingerprint.edit_probe(odd).collect()) == len(ROWS)


def _plain_negatives(rows, asks, n_positives=5, n_negatives=3):
    import math

    fine = [(k, i, [math.floor(256 * float(x)) for x in v], g) for k, (i, v, g) in enumerate(rows) if g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for k, i, v, g in fine:
        if not asks(i):
            continue
        order = sorted(((-sum(a * b for a, b in zip(v, w)), last(j), j, h, m) for m, j, w, h in fine if m != k), key=lambda r: (r[0], r[1], r[4]))  # noqa: B905
        for s, _, j, _, _ in [r for r in order if r[3] == g][:n_positives]:
            fits = [r for r in order if r[3] != g and 50 * -s <= 100 * -r[0] <= 95 * -s][:n_negatives]
            out += [(i, j, n, r[2], -s, -r[0]) for n, r in enumerate(fits, 1)]
    return sorted(out, key=str)


def test_hard_negatives_against_plain(spark, monkeypatch):
    """Ties, negative and zero scores, few positives, nulls of every kind, vectors of other lengths, repeated rows and anchors in several shares."""
    from corvane.operators import sweep

    monkeypatch.setattr(sweep, "ROWS", 40)
    rng = np.random.default_rng(13)
    rows = [(i, [float(x) / 2 for x in rng.integers(-2, 4, 3)], int(rng.integers(0, 4))) for i in range(300)]
    rows += [(400, None, 1), (401, [1.0, None, 1.0], 1), (402, [float("nan")] * 3, 1), (403, [float("inf")] * 3, 1), (404, [1.0, 1.0, 1.0], None), (None, [1.5, 1.0, 1.0], 1), (405, [], 2), (406, [1.0], 2), (410, [1.0, 1.0, 1.0], 9), rows[0], rows[0], rows[50]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("uid", F.lit(1)).withColumn("rank", F.lit("x")).repartition(4)
    for share in (10, 1000):
        monkeypatch.setattr(sweep, "SHARE", share)
        got = sorted(map(tuple, hard_negatives.hard_negatives(table, F.col("vec_id") % 10 == 0).collect()), key=str)
        assert got == _plain_negatives(rows, lambda i: i is not None and i % 10 == 0) and len(got) > 200
    assert hard_negatives.hard_negatives(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    large = spark.createDataFrame([(0, [1e5] * 64, 1), (1, [1e5] * 64, 1), (2, [9e4] * 64, 2)], "vec_id long, embedding array<double>, label int")
    at_zero = hard_negatives.hard_negatives(large, F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in at_zero] == [(0, 1, 1, 2, 64 * 256**2 * 10**10, 64 * 256**2 * 9 * 10**9)] and at_zero[0].positive_score > 1 << 53
    with pytest.raises(Exception, match="beyond 64 bits"):
        hard_negatives.hard_negatives(large.withColumn("embedding", F.transform("embedding", lambda x: x * 1e10)), F.lit(True)).collect()


def test_names_that_differ_in_case_only(spark):
    """Columns that results take the place of, whatever their case, leave a table whose columns can be named; an id column of such a name is an error."""
    docs = spark.createDataFrame([(i, f"the words of text {i} and more of them\nshared", f"s{i}", 1, 2, 3) for i in range(12)], "doc_id long, text string, source string, N_LINES int, Lang_Pred int, HOST int")
    found = line_dedup.remove_boilerplate(docs)
    assert {r.n_lines for r in found.select("n_lines").collect()} == {2} and "N_LINES" not in found.columns
    found = language_id.predict(docs, None)
    assert {r.lang_pred for r in found.select("lang_pred").collect()} == {"und"} and "Lang_Pred" not in found.columns
    found = url_filter.judge_urls(docs.withColumnRenamed("text", "url"), {"net/": "block"})
    assert {r.host for r in found.select("host").collect()} == {""} and "HOST" not in found.columns
    for run in (lambda: sharding.shard_by_bytes(docs, 2, "Size"), lambda: quality.clean_lines(docs, "n_words"), lambda: near_dedup.near_classes(docs, "CLASS_ID"), lambda: line_dedup.remove_boilerplate(docs, "N_lines")):
        with pytest.raises(ValueError, match="name of a result"):
            run()
    odd_ids = docs.withColumnRenamed("doc_id", "k1").withColumn("tie", F.lit(1)).withColumn("shard", F.lit(5))
    assert sharding.shard_by_bytes(odd_ids, 2, "k1").select("k1", "slot").count() == 12


def test_slots_over_many_runs(spark, monkeypatch):
    """A shard of many rows lies in several partitions; its slots have no gaps and no repeats, with a third of all rows equal and with null ids."""
    rows = [(i if i % 50 else None, "same" if i % 3 == 0 else f"text {i} " * (i % 9)) for i in range(3000)] + [(7, "twin")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    written, cut = [], sharding.cut
    monkeypatch.setattr(sharding, "cut", lambda df: written.append(cut(df)) or written[-1])
    try:
        got = sharding.shard_by_bytes(docs, 3).collect()
        runs = written[-1].select("shard", F.shiftright("at", 33)).distinct().groupBy("shard").count().collect()
        assert len(runs) == 3 and all(r["count"] > 1 for r in runs)  # no shard goes through one task
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows)
    for shard in range(3):
        own = sorted(r.slot for r in got if r.shard == shard)
        assert own == list(range(len(own))) and own
    sizes = [sum(r.size for r in got if r.shard == k) for k in range(3)]
    assert max(sizes) - min(sizes) <= 0.03 * sum(sizes) / 3 + 100


def test_short_texts_all_meet(spark):
    """Of pairs of short texts at 0.8 similarity and above, whatever the edits, every one has a key in common; and near_classes links exactly those of brute force."""
    rng = np.random.default_rng(21)

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            at, kind = int(rng.integers(0, len(words))), int(rng.integers(0, 3))
            if kind == 0 and len(words) > 1:
                del words[at]
            elif kind == 1:
                words.insert(at, int(rng.integers(1, 1 << 60)))
            else:
                words[at] = int(rng.integers(1, 1 << 60))
        return words

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    seen = 0
    for _ in range(4000):
        a = rng.integers(1, 1 << 60, rng.integers(1, 30)).tolist()
        b = edited(a, int(rng.integers(1, 8)))
        longer = max(len(a), len(b))
        if a != b and min(len(a), len(b)) <= near_dedup.SHORT and distance(a, b) <= near_dedup._edits(longer):
            one, other = (near_dedup.short_keys(np.array(x, np.uint64)) for x in (a, b))
            assert np.intersect1d(one, other).size, (len(a), len(b))
            seen += 1
    assert seen > 1000
    texts = []
    for _ in range(60):
        base = [f"w{x}" for x in rng.integers(0, 10**9, rng.integers(4, 14))]
        texts += [" ".join(map(str, base)), " ".join(map(str, edited(base, 1))), " ".join(map(str, edited(base, 2)))]
    texts = sorted(set(texts))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    words = [t.split() for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if abs(len(words[i]) - len(words[j])) <= 3 and distance(words[i], words[j]) <= near_dedup._edits(max(len(words[i]), len(words[j]))):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(texts))} and len(set(got.values())) < len(texts)


def test_trees_learn_from_labelled_urls(spark):
    """Labels that no rule gives: held-out URLs are judged as they are labelled, and URLs without a rule get both verdicts; a host's rate alone, made of chance, misleads no one."""
    rng = np.random.default_rng(17)
    rows = []
    for i in range(1600):
        bad = bool(rng.random() < 0.4)
        host = f"{rng.choice(['shop', 'news', 'my'])}{int(rng.integers(0, 400))}.example.{rng.choice(['com', 'org', 'io'])}"
        path = "/".join(str(rng.choice(["a", "text", "page"])) for _ in range(int(rng.integers(1, 4))))
        url = f"http://{host}/{path}/{int(rng.integers(10**11, 10**12))}?" + "&".join(f"u{k}={int(rng.integers(0, 10**6))}" for k in range(int(rng.integers(3, 7)))) if bad else f"http://{host}/{path}"
        rows.append((i, url, int(bad)))
    urls = spark.createDataFrame(rows, "page_id long, url string, label int")
    model = url_filter.UrlModel.fit(urls.where("page_id < 800"))
    found = url_filter.judge_urls(urls.where("page_id >= 800"), {"io/": "block"}, model=model).collect()
    free = [r for r in found if r.rule is None]
    right = sum((r.verdict == "block") == bool(r.label) for r in free)
    assert right >= 0.95 * len(free) and {r.verdict for r in free} == {"allow", "block"} and all(r.verdict == "block" for r in found if r.rule)
    chance = urls.withColumn("label", F.pmod(F.xxhash64("url"), F.lit(2)).cast("int"))  # nothing to learn
    blind = url_filter.UrlModel.fit(chance.where("page_id < 800")).predict(chance.where("page_id >= 800"))
    hit = blind.agg(F.avg(((F.col("p_block") >= 0.5).cast("int") == F.col("label")).cast("double"))).first()[0]
    assert 0.4 < hit < 0.6


def test_special_tokens_in_texts(spark):
    """A special token that stands in a text is what the library makes of it: its id, or other ids if it is to be encoded as text; a text of 3 MB and its neighbours too."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    added = [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()]
    assert added
    texts = ["end " + " ".join(added) + " next", *added, f"x{added[0]}y", "plain words\nand lines", f"two  spaces {added[-1]}\n", "word " * 600_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("start", F.lit(1))
    for literal in (False, True):
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = literal
        manifest = token_files.write_tokens(docs, path, scratch(spark, "test"), encode_special_tokens=literal)
        got = {r.doc_id: r.ids_crc32 for r in token_files.read_digests(manifest, docs.schema["doc_id"].dataType).collect()}
        assert got == {i: zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, x in enumerate(texts)}


def test_parities_lose_no_similar_pair(spark):
    """Pairs of texts, with repeated words, from equal to unlike: what the parities rule out is never similar, and of unlike pairs they leave few."""
    rng = np.random.default_rng(5)
    rows, pairs = [], []
    for i in range(300):
        a = rng.integers(0, 400, rng.integers(20, 400)).astype(np.uint32)
        b = a.copy()
        at = rng.choice(len(a), int(rng.choice([0.02, 0.1, 0.2, 0.25, 0.5, 1.0]) * len(a)), replace=False)
        b[at] = rng.integers(0, 400, len(at))
        b = np.delete(b, rng.integers(0, len(b), rng.integers(0, 5)))
        rows += [(f"a{i:03}".encode(), a.tobytes()), (f"b{i:03}".encode(), b.tobytes())]
        pairs.append((f"a{i:03}".encode(), f"b{i:03}".encode(), a, b))
    sequences = spark.createDataFrame(rows, "t binary, words binary")
    left = near_dedup._plausible(spark.createDataFrame([(a, b) for a, b, _, _ in pairs], "a binary, b binary"), near_dedup._parities(sequences))
    kept = {bytes(r.a) for r in left.collect()}
    similar = {a for a, _, x, y in pairs if near_dedup.edit_distances([(x, y)], [near_dedup._edits(max(len(x), len(y)))])[0]}
    assert similar <= kept and len(similar) > 50 and len(kept) < 250


def _joined_rows(spark, key, since):
    """The most rows that an inner join by `key` alone has made in the session's SQL executions from number `since` on."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    seq = lambda s: [s.apply(i) for i in range(s.size())]
    for e in (x for x in seq(store.executionsList()) if x.executionId() >= since):
        values = store.executionMetrics(e.executionId())
        for node in seq(store.planGraph(e.executionId()).allNodes()):
            if re.search(rf"Join \[{key}#\d+L?\], \[{key}#\d+L?\], Inner", node.desc()):
                for m in seq(node.metrics()):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_near_dedup_pairs_of_a_hot_group_meet_about_once(spark):
    """A template without links and loose copies of one text: the classes are those of all pairs, and the join on rare words makes few more rows than there are pairs."""
    rng = np.random.default_rng(29)
    template, base = [f"t{i}" for i in range(70)], [f"b{i}" for i in range(100)]
    texts = [[*template, *(f"pool{x}" for x in rng.choice(60, 30, replace=False))] for _ in range(150)]
    for i in range(100):
        gone = set(rng.choice(100, 11, replace=False).tolist())
        texts.append([f"new{i}x{j}" if j in gone else w for j, w in enumerate(base)])
    numbers = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    pairs = [(i, j) for i in range(250) for j in range(i)]
    good = near_dedup.edit_distances([tuple(np.array([numbers[w] for w in texts[k]], np.uint32) for k in p) for p in pairs], [20] * len(pairs))
    root = list(range(250))
    for (i, j), linked in zip(pairs, good, strict=True):
        if linked and root[i] != root[j]:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    assert 100 < len(set(root)) < 250
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()} == dict(enumerate(root))
    assert 0 < _joined_rows(spark, "w", since) <= 2 * 150 * 149 // 2


def test_near_dedup_leaves_no_shuffles(spark):
    """Each job's shuffle files are gone when the classes are there, and so are the tables made on the way; the session's setting is as before."""
    tracker, shared = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker(), Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    shuffles = lambda: set(filter(None, tracker.shuffleStatuses().keys().mkString(",").split(",")))
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*words[:i], f"x{i}", *words[i + 1 :]])) for i in range(30)], "doc_id long, text string")
    before, files, setting = shuffles(), set(shared.iterdir()), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    classes = near_dedup.near_classes(docs)
    assert not shuffles() - before
    assert sum(f.stat().st_size for d in set(shared.iterdir()) - files for f in d.rglob("*.parquet")) < 200_000 and not [d for d in set(shared.iterdir()) - files if d.name.startswith("corvane-near")]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting
    assert {r.class_id for r in classes.collect()} == {0} == {r.class_id for r in classes.collect()}


def test_near_dedup_long_texts_of_common_words_do_not_meet(spark):
    """60 texts of 1,500 words share a passage and, out of order, half of all words, and one is a copy of another with 285 words changed: that pair is found, and hardly any of the other 1,770 is left to be compared."""
    rng = np.random.default_rng(41)
    texts = [[*(f"p{i}" for i in range(500)), *(f"v{x}" for x in rng.integers(0, 3000, 1000))] for _ in range(60)]
    gone = set(rng.choice(1500, 285, replace=False).tolist())
    texts.append([f"new{i}" if i in gone else w for i, w in enumerate(texts[7])])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()} == {**{i: i for i in range(60)}, 60: 7}
    assert _joined_rows(spark, "w", since) <= 60


def test_near_dedup_looks_up_each_parts_bigrams_alone(spark):
    """Many parts' shares of a bucket, with few bigrams each: what the parts have in common is found without going through the whole bucket for each of them."""
    parts, size = 6_000, 50
    bigrams = np.arange(parts * size // 2, dtype=np.uint64).reshape(-1, size) + np.uint64(100)  # each is in two parts
    mine = np.arange(size, dtype=np.uint64)  # bigrams of one root in two parts, and of two roots in one
    one, two = np.full(size, 1, np.uint64), np.full(size, 2, np.uint64)
    rows = [(i, 0, bigrams[i // 2].tobytes() + np.full(size, i + 10, np.uint64).tobytes()) for i in range(parts)]
    rows += [(parts, 0, mine.tobytes() + one.tobytes()), (parts + 1, 0, mine.tobytes() + one.tobytes())]
    rows += [(parts + 2, 0, np.repeat(mine + np.uint64(1 << 40), 2).tobytes() + np.ravel([one, two], "F").tobytes())]
    table = spark.createDataFrame(rows, "part long, bucket int, data binary").coalesce(1).localCheckpoint()
    began = time.time()
    found = {r.part: np.frombuffer(r.data, np.uint64).reshape(2, -1) for r in near_dedup._shared_bigrams(table).collect()}
    took = time.time() - began
    assert set(found) == {*range(parts), parts + 2}
    assert all((found[i][0] == bigrams[i // 2]).all() and (found[i][1] == 2).all() for i in range(parts))
    assert (found[parts + 2][0] == mine + np.uint64(1 << 40)).all() and (found[parts + 2][1] == 2).all()
    assert took < 15  # with a sort of the whole bucket for each part this test took 98 s in all, with one lookup a part 18 s
