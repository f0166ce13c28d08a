"""The store of layers, its commits, record files with numbered lines, and what the index makes of them."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from corvane import schemas as S
from corvane.operators import index as I
from corvane.operators import store
from corvane.operators.documents import from_postings, from_publications
from corvane.operators.embedding import HashEmbedder
from corvane.plans import catalog
from corvane.sources import jsonl, storage
from corvane.streaming.upserts import stream_records

EMBED = HashEmbedder(8)


def _pubs(spark, ids, title="Title", **fields):
    lines = [(json.dumps({"id": f"p{i}", "title": f"{title} {i}", "uzh_authors": ["Ann"], "department": "CS" if i % 2 else "Bio", **fields}),) for i in ids]
    return from_publications(jsonl.check_lines(spark.createDataFrame(lines, "value string"), "publication").where("is_valid"))


def _posts(spark, ids, level):
    lines = [(json.dumps({"id": f"t{i}", "title": f"Posting {i}", "url": "u", "degree_level": level}),) for i in ids]
    return from_postings(jsonl.check_lines(spark.createDataFrame(lines, "value string"), "thesis_posting").where("is_valid"))


@pytest.fixture
def index(spark, tmp_path):
    return I.VectorIndex(spark, str(tmp_path / "idx"), "c", buckets=8)


def _state(index):
    return sorted((r.id, r.text, r.source_type, tuple(round(x, 9) for x in r.vector)) for r in index.rows().collect())


def test_small_changes_write_files_of_their_buckets(spark, index, tmp_path):
    assert I.upsert(index, _pubs(spark, range(200)), EMBED) == I.IndexResult(200, 0, 0)
    before = {f for f in (tmp_path / "idx").rglob("*.parquet")}
    assert I.upsert(index, _pubs(spark, range(3), "New").unionByName(_pubs(spark, range(3, 20))), EMBED) == I.IndexResult(3, 17, 0)
    fresh = {f for f in (tmp_path / "idx").rglob("*.parquet")} - before
    bucket = {r.id: r.b for r in spark.createDataFrame([(f"p{i}",) for i in range(3)], "id string").select("id", F.pmod(F.xxhash64("id"), F.lit(8)).alias("b")).collect()}
    assert {f.parent.parent.name for f in fresh} == {f"bucket={b}" for b in bucket.values()} and len(fresh) <= 3
    assert I.remove(index, spark.createDataFrame([("p5",), ("p5",), ("nobody",)], "id string")) == 1
    assert I.remove(index, spark.createDataFrame([("p5",)], "id string")) == 0
    rebuilt = I.VectorIndex(spark, str(tmp_path / "again"), "c", buckets=3)
    I.upsert(rebuilt, _pubs(spark, range(3), "New").unionByName(_pubs(spark, [i for i in range(3, 200) if i != 5])), EMBED)
    want = _state(rebuilt)
    assert _state(index) == want and len(want) == 199 == index.manifest()["document_count"]
    assert sorted(r.content_hash for r in index.hashes().collect()) == sorted(r.content_hash for r in rebuilt.hashes().collect())
    assert index.compact() and not index.compact() and _state(index) == want and max(index.chains(index.manifest()).values()) == 1
    assert I.upsert(index, _pubs(spark, [5]), EMBED).embedded == 1 and len(_state(index)) == 200  # a removed document comes back


def test_long_chains_are_compacted(spark, index, monkeypatch):
    monkeypatch.setattr(store, "MAX_LAYERS", 2)
    for i in range(6):
        I.upsert(index, _pubs(spark, [1, 2], f"Round {i}"), EMBED)
    assert max(index.chains(index.manifest()).values()) <= 3 and [r.text[:7] for r in index.rows().collect()] == ["Round 5"] * 2
    folders = [n for n in storage.names(spark, index.root) if n.startswith("layer-")]
    assert len(folders) <= 2 * store.KEEP + 2 and len(storage.names(spark, f"{index.root}/manifests")) <= 2 * store.KEEP  # what no kept manifest names is gone


def test_writers_at_once_lose_nothing(spark, index, tmp_path):
    I.upsert(index, _pubs(spark, range(5)), EMBED)
    failed = []

    def write(k):
        try:
            for step in range(2):
                I.upsert(I.VectorIndex(spark, str(tmp_path / "idx"), "c"), _pubs(spark, range(100 * k + 10 * step, 100 * k + 10 * step + 10)), EMBED)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in (1, 2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    want = {f"p{i}" for i in range(5)} | {f"p{100 * k + i}" for k in (1, 2, 3) for i in range(20)}
    assert {r.id for r in index.rows().collect()} == want and index.manifest()["document_count"] == len(want)


def test_the_loser_starts_again_on_the_new_base(spark, index, tmp_path, monkeypatch):
    """Between a writer's look and its commit another changes the same document: the later commit holds, and counts are those of its base."""
    I.upsert(index, _pubs(spark, [1]), EMBED)
    other, write = I.VectorIndex(spark, str(tmp_path / "idx"), "c"), store.Store.write_layer
    raced = []

    def slow(self, rows, base):
        layer = write(self, rows, base)
        if self is index and not raced:
            raced.append(I.upsert(other, _pubs(spark, [1], "Other").unionByName(_pubs(spark, [2])), EMBED))
        return layer

    monkeypatch.setattr(store.Store, "write_layer", slow)
    assert I.upsert(index, _pubs(spark, [1]).unionByName(_pubs(spark, [3])), EMBED) == I.IndexResult(2, 0, 0)  # document 1 had become another
    assert {r.id: r.text.split()[0] for r in index.rows().collect()} == {"p1": "Title", "p2": "Title", "p3": "Title"} and index.manifest()["document_count"] == 3


def test_a_writer_that_dies_leaves_the_old_state(spark, index, monkeypatch):
    I.upsert(index, _pubs(spark, range(4)), EMBED)
    want = _state(index)
    with monkeypatch.context() as m:
        m.setattr(store.Store, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            I.upsert(index, _pubs(spark, range(9)), EMBED)
    assert _state(index) == want
    assert I.upsert(index, _pubs(spark, range(9)), EMBED).embedded == 5 and len(_state(index)) == 9


def test_create_is_by_one_writer(spark, tmp_path):
    path, won = f"{tmp_path}/m/1.json", []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if storage.create_json(spark, path, {"k": k}) else None) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and storage.read_json(spark, path) == {"k": won[0]} and storage.names(spark, f"{tmp_path}/m") == ["1.json"]


def test_query_with_filters_of_any_column(spark, index):
    I.upsert(index, _pubs(spark, range(6)).unionByName(_posts(spark, [1], "master")).unionByName(_posts(spark, [2], "phd")), EMBED)
    vector = index.rows().where("id = 't1'").first()["vector"]
    hits = index.query(vector, 5, {"source_type": "thesis_posting", "degree_level": "master"})
    assert [(r.id, r.rk, round(r.score, 6)) for r in hits.collect()] == [("t1", 1, 1.0)] and "content_hash" not in hits.columns and hits.first()["text"] == "Posting 1"
    assert {r.id for r in index.query(vector, 9, {"department": "CS"}).collect()} == {"p1", "p3", "p5"}
    assert index.query(vector, 3).count() == 3 and index.query(vector, 5, {"department": "nothing"}).count() == 0
    asked = spark.createDataFrame([(1, vector, "CS"), (2, vector, "Bio")], "query_id long, vector array<double>, want string")
    plan = store.pushed(index.rows(), asked, {"department": "want"})._jdf.queryExecution().toString()
    assert "In(department, [" in plan.split("PushedFilters")[1].split("]\n")[0] or "In(department" in plan
    typed = store.pushed(index.rows(), asked.withColumn("kind", F.lit("publication")), {"source_type": "kind"})._jdf.queryExecution().toString()
    assert "source_type" in typed.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert {(r.query_id, r.id) for r in index.search(asked, 9, {"department": "want"}).collect()} == {(1, "p1"), (1, "p3"), (1, "p5"), (2, "p0"), (2, "p2"), (2, "p4")}
    free = asked.withColumn("want", F.when(F.col("query_id") == 1, F.col("want")))
    assert index.search(free, 20, {"department": "want"}).where("query_id = 2").count() == 8


def test_lookup_reads_the_buckets_of_its_ids(spark, index, monkeypatch):
    I.upsert(index, _pubs(spark, range(300)), EMBED)
    I.upsert(index, _pubs(spark, [7], "New"), EMBED)
    ids = spark.createDataFrame([("p7",), ("p8",), ("nobody",), ("p8",)], "id string")
    found = index.lookup(ids)
    assert {r.id: r.text for r in found.collect()} == {"p7": "New 7", "p8": "Title 8"} and "vector" not in found.columns
    buckets = {f"bucket={r.b}" for r in ids.select(F.pmod(F.xxhash64("id"), F.lit(8)).alias("b")).collect()}
    plan = found._jdf.queryExecution().toString()
    assert all(f.split("/")[-3] in {*buckets} for f in found.inputFiles()) or "In(id" in plan
    assert "In(id, [" in plan.replace("In(id,[", "In(id, [")
    monkeypatch.setattr(store, "MAX_IDS", 1)
    assert {r.id: r.text for r in index.lookup(ids).collect()} == {"p7": "New 7", "p8": "Title 8"}


def _write(folder, pubs, posts=()):
    folder.mkdir(exist_ok=True)
    (folder / S.PUBLICATIONS_FILE).write_bytes(b"".join(pubs))
    (folder / S.POSTINGS_FILE).write_bytes(b"".join(posts))
    return str(folder)


def test_line_numbers_over_splits(spark, index, tmp_path):
    """A file read in many splits, with blank lines, both line ends, bad bytes and no end of line at the end: places are those of enumerate."""
    lines = []
    for i in range(3000):
        good = json.dumps({"id": f"p{i}", "title": f"Ünï {i} " + "x" * (i % 50)}).encode()
        lines.append({0: b"  ", 1: b"not json", 2: b'{"id": "1"}', 3: b'{"id": "b", "title": "\xff"}'}.get(i % 37, good) + (b"\r\n" if i % 5 == 0 else b"\n"))
    lines.append(b"[1]")
    source = _write(tmp_path / "src", lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", len(b"".join(lines)) // 20)
    try:
        assert spark.read.text(f"{source}/{S.PUBLICATIONS_FILE}").rdd.getNumPartitions() >= 20
        result = I.build(index, source, EMBED)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {}
    for n, line in enumerate(lines, 1):
        text = line.decode(errors="replace").strip()
        if text and not text.endswith('"}') or text.startswith('{"id": "1"}') or "�" in text:
            want[n] = text
    bad = index.quarantine().collect()
    assert {r.number: r.line.strip() for r in bad} == want and len(bad) == len(want) == result.invalid_lines
    assert {r.error for r in bad if "�" in r.line} == {"not UTF-8"} and all(r.file.endswith(S.PUBLICATIONS_FILE) for r in bad)
    assert result.embedded == 3000 - len(want) + 1 - sum(1 for i in range(3000) if i % 37 == 0) and result.duplicates == 0


@pytest.mark.parametrize("splits", [1, 50])
def test_the_last_line_of_an_id_holds(spark, index, tmp_path, splits):
    lines = [json.dumps({"id": f"p{i % 40}", "title": f"turn {i}", "keywords": ["k" * (i % 7)]}).encode() + b"\n" for i in range(400)]
    posts = [json.dumps({"id": "p0", "title": "posting", "url": "u"}).encode() + b"\n"]
    source = _write(tmp_path / "src", lines, posts)
    spark.conf.set("spark.sql.files.maxPartitionBytes", len(b"".join(lines)) // splits)
    try:
        assert I.build(index, source, EMBED) == I.IndexResult(40, 0, 0, 0, 361)
        assert I.build(index, source, EMBED) == I.IndexResult(0, 40, 0, 0, 361)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows = {r.id: r.text.split("\n")[0] for r in index.rows().collect()}
    assert rows == {f"p{i}": f"turn {360 + i}" for i in range(1, 40)} | {"p0": "posting"}
    assert not [n for n in storage.names(spark, index.root) if n.startswith("staged-")]


def test_a_file_twice_on_a_stream_embeds_once(spark, index, tmp_path):
    (tmp_path / "in").mkdir()
    lines = "".join(json.dumps({"id": f"p{i}", "title": f"t{i}"}) + "\n" for i in range(5))
    for name in ("a", "b"):
        (tmp_path / f"in/{name}.jsonl").write_text(lines)
        stream_records(spark, str(tmp_path / "in"), "publication", index, EMBED, str(tmp_path / "cp"), once=True).awaitTermination()


def test_texts_are_shuffled_once_a_change(spark, index, monkeypatch, sf_dir):
    """A change and a compaction deal rows out once and join nothing, and so do the records that the registered queries make."""
    plans, write = [], store.Store.write_layer

    def watched(self, rows, base):
        plans.append(rows._jdf.queryExecution().toString().partition("== Physical Plan ==")[2])
        return write(self, rows, base)

    monkeypatch.setattr(store.Store, "write_layer", watched)
    twice = _pubs(spark, range(30)).unionByName(_pubs(spark, range(20, 40)))
    assert I.upsert(index, twice, EMBED).embedded == 40
    assert I.upsert(index, _pubs(spark, range(35, 45)), EMBED) == I.IndexResult(5, 5, 0)
    assert index.compact() and index.rows().count() == 45
    assert [(p.count("Exchange hashpartitioning(bucket"), p.count("Exchange "), p.count("Join")) for p in plans] == [(1, 1, 0)] * 3
    assert "Join" not in catalog.documents_of_records(spark, sf_dir)._jdf.queryExecution().toString()
