"""Records, index, matching and command line on small hand-made data."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from corvane import __main__ as cli
from corvane import schemas as S
from corvane.functions import text as X
from corvane.operators import embedding
from corvane.operators import index as I
from corvane.operators.embedding import HashEmbedder, build_embedder, token_vector
from corvane.operators.knn import top_k
from corvane.plans import chat, matching
from corvane.plans.pipeline import Pipeline, show_matches
from corvane.plans.settings import Settings, get_settings
from corvane.sources import jsonl
from corvane.streaming.upserts import stream_records

PUBS = [
    {"id": "p1", "title": "Graph search", "abstract": "Walking graphs", "uzh_authors": ["Ann", "Bob"], "department": "CS", "keywords": ["graphs"], "year": 2020},
    {"id": "p2", "title": "Protein folding", "uzh_authors": ["Cy"], "department": "Bio", "year": 0, "url": ""},
    {"id": "p3", "title": "Graph search outside", "uzh_authors": []},
]
POSTS = [{"id": "t1", "title": "Search in graphs", "url": "u", "supervisor": "Dee", "department": "CS", "degree_level": "master", "keywords": ["graphs", "search"]}, {"id": "t2", "title": "Graphs", "url": "u"}]
EMBED = HashEmbedder()


@pytest.fixture
def sources(tmp_path):
    def write(pubs=PUBS, posts=POSTS, extra=""):
        (tmp_path / "src").mkdir(exist_ok=True)
        for name, rows in ((S.PUBLICATIONS_FILE, pubs), (S.POSTINGS_FILE, posts)):
            (tmp_path / "src" / name).unlink(missing_ok=True)
            if rows is not None:
                (tmp_path / "src" / name).write_text("\n".join(map(json.dumps, rows)) + "\n\n" + (extra if name == S.PUBLICATIONS_FILE else ""))
        return str(tmp_path / "src")

    return write


@pytest.fixture
def index(spark, tmp_path):
    return I.VectorIndex(spark, str(tmp_path / "idx"), "c")


def test_index_runs(spark, index, sources):
    assert I.build(index, sources(), EMBED) == I.IndexResult(5, 0, 0, 0)
    assert I.build(index, sources(), EMBED) == I.IndexResult(0, 5, 0, 0)
    changed = [{**PUBS[0], "abstract": "New"}, *PUBS[1:]]
    assert I.build(index, sources(changed), EMBED) == I.IndexResult(1, 4, 0, 0)
    assert I.build(index, sources(changed[:2]), EMBED) == I.IndexResult(0, 4, 1, 0)
    assert I.build(index, sources(changed[:2], extra='{"id": 3}\nnot json\n{"title": "x"}\n'), EMBED) == I.IndexResult(0, 4, 0, 3)
    assert I.build(index, sources(changed[:2], None), EMBED) == I.IndexResult(0, 2, 2, 0)  # a missing file empties its part
    assert index.rows().count() == 2 == index.manifest()["document_count"]
    with pytest.raises(I.ModelMismatchError):
        other = HashEmbedder()
        other.model_name = "another"
        I.build(index, sources(), other)
    assert I.build(index, sources(), other, rebuild=True).embedded == 5


def test_empty_and_vanished_sources(spark, index, sources, tmp_path):
    (tmp_path / "none").mkdir()
    assert I.build(index, str(tmp_path / "none"), EMBED) == I.IndexResult(0, 0, 0, 0)
    assert index.exists() and index.rows().count() == 0 == index.manifest()["document_count"]
    assert I.build(index, sources(), EMBED).embedded == 5
    assert I.build(index, str(tmp_path / "none"), EMBED) == I.IndexResult(0, 0, 5, 0)
    assert index.rows().count() == 0 and "source_type" in index.rows().columns
    assert I.build(index, sources(), EMBED).embedded == 5


def test_two_collections_in_one_folder(spark, sources, tmp_path):
    one, two = (I.VectorIndex(spark, str(tmp_path / "shared"), name) for name in ("one", "two"))
    I.build(one, sources(), EMBED)
    assert not two.exists() and two.rows() is None
    I.build(two, sources(PUBS[:1], None), EMBED)
    assert (one.rows().count(), two.rows().count()) == (5, 1)
    two.drop()
    assert one.rows().count() == 5 and not two.exists()


def test_hash_ignores_what_the_index_does_not_hold(spark):
    from corvane.operators.documents import from_publications

    def hashes(**change):
        lines = spark.createDataFrame([(json.dumps({**PUBS[0], **change}),)], "value string")
        return from_publications(jsonl.check_lines(lines, "publication")).first()["content_hash"]

    assert hashes() == hashes(doi="10/x", language="eng", id="other") != hashes(year=2021)


def test_upsert_remove_and_stream(spark, index, sources, tmp_path):
    I.build(index, sources(), EMBED)
    from corvane.operators.documents import from_publications

    lines = spark.createDataFrame([(json.dumps({**PUBS[1], "title": "New title"}),), (json.dumps({"id": "p9", "title": "Nine"}),)], "value string")
    I.upsert(index, from_publications(jsonl.check_lines(lines, "publication").where("is_valid")), EMBED)
    assert index.rows().count() == 6
    assert index.rows().where("id = 'p2'").first()["text"] == "New title"
    I.remove(index, spark.createDataFrame([("p9",), ("nobody",)], "id string"), EMBED)
    assert {r.id for r in index.rows().select("id").collect()} == {"p1", "p2", "p3", "t1", "t2"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text(json.dumps({"id": "p7", "title": "Seven"}) + "\nbad\n")
    stream_records(spark, str(tmp_path / "in"), "publication", index, EMBED, str(tmp_path / "cp"), once=True).awaitTermination()
    assert index.rows().count() == 6


CASES = [
    {}, {"extra": 1}, {"title": 5}, {"title": ""}, {"authors": None}, {"authors": [None]}, {"author_authority_map": {"a": None}}, {"author_authority_map": {"a": 1}}, {"year": "2024"},
    {"year": " 2024 "}, {"year": "2024.0"}, {"year": 2024.0}, {"year": True}, {"year": 2024.5}, {"year": "x"}, {"id": None}, {"keywords": "a"}, {"abstract": None}, {"year": None},
]


def test_validator_agrees_with_pydantic():
    pydantic = pytest.importorskip("pydantic")
    o = str | None
    fields = {"id": (str, ...), "title": (str, ...), "year": (int | None, None), "authors": (list[str], []), "uzh_authors": (list[str], []), "keywords": (list[str], []), "author_authority_map": (dict[str, o], {})}
    model = pydantic.create_model("P", **fields, **{c: (o, None) for c in ("abstract", "department", "language", "publication_type", "doi", "url")})
    lines = [json.dumps({"id": "1", "title": "t", **c}) for c in CASES]
    lines += ['{"id": "1"}', "[1]", "{'id': 'a', 'title': 'b'}", '{"id": "1", "title": "t"} x', '{"id": "1", "title": "t", "year": NaN}', '{"id": "1", "title": "a", "title": "b"}', "null", "{"]
    for line in lines:
        try:
            want = model.model_validate_json(line)
        except pydantic.ValidationError:
            want = None
        try:
            got = jsonl.check_line(line, S.PUBLICATION, S.REQUIRED["publication"])
        except ValueError:
            got = None
        assert (want is None) == (got is None), line
        if want:
            assert (want.title, want.year, want.keywords) == (got["title"], got["year"], got["keywords"])


def test_posting_fields():
    check = lambda **k: jsonl.check_line(json.dumps({"id": "1", "title": "t", "url": "u", **k}), S.POSTING, S.REQUIRED["thesis_posting"])
    assert check(scraped_at="2024-01-02T03:04:05Z")["scraped_at"].year == 2024
    assert check(scraped_at="2024-01-02")["scraped_at"].day == 2 and check(scraped_at=0)["scraped_at"].year == 1970
    for bad in ({"degree_level": "Master"}, {"scraped_at": "yesterday"}, {"url": None}):
        with pytest.raises(ValueError, match="degree_level|scraped_at|url"):
            check(**bad)


@pytest.mark.parametrize(
    ("query", "topics", "level"),
    [
        ("Master thesis on graphs and search", ["on graphs", "search"], "master"), ("undergraduate thesis: AI", ["undergraduate  : ai"], "master"), ("AI, ML", ["AI, ML"], None), ("", [""], None),
        ("PhD in protein synthesis and folding", ["phd in protein syn", "folding"], "phd"), ("BSc on x and deep nets", ["bsc on x", "deep nets"], "bachelor"), (None, [""], None),
    ],
)
def test_parse(spark, query, topics, level):
    row = matching.parse_queries(spark.createDataFrame([(1, query)], "query_id long, raw_query string")).first()
    assert (row.topics, row.degree_level, row.keywords, row.department) == (topics, level, [], None)


def test_embedder(spark):
    rows = spark.createDataFrame([("Graph graph search",), ("graph",), ("...",), (None,)], "text string")
    got = [np.array(r.vector) for r in EMBED.embed(rows, "text").collect()]
    want = 2 * token_vector("graph", 64) + token_vector("search", 64)
    assert np.allclose(got[0], want / np.linalg.norm(want)) and len(got[1]) == 64
    assert not got[2].any() and not got[3].any()
    assert build_embedder("hash-fake").model_name == "hash-fake"
    with pytest.raises(RuntimeError):
        build_embedder("some/model").embed(rows, "text")


def test_top_k_edges(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id long, vector array<double>")
    rows = spark.createDataFrame([("b", "x", [2.0, 0.0]), ("a", "x", [1.0, 0.0]), ("c", "y", [0.0, 1.0]), ("d", "y", None)], "id string, source_type string, vector array<double>")
    got = {(r.query_id, r.source_type, r.rk): (r.id, r.score) for r in top_k(queries, rows, 5).collect()}
    assert got[1, "x", 1] == ("a", 1.0) and got[1, "x", 2] == ("b", 1.0) and got[1, "y", 1] == ("c", 0.0)
    assert got[2, "x", 1] == ("a", 0.0) and got[3, "y", 2] == ("d", 0.0) and len(got) == 12
    assert top_k(queries.limit(0), rows, 5).count() == 0 == top_k(queries, rows.limit(0), 5).count()
    with pytest.raises(ValueError, match="positive"):
        top_k(queries, rows, 0)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = rng.integers(-2, 3, (2_500, 3)).astype(float)  # many ties, some zero vectors; more rows than are scored at once
    rows = [(i, "xy"[i % 2], v.tolist(), "abc"[i % 3], "mn"[i % 5 % 2]) for i, v in enumerate(vectors)]
    asked = [(q, rng.normal(size=3).tolist(), [None, "", "a", "c"][q % 4], [None, "m"][q % 2]) for q in range(8)]
    found = top_k(
        spark.createDataFrame(asked, "query_id long, vector array<double>, department string, level string"),
        spark.createDataFrame(rows, "id long, source_type string, vector array<double>, department string, level string").repartition(3), 7, equal={"department": "department", "level:x": "level"},
    )
    got = {(r.query_id, r.source_type, r.rk): (r.id, round(r.score, 6)) for r in found.collect()}
    want = {}
    for q, v, department, level in asked:
        for g in "xy":
            fits = [r for r in rows if r[1] == g and (not department or r[3] == department) and (not level or g != "x" or r[4] == level)]
            score = lambda w: round(float(np.dot(v, w) / ((np.linalg.norm(v) * np.linalg.norm(w)) or 1)), 9)  # noqa: B023, E731
            best = sorted((-score(np.array(r[2])), r[0]) for r in fits)[:7]
            want |= {(q, g, k): (i, round(-s, 6)) for k, (s, i) in enumerate(best, 1)}
    assert got == want


def test_match_and_answer(spark, index, sources):
    I.build(index, sources(), EMBED)
    pipe = Pipeline(spark, Settings(embedding_model="hash-fake"), index)
    got = {r.supervisor: r for r in pipe.run("graphs and search").collect()}
    assert set(got) == {"Ann", "Bob", "Cy", "Dee"}  # neither p3 nor t2 has people
    assert got["Dee"]["rank"] == 1 and got["Dee"].has_open_position and got["Dee"].publication_count == 0
    assert got["Ann"].evidence == got["Bob"].evidence and got["Ann"]["rank"] < got["Bob"]["rank"]
    assert got["Cy"].evidence[0].url is None and got["Cy"].evidence[0].year is None and got["Ann"].evidence[0].title == "Graph search"
    phd = {r.supervisor for r in pipe.run("phd on graphs").collect()}
    assert phd == {"Ann", "Bob", "Cy"}
    parsed = pipe.queries(["graphs", "folding"]).selectExpr("query_id", "raw_query", "topics", "keywords", "degree_level", "'Bio' as department")
    assert {(r.query_id, r.supervisor) for r in matching.match(parsed, index.rows(), EMBED).collect()} == {(1, "Cy"), (2, "Cy")}
    answer = pipe.recommend("graphs and search")
    assert answer.startswith('Based on your interest in "graphs and search", here are the top matches:\n\n1. Dee (CS)\n   Works on graphs, search; 0 related publications; has an open thesis position.\n   - Search in graphs (u)\n\n2. Ann')
    assert show_matches(pipe.run("graphs and search")).startswith("#1 Dee: score ")
    empty = matching.render_answers(matching.canned(spark, 0), spark.createDataFrame([(1, "q")], "query_id long, raw_query string"))
    assert empty.first().answer == 'No suitable supervisors found for "q".'
    assert Pipeline(spark).run("x", 2).count() == 2


class Stub(BaseHTTPRequestHandler):
    replies: list = []
    seen: list = []

    def do_POST(self):
        Stub.seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
        status, body = Stub.replies.pop(0)
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def endpoint():
    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Stub.replies, Stub.seen = [], []
    yield chat.ChatClient(f"http://127.0.0.1:{server.server_port}/", "m", "key")
    server.shutdown()


def _reply(text):
    return 200, json.dumps({"choices": [{"message": {"content": text}}]})


def test_chat(spark, endpoint):
    good = json.dumps({"topics": ["a"], "keywords": ["b"], "degree_level": "phd", "department": "CS"})
    Stub.replies = [(400, ""), _reply(good), _reply("no json"), (500, ""), _reply(json.dumps({"topics": "a"})), (200, '{"choices": null}'), _reply(good)]
    assert chat.extract(endpoint, "q")["department"] == "CS"
    assert "response_format" in Stub.seen[0] and "response_format" not in Stub.seen[1]
    assert [chat.extract(endpoint, "q") for _ in range(4)] == [None] * 4
    row = matching.extract_queries(spark.createDataFrame([(1, "thesis on x")], "query_id long, raw_query string"), endpoint).first()
    assert (row.topics, row.keywords, row.degree_level, row.department) == (["a"], ["b"], "phd", "CS")
    Stub.replies, before = [_reply(good)], len(Stub.seen)
    kept = matching.extract_queries(spark.createDataFrame([(1, "thesis on y")], "query_id long, raw_query string"), endpoint)
    rows = spark.createDataFrame([("t", "thesis_posting", "a b", [0.5] * 64, "CS", "phd", "Dee", None, None, None)], "id string, source_type string, text string, vector array<double>, department string, degree_level string, supervisor string, uzh_authors array<string>, url string, year int")
    assert [r.matched_topics for r in matching.match(kept, rows, EMBED).collect()] == [["a"]] and len(Stub.seen) == before + 1  # asked once
    Stub.replies = [_reply(good), _reply(" Take Ada. "), *[(503, "")] * 2 * chat.ATTEMPTS]  # the query is extracted first, as it is with an index
    pipe = Pipeline(spark, Settings(llm_base_url=endpoint.base_url))
    assert pipe.recommend("q") == "Take Ada."
    assert pipe.recommend("q").startswith("Based on")


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("LLM_MODEL=x\nCOLLECTION_NAME=from_file\nOTHER=1\n")
    monkeypatch.setenv("COLLECTION_NAME", "from_env")
    s = get_settings(str(tmp_path / ".env"))
    assert (s.llm_model, s.collection_name, s.embedding_model) == ("x", "from_env", "BAAI/bge-m3")


def test_command_line(spark, sources, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("EMBEDDING_MODEL", "hash-fake")
    monkeypatch.setenv("VECTOR_STORE_PATH", str(tmp_path / "cli"))
    cli.main(["match", "graphs"])
    assert "no index yet" in capsys.readouterr().out
    cli.main(["index", "--source", sources()])
    assert "embedded=5 skipped=0 deleted=0 invalid_lines=0" in capsys.readouterr().out
    cli.main(["match", "graphs", "--top-k", "2"])
    out = capsys.readouterr().out
    assert out.count(": score ") == 2 and "Based on" in out
    cli.main([])
    assert f"index: {tmp_path / 'cli'}" in capsys.readouterr().out


def test_expressions(spark):
    rows = spark.createDataFrame([("a\r\nb", "i"), ("", "i"), (None, "i")], "text string, id string")
    from pyspark.sql import functions as F

    assert [r[0] for r in rows.select(X.first_line(F.col("text"), F.col("id"))).collect()] == ["a", "i", "i"]


def test_top_k_of_many_queries(spark, monkeypatch):
    """More queries than are sent to the rows: they meet in dealt parts, with the rows and ranks of brute force; string ids, ties and null groups included."""
    from corvane.operators import sweep

    monkeypatch.setattr(sweep, "FEW", 5)
    monkeypatch.setattr(sweep, "SHARE", 40)
    rng = np.random.default_rng(9)
    vectors, asked = rng.integers(-2, 3, (300, 3)).astype(float), rng.integers(-2, 3, (130, 3)).astype(float)
    rows = spark.createDataFrame([(f"r{i:03}", ["x", "y", None][i % 3], v.tolist()) for i, v in enumerate(vectors)], "id string, kind string, vector array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id int, vector array<double>")
    found = top_k(queries, rows, 4, group="kind")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # no branch for each block of queries
    got = {(r.query_id, r.kind, r.rk): r.id for r in found.collect()}
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1), 1e-30)[:, None]
    score = np.round(unit(asked) @ unit(vectors).T, 9)
    want = {(q, g, k): f"r{i:03}" for q in range(130) for n, g in enumerate(["x", "y", None]) for k, i in enumerate(sorted(range(n, 300, 3), key=lambda i: (-score[q, i], i))[:4], 1)}
    assert got == want


def test_hash_embedder_holds_few_tokens_at_once(spark, monkeypatch):
    """Texts cut anywhere have the vectors of whole ones, and what a task remembers is bounded, whatever the number of different tokens."""
    rows = [(i, " ".join(f"w{j % (7 * i + 1)}" for j in range(13 * i))) for i in range(12)] + [(12, None), (13, ""), (14, "a " * 50)]
    texts = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    want = {r.id: r.vector for r in embedding.HashEmbedder().embed(texts, "text").collect()}
    for i, text in rows:
        own = sum((embedding.token_vector(t, 64) for t in (text or "").split()), np.zeros(64))
        assert want[i] == pytest.approx((own / (np.linalg.norm(own) or 1)).tolist(), abs=1e-12)
    monkeypatch.setattr(embedding, "PIECE", 17)
    assert {r.id: r.vector for r in embedding.HashEmbedder().embed(texts, "text").collect()} == want
    monkeypatch.setattr(embedding, "CACHE_TOKENS", 20)
    known = {}
    found = embedding._token_vectors([f"t{i}" for i in range(50)], 64, known)
    assert len(known) <= 20 and (found[49] == embedding.token_vector("t49", 64)).all() and (found[0] == embedding.token_vector("t0", 64)).all()
