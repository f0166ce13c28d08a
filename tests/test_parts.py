"""Exchangeable parts, their factories, and model calls as a durable step."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from corvane.operators.index import VectorIndex
from corvane.plans import chat, matching, parts
from corvane.plans.pipeline import Pipeline
from corvane.plans.settings import Settings


class Upper:
    """An extractor of one's own."""

    def extract(self, queries):
        return matching.parse_queries(queries).withColumn("topics", F.array(F.upper("raw_query")))


class Echo:
    def answer(self, matches, queries):
        return matches.groupBy("query_id").agg(F.concat_ws(",", F.sort_array(F.collect_list("supervisor"))).alias("answer"))


def test_parts_can_be_given(spark):
    seen = []

    class Watched(parts.CannedRetriever):
        def retrieve(self, parsed, k):
            seen.append([r.topics for r in parsed.collect()])
            return super().retrieve(parsed, k)

    pipe = Pipeline(spark, extractor=Upper(), retriever=Watched(), synthesizer=Echo())
    assert pipe.recommend("graphs", 2) == "Ada Beispiel,Ben Muster" and seen == [[["GRAPHS"]]]
    many = spark.createDataFrame([(7, "a"), (8, None)], "query_id long, raw_query string")
    assert sorted((r.query_id, r["rank"]) for r in pipe.run_all(many, 2).collect()) == [(7, 1), (7, 2), (8, 1), (8, 2)]


def test_factories(spark, tmp_path):
    plain, model = Settings(embedding_model="hash-fake", vector_store_path=str(tmp_path)), Settings(llm_base_url="http://x", llm_api_key="k")
    assert isinstance(parts.build_extractor(plain), parts.RuleExtractor) and isinstance(parts.build_synthesizer(plain), parts.TemplateSynthesizer)
    assert parts.build_extractor(model).client == chat.ChatClient("http://x", "llama3.1", "k") == parts.build_synthesizer(model).client
    store = parts.build_store(spark, plain)
    assert isinstance(store, VectorIndex) and not store.exists() and store.root == f"{tmp_path}/matchmaker"
    assert isinstance(parts.build_retriever(plain, None), parts.CannedRetriever) and parts.build_retriever(plain, store).embedder.model_name == "hash-fake"


class Counting(BaseHTTPRequestHandler):
    """Answers after a moment, and notes how many requests are open; prompts with `bad` fail, those with `once` fail the first time."""

    lock, open, most, asked = threading.Lock(), 0, 0, []

    def do_POST(self):
        user = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][1]["content"]
        with Counting.lock:
            Counting.open += 1
            Counting.most = max(Counting.most, Counting.open)
            again = user in Counting.asked
            Counting.asked.append(user)
        time.sleep(0.01)
        with Counting.lock:
            Counting.open -= 1
        fails = "bad" in user or "once" in user and not again
        self.send_response(503 if fails else 200)
        self.end_headers()
        found = {"topics": [user.upper()], "keywords": [], "degree_level": None, "department": None}
        self.wfile.write(b"" if fails else json.dumps({"choices": [{"message": {"content": json.dumps(found)}}]}).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    Counting.open, Counting.most, Counting.asked = 0, 0, []
    server = ThreadingHTTPServer(("127.0.0.1", 0), Counting)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield chat.ChatClient(f"http://127.0.0.1:{server.server_port}", "m")
    server.shutdown()


def test_a_thousand_queries_are_asked_once(spark, server, tmp_path):
    texts = [f"query {i % 900}" for i in range(1000)] + ["once more", "bad one", None]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, raw_query string").repartition(40)
    found = matching.extract_queries(queries, server, f"{tmp_path}/replies", at_once=8)
    want = {i: [t.upper()] if t and "bad" not in t else [t] if t else [""] for i, t in enumerate(texts)}
    for _ in range(2):  # a plan that runs again asks nobody
        assert {r.query_id: r.topics for r in found.collect()} == want
    assert Counting.most <= 8 and len(Counting.asked) == 900 + 2 + chat.ATTEMPTS + 1
    asked = len(Counting.asked)
    assert matching.extract_queries(queries.where("raw_query <> 'bad one'"), server, f"{tmp_path}/replies").count() == 1001 and len(Counting.asked) == asked
    matching.extract_queries(queries, server, f"{tmp_path}/replies").count()
    assert len(Counting.asked) == asked + chat.ATTEMPTS  # what failed is tried again by a later run


def test_written_answers_fall_back(spark, server):
    pipe = Pipeline(spark, Settings(llm_base_url=server.base_url), extractor=parts.RuleExtractor())
    asked = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "none")], "query_id long, raw_query string")
    matches = pipe.run_all(asked, 3).where("query_id < 3")
    got = {r.query_id: r.answer for r in pipe.synthesizer.answer(matches, asked).collect()}
    said = json.loads(got[1])["topics"][0]
    assert said.startswith("REQUEST: GOOD\n\nCANDIDATES:\n* ADA BEISPIEL, INFORMATICS: 2 PUBLICATIONS, OPEN POSITION, ON INFORMATION RETRIEVAL, WORKS: SEARCH OVER LONG DOCUMENTS; ")
    assert got[2].startswith('Based on your interest in "bad"') and got[3] == 'No suitable supervisors found for "none".'


def test_people_by_authority_id(spark):
    """Two spellings of one id are one person; one name with two ids is two; a name without an id takes the only one it has elsewhere."""
    from corvane.operators.embedding import HashEmbedder

    pub = lambda i, people: (i, "publication", f"graphs {i}", None, None, [p for p, _ in people], dict(people))
    data = [
        pub("p1", [("A. Lee", "x1"), ("Ann Lee", "x1")]), pub("p2", [("Ann Lee", "x1")]), pub("p3", [("B. Kim", "x2")]), pub("p4", [("B. Kim", "x3"), ("Cy", None)]), pub("p5", [("Cy", "")]), pub("p6", [("Lee, A.", "x1")]),
        ("t1", "thesis_posting", "graphs t1", None, "Lee, A.", [], {}), ("t2", "thesis_posting", "graphs t2", None, "B. Kim", [], {}),
    ]
    rows = spark.createDataFrame(data, "id string, source_type string, text string, department string, supervisor string, uzh_authors array<string>, author_authority_map map<string,string>")
    rows = HashEmbedder().embed(rows.withColumns({"degree_level": F.lit(None).cast("string"), "url": F.lit(None).cast("string"), "year": F.lit(None).cast("int")}), "text")
    asked = matching.parse_queries(spark.createDataFrame([(1, "graphs")], "query_id long, raw_query string"))
    found = {}
    for r in matching.match(asked, rows, HashEmbedder(), 10, by_authority=True).collect():
        found.setdefault(r.supervisor, []).append((r.publication_count, r.has_open_position, sorted(e.source_id for e in r.evidence)))
    assert sorted(found) == ["B. Kim", "Cy", "Lee, A."] and found["Lee, A."] == [(3, True, ["p1", "p2", "p6", "t1"])] and found["Cy"] == [(2, False, ["p4", "p5"])]
    assert sorted(found["B. Kim"]) == [(0, True, ["t2"]), (1, False, ["p3"]), (1, False, ["p4"])]
    plain = matching.match(asked, rows, HashEmbedder(), 10).collect()
    assert {r.supervisor: r.publication_count for r in plain} == {"A. Lee": 1, "Ann Lee": 2, "B. Kim": 2, "Cy": 2, "Lee, A.": 1}
