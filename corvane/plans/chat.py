"""A client for chat endpoints, calls of it as a durable step of a job, and what is asked: query extraction and the written answer."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane import schemas as S
from corvane.sources import storage

#: Open requests of one task, at most.
POOL = 8
#: Attempts for one request that fails, and seconds before the second; each later wait is twice as long.
ATTEMPTS, WAIT = 3, 0.2
REPLIES = "key string, reply string"


class ChatError(RuntimeError):
    """The endpoint could not be reached or gave no usable answer."""


@dataclass(frozen=True)
class ChatClient:
    base_url: str
    model: str
    api_key: str | None = None
    timeout: float = 30.0

    def chat(self, system: str, user: str, json_mode: bool = False) -> str:
        """The answer's text. In JSON mode a refusal (400 or 422) is tried again without it; anything else that goes wrong is a ChatError."""
        body = {"model": self.model, "temperature": 0, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        if json_mode:
            body["response_format"] = {"type": "json_object"}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        request = urllib.request.Request(self.base_url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                text = json.load(answer)["choices"][0]["message"]["content"]
        except urllib.error.HTTPError as e:
            if json_mode and e.code in (400, 422):
                return self.chat(system, user)
            raise ChatError(str(e)) from e
        except (OSError, ValueError, LookupError, TypeError) as e:
            raise ChatError(str(e)) from e
        if not isinstance(text, str):
            raise ChatError("the answer has no text")
        return text


_EXTRACT = "Read a student's request for a thesis and answer with one JSON object: topics (list of short strings), keywords (list of strings), degree_level (bachelor, master, phd or null), department (string or null)."
_ANSWER = "Recommend thesis supervisors in a few friendly sentences. Use the listed candidates and their listed works only; add no names, titles or facts."


def reading(reply: str | None) -> dict | None:
    """topics, keywords, degree_level and department in a model's reply; None if it has another form."""
    try:
        found = json.loads(reply or "")
    except ValueError:
        return None
    if not isinstance(found, dict):
        return None
    out = {"topics": found.get("topics", []), "keywords": found.get("keywords", []), "degree_level": found.get("degree_level"), "department": found.get("department")}
    lists = all(isinstance(out[c], list) and all(isinstance(x, str) for x in out[c]) for c in ("topics", "keywords"))
    plain = out["degree_level"] in (None, *S.DEGREE_LEVELS) and isinstance(out["department"], str | None)
    return out if lists and plain else None


def extract(client: ChatClient, query: str) -> dict | None:
    """topics, keywords, degree_level and department as the model sees them; None if it fails or its answer has another form."""
    try:
        return reading(client.chat(_EXTRACT, query, json_mode=True))
    except ChatError:
        return None


def _patient(client: ChatClient, system: str, user: str, json_mode: bool) -> str | None:
    """The reply, after some attempts if need be; None if all fail."""
    for n in range(ATTEMPTS):
        try:
            return client.chat(system, user, json_mode)
        except ChatError:
            if n + 1 < ATTEMPTS:
                time.sleep(WAIT * 2**n)
    return None


def ask_all(prompts: DataFrame, client: ChatClient, system: str, json_mode: bool = False, folder: str | None = None, at_once: int = POOL) -> DataFrame:
    """`prompts` with the column `reply` to each text in their column `prompt`; null where all attempts fail.

    The requests run in tasks, with at most `at_once` open at any time. Replies are written to `folder` (a fresh one if none is named) under a hash of model and prompt, and read from there: equal prompts are
    asked once, whatever is lost later, and a folder that is used again asks only what is new or has failed. A null prompt counts as empty.
    """
    spark = prompts.sparkSession
    folder = folder or storage.work_folder(spark, "replies")
    key = F.sha2(F.to_json(F.array(F.lit(client.base_url), F.lit(client.model), F.lit(system), F.lit(str(json_mode)), F.coalesce("prompt", F.lit("")))), 256)
    keyed = prompts.withColumn("key", key)
    known = lambda: spark.read.schema(REPLIES).parquet(folder) if storage.exists(spark, folder) else spark.createDataFrame([], REPLIES)
    todo = keyed.select("key", F.coalesce("prompt", F.lit("")).alias("prompt")).dropDuplicates(["key"]).join(known(), "key", "left_anti")
    pool = min(POOL, at_once)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(pool) as workers:
            for batch in batches:
                replies = list(workers.map(lambda p: _patient(client, system, p, json_mode), batch.column("prompt").to_pylist()))
                good = [i for i, r in enumerate(replies) if r is not None]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(good, pa.int64())), pa.array([replies[i] for i in good], pa.string())], names=["key", "reply"])

    # As many tasks as share the open requests; a wider stage would open more.
    todo.repartition(max(1, at_once // pool)).mapInArrow(ask, REPLIES).write.mode("append").parquet(folder)
    return keyed.join(known().dropDuplicates(["key"]), "key", "left").drop("key")


def extract_all(queries: DataFrame, client: ChatClient, folder: str | None = None, at_once: int = POOL) -> DataFrame:
    """`queries` (raw_query) with the column `found`: what `reading` finds in the model's reply, or null."""

    @F.arrow_udf("struct<topics:array<string>,keywords:array<string>,degree_level:string,department:string>")
    def read(replies: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("topics", pa.list_(pa.string())), ("keywords", pa.list_(pa.string())), ("degree_level", pa.string()), ("department", pa.string())])
        for column in replies:
            yield pa.array([reading(r) for r in column.to_pylist()], kind)

    asked = ask_all(queries.withColumn("prompt", F.col("raw_query")), client, _EXTRACT, True, folder, at_once)
    return asked.withColumn("found", read("reply")).drop("prompt", "reply")


def _candidate() -> Column:
    """A match as a line of the prompt."""
    or_ = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    c = F.col
    works = or_(F.array_join(F.transform("evidence", lambda e: e["title"]), "; "), "none listed")
    position = F.when(c("has_open_position"), " publications, open position, on ").otherwise(" publications, no open position, on ")
    return F.concat(F.lit("* "), c("supervisor"), F.lit(", "), or_(c("department"), "no department"), F.lit(": "), c("publication_count").cast("string"), position, or_(F.array_join("matched_topics", ", "), "n/a"), F.lit(", works: "), works)


def write_answers(matches: DataFrame, queries: DataFrame, client: ChatClient, folder: str | None = None, at_once: int = POOL) -> DataFrame:
    """query_id and answer for those of `queries` (query_id, raw_query) that have matches: the model's recommendation, null where it fails."""
    lines = matches.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", _candidate().alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    prompts = queries.join(lines, "query_id").select("query_id", F.concat(F.lit("Request: "), F.coalesce("raw_query", F.lit("")), F.lit("\n\nCandidates:\n"), F.col("lines")).alias("prompt"))
    return ask_all(prompts, client, _ANSWER, folder=folder, at_once=at_once).select("query_id", F.nullif(F.trim("reply"), F.lit("")).alias("answer"))
