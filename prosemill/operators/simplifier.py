"""Pluggable simplifiers and the request pipeline: sentences, cache, answers, guards, rejoining."""

from __future__ import annotations

import json
import re
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.functions.text import serving_sentences
from prosemill.operators.guards import guarded
from prosemill.operators.runs import stub_answer


class Simplifier(ABC):
    """What a model implements. Instances are shipped to the executors, so they load lazily."""

    model_id: str = ""
    supports_audience = False
    batch_size = 8
    document = False
    prompted = False

    @abstractmethod
    def generate(self, texts: Sequence[str], audience: str) -> list[str]:
        """One raw answer for each text."""

    def answers(self, keys: DataFrame) -> DataFrame:
        """keys (model, audience, text) with answer; batches never mix audiences."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(zip(batch.column("audience").to_pylist(), batch.column("text").to_pylist(), strict=True))
                out: list[str | None] = [None] * len(rows)
                for audience in dict.fromkeys(a for a, _ in rows):
                    own = [i for i, (a, _) in enumerate(rows) if a == audience]
                    for k in range(0, len(own), self.batch_size):
                        part = own[k : k + self.batch_size]
                        got = self.generate([rows[i][1] for i in part], audience)
                        if len(got) != len(part):
                            raise ValueError("a model must give one answer for each text")
                        for i, answer in zip(part, got, strict=True):
                            out[i] = answer
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "answer"])

        return keys.select("model", "audience", "text").mapInArrow(run, "model string, audience string, text string, answer string")


class Stub(Simplifier):
    """Deterministic stand-in, in native columns: marker, guard or truncate."""

    def __init__(self, mode: str = "guard"):
        self.mode = mode
        self.model_id = f"stub-{mode}"

    def generate(self, texts, audience):
        raise NotImplementedError("the stub's answers are native columns")

    def answers(self, keys: DataFrame) -> DataFrame:
        return keys.select("model", "audience", "text", stub_answer(F.col("text"), self.mode).alias("answer"))


#: fixed values: statuses after which a service is asked again
RETRIED = (408, 425, 429, 500, 502, 503, 504)


class Busy(Exception):
    """The service wants to be asked again, after ``wait`` seconds if it says so."""

    def __init__(self, status: int, wait: float | None = None):
        super().__init__(f"status {status}")
        self.wait = wait


class JsonService:
    """A model behind HTTP: sends body(text, audience) as JSON, and reads the answer with answer()."""

    def __init__(self, url: str, body: Callable[[str, str], dict], answer: Callable[[dict], str], headers: Mapping[str, str] | None = None):
        self.url, self.body, self.answer = url, body, answer
        self.headers = {"Content-Type": "application/json", **(headers or {})}

    def __call__(self, text: str, audience: str, seconds: float) -> str:
        from urllib import error, request

        sent = request.Request(self.url, json.dumps(self.body(text, audience)).encode(), self.headers)
        try:
            with request.urlopen(sent, timeout=seconds) as got:
                return self.answer(json.load(got))
        except error.HTTPError as e:
            if e.code not in RETRIED:
                raise
            wait = e.headers.get("Retry-After", "")
            raise Busy(e.code, float(wait) if re.fullmatch(r"\d+(\.\d+)?", wait) else None) from e
        except error.URLError as e:
            raise e.reason if isinstance(e.reason, TimeoutError) else e


class Endpoint(Simplifier):
    """A model that is asked text by text: ``ask(text, audience, seconds)`` returns the answer or raises
    Busy, TimeoutError or anything else. A task has at most ``in_flight`` questions open, so the
    service sees that many for each core of the cluster; answers keep the order of the keys."""

    def __init__(self, model_id: str, ask: Callable[[str, str, float], str], in_flight: int = 8, attempts: int = 6, pause: float = 2.0, seconds: float = 60.0):
        self.model_id, self.ask, self.in_flight, self.attempts, self.pause, self.seconds = model_id, ask, in_flight, attempts, pause, seconds

    def generate(self, texts, audience):
        return [self.one(t, audience)[0] or "" for t in texts]

    def one(self, text: str, audience: str) -> tuple[str | None, str | None]:
        """The answer, or else why there is none: timeout or error. A busy service is asked again, each
        time after twice the pause unless it names one."""
        for n in range(self.attempts):
            try:
                return self.ask(text, audience, self.seconds), None
            except TimeoutError:
                return None, "timeout"
            except Busy as busy:
                if n + 1 < self.attempts:
                    time.sleep(self.pause * 2**n if busy.wait is None else busy.wait)
            except Exception:
                return None, "error"
        return None, "error"

    def answers(self, keys: DataFrame) -> DataFrame:
        """keys (model, audience, text) with answer and failure, one of them null."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with ThreadPoolExecutor(self.in_flight) as pool:
                for batch in batches:
                    got = list(pool.map(self.one, batch.column("text").to_pylist(), batch.column("audience").to_pylist()))
                    columns = [pa.array([x[i] for x in got], pa.string()) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "answer", "failure"])

        return keys.select("model", "audience", "text").mapInArrow(run, "model string, audience string, text string, answer string, failure string")


def simplify(requests: DataFrame, simplifier: Simplifier, cache: DataFrame | None = None, audience: str = "general") -> DataFrame:
    """requests (request_id, text) answered: simplified, cached, reason (the first sentence's that
    was guarded), reasons and the sentence split.

    Sentences become distinct keys (model, audience, text) before the model sees them, so a sentence
    of many requests is generated once; keys in the cache (model, audience, text, answer) aren't.
    Without an answer the original is served, and the reason is the model's failure.
    """
    rows = requests.select(
        "request_id", F.posexplode(serving_sentences(F.col("text"))).alias("pos", "text"), F.lit(simplifier.model_id).alias("model"), F.lit(audience).alias("audience")
    )
    keys = rows.select("model", "audience", "text").distinct()
    known = keys.join(cache, ["model", "audience", "text"]).select("model", "audience", "text", "answer") if cache is not None else None
    todo = keys.join(known, ["model", "audience", "text"], "left_anti") if known is not None else keys
    answers = simplifier.answers(todo).withColumn("cached", F.lit(False))
    if known is not None:
        answers = answers.unionByName(known.withColumn("cached", F.lit(True)), allowMissingColumns=True)
    judged = guarded(answers, "text", "answer", "prompted" if simplifier.prompted else "sequence", simplifier.document)
    if "failure" in answers.columns:
        failed = F.col("failure").isNotNull()
        judged = judged.withColumn("served", F.when(failed, F.col("text")).otherwise(F.col("served"))).withColumn("reason", F.coalesce("failure", "reason"))
    done = rows.join(judged.select("model", "audience", "text", "served", "reason", "cached"), ["model", "audience", "text"])
    parts = F.array_sort(F.collect_list(F.struct("pos", "served", "reason")))
    out = done.groupBy("request_id").agg(parts.alias("p"), F.bool_and("cached").alias("cached"))
    reasons = F.filter(F.transform("p", lambda x: x["reason"]), lambda r: r.isNotNull())
    return out.select(
        "request_id", F.array_join(F.transform("p", lambda x: x["served"]), " ").alias("simplified"), "cached", F.get(reasons, F.lit(0)).alias("reason"), reasons.alias("reasons"), F.size("p").alias("sentences")
    )
