"""Calls to external services: retry policy, clients with a deterministic stub, tagging."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import markdown as md

# Waits before a retry, in seconds, and the attempts at the second service.
RATE_WAITS, SERVER_WAITS = (5, 10, 20), (3, 6, 12)
FAILOVER_ATTEMPTS, FAILOVER_WAIT = 3, 2
RETURN, RETRY, FAILOVER, RAISE, OVER = "return", "retry", "failover", "raise", "over"


def kind_of(outcome: str | None) -> str:
    """ok, rate, server, refused (access or redirection), client, or lost for whatever is no status."""
    code = int(outcome) if outcome and outcome.isascii() and outcome.isdigit() else None
    if code is None:
        return "lost"
    if 200 <= code < 300:
        return "ok"
    return "rate" if code == 429 else "server" if code >= 500 else "refused" if code in (401, 403) or 300 <= code < 400 else "client"


@dataclass
class Policy:
    """What follows each outcome of one call: ``after`` gives (service, action, wait).

    At the first service a rate limit or a server error opens a chain of three retries. A chain
    goes on while the same kind comes back (after a server error also while the connection is lost)
    and leads to the second service when it is used up or another status comes; in a chain of
    rate limits a lost connection is raised. Without a chain refusals and lost connections lead to the
    second service, other client errors are raised. The second service is tried three times, two
    seconds apart, whatever its error. After a return or a raise the call is over.
    """

    service: int = 1
    chain: str | None = None
    tries: int = 0
    over: bool = False

    def after(self, outcome: str | None) -> tuple[int, str, int]:
        at = self.service
        if self.over:
            return at, OVER, 0
        action, wait = self._next(kind_of(outcome))
        self.over = action in (RETURN, RAISE)
        if action == FAILOVER:
            self.service, self.tries = 2, 0
        return at, action, wait

    def _next(self, kind: str) -> tuple[str, int]:
        if kind == "ok":
            return RETURN, 0
        self.tries += 1
        if self.service == 2:
            return (RETRY, FAILOVER_WAIT) if self.tries < FAILOVER_ATTEMPTS else (RAISE, 0)
        if self.chain is None:
            if kind not in ("rate", "server"):
                return (RAISE if kind == "client" else FAILOVER), 0
            self.chain = kind
        elif self.chain == "rate" and kind == "lost":
            return RAISE, 0
        goes_on = kind == self.chain or self.chain == "server" and kind == "lost"
        waits = RATE_WAITS if self.chain == "rate" else SERVER_WAITS
        return (RETRY, waits[self.tries - 1]) if goes_on and self.tries <= len(waits) else (FAILOVER, 0)


def decide(outcomes: list[str | None]) -> list[tuple[int, str, int]]:
    """(service, action, wait) after each outcome of one call, in order of attempts."""
    policy = Policy()
    return [policy.after(o) for o in outcomes]


def decisions(calls: DataFrame) -> DataFrame:
    """(call_id, attempt, outcome, service, action, wait) of every distinct attempt: ``Policy`` as window expressions.

    Rows repeated for an attempt count once (the smallest outcome, null last).
    """
    one = calls.groupBy("call_id", "attempt").agg(F.min("outcome").alias("outcome"))
    code = F.when(F.col("outcome").rlike(r"^[0-9]+$"), F.col("outcome").try_cast("int"))
    kind = (
        F.when(code.isNull(), "lost").when(code.between(200, 299), "ok").when(code == 429, "rate").when(code >= 500, "server")
        .when(code.isin(401, 403) | code.between(300, 399), "refused").otherwise("client")
    )
    every, r = Window.partitionBy("call_id"), F.col("r")
    w = one.withColumn("k", kind).withColumn("r", F.row_number().over(every.orderBy("attempt")))
    # the first service ends at attempt e1 with kind k1, the second one at attempt e2
    w = w.withColumn("k0", F.max(F.when(r == 1, F.col("k"))).over(every))
    goes_on = (F.col("k") == F.col("k0")) | ((F.col("k0") == "server") & (F.col("k") == "lost"))
    last = F.lit(len(RATE_WAITS) + 1)
    broken = F.coalesce(F.min(F.when((r > 1) & ~goes_on, r)).over(every), last)
    w = w.withColumn("e1", F.when(F.col("k0").isin("rate", "server"), F.least(broken, last)).otherwise(1))
    w = w.withColumn("k1", F.max(F.when(r == F.col("e1"), F.col("k"))).over(every))
    raised = F.when(F.col("e1") == 1, F.col("k1") == "client").otherwise((F.col("k0") == "rate") & (F.col("k1") == "lost"))
    end = F.when(F.col("k1") == "ok", RETURN).when(raised, RAISE).otherwise(FAILOVER)
    second = r - F.col("e1")
    found = F.min(F.when((r > F.col("e1")) & (F.col("k") == "ok"), second)).over(every)
    e2 = F.least(F.coalesce(found, F.lit(FAILOVER_ATTEMPTS)), F.lit(FAILOVER_ATTEMPTS))
    w = w.withColumn("end", end).withColumn("e2", e2)
    ended = F.when(F.col("k") == "ok", RETURN).otherwise(RAISE)
    action = (
        F.when(r < F.col("e1"), RETRY).when(r == F.col("e1"), F.col("end")).when(F.col("end") != FAILOVER, OVER)
        .when(second < F.col("e2"), RETRY).when(second == F.col("e2"), ended).otherwise(OVER)
    )
    first_wait = F.when(F.col("k0") == "rate", F.lit(RATE_WAITS[0])).otherwise(F.lit(SERVER_WAITS[0])) * F.pow(F.lit(2), r - 1)
    wait = F.when(r < F.col("e1"), first_wait.cast("int")).when((F.col("end") == FAILOVER) & (r > F.col("e1")) & (second < F.col("e2")), FAILOVER_WAIT).otherwise(0)
    service = F.when((r > F.col("e1")) & (F.col("end") == FAILOVER), 2).otherwise(1)
    return w.select("call_id", "attempt", "outcome", service.alias("service"), action.alias("action"), wait.alias("wait"))


class Client(Protocol):
    """An external service; raises to fail."""

    def complete(self, system: str, user: str) -> str: ...


class StatusError(Exception):
    """A service answered with a status that is no success."""

    def __init__(self, status: int):
        super().__init__(str(status))
        self.status = status


class ResilientClient:
    """A client over two services that follows ``Policy``; errors other than ``StatusError`` are lost connections."""

    def __init__(self, first: Client, second: Client, sleep: Callable[[float], None] = time.sleep):
        self.services, self.sleep = (first, second), sleep

    def complete(self, system: str, user: str) -> str:
        policy = Policy()
        while True:
            try:
                return self.services[policy.service - 1].complete(system, user)
            except Exception as e:  # noqa: BLE001
                _, action, wait = policy.after(str(e.status) if isinstance(e, StatusError) else None)
                if action == RAISE:
                    raise
                self.sleep(wait)


class StubClient:
    """Answers by a fixed rule: the bold terms of the input as tags, else a digest of it."""

    def complete(self, system: str, user: str) -> str:
        import re

        terms = re.findall(r"\*\*([^*\n]+)\*\*", user)
        return "、".join(f"# {t}" for t in terms[:8]) if terms else hashlib.sha1(user.encode()).hexdigest()[:8]


def call_service(df: DataFrame, key: str, text: str, client: Callable[[], Client], system: str = "") -> DataFrame:
    """(key, answer, error) for every row; a client for each task, one failure doesn't fail the task."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        service = client()
        for b in batches:
            answers, errors = [], []
            for t in b.column(1).to_pylist():
                try:
                    answers.append(service.complete(system, t or ""))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    answers.append(None)
                    errors.append(str(e)[:100])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=["key", "answer", "error"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("t")).mapInArrow(run, f"key {kind}, answer string, error string")


FAILED_REPORT = "(research failed)"


def finished(df: DataFrame, key: str, text: str, client: Callable[[], Client]) -> DataFrame:
    """(key, final, error): draft, research and final text, three chained calls for each row in one task.

    A failed research step leaves a fixed report and goes on; a failed draft or final step
    leaves the row without a final text.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        service = client()

        def one(t: str) -> str:
            draft = service.complete("draft", t)
            try:
                report = service.complete("research", draft)
            except Exception:  # noqa: BLE001
                report = FAILED_REPORT
            return service.complete("final", f"## draft\n{draft}\n\n## report\n{report}\n")

        for b in batches:
            finals, errors = [], []
            for t in b.column(1).to_pylist():
                try:
                    finals.append(one(t or ""))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    finals.append(None)
                    errors.append(str(e)[:100])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(finals, pa.string()), pa.array(errors, pa.string())], names=["key", "final", "error"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("t")).mapInArrow(run, f"key {kind}, final string, error string")


def tagged(notes: DataFrame, client: Callable[[], Client] = StubClient) -> DataFrame:
    """(id, tags): the service's tags, cleaned; where it fails, the bold terms of the summary. One scan."""
    kind = notes.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        service = client()
        for b in batches:
            answers = []
            for t in b.column(1).to_pylist():
                try:
                    answers.append(service.complete("", t or ""))
                except Exception:  # noqa: BLE001
                    answers.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(answers, pa.string()), b.column(2)], names=["id", "answer", "own"])

    rows = notes.select("id", "summary_markdown", md.tags_from_bold(F.coalesce("summary_markdown", F.lit(""))).alias("own"))
    return rows.mapInArrow(run, f"id {kind}, answer string, own string").select("id", F.coalesce(md.tags_clean(F.col("answer")), "own").alias("tags"))


def joined_segments(df: DataFrame, key: Column, order: Column, text: Column, sep: str = "\n\n") -> DataFrame:
    """(key, text): the surviving (not null) segments in order.

    The text of a key is one value, so it is gathered whole; a key's segments must fit into one row.
    """
    parts = df.select(key.alias("key"), F.struct(order.alias("o"), text.alias("t")).alias("s")).where("s.t IS NOT NULL")
    return parts.groupBy("key").agg(F.sort_array(F.collect_list("s")).alias("s")).select("key", F.array_join("s.t", sep).alias("text"))
