"""Columns that a model fills: one partition-level operator with caps on calls, lists of prompts, failover and failed rows."""

from __future__ import annotations

import json
import queue
import time
from collections import deque
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Semaphore, Thread

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import payload

#: What a provider is: made once a task; takes a prompt and an alias, and answers with a JSON text. What it makes may
#: have a method ``many`` (prompts, alias) that answers lists, for all aliases or those of ``takes_lists``; the provider
#: may have ``limits``, calls in flight an alias.
Provider = Callable[[], Callable[[str, str], str]]
#: Rows whose answers are waited for together, and how many such groups a task has under way.
GROUP, AHEAD = 256, 4
#: What an answer is told with.
USE = {"calls": "int", "failed_calls": "int", "input_tokens": "long", "output_tokens": "long", "seconds": "double"}


class Answer(str):
    """A model's text, with the tokens that it took where they are known."""

    input_tokens: int | None
    output_tokens: int | None

    def __new__(cls, text: str, input_tokens: int | None = None, output_tokens: int | None = None):
        made = super().__new__(cls, text)
        made.input_tokens, made.output_tokens = input_tokens, output_tokens
        return made


@dataclass(frozen=True)
class Lists:
    """How prompts are gathered for a provider that takes lists: so many at most, and no longer than so many seconds."""

    most: int = 32
    wait: float = 0.05


@dataclass
class Reply:
    answer: str | None = None
    error: str | None = None
    use: dict[str, float] = field(default_factory=lambda: dict.fromkeys(USE, 0))

    def took(self, seconds: float, failed: bool = False) -> None:
        self.use["calls"] += 1
        self.use["failed_calls"] += failed
        self.use["seconds"] += seconds

    def has(self, answer: str) -> None:
        self.answer, self.error = answer, None
        for k in ("input_tokens", "output_tokens"):
            self.use[k] += getattr(answer, k, None) or 0


def echo_provider() -> Callable[[str, str], str]:
    """The offline default: answers with what the prompt carries after its last ``ANSWER:``, else ``{}``."""
    return lambda prompt, alias: prompt.rpartition("ANSWER:")[2].strip() if "ANSWER:" in prompt else "{}"


class Asker:
    """A task's calls: a semaphore an alias, threads for as many calls as these allow, and lists that fill up across rows."""

    def __init__(self, call: Callable[[str, str], str], pool: Sequence[str], slots: Mapping[str, int], lists: Lists = Lists()):
        self.call, self.pool, self.lists = call, list(pool), lists
        self.gates = {a: Semaphore(slots[a]) for a in self.pool}
        self.workers = ThreadPoolExecutor(max(1, sum(slots[a] for a in set(self.pool))))
        self.many = getattr(call, "many", None)
        self.waiting: queue.Queue = queue.Queue()
        self.gatherer = Thread(target=self._gather, daemon=True) if self.many else None
        if self.gatherer:
            self.gatherer.start()

    def ask(self, prompt: str, first: int = 0) -> Future[Reply]:
        """The reply to a prompt, whose first alias is number ``first`` of the pool."""
        if not self.pool:
            done: Future = Future()
            done.set_result(Reply(error="the pool is empty"))
            return done
        if not self.many or not getattr(self.call, "takes_lists", lambda alias: True)(self.pool[first % len(self.pool)]):
            return self.workers.submit(self.one, prompt, first, Reply())
        made: Future = Future()
        self.waiting.put((prompt, first % len(self.pool), made))
        return made

    def one(self, prompt: str, first: int, reply: Reply) -> Reply:
        """Asks the aliases in turn; the last error if all fail."""
        for k in range(len(self.pool)):
            alias = self.pool[(first + k) % len(self.pool)]
            with self.gates[alias]:
                began = time.monotonic()
                try:
                    answer = self.call(prompt, alias)
                    reply.took(time.monotonic() - began)
                    reply.has(answer)
                    return reply
                except Exception as e:
                    reply.took(time.monotonic() - began, True)
                    reply.error = f"{type(e).__name__}: {e}"
        return reply

    def _gather(self) -> None:
        held: dict[int, list] = {}
        due: dict[int, float] = {}

        def send(first: int) -> None:
            due.pop(first)
            self.workers.submit(self._together, held.pop(first), first)

        while True:
            try:
                item = self.waiting.get(timeout=max(0.0, min(due.values()) - time.monotonic()) if due else None)
            except queue.Empty:
                now = time.monotonic()
                for first in [f for f, at in due.items() if at <= now]:
                    send(first)
                continue
            if item is None:
                for first in list(held):
                    send(first)
                return
            prompt, first, made = item
            held.setdefault(first, []).append((prompt, made))
            due.setdefault(first, time.monotonic() + self.lists.wait)
            if len(held[first]) >= self.lists.most:
                send(first)

    def _together(self, items: list, first: int) -> None:
        """One call for a list; what it leaves out, or all if it fails, is asked one by one."""
        alias, replies = self.pool[first], [Reply() for _ in items]
        with self.gates[alias]:
            began = time.monotonic()
            try:
                got = list(self.many([p for p, _ in items], alias))
                if len(got) != len(items):
                    raise ValueError(f"{len(got)} answers to {len(items)} prompts")
                replies[0].took(time.monotonic() - began)
            except Exception:
                got = [None] * len(items)
                replies[0].took(time.monotonic() - began, True)
        for (prompt, made), reply, answer in zip(items, replies, got, strict=True):
            if answer is not None:
                reply.has(answer)
                made.set_result(reply)
            else:
                self.workers.submit(self._settle, made, prompt, first, reply)

    def _settle(self, made: Future, prompt: str, first: int, reply: Reply) -> None:
        try:
            made.set_result(self.one(prompt, first, reply))
        except BaseException as e:
            made.set_exception(e)

    def close(self) -> None:
        if self.gatherer:
            self.waiting.put(None)
            self.gatherer.join()
        self.workers.shutdown(wait=False, cancel_futures=True)


def dispatch(call: Callable[[str, str], str], prompt: str, pool: Sequence[str], first: int) -> tuple[str | None, str | None]:
    """Asks the aliases of a pool in turn, from ``first`` on; the last error if all fail."""
    asker = Asker(call, pool, dict.fromkeys(pool, 1), Lists(1, 0))
    try:
        reply = asker.ask(prompt, first).result()
    finally:
        asker.close()
    return reply.answer, reply.error


def slots(df: DataFrame, pool: Sequence[str], limits: Mapping[str, int], threads: int) -> tuple[DataFrame, dict[str, int]]:
    """``df`` in so few partitions, with so many calls a task and alias, that no alias has more in flight than its limit.

    Tasks times slots never exceed a limit, however many tasks run at once; without a
    limit a task has ``threads``. Partitions are coalesced, never exchanged. (A cluster
    that runs copies of slow tasks speculatively asks for those again.)
    """
    capped = {a: max(1, limits[a]) for a in pool if limits.get(a)}
    if not capped:
        return df, dict.fromkeys(pool, threads)
    tasks = max(1, min([*capped.values(), df.sparkSession.sparkContext.defaultParallelism]))
    return df.coalesce(tasks), {a: capped[a] // tasks if a in capped else threads for a in pool}


def answers(df: DataFrame, prompt: str, provider: Provider = echo_provider, pool: Sequence[str] = ("default",), threads: int = 8, limits: Mapping[str, int] | None = None, lists: Lists = Lists()) -> DataFrame:
    """The columns of ``df`` but the prompt, then ``answer``, ``error`` and the columns of ``USE``.

    ``prompt`` is a string column, or an array of strings (chunks): then answers are an
    array, chunk i begins at alias i of the pool, and one failed chunk fails the row. A
    null prompt has a null answer. ``limits`` (or the provider's own) are calls in
    flight an alias, over the whole cluster. A provider that takes lists gets up to
    ``lists.most`` prompts at once, gathered over rows and chunks. A recomputed task
    asks again: give few columns and write the result before it is used twice.
    """
    many = isinstance(df.schema[prompt].dataType, T.ArrayType)
    raw = T.ArrayType(T.StringType()) if many else T.StringType()
    kept = [f for f in df.schema.fields if f.name != prompt]
    use = [T.StructField(k, T._parse_datatype_string(v)) for k, v in USE.items()]
    schema = T.StructType([*kept, T.StructField("answer", raw), T.StructField("error", T.StringType()), *use])
    spread, calls = slots(df, pool, limits if limits is not None else getattr(provider, "limits", None) or {}, threads)

    def settled(part: pa.RecordBatch, futures: list[list[Future]]) -> pa.RecordBatch:
        replies = [[f.result() for f in row] for row in futures]
        wrong = [next((r.error for r in row if r.answer is None), None) for row in replies]
        told = [None if e is not None or not many and not row else [r.answer for r in row] if many else row[0].answer for e, row in zip(wrong, replies, strict=True)]
        sums = [[sum(r.use[k] for r in row) for row in replies] for k in USE]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
        made = [pa.array(told, pa.list_(pa.string()) if many else pa.string()), pa.array(wrong, pa.string()), *(pa.array(s, k) for s, k in zip(sums, kinds, strict=True))]
        return pa.RecordBatch.from_arrays([*part.columns[1:], *made], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asker = Asker(provider(), pool, calls, lists)
        under_way: deque = deque()
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, GROUP):
                    part = batch.slice(at, GROUP)
                    asked = [[] if p is None else [asker.ask(x, k) for k, x in enumerate(p if many else [p])] for p in part.column(0).to_pylist()]
                    under_way.append((part, asked))
                    if len(under_way) > AHEAD:
                        yield settled(*under_way.popleft())
            while under_way:
                yield settled(*under_way.popleft())
        finally:
            asker.close()

    return spread.select(F.col(f"`{prompt}`"), *(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, schema)


def parsed(answer: str, kind: T.DataType, many: bool) -> F.Column:
    """An answer, or each of several, as ``kind``: null where it isn't of that shape, each field for itself."""
    read = (lambda a: payload.read(a, kind)) if not isinstance(kind, T.StringType) else (lambda a: a)
    return F.transform(answer, read) if many else read(F.col(answer))


def model_column(df: DataFrame, prompt: str, output: str, kind: T.DataType, provider: Provider = echo_provider, pool: Sequence[str] = ("default",), threads: int = 8, when: str | None = None) -> DataFrame:
    """Adds ``output`` (``kind``) and ``output_error`` to ``df``: ``answers`` beside all other columns.

    Rows with ``when`` false, or a null prompt, never reach the model.
    """
    many = isinstance(df.schema[prompt].dataType, T.ArrayType)
    todo = F.col(prompt).isNotNull() if when is None else F.col(prompt).isNotNull() & F.coalesce(F.col(when), F.lit(False))
    # columns by number, so that none is called like one of ours
    numbers = [f"_{i}" for i in range(len(df.columns))]
    asked = df.filter(todo).toDF(*numbers).withColumn("_asked", F.col(numbers[df.columns.index(prompt)]))
    kept = [F.col(k).alias(c) for k, c in zip(numbers, df.columns, strict=True)]
    done = answers(asked, "_asked", provider, pool, threads).select(*kept, parsed("answer", kind, many).alias(output), F.col("error").alias(f"{output}_error"))
    rest = df.filter(~todo).withColumns({f"{output}_error": F.lit(None).cast("string"), output: F.lit(None).cast(done.schema[output].dataType)})
    return done.unionByName(rest)


def failures(df: DataFrame, output: str, step: str, record_id: str = schemas.RECORD_ID) -> DataFrame:
    """record_id, step, reason of rows whose model call failed."""
    return df.filter(F.col(f"{output}_error").isNotNull()).select(F.col(record_id).alias("record_id"), F.lit(step).alias("step"), F.col(f"{output}_error").alias("reason"))


def missing_records(before: DataFrame, after: DataFrame, step: str, record_id: str = schemas.RECORD_ID) -> DataFrame:
    """Failed records for input ids that a step's output lacks.

    All are lost if the output has no ids; nothing can be told if the input has none.
    """
    if record_id not in before.columns:
        return before.limit(0).select(*(F.lit(None).cast("string").alias(c) for c in ("record_id", "step", "reason")))
    if record_id not in after.columns:
        return before.select(F.col(record_id).alias("record_id"), F.lit(step).alias("step"), F.lit("the output has no record ids").alias("reason"))
    lost = before.select(record_id).join(after.select(record_id), record_id, "left_anti")
    return lost.select(F.col(record_id).alias("record_id"), F.lit(step).alias("step"), F.lit("missing from the output").alias("reason"))


def json_answer(value: object) -> str:
    return json.dumps(value)
