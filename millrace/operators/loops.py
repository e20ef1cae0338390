"""Cycles: feedback, retries and unfolding.

Spark plans have no cycles. Where an element's way round the loop depends on itself alone, the loop
runs inside the task that holds the element, which scales with the input; only where an element becomes
many (unfolds, feedback_each) are elements first dealt to all tasks. Where the way round is a DataFrame
function or SQL, a driver loop runs it to its fixpoint over a shrinking frontier whose lineage is cut in
every round.
"""

from __future__ import annotations

import queue
import threading
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.checkpoints import cut, put

_BATCH = 4096

#: Types of few bytes, of which a batch may hold four times as many rows.
_SMALL = {"boolean", "tinyint", "byte", "smallint", "short", "int", "integer", "bigint", "long", "float", "double", "date"}

#: Steps of unfold_sql in a round.
_UNROLLED = 32


#: Session setting: seconds after which a call of a retried flow has failed, where no timeout_s is given.
RETRY_TIMEOUT = "spark.millrace.retry.timeout"


def _retry_timeout(df: DataFrame, timeout_s: float | None) -> float | None:
    if timeout_s is not None:
        return timeout_s
    held = df.sparkSession.conf.get(RETRY_TIMEOUT, None)
    return float(held) if held else None


def _within(call: Callable[[Any], Any], seconds: float | None) -> Callable[[Any], Any]:
    """The call, failing with TimeoutError when it takes longer; a call that hangs stays behind in a daemon thread."""
    if seconds is None:
        return call

    def timed(x: Any) -> Any:
        answer: queue.SimpleQueue = queue.SimpleQueue()

        def run() -> None:
            try:
                answer.put((True, call(x)))
            except BaseException as e:  # noqa: BLE001 - raised again where it is awaited
                answer.put((False, e))

        threading.Thread(target=run, daemon=True).start()
        try:
            good, got = answer.get(timeout=seconds)
        except queue.Empty:
            raise TimeoutError(f"no answer within {seconds} s") from None
        if good:
            return got
        raise got

    return timed


def _frames(rows: Iterable[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= _BATCH:
            yield pd.DataFrame(held, columns=names, dtype=object)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names, dtype=object)


def _spread(df: DataFrame) -> DataFrame:
    """df dealt evenly to all tasks: elements that become many rows each may lie in one small file, which is one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def unfold_flow_with(seeds: DataFrame, seed: str, step: Callable[[Any], tuple[Any, Any] | None], element_type: str, max_steps: int = 1_000_000, timeout_s: float | None = None) -> DataFrame:
    """(seed, step, element) of state -> (next state, element), until None; lazy within a batch.

    A chain of more than max_steps fails, and so does a step that takes longer than timeout_s. Null seeds give no rows.
    """
    step = _within(step, timeout_s)

    def chain(state: Any) -> Iterator[Any]:
        while (got := step(state)) is not None:
            state = got[0]
            yield got[1]

    return _unfolded(seeds, seed, chain, element_type, max_steps)


def unfold_flow(seeds: DataFrame, seed: str, flow: Callable[[Any], tuple[Any, Any]], element_type: str, max_steps: int = 1_000_000, timeout_s: float | None = None) -> DataFrame:
    """As unfold_flow_with, but the flow ends the chain by raising StopIteration; its value, if any, is a last element."""
    flow = _within(flow, timeout_s)

    def chain(state: Any) -> Iterator[Any]:
        while True:
            try:
                got = flow(state)
            except StopIteration as end:
                if end.value is not None:
                    yield end.value
                return
            if got is None:
                return
            state = got[0]
            yield got[1]

    return _unfolded(seeds, seed, chain, element_type, max_steps)


def _unfolded(seeds: DataFrame, seed: str, chain: Callable[[Any], Iterator[Any]], element_type: str, max_steps: int) -> DataFrame:
    """(seed, step, element) of the elements of chain(seed); seeds are dealt to all tasks, columns built for a batch at once."""
    kind = dict(seeds.dtypes)[seed]
    size = 4 * _BATCH if {kind, element_type.lower()} <= _SMALL else _BATCH

    def frame(firsts: pd.Series, runs: list[tuple[int, int, int]], elements: list[Any]) -> pd.DataFrame:
        at, begin, count = np.array(runs, dtype=np.int64).T
        steps = np.arange(len(elements)) + np.repeat(begin - np.cumsum(count) + count, count)
        repeated = firsts.take(np.repeat(at, count)).reset_index(drop=True)
        return pd.DataFrame({"seed": repeated, "step": steps, "element": pd.Series(elements, dtype=object)}, copy=False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            firsts = batch[seed].dropna()
            runs: list[tuple[int, int, int]] = []  # place of the seed, first step, number of elements
            elements: list[Any] = []
            for at, first in enumerate(firsts.tolist()):
                rest, n = chain(first), 0
                while True:
                    held, room = len(elements), min(size - len(elements), max_steps + 1 - n)
                    elements.extend(islice(rest, room))
                    got = len(elements) - held
                    if n + got > max_steps:
                        raise RuntimeError(f"no end after {max_steps} steps from {first!r}")
                    if got:
                        runs.append((at, n + 1, got))
                        n += got
                    if len(elements) >= size:
                        yield frame(firsts, runs, elements)
                        runs, elements = [], []
                    if got < room:
                        break
            if elements:
                yield frame(firsts, runs, elements)

    return _spread(seeds.select(seed).where(F.col(seed).isNotNull())).mapInPandas(run, f"seed {kind}, step long, element {element_type}")


def unfold_sql(seeds: DataFrame, seed: str, next_state: str, goes_on: str, max_steps: int = 1000) -> DataFrame:
    """(seed, step, element): elements while ``goes_on`` holds of ``state``; SQL expressions, also of ``seed`` and ``step``.

    A driver loop goes on by _UNROLLED steps a round, each evaluated once. A round's chains are a table in the shared
    folder, which gives the elements and the next round, so neither levels nor rows pile up in one plan or executor as
    in a recursive query (that fails beyond spark.sql.cteRecursionRowLimit). A chain of more than max_steps fails.
    """
    spark, kind = seeds.sparkSession, dict(seeds.dtypes)[seed]
    frontier = _spread(seeds.select(F.col(seed).alias("seed"), F.lit(1).cast("long").alias("step"), F.col(seed).alias("state")).where("seed IS NOT NULL"))
    rounds: list[str] = []
    while True:
        chains = _unrolled(frontier, next_state, goes_on, kind)
        rounds.append(put(chains))
        done = spark.read.schema(chains.schema).parquet(rounds[-1])
        open_chains, longest = done.agg(F.count_if("going"), F.max(F.col("step") + F.col("n") - 1)).first()
        if longest is not None and longest > max_steps:
            raise RuntimeError(f"no end after {max_steps} steps")
        if not open_chains:
            break
        frontier = done.where("going").selectExpr("seed", f"step + {_UNROLLED}L AS step", "state")
    return spark.read.schema(done.schema).parquet(*rounds).select("seed", "step", F.posexplode("elements").alias("pos", "element")).selectExpr("seed", "step + pos AS step", "element")


def _unrolled(frontier: DataFrame, next_state: str, goes_on: str, kind: str) -> DataFrame:
    """_UNROLLED steps of each (seed, step, state): its elements, their number, and the state behind them where the chain is ``going`` on.

    Two projections a step, so that no expression is copied into those that use its value, each resolved before the next.
    """
    plan, held = frontier.selectExpr("seed", "step", "state", "true AS going", "0 AS n"), []
    for i in range(_UNROLLED):
        plan = plan.selectExpr("seed", "step", "state", *held, "n", f"going AND coalesce(({goes_on}), false) AS going")
        plan = plan.selectExpr("seed", "step + 1L AS step", *held, f"state AS _{i}", "n + int(going) AS n", "going", f"CASE WHEN going THEN CAST(({next_state}) AS {kind}) END AS state")
        held.append(f"_{i}")
    return plan.selectExpr("seed", f"step - {_UNROLLED}L AS step", "n", "going", "state", f"slice(array({', '.join(held)}), 1, n) AS elements")


def feedback_loop(df: DataFrame, forward: Callable[[DataFrame], tuple[DataFrame, DataFrame]], max_iterations: int = 100, feedback_buffer_size: int | None = None) -> DataFrame:
    """All outputs of a forward flow whose second output comes back as input, with ``iteration``.

    Ends when nothing comes back; more than max_iterations rounds or more than feedback_buffer_size rows
    in a round fail. forward must give df's columns on its second output.
    """
    outs, frontier, i = [], df, 0
    while True:
        out, back = forward(frontier)
        outs.append(out.withColumn("iteration", F.lit(i).cast("long")))
        back = cut(back)
        n = back.count()
        if not n:
            break
        if feedback_buffer_size is not None and n > feedback_buffer_size:
            raise OverflowError(f"{n} rows came back; the buffer holds {feedback_buffer_size}")
        i += 1
        if i > max_iterations:
            raise RuntimeError(f"elements still come back after {max_iterations} rounds")
        frontier = back
    result = outs[0]
    for o in outs[1:]:
        result = result.unionByName(o)
    return result


def feedback_each(df: DataFrame, value: str, forward: Callable[[Any], tuple[list[Any], list[Any]]], out_type: str, feedback_buffer_size: int = 1024, max_steps: int = 1_000_000) -> DataFrame:
    """(source, emit_order, element): the loop of each element alone, inside its task.

    forward(x) gives outputs and elements that come back. What comes back goes before new input; a
    buffer of more than feedback_buffer_size elements fails, as does a loop of more than max_steps.
    """
    kind = dict(df.dtypes)[value]

    def loops(values: Iterable[Any]) -> Iterator[tuple]:
        for source in values:
            waiting, steps, order = deque([source]), 0, 0
            while waiting:
                steps += 1
                if steps > max_steps:
                    raise RuntimeError(f"no end after {max_steps} steps from {source!r}")
                out, back = forward(waiting.popleft())
                waiting.extend(back)
                if len(waiting) > feedback_buffer_size:
                    raise OverflowError("the feedback buffer is full")
                for x in out:
                    order += 1
                    yield source, order, x

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _frames(loops(batch[value].tolist()), ["source", "emit_order", "element"])

    return _spread(df.select(value)).mapInPandas(run, f"source {kind}, emit_order long, element {out_type}")


def retry(df: DataFrame, key: str, value: str, state: str, flow: Callable[[Any], Any], retry_with: Callable[[Any], tuple[Any, Any] | None], result_type: str, max_attempts: int = 1000, timeout_s: float | None = None) -> DataFrame:
    """(key, ok, result, error, state, attempts): the flow's success, or its last failure.

    A failed element (the flow raised, or took longer than timeout_s, else than RETRY_TIMEOUT) is tried again with retry_with(state) = (value,
    state), until that is None. More than max_attempts fail the query. Also for streams: elements do not depend on
    each other.
    """
    kinds = dict(df.dtypes)
    flow = _within(flow, _retry_timeout(df, timeout_s))

    def one(x: Any, s: Any) -> tuple:
        for attempt in range(1, max_attempts + 1):
            try:
                return True, flow(x), None, s, attempt
            except Exception as e:  # noqa: BLE001 - any failure of the flow is data
                again = retry_with(s)
                if again is None:
                    return False, None, str(e), s, attempt
                x, s = again
        raise RuntimeError(f"still failing after {max_attempts} attempts")

    names = ["key", "ok", "result", "error", "state", "attempts"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _frames(((k, *one(x, s)) for k, x, s in zip(batch[key].tolist(), batch[value].tolist(), batch[state].tolist(), strict=True)), names)

    return df.select(key, value, state).mapInPandas(run, f"key {kinds[key]}, ok boolean, result {result_type}, error string, state {kinds[state]}, attempts long")


def retry_concat(df: DataFrame, key: str, value: str, state: str, flow: Callable[[Any], Any], retry_with: Callable[[Any], list[tuple[Any, Any]] | None], result_type: str, retries_limit: int, max_attempts: int = 1_000_000, timeout_s: float | None = None) -> DataFrame:
    """(key, emit_order, ok, result, error, state): a failure may become many new elements, or none.

    retry_with(state) gives a list that is tried next, in order, before other input; None passes the
    failure on. A list that does not fit into retries_limit fails the query. A call that takes longer than timeout_s failed.
    """
    kinds = dict(df.dtypes)
    flow = _within(flow, _retry_timeout(df, timeout_s))

    def one(x: Any, s: Any) -> Iterator[tuple]:
        waiting, order, attempts = deque([(x, s)]), 0, 0
        while waiting:
            x, s = waiting.popleft()
            attempts += 1
            if attempts > max_attempts:
                raise RuntimeError(f"no end after {max_attempts} attempts")
            try:
                result = (True, flow(x), None, s)
            except Exception as e:  # noqa: BLE001 - any failure of the flow is data
                more = retry_with(s)
                if more is not None:
                    if len(more) + len(waiting) > retries_limit:
                        raise OverflowError(f"more than {retries_limit} retries wait") from e
                    waiting.extend(more)
                    continue
                result = (False, None, str(e), s)
            order += 1
            yield order, *result

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = ((k, *r) for k, x, s in zip(batch[key].tolist(), batch[value].tolist(), batch[state].tolist(), strict=True) for r in one(x, s))
            yield from _frames(rows, ["key", "emit_order", "ok", "result", "error", "state"])

    return df.select(key, value, state).mapInPandas(run, f"key {kinds[key]}, emit_order long, ok boolean, result {result_type}, error string, state {kinds[state]}")
