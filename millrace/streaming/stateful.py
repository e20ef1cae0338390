"""Streaming forms of the ordered operators, on keyed state.

Each operator is a small machine: ``begin()`` gives its state (a tuple of plain values), ``step(state,
row)`` takes a row and gives the state and output rows, ``end(state)`` flushes at a timeout. Rows of a
key are taken in the order of their key column within a micro-batch, and micro-batches in turn; with
an input in order the outputs are those of the batch forms. State is pickled into one binary column,
so any machine runs on the same keyed operator, checkpointed by the state store.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Machine:
    begin: Callable[[], Any]
    step: Callable[[Any, dict], tuple[Any, list[tuple]]]
    schema: str
    end: Callable[[Any], list[tuple]] = lambda state: []


def stateful(df: DataFrame, by: list[str], order_by: str, machine: Machine, idle_ms: int | None = None) -> DataFrame:
    """by and the machine's columns. With idle_ms a key that gets no rows for so long is flushed and forgotten."""
    kinds = dict(df.dtypes)
    names = [c.strip().split()[0] for c in machine.schema.split(",")]
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), machine.schema])

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else machine.begin()
        out: list[tuple] = []
        if state.hasTimedOut:
            out = list(machine.end(held))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(order_by, kind="stable")
            for row in rows.to_dict("records"):
                held, more = machine.step(held, row)
                out += more
            state.update((pickle.dumps(held),))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        if out:
            got = pd.DataFrame(out, columns=names)
            for i, b in enumerate(by):
                got.insert(i, b, key[i])
            yield got

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms is not None else GroupStateTimeout.NoTimeout
    return df.groupBy(*by).applyInPandasWithState(run, schema, "held binary", "append", timeout)


def accumulate(value: str, order_by: str, fold: Callable[[Any, Any], Any], zero: Any, out_type: str) -> Machine:
    def step(acc: Any, row: dict) -> tuple[Any, list[tuple]]:
        acc = fold(acc, row[value])
        return acc, [(row[order_by], acc)]

    return Machine(lambda: zero, step, f"{order_by} long, acc {out_type}")


def accumulate_while_unchanged(prop: str, element: str, order_by: str, element_type: str, max_elements: int | None = None, max_duration_us: int | None = None, arrival: str | None = None) -> Machine:
    """A batch also ends after max_elements and at ticks of max_duration_us; the open one is only given out at a timeout."""
    if max_duration_us is not None and (max_duration_us <= 0 or arrival is None):
        raise ValueError("max_duration_us must be positive and needs arrival times")

    def step(state: Any, row: dict) -> tuple[Any, list[tuple]]:
        first, was, held = state
        now = (row[prop], row[arrival] // max_duration_us if max_duration_us is not None else None)
        out = []
        if held and (now != was or (max_elements is not None and len(held) >= max_elements)):
            out = [(first, held, len(held))]
            held = []
        if not held:
            first = row[order_by]
        return (first, now, [*held, row[element]]), out

    return Machine(lambda: (None, None, []), step, f"first_order long, elements array<{element_type}>, n long", lambda s: [(s[0], s[2], len(s[2]))] if s[2] else [])


def sample_nth(nth: int, order_by: str) -> Machine:
    return Machine(lambda: 0, lambda n, row: (n + 1, [(row[order_by],)] if (n + 1) % nth == 0 else []), f"{order_by} long")


def pulse(interval_us: int, arrival: str, order_by: str, initially_open: bool = False) -> Machine:
    """emit_us of each element, as the batch form gives it."""

    def step(tick: int, row: dict) -> tuple[int, list[tuple]]:
        tick = max(tick + 1, row[arrival] // interval_us)
        return tick, [(row[order_by], max(row[arrival], tick * interval_us))]

    return Machine(lambda: -1 if initially_open else 0, step, f"{order_by} long, emit_us long")


def delay_by(delay: str, arrival: str, order_by: str) -> Machine:
    def step(left: int | None, row: dict) -> tuple[int, list[tuple]]:
        left = max(row[arrival], row[arrival] if left is None else left) + max(0, row[delay])
        return left, [(row[order_by], left)]

    return Machine(lambda: None, step, f"{order_by} long, emit_us long")


def time_window(interval_us: int, arrival: str, order_by: str, eager: bool = True) -> Machine:
    """(emit_us, n, first_order) of each batch; the open one is given out at a timeout."""

    def step(state: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        cell, armed, held, seen = state
        c, out = row[arrival] // interval_us, []
        if c != cell:
            if held:
                out.append(((cell + 1) * interval_us, len(held), held[0]))
            if seen or c > 0:
                adjacent = c == cell + 1 and seen
                armed = (False if held else armed) if adjacent else True
            cell, held = c, []
            alone = armed
            if alone:
                out.append((row[arrival], 1, row[order_by]))
                return (cell, True, [], True), out
            return (cell, False, [row[order_by]], True), out
        if not seen and armed:
            return (cell, True, [], True), [(row[arrival], 1, row[order_by])]
        return (cell, armed, [*held, row[order_by]], True), out

    return Machine(lambda: (0, eager, [], False), step, "emit_us long, n long, first_order long", lambda s: [((s[0] + 1) * interval_us, len(s[2]), s[2][0])] if s[2] else [])


def token_throttle(order_by: str, cost: str, amount: str) -> Machine:
    """Elements and grants of one union stream: a row with an amount is a grant, else an element."""

    def step(state: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        tokens, waiting = state
        if row[amount] is not None and row[amount] == row[amount]:
            tokens += int(row[amount])
        else:
            if row[cost] < 0:
                raise ValueError("a cost must not be negative")
            waiting = [*waiting, (row[order_by], int(row[cost]))]
        out = []
        while waiting and waiting[0][1] <= tokens:
            name, price = waiting[0]
            tokens -= price
            waiting = waiting[1:]
            out.append((name, price))
        return (tokens, waiting), out

    return Machine(lambda: (0, []), step, f"{order_by} long, tokens long")


def valve(order_by: str, opens: str, initially_open: bool = True) -> Machine:
    """Elements and controls of one union stream: a row with a value in ``opens`` (1 or 0) is a control."""

    def step(state: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        is_open, waiting = state
        control = row[opens]
        if control is not None and control == control:
            is_open = bool(control)
            return (is_open, [] if is_open else waiting), [(w,) for w in waiting] if is_open else []
        return ((is_open, waiting), [(row[order_by],)]) if is_open else ((is_open, [*waiting, row[order_by]]), [])

    return Machine(lambda: (initially_open, []), step, f"{order_by} long")


def sample_steps(next_step: Callable[[int], int], order_by: str) -> Machine:
    """Elements at the running sums of next_step(1), next_step(2) and so on, which must be positive."""

    def gap(k: int) -> int:
        n = next_step(k)
        if n < 1:
            raise ValueError("a sampling step must be positive")
        return n

    def step(state: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        k, left = state if state is not None else (1, gap(1))
        if left > 1:
            return (k, left - 1), []
        return (k + 1, gap(k + 1)), [(row[order_by],)]

    return Machine(lambda: None, step, f"{order_by} long")


def sample_random(max_step: int, order_by: str, seed: int = 0) -> Machine:
    """The gaps of the batch form."""
    if max_step < 1:
        raise ValueError("max_step must be positive")
    return sample_steps(lambda k: int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:15], 16) % max_step + 1, order_by)


def delay_linear(step_us: int, grows: str, arrival: str, order_by: str, initial_us: int = 0, max_us: int | None = None) -> Machine:
    """emit_us under a delay that grows by step_us with each successive true of ``grows``, and falls back otherwise."""
    if step_us <= 0 or (max_us is not None and max_us <= initial_us):
        raise ValueError("step_us must be positive and max_us above initial_us")

    def step(state: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        trues, left = state
        grown = row[grows]
        trues = trues + 1 if grown is not None and grown == grown and grown else 0
        delay = initial_us + trues * step_us if trues else initial_us
        delay = min(delay, max_us) if max_us is not None else delay
        left = max(row[arrival], row[arrival] if left is None else left) + max(0, delay)
        return (trues, left), [(row[order_by], left)]

    return Machine(lambda: (0, None), step, f"{order_by} long, emit_us long")


def interval_rate_limiter(min_interval_us: int, max_batch: int, arrival: str, element: str, order_by: str, element_type: str) -> Machine:
    """(first_order, elements, n, emit_us) of batches that leave min_interval_us apart or more; the open one goes at a timeout."""
    if max_batch < 1 or min_interval_us < 1:
        raise ValueError("max_batch and min_interval_us must be positive")

    def leave(left: int | None, ready: int) -> int:
        return max(ready, ready if left is None else left) + min_interval_us

    def step(state: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        cell, first, held, left = state
        out, now = [], row[arrival] // min_interval_us
        if held and now != cell:
            left = leave(left, (cell + 1) * min_interval_us)
            out.append((first, held, len(held), left))
            held = []
        first = first if held else row[order_by]
        held = [*held, row[element]]
        if len(held) == max_batch:
            left = leave(left, row[arrival])
            out.append((first, held, len(held), left))
            held = []
        return (now, first, held, left), out

    def end(state: tuple) -> list[tuple]:
        cell, first, held, left = state
        return [(first, held, len(held), leave(left, (cell + 1) * min_interval_us))] if held else []

    return Machine(lambda: (None, None, [], None), step, f"first_order long, elements array<{element_type}>, n long, emit_us long", end)


def keep_alive_concat(size: int, interval_us: int, arrival: str, element: str, expand: Callable[[Any], list[Any]], element_type: str) -> Machine:
    """(emit_us, element) of the keep-alive buffer; at a timeout the next tick drains it."""
    if size < 1:
        raise ValueError("size must be positive")

    def step(state: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        before, buffer = state
        a, out = row[arrival], []
        for k in range(min(len(buffer), a // interval_us - before // interval_us)):  # ticks since the arrival before
            out.append(((before // interval_us + 1 + k) * interval_us, buffer[k]))
        buffer = buffer[len(out) :]
        buffer = buffer + (list(expand(row[element])) if len(buffer) < size else [row[element]])
        n = max(min(1, len(buffer)), len(buffer) - size)
        return (a, buffer[n:]), out + [(a, x) for x in buffer[:n]]

    return Machine(lambda: (0, []), step, f"emit_us long, element {element_type}", lambda s: [((s[0] // interval_us + 1) * interval_us, x) for x in s[1]])


def timed_interval_between(matching: str, time_us: str, order_by: str) -> Machine:
    """interval_us since the match before, for each row whose ``matching`` holds but the first."""

    def step(last: int | None, row: dict) -> tuple[int | None, list[tuple]]:
        hit = row[matching]
        if hit is None or hit != hit or not hit:
            return last, []
        return row[time_us], [] if last is None else [(row[order_by], row[time_us] - last)]

    return Machine(lambda: None, step, f"{order_by} long, interval_us long")


def last_element(value: str, order_by: str, value_type: str) -> Machine:
    """The last element, when the key has been idle."""
    return Machine(lambda: None, lambda last, row: ((row[order_by], row[value]), []), f"{order_by} long, {value} {value_type}", lambda last: [last] if last else [])


def merge_by_index(inputs: int, input_no: str, index: str) -> Machine:
    """Rows of inputs 0 to inputs - 1 in the order of their index, each as soon as no input can bring a smaller one.

    An input that has ended says so by a row with a null index; what waits is given out at a timeout.
    """

    def step(state: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        waiting, last, position = [list(w) for w in state[0]], list(state[1]), state[2]
        i, x = int(row[input_no]), row[index]
        if x is None or x != x:
            last[i] = math.inf
        else:
            if x < 0 or x <= last[i]:
                raise ValueError("the index of an input must rise from 0 or more")
            last[i] = x
            waiting[i].append(int(x))
        out = []
        while any(waiting) and all(w or at == math.inf for w, at in zip(waiting, last, strict=True)):
            at = min(w[0] for w in waiting if w)
            holders = [w for w in waiting if w and w[0] == at]
            if len(holders) > 1 or at == position[1]:
                raise ValueError("an index occurs twice")
            holders[0].pop(0)
            position = (position[0] + 1, at)
            out.append((at, position[0]))
        return (waiting, last, position), out

    def end(state: tuple) -> list[tuple]:
        rest = sorted(x for w in state[0] for x in w)
        if len(set(rest)) < len(rest):
            raise ValueError("an index occurs twice")
        return [(x, state[2][0] + 1 + k) for k, x in enumerate(rest)]

    return Machine(lambda: ([[] for _ in range(inputs)], [-1] * inputs, (0, -1)), step, f"{index} long, emit_position long", end)
