"""A handle that pauses a streaming query, and batch listeners."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

OPEN, CLOSE = "Open", "Close"


class ValveSwitch:
    """Opens and closes a stream: closed, its query is stopped; opened again it goes on from its checkpoint."""

    def __init__(self, start: Callable[[], StreamingQuery], mode: str = OPEN):
        self._start, self._lock, self._query, self._done = start, threading.Lock(), None, False
        if mode == OPEN:
            self._query = start()

    def flip(self, mode: str) -> bool:
        """True if the mode changed."""
        if mode not in (OPEN, CLOSE):
            raise ValueError(f"{mode} is no mode")
        with self._lock:
            if self._done:
                raise RuntimeError("the stream has ended")
            if (mode == OPEN) == (self._query is not None):
                return False
            if mode == OPEN:
                self._query = self._start()
            else:
                self._query.stop()
                self._query = None
            return True

    @property
    def mode(self) -> str:
        if self._done:
            raise RuntimeError("the stream has ended")
        return CLOSE if self._query is None else OPEN

    @property
    def query(self) -> StreamingQuery | None:
        return self._query

    def complete(self) -> None:
        with self._lock:
            if self._query is not None:
                self._query.stop()
            self._query, self._done = None, True


class TimedListener(StreamingQueryListener):
    """Calls on_complete(seconds) when a query ends, after a failure, too."""

    def __init__(self, on_complete: Callable[[float], None]):
        import time

        self._clock, self._on_complete, self._started = time.perf_counter, on_complete, {}

    def onQueryStarted(self, event) -> None:
        self._started[event.id] = self._clock()

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        start = self._started.pop(event.id, None)
        if start is not None:
            self._on_complete(self._clock() - start)
