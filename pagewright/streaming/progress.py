"""Progress of ingest streams, told to whoever listens."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener

Listener = Callable[[str, dict], None]


class Fanout:
    """Sends events to all listeners; one that fails leaves."""

    def __init__(self) -> None:
        self._listeners: dict[int, Listener] = {}
        self._lock, self._next = threading.Lock(), 0

    def add(self, listener: Listener) -> Callable[[], None]:
        """Returns what removes it."""
        with self._lock:
            self._next += 1
            number = self._next
            self._listeners[number] = listener
        return lambda: self._remove(number)

    def _remove(self, number: int) -> None:
        with self._lock:
            self._listeners.pop(number, None)

    def send(self, event: str, payload: dict) -> None:
        with self._lock:
            current = list(self._listeners.items())
        for number, listener in current:
            try:
                listener(event, payload)
            except Exception:  # noqa: BLE001  a closed connection may fail in any way
                self._remove(number)


def line(event: str, payload: dict) -> str:
    """An event as server-sent text."""
    return f"event: {event}\ndata: {json.dumps(payload, ensure_ascii=False)}\n\n"


class QueryProgress(StreamingQueryListener):
    """Tells a fanout when streaming queries start, make progress and end."""

    def __init__(self, fanout: Fanout):
        self.fanout = fanout

    def onQueryStarted(self, event) -> None:
        self.fanout.send("ingest.progress", {"state": "started", "query": event.name or str(event.id)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.fanout.send("ingest.progress", {"state": "batch-flushed", "query": p.name or str(p.id), "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        failed = getattr(event, "exception", None)
        self.fanout.send("ingest.progress", {"state": "error" if failed else "completed", "query": str(event.id)})


def ingest_stream(source: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a stream's waiting files through each(batch, number) and end; what was done before, by the checkpoint, isn't done again."""
    query = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
