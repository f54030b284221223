"""Ratings and their sidecars as streams with state: undo and redo, and a queue of writes that are tried again.

Both take transformWithState, which needs the RocksDB state store (ROCKSDB) in the session's settings. State is kept in
small pieces: an action touches the few entries that it changes, however long its session is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.history import UNDO_DEPTH, recorded

#: The setting that these streams need.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Milliseconds before each further try of a write.
RETRY_MS = (400, 1500, 4000)
_CHANGES = "array<struct<img_id:bigint,before:string,after:string>>"


def _changes(found: list) -> list[tuple]:
    """Changes as tuples, whichever way Spark hands structs over."""
    return [tuple(c.values()) if isinstance(c, dict) else tuple(c) for c in found]


class _Stacks(StatefulProcessor):
    """at: how many actions can be taken back (u), taken back or brought again (s), and the height (h); slots: the action at each height."""

    def __init__(self, depth: int) -> None:
        self.depth = depth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "u int, s int, h bigint")
        self.slots = handle.getMapState("slots", "height bigint", f"changes {_CHANGES}")

    def _set(self, u: int, s: int, h: int) -> None:
        self.at.update((u, s, h))

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        undo, redo = list(initialState.undo or [])[-self.depth :], list(initialState.redo or [])
        for height, changes in enumerate([*undo, *reversed(redo)], 1):
            self.slots.updateValue((height,), (_changes(changes),))
        self._set(len(undo), len(undo) + len(redo), len(undo))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        u, s, h = self.at.get() if self.at.exists() else (0, 0, 0)
        # the rows of one batch only
        for row in sorted(rows, key=lambda r: r.seq):
            changes = None
            if row.kind == "rate":
                for gone in range(h + 1, h + s - u + 1):  # what could be brought again
                    self.slots.removeKey((gone,))
                changes, h = _changes(row.changes), h + 1
                self.slots.updateValue((h,), (changes,))
                if u == self.depth:
                    self.slots.removeKey((h - self.depth,))
                u = s = min(self.depth, u + 1)
            elif row.kind == "undo" and u:
                changes = _changes(self.slots.getValue((h,))[0])
                u, h = u - 1, h - 1
            elif row.kind == "redo" and u < s:
                u, h = u + 1, h + 1
                changes = _changes(self.slots.getValue((h,))[0])
            for pos, (img, before, after) in enumerate(changes or ()):
                yield Row(session=key[0], seq=row.seq, pos=pos, img_id=img, rating=before if row.kind == "undo" else after)
        self._set(u, s, h)

    def close(self) -> None:
        pass


def rating_stream(actions: DataFrame, initial: DataFrame | None = None, depth: int = UNDO_DEPTH) -> DataFrame:
    """session, seq, pos, img_id, rating: what operators.history.effects() gives for the same actions, as they arrive.

    Actions of a session must arrive in the order of seq from batch to batch; inside a batch they are sorted.
    ``initial`` has a row for each session that goes on from before: session, undo and redo, arrays of arrays of
    changes, the next one to be taken back or brought again last.
    """
    rows = recorded(actions.where(F.col("kind").isin("rate", "undo", "redo"))).select("session", "seq", "kind", "changes")
    kind = f"session {actions.schema['session'].dataType.simpleString()}, seq bigint, pos int, img_id bigint, rating string"
    return rows.groupBy("session").transformWithState(_Stacks(depth), kind, "Append", "None", initial.groupBy("session") if initial is not None else None)


class _Queue(StatefulProcessor):
    """waiting: writes of a path that are not done, oldest first; trying: the first one's tries so far; newest: the last seq seen."""

    def __init__(self, write: Callable[[str, str | None], None], waits: tuple[int, ...]) -> None:
        self.write, self.waits = write, waits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "seq bigint, rating string")
        self.trying = handle.getValueState("trying", "tries int")
        self.newest = handle.getValueState("newest", "seq bigint")

    def _work(self, path: str, now: int) -> Iterator[Row]:
        """Writes what waits, until one has to be tried again later."""
        waiting = [tuple(x) for x in self.waiting.get()]
        tries = self.trying.get()[0] if self.trying.exists() else 0
        while waiting:
            seq, rating = waiting[0]
            try:
                self.write(path, rating)
                error = None
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
            tries += 1
            if error and tries <= len(self.waits):
                self.handle.registerTimer(now + self.waits[tries - 1])
                break
            state = "saved" if not error else "failed" if seq == self.newest.get()[0] else "superseded"
            yield Row(path=path, seq=seq, rating=rating, state=state, tries=tries, error=error)
            waiting, tries = waiting[1:], 0
        self.waiting.put(waiting) if waiting else self.waiting.clear()
        self.trying.update((tries,)) if tries else self.trying.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = self.newest.get()[0] if self.newest.exists() else None
        # a row that comes twice, or late, is older than what is there
        new = sorted({(r.seq, r.rating) for r in rows if last is None or r.seq > last}, key=lambda x: x[0])
        if not new:
            return
        self.newest.update((new[-1][0],))
        self.waiting.appendList(new)
        if not self.trying.exists():  # else the first one waits for its timer, and these for it
            yield from self._work(key[0], timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._work(key[0], timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def write_queue(changes: DataFrame, write: Callable[[str, str | None], None], waits: tuple[int, ...] = RETRY_MS) -> DataFrame:
    """path, seq, rating, state, tries, error for each change (path, seq, rating; null clears) of a stream, once it is written or given up.

    Writes of one path go one after the other, in the order of seq; other paths go on meanwhile. One that raises is
    tried again after each of ``waits``, in milliseconds, by timers in the state: no task sleeps. After the last try it is
    failed if it is the newest of its path, and superseded if a newer one waits behind it. ``write`` must do no harm when
    it is called again, as a batch may run twice. A null path is left out.
    """
    kind = "path string, seq bigint, rating string, state string, tries int, error string"
    rows = changes.where("path is not null").select("path", "seq", "rating")
    return rows.groupBy("path").transformWithState(_Queue(write, waits), kind, "Append", "ProcessingTime")


def unsaved(outcomes: DataFrame) -> DataFrame:
    """path, seq, rating: what was not saved at last, from all that write_queue() gave; a later success of the path clears it."""
    last = outcomes.where("state <> 'superseded'").groupBy("path").agg(F.max_by(F.struct("seq", "rating", "state"), "seq").alias("x"))
    return last.where("x.state = 'failed'").select("path", "x.seq", "x.rating")
