"""Keyed folds in event-time order.

Rows of a key wait in keyed map state, in parts by time, and are folded in order once the watermark has passed them: in whatever order files bring
them, the result is that of the batch form. What may still be preceded by an
admitted row waits; rows later than the watermark are dropped by Spark and
counted in the progress metric numRowsDroppedByWatermark. One event-time timer
a key wakes it, at its earliest waiting row or at the end that its state is
due to, so a state also ends where no further row comes, and nothing is left
of it then.

Every call on the state is a round trip to the JVM, so up to 256 rows
wait with the key's own state, and a part holds up to 256 rows of following
slots of time, or one slot that has more: a key costs calls by the parts that it
waits in, not by its rows. A wake-up reads the parts that are
due in order of their first times and folds what no further part can precede:
memory is 20,000 rows of a key and the parts that overlap, one for each time
that 20,000 rows or fewer of it came. The state store has to be RocksDB's: see
rocksdb_state.
"""

from __future__ import annotations

import contextlib
import itertools
import json
import operator
import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import Fold, advance

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Rows of a key that are sorted together as they come, or folded together.
SORT_ROWS = 20_000
#: Rows of a part that spans slots, and rows that wait with the key itself.
PART_ROWS = 256
#: A row's columns as one JSON text: Spark hands rows to Python cell by cell.
PACKED = "_packed"


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started within keep their state in RocksDB, which timers and map state need. The session's setting comes back afterwards."""
    was = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, was) if was else spark.conf.unset(PROVIDER)


_time = operator.itemgetter(0)


class InOrder(StatefulProcessor):
    def __init__(self, fold: Fold, cols: list[str], names: list[str], slot_ms: int, doubles: set[int] | None = None):
        """doubles: places of cols that are doubles; where given, a row holds its cols as one JSON text."""
        self.fold, self.cols, self.row, self.slot_ms, self.doubles = fold, cols, Row(*names), slot_ms, doubles

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first long, part long", "rows binary")
        self.held = handle.getValueState("key", "held binary")

    def load(self) -> tuple:
        """The fold's state or None, the number of the next part, when the key's timer goes, and the rows that wait in no part."""
        held = self.held.get()
        return pickle.loads(held[0]) if held else (None, 0, None, [])

    def values(self, rows: list[Row]) -> list[tuple]:
        if self.doubles is None:
            at = [rows[0].__fields__.index(c) for c in self.cols]
            return [tuple(row[i] for i in at) for row in rows]
        at = rows[0].__fields__.index(PACKED)
        read = [json.loads(row[at]) for row in rows]
        return [tuple(float(x) if i in self.doubles and x is not None else x for i, x in enumerate(r.get(c) for c in self.cols)) for r in read]

    def put(self, rows: list[tuple], parts: int) -> int:
        """Lets rows wait, in parts of following slots; the number of the next part."""
        part = []
        for _, slot in itertools.groupby(sorted(rows, key=_time), key=lambda r: r[0] // self.slot_ms):
            more = list(slot)
            if part and len(part) + len(more) > PART_ROWS:
                self.waiting.updateValue((part[0][0], parts), (pickle.dumps(part),))
                part, parts = [], parts + 1
            part += more
        if part:
            self.waiting.updateValue((part[0][0], parts), (pickle.dumps(part),))
            parts += 1
        return parts

    def rest(self, rows: list[tuple], parts: int) -> tuple[int, list[tuple]]:
        """Lets rows wait: few with the key, more in parts."""
        return (parts, rows) if len(rows) <= PART_ROWS else (self.put(rows, parts), [])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state, parts, wake, few = self.load()
        first = None
        while some := list(itertools.islice(rows, SORT_ROWS)):
            some = self.values(some)
            least = min(some, key=_time)[0]
            first = least if first is None else min(first, least)
            parts, few = self.rest(few + some, parts)
        if wake is None or first + 1 < wake:
            if wake is not None:
                self.handle.deleteTimer(wake)
            wake = first + 1
            self.handle.registerTimer(wake)
        self.held.update((pickle.dumps((state, parts, wake, few)),))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark, (state, parts, _, read) = timerValues.getCurrentWatermarkInMs(), self.load()
        places = sorted(tuple(k) for k in self.waiting.keys()) if parts else []
        now = list(itertools.takewhile(lambda p: p[0] < watermark, places))
        waits, enough = [p[0] for p in places[len(now) :][:1]], SORT_ROWS
        for place, upto in zip([None, *now], [*(p[0] for p in now), watermark], strict=True):
            if place is not None:
                read += pickle.loads(self.waiting.getValue(place)[0])
                self.waiting.removeKey(place)
            if upto == watermark or len(read) >= enough:  # no further part has rows before upto
                ready = sorted((r for r in read if r[0] < upto), key=self.fold.rank)
                read = [r for r in read if r[0] >= upto]
                enough = max(SORT_ROWS, 2 * len(read))
                for row in ready:
                    state, out = advance(self.fold, key, state, (key[0], *row))
                    yield from (self.row(*values) for values in out)
        waits += [min(r[0] for r in read)] if read else []
        parts, few = self.rest(read, parts if len(now) < len(places) else 0)
        due = self.fold.due(state) if state is not None else None
        if due is not None and due <= watermark:
            yield from (self.row(*values) for values in self.fold.finish(key, state))
            state, due = None, None
        ends = [x for x in (due, *(w + 1 for w in waits)) if x is not None]
        if not ends and (state is None or state == self.fold.start()):
            self.held.clear()
            return
        wake = min(ends) if ends else None
        if wake is not None:
            self.handle.registerTimer(wake)
        self.held.update((pickle.dumps((state, parts, wake, few)),))


def folded_in_order(stream: DataFrame, key: str, cols: list[str], ts: str, late: str, schema: str, fold: Fold, slot_ms: int = 600_000) -> DataFrame:
    """The fold over each key's rows (key, *cols), cols[0] being ts in milliseconds since 1970. Rows without a time have no place in the order and are left out."""
    names = [f.split()[0].strip("`") for f in schema.split(", ")]
    x = stream.where(F.col(ts).isNotNull() & F.col(cols[0]).isNotNull()).withWatermark(ts, late)
    kinds = [x.schema[c].dataType.simpleString() for c in cols]
    packs = len(cols) > 3 and set(kinds) <= {"bigint", "int", "boolean", "string", "double", "array<string>"}
    x = x.select(key, F.to_json(F.struct(*cols)).alias(PACKED), ts) if packs else x.select(key, *cols, ts)
    doubles = {i for i, kind in enumerate(kinds) if kind == "double"} if packs else None
    return x.groupBy(key).transformWithState(InOrder(fold, cols, names, slot_ms, doubles), schema, "append", "eventTime")
