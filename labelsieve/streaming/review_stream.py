"""The review log as a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator, MutableMapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from labelsieve.operators.undo import SessionLog, _text
from labelsieve.schema import MAX_HISTORY, STATUSES

OUTPUT = "session_id string, seq bigint, item_id string, label string, status string"
PACK_COMMANDS = 500
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with the state store that the streams need; ``spark`` keeps its settings."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return own


def require_rocksdb(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        raise ValueError("the review stream needs the RocksDB state store: read the commands with stream_session(spark)")


class _ItemStates(MutableMapping):
    """The state store's map of one session as item -> (label, status); an item is read and written once per batch."""

    def __init__(self, state):
        self._state = state
        self._seen: dict = {}
        self._dirty: set = set()

    def __getitem__(self, item):
        if item not in self._seen:
            stored = self._state.getValue((item,))
            self._seen[item] = None if stored is None else tuple(stored)
        if self._seen[item] is None:
            raise KeyError(item)
        return self._seen[item]

    def __setitem__(self, item, value):
        self._seen[item] = tuple(value)
        self._dirty.add(item)

    def __delitem__(self, item):
        self._state.removeKey((item,))
        self._seen[item] = None
        self._dirty.discard(item)

    def __iter__(self):
        self.flush()
        return (key[0] for key in self._state.keys())

    def __len__(self):
        return sum(1 for _ in self)

    def flush(self) -> None:
        for item in sorted(self._dirty):
            self._state.updateValue((item,), self._seen[item])
        self._dirty.clear()


class ReviewProcessor(StatefulProcessor):
    """Keeps items and undo/redo stacks per session; emits the new state of every item a command changed."""

    def __init__(self, cap: int = MAX_HISTORY):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "item_id string", "label string, status string")
        self.stacks = handle.getValueState("stacks", "undo string, redo string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        states = _ItemStates(self.items)
        log = SessionLog(states, *_stacks(self.stacks), self.cap)
        commands = pd.concat(rows).sort_values("seq", kind="stable")
        changed = []
        for seq, op, item, label, status in zip(*(commands[c] for c in ("seq", "op", "item_id", "label", "status"))):
            touched = log.run(op, _text(item), _text(label), _text(status))
            if touched is not None:
                changed.append((key[0], int(seq), touched, *states[touched]))
        states.flush()
        self.stacks.update((json.dumps(list(log.undo)), json.dumps(log.redo)))
        yield pd.DataFrame(changed, columns=["session_id", "seq", "item_id", "label", "status"])

    def close(self) -> None:
        pass


def review_stream(commands: DataFrame, cap: int = MAX_HISTORY) -> DataFrame:
    """Changes (session_id, seq, item_id, label, status) of a command stream, in update mode.

    Commands of a session must not arrive in a later micro-batch than their successors; inside a micro-batch they are
    put in order. Limit a micro-batch at the source. Needs a session with the RocksDB state store (``stream_session``).
    """
    require_rocksdb(commands.sparkSession)
    return commands.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=ReviewProcessor(cap), outputStructType=OUTPUT, outputMode="Update", timeMode="None"
    )


def _stacks(state) -> tuple[list, list]:
    undo, redo = map(json.loads, state.get()) if state.exists() else ([], [])

    def commands(stack):
        return [(item, tuple(before), tuple(after)) for item, before, after in stack]

    return commands(undo), commands(redo)


def _packs(commands: list) -> list[tuple[int, str]]:
    """(earliest time, JSON text) of up to ``PACK_COMMANDS`` commands each, in their order of arrival."""
    cut = [commands[at:at + PACK_COMMANDS] for at in range(0, len(commands), PACK_COMMANDS)]
    return [(min(command[0] for command in part), json.dumps(part)) for part in cut]


class OrderedReviewProcessor(StatefulProcessor):
    """Holds commands until the watermark has passed them, then applies them in the order of time and sequence number.

    A command older than the watermark when it arrives is not applied: it comes out as a row of its own. Held commands lie
    in the state store in packs, since every call of the store costs more than a command; a timer at the earliest of them
    wakes the session. Packs that begin later are put back unread, and packs keep their order of arrival.
    """

    def __init__(self, cap: int = MAX_HISTORY):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "item_id string", "label string, status string")
        self.stacks = handle.getValueState("stacks", "undo string, redo string")
        self.held = handle.getListState("held", "first bigint, commands string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark, first = timerValues.getCurrentWatermarkInMs(), None
        for batch in rows:
            late = batch["at_ms"] < watermark
            commands = zip(*(batch.loc[~late, c] for c in ("at_ms", "seq", "op", "item_id", "label", "status")))
            packs = _packs([(int(at), int(seq), *map(_text, command)) for at, seq, *command in commands])
            if packs:
                self.held.appendList(packs)
                first = min([pack[0] for pack in packs] + ([] if first is None else [first]))
            if late.any():
                yield batch.loc[late].assign(session_id=key[0], kind="late")[list(ORDERED)]
        if first is not None:
            self.handle.registerTimer(first + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        due, later = {}, []
        for pack in self.held.get():
            if pack[0] >= watermark:
                later.append(pack)
                continue
            commands = json.loads(pack[1])
            due |= {(at, seq): command for at, seq, *command in commands if at < watermark}
            later += _packs([command for command in commands if command[0] >= watermark])
        states = _ItemStates(self.items)
        log = SessionLog(states, *_stacks(self.stacks), self.cap)
        changed = []
        for place in sorted(due):
            touched = log.run(*due[place])
            if touched is not None:
                changed.append((key[0], *place, touched, *states[touched], "change"))
        states.flush()
        self.stacks.update((json.dumps(list(log.undo)), json.dumps(log.redo)))
        if later:
            self.held.put(later)
            self.handle.registerTimer(min(pack[0] for pack in later) + 1)
        else:
            self.held.clear()
        if changed:
            yield pd.DataFrame(changed, columns=list(ORDERED))

    def close(self) -> None:
        pass


ORDERED = ("session_id", "at_ms", "seq", "item_id", "label", "status", "kind")


def ordered_review_stream(commands: DataFrame, at: str, delay: str, cap: int = MAX_HISTORY) -> DataFrame:
    """(session_id, at_ms, seq, item_id, label, status, kind) of a command stream that may arrive in any order, appended.

    ``at`` is the time of a command, ``delay`` how long its successors wait for it. Rows of kind ``change`` are the states
    that commands lead to, in order; ``changes_of`` selects them. Rows of kind ``late`` are commands that arrived when the
    watermark had passed them: they are reported by ``late_of``, never applied and never lost. What the watermark has
    not passed when a stream ends stays held in its state. Commands without session, time or number are late rows of
    nobody: filter them before. Two commands of a session with the same time and number count as one.
    """
    require_rocksdb(commands.sparkSession)
    timed = commands.withWatermark(at, delay).select(
        "session_id", F.unix_millis(at).alias("at_ms"), F.col("seq").cast("long").alias("seq"), "op", "item_id", "label", "status")
    return timed.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=OrderedReviewProcessor(cap),
        outputStructType="session_id string, at_ms bigint, seq bigint, item_id string, label string, status string, kind string",
        outputMode="Append", timeMode="EventTime")


def changes_of(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'change'").drop("kind")


def late_of(rows: DataFrame) -> DataFrame:
    """Late commands (session_id, at_ms, seq, item_id, label, status)."""
    return rows.filter("kind = 'late'").drop("kind")


def latest_changes(changes: DataFrame) -> DataFrame:
    """Final state from all emitted changes."""
    order = F.struct("at_ms", "seq") if "at_ms" in changes.columns else F.col("seq")
    last = F.max_by(F.struct("label", "status"), order).alias("_s")
    return changes.groupBy("session_id", "item_id").agg(last).select("session_id", "item_id", "_s.label", "_s.status")


def status_count_stream(updates: DataFrame) -> DataFrame:
    """Running number of updates per status, for update or complete mode."""
    return updates.filter(F.col("status").isin(*STATUSES)).groupBy("status").agg(F.count("*").alias("n"))
