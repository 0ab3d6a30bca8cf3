"""Order-dependent part of the review log: one session's undo and redo."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, MutableMapping

import pandas as pd

from labelsieve.schema import MAX_HISTORY

Value = tuple[str | None, str | None]  # (label, status)


class SessionLog:
    """Commands of one session applied in order. ``states`` maps an item to its (label, status)."""

    def __init__(self, states: MutableMapping[str, Value], undo=(), redo=(), cap: int = MAX_HISTORY):
        self.states = states
        self.undo: deque = deque(undo, maxlen=cap)  # a full deque drops its oldest command
        self.redo: list = list(redo)

    def run(self, op: str, item: str | None, label: str | None, status: str | None) -> str | None:
        """Apply one command; returns the item that changed."""
        if op == "start":
            self.states[item] = (label, status)
        elif op == "update":
            before = self.states.get(item, (None, None))
            after = (before[0] if label is None else label, before[1] if status is None else status)
            if after == before:
                return None
            self.states[item] = after
            self.undo.append((item, before, after))
            self.redo = []
            return item
        elif op == "undo" and self.undo:
            command = self.undo.pop()
            self.states[command[0]] = command[1]
            self.redo.append(command)
            return command[0]
        elif op == "redo" and self.redo:
            command = self.redo.pop()
            self.states[command[0]] = command[2]
            self.undo.append(command)
            return command[0]
        return None


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def _result(session: str, log: SessionLog) -> pd.DataFrame:
    items = list(log.states.items())
    return pd.DataFrame({
        "session_id": [session] * len(items),
        "item_id": [item for item, _ in items],
        "label": [value[0] for _, value in items],
        "status": [value[1] for _, value in items],
    })


def _command(command: tuple[str, Value, Value]) -> dict:
    item, before, after = command
    return {"item_id": item, "before_label": before[0], "before_status": before[1], "after_label": after[0], "after_status": after[1]}


def stacks_of(session: str, log: SessionLog) -> pd.DataFrame:
    """The two stacks, oldest command first."""
    return pd.DataFrame({
        "session_id": [session], "undo": [[_command(c) for c in log.undo]], "redo": [[_command(c) for c in log.redo]]})


def fold_rows(
    batches: Iterator[pd.DataFrame], cap: int = MAX_HISTORY, result: Callable[[str, SessionLog], pd.DataFrame] = _result,
) -> Iterator[pd.DataFrame]:
    """Fold rows sorted by (session_id, seq); a session may run over any number of batches."""
    session, log = None, None
    for batch in batches:
        columns = (batch[name] for name in ("session_id", "op", "item_id", "label", "status"))
        for key, op, item, label, status in zip(*columns):
            if key != session:
                if log is not None:
                    yield result(session, log)
                session, log = key, SessionLog({}, cap=cap)
            log.run(op, _text(item), _text(label), _text(status))
    if log is not None:
        yield result(session, log)
