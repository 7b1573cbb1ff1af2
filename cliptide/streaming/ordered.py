"""Clips of a stream in their order, whatever order they arrive in."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "clip bigint, status string, error string, made string"


class Fold(Protocol):
    """What is done with each clip in turn. The state and the results must fit into JSON."""

    def begin(self) -> Any: ...

    def step(self, state: Any, row: dict) -> tuple[Any, list[dict]]: ...


class InOrder(StatefulProcessor):
    """Keeps clips that came too early in map state, and folds the prefix without gaps as soon as it is there.

    A clip whose step raises becomes a row of status ``failed``; the state stays as before it, and the next clip goes on.
    With ``patience_ms`` a timer gives up on a gap: the clips in it become rows of status ``missing``. A clip
    that comes again, or after it was given up, is ``repeated``; a row without a number has failed.
    """

    def __init__(self, fold: Fold, key: str, clip: str, columns: list[str], first: int, patience_ms: int | None):
        self.fold, self.key, self.clip, self.columns = fold, key, clip, columns
        self.first, self.patience_ms = first, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "next bigint, folded string")
        self.waiting = handle.getMapState("waiting", "clip bigint", "body string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upcoming, state = self._progress()
        out = []
        for pdf in rows:
            for record in json.loads(pdf[[self.clip, *self.columns]].to_json(orient="records", date_format="iso")):
                if record[self.clip] is None:
                    out.append((None, "failed", "no clip number", None))
                    continue
                at = int(record[self.clip])
                if at < upcoming or self.waiting.containsKey((at,)):
                    out.append((at, "repeated", None, None))
                else:
                    self.waiting.updateValue((at,), (json.dumps(record),))
        upcoming, state = self._release(upcoming, state, out)
        self.progress.update((upcoming, json.dumps(state)))
        self._watch(timerValues)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upcoming, state = self._progress()
        out = []
        early = [k[0] for k in self.waiting.keys()]  # noqa: SIM118
        if early:
            out += [(at, "missing", None, None) for at in range(upcoming, min(early))]
            upcoming, state = self._release(min(early), state, out)
            self.progress.update((upcoming, json.dumps(state)))
        self._watch(timerValues)
        yield self._frame(key, out)

    def close(self) -> None:
        pass

    def _progress(self) -> tuple[int, Any]:
        if not self.progress.exists():
            return self.first, self.fold.begin()
        upcoming, folded = self.progress.get()
        return int(upcoming), json.loads(folded)

    def _release(self, upcoming: int, state: Any, out: list[tuple]) -> tuple[int, Any]:
        while self.waiting.containsKey((upcoming,)):
            row = json.loads(self.waiting.getValue((upcoming,))[0])
            self.waiting.removeKey((upcoming,))
            before = json.dumps(state)
            try:
                state, made = self.fold.step(state, row)
                out.append((upcoming, "done", None, json.dumps(made)))
            except Exception as failure:  # noqa: BLE001  (one bad clip must not end the stream; it is reported as a row)
                state = json.loads(before)
                out.append((upcoming, "failed", f"{type(failure).__name__}: {failure}", None))
            upcoming += 1
        return upcoming, state

    def _watch(self, timer_values) -> None:
        """One timer while clips wait behind a gap, none otherwise."""
        if self.patience_ms is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if next(iter(self.waiting.keys()), None) is not None:
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.patience_ms)

    def _frame(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["clip", "status", "error", "made"]).astype({"clip": "Int64"})
        frame.insert(0, self.key, key[0])
        return frame


def in_order(
    clips: DataFrame, key: str, clip: str, columns: list[str], fold: Fold, first: int = 0, patience_ms: int | None = None
) -> DataFrame:
    """(key, clip, status, error, made) of each clip of a stream, folded in the order of ``clip`` from ``first`` on.

    Clip numbers of a key have no gaps; they may arrive in any order and in any micro-batch. State per key is the fold's
    own and the clips behind a gap, each under its number. ``made`` is JSON; ``results`` reads it.
    """
    clips.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    types = dict(clips.dtypes)
    return clips.select(key, clip, *columns).groupBy(key).transformWithStateInPandas(
        statefulProcessor=InOrder(fold, key, clip, columns, first, patience_ms),
        outputStructType=f"{key} {types[key]}, {OUT}",
        outputMode="Append",
        timeMode="None" if patience_ms is None else "ProcessingTime",
    )


def results(done: DataFrame, key: str, schema: str) -> DataFrame:
    """One row per result of the clips that went well."""
    made = F.from_json("made", f"array<struct<{schema}>>")
    return done.filter("status = 'done'").select(key, "clip", F.explode(made).alias("r")).select(key, "clip", "r.*")


def failures(done: DataFrame) -> DataFrame:
    """Clips that failed, were missing or came again."""
    return done.filter("status <> 'done'").drop("made")


def fold_table(spark: SparkSession, clips: DataFrame, key: str, clip: str, columns: list[str], fold: Fold, first: int = 0) -> DataFrame:
    """The same fold over a table: every key's clips, sorted, in one task."""
    types = dict(clips.dtypes)
    names = [clip, *columns]

    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {int(r[clip]): r for r in reversed(json.loads(pdf[names].to_json(orient="records", date_format="iso")))}
        out, state, at = [], fold.begin(), first
        while at in rows:
            before = json.dumps(state)
            try:
                state, made = fold.step(state, rows[at])
                state = json.loads(json.dumps(state))
                out.append((at, "done", None, json.dumps(made)))
            except Exception as failure:  # noqa: BLE001
                state = json.loads(before)
                out.append((at, "failed", f"{type(failure).__name__}: {failure}", None))
            at += 1
        frame = pd.DataFrame(out, columns=["clip", "status", "error", "made"])
        frame.insert(0, key, keys[0])
        return frame

    return clips.select(key, *names).groupBy(key).applyInPandas(run, f"{key} {types[key]}, {OUT}")


class SceneFold:
    """Tumbling windows of ``size`` clips; the clip marked ``last`` flushes the rest. Windows without text make nothing."""

    def __init__(self, text: str, clip: str, last: str, size: int = 6):
        self.text, self.clip, self.last, self.size = text, clip, last, size

    def begin(self) -> dict:
        return {"scene": 0, "members": [], "fragments": 0}

    def step(self, state: dict, row: dict) -> tuple[dict, list[dict]]:
        members = [*state["members"], row[self.clip]]
        fragments = state["fragments"] + bool((row[self.text] or "").strip())
        if len(members) < self.size and not row[self.last]:
            return {"scene": state["scene"], "members": members, "fragments": fragments}, []
        scene = {"scene": state["scene"], "last_clip": members[-1], "clips": len(members), "members": members, "fragments": fragments}
        return {"scene": state["scene"] + 1, "members": [], "fragments": 0}, [scene] if fragments else []


class LengthFold:
    """Letters said so far; a text whose length a ``bad`` number divides is refused."""

    def __init__(self, text: str, bad: int):
        self.text, self.bad = text, bad

    def begin(self) -> int:
        return 0

    def step(self, state: int, row: dict) -> tuple[int, list[dict]]:
        size = len(row[self.text] or "")
        if size % self.bad == 0:
            raise ValueError(f"length {size}")
        return state + size, [{"so_far": state + size}]
