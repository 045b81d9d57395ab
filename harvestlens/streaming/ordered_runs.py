"""Run states from a stream of turns that arrive in any order within a bounded delay.

Nobody numbers the turns before: a turn waits in its run's buffer until the watermark
has passed its event time, so that no earlier one can follow, and is folded then.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from harvestlens.operators.runs import DEFAULT_MAX_STEPS, EXECUTED, TERMINAL, step_limit
from harvestlens.streaming.run_state import UPDATE, ending_reason

_FOLD = "n bigint, calls bigint, errors bigint, ending string, reason string, turn_limit bigint, at bigint"
_WAITING = "at bigint, tie {tie}, kind string, ok boolean, reason string"


def _plain(value):
    """A value as state and rows take it: no numpy scalars, no NaN for a missing text."""
    if value is None or (isinstance(value, float) and value != value):
        return None
    return value.item() if hasattr(value, "item") else value


def _millis(micros: int) -> int:
    return -(-micros // 1000)


class OrderedFold(StatefulProcessor):
    """Applies the turns of one run in the order of (event time, tie).

    The buffer never holds more turns than the run may still take: a turn behind that
    many earlier ones cannot take effect, whatever else arrives. A run that has ended
    keeps one small row, so that its later turns are known as such, and a run without
    a new turn for the retention time keeps nothing. The buffer is read and written as
    one list: what a run asks of the state store does not grow with its turns.
    """

    def __init__(self, tie: str, retention: timedelta):
        self._tie = tie
        self._retention = int(retention.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._fold = handle.getValueState("fold", _FOLD)
        self._waiting = handle.getListState("waiting", _WAITING.format(tie=self._tie))

    def _folded(self):
        fold = self._fold.get()
        return (0, 0, 0, None, None, 0, 0) if fold is None else tuple(fold)

    def _held(self) -> dict:
        return {(at, tie): tuple(turn) for at, tie, *turn in self._waiting.get()}

    def _write(self, turns: list[tuple]) -> None:
        if turns:
            self._waiting.put(turns)
        else:
            self._waiting.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, calls, errors, ending, reason, limit, at = self._folded()
        new = {}
        for batch in rows:
            for micros, tie, kind, ok, text, most in zip(
                batch["micros"], batch["tie"], batch["kind"], batch["ok"], batch["reason"], batch["turn_limit"]
            ):
                kind = _plain(kind)
                if kind is None or ending is not None:
                    continue
                limit = max(limit, int(most))
                new[(int(micros), _plain(tie))] = (kind, bool(ok), _plain(text))
            if len(new) > 4 * (limit + 1):
                new = {k: new[k] for k in sorted(new)[: limit - n]}
        if not new:
            return
        held = self._held()
        first_held = min(held, default=None)
        turns = new | held
        kept = sorted(turns)[: max(limit - n, 0)]
        if len(kept) != len(held) or any(place not in held for place in kept):
            self._write([(*place, *turns[place]) for place in kept])
        self._fold.update((n, calls, errors, ending, reason, limit, at))
        if kept and kept[0] != first_held:
            self._handle.registerTimer(_millis(kept[0][0]))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        n, calls, errors, ending, reason, limit, at = self._folded()
        start = n
        held = self._held()
        waiting = sorted(held)
        ready = [place for place in waiting if place[0] <= now * 1000]
        for place in ready:
            kind, ok, text = held[place]
            n += 1
            at = place[0]
            calls += kind in EXECUTED
            errors += kind in ("parse_error", "action_error", "model_failure") or (kind == "call" and not ok)
            if kind in TERMINAL:
                ending, reason = kind, text
                break
        done = ending is not None or n >= limit
        rest = [] if done else waiting[len(ready):]
        if len(rest) < len(held):
            self._write([(*place, *held[place]) for place in rest])
        if rest:
            self._handle.registerTimer(max(_millis(rest[0][0]), now + 1))
        if n == start:
            if not rest and now >= _millis(at) + self._retention:
                self._fold.clear()
            return
        self._fold.update((n, calls, errors, ending, reason, limit, at))
        self._handle.registerTimer(max(_millis(at) + self._retention, now + 1))
        status = {"finish": "finished", "model_failure": "failed"}.get(
            ending, "max_steps_reached" if n >= limit else "running"
        )
        yield pd.DataFrame(
            {
                "run_id": [key[0]],
                "n_turns": [n],
                "status": [status],
                "current_step": [n - 1 if ending else n],
                "n_calls": [calls],
                "n_errors": [errors],
                "finish_reason": [reason],
            }
        )

    def close(self) -> None:
        pass


# Whole numbers stay whole beside missing values.
_WHOLE = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype(), pa.int16(): pd.Int16Dtype(), pa.int8(): pd.Int8Dtype()}


def _first_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run in a batch of rows the turns that can take effect; the batch's latest row moves time on."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.select(["run_id", "micros", "tie", "kind", "turn_limit"]).to_pandas(types_mapper=_WHOLE.get)
        turns = rows[rows["kind"].notna()].drop_duplicates(["run_id", "micros", "tie"])
        place = turns.sort_values(["micros", "tie"], kind="stable").groupby("run_id", dropna=False).cumcount()
        keep = set(place.index[place < turns["turn_limit"].reindex(place.index)])
        keep.add(rows["micros"].idxmax())
        yield batch.filter(pa.array([i in keep for i in range(len(rows))]))


def _never_missing(column: str, type_: str) -> Column:
    """A heartbeat's empty cells as zeros where they would turn whole numbers of other rows into floats."""
    whole = type_ in ("tinyint", "smallint", "int", "bigint")
    value = F.col(column)
    return F.when(F.col("kind").isNull() & value.isNull(), F.lit(0).cast(type_)).otherwise(value) if whole else value


def stream_ordered_run_state(
    turns: DataFrame,
    at: str = "ts",
    tie: str = "event_id",
    delay: timedelta = timedelta(hours=1),
    retention: timedelta = timedelta(days=30),
) -> DataFrame:
    """Streaming turns (run_id, ``at``, ``tie``, kind, success, max_steps, ...) in any order to state updates.

    A turn may arrive up to ``delay`` behind the latest event time seen; later ones are
    dropped, as Structured Streaming does. ``tie`` orders turns of one instant and, with
    ``at``, names a turn: a repeated one counts once. All turns of a run state one
    ``max_steps``; their ``run_id`` and ``tie`` are not NULL. State goes when a run had no turn for ``retention`` of event time; a
    turn after that opens the run anew. A row without a ``kind`` is a heartbeat: it moves
    event time on and belongs to no run. Rows without ``at`` have no place in a stream's
    order and are ignored; in batch they come first.

    Before the shuffle each batch of rows keeps a run's first turns up to its step limit
    only, so that a run that floods the log does not flood one task.
    """
    key, tie_type = dict(turns.dtypes)["run_id"], dict(turns.dtypes)[tie]
    limited = turns.where(F.col(at).isNotNull()).select(
        _never_missing("run_id", key).alias("run_id"),
        F.col(at).cast("timestamp").alias("at"),
        F.unix_micros(F.col(at).cast("timestamp")).alias("micros"),
        _never_missing(tie, tie_type).alias("tie"),
        "kind",
        F.coalesce(F.col("success"), F.lit(False)).alias("ok"),
        ending_reason(turns).alias("reason"),
        F.coalesce(step_limit(F.col("max_steps")), F.lit(DEFAULT_MAX_STEPS)).cast("long").alias("turn_limit"),
    )
    return (
        limited.mapInArrow(_first_turns, limited.schema)
        .withWatermark("at", f"{int(delay.total_seconds() * 1000)} milliseconds")
        .groupBy("run_id")
        .transformWithStateInPandas(
            statefulProcessor=OrderedFold(tie_type, retention),
            outputStructType=UPDATE.format(key=key),
            outputMode="Append",
            timeMode="EventTime",
        )
    )
