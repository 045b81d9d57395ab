"""Run states kept up to date from a stream of turns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from harvestlens.operators.runs import EXECUTED, TERMINAL, step_limit

UPDATE = (
    "run_id {key}, n_turns bigint, status string, current_step bigint, n_calls bigint, n_errors bigint, "
    "finish_reason string"
)
_FOLD = "n bigint, calls bigint, errors bigint, ending string, reason string"
_TURN = "kind string, ok boolean, reason string"


class RunFold(StatefulProcessor):
    """Applies the turns of one run in order; a turn that comes early waits in state, a repeated one is dropped.

    State is one small row per run plus the turns that wait, and the caller has
    already dropped turns beyond the step limit, so a run never holds more than
    that many.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._fold = handle.getValueState("fold", _FOLD)
        self._waiting = handle.getMapState("waiting", "seq bigint", _TURN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, calls, errors, ending, reason = self._fold.get() if self._fold.exists() else (0, 0, 0, None, None)
        start, limit = n, 1
        early = {}
        for batch in rows:
            for seq, kind, ok, text, most in zip(
                batch["turn_seq"], batch["kind"], batch["ok"], batch["reason"], batch["turn_limit"]
            ):
                limit = max(limit, int(most))
                if seq > n:
                    early[int(seq)] = (kind, bool(ok), None if pd.isna(text) else text)
        while ending is None:
            seq = n + 1
            if seq in early:
                turn = early.pop(seq)
            elif self._waiting.containsKey((seq,)):
                turn = self._waiting.getValue((seq,))
                self._waiting.removeKey((seq,))
            else:
                break
            kind, ok, text = turn
            n += 1
            calls += kind in EXECUTED
            errors += kind in ("parse_error", "action_error", "model_failure") or (kind == "call" and not ok)
            if kind in TERMINAL:
                ending, reason = kind, text
        if ending is not None:
            self._waiting.clear()
        else:
            for seq, turn in early.items():
                self._waiting.updateValue((seq,), turn)
        if n == start:
            return
        self._fold.update((n, calls, errors, ending, reason))
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


def ending_reason(turns: DataFrame) -> Column:
    """Why a turn ends its run, NULL when it does not."""
    reason = F.col("reason") if "reason" in turns.columns else F.lit(None).cast("string")
    message = F.col("message") if "message" in turns.columns else F.lit(None).cast("string")
    return F.when(F.col("kind") == "finish", F.coalesce(reason, F.lit(""))).when(
        F.col("kind") == "model_failure",
        F.concat(F.lit("Model generation error: "), F.coalesce(message, F.lit("unknown error"))),
    )


def stream_run_state(turns: DataFrame) -> DataFrame:
    """Streaming (run_id, turn_seq from 1 without gaps, kind, success, max_steps, ...) to state updates.

    Turns beyond a run's step limit cannot change it and are dropped before the
    shuffle, so a run that floods the log brings at most its step limit to one
    task. Each update carries ``n_turns``; the largest one per run is current.
    """
    limited = turns.filter(F.col("turn_seq") <= step_limit(F.col("max_steps"))).select(
        "run_id",
        "turn_seq",
        "kind",
        F.coalesce(F.col("success"), F.lit(False)).alias("ok"),
        ending_reason(turns).alias("reason"),
        step_limit(F.col("max_steps")).cast("long").alias("turn_limit"),
    )
    return limited.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=RunFold(),
        outputStructType=UPDATE.format(key=dict(turns.dtypes)["run_id"]),
        outputMode="Append",
        timeMode="None",
    )


def latest_run_state(updates: DataFrame) -> DataFrame:
    """Current state per run from the appended updates; picked map-side first."""
    fields = [c for c in updates.columns if c not in ("run_id", "n_turns")]
    return updates.groupBy("run_id").agg(F.max_by(F.struct(*fields), "n_turns").alias("s")).select("run_id", "s.*")
