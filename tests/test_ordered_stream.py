"""Run states from turns that arrive out of order against the batch fold."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from harvestlens.operators import runs
from harvestlens.streaming import run_state as streamed
from harvestlens.streaming import sinks
from harvestlens.streaming.ordered_runs import OrderedFold, stream_ordered_run_state

TURN = "run_id long, ts timestamp, event_id long, kind string, success boolean, max_steps int, reason string"
START = datetime(2024, 1, 1)
COLUMNS = ["run_id", "status", "current_step", "n_calls", "n_errors", "finish_reason"]


def turns(seed, n_runs, hot):
    """Runs of up to 12 turns and one of many; several turns share an instant."""
    pick, rows, event = random.Random(seed), [], 0
    for run in range(n_runs):
        most = 30 if run == 0 else pick.choice([0, 3, 6, None])
        for _ in range(hot if run == 0 else pick.randint(1, 12)):
            kind = pick.choices(["call", "parse_error", "action_error", "finish", "model_failure"], [40, 4, 4, 1, 1])[0]
            at = START + timedelta(seconds=pick.randint(0, 600))
            rows.append((run, at, event, kind, pick.random() < 0.7, most, f"r{event}"))
            event += 1
    return rows


def stream(spark, base, batches, delay, retention=timedelta(days=1)):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, TURN).coalesce(1).write.mode("append").parquet(f"{base}/in")
        arriving = sinks.read_table_stream(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema)
        updates = stream_ordered_run_state(arriving, delay=delay, retention=retention)
        sinks.append_updates(updates, f"{base}/out", f"{base}/cp").awaitTermination()
    return spark.read.schema(updates.schema).parquet(f"{base}/out")


def heartbeat(at):
    return [(None, at, None, None, None, None, None)]


def states(df):
    return {tuple(r) for r in df.select(COLUMNS).collect()}


def test_shuffled_arrivals_equal_batch(spark, tmp_path):
    rows = turns(3, 15, 200)
    # A turn arrives up to 300 seconds after its time, and some arrive twice.
    pick = random.Random(5)
    arrivals = sorted(rows + rows[::9], key=lambda r: r[1] + timedelta(seconds=pick.randint(0, 300)))
    third = len(arrivals) // 3
    batches = [arrivals[:third], arrivals[third : 2 * third], arrivals[2 * third :], heartbeat(START + timedelta(hours=2))]
    final = streamed.latest_run_state(stream(spark, tmp_path, batches, timedelta(seconds=601)))
    batch = runs.run_state(runs.kept_turns(spark.createDataFrame(rows, TURN), ["ts", "event_id"]))
    assert states(final) == states(batch)


def test_a_turn_waits_for_earlier_ones(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    late_first = [(1, at(20), 2, "finish", True, 9, "end")]
    then_early = [(1, at(10), 1, "call", True, 9, None), (1, at(90), 3, "call", True, 9, None)]
    updates = stream(spark, tmp_path, [late_first, then_early, heartbeat(at(300))], timedelta(seconds=60))
    assert states(streamed.latest_run_state(updates)) == {(1, "finished", 1, 2, 0, "end")}


@pytest.mark.parametrize("retention, left", [(timedelta(seconds=30), 0), (timedelta(days=9), 1)])
def test_finished_runs_leave_no_state(spark, tmp_path, retention, left):
    at = lambda s: START + timedelta(seconds=s)
    batches = [[(1, at(0), 1, "finish", True, 9, "end")], heartbeat(at(100)), heartbeat(at(200)), heartbeat(at(300))]
    stream(spark, tmp_path, batches, timedelta(seconds=1), retention)
    state = (
        spark.read.format("statestore").option("stateVarName", "fold").load(f"{tmp_path}/cp")
    )
    assert state.count() == left
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{tmp_path}/cp")
    assert waiting.count() == 0


class CountedState:
    """A processor's handle and all of its states; counts what is asked of them."""

    def __init__(self):
        self.calls, self.stored, self.timers = 0, {}, []

    def of(self, name, schema):
        return CountedVariable(self, name)

    getValueState = getListState = getMapState = of

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


class CountedVariable:
    def __init__(self, state, name):
        self.state, self.name = state, name

    def get(self):
        self.state.calls += 1
        return self.state.stored.get(self.name, None if self.name == "fold" else [])

    def put(self, value):
        self.state.calls += 1
        self.state.stored[self.name] = value

    update = put

    def clear(self):
        self.state.calls += 1
        self.state.stored.pop(self.name, None)

    # As in a map of turns.
    def exists(self):
        self.state.calls += 1
        return self.name in self.state.stored

    def keys(self):
        self.state.calls += 1
        return list(self.state.stored.get(self.name, {}))

    def getValue(self, key):
        self.state.calls += 1
        return self.state.stored[self.name][key]

    def updateValue(self, key, value):
        self.state.calls += 1
        self.state.stored.setdefault(self.name, {})[key] = value

    def removeKey(self, key):
        self.state.calls += 1
        del self.state.stored[self.name][key]


class Watermark:
    def getCurrentWatermarkInMs(self):
        return 10**9


def test_calls_of_the_state_store_do_not_grow_with_a_runs_turns():
    def run(n):
        state, fold = CountedState(), OrderedFold("bigint", timedelta(days=1))
        fold.init(state)
        turns = pd.DataFrame(
            {"micros": range(n), "tie": range(n), "kind": "call", "ok": True, "reason": None, "turn_limit": 1000}
        )
        list(fold.handleInputRows((1,), iter([turns]), None))
        (update,) = fold.handleExpiredTimer((1,), Watermark(), None)
        assert update["n_turns"].tolist() == [n] and not state.stored.get("waiting")
        return state.calls

    assert run(300) == run(3)
