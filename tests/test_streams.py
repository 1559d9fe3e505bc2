"""State that is carried from run to run, ends, and drops what is late."""

import datetime as dt

from deskwise.plans.streams import arriving
from deskwise.streaming import streams as S

NOON = dt.datetime(2024, 1, 1, 12)


def after(hours):
    return NOON + dt.timedelta(hours=hours)


def test_days_are_given_out_once_and_their_state_goes(spark):
    rows = [(i, after(12 * i)) for i in range(40)]
    events = spark.createDataFrame([*rows, (99, after(0))], "event_id long, ts timestamp")
    reports = []
    # Part by part in the order of event_id: the last row is weeks late.
    found = arriving(events, lambda e: S.questions_per_window(e, late="6 hours"), "append", "late", "event_id", 4, reports).collect()
    whole = {}
    for _, ts in rows:
        whole[ts.date()] = whole.get(ts.date(), 0) + 1
    until = rows[-1][1] - dt.timedelta(hours=6)
    assert {r["bucket"].date(): r["questions"] for r in found} == {d: n for d, n in whole.items() if dt.datetime.combine(d, dt.time()) + dt.timedelta(days=1) <= until}
    assert len(found) == len({r["bucket"] for r in found})
    kept = [o["numRowsTotal"] for p in reports for o in p["stateOperators"]]
    assert sum(o["numRowsDroppedByWatermark"] for p in reports for o in p["stateOperators"]) == 1
    assert max(kept) > 5 and kept[-1] <= 2


def test_contexts_go_on_and_end_when_idle(spark):
    lines = [(1, 0, "user", "a", after(0)), (2, 1, "user", "b", after(0)), (1, 2, "bot", None, after(1)), (2, 3, "bot", "c", after(30)), (2, 4, "user", "d" * 30, after(31)), (1, 5, "user", "e", after(60)), (2, 6, "user", "f", after(61))]
    messages = spark.createDataFrame(lines, "session_id long, id long, role string, content string, created_at timestamp")
    found = arriving(messages, lambda m: S.rolling_contexts(m, 20, idle="24 hours"), "update", "idle", "id", 3).orderBy("_batch", "session_id").collect()
    assert any(r["session_id"] == 1 and r["context"] is None for r in found)
    last = {r["session_id"]: r["context"] for r in found if r["context"] is not None}
    # Session 1 was idle for 24 hours before the watermark of the second part; session 2 wasn't when its last message came.
    assert last == {1: "user: e", 2: ("d" * 30 + "\nuser: f")[-20:]}


def test_feedback_is_remembered(spark):
    rows = spark.createDataFrame([(i, 7, after(i), "like") for i in range(2)], "event_id long, target long, ts timestamp, value string")
    found = arriving(rows, S.feedback_stream, "append", "kept", "event_id").collect()
    assert sorted((r["event_id"], r["result"]) for r in found) == [(0, "ok"), (1, "already_rated")]
