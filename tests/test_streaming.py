"""Streams over several micro-batches: order, duplicates, late and missing rows."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from winnow.operators.pruning import select_topk
from winnow.operators.scoring import group_advantage
from winnow.sources import writers
from winnow.streaming import streams as st

START = dt.datetime(2024, 1, 1)
SCHEMA = "run_id long, group_id long, sample_idx int, reward double, n_tokens int, kept boolean, ts timestamp"


def row(group, index, reward, minutes, run=0, tokens=10, kept=True):
    return (run, group, index, float(reward), tokens, kept, START + dt.timedelta(minutes=minutes))


def stream(spark, tmp_path, batches):
    """A stream that reads one file per micro-batch, in order."""
    source = str(tmp_path / "source")
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)


def drained(stream_df, tmp_path, name="out"):
    return st.drain(stream_df, str(tmp_path / name), str(tmp_path / f"{name}-state"))


def drain(stream_df, tmp_path, name="out"):
    return drained(stream_df, tmp_path, name).rows


def pruned(spark, tmp_path, batches, size=4, k=2, delay="10 minutes", name="out", **options):
    """What the stream gives out, and with it what was open when the data ended."""
    source = stream(spark, tmp_path / name, batches)
    ran = drained(st.mark_stream(source, size, k, delay=delay, **options), tmp_path, name)
    batch = spark.read.schema(SCHEMA).parquet(str(tmp_path / name / "source"))
    both = st.with_open_groups(ran, batch, size, k, delay=delay, **options)
    return tuple(rows.where("kept").drop("kept") for rows in (ran.rows, both))


def placed(df):
    return sorted((r.group_id, r.sample_idx, r.whole) for r in df.collect())


def test_whole_groups_keep_their_best_and_repeats_count_once(spark, tmp_path):
    batches = [
        [row(1, 0, 3, 0), row(1, 1, 0, 0), row(2, 0, 1, 0)],
        [row(1, 2, 1, 1), row(1, 1, 0, 1), row(2, 1, 2, 1)],
        [row(1, 3, 0, 2), row(2, 2, 0, 2), row(2, 3, 0, 2), row(3, 0, 1, 2)],
        [row(1, 3, 0, 3), row(1, 0, 3, 3), row(9, 0, 1, 300)],
        [row(9, 1, 1, 301)],
    ]
    streamed, got = pruned(spark, tmp_path, batches)
    assert {(1, 0, True), (1, 1, True), (2, 1, True), (2, 2, True)} <= set(placed(streamed))
    assert placed(got) == [(1, 0, True), (1, 1, True), (2, 1, True), (2, 2, True), (3, 0, False), (9, 0, False), (9, 1, False)]
    whole = spark.createDataFrame(
        [(0, 1, 0, 3.0), (0, 1, 1, 0.0), (0, 1, 2, 1.0), (0, 1, 3, 0.0),
         (0, 2, 0, 1.0), (0, 2, 1, 2.0), (0, 2, 2, 0.0), (0, 2, 3, 0.0)],
        "run_id long, group_id long, sample_idx int, reward double")
    batch = select_topk(group_advantage(whole), 2, 4)
    want = {(r.group_id, r.sample_idx): round(r.advantage, 9) for r in batch.collect()}
    assert {(r.group_id, r.sample_idx): round(r.advantage, 9) for r in got.where("whole").collect()} == want
    assert set(got.columns) == {*SCHEMA.replace(",", "").split()[::2], "advantage", "whole"} - {"kept"}


def test_surplus_completions_make_a_group_ragged(spark, tmp_path):
    ten = [row(1, i, i % 3, i) for i in range(10)]
    _, got = pruned(spark, tmp_path, [ten[:8], ten[8:]], size=8)
    assert placed(got) == [(1, i, False) for i in range(10)]
    _, dropped = pruned(spark, tmp_path, [ten[:8], ten[8:]], size=8, name="drop", on_ragged="drop")
    assert dropped.count() == 0


def test_open_groups_are_given_out_at_the_end(spark, tmp_path):
    batches = [[row(1, 0, 3, 0), row(1, 1, 0, 0)], [row(2, 0, 1, 300)], [row(2, 1, 1, 600)]]
    streamed, got = pruned(spark, tmp_path, batches)
    assert placed(streamed)[:2] == [(1, 0, False), (1, 1, False)]
    assert placed(got) == [(1, 0, False), (1, 1, False), (2, 0, False), (2, 1, False)]
    alone, at_end = pruned(spark, tmp_path, [[row(5, i, i, 0) for i in range(4)]], name="one")
    assert placed(alone) == [] and placed(at_end) == [(5, 0, True), (5, 3, True)]


def test_rows_without_time_group_or_position(spark, tmp_path):
    lost = (0, 1, 0, 1.0, 10, True, None)
    rows = [lost, row(1, 1, 0, 0), row(None, 0, 1, 0), row(None, 1, 2, 0), row(2, None, 1, 0), row(2, None, 2, 0)]
    _, got = pruned(spark, tmp_path, [rows, [row(1, 2, 1, 100)]], delay="1 hour")
    assert sorted(str((r.group_id, r.sample_idx)) for r in got.collect()) == sorted(
        map(str, [(1, 1), (1, 2), (None, 0), (None, 1), (2, None), (2, None)]))
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "out" / "source"))
    assert drain(st.without_event_time(source), tmp_path, "side").count() == 1


def test_last_windows_and_sessions_are_given_out(spark, tmp_path):
    source = stream(spark, tmp_path, [[row(1, 0, 2, 0)], [row(1, 1, 1, 90)]])
    batch = spark.read.schema(SCHEMA).parquet(str(tmp_path / "source"))
    of = lambda rows: st.metrics_stream(rows, "1 hour", None, "30 minutes")
    got = st.closed(drained(of(source), tmp_path), of(batch), "window_end")
    assert sorted(r.completions for r in got.collect()) == [1, 1]
    timed = lambda rows: st.timings_stream(rows.withColumns(
        {"seconds": F.col("reward"), "kind": F.lit("rollout")}), "30 minutes", "10 minutes")
    got = st.closed(drained(timed(source), tmp_path, "sessions"), timed(batch), "session_end")
    assert sorted(r.rollout_seconds for r in got.collect()) == [1.0, 2.0]


def test_late_rows_are_dropped_from_windows(spark, tmp_path):
    batches = [
        [row(1, 0, 2, 0, tokens=2000), row(1, 1, 0, 30, kept=False)],
        [row(1, 2, 1, 500)],
        [row(1, 6, 1, 501)],  # Spark drops late rows by the watermark of the batch before
        [row(1, 3, 9, 10), row(1, 4, 1, 510)],
        [row(1, 5, 1, 2000)],
    ]
    got = drain(st.metrics_stream(stream(spark, tmp_path, batches), "1 hour", None, "30 minutes"), tmp_path)
    rows = {r.window_start: r for r in got.collect()}
    first = rows[START]
    assert (first.completions, first.reward, first.retention, first.clipped_ratio) == (2, 1.0, 0.5, 0.5)
    assert rows[START + dt.timedelta(hours=8)].completions == 3


def test_sessions_follow_gaps(spark, tmp_path):
    batches = [[row(1, 0, 4, 0), row(1, 1, 1, 10)], [row(1, 2, 5, 200)], [row(1, 3, 0, 900)]]
    source = stream(spark, tmp_path, batches).withColumns({
        "seconds": F.col("reward"),
        "kind": F.when(F.col("sample_idx") == 1, "rollout").otherwise("train_step")})
    got = drain(st.timings_stream(source, "30 minutes", "10 minutes"), tmp_path).orderBy("session_start").collect()
    assert [(r.events, r.update_seconds) for r in got[:2]] == [(2, 3.0), (1, 5.0)]


def test_a_whole_group_leaves_with_its_last_row(spark, tmp_path):
    """Each micro-batch of a running stream gives out the groups that it completes; its state stays small."""
    batches = [
        [row(1, 0, 3, 0), row(1, 1, 0, 0), row(2, 0, 1, 0)],
        [row(1, 2, 1, 1), row(2, 1, 2, 1), row(1, 1, 9, 1)],
        [row(1, 3, 0, 2), row(2, 2, 0, 2)],
        [row(2, 3, 0, 3), row(2, 3, 0, 3), row(3, 0, 1, 3)],
        [row(1, 4, 5, 4)],
    ]
    seen = []

    def note(batch, number):
        seen.append(sorted((r.group_id, r.sample_idx, r.whole) for r in batch.collect()))

    source = stream(spark, tmp_path, batches)
    of = st.prune_stream(source, 4, 2, emit="complete")
    query = of.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen[:5] == [[], [], [(1, 0, True), (1, 1, True)], [(2, 1, True), (2, 2, True)], [(1, 4, False)]]
    assert all(not later for later in seen[5:])
    ran = drained(st.mark_stream(source, 4, 2, emit="complete"), tmp_path)
    got = st.with_open_groups(ran, spark.read.schema(SCHEMA).parquet(str(tmp_path / "source")), 4, 2, emit="complete").where("kept")
    assert placed(got) == [(1, 0, True), (1, 1, True), (1, 4, False), (2, 1, True), (2, 2, True), (3, 0, False)]


class KeptState:
    """The state of one group outside of a stream, with the most rows it ever held."""

    def __init__(self):
        self.value, self.most, self.hasTimedOut, self.deadline = None, 0, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value, self.most = value, max(self.most, len(value[1]))

    def remove(self):
        self.value = None

    def getCurrentWatermarkMs(self):
        return 0

    def setTimeoutTimestamp(self, at):
        self.deadline = at


@pytest.mark.parametrize("early", [True, False])
def test_state_of_a_group_is_bounded(early):
    machine, state = st._group_machine(8, 2, 1e-4, early), KeptState()
    out = []
    for batch in range(100):
        rows = [(f"{batch}/{k}", float(k % 5), k, 10 + batch) for k in range(1000)]
        frames = [pd.DataFrame(rows[a:a + 300], columns=["_payload", "_reward", "_place", "_deadline"]) for a in range(0, 1000, 300)]
        out += list(machine((0, 1), iter(frames), state))
    assert state.most <= 8 and sum(map(len, out)) == 100_000
    assert not any(frame["whole"].any() for frame in out) and state.deadline == 109
    state.hasTimedOut = True
    assert list(machine((0, 1), iter(()), state)) == [] and not state.exists


def test_state_machine_gives_out_ragged_rows_when_time_is_over():
    machine, state = st._group_machine(4, 1, 1e-4, False), KeptState()
    frame = pd.DataFrame([("a", 1.0, 0, 5), ("b", None, None, 5), ("c", 3.0, 2, 5)], columns=["_payload", "_reward", "_place", "_deadline"])
    assert list(machine((0, None), iter([frame]), state)) == []
    state.hasTimedOut = True
    (last,) = machine((0, None), iter(()), state)
    assert last["_payload"].tolist() == ["a", "b", "c"] and last["kept"].all() and not last["whole"].any() and not state.exists


def test_all_columns_come_back_as_they_were(spark, tmp_path):
    schema = ("run_id long, group_id long, sample_idx int, reward float, ts timestamp, big long, small double, raw binary, "
              "parts array<struct<x: int, y: string>>, day date, money decimal(20,4), text string")
    odd = [(1, 2**62, None, 0.1, dt.datetime(2024, 1, 1, 0, 0, 0, 123457), 2**62 + 1, 1 / 3, bytearray(b"\x00\xff"),
            [(1, "é"), (None, None)], dt.date(2024, 2, 29), None, 'a "quoted"\n\\ text \u2028'),
           (1, 2**62, 1, 0.7, dt.datetime(2024, 1, 1, 0, 0, 1), None, float("nan"), None, None, None, None, None)]
    spark.createDataFrame(odd, schema).coalesce(1).write.parquet(str(tmp_path / "source"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "source"))
    ran = drained(st.mark_stream(source, 2, 1, emit="complete"), tmp_path)
    given = spark.read.parquet(str(tmp_path / "source"))
    assert ran.rows.schema[:12] == given.schema and ran.rows.where("whole").count() == 2
    assert sorted(map(str, ran.rows.select(*given.columns).collect())) == sorted(map(str, given.collect()))


def test_what_the_stream_loses_stays_lost(spark, tmp_path):
    """Closing fills in what was open at the end, and nothing that should have been given out before."""
    batches = [[row(1, i, i, 0) for i in range(4)], [row(2, i, i, 1) for i in range(4)], [row(3, 0, 1, 300)], [row(4, 0, 1, 301)]]
    source = stream(spark, tmp_path, batches)
    data = spark.read.schema(SCHEMA).parquet(str(tmp_path / "source"))
    broken = drained(st.mark_stream(source.where("group_id <> 1"), 4, 2, emit="complete"), tmp_path)
    assert broken.watermark == dt.datetime(2024, 1, 1, 4, 51, tzinfo=dt.timezone.utc) and broken.dropped == 0
    got = st.with_open_groups(broken, data, 4, 2, emit="complete").where("kept")
    assert placed(got) == [(2, 0, True), (2, 3, True), (3, 0, False), (4, 0, False)]
    windows = lambda rows: st.metrics_stream(rows, "1 hour", None, "30 minutes")
    lost = drained(windows(source.where("group_id <> 1 and group_id <> 2")), tmp_path, "windows")
    starts = sorted(r.window_start for r in st.closed(lost, windows(data), "window_end").collect())
    assert starts == [START + dt.timedelta(hours=5)]


def test_a_session_that_is_open_at_the_end_comes_whole(spark, tmp_path):
    """The watermark ends inside of a session whose first events lie before it."""
    rows = [row(1, i, i, 25 * i) for i in range(8)]
    source = stream(spark, tmp_path, [rows])
    data = spark.read.schema(SCHEMA).parquet(str(tmp_path / "source"))
    timed = lambda events: st.timings_stream(events.withColumns(
        {"seconds": F.col("reward"), "kind": F.lit("rollout")}), "30 minutes", "10 minutes")
    (only,) = st.closed(drained(timed(source), tmp_path), timed(data), "session_end").collect()
    assert (only.events, only.session_start) == (8, START)


def test_late_rows_are_counted(spark, tmp_path):
    batches = [[row(1, 0, 2, 0)], [row(1, 2, 1, 500)], [row(1, 6, 1, 501)], [row(1, 3, 9, 10)], [row(1, 5, 1, 2000)]]
    ran = drained(st.metrics_stream(stream(spark, tmp_path, batches), "1 hour", None, "30 minutes"), tmp_path)
    assert ran.dropped == 1 and ran.watermark == dt.datetime(2024, 1, 2, 8, 50, tzinfo=dt.timezone.utc)


def rounds(spark, path):
    return st.read_rounds(spark, str(path), spark.createDataFrame([], SCHEMA).schema)


def test_landing_twice_changes_nothing(spark, tmp_path):
    batches = [[row(1, 0, 1, 0), row(2, 0, 1, 0, run=1)], [row(1, 1, 1, 1)]]
    source = stream(spark, tmp_path, batches)
    path = str(tmp_path / "rounds")
    assert rounds(spark, path).count() == 0
    for checkpoint in ("first", "again"):
        st.land_rounds(source, path, str(tmp_path / checkpoint)).awaitTermination()
        assert rounds(spark, path).count() == 3
    st.land_rounds(source, path, str(tmp_path / "again")).awaitTermination()
    assert rounds(spark, path).count() == 3


def test_a_batch_that_dies_before_its_manifest_is_read_once(spark, tmp_path, monkeypatch):
    batches = [[row(1, 0, 1, 0), row(2, 0, 1, 0, run=1)], [row(1, 1, 1, 1)], [row(1, 2, 1, 2)]]
    source, path = stream(spark, tmp_path, batches), str(tmp_path / "rounds")
    whole, calls = writers._write_manifest, []

    def dies(*args):
        calls.append(args)
        if len(calls) == 2:
            raise OSError("the driver is gone")
        return whole(*args)

    monkeypatch.setattr(writers, "_write_manifest", dies)
    with pytest.raises(Exception, match="the driver is gone"):
        st.land_rounds(source, path, str(tmp_path / "state")).awaitTermination()
    assert placed_rows(rounds(spark, path)) == [(1, 0), (2, 0)]
    assert len(list((tmp_path / "rounds" / "data").iterdir())) == 2  # one of them is no one's
    st.land_rounds(source, path, str(tmp_path / "state")).awaitTermination()
    assert placed_rows(rounds(spark, path)) == [(1, 0), (1, 1), (1, 2), (2, 0)]


def placed_rows(df):
    return sorted((r.group_id, r.sample_idx) for r in df.collect())


class MarkedState(KeptState):
    """A state with a watermark, for one bucket or one group."""

    watermark = 0

    def update(self, value):
        self.value = value

    def getCurrentWatermarkMs(self):
        return self.watermark


@pytest.mark.parametrize("early", [True, False])
def test_a_bucket_gives_what_its_groups_give(early):
    """One call for a bucket of groups gives the rows and times that a call for each group gives."""
    import random

    rng = random.Random(6)
    bucket, alone = st._bucket_machine(4, 2, 1e-4, early), st._group_machine(4, 2, 1e-4, early)
    columns = ["_key", "_payload", "_reward", "_place", "_deadline"]
    said = lambda frames: sorted(map(str, (r for f in frames for r in f.itertuples(index=False))))
    for _ in range(60):
        whole, parts, calls = MarkedState(), {}, 0
        for batch in range(12):
            mark = 10 * batch
            rows = [(f"g{rng.randrange(12)}", f"{batch}/{n}", rng.choice([None, 0.0, 1.0, 2.5]), rng.choice([None, n]), mark + rng.randrange(1, 25))
                    for n in range(rng.choice([0, 6, 25]))]
            frame = pd.DataFrame(rows, columns=columns)
            frames = [frame[a:a + 7] for a in range(0, len(frame), 7)]
            want = []
            for name in sorted(set(frame["_key"])):
                state = parts.setdefault(name, MarkedState())
                state.watermark, state.hasTimedOut = mark, False
                want += list(alone((name,), (f[f["_key"] == name] for f in frames if (f["_key"] == name).any()), state))
            for name, state in list(parts.items()):
                if name not in set(frame["_key"]) and state.deadline < mark:
                    state.watermark, state.hasTimedOut = mark, True
                    want += list(alone((name,), iter(()), state))
                    del parts[name]
            got = []
            whole.watermark, whole.hasTimedOut = mark, not rows
            if rows or (whole.exists and whole.deadline < mark):
                got, calls = list(bucket((0,), iter(frames), whole)), calls + 1
            assert said(got) == said(want)
            assert not whole.exists if not parts else whole.deadline == min(state.deadline for state in parts.values())
        assert calls <= 12


def test_state_and_python_calls_are_counted_by_buckets(spark, tmp_path):
    """A micro-batch calls Python per bucket, not per group, also when the groups' time is over."""
    batches = [[row(g, i, i, g) for g in range(200) for i in range(4)], [row(999, 0, 1, 5000)], [row(998, 0, 1, 9000)]]
    source = stream(spark, tmp_path, batches)
    query = st.mark_stream(source, 4, 2, emit="complete", buckets=8).writeStream.format("parquet").option(
        "path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [s.numRowsTotal for p in query.recentProgress for s in p.stateOperators if s.operatorName == "applyInPandasWithState"]
    assert held[0] == 8 and max(held) <= 8 and held[-1] <= 2
    assert spark.read.parquet(str(tmp_path / "out")).where("whole and kept").count() == 400
