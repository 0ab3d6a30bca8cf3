"""Review log against a plain model, streams against batches, ranks and lags across their internal boundaries."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelsieve.operators import queue, review
from labelsieve.operators.checks import ViolationError
from labelsieve.operators.ranking import bucketed_rank, grouped_rank, neighbour_value, ordered_rank
from labelsieve.streaming.review_stream import OrderedReviewProcessor, changes_of, late_of, latest_changes, ordered_review_stream, review_stream, stream_session

COMMANDS = "seq long, session_id string, op string, item_id string, label string, status string"


def model(commands, cap=2048):
    """Straightforward two-stack model, one session after the other."""
    result = {}
    for session in {c[1] for c in commands}:
        state, past, future = {}, [], []
        for _, _, op, item, label, status in sorted(c for c in commands if c[1] == session):
            if op == "update":
                old = state.get(item, (None, None))
                new = (label or old[0], status or old[1])
                if new != old:
                    state[item], future = new, []
                    past = (past + [(item, old, new)])[-cap:]
            elif op == "undo" and past:
                step = past.pop()
                state[step[0]] = step[1]
                future.append(step)
            elif op == "redo" and future:
                step = future.pop()
                state[step[0]] = step[2]
                past = (past + [step])[-cap:]
        result |= {(session, item): value for item, value in state.items()}
    return result


def random_commands(count, sessions, seed, reversals=0.5):
    rng = random.Random(seed)
    rows = []
    for seq in range(count):
        session = f"s{min(rng.randrange(sessions * 3), sessions) if sessions > 1 else 0}"
        if rng.random() < reversals:
            rows.append((seq, session, rng.choice(["undo", "redo"]), None, None, None))
        else:
            rows.append((seq, session, "update", f"i{rng.randrange(5)}", rng.choice(["a", "b", None]), rng.choice(["correct", "skipped", None])))
    return rows


def state_of(df):
    return {(r.session_id, r.item_id): (r.label, r.status) for r in df.collect()}


@pytest.mark.parametrize("seed,reversals,cap", [(1, 0.5, 2048), (2, 0.3, 3), (3, 0.0, 2048), (4, 0.7, 2)])
def test_fold_equals_model(spark, seed, reversals, cap):
    commands = random_commands(600, 4, seed, reversals)
    got = state_of(review.undo_redo_fold(spark.createDataFrame(commands, COMMANDS).repartition(5), cap=cap))
    assert {k: v for k, v in got.items() if v != (None, None)} == {k: v for k, v in model(commands, cap).items() if v != (None, None)}


def test_history_cap_drops_the_oldest(spark):
    rows = [(i, "s", "update", "i", "ab"[i % 2], None) for i in range(2049)]
    rows += [(3000 + i, "s", "undo", None, None, None) for i in range(2060)]
    assert state_of(review.undo_redo_fold(spark.createDataFrame(rows, COMMANDS))) == {("s", "i"): ("a", None)}


def test_fold_starts_from_the_items(spark):
    rows = [(1, "s", "update", "i", "b", None), (2, "s", "undo", None, None, None)]
    start = spark.createDataFrame([("s", "i", "a", "pending")], "session_id string, item_id string, label string, status string")
    assert state_of(review.undo_redo_fold(spark.createDataFrame(rows, COMMANDS), start)) == {("s", "i"): ("a", "pending")}


def test_stream_equals_batch(spark, tmp_path):
    commands = random_commands(300, 3, 9)
    for part in range(3):
        spark.createDataFrame(commands[part * 100:(part + 1) * 100], COMMANDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    stream = stream_session(spark).readStream.schema(COMMANDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes = []
    run = (review_stream(stream).writeStream.outputMode("update").trigger(availableNow=True)
           .option("checkpointLocation", str(tmp_path / "state"))
           .foreachBatch(lambda batch, _: changes.extend(batch.collect())).start())
    run.awaitTermination()
    final = latest_changes(spark.createDataFrame(changes, "session_id string, seq long, item_id string, label string, status string"))
    assert state_of(final) == model(commands)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") == before
    with pytest.raises(ValueError):
        review_stream(spark.readStream.schema(COMMANDS).parquet(str(tmp_path / "in")))


def test_ordered_stream_under_shuffled_arrival(spark, tmp_path):
    """Commands within the delay are put in order; those behind the watermark come out as late rows and change nothing."""
    rng, commands = random.Random(4), random_commands(240, 3, 12)
    batches = [[], [], [], []]
    for command in commands:
        home = command[0] // 60
        batches[min(home + (rng.random() < 0.3), 3)].append((*command, command[0] * 1000))
    late, top = set(), None
    for batch in batches:
        late |= {c[0] for c in batch if top is not None and c[-1] < top - 20_000}
        top = max([c[-1] for c in batch] + [top or 0])
    own, schema = stream_session(spark), COMMANDS + ", ms long"
    batches.append([(-1, "end", "update", "i0", "a", None, 10 ** 10)])
    rows = []
    for batch in batches:
        rng.shuffle(batch)
        own.createDataFrame(batch, schema).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        arriving = own.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("at", F.timestamp_millis("ms"))
        run = (ordered_review_stream(arriving, "at", "20 seconds").writeStream.outputMode("append").trigger(availableNow=True)
               .option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda part, _: rows.extend(part.collect())).start())
        run.awaitTermination()
    out = spark.createDataFrame(rows, "session_id string, at_ms long, seq long, item_id string, label string, status string, kind string").filter("session_id <> 'end'")
    assert late and {r.seq for r in late_of(out).collect()} == late
    kept = [c for c in commands if c[0] not in late]
    assert state_of(latest_changes(changes_of(out))) == model(kept)


def test_previous_value_crosses_stretches(spark):
    rows = [(i, "hot" if i % 3 else "cold", i * 10) for i in range(0, 200)]
    df = spark.createDataFrame(rows, "seq long, item_id string, v long")
    for backwards in (True, False):
        got = {r.seq: r.near for r in neighbour_value(df, "item_id", "seq", F.col("v"), "near", backwards, width=7).collect()}
        want = {}
        for key in ("hot", "cold"):
            own = [r for r in rows if r[1] == key]
            for at, (seq, _, _) in enumerate(own):
                near = at - 1 if backwards else at + 1
                want[seq] = own[near][2] if 0 <= near < len(own) else None
        assert got == want


def test_ranks_equal_a_plain_sort(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["x", "x", "x", "y"]), rng.choice([None, 1.0, 2.0, 2.0, 3.0])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, score double").repartition(6)
    key = lambda r: (r[2] is None, -(r[2] or 0), r[0])
    order = [F.col("score").desc_nulls_last(), F.col("id").asc()]
    overall = {r.id: r["rank"] for r in ordered_rank(df, order).collect()}
    assert overall == {r[0]: at + 1 for at, r in enumerate(sorted(rows, key=key))}
    grouped = {r.id: r["rank"] for r in grouped_rank(df, ["g"], order).collect()}
    assert grouped == {r[0]: at + 1 for g in "xy" for at, r in enumerate(sorted([r for r in rows if r[1] == g], key=key))}
    bucketed = {r.id: r["rank"] for r in bucketed_rank(df, ["g"], F.floor(F.col("id") / 50), [F.col("id")]).collect()}
    assert bucketed == {r[0]: at + 1 for g in "xy" for at, r in enumerate([r for r in rows if r[1] == g])}


def test_incomplete_batch_is_rejected_whole(spark):
    ddl = "id string, x double, y double, suspicion_score double, suggested_label string, label_confidence double, neighbor_support double"
    items = spark.createDataFrame([(str(i), 0.0, 0.0, None, None, None, None, "not_analyzed") for i in range(3)], ddl + ", analysis_state string")
    classes = spark.createDataFrame([("a",)], "class_name string")
    good = [(str(i), 1.0, 2.0, 50.0, "a", 0.5, 0.5) for i in range(3)]
    assert review.apply_analysis(items, spark.createDataFrame(good, ddl), classes).filter("analysis_state = 'analyzed'").count() == 3
    faults = [
        good[:2], good + good[:1], [*good[:2], ("9", *good[2][1:])], [*good[:2], ("2", 1.0, 2.0, 101.0, "a", 0.5, 0.5)],
        [*good[:2], ("2", float("nan"), 2.0, 50.0, "a", 0.5, 0.5)], [*good[:2], ("2", 1.0, 2.0, 50.0, "zzz", 0.5, 0.5)],
    ]
    for rows in faults:
        with pytest.raises(ViolationError):
            review.apply_analysis(items, spark.createDataFrame(rows, ddl), classes)


def test_quotas_fill_the_limit(spark):
    groups = spark.createDataFrame([("a", "p", 1), ("a", "q", 2), ("b", "p", 1000), ("c", "p", 3), ("c", "q", 94)], "label string, status string, n long")
    for limit in (3, 5, 6, 17, 100, 1099):
        rows = queue.sample_quotas(groups, limit).collect()
        assert all(1 <= r.quota <= r.n for r in rows)
        assert sum(r.quota for r in rows) == max(limit, 5)


def test_plot_sample_pins_the_selected_item(spark):
    rows = [(str(i), f"p/{i}", "a", "pending", float(i), 0.0) for i in range(50)]
    items = spark.createDataFrame(rows, "id string, relative_path string, label string, status string, x double, y double")
    sample = queue.plot_sample(items, 10).persist()
    inside = sample.first().id
    outside = next(r[0] for r in rows if r[0] not in {s.id for s in sample.collect()})
    assert {r.id for r in queue.with_selected(sample, items.filter(F.col("id") == inside)).collect()} == {r.id for r in sample.collect()}
    pinned = {r.id for r in queue.with_selected(sample, items.filter(F.col("id") == outside)).collect()}
    assert outside in pinned and len(pinned) == 10


def test_broken_history_is_dropped_and_the_state_kept(spark):
    ddl = "seq long, item_id string, before_label string, after_label string, before_status string, after_status string"
    current = spark.createDataFrame([("i", "b", "correct"), ("j", "a", "pending")], "item_id string, label string, status string")
    undo = [(1, "i", "x", "a", "pending", "pending"), (2, "i", "a", "b", "pending", "correct")]
    redo = [(1, "j", "b", "c", "pending", "pending"), (2, "j", "a", "b", "pending", "pending")]
    good = review.usable_history(spark.createDataFrame(undo, ddl), spark.createDataFrame(redo, ddl), current)
    assert [side.count() for side in good] == [2, 2]
    for rows in (undo[:1], [undo[0], (2, "i", "z", "b", "pending", "correct")]):
        lost = review.usable_history(spark.createDataFrame(rows, ddl), spark.createDataFrame(redo, ddl), current)
        assert [side.count() for side in lost] == [0, 0]
    swapped = [(3 - r[0], *r[1:]) for r in redo]
    lost = review.usable_history(spark.createDataFrame(undo, ddl), spark.createDataFrame(swapped, ddl), current)
    assert [side.count() for side in lost] == [0, 0]


def test_held_commands_cost_few_calls_of_the_state_store():
    """A session of 3,000 commands out of order, some of them twice: calls do not grow with its commands."""
    class Calls:
        def __init__(self):
            self.calls, self.rows, self.timers = 0, [], []

        def appendList(self, rows):
            self.calls, self.rows = self.calls + 1, self.rows + rows

        def put(self, rows):
            self.calls, self.rows = self.calls + 1, list(rows)

        def get(self):
            self.calls += 1
            return iter(self.rows)

        def clear(self):
            self.put([])

        def registerTimer(self, at):
            self.timers.append(at)

    class Watermark:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

    class Items(dict):
        getValue = dict.get
        updateValue = dict.__setitem__

    class Stacks:
        kept = None

        def exists(self):
            return self.kept is not None

        def get(self):
            return self.kept

        def update(self, value):
            self.kept = value

    processor = OrderedReviewProcessor()
    processor.held = processor.handle = held = Calls()
    processor.items, processor.stacks = Items(), Stacks()
    commands = [(n, n, "update", f"i{n % 5}", f"class_{n}", None) for n in range(3000)] + [(10, 10, "update", "i0", "again", None), (2500, 2500, "update", "i0", "last", None)]
    order = random.Random(1).sample(range(3000), 3000) + [3000, 3001]
    frame = pd.DataFrame([commands[n] for n in order], columns=["at_ms", "seq", "op", "item_id", "label", "status"])
    assert list(processor.handleInputRows(("s",), iter([frame]), Watermark(0))) == []
    rows = []
    for mark in (1000, 1001, 3000):
        rows += [row for part in processor.handleExpiredTimer(("s",), Watermark(mark), None) for row in part.itertuples(index=False)]
    assert [(r.seq, r.label) for r in rows] == [(n, {10: "again", 2500: "last"}.get(n, f"class_{n}")) for n in range(3000)]
    assert held.rows == [] and held.calls < 20
