"""Streams over several batches, in and out of order."""

import random

import pandas as pd
import pytest

from usage_audit.operators import runs as RU
from usage_audit.streaming import run_events as ST

EVENT = "run_id string, seq long, at timestamp"


def streamed(spark, tmp_path, batches, schema, make, mode="append"):
    """`batches` (data frames) as files of a folder, one a micro-batch; the sink's rows."""
    for k, rows in enumerate(batches):
        rows.coalesce(1).write.parquet(f"{tmp_path}/in/{k:03}")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    stream = make(files)
    put = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/{epoch}")
    running = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{tmp_path}/cursor").trigger(availableNow=True).start()
    assert running.awaitTermination(300)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/out")


@pytest.mark.parametrize("seed", [0, 1])
def test_gaps_of_shuffled_batches_are_those_of_sorted_ones(spark, tmp_path, seed):
    random.seed(seed)
    rows = [(run, seq, 1_700_000_000 + seq) for run in ("a", "b", "c") for seq in random.sample(range(1, 80), 50 if run != "c" else 3)]
    want = {tuple(r) for r in RU.sequence_gaps(spark.createDataFrame([r[:2] for r in rows], "run_id string, seq long")).collect()}
    random.shuffle(rows)
    rows += rows[:20]  # repeats change nothing
    batches = [spark.createDataFrame(rows[k::5], "run_id string, seq long, s long").selectExpr("run_id", "seq", "timestamp_seconds(s) AS at") for k in range(5)]
    changes = streamed(spark, tmp_path, batches, EVENT, ST.detect_gaps)
    assert {tuple(r) for r in ST.current_gaps(changes).collect()} == want
    assert changes.filter("change < 0").count() > 0


def test_an_idle_run_is_forgotten(spark, tmp_path):
    day = 86_400
    steps = [[("a", 1, 0), ("a", 3, 0)], [("b", 1, 5 * day)], [("b", 2, 6 * day)], [("a", 9, 6 * day), ("a", 11, 6 * day)]]
    batches = [spark.createDataFrame(s, "run_id string, seq long, s long").selectExpr("run_id", "seq", "timestamp_seconds(1700000000 + s) AS at") for s in steps]
    changes = streamed(spark, tmp_path, batches, EVENT, ST.detect_gaps)
    assert sorted(tuple(r) for r in changes.collect()) == [("a", 1, 3, 1), ("a", 9, 11, 1)]  # 3 to 9 is no gap: the run began anew


def files_of(path):
    return {str(p.relative_to(path)): p.stat().st_size for p in path.rglob("*.parquet")}


@pytest.mark.parametrize("policy", ["replace", "keep", "coalesce", "add"])
def test_folded_batches(spark, tmp_path, policy):
    random.seed(3)
    table, put = {}, ST.fold_into(str(tmp_path), ["k"], policy, most_epochs=3)
    for epoch in range(8):
        rows = [(k, random.choice([None, random.randint(0, 9)]), random.randint(0, 9)) for k in random.sample(range(12), 6)]
        batch = spark.createDataFrame(rows, "k int, x int, epoch long")
        put(batch, epoch)
        if epoch in (1, 5):
            put(batch, epoch)  # a repeated batch changes nothing, folded or not
        for k, *new in rows:
            old = table.get(k)
            table[k] = {"replace": new, "keep": old or new, "coalesce": [b if b is not None else a for a, b in zip(old or new, new, strict=True)], "add": [(a or 0) + (b or 0) for a, b in zip(old or [0, 0], new, strict=True)]}[policy]
        got = {r["k"]: [r["x"], r["epoch"]] for r in ST.folded(spark, str(tmp_path), ["k"], policy).collect()}
        assert got == table
    assert len([p for p in tmp_path.iterdir() if p.is_dir()]) <= 3  # what is folded is removed


def test_a_small_batch_writes_little(spark, tmp_path):
    rows = spark.range(100_000).selectExpr("id AS k", "uuid() AS v")
    put = ST.fold_into(str(tmp_path), ["k"])
    put(rows, 0)
    whole = sum(files_of(tmp_path).values())
    put(rows.filter("k % 100 = 7").selectExpr("k", "'new' AS v"), 1)
    assert sum(files_of(tmp_path).values()) - whole < whole / 50
    found = ST.folded(spark, str(tmp_path), ["k"])
    assert found.count() == 100_000 and found.filter("v = 'new'").count() == 1000


def test_an_unfinished_fold_is_not_read(spark, tmp_path):
    put = ST.fold_into(str(tmp_path), ["k"], "add", most_epochs=2)
    one = spark.createDataFrame([(1, 5)], "k int, v int")
    for epoch in range(2):
        put(one, epoch)
    one.write.parquet(f"{tmp_path}/upto=9")
    (tmp_path / "upto=9/_SUCCESS").unlink()
    put(one, 2)
    assert [tuple(r) for r in ST.folded(spark, str(tmp_path), ["k"], "add").collect()] == [(1, 15)]
    with pytest.raises(ValueError):
        ST.folded(spark, str(tmp_path), ["k"], "no")


@pytest.mark.parametrize("hot", [False, True])
def test_numbers_of_large_groups(spark, hot):
    random.seed(8)
    rows = [(random.choice([None, "a", "b"]) if not hot else "a", random.choice([None, *range(40)]), k) for k in range(3000)]
    events = spark.createDataFrame(rows, "run_id string, at int, event_id long").selectExpr("*", "1 AS seq", "2 AS part", "3 AS own", "4 AS first").repartition(6)
    want, last = {}, {}
    for run, at, k in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        want[k] = last[run] = last.get(run, 0) + 1
    found = RU.assign_sequence(events)
    assert {r["event_id"]: r["seq"] for r in found.collect()} == want
    assert sorted(found.columns) == sorted(events.columns)


def test_gaps_of_a_large_run(spark):
    random.seed(9)
    kept = sorted(random.sample(range(100_000), 60_000))
    gaps = RU.sequence_gaps(spark.createDataFrame([("r", s) for s in kept], "run_id string, seq long").repartition(7))
    assert {(r["after"], r["seq"]) for r in gaps.collect()} == {(a, b) for a, b in zip(kept, kept[1:], strict=False) if b - a > 1}


class _Handle:
    """State of one run, in memory; calls are counted."""

    def __init__(self):
        self.calls, self.value, self.list = 0, None, []

    def getValueState(self, *_):
        return self

    def getListState(self, *_):
        return type("List", (), {"get": lambda _: iter(self.list), "put": lambda _, x: self._call(self.list.clear, lambda: self.list.extend(x)), "appendValue": lambda _, x: self._call(lambda: self.list.append(x)), "clear": lambda _: self._call(self.list.clear)})()

    def _call(self, *steps):
        self.calls += 1
        for step in steps:
            step()

    def get(self):
        return self.value

    def update(self, value):
        self._call(lambda: setattr(self, "value", value))

    def registerTimer(self, _):
        self.calls += 1

    deleteTimer = registerTimer


def test_gaps_cost_calls_of_the_state_for_each_batch_not_for_each_gap():
    for seed in range(40):
        chance, handle, seen, change = random.Random(seed), _Handle(), set(), {}
        gaps = ST._Gaps(1000)
        gaps.init(handle)
        for _ in range(chance.randint(1, 8)):
            batch = [chance.randint(0, chance.choice([30, 400, 3000])) for _ in range(chance.choice([1, 5, 200]))]
            seen |= set(batch)
            before = handle.calls
            frames = [pd.DataFrame({"seq": batch[k::2], "ms": 5}) for k in range(2) if batch[k::2]]
            for out in gaps.handleInputRows(("r",), iter(frames), None):
                for run, after, seq, n in out.itertuples(index=False):
                    assert run == "r"
                    change[after, seq] = change.get((after, seq), 0) + n
            assert handle.calls - before <= 4
            known = sorted(seen)
            assert {k for k, n in change.items() if n} == {(a, b) for a, b in zip(known, known[1:], strict=False) if b - a > 1}
            assert set(change.values()) <= {0, 1}
        assert sum(len(e[0]) for e in handle.list) // 24 <= 2 * (len(seen) + 200)
