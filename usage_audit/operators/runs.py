"""Runs: their history, differences, events and stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import vocabulary as V
from .graph import cut
from .joins import unused


def _seconds(at: str):
    return F.col(at).cast("timestamp").cast("double")


def run_history(runs: DataFrame, verdicts: DataFrame, limit: int = 50) -> DataFrame:
    """The newest runs with their component and verdict counts and duration in seconds."""
    counts = verdicts.groupBy("run_id").agg(F.count("*").alias("components"), *[F.count_if(F.col("label") == k).alias(k.lower()) for k in (V.UNUSED, V.REVIEW, V.USED, V.OUT)])
    seconds = _seconds("finished_at") - _seconds("started_at")
    joined = runs.join(counts, "run_id", "left").na.fill(0, ["components", *(k.lower() for k in (V.UNUSED, V.REVIEW, V.USED, V.OUT))])
    return joined.withColumn("seconds", seconds).orderBy(F.desc("started_at"), "run_id").limit(limit)


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run of each org."""
    return runs.withColumn("__n", F.row_number().over(W.partitionBy("org_id").orderBy(F.desc("started_at"), F.desc("run_id")))).filter("__n = 1").drop("__n")


def superseded_runs(runs: DataFrame) -> DataFrame:
    """(run_id, later): how many later runs of its org there are."""
    order = W.partitionBy("org_id").orderBy(F.col("started_at").desc())
    return runs.select("run_id", "org_id", (F.rank().over(order) - 1).cast("long").alias("later"))


def run_snapshot(runs: DataFrame, stages: DataFrame, verdicts: DataFrame, events: DataFrame) -> DataFrame:
    """One row a run: its columns, stage states, verdict counts, and the sequence number that this holds for."""
    s = stages.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "state")))).alias("stages"))
    v = verdicts.groupBy("run_id", "label").count().groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "count")))).alias("verdicts"))
    return runs.join(s, "run_id", "left").join(v, "run_id", "left").join(events.groupBy("run_id").agg(F.max("seq").alias("as_of_seq")), "run_id", "left")


def stage_durations(stages: DataFrame) -> DataFrame:
    return stages.select("run_id", "stage", F.round(_seconds("finished_at") - _seconds("started_at"), 3).alias("seconds"))


def _dealt(rows: DataFrame, group: str, order: list[str], at: str) -> tuple[DataFrame, DataFrame]:
    """`rows`, written in order of (group, order) by ranges, so that a group of any size lies in many parts; and the parts of
    each group: (group, part, first, n, before), with the rows of the group in earlier parts.

    Column `at` numbers the rows in that order: the part in the high bits, the place in it in the 33 low ones.
    """
    columns = [F.col(c).asc_nulls_first() for c in (group, *order)]
    rows = cut(rows.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn(at, F.monotonically_increasing_id()), "ordered")
    parts = rows.groupBy(group, F.shiftright(at, 33).alias("part")).agg(F.min(at).alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy(group).orderBy("part")) - F.col("n")  # a row for each part that the group lies in
    return rows, parts.withColumn("before", before)


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """`rows` with column `name`: 1, 2, 3 and so on in each `group`, in `order`, nulls first; no task holds a whole group."""
    at, own, part = unused("at", rows), unused("own", rows), unused("part", rows)
    rows, parts = _dealt(rows, group, order, at)
    parts = parts.select(F.col(group).alias(own), F.col("part").alias(f"{part}_of"), (F.col("first") - F.col("before") - 1).alias(f"{at}_from"))
    joined = rows.withColumn(part, F.shiftright(at, 33)).join(parts, F.col(group).eqNullSafe(F.col(own)) & (F.col(part) == F.col(f"{part}_of")))
    return joined.withColumn(name, F.col(at) - F.col(f"{at}_from")).drop(at, f"{at}_from", own, part, f"{part}_of")


def assign_sequence(events: DataFrame, order: str = "at", tie: str = "event_id") -> DataFrame:
    """`events` with seq, gapless from 1 in each run, in order of time."""
    return numbered(events.drop("seq"), "run_id", [order, tie], "seq")


def sequence_gaps(events: DataFrame) -> DataFrame:
    """(run_id, after, seq): where seq jumps by more than one.

    A run lies in many parts by ranges of seq; before a part's first number comes the last of the part before it.
    """
    rows, _ = _dealt(events.select("run_id", "seq"), "run_id", ["seq"], "at")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    inside = F.lag("seq").over(W.partitionBy("run_id", "part").orderBy("at"))
    ends = rows.groupBy("run_id", "part").agg(F.min("seq").alias("seq"), F.max("seq").alias("last"))
    between = ends.select("run_id", F.lag("last").over(W.partitionBy("run_id").orderBy("part")).alias("after"), "seq")
    return rows.select("run_id", inside.alias("after"), "seq").unionByName(between).filter(F.col("seq") - F.col("after") > 1)


def compare_runs(base: DataFrame, head: DataFrame) -> DataFrame:
    """(ctype, api_name, before, after, change): what differs; regression is UNUSED to USED."""
    b, h = base.select("ctype", "api_name", F.col("label").alias("before")), head.select("ctype", "api_name", F.col("label").alias("after"))
    joined = b.join(h, ["ctype", "api_name"], "full").filter(~F.col("before").eqNullSafe(F.col("after")))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when((F.col("before") == V.UNUSED) & (F.col("after") == V.USED), "regression").otherwise("changed")
    return joined.withColumn("change", change)


def fold_stage_state(snapshot: DataFrame, events: DataFrame) -> DataFrame:
    """(run_id, stage, state, note, progress): the latest event of each stage on top of the snapshot."""
    both = snapshot.select("run_id", "stage", F.lit(-1).cast("long").alias("seq"), "state", "note", "progress").unionByName(events.select("run_id", "stage", "seq", "state", "note", "progress"))
    return both.groupBy("run_id", "stage").agg(F.max_by(F.struct("state", "note", "progress"), "seq").alias("x")).select("run_id", "stage", "x.*")
