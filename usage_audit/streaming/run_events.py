"""Run events as streams: an append-only log, read on from a cursor.

The source is a folder of files; the query's checkpoint is the cursor. State is a few numbers for each run or stage, and
goes when nothing has come for `idle`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import events as E
from ..operators.graph import folder_of, remove
from ..operators.joins import unused

EVENT = "run_id string, seq long, at timestamp, stage string, kind string, state string, note string, progress double"


def tail_events(spark: SparkSession, path: str, schema: str = EVENT, from_seq: int = 0) -> DataFrame:
    """Events of `path` after `from_seq`, those to come included."""
    return spark.readStream.schema(schema).parquet(path).filter(F.col("seq") > from_seq)


def dedupe_replays(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (run_id, seq) once; numbers are remembered for `late` of event time."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["run_id", "seq"])


def _ordered(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """A group's rows of one micro-batch in order; maxFilesPerTrigger at the source bounds them."""
    return pd.concat(list(batches)).sort_values(by)


def _still_open(changes: np.ndarray) -> np.ndarray:
    """The (after, seq) of rows (after, seq, change) whose changes add up to one, in ascending order."""
    changes = changes[np.lexsort((changes[:, 1], changes[:, 0]))]
    first = np.flatnonzero(np.append(True, (changes[1:, :2] != changes[:-1, :2]).any(1))) if len(changes) else np.zeros(0, np.int64)
    return changes[first][np.add.reduceat(changes[:, 2], first) > 0, :2] if len(changes) else changes[:, :2]


def _gaps_between(edge: np.ndarray) -> np.ndarray:
    """(after, seq) of the gaps between ascending numbers."""
    wide = np.flatnonzero(np.diff(edge) > 1)
    return np.stack((edge[wide], edge[wide + 1]), 1)


class _Gaps(StatefulProcessor):
    """The open gaps of each run; a timer forgets a run that is idle.

    They are kept as a list of changes, each entry those of one batch, as bytes of (after, seq, change): a call of the
    state for each gap would cost more than its rows. The list is read where a number falls between known ones, and put
    together when less than half of it is still open.
    """

    #: Changes of an entry at most.
    ENTRY = 16_384

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "first long, last long, until long")
        self.open = handle.getListState("open", "changes binary")

    def _keep(self, changes: np.ndarray, instead: bool) -> None:
        for at in range(0, len(changes), self.ENTRY):
            entry = (changes[at : at + self.ENTRY].tobytes(),)
            if instead and not at:
                self.open.put([entry])
            else:
                self.open.appendValue(entry)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batches = list(rows)  # a run's rows of one micro-batch; maxFilesPerTrigger at the source bounds them
        seqs = np.unique(np.concatenate([b["seq"].to_numpy(np.int64) for b in batches]))
        newest = max(int(b["ms"].max()) for b in batches) + self.idle_ms
        first, last, until = self.known.get() or (int(seqs[0]), int(seqs[0]), 0)
        # before all and after all that is known, the new numbers leave gaps between them
        opened = [_gaps_between(np.append(seqs[seqs < first], first)), _gaps_between(np.append(last, seqs[seqs > last]))]
        closed, kept = np.zeros((0, 2), np.int64), None
        inside = seqs[(seqs > first) & (seqs < last)]
        if len(inside):
            kept = np.concatenate([np.zeros((0, 3), np.int64), *[np.frombuffer(e[0], np.int64).reshape(-1, 3) for e in self.open.get()]])
            gaps = _still_open(kept)
            at = np.searchsorted(gaps[:, 0], inside, "left") - 1
            fits = at >= 0
            fits[fits] = inside[fits] < gaps[at[fits], 1]
            closed = gaps[np.unique(at[fits])]
            # the ends of what closes and the numbers within; what one gap ends with and the next begins with isn't a gap
            cuts = np.unique(np.concatenate((closed.ravel(), inside[fits])))
            pieces = _gaps_between(cuts)
            within = np.searchsorted(closed[:, 0], pieces[:, 0], "right") - 1
            opened.append(pieces[pieces[:, 1] <= closed[within, 1]] if len(closed) else pieces)
        opened = np.concatenate(opened)
        changes = np.concatenate((np.insert(closed, 2, -1, 1), np.insert(opened, 2, 1, 1)))
        if kept is not None and len(kept) + len(changes) > 2 * (len(gaps) - len(closed) + len(opened)):
            left = np.insert(_still_open(np.concatenate((kept, changes))), 2, 1, 1)
            if len(left):
                self._keep(left, True)
            else:
                self.open.clear()
        else:
            self._keep(changes, False)
        if newest > until:
            if until:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(newest)
        self.known.update((min(first, int(seqs[0])), max(last, int(seqs[-1])), max(until, newest)))
        if len(changes):
            yield pd.DataFrame({"run_id": key[0], "after": changes[:, 0], "seq": changes[:, 1], "change": changes[:, 2].astype(np.int32)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.known.clear()
        self.open.clear()
        return iter(())

    def close(self) -> None:
        pass


def detect_gaps(events: DataFrame, idle: str = "1 day") -> DataFrame:
    """(run_id, after, seq, change): a gap between two numbers of a run opens (1), and closes (-1) when a later row, of
    any batch, falls into it; what is left of it opens. current_gaps() sums them up.

    Numbers may come in any order; rows without number or time are left out. A run's state goes when the watermark over `at` is `idle` past its newest event; it is
    kept in RocksDB, since maps of state need that.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    keyed = events.filter("seq is not null and at is not null").withWatermark("at", idle).select("run_id", "seq", "at", F.unix_millis("at").alias("ms")).groupBy("run_id")
    return keyed.transformWithStateInPandas(_Gaps(idle_ms), "run_id string, after long, seq long, change int", "Append", "EventTime")


def current_gaps(changes: DataFrame) -> DataFrame:
    """(run_id, after, seq) of the gaps that are open after all `changes`, which may come in any order."""
    return changes.groupBy("run_id", "after", "seq").agg(F.sum("change").alias("n")).filter("n > 0").drop("n")


#: Stages are dealt over so many groups of state: one call of Python serves all stages of a group that a batch touches.
STAGE_GROUPS = 4096


def _throttled(group: pd.DataFrame, known: dict[tuple, tuple[float, int]], interval: float, idle_ms: int) -> list[bool]:
    """Which of the rows, ordered by stage, time and number, pass; `known` (last passed, forgotten at) is brought up to date."""
    keep, now, last, until = [], None, 0.0, 0
    stamps = group["at"].astype("datetime64[us]").astype("int64").to_numpy()
    for run, stage, us, progress in zip(group["run_id"], group["stage"], stamps.tolist(), group["progress"], strict=True):
        if (run, stage) != now:
            if now is not None:
                known[now] = last, until
            now = run, stage
            last, until = known.get(now, (float("-inf"), 0))
        at = us / 1e6
        passes = progress >= 1 or at - last >= interval
        keep.append(passes)
        last, until = at if passes else last, max(until, us // 1000 + idle_ms)
    if now is not None:
        known[now] = last, until
    return keep


def throttle_progress(events: DataFrame, interval: float = 0.4, idle: str = "1 day", groups: int = STAGE_GROUPS) -> DataFrame:
    """At most one progress event of each stage in `interval` seconds of event time; the final one (progress 1) always
    passes. State goes as in `detect_gaps`.

    A stage's state is two numbers; those of many stages are kept together, dealt by hash over `groups` groups, since a
    call of Python for each stage costs more than its rows.
    """

    def one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs, stages, lasts, untils = state.get if state.exists else ([], [], [], [])
        known = {(r, s): (a, u) for r, s, a, u in zip(runs, stages, lasts, untils, strict=True) if u > state.getCurrentWatermarkMs()}
        if not state.hasTimedOut:
            rows = _ordered(batches, ["run_id", "stage", "at", "seq"])
            kept = rows[_throttled(rows, known, interval, idle_ms)]
            if len(kept):
                yield kept[["run_id", "seq", "at", "stage", "progress"]]
        if not known:
            state.remove()
            return
        state.update(([k[0] for k in known], [k[1] for k in known], [v[0] for v in known.values()], [v[1] for v in known.values()]))
        state.setTimeoutTimestamp(max(min(v[1] for v in known.values()), state.getCurrentWatermarkMs() + 1))

    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    progress = events.filter("kind = 'progress'").withWatermark("at", idle)
    dealt = progress.select("run_id", "seq", "at", "stage", "progress", F.pmod(F.xxhash64("run_id", "stage"), F.lit(groups)).alias("group"))
    return dealt.groupBy("group").applyInPandasWithState(one, "run_id string, seq long, at timestamp, stage string, progress double", "runs array<string>, stages array<string>, lasts array<double>, untils array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def streaming_event_hits(logs: DataFrame) -> DataFrame:
    """Hits by (bucket, key), kept up to date as log rows come: in output mode update fold_into() keeps the table."""
    e = E.normalised_events(logs)
    return e.groupBy("bucket", "key").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in E.KINDS], F.count("*").alias("total"), F.max("seen").alias("last_seen"))


def _stored(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """Of the table under `path`: the last complete fold, if any, and the epochs after it."""
    fs, names = folder_of(spark, path)
    whole = lambda name: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS"))
    folds = [int(n.removeprefix("upto=")) for n in names if n.startswith("upto=") and whole(n)]
    upto = max(folds, default=None)
    epochs = [int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch=") and whole(n)]
    return upto, sorted(e for e in epochs if upto is None or e > upto)


def folded(spark: SparkSession, path: str, keys: list[str], policy: str = "replace") -> DataFrame:
    """The table that fold_into() keeps under `path`: a row for each of `keys`.

    replace: the row of the latest batch; keep: that of the first; coalesce: of each column the latest value that isn't
    null; add: the sum of each column, nulls as 0.
    """
    if policy not in ("replace", "keep", "coalesce", "add"):
        raise ValueError(f"no such policy: {policy}")
    upto, epochs = _stored(spark, path)
    parts = [(f"{path}/upto={upto}", upto)] * (upto is not None) + [(f"{path}/epoch={e}", e) for e in epochs]
    if not parts:
        raise ValueError(f"nothing is stored in {path}")
    schema = spark.read.parquet(parts[0][0]).schema
    at = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:upto|epoch)=(\d+)/[^/]*$", 1).cast("long")
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*[p for p, _ in parts])
    epoch = unused("epoch", rows)
    rows = rows.withColumn(epoch, at)
    others = [c for c in schema.names if c not in keys]
    if policy == "add":
        aggs = [F.sum(F.coalesce(F.col(c), F.lit(0))).cast(schema[c].dataType).alias(c) for c in others]
    elif policy == "coalesce":
        aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(epoch))).alias(c) for c in others]
    else:
        pick = F.max_by if policy == "replace" else F.min_by
        return rows.groupBy(*keys).agg(pick(F.struct(*others), epoch).alias(epoch)).select(*keys, *[F.col(f"{epoch}.{c}").alias(c) for c in others])
    return rows.groupBy(*keys).agg(*aggs)


def fold_into(path: str, keys: list[str], policy: str = "replace", most_epochs: int = 16):
    """A foreachBatch function that keeps a table of `keys` under `path`; folded() reads it.

    A batch writes its own rows and nothing else, into a folder of its own: a repeated batch replaces that, so that sums
    aren't added twice either. After `most_epochs` batches they are folded with all before them into one folder, and
    what it holds is removed; a reader counts only complete folds and the batches after the last of them. Keys within a
    batch are unique.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        upto, epochs = _stored(spark, path)
        if upto is not None and epoch <= upto:
            return  # a repeated batch that is folded already
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/epoch={epoch}")
        if len({*epochs, epoch}) < most_epochs:
            return
        folded(spark, path, keys, policy).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/upto={epoch}")
        for name in folder_of(spark, path)[1]:
            kind, _, n = name.partition("=")
            if (kind == "epoch" and int(n) <= epoch) or (kind == "upto" and int(n) < epoch):
                remove(spark, f"{path}/{name}")

    return put
