"""Usage-event logs rolled up to hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import vocabulary as V
from ..functions import text as T
from .joins import unused

#: Rows that a task sums at once, and groups of tasks whose sums are joined first.
HELD, PARTS = 200_000, 64
KINDS = ("execution", "trigger", "callout", "ui", "object", "field", "rest")
#: The columns of a log that are read.
COLUMNS = "EVENT_TYPE TIMESTAMP_DERIVED TIMESTAMP LOGDATE APEX_CLASS_NAME CLASS_NAME APEX_METHOD_NAME METHOD_NAME ENTRY_POINT TRIGGER_NAME OPERATION_TYPE TRIGGER_TYPE URI URL PAGE_ENTITY_TYPE COMPONENT_NAME TARGET_UI_ELEMENT PARENT_UI_ELEMENT ENTITY_NAME QUERY QUERY_IDENTIFIER KEY_PREFIX DML_TYPE".split()


def normalised_events(logs: DataFrame, hint: str | None = None) -> DataFrame:
    """(bucket, key, kind, seen, sample): what each log row says was used. Columns that `logs` lacks count as null."""
    have = {c.upper(): c for c in logs.columns}
    col = {c: T.empty_to_null(F.col(f"`{have[c]}`").cast("string")) if c in have else F.lit(None).cast("string") for c in COLUMNS}
    either = lambda *names: F.coalesce(*[col[n] for n in names])
    event = F.lower(F.coalesce(col["EVENT_TYPE"], F.col(hint) if hint else F.lit(""), F.lit("")))
    cls, meth, trig = either("APEX_CLASS_NAME", "CLASS_NAME"), either("APEX_METHOD_NAME", "METHOD_NAME"), col["TRIGGER_NAME"]

    def hit(bucket: str, key: Column, kind: str, sample: Column, when: Column | bool = True) -> Column:
        made = F.struct(F.lit(bucket).alias("bucket"), F.lower(key).alias("key"), F.lit(kind).alias("kind"), sample.alias("sample"))
        return F.when(F.lit(True) if when is True else when, F.when(F.coalesce(key, F.lit("")) != "", made))

    def several(bucket: str, keys: Column, kind: str, sample) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(bucket).alias("bucket"), F.lower(k).alias("key"), F.lit(kind).alias("kind"), sample(k).alias("sample")))

    dotted = lambda c, m: F.concat_ws(".", c, F.nullif(m, F.lit("")))
    # a column of its own: what is named often below would be parsed as often
    name = unused("parsed", logs)
    logs, parsed = logs.withColumn(name, F.when(event.contains("apexexecution"), T.parse_entry_point(col["ENTRY_POINT"]))), F.col(name)
    is_class, is_trigger = cls.isNotNull() | (parsed["kind"] == "class"), cls.isNull() & (parsed["kind"] == "trigger")
    run_class = F.coalesce(cls, F.when(parsed["kind"] == "class", parsed["name"]))
    run_method = F.nullif(F.when(cls.isNotNull(), meth).otherwise(parsed["detail"]), F.lit(""))
    execution = F.array(
        hit("class", run_class, "execution", dotted(run_class, run_method), is_class), hit("method", F.concat(run_class, F.lit("."), run_method), "execution", dotted(run_class, run_method), is_class),
        hit("trigger", parsed["name"], "trigger", F.concat_ws(":", parsed["name"], F.nullif(parsed["detail"], F.lit(""))), is_trigger),
    )
    uri = either("URI", "URL")
    called = F.concat_ws(" > ", dotted(cls, meth), F.substring(uri, 1, 60))
    callout = F.array(hit("class", cls, "callout", called), hit("method", F.concat(cls, F.lit("."), meth), "callout", called))
    entity = lambda c, what: hit("object", F.when(T.is_custom_object(c), c), "object", F.concat(F.lit(f"{what}:"), c))
    plain = lambda c: F.when(~c.contains(";") & ~c.contains(":"), c)
    elements = ("COMPONENT_NAME", "TARGET_UI_ELEMENT", "PARENT_UI_ELEMENT")
    said_of = lambda what: lambda k: F.concat(F.lit(f"{what}:"), k)
    interaction = F.concat(
        F.array(entity(col["PAGE_ENTITY_TYPE"], "interaction"), *[entity(plain(col[e]), e.lower()) for e in elements]),
        *[several("ui", T.ui_component_names(col[e]), "ui", said_of(e.lower())) for e in elements],
    )

    def soql(query: Column, what: str) -> Column:
        return F.concat(several("object", T.soql_objects(query), "object", lambda k: F.concat(F.lit(f"{what}:FROM "), k)), several("field", T.soql_fields(query), "field", lambda k: F.concat(F.lit(f"{what}:"), k)))

    prefix = F.array(hit("key_prefix", col["KEY_PREFIX"], "object", F.concat(F.lit("dml:"), F.coalesce(col["DML_TYPE"], F.lit("?")), F.lit(":"), col["KEY_PREFIX"])))
    path = F.array(hit("rest_path", T.rest_path_token(col["URI"]), "rest", F.substring(col["URI"], 1, 80)))
    trigger = F.array(hit("trigger", trig, "trigger", F.concat_ws(":", trig, either("OPERATION_TYPE", "TRIGGER_TYPE"))))
    classic = F.array(hit("class", cls, "execution", cls), hit("trigger", trig, "trigger", trig))
    said = (  # the order matters: names contain one another
        F.when(event.contains("apexexecution"), execution).when(event.contains("apextrigger"), trigger).when(event.contains("apexcallout"), callout).when(event.contains("apexrestapi"), path)
        .when(event.contains("lightninginteraction"), interaction).when(event.contains("lightningpageview"), F.array(entity(col["PAGE_ENTITY_TYPE"], "page")))
        .when(event.contains("restapi"), F.concat(F.array(entity(col["ENTITY_NAME"], "rest")), soql(col["QUERY"], "restapi"))).when(event.contains("uniquequery"), soql(either("QUERY_IDENTIFIER", "QUERY"), "uniquequery"))
        .when(event.contains("databasesave"), prefix).otherwise(classic)
    )
    return logs.select(either("TIMESTAMP_DERIVED", "TIMESTAMP", "LOGDATE").alias("seen"), F.explode(F.array_compact(said)).alias("h")).select("h.bucket", "h.key", "h.kind", "seen", "h.sample")


def _reduced(rows: pa.Table, samples: int) -> pa.Table:
    """Counts and last times by (bucket, key, kind, sample); of each key the `samples` smallest samples stay, others become null."""
    names = ["bucket", "key", "kind", "sample"]
    t = rows.group_by(names, use_threads=False).aggregate([("n", "sum"), ("seen", "max")]).select([*names, "n_sum", "seen_max"]).rename_columns([*names, "n", "seen"])
    t = t.sort_by([(c, "ascending") for c in ("bucket", "key", "sample")]).combine_chunks()  # nulls last
    begins = {c: np.ones(t.num_rows, bool) for c in ("bucket", "key", "sample")}
    for c, new in begins.items():
        v = t.column(c)
        new[1:] = ~pc.fill_null(pc.equal(v[1:], v[:-1]), False).to_numpy() if t.num_rows > 1 else new[1:]
    group = begins["bucket"] | begins["key"]
    place = np.cumsum(group | begins["sample"])
    place -= np.repeat(place[group], np.diff(np.flatnonzero(group), append=t.num_rows))
    kept = pc.if_else(pa.array(place < samples), t.column("sample"), pa.scalar(None, pa.string()))
    return t.set_column(3, "sample", kept)


def _partial(samples: int):
    """A task's rows in few: at most `samples` + 1 of each key and kind for about HELD rows read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n, known = TaskContext.get().partitionId() % PARTS, [], 0, 0

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from table.append_column("part", pa.repeat(pa.scalar(part, pa.int32()), table.num_rows)).to_batches()

        for batch in batches:
            held.append(pa.Table.from_batches([batch]).append_column("n", pa.repeat(pa.scalar(1, pa.int64()), batch.num_rows)).select(["bucket", "key", "kind", "sample", "n", "seen"]))
            n += batch.num_rows
            if n - known >= HELD:
                held = [_reduced(pa.concat_tables(held), samples)]
                n = known = held[0].num_rows
                if known >= HELD // 2:  # keys that hardly repeat go on
                    yield from out(held[0])
                    held, n, known = [], 0, 0
        if held:
            yield from out(_reduced(pa.concat_tables(held), samples))

    return run


def event_hits(events: DataFrame, samples: int = 3) -> DataFrame:
    """One row for each (bucket, key) of normalised events: counts by kind, total, last_seen, samples.

    Of each key the `samples` smallest distinct samples stay. Each task sums its rows and keeps as many samples of a key
    before anything is shuffled, and sums of up to PARTS groups of tasks are made before the last one, so that a key that
    all tasks have is no large group either.
    """
    rows = events.select("bucket", "key", "kind", "sample", "seen")
    parts = rows.mapInArrow(_partial(samples), "bucket string, key string, kind string, sample string, n long, seen string, part int")
    sums = {**{f"{k}s": F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)) for k in KINDS}, "total": F.sum("n")}
    first = lambda found: F.slice(F.array_sort(found), 1, samples).alias("samples")
    some = parts.groupBy("bucket", "key", "part").agg(*[v.alias(c) for c, v in sums.items()], F.max("seen").alias("last_seen"), first(F.collect_set("sample")))
    return some.groupBy("bucket", "key").agg(*[F.sum(c).alias(c) for c in sums], F.max("last_seen").alias("last_seen"), first(F.array_distinct(F.flatten(F.collect_list("samples")))))


def sample_values(df: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """(keys, samples): the n smallest distinct values of each key, sorted."""
    distinct = df.select(*keys, F.col(value).alias("v")).distinct()
    first = distinct.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy("v"))).filter(F.col("n") <= n)
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list("v")).alias("samples"))


def merge_event_hits(a: DataFrame, b: DataFrame, samples: int = 3) -> DataFrame:
    """Two rollups as one: counts add, the last is the later, source is mixed where both have the key."""
    sums = [f"{k}s" for k in KINDS] + ["total"]
    both = a.withColumn("__s", F.coalesce(F.col("source"), F.lit("a")) if "source" in a.columns else F.lit("a")).unionByName(b.withColumn("__s", F.coalesce(F.col("source"), F.lit("b")) if "source" in b.columns else F.lit("b")), allowMissingColumns=True)
    merged = both.groupBy("bucket", "key").agg(*[F.sum(c).alias(c) for c in sums], F.max("last_seen").alias("last_seen"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("samples")))), 1, samples).alias("samples"), F.countDistinct("__s").alias("n"), F.min("__s").alias("one"))
    return merged.withColumn("source", F.when(F.col("n") > 1, "mixed").otherwise(F.col("one"))).drop("n", "one")


def async_runs(jobs: DataFrame) -> DataFrame:
    """(class_key, runs) by the first 15 characters of the class id, in lower case."""
    return jobs.groupBy(F.lower(F.substring("class_id", 1, 15)).alias("class_key")).agg(F.sum("runs").alias("runs"))


def match_runtime(components: DataFrame, hits: DataFrame, runs: DataFrame, scheduled: DataFrame) -> DataFrame:
    """Evidence of runtime use, with a miss for each component that has none.

    `components`: id, ctype, api_name, parent_object, sf_id, key_prefix; `hits`: event_hits(); `runs`: async_runs();
    `scheduled`: class_name. Classes are looked up by name, then by the REST paths they may serve; objects by name, then
    by key prefix; fields by their name without the object.
    """
    own = F.lower("api_name")
    last = F.element_at(F.split(own, r"\."), -1)
    keys = (
        F.when(F.col("ctype") == V.CLASS, F.concat(F.array(F.struct(F.lit("class").alias("bucket"), own.alias("key"))), F.transform(T.rest_path_keys("api_name"), lambda k: F.struct(F.lit("rest_path").alias("bucket"), k.alias("key")))))
        .when(F.col("ctype") == V.TRIGGER, F.array(F.struct(F.lit("trigger").alias("bucket"), own.alias("key"))))
        .when(F.col("ctype") == V.METHOD, F.array(F.struct(F.lit("method").alias("bucket"), own.alias("key"))))
        .when(F.col("ctype").isin(*V.UI_TYPES), F.array(F.struct(F.lit("ui").alias("bucket"), own.alias("key"))))
        .when(F.col("ctype") == V.OBJECT, F.array(F.struct(F.lit("object").alias("bucket"), own.alias("key")), F.struct(F.lit("key_prefix").alias("bucket"), F.lower(F.coalesce("key_prefix", F.lit(""))).alias("key"))))
        .when(F.col("ctype") == V.FIELD, F.array(F.struct(F.lit("field").alias("bucket"), last.alias("key"))))
    )
    asked = components.select("id", F.posexplode(keys).alias("priority", "k")).select("id", "priority", "k.*")
    best = asked.join(hits.filter("total > 0"), ["bucket", "key"]).groupBy("id").agg(F.min_by(F.struct("bucket", "key", "total", "last_seen", "samples"), "priority").alias("hit"))
    sid = F.when(F.col("ctype") != V.METHOD, F.lower(F.substring("sf_id", 1, 15)))
    joined = components.join(best, "id", "left").withColumn("class_key", sid).join(runs, "class_key", "left")
    crons = scheduled.select(F.lower("class_name").alias("__cron")).distinct()
    joined = joined.join(crons, (F.col("ctype") == V.CLASS) & (F.col("__cron") == own), "left")
    log = F.col("hit").isNotNull()
    found = log | F.col("runs").isNotNull() | F.col("__cron").isNotNull()
    code = F.col("ctype").isin(*V.CODE_TYPES)
    payload = F.to_json(F.struct(F.col("api_name").alias("entity_name"), F.coalesce("runs", F.lit(0)).alias("async_runs"), F.col("__cron").isNotNull().alias("scheduled"), F.col("hit")))
    return joined.select(
        F.col("id").alias("component_id"), F.lit(V.RUNTIME).alias("collector_id"), F.when(found, V.HIT).otherwise(V.MISS).alias("result"), F.when(found, "B").alias("tier"),
        F.when(found & code & log, 0.95).when(found, 0.9).otherwise(0.0).alias("weight"), payload.alias("payload"),
    )
