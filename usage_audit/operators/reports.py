"""Summaries, report tables and listings of an audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import vocabulary as V
from ..functions import text as T
from .runs import numbered

LABEL_ORDER = (V.UNUSED, V.REVIEW, V.USED, V.OUT)


def label_rank(label: str = "label") -> Column:
    return F.coalesce(T.mapped(label, {k: str(n) for n, k in enumerate(LABEL_ORDER)}).cast("int"), F.lit(9))


def component_summary(components: DataFrame, verdicts: DataFrame, evidence: DataFrame, gaps: DataFrame, flags: DataFrame) -> DataFrame:
    """Per component its verdict and its counts of hits, clean and unclear checks, gaps and flags.

    Each child table is summed before it is joined, so two gaps don't double the evidence.
    """
    e = evidence.groupBy("component_id").agg(F.count_if(F.col("result") == V.HIT).alias("hits"), F.count_if(F.col("result") == V.MISS).alias("clean"), F.count_if(F.col("result") == V.UNCLEAR).alias("unclear"), F.count_if(F.col("result") == V.NOT_APPLICABLE).alias("not_applicable"))
    g = gaps.groupBy("component_id").agg(F.count("*").alias("gaps"))
    f = flags.groupBy("component_id").agg(F.count("*").alias("flags"))
    out = components.select(F.col("id").alias("component_id"), "ctype", "api_name").join(verdicts.select("component_id", "label", "confidence"), "component_id", "left")
    out = out.join(e, "component_id", "left").join(g, "component_id", "left").join(f, "component_id", "left")
    return out.na.fill(0, ["hits", "clean", "unclear", "not_applicable", "gaps", "flags"])


def verdict_totals(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("label").agg(F.count("*").alias("components"))


def verdicts_by_type(verdicts: DataFrame, components: DataFrame) -> DataFrame:
    """One row for each ctype with a column for each label."""
    joined = components.select(F.col("id").alias("component_id"), "ctype").join(verdicts.select("component_id", "label"), "component_id")
    return joined.groupBy("ctype").pivot("label", list(LABEL_ORDER)).count().na.fill(0)


def reason_frequencies(verdicts: DataFrame, top: int = 20) -> DataFrame:
    """The commonest reasons of what is under review; reasons count up to their first bracket."""
    said = verdicts.filter(F.col("label") == V.REVIEW).select(F.explode("reason_codes").alias("r")).select(F.trim(F.substring_index("r", "(", 1)).alias("reason"))
    return said.groupBy("reason").agg(F.count("*").alias("components")).orderBy(F.desc("components"), "reason").limit(top)


def removal_manifest(components: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(ctype, member): the names of UNUSED components by type, sorted by both; a row a member, as types can be huge."""
    joined = components.select(F.col("id").alias("component_id"), "ctype", F.col("api_name").alias("member")).join(verdicts.filter(F.col("label") == V.UNUSED).select("component_id"), "component_id", "left_semi")
    return joined.select("ctype", "member").orderBy("ctype", "member")


def evidence_detail(evidence: DataFrame, components: DataFrame, collector_runs: DataFrame) -> DataFrame:
    """One row for each component and collector, misses included, with what was searched."""
    out = evidence.join(components.select(F.col("id").alias("component_id"), "ctype", "api_name"), "component_id").join(collector_runs.select("collector_id", "status", "searched"), "collector_id", "left")
    return out.select("component_id", "ctype", "api_name", "collector_id", T.label_for("collector_id").alias("collector"), "result", "tier", "weight", "status", "searched")


def evidence_order(evidence: DataFrame) -> DataFrame:
    """`evidence` ranked within its component by result, then tier."""
    result = T.mapped("result", {V.HIT: "0", V.UNCLEAR: "1", V.MISS: "2", V.NOT_APPLICABLE: "3"}).cast("int")
    return evidence.withColumn("place", F.row_number().over(W.partitionBy("component_id").orderBy(result, F.col("tier").asc_nulls_last(), "collector_id")))


def component_list(summary: DataFrame, limit: int = 5000) -> DataFrame:
    return summary.orderBy(label_rank(), F.desc("confidence"), "api_name", "component_id").limit(limit)


def review_queue(summary: DataFrame, limit: int = 200) -> DataFrame:
    """What a person should look at: UNUSED first, then what needs review, the surest first."""
    return summary.filter(F.col("label").isin(V.UNUSED, V.REVIEW)).orderBy((F.col("label") == V.UNUSED).desc(), F.desc("confidence"), "api_name", "component_id").limit(limit)


def report_order(summary: DataFrame) -> DataFrame:
    return summary.orderBy((F.col("label") == V.UNUSED).desc(), "ctype", "api_name")


def removal_readiness(verdicts: DataFrame) -> DataFrame:
    """UNUSED components with the number of steps before removal, and whether one blocks; the readiest first."""
    steps = F.col("removal_prerequisites")
    return verdicts.filter(F.col("label") == V.UNUSED).select("component_id", "confidence", F.size(steps).alias("steps"), F.exists(steps, lambda s: s["blocking"]).alias("blocked")).orderBy("steps", F.desc("confidence"), "component_id")


def near_names(components: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """Did you mean: components whose name contains `name` in any case."""
    return components.filter(F.contains(F.lower("api_name"), F.lit(name.lower()))).select("id", "ctype", "api_name").orderBy(F.length("api_name"), "api_name", "id").limit(limit)


def filter_components(summary: DataFrame, labels: list[str] | None = None, ctypes: list[str] | None = None, contains: str | None = None) -> DataFrame:
    if labels:
        summary = summary.filter(F.col("label").isin(*labels))
    if ctypes:
        summary = summary.filter(F.col("ctype").isin(*ctypes))
    return summary.filter(F.contains(F.lower("api_name"), F.lit(contains.lower()))) if contains else summary


def grouped_search(components: DataFrame, term: str) -> DataFrame:
    """Classes whose name or any method's matches, and the methods to show: all if the class matches, else the matching ones."""
    said = F.contains(F.lower("api_name"), F.lit(term.lower()))
    classes, methods = components.filter(F.col("ctype") == V.CLASS), components.filter(F.col("ctype") == V.METHOD)
    by_name = classes.filter(said).select(F.col("id").alias("class_id"))
    hits = methods.filter(said).select(F.col("parent_id").alias("class_id"), F.col("id").alias("method_id"))
    shown = methods.select(F.col("parent_id").alias("class_id"), F.col("id").alias("method_id")).join(by_name, "class_id", "left_semi").unionByName(hits.join(by_name, "class_id", "left_anti"))
    kept = by_name.unionByName(hits.select("class_id")).distinct()
    return kept.join(shown, "class_id", "left")


def source_for_component(components: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, body, from_parent): a component's own body, else its parent's."""
    own = sources.select(F.col("component_id").alias("id"), F.col("body").alias("__own"))
    parent = sources.select(F.col("component_id").alias("parent_id"), F.col("body").alias("__parent"))
    joined = components.select("id", "parent_id").join(own, "id", "left").join(parent, "parent_id", "left")
    return joined.select("id", F.coalesce("__own", "__parent").alias("body"), (F.col("__own").isNull() & F.col("__parent").isNotNull()).alias("from_parent"))


def file_component_map(artifacts: DataFrame, components: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(path, label, components): components that each file defines, or whose parent it defines, by verdict."""
    named = components.select(F.col("id").alias("component_id"), F.explode(F.array_distinct(F.array_compact(F.array(F.lower("api_name"), F.lower("parent_object"))))).alias("name"))
    joined = artifacts.select("path", F.lower("member_name").alias("name")).join(named, "name").join(verdicts.select("component_id", "label"), "component_id")
    return joined.groupBy("path", "label").agg(F.countDistinct("component_id").alias("components"))


def unmapped_components(artifacts: DataFrame, components: DataFrame) -> DataFrame:
    """(ctype, components): components that no file defines."""
    names = artifacts.select(F.lower("member_name").alias("name")).distinct()
    own = components.select("id", "ctype", F.explode(F.array_distinct(F.array_compact(F.array(F.lower("api_name"), F.lower("parent_object"))))).alias("name"))
    mapped = own.join(names, "name", "left_semi").select("id").distinct()
    return components.join(mapped, "id", "left_anti").groupBy("ctype").agg(F.count("*").alias("components"))


def folder_rollup(file_counts: DataFrame) -> DataFrame:
    """(folder, label counts, dominant): `file_counts` (path, label, components) summed up to every ancestor folder.

    The root is "". The dominant verdict has the most components, ties in the order of labels.
    """
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    sums = file_counts.select(F.explode(folders).alias("folder"), "label", "components").groupBy("folder", "label").agg(F.sum("components").alias("n"))
    wide = sums.groupBy("folder").agg(*[F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0)).alias(k.lower()) for k in LABEL_ORDER], F.max_by("label", F.struct("n", (-label_rank()).alias("r"))).alias("dominant"))
    return wide


def reconcile_received(requested: DataFrame, received: DataFrame) -> DataFrame:
    """(metadata_type): types that were asked for and of which nothing came."""
    return requested.select("metadata_type").distinct().join(received.select("metadata_type").distinct(), "metadata_type", "left_anti")


# --- fixed values: what a probed capability means; of one that isn't listed for a state nothing is said ---------------------
CAPABILITIES = {
    ("has_event_logs", True): "runtime logs are read for the types that name components; others are skipped",
    ("has_event_logs", None): "it is not known whether runtime logs are available",
    ("has_dependency_api", False): "recorded dependencies are not available: nothing is checked against them",
    ("has_field_history", False): "no history of fields: a value written long ago looks like one of yesterday",
    ("has_code_coverage", False): "no code coverage is recorded",
}
NO_LOGS = ("no runtime logs came, but files of them are read: ", "runtime logs are not available: use by people and integrations can't be seen")
NAMED_LOGS, NAMED_OBJECTS = 5, 8


def coverage_caveats(collector_runs: DataFrame, capabilities: DataFrame) -> DataFrame:
    """(run_id, caveat): collectors that did not finish well, and what a run's capabilities leave unseen.

    `collector_runs`: run_id, collector_id, status; `capabilities`: run_id, the flags of CAPABILITIES (null: not probed),
    log_files and unavailable_objects (arrays of names), is_admin, run_as.
    """
    bad = collector_runs.filter("status != 'OK'").select("run_id", F.concat_ws(" ", T.label_for("collector_id"), F.concat(F.lit("is "), F.lower("status"))).alias("caveat"))
    names = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    first = lambda c, n: F.concat_ws(", ", F.slice(names(c), 1, n))
    files, hidden = F.size(names("log_files")), F.size(names("unavailable_objects"))
    more = F.when(files > NAMED_LOGS, F.concat(F.lit(" and "), (files - NAMED_LOGS).cast("string"), F.lit(" more"))).otherwise("")
    said = [F.when(~F.col("has_event_logs"), F.when(files > 0, F.concat(F.lit(NO_LOGS[0]), first("log_files", NAMED_LOGS), more)).otherwise(NO_LOGS[1]))]
    said += [F.when(F.col(c).eqNullSafe(F.lit(state)), text) for (c, state), text in CAPABILITIES.items()]
    sorted_ = F.concat_ws(", ", F.slice(F.array_sort(names("unavailable_objects")), 1, NAMED_OBJECTS))
    said.append(F.when(hidden > 0, F.concat(hidden.cast("string"), F.lit(" objects could not be read: "), sorted_, F.when(hidden > NAMED_OBJECTS, F.lit(" and more")).otherwise(F.lit("")))))
    said.append(F.when(~F.col("is_admin"), F.concat(F.lit("the user "), F.coalesce("run_as", F.lit("?")), F.lit(" is no administrator: what it can't see looks unused"))))
    return bad.unionByName(capabilities.select("run_id", F.explode(F.array_compact(F.array(*said))).alias("caveat"))).distinct()


def kind_buckets(classes: DataFrame, methods: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(kind, classes, class_unused, class_review, methods, method_unused, method_review) by role."""
    label = verdicts.select(F.col("component_id").alias("id"), "label")
    m = methods.select("id", "parent_id").join(label, "id").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("m"), F.count_if(F.col("label") == V.UNUSED).alias("mu"), F.count_if(F.col("label") == V.REVIEW).alias("mr"))
    joined = classes.select("id", "kind").join(label, "id").join(m, "id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return joined.groupBy("kind").agg(F.count("*").alias("classes"), F.count_if(F.col("label") == V.UNUSED).alias("class_unused"), F.count_if(F.col("label") == V.REVIEW).alias("class_review"), total("m").alias("methods"), total("mu").alias("method_unused"), total("mr").alias("method_review"))


def attention_score(classes: DataFrame, methods: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(id, score): how much of a class waits for a person; itself counts 3 (unused) or 2, each method 1 or half."""
    label = verdicts.select(F.col("component_id").alias("id"), "label")
    worth = lambda u, r: F.when(F.col("label") == V.UNUSED, u).when(F.col("label") == V.REVIEW, r).otherwise(0.0)
    m = methods.select("id", "parent_id").join(label, "id").groupBy(F.col("parent_id").alias("id")).agg(F.sum(worth(1.0, 0.5)).alias("m"))
    return classes.select("id").join(label, "id").join(m, "id", "left").select("id", (worth(3.0, 2.0) + F.coalesce("m", F.lit(0.0))).alias("score"))


def inventory_profile(components: DataFrame) -> DataFrame:
    """(ctype, in_scope, components, entry_points, tests, orphan_fields): fields count as orphans if their object is out of scope."""
    attrs = lambda c: F.col(c) if c in components.columns else F.lit(False)
    return components.groupBy("ctype", "in_scope").agg(F.count("*").alias("components"), F.count_if(attrs("is_entry_point")).alias("entry_points"), F.count_if(attrs("is_test")).alias("tests"), F.count_if((F.col("ctype") == V.FIELD) & ~F.coalesce(attrs("parent_in_scope"), F.lit(True))).alias("orphan_fields"))


def removal_batches(summary: DataFrame, size: int) -> DataFrame:
    """(run_id, component_id, batch): candidates of each run in order of type and name, `size` a batch."""
    place = numbered(summary.select("run_id", "ctype", "api_name", "component_id"), "run_id", ["ctype", "api_name", "component_id"], "place")
    return place.select("run_id", "component_id", F.floor((F.col("place") - 1) / size).cast("long").alias("batch"))


def report_tables(components: DataFrame, verdicts: DataFrame, evidence: DataFrame, gaps: DataFrame, flags: DataFrame, collector_runs: DataFrame) -> dict[str, DataFrame]:
    """The tables of a report by name; write them with any Spark writer."""
    summary = component_summary(components, verdicts, evidence, gaps, flags)
    asked = verdicts.select("component_id", T.review_question("reason_codes").alias("question"), "reason_codes")
    return {
        "summary": verdict_totals(verdicts), "coverage": collector_runs, "candidates": summary.filter(F.col("label") == V.UNUSED), "needs_review": summary.filter(F.col("label") == V.REVIEW).join(asked, "component_id"),
        "components": report_order(summary), "evidence": evidence_detail(evidence, components, collector_runs),
    }


#: The columns by whose ranges each table of a report is laid out, as far as it has them.
REPORT_LAYOUT = ("label", "ctype", "api_name", "component_id", "collector_id")


def write_report(tables: dict[str, DataFrame], path: str, run_id: str, rows_per_file: int = 1_000_000, format: str = "parquet") -> None:
    """Write the `tables` of a run, as report_tables() gives them, under `path`/name/run_id=...

    Rows are laid out by ranges of REPORT_LAYOUT, in files of at most `rows_per_file`. Each table's run replaces what was
    there of it and of no other run, when it is written whole: a repeated write leaves the same, a failed one what was
    there. `format` is parquet or json.
    """
    for name, table in tables.items():
        by = [c for c in REPORT_LAYOUT if c in table.columns] or table.columns[:1]
        own = table.withColumn("run_id", F.lit(run_id))
        laid = own.repartitionByRange(*by).sortWithinPartitions(*by)
        laid.write.format(format).mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).partitionBy("run_id").save(f"{path}/{name}")


def read_report(spark: SparkSession, path: str, run_id: str, names: list[str], format: str = "parquet") -> dict[str, DataFrame]:
    """The tables `names` of a run that write_report() wrote."""
    read = lambda name: spark.read.format(format).load(f"{path}/{name}")
    return {name: read(name).filter(F.col("run_id") == F.lit(run_id)).drop("run_id") for name in names}


def attrs_get(df: DataFrame, path: str, kind: str, json: str = "attrs") -> Column:
    """A typed value of a JSON column at a path such as $.is_test."""
    return F.get_json_object(df[json], path).cast(kind)


def grep_artifacts(files: DataFrame, pattern: str, path_glob: str | None = None, limit: int = 200, widest: int = 400) -> DataFrame:
    """(path, line, text): lines that match, numbered from 1, cut to `widest` characters; the first `limit` by path and line.

    Files without a match are dropped before they are cut into lines.
    """
    if path_glob:
        files = files.filter(F.col("path").rlike("^" + path_glob.replace(".", r"\.").replace("*", ".*") + "$"))
    lines = files.filter(F.col("content").rlike(pattern)).select("path", F.posexplode(F.split("content", "\n")).alias("n", "text")).filter(F.col("text").rlike(pattern))
    return lines.select("path", (F.col("n") + 1).alias("line"), F.substring("text", 1, widest).alias("text")).orderBy("path", "line").limit(limit)
