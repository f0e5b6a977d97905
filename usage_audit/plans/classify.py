"""Verdicts: ordered rules over all evidence, the first that applies decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import text as T
from ..operators import graph as G

PAYLOAD = "layout_only boolean, layout_names array<string>, weak_references long, weak_source_types array<string>, reachable boolean, path array<string>"
NONE = "array<string>"


def completeness_gate(required: Column, ran: Column, gaps: Column) -> Column:
    """struct(required, ran, missing, gaps, gate): PASS when nothing required is missing and nothing has a gap."""
    missing = F.array_sort(F.array_except(required, ran))
    return F.struct(F.array_sort(required).alias("required"), F.array_sort(F.array_intersect(required, ran)).alias("ran"), missing.alias("missing"), F.array_sort(gaps).alias("gaps"), F.when((F.size(missing) == 0) & (F.size(gaps) == 0), "PASS").otherwise("FAIL").alias("gate"))


def required_collectors(ctype: str = "ctype") -> Column:
    out = F.array(F.lit(V.STATIC))
    for kind, names in V.REQUIRED_COLLECTORS.items():
        out = F.when(F.col(ctype) == kind, F.array(*map(F.lit, names))).otherwise(out)
    return out


def score() -> Column:
    """What a row of evidence contributes: int(30 * weight), where no weight counts as 1, 15 for a miss, -10 if unclear."""
    weight = F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight"))
    return F.when(F.col("result") == V.HIT, (30 * weight).cast("int")).when(F.col("result") == V.MISS, 15).when(F.col("result") == V.UNCLEAR, -10).otherwise(0)


def evidence_wide(evidence: DataFrame) -> DataFrame:
    """One row for each component: what the rules ask of its evidence."""
    e = evidence.withColumn("p", F.from_json("payload", PAYLOAD)).withColumn("points", score())
    hit, unclear = F.col("result") == V.HIT, F.col("result") == V.UNCLEAR
    static, reach = F.col("collector_id") == V.STATIC, F.col("collector_id") == V.REACHABILITY
    only = static & F.coalesce("p.layout_only", F.lit(False))
    weak = unclear & (F.coalesce("p.weak_references", F.lit(0)) > 0)
    return e.groupBy("component_id").agg(
        F.count_if(hit).alias("n_used"), F.count_if(hit & (F.col("tier") == "A")).alias("n_a"), F.count_if(hit & (F.col("tier") == "B")).alias("n_b"), F.count_if(hit & (F.col("tier") == "A") & ~only).alias("n_a_other"),
        F.coalesce(F.bool_or(only), F.lit(False)).alias("layout_only"), F.coalesce(F.max(F.when(static, F.col("p.layout_names"))), F.array().cast(NONE)).alias("layout_names"),
        F.coalesce(F.bool_or((F.col("collector_id") == V.POPULATION) & (F.col("result") == V.MISS)), F.lit(False)).alias("zero_data"), F.count_if(reach).alias("n_reach"),
        F.coalesce(F.bool_or(reach & F.col("p.reachable")), F.lit(False)).alias("reachable"), F.coalesce(F.max(F.when(reach, F.col("p.path"))), F.array().cast(NONE)).alias("path"),
        F.count_if(weak).alias("n_weak"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(weak, F.coalesce("p.weak_source_types", F.array().cast(NONE))))))).alias("weak_types"),
        F.sum("points").cast("int").alias("points"),
        F.array_sort(F.collect_list(F.struct(F.col("collector_id").alias("collector"), F.col("points").alias("contribution")))).alias("score_breakdown"),
    )


#: What has to happen before something that only layouts show is removed.
LAYOUT_STEPS = ("remove it from its layouts", "hide it by permissions and watch for a business cycle", "export its data")

#: Of each way to decide, in no order, the rule's name, the label, and the bounds of its confidence.
RULES = (
    ("managed", "R0", V.OUT, 100, 100),
    ("outside", "R1", V.OUT, 100, 100),
    ("incomplete", "R2", V.REVIEW, 0, 55),
    ("layout flagged", "R6", V.REVIEW, 0, 60),
    ("layout only", "R3a", V.UNUSED, 0, 70),
    ("bound", "R3", V.USED, 80, 100),
    ("runtime", "R4", V.USED, 60, 75),
    ("entry point", "R5", V.REVIEW, 0, 60),
    ("exposed", "R5", V.REVIEW, 0, 60),
    ("test", "R5", V.REVIEW, 0, 60),
    ("flagged", "R6", V.REVIEW, 0, 60),
    ("unreachable", "R5b", V.UNUSED, 70, 85),
    ("presence", "R7a", V.UNUSED, 0, 70),
    ("weak", "R7", V.REVIEW, 0, 65),
    ("nothing", "R9", V.UNUSED, 70, 100),
    ("unclear", "R2", V.REVIEW, 0, 55),
)


def classify(components: DataFrame, evidence: DataFrame, gaps: DataFrame, flags: DataFrame, ran: list[str]) -> DataFrame:
    """(component_id, label, confidence, reason_codes, rule_trace, score_breakdown, completeness, had_gaps, removal_prerequisites).

    `components`: id, ctype, namespace, in_scope, out_of_scope_reason, is_entry_point, is_exposed, is_test; `gaps`:
    component_id, collector_id; `flags`: component_id, code; `ran`: the collectors that finished. One aggregation of
    each child table, three joins on the component, one ordered choice of a way to decide; label and bounds come from
    the table of these ways, so that whoever filters by label doesn't repeat the choice.
    """
    for name, kind in (("namespace", "string"), ("out_of_scope_reason", "string"), ("is_entry_point", "boolean"), ("is_exposed", "boolean"), ("is_test", "boolean")):
        if name not in components.columns:
            components = components.withColumn(name, F.lit(None).cast(kind))
    gap = gaps.groupBy("component_id").agg(F.array_sort(F.collect_set("collector_id")).alias("gap_collectors"))
    raised = flags.groupBy("component_id").agg(F.count("*").alias("n_flags"), F.array_sort(F.collect_set(F.when(~F.col("code").isin(*V.INFORMATIONAL_FLAGS), F.col("code")))).alias("review"))
    none = F.array().cast(NONE)
    judged = components.select(F.col("id").alias("component_id"), "ctype", "namespace", "in_scope", "out_of_scope_reason", "is_entry_point", "is_exposed", "is_test")
    base = judged.join(evidence_wide(evidence), "component_id", "left").join(gap, "component_id", "left").join(raised, "component_id", "left")
    base = base.na.fill(0, ["n_used", "n_a", "n_b", "n_a_other", "n_reach", "n_weak", "points", "n_flags"]).na.fill(False, ["layout_only", "zero_data", "reachable", "is_entry_point", "is_exposed", "is_test"])
    base = base.withColumns({name: F.coalesce(name, none) for name in ("layout_names", "path", "weak_types", "gap_collectors", "review")})
    base = base.withColumn("completeness", completeness_gate(required_collectors(), F.array(*map(F.lit, sorted(ran))).cast(NONE), F.col("gap_collectors")))

    c = F.col
    is_data, is_code, is_ui = c("ctype").isin(V.FIELD, V.OBJECT), c("ctype").isin(V.CLASS, V.METHOD), c("ctype").isin(*V.UI_TYPES)
    facts = base.withColumns({
        "conf": (50 + c("points") - 30 * c("n_flags")).cast("double"),
        "passed": c("completeness.gate") == "PASS",
        "flagged": F.size("review") > 0,
        "only_presence": F.forall("weak_types", lambda s: s.isin(*V.PRESENCE_ONLY)) & (~is_data | c("zero_data")),
        "is_reviewed_entry": is_code & c("is_entry_point"),
        "is_shown": is_ui & (c("is_exposed") | c("is_entry_point")),
        "is_dead": (c("n_reach") > 0) & ~c("reachable") & c("ctype").isin(*V.CODE_TYPES, *V.UI_TYPES) & ~c("is_entry_point"),
    })
    layouts = (c("n_a") > 0) & (c("n_a_other") == 0) & c("zero_data") & c("passed")
    weak = (c("n_weak") > 0) & (c("n_used") == 0)
    ways = (
        (F.coalesce("namespace", F.lit("")) != "", "managed"), (~F.coalesce("in_scope", F.lit(False)), "outside"), (~c("passed") & (c("n_used") == 0), "incomplete"), (layouts & c("flagged"), "layout flagged"),
        (layouts, "layout only"), (c("n_a") > 0, "bound"), (c("n_b") > 0, "runtime"), (c("is_reviewed_entry"), "entry point"), (c("is_shown"), "exposed"), (c("is_test"), "test"), (c("flagged"), "flagged"),
        (c("is_dead"), "unreachable"), (weak & c("only_presence") & c("passed"), "presence"), (weak, "weak"), (c("passed"), "nothing"),
    )
    way = F.lit("unclear")
    for condition, name in reversed(ways):
        way = F.when(condition, name).otherwise(way)
    spark = components.sparkSession
    table = ", ".join(f"('{way}', '{rule}', '{label}', {low}D, {high}D)" for way, rule, label, low, high in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {table} AS t(way, rule, label, low, high)")
    decided = facts.withColumn("way", way).join(F.broadcast(rules), "way")  # a fixed table of sixteen rows

    codes = F.concat_ws(", ", "review")
    route = F.concat_ws(" -> ", F.slice("path", 1, 4))
    bound = F.when(c("reachable"), F.when(F.size("path") > 0, F.concat(F.lit("REACHABLE_FROM_ENTRY_POINT ("), route, F.lit(")"))).otherwise(F.lit("REACHABLE_FROM_ENTRY_POINT"))).when(c("layout_only"), F.lit("BINDING_REFERENCE (layout-only, but data exists)")).otherwise(F.lit("BINDING_REFERENCE"))
    origin = F.when(F.size("weak_types") > 0, F.concat(F.lit(" ("), F.concat_ws(", ", F.slice("weak_types", 1, 3)), F.lit(" only)"))).otherwise(F.lit(""))
    why = {
        "managed": F.lit("MANAGED_PACKAGE"),
        "outside": F.coalesce("out_of_scope_reason", F.lit("OUT_OF_SCOPE")),
        "incomplete": F.concat(F.lit("INSUFFICIENT_EVIDENCE (missing: "), F.concat_ws(", ", F.concat("completeness.missing", "completeness.gaps")), F.lit(")")),
        "layout flagged": codes,
        "layout only": F.concat(F.lit("LAYOUT_ONLY_NO_DATA ("), F.size("layout_names").cast("string"), F.lit(" layouts)")),
        "bound": F.concat(bound, F.lit(" ("), c("n_a").cast("string"), F.lit(" collectors)")),
        "runtime": F.lit("RUNTIME_OR_DATA_EVIDENCE"),
        "entry point": F.lit("UNCALLED_ENTRY_POINT"),
        "exposed": F.lit("EXPOSED_UI_NO_PLACEMENT"),
        "test": F.lit("TEST_ONLY"),
        "flagged": codes,
        "unreachable": F.lit("UNREACHABLE"),
        "presence": F.concat(F.lit("PRESENCE_ONLY_NO_DATA"), origin),
        "weak": F.concat(F.lit("WEAK_SIGNAL_ONLY"), origin),
        "nothing": F.lit("NO_EVIDENCE_FROM_ANY_COLLECTOR"),
    }
    said = F.lit("INSUFFICIENT_EVIDENCE")
    for name, text in why.items():
        said = F.when(c("way") == name, text).otherwise(said)
    step = lambda text, targets: F.struct(F.lit(text).alias("step"), targets.alias("targets"), F.lit(False).alias("blocking"))
    steps = F.array(step(LAYOUT_STEPS[0], c("layout_names")), *[step(s, none) for s in LAYOUT_STEPS[1:]])
    empty = F.filter(steps, lambda _: F.lit(False))
    return decided.withColumn("why", said).select(
        "component_id", "label", T.clamp_confidence(F.greatest(F.least("conf", "high"), "low")).alias("confidence"), F.array("why").alias("reason_codes"), F.array(F.struct("rule", F.lit(True).alias("fired"), "why")).alias("rule_trace"),
        F.coalesce("score_breakdown", F.array().cast("array<struct<collector:string,contribution:int>>")).alias("score_breakdown"), "completeness", (F.size("gap_collectors") > 0).alias("had_gaps"),
        F.when(c("way").isin("layout flagged", "layout only"), steps).otherwise(empty).alias("removal_prerequisites"),
    )


def promote_parents(verdicts: DataFrame, components: DataFrame) -> DataFrame:
    """A class with a USED method is USED."""
    used = verdicts.filter(F.col("label") == V.USED).select(F.col("component_id").alias("id"))
    parents = components.filter((F.col("ctype") == V.METHOD) & F.col("parent_id").isNotNull()).join(used, "id", "left_semi").select(F.col("parent_id").alias("component_id"), F.lit(True).alias("__up")).distinct()
    up = F.coalesce("__up", F.lit(False)) & (F.col("label") != V.USED)
    traced = F.concat("rule_trace", F.array(F.struct(F.lit("R_PARENT").alias("rule"), F.lit(True).alias("fired"), F.lit("HAS_USED_METHOD").alias("why"))))
    joined = verdicts.join(parents, "component_id", "left").withColumn("__go", up)
    joined = joined.withColumn("rule_trace", F.when(F.col("__go"), traced).otherwise(F.col("rule_trace"))).withColumn("confidence", F.when(F.col("__go"), F.greatest("confidence", F.lit(80.0))).otherwise(F.col("confidence")))
    joined = joined.withColumn("reason_codes", F.when(F.col("__go"), F.array(F.lit("HAS_USED_METHOD"))).otherwise(F.col("reason_codes"))).withColumn("label", F.when(F.col("__go"), V.USED).otherwise(F.col("label")))
    return joined.select(verdicts.columns)


def transitive_guard(verdicts: DataFrame, edges: DataFrame, artifacts: DataFrame, components: DataFrame) -> DataFrame:
    """UNUSED components that something not UNUSED refers to go to review; those that only UNUSED ones refer to form a cluster.

    Referrers are the components that the referring files define; presentation files and a component's own definition
    don't count. Labels are those before the guard: nothing cascades.
    """
    labels = verdicts.select(F.col("component_id").alias("id"), "label")
    own = components.groupBy(F.col("ctype").alias("metadata_type"), F.lower("api_name").alias("name")).agg(F.min("id").alias("id")).join(labels, "id")
    files = artifacts.filter(~F.col("metadata_type").isin(*V.LAYOUT_TYPES)).select("artifact_id", "metadata_type", F.lower("member_name").alias("name"))
    source = files.join(own, ["metadata_type", "name"]).select("artifact_id", F.col("id").alias("src"), F.col("label").alias("src_label"))
    targets = verdicts.filter(F.col("label") == V.UNUSED).select("component_id")
    refs = edges.filter("tier = 'A'").join(targets, "component_id", "left_semi").join(source, "artifact_id").filter("src != component_id")
    seen = refs.groupBy("component_id").agg(F.bool_or(F.col("src_label") != V.UNUSED).alias("__live"), F.min(F.when(F.col("src_label") != V.UNUSED, F.col("src"))).alias("__by"), F.min("src").alias("__first"))
    joined = verdicts.join(seen, "component_id", "left")
    live = F.coalesce("__live", F.lit(False))
    cluster = F.col("__live").isNotNull() & ~live
    trace = lambda name, why: F.array(F.struct(F.lit(name).alias("rule"), F.lit(True).alias("fired"), F.lit(why).alias("why")))
    steps = F.array(F.struct(F.lit("remove the whole cluster together").alias("step"), F.array(F.col("__first").cast("string")).alias("targets"), F.lit(True).alias("blocking")))
    out = joined.withColumn("rule_trace", F.when(live, F.concat("rule_trace", trace("R8", "BLOCKED_BY_DEPENDENT"))).when(cluster, F.concat("rule_trace", trace("R8c", "PART_OF_ORPHANED_CLUSTER"))).otherwise(F.col("rule_trace")))
    out = out.withColumn("reason_codes", F.when(live, F.array(F.lit("BLOCKED_BY_DEPENDENT"))).when(cluster, F.concat("reason_codes", F.array(F.lit("PART_OF_ORPHANED_CLUSTER")))).otherwise(F.col("reason_codes")))
    out = out.withColumn("removal_prerequisites", F.when(cluster, F.concat("removal_prerequisites", steps)).otherwise(F.col("removal_prerequisites")))
    out = out.withColumn("confidence", F.when(live, F.least("confidence", F.lit(60.0))).otherwise(F.col("confidence"))).withColumn("label", F.when(live, V.REVIEW).otherwise(F.col("label")))
    return out.select(verdicts.columns)


def audit(components: DataFrame, artifacts: DataFrame, edges: DataFrame, evidence: DataFrame, gaps: DataFrame, flags: DataFrame, ran: list[str]) -> DataFrame:
    """The whole chain from evidence to verdicts; the first ones are written, as promotion and guard read them often."""
    first = G.cut(classify(components, evidence, gaps, flags, ran), "verdicts")
    return transitive_guard(promote_parents(first, components), edges, artifacts, components)
