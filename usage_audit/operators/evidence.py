"""Evidence collectors: each gives a row for every component it applies to, hits and misses alike.

The common shape: component_id, collector_id, result, tier, weight, payload (JSON).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import text as T
from . import events as E
from .joins import dealt
from .resolve import mark_self_references

SHAPE = ["component_id", "collector_id", "result", "tier", "weight", "payload"]


def _row(collector: str, result: Column, tier: Column, weight: Column, payload: Column, component: str = "component_id") -> list[Column]:
    return [F.col(component).alias("component_id"), F.lit(collector).alias("collector_id"), result.alias("result"), tier.alias("tier"), weight.cast("double").alias("weight"), F.to_json(payload).alias("payload")]


def static_reference_rollup(components: DataFrame, edges: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One row for each component in scope: binding, weak, layout and functional references, distinct files and types.

    Inactive files count for nothing. Weak and layout references include the component's own file, the others don't.
    """
    marked = mark_self_references(edges, artifacts, components).filter("is_active")
    other = ~F.col("is_self")
    a, c = F.col("tier") == "A", F.col("tier") == "C"
    kinds = lambda cond, col: F.array_sort(F.collect_set(F.when(cond, F.col(col))))
    sums = marked.groupBy("component_id").agg(
        F.count_if(a & other).alias("tier_a"), F.count_if(c).alias("tier_c"), F.countDistinct(F.when(other, F.col("artifact_id"))).alias("sources"), F.count_if(a & (F.col("metadata_type") == "Layout")).alias("layout_refs"),
        F.count_if(a & other & ~F.col("metadata_type").isin(*V.LAYOUT_TYPES)).alias("functional_refs"), kinds(a & other, "metadata_type").alias("binding_types"), kinds(c & other, "metadata_type").alias("weak_types"),
        kinds(a & F.col("metadata_type").isin(*V.LAYOUT_TYPES), "member_name").alias("layout_names"),
    )
    joined = components.filter("in_scope").select(F.col("id").alias("component_id")).join(sums, "component_id", "left")
    return joined.na.fill(0, ["tier_a", "tier_c", "sources", "layout_refs", "functional_refs"])


def collect_static(components: DataFrame, edges: DataFrame, artifacts: DataFrame) -> DataFrame:
    r = static_reference_rollup(components, edges, artifacts)
    hit, weak = F.col("tier_a") > 0, F.col("tier_c") > 0
    layout_only = (F.col("layout_refs") > 0) & (F.col("functional_refs") == 0)
    payload = F.struct(
        F.col("tier_a").alias("binding_references"), F.when(~hit, F.col("tier_c")).alias("weak_references"), "sources", F.col("layout_refs").alias("layout_references"), F.col("functional_refs").alias("functional_references"),
        F.col("binding_types").alias("binding_source_types"), F.col("weak_types").alias("weak_source_types"), "layout_names", (hit & layout_only).alias("layout_only"), F.when(~hit & weak, T.weak_note("weak_types")).alias("note"),
    )
    result = F.when(hit, V.HIT).when(weak, V.UNCLEAR).otherwise(V.MISS)
    return r.select(*_row(V.STATIC, result, F.when(hit, "A").when(weak, "C"), F.when(hit & layout_only, 0.5).when(hit, 1.0).when(weak, 0.3).otherwise(0.0), payload))


def field_population(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, total, filled, pct) of each column: one pass over the table, however many columns."""
    counts = df.agg(F.count("*").alias("total"), *[F.count(c).alias(f"f{n}") for n, c in enumerate(columns)])
    rows = counts.select("total", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"f{n}").alias("filled")) for n, c in enumerate(columns)])).alias("x"))
    return rows.select("x.field", "total", "x.filled", T.population_pct("x.filled", "total").alias("pct"))


def field_has_any_value(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, has_value): does the column hold any value? False for an empty table."""
    counts = df.agg(*[F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False)).alias(f"f{n}") for n, c in enumerate(columns)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"f{n}").alias("has_value")) for n, c in enumerate(columns)])).alias("x")).select("x.*")


def record_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(object, records) of each table."""
    parts = [df.agg(F.count("*").alias("records")).select(F.lit(name).alias("object"), "records") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def collect_population(components: DataFrame, population: DataFrame, records: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence and gaps of stored data. `population`: object, field, total, filled (null: not computed); `records`: object,
    records; `failed`: object. A component of a failed object is a gap, not a miss."""
    own = F.element_at(F.split("api_name", r"\."), -1)
    asked = components.filter(F.col("ctype").isin(V.FIELD, V.OBJECT) & F.col("in_scope")).select(F.col("id").alias("component_id"), "ctype", F.lower(F.coalesce("parent_object", "api_name")).alias("object"), F.lower(own).alias("field"))
    bad = failed.select(F.lower("object").alias("object"), F.lit(True).alias("bad")).distinct()
    fields = population.select(F.lower("object").alias("object"), F.lower("field").alias("field"), "total", "filled", F.lit(True).alias("probed"))
    joined = asked.join(bad, "object", "left").join(fields, ["object", "field"], "left").join(records.select(F.lower("object").alias("object"), "records"), "object", "left")
    n = F.when(F.col("ctype") == V.OBJECT, F.col("records")).otherwise(F.col("filled"))
    known = joined.filter("bad is null")
    result = F.when(n > 0, V.HIT).when(n == 0, V.MISS).otherwise(V.UNCLEAR)
    evidence = known.select(*_row(V.POPULATION, result, F.when(n > 0, "B"), F.when(n > 0, 0.7).otherwise(0.0), F.struct(n.alias("filled"), F.col("total"), T.population_pct(F.coalesce("filled", F.lit(0)), F.coalesce("total", F.lit(0))).alias("pct"))))
    gaps = joined.filter("bad").select("component_id", F.lit(V.POPULATION).alias("collector_id"), F.lit("table could not be read").alias("reason"))
    return evidence, gaps


def match_dependencies(dependencies: DataFrame, components: DataFrame, shown: int = 6, most_rows: int | None = None) -> DataFrame:
    """Evidence of recorded dependencies for all but methods. `dependencies`: ref_id, ref_name, by_name, by_type.

    A row names a component by its name, its name without the object, or its 18- or 15-character id. The first `shown`
    dependents are named. `most_rows`: a bound of the rows of `dependencies` if one is known; else they are counted first.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    own = components.filter(F.col("in_scope") & (F.col("ctype") != V.METHOD))
    forms = lambda name, sid: F.array_distinct(F.filter(F.array(low(F.col(name)), low(F.element_at(F.split(name, r"\."), -1)), low(F.col(sid)), low(F.substring(sid, 1, 15))), lambda x: x != ""))
    left = dependencies.select("by_name", "by_type", F.explode(forms("ref_name", "ref_id")).alias("k"))
    right = own.select(F.col("id").alias("component_id"), F.explode(forms("api_name", "sf_id")).alias("k"))
    n = 2 * max(dependencies.count() if most_rows is None else most_rows, own.count())  # a row has two forms or more
    pairs = dealt(left, n, "k").join(dealt(right, n, "k"), "k").select("component_id", "by_name", "by_type")
    # by the dependent, too: all may name one component
    found = dealt(pairs.withColumn("by", F.concat_ws(":", "by_type", "by_name")), n, "component_id", "by").distinct()
    counts = found.groupBy("component_id").agg(F.count("*").alias("n"))
    first = E.sample_values(found, ["component_id"], "by", shown).withColumnRenamed("samples", "by")
    joined = own.select(F.col("id").alias("component_id")).join(counts, "component_id", "left").join(first, "component_id", "left")
    hit = F.col("n") > 0
    return joined.select(*_row(V.DEPENDENCY, F.when(hit, V.HIT).otherwise(V.MISS), F.when(hit, "A"), F.when(hit, 1.0).otherwise(0.0), F.struct(F.coalesce("n", F.lit(0)).alias("dependents"), "by")))


def dependency_status(dependencies: DataFrame, cap: int = 2000) -> DataFrame:
    """(rows, status): PARTIAL when exactly `cap` rows came, for then more may exist."""
    return dependencies.agg(F.count("*").alias("rows")).withColumn("status", F.when(F.col("rows") == cap, "PARTIAL").otherwise("OK"))


def collect_temporal(components: DataFrame, now: Column, days: Column) -> DataFrame:
    """(component_id, code, severity, detail): RECENTLY_CHANGED of what is newer than the cut-off; it informs, no more."""
    newest = F.greatest("created_at", "modified_at")
    changed = components.filter((F.col("ctype") != V.METHOD) & F.col("in_scope") & T.recently_changed("created_at", "modified_at", now, days))
    return changed.select(F.col("id").alias("component_id"), F.lit("RECENTLY_CHANGED").alias("code"), F.lit("info").alias("severity"), F.date_format(newest, "yyyy-MM-dd").alias("detail"))


def propagate_taint(dynamic: DataFrame, edges: DataFrame, artifacts: DataFrame, components: DataFrame) -> DataFrame:
    """(component_id, code, severity, detail): components that dynamic code names, and all custom fields of objects it touches.

    `dynamic`: path of files with dynamic markers; a file's member is its name without .cls.
    """
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"-meta\.xml$", ""), r"\.cls$", "")
    files = artifacts.join(dynamic.select(F.lower(stem).alias("m")).distinct(), F.lower("member_name") == F.col("m"), "left_semi").select("artifact_id")
    named = edges.join(files, "artifact_id", "left_semi").select(F.col("component_id").alias("id")).distinct()
    touched = components.join(named, "id", "left_semi")
    objects = touched.select(F.lower(F.when(F.col("ctype") == V.OBJECT, F.col("api_name")).otherwise(F.col("parent_object"))).alias("o")).filter("o is not null").distinct()
    fields = components.filter((F.col("ctype") == V.FIELD) & F.lower("api_name").endswith("__c")).join(objects, F.lower("parent_object") == F.col("o"), "left_semi").select("id")
    every = touched.select("id").unionByName(fields).distinct().join(components.filter("in_scope").select("id"), "id", "left_semi")
    return every.select(F.col("id").alias("component_id"), F.lit("DYNAMIC_APEX_IN_SCOPE").alias("code"), F.lit("high").alias("severity"), F.lit("dynamic code touches it").alias("detail"))


def match_config_data(rows: DataFrame, text_columns: list[str], table: str, aliases: DataFrame, components: DataFrame) -> DataFrame:
    """Evidence of configuration cells whose trimmed text is an alias; every other component in scope has a miss."""
    cells = rows.select(F.explode(F.array(*[F.struct(F.lit(f"{table}.{c}").alias("cell"), F.lower(F.trim(F.col(c).cast("string"))).alias("alias_lc")) for c in text_columns])).alias("x")).select("x.*")
    able = aliases.filter(F.col("alias_kind").isin("api_name", "qualified", "bare_name", "sf_id_18", "sf_id_15"))
    found = cells.filter("alias_lc != ''").join(able, "alias_lc").groupBy("component_id", "cell").agg(F.count("*").alias("n"))  # a row a text column
    found = found.groupBy("component_id").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.collect_list("cell")), 1, 5).alias("cells"))
    joined = components.filter("in_scope").select(F.col("id").alias("component_id")).join(found, "component_id", "left")
    hit = F.col("n") > 0
    return joined.select(*_row(V.CONFIG, F.when(hit, V.HIT).otherwise(V.MISS), F.when(hit, "A"), F.when(hit, 1.0).otherwise(0.0), F.struct(F.coalesce("n", F.lit(0)).alias("matches"), "cells")))


def rehearsal_evidence(results: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence and gaps of removal rehearsals of unused components.

    `results`: component_id, phase (batch, solo, cluster), outcome JSON {"status": blocked | passed | not_addressable |
    unresolved, "by": [...]}. The latest phase decides. Methods can't be rehearsed. `components`: id, ctype.
    """
    said = F.from_json("outcome", "status string, by array<string>")
    place = F.when(F.col("phase") == "cluster", 3).when(F.col("phase") == "solo", 2).otherwise(1)
    best = results.select("component_id", said.alias("o"), place.alias("p")).groupBy("component_id").agg(F.max_by("o", F.struct("p", "o.status")).alias("o"))
    joined = components.select(F.col("id").alias("component_id"), "ctype").join(best, "component_id", "left")
    status = F.when(F.col("ctype") == V.METHOD, "method").otherwise(F.coalesce("o.status", F.lit("unresolved")))
    judged = joined.withColumn("s", status)
    result = F.when(F.col("s") == "blocked", V.HIT).when(F.col("s") == "passed", V.MISS).otherwise(V.NOT_APPLICABLE)
    hit = F.col("s") == "blocked"
    evidence = judged.filter("s != 'unresolved'").select(*_row(V.REHEARSAL, result, F.when(hit, "A"), F.when(hit, 1.0).otherwise(0.0), F.struct(F.col("s").alias("status"), F.col("o.by").alias("by"))))
    gaps = judged.filter("s = 'unresolved'").select("component_id", F.lit(V.REHEARSAL).alias("collector_id"), F.lit("rehearsal gave no result").alias("reason"))
    return evidence, gaps


def apply_opinions(opinions: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flags and evidence from outside opinions (component_id, uses boolean, note): a doubt about an UNUSED component is a
    flag, a confirmation of one under review is evidence of tier A."""
    joined = opinions.join(verdicts.select("component_id", "label"), "component_id")
    flags = joined.filter((F.col("label") == V.UNUSED) & F.col("uses")).select("component_id", F.lit("LLM_CONCERN").alias("code"), F.lit("medium").alias("severity"), F.col("note").alias("detail"))
    confirmed = joined.filter((F.col("label") == V.REVIEW) & F.col("uses"))
    return flags, confirmed.select(*_row(V.OPINIONS, F.lit(V.HIT), F.lit("A"), F.lit(0.85), F.struct("note")))


def union_evidence(*parts: DataFrame) -> DataFrame:
    """All evidence as one long table, one row for each (component, collector): the later part stays."""
    out = None
    for n, p in enumerate(parts):
        p = p.select(*SHAPE, F.lit(n).alias("part"))
        out = p if out is None else out.unionByName(p)
    last = F.max_by(F.struct(*SHAPE[2:]), "part").alias("x")
    return out.groupBy("component_id", "collector_id").agg(last).select("component_id", "collector_id", "x.*")


def collector_ledger(evidence: DataFrame, collectors: DataFrame) -> DataFrame:
    """(collector_id, status, searched, hits): a row for each collector, one without evidence included."""
    sums = evidence.groupBy("collector_id").agg(F.count("*").alias("searched"), F.count_if(F.col("result") == V.HIT).alias("hits"))
    return collectors.join(sums, "collector_id", "left").na.fill(0, ["searched", "hits"])


def filter_by_evidence_tags(components: DataFrame, evidence: DataFrame, flags: DataFrame, tags: list[str]) -> DataFrame:
    """Components for which every tag holds: "collector:RESULT", or "collector:FLAG" and "collector:NOFLAG".

    NOT_APPLICABLE also holds where the collector has no row.
    """
    out = components
    for tag in tags:
        collector, result = tag.split(":")
        rows = evidence.filter(F.col("collector_id") == collector)
        if result in ("FLAG", "NOFLAG"):
            code = {V.TEMPORAL: "RECENTLY_CHANGED", V.TAINT: "DYNAMIC_APEX_IN_SCOPE"}.get(collector, collector)
            out = out.join(flags.filter(F.col("code") == code).select(F.col("component_id").alias("id")), "id", "left_semi" if result == "FLAG" else "left_anti")
        elif result == V.NOT_APPLICABLE:
            out = out.join(rows.filter(F.col("result") != result).select(F.col("component_id").alias("id")), "id", "left_anti")
        else:
            out = out.join(rows.filter(F.col("result") == result).select(F.col("component_id").alias("id")), "id", "left_semi")
    return out


def check_matrix(components: DataFrame, checks: DataFrame, evidence: DataFrame, gaps: DataFrame, flags: DataFrame) -> DataFrame:
    """(component_id, collector_id, state): hit, clear, na, incomplete, flagged or noflag for each check of its type.

    `checks`: ctype, collector_id, flag_code (null: an evidence check).
    """
    asked = components.select(F.col("id").alias("component_id"), "ctype").join(F.broadcast(checks), "ctype")  # a dozen rows
    found = evidence.select("component_id", "collector_id", "result")
    missing = gaps.select("component_id", "collector_id", F.lit(True).alias("gap")).distinct()
    raised = flags.select("component_id", F.col("code").alias("flag_code"), F.lit(True).alias("flag")).distinct()
    joined = asked.join(found, ["component_id", "collector_id"], "left").join(missing, ["component_id", "collector_id"], "left").join(raised, ["component_id", "flag_code"], "left")
    state = (
        F.when(F.col("flag_code").isNotNull(), F.when(F.col("flag"), "flagged").otherwise("noflag")).when(F.col("gap"), "incomplete")
        .when(F.col("result") == V.HIT, "hit").when(F.col("result") == V.MISS, "clear").when(F.col("result") == V.UNCLEAR, "incomplete").otherwise("na")
    )
    return joined.select("component_id", "collector_id", state.alias("state"))
