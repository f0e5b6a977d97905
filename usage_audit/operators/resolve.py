"""From the names found in files to reference edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import vocabulary as V
from ..functions import text as T
from .graph import cut
from .joins import dealt, hot_keys, maybe_among, salted_join


def token_counts(files: DataFrame, text: str = "code", key: str = "artifact_id") -> DataFrame:
    """(key, token, n): how often each lower-cased identifier, or joined report column, occurs in each file."""
    return files.select(key, F.explode(T.tokens(text)).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def union_layers(files: DataFrame, layers: tuple[str, ...] = ("code", "literals", "forms", "comments")) -> DataFrame:
    """(artifact_id, said, origin, precedence) of `files` (artifact_id, code, comments, literals): what the layers say.

    Layers are united as rows of one pass over the files, so one that finds nothing takes nothing from another. literals
    are merge fields too; forms are those that name UI bundles.
    """
    row = lambda said, origin, precedence: F.struct(said.alias("literal"), F.lit(origin).alias("origin"), F.lit(precedence).alias("precedence"))
    words = lambda column, origin, precedence: F.transform(F.array_distinct(T.tokens(column)), lambda t: row(t, origin, precedence))
    said = {"code": lambda: words("code", "token", 0), "literals": lambda: T.harvest_literals("literals", "code"), "forms": lambda: T.ui_reference_literals("code"), "comments": lambda: words("comments", "comment", 9)}
    every = F.concat(*[said[k]() for k in layers])
    return files.select("artifact_id", F.explode(every).alias("l")).select("artifact_id", F.col("l.literal").alias("said"), "l.origin", "l.precedence")


def first_origin(literals: DataFrame) -> DataFrame:
    """(artifact_id, literal, origin): one origin for each literal, UI forms before strings before merge fields."""
    return literals.groupBy("artifact_id", "literal").agg(F.min_by("origin", F.struct("precedence", "origin")).alias("origin"))


def best_edge(edges: DataFrame) -> DataFrame:
    """The edge of the best tier for each (artifact_id, component_id, match_kind); ties by alias kind."""
    rank = T.mapped("tier", {k: str(v) for k, v in V.TIER_RANK.items()}).cast("int")
    first = W.partitionBy("artifact_id", "component_id", "match_kind").orderBy(rank.desc(), "alias_kind")
    return edges.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def ambiguity_guard(aliases: DataFrame) -> DataFrame:
    """`aliases` that can be references, with ambiguous: does another alias row have the same text?"""
    able = aliases.filter(~F.col("alias_kind").isin(*V.NON_REFERENCE_KINDS))
    several = able.groupBy("alias_lc").agg(F.count("*").alias("n")).filter("n > 1").select("alias_lc", F.lit(True).alias("ambiguous"))
    return salted_join(able, several, ["alias_lc"], "left").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))


def resolve_references(said: DataFrame, aliases: DataFrame, components: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(artifact_id, component_id, match_kind, alias_kind, tier, ambiguous): the best edge of each kind.

    `said`: union_layers(); `aliases`: component_id, alias_lc, alias_kind; `components`: id, ctype, parent_object;
    `artifacts`: artifact_id, metadata_type, is_code, is_test, is_active. A bare common word is refused in files that
    aren't code, and in comments everywhere. Of an ambiguous alias only the component whose parent the file also names
    keeps tier A. Tests, inactive and weak consumers give tier C, but an app or a tab that places a UI bundle keeps A.
    Comments give C.

    Files are read once: most of what they say is no alias and stays where it is (maybe_among); the rest is written
    before it is joined, and an alias that all files name is dealt over many tasks (salted_join). Tasks are as many as the
    rows need, and what was matched moves once more, to its file: its attributes, the parents that it names and its best
    edges are found there.
    """
    parents = components.select(F.col("id").alias("component_id"), "ctype", F.lower("parent_object").alias("parent"))
    owned = cut(ambiguity_guard(aliases).select("component_id", "alias_lc", "alias_kind", "ambiguous").join(parents, "component_id"), "aliases")
    # only ambiguous aliases ask whether the file names the parent, and only names of such parents can answer
    asked = owned.filter("ambiguous and parent is not null").select("parent").distinct()
    names = owned.select(F.col("alias_lc").alias("said")).union(asked).distinct()
    said = cut(maybe_among(said.select("artifact_id", "said", "origin", "precedence"), names, ["said"]), "said")
    n, common = said.count(), hot_keys(said, ["said"]).collect()  # fewer than 1000
    hot = said.sparkSession.createDataFrame(common, said.select("said").schema)

    own = said.filter("origin = 'token'").select("artifact_id", F.col("said").alias("alias_lc"), F.lit("token_sweep").alias("match_kind"))
    literals = first_origin(said.filter("origin not in ('token', 'comment')").select("artifact_id", F.col("said").alias("literal"), "origin", "precedence"))
    spoken = literals.select("artifact_id", F.col("literal").alias("alias_lc"), F.when(F.col("origin") == "merge_field", "merge_field").otherwise("string_literal").alias("match_kind"))
    comments = said.filter("origin = 'comment'").select("artifact_id", F.col("said").alias("alias_lc"), F.lit("comment_mention").alias("match_kind"))
    kinds = own.unionByName(spoken).unionByName(comments)
    about = dealt(artifacts.select("artifact_id", "metadata_type", "is_code", "is_test", "is_active"), n, "artifact_id")
    matched = dealt(salted_join(kinds, owned, ["alias_lc"], hot=hot.withColumnRenamed("said", "alias_lc")), n, "artifact_id").join(about, "artifact_id")
    guarded = (F.col("match_kind") == "comment_mention") | ((F.col("match_kind") == "token_sweep") & ~F.col("is_code"))
    matched = matched.filter(~guarded | T.is_sweepable("alias_lc"))
    named = salted_join(own.select("artifact_id", F.col("alias_lc").alias("parent")), asked, ["parent"], hot=hot.withColumnRenamed("said", "parent"))
    matched = matched.join(dealt(named, n, "artifact_id").groupBy("artifact_id").agg(F.collect_set("parent").alias("named")), "artifact_id", "left")
    base = F.when(F.col("match_kind") == "comment_mention", "C").when((F.col("match_kind") == "token_sweep") & (F.col("alias_kind") == "bare_name"), "C").otherwise("A")
    doubtful = F.col("ambiguous") & ~F.coalesce(F.array_contains("named", F.col("parent")), F.lit(False))
    placed = F.col("metadata_type").isin(*V.PLACEMENT_CONSUMERS) & F.col("ctype").isin(*V.UI_TYPES)
    weak = F.col("is_test") | ~F.col("is_active") | (F.col("metadata_type").isin(*V.WEAK_CONSUMERS) & ~placed)
    tier = F.when((base == "A") & (doubtful | weak), "C").otherwise(base)
    return best_edge(matched.select("artifact_id", "component_id", "match_kind", "alias_kind", tier.alias("tier"), "ambiguous"))


def is_self(metadata_type: str = "metadata_type", member: str = "member_name") -> Column:
    """Is the file the component's own? Needs api_name and parent_object beside the file's columns."""
    m, own, parent = F.col(member), F.col("api_name"), F.coalesce("parent_object", F.lit(""))
    kind = F.col(metadata_type)
    same = (
        ((kind == V.OBJECT) & ((m == parent) | (m == own)))
        | (kind.isin(V.CLASS, V.TRIGGER) & (F.lower(m).isin(F.lower(own)) | (F.lower(m) == F.lower(parent))))
        | (kind.isin(*V.UI_TYPES) & (F.lower(m) == F.lower(own)))
    )
    return F.coalesce(same, F.lit(False))


def mark_self_references(edges: DataFrame, artifacts: DataFrame, components: DataFrame) -> DataFrame:
    """`edges` with is_self, metadata_type, member_name and is_active of their files."""
    files = artifacts.select("artifact_id", "metadata_type", "member_name", "is_active")
    targets = components.select(F.col("id").alias("component_id"), "api_name", "parent_object")
    joined = edges.join(files, "artifact_id").join(targets, "component_id")
    return joined.withColumn("is_self", is_self()).drop("api_name", "parent_object")


def referenced_by(edges: DataFrame, artifacts: DataFrame, components: DataFrame, limit: int = 200) -> DataFrame:
    """(component_id, place, artifact_id, metadata_type, member_name, tier, match_kind, referrer_id): at most `limit` a component.

    Its own file is left out; referrer_id is the component that the file defines, if any. The best tiers come first.
    Files learn what they define before their edges are joined; rows are dealt by their number (`dealt`).
    """
    n = max(edges.count(), artifacts.count())
    files = artifacts.select("artifact_id", "metadata_type", "member_name", F.lower("member_name").alias("__name"))
    named = components.groupBy(F.col("ctype").alias("metadata_type"), F.lower("api_name").alias("__name")).agg(F.min("id").alias("referrer_id"))
    files = dealt(files, n, "metadata_type", "__name").join(dealt(named, n, "metadata_type", "__name"), ["metadata_type", "__name"], "left").drop("__name")
    said = dealt(edges.select("artifact_id", "component_id", "tier", "match_kind"), n, "artifact_id").join(dealt(files, n, "artifact_id"), "artifact_id")
    targets = components.select(F.col("id").alias("component_id"), "api_name", "parent_object")
    joined = dealt(said, n, "component_id").join(dealt(targets, n, "component_id"), "component_id").filter(~is_self())
    rank = T.mapped("tier", {k: str(v) for k, v in V.TIER_RANK.items()}).cast("int")
    order = W.partitionBy("component_id").orderBy(rank.desc(), "metadata_type", "member_name", "match_kind", "artifact_id")
    return joined.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("component_id", "place", "artifact_id", "metadata_type", "member_name", "tier", "match_kind", "referrer_id")


def zero_reference_components(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Components in scope without an edge of tier A."""
    return components.filter("in_scope").join(edges.filter("tier = 'A'").select(F.col("component_id").alias("id")).distinct(), "id", "left_anti")


def edge_profile(edges: DataFrame) -> DataFrame:
    return edges.groupBy("tier", "match_kind").agg(F.count("*").alias("edges"))


def most_referenced(edges: DataFrame, top: int = 10) -> DataFrame:
    """The `top` components by edges of tier A, with their distinct files."""
    counts = edges.filter("tier = 'A'").groupBy("component_id").agg(F.count("*").alias("refs"), F.countDistinct("artifact_id").alias("sources"))
    return counts.orderBy(F.desc("refs"), "component_id").limit(top)
