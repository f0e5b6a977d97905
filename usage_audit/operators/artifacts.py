"""Attributes of files: their type, member name, and whether they are tests or live consumers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import text as T

#: A switch of a custom record, a field named after being active or enabled, that is off.
_GATE = r'(?i)<field>\w*(?:active|enabled)\w*</field>\s*<value[^>]*type="xsd:boolean">false</value>'


def artifact_attributes(files: DataFrame) -> DataFrame:
    """`files` (path, content) with suffix, metadata_type, member_name, is_test, is_code, is_meta.

    The type comes from the first folder that is known, else the first folder's own name; a UI bundle's member is its
    folder, any other file's its name without the last suffix.
    """
    parts = F.split("path", "/")
    types = F.filter(F.transform(parts, lambda p: T.mapped(p, V.FOLDER_TYPES)), lambda t: t.isNotNull())
    kind = F.coalesce(F.get(types, 0), F.get(parts, 0))
    name = F.element_at(parts, -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    suffix = F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1))
    test = (suffix == ".cls") & (F.lower(stem).endswith("test") | F.lower(stem).startswith("test") | F.contains(F.lower(F.substring(F.coalesce("content", F.lit("")), 1, 4000)), F.lit("@istest")))
    return (
        files.withColumn("suffix", suffix)
        .withColumn("metadata_type", kind)
        .withColumn("member_name", F.when(kind.isin(*V.UI_TYPES) & (F.size(parts) >= 2), F.get(parts, 1)).otherwise(stem))
        .withColumn("is_test", test)
        .withColumn("is_code", suffix.isin(*V.CODE_SUFFIXES))
        .withColumn("is_meta", F.lower(name).rlike(r"\.(cls|trigger)-meta\.xml$"))
    )


def consumer_active(files: DataFrame) -> DataFrame:
    """`files` (path, content, metadata_type) with is_active: false for what exists but can't run.

    Obsolete and draft flows, rules with active = false, configuration records whose gate is off, and code whose sibling
    -meta.xml says Inactive.
    """
    low = F.lower(F.coalesce("content", F.lit("")))
    sibling = files.filter(F.col("path").endswith("-meta.xml") & low.contains("<status>inactive</status>")).select(F.regexp_replace("path", "-meta\\.xml$", "").alias("path"), F.lit(True).alias("__off")).distinct()
    kind = F.col("metadata_type")
    off = (
        (kind.isin("Flow", "FlowDefinition") & (low.contains("<status>obsolete</status>") | low.contains("<status>draft</status>")))
        | (kind.isin(*V.ACTIVE_FLAG_TYPES) & low.contains("<active>false</active>"))
        | ((kind == "CustomMetadata") & F.coalesce("content", F.lit("")).rlike(_GATE))
        | (kind.isin(V.CLASS, V.TRIGGER) & F.col("__off"))
    )
    return files.join(sibling, "path", "left").withColumn("is_active", ~F.coalesce(off, F.lit(False))).drop("__off")


def scope_components(raw: DataFrame, skipped_suffixes: tuple[str, ...] = ("__history", "__share", "__feed", "__changeevent"), standard: str = "is_standard") -> DataFrame:
    """`raw` (api_name, namespace, is_standard) without packaged and system members, with in_scope and out_of_scope_reason."""
    low = F.lower("api_name")
    kept = raw.filter(F.coalesce("namespace", F.lit("")) == "")
    for s in skipped_suffixes:
        kept = kept.filter(~low.endswith(s))
    return kept.withColumn("in_scope", ~F.coalesce(standard, F.lit(False))).withColumn("out_of_scope_reason", F.when(F.col(standard), "STANDARD_OBJECT"))


def entry_point_flags(methods: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with is_entry_point: may something outside call it?

    `methods`: id, parent_id, name, modifiers, annotations; `classes`: id, annotations, interfaces. A method is one by an
    annotation, by webservice, or as a lifecycle method of a class with an entry interface; a class by its own annotation,
    such an interface, or any of its methods.
    """
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)
    shorts = F.transform(low(F.col("interfaces")), lambda i: F.element_at(F.split(F.trim(F.element_at(F.split(i, "<"), 1)), r"\."), -1))
    marked = classes.withColumn("__iface", F.arrays_overlap(shorts, F.array(*map(F.lit, V.ENTRY_INTERFACES))))
    of_class = marked.select(F.col("id").alias("parent_id"), "__iface")
    said = F.arrays_overlap(low(F.col("annotations")), F.array(*map(F.lit, V.ENTRY_ANNOTATIONS)))
    entry = said | F.array_contains(low(F.col("modifiers")), "webservice") | (F.coalesce("__iface", F.lit(False)) & F.lower("name").isin(*V.ENTRY_METHODS))
    flagged = methods.join(of_class, "parent_id", "left").withColumn("is_entry_point", F.coalesce(entry, F.lit(False))).drop("__iface")
    any_method = flagged.groupBy(F.col("parent_id").alias("id")).agg(F.bool_or("is_entry_point").alias("__any"))
    own = F.arrays_overlap(low(F.col("annotations")), F.array(*map(F.lit, V.CLASS_ENTRY_ANNOTATIONS)))
    with_any = marked.join(any_method, "id", "left").withColumn("is_entry_point", F.coalesce(own, F.lit(False)) | F.coalesce("__iface", F.lit(False)) | F.coalesce("__any", F.lit(False)))
    return flagged, with_any.drop("__iface", "__any")


def class_kinds(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """`classes` (id, is_test, is_entry_point, annotations, interfaces) with kinds, in fixed order, and kind, the first.

    A test is nothing else; entry and regular stand only where no role applies.
    """
    none = F.array().cast("array<string>")
    low = lambda c: F.transform(F.coalesce(c, none), F.lower)
    said = methods.groupBy(F.col("parent_id").alias("id")).agg(F.array_distinct(F.flatten(F.collect_list(low(F.col("annotations"))))).alias("__ann"), F.array_distinct(F.flatten(F.collect_list(low(F.col("modifiers"))))).alias("__mod"))
    joined = classes.join(said, "id", "left").withColumn("__a", F.array_union(low(F.col("annotations")), F.coalesce("__ann", none)))
    joined = joined.withColumn("__i", F.transform(low(F.col("interfaces")), lambda i: F.element_at(F.split(F.trim(F.element_at(F.split(i, "<"), 1)), r"\."), -1)))
    has, is_a = lambda x: F.array_contains("__a", x), lambda x: F.array_contains("__i", x)
    roles = {
        "rest": has("restresource") | F.exists("__a", lambda a: a.startswith("http")), "scheduled": is_a("schedulable"), "batch": is_a("batchable"), "queueable": is_a("queueable"), "invocable": has("invocablemethod"),
        "aura": has("auraenabled"), "email": is_a("inboundemailhandler"), "webservice": has("webservice") | F.array_contains(F.coalesce("__mod", none), "webservice"),
    }
    found = F.array_compact(F.array(*[F.when(roles[k], F.lit(k)) for k in V.CLASS_KINDS if k in roles]))
    kinds = F.when(F.coalesce("is_test", F.lit(False)), F.array(F.lit("test"))).when(F.size(found) > 0, found).when(F.coalesce("is_entry_point", F.lit(False)), F.array(F.lit("entry"))).otherwise(F.array(F.lit("regular")))
    return joined.withColumn("kinds", kinds).withColumn("kind", F.get(kinds, 0)).drop("__ann", "__mod", "__a", "__i")


def parse_bundle_meta(files: DataFrame) -> DataFrame:
    """(artifact_id, is_exposed, targets, label, access, implements) of UI bundles' meta files and markup."""
    text = lambda tag: F.regexp_extract(F.coalesce("content", F.lit("")), rf"(?is)<(?:\w+:)?{tag}>\s*(.*?)\s*</(?:\w+:)?{tag}>", 1)
    attribute = lambda name: F.regexp_extract(F.coalesce("content", F.lit("")), rf"(?is)<aura:(?:component|application)[^>]*\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    return files.select(
        "artifact_id", (F.lower(text("isExposed")) == "true").alias("is_exposed"), F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"(?is)<target>\s*([^<]*?)\s*</target>"), 1).alias("targets"),
        F.nullif(text("masterLabel"), F.lit("")).alias("label"), F.nullif(F.lower(attribute("access")), F.lit("")).alias("access"),
        F.filter(F.transform(F.split(attribute("implements"), ","), lambda x: F.trim(x)), lambda x: x != "").alias("implements"),
    )
