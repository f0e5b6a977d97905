"""Every textual form of each component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import text as T
from .joins import dealt


#: Forms of a component, at most about.
FORMS = 10


def _forms(*forms: tuple[Column, str, str]) -> Column:
    return F.array(*[F.struct(F.lower(value).alias("alias_lc"), F.lit(kind).alias("alias_kind"), F.lit(rule).alias("generated_by"), F.lit(n).alias("place")) for n, (value, kind, rule) in enumerate(forms)])


def _ids(prefix: str) -> list[tuple[Column, str, str]]:
    return [(F.col("sf_id"), "sf_id_18", f"{prefix}.sf_id"), (T.id15("sf_id"), "sf_id_15", f"{prefix}.sf_id_15")]


def generate_aliases(components: DataFrame) -> DataFrame:
    """(component_id, alias_lc, alias_kind, generated_by) of `components`.

    Read columns: id, ctype, api_name, parent_object, label, sf_id, relationship_name, key_prefix, namespace; missing ones
    count as null. Fields and methods may come qualified by their parent. Forms shorter than two characters and repeats
    of (component, form, kind) are dropped; the first rule stays. `components` is read twice: its rows are counted first.
    """
    for name in ("parent_object", "label", "sf_id", "relationship_name", "key_prefix", "namespace"):
        if name not in components.columns:
            components = components.withColumn(name, F.lit(None).cast("string"))
    api, parent = F.col("api_name"), F.col("parent_object")
    own = F.element_at(F.split(api, r"\."), -1)  # without the parent
    short = T.bare_name(own)
    label = lambda name: F.when(F.lower("label") != F.lower(name), F.col("label"))
    dotted = lambda a, b: F.concat(a, F.lit("."), b)
    rel = F.col("relationship_name")
    field = _forms(
        (own, "api_name", "field.api_name"), (dotted(parent, own), "qualified", "field.qualified"), (F.concat(parent, F.lit("$"), own), "report_qualified", "field.report_qualified"),
        (F.when(F.lower(short) != F.lower(own), short), "stripped_suffix", "field.stripped_suffix"), (rel, "relationship_name", "field.relationship"), (dotted(parent, rel), "qualified", "field.relationship_qualified"),
        *_ids("field"), (label(own), "label", "field.label"),
    )
    bare = T.bare_name(api)
    object_ = _forms(
        (api, "api_name", "object.api_name"), (F.when(F.lower(bare) != F.lower(api), bare), "stripped_suffix", "object.stripped_suffix"),
        (F.when(F.lower(api).endswith("__c"), F.regexp_replace(api, ".$", "r")), "relationship_name", "object.relationship_suffix"), (F.col("key_prefix"), "key_prefix", "object.key_prefix"),
        *_ids("object"), (label(api), "label", "object.label"),
    )
    code = lambda is_class: _forms((api, "api_name", "code.api_name"), *([(F.concat(api, F.lit(".")), "qualified", "code.dotted")] if is_class else []), *_ids("code"))
    getter = F.when(F.lower(own).startswith("get") & (F.length(own) > 3), F.substring(own, F.lit(4), F.length(own)))
    owner = F.coalesce(parent, F.when(api.contains("."), F.regexp_extract(api, r"^(.*)\.[^.]*$", 1)))
    method = _forms(
        (own, "api_name", "method.name"), (dotted(owner, own), "qualified", "method.qualified"), (F.concat(F.lit("@salesforce/apex/"), dotted(owner, own)), "qualified", "method.import"),
        (F.concat(F.lit("c."), own), "bare_name", "method.binding"), (getter, "bare_name", "method.getter_property"),
    )
    space = F.col("namespace")
    ui = _forms(
        (api, "api_name", "ui.api_name"), (F.concat(F.lit("c/"), api), "qualified", "ui.import"), (F.concat(F.lit("c:"), api), "qualified", "ui.tag"), (F.concat(F.lit("c-"), T.camel_to_kebab(api)), "qualified", "ui.element"),
        (F.concat(space, F.lit("/"), api), "qualified", "ui.namespace_import"), (F.concat(space, F.lit(":"), api), "qualified", "ui.namespace_tag"), *_ids("ui"),
    )
    kind = F.col("ctype")
    forms = F.when(kind == V.FIELD, field).when(kind == V.OBJECT, object_).when(kind == V.CLASS, code(True)).when(kind == V.TRIGGER, code(False)).when(kind == V.METHOD, method).when(kind.isin(*V.UI_TYPES), ui)
    near = dealt(components, FORMS * components.count(), "id")  # the components, not their forms, are shuffled
    rows = near.select(F.col("id").alias("component_id"), F.explode(forms).alias("f")).select("component_id", "f.*").filter("length(alias_lc) >= 2")
    return rows.groupBy("component_id", "alias_lc", "alias_kind").agg(F.min_by("generated_by", "place").alias("generated_by"))


def alias_coverage(aliases: DataFrame) -> DataFrame:
    """(alias_kind, aliases, components) by kind."""
    return aliases.groupBy("alias_kind").agg(F.count("*").alias("aliases"), F.countDistinct("component_id").alias("components"))


def weak_inventory_warning(aliases: DataFrame, components: DataFrame, least: float = 2.0) -> DataFrame:
    """One row: aliases, components in scope, their ratio, and a warning when it is below `least`."""
    counts = aliases.agg(F.count("*").alias("aliases")).join(components.filter("in_scope").agg(F.count("*").alias("components")))
    ratio = F.when(F.col("components") > 0, F.round(F.col("aliases") / F.col("components"), 4)).otherwise(0.0)
    return counts.withColumn("ratio", ratio).withColumn("warning", F.when(F.col("ratio") < least, "few aliases a component: references may be missed"))


def parent_names(fields: DataFrame, objects: DataFrame) -> DataFrame:
    """`fields` (id, parent_key) with parent_object: by the key's first 15 characters if it is an id, else by name."""
    by_id = objects.select(F.substring("sf_id", 1, 15).alias("__id"), F.col("api_name").alias("__by_id")).filter("__id is not null").dropDuplicates(["__id"])
    by_name = objects.select(F.lower("api_name").alias("__name"), F.col("api_name").alias("__by_name")).dropDuplicates(["__name"])
    keyed = fields.withColumn("__k15", F.when(T.looks_like_id("parent_key"), F.substring("parent_key", 1, 15))).withColumn("__kn", F.lower("parent_key"))
    joined = keyed.join(by_id, F.col("__k15") == F.col("__id"), "left").join(by_name, F.col("__kn") == F.col("__name"), "left")
    return joined.withColumn("parent_object", F.coalesce("__by_id", "__by_name")).drop("__k15", "__kn", "__id", "__name", "__by_id", "__by_name")


