"""Queries over the test tables, one or more for each operator, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import source as S
from ..functions import text as T
from ..operators import aliases as A
from ..operators import artifacts as AR
from ..operators import events as E
from ..operators import evidence as EV
from ..operators import graph as G
from ..operators import reports as R
from ..operators import resolve as RE
from ..operators import runs as RU
from ..operators.joins import dealt
from ..sources import files
from . import classify as C
from . import inputs as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True):
    """Register a query; `sql` may use the derived tables if `base`."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {I.SQL} {sql}" if base else sql
        return f

    return put


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _joined(c: str) -> F.Column:
    return F.concat_ws("|", F.col(c)).alias(c)


# --- names and texts ---------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id AS artifact_id, lower(t) AS token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*') || regexp_extract_all(text, '[A-Za-z0-9_]+\$[A-Za-z0-9_]+')) AS t FROM documents) GROUP BY ALL", base=False)
def token_counts(spark, d):
    return RE.token_counts(_docs(spark, d).select(F.col("doc_id").alias("artifact_id"), F.col("text").alias("code")))


_COMMON = "('" + "', '".join(sorted(set(V.COMMON_WORDS))) + "')"
_SWEEP = "CASE WHEN regexp_matches(w, '[_.$/]') THEN true WHEN length(w) IN (15, 18) AND regexp_full_match(w, '[A-Za-z0-9]+') AND regexp_matches(w, '[0-9]') THEN true WHEN w IN " + _COMMON + " THEN false ELSE length(w) >= 6 END"


@query(f"SELECT w, {_SWEEP} AS sweepable FROM (SELECT DISTINCT lower(unnest(regexp_extract_all(p_name || ' ' || p_type || ' ' || p_brand || ' type_' || p_size || ' ' || p_partkey, '[^ ]+'))) AS w FROM part)", base=False)
def is_sweepable(spark, d):
    words = spark.read.parquet(f"{d}/part.parquet").select(F.explode(F.split(F.lower(F.expr("p_name || ' ' || p_type || ' ' || p_brand || ' type_' || p_size || ' ' || p_partkey")), " ")).alias("w")).distinct()
    return words.select("w", T.is_sweepable("w").alias("sweepable"))


@query(
    "SELECT component_id, f.a AS alias_lc, f.k AS alias_kind FROM (SELECT id AS component_id, unnest([{'a': lower(api_name), 'k': 'api_name'}, {'a': CASE WHEN ctype = 'CustomField' THEN lower(parent_object || '.' || api_name) END, 'k': 'qualified'}, {'a': CASE WHEN ctype = 'CustomField' THEN lower(parent_object || '$' || api_name) END, 'k': 'report_qualified'},"
    " {'a': CASE WHEN ctype IN ('CustomField', 'CustomObject') THEN lower(regexp_replace(api_name, '__c$', '')) END, 'k': 'stripped_suffix'}, {'a': CASE WHEN ctype = 'CustomObject' THEN lower(regexp_replace(api_name, 'c$', 'r')) END, 'k': 'relationship_name'},"
    " {'a': CASE WHEN ctype <> 'ApexMethod' THEN lower(sf_id) END, 'k': 'sf_id_18'}, {'a': CASE WHEN ctype <> 'ApexMethod' THEN lower(substr(sf_id, 1, 15)) END, 'k': 'sf_id_15'}, {'a': CASE WHEN ctype IN ('CustomField', 'CustomObject') THEN lower(label) END, 'k': 'label'},"
    " {'a': CASE WHEN ctype = 'ApexClass' THEN lower(api_name) || '.' END, 'k': 'qualified'}, {'a': CASE WHEN ctype = 'ApexMethod' THEN lower(parent_object || '.' || api_name) END, 'k': 'qualified'}, {'a': CASE WHEN ctype = 'ApexMethod' THEN lower('@salesforce/apex/' || parent_object || '.' || api_name) END, 'k': 'qualified'},"
    " {'a': CASE WHEN ctype = 'ApexMethod' THEN lower('c.' || api_name) END, 'k': 'bare_name'}, {'a': CASE WHEN ctype LIKE 'Lightning%' THEN lower('c/' || api_name) END, 'k': 'qualified'}, {'a': CASE WHEN ctype LIKE 'Lightning%' THEN lower('c:' || api_name) END, 'k': 'qualified'}, {'a': CASE WHEN ctype LIKE 'Lightning%' THEN lower('c-' || api_name) END, 'k': 'qualified'},"
    " {'a': CASE WHEN ctype LIKE 'Lightning%' THEN lower(namespace || '/' || api_name) END, 'k': 'qualified'}, {'a': CASE WHEN ctype LIKE 'Lightning%' THEN lower(namespace || ':' || api_name) END, 'k': 'qualified'}]) AS f FROM comps) WHERE f.a IS NOT NULL"
)
def generate_aliases(spark, d):
    return A.generate_aliases(I.components(spark, d)).drop("generated_by")


@query("SELECT alias_kind, count(*) AS aliases, count(DISTINCT component_id) AS components FROM (SELECT id AS component_id, CASE WHEN ctype = 'CustomField' THEN 'f' ELSE 'o' END AS alias_kind FROM comps) GROUP BY 1")
def alias_coverage(spark, d):
    return A.alias_coverage(I.components(spark, d).select(F.col("id").alias("component_id"), F.when(F.col("ctype") == V.FIELD, "f").otherwise("o").alias("alias_kind")))


@query("SELECT (SELECT count(*) FROM edges) AS aliases, (SELECT count(*) FROM comps WHERE in_scope) AS components, round((SELECT count(*) FROM edges) / (SELECT count(*) FROM comps WHERE in_scope), 4) AS ratio, NULL::VARCHAR AS warning")
def weak_inventory_warning(spark, d):
    return A.weak_inventory_warning(I.edges(spark, d), I.components(spark, d))


@query(r"""SELECT doc_id, regexp_replace(text, '(?i)(password|secret|token|api[_-]?key|private[_-]?key|bearer)\s*[:=]\s*[''"]?[\p{L}\p{N}_\-./+=]{8,}', '\1=[REDACTED]', 'g') AS clean FROM documents""", base=False)
def redact(spark, d):
    return _docs(spark, d).select("doc_id", T.redact("text").alias("clean"))


@query("SELECT doc_id, sha256(text) AS sha256, len(text) - len(replace(text, chr(10), '')) + 1 AS lines FROM documents", base=False)
def source_fingerprint(spark, d):
    return _docs(spark, d).select("doc_id", T.source_fingerprint("text").alias("f")).select("doc_id", "f.*")


@query("SELECT component_id, CASE WHEN confidence >= 80 THEN 'High' WHEN confidence >= 60 THEN 'Medium' ELSE 'Low' END AS band, greatest(0.0, least(100.0, confidence * 2 - 30))::DOUBLE AS clamped FROM verdicts")
def confidence_band(spark, d):
    return I.verdicts(spark, d).select("component_id", T.confidence_band("confidence").alias("band"), T.clamp_confidence(F.col("confidence") * 2 - 30).alias("clamped"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<!\[CDATA\[(.*?)\]\]>', ' \1 ', 'g') AS code, array_to_string(regexp_extract_all(html, '(?s)<!--.*?-->'), ' ') AS comments FROM pages", base=False)
def split_markup(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", T.split_markup("html").alias("x")).select("page_id", "x.*")


@query(
    "SELECT event_id, CASE WHEN e LIKE '% trigger event %' THEN 'trigger' WHEN e LIKE 'vf-%' THEN 'skip' WHEN e LIKE '% %' THEN 'skip' ELSE 'class' END AS kind, CASE WHEN e LIKE '% trigger event %' THEN split_part(e, ' on ', 1) WHEN e LIKE 'vf-%' OR e LIKE '% %' THEN '' WHEN e LIKE '%.%' THEN split_part(e, '.', 1) ELSE e END AS name,"
    " CASE WHEN e LIKE '% trigger event %' THEN lower(split_part(e, ' trigger event ', 2)) WHEN e LIKE '%.%' AND e NOT LIKE '% %' AND e NOT LIKE 'vf-%' THEN replace(split_part(e, '.', 2), '()', '') ELSE '' END AS detail FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Svc' || user_id || '.run()' WHEN 1 THEN 'Trg' || user_id || ' on Order trigger event BeforeInsert' WHEN 2 THEN 'vf-page' WHEN 3 THEN 'some noise' ELSE 'Svc' || user_id END AS e FROM events)", base=False,
)
def parse_entry_point(spark, d):
    said = "CASE event_id % 5 WHEN 0 THEN 'Svc' || user_id || '.run()' WHEN 1 THEN 'Trg' || user_id || ' on Order trigger event BeforeInsert' WHEN 2 THEN 'vf-page' WHEN 3 THEN 'some noise' ELSE 'Svc' || user_id END AS e"
    return spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id", said).select("event_id", T.parse_entry_point("e").alias("p")).select("event_id", "p.*")


@query("SELECT id, lower('c-' || replace(api_name, 'z', 'z')) AS kebab, regexp_replace(api_name, '__c$', '') AS bare, substr(sf_id, 1, 15) AS id15, true AS is_id, ctype IN ('CustomField', 'CustomObject') AS custom FROM comps")
def name_functions(spark, d):
    return I.components(spark, d).select("id", F.concat(F.lit("c-"), T.camel_to_kebab("api_name")).alias("kebab"), T.bare_name("api_name").alias("bare"), T.id15("sf_id").alias("id15"), T.looks_like_id("sf_id").alias("is_id"), T.is_custom_object("api_name").alias("custom"))


@query("SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN 'customer' || (id % 10) ELSE '' END, '') AS token FROM comps")
def rest_path_token(spark, d):
    uri = F.expr("CASE WHEN id % 3 = 0 THEN '/services/data/' || id WHEN id % 3 = 1 THEN '/{v}/Customer' || (id % 10) || '/list' ELSE '/9x/' || id END")
    return I.components(spark, d).select("id", T.rest_path_token(uri).alias("token"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderdate > TIMESTAMP '2000-01-01' - INTERVAL 365 DAY AS recent FROM orders", base=False)
def recently_changed(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("s", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    read = o.withColumn("t", T.parse_timestamp("s"))
    return read.select("o_orderkey", F.date_format("t", "yyyy-MM-dd").alias("day"), T.recently_changed("t", "t", F.expr("timestamp'2000-01-01'"), F.lit(365)).alias("recent"))


@query()
def split_source(spark, d):
    rows = _docs(spark, d).select("doc_id", F.lit(".cls").alias("suffix"), F.col("text").alias("content"))
    out = S.split_source(rows)
    return out.select("doc_id", F.length("code").alias("code_chars"), F.length("comments").alias("comment_chars"), F.size("literals").alias("literals"), F.size("spans").alias("spans"))


@query()
def member_spans(spark, d):
    rows = I.components(spark, d).select(F.col("id").alias("artifact_id"), F.expr("'<CustomObject>\n<fields>\n<fullName>' || api_name || '</fullName>\n</fields>\n</CustomObject>'").alias("content"))
    return S.member_spans(rows)


# --- files and references -----------------------------------------------------------------------------------------------


@query(
    "SELECT artifact_id, 'ApexClass' AS metadata_type, member_name || '_' || artifact_id AS member_name, '.cls' AS suffix, (lower(member_name) || '_' || artifact_id) LIKE 'test%' OR is_test AS is_test, true AS is_code FROM arts"
)
def artifact_attributes(spark, d):
    rows = I.artifacts(spark, d).select("artifact_id", F.concat(F.lit("main/classes/"), "member_name", F.lit("_"), "artifact_id", F.lit(".cls")).alias("path"), F.when(F.col("is_test"), "@IsTest class").otherwise("class").alias("content"))
    return AR.artifact_attributes(rows).select("artifact_id", "metadata_type", "member_name", "suffix", "is_test", "is_code")


@query("SELECT artifact_id, NOT (metadata_type = 'Flow' AND NOT is_active) AND NOT (metadata_type = 'ApexClass' AND is_test) AS is_active FROM arts")
def consumer_active(spark, d):
    a = I.artifacts(spark, d).withColumn("path", F.concat("metadata_type", F.lit("/"), "artifact_id"))
    own = a.select("artifact_id", "path", "metadata_type", F.when(~F.col("is_active"), "<status>Draft</status>").otherwise("<a/>").alias("content"))
    meta = a.filter("metadata_type = 'ApexClass' and is_test").select(F.lit(None).cast("long").alias("artifact_id"), F.concat("path", F.lit("-meta.xml")).alias("path"), F.lit("Meta").alias("metadata_type"), F.lit("<status>Inactive</status>").alias("content"))
    return AR.consumer_active(own.unionByName(meta)).filter("artifact_id is not null").select("artifact_id", "is_active")


@query("SELECT id, in_scope, CASE WHEN NOT in_scope THEN 'STANDARD_OBJECT' END AS reason FROM comps WHERE namespace IS NULL")
def scope_components(spark, d):
    raw = I.components(spark, d).select("id", "api_name", "namespace", (~F.col("in_scope")).alias("is_standard"))
    return AR.scope_components(raw).select("id", "in_scope", F.col("out_of_scope_reason").alias("reason"))


@query("SELECT artifact_id, component_id, match_kind, max(CASE tier WHEN 'A' THEN 3 WHEN 'B' THEN 2 ELSE 1 END) AS best FROM edges GROUP BY 1, 2, 3")
def best_edge(spark, d):
    return RE.best_edge(I.edges(spark, d)).select("artifact_id", "component_id", "match_kind", T.mapped("tier", {"A": "3", "B": "2", "C": "1"}).cast("int").alias("best"))


_SAID = r"""
words AS (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS w FROM benchmark),
registry AS (SELECT lower(w) AS name, min(item_id) AS item, CASE WHEN length(w) % 2 = 0 THEN 'ApexClass' ELSE 'CustomField' END AS ctype FROM words WHERE length(w) >= 4 GROUP BY lower(w), CASE WHEN length(w) % 2 = 0 THEN 'ApexClass' ELSE 'CustomField' END),
toks AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'))) AS t FROM documents)
"""


def _registry(spark, d):
    words = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.explode(F.regexp_extract_all("text", F.lit(V.TOKEN), 0)).alias("w")).filter("length(w) >= 4")
    names = words.groupBy(F.lower("w").alias("name")).agg(F.min("item_id").alias("item"))
    return names.select(F.col("name").alias("id"), F.when(F.length("name") % 2 == 0, V.CLASS).otherwise(V.FIELD).alias("ctype"), F.concat(F.lit("item_"), F.col("item")).alias("parent_object"))


def _layers(spark, d):
    return RE.union_layers(_docs(spark, d).select(F.col("doc_id").alias("artifact_id"), F.col("text").alias("code")), ("code",))


def _files(spark, d):
    return _docs(spark, d).select(F.col("doc_id").alias("artifact_id"), F.when(F.col("doc_id") % 4 == 0, "Profile").otherwise("ApexClass").alias("metadata_type"), (F.col("doc_id") % 2 == 0).alias("is_code"), (F.col("lang") == "de").alias("is_test"), (F.col("lang") != "fr").alias("is_active"))


_REF = _SAID + f""", able AS (SELECT name AS w, ctype FROM registry),
refs AS (SELECT doc_id AS artifact_id, name AS component_id, CASE WHEN lang IN ('de', 'fr') OR doc_id % 4 = 0 THEN 'C' ELSE 'A' END AS tier FROM toks JOIN registry ON t = name JOIN documents USING (doc_id)
  WHERE doc_id % 2 = 0 OR (SELECT {_SWEEP.replace('w ', 't ').replace('(w', '(t').replace('w,', 't,')}))"""


@query(f"WITH {_REF} SELECT artifact_id, component_id, 'token_sweep' AS match_kind, tier FROM refs", base=False)
def resolve_references(spark, d):
    """Which names of the registry do the documents mention, and what is each mention worth?"""
    registry = _registry(spark, d)
    aliases = registry.select(F.col("id").alias("component_id"), F.col("id").alias("alias_lc"), F.lit("api_name").alias("alias_kind"))
    edges = RE.resolve_references(_layers(spark, d), aliases, registry, _files(spark, d))
    return edges.select("artifact_id", "component_id", "match_kind", "tier")


@query(f"WITH {_REF} SELECT component_id, count(DISTINCT artifact_id) AS sources, count(*) FILTER (tier = 'A') AS tier_a, count(*) FILTER (tier = 'C') AS tier_c FROM refs GROUP BY 1", base=False)
def referenced_components(spark, d):
    """The flagship: which components are referenced, by how many files, and how surely."""
    return resolve_references(spark, d).groupBy("component_id").agg(F.countDistinct("artifact_id").alias("sources"), F.count_if(F.col("tier") == "A").alias("tier_a"), F.count_if(F.col("tier") == "C").alias("tier_c"))


_SELF = """marked AS (SELECT e.*, a.metadata_type, a.member_name, a.is_active, coalesce((a.metadata_type = 'CustomObject' AND a.member_name IN (c.parent_object, c.api_name)) OR (a.metadata_type = 'ApexClass' AND lower(a.member_name) IN (lower(c.api_name), lower(c.parent_object))), false) AS is_self
  FROM edges e JOIN arts a USING (artifact_id) JOIN comps c ON c.id = e.component_id)"""


@query(f", {_SELF} SELECT artifact_id, component_id, tier, match_kind, alias_kind, is_self FROM marked")
def mark_self_references(spark, d):
    return RE.mark_self_references(I.edges(spark, d), I.artifacts(spark, d), I.components(spark, d)).select("artifact_id", "component_id", "tier", "match_kind", "alias_kind", "is_self")


@query(
    f", {_SELF} SELECT c.id AS component_id, count(*) FILTER (tier = 'A' AND NOT is_self) AS tier_a, count(*) FILTER (tier = 'C') AS tier_c, count(DISTINCT artifact_id) FILTER (NOT is_self) AS sources, count(*) FILTER (tier = 'A' AND metadata_type = 'Layout') AS layout_refs,"
    " count(*) FILTER (tier = 'A' AND NOT is_self AND metadata_type NOT IN ('Layout', 'FlexiPage', 'CompactLayout')) AS functional_refs, coalesce(array_to_string(list_sort(list(DISTINCT metadata_type) FILTER (tier = 'C' AND NOT is_self)), '|'), '') AS weak_types FROM comps c LEFT JOIN (SELECT * FROM marked WHERE is_active) m ON m.component_id = c.id WHERE c.in_scope GROUP BY 1"
)
def static_reference_rollup(spark, d):
    r = EV.static_reference_rollup(I.components(spark, d), I.edges(spark, d), I.artifacts(spark, d))
    return r.select("component_id", "tier_a", "tier_c", "sources", "layout_refs", "functional_refs", _joined("weak_types"))


@query(f", {_SELF}, s AS (SELECT component_id, count(*) FILTER (tier = 'A' AND NOT is_self) AS a, count(*) FILTER (tier = 'C') AS c FROM marked WHERE is_active GROUP BY 1) SELECT CASE WHEN a > 0 THEN 'EVIDENCE_OF_USE' WHEN c > 0 THEN 'INCONCLUSIVE' ELSE 'NO_EVIDENCE_FOUND' END AS result, count(*) AS components FROM comps LEFT JOIN s ON id = component_id WHERE in_scope GROUP BY 1")
def collect_static(spark, d):
    return EV.collect_static(I.components(spark, d), I.edges(spark, d), I.artifacts(spark, d)).groupBy("result").agg(F.count("*").alias("components"))


@query("SELECT id FROM comps WHERE in_scope AND id NOT IN (SELECT component_id FROM edges WHERE tier = 'A')")
def zero_reference_components(spark, d):
    return RE.zero_reference_components(I.components(spark, d), I.edges(spark, d)).select("id")


@query("SELECT tier, match_kind, count(*) AS edges FROM edges GROUP BY 1, 2")
def edge_profile(spark, d):
    return RE.edge_profile(I.edges(spark, d))


@query("SELECT component_id, count(*) AS refs, count(DISTINCT artifact_id) AS sources FROM edges WHERE tier = 'A' GROUP BY 1 ORDER BY refs DESC, component_id LIMIT 10")
def most_referenced(spark, d):
    return RE.most_referenced(I.edges(spark, d))


@query(f", {_SELF} SELECT component_id, least(count(*), 5) AS shown FROM marked WHERE NOT is_self GROUP BY 1")
def referenced_by(spark, d):
    return RE.referenced_by(I.edges(spark, d), I.artifacts(spark, d), I.components(spark, d), 5).groupBy("component_id").agg(F.count("*").alias("shown"))


# --- collectors ------------------------------------------------------------------------------------------------------------


@query("SELECT unnest(['c_name', 'c_acctbal', 'rich']) AS field, count(*) AS total, unnest([count(c_name), count(c_acctbal), count(CASE WHEN c_acctbal > 5000 THEN 1 END)]) AS filled, round(100.0 * unnest([count(c_name), count(c_acctbal), count(CASE WHEN c_acctbal > 5000 THEN 1 END)]) / count(*), 2) AS pct FROM customer", base=False)
def field_population(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").withColumn("rich", F.when(F.col("c_acctbal") > 5000, 1))
    return EV.field_population(c, ["c_name", "c_acctbal", "rich"])


@query("SELECT unnest(['c_name', 'none']) AS field, unnest([count(c_name) > 0, count(CASE WHEN c_acctbal > 1e12 THEN 1 END) > 0]) AS has_value FROM customer", base=False)
def field_has_any_value(spark, d):
    return EV.field_has_any_value(spark.read.parquet(f"{d}/customer.parquet").withColumn("none", F.when(F.col("c_acctbal") > 1e12, 1)), ["c_name", "none"])


@query("SELECT 'customer' AS object, count(*) AS records FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part", base=False)
def record_counts(spark, d):
    return EV.record_counts({t: spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "orders", "part")})


@query(f", {I.LOG_SQL} SELECT bucket, key, count(*) AS total, count(*) FILTER (kind = 'execution') AS executions, count(*) FILTER (kind = 'object') AS objects, max(seen) AS last_seen FROM hits GROUP BY 1, 2")
def event_hits(spark, d):
    return E.event_hits(E.normalised_events(I.logs(spark, d))).select("bucket", "key", "total", "executions", "objects", "last_seen")


@query(f", {I.LOG_SQL} SELECT bucket, key, 2 * count(*) AS total, max(seen) AS last_seen, 'mixed' AS source FROM hits GROUP BY 1, 2")
def merge_event_hits(spark, d):
    h = E.event_hits(E.normalised_events(I.logs(spark, d)))
    return E.merge_event_hits(h, h).select("bucket", "key", "total", "last_seen", "source")


@query("SELECT c_nationkey AS key, array_to_string(list_sort(list(DISTINCT c_mktsegment))[1:3], '|') AS samples FROM customer GROUP BY 1", base=False)
def sample_values(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").withColumnRenamed("c_nationkey", "key")
    return E.sample_values(c, ["key"], "c_mktsegment", 3).select("key", _joined("samples"))


@query("SELECT lower(substr('0Z' || lpad((o_custkey % 100)::VARCHAR, 13, '0') || 'AAB', 1, 15)) AS class_key, count(*) AS runs FROM orders GROUP BY 1", base=False)
def async_runs(spark, d):
    return E.async_runs(spark.read.parquet(f"{d}/orders.parquet").selectExpr("'0Z' || lpad(CAST(o_custkey % 100 AS STRING), 13, '0') || 'AAB' AS class_id", "1 AS runs"))


#: Components whose names, ids and prefixes the logs of inputs.logs() name; both dialects read these expressions.
_RUNTIME = (
    "p_partkey AS id",
    "CASE p_size % 3 WHEN 0 THEN 'ApexClass' WHEN 1 THEN 'CustomObject' ELSE 'CustomField' END AS ctype",
    "CASE p_size % 3 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'Service' || p_partkey % 40 ELSE 'Rest' || p_partkey % 60 || 'Resource' END WHEN 1 THEN 'Entity_' || p_partkey || '__c' ELSE 'Obj.Field_' || p_partkey % 14 || '__c' END AS api_name",
    "CASE WHEN p_size % 3 = 0 THEN '01p' || lpad(CAST(p_partkey AS VARCHAR(20)), 12, '0') || 'AAA' END AS sf_id",
    "CASE WHEN p_size % 3 = 1 THEN 'A' || p_partkey % 40 END AS key_prefix",
)


@query(
    f", {I.LOG_SQL}, c AS (SELECT {', '.join(_RUNTIME)} FROM part), k AS (SELECT DISTINCT bucket, key FROM hits), n AS (SELECT *, lower(CASE WHEN ctype = 'CustomField' THEN split_part(api_name, '.', 2) ELSE api_name END) AS own FROM c), "
    "f AS (SELECT n.*, CASE WHEN ctype = 'ApexClass' AND ('class', own) IN (SELECT (bucket, key) FROM k) THEN 'class' WHEN ctype = 'ApexClass' AND (('rest_path', own) IN (SELECT (bucket, key) FROM k) OR ('rest_path', regexp_replace(own, '(resource|service)$', '')) IN (SELECT (bucket, key) FROM k)) THEN 'rest_path' "
    "WHEN ctype = 'CustomObject' AND ('object', own) IN (SELECT (bucket, key) FROM k) THEN 'object' WHEN ctype = 'CustomObject' AND ('key_prefix', lower(key_prefix)) IN (SELECT (bucket, key) FROM k) THEN 'key_prefix' WHEN ctype = 'CustomField' AND ('field', own) IN (SELECT (bucket, key) FROM k) THEN 'field' END AS bucket, "
    "(SELECT count(*) FROM orders WHERE 3 * o_custkey = n.id AND n.ctype = 'ApexClass') AS runs, n.ctype = 'ApexClass' AND n.api_name IN (SELECT api_name FROM c WHERE id % 29 = 0) AS scheduled FROM n) "
    "SELECT id AS component_id, bucket, runs, scheduled, CASE WHEN bucket IS NULL AND runs = 0 AND NOT scheduled THEN 'NO_EVIDENCE_FOUND' ELSE 'EVIDENCE_OF_USE' END AS result, CASE WHEN bucket IS NULL AND runs = 0 AND NOT scheduled THEN 0.0 WHEN ctype = 'ApexClass' AND bucket IS NOT NULL THEN 0.95 ELSE 0.9 END::DOUBLE AS weight FROM f"
)
def match_runtime(spark, d):
    """Logs by name, by REST path and by key prefix, runs of jobs, and schedules."""
    part, orders = spark.read.parquet(f"{d}/part.parquet"), spark.read.parquet(f"{d}/orders.parquet")
    c = part.selectExpr(*_RUNTIME)
    runs = E.async_runs(orders.selectExpr("'01P' || lpad(CAST(3 * o_custkey AS STRING), 12, '0') || 'AAB' AS class_id", "1 AS runs"))
    scheduled = c.filter("id % 29 = 0").select(F.upper("api_name").alias("class_name"))
    found = E.match_runtime(c, E.event_hits(E.normalised_events(I.logs(spark, d))), runs, scheduled)
    said = lambda path: F.get_json_object("payload", path)
    return found.select("component_id", said("$.hit.bucket").alias("bucket"), said("$.async_runs").cast("long").alias("runs"), said("$.scheduled").cast("boolean").alias("scheduled"), "result", "weight")


@query("SELECT id AS component_id, CASE WHEN count(DISTINCT s_name) > 0 THEN 'EVIDENCE_OF_USE' ELSE 'NO_EVIDENCE_FOUND' END AS result FROM comps LEFT JOIN lineitem ON l_partkey - l_partkey % 3 = id LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE in_scope AND ctype <> 'ApexMethod' GROUP BY 1")
def match_dependencies(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    named = I.components(spark, d).select("id", "sf_id")
    n = li.count()
    asked = dealt(li.select(F.expr("l_partkey - l_partkey % 3 AS id"), F.col("l_suppkey").alias("s_suppkey")), n, "id").join(dealt(named, n, "id"), "id")
    deps = asked.join(spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_name"), "s_suppkey").select(F.col("sf_id").alias("ref_id"), F.lit(None).cast("string").alias("ref_name"), F.col("s_name").alias("by_name"), F.lit("Report").alias("by_type"))
    return EV.match_dependencies(deps, I.components(spark, d), most_rows=n).select("component_id", "result")


@query("SELECT id AS component_id, CASE WHEN id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'EVIDENCE_OF_USE' ELSE 'NO_EVIDENCE_FOUND' END AS result FROM comps WHERE in_scope")
def match_config_data(spark, d):
    c = I.components(spark, d)
    target = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("  "), F.upper("api_name"))).otherwise(F.col("c_mktsegment"))
    rows = spark.read.parquet(f"{d}/customer.parquet").join(c.select("id", "api_name"), F.col("c_custkey") == F.col("id"), "left").select(target.alias("target"), "c_name")
    aliases = c.select(F.col("id").alias("component_id"), F.lower("api_name").alias("alias_lc"), F.lit("api_name").alias("alias_kind"))
    return EV.match_config_data(rows, ["target", "c_name"], "config", aliases, c).select("component_id", "result")


@query("SELECT id AS component_id, code FROM (SELECT id, 'RECENTLY_CHANGED' AS code, ctype, in_scope, o_orderdate FROM comps JOIN (SELECT o_custkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1) ON o_custkey = id) WHERE ctype <> 'ApexMethod' AND in_scope AND o_orderdate > TIMESTAMP '2000-01-01' - INTERVAL 700 DAY")
def collect_temporal(spark, d):
    dates = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("created_at"), F.max("o_orderdate").alias("modified_at"))
    return EV.collect_temporal(I.components(spark, d).join(dates, "id"), F.expr("timestamp'2000-01-01'"), F.lit(700)).select("component_id", "code")


@query(", t AS (SELECT DISTINCT component_id FROM edges JOIN arts USING (artifact_id) WHERE member_name IN (SELECT member_name FROM arts WHERE is_test)), o AS (SELECT DISTINCT lower(CASE WHEN ctype = 'CustomObject' THEN api_name ELSE parent_object END) AS o FROM comps WHERE id IN (SELECT component_id FROM t)) SELECT id AS component_id FROM comps WHERE in_scope AND (id IN (SELECT component_id FROM t) OR (ctype = 'CustomField' AND lower(parent_object) IN (SELECT o FROM o)))")
def propagate_taint(spark, d):
    dynamic = I.artifacts(spark, d).filter("is_test").select("path")
    return EV.propagate_taint(dynamic, I.edges(spark, d), I.artifacts(spark, d), I.components(spark, d)).select("component_id")


@query("SELECT collector_id, 'OK' AS status, coalesce(n, 0) AS searched, coalesce(h, 0) AS hits FROM (VALUES ('C10_static_index'), ('C20_data_population'), ('C30_dependency_api'), ('C70_reachability')) v(collector_id) LEFT JOIN (SELECT collector_id, count(*) AS n, count(*) FILTER (result = 'EVIDENCE_OF_USE') AS h FROM evidence GROUP BY 1) USING (collector_id)")
def collector_ledger(spark, d):
    names = spark.createDataFrame([(c, "OK") for c in (V.STATIC, V.POPULATION, V.DEPENDENCY, V.REACHABILITY)], "collector_id string, status string")
    return EV.collector_ledger(I.evidence(spark, d), names)


@query("SELECT component_id, collector_id, result FROM evidence")
def union_evidence(spark, d):
    e = I.evidence(spark, d)
    return EV.union_evidence(e.withColumn("result", F.lit("OLD")), e).select("component_id", "collector_id", "result")


@query("SELECT id FROM comps WHERE id IN (SELECT component_id FROM evidence WHERE collector_id = 'C10_static_index' AND result = 'EVIDENCE_OF_USE') AND id NOT IN (SELECT component_id FROM evidence WHERE collector_id = 'C20_data_population') AND id NOT IN (SELECT component_id FROM flags WHERE code = 'RECENTLY_CHANGED')")
def filter_by_evidence_tags(spark, d):
    tags = [f"{V.STATIC}:{V.HIT}", f"{V.POPULATION}:{V.NOT_APPLICABLE}", f"{V.TEMPORAL}:NOFLAG"]
    return EV.filter_by_evidence_tags(I.components(spark, d), I.evidence(spark, d), I.flags(spark, d), tags).select("id")


@query("SELECT c.id AS component_id, k.collector_id, CASE WHEN k.flag THEN CASE WHEN f.component_id IS NULL THEN 'noflag' ELSE 'flagged' END WHEN g.component_id IS NOT NULL THEN 'incomplete' WHEN e.result = 'EVIDENCE_OF_USE' THEN 'hit' WHEN e.result = 'NO_EVIDENCE_FOUND' THEN 'clear' WHEN e.result = 'INCONCLUSIVE' THEN 'incomplete' ELSE 'na' END AS state FROM comps c JOIN (VALUES ('CustomField', 'C10_static_index', false), ('CustomField', 'C50_temporal', true), ('ApexClass', 'C10_static_index', false), ('ApexClass', 'C40_runtime', false)) k(ctype, collector_id, flag) USING (ctype) LEFT JOIN evidence e ON e.component_id = c.id AND e.collector_id = k.collector_id LEFT JOIN gaps g ON g.component_id = c.id AND g.collector_id = k.collector_id LEFT JOIN flags f ON f.component_id = c.id AND f.code = 'RECENTLY_CHANGED'")
def check_matrix(spark, d):
    checks = spark.createDataFrame([(V.FIELD, V.STATIC, None), (V.FIELD, V.TEMPORAL, "RECENTLY_CHANGED"), (V.CLASS, V.STATIC, None), (V.CLASS, V.RUNTIME, None)], "ctype string, collector_id string, flag_code string")
    return EV.check_matrix(I.components(spark, d), checks, I.evidence(spark, d), I.gaps(spark, d), I.flags(spark, d))


# --- the graph ----------------------------------------------------------------------------------------------------------------


def _parts_links(spark, d):
    """The edges as often as the tables name them: what goes along them needs each only once, and they aren't sorted for it."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    edges = li.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("reference").alias("kind"))
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst"), F.when(F.col("o_orderstatus") == "P", "declares").otherwise("reference").alias("kind"))
    return edges.unionByName(orders)


def _parts_graph(spark, d):
    return _parts_links(spark, d).distinct()


_GRAPH = "g AS (SELECT DISTINCT * FROM (SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, 'reference' AS kind FROM lineitem UNION ALL SELECT 'p' || o_custkey, 'o' || o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'declares' ELSE 'reference' END FROM orders))"


@query(f"WITH RECURSIVE {_GRAPH}, walk(key, distance) AS (SELECT 'p' || p_partkey, 0 FROM part WHERE p_partkey % 101 = 0 UNION SELECT dst, distance + 1 FROM walk JOIN g ON src = key WHERE kind <> 'declares' AND distance < 30) SELECT key, min(distance) AS distance FROM walk GROUP BY 1", base=False)
def reachability(spark, d):
    nodes = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), (F.col("p_partkey") % 101 == 0).alias("is_entry_point"))
    return G.reachability(nodes, _parts_links(spark, d)).select("key", "distance")


@query(f"WITH {_GRAPH} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM g UNION ALL SELECT dst FROM g) GROUP BY 1", base=False)
def degree(spark, d):
    return G.degree(_parts_graph(spark, d))


@query("WITH RECURSIVE e AS (SELECT 'p' || (l_partkey) AS a, 'p' || (l_partkey - 7) AS b FROM lineitem WHERE l_partkey > 7), m AS (SELECT 'p' || p_partkey AS n FROM part), b AS (SELECT a, b FROM e JOIN m x ON x.n = a JOIN m y ON y.n = b UNION SELECT b, a FROM e JOIN m x ON x.n = a JOIN m y ON y.n = b), w(n, c) AS (SELECT n, n FROM m UNION SELECT b.a, w.c FROM w JOIN b ON b.b = w.n WHERE w.c < b.a) SELECT n AS node, min(c) AS cluster FROM w GROUP BY 1", base=False)
def clusters(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").filter("l_partkey > 7")
    p = lambda c: F.concat(F.lit("p"), c.cast("string"))
    return G.clusters(spark.read.parquet(f"{d}/part.parquet").select(p(F.col("p_partkey")).alias("node")), li.select(p(F.col("l_partkey")).alias("src"), p(F.col("l_partkey") - 7).alias("dst")))


@query(f"WITH {_GRAPH} SELECT DISTINCT * FROM (SELECT src AS node, 'out' AS direction, dst AS other FROM g UNION ALL SELECT dst, 'in', src FROM g) WHERE node IN (SELECT 'p' || p_partkey FROM part WHERE p_size = 1)", base=False)
def neighbours(spark, d):
    return G.neighbours(_parts_graph(spark, d), spark.read.parquet(f"{d}/part.parquet").filter("p_size = 1").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node")))


@query(f"WITH RECURSIVE {_GRAPH}, w(start, node) AS (SELECT 'p' || p_partkey, 'p' || p_partkey FROM part WHERE p_partkey <= 3 UNION SELECT start, dst FROM w JOIN g ON src = node) SELECT start, node FROM w WHERE start <> node", base=False)
def closure(spark, d):
    starts = spark.read.parquet(f"{d}/part.parquet").filter("p_partkey <= 3").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"))
    return G.closure(_parts_links(spark, d), starts).select("start", "node")


@query("SELECT 'component' AS kind, count(*) AS nodes, count(*) FILTER (is_entry_point) AS entries FROM comps UNION ALL SELECT 'artifact', count(*), count(*) FILTER (metadata_type = 'Flow' AND is_active AND NOT is_test) FROM arts")
def build_nodes(spark, d):
    return G.build_nodes(I.components(spark, d), I.artifacts(spark, d)).groupBy("kind").agg(F.count("*").alias("nodes"), F.count_if("is_entry_point").alias("entries"))


@query(
    ", e AS (SELECT 'a:' || artifact_id AS src, 'c:' || component_id AS dst, 0 AS k FROM edges WHERE tier IN ('A', 'B') UNION ALL SELECT 'c:' || id, 'a:' || artifact_id, 1 FROM arts JOIN comps ON ctype = metadata_type AND lower(api_name) = lower(member_name) UNION ALL SELECT 'a:' || artifact_id, 'c:' || id, 3 FROM arts JOIN comps ON ctype = metadata_type AND lower(api_name) = lower(member_name)"
    " UNION ALL SELECT 'c:' || id, 'c:' || parent_id, 2 FROM comps WHERE parent_id IS NOT NULL) SELECT CASE k WHEN 0 THEN 'reference' WHEN 1 THEN 'implements' WHEN 2 THEN 'member_of' ELSE 'declares' END AS kind, count(*) AS edges FROM (SELECT src, dst, min(k) AS k FROM e WHERE src <> dst GROUP BY 1, 2) GROUP BY 1"
)
def build_edges(spark, d):
    return G.build_edges(I.edges(spark, d), I.components(spark, d), I.artifacts(spark, d)).groupBy("kind").agg(F.count("*").alias("edges"))


# --- verdicts and reports ---------------------------------------------------------------------------------------------------------

_RAN = [V.STATIC, V.POPULATION, V.RUNTIME, V.REACHABILITY]
_CLASSIFY = """
w AS (SELECT c.*, e.*, g.component_id IS NOT NULL AS gap, coalesce(f.n, 0) AS n_flags, coalesce(f.review, '') AS review FROM comps c
  LEFT JOIN (SELECT component_id, count(*) FILTER (result = 'EVIDENCE_OF_USE') AS used, count(*) FILTER (result = 'EVIDENCE_OF_USE' AND tier = 'A') AS a, count(*) FILTER (result = 'EVIDENCE_OF_USE' AND tier = 'B') AS b,
    count(*) FILTER (result = 'EVIDENCE_OF_USE' AND tier = 'A' AND NOT (collector_id = 'C10_static_index' AND component_id % 10 = 0)) AS a_other, bool_or(collector_id = 'C20_data_population' AND result = 'NO_EVIDENCE_FOUND') AS no_data,
    count(*) FILTER (collector_id = 'C70_reachability') AS n_reach, bool_or(collector_id = 'C70_reachability' AND component_id % 4 = 0) AS reach,
    sum(CASE result WHEN 'EVIDENCE_OF_USE' THEN trunc(30 * CASE WHEN weight = 0 THEN 1 ELSE weight END) WHEN 'NO_EVIDENCE_FOUND' THEN 15 ELSE -10 END) AS points FROM evidence GROUP BY 1) e ON e.component_id = c.id
  LEFT JOIN gaps g ON g.component_id = c.id LEFT JOIN (SELECT component_id, count(*) AS n, string_agg(code, ', ') FILTER (code <> 'RECENTLY_CHANGED') AS review FROM flags GROUP BY 1) f ON f.component_id = c.id),
x AS (SELECT *, 50 + points - 30 * n_flags AS conf, id % 5 = 1 AND used = 0 AS weak, (id % 2 = 0 AND (ctype NOT IN ('CustomField', 'CustomObject') OR no_data)) AND NOT gap AS presence FROM w),
ruled AS (SELECT *, CASE WHEN namespace IS NOT NULL THEN 'R0' WHEN NOT in_scope THEN 'R1' WHEN gap AND used = 0 THEN 'R2' WHEN a > 0 AND a_other = 0 AND no_data AND NOT gap AND review <> '' THEN 'R6' WHEN a > 0 AND a_other = 0 AND no_data AND NOT gap THEN 'R3a' WHEN a > 0 THEN 'R3' WHEN b > 0 THEN 'R4'
  WHEN ctype IN ('ApexClass', 'ApexMethod') AND is_entry_point THEN 'R5' WHEN ctype = 'LightningComponentBundle' AND (is_exposed OR is_entry_point) THEN 'R5' WHEN is_test THEN 'R5' WHEN review <> '' THEN 'R6'
  WHEN n_reach > 0 AND NOT reach AND ctype IN ('ApexClass', 'ApexTrigger', 'ApexMethod', 'LightningComponentBundle') AND NOT is_entry_point THEN 'R5b' WHEN weak AND presence THEN 'R7a' WHEN weak THEN 'R7' WHEN NOT gap THEN 'R9' ELSE 'R2' END AS rule FROM x),
judged AS (SELECT id AS component_id, rule, CASE WHEN rule IN ('R0', 'R1') THEN 'OUT_OF_SCOPE' WHEN rule IN ('R3', 'R4') THEN 'USED' WHEN rule IN ('R3a', 'R5b', 'R7a', 'R9') THEN 'UNUSED' ELSE 'NEEDS_REVIEW' END AS label,
  greatest(0, least(100, CASE rule WHEN 'R0' THEN 100 WHEN 'R1' THEN 100 WHEN 'R2' THEN least(conf, 55) WHEN 'R3a' THEN least(conf, 70) WHEN 'R3' THEN greatest(conf, 80) WHEN 'R4' THEN greatest(least(conf, 75), 60) WHEN 'R5' THEN least(conf, 60) WHEN 'R6' THEN least(conf, 60)
    WHEN 'R5b' THEN greatest(least(conf, 85), 70) WHEN 'R7a' THEN least(conf, 70) WHEN 'R7' THEN least(conf, 65) ELSE greatest(conf, 70) END))::DOUBLE AS confidence FROM ruled)
"""


def _classified(spark, d):
    return C.classify(I.components(spark, d), I.evidence(spark, d), I.gaps(spark, d), I.flags(spark, d), _RAN)


@query(f", {_CLASSIFY} SELECT component_id, rule, label, confidence FROM judged")
def classify(spark, d):
    return _classified(spark, d).select("component_id", F.col("rule_trace")[0]["rule"].alias("rule"), "label", "confidence")


_PROMOTE = "up AS (SELECT DISTINCT parent_id FROM comps JOIN judged ON id = component_id WHERE ctype = 'ApexMethod' AND judged.label = 'USED'), promoted AS (SELECT component_id, CASE WHEN parent_id IS NOT NULL THEN 'USED' ELSE label END AS label, CASE WHEN parent_id IS NOT NULL AND label <> 'USED' THEN greatest(confidence, 80) ELSE confidence END AS confidence FROM judged LEFT JOIN up ON parent_id = component_id)"


@query(f", {_CLASSIFY}, {_PROMOTE} SELECT * FROM promoted")
def promote_parents(spark, d):
    return C.promote_parents(_classified(spark, d), I.components(spark, d)).select("component_id", "label", "confidence")


@query(
    f", {_CLASSIFY}, {_PROMOTE}, src AS (SELECT artifact_id, id AS src, p.label AS src_label FROM arts JOIN comps ON ctype = metadata_type AND lower(api_name) = lower(member_name) JOIN promoted p ON p.component_id = id WHERE metadata_type <> 'Layout'),"
    " r AS (SELECT e.component_id, bool_or(src_label <> 'UNUSED') AS live FROM edges e JOIN src USING (artifact_id) WHERE tier = 'A' AND src <> e.component_id GROUP BY 1) SELECT p.component_id, CASE WHEN label = 'UNUSED' AND coalesce(live, false) THEN 'NEEDS_REVIEW' ELSE label END AS label, CASE WHEN label = 'UNUSED' AND coalesce(live, false) THEN least(confidence, 60) ELSE confidence END AS confidence FROM promoted p LEFT JOIN r USING (component_id)"
)
def audit(spark, d):
    """The whole chain: evidence, rules, promotion, guard."""
    out = C.audit(I.components(spark, d), I.artifacts(spark, d), I.edges(spark, d), I.evidence(spark, d), I.gaps(spark, d), I.flags(spark, d), _RAN)
    return out.select("component_id", "label", "confidence")


@query("SELECT c.id AS component_id, v.label, coalesce(e.h, 0) AS hits, coalesce(e.m, 0) AS clean, coalesce(g.n, 0) AS gaps, coalesce(f.n, 0) AS flags FROM comps c LEFT JOIN verdicts v ON v.component_id = c.id LEFT JOIN (SELECT component_id, count(*) FILTER (result = 'EVIDENCE_OF_USE') AS h, count(*) FILTER (result = 'NO_EVIDENCE_FOUND') AS m FROM evidence GROUP BY 1) e ON e.component_id = c.id LEFT JOIN (SELECT component_id, count(*) AS n FROM gaps GROUP BY 1) g ON g.component_id = c.id LEFT JOIN (SELECT component_id, count(*) AS n FROM flags GROUP BY 1) f ON f.component_id = c.id")
def component_summary(spark, d):
    out = R.component_summary(I.components(spark, d), I.verdicts(spark, d), I.evidence(spark, d), I.gaps(spark, d), I.flags(spark, d))
    return out.select("component_id", "label", "hits", "clean", "gaps", "flags")


@query("SELECT label, count(*) AS components FROM verdicts GROUP BY 1")
def verdict_totals(spark, d):
    return R.verdict_totals(I.verdicts(spark, d))


@query("SELECT ctype, count(*) FILTER (v.label = 'UNUSED') AS UNUSED, count(*) FILTER (v.label = 'NEEDS_REVIEW') AS NEEDS_REVIEW, count(*) FILTER (v.label = 'USED') AS USED, count(*) FILTER (v.label = 'OUT_OF_SCOPE') AS OUT_OF_SCOPE FROM comps JOIN verdicts v ON component_id = id GROUP BY 1")
def verdicts_by_type(spark, d):
    return R.verdicts_by_type(I.verdicts(spark, d), I.components(spark, d))


@query("SELECT ctype, api_name AS member FROM comps JOIN verdicts v ON component_id = id WHERE v.label = 'UNUSED'")
def removal_manifest(spark, d):
    return R.removal_manifest(I.components(spark, d), I.verdicts(spark, d))


@query(f", {_CLASSIFY} SELECT trim(split_part(CASE rule WHEN 'R2' THEN 'INSUFFICIENT_EVIDENCE' WHEN 'R6' THEN 'DYNAMIC_APEX_IN_SCOPE' WHEN 'R7' THEN 'WEAK_SIGNAL_ONLY' ELSE CASE WHEN ctype IN ('ApexClass', 'ApexMethod') AND is_entry_point THEN 'UNCALLED_ENTRY_POINT' WHEN ctype = 'LightningComponentBundle' AND (is_exposed OR is_entry_point) THEN 'EXPOSED_UI_NO_PLACEMENT' ELSE 'TEST_ONLY' END END, '(', 1)) AS reason, count(*) AS components FROM judged JOIN comps ON id = component_id WHERE judged.label = 'NEEDS_REVIEW' GROUP BY 1")
def reason_frequencies(spark, d):
    return R.reason_frequencies(_classified(spark, d))


@query("SELECT component_id, label, confidence FROM comps JOIN verdicts ON component_id = id ORDER BY CASE verdicts.label WHEN 'UNUSED' THEN 0 WHEN 'NEEDS_REVIEW' THEN 1 WHEN 'USED' THEN 2 ELSE 3 END, confidence DESC, api_name, component_id LIMIT 500".replace("SELECT component_id, label", "SELECT component_id, verdicts.label AS label"))
def component_list(spark, d):
    s = I.components(spark, d).select(F.col("id").alias("component_id"), "api_name").join(I.verdicts(spark, d), "component_id")
    return R.component_list(s, 500).select("component_id", "label", "confidence")


@query("SELECT component_id, verdicts.label AS label FROM comps JOIN verdicts ON component_id = id WHERE verdicts.label IN ('UNUSED', 'NEEDS_REVIEW') ORDER BY verdicts.label = 'UNUSED' DESC, confidence DESC, api_name, component_id LIMIT 200")
def review_queue(spark, d):
    s = I.components(spark, d).select(F.col("id").alias("component_id"), "api_name").join(I.verdicts(spark, d), "component_id")
    return R.review_queue(s).select("component_id", "label")


@query("SELECT id, ctype, api_name FROM comps WHERE contains(lower(api_name), 'ring') ORDER BY length(api_name), api_name, id LIMIT 10")
def near_names(spark, d):
    return R.near_names(I.components(spark, d), "RING")


@query(", cl AS (SELECT id FROM comps WHERE ctype = 'ApexClass' AND contains(lower(api_name), 'red')), m AS (SELECT parent_id, id, contains(lower(api_name), 'red') AS hit FROM comps WHERE ctype = 'ApexMethod') SELECT k.class_id, s.method_id FROM (SELECT id AS class_id FROM cl UNION SELECT parent_id FROM m WHERE hit) k LEFT JOIN (SELECT parent_id AS class_id, id AS method_id FROM m WHERE hit OR parent_id IN (SELECT id FROM cl)) s USING (class_id)")
def grouped_search(spark, d):
    return R.grouped_search(I.components(spark, d), "Red")


@query("SELECT path, v.label, count(DISTINCT component_id) AS components FROM arts JOIN (SELECT id, lower(api_name) AS n FROM comps UNION SELECT id, lower(parent_object) FROM comps) c ON n = lower(member_name) JOIN verdicts v ON component_id = id GROUP BY 1, 2")
def file_component_map(spark, d):
    return R.file_component_map(I.artifacts(spark, d), I.components(spark, d), I.verdicts(spark, d))


@query("SELECT ctype, count(*) AS components FROM comps WHERE lower(api_name) NOT IN (SELECT lower(member_name) FROM arts) AND lower(parent_object) NOT IN (SELECT lower(member_name) FROM arts) GROUP BY 1")
def unmapped_components(spark, d):
    return R.unmapped_components(I.artifacts(spark, d), I.components(spark, d))


@query(", fc AS (SELECT path, v.label AS label, count(*) AS n FROM arts JOIN comps ON lower(api_name) = lower(member_name) JOIN verdicts v ON component_id = id GROUP BY 1, 2), s AS (SELECT unnest(['', 'src', 'src/' || split_part(path, '/', 2)]) AS folder, label, n FROM fc), g AS (SELECT folder, label, sum(n) AS n FROM s GROUP BY 1, 2) SELECT folder, coalesce(sum(n) FILTER (label = 'UNUSED'), 0)::BIGINT AS unused, coalesce(sum(n) FILTER (label = 'USED'), 0)::BIGINT AS used, arg_max(label, n) AS dominant FROM g GROUP BY 1")
def folder_rollup(spark, d):
    a = I.artifacts(spark, d).select("path", F.lower("member_name").alias("n")).join(I.components(spark, d).select(F.lower("api_name").alias("n"), F.col("id").alias("component_id")), "n").join(I.verdicts(spark, d), "component_id")
    return R.folder_rollup(a.groupBy("path", "label").agg(F.count("*").alias("components"))).select("folder", "unused", "used", "dominant")


@query("SELECT component_id, collector_id, result, e.weight, status, searched FROM evidence e JOIN comps ON id = component_id LEFT JOIN (SELECT 'C10_static_index' AS collector_id, 'OK' AS status, 7 AS searched) USING (collector_id)")
def evidence_detail(spark, d):
    runs = spark.createDataFrame([(V.STATIC, "OK", 7)], "collector_id string, status string, searched int")
    return R.evidence_detail(I.evidence(spark, d), I.components(spark, d), runs).select("component_id", "collector_id", "result", "weight", "status", "searched")


@query("SELECT component_id, collector_id, row_number() OVER (PARTITION BY component_id ORDER BY CASE result WHEN 'EVIDENCE_OF_USE' THEN 0 WHEN 'INCONCLUSIVE' THEN 1 WHEN 'NO_EVIDENCE_FOUND' THEN 2 ELSE 3 END, tier NULLS LAST, collector_id) AS place FROM evidence")
def evidence_order(spark, d):
    return R.evidence_order(I.evidence(spark, d)).select("component_id", "collector_id", "place")


@query("SELECT ctype, in_scope, count(*) AS components, count(*) FILTER (is_entry_point) AS entry_points, count(*) FILTER (is_test) AS tests FROM comps GROUP BY 1, 2")
def inventory_profile(spark, d):
    return R.inventory_profile(I.components(spark, d)).drop("orphan_fields")


@query("SELECT 1 AS run_id, component_id, (row_number() OVER (ORDER BY ctype, api_name, component_id) - 1) // 25 AS batch FROM comps JOIN verdicts v ON component_id = id WHERE v.label = 'UNUSED'")
def removal_batches(spark, d):
    s = I.components(spark, d).select(F.col("id").alias("component_id"), "ctype", "api_name").join(I.verdicts(spark, d).filter("label = 'UNUSED'"), "component_id").withColumn("run_id", F.lit(1))
    return R.removal_batches(s, 25)


@query(f", {_CLASSIFY} SELECT component_id, confidence, CASE WHEN rule = 'R3a' THEN 3 ELSE 0 END AS steps, false AS blocked FROM judged WHERE label = 'UNUSED'")
def removal_readiness(spark, d):
    return R.removal_readiness(_classified(spark, d))


@query("SELECT path, line, text FROM (SELECT 'd' || doc_id AS path, generate_subscripts(string_split(text, chr(10)), 1) AS line, left(unnest(string_split(text, chr(10))), 400) AS text, unnest(string_split(text, chr(10))) AS whole FROM documents) WHERE regexp_matches(whole, '(?i)password|token') ORDER BY path, line LIMIT 200", base=False)
def grep_artifacts(spark, d):
    return R.grep_artifacts(_docs(spark, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content")), "(?i)password|token")


# --- runs -----------------------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey AS org_id, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS run_id FROM orders GROUP BY 1", base=False)
def latest_run(spark, d):
    return RU.latest_run(I.runs(spark, d)).select("org_id", "run_id")


@query("SELECT o_orderkey AS run_id, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) - 1 AS later FROM orders", base=False)
def superseded_runs(spark, d):
    return RU.superseded_runs(I.runs(spark, d)).select("run_id", "later")


@query("SELECT o_orderkey AS run_id, coalesce(n, 0) AS components FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey ORDER BY o_orderdate DESC, run_id LIMIT 50", base=False)
def run_history(spark, d):
    v = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("run_id"), F.lit("USED").alias("label"))
    return RU.run_history(I.runs(spark, d).withColumn("finished_at", F.col("started_at")), v).select("run_id", "components")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events", base=False)
def assign_sequence(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"), "event_id")
    return RU.assign_sequence(e).select("event_id", "seq")


@query("SELECT run_id, after, seq FROM (SELECT user_id AS run_id, event_id AS seq, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM events) WHERE seq - after > 1", base=False)
def sequence_gaps(spark, d):
    return RU.sequence_gaps(spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq")))


def _slice(spark, d, condition):
    o = spark.read.parquet(f"{d}/orders.parquet").filter(condition).groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    return o.select(F.lit("org").alias("ctype"), F.col("o_custkey").cast("string").alias("api_name"), F.when(F.col("v") > 1_000_000, "USED").otherwise("UNUSED").alias("label"))


@query("WITH s AS (SELECT o_custkey::VARCHAR AS api_name, CASE WHEN sum(o_totalprice) FILTER (o_orderstatus <> 'O') > 1000000 THEN 'USED' WHEN count(*) FILTER (o_orderstatus <> 'O') > 0 THEN 'UNUSED' END AS before, CASE WHEN sum(o_totalprice) FILTER (o_orderstatus <> 'F') > 1000000 THEN 'USED' WHEN count(*) FILTER (o_orderstatus <> 'F') > 0 THEN 'UNUSED' END AS after FROM orders GROUP BY 1) SELECT api_name, before, after, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' WHEN before = 'UNUSED' AND after = 'USED' THEN 'regression' ELSE 'changed' END AS change FROM s WHERE before IS DISTINCT FROM after", base=False)
def compare_runs(spark, d):
    return RU.compare_runs(_slice(spark, d, "o_orderstatus <> 'O'"), _slice(spark, d, "o_orderstatus <> 'F'")).drop("ctype")


@query("SELECT user_id AS run_id, event_type AS stage, arg_max(event_id, event_id)::VARCHAR AS state FROM events GROUP BY 1, 2", base=False)
def fold_stage_state(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("state"), F.lit("").alias("note"), F.col("value").alias("progress"))
    snapshot = e.drop("seq").withColumn("state", F.lit("old")).dropDuplicates(["run_id", "stage"])
    return RU.fold_stage_state(snapshot, e).select("run_id", "stage", "state")


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN a.n ELSE coalesce(a.n, 0) + b.n END AS n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) b ON a.k = b.k", base=False)
def upsert_add(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    by = lambda s: o.filter(f"o_orderstatus {s} 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return files.upsert(by("="), by("<>"), ["k"], "add")


@query("SELECT event_type, log_date, file FROM (SELECT *, max((log_date >= TIMESTAMP '1999-01-01')::INT) OVER (PARTITION BY event_type) AS any_, row_number() OVER (PARTITION BY event_type ORDER BY log_date DESC, file) AS n FROM (SELECT o_orderstatus AS event_type, CASE WHEN o_orderstatus = 'P' THEN o_orderdate - INTERVAL 20 YEAR ELSE o_orderdate END AS log_date, o_orderkey AS file FROM orders)) WHERE CASE WHEN any_ = 1 THEN log_date >= TIMESTAMP '1999-01-01' AND n <= 5 ELSE n <= 3 END", base=False)
def latest_log_files(spark, d):
    """Orders as files, the status their type; those of status P are twenty years older, so that the type has none so new."""
    date = F.when(F.col("o_orderstatus") == "P", F.expr("o_orderdate - interval 20 years")).otherwise(F.col("o_orderdate"))
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderstatus").alias("event_type"), date.alias("log_date"), F.col("o_orderkey").alias("file"))
    return files.latest_log_files(o, "1999-01-01", 5)
