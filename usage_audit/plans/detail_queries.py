"""Queries that compare whole rows of operators of which the others compare a part."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import source as S
from ..operators import events as E
from ..operators import graph as G
from ..operators import reports as R
from ..operators import resolve as RE
from ..operators.joins import maybe_among
from . import inputs as I
from .queries import _GRAPH, _SELF, _SWEEP, _docs, _joined, _parts_links, query

# --- references -----------------------------------------------------------------------------------------------------------

_PLACES = "CASE doc_id % 6 WHEN 0 THEN 'CustomTab' WHEN 1 THEN 'Profile' ELSE 'ApexClass' END"
_KIND = "CASE WHEN length(name) % 3 = 0 THEN 'LightningComponentBundle' WHEN length(name) % 2 = 0 THEN 'ApexClass' ELSE 'CustomField' END"
_LAYER_SQL = rf"""
g AS (SELECT doc_id, lang, doc_id % 5 AS k, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*')[1], 'none') AS a, coalesce(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*')[2], 'none') AS b FROM documents),
h AS (SELECT *, CASE k WHEN 0 THEN text || ' {{! ' || a || '.' || b || ' }}' WHEN 1 THEN text || ' from ''c/' || a || ''' ' WHEN 2 THEN text || ' <c:' || a || ' />' WHEN 3 THEN text ELSE '' END AS code, CASE WHEN k = 4 THEN text ELSE '' END AS comments FROM g),
tok AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(code, '{V.TOKEN}') || regexp_extract_all(code, '{V.REPORT_COLUMN}'))) AS w FROM h),
lit AS (
  SELECT doc_id, lower(unnest([a, 'SELECT ' || a || ' FROM ' || b, 'select', 'from', a, b])) AS w, 'string_literal' AS kind FROM h WHERE k = 3
  UNION SELECT doc_id, lower(unnest([a || '.' || b, a, b])), 'merge_field' FROM h WHERE k = 0 UNION SELECT doc_id, lower(unnest([a, 'c/' || a])), 'string_literal' FROM h WHERE k = 1
  UNION SELECT doc_id, lower(unnest([a, 'c:' || a])), 'string_literal' FROM h WHERE k = 2),
said AS (SELECT doc_id, w, 'token_sweep' AS kind FROM tok UNION ALL SELECT * FROM lit WHERE length(w) > 1 UNION ALL SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(comments, '{V.TOKEN}') || regexp_extract_all(comments, '{V.REPORT_COLUMN}'))), 'comment_mention' FROM h),
words AS (SELECT item_id, lower(unnest(regexp_extract_all(text, '{V.TOKEN}'))) AS name FROM benchmark),
names AS (SELECT name, min(item_id) AS item FROM words WHERE length(name) >= 4 GROUP BY name), ends AS (SELECT item_id, min(name) AS least, max(name) AS most FROM words WHERE length(name) >= 4 GROUP BY item_id),
own AS (SELECT name AS id, name, least AS parent FROM names JOIN ends ON item_id = item UNION ALL SELECT name || '#2', name, most FROM names JOIN ends ON item_id = item WHERE length(name) % 5 = 0),
al AS (
  SELECT id, name AS w, 'api_name' AS alias_kind FROM own UNION ALL SELECT id, 'c/' || name, 'qualified' FROM own WHERE length(id) = length(name)
  UNION ALL SELECT id, 'c:' || name, 'bare_name' FROM own WHERE length(id) = length(name) UNION ALL SELECT id, name, 'bare_name' FROM own WHERE length(name) % 7 = 0 AND length(id) = length(name)),
able AS (SELECT al.*, count(*) OVER (PARTITION BY w) > 1 AS ambiguous, {_SWEEP} AS sweepable FROM al),
m AS (
  SELECT s.doc_id, a.id, s.kind, a.alias_kind, a.ambiguous, a.sweepable, d.doc_id % 2 = 0 AS is_code, d.lang = 'de' AS is_test, d.lang <> 'fr' AS is_active, {_PLACES.replace('doc_id', 'd.doc_id')} AS place,
    {_KIND} AS ctype, EXISTS (SELECT 1 FROM tok WHERE tok.doc_id = s.doc_id AND tok.w = o.parent) AS named
  FROM said s JOIN able a ON a.w = s.w JOIN own o ON o.id = a.id JOIN documents d ON d.doc_id = s.doc_id),
t AS (
  SELECT *, CASE WHEN kind = 'comment_mention' OR (kind = 'token_sweep' AND alias_kind = 'bare_name') THEN 'C' WHEN (ambiguous AND NOT named) OR is_test OR NOT is_active OR place = 'Profile' OR (place = 'CustomTab' AND ctype <> 'LightningComponentBundle') THEN 'C' ELSE 'A' END AS tier
  FROM m WHERE sweepable OR NOT (kind = 'comment_mention' OR (kind = 'token_sweep' AND NOT is_code)))
"""


@query(f"WITH {_LAYER_SQL} SELECT doc_id AS artifact_id, id AS component_id, kind AS match_kind, alias_kind, tier, ambiguous FROM t QUALIFY row_number() OVER (PARTITION BY doc_id, id, kind ORDER BY tier, alias_kind) = 1", base=False)
def resolve_layers(spark, d):
    """What code, literals, merge fields, UI forms and comments of the documents say of names, a fifth of which are ambiguous."""
    word = lambda n: F.coalesce(F.get(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z0-9]*"), 0), F.lit(n)), F.lit("none"))
    docs = _docs(spark, d).select("doc_id", "lang", (F.col("doc_id") % 5).alias("k"), F.coalesce("text", F.lit("")).alias("text"), word(0).alias("a"), word(1).alias("b"))
    rows = docs.selectExpr(
        "doc_id AS artifact_id", "CASE k WHEN 0 THEN text || ' {! ' || a || '.' || b || ' }' WHEN 1 THEN text || ' from \\'c/' || a || '\\' ' WHEN 2 THEN text || ' <c:' || a || ' />' WHEN 3 THEN text ELSE '' END AS code",
        "CASE WHEN k = 4 THEN text ELSE '' END AS comments", "CASE WHEN k = 3 THEN array(' ' || a || ' ', 'SELECT ' || a || ' FROM ' || b) ELSE CAST(array() AS array<string>) END AS literals",
    )
    words = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.explode(F.regexp_extract_all("text", F.lit(V.TOKEN), 0)).alias("w")).select("item_id", F.lower("w").alias("name")).filter("length(name) >= 4")
    ends = words.groupBy("item_id").agg(F.min("name").alias("least"), F.max("name").alias("most"))
    names = words.groupBy("name").agg(F.min("item_id").alias("item_id")).join(ends, "item_id")
    own = names.selectExpr("name AS id", "name", "least AS parent_object").unionByName(names.filter("length(name) % 5 = 0").selectExpr("name || '#2' AS id", "name", "most AS parent_object")).withColumn("ctype", F.expr(_KIND))
    forms = F.expr("CASE WHEN id = name THEN filter(array(named_struct('a', name, 'k', 'api_name'), named_struct('a', 'c/' || name, 'k', 'qualified'), named_struct('a', 'c:' || name, 'k', 'bare_name'), named_struct('a', CASE WHEN length(name) % 7 = 0 THEN name END, 'k', 'bare_name'), named_struct('a', name, 'k', 'label')), x -> x.a IS NOT NULL) ELSE array(named_struct('a', name, 'k', 'api_name')) END")
    aliases = own.select(F.col("id").alias("component_id"), F.explode(forms).alias("f")).select("component_id", F.col("f.a").alias("alias_lc"), F.col("f.k").alias("alias_kind"))
    files = _docs(spark, d).selectExpr("doc_id AS artifact_id", f"{_PLACES} AS metadata_type", "doc_id % 2 = 0 AS is_code", "lang = 'de' AS is_test", "lang <> 'fr' AS is_active")
    return RE.resolve_references(RE.union_layers(rows), aliases, own, files)


# --- events ----------------------------------------------------------------------------------------------------------------

_SAMPLE = """
sampled AS (
  SELECT 'object' AS bucket, lower('Entity_' || user_id || '__c') AS key, 'object' AS kind, CASE WHEN event_type = 'click' THEN 'interaction:' ELSE 'page:' END || 'Entity_' || user_id || '__c' AS sample, seen FROM logrows WHERE event_type = 'click' OR (event_type = 'view' AND user_id % 10 > 1)
  UNION ALL SELECT 'rest_path', 'rest' || (user_id % 30 + 1), 'rest', left('/Rest' || (user_id % 30 + 1) || '/items/' || event_id, 80), seen FROM logrows WHERE event_type = 'view' AND user_id % 10 = 0
  UNION ALL SELECT 'key_prefix', 'a' || (user_id % 30), 'object', 'dml:?:a' || (user_id % 30), seen FROM logrows WHERE event_type = 'view' AND user_id % 10 = 1
  UNION ALL SELECT 'ui', lower('Card' || (user_id % 10)), 'ui', 'component_name:Card' || (user_id % 10), seen FROM logrows WHERE event_type = 'click'
  UNION ALL SELECT unnest(['class', 'method']), unnest([lower('Service' || (user_id % 20)), lower('Service' || (user_id % 20) || '.run' || (event_id % 3))]), 'execution', 'Service' || (user_id % 20) || '.run' || (event_id % 3), seen FROM logrows WHERE event_type = 'purchase'
  UNION ALL SELECT 'object', lower('Order_' || (user_id % 5) || '__c'), 'object', 'restapi:FROM order_' || (user_id % 5) || '__c', seen FROM logrows WHERE event_type = 'signup'
  UNION ALL SELECT 'field', unnest([lower('Field_' || (user_id % 7) || '__c'), lower('Order_' || (user_id % 5) || '__c')]), 'field', 'restapi:' || unnest([lower('Field_' || (user_id % 7) || '__c'), lower('Order_' || (user_id % 5) || '__c')]), seen FROM logrows WHERE event_type = 'signup'
  UNION ALL SELECT unnest(['class', 'method']), unnest([lower('Caller' || (user_id % 9)), lower('Caller' || (user_id % 9) || '.send')]), 'callout', 'Caller' || (user_id % 9) || '.send > /out/' || user_id, seen FROM logrows WHERE event_type = 'error')
"""
_COUNTS = ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}s" for k in E.KINDS)


@query(f", {I.LOG_SQL}, {_SAMPLE} SELECT bucket, key, {_COUNTS}, count(*) AS total, max(seen) AS last_seen, array_to_string(list_sort(list(DISTINCT sample))[1:3], '|') AS samples FROM sampled GROUP BY 1, 2")
def event_hit_details(spark, d):
    """All seven counts, the last time and the samples of what the logs say was used."""
    return E.event_hits(E.normalised_events(I.logs(spark, d))).withColumn("samples", _joined("samples"))


# --- places, referrers, paths, written reports ------------------------------------------------------------------------------


@query(
    rf"""WITH w AS (SELECT doc_id, unnest(ws) AS t, unnest(range(len(ws))) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{V.TOKEN}') AS ws FROM documents)),
    al AS (SELECT w, min(item_id) AS component_id, {_SWEEP} AS sweepable FROM (SELECT item_id, lower(unnest(regexp_extract_all(text, '{V.TOKEN}'))) AS w FROM benchmark) WHERE length(w) >= 4 GROUP BY w)
    SELECT doc_id AS artifact_id, i::INT AS line, (CASE i % 3 WHEN 0 THEN 0 WHEN 1 THEN 5 ELSE 3 END)::INT AS col, (CASE i % 3 WHEN 0 THEN 0 WHEN 1 THEN 5 ELSE 3 END + length(t))::INT AS end_col, t AS text, component_id,
      CASE i % 3 WHEN 0 THEN 'token_sweep' WHEN 1 THEN 'string_literal' ELSE 'comment_mention' END AS match_kind, CASE i % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'literal' ELSE 'comment' END AS region, 0::INT AS also
    FROM w JOIN al ON al.w = lower(t) WHERE i % 3 < 2 OR sweepable""",
    base=False,
)
def locate_layers(spark, d):
    """Documents as code, a word a line: bare, in a literal, in a comment. Where are the names of benchmark passages?"""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(V.TOKEN), 0)
    line = lambda w, i: F.when(i % 3 == 0, w).when(i % 3 == 1, F.concat(F.lit("x = '"), w, F.lit("'"))).otherwise(F.concat(F.lit("// "), w))
    rows = _docs(spark, d).select(F.col("doc_id").alias("artifact_id"), F.lit(".cls").alias("suffix"), F.array_join(F.transform(words, line), "\n").alias("content"))
    names = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(V.TOKEN), 0)).alias("alias_lc")).filter("length(alias_lc) >= 4")
    aliases = names.groupBy("alias_lc").agg(F.min("item_id").alias("component_id")).withColumn("alias_kind", F.lit("api_name"))
    kind = F.when(F.col("i") % 3 == 0, "token_sweep").when(F.col("i") % 3 == 1, "string_literal").otherwise("comment_mention")
    said = _docs(spark, d).select(F.col("doc_id").alias("artifact_id"), F.posexplode(words).alias("i", "w")).select("artifact_id", F.lower("w").alias("alias_lc"), kind.alias("match_kind"))
    edges = maybe_among(said, aliases, ["alias_lc"]).join(aliases, "alias_lc").select("artifact_id", "component_id", "match_kind")  # repeats go later
    return S.locate_references(rows, edges, aliases).select("artifact_id", "line", "col", "end_col", "text", "component_id", "match_kind", "region", F.size("also").alias("also"))


@query(
    f""", {_SELF}, n AS (SELECT ctype, lower(api_name) AS name, min(id) AS referrer_id FROM comps GROUP BY 1, 2)
    SELECT component_id, row_number() OVER (PARTITION BY component_id ORDER BY tier, metadata_type, member_name, match_kind, artifact_id) AS place, artifact_id, metadata_type, member_name, tier, match_kind, referrer_id
    FROM marked LEFT JOIN n ON ctype = metadata_type AND name = lower(member_name) WHERE NOT is_self QUALIFY place <= 200"""
)
def referenced_by_rows(spark, d):
    """Who refers to each component: order, place and the component that the file defines."""
    return RE.referenced_by(I.edges(spark, d), I.artifacts(spark, d), I.components(spark, d)).withColumn("place", F.col("place").cast("long"))


@query(
    f"""WITH RECURSIVE {_GRAPH}, walk(key, distance) AS (SELECT 'p' || p_partkey, 0 FROM part WHERE p_partkey % 101 = 0 UNION SELECT dst, distance + 1 FROM walk JOIN g ON src = key WHERE kind <> 'declares' AND distance < 30),
    d AS (SELECT key, min(distance) AS distance FROM walk GROUP BY 1), v AS (SELECT b.key, b.distance, min(src) AS via FROM d b JOIN g ON dst = b.key AND kind <> 'declares' JOIN d a ON a.key = src AND a.distance = b.distance - 1 GROUP BY 1, 2),
    p(key, distance, root, path) AS (SELECT key, 0, key, [key] FROM d WHERE distance = 0 UNION ALL SELECT v.key, v.distance, root, path || [v.key] FROM p JOIN v ON via = p.key AND v.distance = p.distance + 1)
    SELECT key, distance, root, array_to_string(path[-12:], '|') AS path FROM p""",
    base=False,
)
def reachability_paths(spark, d):
    """How each node is reached: its entry point, and the last twelve nodes of the way."""
    nodes = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), (F.col("p_partkey") % 101 == 0).alias("is_entry_point"))
    return G.reachability(nodes, _parts_links(spark, d)).select("key", "distance", "root", _joined("path"))


@query("SELECT 'evidence' AS name, component_id, collector_id || ':' || result AS said FROM evidence UNION ALL SELECT 'components', c.id, c.api_name || ':' || coalesce(v.label, '') FROM comps c LEFT JOIN verdicts v ON v.component_id = c.id UNION ALL SELECT 'candidates', component_id, api_name || ':UNUSED' FROM comps JOIN verdicts v ON component_id = id WHERE v.label = 'UNUSED'")
def written_report(spark, d):
    """A report written twice, and read: its tables row by row."""
    v = I.verdicts(spark, d).withColumn("reason_codes", F.array(F.lit("TEST_ONLY")))
    runs = spark.createDataFrame([(V.STATIC, "OK", 7)], "collector_id string, status string, searched int")
    tables = R.report_tables(I.components(spark, d), v, I.evidence(spark, d), I.gaps(spark, d), I.flags(spark, d), runs)
    names, path = ["candidates", "components", "evidence"], f"{G.shared_folder(spark)}/report-{uuid.uuid4().hex}"
    for _ in range(2):
        R.write_report({n: tables[n] for n in names}, path, "run")
    found = R.read_report(spark, path, "run", names)
    verdict = lambda n: found[n].select(F.lit(n).alias("name"), "component_id", F.concat("api_name", F.lit(":"), F.coalesce("label", F.lit(""))).alias("said"))
    return verdict("candidates").unionByName(verdict("components")).unionByName(found["evidence"].select(F.lit("evidence").alias("name"), "component_id", F.concat("collector_id", F.lit(":"), "result").alias("said")))
