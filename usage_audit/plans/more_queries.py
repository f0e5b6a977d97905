"""Further queries: log and source parsing, rehearsals, report tables, streams."""

from __future__ import annotations

import uuid

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
from ..sources import files
from ..streaming import run_events as ST
from . import inputs as I
from .queries import _classified, _docs, _joined, _parts_graph, _parts_links, query


def _shared(spark, name: str) -> str:
    base = G.shared_folder(spark)
    return f"{base}/{name}-{uuid.uuid4().hex}"


# --- texts ---------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, (contains(lower(text), 'callable')::INT + contains(lower(text), 'database.query')::INT)::INT AS markers FROM documents", base=False)
def dynamic_markers(spark, d):
    return _docs(spark, d).select("doc_id", F.size(F.filter(T.dynamic_markers("text"), lambda m: m.isin("callable", "database.query"))).alias("markers"))


@query(
    "SELECT event_id, 'order_' || (user_id % 5) || '__c' AS objects, 'field_' || (user_id % 7) || '__c|order_' || (user_id % 5) || '__c' AS fields, CASE WHEN event_id % 2 = 0 THEN 'Card' || user_id || '|Other' ELSE '' END AS ui FROM events", base=False,
)
def soql_refs(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id", "'\"SELECT%20Field_' || (user_id % 7) || '__c FROM Order_' || (user_id % 5) || '__c\"' AS q", "CASE WHEN event_id % 2 = 0 THEN 'c:Card' || user_id || ';force:x;c/Other;c:card' || user_id END AS ui")
    return e.select("event_id", F.concat_ws("|", T.soql_objects("q")).alias("objects"), F.concat_ws("|", T.soql_fields("q")).alias("fields"), F.concat_ws("|", T.ui_component_names("ui")).alias("ui"))


@query("SELECT id, api_name || ' x' AS x, lower(api_name) AS literal, 'merge_field' AS origin FROM comps WHERE ctype = 'CustomField'")
def harvest_literals(spark, d):
    c = I.components(spark, d).filter(F.col("ctype") == V.FIELD)
    said = c.select("id", "api_name", F.concat(F.lit("{! "), "api_name", F.lit(" }")).alias("code"), F.array().cast("array<string>").alias("l"))
    found = said.select("id", "api_name", F.explode(F.array_distinct(T.harvest_literals("l", "code"))).alias("x"))
    return found.select("id", F.concat("api_name", F.lit(" x")).alias("x"), F.col("x.literal").alias("literal"), F.col("x.origin").alias("origin")).distinct()


@query("SELECT id, literal, CASE WHEN id % 2 = 0 THEN 'lwc_import' ELSE 'aura_tag' END AS origin FROM (SELECT id, unnest([lower(api_name), CASE WHEN id % 2 = 0 THEN 'c/' ELSE 'c:' END || lower(api_name)]) AS literal FROM comps WHERE ctype LIKE 'Lightning%')")
def ui_reference_literals(spark, d):
    c = I.components(spark, d).filter(F.col("ctype").isin(*V.UI_TYPES))
    code = F.when(F.col("id") % 2 == 0, F.concat(F.lit("import x from 'c/"), "api_name", F.lit("';"))).otherwise(F.concat(F.lit("<c:"), "api_name", F.lit(" />")))
    found = c.select("id", F.explode(T.ui_reference_literals(code)).alias("x")).select("id", F.col("x.literal").alias("literal"), F.col("x.origin").alias("origin"), F.col("x.precedence").alias("precedence"))
    return RE.first_origin(found.withColumnRenamed("id", "artifact_id")).select(F.col("artifact_id").alias("id"), "literal", "origin")


def _located(spark, d):
    """Documents as files, the commonest words of benchmark passages as components."""
    names = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z_]{7,}"), 0)).alias("alias_lc"))
    aliases = names.groupBy("alias_lc").agg(F.min("item_id").alias("component_id")).withColumn("alias_kind", F.lit("api_name"))
    rows = _docs(spark, d).select(F.col("doc_id").alias("artifact_id"), F.lit(".cls").alias("suffix"), F.regexp_replace("text", "['\"]", "").alias("content"))
    said = RE.token_counts(rows, "content").withColumnRenamed("token", "alias_lc").join(aliases, "alias_lc").select("artifact_id", "component_id", F.lit("token_sweep").alias("match_kind")).distinct()
    return rows, said, aliases


@query()
def locate_references(spark, d):
    return S.locate_references(*_located(spark, d)).select("artifact_id", "line", "col", "end_col", "text", "component_id", "region")


@query()
def mark_definition_region(spark, d):
    rows, edges, aliases = _located(spark, d)
    spans = edges.select("artifact_id", "component_id", F.lit(0).alias("start_line"), F.lit(0).alias("end_line"))
    return S.mark_definition_region(S.locate_references(rows, edges, aliases), spans).groupBy("region").agg(F.count("*").alias("segments"))


# --- inventory ---------------------------------------------------------------------------------------------------------------


@query(", m AS (SELECT id, parent_id, id % 5 = 0 AS aura, id % 7 = 0 AS ws FROM comps WHERE ctype = 'ApexMethod') SELECT id, aura OR ws AS is_entry_point FROM m")
def entry_point_flags(spark, d):
    c = I.components(spark, d)
    none = F.array().cast("array<string>")
    methods = c.filter(F.col("ctype") == V.METHOD).select("id", "parent_id", F.lit("run").alias("name"), F.when(F.col("id") % 7 == 0, F.array(F.lit("WebService"))).otherwise(none).alias("modifiers"), F.when(F.col("id") % 5 == 0, F.array(F.lit("AuraEnabled"))).otherwise(none).alias("annotations"))
    classes = c.filter(F.col("ctype") == V.CLASS).select("id", none.alias("annotations"), none.alias("interfaces"))
    return AR.entry_point_flags(methods, classes)[0].select("id", "is_entry_point")


@query(", m AS (SELECT parent_id, bool_or(id % 3 = 0) AS inv FROM comps WHERE ctype = 'ApexMethod' GROUP BY 1), c AS (SELECT comps.*, coalesce(inv, false) AS inv FROM comps LEFT JOIN m ON m.parent_id = comps.id WHERE ctype = 'ApexClass') SELECT id, CASE WHEN is_test THEN 'test' WHEN id % 4 = 0 AND inv THEN 'batch|invocable' WHEN id % 4 = 0 THEN 'batch' WHEN inv THEN 'invocable' WHEN is_entry_point THEN 'entry' ELSE 'regular' END AS kinds FROM c")
def class_kinds(spark, d):
    c = I.components(spark, d)
    none = F.array().cast("array<string>")
    classes = c.filter(F.col("ctype") == V.CLASS).select("id", "is_test", "is_entry_point", none.alias("annotations"), F.when(F.col("id") % 4 == 0, F.array(F.lit("Database.Batchable<SObject>"))).otherwise(none).alias("interfaces"))
    methods = c.filter(F.col("ctype") == V.METHOD).select("parent_id", F.when(F.col("id") % 3 == 0, F.array(F.lit("InvocableMethod"))).otherwise(none).alias("annotations"), none.alias("modifiers"))
    return AR.class_kinds(classes, methods).select("id", _joined("kinds"))


@query("SELECT id AS artifact_id, is_exposed, label, 'lightning__AppPage|lightning__HomePage' AS targets FROM comps")
def parse_bundle_meta(spark, d):
    xml = F.concat(F.lit("<LightningComponentBundle><isExposed>"), F.col("is_exposed").cast("string"), F.lit("</isExposed><masterLabel>"), "label", F.lit("</masterLabel><targets><target>lightning__AppPage</target><target>lightning__HomePage</target></targets></LightningComponentBundle>"))
    return AR.parse_bundle_meta(I.components(spark, d).select(F.col("id").alias("artifact_id"), xml.alias("content"))).select("artifact_id", "is_exposed", "label", _joined("targets"))


@query("SELECT f.id, o.api_name AS parent_object FROM comps f LEFT JOIN comps o ON o.id = f.id - 1 AND o.ctype = 'CustomObject' WHERE f.ctype = 'CustomField'")
def resolve_parent_objects(spark, d):
    c = I.components(spark, d)
    objects = c.filter(F.col("ctype") == V.OBJECT)
    key = c.select((F.col("id") + 1).alias("id"), F.when(F.col("id") % 2 == 0, F.col("sf_id")).otherwise(F.upper("api_name")).alias("parent_key"))
    return A.parent_names(c.filter(F.col("ctype") == V.FIELD).select("id").join(key, "id", "left"), objects).select("id", "parent_object")


@query("SELECT ctype AS metadata_type FROM (SELECT DISTINCT ctype FROM comps) WHERE ctype NOT IN (SELECT metadata_type FROM arts)")
def reconcile_received(spark, d):
    return R.reconcile_received(I.components(spark, d).select(F.col("ctype").alias("metadata_type")), I.artifacts(spark, d))


# --- collectors -----------------------------------------------------------------------------------------------------------------


@query("SELECT id AS component_id, CASE WHEN n IS NULL THEN 'INCONCLUSIVE' WHEN n > 0 THEN 'EVIDENCE_OF_USE' ELSE 'NO_EVIDENCE_FOUND' END AS result FROM comps LEFT JOIN (SELECT p_partkey, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 45 WHERE p_partkey % 4 <> 0 GROUP BY 1) ON p_partkey = id WHERE in_scope AND ctype = 'CustomField' AND parent_object <> 'Obj_3__c'")
def collect_population(spark, d):
    c = I.components(spark, d).filter(F.col("ctype") == V.FIELD)
    li = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_partkey").alias("id")).agg(F.count_if(F.col("l_quantity") > 45).alias("n"))
    population = c.filter("id % 4 <> 0").join(li, "id", "left").select(F.col("parent_object").alias("object"), F.col("api_name").alias("field"), F.lit(100).alias("total"), F.coalesce("n", F.lit(0)).alias("filled"))
    failed = c.filter("parent_object = 'Obj_3__c'").select(F.col("parent_object").alias("object"))
    return EV.collect_population(c, population, c.select(F.col("parent_object").alias("object"), F.lit(1).alias("records")).distinct(), failed)[0].select("component_id", "result")


@query("SELECT id AS component_id, CASE WHEN ctype = 'ApexMethod' THEN 'NOT_APPLICABLE' WHEN id % 3 = 0 THEN 'EVIDENCE_OF_USE' WHEN id % 3 = 1 THEN 'NO_EVIDENCE_FOUND' ELSE 'NOT_APPLICABLE' END AS result FROM comps WHERE ctype = 'ApexMethod' OR id % 7 <> 0")
def rehearsal_evidence(spark, d):
    c = I.components(spark, d)
    status = F.when(F.col("id") % 7 == 0, "unresolved").when(F.col("id") % 3 == 0, "blocked").when(F.col("id") % 3 == 1, "passed").otherwise("not_addressable")
    last = c.select(F.col("id").alias("component_id"), F.lit("solo").alias("phase"), F.to_json(F.struct(status.alias("status"))).alias("outcome"))
    first = c.select(F.col("id").alias("component_id"), F.lit("batch").alias("phase"), F.lit('{"status": "passed"}').alias("outcome"))
    return EV.rehearsal_evidence(first.unionByName(last), c)[0].select("component_id", "result")


@query("SELECT component_id, 'LLM_CONCERN' AS code FROM verdicts WHERE label = 'UNUSED' AND component_id % 2 = 0")
def apply_opinions(spark, d):
    v = I.verdicts(spark, d)
    said = v.select("component_id", (F.col("component_id") % 2 == 0).alias("uses"), F.lit("seen").alias("note"))
    return EV.apply_opinions(said, v)[0].select("component_id", "code")


@query("SELECT count(*) AS rows, CASE WHEN count(*) = 2000 THEN 'PARTIAL' ELSE 'OK' END AS status FROM part", base=False)
def dependency_status(spark, d):
    return EV.dependency_status(spark.read.parquet(f"{d}/part.parquet"))


# --- the graph ----------------------------------------------------------------------------------------------------------------------


def _small_graph(spark, d):
    nodes = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), F.lit("component").alias("kind"), F.col("p_name").alias("label"), F.col("p_type").alias("ctype"), F.col("p_partkey").alias("ref_id"), (F.col("p_partkey") % 101 == 0).alias("is_entry_point"), F.lit(None).cast("string").alias("entry_reason"))
    return nodes, _parts_graph(spark, d), G.reachability(nodes, _parts_links(spark, d))


@query()
def reachability_evidence(spark, d):
    return G.reachability_evidence(*_small_graph(spark, d)).groupBy("result", "tier").agg(F.count("*").alias("components"))


@query()
def path_to_root(spark, d):
    nodes, _, reached = _small_graph(spark, d)
    return G.path_to_root(reached, nodes).select("key", "root", F.size("labels").alias("steps"))


@query()
def sample_subgraph(spark, d):
    return G.sample_subgraph(*_small_graph(spark, d), most_nodes=100)


# --- reports ----------------------------------------------------------------------------------------------------------------------------


@query("SELECT c.id, coalesce(CASE WHEN c.id % 3 = 0 THEN 'body ' || c.id END, CASE WHEN p.id % 3 = 0 THEN 'body ' || p.id END) AS body, c.id % 3 <> 0 AND p.id IS NOT NULL AND p.id % 3 = 0 AS from_parent FROM comps c LEFT JOIN comps p ON p.id = c.parent_id")
def source_for_component(spark, d):
    c = I.components(spark, d)
    sources = c.filter("id % 3 = 0").select(F.col("id").alias("component_id"), F.concat(F.lit("body "), F.col("id").cast("string")).alias("body"))
    return R.source_for_component(c, sources)


@query(
    """WITH n AS (SELECT n_nationkey AS k, n_name AS who FROM nation), t AS (
      SELECT k, 'Recorded dependencies is partial' AS caveat FROM n WHERE (SELECT count(*) FROM part) = 2000
      UNION ALL SELECT k, CASE WHEN k % 5 = 0 THEN 'no runtime logs came, but files of them are read: A, B, C, D, E and 1 more' WHEN k % 5 = 1 THEN 'no runtime logs came, but files of them are read: A' ELSE 'runtime logs are not available: use by people and integrations can''t be seen' END FROM n WHERE k % 3 = 0
      UNION ALL SELECT k, 'runtime logs are read for the types that name components; others are skipped' FROM n WHERE k % 3 = 1
      UNION ALL SELECT k, 'it is not known whether runtime logs are available' FROM n WHERE k % 3 = 2
      UNION ALL SELECT k, 'recorded dependencies are not available: nothing is checked against them' FROM n WHERE k % 4 = 0
      UNION ALL SELECT k, 'no history of fields: a value written long ago looks like one of yesterday' FROM n WHERE k % 4 = 1
      UNION ALL SELECT k, 'no code coverage is recorded' FROM n WHERE k % 4 = 2
      UNION ALL SELECT k, CASE WHEN k % 6 = 0 THEN '9 objects could not be read: O1, O2, O3, O4, O5, O6, O7, O8 and more' ELSE '2 objects could not be read: Bar, Foo' END FROM n WHERE k % 6 < 2
      UNION ALL SELECT k, 'the user ' || who || ' is no administrator: what it can''t see looks unused' FROM n WHERE k % 7 = 0)
    SELECT k AS run_id, caveat FROM t""",
    base=False,
)
def coverage_caveats(spark, d):
    """Each nation is a run with capabilities of its own."""
    n = spark.read.parquet(f"{d}/nation.parquet").withColumn("k", F.col("n_nationkey"))
    have = n.selectExpr(
        "k AS run_id", "CASE k % 3 WHEN 0 THEN false WHEN 1 THEN true END AS has_event_logs", "k % 4 != 0 AS has_dependency_api", "k % 4 != 1 AS has_field_history", "k % 4 != 2 AS has_code_coverage",
        "CASE k % 5 WHEN 0 THEN array('A', 'B', 'C', 'D', 'E', 'F') WHEN 1 THEN array('A') END AS log_files", "CASE k % 6 WHEN 0 THEN array('O9', 'O8', 'O7', 'O6', 'O5', 'O4', 'O3', 'O2', 'O1') WHEN 1 THEN array('Foo', 'Bar') END AS unavailable_objects",
        "k % 7 != 0 AS is_admin", "n_name AS run_as",
    )
    status = EV.dependency_status(spark.read.parquet(f"{d}/part.parquet")).select(F.lit(V.DEPENDENCY).alias("collector_id"), "status")
    return R.coverage_caveats(n.select(F.col("k").alias("run_id")).join(F.broadcast(status)), have)  # one row of status


_CODES = ("DYNAMIC_APEX_IN_SCOPE", "UNCALLED_ENTRY_POINT", "TEST_ONLY", "BLOCKED_BY_DEPENDENT", "WEAK_SIGNAL_ONLY (Profile only)", "INSUFFICIENT_EVIDENCE (missing: C20)", "RECENTLY_CHANGED", "LLM_FLAGGED", "EXPOSED_UI_NO_PLACEMENT")


@query(
    f"""WITH q AS (SELECT p_partkey, [{', '.join(repr(c) for c in _CODES)}] AS codes, p_size % 9 AS i, p_partkey % 9 AS j FROM part)
    SELECT p_partkey, CASE least(i, j) WHEN 0 THEN 'Does code that makes names at run time reach it?' WHEN 1 THEN 'Does anything outside the system call it?' WHEN 2 THEN 'Is the code that this test covers still needed, or can both go?'
      WHEN 3 THEN 'Can what still refers to it go together with it?' WHEN 4 THEN 'Will what only mentions it, or is inactive, be used again?' WHEN 5 THEN 'Which missing checks can be run again?' WHEN 6 THEN 'Is someone still building on it?'
      WHEN 7 THEN 'Is the concern that a model raised about it founded?' ELSE 'Who owns it, and is it still needed?' END AS question FROM q""",
    base=False,
)
def review_question(spark, d):
    """Of two reasons of each part, in any order, the question that comes first."""
    codes = F.array(*map(F.lit, _CODES))
    both = F.array(F.get(codes, (F.col("p_partkey") % 9).cast("int")), F.get(codes, F.col("p_size") % 9))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", T.review_question(both).alias("question"))


@query("SELECT m.parent_id AS id, 0.0 + CASE p.label WHEN 'UNUSED' THEN 3 WHEN 'NEEDS_REVIEW' THEN 2 ELSE 0 END + sum(CASE v.label WHEN 'UNUSED' THEN 1.0 WHEN 'NEEDS_REVIEW' THEN 0.5 ELSE 0 END)::DOUBLE AS score FROM comps m JOIN verdicts v ON v.component_id = m.id JOIN verdicts p ON p.component_id = m.parent_id WHERE m.ctype = 'ApexMethod' GROUP BY m.parent_id, p.label")
def attention_score(spark, d):
    c = I.components(spark, d)
    methods = c.filter(F.col("ctype") == V.METHOD)
    return R.attention_score(methods.select(F.col("parent_id").alias("id")).distinct(), methods, I.verdicts(spark, d))


@query("SELECT c.label AS kind, count(*) AS classes, count(*) FILTER (v.label = 'UNUSED') AS class_unused, coalesce(sum(m.n), 0)::BIGINT AS methods FROM comps c JOIN verdicts v ON v.component_id = c.id LEFT JOIN (SELECT parent_id, count(*) AS n FROM comps WHERE ctype = 'ApexMethod' GROUP BY 1) m ON m.parent_id = c.id WHERE c.ctype <> 'ApexMethod' GROUP BY 1")
def kind_buckets(spark, d):
    c = I.components(spark, d)
    classes = c.filter(F.col("ctype") != V.METHOD).select("id", F.col("label").alias("kind"))
    return R.kind_buckets(classes, c.filter(F.col("ctype") == V.METHOD), I.verdicts(spark, d)).select("kind", "classes", "class_unused", "methods")


@query("SELECT id FROM comps JOIN verdicts v ON component_id = id WHERE v.label IN ('UNUSED', 'USED') AND ctype = 'ApexClass' AND contains(lower(api_name), 'red')")
def filter_components(spark, d):
    s = I.components(spark, d).drop("label").join(I.verdicts(spark, d).withColumnRenamed("component_id", "id"), "id")
    return R.filter_components(s, ["UNUSED", "USED"], [V.CLASS], "RED").select("id")


@query("SELECT * FROM (SELECT 'candidates' AS name, count(*) FILTER (label = 'UNUSED') AS rows FROM verdicts UNION ALL SELECT 'needs_review', count(*) FILTER (label = 'NEEDS_REVIEW') FROM verdicts UNION ALL SELECT 'components', count(*) FROM verdicts UNION ALL SELECT 'evidence', count(*) FROM evidence)")
def report_tables(spark, d):
    v = I.verdicts(spark, d).withColumn("reason_codes", F.array(F.lit("TEST_ONLY")))
    runs = spark.createDataFrame([(V.STATIC, "OK", 7)], "collector_id string, status string, searched int")
    tables = R.report_tables(I.components(spark, d), v, I.evidence(spark, d), I.gaps(spark, d), I.flags(spark, d), runs)
    out = None
    for name in ("candidates", "needs_review", "components", "evidence"):
        one = tables[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def explanations(spark, d):
    """What a report says of each verdict in words."""
    v = _classified(spark, d)
    return v.select("component_id", T.unused_flavor("label", F.col("reason_codes")[0]).alias("flavor"), T.review_question("reason_codes").alias("question"), T.label_for(F.lit(V.STATIC)).alias("first_check"))


@query("SELECT run_id, json_extract(attrs, '$.is_test')::BOOLEAN AS is_test FROM (SELECT id AS run_id, '{\"is_test\": ' || is_test || '}' AS attrs FROM comps)")
def attrs_get(spark, d):
    c = I.components(spark, d).select(F.col("id").alias("run_id"), F.to_json(F.struct("is_test")).alias("attrs"))
    return c.select("run_id", R.attrs_get(c, "$.is_test", "boolean").alias("is_test"))


# --- runs, files and streams ----------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS run_id, coalesce(n, 0) AS verdicts, coalesce(n, 0) AS as_of_seq FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey", base=False)
def run_snapshot(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    verdicts = li.select(F.col("l_orderkey").alias("run_id"), F.lit("USED").alias("label"))
    events = RU.assign_sequence(li.select(F.col("l_orderkey").alias("run_id"), F.col("l_shipdate").alias("at"), F.col("l_linenumber").alias("event_id")))
    stages = li.select(F.col("l_orderkey").alias("run_id"), F.lit("scan").alias("stage"), F.lit("done").alias("state")).distinct()
    out = RU.run_snapshot(I.runs(spark, d).drop("state"), stages, verdicts, events)
    return out.select("run_id", F.coalesce(F.col("verdicts")["USED"], F.lit(0)).alias("verdicts"), F.coalesce("as_of_seq", F.lit(0)).alias("as_of_seq"))


@query("SELECT l_orderkey AS run_id, l_linenumber AS stage, l_quantity AS seconds FROM lineitem", base=False)
def stage_durations(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    s = li.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("stage"), F.col("l_shipdate").alias("started_at"), F.timestamp_seconds(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) + F.col("l_quantity")).alias("finished_at"))
    return RU.stage_durations(s)


@query("SELECT page_id, strlen(html) + 1 AS bytes FROM pages", base=False)
def read_artifacts(spark, d):
    """Pages written as files, a thousand pages a folder, and read back as a tree of files."""
    path = _shared(spark, "tree")
    pages = spark.read.parquet(f"{d}/pages.parquet")
    text = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    name = F.concat(F.lit("pages/"), text(F.floor(F.col("page_id") / 1000)), F.lit("/p="), text(F.col("page_id")), F.lit("-"), F.monotonically_increasing_id().cast("string"), F.lit(".txt"))
    files.write_artifacts(pages.select(name.alias("path"), F.concat(F.coalesce("html", F.lit("")), F.lit("\n")).alias("content")), path)
    tree = files.read_artifacts(spark, path)
    return tree.select(F.nullif(F.regexp_extract("path", r"p=(-?\d+)-\d+\.txt$", 1), F.lit("")).cast("long").alias("page_id"), "bytes").groupBy("page_id").agg(F.sum("bytes").alias("bytes"))


@query("SELECT CASE WHEN event_type = 'view' THEN 'ApexTrigger' ELSE 'ApexExecution' END AS event_type, count(*) AS rows FROM events GROUP BY 1", base=False)
def read_event_logs(spark, d):
    """Events written as two CSV logs with differing columns, and read as one."""
    path = _shared(spark, "logs")
    e = spark.read.parquet(f"{d}/events.parquet")
    e.filter("event_type = 'view'").select(F.lit("ApexTrigger").alias("event_type"), F.col("user_id").alias(" Trigger_Name ")).write.option("header", True).csv(f"{path}/a")
    e.filter("event_type <> 'view'").select(F.lit("ApexExecution").alias("EVENT_TYPE"), F.lit("x").alias("ENTRY_POINT")).write.option("header", True).csv(f"{path}/b")
    return files.read_event_logs(spark, [f"{path}/a", f"{path}/b"]).groupBy(F.col("EVENT_TYPE").alias("event_type")).agg(F.count("*").alias("rows"))


def _finish(writer, most_seconds: int = 600) -> None:
    """Read what there is, then end; a stream that doesn't end is stopped and raises."""
    running = writer.trigger(availableNow=True).start()
    if not running.awaitTermination(most_seconds):
        running.stop()
        raise TimeoutError("the stream did not end")


def _streamed(spark, d, make, mode="append", from_seq=-1):
    """Events as run events in a folder, streamed once through `make` from a cursor on; the sink's rows."""
    source, out = _shared(spark, "events"), _shared(spark, "out")
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.col("event_type").alias("stage"), F.lit("progress").alias("kind"), F.lit("running").alias("state"), F.lit("").alias("note"), (F.col("value") / 100).alias("progress"))
    e.write.parquet(source)
    stream = make(ST.tail_events(spark, source, from_seq=from_seq))
    put = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/{epoch}")
    _finish(stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", _shared(spark, "cursor")))
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(out)


@query("SELECT user_id::VARCHAR AS run_id, event_id AS seq FROM events WHERE event_id > 100", base=False)
def tail_events(spark, d):
    return _streamed(spark, d, lambda s: s.select("run_id", "seq"), from_seq=100)


@query("SELECT user_id::VARCHAR AS run_id, event_id AS seq FROM events", base=False)
def dedupe_replays(spark, d):
    return _streamed(spark, d, lambda s: ST.dedupe_replays(s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))).select("run_id", "seq"))


@query("SELECT run_id, after, seq FROM (SELECT user_id::VARCHAR AS run_id, event_id AS seq, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM events) WHERE seq - after > 1", base=False)
def detect_gaps(spark, d):
    return ST.current_gaps(_streamed(spark, d, ST.detect_gaps))


@query(
    """SELECT run_id, seq FROM (
    WITH RECURSIVE e AS (
      SELECT user_id, event_type, event_id, epoch_us(ts) AS us, value / 100 >= 1 AS final, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
    t AS (
      SELECT user_id, event_type, event_id, k, true AS passes, us AS last FROM e WHERE k = 1
      UNION ALL
      SELECT e.user_id, e.event_type, e.event_id, e.k, e.final OR e.us - t.last >= 864000000000, CASE WHEN e.final OR e.us - t.last >= 864000000000 THEN e.us ELSE t.last END
      FROM t JOIN e ON e.user_id = t.user_id AND e.event_type = t.event_type AND e.k = t.k + 1)
    SELECT user_id::VARCHAR AS run_id, event_id AS seq FROM t WHERE passes)""",
    base=False,
)
def throttle_progress(spark, d):
    """At most one event in ten days of each user and type, but all of 100 or more."""
    return _streamed(spark, d, lambda s: ST.throttle_progress(s, 864_000.0)).select("run_id", "seq")


#: Rows of a log's file, about: a stream reads a file in few tasks, however large.
ROWS_OF_LOG_FILE = 100_000


@query(f", {I.LOG_SQL} SELECT bucket, key, count(*) AS total, max(seen) AS last_seen FROM hits GROUP BY 1, 2")
def streaming_event_hits(spark, d):
    source, out = _shared(spark, "logs"), _shared(spark, "hits")
    logs = I.logs(spark, d)
    files_each = 1 + logs.count() // ROWS_OF_LOG_FILE  # so that many tasks read a batch
    logs.repartition(2 * files_each).write.parquet(source)
    stream = ST.streaming_event_hits(spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files_each).parquet(source))  # two batches
    put = ST.fold_into(out, ["bucket", "key"])
    _finish(stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", _shared(spark, "cursor")))
    return ST.folded(spark, out, ["bucket", "key"]).select("bucket", "key", "total", "last_seen")
