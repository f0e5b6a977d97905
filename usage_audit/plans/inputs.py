"""The audit's input tables, derived from the test tables: parts are components, orders files, line items references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same in SQL, for the oracle.
SQL = """
comps AS (SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'CustomField' WHEN 1 THEN 'CustomObject' WHEN 2 THEN 'ApexClass' WHEN 3 THEN 'ApexMethod' WHEN 4 THEN 'ApexTrigger' ELSE 'LightningComponentBundle' END AS ctype,
  replace(p_name, ' ', '_') || '_' || p_partkey || CASE WHEN p_size % 6 < 2 THEN '__c' ELSE '' END AS api_name, 'Obj_' || (p_partkey % 50) || '__c' AS parent_object,
  CASE WHEN p_size % 6 = 3 THEN p_partkey - p_partkey % 10 END AS parent_id, p_type AS label, CASE WHEN p_brand = 'Brand#7' THEN 'pkg' END AS namespace, p_size <> 50 AS in_scope,
  CASE WHEN p_size = 50 THEN 'STANDARD_OBJECT' END AS out_of_scope_reason, 'a0' || lpad(p_partkey::VARCHAR, 13, '0') || 'AAA' AS sf_id, p_partkey % 17 = 0 AS is_entry_point, p_partkey % 13 = 0 AS is_exposed, p_partkey % 19 = 0 AS is_test FROM part),
arts AS (SELECT o_orderkey AS artifact_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'Flow' WHEN '2-HIGH' THEN 'ApexClass' WHEN '3-MEDIUM' THEN 'Layout' WHEN '5-LOW' THEN 'CustomObject' ELSE 'Profile' END AS metadata_type,
  api_name AS member_name, 'src/' || o_orderpriority || '/' || api_name || '.cls' AS path, o_orderstatus <> 'P' AS is_active, o_totalprice < 5000 AS is_test, o_orderpriority = '2-HIGH' AS is_code FROM orders JOIN comps ON o_custkey = id),
edges AS (SELECT l_orderkey AS artifact_id, l_partkey AS component_id, CASE WHEN l_returnflag = 'N' THEN 'C' WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'B' ELSE 'A' END AS tier,
  CASE WHEN l_linestatus = 'O' THEN 'token_sweep' ELSE 'string_literal' END AS match_kind, CASE WHEN l_linenumber % 2 = 0 THEN 'api_name' ELSE 'qualified' END AS alias_kind FROM lineitem),
verdicts AS (SELECT p_partkey AS component_id, CASE WHEN p_size < 10 THEN 'UNUSED' WHEN p_size < 20 THEN 'NEEDS_REVIEW' WHEN p_size < 45 THEN 'USED' ELSE 'OUT_OF_SCOPE' END AS label, (50 + p_size)::DOUBLE AS confidence FROM part),
evidence AS (
  SELECT p_partkey AS component_id, 'C10_static_index' AS collector_id, CASE p_partkey % 5 WHEN 0 THEN 'EVIDENCE_OF_USE' WHEN 1 THEN 'INCONCLUSIVE' ELSE 'NO_EVIDENCE_FOUND' END AS result, CASE p_partkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'C' END AS tier,
    CASE WHEN p_partkey % 10 = 0 THEN 0.5 WHEN p_partkey % 5 = 0 THEN 1.0 WHEN p_partkey % 5 = 1 THEN 0.3 ELSE 0.0 END::DOUBLE AS weight FROM part
  UNION ALL SELECT p_partkey, 'C20_data_population', CASE WHEN p_partkey % 7 = 0 THEN 'EVIDENCE_OF_USE' ELSE 'NO_EVIDENCE_FOUND' END, CASE WHEN p_partkey % 7 = 0 THEN 'B' END, CASE WHEN p_partkey % 7 = 0 THEN 0.7 ELSE 0.0 END FROM part WHERE p_size % 6 < 2
  UNION ALL SELECT p_partkey, 'C70_reachability', CASE WHEN p_partkey % 4 = 0 THEN 'EVIDENCE_OF_USE' ELSE 'NO_EVIDENCE_FOUND' END, CASE WHEN p_partkey % 4 = 0 THEN 'A' END, CASE WHEN p_partkey % 4 = 0 THEN 1.0 ELSE 0.0 END FROM part WHERE p_size % 6 > 1 AND p_partkey % 3 <> 0),
gaps AS (SELECT p_partkey AS component_id, 'C40_runtime' AS collector_id, 'not probed' AS reason FROM part WHERE p_partkey % 23 = 0),
flags AS (SELECT p_partkey AS component_id, CASE WHEN p_partkey % 2 = 0 THEN 'DYNAMIC_APEX_IN_SCOPE' ELSE 'RECENTLY_CHANGED' END AS code FROM part WHERE p_partkey % 9 = 0)
"""


def components(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet")
    return part.selectExpr(
        "p_partkey AS id", "CASE p_size % 6 WHEN 0 THEN 'CustomField' WHEN 1 THEN 'CustomObject' WHEN 2 THEN 'ApexClass' WHEN 3 THEN 'ApexMethod' WHEN 4 THEN 'ApexTrigger' ELSE 'LightningComponentBundle' END AS ctype",
        "replace(p_name, ' ', '_') || '_' || p_partkey || CASE WHEN p_size % 6 < 2 THEN '__c' ELSE '' END AS api_name", "'Obj_' || (p_partkey % 50) || '__c' AS parent_object",
        "CASE WHEN p_size % 6 = 3 THEN p_partkey - p_partkey % 10 END AS parent_id", "p_type AS label", "CASE WHEN p_brand = 'Brand#7' THEN 'pkg' END AS namespace", "p_size <> 50 AS in_scope",
        "CASE WHEN p_size = 50 THEN 'STANDARD_OBJECT' END AS out_of_scope_reason", "'a0' || lpad(CAST(p_partkey AS STRING), 13, '0') || 'AAA' AS sf_id", "p_partkey % 17 = 0 AS is_entry_point", "p_partkey % 13 = 0 AS is_exposed", "p_partkey % 19 = 0 AS is_test",
    )


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    named = components(spark, d).select("id", "api_name")
    orders = spark.read.parquet(f"{d}/orders.parquet").join(named, F.col("o_custkey") == F.col("id"))
    return orders.selectExpr(
        "o_orderkey AS artifact_id", "CASE o_orderpriority WHEN '1-URGENT' THEN 'Flow' WHEN '2-HIGH' THEN 'ApexClass' WHEN '3-MEDIUM' THEN 'Layout' WHEN '5-LOW' THEN 'CustomObject' ELSE 'Profile' END AS metadata_type",
        "api_name AS member_name", "'src/' || o_orderpriority || '/' || api_name || '.cls' AS path", "o_orderstatus <> 'P' AS is_active", "o_totalprice < 5000 AS is_test", "o_orderpriority = '2-HIGH' AS is_code",
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(
        "l_orderkey AS artifact_id", "l_partkey AS component_id", "CASE WHEN l_returnflag = 'N' THEN 'C' WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'B' ELSE 'A' END AS tier",
        "CASE WHEN l_linestatus = 'O' THEN 'token_sweep' ELSE 'string_literal' END AS match_kind", "CASE WHEN l_linenumber % 2 = 0 THEN 'api_name' ELSE 'qualified' END AS alias_kind",
    )


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    label = "CASE WHEN p_size < 10 THEN 'UNUSED' WHEN p_size < 20 THEN 'NEEDS_REVIEW' WHEN p_size < 45 THEN 'USED' ELSE 'OUT_OF_SCOPE' END AS label"
    return spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey AS component_id", label, "CAST(50 + p_size AS DOUBLE) AS confidence")


def evidence(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet")
    static = part.selectExpr(
        "p_partkey AS component_id", "'C10_static_index' AS collector_id", "CASE p_partkey % 5 WHEN 0 THEN 'EVIDENCE_OF_USE' WHEN 1 THEN 'INCONCLUSIVE' ELSE 'NO_EVIDENCE_FOUND' END AS result", "CASE p_partkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'C' END AS tier",
        "CAST(CASE WHEN p_partkey % 10 = 0 THEN 0.5 WHEN p_partkey % 5 = 0 THEN 1.0 WHEN p_partkey % 5 = 1 THEN 0.3 ELSE 0.0 END AS DOUBLE) AS weight",
        "to_json(named_struct('layout_only', p_partkey % 10 = 0, 'layout_names', CASE WHEN p_partkey % 10 = 0 THEN array('Main') END, 'weak_references', CASE WHEN p_partkey % 5 = 1 THEN 2 END, 'weak_source_types', CASE WHEN p_partkey % 5 = 1 THEN array(CASE WHEN p_partkey % 2 = 0 THEN 'Profile' ELSE 'Report' END) END)) AS payload",
    )
    stored = part.filter("p_size % 6 < 2").selectExpr("p_partkey AS component_id", "'C20_data_population' AS collector_id", "CASE WHEN p_partkey % 7 = 0 THEN 'EVIDENCE_OF_USE' ELSE 'NO_EVIDENCE_FOUND' END AS result", "CASE WHEN p_partkey % 7 = 0 THEN 'B' END AS tier", "CAST(CASE WHEN p_partkey % 7 = 0 THEN 0.7 ELSE 0.0 END AS DOUBLE) AS weight", "'{}' AS payload")
    reach = part.filter("p_size % 6 > 1 AND p_partkey % 3 <> 0").selectExpr("p_partkey AS component_id", "'C70_reachability' AS collector_id", "CASE WHEN p_partkey % 4 = 0 THEN 'EVIDENCE_OF_USE' ELSE 'NO_EVIDENCE_FOUND' END AS result", "CASE WHEN p_partkey % 4 = 0 THEN 'A' END AS tier", "CAST(CASE WHEN p_partkey % 4 = 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS weight", "to_json(named_struct('reachable', p_partkey % 4 = 0, 'path', array('root', p_brand))) AS payload")
    return static.unionByName(stored).unionByName(reach)


def gaps(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").filter("p_partkey % 23 = 0").selectExpr("p_partkey AS component_id", "'C40_runtime' AS collector_id", "'not probed' AS reason")


def flags(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").filter("p_partkey % 9 = 0").selectExpr("p_partkey AS component_id", "CASE WHEN p_partkey % 2 = 0 THEN 'DYNAMIC_APEX_IN_SCOPE' ELSE 'RECENTLY_CHANGED' END AS code", "'flag' AS detail")


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as runs of their customer, the org."""
    return spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey AS run_id", "o_custkey AS org_id", "o_orderstatus AS state", "o_orderdate AS started_at")


def logs(spark: SparkSession, d: str) -> DataFrame:
    """Events as log rows: each type of event stands for a type of log."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.selectExpr(
        "CASE event_type WHEN 'view' THEN CASE user_id % 10 WHEN 0 THEN 'ApexRestApi' WHEN 1 THEN 'DatabaseSave' ELSE 'LightningPageView' END WHEN 'click' THEN 'LightningInteraction' WHEN 'purchase' THEN 'ApexExecution' WHEN 'signup' THEN 'RestApi' ELSE 'ApexCallout' END AS EVENT_TYPE", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") AS TIMESTAMP_DERIVED",
        "CASE WHEN event_type IN ('view', 'click') THEN 'Entity_' || user_id || '__c' END AS PAGE_ENTITY_TYPE", "CASE WHEN event_type = 'click' THEN 'force:x;c:Card' || (user_id % 10) END AS COMPONENT_NAME",
        "CASE WHEN event_type = 'purchase' THEN 'Service' || (user_id % 20) || '.run' || (event_id % 3) END AS ENTRY_POINT", "CASE WHEN event_type = 'signup' THEN 'SELECT Field_' || (user_id % 7) || '__c FROM Order_' || (user_id % 5) || '__c' END AS QUERY",
        "CASE WHEN event_type = 'error' THEN 'Caller' || (user_id % 9) END AS APEX_CLASS_NAME", "'send' AS APEX_METHOD_NAME", "CASE WHEN event_type = 'error' THEN '/out/' || user_id WHEN user_id % 10 = 0 THEN '/Rest' || (user_id % 30 + 1) || '/items/' || event_id END AS URI", "'a' || (user_id % 30) AS KEY_PREFIX",
    )


LOG_SQL = """
logrows AS (SELECT event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS seen, user_id, event_id FROM events),
hits AS (
  SELECT 'object' AS bucket, lower('Entity_' || user_id || '__c') AS key, 'object' AS kind, seen FROM logrows WHERE event_type = 'click' OR (event_type = 'view' AND user_id % 10 > 1)
  UNION ALL SELECT 'rest_path', 'rest' || (user_id % 30 + 1), 'rest', seen FROM logrows WHERE event_type = 'view' AND user_id % 10 = 0
  UNION ALL SELECT 'key_prefix', 'a' || (user_id % 30), 'object', seen FROM logrows WHERE event_type = 'view' AND user_id % 10 = 1
  UNION ALL SELECT 'ui', lower('Card' || (user_id % 10)), 'ui', seen FROM logrows WHERE event_type = 'click'
  UNION ALL SELECT 'class', lower('Service' || (user_id % 20)), 'execution', seen FROM logrows WHERE event_type = 'purchase'
  UNION ALL SELECT 'method', lower('Service' || (user_id % 20) || '.run' || (event_id % 3)), 'execution', seen FROM logrows WHERE event_type = 'purchase'
  UNION ALL SELECT 'object', lower('Order_' || (user_id % 5) || '__c'), 'object', seen FROM logrows WHERE event_type = 'signup'
  UNION ALL SELECT 'field', lower('Field_' || (user_id % 7) || '__c'), 'field', seen FROM logrows WHERE event_type = 'signup'
  UNION ALL SELECT 'field', lower('Order_' || (user_id % 5) || '__c'), 'field', seen FROM logrows WHERE event_type = 'signup'
  UNION ALL SELECT 'class', lower('Caller' || (user_id % 9)), 'callout', seen FROM logrows WHERE event_type = 'error'
  UNION ALL SELECT 'method', lower('Caller' || (user_id % 9) || '.send'), 'callout', seen FROM logrows WHERE event_type = 'error')
"""
