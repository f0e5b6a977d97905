"""The rules one by one, the guard, the graph."""

import json

import pytest
from pyspark.sql import functions as F

from usage_audit import vocabulary as V
from usage_audit.operators import evidence as EV
from usage_audit.operators import graph as G
from usage_audit.operators import reports as R
from usage_audit.operators import runs as RU
from usage_audit.plans import classify as C

RAN = [V.STATIC, V.POPULATION, V.RUNTIME, V.REACHABILITY]
STATIC_MISS, NO_DATA = (V.STATIC, V.MISS, None, 0.0, {}), (V.POPULATION, V.MISS, None, 0.0, {})
LAYOUT = (V.STATIC, V.HIT, "A", 0.5, {"layout_only": True, "layout_names": ["Main", "Side"]})
REACHED, UNREACHED = (V.REACHABILITY, V.HIT, "A", 1.0, {"reachable": True, "path": ["a", "b", "c", "d", "e"]}), (V.REACHABILITY, V.MISS, None, 0.0, {"reachable": False})
WEAK = lambda *types: (V.STATIC, V.UNCLEAR, "C", 0.3, {"weak_references": 2, "weak_source_types": list(types)})


def decide(spark, ctype, evidence, gaps=(), flags=(), ran=RAN, **attrs):
    base = {"id": 1, "ctype": ctype, "namespace": None, "in_scope": True, "out_of_scope_reason": None, "is_entry_point": False, "is_exposed": False, "is_test": False} | attrs
    c = spark.createDataFrame([tuple(base.values())], "id long, ctype string, namespace string, in_scope boolean, out_of_scope_reason string, is_entry_point boolean, is_exposed boolean, is_test boolean")
    e = spark.createDataFrame([(1, a, r, t, w, json.dumps(p)) for a, r, t, w, p in evidence], "component_id long, collector_id string, result string, tier string, weight double, payload string")
    g = spark.createDataFrame([(1, x) for x in gaps], "component_id long, collector_id string")
    f = spark.createDataFrame([(1, x) for x in flags], "component_id long, code string")
    return C.classify(c, e, g, f, ran).first()


CASES = [
    ("R0", "OUT_OF_SCOPE", 100, V.FIELD, [STATIC_MISS], {"namespace": "pkg"}), ("R1", "OUT_OF_SCOPE", 100, V.FIELD, [STATIC_MISS], {"in_scope": False}), ("R2", "NEEDS_REVIEW", 55, V.FIELD, [STATIC_MISS, NO_DATA], {"gaps": [V.POPULATION]}), ("R2", "NEEDS_REVIEW", 55, V.FIELD, [STATIC_MISS], {"ran": [V.STATIC]}),
    ("R3a", "UNUSED", 70, V.FIELD, [LAYOUT, NO_DATA], {}), ("R6", "NEEDS_REVIEW", 50, V.FIELD, [LAYOUT, NO_DATA], {"flags": ["DYNAMIC_APEX_IN_SCOPE"]}), ("R3", "USED", 86, V.FIELD, [LAYOUT, (V.POPULATION, V.HIT, "B", 0.7, {})], {}), ("R3", "USED", 95, V.CLASS, [STATIC_MISS, REACHED], {}),
    ("R4", "USED", 75, V.FIELD, [STATIC_MISS, (V.POPULATION, V.HIT, "B", 0.7, {})], {}), ("R5", "NEEDS_REVIEW", 60, V.CLASS, [STATIC_MISS, UNREACHED], {"is_entry_point": True}), ("R5", "NEEDS_REVIEW", 60, V.UI_TYPES[0], [STATIC_MISS, UNREACHED], {"is_exposed": True}), ("R5", "NEEDS_REVIEW", 60, V.CLASS, [STATIC_MISS, UNREACHED], {"is_test": True}),
    ("R6", "NEEDS_REVIEW", 50, V.FIELD, [STATIC_MISS, NO_DATA], {"flags": ["DYNAMIC_APEX_IN_SCOPE"]}), ("R9", "UNUSED", 70, V.FIELD, [STATIC_MISS, NO_DATA], {"flags": ["RECENTLY_CHANGED"]}), ("R5b", "UNUSED", 80, V.CLASS, [STATIC_MISS, UNREACHED], {}), ("R7a", "UNUSED", 55, V.FIELD, [WEAK("Profile"), NO_DATA], {}), ("R7", "NEEDS_REVIEW", 55, V.FIELD, [WEAK("Profile", "Report"), NO_DATA], {}), ("R9", "UNUSED", 80, V.FIELD, [STATIC_MISS, NO_DATA], {}),
]


@pytest.mark.parametrize(("rule", "label", "confidence", "ctype", "evidence", "more"), CASES)
def test_rules(spark, rule, label, confidence, ctype, evidence, more):
    v = decide(spark, ctype, evidence, **more)
    assert (v["rule_trace"][0]["rule"], v["label"], v["confidence"]) == (rule, label, confidence)
    if rule == "R3a":
        assert [s["blocking"] for s in v["removal_prerequisites"]] == [False] * 3 and v["removal_prerequisites"][0]["targets"] == ["Main", "Side"]
    if evidence[-1] == REACHED:
        assert "a -> b -> c -> d" in v["reason_codes"][0]


def test_promotion_and_guard(spark):
    components = spark.createDataFrame([(1, "ApexClass", "Keep", None), (2, "ApexMethod", "Keep.m", 1), (3, "ApexClass", "Dead", None), (4, "ApexClass", "Other", None), (5, "ApexClass", "Lone", None)], "id long, ctype string, api_name string, parent_id long").withColumn("parent_object", F.lit(None).cast("string"))
    step = "array<struct<step:string,targets:array<string>,blocking:boolean>>"
    verdicts = spark.createDataFrame([(1, "UNUSED"), (2, "USED"), (3, "UNUSED"), (4, "UNUSED"), (5, "UNUSED")], "component_id long, label string").select("component_id", "label", F.lit(70.0).alias("confidence"), F.array(F.lit("X")).alias("reason_codes"), F.array().cast("array<struct<rule:string,fired:boolean,why:string>>").alias("rule_trace"), F.array().cast(step).alias("removal_prerequisites"))
    promoted = C.promote_parents(verdicts, components)
    assert {r["component_id"]: (r["label"], r["confidence"]) for r in promoted.collect()}[1] == ("USED", 80.0)
    artifacts = spark.createDataFrame([(10, "ApexClass", "keep"), (11, "ApexClass", "Dead"), (12, "Layout", "Other")], "artifact_id long, metadata_type string, member_name string")
    edges = spark.createDataFrame([(10, 3, "A"), (11, 4, "A"), (11, 3, "A"), (12, 5, "A")], "artifact_id long, component_id long, tier string")
    got = {r["component_id"]: r for r in C.transitive_guard(promoted, edges, artifacts, components).collect()}
    assert (got[3]["label"], got[3]["confidence"], got[3]["reason_codes"]) == ("NEEDS_REVIEW", 60.0, ["BLOCKED_BY_DEPENDENT"])
    assert got[4]["label"] == "UNUSED" and got[4]["removal_prerequisites"][0]["blocking"] and got[5]["reason_codes"] == ["X"]


def test_reachability_rules(spark):
    nodes = spark.createDataFrame([("t", True), ("f", False), ("c", False), ("m", False), ("x", False), ("e", True), ("p", False)], "key string, is_entry_point boolean")
    edges = spark.createDataFrame([("t", "f", "implements"), ("f", "c", "reference"), ("f", "x", "declares"), ("c", "m", "member_of"), ("e", "p", "member_of")], "src string, dst string, kind string")
    got = {r["key"]: (r["distance"], r["path"]) for r in G.reachability(nodes, edges).collect()}
    assert got == {"t": (0, ["t"]), "e": (0, ["e"]), "f": (1, ["t", "f"]), "c": (2, ["t", "f", "c"]), "m": (3, ["t", "f", "c", "m"])}


def test_a_chain_is_followed_to_its_end(spark):
    keys = [f"n{k:02}" for k in range(17)]
    nodes = spark.createDataFrame([(k, k == "n00", k.upper()) for k in keys], "key string, is_entry_point boolean, label string")
    edges = spark.createDataFrame([(a, b, "reference") for a, b in zip(keys, keys[1:], strict=False)], "src string, dst string, kind string")
    reached = G.reachability(nodes, edges, 16)
    got = {r["key"]: r for r in reached.collect()}
    assert got["n16"]["distance"] == 16 and got["n16"]["path"] == keys[5:] and got["n11"]["path"] == keys[:12]
    routes = {r["key"]: r for r in G.path_to_root(reached, nodes).collect()}
    assert (routes["n16"]["labels"][0], routes["n16"]["root"]) == ("N16", "N00")
    for far in (lambda: G.reachability(nodes, edges, 3), lambda: G.closure(edges, nodes.selectExpr("key AS node").limit(1), most_hops=3)):
        with pytest.raises(RuntimeError):
            far()


def test_clusters(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 51), (51, 99)], "src long, dst long")
    members = spark.createDataFrame([(k,) for k in [*range(31), 50, 51]], "node long")
    got = {r["node"]: r["cluster"] for r in G.clusters(members, edges).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 50: 50, 51: 50}


def test_summary_does_not_fan_out(spark):
    c = spark.createDataFrame([(1, "CustomField", "A")], "id long, ctype string, api_name string")
    e = spark.createDataFrame([(1, V.HIT), (1, V.MISS), (1, V.MISS)], "component_id long, result string")
    two = spark.createDataFrame([(1,), (1,)], "component_id long")
    s = R.component_summary(c, spark.createDataFrame([(1, "USED", 80.0)], "component_id long, label string, confidence double"), e, two, two).first()
    assert (s["hits"], s["clean"], s["gaps"], s["flags"]) == (1, 2, 2, 2)


def test_sequences_and_differences(spark):
    e = spark.createDataFrame([("r", 1, 1), ("r", 2, 3), ("r", 5, 2)], "run_id string, seq long, event_id long")
    assert [(r["after"], r["seq"]) for r in RU.sequence_gaps(e).collect()] == [(2, 5)]
    a, b = spark.createDataFrame([("t", "x", "UNUSED"), ("t", "y", "USED")], "ctype string, api_name string, label string"), spark.createDataFrame([("t", "x", "USED"), ("t", "z", "USED")], "ctype string, api_name string, label string")
    assert {r["api_name"]: r["change"] for r in RU.compare_runs(a, b).collect()} == {"x": "regression", "y": "removed", "z": "added"}


def test_population_in_one_pass(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, None)], "a int, b string")
    assert {r["field"]: (r["total"], r["filled"], r["pct"]) for r in EV.field_population(df, ["a", "b"]).collect()} == {"a": (3, 2, 66.67), "b": (3, 1, 33.33)}
    assert {r["field"]: r["has_value"] for r in EV.field_has_any_value(df.limit(0), ["a"]).collect()} == {"a": False}
