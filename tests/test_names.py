"""Aliases, bare words, log fields and literals on small inputs."""

import pytest
from pyspark.sql import functions as F

from usage_audit.functions import text as T
from usage_audit.operators import aliases as A
from usage_audit.operators import events as E


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("word", "able"),
    [("active", False), ("name", False), ("status", False), ("sku", False), ("true", False), ("", False), ("active__c", True), ("a.b", True), ("obj$field", True), ("c/card", True), ("warehouse", True), ("001a0000003dgb2", True), ("abcdefghijklmno", True), ("orderx", True), ("short", False)],
)
def test_bare_words(spark, word, able):
    assert one(spark, T.is_sweepable(F.lit(word))) is able


def test_field_aliases(spark):
    df = spark.createDataFrame([(1, "CustomField", "Old_Code__c", "Order__c", "Old code", "00N000000000001AAA", "Codes__r")], "id long, ctype string, api_name string, parent_object string, label string, sf_id string, relationship_name string")
    got = {(r["alias_lc"], r["alias_kind"]) for r in A.generate_aliases(df).collect()}
    assert got == {
        ("old_code__c", "api_name"), ("order__c.old_code__c", "qualified"), ("order__c$old_code__c", "report_qualified"), ("old_code", "stripped_suffix"), ("codes__r", "relationship_name"), ("order__c.codes__r", "qualified"),
        ("00n000000000001aaa", "sf_id_18"), ("00n000000000001", "sf_id_15"), ("old code", "label"),
    }


def test_method_and_bundle_aliases(spark):
    df = spark.createDataFrame([(1, "ApexMethod", "Svc.getTotal", None, None), (2, "LightningComponentBundle", "orderCard", None, "ns"), (3, "ApexClass", "Svc", None, None)], "id long, ctype string, api_name string, parent_object string, namespace string")
    got = {(r["component_id"], r["alias_lc"]) for r in A.generate_aliases(df).collect()}
    assert got == {(1, "gettotal"), (1, "svc.gettotal"), (1, "@salesforce/apex/svc.gettotal"), (1, "c.gettotal"), (1, "total"), (2, "ordercard"), (2, "c/ordercard"), (2, "c:ordercard"), (2, "c-order-card"), (2, "ns/ordercard"), (2, "ns:ordercard"), (3, "svc"), (3, "svc.")}


@pytest.mark.parametrize(
    ("entry", "want"),
    [("Svc.run()", ("class", "Svc", "run")), ("ns.Svc.run", ("class", "ns.Svc", "run")), ("Trg on Order trigger event BeforeInsert", ("trigger", "Trg", "beforeinsert")), ("VF- page", ("skip", "", "")), ("/apex/x", ("skip", "", "")), ("Svc", ("class", "Svc", "")), ("a b", ("skip", "", "")), (None, ("skip", "", "")), ("TRIGGERS", ("skip", "", ""))],
)
def test_entry_points(spark, entry, want):
    assert tuple(one(spark, T.parse_entry_point(F.lit(entry).cast("string")))) == want


def test_log_rows(spark):
    rows = [
        ("ApexExecution", "1", "Svc.run", None, None, None, None, None), ("LightningInteraction", "2", None, "force:x;c:Card;c:card", "Pet__c", None, None, None), ("LightningPageView", "3", None, None, "Account", None, None, None),
        ("RestApi", "4", None, None, None, '"SELECT%20A__c FROM B__c"', None, None), ("ApexRestApi", "5", None, None, None, None, "/Orders/{id}", None), ("ApexRestApi", "5", None, None, None, None, "/services/data", None), ("DatabaseSave", "6", None, None, None, None, None, "a01"),
    ]
    logs = spark.createDataFrame(rows, "EVENT_TYPE string, TIMESTAMP string, ENTRY_POINT string, COMPONENT_NAME string, PAGE_ENTITY_TYPE string, QUERY string, URI string, KEY_PREFIX string")
    hits = {(r["bucket"], r["key"]): r["total"] for r in E.event_hits(E.normalised_events(logs)).collect()}
    assert hits == {("class", "svc"): 1, ("method", "svc.run"): 1, ("object", "pet__c"): 1, ("ui", "card"): 1, ("object", "b__c"): 1, ("field", "a__c"): 1, ("field", "b__c"): 1, ("rest_path", "orders"): 1, ("key_prefix", "a01"): 1}


def test_literals(spark):
    x = spark.createDataFrame([([" hello there ", "SELECT Id, A__c FROM B__c", "x"], "v {! Obj.Field__c } w")], "l array<string>, code string").select(T.harvest_literals("l", "code").alias("x")).first()["x"]
    got = {(r["literal"], r["origin"]) for r in x}
    assert ("hello there", "string_literal") in got and ("a__c", "string_literal") in got and ("b__c", "string_literal") in got and ("hello", "string_literal") not in got
    assert ("obj.field__c", "merge_field") in got and ("field__c", "merge_field") in got and ("x", "string_literal") not in got


def test_small_functions(spark):
    assert one(spark, T.redact(F.lit("password=abcdefgh x token: t1"))) == "password=[REDACTED] x token: t1"  # eight characters or more
    assert one(spark, T.redact(F.lit("db_password = 'hunter2hunter2' and private_key: MIIEvgIBADAN"))) == "db_password=[REDACTED]' and private_key=[REDACTED]"
    assert one(spark, T.redact(F.lit("API-KEY:aaaa/bbbb+c= Bearer=xyz12345."))) == "API-KEY=[REDACTED] Bearer=[REDACTED]"
    assert one(spark, T.rest_path_keys(F.lit("OrderRestService"))) == ["orderrestservice", "order"]
    assert one(spark, T.confidence_band(F.lit(None).cast("double"))) == "Unknown"
    assert one(spark, T.parse_timestamp(F.lit("nonsense"))) is None and one(spark, T.parse_timestamp(F.lit("2024-05-01T10:00:00.000+0000"))).hour == 10
    assert one(spark, T.unused_flavor(F.lit("UNUSED"), F.lit("UNREACHABLE"))) == "unreachable" and one(spark, T.unused_flavor(F.lit("USED"), F.lit("x"))) is None
