"""The scanner, definition files, file trees, logs, upserts."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from usage_audit.functions import source as S
from usage_audit.operators import artifacts as AR
from usage_audit.operators import resolve as RE
from usage_audit.operators import graph as G
from usage_audit.plans import more_queries as M
from usage_audit.sources import files


@pytest.mark.parametrize(
    ("source", "code", "comments", "literals"),
    [
        ("a//x\nb", "ab", "x\n", []), ("a /* c 'q' */ b", "a  b", " c 'q'  ", []), ("s = 'it\\'s'; // 'no'", "s =  ; ", " 'no'", ["it's"]), ("x 'a' \"bc\" y", "x     y", "", ["bc"]),
        ("u = 'open", "u = ", "", []), ("'a//b' /* open", "  ", " open", ["a//b"]), ("", "", "", []), ("a/b", "a/b", "", []),
    ],
)
def test_scanner(source, code, comments, literals):
    got = S.split_code(source)
    assert got[:3] == (code, comments, literals)
    spans = got[3]
    assert "".join(source[a:b] for a, b, _ in spans) == source


def test_markup():
    code, comments, literals, spans = S.split_xml("<a><!-- no --><![CDATA[x]]></a>")
    assert code == "<a>  x </a>" and comments == "<!-- no -->" and literals == [] and [k for _, _, k in spans] == ["markup", "comment", "markup"]


def test_members():
    xml = "<CustomObject xmlns='x'>\n<fields>\n<fullName>A__c</fullName>\n<valueSet><value><fullName>not</fullName></value></valueSet>\n</fields>\n<fields><fullName>B__c</fullName></fields>\n</CustomObject>"
    assert S.spans_of_members(xml) == ([("fields", "A__c", 1, 4), ("fields", "B__c", 5, 5)], True)
    assert S.spans_of_members("<a>") == ([], False)


def test_attributes_and_activity(spark):
    rows = [("classes/Old.cls", "class Old"), ("classes/Old.cls-meta.xml", "<status>Inactive</status>"), ("flows/F.flow", "<status>Draft</status>"), ("lwc/card/card.js", ""), ("odd/x.bin", None), ("classes/ATest.cls", ""), ("customMetadata/M.xml", '<field>Is_Enabled__c</field> <value xsi:type="xsd:boolean">false</value>')]
    df = spark.createDataFrame(rows, "path string, content string")
    got = {r["path"]: r for r in AR.consumer_active(AR.artifact_attributes(df)).collect()}
    assert not got["classes/Old.cls"]["is_active"] and not got["flows/F.flow"]["is_active"] and not got["customMetadata/M.xml"]["is_active"] and got["classes/ATest.cls"]["is_active"]
    assert got["lwc/card/card.js"]["member_name"] == "card" and got["odd/x.bin"]["metadata_type"] == "odd" and got["classes/ATest.cls"]["is_test"] and got["classes/Old.cls-meta.xml"]["is_meta"]


def test_resolution(spark):
    components = spark.createDataFrame([(1, "CustomField", "A__c"), (2, "CustomField", "B__c"), (3, "CustomField", "A__c"), (4, "LightningComponentBundle", None)], "id long, ctype string, parent_object string")
    aliases = spark.createDataFrame([(1, "flag__c", "api_name"), (2, "flag__c", "api_name"), (3, "active", "api_name"), (4, "card", "api_name"), (1, "flag", "stripped_suffix")], "component_id long, alias_lc string, alias_kind string")
    artifacts = spark.createDataFrame([(1, "ApexClass", True, False, True), (2, "Layout", False, False, True), (3, "CustomTab", False, False, True), (4, "ApexClass", True, True, True)], "artifact_id long, metadata_type string, is_code boolean, is_test boolean, is_active boolean")
    said = [(1, "flag__c", "token", 0), (1, "a__c", "token", 0), (1, "active", "token", 0), (2, "active", "token", 0), (3, "card", "tab_lwc", 1), (4, "active", "token", 0), (1, "active", "comment", 9), (1, "flag", "token", 0)]
    got = {(r["artifact_id"], r["component_id"], r["match_kind"]): r["tier"] for r in RE.resolve_references(spark.createDataFrame(said, "artifact_id long, said string, origin string, precedence int"), aliases, components, artifacts).collect()}
    assert got == {(1, 1, "token_sweep"): "A", (1, 2, "token_sweep"): "C", (1, 3, "token_sweep"): "A", (3, 4, "string_literal"): "A", (4, 3, "token_sweep"): "C"}


def test_overlaps_and_places(spark):
    content = "class X {\n  a = Order__c.Old__c; // Old__c\n}"
    files_ = spark.createDataFrame([(1, ".cls", content)], "artifact_id long, suffix string, content string")
    aliases = spark.createDataFrame([(5, "old__c", "api_name"), (6, "order__c", "api_name"), (7, "class", "label")], "component_id long, alias_lc string, alias_kind string")
    edges = spark.createDataFrame([(1, 5, "token_sweep"), (1, 5, "comment_mention"), (1, 7, "token_sweep")], "artifact_id long, component_id long, match_kind string")
    got = sorted((r["line"], r["col"], r["end_col"], r["text"], r["region"]) for r in S.locate_references(files_, edges, aliases).collect())
    assert got == [(1, 15, 21, "Old__c", "code"), (1, 26, 32, "Old__c", "comment")]
    hits = spark.createDataFrame([(1, 0, 10, 1, "k", "a", "code"), (1, 0, 4, 2, "k", "a", "code"), (1, 12, 15, 3, "k", "a", "code")], "artifact_id long, start int, end int, component_id long, match_kind string, alias_kind string, region string")
    assert sorted((r["component_id"], r["also"]) for r in S.dedupe_overlaps(hits).collect()) == [(1, [2]), (3, [])]


@pytest.mark.parametrize(("policy", "want"), [("replace", (None, 5)), ("keep", (1, 2)), ("coalesce", (1, 5)), ("add", (1, 7))])
def test_upsert(spark, policy, want):
    a, b = spark.createDataFrame([(1, 1, 2), (2, 9, 9)], "k int, x int, y int"), spark.createDataFrame([(1, None, 5), (3, 4, 4)], "k int, x int, y int")
    got = {r["k"]: (r["x"], r["y"]) for r in files.upsert(a, b, ["k"], policy).collect()}
    assert got == {1: want, 2: (9, 9), 3: (4, 4)}
    with pytest.raises(ValueError):
        files.upsert(a, b, ["k"], "no")


def test_tree_and_logs(spark, tmp_path):
    (tmp_path / "t/classes").mkdir(parents=True)
    (tmp_path / "t/classes/A.cls").write_bytes(b"\xef\xbb\xbfa\r\nb")
    (tmp_path / "t/logo.png").write_bytes(b"\x00\x01")
    got = {r["path"]: (r["content"], r["bytes"]) for r in files.read_artifacts(spark, str(tmp_path / "t")).collect()}
    assert got == {"classes/A.cls": ("a\nb", 7), "logo.png": (None, 2)}
    (tmp_path / "mock(ApexTrigger).csv").write_text("﻿ timestamp ,TRIGGER_NAME\n1,T\n")
    (tmp_path / "b.csv").write_text("EVENT_TYPE,X\nRestApi,2\n,3\n")
    rows = files.read_event_logs(spark, [str(tmp_path / "mock(ApexTrigger).csv"), str(tmp_path / "b.csv")])
    assert sorted((r["EVENT_TYPE"], r["TRIGGER_NAME"], r["X"]) for r in rows.collect()) == sorted([("ApexTrigger", "T", None), ("RestApi", None, "2"), ("b", None, "3")], key=str) or rows.count() == 3


def test_overlaps_against_a_loop(spark):
    random.seed(12)
    rows = []
    for _ in range(900):
        start = random.randint(0, 120)
        rows.append((random.randint(1, 9), start, start + random.randint(1, 12), random.randint(1, 6), random.choice(["token_sweep", "merge_field"]), random.choice(["api_name", "qualified"]), random.choice(["code", "comment"])))
    want = []
    for file in range(1, 10):
        kept = []
        for r in sorted((r for r in rows if r[0] == file), key=lambda r: (r[1], -r[2], *r[3:])):
            if kept and r[1] < kept[-1][2]:
                if r[3] != kept[-1][3] and r[3] not in kept[-1][-1]:
                    kept[-1][-1].append(r[3])
            else:
                kept.append([*r, []])
        want += map(tuple, kept)
    hits = spark.createDataFrame(rows, "artifact_id long, start int, end int, component_id long, match_kind string, alias_kind string, region string").repartition(4)
    got = [(*r[:-1], list(r[-1])) for r in map(tuple, S.dedupe_overlaps(hits).collect())]
    assert sorted(got) == sorted(want)


def test_located_literals_and_merge_fields(spark):
    content = "a = 'Old__c'; q = 'SELECT Old__c FROM Order__c';\n/* Old__c\nOld__c */ b = \"{!Old__c.Name}\";"
    files_ = spark.createDataFrame([(1, ".cls", content)], "artifact_id long, suffix string, content string")
    aliases = spark.createDataFrame([(5, "old__c", "api_name"), (6, "order__c", "api_name")], "component_id long, alias_lc string, alias_kind string")
    edges = spark.createDataFrame([(1, c, k) for c in (5, 6) for k in ("token_sweep", "string_literal", "comment_mention")], "artifact_id long, component_id long, match_kind string")
    got = sorted((r["line"], r["col"], r["end_col"], r["text"], r["component_id"], r["match_kind"], r["region"], list(r["also"])) for r in S.locate_references(files_, edges, aliases).collect())
    assert got == [
        (0, 5, 11, "Old__c", 5, "string_literal", "literal", []), (0, 26, 32, "Old__c", 5, "string_literal", "literal", []), (0, 38, 46, "Order__c", 6, "string_literal", "literal", []),
        (1, 3, 9, "Old__c", 5, "comment_mention", "comment", []), (2, 0, 6, "Old__c", 5, "comment_mention", "comment", []),
    ]


def test_a_tree_has_a_folder_for_many_pages(spark):
    base = Path(G.shared_folder(spark).removeprefix("file://"))
    before, d = set(base.iterdir()), "/root/testdata/sf0.001"
    got = {r["page_id"]: r["bytes"] for r in M.read_artifacts(spark, d).collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    assert got == {r["page_id"]: len(r["html"].encode()) + 1 for r in pages}
    (tree,) = (p for p in set(base.iterdir()) - before if p.name.startswith("tree-"))
    held = [p for p in tree.rglob("*") if p.is_file()]
    assert len(held) == len(pages) and len({p.parent for p in held}) <= max(got) // 1000 + 1
    rows = spark.createDataFrame([("a/b.txt", "ü\r\nx"), ("c.txt", None)], "path string, content string")
    assert files.write_artifacts(rows, f"file://{tree}/more") == 2
    assert (tree / "more/a/b.txt").read_bytes() == "ü\r\nx".encode() and (tree / "more/c.txt").read_bytes() == b""
    assert files.write_artifacts(rows.limit(0), f"file://{tree}/none") == 0 and files.read_artifacts(spark, f"file://{tree}/none").count() == 0
