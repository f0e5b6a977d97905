"""Levels of the graph: each node written once, hubs looked up apart, a narrow and a wide frontier."""

import random
from pathlib import Path

import pytest

from usage_audit.operators import graph as G


def reached(edges, entries):
    distance, root, path = dict.fromkeys(entries, 0), {k: k for k in entries}, {k: [k] for k in entries}
    frontier = sorted(entries)
    while frontier:
        via = {}
        for src, dst, kind in edges:
            if src in frontier and dst not in distance and kind != "declares" and (kind != "member_of" or distance[src] > 0):
                via[dst] = min(via.get(dst, src), src)
        for k, v in via.items():
            distance[k], root[k], path[k] = distance[v] + 1, root[v], (path[v] + [k])[-5:]
        frontier = sorted(via)
    return {k: (distance[k], root[k], path[k]) for k in distance}


def run(spark, edges, entries, keep):
    nodes = spark.createDataFrame([(k, True) for k in entries], "key string, is_entry_point boolean")
    df = spark.createDataFrame(edges, "src string, dst string, kind string").repartition(3)
    return {r["key"]: (r["distance"], r["root"], r["path"]) for r in G.reachability(nodes, df, keep_path=keep).collect()}


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_paths_of_random_graphs(spark, monkeypatch, parts):
    monkeypatch.setattr(G._Levels, "LEAST_PARTS", parts)
    random.seed(parts)
    name = lambda: f"n{random.randint(0, 60):02}"
    edges = list({(name(), name(), random.choice(["reference", "reference", "member_of", "declares"])) for _ in range(110)})
    assert run(spark, edges, ["n00", "n07", "n99"], 5) == reached(edges, ["n00", "n07", "n99"])


def test_hubs_are_looked_up_apart(spark, monkeypatch):
    monkeypatch.setattr(G, "hot_keys", lambda rows, keys, least=0, find=G.hot_keys: find(rows, keys, 20))
    edges = [("e", "hub", "reference")] + [("hub", f"x{k:03}", "reference") for k in range(200)] + [(f"x{k:03}", f"y{k % 40:02}", "reference") for k in range(200)]
    assert run(spark, edges, ["e"], 5) == reached(edges, ["e"])


def test_nothing_is_written_twice(spark, monkeypatch):
    monkeypatch.setattr(G._Levels, "LEAST_PARTS", 8)
    base = Path(G.shared_folder(spark).removeprefix("file://"))
    before = set(base.glob("levels-*"))
    edges = [(f"k{n:03}", f"k{n + 1:03}", "reference") for n in range(12)]
    found = G.closure(spark.createDataFrame(edges, "src string, dst string, kind string"), spark.createDataFrame([("k000",)], "node string"))
    assert {(r["node"], r["hops"]) for r in found.collect()} == {(f"k{n:03}", n) for n in range(1, 13)}
    (own,) = set(base.glob("levels-*")) - before
    rows = {p.name: spark.read.option("recursiveFileLookup", True).schema("node string").parquet(str(p)).count() for p in own.iterdir()}
    assert rows == {f"level-{n}": int(n < 13) for n in range(13)} | {k: 0 for k in rows if k == "level-13"}  # edges and candidates are gone


def test_edges_are_a_row_for_each_source(spark, monkeypatch):
    monkeypatch.setattr(G, "hot_keys", lambda rows, keys, least=0, find=G.hot_keys: find(rows, keys, 1500))
    monkeypatch.setattr(G._Levels, "LIST", 100)
    edges = [(f"k{n:02}", f"x{n * m}") for n in range(40) for m in range(5)] * 2 + [("hub", f"y{m}") for m in range(2000)]
    levels = G._Levels(spark.createDataFrame(edges, "src string, dst string").selectExpr("*", "true AS first"), 0)
    rows = levels._read([levels.edges], set(range(levels.parts))).collect()
    assert sorted(r["src"] for r in rows if r["src"] != "hub") == [f"k{n:02}" for n in range(40)]
    hub = [r["dsts"] for r in rows if r["src"] == "hub"]
    assert len(hub) > 10 and max(map(len, hub)) < 300
    assert {(r["src"], x) for r in rows for x in r["dsts"]} == set(edges) and sum(len(r["dsts"]) for r in rows) == len(set(edges))


def test_whole_folders_are_read_where_most_parts_are(spark, monkeypatch):
    monkeypatch.setattr(G._Levels, "LEAST_PARTS", 16)
    levels = G._Levels(spark.createDataFrame([(f"k{n}", f"k{n + 1}", True) for n in range(300)], "src string, dst string, first boolean"), 0)
    asked = []
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *paths, whole=type(spark.read).parquet: asked.append(paths) or whole(self, *paths))
    assert levels._read([levels.edges], set(range(16))).count() == 300
    assert asked.pop() == (levels.edges[0],)
    assert 0 < levels._read([levels.edges], {3}).count() < 60
    assert asked == [(f"{levels.edges[0]}/part=3",)]


def test_wide_frontiers_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(G._Levels, "MOST_SENT", 0)
    monkeypatch.setattr(G._Levels, "MOST_PATHS_SENT", 0)
    monkeypatch.setattr(G._Levels, "WIDE", 2)
    random.seed(5)
    name = lambda: f"n{random.randint(0, 60):02}"
    edges = list({(name(), name(), "reference") for _ in range(110)})
    assert run(spark, edges, ["n00", "n07"], 5) == reached(edges, ["n00", "n07"])
