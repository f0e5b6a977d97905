"""What one task holds, and how often a step runs, stay bounded as inputs grow."""

import random
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from usage_audit.functions import source as S
from usage_audit.operators import aliases as A
from usage_audit.operators import evidence as EV
from usage_audit.operators import graph as G
from usage_audit.operators import joins as J
from usage_audit.operators import resolve as RE
from usage_audit.plans import more_queries as M
from usage_audit.streaming import run_events as ST


def test_found_places_are_handed_on_in_small_batches():
    words = 3 * S._HELD_ROWS
    content = "\n".join(f"name_{n % 7}" for n in range(words))
    files = pa.RecordBatch.from_pydict({"artifact_id": [1, 2], "suffix": [".cls", None], "content": [content, "name_3"], "names": [["name_3", "name_5"], ["name_3"]]})
    found = list(S._located(iter([files, files])))
    assert max(b.num_rows for b in found) <= S._HELD_ROWS
    rows = [r for b in found for r in b.to_pylist()]
    assert len(rows) == 2 * (sum(n % 7 in (3, 5) for n in range(words)) + 1)
    assert {(r["line"], r["lead"], r["said"]) for r in rows if r["artifact_id"] == 1} == {(n, 0, f"name_{n % 7}") for n in range(words) if n % 7 in (3, 5)}
    assert [r["is_code"] for r in rows if r["artifact_id"] == 2] == [False, False]


def test_clusters_send_no_table_through_the_driver(spark):
    links = G.cut(spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "a")], "a string, b string"), "links")
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    found = G._with_least(links, "b", least, [])
    assert sorted(tuple(r) for r in found.collect()) == [("b", "a", None), ("c", "b", "a"), ("d", "a", None)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    members = G.cut(spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "node string"), "members")
    whole = G.clusters(members, links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    assert sorted(tuple(r) for r in whole.collect()) == [("a", "a"), ("b", "a"), ("c", "a"), ("z", "z")]
    assert "Broadcast" not in whole._jdf.queryExecution().executedPlan().toString()


def test_stages_share_calls_of_python(spark, tmp_path):
    random.seed(5)
    rows = sorted((1_700_000_000 + random.randrange(4_000), n, f"r{n % 9}", f"s{n % 2}", random.choice([0.1, 0.5, 1.0])) for n in range(600))
    want, last = set(), {}
    for at, seq, run, stage, progress in rows:
        if progress >= 1 or at - last.get((run, stage), float("-inf")) >= 300:
            want.add((run, seq))
            last[run, stage] = at
    for k in range(3):
        part = spark.createDataFrame(rows[200 * k : 200 * k + 200], "s long, seq long, run_id string, stage string, progress double")
        part.selectExpr("run_id", "seq", "timestamp_seconds(s) AS at", "stage", "'progress' AS kind", "progress").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = ST.throttle_progress(spark.readStream.schema("run_id string, seq long, at timestamp, stage string, kind string, progress double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"), 300.0, groups=2)
    put = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/{epoch}")
    running = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{tmp_path}/cursor").trigger(availableNow=True).start()
    assert running.awaitTermination(120)
    found = spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/out")
    assert {(r["run_id"], r["seq"]) for r in found.collect()} == want


def test_a_sample_of_a_graph_is_ranked_once(spark):
    nodes = spark.createDataFrame([(f"k{n}", n == 0) for n in range(6)], "key string, is_entry_point boolean")
    edges = spark.createDataFrame([("k0", "k1"), ("k1", "k2"), ("k4", "k5")], "src string, dst string")
    reached = spark.createDataFrame([("k0", 0, ["k0"]), ("k1", 1, ["k0", "k1"]), ("k2", 2, ["k0", "k1", "k2"])], "key string, distance int, path array<string>")
    found = G.sample_subgraph(nodes, edges, reached, most_nodes=4)
    assert [tuple(r) for r in found.orderBy("place").collect()] == [("k3", 1), ("k4", 2), ("k5", 3), ("k0", 4)]
    assert "distance" not in found._jdf.queryExecution().analyzed().toString()  # the ranked nodes are read, not ranked again


def test_a_batch_of_logs_is_several_files_but_the_batches_stay_two(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS_OF_LOG_FILE", 200)
    base = Path(G.shared_folder(spark).removeprefix("file://"))
    before, d = set(base.iterdir()), "/root/testdata/sf0.001"
    M.streaming_event_hits(spark, d).collect()
    names = {p.name.rsplit("-", 1)[0]: p for p in set(base.iterdir()) - before}
    each = 1 + spark.read.parquet(f"{d}/events.parquet").count() // 200
    assert each > 1 and len(list(names["logs"].glob("*.parquet"))) == 2 * each
    assert len([p for p in (names["cursor"] / "commits").iterdir() if p.name.isdigit()]) == 2


def _tasks(df):
    """Tasks of the last step of `df`, which Spark may merge unless they were dealt by a number."""
    return df.rdd.getNumPartitions()


def test_referrers_lie_in_as_many_tasks_as_their_rows_need(spark, monkeypatch):
    monkeypatch.setattr(J, "ROWS_OF_TASK", 50)
    components = spark.createDataFrame([(n, f"c{n}", "ApexClass", "p") for n in range(20)], "id long, api_name string, ctype string, parent_object string")
    artifacts = spark.createDataFrame([(n, "ApexClass", f"C{n % 25}", True) for n in range(100)], "artifact_id long, metadata_type string, member_name string, is_active boolean")
    edges = spark.createDataFrame([(n % 100, n % 20, "A", "token_sweep") for n in range(1000)], "artifact_id long, component_id long, tier string, match_kind string")
    found = RE.referenced_by(edges, artifacts, components, 7)
    assert _tasks(found) == 1000 // 50 + 1
    want = {}
    for a, c in ((n % 100, n % 20) for n in range(1000)):
        if a % 25 != c:
            want.setdefault(c, []).append((f"C{a % 25}", a, a % 25 if a % 25 < 20 else None))
    got = {}
    for r in found.orderBy("component_id", "place").collect():
        got.setdefault(r["component_id"], []).append((r["member_name"], r["artifact_id"], r["referrer_id"]))
    assert got == {c: sorted(rows, key=lambda x: x[:2])[:7] for c, rows in want.items()}


def test_aliases_lie_in_as_many_tasks_as_their_rows_need(spark, monkeypatch):
    monkeypatch.setattr(J, "ROWS_OF_TASK", 50)
    rows = [(n % 90, "ApexClass", f"Klass{n % 90}") for n in range(100)]  # ten come twice
    found = A.generate_aliases(spark.createDataFrame(rows, "id long, ctype string, api_name string"))
    assert _tasks(found) == 100 * A.FORMS // 50 + 1
    assert sorted(tuple(r)[:3] for r in found.collect()) == sorted([(n, f"klass{n}", "api_name") for n in range(90)] + [(n, f"klass{n}.", "qualified") for n in range(90)])


def test_resolved_edges_lie_in_as_many_tasks_as_their_rows_need(spark, monkeypatch):
    monkeypatch.setattr(J, "ROWS_OF_TASK", 50)
    components = spark.createDataFrame([(n, "CustomField", "owner__c") for n in range(10)], "id long, ctype string, parent_object string")
    aliases = spark.createDataFrame([(n, f"field{n % 5}__c", "api_name") for n in range(10)], "component_id long, alias_lc string, alias_kind string")
    artifacts = spark.createDataFrame([(n, "ApexClass", True, False, True) for n in range(60)], "artifact_id long, metadata_type string, is_code boolean, is_test boolean, is_active boolean")
    said = [(n, f"field{m}__c", "token", 0) for n in range(60) for m in range(5)] + [(n, "owner__c", "token", 0) for n in range(0, 60, 2)]
    found = RE.resolve_references(spark.createDataFrame(said, "artifact_id long, said string, origin string, precedence int"), aliases, components, artifacts)
    assert _tasks(found) == len(said) // 50 + 1
    assert {(r["artifact_id"], r["component_id"], r["tier"]) for r in found.collect()} == {(n, c, "C" if n % 2 else "A") for n in range(60) for c in range(10)}


def test_dependents_of_one_component_lie_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(J, "ROWS_OF_TASK", 50)
    monkeypatch.setattr(EV.E, "sample_values", lambda df, *a, find=EV.E.sample_values: seen.append(df) or find(df, *a))
    seen = []
    components = spark.createDataFrame([(1, "Klass", "ApexClass", "a00000000000001AAA", True), (2, "Other", "ApexClass", None, True)], "id long, api_name string, ctype string, sf_id string, in_scope boolean")
    deps = spark.createDataFrame([("a00000000000001AAA", None, f"r{n % 150}", "Report") for n in range(300)], "ref_id string, ref_name string, by_name string, by_type string")
    found = {r["component_id"]: (r["result"], r["payload"]) for r in EV.match_dependencies(deps, components, 2).collect()}
    assert found[1][0] == "EVIDENCE_OF_USE" and '"dependents":150' in found[1][1] and '["Report:r0","Report:r1"]' in found[1][1]
    assert found[2][0] == "NO_EVIDENCE_FOUND"
    held = seen[0].groupBy(F.spark_partition_id()).count().collect()
    assert len(held) > 5


def test_hot_nodes_are_looked_up_in_one_job(spark):
    links = [(f"x{n:03}", "hub") for n in range(300)] + [("hub", "a")]
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    spark.sparkContext.setJobGroup("hot nodes", "")
    try:
        for name, value in zip(names, ("90", "false"), strict=True):
            spark.conf.set(name, value)
        found = G.components(spark.createDataFrame(links, "a string, b string"))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("hot nodes"))
        assert {tuple(r) for r in found.collect()} == {(k, "a") for pair in links for k in pair}
        written = found.inputFiles()
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 90  # an iterator over what is found of a hot node had been a job for each partition
    assert len(written) <= 1 + G.LEAST_TASKS
