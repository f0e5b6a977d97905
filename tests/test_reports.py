"""Reports written and read, logs of many headers, newest files."""

import random

from pyspark.sql import functions as F

from usage_audit.operators import events as E
from usage_audit.operators import joins as J
from usage_audit.operators import reports as R
from usage_audit.sources import files


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_a_report_is_written_again(spark, tmp_path):
    one = spark.range(2500).selectExpr("id AS component_id", "concat('n', id % 7) AS api_name", "if(id % 3 = 0, 'UNUSED', 'USED') AS label", "array(id, id + 1) AS steps").repartition(5)
    totals = one.groupBy("label").agg(F.count("*").alias("components"))
    tables = {"components": one, "summary": totals, "none": one.limit(0)}
    for run, part in (("r1", tables), ("r2", {k: v.limit(3) for k, v in tables.items()}), ("r1", tables)):
        R.write_report(part, str(tmp_path), run, rows_per_file=400)
        found = R.read_report(spark, str(tmp_path), run, ["components", "summary"])
        assert all(rows_of(found[k].select(part[k].columns)) == rows_of(part[k]) for k in found)
    assert R.read_report(spark, str(tmp_path), "r2", ["components"])["components"].count() == 3
    sizes = [r["count"] for r in spark.read.parquet(f"{tmp_path}/components/run_id=r1").groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 2500 and max(sizes) <= 400
    R.write_report({"summary": totals}, f"{tmp_path}/json", "r1", format="json")
    assert rows_of(R.read_report(spark, f"{tmp_path}/json", "r1", ["summary"], "json")["summary"].select("label", "components")) == rows_of(totals)


def test_logs_of_one_header_are_one_scan(spark, tmp_path):
    want = []
    for k in range(120):
        kind = ("a,EVENT_TYPE", " EVENT_TYPE , b", "﻿A", "x,x,")[k % 4]
        own = (f"1{k},T{k}", f"T{k},2{k}", f'"3,{k}"', f"l{k},r{k},e{k}")[k % 4]
        (tmp_path / f"Log {k}.csv").write_text(f"{kind}\n{own}\n")
        want.append(((f"1{k}", f"T{k}", None, None, None), (None, f"T{k}", f"2{k}", None, None), (f"3,{k}", "Log", None, None, None), (None, "Log", None, f"l{k}", f"r{k}"))[k % 4])
    (tmp_path / "empty.csv").write_text("")
    found = files.read_event_logs(spark, [str(tmp_path)])
    assert sorted(map(str, map(tuple, found.select("A", "EVENT_TYPE", "B", "X", "X_1").collect()))) == sorted(map(str, want))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 4


def test_newest_files_of_large_types(spark):
    random.seed(6)
    rows = [(random.choice(["a", "a", "a", "b", "c", None]), random.choice([None, *range(50)]) if k % 7 else k % 9, k) for k in range(1500)] + [("old", k, 5000 + k) for k in range(9)]
    df = spark.createDataFrame(rows, "event_type string, log_date int, file long").selectExpr("*", "1 AS n", "2 AS part").repartition(5)
    for since, per_type in ((40, 5), (40, 1), (100, 5), (100, 2), (0, 1000)):
        want = []
        for kind in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == kind), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
            new = [r for r in own if r[1] is not None and r[1] >= since]
            want += new[:per_type] if new else own[: min(per_type, 3)]
        got = files.latest_log_files(df, since, per_type)
        assert sorted(map(str, (tuple(r)[:3] for r in got.collect()))) == sorted(map(str, want)) and got.columns == df.columns


def test_event_hits_keep_the_smallest_samples(spark, monkeypatch):
    monkeypatch.setattr(E, "HELD", 40)
    random.seed(2)
    rows = [(random.choice("ab"), random.choice(["hot", "hot", "k1", f"k{random.randint(2, 200)}"]), random.choice(E.KINDS), random.choice([None, f"{random.randint(0, 99):02}"]), random.choice(["é", None, *map(str, range(10))])) for _ in range(1500)]
    got = E.event_hits(spark.createDataFrame(rows, "bucket string, key string, kind string, seen string, sample string").repartition(7), 4).collect()
    assert len(got) == len({r[:2] for r in rows})
    for g in got:
        own = [r for r in rows if r[:2] == (g["bucket"], g["key"])]
        assert g["total"] == len(own) and all(g[f"{k}s"] == sum(r[2] == k for r in own) for k in E.KINDS)
        assert g["last_seen"] == max((r[3] for r in own if r[3]), default=None)
        assert g["samples"] == sorted({r[4] for r in own if r[4]}, key=str.encode)[:4]


def test_joins_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT_PART", 5)
    rows = spark.createDataFrame([("hot", k) for k in range(300)] + [(f"k{k}", k) for k in range(60)] + [(None, 7)], "k string, salt int")
    table = spark.createDataFrame([("hot", "x"), ("hot", "y"), ("k3", "z"), ("none", "w"), (None, "v")], "k string, salts string")
    for how in ("inner", "left", "left_semi"):
        assert rows_of(J.salted_join(rows, table, ["k"], how)) == rows_of(rows.join(table, ["k"], how))
    maybe = J.maybe_among(rows, table, ["k"])
    assert maybe.columns == rows.columns and maybe.filter("k in ('hot', 'k3')").count() == 301 and maybe.count() < 320
    assert J.unused("salt", rows, table) == "salt_1" and J.unused("SALTS", table) == "SALTS_1"
