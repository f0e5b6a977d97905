"""Located references against a plain loop, and what of the files is moved for them."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from usage_audit import vocabulary as V
from usage_audit.functions import source as S

WORDS = ["Old__c", "order__c", "Total", "select", "a$b", "Acme$Old__c", "x", "é", "İd", "3old__c", "c/Old__c", "Old__c.Total", "foK", "zz9"]
GLUE = [" ", " ", "\n", "\n", ".", "'", '"', "\\", "//", "/*", "*/", "{!", "}", "/", "$", "<!--", "-->", "=", "\t"]
ALIASES = [(1, "old__c", "api_name"), (2, "order__c", "api_name"), (3, "total", "api_name"), (4, "select", "api_name"), (5, "old__c.total", "qualified"), (6, "c/old__c", "qualified"), (7, "acme$old__c", "report_qualified"), (8, "a$b", "api_name"), (9, "total", "bare_name"), (1, "zz9", "label"), (2, "old__c  order__c", "qualified"), (3, "x", "api_name"), (8, "fo", "api_name")]
KINDS = ("token_sweep", "string_literal", "merge_field", "comment_mention")


def sweepable(w):
    if re.search(r"[_.$/]", w) or (len(w) in (15, 18) and re.fullmatch("[a-z0-9]+", w) and re.search("[0-9]", w)):
        return True
    return w not in V.COMMON_WORDS and len(w) >= V.SHORTEST_BARE_WORD


def occurrences(source, suffix):
    words = lambda lo, hi: [(m.start(), m.end(), m.group().lower()) for p in (V.TOKEN, V.REPORT_COLUMN) for m in re.compile(p).finditer(source, lo, hi)]
    for lo, hi, region in S.split_any(suffix, source)[3]:
        if region == "literal":
            inner = source[lo + 1 : max(lo + 1, hi - 1)]
            yield lo + 1, lo + 1 + len(inner), inner.strip().lower(), "string_literal", region
            yield from ((*w, "string_literal", region) for w in (words(lo + 1, lo + 1 + len(inner)) if " " in inner else []))
        else:
            yield from ((*w, "comment_mention" if region == "comment" else "token_sweep", region) for w in words(lo, hi))
        for m in re.compile(V.MERGE_FIELD).finditer(source, lo, hi) if region in ("code", "markup") else []:
            said = m.group(1).strip()
            yield from ((m.start(), m.end(), p.lower(), "merge_field", region) for p in {said, *(p for p in re.split(r"[.\s(),]+", said) if len(p) > 1)})


def places(files, edges, aliases):
    for key, suffix, source in files:
        hits = set()
        for a, b, w, kind, region in occurrences(source or "", suffix):
            guarded = kind == "comment_mention" or (kind == "token_sweep" and (suffix or "").lower() not in V.CODE_SUFFIXES)
            hits |= {(a, -b, c, kind, k, region) for c, alias, k in aliases if alias == w and k not in V.NON_REFERENCE_KINDS and (key, c, kind) in edges and (sweepable(w) or not guarded)}
        kept = []
        for a, b, *about in sorted(hits):
            if kept and a < kept[-1][1]:
                if about[0] != kept[-1][2] and about[0] not in kept[-1][-1]:
                    kept[-1][-1].append(about[0])
            else:
                kept.append([a, -b, *about, []])
        for a, b, *about, also in kept:
            line, col = source.count("\n", 0, a), a - source.rfind("\n", 0, a) - 1
            for n, text in enumerate(source[a:b].split("\n")):
                if text:
                    yield (key, line + n, 0 if n else col, (0 if n else col) + len(text), text, *about, tuple(also))


def frames(spark, files, edges, aliases):
    return (
        spark.createDataFrame(files, "artifact_id long, suffix string, content string").repartition(3), spark.createDataFrame(sorted(edges, key=str), "artifact_id long, component_id long, match_kind string").repartition(2),
        spark.createDataFrame(aliases, "component_id long, alias_lc string, alias_kind string"),
    )


@pytest.mark.parametrize(("window", "short"), [(None, None), (5, 3)])
def test_places_against_a_loop(spark, monkeypatch, window, short):
    if window:  # the workers take it from the functions that are sent to them
        monkeypatch.setattr(S, "FILES_OF_TASK", 20)
    random.seed(window)
    text = lambda: "".join(random.choice(WORDS if random.random() < 0.55 else GLUE) for _ in range(random.randint(0, 60)))
    whole = ["x = 'Old__c'", "// Old__c", "Old__c", "x = 'Total Old__c'", '"c/Old__c"', "/* Old__c */ x", "{!Old__c.Total}", "'Old__c  order__c'", "Acme$Old__c"]
    lines = lambda: "\n".join(random.choice(whole) for _ in range(random.randint(1, 12)))
    files = [(k, random.choice([".cls", ".JS", ".page", ".xml", None]), random.choice([text, text, lines])()) for k in range(150)]
    files += [(None, ".cls", "Old__c"), (3, ".cls", "Old__c 'Total'"), (4, ".cls", None), (5, ".cls", "// " + "Old__c " * 400 + "\n'" + "Total " * 300)]
    edges = {(k, c, kind) for k in [None, *range(150)] for c in range(1, 10) for kind in KINDS if random.random() < 0.6}
    edges |= {(5, 1, "comment_mention"), (5, 3, "string_literal"), (7, 99, "token_sweep"), (8, 1, "other"), (999, 1, "token_sweep")}
    found = S.locate_references(*frames(spark, files, edges, ALIASES + [(1, None, "api_name")]))
    rows = [(*r[:-1], tuple(r[-1])) for r in map(tuple, found.collect())]
    want = list(places(files, edges, ALIASES))
    assert len(want) > 800 and any(r[-1] for r in want) and {r[6] for r in want} == set(KINDS)
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_windows_and_long_pieces_change_nothing(monkeypatch):
    random.seed(8)
    known = {a: [(c, k, True)] for c, a, k in ALIASES}
    for _ in range(400):
        source, suffix = "".join(random.choice(WORDS if random.random() < 0.55 else GLUE) for _ in range(random.randint(0, 50))), random.choice([".cls", ".xml"])
        want = sorted(o for o in set(occurrences(source, suffix)) if o[2] in known)
        for window, short in ((1 << 18, 100), (4, 100), (3, 2)):
            monkeypatch.setattr(S, "_WINDOW", window)
            monkeypatch.setattr(S, "_SHORT", short)
            got = [(start + a, start + b, *about) for start, hits in S._found(source, suffix, S._Pieces(known, suffix)) for a, b, *about in hits]
            assert sorted(set(got)) == want and [o[0] for o in got] == sorted(o[0] for o in got), (source, suffix, window)


def test_lines_tell_by_themselves_only_what_is_so():
    random.seed(3)
    for suffix, aliases in ((".cls", ALIASES), (".xml", ALIASES), (".cls", ALIASES[:4])):
        known = {a: [(c, k, True)] for c, a, k in aliases}
        lines = ["".join(random.choice([*WORDS, "alpha", "9x"] if random.random() < 0.5 else GLUE) for _ in range(random.randint(0, 12))).replace("\n", " ") for _ in range(3000)]
        reader, quiet = S._Lines(known, suffix), 0
        for line, silent in zip(lines, reader.silent(pa.array(lines)).tolist(), strict=True):
            text = line + "\nQ"
            hits, spans = {o for o in occurrences(text, suffix) if o[2] in known}, S.split_any(suffix, text)[3]
            ends_open = spans[-1][1:] not in ((len(text), "code"), (len(text), "markup"))
            found = reader[line]
            if silent or found is not S._WHOLE:
                assert not ends_open and (not silent or not hits), (suffix, line)
            if found is not S._WHOLE:
                assert {(a, b, text[a:b], kind, region) for a, b, _, kind, region in hits} == {(a, b, t, kind, region) for a, b, t, _, _, kind, _, region in found}, (suffix, line)
            quiet += silent
        assert 300 < quiet < 2900


def test_what_is_found_is_neither_sorted_nor_joined(spark):
    files = [(k, ".cls", "Old__c // order__c\nTotal") for k in range(30)]
    found = S.locate_references(*frames(spark, files, {(k, 1, "token_sweep") for k in range(30)}, ALIASES))
    assert found.count() == 30
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.replace("WindowGroupLimit", "Window")
    above = plan[: plan.index("MapInArrow")]
    assert "Join" not in above and "Exchange" not in above and "Sort" not in above and "ObjectHashAggregate" not in plan


def test_repeated_and_missing_documents_keep_their_places(spark, tmp_path):
    import duckdb

    from usage_audit.plans import detail_queries as D
    from usage_audit.plans import queries as Q

    rows = [(1, "Total order total"), (1, "alpha Total beta gamma total"), (None, "Total x order"), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "Total order of gamma"), (8, "order")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(Q.ORACLE_SQL["locate_layers"]).fetchall()
    columns = [c[0] for c in con.description]
    got = D.locate_layers(spark, str(tmp_path))
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want))
    assert got.filter(F.col("artifact_id").isNull()).count() > 0
