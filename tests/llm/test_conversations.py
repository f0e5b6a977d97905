"""Repair of conversations against a dynamic programme over all edits."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from usage_audit.llm import conversations as C

STEP = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """Cost, audit and text of `rows` (role, text, fault) by a programme from the end; three inserted turns are never worth it."""

    @lru_cache(None)
    def best(i, q, inserted):
        ways = [(0, "", ())] if i == len(rows) and q in ("", "a") else []

        def way(edit, j, to, price, said, n=0):
            if rest := best(j, to, n):
                ways.append((price + rest[0], edit + rest[1], said + rest[2]))

        wanted = "a" if q == "u" else "u"
        name = {"u": "user", "a": "assistant"}[wanted]
        if inserted < 3:
            way("I", i, wanted, 3, (name + ":",), inserted + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            way("D", i + 1, q, 4, ())
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] and role[:1] in STEP[q]:
                    way("K", i + 1, role[:1], more, (f"{role}:{text}",))
                way("R", i + 1, wanted, 3 + more, (f"{name}:{text}",))
        return min(ways, default=None)

    for i in range(len(rows), -1, -1):  # from the end, so that no call goes deep
        for q in STEP:
            for inserted in (3, 2, 1, 0):
                best(i, q, inserted)
    cost, audit, said = best(0, "", 0)
    return cost, audit, "\n".join(said)


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = {}
    for c, own in convs.items():
        own.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        seen, judged = set(), []
        for _, _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            judged.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = {t for known, t, _, _ in own if known}
        faults = [j[2] for j in judged]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, *cheapest(judged))
    return out


def got(spark, rows, parts=3, **options):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS content", "1 AS later", "2 AS place", "3 AS cost").repartition(parts)
    found = C.repair(spark, df, **options).collect()
    out = {r[0]: tuple(r)[1:] for r in found}
    assert len(out) == len(found)
    return out


def some(n, seed, convs=None):
    random.seed(seed)
    texts = ["One.", "two", "Three! ", "", " \t", "é.", "x" * 50 + "?", "no end "]
    return [(random.choice([None, *range(n // 6)]) if convs is None else random.choice(convs), random.choice([None, 0, 1, 2, 3, 5, 9, -4]) if convs is None else i, random.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "User", None]), random.choice([*texts, f"own {i}.", f"own {i}", f"{i}?", None])) for i in range(n)]


def test_search_finds_the_first_of_the_cheapest():
    random.seed(4)
    for _ in range(1500):
        letters = "".join(random.choice("DsuaoSUAOuauaua") for _ in range(random.randint(0, 9)))
        rows = [("" if c == "D" else {"s": "system", "u": "user", "a": "assistant", "o": "tool"}[c.lower()], "t", "blank" if c == "D" else "truncated" if c.isupper() else "") for c in letters]
        found = C.cheapest(letters, C.START, frozenset([C.START, C.ASSISTANT]))
        assert found[:2] == cheapest(rows)[:2], letters


@pytest.mark.parametrize("stretch,held", [(32, 4096), (3, 7), (1, 1)])
def test_repair_against_brute_force(spark, monkeypatch, stretch, held):
    monkeypatch.setattr(C, "STRETCH", stretch)
    monkeypatch.setattr(C, "HELD", held)
    rows = some(200, 1) + [(900, 1, "user", "Same.")] * 4 + [(901, None, None, None)]
    want = brute(rows)
    assert got(spark, rows) == want
    hashed = got(spark, rows, digest=True)
    assert hashed == {k: (*v[:-1], hashlib.sha256(v[-1].encode()).hexdigest()) for k, v in want.items()}


def test_a_conversation_of_a_third_of_all_rows(spark):
    rows = some(1500, 7, convs=[1, 1, 1, *range(2, 60)]) + [(1, 10_000 + i, "user", "Again.") for i in range(300)]
    assert got(spark, rows, 6) == brute(rows)


def test_repair_of_nothing(spark):
    assert got(spark, []) == {}


def test_damage(spark):
    rows = [(c, t, r, x) for c in [*range(60), None] for t, r, x in [(0, "system", "Be kind."), (1, "user", "Hm? Yes!"), (2, "assistant", None), (None, None, "So. Long.")]]
    key = lambda v: " " if v is None else str(v)
    want = []
    for c, t, r, x in rows:
        fault, r, x = zlib.crc32(f"{key(c)}:{key(t)}".encode()) % 20, " " if r is None else r, " " if x is None else x
        if fault == 2:
            x = "".join(k for k in x if k not in ".!?")
        want += [(c, t, "user" if fault == 4 else r, "" if fault == 1 else x)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    assert sorted(map(tuple, C.damaged(df, fault).collect()), key=str) == sorted(want, key=str)


def test_query_keeps_conversations_without_rows(spark, tmp_path):
    gone = next(i for i in range(10_000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    kept = next(i for i in range(10_000) if zlib.crc32(f"{i}:1".encode()) % 20 > 4)
    spark.createDataFrame([(gone, 1, "user", "Hi."), (kept, 1, "user", "Hi.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["conv_id"]: r for r in C.op13_conversations(spark, str(tmp_path)).collect()}
    assert tuple(found[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert tuple(found[kept])[1:] == (0, 0, 0, 0, 0, 3, "KI", hashlib.sha256(b"user:Hi.\nassistant:").hexdigest())
