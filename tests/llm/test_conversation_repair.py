import random
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from gridpoint.llm import conversation_repair as C

PATTERN = re.compile(r"(s?(ua)+)?")


def brute(initials, faults):
    """Every edit sequence up to the cost of deleting all: the least (cost, audit)."""
    best = (3 * len(initials), "D" * len(initials))

    def walk(i, made, cost, audit):
        nonlocal best
        if (cost, audit) > best and cost >= best[0] and not best[1].startswith(audit):
            return
        if cost > best[0]:
            return
        if i == len(initials) and PATTERN.fullmatch(made):
            best = min(best, (cost, audit))
        for x in "ua":
            walk(i, made + x, cost + 2, audit + "I")
        if i < len(initials):
            walk(i + 1, made, cost + 3, audit + "D")
            if faults[i] not in "bd" or not faults[i]:
                charge = int(faults[i] == "t")
                walk(i + 1, made + (initials[i] or "?"), cost + charge, audit + "K")
                for x in "ua":
                    walk(i + 1, made + x, cost + 2 + charge, audit + "R")

    walk(0, "", 0, "")
    return best


def test_search_finds_the_cheapest_and_least_audit():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randint(0, 4)
        initials, faults = rng.choices(["u", "a", "s", "t", " ", ""], [5, 5, 2, 1, 1, 1], k=n), rng.choices(["", "t", "b", "d"], [5, 2, 1, 1], k=n)
        (found,) = C.search(initials, faults).values()
        assert found == brute(initials, faults), (initials, faults)


def test_blocks_join_to_the_whole():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 14)
        initials, faults = rng.choices("uast", [5, 5, 2, 1], k=n), rng.choices(["", "t", "b", "d"], [5, 2, 1, 1], k=n)
        parts, at = [], 0
        while at < n:
            end = min(n, at + rng.randint(1, 4))
            parts.append([(e, x, *t) for e in range(4) for x, t in C.search(initials[at:end], faults[at:end], e, (0, 1, 2, 3), first=False).items()])
            at = end
        joined = C.joined_blocks(parts)
        whole = C.search(initials, faults)
        assert min((c, a) for e, x, c, a in joined if e == 0 and x in C.ENDS) == next(iter(whole.values()))


def rows(seed):
    rng = random.Random(seed)
    texts = ["Hi.", "Yes!  ", "no", "", " \t\n", "Why?\n", "é.", "a.b", None, "x" * 5000, "\xa0", "end.\xa0"]
    out = []
    for conv in [None, *range(60)]:
        for turn in range(rng.choice([1, 2, 5, 9])):
            for _ in range(rng.choice([1, 1, 1, 2])):
                out.append((conv, rng.choice([turn, turn, turn, None, 40]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(texts)))
    out += [(400, t, "user" if t % 2 == 0 else "assistant", f"turn {t}{'.' if t % 7 else ''}") for t in range(700)]
    out += [(500 + k, 0, "user", "only.") for k in range(40)]
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def expected(tmp_path_factory, spark):
    """The SQL's rows over the table of rows(5), which the tests read too."""
    folder = tmp_path_factory.mktemp("conversations")
    path = f"{folder}/conversations.parquet"
    spark.createDataFrame(rows(5), SCHEMA).withColumn("cost", F.lit("x")).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    told = con.execute(C.OP11_SQL)
    names = [d[0] for d in told.description]
    return str(folder), names, sorted(told.fetchall(), key=str)


@pytest.mark.parametrize("long", [512, 6])
def test_query_equals_sql(spark, expected, long, monkeypatch):
    folder, names, want = expected
    monkeypatch.setattr(C, "LONG", long)
    if long == 6:
        monkeypatch.setattr(C, "BLOCK", 4), monkeypatch.setattr(C, "FOLD", 2)
    found = C.op11_conversation_repair(spark, folder)
    assert sorted(found.columns) == sorted(names)
    got = sorted((tuple(r[n] for n in names) for r in found.collect()), key=str)
    assert got == want and len(got) == 102


def test_whole_table_equals_sql(spark):
    con = duckdb.connect()
    path = Path("/root/testdata/sf0.001")
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet'")
    told = con.execute(C.OP11_SQL)
    names = [d[0] for d in told.description]
    got = sorted(tuple(r[n] for n in names) for r in C.op11_conversation_repair(spark, str(path)).collect())
    assert got == sorted(told.fetchall())


def test_repair_without_damage(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (2, 3, "user", "A."), (2, 7, "assistant", "B.")], SCHEMA)
    got = {r.conv_id: (r.gaps, r.illegal, r.cost, r.audit) for r in C.repair_conversations(df).collect()}
    assert got == {1: (0, 0, 4, "IKKI"), 2: (3, 0, 0, "KK")}
    assert C.repair_conversations(df.limit(0)).count() == 0
