"""Short ways through the reader give what the whole rules give, and are taken."""

import pytest
from pyspark.sql import functions as F

from gridpoint.functions import text as X
from gridpoint.operators import features as V
from gridpoint.operators import grid as G
from gridpoint.sources import markup
from gridpoint.synth import prose
from gridpoint.synth.draw import Draw

CELLS = ["a", "", "a>b", "x/>", "+5", "-5", " 5", "- 5", "5 ", "a  b", "~", "#a", "a|b", "nan", "1234567", "12.5", "1234.5678", "5*", "é", "a&amp;b", "&", "5\n6", "infra", "<i>7</i>", "12 3 4"]


def test_values_are_held_without_a_copy(spark):
    assert "transform" not in str(X.let(F.col("a"), lambda v: v)) and "transform" not in str(X.bind(F.col("a"), F.col("b"), body=lambda a, b: a + b))


def test_rows_without_attributes_are_read_as_those_with(spark):
    html, cals = (lambda tag, c: f"<table><tr><{tag}>{c}</td><td>z</td></tr></table>"), (lambda tag, c: f"<tgroup><row><{tag}>{c}</entry><entry>z</entry></row></tgroup>")
    rows = spark.createDataFrame([(html("td", c), html('td class="k"', c)) for c in CELLS] + [(cals("entry", c), cals('entry class="k"', c)) for c in CELLS], "plain string, full string")
    for found in rows.select("plain", markup.from_source(F.col("plain")).alias("a"), markup.from_source(F.col("full")).alias("b")).collect():
        assert found["a"] == found["b"], found


def test_a_plain_line_is_parsed_as_one_with_a_mark(spark):
    rows = spark.createDataFrame([(f"{c} |  | b",) for c in CELLS if "\n" not in c and "|" not in c], "t string")
    for found in rows.select("t", G.parse(F.col("t")).alias("a"), G.parse(F.concat("t", F.lit(" | \\#"))).alias("b")).collect():
        assert [c for r in found["a"] for c in r] == [c for r in found["b"] for c in r][:-1], found


def test_values_of_cells_are_those_of_the_whole_rules(spark):
    placed = G.resolve(F.array(F.array(G.cell(F.col("t"), F.lit(False), F.lit(1), F.lit(1)))))
    rows = spark.createDataFrame([(c,) for c in CELLS], "t string").select("t", F.flatten(G.valued(placed))[0].alias("c"), X.as_number(F.col("t")).alias("num"), X.triples_in(F.col("t")).alias("triples"), X.strip(F.col("t")).alias("bare"))
    for r in rows.collect():
        same = lambda a, b: a == b or (a != a and b != b)
        assert same(r["c"]["num"], r["num"]) and r["c"]["triples"] == r["triples"] and r["c"]["bare"] == r["bare"], r


def test_a_triple_that_is_known_is_not_sought_again(spark):
    texts = ["1, 2, 3", "1 (2, 3)", "a (1; 2 3)", "200 1 2 3", "1,2", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("w", V.whole_triple(F.col("t"))).select("w", V.straddles_a_bracket(F.col("t"), F.col("w")))
    assert [tuple(r) for r in rows.collect()] == [(True, False), (False, True), (True, False), (True, False), (False, False), (False, False), (None, None)]


def test_abbreviations_and_orders_without_patterns_of_their_own(spark):
    rows = spark.createDataFrame([("left SMA | IFG",), ("SMAX",), ("none",)], "t string")
    found = rows.select(F.transform(prose.used(prose.REGION_NAMES, F.col("t")), lambda s: s["short"]).alias("s"))
    assert [r["s"] for r in found.collect()] == [["SMA", "IFG"], [], []]
    assert "pattern" not in str(prose.used(prose.REGION_NAMES, F.col("t")))
    d = Draw(F.col("id"))
    wrong = spark.range(2000).select(d.u("a").alias("u"), d.digits("a").alias("s")).selectExpr("rank() OVER (ORDER BY u) - rank() OVER (ORDER BY s) AS off").where("off <> 0")
    assert wrong.count() == 0


@pytest.mark.parametrize("header", ["T value", "p", "Region", "L/R", "x, y, z", "cohen's d", "Correlation", "k", "", "t (12)", "Hedges' g"])
def test_one_look_for_any_statistic(spark, header):
    told = spark.range(1).select(F.lit(header).rlike(X.ANY_STATISTIC), F.coalesce(*(F.when(F.lit(header).rlike(p), k) for k, p in X.STATISTICS.items()))).first()
    assert told[0] == (told[1] is not None)
