"""Reading long and odd texts, streams, the gate on all features, and analyses."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from gridpoint.functions import text as X
from gridpoint.functions.text import statistic_named_by
from gridpoint.operators import gate as K
from gridpoint.operators import grid as G
from gridpoint.operators import blocks as B
from gridpoint.operators import features as V
from gridpoint.operators import reader as R
from gridpoint.operators import trainset as T
from gridpoint.operators.features import NAMES
from gridpoint.plans import factory as M
from gridpoint.sources import markup
from gridpoint.streaming import tables as S

DATA = "/root/testdata/sf0.001"


def csv_rows(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string")
    return [[[c.text for c in row] for row in r.g] for r in df.select("i", markup.from_csv(F.col("raw")).alias("g")).orderBy("i").collect()]


def test_csv_fields(spark):
    got = csv_rows(spark, 'a,"b, ""c""\nd",\n\n1,2,3\r\n', ",x", "one", "", 'p,"open, 1\nq,2', '"a"b,c')
    assert got == [[["a", 'b, "c" d', ""], ["1", "2", "3"]], [["", "x"]], [["one"]], [], [["p", "open, 1 q,2"]], [["ab", "c"]]]


def test_long_csv_is_linear_and_keeps_the_stack(spark):
    began = time.time()
    quoted = '"' + '""' * 40_000 + 'end",1'
    lines = "\n".join(f"area {i},{i % 70},{i % 90},{i % 50}" for i in range(60_000))
    a, b = csv_rows(spark, quoted, lines)
    assert a == [['"' * 40_000 + "end", "1"]] and len(b) == 60_000 and b[-1][0] == "area 59999"
    assert time.time() - began < 60


def test_stream_gives_the_points_of_a_batch(spark, tmp_path):
    raw = M.html_tables(M.lines(spark, DATA)).limit(40).withColumns({"caption": F.lit("Peaks in MNI space"), "footer": F.lit("")})
    raw.write.json(f"{tmp_path}/in")
    tables = spark.read.schema(S.TABLE).json(f"{tmp_path}/in")
    for _ in range(2):  # the second start finds nothing new
        query = S.keep_reading(S.arriving(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", once=True)
        query.awaitTermination(300)
    same = ["table_id", "ord", "x", "y", "z", "statistic_value"]
    assert sorted(spark.read.parquet(f"{tmp_path}/out").select(same).collect()) == sorted(S.points(tables).select(same).collect())


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """Made training rows of the 46 features: reader_points and two others tell the label, with noise."""
    value = lambda n, k: F.pmod(F.xxhash64("table_id", F.lit(k)), F.lit(1000)) / 1000.0
    base = spark.range(300).withColumnRenamed("id", "table_id").withColumns({n: value(n, k) for k, n in enumerate(NAMES)})
    base = base.withColumn("reader_points", F.when(F.col("table_id") % 2 == 0, F.lit(1.5)).otherwise(0.0))
    base = base.withColumn("label", F.when(F.col("n_rows") + F.col("frac_even") > 1, "positive").otherwise("negative")).withColumn("extractor_found", F.lit(False))
    path = f"{tmp_path_factory.mktemp('rows')}/t"
    base.withColumn("article_id", (F.col("table_id") % 40).cast("string")).write.parquet(path)
    return spark.read.parquet(path)


def test_routed_gate(spark, rows, tmp_path):
    train = K.training_rows(rows)
    gate = K.fit_routed(train, trees=8)
    decided = {r.table_id: r for r in gate.decide(rows).collect()}
    assert len(decided) == 300 and {r.route for r in decided.values()} == {"candidates", "residual"}
    assert gate.thresholds["residual"]["out_of_fold"] and not gate.thresholds["candidates"]["out_of_fold"]
    own = [r for r in decided.values() if r.route == "candidates"]
    assert sum(r.keep for r in own if r.label == "positive") >= 0.99 * sum(r.label == "positive" for r in own)
    assert sum(r.keep == (r.label == "positive") for r in own) > 0.9 * len(own)
    gate.save(spark, f"{tmp_path}/gate")
    again = {r.table_id: (r.keep, r.score) for r in K.RoutedGate.load(spark, f"{tmp_path}/gate").decide(rows).collect()}
    assert again == {i: (r.keep, r.score) for i, r in decided.items()}
    told = gate.explain("candidates", rows.where("table_id < 20"), top=2).collect()
    assert len(told) == 40 and {"n_rows", "frac_even"} & {r.feature for r in told}


def test_tables_of_a_route_without_a_model_are_kept(rows):
    gate = K.RoutedGate({}, {})
    got = gate.decide(rows).collect()
    assert len(got) == 300 and all(r.keep and r.score is None for r in got)


def test_analyses_follow_sections(spark):
    points = [(float(i), 0.0, 0.0, r) for i, r in enumerate([1, 3, 4, 6, 8])]
    schema = "points array<struct<x:double,y:double,z:double,row:int>>, sections array<struct<row:int,text:string>>, caption string"
    some = [(points, [(2, "A"), (5, "B"), (7, "A")], " cap "), (points, [(2, "A")], None), (points[:2], [], "cap"), (points, [], "cap")]
    got = [None if r.analyses is None else [(a.name, [p.x for p in a.points]) for a in r.analyses] for r in T.with_analyses(spark.createDataFrame(some, schema)).collect()]
    assert got == [[("cap", [0.0]), ("A", [1.0, 2.0]), ("B", [3.0]), ("A", [4.0])], None, None, [("cap", [0.0, 1.0, 2.0, 3.0, 4.0])]]


def test_statistic_named_by(spark):
    some = [
        ("#R | #A | #S | #Peak\n1 | 2 | 3 | 4", None, None, None),
        ("Side | t\nR | 3", "", "", "T"),
        ("#Side | #<2:p\nR | 3", "Values are t statistics", "", "T"),
        ("#Side\nR | 3", "", "p below .05 corrected. Peak", "P"),
        ("#x (MNI) | #y (MNI) | #z (MNI)\n1 | 2 | 3", "", "", None),
        ("#Side | #p\nR | 3", "Peaks.", "Values shown are Z scores", "Z"),
        ("#Side | #p\nR | 3", "Peaks", "Values shown are Z scores", "P"),  # "Peaks values shown" is the first claim, of no statistic
        (None, None, None, None),
        ("", "", "", None),
    ]
    df = spark.createDataFrame([r[:3] for r in some], "t string, c string, f string")
    got = [r.k for r in df.select(statistic_named_by(F.col("t"), F.col("c"), F.col("f")).alias("k")).collect()]
    assert got == [r[3] for r in some]


def test_filled_grid_is_placed_alike(spark):
    made = "transform(array(0), i -> named_struct('text', 'a', 'header', false, 'colspan', 1, 'rowspan', 2))"
    rows = F.expr(f"array(concat({made}, array(named_struct('text', 'b', 'header', false, 'colspan', 1, 'rowspan', 1))), array(named_struct('text', 'c', 'header', false, 'colspan', 1, 'rowspan', 1)))")
    own = spark.range(1).select(G.resolve(rows.cast(f"array<array<{G.CELL}>>")).alias("placed"))
    r = own.select("placed", G.resolve(G.filled(F.col("placed"))).alias("again")).first()
    assert r.placed == r.again and [[c.text for c in row] for row in r.again] == [["a", "b"], ["~", "c"]]


def test_judged_negatives(spark, tmp_path):
    (tmp_path / "j.json").write_text('[{"verdict": "negative", "text": "a | b", "article": "1"}, {"verdict": "negative", "text": ""}, {"verdict": "positive", "text": "c"}, {"text": "d"}]')
    got = markup.judged_negatives(spark, str(tmp_path / "j.json")).collect()
    assert [(r.article_id, r.table_serialised, r.caption, r.origin) for r in got] == [("1", "a | b", "", "hand-judged")]
    with pytest.warns(UserWarning):
        assert markup.judged_negatives(spark, str(tmp_path / "none.json")).count() == 0


def test_compared_counts_repeats_and_nulls(spark):
    left, right = (spark.createDataFrame(r, "x int") for r in ([(1,), (1,), (2,), (None,)], [(1,), (3,), (None,)]))
    got = {r.x: (r.n_both, r.n_only_left, r.n_only_right) for r in T.compared(left, right, ("x",)).collect()}
    assert got == {1: (1, 1, 0), 2: (0, 1, 0), 3: (0, 0, 1), None: (1, 0, 0)}


def test_one_look_gives_what_the_whole_rules_give(spark):
    texts = ["", "5", "-72", "+3", "- 3", "2.50", "a  b", " a", "a b ", "a&amp;b", "<b>1</b>", "3*", "inf", "nan", "1,234", "4 a", "x y", "- .5", "-", "1_2", "٣", "1 2 3", "090012005", "12 34 56", "1234567890123456", "z (mm)"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    own, whole = ("clean", "as_number"), ("_settled", "_marked_number")
    got = rows.select("t", *(getattr(X, f)(F.col("t")).alias(f) for f in own + whole), F.size(X.triples_in(F.col("t"))).alias("triples")).collect()
    for r in got:
        assert r.clean == r._settled and str(r.as_number) == str(r._marked_number), r.t
    assert {r.t for r in got if r.triples} == {"1 2 3", "090012005", "12 34 56"}


def test_rows_below_a_span_are_placed_as_before(spark):
    head = "<table><tr><td rowspan=2>a</td><td>1</td></tr><tr><td>2</td></tr>"
    raws = [head + "<tr><td>3</td><td>4</td></tr>" * 2, "<table><tr><td>1</td><td rowspan=3>b</td></tr><tr></tr><tr></tr><tr></tr><tr><td>x</td><td>y</td></tr>", "<table><tr><td rowspan=2147483647>a</td></tr><tr><td>2</td></tr>"]
    rows = spark.createDataFrame([(i, r + "</table>") for i, r in enumerate(raws)], "i int, raw string")
    got = [r.g for r in rows.select("i", G.render(G.resolve(markup.from_source(F.col("raw")))).alias("g")).orderBy("i").collect()]
    assert got == ["^2:a | 1\n~ | 2\n3 | 4\n3 | 4", "1 | ^3:b\nx | ~ | y", "^2147483647:a\n~ | 2"]


def test_models_of_folds_are_fitted_beside_each_other(spark):
    rows = spark.range(40).select(F.col("id").alias("table_id"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2).cast("double").alias("a"))
    met = threading.Barrier(5, timeout=60)

    def fitter(part):
        met.wait()  # passes only when all five fits have begun
        return K.fit(part, names=("a",))

    scored, held_out = K.out_of_fold(rows, fitter)
    assert held_out and scored.count() == 40 and scored.where((F.col("score") > 0.5) != (F.col("y") == 1)).isEmpty()


def test_one_look_at_marks_beyond_ascii_and_at_several_numbers(spark):
    texts = ["12 ± 3", "é b", "a b", "a – b", "− 3", "x​y", "[0.1, 0.9]", "1,234 a", "1 234", "1,234,567*", "12, 345", "1, 2", "< 1,000", "(1) 2 3", "3 and 4", "#1,000", "٣,٣٣٣", "1,23", "1.5, 2", "5 a", "- 1,000", "1 000"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", X.clean(F.col("t")).alias("clean"), X._settled(F.col("t")).alias("settled"), X.as_number(F.col("t")).alias("number"), X._marked_number(F.col("t")).alias("marked"),
                      F.col("t").rlike(X.CLEAN_ALREADY).alias("look"), F.transform(G.parse(F.concat(F.lit("5 | "), "t"))[0], lambda c: c["text"]).alias("cells")).collect()
    for r in got:
        assert r.clean == r.settled and str(r.number) == str(r.marked), r.t
    assert {r.t for r in got if r.look} >= {"12 ± 3", "é b"}  # taken as they are, where the whole rules ran before
    assert {r.t: r.cells for r in got}["12 ± 3"] == ["5", "12 ± 3"]


def test_lists_of_words_match_alike_behind_a_look(spark):
    words = [w for p in V.STARTS for w in "".join(c if c.isalnum() else " " for c in p.replace(r"\b", " ").replace(r"\s", " ")).split()]
    texts = [" ".join(words[i : i + 3]) for i in range(0, len(words), 3)] + ["ſulcus Nūcleus K KE mm3", "ſcale Left R/L L | R", "peak voxel local  maxima BA 4 x, y, z mm ^3", "İnsula ınsula THALAMUS İnventory"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    pairs = [F.regexp_extract_all("t", F.lit(p), F.lit(0)) == F.regexp_extract_all("t", F.lit(V.led(p)), F.lit(0)) for p in V.STARTS]
    assert rows.select(*(F.every(c) for c in pairs)).first() == (True,) * len(pairs)


def test_values_bound_together_take_one_lambda(spark):
    deep = X.bind(*(F.lit(i) for i in range(120)), body=lambda *v: v[0] + v[119])  # one in another, these were over the analyzer's 100 passes
    assert spark.range(1).select(deep.alias("n")).first().n == 119


def test_cells_at_columns(spark):
    raws = ["<table><tr><td>1</td><td colspan=2>2</td><td>3</td></tr><tr><td rowspan=2>4</td><td>5</td><td>6</td><td>7</td></tr><tr><td>8</td><td>9</td></tr></table>"]
    rows = spark.createDataFrame([(r,) for r in raws], "raw string").select(G.resolve(markup.from_source(F.col("raw")), G.with_value).alias("rows"))
    at = lambda last: F.transform("rows", lambda row: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda col: R.value_at(row, col, last)["text"]))
    got = rows.select(at(True).alias("last"), at(False).alias("first"), G.width(F.col("rows")).alias("width"), R.numeric_columns(F.col("rows"), F.lit(4)).alias("numeric")).first()
    assert got.last == got.first == [["1", "2", "2", "3", None], ["4", "5", "6", "7", None], ["~", "8", "9", None, None]]
    assert got.width == 4 and got.numeric == [0, 1, 2, 3]


def test_blocks_that_are_taken_are_not_looked_at_again(spark):
    """The rows of a table are judged for columns that are free and hold a negative number; the blocks are the same."""
    row = "<tr><td>a</td><td>-4</td><td>8</td><td>6</td><td>-12</td><td>3</td><td>9</td><td>5</td></tr>"
    heads = ["<th>Region</th><th>x</th><th>y</th><th>z</th><th>a</th><th>b</th><th>c</th><th>d</th>", "<th>Region</th><th>a</th><th>b</th><th>c</th><th>d</th><th>e</th><th>f</th><th>g</th>"]
    raws = [f"<table><tr>{h}</tr>{row * 2}</table>" for h in heads] + [f"<table><tr>{heads[1]}</tr>{row.replace('-', '') * 2}</table>"]
    tables = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "table_id int, raw string")
    found = B.coordinate_blocks(R.prepared(tables, markup.from_source(F.col("raw"))))
    assert [[tuple(b) for b in r.blocks] for r in found.orderBy("table_id").select("blocks").collect()] == [[(1, 3), (4, 6)], [(1, 3), (4, 6)], []]
    assert "_listed" not in found.columns  # axes that an earlier block covers were judged row by row before
