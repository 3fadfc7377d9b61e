"""Markup made from the driver's tables, so that reading it back can be compared with the base columns.

One table for each order, one line for each line number: x, y and z from part, supplier and quantity, a statistic and an
extent from line number and supplier. All coordinates lie in a head, so a reader must return exactly them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same lines in SQL.
LINES = """lines AS (
  SELECT l_orderkey AS table_id, l_linenumber AS line, CAST(max(l_partkey) % 145 - 72 AS BIGINT) AS x, CAST(max(l_suppkey) % 209 - 104 AS BIGINT) AS y,
    CAST(max(l_quantity) AS BIGINT) - 25 AS z, max(l_suppkey) + 1 AS extent, max(l_returnflag) AS flag, max(l_linestatus) AS status
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines in one partition, so neither grouping shuffles again. The number is stated, as reading the made tables
    takes far more time than their bytes tell, by which adaptive execution would join partitions."""
    base = spark.read.parquet(f"{sf_dir}/lineitem.parquet").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    top = lambda c: F.max(c)
    return base.groupBy(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("line")).agg(
        (top("l_partkey") % 145 - 72).cast("long").alias("x"), (top("l_suppkey") % 209 - 104).cast("long").alias("y"), (top("l_quantity").cast("long") - 25).alias("z"),
        (top("l_suppkey") + 1).alias("extent"), top("l_returnflag").alias("flag"), top("l_linestatus").alias("status"))


def tabled(rows: DataFrame, line: Column, head: str, tail: str, key: str = "table_id", between: str = "") -> DataFrame:
    """table_id and raw: the lines' markup in line order between head and tail."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("line").alias("n"), line.alias("text"))))
    return rows.groupBy(key).agg(F.concat(F.lit(head), F.array_join(F.transform(ordered, lambda r: r["text"]), between), F.lit(tail)).alias("raw"))


def text(name: str) -> Column:
    return F.col(name).cast("string")


def statistic() -> Column:
    """2.5 and the line number, as text."""
    return F.concat((F.col("line") + 2).cast("string"), F.lit(".5"))


def html_tables(rows: DataFrame) -> DataFrame:
    row = F.concat(F.lit("<tr><td>Area "), F.col("flag"), F.lit("</td><td>"), F.concat_ws("</td><td>", text("x"), text("y"), text("z"), statistic(), text("extent")), F.lit("</td></tr>"))
    head = '<table><tr><th rowspan="2">Region</th><th colspan="3">MNI coordinates</th><th rowspan="2">Z value</th><th rowspan="2">Cluster size (voxels)</th></tr><tr><th>x</th><th>y</th><th>z</th></tr>'
    return tabled(rows, row, head, "</table>")


def cals_tables(rows: DataFrame) -> DataFrame:
    minus = lambda n: F.regexp_replace(text(n), "^-", "−<hsp sp='0.25'/>")
    row = F.concat(F.lit("<row><entry>Area "), F.col("flag"), F.lit("</entry><entry>"), F.concat_ws("</entry><entry>", minus("x"), minus("y"), minus("z"), statistic(), text("extent")), F.lit("</entry></row>"))
    head = '<tgroup><thead><row><entry>Region</entry><entry namest="col2" nameend="col4">Talairach coordinates (x, y, z)</entry><entry>T score</entry><entry>k</entry></row></thead><tbody>'
    return tabled(rows, row, head, "</tbody></tgroup>")


def csv_tables(rows: DataFrame) -> DataFrame:
    row = F.concat(F.lit('"Area, '), F.col("flag"), F.lit('",'), F.concat_ws(",", text("x"), text("y"), text("z"), statistic(), text("extent")))
    return tabled(rows, row, "Region,x (mm),y (mm),z (mm),t,mm3\n", "\n", between="\n")


def packed_tables(rows: DataFrame) -> DataFrame:
    """Coordinates of a line in one cell, in one of five forms by table."""
    x, y, z = (text(n) for n in "xyz")
    forms = (F.concat_ws(" ", x, y, z), F.concat_ws(", ", x, y, z), F.concat(F.lit("("), F.concat_ws(", ", x, y, z), F.lit(")")), F.concat_ws("; ", x, y, z), F.concat(F.concat_ws(" ", x, y, z), F.lit(" (BA 40)")))
    row = F.concat(F.lit("<tr><td>Area</td><td>"), F.get(F.array(*forms), (F.col("table_id") % 5).cast("int")), F.lit("</td><td>"), statistic(), F.lit("</td></tr>"))
    return tabled(rows, row, "<table><tr><th>Region</th><th>Peak coordinates</th><th>F value</th></tr>", "</table>")


def split_tables(rows: DataFrame) -> DataFrame:
    """All lines of an order as one row whose axis cells hold every value, apart by slashes."""
    each = lambda n: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", n))), lambda r: r[n].cast("string")), "/")
    cells = F.concat_ws("</td><td>", F.lit("cluster"), each("x"), each("y"), each("z"))
    return rows.groupBy("table_id").agg(F.concat(F.lit("<table><tr><th>Cluster</th><th>X</th><th>Y</th><th>Z</th></tr><tr><td>"), cells, F.lit("</td></tr></table>")).alias("raw"))


def section_tables(rows: DataFrame) -> DataFrame:
    """A banner before each line whose status differs from the line before, and a label over the lines of a run."""
    from pyspark.sql import Window

    w = Window.partitionBy("table_id").orderBy("line")
    marked = rows.withColumn("before", F.lag("status").over(w))
    banner = F.when(F.col("before").isNull() | (F.col("before") != F.col("status")), F.concat(F.lit('<tr><td colspan="4">Contrast '), F.col("status"), F.lit("</td></tr>"))).otherwise("")
    row = F.concat(banner, F.lit("<tr><td>Area</td><td>"), F.concat_ws("</td><td>", text("x"), text("y"), text("z")), F.lit("</td></tr>"))
    return tabled(marked, row, "<table><tr><th>Region</th><th>x</th><th>y</th><th>z</th></tr>", "</table>")


def label_tables(rows: DataFrame) -> DataFrame:
    """One label cell that spans all lines of an order."""
    ordered = F.array_sort(F.collect_list(F.struct("line", "x", "y", "z")))
    cells = F.transform(ordered, lambda r, i: F.concat(
        F.lit("<tr>"), F.when(i == 0, F.concat(F.lit('<td rowspan="'), F.size(ordered).cast("string"), F.lit('">'), F.when(F.col("table_id") % 2 == 1, "Right").otherwise("Left"), F.lit(" area "), F.col("table_id").cast("string"), F.lit("a</td>"))).otherwise(""),
        F.lit("<td>"), F.concat_ws("</td><td>", r["x"].cast("string"), r["y"].cast("string"), r["z"].cast("string")), F.lit("</td></tr>")))
    return rows.groupBy("table_id").agg(F.concat(F.lit("<table><tr><th>Region</th><th>x</th><th>y</th><th>z</th></tr>"), F.array_join(cells, ""), F.lit("</table>")).alias("raw"))


def two_block_tables(rows: DataFrame) -> DataFrame:
    """Two contrasts side by side; the second mirrors x."""
    row = F.concat(F.lit("<tr><td>Area</td><td>"), F.concat_ws("</td><td>", text("x"), text("y"), text("z"), statistic(), (-F.col("x")).cast("string"), text("y"), text("z"), statistic()), F.lit("</td></tr>"))
    return tabled(rows, row, "<table><tr><th>Region</th><th>x</th><th>y</th><th>z</th><th>t</th><th>x</th><th>y</th><th>z</th><th>t</th></tr>", "</table>")


def demographic_tables(rows: DataFrame) -> DataFrame:
    """Tables about something else, with values out of any head."""
    row = F.concat(F.lit("<tr><td>Group "), F.col("flag"), F.lit("</td><td>"), F.concat_ws("</td><td>", (F.col("extent") + 500).cast("string"), (F.col("line") + 200).cast("string")), F.lit("</td></tr>"))
    return tabled(rows, row, "<table><tr><th>Group</th><th>Score</th><th>Points</th></tr>", "</table>")
