"""Tables whose analyses or axes run across: axes along rows, centroids in the header, analyses in groups of columns; and all kinds mixed.

Regions and peaks of a seed are one array each; turning rows into columns is a projection over their positions, so a table
of these shapes needs no shuffle at all. A reader that looks for three columns finds no points in the first two shapes, and
in the third one block of columns for each analysis. Null seeds give none, equal ones one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpoint.operators.grid import CELL, cell, placed_from, render
from gridpoint.synth import words as W
from gridpoint.synth.coordinates import POINT, TARGET, Rates, build
from gridpoint.synth.draw import Draw, among, distinct_seeds
from gridpoint.synth.empty import build_empty

#: How often each shape is drawn among tables with coordinates. Fixed values.
ALONG_ROWS, CENTROIDS, COLUMN_GROUPS = 0.03, 0.03, 0.16
SHAPES = ("along rows", "centroids", "column groups")
#: How often a region has no peak in a group.
NO_PEAK = 0.15


def regions(d: Draw, n: Column) -> Column:
    """n regions with a side each, without replacement: name, side, and the box that its side gives it."""
    every = F.array(*(F.struct(F.lit(r[0]).alias("name"), *(F.lit(v).alias(f"{a}{i}") for a, box in (("x", r[1]), ("y", r[2]), ("z", r[3])) for i, v in enumerate(box)), F.lit(r[5]).alias("midline")) for r in W.REGIONS))
    order = F.array_sort(F.transform(every, lambda r: F.struct(d.u("shape-region", r["name"]).alias("u"), r.alias("r"))))

    def sided(s: Column) -> Column:
        r = s["r"]
        left = ~r["midline"] & d.happens(0.5, "shape-side", r["name"])
        low, high = F.greatest(F.lit(4), F.abs(r["x0"])), F.abs(r["x1"])
        name = F.when(r["midline"], r["name"]).otherwise(F.concat(F.when(left, "Left ").otherwise("Right "), r["name"]))
        return F.struct(name.alias("name"), F.when(left, -high).when(r["midline"], r["x0"]).otherwise(low).alias("x0"), F.when(left, -low).otherwise(r["x1"]).alias("x1"), *(r[f"{a}{i}"].alias(f"{a}{i}") for a in "yz" for i in (0, 1)))

    return F.transform(F.slice(order, 1, n), sided)


def peak(d: Draw, r: Column, group: Column, p: Column) -> Column:
    """An even coordinate in a region's box and the head."""
    at = {}
    for axis, limit in W.DRAWN.items():
        low, high = F.greatest(r[f"{axis}0"], F.lit(-limit)), F.least(r[f"{axis}1"], F.lit(limit))
        at[axis] = F.floor(F.floor(low + d.u(f"shape-{axis}", group, p) * (high - low)) / 2) * 2
    none = [F.lit(None).cast("string").alias("statistic_type"), F.lit(None).cast("double").alias("statistic_value"), F.lit(None).cast("double").alias("extent")]
    return F.struct(*(at[a].cast("double").alias(a) for a in "xyz"), *none)


def shaped(seeds: DataFrame, shape: str | None = None, seed: str = "seed") -> DataFrame:
    """seed, shape, n_groups, regions and, for each group and region, its peak or null."""
    d = Draw(F.col("seed"))
    out = distinct_seeds(seeds, seed)
    out = out.withColumn("shape", d.pick(SHAPES, "shape") if shape is None else F.lit(shape)).withColumn("n", d.whole(3, 8, "shape-regions"))
    out = out.withColumn("n_groups", F.when(F.col("shape") == "column groups", d.whole(2, 3, "shape-groups")).otherwise(1)).withColumn("regions", regions(d, F.col("n")))
    groups = F.sequence(F.lit(0), F.col("n_groups") - 1)
    may_miss = F.col("shape") == "column groups"
    of = lambda g: F.transform("regions", lambda r, p: F.when(~(may_miss & d.happens(NO_PEAK, "no-peak", g, p)), peak(d, r, g, p)))
    return out.withColumn("peaks", F.transform(groups, of))


def build_shapes(seeds: DataFrame, rates: Rates = Rates(), shape: str | None = None, seed: str = "seed") -> DataFrame:
    """seed, table_serialised, caption, footer, target, kind, reader_cannot of tables of these shapes."""
    d = Draw(F.col("seed"))
    tables = shaped(seeds, shape, seed)
    plain = lambda text, head=False, across=1, down=1: cell(text, F.lit(head), F.lit(across) if isinstance(across, int) else across, F.lit(down))
    number = lambda v: v.cast("long").cast("string")
    first = F.get("peaks", F.lit(0))
    label = lambda r: F.concat(F.upper(F.substring(r["name"], 1, 1)), F.substring(r["name"], 2, 100))
    heads = F.concat(F.array(plain(F.lit("Axis"), True)), F.transform("regions", lambda r: plain(label(r), True)))
    along = F.concat(F.array(heads), F.array(*(F.concat(F.array(plain(F.lit(f"{a} (mm)"))), F.transform(first, lambda p: plain(number(p[a])))) for a in "xyz")))
    at = lambda i: F.get(first, i)
    centred = F.transform("regions", lambda r, i: plain(F.concat(label(r), F.lit(" ("), F.concat_ws(", ", *(number(at(i)[a]) for a in "xyz")), F.lit(")")), True, 2))
    measures = F.array(*(F.concat(F.array(plain(F.lit(name))), F.flatten(F.transform("regions", lambda r, i: F.array(
        plain(F.format_string("%.2f", d.u("mean", F.lit(name), i) * 3)), plain(F.format_string("%.2f", d.u("spread", F.lit(name), i))))))) for name in ("Patients", "Controls")))
    under = F.concat(F.array(plain(F.lit(""), True)), F.flatten(F.transform("regions", lambda r: F.array(plain(F.lit("M"), True), plain(F.lit("SD"), True)))))
    centroids = F.concat(F.array(F.concat(F.array(plain(F.lit("Group"), True)), centred), under), measures)
    ones = F.transform("peaks", lambda g, i: F.concat(F.initcap(d.pick(W.CONDITIONS, "shape-one", i)), F.lit(" > "), d.pick(W.GROUPS, "shape-other", i)))
    top = F.concat(F.array(plain(F.lit("Region"), True, 1, 2)), F.transform(ones, lambda name: plain(name, True, 3)))
    axes = F.flatten(F.transform("peaks", lambda g: among(["x", "y", "z"])))
    cells = lambda p: F.when(p.isNull(), F.array(*[plain(F.lit("-"))] * 3)).otherwise(F.array(*(plain(number(p[a])) for a in "xyz")))
    body = F.transform("regions", lambda r, i: F.concat(F.array(plain(label(r))), F.flatten(F.transform("peaks", lambda g: cells(F.get(g, i))))))
    grouped = F.concat(F.array(top, F.transform(axes, lambda a: plain(a, True))), body)
    kind = f"array<array<{CELL}>>"
    grid = F.when(F.col("shape") == "along rows", along.cast(kind)).when(F.col("shape") == "centroids", centroids.cast(kind)).otherwise(grouped.cast(kind))
    name = d.pick(W.EFFECTS, "shape-name")
    named = F.when(F.col("shape") == "column groups", ones).otherwise(F.array(name))
    told = F.transform("peaks", lambda g, i: F.struct(F.get(named, i).alias("name"), F.lit(None).cast("string").alias("measure"), F.array_compact(g).cast(f"array<{POINT}>").alias("points")))
    space = F.when(d.happens(rates.space_in_table, "shape-space"), d.pick(("MNI", "TAL", "MNI"), "shape-which"))
    caption = F.concat(F.lit("Table "), d.whole(1, 6, "number").cast("string"), F.lit(". "), F.when(F.col("shape") == "column groups", "Peaks of each contrast").otherwise(F.concat(F.lit("Peaks for "), name)), F.lit("."))
    caption = F.concat(caption, F.when(space == "TAL", " Coordinates are in Talairach space.").when(space == "MNI", " Coordinates are in MNI space.").otherwise(""))
    footer = F.when(d.happens(rates.footer, "footer"), d.pick(W.FOOTER_PARTS, "footer-part")).otherwise("")
    out = tables.select("seed", grid.alias("grid"), caption.alias("caption"), footer.alias("footer"), F.struct(space.alias("space"), told.alias("analyses")).cast(TARGET).alias("target"), F.col("shape").alias("kind"), F.lit(True).alias("reader_cannot"))
    return out.withColumn("table_serialised", render(placed_from("grid"))).drop("grid")


def build_tables(seeds: DataFrame, rates: Rates = Rates(), seed: str = "seed") -> DataFrame:
    """Tables with coordinates of all shapes, each as often as it is found."""
    roll = Draw(F.col(seed)).u("which-shape")
    ends = (ALONG_ROWS, ALONG_ROWS + CENTROIDS, ALONG_ROWS + CENTROIDS + (1 - ALONG_ROWS - CENTROIDS) * COLUMN_GROUPS)
    out, low = build(seeds.where(roll >= ends[-1]), rates, seed), 0.0
    for shape, high in zip(SHAPES, ends):
        out = out.unionByName(build_shapes(seeds.where((roll >= low) & (roll < high)), rates, shape, seed))
        low = high
    return out


def build_mixed(seeds: DataFrame, rates: Rates = Rates(), seed: str = "seed") -> DataFrame:
    """Tables with and without coordinates, the latter at rates.empty_tables."""
    empty = Draw(F.col(seed)).happens(rates.empty_tables, "without")
    full = build_tables(seeds.where(~empty), rates, seed).drop("reader_cannot")
    return full.unionByName(build_empty(seeds.where(empty), rates, seed=seed).drop("flavour", "n_rows"))
