"""Column functions on cell text: cleaning, numbers, coordinate triples, and what headers and captions state.

All are expressions over built-in functions, so they run inside a projection: no shuffle, no Python on executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest distance from the origin in a head, by axis. Fixed values.
LIMITS = {"x": 90.0, "y": 126.0, "z": 108.0}
AXES = ("x", "y", "z")
# Texts as most cells are, of which one look tells what the whole rules would give. Fixed values.
CLEAN_TEXT = r"(?![+-] )(?:[!-%'-;=-~\x{a1}-\x{167f}]++(?: [!-%'-;=-~\x{a1}-\x{167f}]++)*+)?"
CLEAN_ALREADY = rf"^{CLEAN_TEXT}\z"
# A number without a triple in it, and a text with neither a number in it nor white space at its edges. Fixed values.
SHORT_NUMBER = r"^-?\d{1,6}(?:\.\d{1,15})?\z"
WORDS = r"^(?!.*(?:[iI][nN][fF]|[nN][aA][nN]))(?:[!-/:-~](?:[ -/:-~]*[!-/:-~])?)?\z"
PLAIN_NUMBER = r"^-?\d{1,15}(?:\.\d{1,15})?\z"
MAY_BE_NUMBER = r"(?i)\d|inf|nan"
# A comma or space between digits that separates no thousands: such a text is no number. Fixed value.
APART = r"(?s)[0-9].*?[, ](?![0-9]{3}(?![0-9])).*[0-9]"
FEW_DIGITS = r"^-?\d{1,6}(?:\.\d+)?\z"
TRIPLE = "struct<x:double,y:double,z:double>"

# Patterns and lists that define the formats read here. Fixed values.
HSP = r"<(?:ce:)?hsp\b[^>]*?(?:/>|>[^<]*</(?:ce:)?hsp\s*>)"
HSP_THOUSANDS = rf"(?i)(?<![\d.,\-−])(\d{{1,3}})(?:{HSP})+(?=\d{{3}}(?!\d|,\d))"
HSP_ONE_NUMBER = rf"(?i)^\s*([-−+]?(?:{HSP})*\d)(?:{HSP})+(\d)\s*\z"
HSP_BETWEEN_NUMBERS = rf"(?i)(?<=\d)(?:{HSP})+(?=[-−+]?(?:{HSP})*\d)"
BLOCK = r"(?i)</?(?:p|div|br|break|li|tr|h[1-6])\b[^>]*/?>"
TAG = r"<[^>]+>"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#x2212;": "-", "&minus;": "-", "&ndash;": "-", "&mdash;": "-", "&#8722;": "-"}
OTHER_ENTITY = "&[a-zA-Z#0-9]+;"
SPACES = r"(?U)[\s\x{1c}-\x{1f}​﻿]+"
SOME = r"(?U)[^\s\x{1c}-\x{1f}]"
LEADING_SIGN = r"(?U)^([+-])\s+(?=[.\d])"
EDGE = r"(?U)^[\s\x{1c}-\x{1f}]|[\s\x{1c}-\x{1f}]\z"
EDGES = r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+\z"
FOOTNOTES = r"[*†‡§¶°abcde]+\z"
INEQUALITY = r"(?U)^[<>~≤≥=¡]\s*"
THOUSANDS = r"(?U)(?<=\d)[,  ](?=\d{3}(?!\d))"
NUMBER = r"^[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?\z"
NOT_FINITE = r"(?i)^[+-]?(?:inf|infinity|nan)\z"
NUMBERS = r"(?U)-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
SIGNED = r"[-+−–]?\s*\d{1,3}(?:\.\d+)?"
WRAPPED = r"(?sU)^\s*[\(\[\{]\s*(.*?)\s*[\)\]\}]\s*\z"
BRACKETED = r"[\(\[\{]([^\)\]\}]*)[\)\]\}]"
PEAK_SPLIT = r"(?iU)[;/]|\band\b"
MARKER = r"(?U)(?:(?<=[)\]\d\s])[a-h]|[*†‡¶§]{1,3})\s*\z"
AXIS = r"(?iU)^\(?\s*{}\s*\)?\s*(?:\(?\s*(?:mm|cm|coord(?:inate)?s?|coor|mni|tal(?:airach)?|voxels?)\s*\)?\s*)*\z"
AXIS_SUFFIX = r"(?iU)[.\s\-]{}\z"
EXTENT = r"(?iU)cluster\s*(?:size|extent)|extent|\bsize\b|\bvoxels?\b|\bn\s*vox|\bk\b|\bke\b|mm\s*\^?3"
SPANS_COORDINATES = r"(?iU)coord|\bMNI\b|talairach|\bTAL\b|stereotax|\bpeak\b|\bloc(?:ation|us)\b|\bvoxel\b|\bsite\b|x\s*[,/ ]\s*y\s*[,/ ]\s*z"
COORDINATE_WORDS = r"(?iU)coord|\bMNI\b|talairach|\bTAL\b|stereotax|\bpeak\b|\bloc(?:ation|us)\b|\bvoxel\b|\bsite\b"
VALUES_ARE = r"(?iU)values?\s+(?:shown\s+)?(?:are|is|represent\w*)\s+(?:the\s+)?([A-Za-z]{1,6})\b|\b([A-Za-z]{1,6})\s+values?\s+(?:are\s+)?(?:given|shown|reported|listed)"
MNI = r"(?i)(?<![A-Za-z])(?:MNI|ICBM)(?![A-Za-z])|MNI-?152|montreal neuro"
TALAIRACH = r"(?i)talairach|tournoux|(?<![A-Za-z])(?:Tal|TT)(?![A-Za-z])"
VOXELS = r"(?iU)voxel|\bvox\b|\bk\b|\bke\b|n\s*vox"
CUBIC = r"(?iU)mm\s*(?:\^?3|³)|cubic\s*mm|\bcm\s*(?:\^?3|³)"
BOTH_SIDES = r"(?iU)\bL\s*/\s*R\b|\bR\s*/\s*L\b|bilat|\bboth\b|\bmidline\b"
LEFT = r"(?<![A-Za-z])left(?![A-Za-z])|(?<![A-Za-z/])L(?![A-Za-z/])"
RIGHT = r"(?i)(?<![A-Za-z])right(?![A-Za-z])|(?<![A-Za-z/])R(?![A-Za-z/])"
SIDE_ONLY = r"(?iU)^\s*(?:L\s*/\s*R|R\s*/\s*L|side|hemisphere|hemi\.?|lat\.?|H)\s*\z"
LEGEND = r"(?iU)(?<![A-Za-z])[LRBlrb]\s*[:=]\s*(?:left|right|bilateral|both)\b"
THREE_AXES = r"(?isU)(?<![A-Za-z])x(?![A-Za-z]).{0,30}?(?<![A-Za-z])y(?![A-Za-z]).{0,30}?(?<![A-Za-z])z(?![A-Za-z])"
#: Statistics in the order in which one is preferred where a text names several. Fixed values.
STATISTICS = {
    "T": r"(?iU)(?<![A-Za-z])t(?:[-\s]?(?:value|score|stat\w*))?(?![A-Za-z])|t\s*\(\s*\d+\s*\)",
    "Z": r"(?iU)(?<![A-Za-z])z(?:[-\s]?(?:value|score|stat\w*))?(?![A-Za-z])",
    "D": r"(?iU)cohen'?s?\s*d\b|effect size\s*\(\s*d\s*\)|(?<![A-Za-z])d(?![A-Za-z])",
    "G": r"(?iU)hedge'?s?'?\s*g\b",
    "F": r"(?iU)(?<![A-Za-z])F(?:[-\s]?(?:value|score|stat\w*))?(?![A-Za-z])|F\s*\(\s*\d+",
    "R": r"(?iU)(?<![A-Za-z])r(?:[-\s]?(?:value|score))?(?![A-Za-z])|correlation",
    "B": r"(?iU)(?<![A-Za-z])(?:beta|b)(?:[-\s]?(?:value|weight|coef\w*))?(?![A-Za-z])|coefficient|\bestimate\b",
    "P": r"(?iU)(?<![A-Za-z])p(?:[-\s]?(?:value|val|corr\w*|unc\w*|FWE|FDR))?(?![A-Za-z])",
}

#: Whether any of them is named, by one look.
ANY_STATISTIC = "(?iU)" + "|".join(p.removeprefix("(?iU)") for p in STATISTICS.values())

#: Axis columns side by side in a rendered header, as x y z and as R A S, and what marks a header cell. Fixed values.
AXIS_CELL = r"#?\s*{}\s*(?:\([^)]*\)|\[[^\]]*\]|coord\w*|axis|mm|cm|position)?\s*"
XYZ_RUN = "(?iU)" + r"\s*\|\s*".join(AXIS_CELL.format(a) for a in "xyz") + r"(?!\w)"
RAS_RUN = r"(?iU)#?\s*R\s*\|\s*#?\s*A\s*\|\s*#?\s*S(?!\w)|#?\s*Right\s*\|\s*#?\s*Anterior\s*\|\s*#?\s*Superior(?!\w)"
HEADER_CELL = r"(?U)^\s*#\s*(?:[<^]\d+:)?\s*"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: the end of a fold over nothing, as a fold hands values on as they are, where a
    transformed array copies them."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


def bind(*values: Column, body: Callable[..., Column]) -> Column:
    """body of several values, each computed once, all held as one: the analyzer settles a lambda a pass, and stops after 100.

    Inside a lambda only such values may be used, never columns of the table: the optimizer puts the expression behind a
    column in the place where it is used once, and inside a lambda that place runs for every element.
    """
    if len(values) == 1:
        return let(values[0], body)
    return let(F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values))), lambda held: body(*(held[f"v{i}"] for i in range(len(values)))))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def said(text: Column) -> Column:
    """Whether strip() would leave something."""
    return text.rlike(SOME)


def clean(raw: Column) -> Column:
    """Markup of one cell as text: gaps between numbers, tags, entities, minus signs and white space settled."""
    return let(F.coalesce(raw, F.lit("")), lambda s: F.when(s.rlike(CLEAN_ALREADY), s).otherwise(_settled(s)))


def _settled(raw: Column) -> Column:

    def gaps(s: Column) -> Column:
        one = F.concat(F.regexp_extract(s, HSP_ONE_NUMBER, 1), F.regexp_extract(s, HSP_ONE_NUMBER, 2))
        many = F.regexp_replace(F.regexp_replace(s, HSP_THOUSANDS, "$1"), HSP_BETWEEN_NUMBERS, " ")
        return F.when(F.contains(s, F.lit("hsp")), F.when(s.rlike(HSP_ONE_NUMBER), one).otherwise(many)).otherwise(s)

    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(gaps(raw), BLOCK, " "), TAG, ""), CONTROL, "")

    def settled(text: Column) -> Column:
        named = text
        for entity, plain in ENTITIES.items():
            named = F.replace(named, F.lit(entity), F.lit(plain))
        return F.when(F.contains(text, F.lit("&")), F.regexp_replace(named, OTHER_ENTITY, " ")).otherwise(text)

    text = F.translate(let(text, settled), "−–�", "---")
    return F.regexp_replace(strip(F.regexp_replace(text, SPACES, " ")), LEADING_SIGN, "$1")


def escape(text: Column) -> Column:
    """Text whose pipes, and a leading hash, don't read as syntax."""
    piped = F.replace(text, F.lit("|"), F.lit("\\|"))
    return F.when(F.startswith(text, F.lit("#")), F.concat(F.lit("\\"), piped)).when(F.contains(text, F.lit("|")), piped).otherwise(text)


def unescape(text: Column) -> Column:
    bare = F.when(F.startswith(text, F.lit("\\#")), F.substring(text, 2, 1 << 30)).otherwise(text)
    return F.replace(bare, F.lit("\\|"), F.lit("|"))


def float_of(text: Column) -> Column:
    """What a float literal denotes, else null."""
    return F.when(text.rlike(NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double")).when(text.rlike(NOT_FINITE), text.try_cast("double"))


def as_number(text: Column) -> Column:
    """The number a cell denotes under marks, inequality signs, thousands separators and other minus signs, or null."""
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double")).when(text.rlike(MAY_BE_NUMBER) & ~text.rlike(APART), _marked_number(text))


def _marked_number(text: Column) -> Column:
    bare = strip(F.regexp_replace(strip(unescape(text)), "^#+", ""))
    bare = strip(F.regexp_replace(strip(F.regexp_replace(bare, FOOTNOTES, "")), INEQUALITY, ""))
    bare = F.regexp_replace(F.translate(bare, "−–", "--"), r"(?U)^([-+])\s+(?=[\d.])", "$1")
    return let(F.regexp_replace(bare, THOUSANDS, ""), float_of)


def numbers_in(text: Column) -> Column:
    """Every number in a composite cell, as an array."""
    plain = F.regexp_replace(F.translate(text, "−–", "--"), THOUSANDS, "")
    return F.transform(F.regexp_extract_all(plain, F.lit(NUMBERS), F.lit(0)), lambda n: n.try_cast("double"))


def in_head(x: Column, y: Column, z: Column) -> Column:
    return (F.abs(x) <= LIMITS["x"]) & (F.abs(y) <= LIMITS["y"]) & (F.abs(z) <= LIMITS["z"])


def millimetres(v: Column) -> Column:
    """Whole or nearly whole: at most two decimals."""
    return v.isNotNull() & (F.abs(F.bround(v, 2) - v) < 1e-9)


def one_triple(part: Column) -> Column:
    """The triple that a text states as a whole, or null."""
    inner = F.when(part.rlike(WRAPPED), F.regexp_extract(part, WRAPPED, 1)).otherwise(part)
    found = F.transform(F.regexp_extract_all(inner, F.lit("(?U)" + SIGNED), F.lit(0)), lambda n: F.translate(F.regexp_replace(n, r"(?U)\s+", ""), "−–", "--").try_cast("double"))

    def made(v: Column) -> Column:
        x, y, z = (F.get(v, F.lit(i)) for i in range(3))
        fits = (F.size(v) == 3) & F.forall(v, millimetres) & in_head(x, y, z)
        return F.when(fits, F.struct(x.alias("x"), y.alias("y"), z.alias("z")))

    return let(found, made)


def triples_in(text: Column) -> Column:
    """Every triple a cell states: the whole cell, else its first bracket that is one, else what is outside brackets, else its parts."""
    none = F.array().cast(f"array<{TRIPLE}>")

    def found(s: Column) -> Column:
        groups = F.filter(F.transform(F.regexp_extract_all(s, F.lit(BRACKETED), F.lit(1)), one_triple), lambda t: t.isNotNull())
        outside = F.regexp_replace(s, BRACKETED, " ")
        parts = F.filter(F.transform(F.split(s, PEAK_SPLIT, -1), one_triple), lambda t: t.isNotNull())
        alone = F.when(strip(outside) != strip(s), one_triple(outside))
        return let(one_triple(s), lambda t: F.when(t.isNotNull(), F.array(t)).otherwise(
            let(groups, lambda g: F.when(F.size(g) > 0, F.slice(g, 1, 1)).otherwise(
                let(alone, lambda o: F.when(o.isNotNull(), F.array(o)).otherwise(parts))))))

    some = F.coalesce(text, F.lit(""))
    # What a triple is looked for in ends where no number goes on, so a text of fewer than three numbers has none.
    three = F.size(F.regexp_extract_all(some, F.lit("(?U)" + SIGNED), F.lit(0))) >= 3
    return F.when(some.rlike(r"(?sU)\d.*?\d.*?\d") & ~some.rlike(FEW_DIGITS) & three, found(some)).otherwise(none)


def unmarked(header: Column) -> Column:
    """A header without its trailing footnote mark."""
    return strip(F.regexp_replace(F.coalesce(header, F.lit("")), MARKER, ""))


def names_axis(header: Column, axis: str) -> Column:
    named = let(unmarked(header), lambda bare: bare.rlike(AXIS.format(axis)) | bare.rlike(AXIS_SUFFIX.format(axis)))
    return F.when(F.contains(header, F.lit(axis)) | F.contains(header, F.lit(axis.upper())), named).otherwise(False)


def visible_space(*texts: Column) -> Column:
    """MNI or TAL where the texts state exactly one of them."""
    joined = F.concat_ws(" ", *(F.coalesce(t, F.lit("")) for t in texts))
    mni, tal = joined.rlike(MNI), joined.rlike(TALAIRACH)
    return F.when(mni & ~tal, "MNI").when(tal & ~mni, "TAL")


def statistic_type(header: Column) -> Column:
    """The statistic a header names, the preferred one of several; null for sides, axes and legends."""
    refused = header.rlike(SIDE_ONLY) | header.rlike(THREE_AXES) | header.rlike(LEGEND)
    return F.when(header.rlike(ANY_STATISTIC) & ~refused, F.coalesce(*(F.when(header.rlike(p), k) for k, p in STATISTICS.items())))


def best_of(kinds: Column) -> Column:
    """The preferred one of an array of statistics."""
    return F.coalesce(*(F.when(F.array_contains(kinds, k), k) for k in STATISTICS))


def claimed_statistic(context: Column) -> Column:
    """The statistic that a sentence says the values are."""

    def named(text: Column) -> Column:
        group = lambda i: F.nullif(F.regexp_extract(text, VALUES_ARE, i), F.lit(""))
        return F.when(F.contains(F.lower(text), F.lit("value")), let(F.coalesce(group(1), group(2)), statistic_type))

    return let(F.coalesce(context, F.lit("")), named)


def statistic_named_by(table: Column, caption: Column, footer: Column) -> Column:
    """The preferred one of the statistics that a rendered table's header names and its caption or footer claims; where
    neither says one, of those that single sentences of caption and footer name."""
    kinds = lambda texts: F.filter(F.transform(texts, statistic_type), lambda k: k.isNotNull())
    context = F.concat(F.coalesce(caption, F.lit("")), F.lit(" "), F.coalesce(footer, F.lit("")))
    top = F.array_join(F.slice(F.split(F.coalesce(table, F.lit("")), "\n", -1), 1, 3), "\n")
    masked = F.regexp_replace(F.regexp_replace(top, XYZ_RUN, " coord "), RAS_RUN, " coord ")

    def of_header(head: Column) -> Column:
        marked = F.filter(F.split(head, "[|\n]", -1), lambda c: c.rlike(HEADER_CELL))
        plain = F.split(F.get(F.split(head, "\n", -1), F.lit(0)), "[|]", -1)
        return let(marked, lambda m: kinds(F.when(F.size(m) > 0, F.transform(m, lambda c: F.regexp_replace(c, HEADER_CELL, ""))).otherwise(plain)))

    def with_context(hits: Column, claimed: Column, context: Column) -> Column:
        return F.when(claimed.isNotNull(), F.concat(hits, F.array(claimed))).when(F.size(hits) == 0, kinds(F.split(context, "[.]", -1))).otherwise(hits)

    return let(bind(let(masked, of_header), claimed_statistic(context), context, body=with_context), best_of)


def cluster_measure(header: Column) -> Column:
    cubic, voxels = header.rlike(CUBIC), header.rlike(VOXELS)
    return F.when(cubic & ~voxels, "mm^3").when(voxels & ~cubic, "voxels")


def laterality(text: Column) -> Column:
    """L, R or B."""
    one = lambda left, right: F.when(left & ~right, "L").when(right & ~left, "R")
    return F.when(text.rlike(BOTH_SIDES), "B").otherwise(bind(text.rlike(LEFT), text.rlike(RIGHT), body=one))


def sign_agrees(x: Column, text: Column) -> Column:
    """Whether the sign of x agrees with the side a text names; null without either."""
    agrees = lambda side: F.when(side == "L", x < 0).when(side == "R", x > 0)
    return F.when(x != 0, let(laterality(text), agrees))
