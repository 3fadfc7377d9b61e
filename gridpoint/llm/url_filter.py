"""URL filters: prefix rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from labelled urls, here those that a rule judges, on a sample of at most SAMPLE distinct urls, half of each
label as far as there are so many (a documented bound; the lowest hashes, so that it is the same in each run and copies
crowd out no other url). Their features: lengths, depth, digit ratio, entropy, parameter counts, and statistics of host
suffixes and of suffix with first path segment: how many sample urls have them and what share is blocked. A sample url's
own statistics come from the other FOLDS of hosts only, and every sample url is learned from twice, the second time as if
its suffix had never been seen: so the trees also learn what lexical features say alone, for suffixes without a label.
Every url is then judged: by the longest rule that fits, else by the trees. Without labels of both kinds the only kind
seen, or else "allow", is given.

Null urls and urls without "://" have an empty host and path and are judged like others. Very long urls are read whole.
Repeated rows are judged one by one. An empty table gives no row. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpoint.llm.common import table, written

SAMPLE = 20_000
#: Verdict, host, path. Fixed values.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
FEATURES = ["url_length", "host_length", "path_length", "labels", "depth", "digit_ratio", "hyphens", "entropy", "parameters", "fragment", "secure", "suffix_seen", "suffix_rate", "lead_seen", "lead_rate"]
#: Weight of the overall rate in the rates of suffixes.
PRIOR = 5.0
#: Hosts are dealt to so many folds by their hash.
FOLDS = 5
STATISTICS = ("suffix", "lead")


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits best, as a string, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text).cast("double")
    total = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda s, c: s + F.transform(F.array((n - F.length(F.replace(text, c, F.lit("")))).cast("double")), lambda k: F.when(k > 0, k * F.log2(k)).otherwise(0.0))[0])
    return F.when(n > 0, F.log2(n) - total / n).otherwise(0.0)


def with_features(df: DataFrame, key: str, url: str, rules) -> DataFrame:
    text = df.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"))
    host, path = parts(F.col("url"))
    text = text.select("*", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    count = lambda chars: F.length("url") - F.length(F.translate("url", chars, ""))
    suffix = F.substring_index("host", ".", -1)
    return text.select(
        "key", "url", "host", "path", rule.alias("rule"), verdict.alias("ruled"),
        suffix.alias("suffix"), F.concat_ws("/", F.substring_index("host", ".", -2), F.get(F.split("path", "/"), F.lit(1))).alias("lead"),
        F.length("url").cast("double").alias("url_length"), F.length("host").cast("double").alias("host_length"), F.length("path").cast("double").alias("path_length"),
        F.size(F.split("host", r"\.")).cast("double").alias("labels"), (F.length("path") - F.length(F.translate("path", "/", ""))).cast("double").alias("depth"),
        (count("0123456789") / F.greatest(F.length("url"), F.lit(1))).alias("digit_ratio"), count("-_").cast("double").alias("hyphens"),
        entropy(F.col("url")).alias("entropy"), count("&=?").cast("double").alias("parameters"), F.col("url").contains("#").cast("double").alias("fragment"), F.col("url").startswith("https").cast("double").alias("secure"),
    )


def statistics(sample: DataFrame, name: str, *by: str) -> DataFrame:
    """How many urls of the sample have a suffix, and how many of them are blocked; at most SAMPLE rows."""
    return sample.groupBy(name, *by).agg(F.sum("label").alias("blocked"), F.count(F.lit(1)).alias("n"))


def rated(found: DataFrame, name: str, n: Column, blocked: Column) -> DataFrame:
    """found with the two features of a statistic; one never seen has rate 1/2."""
    n, blocked = F.coalesce(n.cast("double"), F.lit(0.0)), F.coalesce(blocked.cast("double"), F.lit(0.0))
    return found.withColumns({f"{name}_seen": F.log1p(n), f"{name}_rate": (blocked + PRIOR * 0.5) / (n + PRIOR)})


def out_of_fold(sample: DataFrame) -> DataFrame:
    """The sample twice: with statistics from the hosts of other folds, and as if none were known."""
    found = sample
    for name in STATISTICS:
        every, own = (statistics(sample, name, *by).withColumnsRenamed({"n": f"n{k}", "blocked": f"b{k}"}) for k, by in enumerate(((), ("fold",))))
        both = found.join(F.broadcast(every), name).join(F.broadcast(own), [name, "fold"])  # bounded by the sample
        found = rated(both, name, F.col("n0") - F.col("n1"), F.col("b0") - F.col("b1")).drop("n0", "n1", "b0", "b1")
    unseen = sample
    for name in STATISTICS:
        unseen = rated(unseen, name, F.lit(0), F.lit(0))
    return found.unionByName(unseen)


def labelled_sample(rows: DataFrame, sample: int) -> DataFrame:
    """Distinct labelled urls with label and fold, half of each label: those with the lowest hashes."""
    labelled = rows.where(F.col("ruled").isNotNull()).withColumn("label", (F.col("ruled") == "block").cast("double"))
    place = (F.xxhash64("url").cast("double") / float(1 << 63) + 1) / 2
    there = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.approx_count_distinct("url").alias("n")).collect()}  # two labels
    parts = []
    for label in (0.0, 1.0):
        near = min(1.0, 3 * sample / max(1, there.get(label, 0)))  # three times as many as are wanted, or all
        own = labelled.where((F.col("label") == label) & (place <= near)).dropDuplicates(["url"])
        parts.append(own.orderBy(F.xxhash64("url"), "url").limit(sample // 2))
    return parts[0].unionByName(parts[1]).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)))


class UrlModel:
    """Trees and the statistics that go with them."""

    def __init__(self, sample: DataFrame, trees: int = 20, depth: int = 4, seed: int = 7):
        """sample: of both labels, from labelled_sample()."""
        self.tables = {name: written(statistics(sample, name), f"url-{name}") for name in STATISTICS}
        train = written(self.assembled(out_of_fold(sample)).select("features", "label"), "url-train")
        self.model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.2).fit(train)

    @staticmethod
    def assembled(found: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)

    def scored(self, found: DataFrame, known: bool = True) -> DataFrame:
        """found with score, the probability of block. known: with the statistics of its suffixes."""
        for name, own in self.tables.items():  # bounded by the sample, so they can be broadcast
            if known:
                found = rated(found.join(F.broadcast(own), name, "left"), name, F.col("n"), F.col("blocked")).drop("n", "blocked")
            else:
                found = rated(found, name, F.lit(0), F.lit(0))
        return self.model.transform(self.assembled(found)).withColumn("score", vector_to_array("probability")[1])


def filter_urls(df: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, sample: int = SAMPLE, trees: int = 20, depth: int = 4, seed: int = 7) -> DataFrame:
    """key, host, path, rule, verdict and the trees' score (probability of block) of every url."""
    rows = with_features(df, key, url, rules)
    chosen = written(labelled_sample(rows, sample), "url-sample")
    kinds = [r["label"] for r in chosen.select("label").distinct().collect()]  # at most two
    if len(kinds) < 2:
        judged = rows.withColumn("score", F.lit(kinds[0] if kinds else 0.0))
    else:
        judged = UrlModel(chosen, trees, depth, seed).scored(rows)
    verdict = F.coalesce("ruled", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return judged.select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "score")


def held_out_accuracy(df: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, sample: int = SAMPLE, **options) -> dict[str, float]:
    """Share of labelled sample urls judged right by trees that saw no url of their hosts, with and without suffix statistics, and of the commoner label."""
    chosen = written(labelled_sample(with_features(df, key, url, rules), sample), "url-sample")
    rest, held = chosen.where("fold <> 0"), chosen.where("fold = 0")
    model = UrlModel(rest, **options)
    right = lambda known: model.scored(held, known).agg(F.avg(((F.col("score") > 0.5) == (F.col("label") == 1)).cast("double"))).first()[0]
    share = held.agg(F.avg("label")).first()[0]
    return {"with_statistics": right(True), "lexical_only": right(False), "commoner_label": max(share, 1 - share)}


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


QUERIES = {"op2_url_filter": op2_url_filter}
ORACLES: dict[str, str] = {}
