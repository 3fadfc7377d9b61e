"""Spelling variants of the words of a corpus: words that differ by one code point, grouped under the commonest form.

1. Words are counted in Spark: the maximal runs of letters of every whole text, at least SHORTEST code points, at least
   OFTEN occurrences. The vocabulary is a table; nothing of it is collected.
2. Two words that differ by one code point share their first half or what follows the other's first half. So each word goes
   to shards by base length, side and half, as asker and target of its own length and as a target that is one longer.
   Shards are dealt to tasks of about SHARD_WORDS; askers and targets of a larger shard are split, and parts meet parts.
3. In a task the targets of one length stand in forward order and, by their ranks, in reverse order: points of a wavelet
   tree. For each edit position of an asker the targets with its prefix are an interval of the one order, those with its
   suffix one of the other; two-dimensional range reporting gives just the words that differ there. Words of the same
   length are replacements; longer ones insertions, counted for both words, at the leftmost of equal places.
4. A task tells for each word how many near words it found and the best of them; Spark adds these up. Forms are followed to
   their end by doubling.

Letters are A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased. Null texts have no words. Texts and words of any
length are taken whole. Rows that repeat count. Ties of a form go to the smallest word in code-point order. An empty table
gives no row. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpoint.llm import sql
from gridpoint.llm.common import MOST_FREQUENT, table, written
from gridpoint.llm.wavelet import WaveletTree

SHORTEST = 5
OFTEN = 3
#: A form occurs at least so many times as often as its variant.
RATIO = 2
SHARD_WORDS = 50_000
ASKS, TARGET = 1, 2
LETTERS = r"[A-Za-zÀ-ÿ]+"


def counted_words(words: DataFrame, word: str = "word", shortest: int = SHORTEST, often: int = OFTEN) -> DataFrame:
    """word, n of those long and frequent enough."""
    own = words.select(F.col(word).alias("word")).where(F.length("word") >= shortest)
    return own.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= often)


def runs(df: DataFrame, *others: str, text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """run (A-Z lower-cased) for each run of at least shortest letters, and the other columns."""
    pattern = LETTERS[:-1] + f"{{{shortest},}}"
    found = df.select(*others, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("run"))
    return found.withColumn("run", F.translate("run", ascii_uppercase, ascii_lowercase))


def shards(words: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """side, base, half, word, n, roles: each word as asker and target of its own length, and as a target for the length below."""
    w = F.col("word")

    def row(side: int, base: Column, start: Column, length: Column, roles: int) -> Column:
        return F.struct(F.lit(side).alias("side"), base.alias("base"), F.substring(w, start, length).alias("half"), F.lit(roles).alias("roles"))

    long, below = F.length(w), F.length(w) - 1
    half, half_below = F.floor(long / 2).cast("int"), F.floor(below / 2).cast("int")
    one, both = F.lit(1), ASKS | TARGET
    own = F.array(row(0, long, one, half, both), row(1, long, half + 1, long, both))
    longer = F.array(row(0, below, one, half_below, TARGET), row(1, below, half_below + 2, long, TARGET))
    every = F.when(below >= shortest, F.concat(own, longer)).otherwise(own)
    return words.select("word", "n", F.explode(every).alias("s")).select("s.*", "word", "n")


def letters_of(words: list[str], width: int) -> np.ndarray:
    """Words of one length as rows of bytes (their letters are of one byte in Latin-1)."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), width)


def intervals(asks: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of targets, and for each asker and length of prefix (0 up to its own) the interval of targets that begin with it."""
    width, long = targets.shape[1], asks.shape[1]
    both = np.zeros((len(asks) + len(targets), width), np.uint8)
    both[: len(asks), :long], both[len(asks) :] = asks, targets
    order = np.argsort(both.view(f"S{width}").ravel(), kind="stable")
    both = both[order]
    same = np.zeros(len(both), np.int64)  # letters in common with the row before
    differ = both[1:] != both[:-1]
    same[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    target = order >= len(asks)
    before = np.concatenate([[0], np.cumsum(target)])
    at = np.arange(len(both))
    place = np.empty(len(both), np.int64)
    place[order] = at
    place = place[: len(asks)]
    low, high = np.empty((len(asks), long + 1), np.int64), np.empty((len(asks), long + 1), np.int64)
    for n in range(long + 1):
        fresh = same < n
        fresh[0] = True
        starts = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        low[:, n] = before[starts][group[place]]
        high[:, n] = before[np.append(starts[1:], len(both))][group[place]]
    return order[target] - len(asks), low, high


def near(asks: np.ndarray, targets: np.ndarray, positions: range) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(asker, target, position): targets that differ at one of the positions, by a replacement or, if one longer, an insertion."""
    more = targets.shape[1] - asks.shape[1]
    forward, low, high = intervals(asks, targets)
    backward, back_low, back_high = intervals(np.ascontiguousarray(asks[:, ::-1]), np.ascontiguousarray(targets[:, ::-1]))
    rank = np.empty(len(targets), np.int64)
    rank[backward] = np.arange(len(targets))
    tree = WaveletTree(rank[forward])
    which = np.array(positions, np.int64)
    rest = asks.shape[1] - which - (0 if more else 1)
    rectangle = [x.ravel() for x in (low[:, which], high[:, which], back_low[:, rest], back_high[:, rest])]
    some = np.flatnonzero((rectangle[0] < rectangle[1]) & (rectangle[2] < rectangle[3]))
    for query, value in tree.report(*(x[some] for x in rectangle)):
        query = some[query]
        yield query // len(which), backward[value], which[query % len(which)]


def near_of_shards(rows: pa.Table) -> pa.Table:
    """word, found, less (how often the best near word occurs, negative), best of the words of a task's shards."""
    words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
    side, base, roles = (rows.column(c).to_numpy() for c in ("side", "base", "roles"))
    length = np.array([len(w) for w in words])
    word, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in np.unique(base):
        for s in (0, 1):
            own = (base == k) & (side == s)
            ask = np.flatnonzero(own & (roles & ASKS > 0))
            for more in (0, 1):
                goal = np.flatnonzero(own & (roles & TARGET > 0) & (length == k + more))
                if not len(ask) or not len(goal):
                    continue
                x, y = letters_of([words[i] for i in ask], k), letters_of([words[i] for i in goal], k + more)
                half = int(k) // 2
                for a, b, at in near(x, y, range(half, k + more) if s == 0 else range(half)):
                    if more:  # of several places that give the same word, the leftmost
                        first = (at == 0) | (x[a, np.maximum(at - 1, 0)] != y[b, at])
                        a, b = a[first], b[first]
                        word.append(goal[b]), other.append(ask[a])
                    else:
                        others = (x[a, at] != y[b, at])
                        a, b = a[others], b[others]
                    word.append(ask[a]), other.append(goal[b])
    word, other = np.concatenate(word), np.concatenate(other)
    order = sorted(range(len(words)), key=words.__getitem__)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    number = np.zeros(len(words), np.int64)  # a word may stand in a task more than once
    if len(words):
        fresh = [True] + [words[a] != words[b] for a, b in zip(order[1:], order)]
        number[order] = np.cumsum(fresh) - 1
    word = number[word]
    by = np.lexsort((rank[other], -n[other], word))
    word, other = word[by], other[by]
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    names = [words[i] for i, f in zip(order, fresh) if f] if len(words) else []
    found = np.diff(np.append(first, len(word)))
    columns = [pa.array([names[i] for i in word[first]], pa.string()), pa.array(found, pa.int64()), pa.array(-n[other[first]], pa.int64()), pa.array([words[i] for i in other[first]], pa.string())]
    return pa.Table.from_arrays(columns, ["word", "found", "less", "best"])


def near_words(words: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """word, n_near, best, best_n of the words (a written table: word, n) that have near ones."""
    rows = written(shards(words, shortest), "shards")
    total = rows.count()
    tasks, most = max(1, total // SHARD_WORDS), max(SHARD_WORDS, total // MOST_FREQUENT)
    on = ["side", "base", "half"]
    counts = rows.groupBy(on).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > most)
    parts = written(counts.select(*on, F.ceil(F.col("k") / most).cast("int").alias("parts")), "large-shards")  # MOST_FREQUENT at most
    dealt = rows.withColumn("task", F.pmod(F.xxhash64(*on), F.lit(tasks)))
    if parts.isEmpty():
        dealt = dealt.withColumn("a", F.lit(0)).withColumn("b", F.lit(0))
    else:
        dealt = dealt.join(F.broadcast(parts), on, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        mine, every = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)
        as_asker = F.transform(every, lambda k: F.struct(mine.alias("a"), k.alias("b"), F.lit(ASKS).alias("as")))
        as_target = F.transform(every, lambda k: F.struct(k.alias("a"), mine.alias("b"), F.lit(TARGET).alias("as")))
        dealt = dealt.withColumn("to", F.explode(F.concat(as_asker, as_target))).select("*", "to.a", "to.b", F.col("roles").bitwiseAND(F.col("to.as")).alias("role"))
        dealt = dealt.where("role > 0").groupBy("task", "a", "b", *on, "word", "n").agg(F.sum("role").cast("int").alias("roles"))
    columns = ["task", "a", "b", "side", "base", "word", "n", "roles"]
    found = dealt.select(columns).groupBy("task", "a", "b").applyInArrow(near_of_shards, "word string, found long, less long, best string")
    best = found.groupBy("word").agg(F.sum("found").alias("n_near"), F.min(F.struct("less", "best")).alias("b"))
    return best.select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def grouped(words: DataFrame, ratio: float = RATIO, shortest: int = SHORTEST) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n)."""
    words = written(words, "words")
    found = words.join(near_words(words, shortest), "word", "left")
    leads = F.col("best_n") >= ratio * F.col("n")
    formed = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(leads, F.col("best")).alias("form"), F.when(leads, F.col("best_n")).alias("form_n")), "forms")
    chain = written(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:  # forms grow by the ratio, so chains are short
        ahead = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = written(chain.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved, chain = not longer.where("moved").isEmpty(), longer.drop("moved")
        if not moved:
            break
    out = formed.join(chain, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def with_losses(df: DataFrame) -> DataFrame:
    """word of every run of documents; of one in 97, by its document, one code point is lost."""
    found = runs(df, "doc_id")
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return found.select(F.when(h % 97 == 0, lost).otherwise(F.col("run")).alias("word"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(counted_words(with_losses(table(spark, sf_dir, "documents"))))


#: The same by patterns with one letter left open, and by the words that are left without one letter.
OP12_SQL = f"""WITH RECURSIVE {sql.CRC_TABLE},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{5,}}')), '{ascii_uppercase}', '{ascii_lowercase}') AS run FROM documents),
hashed AS (SELECT run, {sql.crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc_table),
lost AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, count(*) AS n FROM lost WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words),
open_ AS MATERIALIZED (SELECT word, n, p, substr(word, 1, p - 1) || '*' || substr(word, p + 1) AS pattern FROM places),
without AS MATERIALIZED (SELECT DISTINCT word, n, substr(word, 1, p - 1) || substr(word, p + 1) AS less FROM places),
near AS (SELECT a.word, b.word AS other, b.n FROM open_ a JOIN open_ b ON a.pattern = b.pattern AND a.word <> b.word
         UNION ALL SELECT w.word, v.word, v.n FROM without v JOIN words w ON w.word = v.less
         UNION ALL SELECT v.word, w.word, w.n FROM without v JOIN words w ON w.word = v.less),
best AS (SELECT word, count(*) AS n_near, min({{'less': -n, 'other': other}}) AS b FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 2 * w.n THEN b.other END AS form, CASE WHEN -b.less >= 2 * w.n THEN -b.less END AS form_n
          FROM words w LEFT JOIN best USING (word)),
follow(word, root) AS (SELECT word, word FROM forms UNION ALL SELECT f.word, g.form FROM follow f JOIN forms g ON g.word = f.root WHERE g.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n::BIGINT AS n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM forms f JOIN (SELECT follow.word, follow.root FROM follow JOIN forms e ON e.word = follow.root WHERE e.form IS NULL) r USING (word)"""

QUERIES = {"op12_spelling": op12_spelling}
ORACLES = {"op12_spelling": OP12_SQL}
