"""Language identification with error-correcting output codes.

Each language gets a codeword: all distinct splits of the languages for up to seven, else the random code with the widest
separation among several. A binary classifier for each bit is a log-ratio of smoothed n-gram frequencies between the
languages on its two sides, learned from counts over all training documents. A text's margin for a bit is the mean of its
n-grams' log-ratios. Decoding sums a logistic loss over bits, weighted by how far each bit parts the languages in
training, and takes the codeword with the least loss; the score is its share by softmax, and a text is flagged ambiguous
where the runner-up is close.

N-grams are hashed bytes (three at a time, A-Z lower-cased), so any script counts. Null texts and texts without a letter
are "und" with score 0. Without a training document every text is "und". Training ignores null languages and texts, and where
there are more than MOST_LANGUAGES values it learns those of the most training documents. Repeated rows are judged one by
one and counted as often as they occur. Texts of any length are read whole, in slices. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpoint.llm.common import bytes_of, row_slices, table, utf8

BUCKETS = 1 << 15
GRAM = 3
SMOOTHING = 0.5
#: The model, so many languages x BUCKETS counts at most, is made on the driver.
MOST_LANGUAGES = 400
SLICE = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MARGIN_SCALE = 60.0
AMBIGUOUS = 0.9
#: A text is unintelligible where its loss exceeds the median of its language's training texts of its length class by so many
#: times their distance from median to upper decile, and half the loss of a text that says nothing of its language.
FAR = 10.0
LEAST_LOSS = 0.5 * float(np.log(2))
#: Classes of fewer training texts take the limit of the next shorter class (shorter texts vary more); without one they reject none.
LEAST_TEXTS = 30


def buckets(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bucket of the n-gram at each byte; BUCKETS where it would leave its text."""
    x = LOWER[data].astype(np.uint32)
    out = np.full(len(x), BUCKETS, np.int32)
    if len(x) < GRAM:
        return out
    code = x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))
    out[:-2] = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    ends = offsets[1:]
    for k in range(1, GRAM):
        at = ends - k
        out[at[at >= offsets[:-1]]] = BUCKETS
    return out


def sliced(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of slices. A text longer than a slice comes in several that share GRAM - 1 bytes."""
    for first, last in row_slices(offsets, SLICE):
        begin, end = offsets[first], offsets[last]
        if last - first > 1 or end - begin <= SLICE:
            yield first, data[begin:end], offsets[first : last + 1] - begin
        else:
            for s in range(begin, end, SLICE):
                piece = data[s : min(s + SLICE + GRAM - 1, end)]
                yield first, piece, np.array([0, len(piece)])


def gram_counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """n-gram counts by language and bucket over all rows; each task adds up its own first."""

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in found:
            langs = batch.column(0).to_pylist()
            for first, data, offsets in sliced(*bytes_of(batch.column(1))):
                grams = buckets(data, offsets)
                names = sorted({*langs[first : first + len(offsets) - 1]})
                code = np.repeat([names.index(x) for x in langs[first : first + len(offsets) - 1]], np.diff(offsets))
                sums = np.bincount(code * (BUCKETS + 1) + grams, minlength=len(names) * (BUCKETS + 1)).reshape(len(names), -1)
                for name, row in zip(names, sums):
                    totals[name] = totals.get(name, 0) + row[:BUCKETS]
        for name, row in totals.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array(row[at], pa.int64())], ["lang", "bucket", "n"])

    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), utf8(text).alias("text"))
    return rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of +1 and -1."""
    if n <= 7:
        bits = np.arange(1, 1 << (n - 1)) if n > 1 else np.zeros(0, int)
        return np.array([[1 if (n - 1 == k) or not (b >> k) & 1 else -1 for b in bits] for k in range(n)]).reshape(n, len(bits))
    rng, width = np.random.default_rng(seed), 10 * int(np.ceil(np.log2(n)))
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (n, width))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        distance = ((width - code @ code.T) // 2 + width * np.eye(n, dtype=int)).min()
        if distance > apart:
            best, apart = code, distance
    return best


class Model:
    """Languages, their codewords, each bucket's log-ratio for every bit, and the bits' weights."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        share = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True)
        bits = self.code.shape[1]
        ratios = np.zeros((BUCKETS + 1, bits))
        for b in range(bits):
            positive, negative = share[self.code[:, b] > 0].mean(axis=0), share[self.code[:, b] < 0].mean(axis=0)
            ratios[:BUCKETS, b] = np.log(positive) - np.log(negative)
        expected = share @ ratios[:BUCKETS] * self.code  # a language's own mean margin, by bit
        self.weights = np.maximum(expected.min(axis=0), 1e-3) if bits else np.zeros(0)
        self.weights = self.weights / max(self.weights.sum(), 1e-9)
        self.ratios = ratios.astype(np.float32)

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of log-ratios and numbers of n-grams of each text."""
        grams = buckets(data, offsets)
        sums, counts = np.zeros((len(offsets) - 1, self.code.shape[1])), np.maximum(np.diff(offsets) - GRAM + 1, 0)
        full = np.flatnonzero(np.diff(offsets) > 0)
        if len(full):
            sums[full] = np.add.reduceat(self.ratios[grams], offsets[full], axis=0, dtype=np.float64)
        return sums, counts

    def losses(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of every text to every codeword."""
        margin = sums / np.maximum(counts, 1)[:, None]
        return (self.weights * np.logaddexp(0, -4 * margin[:, None, :] * self.code[None])).sum(axis=2)

    def decoded(self, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share, and its lead over the runner-up."""
        power = -MARGIN_SCALE * self.losses(sums, counts)
        share = np.exp(power - power.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        ordered = np.sort(share, axis=1)
        lead = ordered[:, -1] - (ordered[:, -2] if share.shape[1] > 1 else 0)
        return share.argmax(axis=1), share.max(axis=1), lead


def fitted(df: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST_LANGUAGES) -> Model | None:
    """A model of all rows of df with a language (one of the most common, most of them) and a text; None without any."""
    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    common = known.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most)
    langs = sorted(r["lang"] for r in common.select("lang").collect())
    if not langs:
        return None
    place = F.create_map(*(F.lit(x) for k, name in enumerate(langs) for x in (name, k * BUCKETS)))
    found = gram_counts(known.where(F.col(lang).isin(langs)), text, lang)
    rows = found.select((place[F.col("lang")] + F.col("bucket")).alias("at"), "n").toPandas()  # at most languages x buckets, two numbers each
    counts = np.zeros(len(langs) * BUCKETS)
    counts[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return Model(langs, counts.reshape(len(langs), BUCKETS))


def predicted(df: DataFrame, model: Model | None, text: str = "text", losses: bool = False) -> DataFrame:
    """df with _lang_pred, _score and _ambiguous, and with losses (needs a model) _loss and _grams; its columns are carried along."""
    clean = df.withColumn("_letter", F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}"))
    if model is None:
        return clean.drop("_letter").withColumns({"_lang_pred": F.lit("und"), "_score": F.lit(0.0), "_ambiguous": F.lit(True)})
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def judge(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in found:
            n = batch.num_rows
            sums, counts = np.zeros((n, model.code.shape[1])), np.zeros(n, np.int64)
            texts = batch.column(at).fill_null("")
            for first, data, offsets in sliced(*bytes_of(texts)):
                s, c = model.margins(data, offsets)
                sums[first : first + len(s)] += s
                counts[first : first + len(s)] += c
            best, score, lead = model.decoded(sums, counts)
            known = batch.column(n_columns).to_numpy(zero_copy_only=False)
            langs = np.where(known, np.array(model.langs, object)[best], "und")
            out = [pa.array(langs, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(~known | (lead < AMBIGUOUS))]
            if losses:
                out += [pa.array(model.losses(sums, counts).min(axis=1)), pa.array(counts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n_columns)), *out], [f"c{i}" for i in range(n_columns)] + names)

    n_columns = len(df.columns)
    names = ["lang_pred", "score", "ambiguous"] + ["loss", "grams"] * losses
    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema))
    named = clean.toDF(*(f"c{i}" for i in range(n_columns)), "letter")
    return named.mapInArrow(judge, f"{fields}, lang_pred string, score double, ambiguous boolean" + ", loss double, grams long" * losses).toDF(*df.columns, *(f"_{n}" for n in names))


def held_out(key: str) -> Column:
    """Whether a row is kept from training; not for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identified(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """df with predictions of a model of the rows of df that aren't held out."""
    return predicted(df, fitted(df.where(~held_out(key)), text, lang), text)


def intelligible(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", fill: bool = False) -> DataFrame:
    """Rows with a letter whose loss against the nearest codeword isn't far beyond that language's training texts of its length.

    Where no model can be fitted, all rows with a letter. With fill, a null language becomes the predicted one where the
    decoder isn't in doubt.
    """
    training = df.where(~held_out(key))
    model = fitted(training, text, lang)
    if model is None:
        return df.where(F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}"))
    length = F.floor(F.log2(F.col("_grams") + F.lit(1.0))).cast("int")
    own = predicted(training.where(F.col(lang).isNotNull()).select(text, F.col(lang).alias("_given")), model, text, losses=True).where("_lang_pred = _given")
    levels = own.groupBy(F.col("_lang_pred").alias("_of"), length.alias("_length")).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_loss", [0.5, 0.9]).alias("q"))
    limit = F.greatest(F.col("q")[0] + FAR * (F.col("q")[1] - F.col("q")[0]), F.lit(LEAST_LOSS))
    known = {(r["_of"], r["_length"]): r["_limit"] for r in levels.where(F.col("n") >= LEAST_TEXTS).select("_of", "_length", limit.alias("_limit")).collect()}  # at most languages x length classes
    rows = []
    for name in model.langs:
        last = None
        for k in range(64):
            last = known.get((name, k), last)
            rows.append((name, k, last))
    limits = df.sparkSession.createDataFrame(rows, "_of string, _length int, _limit double")
    judged = predicted(df, model, text, losses=True).where("_lang_pred <> 'und'")
    found = judged.join(F.broadcast(limits), (F.col("_lang_pred") == F.col("_of")) & (length == F.col("_length")), "left")
    own = F.when(F.col(lang).isNull() & ~F.col("_ambiguous"), F.col("_lang_pred")).otherwise(F.col(lang)) if fill else F.col(lang)
    kept = found.where(F.col("_limit").isNull() | (F.col("_loss") <= F.col("_limit")))
    return kept.select(*(own.alias(c) if c == lang else F.col(c) for c in df.columns))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fitted(docs.where(~held_out("doc_id")))
    out = predicted(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"), F.col("_ambiguous").alias("ambiguous"))


QUERIES = {"op7_language_id": op7_language_id}
ORACLES: dict[str, str] = {}
