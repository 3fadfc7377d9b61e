"""Token counts by byte-pair merging with a heap and a linked list.

A word's symbols form a doubly linked list; a heap holds its adjacent pairs by merge rank. The lowest pair is popped
until none is left, and the count is the number of symbols less the number of merges. No identifiers are made.

Words are independent of each other, so each is counted once per worker and then looked up. The table of counted words
is emptied at WORDS_KEPT entries, which bounds memory and changes no result. Null and empty texts have 0 tokens; very
long texts are only split, never cut; the input's other columns aren't read.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpoint.llm.common import table, utf8

WORDS_KEPT = 600_000
#: White space as Unicode has it, for a character class. Fixed values.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if it is one, else 256, 257, ..."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


@lru_cache
def category_ranges(category: str) -> str:
    """The characters of a general category, as ranges for a character class."""
    found = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == category]
    first = [c for c, before in zip(found, [-2, *found]) if c != before + 1]
    last = [c for c, behind in zip(found, [*found[1:], -2]) if c != behind - 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first, last))


class WordPairMerger:
    """Counts the tokens of texts under a vocabulary file whose words end in a suffix, white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, ids = spec["model"], {}

        def number(symbol: str) -> int:
            return ids.setdefault(symbol, len(ids))

        suffix = model["end_of_word_suffix"] or ""
        self.inner = [number(s) for s in byte_symbols()]
        self.final = [number(s + suffix) for s in byte_symbols()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            self.merges.setdefault((number(left), number(right)), (rank, number(left + right)))
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = re.compile(pattern.replace(r"\p{L}", category_ranges("L")).replace(r"\p{N}", category_ranges("N")).replace(r"\s", WHITE))
        self.counted: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens of one word, by heap and linked list."""
        data = word.encode("utf-8", "surrogatepass")
        n = len(data)
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.final[data[-1]]
        if n == 1:
            return 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges, heap = self.merges, []
        for i in range(n - 1):
            if (found := merges.get((symbols[i], symbols[i + 1]))) is not None:
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(heap)
        merged = 0
        while heap:
            _, i, left, right, joined = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = joined, -1
            k = after[i] = after[j]
            merged += 1
            if k < n:
                before[k] = i
                if (found := merges.get((joined, symbols[k]))) is not None:
                    heapq.heappush(heap, (found[0], i, joined, symbols[k], found[1]))
            if (h := before[i]) >= 0 and (found := merges.get((symbols[h], joined))) is not None:
                heapq.heappush(heap, (found[0], h, symbols[h], joined, found[1]))
        return n - merged

    def chunk(self, chunk: str) -> int:
        """Tokens of a normalised run without white space."""
        total, counted = 0, self.counted
        for word in self.pattern.findall(chunk):
            if (n := counted.get(word)) is None:
                n = self.word(word)
                if len(counted) >= WORDS_KEPT:
                    counted.clear()
                if len(word) <= 64:
                    counted[word] = n
            total += n
        return total

    def plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower() looks at a sigma's neighbours; the vocabulary's normaliser doesn't
                text = text.replace("Σ", "σ")
        if SEPARATORS.search(text):  # split() drops these four; the vocabulary's pattern keeps them as symbols
            return self.chunk(text.lower())
        total, counted = 0, self.counted
        for chunk in text.lower().split():
            if (n := counted.get(chunk)) is None:
                n = self.word(chunk) if chunk.isalpha() else self.chunk(chunk)
                if len(counted) >= WORDS_KEPT:
                    counted.clear()
                if len(chunk) <= 64:
                    counted[chunk] = n
            total += n
        return total

    def count(self, text: str) -> int:
        """Tokens of a text; each special string inside it is one token, as is the library's default."""
        if not any(s in text for s in self.specials):
            return self.plain(text)
        return len(self.special.findall(text)) + sum(map(self.plain, self.special.split(text)))


@lru_cache(2)
def merger(path: str) -> WordPairMerger:
    return WordPairMerger(path)


def count_tokens(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = 2048) -> DataFrame:
    """key, n_bytes, n_tokens and whether a text has more tokens than the limit; one row per row of df."""
    kind = df.schema[key].dataType

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merger(path)
        for batch in found:
            texts = batch.column(1)
            counts = [model.count(t) if t else 0 for t in (x.as_py() for x in texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["key", "n_bytes", "n_tokens"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.octet_length(utf8(text)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(count, f"key {kind.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLES: dict[str, str] = {}
