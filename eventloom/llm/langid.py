"""Language identification by bit-sliced Bloom filters of character n-grams.

One filter per language, stored side by side: a slot holds a bit mask of languages, so one look-up of an n-gram gives
every language whose filter contains it. A text's n-grams vote by popcount per language; the count that a filter's
false positives explain is taken off; the highest rest decides.

Training counts in how many sampled documents of a language each n-gram occurs. The sample is bounded
(``PER_LANGUAGE`` documents each, by hash); an n-gram enters the filter of each language where a stated share of the
sampled documents has it and that share is not far below the best language's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, map_texts

#: Documents of each language that training reads, at most.
PER_LANGUAGE = 600
#: Share of a language's sampled documents that must have an n-gram.
LEAST_SHARE = 0.02
#: Share of the best language's share.
LEAST_RATIO = 0.35
SIZES = (2, 3, 4)
HASHES = 3
UNKNOWN = "und"
#: Code points in one pass over a text, so that very long texts need no memory to match.
BLOCK = 1 << 18

_GOLDEN = 0x9E3779B97F4A7C15
_MIX = 0xFF51AFD7ED558CCD


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 32 for anything that is no letter."""
    held = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            held[c] = ord(low) if len(low) == 1 else c
    return held


_cache: dict[str, np.ndarray] = {}


def _folded(text: str) -> np.ndarray:
    """Code points, lower-cased, anything but letters as a space."""
    if "letters" not in _cache:
        _cache["letters"] = _letters()
    return _cache["letters"][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


def ngram_hashes(text: str) -> Iterator[np.ndarray]:
    """64-bit hashes of the n-grams of a text's letters, repeats included, some at a time.

    Runs of other characters count as one space, and there is one at both ends; an n-gram may have a space at its ends
    only. Each pass goes on from the last points of the one before, so passes change nothing.
    """
    held = np.array([32], np.uint64)
    for at in range(0, max(1, len(text)), BLOCK):
        points = np.concatenate([_folded(text[at : at + BLOCK]), [32] if at + BLOCK >= len(text) else []]).astype(np.uint64)
        blank = points == 32
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        keep[0] |= held[-1] != 32
        points, before = np.concatenate([held, points[keep]]), len(held)
        blank = points == 32
        out = [np.empty(0, np.uint64)]
        for n in SIZES:
            first = max(0, before - n + 1)
            m = len(points) - n + 1 - first
            if m <= 0:
                continue
            code = np.full(m, n, np.uint64)
            inner = np.zeros(m, bool)
            for k in range(n):
                code = code * np.uint64(_GOLDEN) + points[first + k : first + k + m]
                if 0 < k < n - 1:
                    inner |= blank[first + k : first + k + m]
            if n == 2:
                inner = blank[first : first + m] & blank[first + 1 : first + 1 + m]
            code = code[~inner]
            code ^= code >> np.uint64(31)
            code *= np.uint64(_MIX)
            out.append(code ^ (code >> np.uint64(29)))
        yield np.concatenate(out)
        held = points[-(max(SIZES) - 1) :]


@dataclass
class Filters:
    """``slots``: a bit mask of languages for each slot, 64 languages a column; ``false``: each filter's false positive rate."""

    languages: list[str]
    slots: np.ndarray
    false: np.ndarray

    @staticmethod
    def slots_of(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
        return [((hashes * np.uint64(2 * k + 1) + np.uint64(k * _MIX % (1 << 64))) * np.uint64(_GOLDEN) >> np.uint64(64 - bits)).astype(np.intp) for k in range(HASHES)]

    @classmethod
    def build(cls, members: dict[str, np.ndarray]) -> Filters:
        languages = sorted(members)
        most = max([1, *(len(x) for x in members.values())])
        bits = max(10, int(np.ceil(np.log2(most * HASHES * 3))))
        slots = np.zeros((1 << bits, max(1, -(-len(languages) // 64))), np.uint64)
        for i, language in enumerate(languages):
            for at in cls.slots_of(members[language], bits):
                slots[at, i // 64] |= np.uint64(1 << (i % 64))
        filled = [((slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))]
        return cls(languages, slots, np.array(filled) ** HASHES)

    def counts(self, text: str) -> tuple[int, np.ndarray]:
        """The number of n-grams and, for each language, how many its filter contains."""
        total, found = 0, np.zeros(len(self.languages))
        bits = int(self.slots.shape[0]).bit_length() - 1
        for hashes in ngram_hashes(text):
            total += len(hashes)
            where = self.slots_of(hashes, bits)
            for word in range(self.slots.shape[1]):
                column = self.slots[:, word]
                mask = column[where[0]]
                for other in where[1:]:
                    mask &= column[other]
                held = range(word * 64, min(len(self.languages), word * 64 + 64))
                if len(held) <= 8:
                    tally = np.bincount(mask.astype(np.intp), minlength=256)
                    for i in held:
                        found[i] += tally[_HAS[i % 64]].sum()
                else:
                    for i in held:
                        found[i] += int(((mask >> np.uint64(i % 64)) & np.uint64(1)).sum())
        return total, found

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the share of the n-grams that speak for it, false positives taken off; ties by name."""
        if not text or not self.languages:
            return UNKNOWN, 0.0
        total, found = self.counts(text)
        if not total:
            return UNKNOWN, 0.0
        share = np.clip((found / total - self.false) / np.maximum(1e-9, 1 - self.false), 0.0, 1.0)
        best = int(np.argmax(share))
        return self.languages[best], float(share[best])


_HAS = [np.nonzero((np.arange(256) >> i) & 1)[0] for i in range(8)]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's decimal text is 2 modulo 4 (a null id: not)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def members(df: DataFrame, text: str = "text", lang: str = "lang", keep: str = "doc_id", per_language: int = PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Each language's n-grams (hashes) from the rows of ``df`` with a language and a text, ``per_language`` each at most, chosen by hash.

    What comes to the driver is the n-grams over the share, a number that texts' lengths and not the corpus bound.
    """
    bounded_batches(df.sparkSession)
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("_lang"), F.col(text).alias("_text"), F.xxhash64(F.lit(7), F.col(keep), F.col(text)).alias("_by"))
    # Four times the sample by hash alone, then exactly the sample: what meets in a language's task has a bound.
    shares = {r["_lang"]: min(1.0, 4.0 * per_language / r["n"]) for r in df.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("_lang")).agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]) if shares else F.create_map(F.lit(""), F.lit(1.0))
    rows = rows.where(F.shiftrightunsigned("_by", 11) / float(1 << 53) < F.coalesce(F.try_element_at(share, F.col("_lang")), F.lit(1.0)))
    sample = rows.withColumn("_n", F.row_number().over(W.partitionBy("_lang").orderBy("_by"))).where(F.col("_n") <= per_language)
    sizes = {r["_lang"]: r["n"] for r in sample.groupBy("_lang").agg(F.count("*").alias("n")).collect()}

    def grams(batches):
        for batch in batches:
            for lang_, text_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.unique(np.concatenate([np.unique(h) for h in ngram_hashes(text_)]))
                yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(found), pa.string()), pa.array(found.view(np.int64))], names=["lang", "gram"])

    counts = sample.repartition("_lang", "_by").select("_lang", "_text").mapInArrow(grams, "lang string, gram long").groupBy("lang", "gram").count()
    size = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]) if sizes else F.create_map(F.lit(""), F.lit(1))
    shares = counts.withColumn("share", F.col("count") / size[F.col("lang")]).where((F.col("share") >= LEAST_SHARE) & (F.col("count") >= 2))
    best = shares.groupBy("gram").agg(F.max("share").alias("best"))
    taken = shares.join(best, "gram").where(F.col("share") >= LEAST_RATIO * F.col("best")).select("lang", "gram").toPandas()
    return {language: taken.loc[taken["lang"] == language, "gram"].to_numpy(np.int64).view(np.uint64) for language in sizes}


def train(df: DataFrame, text: str = "text", lang: str = "lang", keep: str = "doc_id", per_language: int = PER_LANGUAGE) -> Filters:
    return Filters.build(members(df, text, lang, keep, per_language))


def predict(df: DataFrame, filters: Filters, text: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """``lang_pred`` and ``score`` for each row, and the columns that ``keep`` names: one narrow pass."""
    shipped = df.sparkSession.sparkContext.broadcast(filters)
    keep = keep or {"doc_id": "doc_id"}

    def make() -> Callable:
        def work(texts: list) -> dict:
            made = [shipped.value.predict(t) for t in texts]
            return {"lang_pred": pa.array([x for x, _ in made], pa.string()), "score": pa.array([x for _, x in made], pa.float64())}

        return work

    kept = ", ".join(f"`{b}` {df.schema[a].dataType.simpleString()}" for a, b in keep.items())
    return map_texts(df, make, f"{kept}, lang_pred string, score double", text, keep)


def identify(df: DataFrame, text: str = "text", lang: str = "lang", keep: str = "doc_id") -> DataFrame:
    """``keep``, ``held_out``, ``lang_pred`` and ``score`` of each row.

    Filters are learned from the rows that are not held out; only the text is an input of a prediction. Null texts and
    texts without a letter are ``und`` with score 0, and so is every text if there is nothing to learn from. Repeated
    rows stay; an empty table gives no rows; other columns are ignored.
    """
    filters = train(df.where(~held_out(F.col(keep))), text, lang, keep)
    return predict(df, filters, text, {keep: keep}).select(keep, held_out(F.col(keep)).alias("held_out"), "lang_pred", "score")
