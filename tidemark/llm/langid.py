"""Language identification with language-bitmask n-gram filters.

All languages share one Bloom filter whose slots hold bitmasks, one bit per language (a bit-sliced
filter). Asking for an n-gram combines its slots with AND and yields every language that holds the
n-gram at once. A text's n-grams are counted per language; as a language's bit may be set in all
slots by chance with a probability known from its fill, the counts are corrected for that, and the
largest decides.

N-grams are runs of ``ORDER`` characters of the lower-cased text, with everything but letters read
as a space, that have no space inside. A language holds an n-gram if at least ``SHARE`` of its
training texts have it. The filter has ``SLOTS`` slots whatever the corpus, which bounds what the
driver gathers and sends.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import free_name

#: Characters in an n-gram, slots (a power of two), slots of an n-gram.
ORDER, SLOTS, HASHES = 3, 1 << 20, 3
#: Expected training texts of a language at most; least share of them that must have an n-gram.
SAMPLE, SHARE = 2000, 0.01
#: More labels than this are refused, as each lane of 64 sends a filter of SLOTS masks to all workers.
MOST_LANGUAGES = 1024
#: Characters of a text whose n-grams are looked up at once.
PART = 1 << 18
UNDETERMINED = "und"

_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text between two spaces, with 32 for everything but letters."""
    code = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _LETTER[np.minimum(code, 0xFFFF)]
    beyond = code > 0xFFFF
    if beyond.any():
        letter = letter.copy()
        letter[beyond] = [chr(c).isalpha() for c in code[beyond]]
    return np.where(letter, code, 32)


def _hashes(code: np.ndarray) -> np.ndarray:
    """64-bit hashes of the n-grams of ``_codes``."""
    n = len(code) - ORDER + 1
    if n < 1:
        return np.empty(0, np.uint64)
    space = code == 32
    use = np.ones(n, bool)
    for i in range(1, ORDER - 1):
        use &= ~space[i : i + n]
    use &= ~(space[:n] & space[ORDER - 1 :]) if ORDER < 3 else True
    x = np.zeros(n, np.uint64)
    for i in range(ORDER):
        x = x * np.uint64(0x9E3779B97F4A7C15) + code[i : i + n].astype(np.uint64)
    x = x[use]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def held_out(id_col: str) -> Column:
    """Rows that training leaves out: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class LanguageFilter:
    """The filter: ``masks`` (SLOTS, lanes) of up to 64 languages a lane, and the languages in order."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks = languages, masks
        bits = [((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))]
        self.chance = np.array(bits) ** HASHES

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score, the corrected share of n-grams that the language holds."""
        code = _codes(text) if text else np.empty(0, np.uint32)
        if not self.languages or not (code != 32).any():
            return UNDETERMINED, 0.0
        counts, total = np.zeros(len(self.languages)), 0
        for at in range(0, len(code), PART):
            hashes = _hashes(code[at : at + PART + ORDER - 1])
            total += len(hashes)
            mask = self.masks[hashes & np.uint64(SLOTS - 1)]
            for i in range(1, HASHES):
                mask = mask & self.masks[(hashes >> np.uint64(20 * i)) & np.uint64(SLOTS - 1)]
            for k in range(len(self.languages)):
                counts[k] += np.count_nonzero(mask[:, k // 64] & np.uint64(1 << (k % 64)))
        right = np.clip((counts - total * self.chance) / (1 - np.minimum(self.chance, 0.999)), 0, total)
        best = int(np.argmax(right))
        return self.languages[best], float(right[best] / total) if total else 0.0


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageFilter:
    """Fit the filter on labelled rows that are not held out, about ``sample`` texts of each language.

    The sample goes by a hash of the id, so that it does not depend on the order of rows. Only
    language counts and filled slots reach the driver, at most SLOTS for each 64 languages.
    """
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    totals = {r[0]: r[1] for r in rows.groupBy(lang_col).count().limit(MOST_LANGUAGES + 1).collect()}
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different labels; they don't look like languages")
    languages = sorted(totals, key=lambda lang: (-totals[lang], lang))
    lanes = max(1, -(-len(languages) // 64))
    masks = np.zeros((SLOTS, lanes), np.uint64)
    if not languages:
        return LanguageFilter([], masks)
    spark = df.sparkSession
    rates = spark.createDataFrame([(k, lang, min(1.0, sample / totals[lang])) for k, lang in enumerate(languages)], "k int, l string, rate double")
    some = rows.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"), F.pmod(F.xxhash64(id_col), F.lit(1_000_000)).alias("h"))
    some = some.join(F.broadcast(rates), "l").where(F.col("h") < F.col("rate") * 1_000_000).select("k", "t")

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[int, Counter] = {}
            for k, text in zip(batch["k"], batch["t"], strict=True):
                code = _codes(text)
                parts = [np.unique(_hashes(code[at : at + PART + ORDER - 1])) for at in range(0, len(code), PART)]
                seen.setdefault(k, Counter()).update((np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]).tolist())
            for k, counts in seen.items():
                h = np.fromiter(counts.keys(), np.uint64, len(counts)).view(np.int64)
                yield pd.DataFrame({"k": k, "h": h, "n": np.fromiter(counts.values(), np.int64, len(counts))})

    counts = some.mapInPandas(grams, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n"))
    texts = F.broadcast(some.groupBy("k").agg(F.count("*").alias("texts")))
    held = counts.join(texts, "k").where(F.col("n") >= F.greatest(F.lit(1.0), F.col("texts") * SHARE))
    slots = F.array(*[F.shiftrightunsigned("h", 20 * i).bitwiseAND(SLOTS - 1) for i in range(HASHES)])
    filled = held.select(F.expr("k div 64").alias("lane"), F.expr("shiftleft(1L, cast(k % 64 as int))").alias("bit"), F.explode(slots).alias("slot"))
    for r in filled.groupBy("lane", "slot").agg(F.bit_or("bit").alias("mask")).toPandas().itertuples():
        masks[r.slot, r.lane] |= np.uint64(r.mask & 0xFFFFFFFFFFFFFFFF)
    return LanguageFilter(languages, masks)


def predicted(text: Column, model: LanguageFilter, spark) -> Column:
    """``struct(lang_pred, score)`` of a string column."""
    shared = spark.sparkContext.broadcast((model.languages, model.masks))  # SLOTS masks, a fixed size a lane

    def predict(texts: pd.Series) -> pd.DataFrame:
        own = LanguageFilter(*shared.value) if not hasattr(shared, "own") else shared.own
        shared.own = own
        return pd.DataFrame([own.predict(t) for t in texts], columns=["lang_pred", "score"])

    # a filter on the prediction must not make Spark predict twice
    return F.pandas_udf(predict, "lang_pred string, score double").asNondeterministic()(text)


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.2) -> DataFrame:
    """The rows of ``df`` whose language is identified, with its columns.

    A row goes if it is undetermined or if under ``least`` of its n-grams belong to its best
    language. A null label becomes the predicted one.
    """
    model = train(df, id_col, text_col, lang_col)
    p = free_name(df, "language")
    out = df.withColumn(p, predicted(F.col(text_col), model, df.sparkSession))
    out = out.where((F.col(p)["lang_pred"] != UNDETERMINED) & (F.col(p)["score"] >= least))
    return out.withColumn(lang_col, F.coalesce(lang_col, F.col(p)["lang_pred"])).drop(p)


def with_language(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``df`` with held_out, lang_pred and score.

    A null text or one without a letter gets ``und`` and 0. Labels, sources and ids are never
    inputs of a prediction. Without any training row everything is ``und``. Ties go to the language
    with more training rows. An empty table stays empty; columns with the new names are replaced.
    """
    model = train(df, id_col, text_col, lang_col, sample)
    p = predicted(F.col(text_col), model, df.sparkSession)
    out = df.withColumn("held_out", held_out(id_col)).withColumn("score", p)
    return out.withColumn("lang_pred", F.col("score.lang_pred")).withColumn("score", F.col("score.score"))
