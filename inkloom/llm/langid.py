"""Language identification by language-bitmask n-gram filters.

Each language's frequent character n-grams are put into one bit-sliced Bloom
filter: a slot holds a bit for each language, and the slots of an n-gram, anded,
give all languages that contain it. A text's languages are the per-language
counts of its n-grams' bits, less the share that the language's filled slots
give by chance.

The filter is fitted on SAMPLE_DOCS documents of each language or about as many
(by hash, whole texts); an n-gram is a language's if it makes at least
LEAST_SHARE of that sample's n-grams, so that the filter's size is bounded.

Defined cases: a null text or one without letters is `und` with score 0; rows
without a language teach nothing; with nothing to learn from, everything is
`und`; repeated rows get equal results; a null doc_id counts as one that teaches;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty
from .encoding import small_batches

GRAM = 4
SLOT_BITS = 21
HASHES = 2
SAMPLE_DOCS = 3000
LEAST_SHARE = 1e-5
#: A document whose best language knows less of its n-grams than this is rejected by the pipeline.
LEAST_KNOWN = 0.2
UND = "und"

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_ALPHA: np.ndarray | None = None


def _alpha() -> np.ndarray:
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _ALPHA


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, text of each, letters of each text) of the n-grams that hold a letter.

    Letters are lower-cased, everything else is a space, and texts are padded
    with spaces, so that the ends of words count.
    """
    codes = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    pad = np.full(GRAM - 1, 32, np.uint32)
    flat = np.concatenate([pad, *(p for c in codes for p in (c, pad))])
    letter = _alpha()[flat]
    owner = np.repeat(np.arange(len(texts)), [len(c) + GRAM - 1 for c in codes])
    letters = np.bincount(owner, weights=letter[GRAM - 1 :], minlength=len(texts)).astype(np.int64)
    code = np.where(letter, flat, np.uint32(32)).astype(np.uint64) + np.uint64(1)
    n = len(code) - GRAM + 1
    h = np.zeros(n, np.uint64)
    some = np.zeros(n, bool)
    for i in range(GRAM):
        h ^= code[i : i + n] * _MULTIPLIERS[i]
        h = (h << np.uint64(7)) | (h >> np.uint64(57))
        some |= letter[i : i + n]
    h = (h ^ (h >> np.uint64(32))) * _MULTIPLIERS[0]
    return h[some], owner[:n][some], letters


def slots(h: np.ndarray) -> list[np.ndarray]:
    shift = np.uint64(64 - SLOT_BITS)
    return [((h * _MULTIPLIERS[1 + i]) >> shift).astype(np.int64) for i in range(HASHES)]


@dataclass
class Filter:
    """The bit-sliced filter: `planes` tables of 2^SLOT_BITS slots of 64 languages each."""

    languages: list[str]
    planes: np.ndarray
    chance: np.ndarray  # of each language: that an unknown n-gram seems known

    @classmethod
    def build(cls, languages: list[str], language: np.ndarray, h: np.ndarray) -> Filter:
        planes = np.zeros((-(-max(1, len(languages)) // 64), 1 << SLOT_BITS), np.uint64)
        for s in slots(h):
            np.bitwise_or.at(planes, (language // 64, s), np.uint64(1) << (language % 64).astype(np.uint64))
        filled = [np.count_nonzero(planes[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / (1 << SLOT_BITS) for i in range(len(languages))]
        return cls(languages, planes, np.array(filled) ** HASHES)

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(share of each text's n-grams that each language knows, corrected for chance; letters of each text)."""
        h, owner, letters = grams(texts)
        at = slots(h)
        total = np.bincount(owner, minlength=len(texts))
        known = np.zeros((len(texts), len(self.languages)))
        for p, plane in enumerate(self.planes):
            mask = plane[at[0]]
            for s in at[1:]:
                mask &= plane[s]
            for i in range(p * 64, min(len(self.languages), p * 64 + 64)):
                hits = owner[(mask >> np.uint64(i % 64) & np.uint64(1)).astype(bool)]
                known[:, i] = np.bincount(hits, minlength=len(texts))
        share = known / np.maximum(total, 1)[:, None]
        return np.clip((share - self.chance) / (1 - self.chance), 0, 1), letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, share known) of each text."""
        if not self.languages:
            return [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        share, letters = self.shares(texts)
        best = share.argmax(axis=1)
        weight = np.exp(20 * (share - share.max(axis=1, keepdims=True)))
        score = np.where(letters > 0, share.max(axis=1) / weight.sum(axis=1), 0.0)
        return [self.languages[b] if n else UND for b, n in zip(best.tolist(), letters.tolist())], score, share.max(axis=1)


def held_out() -> Column:
    """Whether a document is kept from learning: the checksum of its id, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, least_share: float = LEAST_SHARE) -> Filter:
    """The filter of the languages of the documents that may teach."""
    teachers = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("lang", "text", F.xxhash64("doc_id", "text").alias("key"))
    # a row for each language
    counts = sorted((r.lang, r.n) for r in teachers.groupBy("lang").agg(F.count("*").alias("n")).collect())
    if not counts:
        return Filter([], np.zeros((1, 1 << SLOT_BITS), np.uint64), np.zeros(0))
    languages = [lang for lang, _ in counts]
    code = {lang: i for i, lang in enumerate(languages)}
    spark = docs.sparkSession
    rates = spark.createDataFrame([(lang, min(1.0, sample_docs / n)) for lang, n in counts], "lang string, rate double")
    chosen = teachers.join(F.broadcast(rates), "lang").where((F.col("key").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))) < F.col("rate"))

    def counted(batches):
        for batch in batches:
            for part, texts in small_batches(batch):
                lang = np.array([code[x] for x in part.column("lang").to_pylist()], np.int64)
                h, owner, _ = grams(texts)
                for one in np.unique(lang):
                    u, n = np.unique(h[lang[owner] == one], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), one)), pa.array(u.view(np.int64)), pa.array(n)], ["lang", "h", "n"])

    found = chosen.select("lang", "text").mapInArrow(counted, "lang long, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    total = found.groupBy("lang").agg(F.sum("n").alias("total"))
    # each language has 1 / least_share n-grams at most
    kept = found.join(F.broadcast(total), "lang").where((F.col("n") >= F.greatest(F.lit(2), F.col("total") * least_share)) | (F.col("total") < 2000)).select("lang", "h").toArrow()
    return Filter.build(languages, kept.column("lang").to_numpy(), kept.column("h").to_numpy().view(np.uint64))


def identified(docs: DataFrame, model: Filter, keep: list[str], prefix: str = "") -> DataFrame:
    """The columns `keep` of docs with lang_pred, score and known, under names with a prefix."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 16 MB for each 64 languages
    names = [f"_{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), text_or_empty().alias("_text"))

    def predict(batches):
        for batch in batches:
            for part, texts in small_batches(batch, "_text", 1_000_000):
                lang, score, known = shared.value.predict(texts)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(lang), pa.array(score), pa.array(known)], [*names, "lang_pred", "score", "known"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.drop("_text").dtypes)
    out = rows.mapInArrow(predict, f"{schema}, lang_pred string, score double, known double")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep)), *(F.col(c).alias(prefix + c) for c in ("lang_pred", "score", "known")))


def op6_language_bitmasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identified(docs, fit(docs), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
