"""Language identification by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes a space, and the 1- to 3-grams of code
points that hold a letter are hashed into ``BUCKETS`` columns.  Training counts n-grams by
(language, bucket) in Spark over at most ``max_train`` labelled documents (those with the
smallest seeded hash, whole texts); the smoothed log-probabilities are a matrix of languages
x buckets, bounded by ``MAX_LANGUAGES`` x ``BUCKETS`` numbers whatever the corpus, which is
broadcast.  Scoring works through whole texts in blocks of code points: a block's n-grams
are looked up in the matrix and summed by document, so memory does not follow text length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
BLOCK = 1 << 18
#: Code points of texts that are scored together.
PART = 1 << 21
MAX_LANGUAGES = 200
#: Labelled documents that are learned from, at most.
MAX_TRAIN = 6000
UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTERS[0]


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (document number, bucket) of the n-grams of the texts, in document order."""
    letter = _letter_table()
    points = np.frombuffer("".join(t.lower() for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t.lower()) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    for at in range(0, len(points), BLOCK):
        size = min(BLOCK, len(points) - at)
        part = points[at:at + size + max(ORDERS) - 1]
        is_letter = letter[part]
        part = np.where(is_letter, part, 32).astype(np.uint64)
        doc = np.searchsorted(ends, np.arange(at, at + size), side="right")
        room = ends[doc] - np.arange(at, at + size)
        code, lettered = np.zeros(size, np.uint64), np.zeros(size, bool)
        for n in range(1, max(ORDERS) + 1):
            m = min(size, len(part) - n + 1)
            code, lettered, room, doc = code[:m], lettered[:m], room[:m], doc[:m]
            code = (code + part[n - 1:n - 1 + m] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
            lettered = lettered | is_letter[n - 1:n - 1 + m]
            if n in ORDERS:
                whole = lettered & (room >= n)
                yield doc[whole], (code[whole] >> np.uint64(48 - (BUCKETS.bit_length() - 17))).astype(np.int64) % BUCKETS


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray          # buckets x languages

    def scores(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Best language of each text and its posterior probability (0 for ``und``)."""
        lang, score, part, held = [], [], [], 0
        for t in [*texts, None]:                       # a bounded number of code points at once, or one text
            if part and (held > PART or len(lang) + len(part) == len(texts)):
                a, b = self._scores(part)
                lang, score, part, held = lang + a, score + b, [], 0
            part.append(t)
            held += len(t or "")
        return lang, score

    def _scores(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        whole = [t or "" for t in texts]
        total = np.tile(self.log_prior, (len(whole), 1))
        hit = np.zeros(len(whole), bool)
        for doc, bucket in grams(whole):
            if len(doc):
                starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                total[doc[starts]] += np.add.reduceat(self.log_prob[bucket], starts, axis=0)
                hit[doc[starts]] = True
        if not self.languages:
            return [UNKNOWN] * len(whole), [0.0] * len(whole)
        best = total.argmax(axis=1)
        share = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return ([self.languages[b] if h else UNKNOWN for b, h in zip(best, hit)],
                [float(s) if h else 0.0 for s, h in zip(share, hit)])


def _count_part(batches):
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for b in batches:
        for lang, group in b.groupby("lang"):
            c = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            docs[lang] = docs.get(lang, 0) + len(group)
            for _, bucket in grams(group["text"].tolist()):
                c += np.bincount(bucket, minlength=BUCKETS)
    for lang, c in counts.items():
        seen = np.flatnonzero(c)
        yield pd.DataFrame({"lang": lang, "bucket": np.r_[-1, seen], "n": np.r_[docs[lang], c[seen]]})


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
          max_train: int = MAX_TRAIN, alpha: float = 0.5) -> Model:
    """Fit on rows with a text and a label; at most ``max_train`` keys, those of smallest hash.

    No such row: a model that answers ``und``.  More than ``MAX_LANGUAGES`` labels: ValueError.
    """
    h = F.xxhash64(F.lit("langid"), F.col(key))
    rows = docs.select(h.alias("h"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    cut = rows.select("h").orderBy("h").limit(max_train).agg(F.max("h")).first()[0]
    if cut is None:
        return Model((), np.zeros(0), np.zeros((BUCKETS, 0)))
    sample = rows.where(F.col("h") <= F.lit(cut)).select("lang", "text")
    counted = (sample.mapInPandas(_count_part, "lang string, bucket int, n long")
               .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    labels = sorted(r[0] for r in sample.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(labels) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    table = counted.toArrow()                # at most MAX_LANGUAGES x (BUCKETS + 1) rows
    at = pd.Index(labels).get_indexer(table["lang"].to_pandas())
    bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy().astype(float)
    seen = np.zeros((BUCKETS, len(labels)))
    gram = bucket >= 0
    seen[bucket[gram], at[gram]] = n[gram]
    prior = np.zeros(len(labels))
    prior[at[~gram]] = n[~gram]
    return Model(tuple(labels), np.log(prior / prior.sum()),
                 np.log((seen + alpha) / (seen.sum(axis=0) + alpha * BUCKETS)))


def predict(spark: SparkSession, model: Model, text: str = "text") -> Column:
    """Struct column (lang, score) for a text column; other columns stay in the JVM."""
    # Plain values: a broadcast names its classes by module, which a worker need not have.
    shared = spark.sparkContext.broadcast((model.languages, model.log_prior, model.log_prob))

    @F.pandas_udf("lang string, score double")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Model(*shared.value)
        for texts in batches:
            lang, score = known.scores(texts.tolist())
            yield pd.DataFrame({"lang": pd.Series(lang, dtype=object), "score": np.array(score, float)})

    return identify(F.col(text))


def held_out(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
             max_train: int = MAX_TRAIN, into: str = "langid") -> DataFrame:
    """``docs`` with a struct column ``into`` (lang, score, held_out).

    Learns from labelled rows outside the held-out quarter of the keys.  Null texts and texts
    without a letter are ``und`` with score 0; a null key is not held out; repeated rows get
    the same answer; an empty table gives an empty result; a column named ``into`` is replaced.
    """
    test = F.coalesce(held_out(key), F.lit(False))
    model = train(docs.where(~test), key, text, lang, max_train)
    out = docs.drop(into).withColumn("__p", predict(docs.sparkSession, model, text))
    return out.withColumn(into, F.struct("__p.lang", "__p.score", test.alias("held_out"))).drop("__p")


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", F.col("langid.held_out").alias("held_out"),
                                 F.col("langid.lang").alias("lang_pred"), F.col("langid.score").alias("score"))
