"""Token, n-gram, vocabulary and TF-IDF features in long form.

Weights follow the source application's vectoriser settings: vocabulary = the
``max_features`` terms with the highest corpus term frequency (ties by term)
among terms with ``df >= min_df``; ``idf = ln((1+n)/(1+df)) + 1`` (smooth);
``tf = 1 + ln(count)`` (sublinear); rows L2-normalised over vocabulary terms.
Spark ML's ``IDF`` omits the ``+1`` and its TF is raw, hence the SQL form.

Plan shape: terms are counted where a text is read, so no text is shuffled; document
frequencies are one map-side combined aggregate by term, and every term gets a dense number by
ranges (``dense_index``), however many there are.  A vocabulary of at most ``BROADCAST_MAX_TERMS``
terms is broadcast to the weights (this changes the plan, not the rows); any other is joined by key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casework import lexicon
from casework.functions import text as T
from casework.session import written


def stop_words() -> tuple[str, ...]:
    """Spark ML's English stop-word list (a fixed value of the lexicon).

    It is not the list the source application's library used (that one is not
    available here); pass your own list to match it exactly.
    """
    return tuple(lexicon.ENGLISH_STOP_WORDS)


@dataclass(frozen=True)
class TermSpec:
    """How text becomes terms."""
    stop_words: Sequence[str] = ()
    bigrams: bool = False
    clean: bool = False          # apply the cleaner before tokenising

    def tokens(self, text_col) -> F.Column:
        """Unigram tokens after cleaning and stop-word removal."""
        if self.clean:
            toks = T.clean_tokens(text_col)
        else:
            toks = T.tokens(F.col(text_col) if isinstance(text_col, str) else text_col)
        return T.drop_words(toks, self.stop_words) if self.stop_words else toks

    def terms_from_tokens(self, toks) -> F.Column:
        return T.uni_and_bigrams(toks) if self.bigrams else toks

    def terms(self, text_col) -> F.Column:
        return self.terms_from_tokens(self.tokens(text_col))


def repeated_ids(docs: DataFrame, id_col: str) -> DataFrame | None:
    """(id) of the ids that several rows share, null counted as one; None where every row has its own."""
    many = written(docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(id_col), "repeated-ids")
    return None if many.isEmpty() else many


def by_id(docs: DataFrame, many: DataFrame, id_col: str, how: str) -> DataFrame:
    """Rows of ``docs`` whose id is among ``many`` (``left_semi``) or is not (``left_anti``); null meets null."""
    m = many.select(F.col(id_col).alias("_many"))
    return docs.join(m, F.col(id_col).eqNullSafe(F.col("_many")), how)


def row_term_counts(docs: DataFrame, id_col: str, text_col: str, spec: TermSpec) -> DataFrame:
    """(id, term, tf): the distinct terms of each row, counted in the row by the runs of its sorted terms."""
    # explode_outer: a plain explode makes the optimizer add a size(terms) > 0 filter that recomputes the
    # whole tokenising expression; tokens and terms are staged, since the steps after read them several times
    toks = docs.select(id_col, spec.tokens(text_col).alias("_toks"))
    rows = toks.select(id_col, F.explode_outer(F.array(F.sort_array(spec.terms_from_tokens(F.col("_toks"))))).alias("_terms"))
    terms, n = F.col("_terms"), F.size("_terms")
    runs = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1)))
    rows = rows.where(n > 0).select(id_col, "_terms", runs.alias("_runs"))
    counted = F.transform("_runs", lambda i, j: F.struct(
        F.get(F.col("_terms"), i).alias("term"),
        (F.coalesce(F.get(F.col("_runs"), j + 1), F.size("_terms")) - i).cast("long").alias("tf")))
    return rows.select(id_col, F.explode(counted).alias("_c")).select(id_col, "_c.term", "_c.tf")


def doc_term_counts(docs: DataFrame, id_col: str, text_col: str, spec: TermSpec) -> DataFrame:
    """(id, term, tf): one row per distinct term of each document.

    A row with an id of its own is counted where it is read and nothing is shuffled; only the terms of rows
    that share an id are brought together.
    """
    many = repeated_ids(docs, id_col)
    if many is None:
        return row_term_counts(docs, id_col, text_col, spec)
    shared = (row_term_counts(by_id(docs, many, id_col, "left_semi"), id_col, text_col, spec)
              .groupBy(id_col, "term").agg(F.sum("tf").cast("long").alias("tf")))
    return row_term_counts(by_id(docs, many, id_col, "left_anti"), id_col, text_col, spec).unionByName(shared)


def dense_index(df: DataFrame, keys: Sequence[str], name: str, out: str = "idx") -> DataFrame:
    """``df`` with dense numbers from 0 in the order of ``keys``, without one global window.

    Rows are sorted by ranges and written with their place in the range; the ranges' counts (one row
    for each shuffle partition) are summed to offsets and broadcast.
    """
    at, part = F.col("_at"), F.shiftright("_at", 33)
    ordered = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                      .withColumn("_at", F.monotonically_increasing_id()), name)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ordered.groupBy(part.alias("_range")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
               .select("_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return (ordered.join(F.broadcast(offsets), part == F.col("_range"))
            .withColumn(out, F.col("_before") + at - F.col("_first")).drop("_at", "_range", "_first", "_before"))


def fit_vocabulary(tc: DataFrame, n_docs: int, max_features: int | None, min_df: int = 1,
                   id_col: str = "doc_id", numbered: bool = True) -> DataFrame:
    """(term, idx, df, ttf, idf).  ``idx``: dense numbers from 0 in sorted term order, with or without
    a cap (``max_features``: the terms of the highest corpus frequency, at most that many); null
    where no numbers are asked for."""
    stats = tc.groupBy("term").agg(F.count(F.lit(1)).cast("long").alias("df"),
                                   F.sum("tf").cast("long").alias("ttf"))
    if min_df > 1:
        stats = stats.where(F.col("df") >= min_df)
    if max_features:
        stats = stats.orderBy(F.col("ttf").desc(), F.col("term")).limit(max_features)
    stats = dense_index(stats, ["term"], "vocabulary") if numbered else stats.withColumn("idx", F.lit(None).cast("long"))
    idf = F.log((F.lit(1.0) + F.lit(float(n_docs))) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return stats.withColumn("idf", idf).select("term", "idx", "df", "ttf", "idf")


# A capped vocabulary has at most this many rows (~100 bytes each) and is
# broadcast; an uncapped one grows with the corpus and is joined by key.
BROADCAST_MAX_TERMS = 200_000


def tfidf_weights(tc: DataFrame, vocab: DataFrame, id_col: str = "doc_id",
                  max_terms: int | None = None) -> DataFrame:
    """(id, term, idx, weight) with L2-normalised sublinear tf-idf weights.

    ``max_terms``: the vocabulary's row bound (its ``max_features``), if any.
    Only a vocabulary with a known bound is broadcast; otherwise the join is
    left to the planner (shuffle on term, AQE splits hot terms).
    """
    v = vocab.select("term", "idx", "idf")
    bounded = max_terms is not None and max_terms <= BROADCAST_MAX_TERMS
    j = tc.join(F.broadcast(v) if bounded else v, "term", "inner")
    w = (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf")
    j = j.withColumn("_w", w)
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    # fresh aliases: the same vocabulary may weight both sides of a later cogroup / join
    return j.select(F.col(id_col).alias(id_col), F.col("term").alias("term"), F.col("idx").alias("idx"),
                    (F.col("_w") / norm).alias("weight"))


def corpus_tfidf(docs: DataFrame, id_col: str, text_col: str, spec: TermSpec,
                 max_features: int | None = None, min_df: int = 1,
                 numbered: bool = True) -> tuple[DataFrame, DataFrame]:
    """Fit on ``docs`` and weight them: returns (vocabulary, weights).

    ``n_docs`` is one driver-side scalar count.
    """
    n_docs = docs.count()
    # read twice (vocabulary, weights): written, so that neither re-tokenises and nothing stays cached
    tc = written(doc_term_counts(docs, id_col, text_col, spec), "term-counts")
    vocab = fit_vocabulary(tc, n_docs, max_features, min_df, id_col, numbered)
    return vocab, tfidf_weights(tc, vocab, id_col, max_features)
