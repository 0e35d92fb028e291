"""Decoding of per-head logits into labels and confidences, and the scorer
plug-in for external models.

The source application scores one text at a time with a transformer and then
applies softmax, argmax and a severity confidence floor.  Here the scorer is
a per-partition factory run by ``mapInPandas`` (model loaded once per task,
Arrow batches in and out) and decoding is plain column arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework import lexicon

HEAD_LABELS: dict[str, list[str]] = {
    "category": list(lexicon.CATEGORIES),
    "severity": list(lexicon.SEVERITIES),
    "emotion": list(lexicon.EMOTIONS),
}


def softmax_columns(logits: Sequence[Column]) -> list[Column]:
    """Numerically stable softmax over a fixed number of logit columns (no lambdas)."""
    m = F.greatest(*logits) if len(logits) > 1 else logits[0]
    ex = [F.exp(x - m) for x in logits]
    total = ex[0]
    for e in ex[1:]:
        total = total + e
    return [e / total for e in ex]


def argmax_index(probs: Sequence[Column]) -> Column:
    """Index of the first maximum."""
    mx = F.greatest(*probs) if len(probs) > 1 else probs[0]
    out = None
    for i, p in enumerate(probs):
        out = F.when(p == mx, F.lit(i)) if out is None else out.when(p == mx, F.lit(i))
    return out


def decode_head(logits: Sequence[Column], labels: Sequence[str], floor: float | None = None,
                floor_label: str = "medium") -> tuple[Column, Column]:
    """(label, confidence 4 dp).  With ``floor``, a top probability below it is
    replaced by ``floor_label`` (when known) and that label's probability is reported."""
    probs = softmax_columns(logits)
    idx = argmax_index(probs)
    if floor is not None and floor_label in labels:
        fi = labels.index(floor_label)
        top = F.greatest(*probs) if len(probs) > 1 else probs[0]
        idx = F.when(top < F.lit(floor), F.lit(fi)).otherwise(idx)
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), idx + 1)
    conf = F.element_at(F.array(*probs), idx + 1)
    return label, F.round(conf, 4)


def decode_heads(df: DataFrame, logit_cols: Mapping[str, str],
                 labels: Mapping[str, Sequence[str]] = HEAD_LABELS,
                 severity_floor: float | None = 0.50) -> DataFrame:
    """Array-of-logits columns -> ``<head>`` label and ``<head>_confidence`` columns."""
    out = df
    for head, col in logit_cols.items():
        labs = list(labels[head])
        lg = [F.col(col).getItem(i).cast("double") for i in range(len(labs))]
        lab, conf = decode_head(lg, labs, severity_floor if head == "severity" else None)
        out = out.withColumn(head, lab).withColumn(f"{head}_confidence", conf)
    return out


ScorerFactory = Callable[[], Callable[[list[str]], Mapping[str, np.ndarray]]]


def score_with(df: DataFrame, text_col: str, scorer_factory: ScorerFactory,
               heads: Mapping[str, int], keep: Sequence[str] = ()) -> DataFrame:
    """Run an external scorer over Arrow batches: one model instance per task.

    ``scorer_factory()`` returns ``f(texts) -> {head: ndarray (n, n_classes)}``.
    Output: ``keep`` columns plus one ``array<double>`` logits column per head.
    """
    keep = list(keep)
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
                       + [f"`{h}_logits` array<double>" for h in heads])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_factory()
        for pdf in batches:
            texts = pdf[text_col].fillna("").astype(str).tolist()
            scores = scorer(texts)
            out = pdf[keep].copy()
            for h, k in heads.items():
                arr = np.asarray(scores[h], dtype="float64").reshape(len(texts), k)
                out[f"{h}_logits"] = list(arr)
            yield out

    return df.select(*keep, text_col).mapInPandas(run, schema)
