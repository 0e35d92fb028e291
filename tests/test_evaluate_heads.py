"""Evaluation metrics and logit decoding."""

import math

from pyspark.sql import functions as F

from casework.operators import evaluate as EV
from casework.operators import heads as H

from .conftest import rows


def test_class_never_predicted_scores_zero(spark):
    data = [("a", "a"), ("a", "a"), ("b", "a"), ("c", "c")]
    lf = EV.long_form(spark.createDataFrame(data, "t string, p string"), {"h": ("t", "p")})
    rep = EV.head_report(lf)
    pc = {r[1]: r[2:] for r in rows(rep["per_class"])}
    assert pc["b"] == (0.0, 0.0, 0.0, 1)
    assert pc["a"] == (round(2 / 3, 4), 1.0, 0.8, 2)
    assert rows(rep["accuracy"], "accuracy") == [(0.75,)]
    cm = {(t, p): n for _, t, p, n in rows(rep["confusion"])}
    assert len(cm) == 9 and cm[("b", "a")] == 1 and cm[("b", "b")] == 0
    # weighted F1 = (2*0.8 + 1*0 + 1*1) / 4
    assert rows(rep["weighted_f1"], "f1_weighted") == [(round((2 * 0.8 + 1.0) / 4, 4),)]


def _decode(spark, sev_logits):
    df = spark.createDataFrame([(sev_logits,)], "s array<double>")
    return H.decode_heads(df, {"severity": "s"}).first()


def test_severity_floor(spark):
    # probabilities [0.49, 0.17, 0.17, 0.17] -> floor applies: medium with its own probability
    p = [0.49, 0.17, 0.17, 0.17]
    r = _decode(spark, [math.log(x) for x in p])
    assert r["severity"] == "medium" and r["severity_confidence"] == 0.17
    p = [0.50, 0.2, 0.2, 0.1]
    r = _decode(spark, [math.log(x) for x in p])
    assert r["severity"] == "low" and r["severity_confidence"] == 0.5


def test_argmax_first_of_ties(spark):
    df = spark.createDataFrame([([1.0, 1.0, 0.0],)], "c array<double>")
    r = H.decode_heads(df, {"category": "c"}).first()
    assert r["category"] == "ATM_FAILURE"


def test_external_scorer_factory(spark):
    import numpy as np

    def factory():
        def score(texts):
            n = len(texts)
            return {"category": np.tile([0.0, 2.0, 0.0], (n, 1))}
        return score

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    out = H.score_with(df, "t", factory, {"category": 3}, keep=["id"])
    dec = H.decode_heads(out, {"category": "category_logits"})
    assert sorted(rows(dec, "id", "category")) == [(1, "FRAUD_DETECTION"), (2, "FRAUD_DETECTION")]
