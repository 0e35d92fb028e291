"""Registered queries: evaluation reports, head decoding, leaderboards, run registry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from casework.functions import text as T
from casework.operators import evaluate as EV
from casework.operators import heads as H
from casework.plans import sqltext as S
from casework.plans.registry import register
from casework.sources import fixtures as FX
from casework.sources.fixtures import sql_str

# -- deterministic rule predictors over the labelled documents ---------------------
# (fixture models: they make the evaluation queries exactly checkable)

LANG_RULE = [("en", " the "), ("es", " que "), ("de", " und ")]
LANG_FALLBACK = "fr"
QUALITY_MIN_CHARS = 500


def _spark_predictions(df):
    low = F.lower(F.col("text"))
    lang = None
    for lab, kw in LANG_RULE:
        lang = F.when(low.contains(kw), lab) if lang is None else lang.when(low.contains(kw), lab)
    return df.select(
        "doc_id", "lang", "quality", "toxic", "n_chars",
        lang.otherwise(LANG_FALLBACK).alias("pred_lang"),
        F.when(F.col("n_chars") >= QUALITY_MIN_CHARS, "1").otherwise("0").alias("pred_quality"),
        F.when(T.starts_word_any("text", FX.FIXTURE_PROFANITY), "1").otherwise("0").alias("pred_toxic"))


def _sql_predictions() -> str:
    lang = " ".join(f"WHEN contains(lower(text), {sql_str(kw)}) THEN {sql_str(lab)}" for lab, kw in LANG_RULE)
    return (f"SELECT doc_id, lang, quality, toxic, n_chars, CASE {lang} ELSE '{LANG_FALLBACK}' END AS pred_lang, "
            f"CASE WHEN n_chars >= {QUALITY_MIN_CHARS} THEN '1' ELSE '0' END AS pred_quality, "
            f"CASE WHEN {S.prefix_word_any('text', FX.FIXTURE_PROFANITY)} THEN '1' ELSE '0' END AS pred_toxic "
            "FROM labelled")


HEADS = {"lang": ("lang", "pred_lang"), "quality": ("quality", "pred_quality"), "toxic": ("toxic", "pred_toxic")}


def _long(spark, sf_dir):
    return EV.long_form(_spark_predictions(FX.labelled(spark, sf_dir)), HEADS)


def _sql_long() -> str:
    return " UNION ALL ".join(f"SELECT '{h}' AS head, {t} AS truth, {p} AS pred FROM preds"
                              for h, (t, p) in HEADS.items())


def _with_long(sql: str, extra=()) -> str:
    return FX.with_views(sql, names=["labelled"],
                         ctes=[("preds", _sql_predictions()), ("lf", _sql_long()), *extra])


SQL_COUNTS = "SELECT head, truth, pred, count(*) AS n FROM lf GROUP BY ALL"
SQL_CLASSES = "SELECT DISTINCT head, truth AS label FROM lf WHERE truth IS NOT NULL"
SQL_LABELS = (
    "SELECT l.head, l.label, coalesce(tp.n, 0) AS tp, coalesce(pr.n, 0) AS predicted, coalesce(su.n, 0) AS support "
    "FROM (SELECT DISTINCT head, truth AS label FROM pc UNION SELECT DISTINCT head, pred FROM pc) l "
    "LEFT JOIN (SELECT head, truth AS label, n FROM pc WHERE truth = pred) tp ON l.head = tp.head AND l.label = tp.label "
    "LEFT JOIN (SELECT head, pred AS label, sum(n) AS n FROM pc GROUP BY ALL) pr ON l.head = pr.head AND l.label = pr.label "
    "LEFT JOIN (SELECT head, truth AS label, sum(n) AS n FROM pc GROUP BY ALL) su ON l.head = su.head AND l.label = su.label "
    "WHERE l.label IS NOT NULL")
SQL_METRICS = ("SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision, "
               "CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall, "
               "CASE WHEN predicted + support = 0 THEN 0.0 ELSE 2 * tp / (predicted + support) END AS f1 FROM lab")


@register("accuracy_heads", lambda: _with_long(
    "SELECT head, round(avg(CASE WHEN truth IS NOT DISTINCT FROM pred THEN 1.0 ELSE 0.0 END), 4) AS accuracy, "
    "count(*) AS n FROM lf GROUP BY head"))
def accuracy_heads(spark, sf_dir):
    return EV.accuracy(_long(spark, sf_dir))


@register("confusion", lambda: _with_long(
    "SELECT g.head, g.truth, g.pred, CAST(coalesce(pc.n, 0) AS BIGINT) AS n FROM "
    "(SELECT a.head, a.label AS truth, b.label AS pred FROM cl a JOIN cl b ON a.head = b.head) g "
    "LEFT JOIN pc ON g.head = pc.head AND g.truth = pc.truth AND g.pred = pc.pred",
    extra=[("pc", SQL_COUNTS), ("cl", SQL_CLASSES)]))
def confusion(spark, sf_dir):
    counts = EV.pair_counts(_long(spark, sf_dir))
    return EV.confusion(counts, EV.classes_from_counts(counts))


@register("per_class", lambda: _with_long(
    "SELECT cl.head, cl.label AS class, round(coalesce(m.precision, 0), 4) AS precision, "
    "round(coalesce(m.recall, 0), 4) AS recall, round(coalesce(m.f1, 0), 4) AS f1_score, "
    "CAST(coalesce(m.support, 0) AS BIGINT) AS support FROM cl LEFT JOIN m ON cl.head = m.head AND cl.label = m.label",
    extra=[("pc", SQL_COUNTS), ("cl", SQL_CLASSES), ("lab", SQL_LABELS), ("m", SQL_METRICS)]))
def per_class(spark, sf_dir):
    counts = EV.pair_counts(_long(spark, sf_dir))
    return EV.per_class(counts, EV.classes_from_counts(counts))


@register("weighted_f1", lambda: _with_long(
    "SELECT head, round(coalesce(sum(f1 * support) / sum(support), 0), 4) AS f1_weighted FROM m GROUP BY head",
    extra=[("pc", SQL_COUNTS), ("lab", SQL_LABELS), ("m", SQL_METRICS)]))
def weighted_f1(spark, sf_dir):
    return EV.weighted_f1(EV.pair_counts(_long(spark, sf_dir)))


# -- M10: decode per-head logits (fixture: slices of the embedding vectors) ---------

SEV_SCALE = 8.0


def _sql_decode() -> str:
    def head(name, idx, scale=1.0, floor=None):
        labels = H.HEAD_LABELS[name]
        lg = [f"(CAST(embedding[{i + 1}] AS DOUBLE) * {scale})" for i in idx]
        m = f"greatest({', '.join(lg)})"
        ex = [f"exp({x} - {m})" for x in lg]
        tot = " + ".join(ex)
        probs = [f"({e}) / ({tot})" for e in ex]
        top = f"greatest({', '.join(probs)})"
        am = "CASE " + " ".join(f"WHEN {p} = {top} THEN {i}" for i, p in enumerate(probs)) + " END"
        if floor is not None:
            am = f"CASE WHEN {top} < {floor} THEN {labels.index('medium')} ELSE {am} END"
        lab = "CASE " + " ".join(f"WHEN ({am}) = {i} THEN {sql_str(x)}" for i, x in enumerate(labels)) + " END"
        conf = "CASE " + " ".join(f"WHEN ({am}) = {i} THEN {p}" for i, p in enumerate(probs)) + " END"
        return f"{lab} AS {name}, round({conf}, 4) AS {name}_confidence"
    return ("SELECT vec_id, " + head("category", range(0, 3)) + ", "
            + head("severity", range(3, 7), SEV_SCALE, 0.5) + ", " + head("emotion", range(7, 11))
            + " FROM embeddings")


@register("decode_heads", _sql_decode)
def decode_heads(spark, sf_dir):
    """Softmax + argmax per head; severity floor 0.50 falls back to 'medium'."""
    e = FX.vectors(spark, sf_dir)
    v = F.col("vector")
    logits = e.select(
        F.col("id").alias("vec_id"),
        F.array(*[v.getItem(i) for i in range(0, 3)]).alias("cat_logits"),
        F.array(*[v.getItem(i).cast("double") * SEV_SCALE for i in range(3, 7)]).alias("sev_logits"),
        F.array(*[v.getItem(i) for i in range(7, 11)]).alias("emo_logits"))
    out = H.decode_heads(logits, {"category": "cat_logits", "severity": "sev_logits", "emotion": "emo_logits"})
    return out.drop("cat_logits", "sev_logits", "emo_logits")


# -- B6, O6, A9, S10: leaderboard over rule models ---------------------------------
# Results table derived from the labelled documents: three deterministic
# "models" per task, scored on the test side of the stratified split.

RULE_MODELS = {"keyword_rule": "rule", "majority": "majority", "first_label": "first_label"}


def _rule_results(spark, sf_dir):
    """All task x model metrics from one grouped count of (model, task, truth, pred)."""
    from casework.operators import sampling as SM
    p = _spark_predictions(FX.labelled(spark, sf_dir))
    per_task = F.explode(F.array(*[F.struct(F.lit(task).alias("task"), F.col(t).alias("truth"),
                                            F.col(pr).alias("rule"))
                                   for task, (t, pr) in HEADS.items()])).alias("_r")
    long = p.select("doc_id", per_task).select("doc_id", "_r.*")
    test = SM.stratified_split(long, "task", "doc_id", 20).where(F.col("split") == "test")
    # per-task baselines: majority class (ties: smallest label) and the first label
    tc = test.groupBy("task", "truth").agg(F.count(F.lit(1)).alias("c"))
    base = tc.groupBy("task").agg(F.min_by("truth", F.struct(-F.col("c"), F.col("truth"))).alias("majority"),
                                  F.min("truth").alias("first_label"))
    j = test.join(F.broadcast(base), "task")       # one row per task
    preds = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("pred"))
                                for m, c in RULE_MODELS.items()])).alias("_m")
    lf = j.select("task", "truth", preds).select(
        F.concat_ws("|", F.col("_m.model"), F.col("task")).alias("head"), "truth", F.col("_m.pred").alias("pred"))
    counts = EV.pair_counts(lf).cache()
    acc = EV.accuracy_from_counts(counts)
    f1 = EV.weighted_f1(counts)
    out = acc.join(f1, "head")
    return out.select(F.split("head", "[|]").getItem(1).alias("task"), F.split("head", "[|]").getItem(0).alias("model"),
                      "accuracy", "f1_weighted", F.col("n").alias("n_test"), F.lit("rule").alias("type"))


def _sql_rule_results() -> str:
    return f"""
t AS ({' UNION ALL '.join(f"SELECT '{h}' AS task, doc_id, {tr} AS truth, {pr} AS rule FROM preds" for h, (tr, pr) in HEADS.items())}),
ts AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY task ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id)
        <= (count(*) OVER (PARTITION BY task) * 20 + 99) // 100),
mj AS (SELECT task, arg_min(truth, (-c, truth)) AS majority FROM (SELECT task, truth, count(*) AS c FROM ts GROUP BY ALL) GROUP BY task),
fl AS (SELECT task, min(truth) AS first_label FROM ts GROUP BY task),
x AS (SELECT ts.*, mj.majority, fl.first_label FROM ts JOIN mj USING (task) JOIN fl USING (task)),
lf AS ({' UNION ALL '.join(f"SELECT '{m}' AS model, task, truth, {c} AS pred FROM x" for m, c in (('keyword_rule', 'rule'), ('majority', 'majority'), ('first_label', 'first_label')))}),
pc AS (SELECT model, task, truth, pred, count(*) AS n FROM lf GROUP BY ALL),
labs AS (SELECT DISTINCT model, task, truth AS label FROM pc UNION SELECT DISTINCT model, task, pred FROM pc),
lab AS (SELECT l.model, l.task, l.label, coalesce((SELECT sum(n) FROM pc WHERE pc.model = l.model AND pc.task = l.task AND pc.truth = l.label AND pc.pred = l.label), 0) AS tp,
          coalesce((SELECT sum(n) FROM pc WHERE pc.model = l.model AND pc.task = l.task AND pc.pred = l.label), 0) AS predicted,
          coalesce((SELECT sum(n) FROM pc WHERE pc.model = l.model AND pc.task = l.task AND pc.truth = l.label), 0) AS support
        FROM labs l WHERE l.label IS NOT NULL),
f AS (SELECT model, task, round(coalesce(sum((CASE WHEN predicted + support = 0 THEN 0.0 ELSE 2 * tp / (predicted + support) END) * support) / sum(support), 0), 4) AS f1_weighted FROM lab GROUP BY ALL),
a AS (SELECT model, task, round(avg(CASE WHEN truth IS NOT DISTINCT FROM pred THEN 1.0 ELSE 0.0 END), 4) AS accuracy, count(*) AS n_test FROM lf GROUP BY ALL),
results AS (SELECT a.task, a.model, a.accuracy, f.f1_weighted, a.n_test, 'rule' AS type FROM a JOIN f USING (model, task))"""


def _with_results(sql: str) -> str:
    return FX.with_views("", names=["labelled"], ctes=[("preds", _sql_predictions())]).rstrip("\n") \
        + "," + _sql_rule_results() + "\n" + sql


@register("bench_results", lambda: _with_results("SELECT * FROM results"))
def bench_results(spark, sf_dir):
    """task x model: accuracy, weighted F1, test rows (held-out side of the split)."""
    return _rule_results(spark, sf_dir)


@register("leaderboard", lambda: _with_results(
    "SELECT model, round(avg(accuracy), 4) AS avg_accuracy, count(*) AS n_tasks FROM results GROUP BY model"))
def leaderboard(spark, sf_dir):
    r = _rule_results(spark, sf_dir)
    return r.groupBy("model").agg(F.round(F.avg("accuracy"), 4).alias("avg_accuracy"),
                                  F.count(F.lit(1)).cast("long").alias("n_tasks"))


@register("best_per_task", lambda: _with_results(
    "SELECT task, model, accuracy, f1_weighted FROM results "
    "QUALIFY row_number() OVER (PARTITION BY task ORDER BY accuracy DESC, model) = 1"))
def best_per_task(spark, sf_dir):
    r = _rule_results(spark, sf_dir)
    w = Window.partitionBy("task").orderBy(F.col("accuracy").desc(), F.col("model"))
    return r.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(
        "task", "model", "accuracy", "f1_weighted")


# -- M14, O3: run registry ------------------------------------------------------------
# One "training run" per document source: accuracies of the rule model on that
# source's labelled documents, recorded at the source's own time.

def _sql_runs() -> str:
    acc = ", ".join(f"round(avg(CASE WHEN {t} = {p} THEN 1.0 ELSE 0.0 END), 4) AS {h}_accuracy"
                    for h, (t, p) in HEADS.items())
    return FX.with_views(
        f"SELECT 'run-' || source AS id, {acc}, count(*) AS training_samples, "
        "TIMESTAMP '2024-01-01' + CAST(substr(source, 4) AS BIGINT) * INTERVAL 1 DAY AS created_at, "
        "row_number() OVER (ORDER BY TIMESTAMP '2024-01-01' + CAST(substr(source, 4) AS BIGINT) * INTERVAL 1 DAY DESC, "
        "'run-' || source) = 1 AS is_active FROM preds JOIN (SELECT doc_id, source FROM documents) d "
        "USING (doc_id) GROUP BY source",
        names=["labelled"], ctes=[("preds", _sql_predictions())])


@register("model_runs", _sql_runs)
def model_runs(spark, sf_dir):
    """Append-only run log; ``is_active`` is derived (newest run), never updated in place."""
    from casework.session import read_table
    p = _spark_predictions(FX.labelled(spark, sf_dir)).join(
        read_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    accs = [F.round(F.avg((F.col(t) == F.col(pr)).cast("double")), 4).alias(f"{h}_accuracy")
            for h, (t, pr) in HEADS.items()]
    runs = p.groupBy("source").agg(*accs, F.count(F.lit(1)).cast("long").alias("training_samples"))
    runs = runs.select(
        F.concat(F.lit("run-"), F.col("source")).alias("id"), *[f"{h}_accuracy" for h in HEADS],
        "training_samples",
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + CAST(substr(source, 4) AS BIGINT) * INTERVAL '1' DAY")
        .alias("created_at"))
    from casework.operators.models import mark_active
    return mark_active(runs)


# -- V12, V13: which heads can be trained --------------------------------------------

GUARD_HEADS = ("category", "severity", "emotion")


@register("train_guard", lambda: FX.with_views(" UNION ALL ".join(
    f"SELECT '{h}' AS task, count(*) AS n_valid, count(DISTINCT {h}) AS n_classes, "
    f"count(DISTINCT {h}) >= 2 AND count(*) >= 20 AS trainable FROM cases "
    f"WHERE complaint_text IS NOT NULL AND {h} IS NOT NULL AND trim({h}) <> ''" for h in GUARD_HEADS),
    names=["cases"]))
def train_guard(spark, sf_dir):
    from casework.operators.models import task_guard
    return task_guard(FX.cases(spark, sf_dir), "complaint_text", GUARD_HEADS)
