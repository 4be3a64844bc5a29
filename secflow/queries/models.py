"""Model training, scores and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from secflow.operators.sampling import hash_rank_split
from secflow.plans import evaluation as ev
from secflow.plans import features as ft
from secflow.plans import forest
from secflow.plans.detection import first_rows, with_scalar
from secflow.queries import tables as t
from secflow.queries.behaviour import NORMED, _PAIRS, standardized
from secflow.queries.campaigns import light
from secflow.queries.registry import Section
from secflow.queries.scoring import evidence
from secflow.settings import checkpointed
from secflow.sources.telemetry import telemetry

section = Section()
_TEL = t.with_(t.TEL)


def scored(spark, sf):
    return telemetry(spark, sf).selectExpr("event_id", "ts", "anomaly_score as score", "label", "attack_cat as category")


def normed(spark, sf):
    return standardized(spark, sf)


def forest_scores(rows, names):
    """The rows with the score of a forest over ``names``, fitted on every other benign one."""
    model = forest.fit(rows.where("label = 0 and event_id % 2 = 0"), list(names))
    return forest.score(rows, model, list(names)).withColumn("forest_score", F.round("forest_score", 6))


def ml_iforest(spark, sf, names=tuple(ft.FEATURES)):
    rows = checkpointed(normed(spark, sf))
    return forest_scores(rows, names).selectExpr("event_id", "label", "attack_cat", "forest_score as anomaly_score")


section.add("ml_iforest", ml_iforest)


def ml_feature_ablation(spark, sf):
    """Forest with and without the temporal features, compared by confusion at 0.55 and ROC area.

    The features serve both forests, and the scores of a forest both measures.
    """
    out, both = None, checkpointed(normed(spark, sf))
    for name, names in (("all", ft.FEATURES), ("without_time", [f for f in ft.FEATURES if f not in ft.TEMPORAL])):
        scores = forest_scores(both.select("event_id", "label", *names), names)
        rows = checkpointed(scores.selectExpr("label", "forest_score as score"))
        part = with_scalar(ev.confusion_at(rows, 0.55), ev.roc_auc(rows)).withColumn("features", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


section.add("ml_feature_ablation", ml_feature_ablation)
section.add("ml_threshold_p99", lambda spark, sf: ev.suggested_threshold(scored(spark, sf).where("label = 0")).selectExpr("round(threshold, 6) as threshold"),
            f"{_TEL} SELECT round(greatest(quantile_cont(anomaly_score, 0.99), 0.5), 6) AS threshold FROM tel WHERE label = 0")


def ml_benign_split(spark, sf):
    rows = hash_rank_split(scored(spark, sf), "split", 0.5)
    return rows.selectExpr("event_id", "if(label = 0 and in_train, 'train', 'test') as split", "label")


section.add("ml_benign_split", ml_benign_split, f"""{_TEL} SELECT event_id, CASE WHEN label = 0 AND ('0x' || substr(md5('split' || event_id), 1, 7))::BIGINT % 10000 < 5000 THEN 'train' ELSE 'test' END AS split, label FROM tel""")
STRAT = """str AS MATERIALIZED (SELECT event_id, anomaly_score AS score, label, CASE WHEN i < trunc(n * 0.5) THEN 'train' WHEN i < trunc(n * 0.5) + trunc(n * 0.25) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(event_id::VARCHAR), event_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM tel))"""
section.add("ml_stratified_split", lambda spark, sf: ev.stratified_split(scored(spark, sf)).select("event_id", "label", "split"),
            f"{t.with_(t.TEL, STRAT)} SELECT event_id, label, split FROM str")


def _metric_sql(source: str, extra: str = "", digits: int = 4, undefined: str = "0") -> str:
    return f"""SELECT {extra}tp, fp, tn, fn, round(p, {digits}) AS precision, round(r, {digits}) AS recall, round(CASE WHEN p IS NULL OR r IS NULL THEN {undefined} WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END::DOUBLE, {digits}) AS f1,
round(CASE WHEN fp + tn = 0 THEN {undefined} ELSE fp / (fp + tn) END::DOUBLE, {digits}) AS fpr, round(CASE WHEN fp + tn = 0 THEN {undefined} ELSE tn / (fp + tn) END::DOUBLE, {digits}) AS specificity, round((tp + tn) / (tp + fp + tn + fn), {digits}) AS accuracy
FROM (SELECT *, CASE WHEN tp + fp = 0 THEN {undefined} ELSE tp / (tp + fp) END::DOUBLE AS p, CASE WHEN tp + fn = 0 THEN {undefined} ELSE tp / (tp + fn) END::DOUBLE AS r FROM {source})"""


def _counts(flag: str) -> str:
    return f"count(*) FILTER (WHERE {flag} AND label = 1) AS tp, count(*) FILTER (WHERE {flag} AND label = 0) AS fp, count(*) FILTER (WHERE NOT ({flag}) AND label = 0) AS tn, count(*) FILTER (WHERE NOT ({flag}) AND label = 1) AS fn"


section.add("ml_confusion", lambda spark, sf: ev.confusion_at(scored(spark, sf), 0.602),
            f"{_TEL} {_metric_sql('(SELECT ' + _counts('anomaly_score >= 0.602') + ' FROM tel)')}")
_CURVE = """g AS (SELECT anomaly_score AS score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM tel GROUP BY 1),
cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, row_number() OVER (ORDER BY score DESC) - 1 AS rank, (SELECT sum(pos) FROM g) AS np, (SELECT sum(neg) FROM g) AS nn, (SELECT count(*) FROM g) AS npt FROM g WINDOW w AS (ORDER BY score DESC))"""
_CUR = t.with_(t.TEL, _CURVE)


def ml_roc_auc(spark, sf):
    return ev.roc_auc(scored(spark, sf)).selectExpr("round(roc_auc, 8) as roc_auc")


section.add("ml_roc_auc", ml_roc_auc, f"""{_CUR} SELECT round(sum((fp - pf) / nn * (tp + pt) / np / 2), 8) AS roc_auc FROM (SELECT *, coalesce(lag(fp) OVER (ORDER BY rank), 0) AS pf, coalesce(lag(tp) OVER (ORDER BY rank), 0) AS pt FROM cu)""")
section.add("ml_roc_points", lambda spark, sf: ev.roc_points(scored(spark, sf)).selectExpr("rank", "score", "round(fpr, 8) as fpr", "round(tpr, 8) as tpr"),
            f"{_CUR} SELECT rank, score, round(fp / nn, 8) AS fpr, round(tp / np, 8) AS tpr FROM cu")
section.add("ml_pr_auc", lambda spark, sf: ev.average_precision(scored(spark, sf)).selectExpr("round(average_precision, 8) as average_precision"),
            f"{_CUR} SELECT round(sum(pos / np * tp / (tp + fp)), 8) AS average_precision FROM cu")
section.add("ml_curve_subsample", lambda spark, sf: ev.thinned(ev.roc_points(scored(spark, sf)), 30).selectExpr("rank", "score", "round(fpr, 8) as fpr"),
            f"{_CUR} SELECT rank, score, round(fp / nn, 8) AS fpr FROM cu WHERE rank IN (SELECT (i * npt) // 30 FROM range(30) r(i), (SELECT DISTINCT npt FROM cu))")
section.add("ml_category_recall", lambda spark, sf: ev.category_recall(scored(spark, sf), 0.5),
            f"{_TEL} SELECT attack_cat AS category, count(*) AS total, count(*) FILTER (WHERE anomaly_score >= 0.5) AS detected, round(count(*) FILTER (WHERE anomaly_score >= 0.5) / count(*), 4) AS recall FROM tel WHERE label = 1 GROUP BY 1")
_P = [50.0, 75.0, 90.0, 95.0, 97.5, 99.0, 99.5]


def ml_sweep_percentiles(spark, sf):
    rows = scored(spark, sf)
    points = ev.percentiles(rows, _P)
    return ev.sweep(rows, points).join(points, "threshold").selectExpr("percent", "round(threshold, 4) as threshold", "tp", "fp", "round(precision, 4) as precision", "round(recall, 4) as recall", "round(f1, 4) as f1", "round(fpr, 4) as fpr")


def _sweep_sql(percents):
    body = "(SELECT percent, threshold, " + _counts("score >= threshold") + " FROM th, (SELECT anomaly_score AS score, label FROM tel) GROUP BY ALL)"
    th = "th AS (SELECT unnest([" + ", ".join(str(p) for p in percents) + "])::DOUBLE AS percent, unnest((SELECT quantile_cont(anomaly_score, [" + ", ".join(str(p / 100) for p in percents) + "]) FROM tel)) AS threshold)"
    return th, _metric_sql(body, "percent, threshold, ", 6)


_TH, _SW = _sweep_sql(_P)
section.add("ml_sweep_percentiles", ml_sweep_percentiles, f"""{t.with_(t.TEL, _TH)} SELECT percent, round(threshold, 4) AS threshold, tp, fp, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, round(fpr, 4) AS fpr FROM ({_SW})""")
_Q = [50 + 2.5 * i for i in range(20)]
_TH2, _SW2 = _sweep_sql(_Q)
section.add("ml_pick_f1", lambda spark, sf: ev.best_f1(scored(spark, sf), _Q).selectExpr("round(threshold, 6) as threshold", "round(f1, 6) as f1"),
            f"{t.with_(t.TEL, _TH2)} SELECT round(threshold, 6) AS threshold, f1 FROM ({_SW2}) ORDER BY f1 DESC, percent LIMIT 1")


def ml_pick_youden(spark, sf):
    split = ev.stratified_split(scored(spark, sf))
    return ev.youden_choice(split.where("split = 'validation'"), split.where("split = 'test'"))


section.add("ml_pick_youden", ml_pick_youden, f"""{t.with_(t.TEL, STRAT, "cand AS (SELECT round(score, 3) AS u FROM str WHERE split = 'validation' UNION SELECT round(i / 100, 3) FROM range(101) r(i))",
"cr AS (SELECT u, round(count(*) FILTER (WHERE score >= u AND label = 0) / count(*) FILTER (WHERE label = 0), 4) AS fpr, round(count(*) FILTER (WHERE score >= u AND label = 1) / count(*) FILTER (WHERE label = 1), 4) AS rec FROM cand, (SELECT * FROM str WHERE split = 'validation') GROUP BY u)",
"best AS (SELECT u AS threshold, fpr < 0.15 AND rec > 0.6 AS feasible FROM cr ORDER BY feasible DESC, round(rec - fpr, 6) DESC, u LIMIT 1)")}
{_metric_sql("(SELECT threshold, feasible, " + _counts("score >= threshold") + " FROM best, (SELECT * FROM str WHERE split = 'test') GROUP BY ALL)", "threshold, feasible, ")}""")
section.add("ml_sweep_fixed", lambda spark, sf: ev.sweep(scored(spark, sf), spark.range(50, 100).selectExpr("id / 100D as threshold")).selectExpr("threshold", "tp", "fp", "tn", "fn", "f1", "fpr"),
            f"""{_TEL} SELECT threshold, tp, fp, tn, fn, f1, fpr FROM ({_metric_sql("(SELECT threshold, " + _counts("score >= threshold") + " FROM (SELECT i / 100 AS threshold FROM range(50, 100) r(i)), (SELECT anomaly_score AS score, label FROM tel) GROUP BY ALL)", "threshold, ", 6)})""")


def ml_ablation(spark, sf):
    return ev.ablation(evidence(spark, sf)).selectExpr(
        "config", "tp", "fp", "tn", "fn", "precision", "recall", "f1", "fpr", "round(max_score, 3) as max_score", "round(mean_score, 3) as mean_score", "above_half", "scenarios_found", "scenarios", "blind")


_ARMS = " UNION ALL ".join(
    f"SELECT '{n}' AS config, label, attack_cat, least(100, coalesce(behaviour_score, 0) * 0.6" + (" + CASE WHEN n_rules > 0 THEN 50 ELSE 0 END" if r else "")
    + (" + greatest(0, (anomaly_score - 0.602) * 40)" if m else "") + (" + CASE WHEN sequences <> '' THEN 30 ELSE 0 END" if s and r else "") + ")::DOUBLE AS score FROM ev"
    for n, r, m, s in ev.CONFIGURATIONS)
section.add("ml_ablation", ml_ablation, f"""{t.evidence_base(f"ab AS MATERIALIZED ({_ARMS})", "abc AS (SELECT config, " + _counts("score >= 50") + ", max(score) AS mx, avg(score) AS av, count(*) FILTER (WHERE score >= 25) AS above_half FROM ab GROUP BY 1)",
"abs AS (SELECT config, count(*) FILTER (WHERE d > 0) AS scenarios_found, count(*) AS scenarios FROM (SELECT config, attack_cat, count(*) FILTER (WHERE score >= 50) AS d FROM ab WHERE label = 1 GROUP BY ALL) GROUP BY 1)")}
SELECT config, tp, fp, tn, fn, precision, recall, f1, fpr, round(mx, 3) AS max_score, round(av, 3) AS mean_score, above_half, scenarios_found, scenarios, mx < 50 AS blind FROM ({_metric_sql("abc", "config, mx, av, above_half, ", 4, "NULL")}) JOIN abs USING (config)""")
section.add("ml_fp_cause", lambda spark, sf: ev.false_positive_causes(evidence(spark, sf)), f"""{t.evidence_base()} SELECT CASE WHEN n_rules > 0 THEN 'rule:' || split_part(rules, ',', 1) WHEN sequences <> '' THEN 'sequence' WHEN anomaly_score >= 0.5 THEN 'model' ELSE 'unclear' END AS cause, attack_cat, count(*) AS n
FROM ev WHERE label = 0 AND hybrid_score >= 50 GROUP BY ALL""")


def ml_error_samples(spark, sf):
    rows = normed(spark, sf).selectExpr("event_id", "label", *[f"round({n}, 6) as {n}" for n in ft.FEATURES])
    # Read for the errors and for the calm rows, so the features are made once.
    named = checkpointed(rows.join(scored(spark, sf).select("event_id", "score"), "event_id").selectExpr(
        "event_id", "score", "case when score >= 0.6 then if(label = 1, 'TP', 'FP') else if(label = 1, 'FN', 'TN') end as cell",
        f"array_join(transform({ft.top_features()}, x -> x.name), ',') as top3"))
    calm = first_rows(named.where("cell = 'TN'"), ["cell"], [F.col("event_id")], 10).drop("rank")
    return named.where("cell <> 'TN'").unionByName(calm)


section.add("ml_error_samples", ml_error_samples, f"""{t.with_(t.TEL, t.features_sql(), NORMED, f"es AS (SELECT event_id, anomaly_score AS score, CASE WHEN anomaly_score >= 0.6 THEN CASE WHEN tel.label = 1 THEN 'TP' ELSE 'FP' END ELSE CASE WHEN tel.label = 1 THEN 'FN' ELSE 'TN' END END AS cell, array_to_string(list_transform(list_reverse_sort([{_PAIRS}])[1:3], lambda x: x.n), ',') AS top3 FROM normed JOIN tel USING (event_id))")}
SELECT event_id, score, cell, top3 FROM es WHERE cell <> 'TN' UNION ALL (SELECT event_id, score, cell, top3 FROM es WHERE cell = 'TN' ORDER BY event_id LIMIT 10)""")
section.add("ml_source_comparison", lambda spark, sf: light(spark, sf).groupBy("attack_cat").agg(
    F.count_if(F.col("n_rules") > 0).alias("by_rules"), F.count_if(F.col("anomaly_score") >= 0.602).alias("by_model"),
    F.count_if(F.col("hybrid_score") >= 50).alias("by_score")),
    f"{t.light_base()} SELECT attack_cat, count(*) FILTER (WHERE n_rules > 0) AS by_rules, count(*) FILTER (WHERE anomaly_score >= 0.602) AS by_model, count(*) FILTER (WHERE hybrid_score >= 50) AS by_score FROM light GROUP BY 1")
