"""Quality of scores: confusion, curves, percentiles, threshold sweeps and choices, ablation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secflow.operators.timeline import prefix, row_index
from secflow.plans.detection import with_scalar
from secflow.schema import ALERT_THRESHOLD, ANOMALY_THRESHOLD
from secflow.settings import block_rows, small_side


def metrics(counts: DataFrame, undefined: str = "0D", digits: int = 4) -> DataFrame:
    """Rates from tp, fp, tn, fn; ``undefined`` replaces a zero denominator."""
    def share(top: str, bottom: str) -> str:
        return f"case when {bottom} = 0 then {undefined} else {top} / ({bottom}) end"
    rated = counts.selectExpr(
        "*", f"{share('tp', '(tp + fp)')} as _p", f"{share('tp', '(tp + fn)')} as _r", f"{share('fp', '(fp + tn)')} as _fpr",
        f"{share('tn', '(fp + tn)')} as _spec", f"{share('(tp + tn)', '(tp + fp + tn + fn)')} as _acc")
    f1 = f"case when _p is null or _r is null then {undefined} when _p + _r = 0 then 0D else 2 * _p * _r / (_p + _r) end"
    return rated.selectExpr(*counts.columns, f"round(_p, {digits}) as precision", f"round(_r, {digits}) as recall",
                            f"round({f1}, {digits}) as f1", f"round(_fpr, {digits}) as fpr",
                            f"round(_spec, {digits}) as specificity", f"round(_acc, {digits}) as accuracy")


def counted(flag: str, label: str = "label") -> list:
    return [F.count_if(F.expr(f"{flag} and {label} = 1")).alias("tp"), F.count_if(F.expr(f"{flag} and {label} = 0")).alias("fp"),
            F.count_if(F.expr(f"not {flag} and {label} = 0")).alias("tn"), F.count_if(F.expr(f"not {flag} and {label} = 1")).alias("fn")]


def confusion_at(scored: DataFrame, threshold: float) -> DataFrame:
    return metrics(scored.agg(*counted(f"(score >= {threshold})")))


def by_score(scored: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score; tied scores become one row."""
    return scored.groupBy("score").agg(F.sum("label").cast("bigint").alias("pos"),
                                       F.sum(F.expr("1 - label")).cast("bigint").alias("neg"))


BUCKET = "cast(floor(score * 1000) as bigint)"


def cumulative(groups: DataFrame) -> DataFrame:
    """Positives and negatives with a strictly higher score, by the two-level running sum."""
    above = prefix(groups.withColumn("_all", F.lit(1)), ["_all"], [F.col("score").desc()], F.expr(BUCKET),
                   {"tp_above": ("sum", F.col("pos")), "fp_above": ("sum", F.col("neg")), "rank": ("count", F.lit(1))},
                   descending=True).drop("_all").fillna(0, ["tp_above", "fp_above"])
    totals = groups.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.count("*").alias("n_points"))
    return with_scalar(above, totals)


def roc_points(scored: DataFrame) -> DataFrame:
    return cumulative(by_score(scored)).selectExpr(
        "rank", "n_points", "score", "(fp_above + neg) / n_neg as fpr", "(tp_above + pos) / n_pos as tpr")


def roc_auc(scored: DataFrame) -> DataFrame:
    return cumulative(by_score(scored)).agg(
        (F.sum(F.expr("neg * (tp_above + pos / 2D)")) / F.max(F.expr("double(n_pos) * n_neg"))).alias("roc_auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    return cumulative(by_score(scored)).agg(F.sum(F.expr(
        "pos / n_pos * (tp_above + pos) / (tp_above + pos + fp_above + neg)")).alias("average_precision"))


def thinned(points: DataFrame, most: int = 200) -> DataFrame:
    """At most ``most`` points, at positions int(i * n / most)."""
    return points.where(f"n_points <= {most} or rank = floor(ceil(rank * {most} / n_points) * n_points / {most})")


def percentiles(values: DataFrame, percents: list[float], column: str = "score") -> DataFrame:
    """Exact interpolated percentiles without gathering the values: ranks are read off running counts."""
    groups = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("score")).agg(F.count("*").alias("n"))
    running = prefix(groups.withColumn("_all", F.lit(1)), ["_all"], [F.col("score")], F.expr(BUCKET),
                     {"before": ("sum", F.col("n"))}).fillna(0, ["before"])
    sized = with_scalar(running, groups.agg(F.sum("n").alias("total")))
    wanted = ", ".join(
        f"named_struct('percent', {p}D, 'at', floor((total - 1) * {p / 100}D) + {side}, 'side', {side}, 'weight', (total - 1) * {p / 100}D - floor((total - 1) * {p / 100}D))"
        for p in percents for side in (0, 1))
    held = sized.selectExpr("score", "before", "n", "total", f"explode(array({wanted})) as w").where(
        "least(w.at, total - 1) >= before and least(w.at, total - 1) < before + n")
    return held.groupBy("w.percent").agg(F.sum(F.expr("if(w.side = 0, score * (1 - w.weight), score * w.weight)")).alias("threshold"))


def suggested_threshold(train_scores: DataFrame) -> DataFrame:
    return percentiles(train_scores, [99.0]).selectExpr("greatest(threshold, 0.5D) as threshold")


def sweep(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Confusion at each of a bounded list of thresholds (column threshold) in one pass.

    Each row is reduced to how many thresholds it reaches, so the data is never multiplied by the
    number of thresholds.
    """
    ordered = thresholds.agg(F.sort_array(F.collect_set("threshold")).alias("_ts"))
    levels = with_scalar(scored, ordered).groupBy(F.expr("size(filter(_ts, t -> score >= t))").alias("level")).agg(
        F.sum("label").alias("pos"), F.sum(F.expr("1 - label")).alias("neg"))
    totals = scored.agg(F.sum("label").alias("n_pos"), F.sum(F.expr("1 - label")).alias("n_neg"))
    reached = levels.where("level > 0").selectExpr("explode(sequence(1, level)) as i", "pos", "neg").groupBy("i").agg(
        F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    places = ordered.selectExpr("posexplode(_ts) as (i, threshold)").withColumn("i", F.col("i") + 1)
    joined = with_scalar(places.join(reached, "i", "left").fillna(0, ["tp", "fp"]), totals)
    return metrics(joined.selectExpr("threshold", "tp", "fp", "n_neg - fp as tn", "n_pos - tp as fn"), digits=6)


def best_f1(scored: DataFrame, percents: list[float]) -> DataFrame:
    """Threshold with the best F1 among percentiles; the lowest percentile wins a tie."""
    points = percentiles(scored, percents)
    swept = sweep(scored, points).join(points, "threshold")
    best = swept.where("f1 > 0").agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", F.expr("-percent"))).alias("b"))
    return best.selectExpr("coalesce(b.threshold, 0.5D) as threshold", "coalesce(b.f1, 0D) as f1")


def youden_choice(validation: DataFrame, test: DataFrame, max_fpr: float = 0.15, min_recall: float = 0.60) -> DataFrame:
    """Feasible threshold with the largest recall - FPR, else the best overall; reported on test rows.

    Candidates are scores rounded to three places, at most 1001 values on [0, 1].
    """
    spark = validation.sparkSession
    grid = spark.range(101).selectExpr("round(id / 100D, 3) as threshold")
    candidates = validation.selectExpr("round(score, 3) as threshold").distinct().unionByName(grid).distinct()
    rated = sweep(validation, candidates).selectExpr(
        "threshold", "round(fpr, 4) as fpr", "round(recall, 4) as recall",
        f"round(fpr, 4) < {max_fpr} and round(recall, 4) > {min_recall} as feasible")
    chosen = rated.agg(F.max_by(F.struct("threshold", "feasible"), F.expr(
        "struct(feasible, round(recall - fpr, 6), -threshold)")).alias("c")).selectExpr(
        "c.threshold as threshold", "c.feasible as feasible")
    judged = with_scalar(test, chosen)
    return metrics(judged.groupBy("threshold", "feasible").agg(*counted("(score >= threshold)")))


def category_recall(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.where("label = 1").groupBy("category").agg(
        F.count("*").alias("total"), F.count_if(F.col("score") >= threshold).alias("detected")).withColumn(
        "recall", F.expr("round(detected / total, 4)"))


def stratified_split(rows: DataFrame, key: str = "event_id", label: str = "label") -> DataFrame:
    """50/25/25 per class, ordered by a portable hash; ranks come from per-bucket counts.

    The hash is even, so as many buckets as blocks of rows keep every bucket small.
    """
    buckets = max(1, min(1 << 22, -(-rows.count() // block_rows(rows.sparkSession))))
    hashed = rows.withColumn("_h", F.expr(f"md5(cast(cast({key} as string) as binary))"))
    ranked = row_index(hashed, [label], [F.col("_h"), F.col(key)], F.expr(f"(cast(conv(substr(_h, 1, 10), 16, 10) as bigint) * {buckets}) div {1 << 40}"))
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n"))
    return ranked.join(small_side(sizes), label).withColumn("split", F.expr(
        "case when _idx < cast(_n * 0.5D as bigint) then 'train' when _idx < cast(_n * 0.5D as bigint) + cast(_n * 0.25D as bigint) "
        "then 'validation' else 'test' end")).drop("_h", "_n", "_idx")


# Ablation settings (name, rules, model, sequences).
CONFIGURATIONS = [
    ("A_rules", True, False, False), ("B_model", False, True, False), ("C_sequences", False, False, True),
    ("D_rules_model", True, True, False), ("E_rules_sequences", True, False, True),
    ("F_model_sequences", False, True, True), ("G_all", True, True, True),
]


def ablation(evidence: DataFrame) -> DataFrame:
    """Every configuration over the same events. Sequences are made of rule hits, so a configuration
    without rules has none."""
    def score(rules: bool, model: bool, order: bool) -> str:
        parts = ["coalesce(behaviour_score, 0D) * 0.6D"]
        if rules:
            parts.append("if(n_rules > 0, 50D, 0D)")
        if model:
            parts.append(f"greatest(0D, (anomaly_score - {ANOMALY_THRESHOLD}D) * 40D)")
        if order and rules:
            parts.append("if(sequences <> '', 30D, 0D)")
        return f"least(100D, {' + '.join(parts)})"
    arms = ", ".join(f"named_struct('config', '{n}', 'score', {score(r, m, s)})" for n, r, m, s in CONFIGURATIONS)
    rows = evidence.selectExpr("label", "attack_cat", f"explode(array({arms})) as c").selectExpr(
        "c.config as config", "c.score as score", "label", "attack_cat", f"c.score >= {ALERT_THRESHOLD} as hit")
    per_scenario = rows.groupBy("config", "attack_cat").agg(
        *counted("hit"), F.count("*").alias("n"), F.max("score").alias("top"), F.sum("score").alias("total"),
        F.count_if(F.col("score") >= ALERT_THRESHOLD / 2).alias("half"))
    summed = per_scenario.groupBy("config").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "tn", "fn")], F.max("top").alias("max_score"),
        (F.sum("total") / F.sum("n")).alias("mean_score"), F.sum("half").alias("above_half"),
        F.count_if(F.expr("tp > 0")).alias("scenarios_found"), F.count_if(F.expr("tp + fn > 0")).alias("scenarios"))
    return metrics(summed, undefined="null").withColumn("blind", F.col("max_score") < ALERT_THRESHOLD)


def false_positive_causes(evidence: DataFrame) -> DataFrame:
    wrong = evidence.where(f"label = 0 and hybrid_score >= {ALERT_THRESHOLD}")
    return wrong.groupBy(F.expr(
        "case when n_rules > 0 then concat('rule:', substring_index(rules, ',', 1)) when sequences <> '' then 'sequence' "
        "when anomaly_score >= 0.5 then 'model' else 'unclear' end").alias("cause"), "attack_cat").agg(F.count("*").alias("n"))
