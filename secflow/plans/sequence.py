"""Next-tactic models: transition counts, smoothed probabilities, predictions and their quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secflow.functions.predicates import literals
from secflow.functions.scalars import entity_type, percent_text
from secflow.plans.detection import ratio
from secflow.schema import END, TACTICS, normal_tactic

# Fixed values.
ALPHA = 0.5
DECAY = 0.5
LATE = ("exfiltration", "impact", "command-and-control", "collection")
CAMPAIGN = ("lateral-movement", "command-and-control", "exfiltration")
CHAIN = f"array({literals(TACTICS)})"


def position(t: str) -> str:
    return f"(array_position({CHAIN}, {t}) - 1)"


def tactic_lists(steps: DataFrame, key: str = "seq_id") -> DataFrame:
    """Known tactics of each sequence by first appearance, so a list has at most fifteen entries."""
    known = (steps.withColumn("tactic", normal_tactic("tactic")).where(f"tactic in ({literals(TACTICS)})")
             .groupBy(key, "tactic").agg(F.min("pos").alias("pos")))
    return known.groupBy(key).agg(F.expr(
        "transform(sort_array(collect_list(struct(pos, tactic))), x -> x.tactic)").alias("tactics"))


def transition_counts(lists: DataFrame) -> DataFrame:
    """Consecutive pairs, plus one step to the end per sequence."""
    pairs = lists.where("size(tactics) > 0").selectExpr(
        "explode(transform(tactics, (t, i) -> named_struct('origin', t, 'target', "
        f"coalesce(get(tactics, i + 1), '{END}')))) as p")
    return pairs.groupBy("p.origin", "p.target").agg(F.count("*").alias("n"))


def transition_probabilities(counts: DataFrame) -> DataFrame:
    """Smoothed probability of every (origin, target) pair; 15 x 16 rows whatever the data size."""
    spark = counts.sparkSession
    pairs = spark.range(1).selectExpr(f"explode({CHAIN}) as origin").selectExpr(
        "origin", f"explode(concat({CHAIN}, array('{END}'))) as target")
    totals = counts.groupBy("origin").agg(F.sum("n").alias("row_total"))
    return (pairs.join(counts, ["origin", "target"], "left").join(totals, "origin", "left")
            .selectExpr("origin", "target", "coalesce(n, 0) as n",
                        f"(coalesce(n, 0) + {ALPHA}D) / (coalesce(row_total, 0) + {ALPHA}D * {len(TACTICS) + 1}) as p"))


def with_deepest(histories: DataFrame) -> DataFrame:
    return histories.withColumn("deepest", F.expr(f"array_max(transform(tactics, t -> {position('t')}))"))


def markov_predictions(histories: DataFrame, probabilities: DataFrame, k: int = 3) -> DataFrame:
    """Top-k later, unseen tactics by (-p, name), and the probability of stopping.

    Only fifteen ranked rows (one per origin) are broadcast; each history then filters its own.
    """
    ranked = probabilities.groupBy("origin").agg(
        F.expr(f"sort_array(collect_list(case when target <> '{END}' then named_struct('np', -p, 'tactic', target) end))"
               ).alias("ranked"),
        F.max(F.expr(f"case when target = '{END}' then p end")).alias("p_end"), F.sum("n").alias("n_seen"))
    origin = F.expr(f"get({CHAIN}, cast(deepest as int))")
    joined = with_deepest(histories).withColumn("origin", origin).join(F.broadcast(ranked), "origin", "left")
    keep = f"x -> {position('x.tactic')} > deepest and not array_contains(tactics, x.tactic)"
    return joined.withColumn("predicted", F.expr(
        f"transform(slice(filter(ranked, {keep}), 1, {k}), x -> named_struct('tactic', x.tactic, 'p', -x.np))")
    ).drop("ranked")


def canonical_predictions(histories: DataFrame, k: int = 3) -> DataFrame:
    """Next tactics in the fixed order with geometric weights."""
    ahead = f"slice(filter({CHAIN}, t -> {position('t')} > deepest and not array_contains(tactics, t)), 1, {k})"
    total = f"aggregate(sequence(0, size(ahead) - 1), 0D, (a, i) -> a + pow({DECAY}D, i))"
    return (with_deepest(histories).withColumn("ahead", F.expr(ahead))
            .withColumn("predicted", F.expr(
                "if(size(ahead) = 0, cast(array() as array<struct<tactic: string, p: double>>), "
                f"transform(ahead, (t, i) -> named_struct('tactic', t, 'p', pow({DECAY}D, i) / {total})))"))
            .drop("ahead"))


def prefixes(lists: DataFrame, key: str = "seq_id") -> DataFrame:
    """Every proper prefix of a list with the tactic that really came next."""
    return lists.where("size(tactics) > 1").selectExpr(
        key, "tactics as full", "explode(sequence(1, size(tactics) - 1)) as len").selectExpr(
        key, "len", "slice(full, 1, len) as tactics", "get(full, len) as truth")


def train_test(lists: DataFrame, share: float = 0.7, key: str = "seq_id") -> DataFrame:
    """Reproducible split by a portable hash of the key; no sort and no shuffle."""
    bucket = f"cast(conv(substr(md5(cast(cast({key} as string) as binary)), 1, 7), 16, 10) as bigint) % 1000"
    return lists.withColumn("split", F.expr(f"if({bucket} < {int(share * 1000)}, 'train', 'test')"))


def scored(predictions: DataFrame) -> DataFrame:
    return predictions.selectExpr(
        "truth", "coalesce(get(predicted, 0).tactic, 'none') as guess",
        "coalesce(get(predicted, 0).tactic = truth, false) as hit1",
        "coalesce(array_contains(transform(slice(predicted, 1, 3), x -> x.tactic), truth), false) as hit3",
        "size(predicted) > 0 as covered")


def precision_at(predictions: DataFrame, model: str) -> DataFrame:
    return scored(predictions).agg(
        F.lit(model).alias("model"), F.count("*").alias("n"), F.count_if("hit1").alias("hits1"),
        F.count_if("hit3").alias("hits3"), F.count_if("covered").alias("covered")).selectExpr(
        "model", "n", "hits1", "hits3", "covered", "if(n = 0, 0D, hits1 / n) as p1", "if(n = 0, 0D, hits3 / n) as p3")


def confusion(predictions: DataFrame) -> DataFrame:
    return scored(predictions).groupBy("truth", "guess").agg(F.count("*").alias("n"))


def class_f1(counts: DataFrame) -> DataFrame:
    """Per-class precision, recall and F1 from the confusion counts (zero where undefined)."""
    cells = counts.selectExpr("explode(array(named_struct('label', truth, 'tp', if(truth = guess, n, 0), 'act', n, 'pre', 0L), "
                              "named_struct('label', guess, 'tp', 0L, 'act', 0L, 'pre', n))) as c")
    sums = cells.groupBy("c.label").agg(F.sum("c.tp").alias("tp"), F.sum("c.act").alias("support"),
                                        F.sum("c.pre").alias("guessed"))
    rated = sums.withColumns({"precision": ratio(F.col("tp"), F.col("guessed")),
                              "recall": ratio(F.col("tp"), F.col("support"))})
    return rated.withColumn("f1", F.expr(
        "if(precision + recall = 0, 0D, 2 * precision * recall / (precision + recall))"))


def f1_summary(per_class: DataFrame) -> DataFrame:
    return per_class.agg(F.avg("f1").alias("macro_f1"),
                         (F.sum(F.expr("f1 * support")) / F.sum("support")).alias("weighted_f1"),
                         F.count("*").alias("classes"))


# --- predictions for incidents --------------------------------------------------------------------------
FACTOR = (f"(if(entity_type = 'server' and x.tactic in ({literals(LATE)}), 1.3D, 1D) "
          f"* if(risk >= 75 and x.tactic in ({literals(LATE)}), 1.2D, 1D) * if(velocity >= 5, 1.15D, 1D) "
          f"* if(cti_flagged and x.tactic in ({literals(CAMPAIGN)}), 1.4D, 1D))")


def reweighted(predictions: DataFrame) -> DataFrame:
    """Scale each probability by its context, cap at 1, order again; the sum is left as it is."""
    return predictions.withColumn("predicted", F.expr(
        "transform(sort_array(transform(predicted, (x, i) -> named_struct('np', -least(x.p * "
        f"{FACTOR}, 1D), 'i', i, 'tactic', x.tactic))), x -> named_struct('tactic', x.tactic, 'p', -x.np))"))


#: A model that stops with at least this probability says so.
SAY_STOP = 0.3
MODEL, ORDER = "transitions seen", "canonical order"


def incident_predictions(incidents: DataFrame, flagged: DataFrame, probabilities: DataFrame | None = None,
                         k: int = 2) -> DataFrame:
    """Next tactics of each incident from its deepest one, with context, confidence and a rationale.

    With ``probabilities`` the transitions of the deepest tactic decide, and the confidence is the probability of the
    best guess; a tactic that no training sequence left falls back to the canonical order, as does everything
    without a model, and the confidence then follows the length and order of the progression. One join with
    fifteen rows brings both the ranking and the probability of stopping.
    """
    known = incidents.withColumn("tactics", F.expr(
        f"filter(transform(tactics, t -> if(t = 'defense-evasion', 'stealth', t)), t -> {position('t')} >= 0)")
    ).where("size(tactics) > 0")
    context = (known.join(flagged.where("cti_confirmed").select("entity", F.lit(True).alias("cti_flagged")), "entity", "left")
               .withColumn("cti_flagged", F.expr("coalesce(cti_flagged, false)"))
               .withColumn("entity_type", F.expr(entity_type("entity"))).drop("deepest"))
    if probabilities is None:
        both = canonical_predictions(context, k).withColumns({"n_seen": F.lit(0), "p_end": F.lit(0.0)})
    else:
        learnt = markov_predictions(context, probabilities, k).withColumnRenamed("predicted", "learnt").drop("deepest")
        both = canonical_predictions(learnt, k).withColumn(
            "predicted", F.expr("if(n_seen > 0, learnt, predicted)")).drop("learnt", "origin")
    ranked = reweighted(both.withColumn("model", F.expr(f"if(n_seen > 0, '{MODEL}', '{ORDER}')"))
                        .withColumn("p_end", F.expr("if(n_seen > 0, p_end, 0D)")))
    rising = f"aggregate(sequence(1, size(tactics)), true, (a, i) -> a and (i < 2 or {position('get(tactics, i - 1)')} >= {position('get(tactics, i - 2)')}))"
    why = ("array_compact(array(if(entity_type = 'server', 'server', null), if(risk >= 75, 'high severity', null), "
           "if(velocity >= 5, 'fast', null), if(cti_flagged, 'known campaign', null)))")
    return ranked.withColumns({
        "current_tactic": F.expr(f"get({CHAIN}, cast(deepest as int))"),
        "confidence": F.expr(
            f"if(model = '{MODEL}', coalesce(get(predicted, 0).p, 0D), "
            f"least(0.55D + 0.1D * least(size(tactics), 3) + if({rising}, 0.1D, 0D), 0.95D))"),
        "context": F.expr(why),
    }).withColumn("rationale", F.expr(
        "concat('Progression ', array_join(tactics, ' > '), '; deepest ', current_tactic, ' (', deepest + 1, '/15); ', "
        "if(size(predicted) = 0, 'no later phase is left', concat('by ', model, ' next ', array_join(transform(predicted, "
        f"x -> concat(x.tactic, ' (', {percent_text('x.p')}, ')')), ' or '), "
        f"if(p_end >= {SAY_STOP}D, concat('; stops here with ', {percent_text('p_end')}), ''), "
        "if(size(context) = 0, '', concat('; weighed up: ', array_join(context, ', '))))))"))


def lists_from_incidents(incidents: DataFrame) -> DataFrame:
    return incidents.where("size(tactics) > 0").selectExpr(
        "incident_id as seq_id", "transform(tactics, t -> if(t = 'defense-evasion', 'stealth', t)) as tactics")


def lineitem_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as observed attack steps: one sequence per order."""
    return spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "l_orderkey as seq_id", "l_linenumber as pos",
        f"get({CHAIN}, cast(least(l_linenumber * 2 - 2 + l_suppkey % 4, 14) as int)) as tactic")


