"""Rule evaluation: per-event matches, volume rules, ordered sequences and rule quality."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secflow.functions import predicates as p
from secflow.operators.blocks import greedy_select
from secflow.operators.timeline import over_rows, timed_index
from secflow.plans import catalogue as cat
from secflow.schema import TECHNIQUES
from secflow.settings import MICROS, chunk_seconds


def _constants(values: list, name: str) -> str:
    return f"element_at(array({p.literals(values)}), rule_no) as {name}"


def with_fields(events: DataFrame, rules: Sequence[cat.Rule]) -> DataFrame:
    """Add the fields that rules need: from the column, else the properties, else the raw record, else null.

    Each field is looked up once and then used by all rules. Columns that are not text are left as they are.
    """
    kinds = dict(events.dtypes)
    added = {}
    for name in sorted(set().union(*[cat.fields_of(r.when) for r in rules])):
        if kinds.get(name, "string") != "string":
            continue
        places = [F.col(name)] if name in kinds else []
        if "properties" in kinds:
            places.append(F.col("properties")[name])
        if kinds.get("raw") == "string":
            places.append(F.get_json_object("raw", f"$.{name}"))
        if places and len(places) + (name not in kinds) > 1:
            added[name] = F.coalesce(*[F.nullif(x, F.lit("")) for x in places])
        elif not places:
            added[name] = F.lit(None).cast("string")
    return events.withColumns(added) if added else events


def rule_matches(events: DataFrame, rules: Sequence[cat.Rule] = tuple(cat.PER_EVENT),
                 keep: Sequence[str] = ("event_id", "ts", "host")) -> DataFrame:
    """All rules over all events in one pass; one row per (rule, event)."""
    arms = ", ".join(f"case when {cat.predicate(r)} then {i + 1} end" for i, r in enumerate(rules))
    # The array goes straight into explode: an extra size filter would evaluate every rule twice.
    rows = with_fields(events, rules).selectExpr(*keep, f"explode(array_compact(array({arms}))) as rule_no")
    return rows.selectExpr(
        *keep, "cast(rule_no as bigint) as rule_no",
        _constants([r.rule_id for r in rules], "rule_id"), _constants([r.title for r in rules], "title"),
        _constants([r.severity for r in rules], "severity"),
        _constants([r.technique for r in rules], "technique"),
        _constants([r.tactic for r in rules], "tactic"),
        f"cast({_constants([r.confidence for r in rules], 'confidence').rsplit(' as ', 1)[0]} as double) as confidence")


def volume_hits(matches: DataFrame, keys: Sequence[str], count: int, seconds: int,
                keep: Sequence[str] = (), block: int | None = None) -> DataFrame:
    """``count`` matches of a group within ``seconds``; windows never share a match.

    A row can close a window when the match ``count - 1`` places before it is near enough. Of those
    candidates a left-to-right scan takes the first, jumps ``count`` places, and goes on.
    """
    named = {f"_g{i}": F.coalesce(F.col(k).cast("string"), F.lit("")) for i, k in enumerate(keys)}
    groups = list(named)
    rows = timed_index(matches.withColumns(named), groups)
    near = over_rows(rows, groups, count - 1, {
        "_first": lambda w: F.lag("ts", count - 1).over(w),
        "related": lambda w: F.array(*[F.lag("event_id", b).over(w) for b in range(count - 1, 0, -1)]),
    }, block=block)
    closing = (near.where(F.unix_micros("ts") - F.unix_micros("_first") <= seconds * MICROS)
               .withColumn("_resume", F.col("_idx") + count))
    carry = list(dict.fromkeys(["event_id", "ts", "related", *keys, *keep]))
    picked = greedy_select(closing, groups, "_idx", "_resume", carry, block=block)
    return picked.select(*carry, F.lit(count).cast("bigint").alias("match_count"))


def volume_matches(events: DataFrame, rule: cat.Rule) -> DataFrame:
    return (with_fields(events, [rule]).where(cat.predicate(rule))
            .select("event_id", "ts", "host", *[g for g in rule.group_by if g != "host"]))


def volume_rule_hits(events: DataFrame, rule: cat.Rule, count: int | None = None,
                     seconds: int | None = None, matches: DataFrame | None = None) -> DataFrame:
    """Hits of a volume rule; ``matches`` are its matching events where those are at hand already."""
    matches = volume_matches(events, rule) if matches is None else matches
    hits = volume_hits(matches, rule.group_by, count or rule.count, seconds or rule.minutes * 60, ["host"])
    return hits.select(
        "event_id", "ts", "host", F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.title).alias("title"),
        F.lit(rule.severity).alias("severity"), F.lit(rule.technique).alias("technique"),
        F.lit(rule.tactic).alias("tactic"), F.lit(rule.confidence).alias("confidence"),
        "match_count", "related")


def all_hits(events: DataFrame, volume: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Per-event and volume hits. ``volume`` overrides (count, seconds) per volume rule."""
    single = rule_matches(events).drop("rule_no").withColumns({
        "match_count": F.lit(1).cast("bigint"), "related": F.array().cast("array<bigint>")})
    out = single
    for rule in cat.VOLUME:
        count, seconds = (volume or {}).get(rule.rule_id, (rule.count, rule.minutes * 60))
        out = out.unionByName(volume_rule_hits(events, rule, count, seconds))
    return out


def techniques_table(spark) -> DataFrame:
    return spark.createDataFrame(TECHNIQUES, "technique string, name string, tactic string")


def resolve_technique(hits: DataFrame, column: str = "technique") -> DataFrame:
    """Name and earliest tactic; a sub-technique falls back to its parent. The dimension is fixed."""
    dim = techniques_table(hits.sparkSession)
    exact = F.broadcast(dim.select(F.col("technique").alias(column), F.col("name").alias("_name"),
                                   F.col("tactic").alias("_tactic")))
    parent = F.broadcast(dim.select(F.col("technique").alias("_parent"), F.col("name").alias("_pname"),
                                    F.col("tactic").alias("_ptactic")))
    joined = (hits.join(exact, column, "left")
              .withColumn("_parent", F.substring_index(F.col(column), ".", 1))
              .join(parent, "_parent", "left"))
    return (joined.withColumn("technique_name", F.coalesce("_name", "_pname", F.col(column)))
            .withColumn("technique_tactic", F.coalesce("_tactic", "_ptactic", F.lit("unknown")))
            .drop("_name", "_tactic", "_parent", "_pname", "_ptactic"))


def sequence_hits(hits: DataFrame, patterns: dict[str, tuple[Sequence[str], int]], key: str = "host",
                  block: int | None = None) -> DataFrame:
    """The completed patterns of ``sequence_scan``."""
    return completed(sequence_scan(sequence_parts(hits, patterns, key), patterns, block)[1], key)


def sequence_parts(hits: DataFrame, patterns: dict[str, tuple[Sequence[str], int]], key: str = "host") -> DataFrame:
    """The hits that play a part in a pattern, one row for each pattern."""
    roles = hits.sparkSession.createDataFrame(
        [(name, t) for name, (p, _) in patterns.items() for t in p], "sequence string, technique string")
    return hits.join(F.broadcast(roles), "technique").selectExpr(
        "sequence", f"coalesce({key}, '') as _key", "event_id", "rule_id", "ts", "technique", "confidence")


def completed(picked: DataFrame, key: str = "host") -> DataFrame:
    return picked.where("complete").selectExpr(
        "sequence", f"_key as {key}", "members", "start_ts", "end_ts",
        "least(1D, mean_confidence + 0.2D) as confidence")


def sequence_scan(parts: DataFrame, patterns: dict[str, tuple[Sequence[str], int]],
                  block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Techniques in this order on one entity, inside a window that starts at the first of them.

    Takes ``sequence_parts`` and returns them with their position, and the starts that the scan picked, complete or not.

    ``patterns`` maps a name to (techniques, seconds); all of them run in one pass. Each hit of a
    pattern's first technique has a fixed outcome that depends only on the following ``seconds``: it
    completes, or it lapses. The outcome says where the scan resumes; a greedy selection over those
    starts gives the incidents.
    """
    steps = {name: list(p) for name, (p, _) in patterns.items()}
    spans = {name: seconds * MICROS for name, (_, seconds) in patterns.items()}
    longest = max(spans.values())
    rows = timed_index(parts, ["sequence", "_key"], tie=("event_id", "rule_id"))
    width = max(chunk_seconds(parts.sparkSession) * MICROS, longest)
    # A chunk also receives the rows that follow it by at most the longest window.
    spread = rows.selectExpr(
        "*", f"unix_micros(ts) div {width} as _own", "unix_micros(ts) as _micros",
        f"explode(sequence((unix_micros(ts) - {longest}) div {width}, unix_micros(ts) div {width})) as _chunk")

    columns = ["sequence", "_key", "_idx", "_resume", "complete", "members", "start_ts", "end_ts", "mean_confidence"]

    def outcomes(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_idx").reset_index(drop=True)
        name = pdf["sequence"].iat[0]
        micros, tech = pdf["_micros"].to_numpy(), pdf["technique"].to_numpy()
        index, ids, ts = pdf["_idx"].to_numpy(), pdf["event_id"].to_numpy(), pdf["ts"].to_numpy()
        sure, here = pdf["confidence"].to_numpy(), (pdf["_own"] == pdf["_chunk"]).to_numpy()
        places = [np.flatnonzero(tech == s) for s in steps[name]]
        starts = places[0][here[places[0]]]
        if len(starts) == 0:
            return pd.DataFrame(columns=columns)
        limits = micros[starts] + spans[name]
        # The chains of all starts advance together, one pattern step at a time; -1 means lapsed.
        chains = [starts]
        for place in places[1:]:
            nxt = np.searchsorted(place, chains[-1] + 1)
            found = np.append(place, -1)[np.minimum(nxt, len(place))]
            good = (chains[-1] >= 0) & (found >= 0) & (micros[np.maximum(found, 0)] <= limits)
            chains.append(np.where(good, found, -1))
        done = chains[-1] >= 0
        last = np.where(done, chains[-1], np.searchsorted(micros, limits, side="right") - 1)
        grid = np.stack(chains, axis=1)
        return pd.DataFrame({
            "sequence": pd.Series([name] * len(starts), dtype=object),
            "_key": pd.Series([pdf["_key"].iat[0]] * len(starts), dtype=object), "_idx": index[starts],
            "_resume": index[last] + 1,
            "complete": done, "members": pd.Series([ids[c].tolist() if ok else [] for c, ok in zip(grid, done)], dtype=object),
            "start_ts": ts[starts], "end_ts": ts[last],
            "mean_confidence": np.where(done, sure[np.maximum(grid, 0)].mean(axis=1), 0.0)})

    starts = spread.groupBy("sequence", "_key", "_chunk").applyInPandas(
        outcomes, "sequence string, _key string, _idx bigint, _resume bigint, complete boolean, "
                  "members array<bigint>, start_ts timestamp, end_ts timestamp, mean_confidence double")
    picked = greedy_select(starts, ["sequence", "_key"], "_idx", "_resume",
                           ["complete", "members", "start_ts", "end_ts", "mean_confidence"], block=block)
    return rows, picked


def all_sequences(hits: DataFrame, windows: dict[str, int] | None = None) -> DataFrame:
    """Every sequence rule; ``windows`` overrides the window (seconds) per name."""
    return sequence_hits(hits, sequence_patterns(windows))


def sequence_patterns(windows: dict[str, int] | None = None) -> dict[str, tuple[Sequence[str], int]]:
    return {name: (pattern, (windows or {}).get(name, minutes * 60)) for name, pattern, minutes in cat.SEQUENCES}


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int,
               name: str = "rank") -> DataFrame:
    """At most ``limit`` rows per key; Spark limits each task's rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("bigint")).where(F.col(name) <= limit)


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a global aggregate, which has exactly one row."""
    return (df.withColumn("_one", F.lit(1))
            .join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one"))


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, 0.0).otherwise(top.cast("double") / F.when(bottom != 0, bottom))


def rule_quality(events: DataFrame, rules: Sequence[cat.Rule] = tuple(cat.PER_EVENT)) -> DataFrame:
    """Confusion counts and metrics of every rule against the ``label`` column."""
    totals = events.agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    fired = rule_matches(events, rules, ["event_id", "label"]).groupBy("rule_id").agg(
        F.count_if(F.col("label") == 1).alias("tp"), F.count_if(F.col("label") == 0).alias("fp"))
    every = cat.rules_table(events.sparkSession, list(rules)).select("rule_id").join(fired, "rule_id", "left")
    full = with_scalar(every.fillna(0, ["tp", "fp"]), totals).withColumns(
        {"fn": F.col("pos") - F.col("tp"), "tn": F.col("neg") - F.col("fp")})
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = full.withColumns({"p": precision, "r": recall, "fpr": ratio(F.col("fp"), F.col("fp") + F.col("tn"))})
    return out.select("rule_id", "tp", "fp", "fn", "tn", F.round("p", 4).alias("precision"),
                      F.round("r", 4).alias("recall"), F.round("fpr", 4).alias("fpr"),
                      F.round(F.when(F.col("p") + F.col("r") == 0, 0.0)
                              .otherwise(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))), 4).alias("f1"))


def rule_evaluability(events: DataFrame, rules: Sequence[cat.Rule] = tuple(cat.PER_EVENT)) -> DataFrame:
    """Which rules can fire here: their category occurs and every field they need is filled in it."""
    ready = with_fields(events, rules)
    names = sorted(set().union(*[cat.fields_of(r.when) for r in rules]))
    long = (ready.groupBy("category").agg(F.count("*").alias("n"), *[F.count(n).alias(n) for n in names])
            .select("category", "n", F.explode(F.create_map(
                *[x for n in names for x in (F.lit(n), F.col(n))])).alias("field", "filled")))
    needs = events.sparkSession.createDataFrame(
        [(r.rule_id, r.category, f) for r in rules for f in sorted(cat.fields_of(r.when))],
        "rule_id string, category string, field string")
    return (needs.join(long, ["category", "field"], "left").groupBy("rule_id").agg(
        F.bool_and(F.coalesce(F.col("n") > 0, F.lit(False))).alias("category_present"),
        F.bool_and(F.coalesce(F.col("filled") > 0, F.lit(False))).alias("evaluable"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.coalesce("filled", F.lit(0)) == 0, F.col("field")))),
                     ",").alias("missing")))
