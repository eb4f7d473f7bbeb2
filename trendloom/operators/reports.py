"""Archived JSON reports and simulation results."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom import schemas
from trendloom.functions.text import json_text

# What a report has.
SIZES = {"emerging_directions": 3, "underexplored_gaps": 3, "predicted_convergences": 2}
CONFIDENCES = ("low", "medium", "high")
NAME, REASON, MONTHS = "Unknown", "LLM response unavailable", 12


def fallback() -> Column:
    """The report that stands for one that can't be used."""
    def repeat(n: int, **fields: str) -> Column:
        return F.array_repeat(F.struct(*[F.lit(v).alias(k) for k, v in fields.items()]), n)

    return F.struct(
        repeat(3, direction=NAME, reasoning=REASON, confidence="low").alias("emerging_directions"),
        repeat(3, gap=NAME, reasoning=REASON).alias("underexplored_gaps"),
        repeat(2, concept_a=NAME, concept_b=NAME, reasoning=REASON).alias("predicted_convergences"),
        F.lit(MONTHS).alias("time_horizon_months"), F.lit("low").alias("overall_confidence"))


def validate(raw: DataFrame) -> DataFrame:
    """Columns of `raw(..., raw)` but raw, with `report` (struct) and `is_fallback`: a report of the wrong form gives the fixed one."""
    text = json_text(F.col("raw"))
    parsed = raw.withColumn("_p", F.when(F.try_parse_json(text).isNotNull() & text.startswith("{") & text.endswith("}"), F.from_json(text, schemas.REPORT)))
    p = lambda c: F.col(f"_p.{c}")
    checks = [F.size(p(c)) == n for c, n in SIZES.items()]
    checks += [p("time_horizon_months").isNotNull(), p("overall_confidence").isin(*CONFIDENCES)]
    checks += [F.forall(p("emerging_directions"), lambda d: d["direction"].isNotNull() & d["reasoning"].isNotNull() & d["confidence"].isin(*CONFIDENCES))]
    checks += [F.forall(p("underexplored_gaps"), lambda g: g["gap"].isNotNull() & g["reasoning"].isNotNull())]
    checks += [F.forall(p("predicted_convergences"), lambda c: c["concept_a"].isNotNull() & c["concept_b"].isNotNull() & c["reasoning"].isNotNull())]
    valid = F.lit(True)
    for c in checks:
        valid = valid & F.coalesce(c, F.lit(False))
    marked = parsed.withColumn("_v", F.col("_p").isNotNull() & valid)
    report = F.when(F.col("_v"), F.col("_p")).otherwise(fallback())
    return marked.select(*[c for c in raw.columns if c != "raw"], report.alias("report"), (~F.col("_v")).alias("is_fallback"))


def directions(df: DataFrame, key: str = "report_id") -> DataFrame:
    return df.select(key, F.posexplode("report.emerging_directions").alias("pos", "d")).select(key, "pos", "d.direction", "d.reasoning", "d.confidence")


def gaps(df: DataFrame, key: str = "report_id") -> DataFrame:
    return df.select(key, F.posexplode("report.underexplored_gaps").alias("pos", "g")).select(key, "pos", "g.gap", "g.reasoning")


def convergences(df: DataFrame, key: str = "report_id") -> DataFrame:
    return df.select(key, F.posexplode("report.predicted_convergences").alias("pos", "c")).select(key, "pos", "c.concept_a", "c.concept_b", "c.reasoning")


def opinions(results: DataFrame, key: str = "result_id") -> DataFrame:
    """One row per opinion of `results(key, results)` (JSON text)."""
    parsed = results.select(key, F.from_json("results", schemas.SIMULATION).alias("r"))
    reports = parsed.select(key, F.explode("r.adoption_reports").alias("a"))
    spread = reports.select(key, F.col("a.direction").alias("report_direction"), F.explode("a.rounds").alias("n"))
    flat = spread.select(key, "report_direction", F.col("n.round_number").alias("round"), F.posexplode("n.opinions").alias("pos", "o"))
    return flat.select(key, "report_direction", "round", "pos", "o.persona", "o.adoption_likelihood", "o.confidence_score")


def archive(signals: DataFrame, reports: DataFrame, generated_at: dt.datetime) -> DataFrame:
    """`reports(topic_context, report, model_name)` with a snapshot of the leading signals, not validated yet.

    The signals are those of one report (a few hundred rows).
    """
    ordered = F.sort_array(F.collect_list(F.struct("concept_name", "centrality_score", "velocity", "trend", "composite_score")))
    snapshot = signals.agg(F.to_json(ordered).alias("signals_snapshot"))
    return reports.crossJoin(F.broadcast(snapshot)).select(  # one row
        "topic_context", "signals_snapshot", F.to_json("report").alias("report"), "model_name", F.lit(generated_at).cast("timestamp").alias("generated_at"),
        F.lit(False).alias("is_validated"), F.lit(None).cast("string").alias("validation_notes"))


def mark_validated(reports: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Sets is_validated and notes `[YES] ...` on the reports of `verdicts(report_id, verdict, notes)`."""
    v = verdicts.select("report_id", F.concat(F.lit("["), F.upper("verdict"), F.lit("] "), F.coalesce("notes", F.lit(""))).alias("_n"))
    joined = reports.join(v, "report_id", "left")
    return joined.withColumns({"is_validated": F.col("is_validated") | F.col("_n").isNotNull(), "validation_notes": F.coalesce("_n", "validation_notes")}).drop("_n")


def latest(df: DataFrame, topic: str | None = None, limit: int = 5, key: str = "report_id") -> DataFrame:
    """The newest of a topic, or of each topic."""
    if topic is not None:
        return df.where(F.col("topic_context") == topic).orderBy(F.desc("generated_at"), F.desc(key)).limit(limit)
    order = Window.partitionBy("topic_context").orderBy(F.desc("generated_at"), F.desc(key))
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")
