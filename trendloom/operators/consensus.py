"""Scores over tables of agent opinions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom import schemas
from trendloom.functions.text import strip

# Likelihoods as numbers.
LIKELIHOOD = {"high": 1.0, "medium": 0.5, "low": 0.0}


def _value() -> Column:
    known = F.create_map(*[F.lit(x) for pair in LIKELIHOOD.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.col("adoption_likelihood")), F.lit(0.0))


def parse_opinions(raw: DataFrame) -> DataFrame:
    """Columns of `raw(..., raw)` but raw, and the opinion's fields: the whole text as JSON, or else its widest braces."""
    text = strip(F.regexp_replace(F.coalesce("raw", F.lit("")), r"(?s)<\|channel>.*?<channel\|>", ""))
    chosen = F.when(F.try_parse_json(text).isNotNull() & text.startswith("{") & text.endswith("}"), text).otherwise(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    parsed = raw.withColumn("_o", F.when(F.try_parse_json(chosen).isNotNull(), F.from_json(chosen, schemas.OPINION)))
    return parsed.select(*[c for c in raw.columns if c != "raw"], "_o.*")


def rounds(opinions: DataFrame) -> DataFrame:
    """`direction, round, n_opinions, consensus, opinion_shift`.

    Consensus is 1 - sample variance / 0.25, at least 0, and 1 below two opinions. The shift is the mean change
    of the personas that also spoke in the round before (of a persona's several opinions in a round the last).
    """
    scored = opinions.withColumn("v", _value())
    spread = F.when(F.count("*") < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.var_samp("v") / 0.25))
    per_round = scored.groupBy("direction", "round").agg(F.count("*").alias("n_opinions"), F.round(spread, 4).alias("consensus"))
    last = scored.groupBy("direction", "persona", "round").agg(F.max_by("v", "opinion_id").alias("v"))
    order = Window.partitionBy("direction", "persona").orderBy("round")
    moved = last.withColumns({"pv": F.lag("v").over(order), "pr": F.lag("round").over(order)})
    shift = moved.where(F.col("pr") == F.col("round") - 1).groupBy("direction", "round").agg(F.round(F.avg(F.abs(F.col("v") - F.col("pv"))), 4).alias("s"))
    return per_round.join(shift, ["direction", "round"], "left").select("direction", "round", "n_opinions", "consensus", F.coalesce("s", F.lit(0.0)).alias("opinion_shift"))


def effective_rounds(opinions: DataFrame, max_rounds: int = 3, agreed: float = 0.8) -> DataFrame:
    """Opinions up to the first round of consensus above `agreed`, and no later than `max_rounds`."""
    stop = rounds(opinions).where(F.col("consensus") > agreed).groupBy("direction").agg(F.min("round").alias("_stop"))
    return opinions.join(stop, "direction", "left").where((F.col("round") <= F.coalesce("_stop", F.lit(max_rounds))) & (F.col("round") <= max_rounds)).drop("_stop")


def shared_concerns(opinions: DataFrame) -> DataFrame:
    """`direction, concern, mentions, place`: concerns mentioned twice or more, in the order first seen."""
    spread = opinions.select("direction", "round", "opinion_id", F.posexplode("key_concerns").alias("pos", "concern"))
    found = spread.groupBy("direction", "concern").agg(F.count("*").alias("mentions"), F.min(F.struct("round", "opinion_id", "pos")).alias("_f")).where("mentions >= 2")
    order = Window.partitionBy("direction").orderBy("_f")
    return found.select("direction", "concern", "mentions", F.row_number().over(order).alias("place"))


def verdicts(opinions: DataFrame) -> DataFrame:
    """`direction, final_consensus, verdict, consensus_reached, n_rounds` from each direction's last round."""
    last = rounds(opinions).groupBy("direction").agg(F.max_by("consensus", "round").alias("final_consensus"), F.count("*").alias("n_rounds"))
    c = F.col("final_consensus")
    verdict = F.when(c >= 0.75, "likely").when(c >= 0.45, "contested").otherwise("unlikely")
    return last.select("direction", "final_consensus", verdict.alias("verdict"), (c > 0.8).alias("consensus_reached"), "n_rounds")


def overall(found: DataFrame) -> DataFrame:
    """One row `mean_consensus, confidence` of a run's verdicts; none is low."""
    mean = found.agg(F.avg("final_consensus").alias("mean_consensus"))
    c = F.coalesce("mean_consensus", F.lit(0.0))
    return mean.select(F.round(c, 6).alias("mean_consensus"), F.when(c >= 0.7, "high").when(c >= 0.4, "medium").otherwise("low").alias("confidence"))
