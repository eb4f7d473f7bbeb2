"""Queries on model output, archived reports and opinions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from trendloom.functions import text
from trendloom.operators import consensus, reports
from trendloom.operators.placing import numbered
from trendloom.plans import graph_queries as gq
from trendloom.plans import views as v
from trendloom.plans.define import Book

book = Book()
query = book.query
QUERIES, ORACLES = book.queries, book.oracles

_FENCE = "```"


def raw_extractions(spark, d):
    """Model output per paper, in turn plain, fenced, behind reasoning, broken, and of the wrong form."""
    body = F.to_json(F.struct(F.array("lang", "source", F.lit("")).alias("concepts"), F.array(F.lit("m")).alias("methods")))
    k = F.col("doc_id") % 5
    raw = F.when(k == 0, F.concat(F.lit("\t\n"), body)).when(k == 1, F.concat(F.lit(_FENCE + "json\n"), body, F.lit("\n" + _FENCE))).when(
        k == 2, F.concat(F.lit("\n<think>so {it}\n goes</think>\n\n"), body, F.lit("\n"))).when(k == 3, F.concat(body, F.lit("oops"))).otherwise(F.lit('{"concepts": "x", "methods": ["a", null, "b"]}'))
    return v.table(spark, d, "documents").select(F.format_string("2401.%07d", "doc_id").alias("arxiv_id"), raw.alias("raw"))


@query("""SELECT printf('2401.%07d', doc_id) AS arxiv_id, CASE WHEN doc_id % 5 < 3 THEN [lang, source] ELSE [] END AS concepts,
  CASE WHEN doc_id % 5 < 3 THEN ['m'] WHEN doc_id % 5 = 4 THEN ['a', 'b'] ELSE [] END AS methods, CAST([] AS VARCHAR[]) AS datasets FROM documents""")
def parse_extractions(spark, d):
    return text.parse_extractions(raw_extractions(spark, d))


def stub_backend(prompts: list[str]) -> list[str | None]:
    """Stands for a caller's model: a paper's title length as its one concept, fenced now and then."""
    import json

    out = []
    for p in prompts:
        n = len(p.split("\n")[0]) - len("Title: ")
        body = json.dumps({"concepts": [f"Len {n}"], "methods": [], "datasets": [""]})
        out.append(f"```json\n{body}\n```" if n % 2 else body)
    return out


@query(f"""WITH {v.PAPERS} SELECT arxiv_id, ['Len ' || CAST(CASE WHEN strpos(title, chr(10)) > 0 THEN strpos(title, chr(10)) - 1 ELSE length(title) END AS VARCHAR)] AS concepts, CAST([] AS VARCHAR[]) AS methods, CAST([] AS VARCHAR[]) AS datasets FROM papers""")
def extract_with(spark, d):
    return text.extract_with(v.papers(spark, d), stub_backend)


def raw_reports(spark, d):
    """Reports of documents; every fifth is cut off, every seventh has only two directions."""
    directions = F.transform(F.sequence(F.lit(1), F.when(F.col("doc_id") % 7 == 0, 2).otherwise(3)), lambda i: F.struct(
        F.concat(F.col("lang"), F.lit("-"), i.cast("string")).alias("direction"), F.lit("r").alias("reasoning"), F.lit("high").alias("confidence")))
    gaps = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct(F.concat(F.col("source"), F.lit("-"), i.cast("string")).alias("gap"), F.lit("r").alias("reasoning")))
    pairs = F.array_repeat(F.struct(F.col("lang").alias("concept_a"), F.col("source").alias("concept_b"), F.lit("r").alias("reasoning")), 2)
    whole = F.to_json(F.struct(directions.alias("emerging_directions"), gaps.alias("underexplored_gaps"), pairs.alias("predicted_convergences"), F.lit(12).alias("time_horizon_months"), F.lit("medium").alias("overall_confidence")))
    raw = F.when(F.col("doc_id") % 5 == 0, F.substring(whole, 1, 40)).when(F.col("doc_id") % 5 == 1, F.concat(F.lit(_FENCE + "json\n"), whole, F.lit("\n" + _FENCE))).otherwise(whole)
    stamp = F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(doc_id % 5000 as int))")
    return v.table(spark, d, "documents").select(F.col("doc_id").alias("report_id"), F.col("source").alias("topic_context"), stamp.alias("generated_at"), raw.alias("raw"))


_BAD = "(doc_id % 5 = 0 OR doc_id % 7 = 0)"


@query(f"SELECT doc_id AS report_id, {_BAD} AS is_fallback, CASE WHEN {_BAD} THEN 'Unknown' ELSE lang || '-1' END AS first_direction, CASE WHEN {_BAD} THEN 'low' ELSE 'medium' END AS overall_confidence FROM documents")
def report_validate(spark, d):
    return reports.validate(raw_reports(spark, d)).select("report_id", "is_fallback", F.col("report.emerging_directions")[0]["direction"].alias("first_direction"), F.col("report.overall_confidence").alias("overall_confidence"))


@query(f"SELECT doc_id AS report_id, CAST(i AS INTEGER) AS pos, CASE WHEN {_BAD} THEN 'Unknown' ELSE lang || '-' || CAST(i + 1 AS VARCHAR) END AS direction, CASE WHEN {_BAD} THEN 'LLM response unavailable' ELSE 'r' END AS reasoning, CASE WHEN {_BAD} THEN 'low' ELSE 'high' END AS confidence FROM documents, range(3) t(i)")
def report_directions(spark, d):
    return reports.directions(reports.validate(raw_reports(spark, d)))


@query(f"SELECT doc_id AS report_id, CAST(i AS INTEGER) AS pos, CASE WHEN {_BAD} THEN 'Unknown' ELSE source || '-' || CAST(i + 1 AS VARCHAR) END AS gap, CASE WHEN {_BAD} THEN 'LLM response unavailable' ELSE 'r' END AS reasoning FROM documents, range(3) t(i)")
def report_gaps(spark, d):
    return reports.gaps(reports.validate(raw_reports(spark, d)))


@query(f"SELECT doc_id AS report_id, CAST(i AS INTEGER) AS pos, CASE WHEN {_BAD} THEN 'Unknown' ELSE lang END AS concept_a, CASE WHEN {_BAD} THEN 'Unknown' ELSE source END AS concept_b, CASE WHEN {_BAD} THEN 'LLM response unavailable' ELSE 'r' END AS reasoning FROM documents, range(2) t(i)")
def report_convergences(spark, d):
    return reports.convergences(reports.validate(raw_reports(spark, d)))


@query("""SELECT report_id, topic_context, generated_at FROM (SELECT doc_id AS report_id, source AS topic_context, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 5000 AS INTEGER)) AS generated_at,
  row_number() OVER (PARTITION BY source ORDER BY doc_id % 5000 DESC, doc_id DESC) AS n FROM documents) WHERE n <= 5""")
def report_latest(spark, d):
    return reports.latest(raw_reports(spark, d)).select("report_id", "topic_context", "generated_at")


@query("""SELECT doc_id AS report_id, doc_id % 3 = 0 AS is_validated, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN '[YES] ' ELSE '[PARTIAL] ' END || lang END AS validation_notes FROM documents""")
def report_mark_validated(spark, d):
    docs = v.table(spark, d, "documents")
    archive = docs.select(F.col("doc_id").alias("report_id"), F.lit(False).alias("is_validated"), F.lit(None).cast("string").alias("validation_notes"))
    verdicts = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("report_id"), F.when(F.col("doc_id") % 2 == 0, "yes").otherwise("partial").alias("verdict"), F.col("lang").alias("notes"))
    return reports.mark_validated(archive, verdicts)


@query(f"""WITH {gq._SIGNALS}, s AS (SELECT count(*) AS n FROM (SELECT * FROM signals ORDER BY composite_score DESC, concept_name LIMIT 200))
SELECT source AS topic_context, n AS n_signals, false AS is_validated, TIMESTAMP '2024-01-31' AS generated_at, count(*) AS n_reports FROM documents, s WHERE NOT {_BAD} GROUP BY source, n""")
def report_archive(spark, d):
    """Archived reports, their snapshots read again."""
    good = reports.validate(raw_reports(spark, d)).where("NOT is_fallback").withColumn("model_name", F.lit("stub"))
    top = gq.signals.rank(gq.bridge(spark, d), gq.velocities(spark, d), 200)
    kept = reports.archive(top, good, dt.datetime(2024, 1, 31))
    size = F.size(F.from_json("signals_snapshot", "array<struct<concept_name string>>")).cast("long")
    return kept.select("topic_context", size.alias("n_signals"), "is_validated", "generated_at").groupBy("topic_context", "n_signals", "is_validated", "generated_at").agg(F.count("*").alias("n_reports"))


#: Opinions of an archived JSON text at most.
PART = 1000


def simulation_results(spark, d):
    """Opinions of a user group's events packed as archived JSON, in numbered parts of each direction and round: `result_id(direction, part), results`."""
    placed = numbered(v.opinions(spark, d), ["direction", "round"], ["opinion_id"], "place")
    o = placed.withColumn("part", F.floor(F.col("place") / PART).cast("int"))
    said = F.struct("opinion_id", F.struct("persona", "adoption_likelihood").alias("o"))
    parts = o.groupBy("direction", "round", "part").agg(F.sort_array(F.collect_list(said)).alias("l"))
    rounds = F.array(F.struct(F.col("round").alias("round_number"), F.col("l.o").alias("opinions"))).alias("rounds")
    return parts.select(F.struct("direction", "part").alias("result_id"), F.to_json(F.struct(F.array(F.struct("direction", rounds)).alias("adoption_reports"))).alias("results"))


@query(f"""WITH {v.OPINIONS} SELECT direction AS result_id, direction AS report_direction, round, CAST(row_number() OVER (PARTITION BY direction, round ORDER BY opinion_id) - 1 AS INTEGER) AS pos, persona, adoption_likelihood FROM opinions""")
def simulation_opinions(spark, d):
    found = reports.opinions(simulation_results(spark, d)).drop("confidence_score")
    return found.withColumns({"pos": (F.col("result_id.part") * PART + F.col("pos")).cast("int"), "result_id": F.col("result_id.direction")})


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE event_type END AS persona, CASE WHEN event_id % 3 = 2 THEN NULL ELSE 'high' END AS adoption_likelihood FROM events""")
def parse_opinions(spark, d):
    """Opinions whole, inside prose, and unusable."""
    body = F.to_json(F.struct(F.col("event_type").alias("persona"), F.lit("high").alias("adoption_likelihood")))
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.concat(F.lit("<|channel>thought {\n}<channel|>"), body)).when(k == 1, F.concat(F.lit("I say: "), body, F.lit(" so."))).otherwise(F.lit("none {of it"))
    return consensus.parse_opinions(v.table(spark, d, "events").select("event_id", "event_type", raw.alias("raw"))).select("event_id", "persona", "adoption_likelihood")


_ROUNDS = f"""{v.OPINIONS}, val AS (SELECT *, CASE adoption_likelihood WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.5 ELSE 0.0 END::DOUBLE AS v FROM opinions),
cons AS (SELECT direction, round, count(*) AS n_opinions, CASE WHEN count(*) < 2 THEN 1.0 ELSE round(greatest(0, 1 - var_samp(v) / 0.25), 4) END::DOUBLE AS consensus FROM val GROUP BY ALL),
lastv AS (SELECT direction, persona, round, arg_max(v, opinion_id) AS v FROM val GROUP BY ALL),
moved AS (SELECT *, lag(v) OVER w AS pv, lag(round) OVER w AS pr FROM lastv WINDOW w AS (PARTITION BY direction, persona ORDER BY round)),
shift AS (SELECT direction, round, round(avg(abs(v - pv)), 4) AS s FROM moved WHERE pr = round - 1 GROUP BY ALL),
rounds AS (SELECT cons.*, coalesce(s, 0) AS opinion_shift FROM cons LEFT JOIN shift USING (direction, round)),
verdicts AS (SELECT direction, final_consensus, CASE WHEN final_consensus >= 0.75 THEN 'likely' WHEN final_consensus >= 0.45 THEN 'contested' ELSE 'unlikely' END AS verdict,
  final_consensus > 0.8 AS consensus_reached, n_rounds FROM (SELECT direction, arg_max(consensus, round) AS final_consensus, count(*) AS n_rounds FROM rounds GROUP BY 1))"""


@query(f"WITH {_ROUNDS} SELECT * FROM rounds")
def consensus_rounds(spark, d):
    return consensus.rounds(v.opinions(spark, d))


@query(f"""WITH {_ROUNDS}, stop AS (SELECT direction, min(round) AS r FROM rounds WHERE consensus > 0.6 GROUP BY 1)
SELECT opinion_id, direction, round FROM opinions LEFT JOIN stop USING (direction) WHERE round <= coalesce(r, 2) AND round <= 2""")
def consensus_effective_rounds(spark, d):
    return consensus.effective_rounds(v.opinions(spark, d), 2, 0.6).select("opinion_id", "direction", "round")


@query(f"""WITH {v.OPINIONS}, s AS (SELECT direction, round, opinion_id, unnest(key_concerns) AS concern, unnest(range(len(key_concerns))) AS pos FROM opinions),
f AS (SELECT direction, concern, count(*) AS mentions, min(printf('%02d/%012d/%02d', round, opinion_id, pos)) AS first FROM s GROUP BY ALL HAVING count(*) >= 2)
SELECT direction, concern, mentions, CAST(row_number() OVER (PARTITION BY direction ORDER BY first) AS INTEGER) AS place FROM f""")
def consensus_shared_concerns(spark, d):
    return consensus.shared_concerns(v.opinions(spark, d))


@query(f"WITH {_ROUNDS} SELECT * FROM verdicts")
def consensus_verdicts(spark, d):
    return consensus.verdicts(v.opinions(spark, d))


@query(f"WITH {_ROUNDS} SELECT round(coalesce(avg(final_consensus), 0), 6) AS mean_consensus, CASE WHEN avg(final_consensus) >= 0.7 THEN 'high' WHEN avg(final_consensus) >= 0.4 THEN 'medium' ELSE 'low' END AS confidence FROM verdicts")
def consensus_overall(spark, d):
    return consensus.overall(consensus.verdicts(v.opinions(spark, d)))
