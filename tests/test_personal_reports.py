"""Personal graphs, opinions, reports and hygiene on hand-computed cases."""

import datetime as dt
import json

import pytest

from trendloom.operators import consensus, hygiene, personal, reports

DAY = dt.datetime(2024, 1, 10)


def test_concept_edges(spark):
    rows = [(1, f"c{k:02}", 0.5 - k / 100, k + 1) for k in range(25)] + [(2, "alpha", 0.5, 1), (2, "beta", 0.4, 2), (3, "one", 1.0, 1)]
    got = personal.concept_edges(spark.createDataFrame(rows, "paper_id long, concept string, weight double, rank int")).collect()
    assert sum(r.paper_id == 1 for r in got) == 190
    assert [(r.source_concept, r.target_concept, r.weight) for r in got if r.paper_id != 1] == [("alpha", "beta", 0.2)]


def test_nodes_edges_and_prominence(spark):
    c = spark.createDataFrame([(1, 7, "transformer", 0.15), (1, 7, "attention", 0.10)], "user_id long, paper_id long, concept string, weight double")
    e = spark.createDataFrame([(1, 7, "transformer", "attention", 0.015), (1, 8, "attention", "transformer", 0.5), (1, 7, "transformer", "gone", 0.1)], "user_id long, paper_id long, source_concept string, target_concept string, weight double")
    kept = personal.nodes(c)
    assert [(r.source_concept, r.weight) for r in personal.edges(kept, e).collect()] == [("transformer", 0.015)]
    got = {r.concept: (r.coverage, r.velocity, r.acceleration, r.composite, r.trend) for r in personal.prominence(c).collect()}
    assert got == {"transformer": (1.0, 150.0, 50.0, 150.0, "stable"), "attention": (1.0, 100.0, 50.0, 100.0, "stable")}
    pair = personal.top_pairs(e).where("concept_b = 'transformer'").first()
    assert (pair.concept_a, pair.weight) == ("attention", pytest.approx(0.515))
    doc = json.loads(personal.export_json(c, e).first().document)
    assert len(doc["concepts"]) == 2 and len(doc["edges"]) == 3


def test_process_fails_on_white_space(spark):
    pages = spark.createDataFrame([(1, 2, "graph"), (1, 1, "neural"), (2, 1, " \n"), (3, 1, None)], "paper_id long, page int, text string")
    status, concepts, edges = personal.process(pages)
    got = {r.paper_id: (r.status, r.concept_count, r.error_msg is None) for r in status.collect()}
    assert got == {1: ("processed", 2, True), 2: ("failed", 0, False), 3: ("failed", 0, False)}
    assert [(r.source_concept, r.target_concept) for r in edges.collect()] == [("neural", "graph")] and concepts.count() == 2


OPINION = "direction string, round int, persona string, adoption_likelihood string, key_concerns array<string>, opinion_id long"


def opinions(spark, *rounds):
    rows = [("d", k, f"p{i}", x, ["cost"], 10 * k + i) for k, r in enumerate(rounds, 1) for i, x in enumerate(r)]
    return spark.createDataFrame(rows, OPINION)


@pytest.mark.parametrize("said, want", [(["high"] * 3, 1.0), (["low"] * 3, 1.0), (["high", "medium", "low"], 0.0), (["high", "high", "medium"], 0.6667), (["high"], 1.0), (["high", "low"], 0.0)])
def test_consensus(spark, said, want):
    assert consensus.rounds(opinions(spark, said)).first().consensus == want


def test_shift_verdict_and_concerns(spark):
    df = opinions(spark, ["high", "medium"], ["low", "medium"], ["low", "low"])
    got = {r["round"]: r.opinion_shift for r in consensus.rounds(df).collect()}
    assert got == {1: 0.0, 2: 0.5, 3: 0.25}
    v = consensus.verdicts(df).first()
    assert (v.verdict, v.consensus_reached, v.n_rounds) == ("likely", True, 3)
    assert [(r.concern, r.mentions) for r in consensus.shared_concerns(df).collect()] == [("cost", 6)]
    assert consensus.overall(consensus.verdicts(df)).first().confidence == "high"
    assert consensus.overall(consensus.verdicts(df.limit(0))).first().confidence == "low"
    assert consensus.effective_rounds(opinions(spark, ["high", "high"], ["low", "low"])).count() == 2


def report(n=3):
    return {"emerging_directions": [{"direction": f"d{k}", "reasoning": "r", "confidence": "high"} for k in range(n)], "underexplored_gaps": [{"gap": "g", "reasoning": "r"}] * 3,
            "predicted_convergences": [{"concept_a": "a", "concept_b": "b", "reasoning": "r"}] * 2, "time_horizon_months": 12, "overall_confidence": "medium"}


def test_reports(spark):
    rows = [(1, json.dumps(report())), (2, json.dumps(report(2))), (3, json.dumps(report(4))), (4, "not json"), (5, "```json\n" + json.dumps(report()) + "\n```"), (6, None), (7, "[]")]
    got = reports.validate(spark.createDataFrame(rows, "report_id long, raw string"))
    assert {r.report_id: r.is_fallback for r in got.collect()} == {1: False, 2: True, 3: True, 4: True, 5: False, 6: True, 7: True}
    assert reports.directions(got).count() == 21 and reports.convergences(got).where("concept_a = 'Unknown'").count() == 10
    archive = spark.createDataFrame([(1, False, None), (2, False, None)], "report_id long, is_validated boolean, validation_notes string")
    marked = reports.mark_validated(archive, spark.createDataFrame([(1, "yes", "good")], "report_id long, verdict string, notes string"))
    assert {(r.report_id, r.is_validated, r.validation_notes) for r in marked.collect()} == {(1, True, "[YES] good"), (2, False, None)}


def test_hygiene(spark):
    users = spark.createDataFrame([(1, DAY - dt.timedelta(days=31), 30), (2, None, 0), (3, DAY, 5)], "id long, last_login timestamp, lifetime_uploads long")
    up = spark.createDataFrame([(10, 1, "failed", "/a", DAY - dt.timedelta(days=2)), (11, 2, "failed", None, DAY - dt.timedelta(days=2)), (12, 3, "pending", "/c", DAY)], "id long, user_id long, status string, upload_path string, created_at timestamp")
    kept, paths = hygiene.expire_users(users, {"user_papers": up}, DAY)
    assert sorted(r.id for r in kept["user_papers"].collect()) == [11, 12] and [r.upload_path for r in paths.collect()] == ["/a"]
    stale, after = hygiene.stale_uploads(up, DAY)
    assert [r.id for r in stale.collect()] == [10] and {r.id: r.upload_path for r in after.collect()} == {10: None, 11: None, 12: "/c"}
    audit = {r.user_id: (r.lifetime_reached, r.active) for r in hygiene.quota_audit(users, up).collect()}
    assert audit == {1: (True, 0), 2: (False, 0), 3: (False, 1)}
