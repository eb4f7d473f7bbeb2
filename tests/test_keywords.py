"""Keywords, counts, trends and velocity on hand-computed cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trendloom import schemas
from trendloom.functions import text
from trendloom.operators import counts, trends, velocity

PAPER = "arxiv_id string, title string, abstract string, categories array<string>, published_at timestamp"
DAY = dt.datetime(2024, 1, 1)


def papers(spark, rows):
    return spark.createDataFrame(rows, PAPER)


def test_tokens_are_ascii_runs_after_lowering(spark):
    got = spark.createDataFrame([("Étion The GRAPH of ab nets",)], "t string").select(text.tokens(F.col("t"))).first()[0]
    assert got == ["tion", "graph", "nets"]


def test_keywords_ties_keep_first_appearance(spark):
    df = papers(spark, [("1", "Neural Net", "Deep net learning", ["a"], DAY), ("2", None, None, [], DAY)])
    got = [(r.keyword, r.frequency, r["rank"]) for r in text.keywords(df).orderBy("rank").collect()]
    assert got == [("net", 2, 1), ("neural", 1, 2), ("deep", 1, 3), ("learning", 1, 4)]


def test_keywords_stop_at_ten(spark):
    df = papers(spark, [("1", "", " ".join(f"word{c}" for c in "abcdefghijklmnop"), ["a"], DAY)])
    assert text.keywords(df).count() == 10


def test_weighted_concepts(spark):
    docs = spark.createDataFrame([(1, "neural " * 50 + "network " * 30 + "transformer " * 20 + "attention " * 10), (2, "learning " * 10), (3, "the of and"), (4, None)], "paper_id long, text string")
    got = text.weighted_concepts(docs, 3).orderBy("paper_id", "rank").collect()
    assert [(r.paper_id, r.concept) for r in got] == [(1, "neural"), (1, "network"), (1, "transformer"), (2, "learning")]
    assert got[0].weight == pytest.approx(50 / 110) and got[3].weight == 1.0


def test_counts_add_one_per_paper_and_category(spark):
    df = papers(spark, [("1", "graph graph", "", ["x", "y"], dt.datetime(2024, 2, 9)), ("2", "graph", "", [], dt.datetime(2024, 2, 1))])
    got = {(r.keyword, r.category, r.window_date, r["count"]) for r in counts.keyword_counts(text.keywords(df), df).collect()}
    month = dt.datetime(2024, 2, 1)
    assert got == {("graph", "x", month, 1), ("graph", "y", month, 1), ("graph", "all", month, 1)}
    undated = counts.keyword_counts(text.keywords(df), window_date=dt.date(2024, 5, 2)).collect()
    assert [(r.category, r["count"]) for r in undated] == [("all", 2)]


def test_slope_and_direction(spark):
    rows = [("up", "c", dt.datetime(2024, 1, d), n) for d, n in ((1, 1), (5, 3), (9, 5))] + [("one", "c", dt.datetime(2024, 1, 9), 7)]
    kc = spark.createDataFrame(rows, "keyword string, category string, window_date timestamp, count long")
    got = {r.keyword: r.slope for r in trends.keyword_slope(kc, 30, dt.datetime(2024, 1, 10)).collect()}
    assert got == {"up": 2.0, "one": 0.0}
    scored = {r.keyword: r.trend_direction for r in trends.score(kc, dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 10)).collect()}
    assert scored == {"up": "rising", "one": "stable"}


def test_prefix_clusters(spark):
    df = spark.createDataFrame([(1, "attention_mechanism"), (2, "abc"), (3, "attention_head"), (4, "neural_network"), (5, "abc")], "pos int, keyword string")
    got = {r.label: r.members for r in trends.prefix_clusters(df).collect()}
    assert got == {"attention_mechanism": ["attention_mechanism", "attention_head"], "abc": ["abc"], "neural_network": ["neural_network"]}


@pytest.mark.parametrize("series, want", [
    ([10, 15, 25], (10, 5, "accelerating", 3)), ([10, 15, 25, 40], (15, 5, "accelerating", 4)), ([40, 30, 20], (-10, 0, "decelerating", 3)),
    ([10, 20, 15], (-5, -15, "stable", 3)), ([10, 20], (10, 0, "stable", 2)), ([10], (0, 0, "stable", 1)), ([], (0, 0, "stable", 0))])
def test_velocity(spark, series, want):
    rows = [("graph", "c", dt.datetime(2024, 1, 1) + dt.timedelta(weeks=k), n) for k, n in enumerate(series)]
    kc = spark.createDataFrame(rows, schemas.KEYWORD_COUNTS.replace("count", "count"))
    concepts = spark.createDataFrame([("graph of the graph",)], "concept_name string")
    r = velocity.compute(concepts, kc, DAY).first()
    assert (r.velocity, r.acceleration, r.trend, r.weeks_of_data) == want


def test_concept_tokens_fall_back_to_the_name(spark):
    got = {(r.concept_name, r.token) for r in velocity.concept_tokens(spark.createDataFrame([("Graph Nets",), ("of AI",)], "concept_name string")).collect()}
    assert got == {("Graph Nets", "graph"), ("Graph Nets", "nets"), ("of AI", "of ai")}


def test_extractions_of_every_form(spark):
    rows = [("1", '{"concepts": ["A", "", "B"], "methods": []}'), ("2", '```json\n{"concepts": ["A"]}\n```'), ("3", '<THINK>x {</THINK>{"concepts": ["A"]}'), ("4", ""), ("5", "nope {"), ("6", '{"concepts": "A"}'), ("7", None), ("8", "[1]"), ("9", '<think>\n</think>\n\n{"concepts": ["A"]}\n'), ("10", '\r\n\t```json\n\n{"concepts": ["A"]}\n```\n'), ("11", "\n")]
    got = {r.arxiv_id: r.concepts for r in text.parse_extractions(spark.createDataFrame(rows, "arxiv_id string, raw string")).collect()}
    assert got == {"1": ["A", "B"], "2": ["A"], "3": ["A"], "4": [], "5": [], "6": [], "7": [], "8": [], "9": ["A"], "10": ["A"], "11": []}


def test_backend_failure_gives_empty_lists(spark):
    def broken(prompts):
        raise RuntimeError("no backend")

    df = papers(spark, [("1", "t", "a", [], DAY)])
    assert text.extract_with(df, broken).first().concepts == []


def test_a_failing_prompt_costs_no_other_paper_its_concepts(spark):
    def backend(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        if any("short" in p for p in prompts):
            return []
        return [None if "none" in p else '{"concepts": ["' + p.split("\n")[0].removeprefix("Title: ") + '"]}' for p in prompts]

    names = ["bad" if k % 17 == 3 else "short" if k == 40 else "none" if k == 41 else f"t{k}" for k in range(70)]
    df = papers(spark, [(str(k), name, "a", [], DAY) for k, name in enumerate(names)]).repartition(2)
    got = {int(r.arxiv_id): r.concepts for r in text.extract_with(df, backend).collect()}
    assert got == {k: [name] if name == f"t{k}" else [] for k, name in enumerate(names)}
    assert text.extract_with(df.where("false"), backend).count() == 0


def test_strip_takes_all_white_space(spark):
    rows = ["", " a b ", "\t\n\x0b\u2003x\u3000", "\u00a0\u2028", "\u200bz", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(text.strip(F.col("t"))).collect()]
    assert got == [r.strip() if r is not None else None for r in rows]
