"""Best rows and row numbers of groups, one of which holds most of the table."""

import random

from pyspark.sql import functions as F

from trendloom.operators import placing, trends


def table(spark):
    r = random.Random(5)
    rows = [("hot", r.randint(0, 300), k) for k in range(900)] + [(g, r.randint(0, 9), k) for g in ("a", "b", None) for k in range(20)] + [("one", None, 1)]
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, v int, id long").repartition(6)


def test_top_rows(spark):
    rows, df = table(spark)
    got = sorted(map(str, placing.top_rows(df, ["g"], [F.desc("v"), "id"], 7).collect()))
    want = []
    for g in {x[0] for x in rows}:
        want += sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is None, -(x[1] or 0), x[2]))[:7]
    assert got == sorted(str(r) for r in spark.createDataFrame(want, df.schema).collect())
    assert placing.top_rows(df.where("false"), ["g"], ["id"], 3).count() == 0


def test_numbered(spark):
    rows, df = table(spark)
    got = {(r.g, r.id): r.place for r in placing.numbered(df, ["g"], ["v", "id"], "place").collect()}
    for g in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        assert [got[x[0], x[2]] for x in own] == list(range(len(own)))
    plan = placing.numbered(df, ["g"], ["v", "id"], "place")._jdf.queryExecution().optimizedPlan().toString()
    assert all("_range" in x for x in plan.split("\n") if "windowspecdefinition" in x)  # no window holds a whole group's rows
    assert placing.numbered(df.where("false"), ["g"], ["id"], "place").count() == 0


def test_prefix_members(spark):
    words = ["graph", "grape", "graphs", "art", "art", "arts", "artist", "net", "networks"]
    df = spark.createDataFrame(list(enumerate(words)), "pos long, keyword string")
    got = sorted((r.label, r.pos, r.keyword) for r in trends.prefix_members(df).collect())
    assert got == sorted([("graph", 0, "graph"), ("graph", 1, "grape"), ("graph", 2, "graphs"), ("art", 3, "art"), ("arts", 5, "arts"), ("artist", 6, "artist"), ("net", 7, "net"), ("networks", 8, "networks")])
    assert {r.label: r.members for r in trends.prefix_clusters(df).collect()} == {"graph": ["graph", "grape", "graphs"], "art": ["art"], "arts": ["arts"], "artist": ["artist"], "net": ["net"], "networks": ["networks"]}
