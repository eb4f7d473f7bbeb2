import duckdb
import pytest

from trendloom.llm import mixing


def rows(spark, counts, size=lambda k: 5 + k % 7):
    return spark.createDataFrame([(k + 1000 * n, " ".join(["w"] * size(k)), s) for n, (s, c) in enumerate(counts.items()) for k in range(c)], "doc_id long, text string, source string")


def goals(df):
    return {r.source: (r.source_size, r.target, r.taken) for r in mixing.with_copies(df, df.columns).selectExpr("row.source AS source", "source_size", "target", "copies * size AS t").groupBy("source", "source_size", "target").agg({"t": "sum"}).withColumnRenamed("sum(t)", "taken").collect()}


def test_targets_and_taken_words(spark):
    got = goals(rows(spark, {"a": 300, "b": 300, None: 300, "c": 300}))
    total = sum(x[0] for x in got.values())
    for s, w in (("a", 1), ("b", 2), ("c", 3), (None, 1)):  # null is the last
        assert got[s][1] == pytest.approx(total * w / 7)
        assert got[s][2] == pytest.approx(got[s][1], rel=0.03)


def test_targets_stop_at_three_times_the_size(spark):
    got = goals(rows(spark, {"a": 900, "b": 30, "c": 20}))
    assert got["b"][1] == 3 * got["b"][0] and got["c"][1] == 3 * got["c"][0]
    assert sum(x[1] for x in got.values()) == pytest.approx(sum(x[0] for x in got.values()))
    assert got["c"][2] == 3 * got["c"][0]


def test_empty_texts_nulls_and_clashes(spark):
    df = spark.createDataFrame([(1, None, "a", 1), (2, "", None, 1), (None, "x y", "a", 1), (None, "x y", "a", 1), (4, "z z", "b", 1)], "doc_id long, text string, source string, size int")
    got = sorted((r.doc_id or 0, r["size"], r.source_size) for r in mixing.mix_report(df).collect())
    assert got == [(0, 2, 4), (0, 2, 4), (1, 0, 4), (2, 0, 0), (4, 1, 1)]
    assert mixing.mix(df).columns == df.columns
    assert mixing.mix_report(df.limit(0)).count() == 0 and mixing.mix(df.where("doc_id = 1")).count() == 0


def test_reruns_agree_and_copies_are_emitted(spark):
    df = rows(spark, {"a": 200, "b": 100}).repartition(7)
    once = sorted(tuple(r) for r in mixing.mix_report(df).collect())
    assert once == sorted(tuple(r) for r in mixing.mix_report(df.repartition(3)).collect())
    assert mixing.mix(df).count() == mixing.with_copies(df, df.columns).selectExpr("sum(copies)").first()[0]
    assert all(r[4] <= 3 * r[1] for r in once)


def test_sql_statement(spark, tmp_path):
    df = rows(spark, {"b": 70, "é": 150, None: 40, "": 9, "Z": 3})
    df.coalesce(1).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.MIX_SQL}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in mixing.mix_report(df).orderBy("doc_id").collect()] == want


def test_null_and_evenly_spaced_ids_are_spread_over_salts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SALT_ROWS", 4)
    df = spark.createDataFrame([(64 * k if k % 2 else None, f"some words {k}", "a") for k in range(400)], "doc_id long, text string, source string")
    sized = mixing._sized(df, df.columns)
    assert sized.selectExpr("count(DISTINCT salt)").first()[0] > 60  # of 100, as the table has 400 rows
    assert sized.groupBy("salt").count().agg({"count": "max"}).first()[0] < 20
    placed = mixing.with_copies(df, df.columns)
    assert placed.count() == 400 and placed.selectExpr("sum(copies)").first()[0] == 400
