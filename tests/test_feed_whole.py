"""Whole texts pass through the feed's XML."""

from trendloom.plans import intake_queries


def test_long_and_odd_texts_come_back_whole(spark, tmp_path):
    head = "Title of forty letters and a few more on"
    assert len(head) == 40
    texts = {1: "Überlänge <b>&amp; ]]> \U0001f600 " + "слово äöü " * 3000 + "end", 2: "control\x01\x0b signs\ufffe go", 3: "short"}
    rows = [(k, head + t, "en", "s", 0) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {int(r.arxiv_id.split(".")[1]): r for r in intake_queries.feed_abstracts(spark, str(tmp_path)).collect()}
    assert {k: r.abstract for k, r in got.items()} == texts | {2: "control signs go"}
    assert all(r.updated_at.day == 1 + k for k, r in got.items())
