import corpus_pipeline
import pytest
from test_line_dedup import brute as brute_lines
from test_simhash import brute as brute_groups

from trendloom.llm import mixing
from trendloom.llm.pieces import MODEL, processor
from trendloom.llm.queries import QUERIES


def written(docs, rows, path):
    docs(rows).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_take_effect_in_order(spark, docs, prose, tmp_path):
    passage = prose("en", 60)
    texts = [prose("en", 80) for _ in range(30)]
    rows = [*enumerate(texts), (50, texts[3]), (51, "== 12 =="), (52, None), (53, passage + "\nfirst end of it here"), (54, passage + "\nan other end there was")]
    out = corpus_pipeline.run(spark, written(docs, rows, tmp_path)).collect()
    kept = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    expected = brute_lines(kept)
    assert expected[50] == [] and expected[54] == "an other end there was".split()
    groups = brute_groups([(i, " ".join(w)) for i, w in expected.items()])
    stay = {i for i in expected if groups[i][1] == i}
    assert {r.doc_id for r in out} <= stay  # the mix takes some of them, none or several times
    sp = processor(MODEL)
    texts = dict(rows) | {50: "", 54: "an other end there was"}
    assert all(r.same and r.ids == sp.encode(texts[r.doc_id]) for r in out) and len(out) > 5


def test_every_stage_by_brute_force(spark, docs, prose, tmp_path):
    """Each stage on what the one before kept: nulls, repeated ids with unlike texts, empty texts, clashing names."""
    a, b, c = (prose("en", 70) for _ in range(3))
    german = prose("de", 70)
    rows = [(1, a), (1, b), (2, a), (2, a), (3, None), (4, ""), (5, "12 !!"), (None, c), (None, german), (6, c + "\nmore of this text"), (7, german)]
    rows += [(k, prose(("en", "de")[k % 2], 60)) for k in range(100, 130)]
    df = docs(rows)
    settings = dict(spark.conf.getAll)
    corpus_pipeline.identify_language(spark, df, "").write.parquet(f"{tmp_path}/1")
    one = spark.read.parquet(f"{tmp_path}/1")
    assert one.columns == df.columns and sorted(x.text for x in one.collect()) == sorted(t for _, t in rows if t and any(map(str.isalpha, t)))
    corpus_pipeline.dedup_lines(spark, one, "").write.parquet(f"{tmp_path}/2")
    two = spark.read.parquet(f"{tmp_path}/2")
    texts = sorted((x.doc_id if x.doc_id is not None else -1, x.text) for x in two.collect())
    # the documents without an id come first, then 1 with either text; copies of a document stay until the next stage
    assert texts == sorted([(-1, c), (-1, german), (1, a), (1, b), (2, ""), (2, ""), (6, "more of this text"), (7, "")] + [r for r in rows if (r[0] or 0) >= 100])
    corpus_pipeline.drop_near_duplicates(spark, two, "").write.parquet(f"{tmp_path}/3")
    three = spark.read.parquet(f"{tmp_path}/3")
    empty = [x for x in three.collect() if x.text == ""]
    assert [x.doc_id for x in empty] == [2] and three.count() == two.count() - 2 and three.columns == df.columns
    corpus_pipeline.mix_sources(spark, three, "").write.parquet(f"{tmp_path}/4")
    four = spark.read.parquet(f"{tmp_path}/4")
    assert four.columns == df.columns and {x.text for x in four.collect()} <= {x.text for x in three.collect()}
    assert four.count() == mixing.with_copies(three, three.columns).selectExpr("sum(copies)").first()[0]
    sp = processor(MODEL)
    last = corpus_pipeline.encode(spark, four, "").collect()
    assert len(last) == four.count() and all(r.same for r in last)
    assert sorted(map(tuple, (r.ids for r in last))) == sorted(tuple(sp.encode(x.text)) for x in four.collect())
    assert dict(spark.conf.getAll) == settings  # no stage changes the caller's session


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, None), (None, "")], [(1, "one text")]])
def test_small_tables(spark, docs, rows, tmp_path):
    out = corpus_pipeline.run(spark, written(docs, rows, tmp_path)).collect()
    assert [r.doc_id for r in out] == [i for i, t in rows if t]


CLASHES = ["_", "_id", "_mark", "_none", "_own_id", "_own_none", "_own_mark", "row", "fp", "id", "mark", "none", "n", "k", "key", "root", "node", "lead", "runs", "copies", "Text", "odd name.x"]


def test_stages_keep_columns_of_any_name(spark, prose):
    """Columns named as those that stages use inside keep their values."""
    rows = [(k, prose("en", 60), "en", "s", 9) + tuple(f"{c}{k}" for c in CLASHES[:-1]) + (k,) for k in range(8)]
    rows += [rows[3], (9, rows[2][1], *rows[2][2:])]
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
    df = spark.createDataFrame(rows, names)
    texts = {r[0]: r[5:] for r in rows}
    case = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")  # for text beside Text
    try:
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, "")
            assert out.columns == names, name
            got = out.collect()
            assert got and all(tuple(r)[5:] == texts[r[0]] for r in got), name
            if name == "SimHash near-dedup":
                assert sorted(r[0] for r in got) == list(range(8))
        assert corpus_pipeline.encode(spark, df, "").count() == len(rows)
    finally:
        spark.conf.set("spark.sql.caseSensitive", case)


def test_stages_and_names():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
