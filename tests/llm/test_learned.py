"""Language, quality and main text: held-out accuracy and defined results of odd rows."""

import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from trendloom.llm import html_text, html_training, language_id, quality


@pytest.fixture(scope="module")
def corpus(spark, prose):
    rows = [(k, prose(lang, 40), lang) for k, lang in enumerate(["en", "de", "ru"] * 60)]
    rows += [(900, prose("en", 60) + "\n" + prose("de", 30), None), (901, None, "en"), (902, "12 ½ !?", "en"), (903, "", None), (904, prose("ru", 20000), None), (905, "東京", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language(corpus):
    got = {r.doc_id: r for r in language_id.predict(corpus).collect()}
    lang = {r.doc_id: r.lang for r in corpus.collect()}
    held = [i for i in lang if i < 900 and language_id.held_out(i)]
    assert len(held) > 20 and all(got[i].held_out for i in held)
    assert np.mean([got[i].lang_pred == lang[i] for i in held]) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and not got[i].spans for i in (901, 902, 903))
    spans = got[900].spans
    assert [s.lang for s in spans] == ["en", "de"] and abs(spans[0].n_words - 60) < 8
    assert got[900].lang_pred == "en" and 0.4 < got[900].score < 0.9
    assert got[904].lang_pred == "ru" and got[905].lang_pred in ("en", "de", "ru")
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == len(lang)


def test_language_without_anything_learned(spark):
    df = spark.createDataFrame([(1, "text", None), (None, "text", "en")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.held_out) for r in language_id.predict(df).collect()} == {("und", bool(zlib.crc32(b"1") % 5 == 0)), ("und", False)}
    assert language_id.predict(df.limit(0)).count() == 0


def test_language_filter_keeps_columns_and_clean_documents(corpus):
    kept = language_id.keep_identified(corpus)
    assert kept.columns == corpus.columns
    assert kept.count() == corpus.count() - 3
    # unlike a filter by letters: languages are filled in and corrected, and those not asked for go
    lang = {r.doc_id: r.lang for r in kept.collect()}
    assert lang[900] == "en" and lang[904] == "ru" and all(lang.values())
    wrong = corpus.selectExpr("doc_id", "text", "CASE WHEN doc_id = 7 THEN 'ru' ELSE lang END AS lang")
    assert {r.doc_id: r.lang for r in language_id.keep_identified(wrong).collect()}[7] == "de"
    some = language_id.keep_identified(corpus, languages=["de"]).collect()
    assert {r.lang for r in some} == {"de"} and 55 <= len(some) <= 65


def test_language_scores_against_brute_force(spark, corpus):
    """Counts, log probabilities and a word's score, one n-gram at a time."""
    model = language_id.fit(corpus)
    counts = {lang: {} for lang in model.langs}

    def grams(word):
        marked = f"\x01{word}\x02"
        for n in language_id.NGRAMS:
            for at in range(len(marked) - n + 1):
                if n > 1 or marked[at] not in "\x01\x02":
                    mixed = 0
                    for c in marked[at : at + n]:
                        mixed = (mixed * 1_000_003 + ord(c)) & (1 << 64) - 1
                    mixed = (mixed * (-7046029254386353131 & (1 << 64) - 1) + n) & (1 << 64) - 1
                    mixed -= (mixed >> 63) << 64
                    yield mixed >> 20 & language_id.BUCKETS - 1

    for r in corpus.collect():
        if r.text and r.lang and not language_id.held_out(r.doc_id):
            for w in language_id.WORDS.findall(r.text.lower()):
                for g in grams(w):
                    counts[r.lang][g] = counts[r.lang].get(g, 0) + 1
    labeller = language_id.Labeller(model)
    for word in ("ththe", "schung", "стая", "ß"):
        want = []
        for lang in model.langs:
            total = sum(counts[lang].values())
            want.append(sum(np.log((counts[lang].get(g, 0) + 0.5) / (total + 0.5 * language_id.BUCKETS)) for g in grams(word)))
        got = labeller.score([word])[0].astype(float)
        kept = got > -500  # languages that don't use the word's script are set back
        assert kept.any() and np.allclose(got[kept], np.array(want)[kept], rtol=1e-4)


def test_language_ties_repeated_rows_and_clashing_names(spark):
    """Texts that say nothing of a language fall to the first by name; rows that repeat give rows alike."""
    rows = [(k, "abc abc", lang, "x", 1.0) for k, lang in enumerate(["zz", "aa"] * 20)] + [(100, "abc", None, "x", 1.0)] * 2 + [(None, "abc", None, "x", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    balanced = df.where("doc_id IS NULL OR doc_id >= 100 OR doc_id IN (%s)" % ", ".join(str(k) for lang in (0, 1) for k in [x for x in range(lang, 40, 2) if not language_id.held_out(x)][:10]))
    got = language_id.predict(balanced)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    assert {r.lang_pred for r in got.collect()} == {"aa"} and got.where("doc_id = 100").count() == 2
    kept = language_id.keep_identified(balanced)
    assert kept.columns == df.columns and {r.lang_pred for r in kept.collect()} == {"x"} and {r.lang for r in kept.collect()} == {"aa"}


def test_marks_belong_to_words(spark):
    """Vowel signs, points and decomposed accents; letters are counted without them."""
    split = language_id.words_of
    assert split("हिन्दी भाषा में, 12") == ["हिन्दी", "भाषा", "में"]
    assert split("தமிழ் மொழி") == ["தமிழ்", "மொழி"]
    assert split("שָׁלוֹם עוֹלָם") == ["שָׁלוֹם", "עוֹלָם"]
    assert split("cafe\u0301 o\u0308l 3a_b") == ["cafe\u0301", "o\u0308l", "a", "b"]
    assert split("می\u200cخواهم") == ["می\u200cخواهم"] and split("Straße, l'été!") == ["straße", "l", "été"]
    assert split("\u0301 ॥ 12 \u200d") == []
    assert language_id.letters_of(["cafe\u0301", "ab", "हिन्दी"]).tolist() == [4, 2, 3]
    texts = {"hi": "हिन्दी भाषा में लिखा हुआ पाठ है और यह सरल है", "ta": "தமிழ் மொழியில் எழுதப்பட்ட எளிய உரை இது", "he": "שָׁלוֹם עוֹלָם זֶה טֶקְסְט קָצָר", "fr": "l'e\u0301te\u0301 de\u0301ja\u0300 passe\u0301 a\u0300 la fene\u0302tre"}
    rows = [(k, t, lang) for lang, t in texts.items() for k in range(40)]
    df = spark.createDataFrame([(i, t, lang) for i, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    got = language_id.predict(df).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] and r.score == 1.0 and len(r.spans) == 1 for r in got)
    none = language_id.predict(df.union(spark.createDataFrame([(999, "\u0301\u0302 12", "fr")], df.schema))).where("doc_id = 999").first()
    assert none.lang_pred == "und" and none.score == 0


def test_viterbi_in_step_equals_one_by_one(prose):
    draw = np.random.default_rng(1)
    model = language_id.Model(["a", "b", "c"], draw.normal(-8, 2, (language_id.BUCKETS, 3)).astype(np.float32), np.ones((len(language_id.SCRIPTS) + 1, 3), bool))
    texts = [prose("en", n) for n in (1, 30, 7, 300, 0, 12)]
    words, labels = language_id.Labeller(model).label(texts)
    lone = language_id.Labeller(model)
    for t, w, got in zip(texts, words, labels, strict=True):
        assert lone.label([t])[1][0].tolist() == got.tolist()
        if not w:
            continue
        score = lone.scores[lone.rows([w])].astype(float)
        best, back = score[0].copy(), []
        for row in score[1:]:
            step = best[:, None] - language_id.SWITCH * (1 - np.eye(3))
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + row
        total = lambda path: sum(score[i, k] for i, k in enumerate(path)) - language_id.SWITCH * sum(a != b for a, b in zip(path, path[1:], strict=False))
        assert total(got.tolist()) == pytest.approx(best.max(), rel=1e-5)


@pytest.fixture(scope="module")
def judged(spark, prose):
    rows = [(k, prose("en", 60), 1) if k % 3 else (k, "### ".join(prose("en", 30).split()) if k % 2 else prose("en", 5) * 30, 0) for k in range(300)]
    rows += [(900, None, None), (901, "", None), (902, prose("en", 20000), None)]
    return spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, q, 0) for i, _, q in rows if q is not None], "doc_id long, quality int, toxic int")


def test_quality(judged):
    docs, labels = judged
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r for r in quality.predict(docs, labels).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held) and np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert len(got) == docs.count() and got[900].score == got[901].score and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.predicted == int(r.score >= 0.7) for r in got.values())


def test_quality_with_one_class_or_no_labels(judged):
    docs, labels = judged
    assert {round(r.score, 3) for r in quality.predict(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert {r.score for r in quality.predict(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.predict(docs.limit(0), labels).count() == 0


def test_quality_of_a_doc_id_that_rows_repeat(spark, judged):
    """However often a doc_id comes, one of its texts is learned from, the same on every run."""
    docs, labels = judged
    one = docs.where("doc_id = 0").select(*docs.columns)
    many = docs.union(one.withColumn("text", F.lit("zzz " * 50)).crossJoin(spark.range(300)).drop("id")).repartition(7)
    a, b = ({(r.doc_id, r.score) for r in quality.predict(many, labels).collect()} for _ in range(2))
    assert a == b and len({i for i, _ in a}) == docs.select("doc_id").distinct().count()


def test_quality_features_and_ratios_against_brute_force(prose):
    """Which texts share a feature, by their n-grams of words and of shapes; ratios from counts of documents."""
    r = np.random.default_rng(4)
    texts = [" ".join(r.choice(["Ab", "cd", "e9", "--", "Fgh"], r.integers(1, 9))) for _ in range(60)]

    def shape(word):
        kinds = ["X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word]
        return "".join(k for i, k in enumerate(kinds) if not i or k != kinds[i - 1])

    def brute(text):
        words, shapes = text.lower().split(), [shape(w) for w in text.split()]
        found = {(v, *x[i : i + n]) for v, x in (("w", words), ("s", shapes)) for n in (1, 2, 3) for i in range(len(x) - n + 1)}
        run = 0
        for i, w in enumerate(words):
            run = run + 1 if w in words[max(0, i - quality.RECENT) : i] else 0
            found |= {("run", k) for k in quality.REPEATS if run >= k}
        return found

    owner, bucket = quality.features(texts)
    named = [brute(t) for t in texts]
    got = [bucket[owner == i] for i in range(len(texts))]
    assert [len(x) for x in got] == [len(x) for x in named]
    place = {}
    for x, y in zip(named, got, strict=True):  # one bucket for each name, the same everywhere
        for name in x:
            place[name] = place.get(name, set(y.tolist())) & set(y.tolist())
    assert all(place.values())
    y = np.where(r.random(60) < 0.5, 1, -1)
    model = quality._train(got, y)
    sums = []
    for sign in (1, -1):
        n = np.ones(quality.BUCKETS)
        for x, s in zip(got, y, strict=True):
            n[x] += s == sign
        sums.append(n / n.sum())
    ratio = np.log(sums[0] / sums[1])
    assert np.allclose(model.lengths, ratio**2)
    margins = model.margins(owner, bucket, len(texts))
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.where(ratio != 0, model.weights / ratio, 0)
    for i in range(60):
        own = ratio[got[i]]
        assert margins[i] == pytest.approx(w[got[i]] @ own / np.sqrt(own @ own) + model.bias)


def test_quality_odd_labels_and_bounds(spark, judged, monkeypatch):
    """Contrary labels of an id count as 0, labels without an id nothing; names clash; features on the driver are bounded."""
    docs, labels = judged
    odd = labels.union(spark.createDataFrame([(1, 0, 0), (None, 1, 0), (2, 7, 0)], labels.schema))
    zero = labels.where("doc_id <> 1").union(spark.createDataFrame([(1, 0, 0)], labels.schema))
    by = lambda df: {r.doc_id: r.score for r in df.collect()}
    clash = docs.selectExpr("doc_id", "text", "'x' AS score", "1 AS quality", "'y' AS features")
    assert by(quality.predict(clash, odd)) == by(quality.predict(docs, zero))
    nulls = quality.predict(docs.union(spark.createDataFrame([(None, "some text"), (None, None)], docs.schema)), labels).where("doc_id IS NULL").collect()
    assert len(nulls) == 2 and not any(r.held_out for r in nulls)
    monkeypatch.setattr(quality, "TRAIN_FEATURES", 2000)
    few = by(quality.predict(docs, labels))
    assert few != by(quality.predict(docs, zero)) and all(0 <= x <= 1 for x in few.values())


def test_descent_reaches_the_optimum():
    draw = np.random.default_rng(2)
    rows = [np.sort(draw.choice(50, 6, replace=False)) for _ in range(80)]
    values = [draw.normal(size=6) for _ in rows]
    y = np.where(draw.random(80) < 0.5, 1, -1)
    cost = np.full(80, 0.5)
    w, b = quality.descend(rows, values, y, cost, 400)
    primal = lambda w, b: 0.5 * (w @ w + b * b) + sum(max(0, 1 - s * (w[r] @ v + b)) * 0.5 for r, v, s in zip(rows, values, y, strict=True))
    least = primal(w, b)
    for _ in range(60):
        assert least <= primal(w + draw.normal(size=len(w)) * 1e-3 * (np.arange(len(w)) < 50), b + draw.normal() * 1e-3) + 1e-6


PAGE = """<!DOCTYPE html><html><head><title>no</title></head><body><header><div class="logo">Site name</div></header>
<nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies.</div><script>var a = "<p>x</p>";</script>
<article><h1>The&nbsp;title &amp; more</h1><p>First <b>bold</b> text,
 with   blanks.<p>Second one.<div class="ad">Buy this now.</div><style>p{}</style><p>Third<br>line.</p></article>
<aside class="sidebar"><p>Related things to read.</p></aside><form><label>Your name</label><input></form>
<section class="comments"><article class="comment"><p>I disagree with this article.</p></article></section><footer>&copy; Someone</footer></body></html>"""


def test_html_page():
    assert html_text.model().main_text(PAGE) == "The title & more First bold text, with blanks. Second one. Third line."


def test_html_held_out_layouts():
    field, wrong, total = html_text.model(), 0, 0
    for page in html_training.pages(60, seed=77):
        features, labels = html_text.labelled(page)
        wrong += int((field.decode(features) != np.array(labels)).sum())
        total += len(labels)
    assert wrong <= 0.01 * total


def test_html_viterbi_is_the_best_path():
    from itertools import product

    draw = np.random.default_rng(5)
    model = html_text.Model(draw.normal(size=(html_text.DIMENSIONS, 2)), draw.normal(size=(2, 2)) * 2)
    features = [draw.integers(0, html_text.DIMENSIONS, 4).tolist() for _ in range(8)]
    local = np.array([model.emission[f].sum(axis=0) for f in features])
    score = lambda p: sum(local[i, k] for i, k in enumerate(p)) + sum(model.transition[a, b] for a, b in zip(p, p[1:], strict=False))
    assert tuple(model.decode(features).tolist()) == max(product((0, 1), repeat=8), key=score)


def test_html_odd_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>"), (4, "u", "a < b"), (5, "u", "<article><p>x" + "<div>" * 3000), (6, "u", PAGE), (6, "u", PAGE), (7, "u", "<nav>only</nav>")]
    got = html_text.extract(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == by[3] == by[7] == "" and by[6].startswith("The title & more")
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
