import zlib

from pyspark.sql import functions as F

from boxwise.llm import catalog, langid

from .helpers import documents, rnd

WORDS = {"en": "the of and house river light when that with from".split(), "de": "der und nicht haus fluss licht schön über ein mit".split(), "fr": "le et maison rivière lumière quand avec dans où déjà".split()}


def corpus(spark, n=60):
    r = rnd(2)
    rows, i = [], 0
    for lang, words in WORDS.items():
        for _ in range(n):
            rows.append((i, " ".join(r.choice(words) for _ in range(r.randrange(4, 60))), lang, f"src{i % 3}", 5))
            i += 1
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "123 !? 45", "en", "s", 0), (903, "the river and the light", None, "s", 0), (None, "der fluss und das licht", "de", "s", 0), (904, "the of and " * 40000, "en", "s", 0), (3, rows[3][1], "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return rows, spark.createDataFrame(rows, schema).selectExpr("*", "1 AS label", "2 AS mark", "3 AS key")


def test_held_out_texts_are_told_apart(spark):
    rows, docs = corpus(spark)
    model = langid.fit(docs.filter(~langid.held_out()))
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows) and set(docs.columns) < set(got[0].asDict())
    clean = [g for g in got if g.doc_id is not None and g.doc_id < 900]
    assert sum(g.lang == g.lang_pred for g in clean) >= 0.97 * len(clean)
    by = {g.doc_id: g for g in got}
    for i in (900, 901, 902):
        assert by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected
    assert by[903].lang_pred == "en" and by[None].lang_pred == "de" and by[904].lang_pred == "en"
    assert all(0 <= g.score <= 1 for g in got)
    assert not any(g.rejected for g in clean)


def test_held_out_is_the_given_remainder(spark):
    rows, docs = corpus(spark, 5)
    for r in docs.select("doc_id", langid.held_out().alias("h")).collect():
        assert r.h == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_far_texts_are_rejected(spark):
    _, docs = corpus(spark)
    model = langid.fit(docs.filter(~langid.held_out()))
    odd = documents(spark, [(1, "zqxj wvkq xxjq " * 20), (2, "the river and the light of the house")])
    assert {r.doc_id: r.rejected for r in langid.predict(odd, model).collect()} == {1: True, 2: False}


def test_without_training_rows(spark):
    _, docs = corpus(spark, 5)
    model = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert model is None
    assert {r.lang_pred for r in langid.predict(docs, model).collect()} == {"und"}
    assert langid.predict(docs.limit(0), langid.fit(docs)).count() == 0


def test_query_on_held_out_rows(spark, small):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = catalog.QUERIES["op10_language"](spark, small).collect()
    assert len(got) == len(truth)
    held = [g for g in got if g.held_out]
    assert sum(g.lang_pred == truth[g.doc_id] for g in held) >= 0.95 * len(held)
    assert sum(g.rejected for g in got) <= 0.02 * len(got)


def test_every_language_keeps_rows_in_a_small_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 30)
    _, docs = corpus(spark)
    assert langid.fit(docs).labels == ["de", "en", "fr"]
    assert len(WORDS) * 10 == 30 and langid.rows_each(3) == langid.FEWEST and langid.rows_each(1, 7) == 7
