from pyspark.sql import functions as F

from winnow.llm import langid, queries


def test_held_out_accuracy_and_calibration(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.LLM_QUERIES["op6_language_id"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    held = got.join(docs, "doc_id").where("held_out")
    r = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.avg("score").alias("score"),
                 F.avg(F.col("rejected").cast("double")).alias("rejected"), F.min("score"), F.max("score")).first()
    assert r.right > 0.95 and abs(r.right - r.score) < 0.05 and r.rejected < 0.02
    assert 0 <= r["min(score)"] and r["max(score)"] <= 1


def test_odd_documents(odd, none):
    model = langid.fit_model(odd)
    got = {(r.doc_id, r.text): r for r in langid.with_language(odd, model).collect()}
    assert len(got) == odd.distinct().count()
    for (_, text), r in got.items():
        letters = any(c.isalpha() for c in text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
        assert letters or (r.rejected and r.score == 0)
    assert set(langid.with_language(odd, model).columns) == set(odd.columns)
    assert langid.with_language(none, model).count() == 0


def test_nothing_to_learn_from(odd, none):
    model = langid.fit_model(none)
    assert {r.lang_pred for r in langid.with_language(odd, model).collect()} == {"und"}
    one = langid.train(["only one language here"] * 3, ["en"] * 3, epochs=1)
    assert {r.lang_pred for r in langid.with_language(odd, one).collect()} == {"und", "en"}


def test_training_is_repeatable():
    rows = ["the and of with this", "der die das und nicht"] * 20, ["en", "de"] * 20
    first, again = langid.train(*rows), langid.train(*rows)
    assert (first.table == again.table).all() and first.temperature == again.temperature
