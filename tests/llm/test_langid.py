import zlib

import numpy as np

from cohortspan.llm import langid
from cohortspan.llm.common import prepare
from tests.llm.conftest import ODD, make


def test_held_out_accuracy(spark):
    docs = prepare(spark).read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]
    assert len(held) > 100 and np.mean(held) > 0.98


def test_scores_are_those_of_naive_bayes():
    rng = np.random.default_rng(0)
    weights = np.log(rng.dirichlet(np.ones(langid.BUCKETS), 3).T)
    model = langid.Model(("a", "b", "c"), weights.astype(np.float32), np.log([0.5, 0.25, 0.25]))
    texts = ["Hello wörld", "x", "ab " * 200_000, "日本"]
    for text, got in zip(texts, model.scores(texts)):
        points = langid.code_points(text)
        want = model.priors + sum(model.weights[langid.gram_buckets(points, n)].sum(axis=0, dtype=float) for n in langid.ORDERS)
        assert np.allclose(got, want, rtol=1e-6)


def test_odd_rows(spark, odd, empty):
    got = langid.identify(odd).collect()
    assert len(got) == len(ODD)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (5, 6, 7, 11)} == {"und"}
    assert all(r["score"] == 0.0 for r in got if r["lang_pred"] == "und")
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert {r["lang_pred"] for r in got} - {"und"} <= {"en", "de", "fr"}
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns
    assert not {5, 6, 7, 11} & {r["doc_id"] for r in kept.collect()}
    assert langid.identify(empty).count() == 0 and langid.keep_identified(empty).count() == 0


def test_texts_of_unlearned_scripts_go(spark):
    docs = prepare(spark).read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    letters = np.random.default_rng(3).choice(list("abcdefghijklmnopqrstuvwxyz     "), 3000)
    strange = ["η γρήγορη καφέ αλεπού πηδάει πάνω από το σκυλί", "быстрая коричневая лиса прыгает через собаку " * 200, "敏捷的棕色狐狸跳过了懒狗", "".join(letters)]
    more = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(strange)], docs.schema)
    kept = [r["doc_id"] for r in langid.keep_identified(docs.union(more)).select("doc_id").collect()]
    assert sorted(kept) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_likeness_of_a_text_does_not_grow_with_its_length():
    weights = np.log(np.full((langid.BUCKETS, 1), 1e-6))
    weights[langid.gram_buckets(langid.code_points("ab" * 5), 2)] = np.log(0.4)
    model = langid.Model(("a",), weights, np.zeros(1), np.array([np.log(0.4)]))
    short, long, none, empty = model.judged(["abab", "abab" * 1000, None, "1"])[2]
    assert 0 < short < 1 and abs(short - long) < 0.15 and none == empty == 0
    assert langid.Model(("a",), weights, np.zeros(1)).judged(["日本"])[2] == [1.0]


def test_nothing_to_learn_from(spark):
    rows = make(spark, [(1, "some text"), (2, "..."), (3, None)])
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(rows).collect()} == {(k, "und", 0.0) for k in (1, 2, 3)}
    assert [r["doc_id"] for r in langid.keep_identified(rows).collect()] == [1]


def test_label_and_source_are_no_inputs(docs):
    from pyspark.sql import functions as F

    held = langid.held_out(F.col("doc_id"))
    twisted = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    key = lambda rows: sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in rows)
    assert key(langid.identify(twisted).collect()) == key(langid.identify(docs).collect())
