"""Golden cases of the text rules, the endpoint fold and the error rate."""

from pyspark.sql import functions as F

from parley.functions.text import hallucination_reason
from parley.operators.intervals import der
from parley.operators.ordered import dedupe_recent, endpoint


def test_hallucination_rules(spark):
    cases = [
        ("", "en", None), (None, "en", None), ("x", "en", "too_short"), ("你好 there", "en", "wrong_script"), ("你好 there", "zh", None),
        ("a b " * 41, "en", "too_long"), ("no " * 8, "en", "repetition"), ("Thanks for watching!", "en", "known_phrase"), ("A real sentence here.", "en", None),
    ]
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang, _) in enumerate(cases)], "i int, t string, lang string")
    got = df.select("i", hallucination_reason(F.col("t"), F.col("lang")).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == [c[2] for c in cases]


def test_endpoint(spark):
    speech = [True] * 20 + [False] * 6 + [True] * 60
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(speech)], "stream_id long, seq long, is_speech boolean")
    got = [(r["first"], r["last"], r["n_chunks"]) for r in endpoint(df).orderBy("first").collect()]
    assert got == [(0, 24, 25), (26, 72, 47)]


def test_dedupe_recent(spark):
    texts = ["Hi.", "hi", "a1", "b1", "c1", "d1", "e1", "hi", "", None]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "s long, i long, t string")
    assert sorted(r.i for r in dedupe_recent(df, "s", "i", "t").collect()) == [0, 2, 3, 4, 5, 6, 7]


def test_der_counts_miss_false_alarm_and_confusion(spark):
    ref = spark.createDataFrame([("f", "A", 0.0, 4.0), ("f", "B", 4.0, 8.0)], "file_id string, speaker string, start double, end double")
    hyp = spark.createDataFrame([("f", 1, 0.0, 4.0), ("f", 1, 4.0, 5.0), ("f", 2, 5.0, 8.0)], "file_id string, speaker_id int, start double, end double")
    row = der(ref, hyp, 0.5, 0.1).first()
    assert (row.miss, row.fa, row.confusion, row.speech) == (0, 0, 1, 14)
