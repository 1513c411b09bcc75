import random

import numpy as np
from pyspark.sql import functions as F

from strandlake.llm import language, quality
from strandlake.llm._work import crc_mod

SOUNDS = {"aa": ["ka", "ro", "mi", "ta"], "bb": ["sch", "ung", "er", "ein"], "cc": ["é", "eau", "oi", "que"]}


def _prose(draw, lang, n):
    return " ".join("".join(draw.choices(SOUNDS[lang], k=draw.randrange(2, 5))) for _ in range(n))


def test_languages(spark):
    draw = random.Random(1)
    rows = [(k, _prose(draw, lang, draw.randrange(5, 120)), lang, "x", 1.0) for k in range(300) for lang in [draw.choice(list(SOUNDS))]]
    rows += [(1000, None, "aa", "x", 1.0), (1001, "", "bb", "x", 1.0), (1002, "12 34 !", "cc", "x", 1.0), (1003, _prose(draw, "bb", 9000), None, "x", 1.0), (None, _prose(draw, "aa", 50), "aa", "x", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    model = language.learn(df.where(crc_mod(F.col("doc_id"), 3) != 1))
    assert sorted(model) == ["aa", "bb", "cc"] and all(len(d) <= language.SAMPLE_TEXTS * (language.SAMPLE_BYTES + 1) for d in model.values())
    got = {r.doc_id: r for r in language.classify(df, model).collect()}
    right = [got[i].lang_pred == lang for i, _, lang, *_ in rows[:300]]
    assert sum(right) / len(right) > 0.97
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and all(got[i].rejected and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "bb" and got[1003].score > 0.99 and not got[1003].rejected and got[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.learn(df.limit(0)) == {}
    assert {r.lang_pred for r in language.classify(df, {}).collect()} == {"und"}
    assert language.classify(df.limit(0), model).count() == 0
    # A tie goes to the language that sorts first; repeated rows get the same.
    same = language.classify(df.unionByName(df).where("doc_id < 20"), {"zz": model["aa"], "aa": model["aa"]}).collect()
    assert len(same) == 40 and {r.lang_pred for r in same} == {"aa"}


def test_pairwise_sum_identity():
    draw = np.random.default_rng(2)
    width = quality.BUCKETS + quality.STATISTICS
    m = quality.Machine(0.3, draw.normal(0, 0.1, width), draw.normal(0, 0.1, (width, 3)), np.zeros(width), np.ones(width))
    x = np.zeros((1, width))
    at = [3, 50, width - 1]
    x[0, at] = [1.0, 2.0, -1.5]
    z = 0.3 + x[0] @ m.linear + sum(m.factors[a] @ m.factors[b] * x[0, a] * x[0, b] for k, a in enumerate(at) for b in at[k + 1 :])
    assert abs(m.score(x)[0] - 1 / (1 + np.exp(-z))) < 1e-12


def test_gradients_fit_what_a_linear_model_cannot():
    draw = np.random.default_rng(5)
    x = np.zeros((600, quality.BUCKETS + quality.STATISTICS), np.float32)
    a, b = draw.integers(0, 2, 600), draw.integers(0, 2, 600)
    x[:, 10], x[:, 20] = a * 2 - 1, b * 2 - 1
    y = (a ^ b).astype(np.float32)
    m = quality.fit(x, y)
    assert ((m.score(x) > 0.5) == (y == 1)).mean() > 0.99


def test_quality(spark):
    draw = random.Random(4)
    rows = []
    for k in range(400):
        text = ". ".join(_prose(draw, "aa", 8).capitalize() for _ in range(draw.randrange(3, 20)))
        rows.append((k, text if k % 4 else " ".join(w.upper() + "!!" for w in text.split()), "x", 1))
    rows += [(900, None, "x", 1), (901, "", "x", 1), (902, "a" * 100_000, "x", 1), (5, rows[5][1], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, row int")
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(0, 300)] + [(7, 1, 0), (8, None, 0), (None, 1, 0), (5000, 0, 0)], "doc_id long, quality int, toxic int")
    m = quality.learn(df, labels)
    got = {r.doc_id: r.score for r in quality.score(df, m).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert all((got[k] >= 0.3) == (k % 4 > 0) for k in range(300, 400))
    kept = quality.kept(df, m)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect() if r.doc_id < 400} == {k for k in range(400) if k % 4}
    for few, share in ((labels.limit(0), 0.5), (labels.where("quality = 1"), 1.0)):
        m = quality.learn(df, few)
        assert all(abs(r.score - share) < 0.01 for r in quality.score(df.where("doc_id < 20"), m).collect())
    assert quality.score(df.limit(0), m).count() == 0


def test_all_languages_are_learned(spark):
    draw = random.Random(3)
    sounds = {f"l{k:02}": ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(6)] for k in range(70)}
    texts = [(lang, " ".join("".join(draw.choices(own, k=3)) for _ in range(60))) for lang, own in sounds.items() for _ in range(6 if lang < "l64" else 4)]
    df = spark.createDataFrame([(k, text, lang) for k, (lang, text) in enumerate(texts)], "doc_id long, text string, lang string")
    model = language.learn(df)
    assert sorted(model) == sorted(sounds) and sum(map(len, model.values())) <= language.FULL_LANGUAGES * language.SAMPLE_TEXTS * (language.SAMPLE_BYTES + 1)
    assert {r.doc_id: r.lang_pred for r in language.classify(df, model).collect()} == {k: lang for k, (lang, _) in enumerate(texts)}


def test_languages_after_a_long_preamble(spark):
    draw = random.Random(6)
    rows = [(k, "the same preamble of every text " * 60 + _prose(draw, lang, 2000), lang) for k in range(60) for lang in [draw.choice(list(SOUNDS))]]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = [(k, _prose(draw, lang, 40), lang) for k in range(60) for lang in [draw.choice(list(SOUNDS))]]
    got = {r.doc_id: r.lang_pred for r in language.classify(spark.createDataFrame(tests, "doc_id long, text string, lang string"), model).collect()}
    assert sum(got[k] == lang for k, _, lang in tests) >= 58
