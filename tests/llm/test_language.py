import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.llm import language

FOLDER = "/root/testdata/sf0.001"
EN, DE, ZH = "The village clinics near the river changed slowly, and nobody noticed it.", "Die Ergebnisse lassen sich nicht ohne Weiteres auf andere Orte übertragen.", "本文比较了两个小村的成本，并指出若干差异。"


@pytest.fixture(scope="module")
def samples(spark):
    return spark.read.parquet(f"{FOLDER}/lang_samples.parquet")


def test_held_out(samples):
    rows = [(r["lang"], r["text"]) for r in samples.orderBy("sample_id").collect()]
    model = language.train([x for i, x in enumerate(rows) if i % 3])
    held = [x for i, x in enumerate(rows) if i % 3 == 0]
    got = language.judge(model, [t for _, t in held])
    assert np.mean([a == g[0] for (a, _), g in zip(held, got)]) >= 0.98


def test_probabilities_sum_to_one():
    model = language.train([("xx", "abab abba baab aab"), ("yy", "cdcd dccd")], order=3)
    letters = [*"abcd", " ", "'"]
    for context in ("ab", "ba", " a", "zz"):
        scores = []
        for c in letters:
            chars, starts = language.encode([f"{context}{c}"])
            before, start0 = language.encode([context])
            scores.append(float(model.score(chars, starts)[0, 0] - model.score(before, start0)[0, 0]))
        assert 0.5 < np.exp(scores).sum() < 1.05


CASES = [
    (1, EN, "en", None), (2, EN, "fr", (-1, "en")), (3, DE, None, (-1, "de")), (4, DE, "German", None), (5, ZH, "und", (-1, "zh")), (6, f"{EN}\n\n{DE}\n{EN}", "en", "mixed"),
    (7, None, "en", None), (8, "  \n ", None, None), (9, EN, "en-GB", None), (10, EN, "italian", (-1, "en")), (11, (EN + " ") * 3000, "", (-1, "en")),
]


def test_documents(spark, samples):
    docs = spark.createDataFrame([(k, t, lang, 0, "z") for k, t, lang, _ in CASES], "doc_id long, text string, lang string, seg int, mixed string")
    found = language.languages(docs, samples, "doc_id", "text", "lang")
    rows = found.collect()
    whole = {r["doc_id"]: r for r in rows if r["seg"] == -1}
    assert len(whole) == len(CASES)
    for k, _, _, want in CASES:
        r = whole[k]
        if want == "mixed":
            assert r["mixed"] and [(x["seg"], x["lang"]) for x in rows if x["doc_id"] == k and x["seg"] >= 0] == [(0, "en"), (1, "de"), (2, "en")]
        elif want:
            assert not r["mixed"] and r["lang"] == want[1] and r["named"] != r["lang"] and 0.5 < r["confidence"] <= 1
        else:
            assert r["lang"] is None or r["named"] == r["lang"]
    assert language.languages(docs.limit(0), samples, "doc_id", "text", "lang").count() == 0
    with pytest.raises(ValueError):
        language.languages(docs, samples.limit(0), "doc_id", "text", "lang")


@pytest.mark.parametrize("label,code", [("EN", "en"), ("eng", "en"), ("pt-BR", "pt"), ("zh_CN", "zh"), (" Español ", "es"), ("N/A", ""), (None, ""), (" ", ""), ("Unknown", ""), ("Italian", "italian"), ("中文", "zh"), ("ger", "de")])
def test_labels(spark, label, code):
    assert spark.createDataFrame([(label,)], "l string").select(language.label_language(F.col("l")).alias("c")).first()["c"] == code


def test_calibration(samples):
    """On samples held out, confidence is about the share of right answers, and no sound text is rejected."""
    rows = [(r["lang"], r["text"]) for r in samples.orderBy("sample_id").collect()]
    model = language.calibrated([x for i, x in enumerate(rows) if i % 4])
    held = [x for i, x in enumerate(rows) if i % 4 == 0]
    assert not any(g[2] for g in language.judge(model, [t for _, t in held]))
    words = [(lang, w) for lang, t in held if lang != "zh" for w in language._split(t)]
    got = language.judge(model, [w for _, w in words])
    right, sure = np.mean([a == g[0] for (a, _), g in zip(words, got)]), np.mean([g[1] for g in got])
    assert abs(right - sure) < 0.06 and 0.05 < model.temper < 2


def test_rejection(samples):
    rows = [(r["lang"], r["text"]) for r in samples.orderBy("sample_id").collect()]
    model = language.calibrated(rows)
    strange = ["qwx zzkj vvpq wwxk jjqz", "Это русский текст о погоде", "αυτό είναι ένα κείμενο", "これはひらがなのぶんです", "12 34 56"]
    sound = [EN, DE, ZH, "Un texte français tout à fait ordinaire sur le jardin.", "𠀋𠮟𡈽村庄的成本比较", EN.upper()]
    assert all(g[2] for g in language.judge(model, strange)) and not any(g[2] for g in language.judge(model, sound))
