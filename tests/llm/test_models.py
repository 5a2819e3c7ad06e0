"""The learnt models against plain versions: the ranking's fit, and kernel ridge regression."""

from __future__ import annotations

import random

import numpy as np


def test_ranking_is_the_least_of_its_loss():
    """Newton's weights against plain gradient descent on the loss of the same pairs, and the threshold against all quantiles."""
    from pagewright.llm import quality

    rng = np.random.default_rng(1)
    good, bad = rng.normal(0.4, 1, (60, 5)), rng.normal(-0.4, 1.5, (50, 5))
    model = quality.fit(good, bad, ridge=0.05)
    pick = np.random.default_rng(5)
    n = min(quality.MOST_PAIRS, 40 * 110)
    i, j = pick.integers(60, size=n), pick.integers(50, size=n)
    spread = np.concatenate([good, bad]).std(axis=0)
    diff = (good[i] - bad[j]) / spread
    w = np.zeros(5)
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-diff @ w))
        w -= 0.3 * (diff.T @ (p - 1) / n + 0.05 * w)
    assert np.allclose(model.weights, w, atol=1e-5)
    s_good, s_bad = model.strength(good), model.strength(bad)
    strengths = np.sort(np.concatenate([s_good, s_bad]))
    right = lambda t: (s_good > t).mean() + (s_bad < t).mean()
    assert np.isclose(right(model.threshold), max(right((a + b) / 2) for a, b in zip(strengths, strengths[1:])))
    assert np.isclose(model.score(np.array([good[0]]))[0] >= quality.CUT, s_good[0] >= model.threshold)


def test_cells_are_those_of_the_n_grams():
    """The array form of a text's cells against one n-gram at a time."""
    from pagewright.llm import language

    for text in ("Straße", "a b\tc", "été 12", "日本語テキスト", "x", ""):
        want = np.zeros(language.DIM, bool)
        for n in (1, 2, 3):
            for k in range(len(text) - n + 1):
                # The cell of an n-gram in any text is the one that its first n-gram alone adds to those of its parts.
                piece = text[k : k + n]
                inner = np.zeros(language.DIM, bool)
                for m in range(1, n):
                    for at in range(n - m + 1):
                        inner |= language.grams(piece[at : at + m])
                want |= language.grams(piece) | inner
        assert (language.grams(text) == want).all()
        assert (language.grams(text) == language.grams(text.lower())).all()


def test_prediction_is_kernel_ridge_regression():
    """With every text a landmark, the Nystroem form gives the values of the dual solution on the full kernel."""
    from pagewright.llm import language

    rng = random.Random(4)
    words = {"aa": "der die und ist nicht mit von", "bb": "the and is not with of from", "cc": "les des est pas avec dans pour"}
    texts, names = [], []
    for name, pool in words.items():
        for _ in range(12 if name != "cc" else 7):
            texts.append(" ".join(rng.choice(pool.split()) + rng.choice(["", "e", "n", "x"]) for _ in range(25)))
            names.append(name)
    rows = np.array([language.grams(t) for t in texts], np.uint8)
    model = language.fit(rows, names, n_landmarks=len(rows), ridge=1e-2)
    sets = [set(np.flatnonzero(r)) for r in rows]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    y = np.array([[1.0 if n == name else -1.0 for name in model.languages] for n in names])
    weight = np.array([1 / names.count(n) for n in names])
    dual = np.linalg.solve(kernel + 1e-2 * 3 / 10 * np.diag(1 / weight), y)
    x = rows.astype(np.float32)
    got = ((x @ model.landmarks) / np.sqrt(x.sum(axis=1))[:, None]) @ model.weights
    assert np.allclose(got, kernel @ dual, atol=2e-2)
    best, share = model.predict(rows)
    assert [model.languages[b] for b in best] == names and ((share > 1 / 3) & (share <= 1)).all()


def test_samples_are_bounded_by_rows(spark, monkeypatch):
    """One labelled id that stands very often is one row of what is learnt from."""
    from pagewright.llm import language, quality

    seen = {}
    monkeypatch.setattr(quality, "fit", lambda good, bad: seen.update(quality=(len(good), len(bad))))
    monkeypatch.setattr(language, "fit", lambda rows, langs, n: seen.update(language=(len(rows), sorted(set(langs)))))
    often = spark.range(20_000).selectExpr("1L AS doc_id", "concat('the words of it ', id % 7) AS text", "'en' AS lang")
    others = spark.range(2, 60).selectExpr("id AS doc_id", "concat('other words ', id) AS text", "CASE WHEN id % 2 = 0 THEN 'en' ELSE 'de' END AS lang")
    docs = often.unionByName(others)
    labels = spark.range(1, 60).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    quality.learn(docs, labels, per_class=20)
    assert seen["quality"] == (20, 20)
    language.learn(docs, per_language=25)
    assert seen["language"] == (50, ["de", "en"])


def test_two_hundred_languages_all_have_landmarks(spark):
    from pagewright.llm import language

    letters = [chr(0x3400 + k) for k in range(200)]
    rows = [(k * 200 + n, " ".join([letters[n]] * 4) + f" w{k}", f"l{n:03}") for n in range(200) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs)
    assert len(model.languages) == 200 and model.landmarks.shape[1] == 400
    got = language.identified(docs.where("doc_id < 200"), model, ["doc_id", "lang"])
    assert got.where("lang = lang_pred").count() >= 190
    assert len(language.learn(docs, most_rows=200).languages) == 200
