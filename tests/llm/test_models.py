"""What the two models learn and score, against plain restatements."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from glyphsift.llm import language, pieces, toxicity
from tests.llm.test_operators import DOCS, PIECE, VOCABULARY, prose


def held_out(k):
    return zlib.crc32(str(k).encode()) % 3 == 1


def best_pieces(index, scores, word):
    """Pieces of the best segmentation by trying every end; of equal ones the one with the longest last piece."""
    best = {0: (0.0, [])}
    for e in range(1, len(word) + 1):
        ways = [(best[s][0] + scores[word[s:e]], -s, best[s][1] + [index[word[s:e]]]) for s in range(e) if word[s:e] in index]
        best[e] = (lambda w: (w[0], w[2]))(max(ways, key=lambda w: w[:2])) if ways else (best[e - 1][0] - 1e6, best[e - 1][1])
    return best[len(word)][1]


def summed(table, word):
    """Probability of a word, over all its segmentations."""
    if not word:
        return 1.0
    out = sum(table[word[:n]] * summed(table, word[n:]) for n in range(1, len(word) + 1) if word[:n] in table)
    return out if word[0] in table else out + 1e-9 * summed(table, word[1:])


def test_language_is_brute_force(spark):
    r, kinds = random.Random(1), {"en": "the thing with nation".split(), "fr": "les eaux ou une".split(), "de": "der einem und nicht".split()}
    rows = [(k, " ".join(r.choice(kinds[x]) for _ in range(r.randint(1, 9))), x) for k, x in enumerate(["en", "fr", "de"] * 12)]
    model = language.train(spark.createDataFrame(rows, DOCS + ", lang string"), PIECE)
    p = pieces.Pieces(PIECE)
    index, scores = {s: i for i, (s, _) in enumerate(p.pieces)}, dict(p.pieces)
    tables = {}
    for x in sorted(kinds):
        counts = Counter(i for k, t, y in rows if y == x and not held_out(k) for w in t.split() for i in best_pieces(index, scores, "▁" + w))
        total = sum(counts.values()) + language.ALPHA * len(p.pieces)
        tables[x] = {s: (counts[i] + language.ALPHA) / total for i, (s, _) in enumerate(p.pieces)}
    assert model.languages == sorted(kinds)
    for j, x in enumerate(model.languages):
        assert np.allclose(model.probabilities[:, j], [tables[x][s] for s, _ in p.pieces])
    model.start()
    for text in ["the eaux", "und", "nation une der", "Ŀx"]:
        logs = [sum(math.log(summed(tables[x], "▁" + w)) for w in pieces.words_of(text)) for x in model.languages]
        share = np.exp(np.array(logs) - max(logs))
        got = model.predict([text])[0]
        assert got[0] == model.languages[int(np.argmax(logs))]
        assert abs(got[1] - share.max() / share.sum()) < 1e-6


def test_no_language_is_forgotten(spark):
    words = {f"l{k:02d}": VOCABULARY[9 * k : 9 * k + 9] for k in range(40)}
    rows = [(100 * j + k, " ".join(words[x]), x) for j, x in enumerate(sorted(words)) for k in range(90)]
    rows += [(50_000 + k, "한국어 말", "rare") for k in range(4)] + [(77, "the same text, over and over", "l00")] * 4000
    model = language.train(spark.createDataFrame(rows, DOCS + ", lang string").repartition(4), PIECE, per_language=30, most=60)
    assert model.languages == [*sorted(words), "rare"]
    assert [x for x, _ in model.start().predict([" ".join(words[x]) for x in sorted(words)] + ["한국어"])] == model.languages


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    with pytest.raises(ValueError):
        language.train(spark.createDataFrame([(k, "a b", str(k)) for k in range(12)], DOCS + ", lang string"), PIECE)


def test_best_cut_is_brute_force():
    r = np.random.default_rng(2)
    for _ in range(200):
        n = int(r.integers(2, 12))
        m, t, w = r.integers(0, 5, n).astype(float), r.random(n) < 0.5, r.integers(1, 4, n).astype(float)
        if not t.any():
            continue
        f1 = lambda c: 2 * w[(m >= c) & t].sum() / (w[m >= c].sum() + w[t].sum())  # noqa: B023, E731
        sound = [c for c in m if w[(m >= c) & t].sum() >= 0.9 * w[m >= c].sum()]
        cut = toxicity.best_cut(m, t, w)
        assert f1(cut) == max(map(f1, sound)) if sound else cut == 0


def test_fit_is_brute_force():
    texts = [" ".join(prose(12, k).split() + ["idiots"] * (k % 3 == 0)) for k in range(60)]
    toxic = np.array([k % 3 == 0 for k in range(60)])
    model = toxicity.fit(texts, toxic.astype(int).tolist(), rounds=30)
    # The same by dense matrices over grams.
    of = lambda t: Counter(g for w in set(pieces.words_of(t)) for g in toxicity.grams(w))
    bags = [of(t) for t in texts]
    fold = np.zeros(60, int)
    for c in (False, True):
        fold[toxic == c] = np.arange((toxic == c).sum()) % toxicity.FOLDS

    def ratio(rows):
        n = {c: Counter(g for i in rows if toxic[i] == c for g in bags[i]) for c in (False, True)}
        size = {c: toxicity.BUCKETS + sum(n[c].values()) for c in n}
        return lambda g: math.log((n[True][g] + 1) / size[True]) - math.log((n[False][g] + 1) / size[False])

    def solve(rows, f):
        x = np.array([[bags[i][g] * (f(g) if abs(f(g)) >= 1 else 0) for g in columns] for i in range(60)])
        use = np.isin(np.arange(60), rows)
        w, b = np.zeros(len(columns)), math.log(toxic[use].mean() / (1 - toxic[use].mean()))
        sw, sb, rate = np.full(len(w), 1e-8), 1e-8, 50 / max(1, np.abs(x).sum() / 60)
        for _ in range(30):
            e = (1 / (1 + np.exp(-(b + x @ w))) - toxic) * use
            gw, gb = x.T @ e / use.sum() + 0.1 * w, e.sum() / use.sum()
            sw, sb = sw + gw**2, sb + gb**2
            w, b = w - rate * gw / np.sqrt(sw), b - gb / math.sqrt(sb)
        return b + x @ w, {g: v * (f(g) if abs(f(g)) >= 1 else 0) for g, v in zip(columns, w)}, b

    seen = Counter(g for b in bags for g in b)
    folds = [ratio(range(60)), *(ratio([i for i in range(60) if fold[i] != k]) for k in range(toxicity.FOLDS))]
    columns = sorted(g for g, n in seen.items() if n >= 2 and any(abs(f(g)) >= 1 for f in folds))
    margins = np.zeros(60)
    for k in range(toxicity.FOLDS):
        margins[fold == k] = solve([i for i in range(60) if fold[i] != k], folds[k + 1])[0][fold == k]
    _, weights, b = solve(range(60), folds[0])
    bias = b - toxicity.best_cut(margins, toxic, np.ones(60)) + math.log(0.7 / 0.3)
    assert abs(model.bias - bias) < 1e-2
    assert all(abs(model.weights[g] - v) < 1e-3 for g, v in weights.items())
    model.start()
    for t in [*texts[:6], None, "", "idiot idiot"]:
        want = bias + sum(weights.get(g, 0) for w in set(pieces.words_of(t)) for g in toxicity.grams(w))
        assert abs(model.score(t) - 1 / (1 + math.exp(-want))) < 1e-2
    assert sum((model.score(t) >= 0.7) == y for t, y in zip(texts, toxic)) >= 58


def test_many_rows_of_one_document(spark):
    rows = [(k, prose(30, k) + (" idiot" if k % 4 == 0 else "")) for k in range(200)] + [(0, prose(30, 5) + f" x{k}") for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id bigint, toxic int")
    model = toxicity.train(spark.createDataFrame(rows, DOCS), labels, most=60).start()
    assert model.score(prose(30, 999) + " idiot") > model.score(prose(30, 999))
