"""Toxicity by a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, kept, scored, small_batches
from .pieces import words_of

#: Lengths of grams, of which a word is taken with a space on both sides; buckets that they are hashed into;
#: documents to learn from, at most, half of them of each class; documents that a gram must be in (fewer for small
#: samples); folds for the cut; and the score that is toxic.
SIZES, BUCKETS, MOST_ROWS, LEAST_DOCS, FOLDS, TOXIC = (3, 4, 5, 6), 1 << 20, 8000, 20, 3, 0.7
#: Of the regression: length of the first steps, weight of its weights' squares; and the precision that the cut must have on
#: rows that weren't learnt from.
RATE, DECAY, PRECISION = 50, 0.1, 0.9


def grams(word: str) -> set[int]:
    padded = f" {word} "
    return {zlib.crc32(padded[i : i + n].encode()) % BUCKETS for n in SIZES for i in range(len(padded) - n + 1)}


class ToxicityModel:
    """The score of a text is the logistic of a sum over its distinct words, of the weights of their grams."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    def start(self, most: int = 250_000) -> ToxicityModel:
        self.most, self.cache = most, {}
        return self

    def _known(self, word: str) -> float:
        self.cache[word] = found = float(self.weights[list(grams(word))].sum())
        return found

    def score(self, text: str | None) -> float:
        if len(self.cache) > self.most:
            self.cache.clear()
        total = self.bias
        for w in set(words_of(text)):
            s = self.cache.get(w)
            total += self._known(w) if s is None else s
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def _features(text: str, cache: dict[str, np.ndarray]) -> np.ndarray:
    """Grams of a text's distinct words, each as often as words have it."""
    if len(cache) > 50_000:
        cache.clear()
    parts = []
    for w in set(words_of(text)):
        if w not in cache:
            cache[w] = np.array(list(grams(w)), np.int32)
        parts.append(cache[w])
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _ratio(with_gram: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed shares that grams have of toxic and of other documents' grams."""
    shares = (with_gram + 1) / (with_gram + 1).sum(axis=1, keepdims=True)
    return np.log(shares[1]) - np.log(shares[0])


def _sums(at: np.ndarray, value: np.ndarray, other: np.ndarray, of: np.ndarray, n: int, step: int = 1 << 20) -> np.ndarray:
    """Sums by `at` of value times what `other` has at `of`, a stretch at a time, as numpy copies what it sums."""
    total = np.zeros(n)
    for k in range(0, len(at), step):
        total += np.bincount(at[k : k + step], value[k : k + step] * other[of[k : k + step]], minlength=n)
    return total


def _solve(row: np.ndarray, index: np.ndarray, value: np.ndarray, toxic: np.ndarray, use: np.ndarray, columns: int, rounds: int, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on the rows in use, by AdaGrad over all of them at once. The first steps move
    the margin of a row of mean length by RATE at most, so that it stays in bounds however many grams rows have."""
    share = toxic[use].mean()
    w, b, n = np.zeros(columns), float(np.log(share / (1 - share))), use.sum()
    rate = RATE / max(1.0, float(np.abs(value).sum()) / len(toxic))
    seen_w, seen_b = np.full(columns, 1e-8), 1e-8
    for _ in range(rounds):
        margin = b + _sums(row, value, w, index, len(toxic))
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - toxic) * use
        step = _sums(index, value, error, row, columns) / n + decay * w
        step_b = error.sum() / n
        seen_w += step**2
        seen_b += step_b**2
        w -= rate * step / np.sqrt(seen_w)
        b -= step_b / np.sqrt(seen_b)
    return w, b


def best_cut(margins: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> float:
    """The margin from which on rows are best taken to be toxic: of the cuts with a precision of PRECISION the one with the
    highest F1 of weighted rows, and of several such the highest, midway to the next lower margin. Where too little has
    been learnt for any, it is 0, which is where the regression itself takes both classes to be as likely."""
    order = np.argsort(-margins, kind="stable")
    m, w, t = margins[order], weights[order], toxic[order]
    right, taken = np.cumsum(w * t), np.cumsum(w)
    f1 = np.where(right >= PRECISION * taken, 2 * right / (taken + (weights * toxic).sum()), -1)
    f1[:-1][m[:-1] == m[1:]] = -1
    k = int(f1.argmax())
    if f1[k] <= 0:
        return 0.0
    return float((m[k] + m[k + 1]) / 2) if k + 1 < len(m) else float(m[k])


def fit(texts: list[str], labels: list[int], rounds: int = 200, weights: tuple[float, float] = (1.0, 1.0)) -> ToxicityModel:
    """Logistic regression on how many distinct words of a document have a gram, times the gram's log-count ratio.

    Grams in few documents, or of ratio near 0, are left out. What cut is best is learnt from margins of rows that
    the model in question hasn't seen: of FOLDS folds each is scored by a model of the others, rows of the classes
    count as `weights` says, and the bias is then set so that the best cut scores TOXIC. With one class only, the
    score is that class's. Grams are taken twice, to count and to pick from, so that only those that may be picked
    are held for all documents.
    """
    toxic, n = np.array(labels, bool), len(texts)
    out = np.zeros(BUCKETS, np.float32)
    if not n or toxic.all() or not toxic.any():
        return ToxicityModel(out, 20.0 if n and toxic.all() else -20.0)
    # Each class is dealt in turn, so that every fold has its share.
    fold = np.zeros(n, np.int64)
    for t in (False, True):
        fold[toxic == t] = np.arange((toxic == t).sum()) % FOLDS
    cache: dict[str, np.ndarray] = {}
    counts = np.zeros((FOLDS, 2, BUCKETS), np.int32)
    for text, t, f in zip(texts, toxic, fold, strict=True):
        counts[f, int(t), np.unique(_features(text, cache))] += 1
    whole = counts.sum(axis=0)
    picked = np.flatnonzero(whole.sum(axis=0) >= max(2, min(LEAST_DOCS, n // 130)))
    column = np.full(BUCKETS, -1, np.int32)
    ratios = [_ratio(whole), *(_ratio(whole - counts[f]) for f in range(FOLDS))]
    picked = picked[np.any([np.abs(r[picked]) >= 1 for r in ratios], axis=0)]
    ratios = [np.where(np.abs(r[picked]) >= 1, r[picked], 0).astype(np.float32) for r in ratios]
    del counts
    column[picked] = np.arange(len(picked))
    index, times, sizes = [], [], []
    for text in texts:
        found = column[_features(text, cache)]
        found, seen = np.unique(found[found >= 0], return_counts=True)
        index.append(found)
        times.append(seen.astype(np.float32))
        sizes.append(len(found))
    index, times, row = np.concatenate(index), np.concatenate(times), np.repeat(np.arange(n, dtype=np.int32), sizes)
    # One model's values at a time, as there are as many as grams in all documents.
    values = lambda f: ratios[f][index] * times
    margins, every = np.zeros(n), np.ones(n, bool)
    for f in range(FOLDS):
        seen = fold != f
        if toxic[seen].all() or not toxic[seen].any():
            continue
        value = values(f + 1)
        w, b = _solve(row, index, value, toxic, seen, len(picked), rounds)
        margins[~seen] = (b + _sums(row, value, w, index, n))[~seen]
        del value
    w, b = _solve(row, index, values(0), toxic, every, len(picked), rounds)
    out[picked] = w * ratios[0]
    cut = best_cut(margins, toxic, np.where(toxic, weights[1], weights[0]))
    return ToxicityModel(out, float(b - cut + np.log(TOXIC / (1 - TOXIC))))


def _fitted(weights: tuple[float, float]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((i, t, x) for b in batches for i, t, x in zip(b["doc_id"], b["toxic"], b["text"], strict=True))
        model = fit([r[2] for r in rows], [int(r[1]) for r in rows], weights=weights)
        del rows
        yield pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias]})

    return run


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> ToxicityModel:
    """Learns from labelled rows outside the held-out fold: of each class the `most` / 2 that come first by a hash of
    doc_id, in one task, as that many fit there; the weights alone come to the driver.

    Labels that are null count for nothing; a document with two labels counts with both; rows with one doc_id and
    text count once, and of very many texts with one doc_id the first by a hash are taken.
    """
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("text").isNotNull())
    # The rows are chosen by their ids alone; the choice has a bounded size, and so has what it picks.
    able = marked.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    first = lambda rows, t, *order: rows.where(F.col("toxic") == t).orderBy(*order).limit(most // 2)
    ids = [F.xxhash64("doc_id", F.lit(7)), F.col("doc_id")]
    there = dict(tuple(r) for r in able.groupBy("toxic").count().collect())
    chosen = first(able, 0, *ids).union(first(able, 1, *ids))
    rows = texts.join(F.broadcast(chosen), "doc_id").withColumn("key", F.xxhash64("text")).dropDuplicates(["doc_id", "toxic", "key"])
    rows = first(rows, 0, *ids, "key").union(first(rows, 1, *ids, "key")).select("doc_id", "toxic", "text")
    small_batches(docs.sparkSession)
    # A row of a class stands for so many.
    weights = tuple(there.get(t, 0) / max(1, min(there.get(t, 0), most // 2)) for t in (0, 1))
    got = rows.repartition(1).mapInPandas(_fitted(weights), "weights binary, bias double").collect()
    return ToxicityModel(np.frombuffer(bytes(got[0].weights), np.float32), got[0].bias) if got else fit([], [])


def score(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None, keep: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from its whole text; see scored() for keep.

    Null texts score as empty ones do; very long ones are read whole. Repeated rows give equal rows; an empty table
    gives none, and without labels every score is near 0. Other columns, whatever their names, play no part.
    """
    model = model or train(docs, labels)
    weights, bias = model.weights, model.bias

    def make():
        own = ToxicityModel(weights, bias).start()

        def run(texts):
            got = [own.score(t) for t in texts]
            return got, [int(g >= TOXIC) for g in got]

        return run

    return scored(docs, make, "score double, predicted int", keep)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted to be toxic, with all their columns, whatever those are named. Null and empty
    texts have the score of a text without words, and rows without a doc_id their own text's; equal rows stay
    or go together; an empty table gives none, and without labels every row stays."""
    return kept(score(docs, labels, keep=True).where("predicted = 0"), docs)
