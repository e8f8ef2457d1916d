"""Language identification by unigrams summed over all segmentations."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KEPT, held_out, kept, scored
from .pieces import MARK, Pieces, best_path, forward, words_of

#: Documents of each language to learn from, at most, fewer where languages are so many that they would be over
#: MOST_ROWS, but LEAST at least; languages that one model can hold; what each piece is counted besides.
PER_LANGUAGE, MOST_ROWS, LEAST, MOST_LANGUAGES, ALPHA = 300, 6000, 20, 1000, 0.1
UNDETERMINED = "und"


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


KEPT.append(pieces.cache_clear)


class LanguageModel:
    """Log-probabilities of words in each language, and of texts as their words' sums."""

    def __init__(self, path: str, languages: list[str], probabilities: np.ndarray) -> None:
        self.path, self.languages, self.probabilities = path, languages, probabilities

    def start(self, most: int = 200_000) -> LanguageModel:
        self.most, self.cache, self.rows, self.used = most, {}, np.zeros((4096, len(self.languages))), 0
        return self

    def _learn(self, words: list[str]) -> None:
        got = forward(pieces(self.path), self.probabilities, words)
        while self.used + len(words) > len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        self.rows[self.used : self.used + len(words)] = got
        self.cache.update(zip(words, range(self.used, self.used + len(words)), strict=True))
        self.used += len(words)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language with the highest probability given the text, all languages being as likely before, and
        that probability; UNDETERMINED and 0 without letters or languages. Ties go to the first by name."""
        found = [words_of(t) for t in texts]
        found = [w if any(c.isalpha() for x in w for c in x) else [] for w in found]
        if self.used > self.most:
            self.start(self.most)
        new = list(set().union(*found).difference(self.cache)) if self.languages else []
        for at in range(0, len(new), 8192):
            self._learn(new[at : at + 8192])
        out = []
        for words in found:
            if not words or not self.languages:
                out.append((UNDETERMINED, 0.0))
                continue
            total = self.rows[[self.cache[w] for w in words]].sum(axis=0)
            share = np.exp(total - total.max())
            best = int(total.argmax())
            out.append((self.languages[best], float(share[best] / share.sum())))
        return out


def _counter(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
        own = pieces(path)
        for lang, of in words.items():
            counted = np.zeros(len(own.pieces))
            for w, n in of.items():
                np.add.at(counted, best_path(own, MARK + w), n)
            yield pd.DataFrame({"lang": [lang], "counts": [counted.tobytes()]})

    return run


def train(docs: DataFrame, path: str, per_language: int = PER_LANGUAGE, most: int = MOST_ROWS) -> LanguageModel:
    """Learns from a sample of the rows with text and lang outside the held-out fold: of each language the documents
    that come first by a hash, no language left out and none cut for the sake of another.

    A piece's probability in a language is its share of the pieces of the best segmentations of that
    language's words, counts raised by ALPHA. Of each language there are `per_language` documents, or its share of
    `most` if that is less, or LEAST if that is less still; they are counted by language, and the counts alone come to
    the driver. Over MOST_LANGUAGES languages, whose model no task could hold, are an error. Rows with one doc_id
    and text are drawn once.
    """
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    draw = F.xxhash64("doc_id", "text", F.lit(10))
    # About how many different ones there are, so that copies take no one's place.
    counts = known.groupBy("lang").agg(F.approx_count_distinct(draw).alias("count")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages to learn")
    if not counts:
        return LanguageModel(path, [], np.zeros((len(pieces(path).pieces), 0)))
    each = min(per_language, max(LEAST, most // len(counts)))
    chance = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 3 * each / r["count"])) for r in counts], "lang string, chance double")
    # Three times as many as are needed pass, so that hardly any language gets fewer, and only those are ranked.
    passed = F.pmod(draw, F.lit(1 << 30)) / float(1 << 30) < F.col("chance")
    sample = known.withColumn("draw", draw).join(F.broadcast(chance), "lang").where(passed).dropDuplicates(["lang", "doc_id", "draw"])
    chosen = sample.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("draw", F.lit(1 << 30)), "draw", "doc_id"))).where(F.col("rank") <= each)
    rows = chosen.select("lang", "text").mapInPandas(_counter(path), "lang string, counts binary").collect()
    languages = sorted({r.lang for r in rows})
    counted = np.array([np.sum([np.frombuffer(bytes(r.counts)) for r in rows if r.lang == x], axis=0) for x in languages]).T + ALPHA
    return LanguageModel(path, languages, counted / counted.sum(axis=0))


def identify(docs: DataFrame, path: str, model: LanguageModel | None = None, keep: bool = False) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, from its whole text; see scored() for keep.

    Texts that are null, empty or without a letter are `und`, as is everything where there is nothing to learn from; of
    languages with equal sums the first by name is taken. Very long texts are read whole. Repeated rows give equal
    rows; an empty table gives none. Other columns, whatever their names, play no part.
    """
    model = model or train(docs, path)

    def make():
        own = LanguageModel(model.path, model.languages, model.probabilities).start()
        return lambda texts: tuple(zip(*own.predict(texts), strict=True)) or ((), ())

    return scored(docs, make, "lang_pred string, score double", keep)


def keep_identified(docs: DataFrame, path: str, least: float = 0.5) -> DataFrame:
    """The rows of docs with a language that is at least so probable, with all their columns, whatever those are named.
    Null and empty texts go, as do those without a letter; rows without a doc_id stay by their own text; equal rows
    stay or go together; an empty table gives none."""
    return kept(identify(docs, path, keep=True).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)), docs)
