"""A public piece vocabulary: count-only Viterbi, and sums over all segmentations."""

from __future__ import annotations

import functools
import re

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, map_rows

#: Fixed values of the unigram tokenizer: what an unknown character scores below the least piece, and the
#: mark that stands for a space and before a text.
PENALTY, MARK = 10.0, "▁"


class Pieces:
    """Pieces with their scores, from a sentencepiece model file, matched by an Aho-Corasick automaton."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
        self.unk = model.unk_id()
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(self.pieces):
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in self.pieces) - PENALTY
        #: Line ends are in no piece, and whole scores add up exactly, so that texts fall apart there.
        self.cut = "\n" if all(s.is_integer() for _, s in self.pieces) and not any("\n" in p for p, _ in self.pieces) else None

    def count(self, word: str) -> int:
        """Number of tokens of the best segmentation.

        best[e] and count[e] are score and tokens of the best way to position e; a piece that ends there is
        taken if that scores more than what starts before it does. A character that is no piece itself may
        stand for its bytes. Ties so go to the longest last piece.
        """
        if self.pieces[self.unk][0] in word:
            return self._count_by_path(word)
        n = len(word)
        best, count, single = [None] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        e = 0
        for last, (size, score, _) in self.automaton.iter(word):
            while e < last:
                e += 1
                if not single[e]:
                    self._unknown(word, e, best, count)
            t, s = last + 1, last + 1 - size
            if size == 1:
                single[t] = True
            score += best[s]
            if best[t] is None or score > best[t]:
                best[t], count[t] = score, count[s] + 1
        while e < n:
            e += 1
            if not single[e]:
                self._unknown(word, e, best, count)
        return count[n]

    def _unknown(self, word: str, e: int, best: list, count: list) -> None:
        score = best[e - 1] + self.unknown
        if best[e] is None or score > best[e]:
            best[e], count[e] = score, count[e - 1] + len(word[e - 1].encode())

    def _count_by_path(self, word: str) -> int:
        """The same for words with the unknown piece's own text: neighbours of that are one unknown run with it,
        which is one token if it's just that text and else its bytes."""
        n = len(word)
        best, start, ids = [None] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        ends = [[] for _ in range(n + 1)]
        for last, (size, score, i) in self.automaton.iter(word):
            ends[last + 1].append((size, score, i))
        for e in range(1, n + 1):
            found = sorted(ends[e], reverse=True)
            if not found or found[-1][0] != 1:
                found.append((1, self.unknown, self.unk))
            for size, score, i in found:
                if best[e] is None or best[e - size] + score > best[e]:
                    best[e], start[e], ids[e] = best[e - size] + score, e - size, i
        total, run, e = 0, "", n
        flush = lambda r: 0 if not r else 1 if r == self.pieces[self.unk][0] else len(r.encode())
        while e:
            if ids[e] == self.unk:
                run = word[start[e] : e] + run
            else:
                total, run = total + flush(run) + 1, ""
            e = start[e]
        return total + flush(run)


class TokenCounter:
    """Counts of whole texts, word by word; the cache is emptied at `most` words, which changes no count."""

    def __init__(self, path: str, most: int = 500_000) -> None:
        self.pieces, self.most, self.cache = Pieces(path), most, {}

    def count(self, text: str | None) -> int:
        """Tokens of a text with its spaces turned into marks and one before it; none of an empty or null one."""
        if not text:
            return 0
        if len(self.cache) > self.most:
            self.cache.clear()
        words = text.replace(MARK, " ")
        # A part is a word after a space, but for the first if the text starts with a space.
        if not self.pieces.cut or self.pieces.pieces[self.pieces.unk][0] in text:
            parts = words.split(" ")
            return sum(self.pieces.count(MARK + p) for p in parts[words[0] == " " :])
        parts = words.replace("\n", " \n").split(" ")
        if words[0] == " ":
            del parts[0]
        get, known = self.cache.get, self._known
        return sum([get(p) or known(p) for p in parts])

    def _known(self, part: str) -> int:
        found = self.cache.get(part)
        if found is None:
            # A line end and what follows it belong to the word before.
            found = 1 + self.pieces.count(part[1:]) if part.startswith(self.pieces.cut) else self.pieces.count(MARK + part)
            self.cache[part] = found
        return found


@functools.lru_cache(maxsize=4)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


KEPT.append(counter.cache_clear)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, n_chars) of every row's whole text.

    Rows are independent: repeated ones give equal rows, null and empty texts have no tokens, very long ones are counted
    whole, an empty table gives no rows, and other columns, whatever their names, play no part.
    """

    def make():
        c = counter(path)
        return lambda ids, texts: (ids, [c.count(t) for t in texts], [len(t or "") for t in texts])

    return map_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ["doc_id", "text"], "doc_id bigint, n_tokens bigint, n_chars bigint", make, 64)


def best_path(pieces: Pieces, word: str) -> list[int]:
    """Piece ids of the best segmentation of a word, without those of unknown characters."""
    n = len(word)
    best, back = [0.0] + [None] * n, [(0, -1)] * (n + 1)
    e = 0
    for last, (size, score, i) in pieces.automaton.iter(word):
        while e < last:
            e += 1
            if best[e] is None:
                best[e], back[e] = best[e - 1] + pieces.unknown, (e - 1, -1)
        t = last + 1
        score += best[t - size]
        if best[t] is None or score > best[t]:
            best[t], back[t] = score, (t - size, i)
    while e < n:
        e += 1
        if best[e] is None:
            best[e], back[e] = best[e - 1] + pieces.unknown, (e - 1, -1)
    found = []
    while n:
        n, i = back[n]
        if i >= 0:
            found.append(i)
    return found


LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def forward(pieces: Pieces, probabilities: np.ndarray, words: list[str], floor: float = 1e-9) -> np.ndarray:
    """For each word and language, the log of the summed probability of all the word's segmentations.

    probabilities has a row for each piece and a column for each language. All words advance together: the
    sums at end e are made of those at the starts of the pieces that end there. A character that is no piece
    has probability `floor` in every language. Sums are scaled at each end, so that long words don't vanish.
    """
    words = [MARK + w for w in words]
    lengths = np.array([len(w) for w in words])
    at, ends, sizes, ids = [], [], [], []
    for k, w in enumerate(words):
        single = [False] * len(w)
        for last, (size, _, i) in pieces.automaton.iter(w):
            at.append(k)
            ends.append(last + 1)
            sizes.append(size)
            ids.append(i)
            if size == 1:
                single[last] = True
        for e, known in enumerate(single):
            if not known:
                at.append(k)
                ends.append(e + 1)
                sizes.append(1)
                ids.append(-1)
    table = np.vstack([probabilities, np.full((1, probabilities.shape[1]), floor)])
    at, ends, sizes, ids = (np.array(x, np.int64) for x in (at, ends, sizes, ids))
    order = np.lexsort((at, ends))
    at, ends, sizes, p = at[order], ends[order], sizes[order], table[ids[order]]
    depth = int(sizes.max(initial=1)) + 1
    # The last `depth` sums of each word, in a ring, divided by what `scale` has the log of.
    ring = np.zeros((depth, len(words), probabilities.shape[1]))
    ring[0] = 1
    scale, out = np.zeros(len(words)), np.zeros((len(words), probabilities.shape[1]))
    bounds = np.searchsorted(ends, np.arange(1, lengths.max(initial=0) + 2))
    for e in range(1, int(lengths.max(initial=0)) + 1):
        part = slice(bounds[e - 1], bounds[e])
        k = at[part]
        if not len(k):
            continue
        terms = ring[(e - sizes[part]) % depth, k] * p[part]
        firsts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        sums, who = np.add.reduceat(terms, firsts, axis=0), k[firsts]
        ring[e % depth] = 0
        ring[e % depth, who] = sums
        top = sums.max(axis=1)
        small = top < 1e-100
        if small.any():
            ring[:, who[small]] /= top[small][None, :, None]
            scale[who[small]] += np.log(top[small])
        done = who[lengths[who] == e]
        out[done] = np.log(np.maximum(ring[e % depth, done], 1e-300)) + scale[done][:, None]
    return out
