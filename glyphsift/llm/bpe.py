"""BPE encoding and decoding over a contiguous array of parts and the ranks between them."""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, map_rows

#: Fixed values of the tokenizer file's format: white space of its \s, and the byte-level alphabet, which
#: shows printable bytes as themselves and the others, in order, from U+0100.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = re.compile(f"[{WHITE}]+")
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
OTHERS = [b for b in range(256) if b not in set(PRINTABLE)]
BYTE_CHARS = {b: chr(b) for b in PRINTABLE} | {b: chr(0x100 + k) for k, b in enumerate(OTHERS)}
CHAR_BYTES = {c: b for b, c in BYTE_CHARS.items()}
#: Words of more parts are merged over a heap; a scan for the minimum would take the square of their length.
SHORT = 128
NONE = 1 << 40


def lower(text: str) -> str:
    """Lower case character by character, so that no letter's form depends on its neighbours."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


class WordBpe:
    """A BPE with word ends, from a tokenizer file: NFC, white space to one space, lower case, a split by
    pattern, bytes, merges. Strings of added tokens in a text are those tokens."""

    def __init__(self, path: str, most: int = 300_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.pair, self.merged = {}, []
        for rank, (a, b) in enumerate(model["merges"]):
            self.pair[self.vocab[a] << 20 | self.vocab[b]] = rank
            self.merged.append(self.vocab[a + b])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added, self.special = added, re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern.replace(r"\s", WHITE), regex.V0)
        self.path, self.library = path, None
        self.most, self.cache, self.words = most, {}, {}

    def merge(self, parts: list[int]) -> list[int]:
        """Merges adjacent parts of a word, least rank first, leftmost among equals.

        parts[i] is the token between boundaries i and i + 1, ranks[i] the rank of the pair that meets at
        boundary i + 1. A merge deletes that boundary and refreshes the ranks on both sides of it.
        """
        if len(parts) > SHORT:
            return self._merge_long(parts)
        get = self.pair.get
        ranks = [get(a << 20 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            parts[i] = self.merged[low]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 20 | parts[i], NONE)
            if i < len(ranks):
                ranks[i] = get(parts[i] << 20 | parts[i + 1], NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges in the same order, for long words."""
        n, get = len(parts), self.pair.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := get(parts[i] << 20 | parts[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j < 0 or get(parts[i] << 20 | parts[j], NONE) != r:
                continue
            parts[i], parts[j], after[i] = self.merged[r], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (s := get(parts[k] << 20 | parts[after[k]], NONE)) != NONE:
                    heapq.heappush(heap, (s, k))
        return [p for p in parts if p >= 0]

    def word(self, text: str) -> list[int]:
        chars = [BYTE_CHARS[b] for b in text.encode()]
        chars[-1] += self.suffix
        return self.merge([self.vocab[c] for c in chars])

    def chunk(self, text: str) -> list[int]:
        """Ids of a stretch of text without added tokens."""
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in text):
            words = self._new_characters(text)
        else:
            words = self.split.findall(lower(SPACE.sub(" ", unicodedata.normalize("NFC", text))))
        ids = []
        for w in words:
            got = self.words.get(w)
            if got is None:
                self.words[w] = got = self.word(w)
            ids += got
        return ids

    def _new_characters(self, text: str) -> list[str]:
        """Words of a text with characters that Python's Unicode tables don't have: the library's own tables
        say what is a letter there. Only normalisation and the split are asked of it."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(CHAR_BYTES[c] for c in w).decode() for w, _ in found]

    def _known(self, text: str) -> tuple[int, str, str]:
        """A chunk's ids as count, digits and tokens. A text is cut at spaces and line ends, over which neither
        normalisation nor the split reaches."""
        found = self.cache.get(text)
        if found is None:
            ids = self.chunk(text)
            self.cache[text] = found = (len(ids), " ".join(map(str, ids)), " ".join(self.tokens[i] for i in ids))
        return found

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.encoded(text)[1].split()]

    def decode(self, ids: list[int]) -> str:
        """The tokens, special ones too, joined by spaces, as the file names no decoder."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)

    def encoded(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, ids in decimal joined by spaces, and their decoded text. Null is as the empty text."""
        if len(self.cache) > self.most:
            self.cache.clear()
            self.words.clear()
        text = text or ""
        if "<|" in text and self.special.search(text):
            found, at = [], 0
            for m in self.special.finditer(text):
                found += [self._known(c) for c in text[at : m.start()].replace("\n", " ").split(" ")]
                i = self.added[m[0]]
                found.append((1, str(i), m[0]))
                at = m.end()
            found += [self._known(c) for c in text[at:].replace("\n", " ").split(" ")]
        else:
            known, get = self._known, self.cache.get
            found = [get(c) or known(c) for c in text.replace("\n", " ").split(" ")]
        found = [f for f in found if f[0]]
        return sum([f[0] for f in found]), " ".join([f[1] for f in found]), " ".join([f[2] for f in found])


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> WordBpe:
    """One tokenizer for each Python worker, so that tasks share its cache."""
    return WordBpe(path)


KEPT.append(tokenizer.cache_clear)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row's whole text.

    Rows are independent: repeated ones give equal rows, empty and null texts have no ids and the digests of
    the empty string, very long ones are encoded whole, an empty table gives no rows, and other columns, whatever
    their names, play no part.
    """

    def make():
        bpe = tokenizer(path)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()

        def run(ids, texts):
            got = [bpe.encoded(t) for t in texts]
            return ids, [g[0] for g in got], [digest(g[1]) for g in got], [digest(g[2]) for g in got]

        return run

    return map_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ["doc_id", "text"], "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", make, 64)


def token_ids(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the ids themselves and what they decode to."""

    def make():
        bpe = tokenizer(path)

        def run(ids, texts):
            got = [bpe.encoded(t) for t in texts]
            return ids, [[int(i) for i in g[1].split()] for g in got], [g[2] for g in got]

        return run

    return map_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ["doc_id", "text"], "doc_id bigint, ids array<int>, decoded string", make, 64)
