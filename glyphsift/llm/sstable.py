"""Token ids in sorted-string-table shards.

A shard, all integers little-endian:

    block*      a zstd frame of entries; an entry is varint(shared), varint(own), varint(size), the last `own`
                bytes of the key, of which the first `shared` are those of the key before (0 at a block's
                start), and `size` bytes of value
    bloom       bits, in whole bytes
    index       for each block: varint(length of its last key), that key, varint(offset), varint(size)
    footer      <5Q2I8s: offset of bloom, bytes of bloom, offset of index, entries, ids; number of probes,
                bytes of an id; magic

Keys sort as bytes. A document's key is 0 for a null identifier, else 1 and the identifier in eight big-endian
bytes with the sign bit turned, then in four bytes the number of earlier rows with that identifier. A value is
the ids in two bytes each where the vocabulary allows, else four.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import folder as shared_folder
from .bpe import BYTE_CHARS
from .common import KEPT, small_batches

MAGIC, FOOTER = b"GSSTABLE", struct.Struct("<5Q2I8s")
BLOCK_BYTES, BLOOM_BITS, BLOOM_PROBES = 1 << 16, 10, 7


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int, probes: int) -> Iterator[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return ((a + k * b) % bits for k in range(probes))


def key_of(doc_id: int | None, nth: int = 0) -> bytes:
    return (b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))) + struct.pack(">I", nth)


def doc_id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


class Writer:
    """Writes entries, which come in ascending order of their keys, to an open binary file."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width, self.at, self.entries, self.ids = out, width, 0, 0, 0
        self.block, self.last, self.index, self.hashes = bytearray(), b"", [], []
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes) -> None:
        if self.entries and key <= self.last:
            raise ValueError("keys must ascend")
        shared = len(os.path.commonprefix([self.last, key])) if self.block else 0
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.hashes.append(key)
        self.entries += 1
        self.ids += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data)

    def _flush(self) -> None:
        if self.block:
            data = self.pack.compress(bytes(self.block))
            self.index.append(_varint(len(self.last)) + self.last + _varint(self._put(data)) + _varint(len(data)))
            self.block.clear()

    def finish(self) -> None:
        self._flush()
        bloom = bytearray((max(64, BLOOM_BITS * self.entries) + 7) // 8)
        for key in self.hashes:
            for bit in _probes(key, len(bloom) * 8, BLOOM_PROBES):
                bloom[bit >> 3] |= 1 << (bit & 7)
        bloom_at = self._put(bytes(bloom))
        index_at = self._put(b"".join(self.index))
        self._put(FOOTER.pack(bloom_at, len(bloom), index_at, self.entries, self.ids, BLOOM_PROBES, self.width, MAGIC))


class Reader:
    """Reads a shard from an open binary file that can seek: one key by binary search, or all in order."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.seek(0, 2)
        bloom_at, bloom_bytes, index_at, self.entries, self.ids, self.probes, self.width, magic = FOOTER.unpack(self._get(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.bloom, index = self._get(bloom_at, bloom_bytes), self._get(index_at, size - FOOTER.size - index_at)
        self.last_keys, self.blocks, at = [], [], 0
        while at < len(index):
            n, at = _read_varint(index, at)
            self.last_keys.append(index[at : at + n])
            offset, at = _read_varint(index, at + n)
            length, at = _read_varint(index, at)
            self.blocks.append((offset, length))

    def _get(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        data, at, key = zstandard.ZstdDecompressor().decompress(self._get(*self.blocks[k])), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            yield key, data[at + own : at + own + size]
            at += own + size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        return itertools.chain.from_iterable(map(self._block, range(len(self.blocks))))

    def get(self, key: bytes) -> bytes | None:
        """The value of a key, or None. The Bloom filter spares most reads for keys that aren't here."""
        from bisect import bisect_left

        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _probes(key, len(self.bloom) * 8, self.probes)):
            return None
        k = bisect_left(self.last_keys, key)
        return next((v for own, v in self._block(k) if own == key), None) if k < len(self.blocks) else None

    def ids_of(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}").astype("<u4")


#: ASCII and Latin letters, and the pre-tokens of such text as the byte-level pre-tokenizer has them (a fixed
#: pattern, with what starts alike together).
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
SIMPLE = re.compile(f"[ \n!-~{LATIN}]+")
PRETOKEN = re.compile(rf" ?[{LATIN}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s0-9{LATIN}]+|\s+(?!\S)|\s+")
#: Where other text may be cut: before a run of spaces and line ends that follows something else. The
#: pre-tokenizer starts anew there, given that the text holds no other white space.
CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
OTHER_SPACE = re.compile(r"[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class CachedEncoder:
    """Ids of whole texts by the tokenizers library, which sees each word once while the cache holds it.

    Simple text is split here, as the library's splitting takes longer than its merges, and its words go to the
    library's model in the byte-level alphabet. Other text is cut into chunks, and those that aren't simple
    go to the library as they are; text with white space of other kinds does so whole. Words are kept in two
    generations, of which the older one goes when the younger has `most`; that changes no result.
    """

    def __init__(self, path: str, most: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)").search
        self.most, self.words, self.older, self.chunks, self.code = most, {}, {}, {}, "H" if self.width == 2 else "I"

    def _library(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _learn(self, words: set[str]) -> None:
        tokenize, code, older = self.tokenizer.model.tokenize, self.code, self.older.get
        for w in words.difference(self.words):
            self.words[w] = older(w) or array(code, [t.id for t in tokenize(w.encode().decode("latin-1").translate(BYTE_CHARS))]).tobytes()

    def _simple(self, text: str) -> bool:
        return bool(SIMPLE.fullmatch(text)) and not self.added(text)

    def _chunk(self, chunk: str) -> bytes:
        if self._simple(chunk):
            words = PRETOKEN.findall(chunk)
            self._learn(set(words))
            return b"".join(map(self.words.__getitem__, words))
        found = self.chunks.get(chunk)
        if found is None:
            self.chunks[chunk] = found = self._library(chunk)
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids, `width` bytes each; a null text has none."""
        if len(self.words) > self.most:
            self.older, self.words = self.words, {}
        if len(self.chunks) > 100_000:
            self.chunks.clear()
        split = [PRETOKEN.findall(t) if t and self._simple(t) else None for t in texts]
        self._learn(set().union(*filter(None, split)))
        get, found = self.words.__getitem__, []
        for t, words in zip(texts, split, strict=True):
            if words is not None:
                found.append(b"".join(map(get, words)))
            elif t and OTHER_SPACE.search(t):
                found.append(self._library(t))
            else:
                found.append(b"".join(map(self._chunk, CHUNK.findall(t or ""))))
        return found


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> CachedEncoder:
    """One encoder for each Python worker, so that tasks share its cache."""
    return CachedEncoder(path)


KEPT.append(encoder.cache_clear)


#: Schemes of Hadoop's file systems, and those that Arrow has for the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss"}


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a folder that Spark names. A scheme that Arrow doesn't know is an error that says so."""
    scheme, _, rest = uri.partition(":")
    if rest.startswith("/") and len(scheme) > 1:
        uri = f"{SCHEMES.get(scheme, scheme)}:{rest}"
    try:
        return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
    except pa.ArrowInvalid as e:
        raise ValueError(f"token shards can't be written to {uri}: set spark.checkpoint.dir to a folder in a file system that Arrow has ({e})") from e


def shard_path(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:06d}.sst"


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> list[tuple[int, int, int]]:
    """Encodes every row's whole text, with end_id after it, into shards in ascending order of doc_id.

    Returns (shard, documents, ids) of each shard in order; shards without rows have no file. Rows are dealt
    by ranges of doc_id and sorted there; a shard is written under a name of its own and then renamed, so
    that a task that runs again leaves the same file. Null texts give just end_id; null identifiers come
    first; rows with one identifier keep all their entries, ordered by text. Other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        end = np.array([end_id], f"<u{enc.width}").tobytes()
        shard, writer, last, nth = TaskContext.get().partitionId(), None, None, 0
        store, base = _filesystem(folder)
        temporary = f"{shard_path(base, shard)}.{uuid.uuid4().hex}"
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    ids, texts = (c.to_pylist() for c in batch.slice(at, 256).columns)
                    if writer is None:
                        out = store.open_output_stream(temporary)
                        writer = Writer(out, enc.width)
                    for doc_id, value in zip(ids, enc.encode(texts), strict=True):
                        nth = nth + 1 if writer.entries and doc_id == last else 0
                        last = doc_id
                        writer.add(key_of(doc_id, nth), value + end)
        except BaseException:
            if writer is not None:
                out.close()
                store.delete_file(temporary)
            raise
        if writer is not None:
            writer.finish()
            out.close()
            store.move(temporary, shard_path(base, shard))
            yield pa.RecordBatch.from_pylist([{"shard": shard, "docs": writer.entries, "ids": writer.ids}])

    spark = docs.sparkSession
    small_batches(spark)
    store, base = _filesystem(folder)
    store.create_dir(base, recursive=True)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = rows.mapInArrow(run, "shard bigint, docs bigint, ids bigint")
    found = sorted(tuple(r) for r in manifest.collect())
    # What attempts on lost executors have left.
    for left in store.get_file_info(fs.FileSelector(base)):
        if not left.path.endswith(".sst"):
            store.delete_file(left.path)
    return found


def read_shards(spark: SparkSession, folder: str, manifest: list[tuple[int, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every entry, one task for each shard; start counts all ids before."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    shards = [m[0] for m in manifest]
    starts = [0, *itertools.accumulate(m[2] for m in manifest)]
    out = pa.schema([(x.split()[0], pa.int64()) for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _filesystem(folder)
        for k in itertools.chain.from_iterable(b.column(0).to_pylist() for b in batches):
            at, rows = starts[k], []
            with store.open_input_file(shard_path(base, shards[k])) as file:
                shard = Reader(file)
                for key, value in shard:
                    ids = shard.ids_of(value)
                    rows.append((doc_id_of(key), at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=out)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=out)

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(run, schema)


def token_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes shards to a new folder in the shared one and reads them back. An empty table gives no rows."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    return read_shards(spark, folder, write_shards(docs, folder, tokenizer))
