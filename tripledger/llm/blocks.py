"""A distinct-word shuffle that the two tokenisers share.

A mapper gathers whole texts into a block of about ``BLOCK_CHARS`` characters and replaces every pre-token by
its number in the block's own dictionary, positions kept. The dictionary, not the text, is dealt by word hash:
one row for each (block, bucket) holds the block's distinct words of that bucket, so a word that occurs in
every document is sent once for each block and no key is ever hot. A bucket's reducer evaluates each distinct
word once, whatever the number of blocks that hold it, and sends the values back by block, where they meet the
numbered texts.

Texts and dictionaries are two passes over the same files, so that neither is stored in between; a lost executor's
part is made again from the input. An input that is not just files, whose rows could come in another order the second
time, is written to the shared folder first. A block is named by where its first row stands and what it holds.

A bucket's share of the vocabulary is held by its task in a dictionary of bounded size: there are the more buckets the
larger the input, up to a number, and a dictionary that grows beyond ``KNOWN_BYTES`` all the same starts anew.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.llm.common import lean, rereadable, shuffle_partitions, size_in_bytes

BLOCK_CHARS = 6_000_000
#: Input, as stored, for each bucket and each task; and the most that a task's dictionary holds.
BUCKET_BYTES, KNOWN_BYTES = 24 << 20, 64 << 20
#: Buckets at most, so that a block's rows stay as many and some 400 bytes each, however large the input; dictionaries of KNOWN_BYTES in so many tasks hold about a billion words.
MOST_BUCKETS = 4096

#: Rows of either kind: a block's numbered texts (bucket -1), or its words of a bucket and later their values.
SCHEMA = "block string, bucket int, ids array<string>, n_bytes array<bigint>, n_codes array<int>, codes binary, freqs binary, dealt binary, lengths binary, data binary"
ARROW = pa.schema([
    ("block", pa.string()), ("bucket", pa.int32()), ("ids", pa.list_(pa.string())), ("n_bytes", pa.list_(pa.int64())), ("n_codes", pa.list_(pa.int32())),
    ("codes", pa.binary()), ("freqs", pa.binary()), ("dealt", pa.binary()), ("lengths", pa.binary()), ("data", pa.binary()),
])


def packed(values: np.ndarray) -> bytes:
    """Whole numbers under 2**32, the bytes of equal weight side by side."""
    planes = np.ascontiguousarray(np.asarray(values, "<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def pack_words(words: list[bytes]) -> dict:
    return {"lengths": packed(np.fromiter(map(len, words), "<u4", len(words))), "data": zstandard.ZstdCompressor(level=3).compress(b"".join(words))}


def unpack_words(lengths: bytes, data: bytes) -> list[bytes]:
    ends = np.cumsum(unpacked(lengths)).tolist()
    whole = zstandard.ZstdDecompressor().decompress(data)
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=ARROW)


class Block:
    """Texts as numbers of the block's own words; counted: each text's distinct words with their frequencies instead."""

    def __init__(self, place: tuple, counted: bool):
        self.place = place
        self.ids, self.n_bytes, self.n_codes, self.codes, self.freqs, self.chars, self.counted = [], [], [], [], [], 0, counted
        self.number = defaultdict()
        self.number.default_factory = self.number.__len__

    def add(self, key, text: str, found: list[str]) -> None:
        if self.counted:
            count = Counter(found)
            codes, freqs = np.array([self.number[w] for w in count], np.int64), np.fromiter(count.values(), np.int64, len(count))
            order = np.argsort(codes)
            self.codes.append(np.diff(codes[order], prepend=0))
            self.freqs.append(freqs[order])
        else:
            self.codes.append(np.array([self.number[w] for w in found], np.int64))
        self.ids.append(None if key is None else str(key))
        self.n_bytes.append(len(text.encode()))
        self.n_codes.append(len(self.codes[-1]))
        self.chars += len(text)

    def rows(self, texts: bool, buckets: int) -> Iterator[pa.RecordBatch]:
        raw = [w.encode() for w in self.number]
        self.number.default_factory = None  # it refers to the dictionary, which would keep it alive
        codes = packed(np.concatenate([np.empty(0, np.int64), *self.codes]))
        digest = hashlib.blake2b(codes + b"".join(raw) + repr((self.place, self.ids, self.n_codes)).encode(), digest_size=16).hexdigest()
        dealt = np.fromiter((zlib.crc32(w) for w in raw), np.int64, len(raw)) % buckets
        if texts:
            freqs = packed(np.concatenate([np.empty(0, np.int64), *self.freqs])) if self.counted else None
            yield _rows([{"block": digest, "bucket": -1, "ids": self.ids, "n_bytes": self.n_bytes, "n_codes": self.n_codes, "codes": codes, "freqs": freqs, "dealt": packed(dealt)}])
        elif raw:
            order = np.argsort(dealt, kind="stable")
            cuts = np.searchsorted(dealt[order], np.arange(buckets + 1))
            yield _rows([{"block": digest, "bucket": b, **pack_words([raw[i] for i in order[lo:hi].tolist()])} for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if lo < hi])


def _mapper(split: Callable, buckets: int, counted: bool, texts: bool) -> Callable:
    """split(): returns the function that yields a text's pre-tokens, made once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, block, n = split(), None, 0
        for batch in batches:
            for i, (key, value) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                if block is None:
                    block = Block((batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), n := n + 1), counted)
                text = value.as_py() or ""
                block.add(key, text, pieces(text))
                if block.chars >= BLOCK_CHARS:
                    yield from block.rows(texts, buckets)
                    block = None
        if block is not None:
            yield from block.rows(texts, buckets)

    return run


def _reducer(evaluate: Callable) -> Callable:
    """evaluate(): returns the function from a word's bytes to its value as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = evaluate()
        known: dict[bytes, bytes] = {}
        held = 0
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                if held > KNOWN_BYTES:
                    known, held = {}, 0
                for w in unpack_words(row["lengths"], row["data"]):
                    v = known.get(w)
                    if v is None:
                        v = known[w] = value(w)
                        held += len(w) + len(v) + 200  # with what Python keeps for the two
                    out.append(v)
                yield _rows([{"block": row["block"], "bucket": row["bucket"], **pack_words(out)}])

    return run


def distinct_word_join(docs: DataFrame, id_col: str, text_col: str, split: Callable, evaluate: Callable, finish: Callable, schema: str, counted: bool) -> DataFrame:
    """finish(texts, lengths, data) makes a block's result: the row of its texts, and each word's value by number."""
    rows = rereadable(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), "texts")
    tasks = max(shuffle_partitions(docs.sparkSession), -(-size_in_bytes(rows) // BUCKET_BYTES))
    buckets = min(tasks, MOST_BUCKETS)
    rows = rows.select("id", "text", F.input_file_name().alias("file"), F.input_file_block_start().alias("at"))
    texts = rows.mapInArrow(lean(_mapper(split, buckets, counted, texts=True)), SCHEMA)
    words = rows.mapInArrow(lean(_mapper(split, buckets, counted, texts=False)), SCHEMA)
    values = words.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_reducer(evaluate)), SCHEMA)

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        pa.default_memory_pool().release_unused()
        own, given = rows[rows.bucket < 0], rows[rows.bucket >= 0].drop_duplicates("bucket").sort_values("bucket")
        if len(own) != 1:
            raise RuntimeError("the files changed between two reads: values without their texts")
        dealt = unpacked(own.dealt.iloc[0])
        by_bucket = np.argsort(dealt, kind="stable")
        lengths = np.concatenate([np.empty(0, np.int64), *(unpacked(x) for x in given.lengths)])
        if len(lengths) != len(dealt):
            raise RuntimeError("the files changed between two reads: words without their values")
        data = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(x) for x in given.data), np.uint8)
        # From the order of buckets to the order of numbers.
        number = np.empty(len(dealt), np.int64)
        number[by_bucket] = np.arange(len(dealt))
        data = gathered(data, np.concatenate([[0], np.cumsum(lengths)]), number).tobytes()
        return finish(next(own.itertuples()), lengths[number], data)

    return texts.unionByName(values).repartition(tasks, "block").groupBy("block").applyInPandas(joined, schema)


def gathered(values: np.ndarray, starts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The stretches values[starts[c]:starts[c + 1]] for each c in codes, one after the other."""
    first, n = starts[codes], starts[codes + 1] - starts[codes]
    ends = np.cumsum(n)
    return values[np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
