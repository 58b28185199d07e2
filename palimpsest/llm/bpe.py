"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is split by a pattern; each piece's UTF-8 bytes are mapped to printable characters (one character a byte), the
BPE model of the tokenizers library merges them, and each distinct piece is encoded once per worker. Offsets come back
through the same mapping: a token covers as many bytes as it has characters, and bytes are counted into code points.
Decoding reverses the table; a character whose bytes are split between tokens is put together before UTF-8 decoding.

Edge cases: a null text counts as empty and gives no tokens; repeated rows are encoded each; empty tables give empty
tables; other columns are not looked at. Ids outside the vocabulary raise ValueError when decoded.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import mapped

#: Entries at which a worker's cache of encoded pieces starts anew, and characters split at once. Both bound memory only.
CACHE, BLOCK = 400_000, 1_000_000


def byte_characters() -> list[str]:
    """The printable character for each byte: itself if it prints, else one from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_list(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that makes each token, in rank order: merging below the token's own rank leaves two parts."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if ranks.get(parts[best] + parts[best + 1], 1 << 60) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class Codec:
    """Encodes and decodes with one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        import regex
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        ranks = read_ranks(path)
        chars = byte_characters()
        say = lambda b: "".join([chars[x] for x in b])
        self.chars = chars
        self.split = regex.compile(pattern).findall
        self.model = Tokenizer(BPE({say(k): v for k, v in ranks.items()}, [(say(a), say(b)) for a, b in merge_list(ranks)]))
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.bytes_of[v] = k
        self.known = set(ranks.values())
        self.length_of = np.array([len(x) for x in self.bytes_of], dtype=np.int64)
        self.cache: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        """Encodes the pieces that are new, all at once."""
        table, space, new = self.chars, self.chars[32], []
        for p in pieces:
            if p not in self.cache:
                if p.isascii() and p.isprintable():
                    new.append((p, p.replace(" ", space)))
                else:
                    new.append((p, "".join([table[b] for b in p.encode()])))
        for (p, _), e in zip(new, self.model.encode_batch_fast([x for _, x in new], add_special_tokens=False), strict=True):
            self.cache[p] = array("I", e.ids).tobytes()

    def split_many(self, many: list[str]) -> Iterator[list[str]]:
        """Pieces of each text, all in the cache by then; they are learnt for about BLOCK characters together."""
        at = 0
        while at < len(many):
            if len(self.cache) > CACHE:
                self.cache.clear()
            split, size = [], 0
            while at < len(many) and (not split or size + len(many[at]) <= BLOCK):
                split.append(self.split(many[at]))
                size += len(many[at])
                at += 1
            self.learn(set().union(*split))
            yield from split

    def encode_many(self, many: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        own = self.cache.__getitem__
        for pieces in self.split_many(many):
            yield b"".join(map(own, pieces))

    def offsets(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Code points [start, end) that each token touches; both tokens of a split character touch it."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        ends = np.cumsum(self.length_of[np.frombuffer(ids, dtype="<u4")])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        point = np.cumsum((raw & 0xC0) != 0x80) - 1
        return (point[starts], point[ends - 1] + 1) if len(ends) else (ends, ends)

    def decode(self, ids: bytes) -> bytes:
        got = np.frombuffer(ids, dtype="<u4").tolist()
        if not self.known.issuperset(got):
            raise ValueError("an id is outside the vocabulary")
        return b"".join(map(self.bytes_of.__getitem__, got))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a task. A worker gets this module anew with each task: the former one goes, with its codec, in a collection."""
    gc.collect()
    return Codec(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<long>, starts and ends array<long>: the tokens of each text with the code points they touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            ids, starts, ends = [], [], []
            many = [t or "" for t in b.column(1).to_pylist()]
            for t, got in zip(many, own.encode_many(many), strict=True):
                s, e = own.offsets(t, got)
                ids.append(np.frombuffer(got, dtype="<u4").astype(np.int64))
                starts.append(s)
                ends.append(e)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, type=kind) for x in (ids, starts, ends))], names=["id", "ids", "starts", "ends"])
        own.cache.clear()  # the codec stays with the worker, its pieces don't

    kind = df.schema[id_col].dataType.simpleString()
    return mapped(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, f"id {kind}, ids array<bigint>, starts array<bigint>, ends array<bigint>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, bytes binary, text string: ids decoded; bytes that aren't UTF-8 become replacement characters in text only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            raw = [own.decode(np.array(x or [], dtype="<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, type=pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw], type=pa.string())], names=["id", "bytes", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, bytes binary, text string").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, n_split (tokens that start inside a character): both directions in
    one pass, so that the ids of a text never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            n, digests, decoded, split = [], [], [], []
            many = [t or "" for t in b.column(1).to_pylist()]
            for t, ids in zip(many, own.encode_many(many), strict=True):
                back = own.decode(ids)
                n.append(len(ids) // 4)
                digests.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(back).hexdigest())
                if len(back) == len(t):  # only ASCII
                    split.append(0)
                else:
                    ends = np.cumsum(own.length_of[np.frombuffer(ids, dtype="<u4")])[:-1]
                    split.append(int(((np.frombuffer(back, dtype=np.uint8)[ends] & 0xC0) == 0x80).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), pa.array(split, pa.int64())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split"])
        own.cache.clear()

    kind = df.schema[id_col].dataType.simpleString()
    return mapped(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_split bigint").withColumnRenamed("id", id_col)
