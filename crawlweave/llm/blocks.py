"""Corpora as blocks of encoded documents, and questions from blocks to shards and back.

A block is a row: some documents of one scan task as numbers of the block's own words. Global facts about words or
n-grams are had by scatter and reply: each block sends every shard one message with its distinct keys, a shard merges the
messages of all blocks and answers each in the order it was asked. Messages hold distinct keys alone, so that a frequent
word weighs no more than a rare one, and shards are as many as the data need.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, staged

#: Bytes of text of a block, about; a longer text is a block of its own.
BLOCK_BYTES = 12_000_000

_KINDS = {1: "<u1", 2: "<u2", 4: "<u4", 8: "<u8"}


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays as compressed bytes: the smallest width that holds each, bytes of one significance together."""
    import zstandard

    head, body = [len(arrays)], []
    for a in arrays:
        most = int(a.max()) if len(a) else 0
        width = next(w for w in _KINDS if most < 1 << (8 * w))
        head += [len(a), width]
        a = a.astype(_KINDS[width])
        body += [(a >> a.dtype.type(8 * k)).astype(np.uint8).tobytes() for k in range(width)]
    raw = np.asarray(head, dtype="<u8").tobytes() + b"".join(body)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    head = np.frombuffer(raw, "<u8", 2 * n, 8).reshape(n, 2)
    out, at = [], 8 + 16 * n
    for length, width in head.tolist():
        planes = np.frombuffer(raw, np.uint8, length * width, at).reshape(width, length)
        a = planes[0].astype(_KINDS[width])
        for k in range(1, width):
            a |= planes[k].astype(_KINDS[width]) << a.dtype.type(8 * k)
        out.append(a)
        at += length * width
    return out


def numbering() -> defaultdict[bytes, int]:
    """Numbers words from 0 as they are first asked for."""
    return defaultdict(itertools.count().__next__)


BLOCK = "block long, doc_ids array<bigint>, marks array<int>, lengths binary, tokens binary, words binary, n_tokens long, n_words long"


def encode(docs: DataFrame, mark: Column, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of documents, written to the shared folder. mark: an integer that goes with each document.

    tokens are numbers of words by frequency in the block; words are joined by line feeds (they hold no white space).
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), mark.cast("int").alias("mark"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids: list = []
        marks: list = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        seen = numbering()
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal ids, marks, lengths, parts, seen, size, number
            raw = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            count = np.bincount(raw, minlength=len(seen))
            order = np.argsort(-count, kind="stable")
            rank = np.empty(len(seen), dtype=np.uint32)
            rank[order] = np.arange(len(seen), dtype=np.uint32)
            words = list(seen)
            row = [number, ids, marks, pack(np.asarray(lengths, dtype=np.uint64)), pack(rank[raw]), zstandard.ZstdCompressor(level=3).compress(b"\n".join([words[i] for i in order.tolist()])), len(raw), len(seen)]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["block", "doc_ids", "marks", "lengths", "tokens", "words", "n_tokens", "n_words"])
            ids, marks, lengths, parts, seen, size = [], [], [], [], numbering(), 0
            number += 1
            return out

        for batch in batches:
            for i, m, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = t.encode().translate(LOWER)
                words = raw.split()
                parts.append(np.fromiter(map(seen.__getitem__, words), dtype=np.uint32, count=len(words)))
                ids.append(i)
                marks.append(m)
                lengths.append(len(words))
                size += len(raw) + 100
                if size >= block_bytes:
                    yield block()
        if ids:
            yield block()

    return staged(rows.mapInArrow(run, BLOCK), "blocks")


def words_of(data: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw.split(b"\n") if raw else []


MESSAGE = "shard int, block long, body binary, words binary"
REPLY = "block long, shard int, body binary, distinct_words long, total long"


def vocabulary(blocks: DataFrame, shards: int, count) -> DataFrame:
    """Answers each block with the global number and count of its words; written to the shared folder.

    count(tokens, lengths, marks, n_words) gives a block's own counts. Words are numbered in each shard by falling count,
    number = rank * shards + shard, so that small numbers are frequent words. distinct_words and total of a reply with
    block -1 are a shard's words of positive count and their sum.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        for batch in batches:
            for row in batch.to_pylist():
                words = words_of(row["words"])
                own = count(unpack(row["tokens"])[0], unpack(row["lengths"])[0], np.asarray(row["marks"], dtype=np.int64), len(words))
                to = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words)) % np.uint64(shards)
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(shards + 1, dtype=np.uint64))
                out: list[list] = [[], [], [], []]
                for s in range(shards):
                    part = order[cuts[s] : cuts[s + 1]]
                    if len(part):
                        for k, v in enumerate((s, row["block"], pack(own[part].astype(np.uint64)), zstandard.ZstdCompressor(level=1).compress(b"\n".join([words[i] for i in part.tolist()])))):
                            out[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "block", "body", "words"])

    def merge(asked: pa.Table) -> pa.Table:
        shard = asked.column("shard")[0].as_py()
        seen = numbering()
        keys, counts, blocks_, bodies = [], [], asked.column("block").to_pylist(), asked.column("body")
        for body, words in zip(bodies, asked.column("words"), strict=True):
            got = words_of(words.as_py())
            keys.append(np.fromiter(map(seen.__getitem__, got), dtype=np.int64, count=len(got)))
            counts.append(unpack(body.as_py())[0])
        total = np.bincount(np.concatenate(keys), weights=np.concatenate(counts), minlength=len(seen)).astype(np.uint64)
        rank = np.empty(len(seen), dtype=np.uint64)
        rank[np.argsort(-total.astype(np.int64), kind="stable")] = np.arange(len(seen), dtype=np.uint64)
        number = rank * np.uint64(shards) + np.uint64(shard)
        body = [pack(number[k], total[k]) for k in keys]
        return pa.table({"block": pa.array([*blocks_, -1], pa.int64()), "shard": pa.array([shard] * (len(body) + 1), pa.int32()), "body": pa.array([*body, b""], pa.binary()), "distinct_words": pa.array([0] * len(body) + [int((total > 0).sum())], pa.int64()), "total": pa.array([0] * len(body) + [int(total.sum())], pa.int64())})

    return staged(blocks.mapInArrow(ask, MESSAGE).groupBy("shard").applyInArrow(merge, REPLY), "vocabulary")


def shard_order(words: list[bytes], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """How `vocabulary` has dealt a block's words: their numbers by shard, and where each shard's begin."""
    import xxhash

    to = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words)) % np.uint64(shards)
    order = np.argsort(to, kind="stable")
    return order, np.searchsorted(to[order], np.arange(shards + 1, dtype=np.uint64))


NUMBERED = "block long, doc_ids array<bigint>, marks array<int>, lengths binary, tokens binary, numbers binary, n_tokens long"


def numbered(blocks: DataFrame, replies: DataFrame, shards: int) -> DataFrame:
    """Blocks with the global numbers and counts of their words in place of the words; written to the shared folder."""

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        answers = {s: b for s, b in zip(right.column("shard").to_pylist(), right.column("body").to_pylist(), strict=True)}
        for row in left.to_pylist():
            words = words_of(row["words"])
            order, cuts = shard_order(words, shards)
            number, total = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
            for s, body in answers.items():
                part = order[cuts[s] : cuts[s + 1]]
                number[part], total[part] = unpack(body)
            out.append({k: row[k] for k in ("block", "doc_ids", "marks", "lengths", "tokens")} | {"numbers": pack(number, total), "n_tokens": row["n_tokens"]})
        return pa.Table.from_pylist(out, schema=pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("marks", pa.list_(pa.int32())), ("lengths", pa.binary()), ("tokens", pa.binary()), ("numbers", pa.binary()), ("n_tokens", pa.int64())]))

    return staged(blocks.groupBy("block").cogroup(replies.where("block >= 0").groupBy("block")).applyInArrow(join, NUMBERED), "numbered")
