"""Language-model scoring with an Elias-Fano n-gram trie.

The model is a trigram model. With c the counts over the training texts, a the word before, ab the two words before:
P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),
P(w|a) = (1 - RHO) c(aw) / (c(a) + MU) + l(a) P(w), l(a) = RHO + (1 - RHO) MU / (c(a) + MU),
P(w|ab) = max(c(abw) - D, 0) / c(ab) + D n(ab) / c(ab) P(w|a), n(ab) the number of distinct words after ab; P(w|a) where
ab is unknown. Each sums to 1 over all known words, the end and one unknown word. A text begins with two begin marks.

Shards hold the n-grams whose first two words hash to them, so that all words after a context are in one shard, and the
most frequent word is spread over all. A block of documents asks each shard once about its distinct n-grams and says how
often each occurs in its training texts; the shard adds these up, builds its trie, maps it into memory from a file of its
own that is removed when it has answered, and answers every block from it. Blocks then sum their documents' log
probabilities. All that grows with the corpus is spread over shards and blocks; the driver gets a few totals. Messages are
rows as a shuffle's blocks are: as many as blocks times shards, their bytes in proportion to the corpus.

Cases: null text is empty: one end token. Repeated rows are counted and scored each. A null id counts as an empty text
where rows are held out. Without training texts every word is unknown. An empty table gives no rows. A very long text is a
block of its own, scored whole; a block's tokens are in one task's memory. Other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import encode, numbered, pack, unpack, vocabulary
from .common import released, staged
from .elias_fano import Trie, dequantise

#: Chosen for held-out texts.
DISCOUNT, RHO, MU = 0.75, 0.7, 200.0
#: Tokens of a shard, about.
SHARD_TOKENS = 1_000_000
#: N-grams that are looked up or scored at once.
LOOKUPS = 1 << 18
#: Numbers of the begin and end marks; words come after them.
BEGIN, END, FIRST = 0, 1, 2

ASKED = "shard int, block long, body binary"
ANSWER = "block long, shard int, body binary"


def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and each key's place among them as a 32-bit number: np.unique with fewer and narrower arrays."""
    if not len(key):
        return key, np.zeros(0, dtype=np.uint32)
    bits = (len(key) - 1).bit_length()
    if int(key.max()).bit_length() + bits <= 64:  # key and place fit in a number: sorting these is several times faster
        held = key.astype(np.uint64)
        held <<= np.uint64(bits)
        held |= np.arange(len(key), dtype=np.uint64)
        held.sort()
        order = (held & np.uint64((1 << bits) - 1)).astype(np.uint32)
        held >>= np.uint64(bits)
    else:
        order = np.argsort(key)
        held = key[order]
    new = np.empty(len(key), dtype=bool)
    new[0] = True
    np.not_equal(held[1:], held[:-1], out=new[1:])
    where = np.empty(len(key), dtype=np.uint32)
    where[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return held[new].astype(key.dtype), where


def _stream(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Tokens with marks: begin, begin, words, end, end for each document."""
    lengths = lengths.astype(np.int64)
    first = np.cumsum(lengths + 4) - (lengths + 4)
    out = np.zeros(int((lengths + 4).sum()), dtype=np.uint32)
    ends = first + lengths + 2
    inner = np.ones(len(out), dtype=bool)
    for at in (first, first + 1, ends, ends + 1):
        inner[at] = False
    out[inner] = tokens
    out[inner] += np.uint32(FIRST)
    out[ends] = out[ends + 1] = END
    return out


def _grams(stream: np.ndarray, lengths: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, b, c) in order, for each n-gram place its number, and its document. Places: all that end within a document."""
    doc = np.repeat(np.arange(len(lengths), dtype=np.uint32), lengths.astype(np.int64) + 2)
    # The stream has two tokens more for each document than there are places.
    at = np.arange(len(doc), dtype=np.int64)
    at += doc
    at += doc
    base = np.int64(words + FIRST)
    key = stream[at].astype(np.int64)
    at += 1
    key *= base
    key += stream[at]
    ab, i = ranked(key)
    at += 1
    key = i.astype(np.int64) * base
    del i
    key += stream[at]
    del at
    key, where = ranked(key)
    pair = ab[key // base]
    return (pair // base).astype(np.uint32), (pair % base).astype(np.uint32), (key % base).astype(np.uint32), where, doc


def _deal(a: np.ndarray, b: np.ndarray, shards: int) -> np.ndarray:
    """Shard of the n-grams that begin with words a, b."""
    h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) + np.uint64(0x7F4A7C15))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h >>= np.uint64(33)
    h %= np.uint64(shards)
    return h.astype(np.uint32)


class _Block:
    """A block's n-grams in the order in which shards are asked. Numbers within a block are kept in 32 bits."""

    def __init__(self, row: dict, shards: int, train_docs: int) -> None:
        self.lengths = unpack(row["lengths"])[0]
        number, total = unpack(row["numbers"])
        self.number = np.concatenate([[BEGIN, END], number.astype(np.int64) + FIRST])
        self.total = np.concatenate([[train_docs, train_docs], total.astype(np.int64)])
        a, b, c, where, self.doc = _grams(_stream(unpack(row["tokens"])[0], self.lengths), self.lengths, len(number))
        to = _deal(self.number[a], self.number[b], shards)
        # The stable sort of 16-bit numbers is by radix.
        order = np.argsort(to.astype(np.uint16) if shards <= 1 << 16 else to, kind="stable").astype(np.uint32)
        self.a, self.b, self.c = a[order], b[order], c[order]
        del a, b, c
        self.cuts = np.searchsorted(to[order], np.arange(shards + 1, dtype=np.uint32))
        place = np.empty(len(order), dtype=np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        del order, to
        # The number of each place's n-gram in this order.
        self.gram = place[where]
        del place, where
        # Pairs (a, b) in the same order: shards keep the n-grams of a pair together.
        new = np.append(True, (self.a[1:] != self.a[:-1]) | (self.b[1:] != self.b[:-1])) if len(self.a) else np.zeros(0, bool)
        self.pair_first = np.flatnonzero(new)
        self.pair = np.cumsum(new, dtype=np.int64).astype(np.uint32) - np.uint32(1)
        self.pair_cuts = np.searchsorted(self.pair_first, self.cuts)

    def counts(self, marks: np.ndarray) -> np.ndarray:
        """Occurrences in training texts of each n-gram."""
        return np.bincount(self.gram[marks[self.doc] == 1], minlength=len(self.a))


def _ask(shards: int, train_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row, shards, train_docs)
                count = block.counts(np.asarray(row["marks"], dtype=np.int64))
                out: list[list] = [[], [], []]
                for s in range(shards):
                    lo, hi, plo, phi = block.cuts[s], block.cuts[s + 1], block.pair_cuts[s], block.pair_cuts[s + 1]
                    if lo == hi:
                        continue
                    heads = block.pair_first[plo:phi]
                    pa_, pb = block.a[heads], block.b[heads]
                    new = np.append(True, pa_[1:] != pa_[:-1])
                    at = np.flatnonzero(new)
                    body = pack(block.number[pa_[at]], block.total[pa_[at]], np.diff(np.append(at, len(pa_))), block.number[pb], np.diff(np.append(heads, hi)), block.number[block.c[lo:hi]], count[lo:hi])
                    for k, v in enumerate((s, row["block"], body)):
                        out[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["shard", "block", "body"])

    return run


def build_trie(words: np.ndarray, pair_a: np.ndarray, pair_b: np.ndarray, context: np.ndarray, pair: np.ndarray, c: np.ndarray, count: np.ndarray) -> Trie:
    """A trie of the n-grams that occur, their words given by place among words. Pairs in order, context: c(a) of each; triples in order with counts."""
    kept = count > 0
    cab = np.bincount(pair, weights=count, minlength=len(pair_a))
    after = np.bincount(pair[kept], minlength=len(pair_a))
    known = cab > 0
    number = np.cumsum(known) - 1
    p3 = np.maximum(count[kept] - DISCOUNT, 0) / cab[pair[kept]]
    pair_a, pair_b, c = pair_a[known], pair_b[known], c[kept]
    used = np.zeros(len(words), dtype=bool)
    for x in (pair_a, pair_b, c):
        used[x] = True
    place = np.cumsum(used) - 1
    return Trie.build_at(words[used], place[pair_a], place[pair_b], number[pair[kept]], place[c], (1 - RHO) * cab[known] / (context[known] + MU), DISCOUNT * after[known] / cab[known], p3)


def _asked(asked: pa.Table) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """All blocks' messages as arrays: first words, their counts and numbers of pairs; second words and their numbers of n-grams; last words and counts; and each block's numbers of pairs and n-grams."""
    parts: list[list[np.ndarray]] = [[], [], [], [], [], [], []]
    sizes = []
    for body in asked.column("body"):
        message = unpack(body.as_py())
        for part, x in zip(parts, message, strict=True):
            part.append(x)
        sizes.append((len(message[3]), len(message[5])))
    out = []
    for part in parts:
        out.append(np.concatenate(part))
        part.clear()
    return out, sizes


def _answer(asked: pa.Table) -> pa.Table:
    shard, blocks = asked.column("shard")[0].as_py(), asked.column("block").to_pylist()
    (a, t, nb, b, nc, c, n), sizes = _asked(asked)
    nb, nc = nb.astype(np.int64), nc.astype(np.int64)
    # Words by rank within the shard, so that keys of two and three words fit.
    words, place = ranked(np.concatenate([a, b, c]))
    words = words.astype(np.int64)
    a, b, c = place[: len(a)], place[len(a) : len(a) + len(b)], place[len(a) + len(b) :]
    key = np.repeat(a, nb).astype(np.int64)
    key *= len(words)
    key += b
    key, of_pair = ranked(key)
    pair_a, pair_b = np.divmod(key, len(words))
    context = np.zeros(len(key), dtype=np.int64)
    context[of_pair] = np.repeat(t, nb)
    del a, b, t, nb
    key = np.repeat(of_pair, nc).astype(np.int64)
    key *= len(words)
    key += c
    del c, nc, place
    key, of_triple = ranked(key)
    pair, last = np.divmod(key, len(words))
    del key
    count = np.bincount(of_triple, weights=n, minlength=len(pair)).astype(np.int64)
    del n
    trie = build_trie(words, pair_a, pair_b, context, pair, last, count)
    with tempfile.NamedTemporaryFile(delete=False) as f:
        f.write(trie.to_bytes())
    try:
        trie = Trie.from_buffer(np.memmap(f.name, dtype=np.uint8, mode="r"))
        # Each distinct word is looked up once.
        of_word, known = trie.words.find(words)
        node, ok = trie.pairs_at(of_word[pair_a], of_word[pair_b], known[pair_a] & known[pair_b])
        code = lambda k, at, hit: np.where(hit, trie.codes[k][at] if len(trie.codes[k]) else 0, 0).astype(np.uint16)
        p2, back, p3 = code("p2", node, ok), code("backoff3", node, ok), np.zeros(len(pair), dtype=np.uint16)
        some = np.flatnonzero(ok[pair])
        for lo in range(0, len(some), LOOKUPS):
            part = some[lo : lo + LOOKUPS]
            at, hit = trie.triples_at(node[pair[part]], of_word[last[part]], known[last[part]])
            p3[part] = code("p3", at, hit)
    finally:
        os.unlink(f.name)
    bodies, plo, lo = [], 0, 0
    for np_, nc in sizes:
        pairs = of_pair[plo : plo + np_]
        bodies.append(pack(p2[pairs], back[pairs], p3[of_triple[lo : lo + nc]]))
        plo, lo = plo + np_, lo + nc
    return pa.table({"block": pa.array(blocks, pa.int64()), "shard": pa.array([shard] * len(blocks), pa.int32()), "body": pa.array(bodies, pa.binary())})


SCORES = "doc_id long, mark int, n_tokens long, n_known long, base_score double, score double"


def _log_probabilities(block: _Block, answers: dict[int, object], total: int, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's log10 probability by the base and by the model, and its known tokens."""
    p2, back, p3 = (np.zeros(n, dtype=np.uint16) for n in (len(block.pair_first), len(block.pair_first), len(block.a)))
    for s, body in answers.items():
        plo, phi, lo, hi = block.pair_cuts[s], block.pair_cuts[s + 1], block.cuts[s], block.cuts[s + 1]
        p2[plo:phi], back[plo:phi], p3[lo:hi] = unpack(body.as_py())
    p1 = (block.total + 0.5) / (total + 0.5 * (distinct + 1))
    lam2 = RHO + (1 - RHO) * MU / (block.total + MU)
    docs, n = len(block.lengths), len(block.gram)
    base, score, known = np.zeros(docs), np.zeros(docs), np.zeros(docs, dtype=np.int64)
    for lo in range(0, n, LOOKUPS):
        # The pair (b, c) of an n-gram (a, b, c) is the first pair of the next place's n-gram. The last n-gram of a document,
        # (w, end, end), only carries the pair (w, end): so a slice needs one place more than it scores.
        doc, gram = block.doc[lo : lo + LOOKUPS + 1], block.gram[lo : lo + LOOKUPS + 1]
        use = np.flatnonzero(doc[1:] == doc[:-1])
        own, here = gram[use], doc[use]
        b, c = block.b[own], block.c[own]
        backoff = dequantise(back[block.pair[own]])
        p = dequantise(p3[own]) + np.where(backoff > 0, backoff, 1.0) * (dequantise(p2[block.pair[gram[use + 1]]]) + lam2[b] * p1[c])
        first = int(here[0]) if len(here) else 0
        for out, weights in ((score, np.log10(np.minimum(p, 1.0))), (base, np.log10(p1[c])), (known, block.total[c] > 0)):
            add = np.bincount(here - np.uint32(first), weights)
            out[first : first + len(add)] += add.astype(out.dtype)
    return base, score, known


def _score(shards: int, train_docs: int, total: int, distinct: int):
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    names = ["doc_id", "mark", "n_tokens", "n_known", "base_score", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = dict(zip(right.column("shard").to_pylist(), right.column("body"), strict=True)) if right.num_rows else {}
        out = []
        for row in left.to_pylist():
            block = _Block(row, shards, train_docs)
            base, score, known = _log_probabilities(block, answers, total, distinct)
            values = (row["doc_ids"], row["marks"], block.lengths.astype(np.int64) + 1, known, base, score)
            out.append(pa.Table.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names))
        return pa.concat_tables(out) if out else pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)

    return run


def _train_counts(tokens: np.ndarray, lengths: np.ndarray, marks: np.ndarray, words: int) -> np.ndarray:
    return np.bincount(tokens[np.repeat(marks == 1, lengths.astype(np.int64))], minlength=words)


def score_documents(docs: DataFrame, learn: Column) -> DataFrame:
    """Scores all texts with a model of those for which learn holds.

    doc_id, mark (1: learned from), n_tokens, n_known, base_score, score, and train_tokens, the number of all training tokens.
    """
    coded = encode(docs, F.coalesce(learn, F.lit(False)).cast("int"))
    tokens = coded.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(2 * coded.sparkSession.sparkContext.defaultParallelism, int(tokens // SHARD_TOKENS) + 1)
    replies = vocabulary(coded, shards, _train_counts)
    sums = replies.where("block < 0").agg(F.sum("distinct_words").alias("v"), F.sum("total").alias("n")).first()
    train_docs = coded.agg(F.sum(F.aggregate("marks", F.lit(0).cast("long"), lambda s, m: s + m))).first()[0] or 0
    total, distinct = (sums["n"] or 0) + train_docs, (sums["v"] or 0) + (train_docs > 0)
    known = numbered(coded, replies, shards)
    released(coded, replies)
    answers = staged(known.mapInArrow(_ask(shards, train_docs), ASKED).groupBy("shard").applyInArrow(_answer, ANSWER), "answers")
    scored = known.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(shards, train_docs, total, distinct), SCORES)
    scored = staged(scored, "scores")
    released(known, answers)
    return scored.withColumn("train_tokens", F.lit(int(total)).cast("long"))
