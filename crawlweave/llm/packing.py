"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Best-fit decreasing places pieces from the longest to the shortest, each into the tightest open sequence. Where a piece
goes depends on lengths alone, so the driver packs the histogram of lengths: at most `capacity` counts, whatever the
number of documents. A segment tree over remaining capacities finds the tightest open sequence in logarithmic time, for
whole runs of equal pieces and equal sequences at once. The resulting table of placements (runs of pieces of one length
to runs of sequences) is a step function of a piece's rank among the pieces of its length; executors look it up. The
packing is the same as one that places all documents one by one on one machine.

Cases: null or empty text -> the end token alone. Documents longer than the capacity are cut into full pieces and a
rest. Repeated rows are packed each. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, lean, parts, staged

CAPACITY = 4096
END_ID = 1
#: Words whose ids a worker remembers at most: the first that it meets, which the frequent ones are among.
CACHE = 150_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long, nth long"


#: Encoded words of this process, by tokenizer file; tasks that run in it one after another share them.
_SEEN: dict[str, dict[bytes, bytes]] = {}
#: A special token that stands between words when many are encoded at once.
SEPARATOR, SEPARATOR_ID, AT_ONCE = "<|endoftext|>", 49407, 64

#: Words that `PRE` leaves whole but for punctuation at their end: letters whose lower case is one letter and that no normal form changes.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿА-Яа-яЁё]+)([!-/:-@\\[-`{-~]*)")
PUNCTUATION = bytes(i for i in range(33, 127) if not chr(i).isalnum())
#: Letters that stand for bytes in the vocabulary of a byte-level model: printable ones for themselves, the others from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = dict(zip([i for i in range(256) if i not in _PRINTED], range(256, 512), strict=False))
#: The steps of a tokenizer before its model for which `PLAIN` holds.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


#: Bytes of the words that are merged in arrays, and how many such words at once.
LONGEST, MERGED_AT_ONCE = 64, 16_384


class Merges:
    """Byte-pair merges of many short words at once: in each round a word's pair that was learned first, the leftmost of those, becomes one.

    Pairs are found in an open hash table of fixed size, so that a round is a few array steps.
    """

    PAD, NONE, BITS = 65535, np.int32(2**31 - 1), 18

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str) -> None:
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        if max(vocab.values()) >= self.PAD or len(set(pairs)) < len(pairs) or len(pairs) > 1 << (self.BITS - 1):
            raise ValueError("more tokens or pairs than the table is made for")
        letters = [chr(_BYTES.get(i, i)) for i in range(256)]
        self.inner = np.asarray([vocab[c] for c in letters], dtype=np.int32)
        self.last = np.asarray([vocab[c + suffix] for c in letters], dtype=np.int32)
        self.made = np.asarray([vocab[a + b] for a, b in pairs], dtype=np.int32)
        keys = np.asarray([vocab[a] << 16 | vocab[b] for a, b in pairs], dtype=np.int64)
        self.keys, self.ranks = np.full(1 << self.BITS, -1, dtype=np.int64), np.full(1 << self.BITS, self.NONE, dtype=np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.keys[slot] < 0)
            taken, first = np.unique(slot[free], return_index=True)
            self.keys[taken], self.ranks[taken] = keys[left[free[first]]], left[free[first]]
            rest = np.ones(len(left), dtype=bool)
            rest[free[first]] = False
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.BITS) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """When each pair was learned; NONE if it was not."""
        keys = (a.astype(np.int64) << 16 | b).ravel()
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.ranks[slot], self.NONE)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.BITS) - 1)
            held = self.keys[slot[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out.reshape(a.shape)

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of 1 to LONGEST bytes."""
        out = [b""] * len(words)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(size, kind="stable")
        for lo in range(0, len(words), MERGED_AT_ONCE):
            some = order[lo : lo + MERGED_AT_ONCE]
            self._merge([words[i] for i in some.tolist()], size[some], some, out)
        return out

    def _merge(self, words: list[bytes], size: np.ndarray, at: np.ndarray, out: list[bytes]) -> None:
        raw, width = np.frombuffer(b"".join(words), dtype=np.uint8), int(size.max())
        columns = np.arange(width)
        # The last column is empty, so that every place has one to its right.
        ids = np.full((len(words), width + 1), self.PAD, dtype=np.int32)
        ids[:, :width][columns < size[:, None]] = self.inner[raw]
        ids[np.arange(len(words)), size - 1] = self.last[raw[np.cumsum(size) - 1]]
        rank = self.rank(ids[:, :-1], ids[:, 1:])
        while len(at):
            place = rank.argmin(axis=1)
            best = rank[np.arange(len(at)), place]
            live = best < self.NONE
            if not live.all():
                ended = ids[~live]
                held = ended != self.PAD
                flat, cuts = ended[held].astype("<u4").tobytes(), np.cumsum(held.sum(axis=1) * 4).tolist()
                for i, begin, end in zip(at[~live].tolist(), [0, *cuts], cuts, strict=False):
                    out[i] = flat[begin:end]
                at, ids, rank, place, best = at[live], ids[live], rank[live], place[live], best[live]
            own, moved = np.arange(len(at)), columns > place[:, None]
            ids[:, :-1] = np.where(moved, ids[:, 1:], ids[:, :-1])
            ids[own, place] = self.made[best]
            rank[:, :-1] = np.where(moved[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[own, place] = self.rank(ids[own, place], ids[own, place + 1])
            own, place = own[place > 0], place[place > 0]
            rank[own, place - 1] = self.rank(ids[own, place - 1], ids[own, place])


@lru_cache(maxsize=1)
def _loaded(path: str):
    """The tokenizer of a file, and its merges where words that match PLAIN need nothing else; tasks of a process share them."""
    from tokenizers import Tokenizer

    inner = Tokenizer.from_file(path)
    steps = [json.loads(x.__getstate__()) if x else {} for x in (inner.normalizer, inner.pre_tokenizer)]
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    plain = model["type"] == "BPE" and model.get("end_of_word_suffix") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    known = steps[0].get("normalizers") == NORMAL and steps[1].get("pretokenizers") == PRE and all("<|" in t.content for t in inner.get_added_tokens_decoder().values())
    return inner, Merges(model["vocab"], model["merges"], model["end_of_word_suffix"]) if plain and known else None


class WordTokenizer:
    """A lower-casing tokenizer that drops white space, applied word by word with a cache: its ids never depend on the words around.

    Texts are cut at ASCII white space; any other is treated by the tokenizer as it is within a text.
    """

    def __init__(self, path: str) -> None:
        self.inner, self.merges = _loaded(path)
        self.seen = _SEEN.setdefault(path, {})

    def _plain(self, new: list[bytes], into: dict[bytes, bytes]) -> list[bytes]:
        """Adds the ids of the plain words among new to into; returns the others."""
        if self.merges is None:
            return new
        others, plain, stems = [], [], []
        for w in new:
            # Bytes are letters here if they are ASCII; other words are matched. Lower case keeps the number of bytes.
            stem = w.rstrip(PUNCTUATION)
            if len(w) > LONGEST or not stem.isalpha():
                m = PLAIN.fullmatch(w.decode()) if len(w) <= LONGEST else None
                if m is None:
                    others.append(w)
                    continue
                stem = m[1].lower().encode()
            else:
                stem = stem.lower()
            plain.append(w)
            stems.append(stem)
        # A word with a comma has the ids of the word without it, and then the comma's.
        tails = list({w[len(stem) :] for w, stem in zip(plain, stems, strict=True) if len(w) > len(stem)})
        tail_ids = {b"": b""} | dict(zip(tails, self.merges.ids(tails), strict=True))
        into.update((w, ids if len(w) == len(stem) else ids + tail_ids[w[len(stem) :]]) for w, stem, ids in zip(plain, stems, self.merges.ids(stems), strict=True))
        return others

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        raws = [t.encode() for t in texts]
        # A special token's text is looked for before anything else, and a combining mark may join a small letter only.
        plain = [b"<|" not in r for r in raws]
        words = [(r if b"\xcc" in r or b"\xcd" in r else r.translate(LOWER)).split() if p else [] for r, p in zip(raws, plain, strict=True)]
        seen, extra = self.seen, {}
        every = set().union(*words)
        new = self._plain([w for w in every if w not in seen], extra)
        for lo in range(0, len(new), AT_ONCE * 64):
            groups = [new[i : i + AT_ONCE] for i in range(lo, min(lo + AT_ONCE * 64, len(new)), AT_ONCE)]
            for group, got in zip(groups, self.inner.encode_batch_fast([SEPARATOR.join(w.decode() for w in g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.asarray(got.ids, dtype="<u4")
                cuts = np.flatnonzero(ids == SEPARATOR_ID)
                raw, begin = ids.tobytes(), 0
                for w, end in zip(group, [*(cuts * 4).tolist(), len(raw)], strict=True):
                    extra[w] = raw[begin:end]
                    begin = end + 4
        if extra and len(seen) + len(extra) <= CACHE:
            seen.update(extra)
            extra = {}
        get = ({w: extra[w] if w in extra else seen[w] for w in every} if extra else seen).__getitem__
        return [
            np.frombuffer(b"".join(map(get, ws)), dtype="<u4") if p else np.asarray(self.inner.encode(t, add_special_tokens=False).ids, dtype="<u4")
            for t, ws, p in zip(texts, words, plain, strict=True)
        ]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token pieces of every document, with the chunk of the scan that made them and their place in it; written to the shared folder."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from pyspark import TaskContext

        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        tok, chunk, nth = WordTokenizer(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[list[int]] = [[] for _ in range(6)]
            for some in parts(batch):
                for i, got in zip(some.column(0).to_pylist(), tok.encode(some.column(1).to_pylist()), strict=True):
                    raw = np.append(got, np.uint32(END_ID)).astype("<u4")
                    for piece, start in enumerate(range(0, len(raw), capacity)):
                        part = raw[start : start + capacity]
                        for k, v in enumerate((i, piece, start, len(part), zlib.crc32(part.tobytes()), nth)):
                            out[k].append(v)
                        nth += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(v, ty) for v, ty in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays[:5], pa.array(np.full(len(out[0]), chunk), pa.int64()), arrays[5]], names=["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "nth"])

    return staged(rows.mapInArrow(lean(run), PIECES), "pieces")


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity: which of them have open sequences."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << (capacity + 1 - 1).bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, at: int, filled: bool) -> None:
        at += self.size
        self.any[at] = filled
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least `least` that has an open sequence."""
        at = least + self.size
        if self.any[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first sequence, offset): pieces first.. of a length go to one sequence each from first sequence on; where offset is -1 - p, p pieces a sequence fill it from 0 on."""
    tree, open_, out, new = CapacityTree(capacity), {}, [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if not open_.get(left):
                tree.set(left, True)
            open_.setdefault(left, []).append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            left = tree.tightest(length)
            if left is None:
                # No open sequence takes it: as tightest fit would, fill new ones to the brim with pieces of this length.
                per = capacity // length
                full, rest = divmod(todo, per)
                if full:
                    out.append((length, rank, full * per, new, -1 - per))
                    put(capacity - per * length, new, full)
                    new += full
                    rank += full * per
                if rest:
                    out.append((length, rank, rest, new, -1 - rest))
                    put(capacity - rest * length, new, 1)
                    new += 1
                break
            first, n = open_[left].pop()
            if not open_[left]:
                tree.set(left, False)
            use = min(n, todo)
            out.append((length, rank, use, first, capacity - left))
            put(left, first + use, n - use)
            put(left - length, first, use)
            rank, todo = rank + use, todo - use
    return out


def place(length: np.ndarray, rank: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by length and rank; table: rows of best_fit_decreasing, sorted by length and rank."""
    key = table[:, 0] * (1 << 48) + table[:, 1]
    row = table[np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1]
    at = rank - row[:, 1]
    many = row[:, 4] < 0
    per = np.where(many, -1 - row[:, 4], 1)
    return row[:, 3] + at // per, np.where(many, at % per * length, row[:, 4])


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces that are stored (as `pieces` returns them)."""
    local = found.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    # A piece's rank among those of its length: pieces of earlier chunks, then its place within the chunk.
    w = Window.partitionBy("length").orderBy("chunk")
    before = local.withColumn("before", F.sum("n").over(w) - F.col("n")).select("length", "chunk", "before")
    histogram = {r["length"]: r["n"] for r in local.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = np.asarray(sorted(best_fit_decreasing(histogram, capacity)) or [(0, 0, 0, 0, 0)], dtype=np.int64)
    own = F.row_number().over(Window.partitionBy("chunk", "length").orderBy("nth")) - 1
    ranked = found.withColumn("own", own).join(before, ["chunk", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, offset = place(*(batch.column(k).to_numpy() for k in ("length", "rank")), table)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises, cuts and packs documents; one row per piece."""
    return pack(pieces(docs, tokenizer, capacity), capacity)
