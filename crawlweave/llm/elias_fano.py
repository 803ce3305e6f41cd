"""Elias-Fano sequences and an n-gram trie made of them, all operations on whole arrays.

A sequence of n non-decreasing numbers below u keeps the low floor(log2(u/n)) bits of each packed, and the high parts in
unary as a bit vector with a count of ones before each word: two bits a number and a directory of half a bit's worth. It
gives the i-th number by select, and the first number >= v by select of zeros and a search among the low bits of one
high part. Where many are asked for that lie close together, their stretch of the sequence is decoded once instead.

The trie has three levels (words; words after a word; words after two words). A level keeps the children of all nodes
one after another: an Elias-Fano sequence of pointers says where each node's children begin, another one holds the
children, each node's numbers raised by the last one of the node before, so that the level is monotone. A child is found
by a successor search for the context's base plus the child's number, and counts only if it lies in the context's range.
Probabilities and back-off weights are quantised to 12-bit codes. The whole trie is one run of bytes, so that it can be
memory-mapped.
"""

from __future__ import annotations

import numpy as np

#: Quantised log10 probabilities: code 0 is probability 0, codes 1..4095 are steps of 12 / 4094 from 1e-12 to 1.
CODES, DECADES = 4094, 12.0
#: Numbers whose bits are packed at once; eight times any number, so that slices begin at whole bytes.
SLICE = 1 << 16
#: A stretch is decoded if it has at most so many bits of the high parts for each number that is asked for.
STRETCH = 16
#: Probability of each code.
_LEVELS = np.append(0.0, 10 ** (np.arange(CODES + 1, dtype=np.float64) / CODES * DECADES - DECADES))


def quantise(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        log = np.log10(p)
    return np.where(p > 0, np.clip(np.rint((log + DECADES) / DECADES * CODES), 0, CODES) + 1, 0).astype(np.uint16)


def dequantise(code: np.ndarray) -> np.ndarray:
    return _LEVELS[code]


def _select_in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th (from 0) one of each word."""
    at = np.zeros(len(word), dtype=np.uint64)
    r = r.astype(np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count((word >> at) & np.uint64((1 << step) - 1)).astype(np.uint64)
        skip = r >= low
        r = np.where(skip, r - low, r)
        at = np.where(skip, at + np.uint64(step), at)
    return at


class EliasFano:
    """A non-decreasing sequence, over arrays that may be views of a memory map."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones
        self.zeros = np.arange(len(high), dtype=np.int64) * 64 - ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * bits + 7) // 8 + 16, dtype=np.uint8)
        for lo in range(0, n if bits else 0, SLICE):
            part = values[lo : lo + SLICE]
            packed = np.empty((len(part), bits), dtype=np.uint8)
            for k in range(bits):
                packed[:, k] = (part >> np.uint64(k)) & np.uint64(1)
            packed = np.packbits(packed.reshape(-1), bitorder="little")
            low[lo * bits // 8 : lo * bits // 8 + len(packed)] = packed
        low = np.concatenate([low, np.zeros(-len(low) % 8, np.uint8)]).view(np.uint64)
        parts = (values >> np.uint64(bits)).astype(np.int64)
        flags = np.zeros((int(parts[-1]) if n else 0) + n + 2, dtype=np.uint8)
        flags[parts + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little")
        high = np.concatenate([high, np.zeros(8 + -len(high) % 8, np.uint8)]).view(np.uint64)
        count = np.bitwise_count(high).astype(np.int64)
        return cls(n, bits, low, high, np.cumsum(count) - count)

    def arrays(self) -> list[np.ndarray]:
        return [np.asarray([self.n, self.bits], dtype=np.int64), self.low, self.high, self.ones]

    @classmethod
    def of(cls, head: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> EliasFano:
        return cls(int(head[0]), int(head[1]), low, high, ones)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        rest = np.where(shift > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return ((self.low[word] >> shift) | rest) & np.uint64((1 << self.bits) - 1)

    def select(self, i: np.ndarray) -> np.ndarray:
        """Places of the i-th ones."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        return word * 64 + _select_in_word(self.high[word], i - self.ones[word]).astype(np.int64)

    def select0(self, i: np.ndarray) -> np.ndarray:
        """Places of the i-th zeros."""
        word = np.searchsorted(self.zeros, i, side="right") - 1
        return word * 64 + _select_in_word(~self.high[word], i - self.zeros[word]).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        i = i.astype(np.int64)
        if len(i):
            lo = int(i.min())
            run = self._stretch(lo, int(i.max()) + 1, len(i))
            if run is not None:
                return run[i - lo]
        return ((self.select(i) - i).astype(np.uint64) << np.uint64(self.bits)) | self.lows(i)

    def _stretch(self, lo: int, hi: int, asked: int) -> np.ndarray | None:
        """The numbers from the lo-th to before the hi-th, unless they are too many for what is asked."""
        if not lo < hi or hi - lo > STRETCH * asked:
            return None
        first, last = (self.select(np.asarray([lo, hi - 1])) >> 6).tolist()
        if (last - first) * 64 > STRETCH * asked:
            return None
        ones = np.flatnonzero(np.unpackbits(self.high[first : last + 1].view(np.uint8), bitorder="little"))
        skip = lo - int(self.ones[first])
        i = np.arange(lo, hi, dtype=np.int64)
        return ((ones[skip : skip + hi - lo] + first * 64 - i).astype(np.uint64) << np.uint64(self.bits)) | self.lows(i)

    def find(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first number >= v (n if none), and whether it equals v."""
        if not self.n:
            return np.zeros(len(v), dtype=np.int64), np.zeros(len(v), dtype=bool)
        v = v.astype(np.uint64)
        if len(v) > 2:
            (lo, hi), _ = self.find(np.asarray([v.min(), v.max()]))
            run = self._stretch(int(lo), min(int(hi) + 1, self.n), len(v))
            if run is not None:
                at = np.searchsorted(run, v)
                return at + lo, run[np.minimum(at, len(run) - 1)] == v
        part = (v >> np.uint64(self.bits)).astype(np.int64)
        most = int(self.select(np.asarray([self.n - 1]))[0]) - (self.n - 1)
        inside = part <= most
        h = np.where(inside, part, 0)
        lo = np.where(h > 0, self.select0(np.maximum(h - 1, 0)) + 1 - h, 0)
        hi = np.where(h < most, self.select0(np.minimum(h, most)) - h, self.n)
        want = v & np.uint64((1 << self.bits) - 1)
        a, b = lo.copy(), hi.copy()
        todo = np.flatnonzero(a < b)
        while len(todo):
            mid = (a[todo] + b[todo]) // 2
            less = self.lows(mid) < want[todo]
            a[todo] = np.where(less, mid + 1, a[todo])
            b[todo] = np.where(less, b[todo], mid)
            todo = todo[a[todo] < b[todo]]
        at = np.where(inside, a, self.n)
        hit = inside & (a < hi)
        hit[hit] = self.lows(a[hit]) == want[hit]
        return at, hit


class Trie:
    """Three levels of nodes; codes: quantised probabilities of pairs and triples, back-off weights of pairs."""

    LEVELS = ("words", "begin2", "level2", "begin3", "level3")

    def __init__(self, sequences: dict[str, EliasFano], codes: dict[str, np.ndarray]) -> None:
        self.__dict__.update(sequences)
        self.sequences, self.codes = sequences, codes

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, pair: np.ndarray, c: np.ndarray, p2: np.ndarray, backoff3: np.ndarray, p3: np.ndarray) -> Trie:
        """Pairs (a, b) in order, triples as numbers of pairs and words c in order; p2 and backoff3 by pair, p3 by triple."""
        words = np.unique(np.concatenate([a, b, c]))
        at = lambda x: np.searchsorted(words, x)
        return cls.build_at(words, at(a), at(b), pair, at(c), p2, backoff3, p3)

    @classmethod
    def build_at(cls, words: np.ndarray, a: np.ndarray, b: np.ndarray, pair: np.ndarray, c: np.ndarray, p2: np.ndarray, backoff3: np.ndarray, p3: np.ndarray) -> Trie:
        """The same with a, b, c as places among the words, which are in order and all occur."""
        begin = lambda node, n: EliasFano.build(np.append(0, np.cumsum(np.bincount(node, minlength=n))))
        sequences = {"words": EliasFano.build(words), "begin2": begin(a, len(words)), "level2": EliasFano.build(_raised(b, a)), "begin3": begin(pair, len(a)), "level3": EliasFano.build(_raised(c, pair))}
        return cls(sequences, {"p2": quantise(p2), "backoff3": quantise(backoff3), "p3": quantise(p3)})

    def to_bytes(self) -> bytes:
        arrays = [x for k in self.LEVELS for x in self.sequences[k].arrays()] + [self.codes[k] for k in ("p2", "backoff3", "p3")]
        head = np.asarray([[len(x), x.itemsize] for x in arrays], dtype=np.int64)
        pad = lambda x: x.tobytes() + b"\0" * (-x.nbytes % 8)
        return head.tobytes() + b"".join(map(pad, arrays))

    @classmethod
    def from_buffer(cls, raw: np.ndarray) -> Trie:
        """Views of bytes, which may be a memory map; nothing is copied."""
        n = 4 * len(cls.LEVELS) + 3
        raw = np.asarray(raw)
        head = raw[: 16 * n].view(np.int64).reshape(n, 2)
        at, arrays = 16 * n, []
        for i, (length, size) in enumerate(head.tolist()):
            kind = np.uint16 if size == 2 else np.int64 if i % 4 in (0, 3) else np.uint64
            arrays.append(raw[at : at + length * size].view(kind))
            at += length * size + -length * size % 8
        return cls({k: EliasFano.of(*arrays[4 * i : 4 * i + 4]) for i, k in enumerate(cls.LEVELS)}, dict(zip(("p2", "backoff3", "p3"), arrays[-3:], strict=True)))

    def _child(self, level: EliasFano, begin: EliasFano, node: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Child of each node by the number of its word. A run of equal nodes looks its context up once."""
        new = np.append(True, node[1:] != node[:-1]) if len(node) else np.zeros(0, dtype=bool)
        run, heads = np.cumsum(new) - 1, node[new]
        lo, hi = begin.access(heads).astype(np.int64), begin.access(heads + 1).astype(np.int64)
        some = lo < hi
        base = np.zeros(len(heads), dtype=np.uint64)
        later = some & (lo > 0)
        base[later] = level.access(lo[later] - 1)
        lo, hi, some, base = lo[run], hi[run], some[run], base[run]
        at, hit = level.find(base + word.astype(np.uint64) + np.uint64(1))
        ok = hit & some & (at >= lo) & (at < hi)
        return np.where(ok, at, 0), ok

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of pairs of words, and whether they exist. Each distinct word is looked up once."""
        ua, ia = np.unique(a, return_inverse=True)
        ub, ib = np.unique(b, return_inverse=True)
        (wa, ha), (wb, hb) = self.words.find(ua), self.words.find(ub)
        return self.pairs_at(wa[ia], wb[ib], ha[ia] & hb[ib])

    def pairs_at(self, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words by their nodes, where both are known."""
        return self._known(self.level2, self.begin2, a, b, known)

    def triples(self, pair: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of triples, given the nodes of their first two words."""
        uc, ic = np.unique(c, return_inverse=True)
        wc, hc = self.words.find(uc)
        return self.triples_at(pair, wc[ic], hc[ic])

    def triples_at(self, pair: np.ndarray, c: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for last words by their nodes, where they are known."""
        return self._known(self.level3, self.begin3, pair, c, known)

    def _known(self, level: EliasFano, begin: EliasFano, node: np.ndarray, word: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, ok = np.zeros(len(node), dtype=np.int64), np.zeros(len(node), dtype=bool)
        some = np.flatnonzero(known)
        out[some], ok[some] = self._child(level, begin, node[some], word[some])
        return out, ok


def _raised(child: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Children's numbers plus one, raised by the last raised number of the parents before."""
    child = child.astype(np.uint64) + np.uint64(1)
    if not len(child):
        return child
    last = np.append(parent[1:] != parent[:-1], True)
    steps = np.where(last, child, np.uint64(0))
    before = np.cumsum(steps) - steps
    # Within a parent the base is the sum of the last children of all parents before.
    start = np.append(True, last[:-1])
    return child + before[np.maximum.accumulate(np.where(start, np.arange(len(child)), 0))]
