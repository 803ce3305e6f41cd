"""Document fingerprints by consistent weighted sampling.

Terms are a text's words (runs of non-white-space, A-Z lower-cased), weights are their counts. For each of K samples a
term draws r, c ~ Gamma(2, 1) and b ~ U(0, 1), all functions of the term and the sample alone; with weight w,
t = floor(ln w / r + b) and the term's value is ln c - r (t - b + 1). The term with the least value and its t are the
sample. Two texts agree on a sample with the probability of their generalised Jaccard similarity, sum of minimal over
sum of maximal weights, so the share of equal samples estimates it.

Cases: null text is empty; texts without a word share one fingerprint of their own, with likeness 1 to each other and 0
to others. Rows with equal doc_id are ordered by text, descending too; a null doc_id comes last. A lone document is its
own next document. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER

#: Samples of a fingerprint; each is four hexadecimal digits.
SAMPLES = 64
#: Steps of the quantile tables of the distributions.
STEPS = 1 << 16
#: Characters of text that one bucket of neighbouring ids holds, about.
BUCKET_CHARS = 4_000_000
#: Buckets at most: each is read as a stream, so that its size bounds no memory.
MOST_BUCKETS = 2000
#: Terms whose draws are made at once, and words whose hashes a task remembers at most.
BLOCK, MOST_HASHES = 8192, 250_000


def _gamma_quantiles() -> np.ndarray:
    """Gamma(2, 1) at the midpoints of STEPS equal slices, from its distribution 1 - (1 + x) exp(-x) by bisection."""
    p = (np.arange(STEPS) + 0.5) / STEPS
    lo, hi = np.zeros(STEPS), np.full(STEPS, 60.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


class Sampler:
    """Signatures of term counts."""

    def __init__(self, samples: int = SAMPLES, seed: int = 1) -> None:
        self.samples = samples
        q = _gamma_quantiles()
        self.r, self.ln_c = q.astype(np.float32), np.log(q).astype(np.float32)
        rng = np.random.default_rng(seed)
        self.salt = rng.integers(1, 2**63, size=samples, dtype=np.uint64) | np.uint64(1)

    def draws(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """r, ln c and b for every term and sample."""
        h = terms[:, None] * self.salt[None, :]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(28)
        low = np.uint64(STEPS - 1)
        r = self.r[(h & low).astype(np.intp)]
        ln_c = self.ln_c[((h >> np.uint64(16)) & low).astype(np.intp)]
        b = (h >> np.uint64(32)).astype(np.float32) * np.float32(2.0**-32)
        return r, ln_c, b

    @staticmethod
    def values(weight: np.ndarray, r: np.ndarray, ln_c: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = np.floor(np.log(weight.astype(np.float32))[:, None] / r + b)
        return ln_c - r * (t - b + 1), t

    def signatures(self, terms: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
        """One signature for each of several weightings of the same distinct terms; weight 0 is absence."""
        best = [np.full(self.samples, np.inf, dtype=np.float32) for _ in weights]
        mark = [np.zeros(self.samples, dtype=np.uint64) for _ in weights]
        cols = np.arange(self.samples)
        for at in range(0, len(terms), BLOCK):
            part = terms[at : at + BLOCK]
            r, ln_c, b = self.draws(part)
            for n, weight in enumerate(weights):
                w = weight[at : at + BLOCK]
                have = np.flatnonzero(w)
                if not len(have):
                    continue
                full = len(have) == len(part)
                v, t = self.values(w if full else w[have], *((r, ln_c, b) if full else (r[have], ln_c[have], b[have])))
                i = np.argmin(v, axis=0)
                value = v[i, cols]
                m = (part[have[i]] ^ (t[i, cols].astype(np.int64).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
                less = value < best[n]
                best[n] = np.where(less, value, best[n])
                mark[n] = np.where(less, m >> np.uint64(48), mark[n])
        return [m.astype(np.uint16) if len(terms) and np.isfinite(v).all() else np.zeros(0, np.uint16) for m, v in zip(mark, best, strict=True)]

    def text(self, signature: np.ndarray) -> str:
        """Four hexadecimal digits for each sample; `empty` for a text without words."""
        return signature.astype(">u2").tobytes().hex() if len(signature) else "empty"


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float(np.mean(a == b))


def term_counts(text: str, ids: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of a text as 64-bit hashes, with counts. ids: a cache of hashes."""
    import xxhash

    words = text.encode().translate(LOWER).split()
    if len(ids) > MOST_HASHES:
        ids.clear()
    out = np.empty(len(words), dtype=np.uint64)
    for i, w in enumerate(words):
        h = ids.get(w)
        if h is None:
            h = ids[w] = xxhash.xxh3_64_intdigest(w)
        out[i] = h
    return np.unique(out, return_counts=True)


def edited(text: str, following: str) -> str:
    """The last half of text, rounded down, replaced by as many leading code points of following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, bucket, place and tail: rows in descending order of id within buckets; a bucket ends with a copy of the next one's first row.

    Buckets are ranges of ids with about BUCKET_CHARS characters; the driver sees only their bounds and numbers.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(MOST_BUCKETS, int(chars // BUCKET_CHARS) + 1)
    bounds = sorted(set(rows.approxQuantile("doc_id", [i / n for i in range(1, n)], min(0.01, 0.2 / n)))) if n > 1 else []
    cuts = F.array(*[F.lit(int(b)) for b in reversed(bounds)]).cast("array<bigint>")
    rows = rows.withColumn("bucket", F.coalesce(F.size(F.filter(cuts, lambda c: F.col("doc_id") < c)), F.lit(len(bounds))) if bounds else F.lit(0))
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(F.col("bucket")))
    firsts = rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "text")).alias("first"))
    filled = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())
    if not filled:
        return rows.withColumn("tail", F.lit(False))
    before = F.create_map(*[F.lit(x) for at, b in enumerate(filled) for x in (b, filled[at - 1])])
    tails = firsts.select("first.doc_id", "first.text", before[F.col("bucket")].alias("bucket"), F.lit(True).alias("tail"))
    return rows.withColumn("tail", F.lit(False)).unionByName(tails)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; one row per row of docs."""
    rows = neighbours(docs, doc_id, text)
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, rows.select("bucket").distinct().count())
    ordered = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, ids = Sampler(samples), {}
        last: tuple | None = None  # id, text, bucket, signature
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for i, t, bucket, tail in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "bucket", "tail")), strict=True):
                terms, counts = term_counts(t, ids)
                if last is None or last[2] != bucket:
                    last = (i, t, bucket, sampler.signatures(terms, [counts])[0])
                    continue
                # `last` has a next document now: this row.
                changed = edited(last[1], t)
                more, more_counts = term_counts(changed, ids)
                both = np.union1d(terms, more)
                weight = np.zeros((2, len(both)), dtype=np.int64)
                weight[0, np.searchsorted(both, terms)] = counts
                weight[1, np.searchsorted(both, more)] = more_counts
                own, other = sampler.signatures(both, [weight[0], weight[1]])
                for k, v in enumerate((last[0], len(last[1]), hashlib.sha256(changed.encode()).hexdigest(), sampler.text(last[3]), sampler.text(other), likeness(last[3], other), likeness(last[3], own))):
                    out[k].append(v)
                last = None if tail else (i, t, bucket, own)
            yield pa.RecordBatch.from_arrays([pa.array(v, ty) for v, ty in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return ordered.mapInArrow(run, schema)
