"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained from a small labelled table: hosts made of pairs of words of either kind with paths that go with the
kind, or with both. N-grams of a whole batch are hashed at once.

Cases: a null url, or one without `://`, has an empty host and path and is judged by the model like any other. Ties of
rules don't arise: of the rules that fit a host, two of equal length are equal. Repeated rows are judged alike. An empty
table gives no rows. All n-grams of a very long url count. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (action, host + path) of the rules.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

#: Weights of the model; n-gram lengths.
DIMENSIONS, GRAMS = 1 << 16, (3, 4, 5)
#: Rows of the labelled table at most.
MOST_LABELLED = 10_000
PASSES, RATE, DECAY = 600, 4.0, 1e-4

#: The labelled table that the model is trained from unless another is given: words of hosts of both kinds, and paths for each kind and for both.
BLOCK_WORDS = "casino poker betting bets jackpot slots bonus free cheap winner porn adult xxx dating escort pills viagra pharmacy discount spam malware phishing warez crack keygen torrent clicks banner tracker".split()
ALLOW_WORDS = "news library school garden weather science history museum recipe travel code math health music film birds train council river language theatre winter station orchard lighthouse stone north earth harbour market thread other thing heron tower".split()
BLOCK_PATHS = ["/win-big-bonus", "/free-spins/join", "/click?id=", "/cams/live-girls", "/buy-cheap-pills", "/login/verify-account", "/download/crack.exe", "/ads/banner/300x250"]
ALLOW_PATHS = ["/articles/2024/a-title", "/docs/guide.html", "/collection/items/41", "/about/contact", "/opening-hours", "/chapters/3/summary"]
EITHER_PATHS = ["/", "/index.html", "/search", "/en/12", "/de/7.html", "/fr/345/", "/es/9"]
ENDINGS = ["com", "org", "net", "info", "co.uk"]


def seed_table() -> list[tuple[str, str, int]]:
    """(host, path, blocked) of the built-in labelled table: word i of a kind with the words 1, 3 and 7 places on."""
    out = []
    for blocked, words, paths in ((1, BLOCK_WORDS, BLOCK_PATHS), (0, ALLOW_WORDS, ALLOW_PATHS)):
        for i, word in enumerate(words):
            for j, step in enumerate((1, 3, 7)):
                host = ("www." if (i + j) % 3 == 0 else "") + word + ("-" if (i + j) % 2 else "") + words[(i + step) % len(words)] + "." + ENDINGS[(i + 2 * j) % len(ENDINGS)]
                own = [paths[(i + 3 * j) % len(paths)], *[EITHER_PATHS[(i + 2 * j + k) % len(EITHER_PATHS)] for k in range(3)]]
                out += [(host, path, blocked) for path in own]
    return out


def features(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the url, hashed n-gram) of all distinct n-grams of each host and path, marked by where they come from."""
    n = len(hosts)
    parts = [f"^{x}$\n".encode() for x in (*hosts, *paths)]
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
    owner = np.repeat(np.arange(2 * n), [len(x) for x in parts])
    # No n-gram reaches beyond the mark that ends its part.
    left = np.repeat(np.cumsum([len(x) for x in parts]) - 1, [len(x) for x in parts]) - np.arange(len(raw)) if n else np.zeros(0, np.int64)
    found = []
    for size in GRAMS:
        h = np.full(len(raw), size, dtype=np.uint64) + np.uint64(97) * (owner >= n).astype(np.uint64)
        for k in range(size):
            h = (h ^ np.append(raw[k:], np.zeros(min(k, len(raw)), np.uint8))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        use = left >= size
        found.append((owner[use] % max(n, 1)).astype(np.int64) * DIMENSIONS + (h[use] % np.uint64(DIMENSIONS)).astype(np.int64))
    key = np.unique(np.concatenate(found))
    return key // DIMENSIONS, key % DIMENSIONS


def train(rows: Sequence[tuple[str, str, int]]) -> np.ndarray:
    """Weights, the last of which is the bias; gradient descent with decay on a small table, always the same way."""
    rows = list(rows)
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"at most {MOST_LABELLED} labelled rows")
    weights = np.zeros(DIMENSIONS + 1)
    if not rows:
        return weights
    owner, index = features([r[0] for r in rows], [r[1] for r in rows])
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(rows))))
    y = np.asarray([r[2] for r in rows], dtype=float)
    for _ in range(PASSES):
        z = np.bincount(owner, weights[index], minlength=len(rows)) * scale + weights[-1]
        gap = (1 / (1 + np.exp(-z)) - y) / len(rows)
        weights[:-1] -= RATE * (np.bincount(index, (gap * scale)[owner], minlength=DIMENSIONS) + DECAY * weights[:-1])
        weights[-1] -= RATE * gap.sum()
    return weights


def score(weights: np.ndarray, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
    """Probability of each url that it is to be blocked."""
    owner, index = features(hosts, paths)
    scale = np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(hosts))))
    return 1 / (1 + np.exp(-(np.bincount(owner, weights[index], minlength=len(hosts)) / scale + weights[-1])))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as host + path; else null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = rule.partition("/")
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(slash + p), F.lit(rule)).otherwise(out)
    return out


def judge(pages: DataFrame, weights: np.ndarray, rules: Sequence[tuple[str, str]] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and block_score of every row."""
    action = {rule: a for a, rule in rules}
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score(weights, batch.column(1).to_pylist(), batch.column(2).to_pylist()).tolist()
            verdict = [action[r] if r is not None else "block" if s >= 0.5 else "allow" for r, s in zip(batch.column(3).to_pylist(), scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(verdict, pa.string()), pa.array(scores, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "block_score"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string, block_score double")
