"""N-gram Jaccard join by chosen paths.

A text's set holds the hashes of its shingles of five words. In each run a set follows a tree of chosen paths: at a node
it chooses each of its tokens with probability 1 / (threshold * size), by a hash of node and token alone, so that similar
sets choose shared tokens; each chosen token leads to a child. Sets that meet in a node of at most SMALL sets are compared
by brute force, larger nodes are split further; nodes that are still large after DEPTH levels (groups of near copies share
nearly all tokens) are compared by brute force too, in pairs of blocks. A run misses a pair at the threshold with
probability 0.33 where the pair's buckets are small at the root, and 0.50, 0.59 and 0.66 where they are split at 1, 2 and
3 more levels. RUNS is set by the last: 1 - 0.66^15 is 0.998; a more similar pair, or one split less, is found more surely.

At the root tokens are the set's own. Below it, and where sets are compared, a set is stood for by a sketch of SAMPLES
min-hashes of a byte each, as tokens (position, value): that is all that travels. Sketches agree in a share of places near
the sets' similarity; pairs that agree in LIKELY of them, far below the threshold, are linked provisionally (a pair at the
threshold fails that with a probability below 10^-6). Components of these links are groups; only their sets' tokens are
then fetched, all pairs within a group are compared exactly, in pairs of blocks, and groups are made anew of the links
that hold.

Texts with equal sets are one node; copies are never compared or expanded. Within a bucket only a spanning forest of
links is emitted. The number of links is summed over block pairs.

Cases: words are runs of non-white-space, A-Z lower-cased. A text of one to four words has one shingle, all of it. Null
and empty texts and texts without a word have the empty set: they are copies of each other. Rows with equal doc_id are
rows of their own. A null doc_id is least preferred as class id; a class of null ids has a null id. An empty table gives no
rows. A very long text is one set, hashed whole; sets are handled SLICE_WORDS at a time, or one alone. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, lean, parts, released, staged
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
RUNS, DEPTH, SMALL, BLOCK = 15, 4, 64, 256
#: Min-hashes of a sketch, and the share that must agree for a provisional link.
SAMPLES, LIKELY = 64, 0.55
#: Low bits of a node's number that hold its run.
RUN_BITS = 15
#: Bits of the filter that tells which texts' tokens are wanted: its size doesn't grow with the input, it only lets more pass.
FILTER_BITS = 1 << 26
#: Words that are handled at once, and whose hashes a task remembers at most.
SLICE_WORDS, MOST_HASHES = 500_000, 250_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[str], ids: dict[bytes, int]) -> Iterator[np.ndarray]:
    """Sorted distinct 32-bit hashes of each text's shingles. ids: a cache of word hashes."""
    import xxhash

    for text in texts:
        words = text.encode().translate(LOWER).split()
        if len(ids) > MOST_HASHES:
            ids.clear()
        h = np.empty(len(words), dtype=np.uint64)
        for i, w in enumerate(words):
            v = ids.get(w)
            if v is None:
                v = ids[w] = xxhash.xxh3_64_intdigest(w)
            h[i] = v
        n = max(min(1, len(h)), len(h) - SHINGLE + 1)
        out = np.zeros(n, dtype=np.uint64)
        for j in range(min(SHINGLE, len(h))):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        yield np.unique(_mix(out) >> np.uint64(32)).astype(np.uint32)


def _chosen(tokens: np.ndarray, size: np.ndarray, node: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens that their sets choose at their nodes, and the children they lead to."""
    h = _mix(tokens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ node)
    at = np.flatnonzero((h >> np.uint64(11)).astype(np.float64) * 2.0**-53 < 1 / (threshold * size))
    return at, (_mix(h[at] ^ np.uint64(0xA0761D6478BD642F)) & ~np.uint64(RUN_BITS)) | (node[at] & np.uint64(RUN_BITS))


_ODD = _mix(np.arange(101, 101 + SAMPLES, dtype=np.uint64)) | np.uint64(1)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """SAMPLES min-hashes of a set, the last byte of a mix of each."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(tokens), 4096):
        h = _mix(tokens[at : at + 4096].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))[:, None] * _ODD
        np.minimum(least, h.min(axis=0), out=least)
    return (_mix(least) & np.uint64(255)).astype(np.uint8)


def sets(docs: DataFrame, doc_id: str, text: str, threshold: float, runs: int) -> DataFrame:
    """doc_id, text_md5, key (md5 of the set), sketch, and paths: the children chosen at the root of every run."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text_md5"))
    roots = (_mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) & ~np.uint64(RUN_BITS)) | np.arange(runs, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[bytes, int] = {}

        def flush(got_ids: list, marks: list, got: list[np.ndarray]) -> pa.RecordBatch:
            size = np.asarray([len(x) for x in got])
            every = np.concatenate(got) if got else np.zeros(0, np.uint32)
            owner, each = np.repeat(np.arange(len(got)), size), np.repeat(size, size)
            at, to = [], []
            for root in roots:
                a, c = _chosen(every, each, np.full(len(every), root), threshold)
                at.append(owner[a])
                to.append(c)
            owners, to = np.concatenate(at), np.concatenate(to).view(np.int64)
            order = np.argsort(owners, kind="stable")
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(got)))]).astype(np.int32)
            paths = pa.ListArray.from_arrays(pa.array(offsets), pa.array(to[order]))
            return pa.RecordBatch.from_arrays([pa.array(got_ids, pa.int64()), pa.array(marks, pa.string()), pa.array([hashlib.md5(x.tobytes()).digest() for x in got], pa.binary()), pa.array([sketch(x).tobytes() for x in got], pa.binary()), paths], names=["doc_id", "text_md5", "key", "sketch", "paths"])

        for batch in batches:
            got_ids: list = []
            marks: list = []
            got: list[np.ndarray] = []
            size = 0
            for i, m, s in (x for some in parts(batch) for x in zip(some.column(0).to_pylist(), some.column(2).to_pylist(), shingle_sets(some.column(1).to_pylist(), ids), strict=True)):
                got_ids.append(i)
                marks.append(m)
                got.append(s)
                size += len(s)
                if size >= SLICE_WORDS:
                    yield flush(got_ids, marks, got)
                    got_ids, marks, got, size = [], [], [], 0
            if got:
                yield flush(got_ids, marks, got)

    return staged(rows.mapInArrow(lean(run), "doc_id long, text_md5 string, key binary, sketch binary, paths array<bigint>"), "sets")


def overlaps(x: list[np.ndarray], y: list[np.ndarray], threshold: float) -> np.ndarray:
    """Matrix of which sets of x are similar to which of y, exact on the tokens' hashes."""
    nx, ny = np.asarray([len(s) for s in x]), np.asarray([len(s) for s in y])
    if len(x) == 1 and len(y) == 1:
        if min(nx[0], ny[0]) < threshold * max(nx[0], ny[0]):
            return np.zeros((1, 1), dtype=bool)
        common = nx[0] + ny[0] - len(np.unique(np.concatenate([x[0], y[0]])))
        return np.asarray([[common >= threshold * (nx[0] + ny[0] - common)]])
    cx, cy = np.concatenate(x), np.concatenate(y)
    shared = np.intersect1d(cx, cy)
    common = np.zeros((len(x), len(y)), dtype=np.float32)
    # Only tokens on both sides count; incidence matrices by column slices keep memory bounded.
    ox, oy = np.repeat(np.arange(len(x)), nx), np.repeat(np.arange(len(y)), ny)
    px, py = np.searchsorted(shared, cx), np.searchsorted(shared, cy)
    kx = (px < len(shared)) & (shared[np.minimum(px, max(len(shared) - 1, 0))] == cx) if len(shared) else np.zeros(len(cx), bool)
    ky = (py < len(shared)) & (shared[np.minimum(py, max(len(shared) - 1, 0))] == cy) if len(shared) else np.zeros(len(cy), bool)
    ox, px, oy, py = ox[kx], px[kx], oy[ky], py[ky]
    order_x, order_y = np.argsort(px, kind="stable"), np.argsort(py, kind="stable")
    ox, px, oy, py = ox[order_x], px[order_x], oy[order_y], py[order_y]
    step = 8192
    for lo in range(0, len(shared), step):
        a, b = np.searchsorted(px, [lo, lo + step])
        c, d = np.searchsorted(py, [lo, lo + step])
        mx, my = np.zeros((len(x), step), dtype=np.float32), np.zeros((len(y), step), dtype=np.float32)
        mx[ox[a:b], px[a:b] - lo] = 1
        my[oy[c:d], py[c:d] - lo] = 1
        common += mx @ my.T
    union = nx[:, None] + ny[None, :] - common
    return (common >= threshold * union - 1e-6) & (union > 0)


def _forest(similar: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric or bipartite relation between numbers."""
    up = list(range(len(similar)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for i, j in zip(*np.nonzero(np.triu(similar, 1)), strict=True):
        a, b = root(int(i)), root(int(j))
        if a != b:
            up[b] = a
            out.append((int(i), int(j)))
    return out


def _tokens(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint32)


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of sorted batches by key; a group is a bucket or two blocks, so it is small."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            k = tuple(row[x] for x in keys)
            if k != key and rows:
                yield key, rows
                rows = []
            key = k
            rows.append(row)
    if rows:
        yield key, rows


def agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Matrix of which sketches of x agree with which of y in LIKELY of their places."""
    same = np.zeros((len(x), len(y)), dtype=np.int16)
    for k in range(SAMPLES):
        same += x[:, k, None] == y[None, :, k]
    return same >= LIKELY * SAMPLES


def _sketches(rows: list[dict]) -> np.ndarray:
    return np.frombuffer(b"".join(r["sketch"] for r in rows), dtype=np.uint8).reshape(-1, SAMPLES)


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _small_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a: list[int] = []
    b: list[int] = []
    for _, rows in _grouped(batches, ["path"]):
        own = _sketches(rows)
        for i, j in _forest(agree(own, own)):
            a.append(rows[i]["node"])
            b.append(rows[j]["node"])
        if len(a) > 10_000:
            yield _pairs(a, b)
            a, b = [], []
    yield _pairs(a, b)


def _dense_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _grouped(batches, ["bucket", "i", "j"]):
        left, right = [r for r in rows if r["side"] == 0], [r for r in rows if r["side"] == 1]
        own = _sketches(rows)
        same = rows[0]["i"] == rows[0]["j"]
        similar = agree(own, own) if same else _bipartite(agree(own[: len(left)], own[len(left) :]))  # rows come sorted by side
        both = left + right
        links = _forest(similar)
        yield _pairs([both[i]["node"] for i, _ in links], [both[j]["node"] for _, j in links])


def _bipartite(similar: np.ndarray) -> np.ndarray:
    """The relation over both sides' members as one matrix."""
    m, n = similar.shape
    both = np.zeros((m + n, m + n), dtype=bool)
    both[:m, m:] = similar
    return both


def _block_pairs(rows: list[dict], threshold: float) -> tuple[list[dict], list[dict], np.ndarray]:
    left, right = [r for r in rows if r["side"] == 0], [r for r in rows if r["side"] == 1]
    if rows[0]["i"] == rows[0]["j"]:
        similar = overlaps(x := [_tokens(r["tokens"]) for r in left], x, threshold)
        np.fill_diagonal(similar, False)
        return left, left, similar
    if not left or not right:  # the other block has no member
        return left, right, np.zeros((len(left), len(right)), dtype=bool)
    return left, right, overlaps([_tokens(r["tokens"]) for r in left], [_tokens(r["tokens"]) for r in right], threshold)


def _exact(threshold: float):
    """Of a pair of blocks: (a, b) of a spanning forest of links, and (a, links) with b null: the copies that a is linked to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, ["bucket", "i", "j"]):
            left, right, similar = _block_pairs(rows, threshold)
            node, n = [r["node"] for r in left], similar @ np.asarray([r["copies"] for r in right], dtype=np.int64)
            links = _forest(similar) if left is right else _forest(_bipartite(similar))
            if left is not right:
                node = node + [r["node"] for r in right]
                n = np.concatenate([n, similar.T @ np.asarray([r["copies"] for r in left], dtype=np.int64)])
            a = [node[i] for i, _ in links] + node
            b = [node[j] for _, j in links] + [None] * len(node)
            counts = [None] * len(links) + n.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(counts, pa.int64())], names=["a", "b", "links"])

    return run


def _in_blocks(members: DataFrame) -> DataFrame:
    """bucket, node and what else members has, once for each pair of blocks (i <= j) that the node's block is in.

    A bucket's nodes are dealt to blocks of about BLOCK by hash; side says which of the two a row is of.
    """
    size = members.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = members.join(size, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("*", other.alias("other"))
    pairs = rows.select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    return pairs.drop("own", "other", "blocks")


def _sorted(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *(["side"] if "side" in df.columns else []), "node")


def _children(threshold: float):
    """Children that sets choose by their sketches: tokens are (position, value), SAMPLES of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.asarray([SAMPLES])
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                held = part.column(2).to_pylist()
                tokens = np.frombuffer(b"".join(held), dtype=np.uint8).reshape(-1, SAMPLES).astype(np.uint64) + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(256)
                at, to = _chosen(tokens.reshape(-1), size, np.repeat(part.column(1).to_numpy().view(np.uint64), SAMPLES), threshold)
                rows = at // SAMPLES
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(to.view(np.int64)), part.column(2).take(pa.array(rows))], names=["node", "path", "sketch"])

    return run


def _filter_places(md5: Column) -> list[Column]:
    """Two places of a text in the filter, from its md5."""
    return [F.conv(F.substring(md5, at, 12), 16, 10).cast("long") % FILTER_BITS for at in (1, 13)]


def tokens_of(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """node, root, copies, tokens of the wanted classes, by the text that stands for each: texts are scanned again and a bit filter lets through about those alone."""
    places = wanted.select(F.explode(F.array(*_filter_places(F.col("text_md5")))).alias("at"))
    parts = places.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8 + 8192, dtype=np.uint8)
    for r in parts:
        # Buckets count from 1 for positive numbers; a number's bit lies at (number - 1) within the run of buckets.
        at = (r["part"] - 1) * 4096 if r["part"] > 0 else 0
        bits[at : at + 4096] |= np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids = shared.value, {}
        for batch in batches:
            ok = np.ones(batch.num_rows, dtype=bool)
            for k in (2, 3):
                at = batch.column(k).to_numpy().astype(np.int64) - 1
                at = np.where(at < 0, 0, at)
                ok &= (held[at >> 3] >> (at & 7)) & 1 == 1
            kept = batch.filter(pa.array(ok))
            for lo in range(0, kept.num_rows, 500):
                part = kept.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([s.tobytes() for s in shingle_sets(part.column(0).to_pylist(), ids)], pa.binary())], names=["text_md5", "tokens"])

    plain = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(plain.alias("text"), F.md5(plain).alias("text_md5")).select("text", "text_md5", *[p.alias(f"p{i}") for i, p in enumerate(_filter_places(F.col("text_md5")))])
    return staged(found.mapInArrow(lean(run), "text_md5 string, tokens binary").join(wanted, "text_md5").select("node", "root", "copies", "tokens").dropDuplicates(["node"]), "tokens")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, runs: int = RUNS) -> DataFrame:
    """doc_id, text_md5, key (of its set), copy_id (least id with an equal set), class_id (least id of its group), links (other documents at least that similar), one row per document."""
    if runs > RUN_BITS + 1:
        raise ValueError(f"at most {RUN_BITS + 1} runs")
    every = sets(docs, doc_id, text, threshold, runs)
    grouped = every.groupBy("key").agg(F.min("doc_id").alias("copy_id"), F.min("text_md5").alias("text_md5"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths"))
    classes = staged(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    level = classes.select("node", F.explode("paths").alias("path")).distinct()
    sizes = staged(level.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    met = staged(level.join(sizes, "path").join(classes.select("node", "sketch"), "node"), "met")
    links, dense = _sorted(met.where(F.col("n") <= SMALL), "path").mapInArrow(lean(_small_links), "a long, b long"), met.where(F.col("n") > SMALL)
    for _ in range(DEPTH - 1):
        if dense.isEmpty():
            break
        level = staged(dense.select("node", "path", "sketch").mapInArrow(lean(_children(threshold)), "node long, path long, sketch binary").dropDuplicates(["node", "path"]), "level")
        sizes = staged(level.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
        met = staged(level.join(sizes, "path"), "met")
        links, dense = links.union(_sorted(met.where(F.col("n") <= SMALL), "path").mapInArrow(lean(_small_links), "a long, b long")), met.where(F.col("n") > SMALL)
    heavy = _in_blocks(dense.select(F.col("path").alias("bucket"), "node", "sketch"))
    links = links.union(_sorted(heavy, "bucket", "i", "j").mapInArrow(lean(_dense_links), "a long, b long"))
    likely = staged(components(links), "likely")
    released(met)
    # Exact comparison of all pairs within these groups, in blocks: links, and their numbers.
    tokens = tokens_of(docs, classes.join(likely, "node").select("node", "root", "copies", "text_md5"), text)
    inside = _in_blocks(tokens.select(F.col("root").alias("bucket"), "node", "copies", "tokens"))
    exact = staged(_sorted(inside, "bucket", "i", "j").mapInArrow(lean(_exact(threshold)), "a long, b long, links long"), "exact")
    released(tokens, likely)
    roots = staged(components(exact.where("b IS NOT NULL").select("a", "b")), "roots")
    counted = exact.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    facts = classes.select("key", "node", "copy_id", "copies").join(roots, "node", "left").join(counted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = facts.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    facts = facts.join(least, "root").select("key", "copy_id", "class_id", F.col("root").alias("group_key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return every.select("doc_id", "text_md5", "key").join(facts, "key")


def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but one document of each group: the one of the least id (null last), then of the least md5 of its text.

    Of rows that agree in id and text but not in other columns the one whose JSON has the least md5 stays.
    """
    rows = staged(join(docs, doc_id, text), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_md5").alias("md5")))
    kept = rows.groupBy("group_key").agg(first.alias("kept")).select("kept.id", "kept.md5")
    # Rows that agree in id and text are of one group: where such a row is kept, one of them is.
    repeated = rows.groupBy("doc_id", "text_md5").agg(F.count("*").alias("times")).where("times > 1")
    kept = staged(kept.join(repeated, kept["id"].eqNullSafe(repeated["doc_id"]) & (kept["md5"] == repeated["text_md5"]), "left").select("id", "md5", F.coalesce("times", F.lit(1)).alias("times")), "kept")
    released(rows)
    same = docs[doc_id].cast("long").eqNullSafe(kept["id"]) & (F.md5(F.coalesce(docs[text], F.lit(""))) == kept["md5"])
    once = docs.join(kept.where("times = 1"), same, "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    several = docs.join(kept.where("times > 1"), same, "left_semi")
    one = several.groupBy(F.col(doc_id), F.md5(F.coalesce(F.col(text), F.lit("")))).agg(F.min_by(row, F.md5(F.to_json(row))).alias("__row"))
    return once.unionByName(one.select("__row.*"))
