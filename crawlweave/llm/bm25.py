"""Exact top-k search by BM25 over an inverted index with block-max WAND pruning.

A shard is a block of documents with an inverted index: postings by term, their BM25 impacts, and the greatest impact of
each frequent term in every run of RUN documents. A shard's documents are ordered by likeness (a few rounds of k-means
over the frequent terms, then length), so that runs are alike and their maxima tight, and cut into parts of one kind and
about one length, each with frequent terms of its own: those of long texts, which most of the best are, are many. Document frequencies, the number of documents and
the mean length are those of the whole corpus, so that scores are comparable and the shards' best k merge exactly.

A query visits its own shard first; its k-th best score there is its first threshold. Then it visits shards at growing
distances, FACTOR times as many each round, with the k-th best score so far, which a task raises by what its own shards
have returned. In a shard the queries of a kind and size are scored together, part by part. The lists of terms that are rare in
a part are added up, and those of frequent terms that few of them have; a run's bound is the greatest of these sums in it
plus the maxima of the other frequent terms. Runs whose bound is below the threshold are skipped whole, by batches of queries that need about equally
many; the documents of the others are scored by a product of matrices in single precision, and those that may reach the
threshold again in double precision. Bounds and margins are never below the score, so nothing is lost. A shard returns only
what reaches the threshold: about k times FACTOR rows a query and round at most, whatever the number of shards.

score = sum over the query's distinct terms of tf_query * idf * impact, idf = ln(1 + (N - df + 0.5) / (df + 0.5)),
impact = tf (K1 + 1) / (tf + K1 (1 - B + B len / mean)), rounded to six places; ties go to the smaller doc_id.

Queries go to shards in groups of bounded size, by broadcast: a group is a run of shards whose queries have GROUP_BYTES or
GROUP_QUERIES at most, or one shard, whose queries are no larger than its text. Nothing else is sent to all shards, and
the index is never shuffled. All queries are compared with all shards, so the work is queries times shards times what a
shard cannot skip.

Cases: words are runs of non-white-space, A-Z lower-cased. Null and empty texts have no terms: they are in no result and
have none as queries. Documents that share no term with a query are not in its result, which may be shorter than k. Rows
that repeat are searched and found each; a null doc_id is never a query and comes last among ties. An empty table gives no
rows. A very long text is a shard of its own. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import encode, numbered, pack, unpack, vocabulary
from .common import released, shared_dir, staged

K1, B, TOP = 1.2, 0.75, 10
#: Bytes of text of a shard, documents of a run, about.
SHARD_BYTES, RUN = 32_000_000, 64
#: Bytes and number of the queries that are sent to shards at once.
GROUP_BYTES, GROUP_QUERIES = 48_000_000, 16_384
#: How many times as many shards are visited each round; queries scored at once.
FACTOR, BATCH = 4, 128
#: Queries, and cells of queries by documents, whose sums of lists are held at once; postings that are added up at once;
#: terms of queries of a kind and size that are looked at together.
KNOWN, CELLS, POSTINGS, ENTRIES = 512, 5_000_000, 50_000, 500_000
#: A posting of a list costs so many times a cell of the product of matrices.
LIST_COST = 400
#: Words of documents, and terms of queries, where a class of lengths ends. Documents of a part at least, if its kind has as many.
CLASSES, QUERY_CLASSES, PART = (600, 2400), (160, 640), 128
#: So many runs that no query needs are scored with their neighbours.
BRIDGE = 4
#: Rows of the vocabulary's shards, about.
VOCABULARY_TOKENS = 2_000_000
#: A term is frequent in a part, or a shard, if this share of its documents has it. Kinds of documents that are told apart, and rounds.
FREQUENT, KINDS, ROUNDS = 1 / 16, 8, 3
#: Places that scores are rounded to; what single precision may be wrong by, as a share of the largest possible score.
PLACES, MARGIN, SINGLE = 6, 1e-5, 4e-5


def _document_counts(tokens: np.ndarray, lengths: np.ndarray, marks: np.ndarray, words: int) -> np.ndarray:
    doc = np.repeat(np.arange(len(lengths)), lengths.astype(np.int64))
    return np.bincount(np.unique(doc * max(words, 1) + tokens) % max(words, 1), minlength=words) if words else np.zeros(0, np.int64)


def _postings(row: dict) -> tuple[np.ndarray, ...]:
    """Terms in order, their document frequencies, where their postings begin, and postings' documents and counts."""
    tokens, lengths = unpack(row["tokens"])[0].astype(np.int64), unpack(row["lengths"])[0].astype(np.int64)
    number, df = (x.astype(np.int64) for x in unpack(row["numbers"]))
    order = np.argsort(number)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    n = max(len(lengths), 1)
    key, tf = np.unique(rank[tokens] * n + np.repeat(np.arange(len(lengths)), lengths), return_counts=True)
    begins = np.searchsorted(key // n, np.arange(len(order) + 1))
    return number[order], df[order], begins, key % n, tf


PARTS = "kind string, shard long, doc_ids array<bigint>, body binary, likeness binary, queries long"


def _dense(terms: np.ndarray, begins: np.ndarray, docs: np.ndarray, values: np.ndarray, n: int, kind: type) -> np.ndarray:
    """Values of some terms' postings as a matrix of terms by documents."""
    out = np.zeros((len(terms), n), dtype=kind)
    for i, t in enumerate(terms.tolist()):
        out[i, docs[begins[t] : begins[t + 1]]] = values[begins[t] : begins[t + 1]]
    return out


def _frequent(counts: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(counts > max(FREQUENT * n, 8))


def _split(mean: float):
    """Of every block its index with documents in order of likeness, the kind and place that each had, and its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                terms, df, begins, docs, tf = _postings(row)
                lengths = unpack(row["lengths"])[0]
                impact = tf * (K1 + 1) / (tf + _norm(lengths, mean)[docs])
                place, kind = _by_likeness(_dense(_frequent(np.diff(begins), len(lengths)), begins, docs, impact, len(lengths), np.float32).T, lengths)
                index = pack(lengths[place], terms, np.diff(begins), *_renumbered(place, np.diff(begins), docs, tf))
                likeness = pack(np.arange(len(place)), kind, place)
                chosen = np.flatnonzero(np.asarray(row["marks"]) == 1)
                # The postings again by document, of the queries alone.
                of_term = np.repeat(np.arange(len(terms)), np.diff(begins))
                mine = np.flatnonzero(np.isin(docs, chosen))
                mine = mine[np.argsort(docs[mine], kind="stable")]
                sizes = np.bincount(docs[mine], minlength=len(row["doc_ids"]))[chosen]
                asked = pack(chosen, sizes, terms[of_term[mine]], df[of_term[mine]], tf[mine])
                ids = [[row["doc_ids"][i] for i in where] for where in (place, chosen)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["index", "queries"]), pa.array([row["block"]] * 2, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array([index, asked], pa.binary()), pa.array([likeness, None], pa.binary()), pa.array([0, len(chosen)], pa.int64())],
                    names=["kind", "shard", "doc_ids", "body", "likeness", "queries"],
                )

    return run


def _norm(lengths: np.ndarray, mean: float) -> np.ndarray:
    return K1 * (1 - B + B * lengths.astype(np.float64) / max(mean, 1e-9))


def _by_likeness(x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of x by kind, then length, and their kinds in that order."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    # The first centre is the mean, each next one the row that is least like those so far. Rows of few terms are like
    # nothing: as centres they would leave all others to the first one, so they are none.
    terms = np.count_nonzero(x, axis=1)
    full = unit[terms >= np.median(terms[terms > 0])] if terms.any() else unit
    centres = [full.mean(axis=0)]
    like = full @ centres[0]
    for _ in range(KINDS - 1):
        centres.append(full[int(np.argmin(like))])
        like = np.maximum(like, full @ centres[-1])
    centres = np.asarray(centres, dtype=np.float32)
    kind = np.zeros(len(x), dtype=np.int64)
    for _ in range(ROUNDS):
        kind = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, kind, unit)
        some = np.bincount(kind, minlength=len(centres)) > 0
        centres[some] = sums[some] / np.maximum(np.linalg.norm(sums[some], axis=1, keepdims=True), 1e-9)
    order = np.lexsort((lengths, kind))
    return order, kind[order]


def _renumbered(place: np.ndarray, counts: np.ndarray, docs: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of documents and counts with the documents numbered by their index in place, each in order."""
    number = np.empty(len(place), dtype=np.int64)
    number[place] = np.arange(len(place))
    docs = number[docs]
    # By document, then by term: sixteen bits at a time, the lowest first.
    term = np.repeat(np.arange(len(counts)), counts)
    order = np.arange(len(docs))
    for key in (docs, docs >> 16, term, term >> 16):
        digit = (key & 0xFFFF).astype(np.uint16)
        if digit.any():
            order = order[np.argsort(digit[order], kind="stable")]
    return docs[order], tf[order]


def _parts(kind: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where parts begin, and the end: documents of a kind (in order of length) are cut where a class of lengths begins, but not in parts of less than PART."""
    key = kind * (len(CLASSES) + 1) + np.searchsorted(CLASSES, lengths)
    out: list[int] = []
    for at in np.flatnonzero(np.diff(key, prepend=-1)).tolist():
        # A class of few documents goes to the next longer one of its kind.
        if out and kind[out[-1]] == kind[at] and at - out[-1] < PART:
            continue
        out.append(at)
    return np.asarray([*out, len(kind)], dtype=np.int64)


class Queries:
    """Queries one behind another: query i has the terms unique[term[cuts[i] : cuts[i + 1]]] and their weights."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> None:
        self.unique, term = np.unique(terms, return_inverse=True)
        self.term = term.astype(np.int32)
        self.weights, self.cuts = weights, np.concatenate([[0], np.cumsum(sizes)])

    def entries(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all terms of some queries the index of the query in chosen, and the term's place in term and weights."""
        sizes = self.cuts[chosen + 1] - self.cuts[chosen]
        return np.repeat(np.arange(len(chosen)), sizes), _within(self.cuts[chosen], sizes)


def _within(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all of the runs that begin at begins."""
    out = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    out += np.arange(len(out))
    return out


class Shard:
    """An index in memory. Documents are numbered by likeness (as packed, or worked out); place gives the place that each had.

    A part is a run of documents of one kind and about one length. Impacts of terms that are frequent in it are a matrix of
    its own; what a term's list has of a part is a run of the list.
    """

    def __init__(self, doc_ids: list, body: bytes, mean: float, likeness: bytes | None = None) -> None:
        lengths, self.terms, counts, docs, tf = unpack(body)
        self.n, self.terms, self.counts = len(doc_ids), self.terms.astype(np.int64), counts.astype(np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.counts)])
        norm = _norm(lengths, mean)
        if likeness:
            place, kind, *was = (x.astype(np.int64) for x in unpack(likeness))
        else:
            frequent, was = _frequent(self.counts, self.n), []
            place, kind = _by_likeness(_dense(frequent, self.begins, docs, tf * (K1 + 1) / (tf + norm[docs]), self.n, np.float32).T, lengths)
        if not np.array_equal(place, np.arange(self.n)):
            docs, tf = _renumbered(place, self.counts, docs, tf)
        self.place = was[0] if was else place
        self.docs, self.tf, self.norm = docs.astype(np.uint16 if self.n <= 1 << 16 else np.uint32), tf, norm[place]
        self.impact = (tf * (K1 + 1) / (tf + self.norm[docs])).astype(np.float32)
        # Document and impact side by side: a list is fetched from memory once.
        self.lists = np.empty(len(docs), dtype=[("doc", np.uint32), ("impact", np.float32)])
        self.lists["doc"], self.lists["impact"] = self.docs, self.impact
        self.lists = self.lists.view(np.int64)
        ids = [doc_ids[i] for i in place.tolist()]
        self.ids = np.asarray([np.iinfo(np.int64).max if i is None else i for i in ids], dtype=np.int64)
        self.null = np.asarray([i is None for i in ids], dtype=bool)
        self.edges = _parts(kind, lengths[place])
        self._wide(kind)
        self.skipped = self.visited = 0

    def _wide(self, kind: np.ndarray) -> None:
        """Matrices of the parts, and where the lists of terms that are in one of them pass from part to part."""
        sizes = np.diff(self.edges)
        least = np.maximum(FREQUENT * sizes, 8)
        some = np.flatnonzero(self.counts > least.min(initial=8))
        part = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        where = _within(self.begins[some], self.counts[some])
        cell = np.repeat(np.arange(len(some)) * len(sizes), self.counts[some]) + part[self.docs[where]]
        df = np.bincount(cell, minlength=len(some) * len(sizes)).reshape(len(some), len(sizes))
        wide = (df > least).any(axis=1)
        some, self.df = some[wide], df[wide]
        self.wide = np.full(len(self.terms), -1, dtype=np.int32)
        self.wide[some] = np.arange(len(some))
        self.passes = self.begins[some][:, None] + np.concatenate([np.zeros((len(some), 1), np.int64), np.cumsum(self.df, axis=1)], axis=1)
        #: Of each part its frequent terms (as in wide), their impacts and counts by document, and their greatest impact by run.
        self.parts: list[tuple[np.ndarray, ...]] = []
        for p, (lo, hi) in enumerate(itertools.pairwise(self.edges.tolist())):
            own = np.flatnonzero(self.df[:, p] > least[p])
            where, row = _within(self.passes[own, p], self.df[own, p]), np.repeat(np.arange(len(own)), self.df[own, p])
            doc = self.docs[where].astype(np.int64) - lo
            dense, tf = np.zeros((len(own), hi - lo), np.float32), np.zeros((len(own), hi - lo), self.tf.dtype)
            dense[row, doc], tf[row, doc] = self.impact[where], self.tf[where]
            self.parts.append((own, dense, tf, np.maximum.reduceat(dense, np.arange(0, hi - lo, RUN), axis=1)))
        # The direction of each kind of documents.
        sums = np.concatenate([[0], np.cumsum(self.impact, dtype=np.float64)])
        sums = np.diff(sums[self.passes], axis=1)
        of = kind[self.edges[:-1]] if self.n else kind
        centres = np.asarray([sums[:, of == k].sum(axis=1) for k in np.unique(of)]).reshape(len(np.unique(of)), len(some))
        self.centres = np.ascontiguousarray((centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)).T, dtype=np.float32)

    def _exact(self, whose: np.ndarray, docs: np.ndarray, used: list[np.ndarray], entries: tuple[np.ndarray, ...], runs: tuple[np.ndarray, ...]) -> np.ndarray:
        """Scores of pairs of query and document in double precision: from the parts' matrices where they were used, from the lists elsewhere."""
        (row, wide, weight), (run_row, begins, sizes, run_weight) = entries, runs
        part = np.searchsorted(self.edges, docs, side="right") - 1
        span, run_span = (np.stack([np.searchsorted(x, whose), np.searchsorted(x, whose + 1)]) for x in (row, run_row))
        number, run_number = span[1] - span[0], run_span[1] - run_span[0]
        total = np.concatenate([[0], np.cumsum(number + run_number)])
        out, lo = np.zeros(len(docs)), 0
        while lo < len(docs):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + 4 * POSTINGS, side="right")) - 1)
            # The document's place in each list, by halves.
            at, pair = _within(run_span[0, lo:hi], run_number[lo:hi]), np.repeat(np.arange(lo, hi), run_number[lo:hi])
            begin, want = begins[at], docs[pair]
            last = begin + sizes[at] - 1
            some = np.flatnonzero((self.docs[begin] <= want) & (self.docs[last] >= want))
            at, pair, begin, last, want = at[some], pair[some], begin[some], last[some], want[some]
            while (begin < last).any():
                middle = (begin + last) >> 1
                less = self.docs[middle] < want
                begin, last = np.where(less, middle + 1, begin), np.where(less, last, middle)
            some = np.flatnonzero(self.docs[begin] == want)
            pair, tf, by = pair[some], self.tf[begin[some]].astype(np.float64), run_weight[at[some]]
            pairs, impacts = [pair], [by * (tf * (K1 + 1) / (tf + self.norm[docs[pair]]))]
            at, pair = _within(span[0, lo:hi], number[lo:hi]), np.repeat(np.arange(lo, hi), number[lo:hi])
            of = part[pair]
            for p in np.unique(part[lo:hi]).tolist():
                some = np.flatnonzero(of == p)
                column = used[p][wide[at[some]]]
                some, column = some[column >= 0], column[column >= 0]
                doc = docs[pair[some]]
                tf = self.parts[p][2][column, doc - self.edges[p]].astype(np.float64)
                pairs.append(pair[some])
                impacts.append(weight[at[some]] * (tf * (K1 + 1) / (tf + self.norm[doc])))
            out[lo:hi] = np.bincount(np.concatenate(pairs) - lo, np.concatenate(impacts), minlength=hi - lo)
            lo = hi
        return out

    def _rare(self, row: np.ndarray, begins: np.ndarray, sizes: np.ndarray, weights: np.ndarray, rows: int) -> np.ndarray:
        """Sums of runs of lists by row and document; rows in order."""
        out = np.zeros((rows, self.n), dtype=np.float32)
        cuts = np.searchsorted(row, np.arange(rows + 1))
        total = np.concatenate([[0], np.cumsum(sizes)])[cuts]
        weights, lo = weights.astype(np.float32), 0
        while lo < rows:
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + POSTINGS, side="right")) - 1)
            hi = min(hi, lo + max(1, 4 * POSTINGS // self.n))
            part = slice(cuts[lo], cuts[hi])
            size = sizes[part]
            both = self.lists.take(_within(begins[part], size))
            doc = np.repeat((row[part] - lo) * self.n, size)
            doc += both.view(np.uint32)[::2]
            value = np.repeat(weights[part], size)
            value *= both.view(np.float32)[1::2]
            out[lo:hi] = np.bincount(doc, value, minlength=(hi - lo) * self.n).reshape(hi - lo, self.n)
            lo = hi
        return out

    def _batch(self, dense: np.ndarray, run_max: np.ndarray, heavy: np.ndarray, rare: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(queries, documents, single-precision scores) of all of a part that may be among a query's best k and reach its least score."""
        n = rare.shape[1]
        top = np.maximum.reduceat(rare, np.arange(0, n, RUN), axis=1)
        margin = MARGIN + SINGLE * ((K1 + 1) * heavy.sum(axis=1, dtype=np.float64) + top.max(axis=1))
        least = least - margin
        alive = heavy @ run_max + top >= least[:, None]
        self.visited += alive.size
        # Queries that need equally many runs go together; neighbouring runs that one of them needs are scored at once.
        needs = np.count_nonzero(alive, axis=1)
        by_need = np.argsort(needs, kind="stable")
        none = int(np.count_nonzero(needs == 0))
        self.skipped += none * alive.shape[1]
        for at in range(none, len(least), BATCH):
            some = by_need[at : at + BATCH]
            need = alive[some].any(axis=0)
            self.skipped += len(some) * int((~need).sum())
            edges = np.flatnonzero(np.diff(need.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            if len(edges) > 1:
                far = edges[1:, 0] - edges[:-1, 1] > BRIDGE
                edges = np.stack([edges[np.append(True, far), 0], edges[np.append(far, True), 1]], axis=1)
            for lo, hi in np.minimum(edges * RUN, n).tolist():
                total = heavy[some] @ dense[:, lo:hi]
                total += rare[some, lo:hi]
                bar = least[some].astype(np.float32)
                whole = np.flatnonzero(bar <= 0)
                if len(whole) and hi - lo > k:
                    bar[whole] = np.partition(total[whole], -k, axis=1)[:, -k] - 2 * margin[some[whole]]
                hit = total >= np.nextafter(bar, np.float32(-np.inf))[:, None]
                found = np.flatnonzero(hit)
                if len(found):
                    i, d = np.divmod(found, hi - lo)
                    score = total.reshape(-1)[found]
                    real = score > 0
                    yield some[i[real]], d[real] + lo, score[real], margin[some[i[real]]]

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the query, numbers and rounded scores of its best k documents that reach its least score) of each (terms, weights)."""
        sizes = np.asarray([len(t) for t, _ in queries])
        every = Queries(np.concatenate([t for t, _ in queries]), np.concatenate([w for _, w in queries]), sizes)
        none = (np.zeros(0, np.int64), np.zeros(0))
        found = {i: (docs, scores) for i, docs, scores in self.search_some(every, np.arange(len(queries)), least, k)}
        yield from ((i, *found.get(i, none)) for i in range(len(queries)))

    def search_some(self, queries: Queries, chosen: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The same for some queries, by index in chosen, if any document is found. Queries of a kind and size are scored together, so that they skip the same runs."""
        if not self.n or not len(self.terms):
            return
        # Every term is looked up once, in order.
        needed = np.zeros(len(queries.unique), dtype=bool)
        for lo in range(0, len(chosen), KNOWN):
            needed[queries.term[queries.entries(chosen[lo : lo + KNOWN])[1]]] = True
        needed = np.flatnonzero(needed)
        found = np.minimum(np.searchsorted(self.terms, queries.unique[needed]), len(self.terms) - 1)
        place = np.full(len(queries.unique), -1, dtype=np.int64)
        place[needed] = np.where(self.terms[found] == queries.unique[needed], found, -1)
        kind, counts = np.zeros((2, len(chosen)), dtype=np.int64)
        for lo in range(0, len(chosen), KNOWN):
            query, at, weights = self._met(queries, chosen[lo : lo + KNOWN], place)
            counts[lo : lo + KNOWN] = np.bincount(query, minlength=len(chosen[lo : lo + KNOWN]))
            wide = self.wide[at]
            heavy = np.flatnonzero(wide >= 0)
            some, first = np.unique(query[heavy], return_index=True)
            if len(some):
                like = self.centres[wide[heavy]]
                like *= weights[heavy, None]
                kind[lo + some] = np.argmax(np.add.reduceat(like, first, axis=0), axis=1)
        group = kind * (len(QUERY_CLASSES) + 1) + np.searchsorted(QUERY_CLASSES, counts)
        for one in np.unique(group).tolist():
            order = np.flatnonzero(group == one)
            total = np.cumsum(counts[order])
            lo = 0
            while lo < len(order):
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + ENTRIES, side="right")))
                yield from self._search_group(order[lo:hi], *self._met(queries, chosen[order[lo:hi]], place), least, k)
                lo = hi

    def _met(self, queries: Queries, chosen: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some queries the terms that the shard has: index of the query in chosen, index of the term, weight."""
        query, where = queries.entries(chosen)
        at = place[queries.term[where]]
        have = at >= 0
        return query[have], at[have], queries.weights[where[have]]

    def _search_group(self, order: np.ndarray, query: np.ndarray, at: np.ndarray, weights: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        wide = self.wide[at]
        heavy = wide >= 0
        # A frequent term of a part that few queries of the group have is cheaper by its list.
        uses = np.bincount(wide[heavy], minlength=len(self.df))
        listed, used, terms = np.ones(self.df.shape, dtype=bool), [], []
        for p, (own, dense, *_) in enumerate(self.parts):
            some = np.flatnonzero((uses[own] > 0) & (uses[own] * LIST_COST * self.df[own, p] >= dense.shape[1] * len(order)))
            listed[own[some], p] = False
            # Where each frequent term is in the part's matrix, if it is used.
            used.append(np.full(len(self.df), -1, dtype=np.int64))
            used[p][own[some]] = some
            terms.append(some)
        first_column = np.cumsum([0, *map(len, terms)]).tolist()
        whose = np.concatenate([own[some] for (own, *_), some in zip(self.parts, terms, strict=True)])
        columns = np.argsort(whose, kind="stable")
        column_head = np.searchsorted(whose[columns], np.arange(len(self.df) + 1))
        # What is left of the lists, as runs: neighbouring parts are one run.
        step = np.diff(listed.astype(np.int8), axis=1, prepend=0, append=0)
        of, first = np.nonzero(step == 1)
        begin, end = self.passes[of, first], self.passes[of, np.nonzero(step == -1)[1]]
        real = end > begin
        of, begin, end = of[real], begin[real], end[real]
        head = np.searchsorted(of, np.arange(len(self.df) + 1))
        number = np.where(heavy, np.diff(head)[wide] if len(self.df) else 0, 1)
        entry = np.repeat(np.arange(len(at)), number)
        run_begin, run_size = self.begins[at][entry], self.counts[at][entry]
        of_wide = heavy[entry]
        runs = _within(head[wide[heavy]], number[heavy])
        run_begin[of_wide], run_size[of_wide] = begin[runs], (end - begin)[runs]
        run_query, run_weight = query[entry], weights[entry]
        rows = min(KNOWN, max(1, CELLS // self.n))
        for lo in range(0, len(order), rows):
            hi = min(lo + rows, len(order))
            part = slice(*np.searchsorted(run_query, [lo, hi]).tolist())
            runs = run_query[part] - lo, run_begin[part], run_size[part], run_weight[part]
            rare = self._rare(*runs, hi - lo)
            part = slice(*np.searchsorted(query, [lo, hi]).tolist())
            q, w, v = query[part] - lo, wide[part], weights[part]
            q, w, v = q[w >= 0], w[w >= 0], v[w >= 0]
            # The weights of all parts side by side, each in the columns that its frequent terms have there.
            block = np.zeros((hi - lo, first_column[-1]), dtype=np.float32)
            times = column_head[w + 1] - column_head[w]
            block[np.repeat(q, times), columns[_within(column_head[w], times)]] = np.repeat(v, times)
            parts = []
            for p, (_, dense, _, run_max) in enumerate(self.parts):
                if len(terms[p]) < dense.shape[0]:
                    dense, run_max = dense[terms[p]], run_max[terms[p]]
                a, z = self.edges[p : p + 2].tolist()
                heavy = block[:, first_column[p] : first_column[p + 1]]
                parts += [(i, docs + a, sums, margins) for i, docs, sums, margins in self._batch(dense, run_max, heavy, rare[:, a:z], least[order[lo:hi]], k)]
            if not parts:
                continue
            whose, docs, sums, margins = (np.concatenate([x[i] for x in parts]) for i in range(4))
            by = np.argsort(whose, kind="stable")
            whose, docs, sums, margins = whose[by], docs[by], sums[by], margins[by]
            begins = np.searchsorted(whose, np.arange(hi - lo + 1))
            kept = np.ones(len(whose), dtype=bool)
            for i in np.flatnonzero(np.diff(begins) > k).tolist():
                a, z = begins[i : i + 2].tolist()
                kept[a:z] = sums[a:z] >= np.partition(sums[a:z], -k)[-k] - 2 * margins[a:z].max()
            whose, docs = whose[kept], docs[kept]
            scores = np.round(self._exact(whose, docs, used, (q, w, v), runs), PLACES)
            some = (scores > 0) & (scores >= least[order[lo:hi]][whose] - MARGIN)
            whose, docs, scores = whose[some], docs[some], scores[some]
            by = np.lexsort((self.place[docs], self.ids[docs], -scores, whose))
            whose, docs, scores = whose[by], docs[by], scores[by]
            begins = np.searchsorted(whose, np.arange(hi - lo + 1))
            for i in np.flatnonzero(np.diff(begins)).tolist():
                best = slice(begins[i], min(begins[i] + k, begins[i + 1]))
                yield int(order[lo + i]), docs[best], scores[best]


FOUND = "query_shard long, query_place long, query_id long, doc_id long, doc_shard long, doc_place long, score double"
_NAMES = ["query_shard", "query_place", "query_id", "doc_id", "doc_shard", "doc_place", "score"]


#: The last group of queries that this process has unpacked: a group's rounds and tasks ask for it again.
_KEPT: dict[str, tuple[Queries, np.ndarray, list[tuple]]] = {}


def _asked(group: str, rows: list[dict], n_docs: int) -> tuple[Queries, np.ndarray, list[tuple]]:
    """Queries of some shards, one behind another, the shard of each, and (shard, place, id) of each."""
    if group in _KEPT:
        return _KEPT[group]
    _KEPT.clear()
    bodies = [[x.astype(np.int64) for x in unpack(q["body"])] for q in rows]
    places, sizes, terms, df, tf = (np.concatenate([b[i] for b in bodies]) for i in range(5))
    who = [(q["shard"], p, i) for q, b in zip(rows, bodies, strict=True) for p, i in zip(b[0].tolist(), q["doc_ids"], strict=True)]
    _KEPT[group] = Queries(terms, tf * np.log(1 + (n_docs - df + 0.5) / (df + 0.5)), sizes), np.asarray([w[0] for w in who], dtype=np.int64), who
    return _KEPT[group]


def _search(sent, n_docs: int, mean: float, k: int, near: int, far: int):
    """Searches each shard for the queries whose own shard lies near <= distance < far before it, around the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, shards, asked, least = sent.value
        queries = None
        for batch in batches:
            for row in batch.to_pylist():
                if queries is None:
                    queries, of_shard, who = _asked(group, asked, n_docs)
                    bar = np.asarray([least.get(w[:2], 0.0) for w in who])
                    own, best = np.searchsorted(shards, of_shard), {}
                distance = (int(np.searchsorted(shards, row["shard"])) - own) % len(shards)
                chosen = np.flatnonzero((near <= distance) & (distance < far))
                if not len(chosen):
                    continue
                shard = Shard(row["doc_ids"], row["body"], mean, row["likeness"])
                numbers, docs, scores = [], [], []
                for i, found, score in shard.search_some(queries, chosen, bar[chosen], k):
                    q = int(chosen[i])
                    numbers.append(np.full(len(found), q))
                    docs.append(found)
                    scores.append(score)
                    # What this task has found for a query bounds what its next shards need to return.
                    best[q] = np.sort(np.concatenate([best[q], score]))[-k:] if q in best else score
                    if len(best[q]) == k:
                        bar[q] = max(bar[q], best[q].min())
                if not numbers:
                    continue
                numbers, docs, scores = np.concatenate(numbers), np.concatenate(docs), np.concatenate(scores)
                shard_, place_, id_ = zip(*[who[q] for q in numbers.tolist()], strict=True)
                ids = pa.array(shard.ids[docs], pa.int64(), mask=shard.null[docs])
                yield pa.RecordBatch.from_arrays([pa.array(shard_, pa.int64()), pa.array(place_, pa.int64()), pa.array(id_, pa.int64()), ids, pa.array([row["shard"]] * len(docs), pa.int64()), pa.array(shard.place[docs], pa.int64()), pa.array(scores, pa.float64())], names=_NAMES)

    return run


def _groups(sizes: list) -> list[tuple[int, int]]:
    """Runs [from, to) of shards whose queries are bounded in bytes and number; sizes: (queries, bytes) of each shard."""
    out, begin, count, held = [], 0, 0, 0
    for at, (queries, size) in enumerate(sizes):
        if at > begin and (count + queries > GROUP_QUERIES or held + size > GROUP_BYTES):
            out.append((begin, at))
            begin, count, held = at, 0, 0
        count, held = count + queries, held + size
    if count:
        out.append((begin, len(sizes)))
    return [g for g in out if any(q for q, _ in sizes[g[0] : g[1]])]


def search(docs: DataFrame, is_query: Column, k: int = TOP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """query_id, rank (from 1), doc_id and score: the best k of all documents for each document that is a query."""
    coded = encode(docs, F.coalesce(is_query, F.lit(False)).cast("int"), doc_id, text, SHARD_BYTES)
    facts = coded.agg(F.sum(F.size("doc_ids")).alias("n"), F.sum("n_tokens").alias("tokens")).first()
    n, tokens = (facts[x] or 0 for x in ("n", "tokens"))
    spark = coded.sparkSession
    shards = max(2 * spark.sparkContext.defaultParallelism, int(tokens // VOCABULARY_TOKENS) + 1)
    replies = vocabulary(coded, shards, _document_counts)
    known = numbered(coded, replies, shards)
    released(coded, replies)
    parts = staged(known.mapInArrow(_split(tokens / max(n, 1)), PARTS), "index")
    released(known)
    index, asked = parts.where("kind = 'index'").select("shard", "doc_ids", "body", "likeness"), parts.where("kind = 'queries'")
    # One row for each shard: its number, and how much its queries are.
    meta = sorted(map(tuple, asked.select("shard", "queries", F.length("body")).collect()))
    numbers = np.asarray([m[0] for m in meta], dtype=np.int64)
    path, ranked = f"{shared_dir(spark)}/crawlweave/found-{uuid.uuid4().hex}", None
    best = Window.partitionBy("query_shard", "query_place").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "doc_shard", "doc_place")
    for begin, end in _groups([m[1:] for m in meta]):
        rows = [r.asDict() for r in asked.where(F.col("shard").between(int(numbers[begin]), int(numbers[end - 1])) & (F.col("queries") > 0)).select("shard", "doc_ids", "body").collect()]
        group, now, least, near, far = uuid.uuid4().hex, None, {}, 0, 1
        while near < len(numbers):
            sent = spark.sparkContext.broadcast((group, numbers, rows, least))
            # Only the shards that a query of the group visits in this round are read.
            lo, hi = begin + near, min(end - 1 + far - 1, begin + near + len(numbers) - 1)
            spans = [(lo, min(hi, len(numbers) - 1))] if lo < len(numbers) else []
            if hi >= len(numbers):
                spans.append((max(lo - len(numbers), 0), hi - len(numbers)))
            wanted = F.lit(False)
            for a, z in spans:
                wanted |= F.col("shard").between(int(numbers[a]), int(numbers[z]))
            found = index.where(wanted).mapInArrow(_search(sent, n, tokens / max(n, 1), k, near, far), FOUND)
            found = (now.select(*_NAMES).unionByName(found) if now is not None else found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            before, now = now, staged(found, "found")
            if before is not None:
                released(before)
            least = {(r["query_shard"], r["query_place"]): r["score"] for r in now.where(F.col("rank") == k).select("query_shard", "query_place", "score").collect()}
            sent.destroy()
            near, far = far, min(len(numbers), far * FACTOR) if far < len(numbers) else len(numbers) + 1
        now.write.mode("append").parquet(path)
        released(now)
        ranked = path
    released(parts)
    if ranked is None:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    return spark.read.schema(FOUND + ", rank int").parquet(path).select("query_id", "rank", "doc_id", "score")


#: The search of every document whose id is divisible by 50, in SQL over the table documents.
SEARCH_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
t AS (SELECT r, doc_id, len(words) AS n, unnest(words) AS w FROM d),
p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, w, count(*) AS tf FROM t GROUP BY r, w),
f AS (SELECT w, count(*) AS df FROM p GROUP BY w),
s AS (SELECT count(*) AS docs, sum(len(words)) / count(*) AS mean FROM d),
q AS (SELECT p.r, p.doc_id, p.w, p.tf * ln(1 + (s.docs - f.df + 0.5) / (f.df + 0.5)) AS weight FROM p JOIN f USING (w), s WHERE p.doc_id % 50 = 0),
i AS (SELECT p.r, p.doc_id, p.w, p.tf * {K1 + 1} / (p.tf + {K1} * ({1 - B} + {B} * p.n / s.mean)) AS impact FROM p, s),
m AS (SELECT q.r AS qr, q.doc_id AS query_id, i.r, i.doc_id, round(sum(q.weight * i.impact), {PLACES}) AS score FROM q JOIN i USING (w) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM m)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= {TOP} AND score > 0
"""
