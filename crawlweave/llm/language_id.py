"""Language identification with language-bitmask n-gram filters.

Every learned language has a Bloom filter of its frequent character n-grams. The filters are bit-sliced: row p of the
table is a bitmask over the languages whose filter has bit p set, so that k row reads and an AND return all languages
containing an n-gram at once. A text's votes are the population counts of these masks per language, corrected for the
false-positive rate of each language's filter.

Cases: null text or no letter -> `und`, score 0. Empty training data -> every text with letters is `und` too. Ties go to
the language that sorts first. Repeated rows are answered alike, row by row. An empty table gives no rows. A very long text
is read whole, in pieces of SLICE characters that overlap by less than an n-gram. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, parts

#: Code points of an n-gram.
GRAM = 4
#: Labelled documents per language that training looks at, about: they are chosen by a hash of their id.
SAMPLE_DOCS = 2000
#: Share of a language's sampled documents that must contain an n-gram.
MIN_SHARE = 0.01
#: Bits of a filter for each n-gram it holds, and probes.
BITS_PER_GRAM, PROBES = 16, 4
#: Characters that are handled at once.
SLICE = 1 << 18
#: Labels up to which their table is broadcast; beyond it the join shuffles.
BROADCAST_LABELS = 10_000

UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _seam(text: str, begin: int, end: int) -> int:
    """Where the piece after text[begin:end] begins: GRAM - 1 letters or runs of others before end, so that each n-gram is in one piece."""
    at, units = end, 0
    while at > begin and units < GRAM - 1:
        at -= 1
        if not text[at].isalpha():
            while at > begin and not text[at - 1].isalpha():
                at -= 1
        units += 1
    return at


def _slices(texts: list[str]) -> Iterator[tuple[list[int], list[bool], str]]:
    """Texts joined by NUL in pieces of about SLICE characters, with the number of the text of each part, and whether it goes on within a word. Pieces of a text overlap by less than an n-gram."""
    owners: list[int] = []
    within: list[bool] = []
    parts: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        text = text.replace("\x00", " ") if "\x00" in text else text
        at = 0
        while at < len(text):
            end = min(len(text), at + SLICE)
            # A piece that is shorter than an n-gram, or all of it no letters, grows.
            while end < len(text) and (then := _seam(text, at, end)) == at:
                end = min(len(text), end + SLICE)
            part = text[at:end] if end - at < len(text) else text
            owners.append(i)
            within.append(at > 0 and text[at].isalpha())
            parts.append(part)
            size += len(part)
            at = end if end == len(text) else then
            if size >= SLICE:
                yield owners, within, "\x00".join(parts)
                owners, within, parts, size = [], [], [], 0
    if owners:
        yield owners, within, "\x00".join(parts)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, text numbers) of all n-grams with a letter: lower-cased letters, all else as one space."""
    letters = _letters()
    for owners, within, joined in _slices(texts):
        points = np.frombuffer(("\x00" + joined.lower()).encode("utf-32-le"), dtype="<u4")
        begins = np.flatnonzero(points == 0)
        owner = np.repeat(np.asarray(owners, dtype=np.int32), np.diff(np.append(begins, len(points))))
        code = np.where(letters[points], points, 32).astype(np.uint64)
        keep = np.ones(len(code), dtype=bool)
        keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (points[1:] == 0)
        code, owner = code[keep], owner[keep]
        n = len(code) - GRAM + 1
        if n <= 0:
            continue
        hashed = np.zeros(n, dtype=np.uint64)
        for j in range(GRAM):
            hashed ^= code[j : j + n]
            hashed *= np.uint64(0x9E3779B97F4A7C15)
            hashed ^= hashed >> np.uint64(29)
        same = owner[:n] == owner[GRAM - 1 : GRAM - 1 + n]
        inner = code[1 : 1 + n] != 32
        use = same & inner
        if any(within):
            # The NUL before a part is a space, but not where the part goes on within a word.
            false = np.zeros(len(keep), dtype=bool)
            false[begins[np.asarray(within, dtype=bool)]] = True
            use &= ~false[keep][:n]
        yield hashed[use], owner[:n][use]


@dataclass
class Filters:
    """Bit-sliced Bloom filters: table[p, w] has a bit for each of 64 languages."""

    langs: list[str]
    table: np.ndarray
    false_rate: np.ndarray

    @classmethod
    def build(cls, langs: list[str], sets: list[np.ndarray]) -> Filters:
        most = max([1, *map(len, sets)])
        bits = 1 << max(10, int(np.ceil(np.log2(most * BITS_PER_GRAM))))
        table = np.zeros((bits, max(1, -(-len(langs) // 64))), dtype=np.uint64)
        rate = np.zeros(len(langs))
        for i, held in enumerate(sets):
            for p in _positions(held, bits):
                table[p, i // 64] |= np.uint64(1 << (i % 64))
            fill = float(np.mean((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)))
            rate[i] = fill**PROBES
        return cls(langs, table, rate)

    def masks(self, hashed: np.ndarray) -> np.ndarray:
        """All languages that contain each n-gram."""
        out = np.full((len(hashed), self.table.shape[1]), ~np.uint64(0))
        for p in _positions(hashed, len(self.table)):
            out &= self.table[p]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        known = [t or "" for t in texts]
        hits = np.zeros((len(texts), len(self.langs)))
        total = np.zeros(len(texts))
        for hashed, owner in grams(known):
            total += np.bincount(owner, minlength=len(texts))
            masks = self.masks(hashed)
            for i in range(len(self.langs)):
                bit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                hits[:, i] += np.bincount(owner, weights=bit, minlength=len(texts))
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        share = hits / np.maximum(total, 1)[:, None]
        fixed = np.clip((share - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1)
        best = np.argmax(fixed, axis=1)
        langs, scores = [], np.zeros(len(texts))
        for i, text in enumerate(known):
            if total[i] == 0 and not any(map(str.isalpha, text)):
                langs.append(UNKNOWN)
            else:
                langs.append(self.langs[best[i]])
                scores[i] = fixed[i, best[i]]
        return langs, scores


def _positions(hashed: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = (hashed >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield ((hashed + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Filters:
    """Learns filters from about sample_docs labelled documents of each language, chosen by a hash of the id.

    Rows with a null text or label are left out. Only n-grams in MIN_SHARE of a language's sampled documents (in 2 at
    least) reach the driver: a number that doesn't grow with the input.
    """
    rows = labelled.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Filters.build([], [])
    scale = 1_000_000
    # One row for each label, joined: the plan does not grow with their number. From Arrow: rows of a list are made by workers of their own.
    facts = [(v, i, int(min(1, sample_docs / counts[v]) * scale), max(2, int(MIN_SHARE * min(counts[v], sample_docs))) if counts[v] > 1 else 1) for i, v in enumerate(langs)]
    kinds = {"lang": pa.string(), "i": pa.int32(), "rate": pa.int32(), "least": pa.int32()}
    per = labelled.sparkSession.createDataFrame(pa.table({c: pa.array(v, ty) for (c, ty), v in zip(kinds.items(), zip(*facts, strict=True), strict=True)}))
    few = len(facts) <= BROADCAST_LABELS
    chosen = rows.join(F.broadcast(per) if few else per, "lang").where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(7)), F.lit(scale)) < F.col("rate"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner_lang = np.asarray(batch.column(0).to_pylist(), dtype=np.int64)
            texts = batch.column(1).to_pylist()
            found: dict[int, list[np.ndarray]] = {}
            for hashed, owner in grams(texts):
                order = np.lexsort((hashed, owner))
                h, o = hashed[order], owner[order]
                first = np.ones(len(h), dtype=bool)
                first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
                h, o = h[first], owner_lang[o[first]]
                for i in np.unique(o):
                    found.setdefault(int(i), []).append(h[o == i])
            for i, parts in found.items():
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i), pa.int32()), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "docs"])

    least = per.select(F.col("i").alias("lang"), "least")
    counted = chosen.select("i", "text").mapInArrow(lean(emit), "lang int, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    kept = counted.join(F.broadcast(least) if few else least, "lang").where("docs >= least").select("lang", "gram").toPandas()
    sets = [kept.gram[kept.lang == i].to_numpy(dtype=np.int64).view(np.uint64) for i in range(len(langs))]
    return Filters.build(langs, sets)


def identify(docs: DataFrame, model: Filters, text: str = "text", keep: list[str | Column] | None = None) -> DataFrame:
    """The columns of keep (all, unless given), then lang_pred and score for every row of docs; columns of docs with these two names are replaced."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")] if keep is None else keep
    held = docs.select(*keep)
    # The text is sent once: as one of the columns of keep, or beside them.
    picked = held if text in held.columns and text in keep else docs.select(*keep, F.col(text).alias("__text"))
    at, count = picked.columns.index(text if picked is held else "__text"), len(held.columns)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:count]] + ["lang_pred string", "score double"])
    names = [*held.columns, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [model.predict(some.column(at).to_pylist()) for some in parts(batch)]
            langs, scores = [x for some, _ in told for x in some], np.concatenate([np.zeros(0), *(x for _, x in told)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:count], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    return picked.mapInArrow(lean(run), schema)
