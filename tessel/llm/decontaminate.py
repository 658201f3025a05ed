"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased (A-Z), stripped of ASCII punctuation and hashed. A first pass counts in how many documents each
n-gram of the benchmark occurs. An item's seeds are its n-grams in at most RARE of all documents or FLOOR documents, and in
any case those in at most twice as many as the item's median n-gram, so an item copied everywhere keeps seeds, also those
that edited copies have in common. In a second pass each seed found in a document opens a
window of the item's length and half of it on either side; overlapping windows of an item merge. A window with SEEDS
different seeds (one, for items of up to SINGLE words) is aligned with the item (match +2, mismatch and gap
-1); the score is the best local alignment over the item's score with itself. Of a document's windows that score alike the
first counts. An item of fewer than N words has no seeds; it is found in documents whose words are the item's and no more.

Both passes read the documents once, whole, and shuffle only counts. Items are sent to the tasks in blocks of at most
BLOCK items and BYTES of text, as many blocks as it takes; the results do not depend on the blocks.

Null or empty texts match nothing. Repeated items or documents give a row each. Very long texts are read whole, and long
items are aligned a row of the matrix at a time, so memory grows with the window only. Empty tables give empty results;
further columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import WordHash, mix64

N, RARE, FLOOR, SEEDS, THRESHOLD, BLOCK, BYTES, BATCH = 3, 0.0005, 50, 2, 0.5, 20_000, 16 << 20, 1024
SINGLE = 23
MATCH, MISMATCH, GAP = 2, -1, -1
_PUNCTUATION = string.punctuation.encode()
_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def words(text: bytes | None, hashes: WordHash) -> np.ndarray:
    tokens = (text or b"").lower().translate(None, _PUNCTUATION).split()
    return np.fromiter(map(hashes.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def grams(w: np.ndarray) -> np.ndarray:
    n = max(0, len(w) - N + 1)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(N):
        total = total + w[i : i + n] * _ODD[i]
    return mix64(total)


class Lookup:
    """Places of 64-bit keys in a sorted array; most absent keys are told by a bitmap."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys if len(keys) else np.zeros(1, dtype=np.uint64)
        self.mask = _U((1 << 20) - 1)
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[(keys & self.mask).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in x of keys, and which keys they are."""
        at = np.flatnonzero(self.bits[(x & self.mask).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, x[at]), len(self.keys) - 1)
        ok = self.keys[place] == x[at]
        return at[ok], place[ok]


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """The best local alignment score of each item with its window, a row of all matrices at a time."""
    m, w = max(map(len, items)), max(map(len, windows))
    a, b = np.zeros((len(items), m), dtype=np.uint64), np.full((len(items), w), 1, dtype=np.uint64)
    for k, (x, y) in enumerate(zip(items, windows, strict=True)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    slope = (np.arange(w, dtype=np.int32) * -GAP)[None, :]
    h, best = np.zeros((len(items), w + 1), dtype=np.int32), np.zeros(len(items), dtype=np.int32)
    for i in range(m):
        t = h[:, :-1] + np.where(b == a[:, i : i + 1], MATCH, MISMATCH)
        np.maximum(t, h[:, 1:] + GAP, out=t)
        np.maximum(t, 0, out=t)
        t += slope
        np.maximum.accumulate(t, axis=1, out=t)
        t -= slope
        h[:, 1:] = t
        np.maximum(best, t.max(axis=1), out=best)
    return best


def _best_end(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Score of the best local alignment, and how many words of the item and of the window come up to its end."""
    slope = np.arange(len(window), dtype=np.int32) * -GAP
    h, best = np.zeros(len(window) + 1, dtype=np.int32), (0, 0, 0)
    for i, word in enumerate(item.tolist(), 1):
        t = np.maximum(h[:-1] + np.where(window == word, MATCH, MISMATCH), h[1:] + GAP)
        h[1:] = np.maximum.accumulate(np.maximum(t, 0) + slope) - slope
        j = int(h.argmax())
        if h[j] > best[0]:
            best = (int(h[j]), i, j)
    return best


def span(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """First word and end of the window's part in a best local alignment; the first is the end of the same read backwards."""
    _, i, j = _best_end(item, window)
    _, _, back = _best_end(item[:i][::-1], window[:j][::-1])
    return j - back, j


def windows_of(hits: np.ndarray, place: np.ndarray, m: int, n: int) -> list[tuple[int, int]]:
    """Merged windows for hits at words `hits` of a text of n words that are at words `place` of an item of m words."""
    slack = m // 2 + 1
    start = np.maximum(0, hits - place - slack)
    end = np.minimum(n, hits - place + m + slack)
    out: list[tuple[int, int, set[int]]] = []
    for k in np.argsort(start, kind="stable"):
        s, e, p = int(start[k]), int(end[k]), int(place[k])
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e), out[-1][2] | {p})
        else:
            out.append((s, e, {p}))
    need = SEEDS if m > SINGLE else 1
    whole = []
    for s, e in ((s, e) for s, e, seeds in out if len(seeds) >= need):  # a long run of windows is aligned in pieces that overlap by two items
        while e - s > 8 * m:
            whole.append((s, s + 6 * m))
            s += 4 * m
        whole.append((s, e))
    return whole


def _count(batches: Iterator[pa.RecordBatch], lookup: Lookup) -> Iterator[pa.RecordBatch]:
    hashes, counts, docs = WordHash(), np.zeros(len(lookup.keys), dtype=np.int64), 0
    for batch in batches:
        docs += batch.num_rows
        for text in batch.column(0):
            _, which = lookup.find(grams(words(text.as_py(), hashes)))
            counts[np.unique(which)] += 1
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *some], pa.int64()), pa.array([docs, *counts[some]], pa.int64())], names=["gram", "n"])


def _found(batches: Iterator[pa.RecordBatch], shared, threshold: float, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """shared: the items' words end to end with their bounds, the seeds, and the seeds' places (item, word) with their bounds."""
    flat, bounds, keys, owner, place, starts = shared.value
    items, lookup, hashes = np.split(flat, bounds[1:-1]), Lookup(keys), WordHash()
    short: dict[bytes, list[int]] = {}
    for i, x in enumerate(items):
        if 0 < len(x) < N:
            short.setdefault(x.tobytes(), []).append(i)
    waiting: list[tuple] = []

    def flush() -> pa.RecordBatch:
        waiting.sort(key=lambda x: (len(items[x[1]]), len(x[3])))
        best: dict[tuple[int, int], tuple] = {}
        for at in range(0, len(waiting), 256):
            part = waiting[at : at + 256]
            for (row, item, start, window, doc), got in zip(part, align([items[x[1]] for x in part], [x[3] for x in part]), strict=True):
                score = int(got) / (MATCH * len(items[item]))
                if score >= threshold and (score, -start) > best.get((row, item), (0,))[:2]:
                    best[row, item] = (score, -start, window, doc)
        rows = []
        for (_, item), (score, start, window, doc) in best.items():
            s, e = span(items[item], window)
            rows.append((doc, item, score, s - start, e - start))
        waiting.clear()
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (id_type, pa.int32(), pa.float64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["__id", "item", "score", "first_word", "end_word"])

    row = 0
    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            row += 1
            w = words(text.as_py(), hashes)
            if len(w) < N:
                waiting += [(row, item, 0, w, doc.as_py()) for item in short.get(w.tobytes(), ())]
                continue
            at, which = lookup.find(grams(w))
            if not len(at):
                continue
            lengths = starts[which + 1] - starts[which]
            hits = np.repeat(at, lengths)
            own = np.repeat(starts[which] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(len(hits))
            for item in np.unique(owner[own]).tolist():
                mine = owner[own] == item
                for s, e in windows_of(hits[mine], place[own[mine]], len(items[item]), len(w)):
                    waiting.append((row, item, s, w[s:e], doc.as_py()))
        if len(waiting) >= BATCH:
            yield flush()
    if waiting:
        yield flush()


def overlaps(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, rare: float = RARE, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item id, score, first_word, end_word): each document and item whose alignment reaches the threshold, with the aligned words' place."""
    spark = documents.sparkSession
    kind, item_kind = documents.schema[id_column].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    docs = documents.select(F.col(id_column).alias("__id"), F.col(text_column).cast("string").cast("binary").alias("__b")).where("__b is not null")
    bench = benchmark.select(F.col(item_id).alias("__item"), F.col(item_text).cast("string").cast("binary").alias("__t")).where("__t is not null")
    n_items, n_bytes = bench.agg(F.count("*"), F.coalesce(F.sum(F.length("__t")), F.lit(0))).first()
    blocks = max(1, -(-n_items // BLOCK), -(-n_bytes // BYTES))
    out, id_type = None, to_arrow_type(documents.schema[id_column].dataType)
    for block in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("__item", "__t"), F.lit(blocks)) == block).collect() if n_items else []  # at most BLOCK, or a few more
        rows.sort(key=lambda r: (str(r["__item"]), r["__t"]))
        hashes = WordHash()
        items = [words(bytes(r["__t"]), hashes) for r in rows]
        each = [grams(x) for x in items]
        keys = np.unique(np.concatenate([*each, np.empty(0, dtype=np.uint64)]))
        if not any(map(len, items)):
            continue
        df, n_docs = np.zeros(len(keys), dtype=np.int64), 0
        if len(keys):
            everything = Lookup(keys)
            for r in docs.select("__b").mapInArrow(lambda x, e=everything: _count(x, e), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect():
                if r["gram"] < 0:
                    n_docs = r["n"]
                else:
                    df[r["gram"]] = r["n"]
        item, at, seed = [], [], []
        for i, g in enumerate(each):
            own = np.searchsorted(keys, g)
            most = max(rare * n_docs, FLOOR, 2 * float(np.median(df[own])) if len(g) else 0)
            p = np.flatnonzero(df[own] <= most)
            item.append(np.full(len(p), i, dtype=np.int64)), at.append(p), seed.append(own[p])
        item, at, seed = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (item, at, seed))
        order = np.argsort(seed, kind="stable")
        chosen, starts = np.unique(seed[order], return_index=True)
        # of BLOCK items and BYTES of text at most: a few numbers a word
        shared = spark.sparkContext.broadcast((np.concatenate(items), np.cumsum([0, *map(len, items)]), keys[chosen], item[order], at[order], np.append(starts, len(order))))
        found = docs.mapInArrow(lambda x, s=shared: _found(x, s, threshold, id_type), f"__id {kind}, item int, score double, first_word int, end_word int")
        names = spark.createDataFrame([(i, r["__item"]) for i, r in enumerate(rows)], f"item int, __item {item_kind}")
        part = found.join(F.broadcast(names), "item").select(F.col("__id").alias(id_column), F.col("__item").alias(item_id), "score", "first_word", "end_word")
        out = part if out is None else out.unionByName(part)
    empty = spark.createDataFrame([], f"{id_column} {kind}, {item_id} {item_kind}, score double, first_word int, end_word int")
    return empty if out is None else out


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any overlap, all their columns. Rows are told apart by id and text, so null or repeated ids do no harm."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = documents.withColumn("__key", F.md5(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)))
    found = overlaps(keyed.select("__key", "text"), benchmark, id_column="__key").select("__key").distinct()
    return keyed.join(found, "__key", "left_anti").select(*documents.columns)
