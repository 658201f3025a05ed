"""N-gram Jaccard join by several global token orders.

A document's tokens are its distinct word shingles, as 64-bit hashes. A global order of all tokens gives each set a
prefix: with Jaccard similarity at least NUM/DEN, two sets share a token of their prefixes under every order there is.
ORDERS orders are used. The first puts tokens of rarely hit count buckets first (BUCKETS counters over the whole corpus,
summed and scaled to a byte each, so the table that tasks receive has a fixed size). The others deal the tokens into 16
groups by hashes of their own and order by group before rarity, so their prefixes are other parts of the sets.

Documents with equal sets are one node. Tokens in the first order's prefixes of at least two nodes make lists.
- A list of up to LIST nodes gives its pairs of fitting size. A pair stays a candidate only if the prefixes under all the
  other orders share a token too (by their lower 32 bits), and then only if its bitmaps allow it: each set's parity bitmap
  (one bit for each bucket with an odd number of tokens) differs from another's in at most as many bits as the sets differ
  in tokens.
- A longer list joins the cluster of its smallest node, so all pairs of a list are inside one cluster and the rows stay
  linear. STARS of its nodes, chosen by hash, are paired with all the others, by the same filters. Only clusters whose nodes
  are still in several components after that are gone through: split into blocks of CLUSTER nodes, a task for each pair of
  blocks, which intersects the orders' lists locally, skips what is connected already and verifies the rest, giving only links.
Candidates are verified with the whole sets: first one pair for each node and the stars, then the pairs whose ends are still
in different components. Links are exact; components come from alternating stars. Nothing is capped and no pair is lost.

Null or empty texts have no tokens and link with nothing. Texts with fewer words than a shingle are one token. A null
doc_id belongs to its component but never names it. Equal sets, ties and repeated rows are one node. Very long texts are
read whole. Empty tables give empty results; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHash, connected, mix64

NUM, DEN, ORDERS, BUCKETS, LIST, STARS, CLUSTER, SLICES = 9, 10, 3, 1 << 20, 64, 4, 1024, 64
_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(data: bytes | None, size: int, words: WordHash) -> np.ndarray:
    """The distinct shingles of a text, sorted; A-Z lower-cased, words parted by the six ASCII white-space characters."""
    tokens = (data or b"").lower().split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    if len(h) < size:
        whole = np.array([len(h)], dtype=np.uint64)
        for i in range(len(h)):
            whole = whole * _ODD[-1] + h[i : i + 1] * _ODD[i % len(_ODD)]
        return mix64(whole)
    n = len(h) - size + 1
    total = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        total = mix64(total + h[i : i + n] * _ODD[i % len(_ODD)]) if i >= len(_ODD) else total + h[i : i + n] * _ODD[i]
    return np.unique(mix64(total))


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    return n - -(-num * n // den) + 1


def prefix(tokens: np.ndarray, rank: np.ndarray, order: int, num: int, den: int) -> np.ndarray:
    """The tokens of a set's prefix under an order: rare buckets first, but in all orders except the first within hashed groups."""
    p = prefix_length(len(tokens), num, den)
    if p >= len(tokens):
        return tokens
    rare, own = rank[(tokens & _U(len(rank) - 1)).astype(np.int64)].astype(np.uint64), mix64(tokens * _ODD[order])
    key = (rare << _U(56)) | (own >> _U(8)) if order == 0 else ((own & _U(0xF)) << _U(60)) | (rare << _U(52)) | (own >> _U(12))
    return tokens[np.argpartition(key, p - 1)[:p]]


def parity(tokens: np.ndarray) -> np.ndarray:
    """A bitmap of a power of two of bits, at least as many as tokens and 64: is the number of tokens in the bucket odd?"""
    bits = 1 << max(6, int(len(tokens) - 1).bit_length())
    return np.packbits((np.bincount((tokens >> _U(20) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool))


def fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    while len(bitmap) > size:
        bitmap = bitmap[: len(bitmap) // 2] ^ bitmap[len(bitmap) // 2 :]
    return bitmap


def may_link(n: int, m: int, differing: int, num: int = NUM, den: int = DEN) -> bool:
    """Can sets of n and m tokens that differ in at least this many reach the similarity?"""
    return den * (n + m - differing) >= num * (n + m + differing)


def links(a: np.ndarray, b: np.ndarray, num: int = NUM, den: int = DEN) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


# ---------------------------------------------------------------- passes over the texts


def _count(batches: Iterator[pa.RecordBatch], size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    counts, words, held = np.zeros(buckets, dtype=np.int64), WordHash(), []
    for batch in batches:
        for text in batch.column(0):
            held.append((shingles(text.as_py(), size, words) & _U(buckets - 1)).astype(np.int64))
        if held:
            counts += np.bincount(np.concatenate(held), minlength=buckets)
            held = []
    parts = np.split(counts, SLICES)
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([zlib.compress(x.astype("<u4").tobytes(), 1) for x in parts], pa.binary())], names=["slice", "counts"])


def _sum(key, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x.as_py()), dtype="<u4").astype(np.int64) for x in table.column("counts"))
    return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([zlib.compress(np.minimum(total, 2**32 - 1).astype("<u4").tobytes(), 1)], pa.binary())})


def bucket_ranks(texts: DataFrame, size: int, buckets: int = BUCKETS) -> np.ndarray:
    """A byte for each bucket that grows with the logarithm of its count over all texts. texts: (b), bytes."""
    parts = texts.select("b").mapInArrow(lambda x: _count(x, size, buckets), "slice int, counts binary")
    for groups in (F.pmod(F.spark_partition_id(), F.lit(64)), F.lit(0)):
        parts = parts.withColumn("g", groups).groupBy("slice", "g").applyInArrow(lambda k, t: _sum(k, t), "slice int, counts binary")
    rows = sorted(parts.collect(), key=lambda r: r["slice"])  # SLICES rows of BUCKETS / SLICES numbers
    counts = np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), dtype="<u4") for r in rows]) if rows else np.zeros(buckets)
    return np.floor(3 * np.log2(1.0 + counts)).astype(np.uint8)


def _sketch(batches: Iterator[pa.RecordBatch], size: int, rank, num: int, den: int) -> Iterator[pa.RecordBatch]:
    words, rank = WordHash(), np.frombuffer(rank.value, dtype=np.uint8)
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            rows = []
            for text in batch.column("b"):
                s = shingles(text.as_py(), size, words)
                first, *others = (prefix(s, rank, o, num, den) for o in range(ORDERS))
                rows.append((len(s), hashlib.md5(s.tobytes()).digest() if len(s) else None, parity(s).tobytes() if len(s) else None, first.view(np.int64), *(x.astype(np.uint32).view(np.int32) for x in others)))
            n, key, bits, first, *others = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("k"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bits, pa.binary()), pa.array(first, pa.list_(pa.int64())), *(pa.array(o, pa.list_(pa.int32())) for o in others)], names=["__id", "k", "n", "s", "bits", *(f"p{o}" for o in range(ORDERS))])


def _whole_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    words = WordHash()
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            yield pa.RecordBatch.from_arrays([batch.column("s"), pa.array([shingles(x.as_py(), size, words).tobytes() for x in batch.column("b")], pa.binary())], names=["s", "tokens"])


# ---------------------------------------------------------------- candidates and verification


def _by_bitmap(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for nu, nv, bu, bv in zip(*(batch.column(c).to_pylist() for c in ("nu", "nv", "bu", "bv")), strict=True):
            x, y = (np.frombuffer(b, dtype=np.uint8) for b in (bu, bv))
            size = min(len(x), len(y))
            keep.append(may_link(nu, nv, int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum()), num, den))
        yield batch.select(["u", "v", "star"]).filter(pa.array(keep, pa.bool_()))


def _by_sets(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [links(*(np.frombuffer(b, dtype=np.uint64) for b in pair), num, den) for pair in zip(batch.column("tu").to_pylist(), batch.column("tv").to_pylist(), strict=True)]
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar enough."""
    x = pairs.join(sets.select(F.col("s").alias("u"), F.col("tokens").alias("tu")), "u").join(sets.select(F.col("s").alias("v"), F.col("tokens").alias("tv")), "v")
    return x.select("u", "v", "tu", "tv").mapInArrow(lambda b: _by_sets(b, num, den), "u binary, v binary")


def _cluster(key, table: pa.Table, rank, num: int, den: int) -> pa.Table:
    """Links that connect a cluster's nodes as all its similar pairs would, given the components so far."""
    rank = np.frombuffer(rank.value, dtype=np.uint8)
    names, roots = table.column("s").to_pylist(), table.column("root").to_pylist()
    sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("tokens").to_pylist()]
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), names[i]))
    sizes = np.array([len(sets[i]) for i in order])
    bits = 1 << max(6, int(sizes.min() - 1).bit_length())
    maps = np.stack([fold(parity(sets[i]), bits // 8) for i in order])
    lists: list[dict[int, list[int]]] = [{} for _ in range(ORDERS)]
    root = np.unique(np.array([roots[i] for i in order], dtype=object), return_inverse=True)[1]
    out = []
    for j, i in enumerate(order):
        share = (root[:j] != root[j]) & (den * sizes[:j] >= num * sizes[j])
        for o in range(ORDERS):
            mine = np.zeros(j, dtype=bool)
            for t in prefix(sets[i], rank, o, num, den).tolist():
                have = lists[o].setdefault(t, [])
                if have:
                    mine[have] = True
                have.append(j)
            share &= mine
        todo = np.flatnonzero(share)
        diff = np.bitwise_count(maps[todo] ^ maps[j]).sum(axis=1, dtype=np.int64)
        fits = den * (sizes[todo] + sizes[j] - diff) >= num * (sizes[todo] + sizes[j] + diff)
        todo = todo[fits][np.argsort(diff[fits], kind="stable")]
        while len(todo):
            a, todo = todo[0], todo[1:]
            if links(sets[order[a]], sets[i], num, den):
                out.append((names[order[a]], names[i]))
                root[root == root[j]] = root[a]
                todo = todo[root[todo] != root[j]]
    return pa.table({"u": pa.array([x for x, _ in out], pa.binary()), "v": pa.array([y for _, y in out], pa.binary())})


def _lists(sketch: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Of the first order: rows (token, i, n) of short lists, clusters (pivot, i) of long ones, and what to drop later.

    Candidates are found by i, a 64-bit hash of the node's key; all nodes of a hash come back when the keys are joined again.
    Counts are summed before they are shuffled and written before they are joined, so Spark can split a hot token's rows.
    """
    entries = sketch.where("n > 0").select(F.explode("p0").alias("token"), F.xxhash64("s").alias("i"), "n")
    shared = scratch.write(entries.groupBy("token").agg(F.min("i").alias("a"), F.max("i").alias("b")).where("a != b").select("token"), "shared")
    scratch.sweep()
    met = scratch.write(entries.join(shared, "token").distinct(), "met")
    sizes = scratch.write(met.groupBy("token").agg(F.count("*").alias("size"), F.min("i").alias("pivot")), "sizes")
    scratch.drop(shared)
    sized = met.join(sizes, "token")
    return sized.where(F.col("size") <= LIST).select("token", "i", "n"), sized.where(F.col("size") > LIST).select("pivot", "i").distinct(), [met, sizes]


def _pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    a, b = (rows.select("token", F.col("i").alias(f"{x}i"), F.col("n").alias(f"n{x}")) for x in "uv")
    near = (den * F.least("nu", "nv") >= num * F.greatest("nu", "nv")) & (F.col("ui") < F.col("vi"))
    return a.join(b, "token").where(near).select("ui", "vi", F.lit(False).alias("star"))


def _stars(clusters: DataFrame) -> DataFrame:
    """Pairs of each cluster's STARS nodes of smallest hash with all its nodes."""
    each = [F.min_by("i", F.xxhash64("i", F.lit(x))).alias(f"c{x}") for x in range(STARS)]
    chosen = clusters.groupBy("pivot").agg(*each).select("pivot", F.explode(F.array_distinct(F.array(*(f"c{x}" for x in range(STARS))))).alias("c"))
    met = clusters.join(chosen, "pivot").where("i != c")
    return met.select(F.least("i", "c").alias("ui"), F.greatest("i", "c").alias("vi"), F.lit(True).alias("star"))


def _rooted(documents: DataFrame, scratch: Scratch, size: int, num: int, den: int, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """Rows (__id, k, n, s) of all documents, k being the text's and s the set's digest, and (node, root) of the sets with links."""
    spark = documents.sparkSession
    b = F.coalesce(F.col(text_column).cast("string").cast("binary"), F.lit(b""))
    texts = documents.select(F.col(id_column).alias("__id"), b.alias("b"))
    kind = documents.schema[id_column].dataType.simpleString()
    rank = spark.sparkContext.broadcast(bucket_ranks(texts, size).tobytes())
    keyed = texts.select("__id", F.unhex(F.md5("b")).alias("k"), "b")
    prefixes = ", ".join(f"p{o} array<{'int' if o else 'bigint'}>" for o in range(ORDERS))
    sketch = scratch.write(keyed.mapInArrow(lambda x: _sketch(x, size, rank, num, den), f"__id {kind}, k binary, n bigint, s binary, bits binary, {prefixes}"), "sketch")
    short, long, own = _lists(sketch, scratch)
    clusters = scratch.write(long, "clusters")
    pairs = scratch.write(_pairs(short, num, den).unionByName(_stars(clusters)).groupBy("ui", "vi").agg(F.bool_or("star").alias("star")), "pairs")
    scratch.drop(*own)
    others = [f"p{o}" for o in range(1, ORDERS)]
    ends = pairs.select(F.col("ui").alias("i")).unionByName(pairs.select(F.col("vi").alias("i"))).distinct()
    nodes = sketch.where("n > 0").withColumn("i", F.xxhash64("s")).join(ends, "i", "left_semi")
    known = scratch.write(nodes.groupBy("s", "i").agg(F.min(F.struct("k", "n", "bits", *others)).alias("x")).select("s", "i", "x.*"), "nodes")
    u, v = (known.select(F.col("i").alias(f"{x}i"), F.col("s").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}"), *(F.col(p).alias(f"{p}{x}") for p in others)) for x in "uv")
    shared = pairs.join(u, "ui").join(v, "vi").where(" and ".join(f"arrays_overlap({p}u, {p}v)" for p in others) or "true")
    close = scratch.write(shared.select("u", "v", "star", "nu", "nv", "bu", "bv").mapInArrow(lambda x: _by_bitmap(x, num, den), "u binary, v binary, star boolean"), "close")
    wanted = close.select(F.col("u").alias("s")).unionByName(close.select(F.col("v").alias("s"))).unionByName(known.join(clusters.select("i").distinct(), "i", "left_semi").select("s")).distinct().join(known.select("s", "k"), "s")
    # one text for each wanted set; texts of equal bytes bring it once each
    sets = scratch.write(keyed.select("k", "b").join(wanted, "k").mapInArrow(lambda x: _whole_sets(x, size), "s binary, tokens binary").groupBy("s").agg(F.min("tokens").alias("tokens")), "sets")
    first = close.groupBy("v").agg(F.min("u").alias("u")).select("u", "v").unionByName(close.where("star").select("u", "v")).distinct()
    found = scratch.write(_verified(first, sets, num, den), "links")
    roots = connected(found, scratch)
    placed = scratch.write(known.select("i", "s").join(clusters, "i").join(roots.withColumnRenamed("node", "s"), "s", "left").select("pivot", "s", F.coalesce("root", "s").alias("root")), "placed")
    blocks = placed.groupBy("pivot").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.ceil(F.count("*") / CLUSTER).cast("int").alias("blocks")).where("a != b").select("pivot", "blocks")
    dealt = placed.join(scratch.write(blocks, "blocks"), "pivot").withColumn("block", F.pmod(F.hash("s"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = dealt.withColumn("other", other).select("pivot", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "s", "root")
    dense = tasks.join(sets, "s").select("pivot", "x", "y", "s", "root", "tokens").groupBy("pivot", "x", "y").applyInArrow(lambda k, t: _cluster(k, t, rank, num, den), "u binary, v binary")
    by_end = close.join(roots.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u", "left").join(roots.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v", "left")
    apart = by_end.where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v").join(first, ["u", "v"], "left_anti")
    more, seen = scratch.measured(dense.unionByName(_verified(apart, sets, num, den)), "links", n=F.count("*"))
    if seen["n"]:
        roots = connected(found.unionByName(more), scratch)
    rank.unpersist()
    scratch.drop(pairs, clusters, known, close, sets, placed)
    return sketch.select("__id", "k", "n", "s"), roots


def components(documents: DataFrame, scratch: Scratch, size: int = 3, num: int = NUM, den: int = DEN, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, n_nodes): component_id is the smallest id reachable by links, n_nodes the number of
    different token sets in the component."""
    sketch, roots = _rooted(documents, scratch, size, num, den, id_column, text_column)
    out = sketch.select("__id", "n", "s").join(nodes_named(sketch, roots), "s", "left")
    return out.select(F.col("__id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component_id", "__id").alias("component_id"), F.coalesce("n_nodes", F.lit(1)).cast("bigint").alias("n_nodes"))


def nodes_named(sketch: DataFrame, roots: DataFrame) -> DataFrame:
    """(s, component_id, n_nodes) of every set."""
    least = sketch.where("s is not null").groupBy("s").agg(F.min("__id").alias("least"))
    rooted = least.join(roots.withColumnRenamed("node", "s"), "s", "left").select("s", "least", F.coalesce("root", "s").alias("root"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_nodes"))
    return rooted.select("s", "root").join(whole, "root").select("s", "component_id", "n_nodes")


def one_of_each(documents: DataFrame, scratch: Scratch, size: int = 5, num: int = 4, den: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, all columns: of each component one row stays, the one of the smallest id (nulls last), then of the
    smallest digest of its text; of rows that agree in both any one. Documents without tokens stay, all of them.

    Rows are told apart by id and text, so a row never goes for another one that has its id.
    """
    sketch, roots = _rooted(documents, scratch, size, num, den, id_column, text_column)
    rows = sketch.where("s is not null").join(roots.withColumnRenamed("node", "s"), "s", "left").select("__id", "k", F.coalesce("root", "s").alias("root"))
    rows = scratch.write(rows.groupBy("root", "__id", "k").agg(F.count("*").alias("c")), "rows")
    at = F.struct(F.col("__id").isNull().alias("x"), "__id", "k")
    first = scratch.write(rows.groupBy("root").agg(F.min(at).alias("first"), F.count("*").alias("keys")).where("keys > 1").select("root", "first"), "first")
    gone = rows.join(first, "root").where(at != F.col("first")).select(F.col("__id").alias("__gone"), F.col("k").alias("__k"))
    gone, seen = scratch.measured(gone, "gone", n=F.count("*"))
    again = rows.where("c > 1").limit(1).count()
    key = F.unhex(F.md5(F.coalesce(F.col(text_column).cast("string").cast("binary"), F.lit(b""))))
    out = documents.withColumn("__d", key)
    if seen["n"]:
        out = out.join(gone, F.col(id_column).eqNullSafe(F.col("__gone")) & (F.col("__d") == F.col("__k")), "left_anti")
    if again:  # repeated rows; those without tokens stay, each under a number of its own
        tokens = F.col(text_column).rlike(r"[^ \t\n\x0B\f\r]")
        out = out.where(tokens).dropDuplicates([id_column, "__d"]).unionByName(out.where(~F.coalesce(tokens, F.lit(False))))
    return out.select(*documents.columns)
