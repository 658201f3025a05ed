"""Suffix-array dedup: remove every byte covered by a LENGTH-byte string that also starts anywhere else.

Candidates. Each LENGTH-byte window of a text is filed under its anchor, the leftmost GRAM-byte string inside it with the
smallest hash (of a fixed number of bits, whatever the text's length). Equal windows have equal anchors at equal places, so equal windows always meet. Consecutive windows with
one anchor form a block; about one suffix in ninety bytes is an anchor, and only those suffixes are shuffled, as hashes.
An anchor seen once is dropped; if all blocks of an anchor are equal, they are repeated as a whole.

Sorting. Where an anchor has different blocks, their bytes are fetched once for each different block, and two suffix
orders are made by deep-shallow sorting: of the anchor and what follows it, and of the anchor and what precedes it read
backwards. Multikey quicksort orders by eight-byte symbols down to a shallow depth (SHALLOW of them, the anchor being the first
three); ranges that agree so far (and small ranges) go to a blind trie, which finds a suffix's place from branching bytes alone and one comparison. The window that starts u bytes before
the anchor is repeated if and only if another block is in the same run of both orders: longest common prefixes of at least
LENGTH - u forwards and u backwards. A task sorts some anchors at a time, so it holds no more than GROUP blocks twice. Anchors with more than GROUP different blocks are spread by a digest of each window
instead (the same answer, by aggregation), so no group has to fit into a task.

Texts are UTF-8 bytes, null is empty. Texts below LENGTH bytes keep all. Equal texts have equal results, so texts are
keyed by digest: null or repeated doc_ids do no harm. Spans are judged on the input; overlapping ones merge. Memory is
bounded by the longest text and the partition size. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LENGTH, GRAM, GROUP, SHALLOW, SMALL, CHUNK = 200, 24, 20_000, 8, 24, 2 << 20
#: Anchors are ranked by the hash bits above these, which hold the place in the chunk: as many for short texts as for long ones.
PLACE_BITS = 34
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, dtype=np.uint64)])) for b in (_BASE, _INVERSE))
        return self.up, self.down


_POWERS = _Powers()


def blocks_of(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Blocks of texts laid end to end (each at least `length` long): text number, first window's start in the text, number of
    windows, the anchor's distance from the first window, and hashes of the anchor's gram and of the whole block."""
    n = len(data)
    up, down = _POWERS.of(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_LETTER[data] * down[:n], out=sums[1:])
    grams = (sums[gram:] - sums[:-gram]) * up[: n - gram + 1]
    key = _mix(grams)
    bits = _U(PLACE_BITS)
    order = (key >> bits << bits) | np.arange(len(key), dtype=np.uint64)
    w = length - gram + 1
    rows = -(-len(order) // w)
    padded = np.full(rows * w, ~_U(0), dtype=np.uint64)
    padded[: len(order)] = order
    grid = padded.reshape(rows, w)
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    head = np.minimum.accumulate(grid, axis=1).ravel()
    least = np.minimum(tail[: n - length + 1], head[w - 1 : w - 1 + n - length + 1])
    anchor = (least & ((_U(1) << bits) - _U(1))).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.ones(n - length + 1, dtype=bool)
    for e in ends[:-1].tolist():
        inside[max(0, e - length + 1) : e] = False
    at = np.flatnonzero(inside)
    own = anchor[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start, anchor = at[first], own[first]
    text = np.searchsorted(ends, start, side="right")
    whole = _mix((sums[start + count - 1 + length] - sums[start]) * up[start] + _mix(((anchor - start) * 512 + count).astype(np.uint64)))
    return {"text": text, "start": start - starts[text], "count": count, "offset": anchor - start, "gram": key[anchor].view(np.int64), "whole": whole.view(np.int64)}


_BLOCK = "k binary, start int, count smallint, offset smallint, gram bigint, whole bigint"


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    def made(keys: list[bytes], texts: list[bytes]) -> pa.RecordBatch:
        x = blocks_of(np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([len(t) for t in texts]), length)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).take(pa.array(x["text"])), *(pa.array(x[c], t) for c, t in (("start", pa.int32()), ("count", pa.int16()), ("offset", pa.int16()), ("gram", pa.int64()), ("whole", pa.int64())))], names=["k", "start", "count", "offset", "gram", "whole"])

    keys, texts, held = [], [], 0
    for batch in batches:
        for k, t in zip(batch.column(0), batch.column(1), strict=True):
            keys.append(k.as_py()), texts.append(t.as_py())
            held += len(texts[-1])
            if held >= CHUNK:
                yield made(keys, texts)
                keys, texts, held = [], [], 0
    if texts:
        yield made(keys, texts)


# ---------------------------------------------------------------- deep-shallow sorting


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def blind_trie(strings: list[bytes], ids: list[int]) -> tuple[list[int], list[int]]:
    """ids in the order of their strings, and each one's longest common prefix with the one before it (0 for the first).

    A node is [skip, {byte: child}] where skip is the place of the byte that decides; a leaf is a list of equal strings' ids.
    A search follows deciding bytes to some leaf, compares once with its string, and so knows where the new edge belongs.
    """
    root = None
    for i in ids:
        s = strings[i]
        if root is None:
            root = (-1, [i])
            continue
        node = root
        while node[0] >= 0:
            skip, children = node
            byte = s[skip] if skip < len(s) else -1
            node = children[byte] if byte in children else next(iter(children.values()))
        other = strings[node[1][0]]
        lcp = _common(s, other)
        if lcp == len(s) == len(other):
            node[1].append(i)
            continue
        mine, theirs = (x[lcp] if lcp < len(x) else -1 for x in (s, other))
        parent, edge, node = None, None, root
        while 0 <= node[0] < lcp:
            parent, edge = node, s[node[0]]
            node = node[1][edge]
        if node[0] == lcp:
            node[1][mine] = (-1, [i])
        else:
            split = (lcp, {theirs: node, mine: (-1, [i])})
            if parent is None:
                root = split
            else:
                parent[1][edge] = split
    order: list[int] = []
    lcps: list[int] = []
    stack = [(root, 0)] if root is not None else []
    while stack:
        node, lcp = stack.pop()
        if node[0] < 0:
            for k, i in enumerate(node[1]):
                order.append(i)
                lcps.append(len(strings[i]) if k else lcp)
        else:
            kids = sorted(node[1].items(), reverse=True)
            stack += [(child, node[0] if k < len(kids) - 1 else lcp) for k, (_, child) in enumerate(kids)]
    return order, lcps


def deep_shallow(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings and each one's longest common prefix with the one before it in that order."""
    n = len(strings)
    symbols = np.zeros((SHALLOW, n), dtype=np.uint64)
    for d in range(SHALLOW):
        symbols[d] = np.frombuffer(b"".join(s[8 * d : 8 * d + 8].ljust(8, b"\0") for s in strings), dtype=">u8") if n else 0
    order: list[int] = []
    lcps: list[int] = []
    todo = [(np.arange(n), 0)]
    while todo:
        ids, depth = todo.pop()
        if len(ids) <= SMALL or depth == SHALLOW:
            got, common = blind_trie(strings, ids.tolist())
            if order and got:
                common[0] = _common(strings[order[-1]], strings[got[0]])
            order += got
            lcps += common
            continue
        own = symbols[depth][ids]
        pivot = np.partition(own[:: max(1, len(own) // 9)], min(len(own), 9) // 2)[min(len(own), 9) // 2]
        parts = ((ids[own < pivot], depth), (ids[own == pivot], depth + 1), (ids[own > pivot], depth))
        todo += [p for p in reversed(parts) if len(p[0])]
    return np.array(order, dtype=np.int64), np.array(lcps, dtype=np.int64)


def repeated(counts: np.ndarray, offsets: np.ndarray, contents: list[bytes], length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For different blocks of any anchors, a table of blocks by windows: is the block's window w also in another block?"""
    n = len(contents)
    out = np.zeros((n, int(counts.max()) if n else 0), dtype=bool)
    places = offsets.tolist()
    after, after_lcp = deep_shallow([c[o:] for c, o in zip(contents, places, strict=True)])
    before, before_lcp = deep_shallow([c[o : o + gram] + c[:o][::-1] for c, o in zip(contents, places, strict=True)])
    run = np.empty((2, n), dtype=np.int64)
    for u in range(length):
        have = np.flatnonzero((offsets >= u) & (offsets - u < counts))
        if len(have) > 1:
            run[0, after] = np.cumsum(after_lcp < length - u)
            run[1, before] = np.cumsum(before_lcp < gram + u)
            both = run[0, have] * (n + 1) + run[1, have]
            _, which, many = np.unique(both, return_inverse=True, return_counts=True)
            hit = have[many[which] > 1]
            out[hit, offsets[hit] - u] = True
    return out


def _runs(row: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _sorted_groups(batches: Iterator[pa.RecordBatch], length: int, most: int = GROUP) -> Iterator[pa.RecordBatch]:
    """gram, whole, count, offset, times, content, in order of gram -> gram, whole, runs of repeated windows. Whole anchors are
    taken until there are `most` blocks, so what is held stays small."""

    def done(t: pa.Table) -> pa.RecordBatch:
        gram, whole, count, offset, times = (t.column(c).to_numpy() for c in ("gram", "whole", "count", "offset", "times"))
        found = repeated(count.astype(np.int64), offset.astype(np.int64), t.column("content").to_pylist(), length)
        found |= ((times > 1)[:, None]) & (np.arange(found.shape[1])[None, :] < count[:, None])
        keep = np.flatnonzero(found.any(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(gram[keep]), pa.array(whole[keep]), pa.array([_runs(found[i]) for i in keep], _RUNS)], names=["gram", "whole", "runs"])

    held: pa.Table | None = None
    for batch in batches:
        if batch.num_rows:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            if held.num_rows >= most:
                gram = held.column("gram").to_numpy()
                last = int(np.searchsorted(gram, gram[-1]))  # where the anchor begins that may go on
                if last:
                    yield done(held.slice(0, last))
                    held = held.slice(last)
    if held is not None and held.num_rows:
        yield done(held)


def _spread_groups(rows: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many different blocks: windows meet by digest."""
    windows = rows.select("gram", "whole", "times", F.explode(F.expr("sequence(0, count - 1)")).alias("w"), "content")
    windows = windows.select("gram", "whole", "times", "w", F.unhex(F.md5(F.substring("content", F.col("w") + 1, F.lit(length)))).alias("d"))
    many = windows.groupBy("d").agg(F.sum("times").alias("n")).where("n > 1").select("d")
    return windows.join(many, "d").groupBy("gram", "whole").agg(F.collect_list(F.struct(F.col("w").cast("int").alias("a"), F.col("w").cast("int").alias("b"))).alias("runs"))


# ---------------------------------------------------------------- the operator


def keyed(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, k, b): each text as bytes with its digest."""
    b: Column = F.coalesce(F.col(text_column).cast("string").cast("binary"), F.lit(b""))
    return documents.select(F.col(id_column).alias("__id"), b.alias("b")).select("__id", F.unhex(F.md5("b")).alias("k"), "b")


def repeated_spans(texts: DataFrame, scratch: Scratch, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(k, spans) for each different text with repeated strings; texts: (k, b), a row for each occurrence of a text."""
    long = texts.select("k", "b").where(F.length("b") >= length)
    blocks = scratch.write(long.mapInArrow(lambda x: _blocks(x, length), _BLOCK), "blocks")
    anchors = blocks.groupBy("gram").agg(F.count("*").alias("n"), (F.min("whole") != F.max("whole")).alias("mixed")).where("n > 1").select("gram", "mixed")
    anchors = scratch.write(anchors, "anchors")  # joined from a table, so Spark can split a hot anchor's rows
    met = scratch.write(blocks.join(anchors, "gram"), "met")
    end = (F.col("start") + F.col("count") - 1 + length).alias("end")
    alike = met.where("not mixed").select("k", "start", end)
    mixed = met.where("mixed")
    ones = mixed.groupBy("gram", "whole", "count", "offset").agg(F.count("*").alias("times"), F.min(F.struct("k", "start")).alias("at"))
    sizes = ones.groupBy("gram").agg((F.count("*") > group).alias("large"))
    want = ones.join(sizes, "gram").select(F.col("at.k").alias("k"), F.struct("gram", "whole", "count", "offset", "times", "at.start", "large").alias("x"))
    wanted = want.groupBy("k").agg(F.collect_list("x").alias("xs"))
    different = long.join(wanted, "k").select("k", "xs", "b")
    cut = different.select(F.explode("xs").alias("x"), "b").select("x.*", F.expr(f"substring(b, x.start + 1, x.count - 1 + {length})").alias("content"))
    cut = scratch.write(cut.groupBy("gram", "whole", "count", "offset", "times", "large").agg(F.min("content").alias("content")), "contents")
    small = cut.where("not large").select("gram", "whole", "count", "offset", "times", "content").repartition("gram").sortWithinPartitions("gram").mapInArrow(lambda x: _sorted_groups(x, length, group), "gram bigint, whole bigint, runs array<struct<a: int, b: int>>")
    runs = scratch.write(small.unionByName(_spread_groups(cut.where("large"), length)), "runs")
    partly = mixed.join(runs, ["gram", "whole"]).select("k", "start", F.explode("runs").alias("r")).select("k", (F.col("start") + F.col("r.a")).alias("start"), (F.col("start") + F.col("r.b") + length).alias("end"))
    spans = alike.unionByName(partly).distinct().groupBy("k").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    out = scratch.write(spans, "spans")
    scratch.drop(blocks, anchors, met, cut, runs)
    return out


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def remove(documents: DataFrame, scratch: Scratch, length: int = LENGTH, group: int = GROUP, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, spans, kept): each document's removed spans (start, end in bytes, merged) and its remaining bytes."""
    texts = keyed(documents, id_column, text_column)
    spans = repeated_spans(texts, scratch, length, group)

    def run(batches):
        for batch in batches:
            kept, cut = [], []
            for b, s in zip(batch.column("b"), batch.column("spans"), strict=True):
                data, own = b.as_py(), merged(s.as_py())
                cut.append([{"start": x, "end": y} for x, y in own])
                edges = [0, *(v for pair in own for v in pair), len(data)]
                kept.append(b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)) if own else data)
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(cut, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], names=["__id", "spans", "kept"])

    kind = documents.schema[id_column].dataType.simpleString()
    out = texts.join(spans, "k", "left").select("__id", "b", "spans").mapInArrow(run, f"__id {kind}, spans array<struct<start: int, end: int>>, kept binary")
    return out.withColumnRenamed("__id", id_column)


def removal_digests(documents: DataFrame) -> DataFrame:
    out = remove(documents, Scratch(documents.sparkSession))
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select("doc_id", (F.length("kept") + gone).cast("bigint").alias("n_bytes"), gone.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
