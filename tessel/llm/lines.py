"""Line dedup: segment-partition edit join, by DataFrame operations only.

Two lines of at least SHORTEST characters are linked if their edit distance is at most TAU; linked lines form classes (by
reachability), and of each class the first line stays (smallest doc_id, nulls last, then digest of the document, then line
number). All other lines of the class, equal or edited, are removed. Shorter lines form a class with their equals only;
blank lines always stay.

Join. A line of n characters is cut into TAU + 1 segments of n // (TAU + 1) characters or one more. Edits can touch at
most TAU of them, so a longer or equally long line within the distance contains one segment unchanged, at a place that
the numbers of edits left and right of it allow (multi-match-aware selection). Keys are hashes of length, segment number
and substring, so lines meet only with fitting lengths; different lines alone are joined, copies are merged before.

Hot segments. A key that over LIST lines (8 * LIST for rests) have as their own segment gives no pairs. Its lines lose the segment they share,
then the prefix and suffix that all lines of the key share, and what is left is joined again within the key, by more segments:
of PIECES pieces at most TAU hold the edits, so a key is all the others, those before the first edit in place, those after the
last one at the same distance from the end, those between moved as far as the edits before them allow. Lines that share such a
key are left with the pieces that may differ, and so on, until keys are short or at most 3 * TAU characters are left. Such
rests are compared with their key's first line only; where the links found so far leave a key's lines in several components,
the pairs across components follow. So templates with many fillings cost rows in proportion to their lines, not pairs of all
lines, and no link is lost.

Verification. Candidates with fitting letter counts run through an automaton held in bits: for every number of errors a
word whose bits are the 2 * TAU + 1 diagonals of the band, advanced for a character at a time with shifts, ANDs and ORs.

A line is what split() by \\n gives; null or empty texts have no lines to remove. Lines are keyed by a 64-bit hash. Rows
that agree in id and text are one document and keep or lose the same lines. Any number of copies costs one row a copy.
Very long lines and texts are read whole. Empty tables give empty results; further columns are kept, whatever their names
(those that begin with two underscores apart).
"""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected

TAU, SHORTEST, LIST, PIECES, LETTERS = 2, 20, 16, 5, "etaoinsrhldcumpg"


def cut(rows: DataFrame, tau: int) -> DataFrame:
    """rows (g, h, s) as (g, h, b, n, p<less>_<i>): b has four bytes a character, n is the number of characters, p the place where
    segment i of a string of n - less characters begins. As columns they are computed once a row, and the code stays small."""
    x = rows.select("g", "h", F.encode("s", "UTF-32").alias("b")).withColumn("n", F.shiftright(F.octet_length("b"), 2))
    return x.select("g", "h", "b", "n", *(F.expr(f"cast({i} * (n - {less}) div {tau + 1} as int)").alias(f"p{less}_{i}") for less in range(tau + 1) for i in range(tau + 2)))


def places(tau: int, own: bool) -> list[tuple[int, int, int]]:
    """(segment, how much shorter the other string is, shift): a string's own segments, or the substrings of it that may equal a
    segment of a string up to tau shorter. Both ends of each are inside a string whose segments have a character at least.
    Of two equally long strings up to three edits apart the one that is ahead of the other's segment finds it."""
    if own:
        return [(i, 0, 0) for i in range(tau + 1)]
    every = [(i, less, shift) for less in range(tau + 1) for i in range(tau + 1) for shift in range(max(-i, less - (tau - i)), min(i, less + (tau - i)) + 1)]
    return [(i, less, shift) for i, less, shift in every if less or shift > 0 or shift < 0 and tau > 3]


def key(i: int, less: int, shift: int, shortest: int) -> Column:
    """A hash of group, length, segment number and substring; null for strings that are too short to have a partner."""
    found = F.expr(f"xxhash64(g, n - {less}, {i}, substring(b, 4 * (p{less}_{i} + {shift}) + 1, 4 * (p{less}_{i + 1} - p{less}_{i})))")
    return F.when(F.col("n") >= shortest + less, found)


def opened(tau: int) -> Column:
    """All keys of a rest as an array of structs: own (may others probe it), less (how much shorter the other string is), number of the
    open pieces, the runs of pieces between them (from a to b, moved by s) and the open pieces (from a moved by s to b moved by e)."""
    out, number = [], 0
    listed = lambda names, xs: "array(" + ", ".join("named_struct(" + ", ".join(f"'{n}', {v}" for n, v in zip(names, x, strict=True)) + ")" for x in xs) + ")"
    for m in range(1, tau + 1):
        for places in combinations(range(PIECES), m):
            number += 1
            for moved in product(range(-tau, tau + 1), repeat=m):
                shifts = (0, *moved)
                first = next((x for x in moved if x), 0)
                if sum(max(1, abs(y - x)) for x, y in zip(shifts, moved, strict=False)) <= tau and (shifts[-1] > 0 or shifts[-1] == 0 and first >= 0):
                    runs = zip((0, *(p + 1 for p in places)), (*places, PIECES), shifts, strict=True)
                    opens = [(p, p + 1, x, y) for p, x, y in zip(places, shifts, moved, strict=False)]
                    out.append((str(not any(shifts)).lower(), shifts[-1], number, listed("abs", runs), listed("abse", opens)))
    return F.expr(listed(("own", "less", "number", "runs", "opens"), out))


def rest_keys(rows: DataFrame, tau: int, least: int) -> DataFrame:
    """rows (g, h, c, s) as (g, h, c, key, own, q0, q1, rest): a row for each way to leave pieces open; rest (UTF-32) is what is open,
    q0 and q1 are hashes of its first two pieces (q1 null where there is one piece; q0 null for one way, which lets equals meet)."""
    x = rows.select("g", "h", "c", F.encode("s", "UTF-32").alias("b")).withColumn("n", F.shiftright(F.octet_length("b"), 2))
    x = x.select("g", "h", "c", "b", "n", F.explode(opened(tau)).alias("x")).withColumn("m", F.expr("n - x.less")).where(F.col("m") >= least)
    at = lambda c: f"cast({c} * m div {PIECES} as int)"
    runs = f"transform(x.runs, r -> substring(b, 4 * ({at('r.a')} + r.s) + 1, 4 * ({at('r.b')} - {at('r.a')})))"
    opens = f"transform(x.opens, o -> substring(b, 4 * ({at('o.a')} + o.s) + 1, greatest(0, 4 * ({at('o.b')} + o.e - {at('o.a')} - o.s))))"
    return x.select("g", "h", "c", F.expr(f"xxhash64(g, m, x.number, {runs})").alias("key"), F.col("x.own").alias("own"), F.expr(f"if(x.number = 1, null, xxhash64(get({opens}, 0)))").alias("q0"), F.expr(f"if(size(x.opens) = 1, null, xxhash64(get({opens}, 1)))").alias("q1"), F.expr(f"aggregate({opens}, cast('' as binary), (done, y) -> concat(done, y))").alias("rest"))


def letter_counts(line: Column) -> Column:
    """Sixteen counts of four bits."""
    out = F.lit(0).cast("bigint")
    for k, c in enumerate(LETTERS):
        count = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).cast("bigint")
        out = out.bitwiseOR(F.shiftleft(count.bitwiseAND(15), 4 * k))
    return out


def counts_differ(a: str, b: str) -> Column:
    """A lower bound of the sum of the counts' differences: each is taken around the circle of 16."""
    gap = [f"(((shiftrightunsigned({a}, {4 * k}) & 15L) - (shiftrightunsigned({b}, {4 * k}) & 15L) + 16L) & 15L)" for k in range(len(LETTERS))]
    return F.expr(" + ".join(f"least({g}, 16L - {g})" for g in gap))


def within(x: str, y: str, tau: int) -> Column:
    """Is the edit distance of two strings at most tau? One word a number of errors; bit k is the diagonal k - tau."""
    a, b = "z.a", "z.b"  # the characters, split once a pair
    width = 2 * tau + 1
    band = (1 << width) - 1
    masks = " | ".join(f"if(coalesce(get({a}, j + ({k - tau})), '') = get({b}, j), {1 << k}L, 0L)" for k in range(width))
    parts: list[str] = []
    for d in range(tau + 1):
        old = f"(shiftright(s, {width * d}) & {band}L)"
        if d == 0:
            parts.append(f"({old} & m)")
        else:  # the same diagonal (match, substitution), the one below (insertion), the one above (deletion)
            below = f"(shiftright(s, {width * (d - 1)}) & {band}L)"
            parts.append(f"((({old} & m) | {below} | shiftright({below}, 1) | shiftleft({parts[d - 1]}, 1)) & {band}L)")
    new = " | ".join(f"shiftleft({p}, {width * d})" for d, p in enumerate(parts))
    first = sum((((1 << (d + 1)) - 1) << tau) << (width * d) for d in range(tau + 1))
    advance = f"get(transform(array({masks}), m -> ({new})), 0)"  # m: where the pattern has this character
    final = f"if(size({b}) = 0, {first}L, aggregate(sequence(0, size({b}) - 1), {first}L, (s, j) -> {advance}))"
    test = f"if(abs(size({a}) - size({b})) <= {tau}, (shiftright({final}, {width * tau + tau} + size({a}) - size({b})) & 1L) = 1L, false)"
    return F.expr(f"get(transform(array(struct(split({x}, '') as a, split({y}, '') as b)), z -> {test}), 0)")


# ---------------------------------------------------------------- candidates


def _keys(rows: DataFrame, scratch: Scratch, tau: int, shortest: int, deep: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (g, h, s): what is written, (h, key) of the own segments, and (h, key) of all; of rests with the whole lines' letter counts c."""
    if deep:
        keys = scratch.write(rest_keys(rows, tau, shortest).select("h", "c", "key", "own", "q0", "q1").distinct(), "keys", "none")
        return keys, keys.where("own").drop("own"), keys
    own, other = places(tau, True), places(tau, False)
    named = [key(*x, shortest).alias(f"{c}{i}") for c, xs in (("i", own), ("o", other)) for i, x in enumerate(xs)]
    keys = scratch.write(cut(rows, tau).where(F.col("n") >= shortest).select("h", *named), "keys", "none")
    columns = [f"i{i}" for i in range(len(own))] + [f"o{i}" for i in range(len(other))]
    return keys, keys.select("h", F.explode(F.array(*columns[: len(own)])).alias("key")), keys.select("h", F.explode(F.array(*columns)).alias("key")).where("key is not null")


def _met(rows: DataFrame, scratch: Scratch, tau: int, shortest: int, most: int, deep: bool) -> tuple[DataFrame, DataFrame, dict]:
    """rows (g, h, s): pairs (u, v) of different strings' hashes with a key in common, and (key, h) where the key is hot."""
    keys, own_keys, left = _keys(rows, scratch, tau, shortest, deep)
    hot = scratch.write(own_keys.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > most).select("key"), "hot")
    own = own_keys.join(hot, "key", "left_anti").withColumnsRenamed({"h": "o", "c": "d", "q0": "r0", "q1": "r1"})
    right = own.unionByName(hot.select("key", F.lit(None).cast("bigint").alias("o")), allowMissingColumns=True)
    # at most 8 * LIST rows a key on the right: a hash table of them is bounded by the partition's size
    fits = F.col("h") != F.col("o")
    if deep:  # two unmoved rests meet once, and only under the key that leaves open what differs
        once = F.expr("NOT own OR h < o AND coalesce(q0 <> r0, true) AND coalesce(q1 <> r1, true)")
        fits = fits & once & (counts_differ("c", "d") <= 2 * tau)
    met = left.join(right.hint("shuffle_hash"), (left["key"] == right["key"]) & (F.col("o").isNull() | fits)).drop(right["key"])
    met = met.select(F.when(F.col("o").isNull(), F.col("h")).otherwise(F.least("h", "o")).alias("u"), F.greatest("h", "o").alias("v"), F.when(F.col("o").isNull(), F.col("key")).alias("key"), F.col("o").isNull().alias("hot"))
    met, seen = scratch.measured(met, "met", hot=F.count_if("hot"), pairs=F.count_if(~F.col("hot")))
    scratch.drop(keys, hot)
    return met, met.where("hot").select("key", F.col("u").alias("h")).distinct(), seen


def _common(a: str, b: str) -> Column:
    """The length of two strings' common prefix, by halving."""
    step = "if(lo + shiftleft(1, 30 - k) <= least(char_length({a}), char_length({b})) and left({a}, lo + shiftleft(1, 30 - k)) = left({b}, lo + shiftleft(1, 30 - k)), lo + shiftleft(1, 30 - k), lo)"
    return F.expr(f"aggregate(sequence(0, 30), 0, (lo, k) -> {step.format(a=a, b=b)})")


def _rests(rows: DataFrame, members: DataFrame, scratch: Scratch, tau: int, shortest: int, deep: bool) -> DataFrame:
    """The next level's rows: for each hot key its lines without what they share there and without the prefix and suffix that all of
    them share in what is left."""
    some = rows.join(members.select("h").distinct(), "h", "left_semi")
    if deep:
        met = rest_keys(some, tau, shortest).select("key", "h", "c", F.decode("rest", "UTF-32").alias("s"))
    else:
        each = [F.when(key(*x, shortest).isNotNull(), F.struct(key(*x, shortest).alias("key"), F.expr(f"4 * (p{x[1]}_{x[0]} + {x[2]})").alias("a"), F.expr(f"4 * (p{x[1]}_{x[0] + 1} + {x[2]})").alias("z"))) for x in places(tau, True) + places(tau, False)]
        met = cut(some, tau).select("h", "b", F.explode(F.array(*each)).alias("x")).where("x is not null")
        met = met.select(F.col("x.key").alias("key"), "h", letter_counts(F.decode("b", "UTF-32")).alias("c"), F.expr("decode(concat(substring(b, 1, x.a), substring(b, x.z + 1)), 'UTF-32')").alias("s"))
    parts = scratch.write(met.join(members, ["key", "h"], "left_semi").distinct(), "cut")
    ends = parts.withColumn("r", F.reverse("s")).groupBy("key").agg(F.min("s").alias("s1"), F.max("s").alias("s2"), F.min("r").alias("r1"), F.max("r").alias("r2"), F.min(F.char_length("s")).alias("least"))
    ends = ends.select("key", _common("s1", "s2").alias("p"), _common("r1", "r2").alias("q"), "least").select("key", "p", F.least("q", F.col("least") - F.col("p")).alias("q"))
    ends = scratch.write(ends, "ends")
    trimmed = parts.join(ends, "key").select(F.col("key").alias("g"), "h", "c", F.expr("substring(s, p + 1, char_length(s) - p - q)").alias("s"))
    return scratch.write(trimmed, "rests")


def _verified(pairs: DataFrame, texts: DataFrame, tau: int) -> DataFrame:
    x = pairs.join(texts.select(F.col("h").alias("u"), F.col("line").alias("a")), "u").join(texts.select(F.col("h").alias("v"), F.col("line").alias("b")), "v")
    near = x.withColumns({"c": letter_counts(F.col("a")), "d": letter_counts(F.col("b"))}).where(counts_differ("c", "d") <= 2 * tau)
    return near.where(within("a", "b", tau)).select("u", "v")


def linked_lines(own: DataFrame, scratch: Scratch, tau: int = TAU, shortest: int = SHORTEST, most: int = LIST) -> DataFrame:
    """(node, root) for every line hash with links. own: (h, line), a row for each different line of at least `shortest` characters."""
    rows, least = own.select(F.lit(0).cast("bigint").alias("g"), "h", F.col("line").alias("s")), shortest
    pairs, ends, deep = None, None, False
    while True:
        met, members, seen = _met(rows, scratch, tau, least, 8 * most if deep else most, deep)  # letter counts thin out the rests' pairs
        now = met.where("not hot").select("u", "v")
        pairs = now if pairs is None else pairs.unionByName(now)
        if not seen["hot"]:
            break
        rows = _rests(rows, members, scratch, tau, least, deep)
        least, deep = 2 * tau + 1, True
        rest = rows.where(F.char_length("s") <= 3 * tau).select("g", "h").distinct()
        ends = rest if ends is None else ends.unionByName(rest)
    if ends is not None:
        ends = scratch.write(ends, "rest")
        stars = ends.join(ends.groupBy("g").agg(F.min("h").alias("p")), "g").where("h != p")
        pairs = pairs.unionByName(stars.select(F.least("h", "p").alias("u"), F.greatest("h", "p").alias("v")))
    pairs = scratch.write(pairs.distinct(), "candidates")
    wanted = pairs.select(F.col("u").alias("h")).unionByName(pairs.select(F.col("v").alias("h")))
    if ends is not None:
        wanted = wanted.unionByName(ends.select("h"))
    # grows with the corpus, so it is never broadcast
    texts = scratch.write(own.join(wanted.distinct().hint("merge"), "h"), "texts", "lz4")
    links = scratch.write(_verified(pairs, texts, tau), "links")
    roots = connected(links, scratch)
    if ends is not None:
        rooted = scratch.write(ends.join(roots.withColumnRenamed("node", "h"), "h", "left").select("g", "h", F.coalesce("root", "h").alias("root")), "rooted")
        split = rooted.groupBy("g").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("g")
        left = scratch.write(rooted.join(split, "g"), "split")
        across = left.alias("x").join(left.alias("y"), F.expr("x.g = y.g and x.root < y.root")).select(F.least("x.h", "y.h").alias("u"), F.greatest("x.h", "y.h").alias("v")).distinct()
        more, seen = scratch.measured(_verified(across, texts, tau), "links", n=F.count("*"))
        if seen["n"]:
            roots = connected(links.unionByName(more), scratch)
    scratch.drop(pairs, texts)
    return roots


# ---------------------------------------------------------------- the operator


def _keyed(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    name = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return documents.withColumn("__k", F.unhex(F.md5(F.concat_ws("\x00", name, F.coalesce(F.col(text_column), F.lit(""))))))


def removed_lines(documents: DataFrame, scratch: Scratch, tau: int = TAU, shortest: int = SHORTEST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(__k, __gone): for each document's key the numbers (from 0) of its removed lines, in order."""
    keyed = _keyed(documents.select(id_column, text_column), id_column, text_column)
    split = F.split(text_column, "\n")
    every = keyed.select(F.explode(split).alias("line")).where(F.col("line").rlike(r"\S")).groupBy("line").agg(F.count("*").alias("times"))
    own = scratch.write(every.select(F.xxhash64("line").alias("h"), "times", "line"), "lines")
    scratch.sweep()
    roots = linked_lines(own.where(F.char_length("line") >= shortest).select("h", "line"), scratch, tau, shortest)
    copied = own.where("times > 1").select(F.col("h").alias("node"), F.col("h").alias("root"))
    # a line's root is the smallest hash of its class, so never above its own
    classes = scratch.write(roots.unionByName(copied).groupBy("node").agg(F.min("root").alias("root")), "classes")
    scratch.drop(own)
    places = keyed.select(F.col(id_column).alias("__id"), "__k", F.posexplode(split).alias("no", "line")).select("__id", "__k", "no", F.xxhash64("line").alias("node"))
    at = places.join(classes, "node").select(F.struct(F.col("__id").isNull().alias("x"), "__id", "__k", "no").alias("at"), "root")
    at = scratch.write(at, "occurrences")
    first = scratch.write(at.groupBy("root").agg(F.min("at").alias("first")), "first")  # joined from a table, so Spark can split a very common line's rows
    gone = at.join(first, "root").where("at != first").groupBy(F.col("at.__k").alias("__k")).agg(F.array_sort(F.collect_set("at.no")).alias("__gone"))
    out = scratch.write(gone, "removed")
    scratch.drop(at, first, classes)
    return out


def without(lines: str, gone: str) -> Column:
    """The lines that stay, from the runs between the removed numbers."""
    start, end = f"if(j = 0, 0, get({gone}, j - 1) + 1)", f"if(j = size({gone}), size({lines}), get({gone}, j))"
    return F.expr(f"flatten(transform(sequence(0, size({gone})), j -> slice({lines}, {start} + 1, {end} - {start})))")


def dedup(documents: DataFrame, scratch: Scratch, tau: int = TAU, shortest: int = SHORTEST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with their removed lines taken out of the text; __lines and __removed count each document's lines."""
    removed = removed_lines(documents, scratch, tau, shortest, id_column, text_column)
    # a row a document with removals: it grows with the corpus, so it is never broadcast
    x = _keyed(documents, id_column, text_column).join(removed.hint("merge"), "__k", "left")
    x = x.withColumn("__split", F.split(text_column, "\n"))
    kept = F.array_join(without("__split", "__gone"), "\n")
    counts = {"__lines": F.coalesce(F.size("__split"), F.lit(0)).cast("bigint"), "__removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint")}
    return x.withColumns(counts).withColumn(text_column, F.when(F.col("__gone").isNull(), F.col(text_column)).otherwise(kept)).select(*documents.columns, *counts)


def without_repeated_lines(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """Documents' own columns; those of which nothing but white space is left go, n_chars counts what is left."""
    out = dedup(documents, scratch).where((F.col("__removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*documents.columns)


def line_digests(documents: DataFrame) -> DataFrame:
    out = dedup(documents.select("doc_id", "text"), Scratch(documents.sparkSession))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.char_length(text).cast("bigint").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))
