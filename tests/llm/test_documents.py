"""Every document operator on awkward rows: nulls in any column, empty, blank and very long texts, repeated rows, no rows, and
columns whose names clash with the operators' own."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import decontaminate, jaccard, lines, mixing, ogg, rnnlm, suffix, toxicity
from tessel.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, s string, n int, k string, line string, words string, __id2 string"


def make(rows):
    return [(i, t, "en", "src", len(t or ""), 0.5, "s", 1, "k", "l", "w", "x") for i, t in rows]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    say = lambda n: " ".join(word() for _ in range(n))
    base, line = say(300), say(12)
    rows = [(i, say(r.randint(1, 60)) + "\n" + say(9)) for i in range(24)]
    rows += [(30, base), (31, base), (32, base.replace(" ", "  ")), (33, base[:-30] + say(5)), (34, say(8) + "\n" + line), (35, line + "\n" + say(8)), (36, line[:-1] + "Z\n" + say(8))]
    rows += [(40, None), (41, ""), (42, "   \n\t "), (43, "A b"), (44, "a B"), (45, say(20_000)), (None, base), (None, None), (30, base), (46, "é😀 " * 90), (47, "x" * 700), (48, "ab " * 300)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(make(texts), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(24)] + [(None, 1, 1), (3, None, None), (3, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")


def test_ogg(docs, none, texts):
    got = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.payload_bytes) for r in ogg.media_digests(docs).collect())
    want = sorted((i is None, i, n, max(64, -(-n // 64) * 64)) for i, n in ((i, len((t or "").encode())) for i, t in texts))
    assert got == want and ogg.media_digests(none).count() == 0


def test_toxicity(spark, docs, none, labels, texts):
    assert toxicity.scored(docs, labels).count() == len(texts)
    assert toxicity.scored(none, labels).count() == 0
    empty = toxicity.scored(docs, labels.limit(0)).collect()
    assert all(r.score == pytest.approx(1e-9) for r in empty) and toxicity.clean(docs, labels.limit(0)).columns == docs.columns


def brute_force(texts: list[bytes], length: int = suffix.LENGTH) -> list[tuple[int, int, int, str]]:
    """The definition, for tests: (n_bytes, n_removed, n_spans, sha256 of the rest) of each text."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, dtype=np.int64)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1] += 1
                gone[i + length + 1] -= 1
        mask = np.cumsum(gone)[1 : len(t) + 1] > 0
        kept = bytes(b for b, m in zip(t, mask, strict=True) if not m)
        out.append((len(t), int(mask.sum()), int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix(docs, none, texts):
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.removal_digests(docs).collect())
    assert got == sorted(brute_force([(t or "").encode() for _, t in texts]))
    assert suffix.removal_digests(none).count() == 0


def test_suffix_hot_groups_are_spread(docs, texts):
    out = suffix.remove(docs, Scratch(docs.sparkSession), group=1)
    want = sorted(n - gone for n, gone, _, _ in brute_force([(t or "").encode() for _, t in texts]))
    assert sorted(len(r.kept) for r in out.collect()) == want


@pytest.mark.parametrize("group", [1, 40, 20_000])
def test_suffix_of_passages_in_many_surroundings(spark, group):
    """Passages with edges of all kinds, periods and near repeats; groups spread, sorted a few anchors at a time, and at once."""
    r = random.Random(14)
    say = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passages = [say(260), say(199), say(200), say(201), "xy" * 150]
    texts = [say(r.randint(0, 150)) + r.choice(passages) + say(r.randint(0, 150)) + r.choice(["", r.choice(passages)]) for _ in range(120)] + [say(900)] * 3
    out = suffix.remove(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), Scratch(spark), group=group)
    assert [(sum(x.end - x.start for x in s.spans), len(s.spans)) for s in sorted(out.collect())] == [(gone, n) for _, gone, n, _ in brute_force([t.encode() for t in texts])]


def brute_components(texts, size, num, den):
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
    ids = {}
    for r, (i, _) in zip(root, texts, strict=True):
        if i is not None:
            ids[r] = min(ids.get(r, i), i)
    return sorted(((i, len(s), ids.get(r)) for (i, _), s, r in zip(texts, sets, root, strict=True)), key=str)


@pytest.mark.parametrize("size,num,den,longest", [(3, 9, 10, 64), (5, 4, 5, 1)])
def test_jaccard(docs, texts, monkeypatch, size, num, den, longest):
    monkeypatch.setattr(jaccard, "LIST", longest)
    got = sorted(((r[0], r[1], r[2]) for r in jaccard.components(docs, Scratch(docs.sparkSession), size, num, den).collect()), key=str)
    assert got == brute_components(texts, size, num, den)


@pytest.mark.parametrize("cluster", [8, 1024])
def test_jaccard_of_a_dense_cluster(spark, monkeypatch, cluster):
    """Lists longer than LIST, in one block and in several: sixty copies, each edited in its own place, that link in part only."""
    monkeypatch.setattr(jaccard, "LIST", 4)
    monkeypatch.setattr(jaccard, "CLUSTER", cluster)
    r = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = list(base)
        for k in r.sample(range(5, 60), r.randint(0, 3)):
            own[k] = f"x{i}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(base[:30]) + " " + " ".join(f"y{i}z{k}" for k in range(r.randint(0, 30)))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x[0], x[1], x[2]) for x in jaccard.components(docs, Scratch(spark), 3, 9, 10).collect()), key=str)
    assert got == brute_components(rows, 3, 9, 10)


def test_orders_differ_in_their_prefixes():
    import numpy as np

    r = np.random.default_rng(4)
    tokens, rank = np.unique(r.integers(0, 1 << 63, 3000, dtype=np.uint64)), r.integers(0, 30, 1 << 20).astype(np.uint8)
    sets = [set(jaccard.prefix(tokens, rank, o, 9, 10).tolist()) for o in range(jaccard.ORDERS)]
    assert all(len(a) == jaccard.prefix_length(len(tokens)) for a in sets)
    assert all(len(a & b) < 0.3 * len(a) for k, a in enumerate(sets) for b in sets[:k])


def test_one_of_each_keeps_rows_apart(spark):
    """Rows are told apart by id and text: neither repeated ids nor null ids nor repeated rows lose or keep a row too many."""
    a, b = "one two three four five six seven", "a text of its own that no other row is like at all"
    rows = [(5, b, "x"), (5, a, "y"), (3, a, "z"), (3, a, "z"), (None, a, "n"), (7, "", "e"), (7, "", "e"), (8, None, "e"), (None, "some other words that are found once here", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k string")
    got = sorted(map(tuple, jaccard.one_of_each(docs, Scratch(spark)).collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[5], rows[6], rows[7], rows[8]], key=str)


def test_jaccard_on_nothing(none):
    assert jaccard.components(none, Scratch(none.sparkSession)).count() == 0
    assert jaccard.one_of_each(none, Scratch(none.sparkSession)).columns == none.columns


def test_lines(docs, none, texts):
    out = lines.dedup(docs, Scratch(docs.sparkSession)).collect()
    kept = {r.doc_id: r.text for r in out if r.doc_id is not None}
    assert len(out) == len(texts) and kept[34].count("\n") == 1 and kept[35].count("\n") == kept[36].count("\n") == 0
    assert kept[30] and kept[31] == "" and kept[40] is None and kept[41] == "" and kept[43] == "A b"
    left = lines.without_repeated_lines(docs, Scratch(docs.sparkSession))
    assert left.columns == docs.columns and {40, 41, 42, 30} <= {r.doc_id for r in left.collect()} and not left.where("doc_id = 31").collect()
    assert lines.dedup(none, Scratch(none.sparkSession)).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("tau,most", [(1, 64), (2, 64), (3, 64), (2, 1), (3, 2)])
def test_edit_join_against_brute_force(spark, tau, most):
    r, every = random.Random(tau), set()
    for _ in range(40):
        s = [r.choice("abcdé ") for _ in range(r.randint(8, 24))]
        for _ in range(4):
            every.add("".join(s))
            at = r.randrange(len(s))
            s[at : at + 1] = r.choice([[], [r.choice("abc")], [s[at], "q"]])
    every = sorted(x for x in every if len(x) >= 8)
    root = {x: x for x in every}
    for a in every:
        for b in every:
            if a < b and edit_distance(a, b) <= tau:
                x, y = root[a], root[b]
                root = {k: y if v == x else v for k, v in root.items()}
    got = lines.linked_lines(spark.createDataFrame([(x,) for x in every], "line string").select(F.xxhash64("line").alias("h"), "line"), Scratch(spark), tau, 8, most)
    named = spark.createDataFrame([(x,) for x in every], "line string").join(got, F.xxhash64("line") == F.col("node"), "left").collect()
    classes, mine = {}, {}
    for x in every:
        classes.setdefault(root[x], set()).add(x)
    for row in named:
        mine.setdefault(row.root if row.root is not None else row.line, set()).add(row.line)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, mine.values()))


@pytest.mark.parametrize("digits", [3, 9])
def test_a_template_with_many_fillings(spark, digits, monkeypatch):
    """Dense (every number) and sparse (random ones): rows that meet stay linear in the lines, classes equal brute force."""
    r, n, met = random.Random(digits), 600, []
    fill = [f"{i:03d}" for i in range(n)] if digits == 3 else sorted({"".join(r.choice("abcdefgh") for _ in range(digits)) for _ in range(n)})
    every = [f"Dear reader, the parcel with number {x} has been sent to the address that we hold for you." for x in fill]
    real = lines._met
    monkeypatch.setattr(lines, "_met", lambda *a: met.append(real(*a)) or met[-1])
    own = spark.createDataFrame([(x,) for x in every], "line string").select(F.xxhash64("line").alias("h"), "line")
    got = {x.node: x.root for x in lines.linked_lines(own, Scratch(spark), 2, 20, 16).collect()}
    assert sum(seen["pairs"] + seen["hot"] for _, _, seen in met) < 120 * n
    number = {x.line: x.h for x in own.collect()}
    root = {x: x for x in every}
    for a, x in zip(every, fill, strict=True):
        for b, y in zip(every, fill, strict=True):
            if a < b and root[a] != root[b] and edit_distance(x, y) <= 2:
                one, two = root[a], root[b]
                root = {k: two if v == one else v for k, v in root.items()}
    classes, mine = {}, {}
    for x in every:
        classes.setdefault(root[x], set()).add(x)
        mine.setdefault(got.get(number[x], x), set()).add(x)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, mine.values()))


def test_short_and_blank_lines(spark):
    docs = spark.createDataFrame([(1, "Yes.\n\n   \nA line that is long enough to count"), (2, "Yes.\n\n   \nYess."), (2, "Yes.\n\n   \nYess."), (None, "Yes.")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r["__removed"]) for r in lines.dedup(docs, Scratch(spark)).collect()), key=str)
    assert got == sorted([(1, "Yes.\n\n   \nA line that is long enough to count", 0), (2, "\n   \nYess.", 1), (2, "\n   \nYess.", 1), (None, "", 1)], key=str)


def test_letter_counts_are_a_bound(spark):
    r = random.Random(7)
    rows = []
    for _ in range(300):
        a = "".join(r.choice("etgggppp zé") for _ in range(r.randint(1, 120)))
        b = a[: r.randrange(len(a) + 1)] + r.choice(["", "g", "ee", "x"]) + a[r.randrange(len(a)) :]
        rows.append((a, b, edit_distance(a, b)))
    x = spark.createDataFrame(rows, "a string, b string, d int").withColumns({"c": lines.letter_counts(F.col("a")), "e": lines.letter_counts(F.col("b"))})
    assert not x.where(lines.counts_differ("c", "e") > 2 * F.col("d")).collect()


def test_decontamination(spark, docs, none):
    r = random.Random(9)
    item = ["".join(r.choice("klmnop") for _ in range(5)) for _ in range(30)]
    edited = [w if i % 6 else "other" for i, w in enumerate(item)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "two words"), (None, "q w e r t y u i o p")], "item_id long, text string")
    more = spark.createDataFrame(make([(70, "before " * 50 + " ".join(item) + " after" * 40), (71, "Say: " + " ".join(edited).upper() + "."), (72, " ".join(item[:6]))]), SCHEMA)
    every = docs.unionByName(more)
    got = {(x.doc_id, x.item_id): x for x in decontaminate.overlaps(every, bench).collect()}
    assert set(got) == {(70, 1), (71, 1)} and got[70, 1].score == 1 and (got[70, 1].first_word, got[70, 1].end_word) == (50, 80)
    left = decontaminate.clean(every, bench)
    assert left.columns == every.columns and left.count() == every.count() - 2
    assert decontaminate.overlaps(none, bench).count() == 0 and decontaminate.overlaps(docs, bench.limit(0)).count() == 0


def test_alignment_against_the_plain_recurrence():
    import numpy as np

    r = np.random.default_rng(1)
    pairs = [(r.integers(2, 6, r.integers(3, 9)).astype(np.uint64), r.integers(2, 6, r.integers(1, 15)).astype(np.uint64)) for _ in range(60)]
    got = decontaminate.align([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), score in zip(pairs, got, strict=True):
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert h.max() == score


def test_spans_of_long_items():
    import numpy as np

    r = np.random.default_rng(2)
    item = r.integers(1, 1 << 40, 3000, dtype=np.uint64)
    window = np.concatenate([r.integers(1, 1 << 40, 500, dtype=np.uint64), item[100:1400], r.integers(1, 1 << 40, 3, dtype=np.uint64), item[1400:2900], r.integers(1, 1 << 40, 800, dtype=np.uint64)])
    assert decontaminate.span(item, window) == (500, 500 + 1300 + 3 + 1500)


def test_recall_over_edited_copies(spark):
    """Every pair that reaches the threshold by the plain recurrence, over random edits of items of 8 to 60 words."""
    import numpy as np

    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 5)))
    items = [[word() for _ in range(r.choice([8, 12, 20, 30, 60]))] for _ in range(40)]
    rows = []
    for i in range(160):
        own = list(items[i % 40])
        for _ in range(int(len(own) * r.choice([0, 0.1, 0.2, 0.3]))):
            k = r.randrange(len(own))
            own[k : k + 1] = r.choice([[], [word()], [own[k], word()]])
        rows.append((i, " ".join([word() for _ in range(r.randint(0, 200))] + own + [word() for _ in range(r.randint(0, 200))])))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    number = {}
    code = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws], dtype=np.uint64)
    want = {(i, k) for i, t in rows for k, item in enumerate(items) if decontaminate._best_end(code(item), code(t.split()))[0] >= len(item)}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 100


def test_items_of_one_or_two_words_and_rows_without_an_id(spark):
    bench = spark.createDataFrame([(1, "yes"), (2, "Not now."), (3, "one two three four five six seven eight")], "item_id short, text string")
    docs = spark.createDataFrame([(1, "Yes."), (2, "yes it is"), (None, "not, now"), (4, "not now then"), (None, "a b c one two three four five six seven eight d"), (None, "nothing"), (4, "one two three four five six seven eight")], "doc_id int, text string")
    assert sorted((str(x.doc_id), x.item_id, x.first_word) for x in decontaminate.overlaps(docs, bench).collect()) == [("1", 1, 0), ("4", 3, 0), ("None", 2, 0), ("None", 3, 3)]
    assert sorted((str(x.doc_id), x.text) for x in decontaminate.clean(docs, bench).collect()) == [("2", "yes it is"), ("4", "not now then"), ("None", "nothing")]


def test_mixing(spark, docs, none, labels):
    labelled = labels.selectExpr("doc_id", "concat('d', cast(quality as string)) AS domain")
    out = mixing.mixed(docs, labelled, {"d0": 0.3, "d1": 0.7}, Scratch(spark))
    rows = out.collect()
    assert len(rows) == docs.count() and min(r["__rate"] for r in rows) >= 0
    total = sum(r["__n"] for r in rows)
    for k, w in (("d0", 0.3), ("d1", 0.7)):
        assert sum(r["__rate"] * r["__n"] * r["__posterior"][k] for r in rows) == pytest.approx(w * total, abs=2e-4 * total)
    assert mixing.rates(none, labels).count() == 0
    assert {r.rate for r in mixing.rates(docs, labels.limit(0)).collect()} == {1.0}
    assert set(docs.columns) <= set(mixing.kept(docs, labels, Scratch(spark)).columns)


def test_rates_against_numpy(spark):
    import numpy as np

    r = np.random.default_rng(2)
    p = r.dirichlet([0.4] * 3, 50)
    n = r.integers(1, 90, 50)
    rows = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p, strict=True)], "n long, p0 double, p1 double, p2 double")
    want = np.array([0.5, 0.3, 0.2])
    full, rate = p.T @ n, np.ones(50)
    for _ in range(2000):
        rate = np.maximum(0, rate - p @ ((p.T @ (n * rate) - want * n.sum()) / full))
    got = mixing.solve(rows, list(want)).collect()
    have = np.array([x.rate * x.n for x in got]) @ np.array([[x.p0, x.p1, x.p2] for x in got])
    assert np.abs(have - p.T @ (n * rate)).max() < 1e-3 * n.sum()


def test_targets_out_of_reach_are_met_as_well_as_rates_can(spark):
    rows = spark.createDataFrame([(10, 0.9, 0.1), (20, 0.7, 0.3)], "n long, p0 double, p1 double")
    with pytest.warns(UserWarning, match="off their target"):
        got = mixing.solve(rows, [0.0, 1.0]).collect()
    assert all(x.rate >= 0 for x in got) and sum(x.rate * x.n for x in got) < 30


def test_posteriors_are_calibrated_and_use_all_words(spark):
    r = random.Random(1)
    text = lambda d, n: " ".join(r.choice("abcdefgh") if r.random() < 0.9 else r.choice("xy" if d else "zw") for _ in range(n))
    rows = [(i, text(i % 2, 30), i % 2) for i in range(800)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1, "z " * 5), (5000, text(0, 30).replace("z", "a").replace("w", "b") + " a b c d e f g h" * 200 + " x y" * 100)], "doc_id long, text string")
    out = mixing.mixed(docs, spark.createDataFrame([(i, f"d{d}") for i, _, d in rows], "doc_id long, domain string"), None, Scratch(spark)).collect()
    sure = [(x["__posterior"][f"d{x.doc_id % 2}"], max(x["__posterior"].values())) for x in out if x.doc_id < 800]
    right = sum(p >= 0.5 for p, _ in sure) / len(sure)
    assert abs(right - sum(m for _, m in sure) / len(sure)) < 0.05  # mean confidence is the share of right answers
    assert next(x["__posterior"]["d1"] for x in out if x.doc_id == 5000) > 0.9  # the last words of a long text


def test_language_model(docs, none, texts):
    import math
    import zlib
    from collections import Counter

    rows = rnnlm.scored(docs, Scratch(docs.sparkSession)).collect()
    counts, split = Counter(), lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    for i, t in texts:
        if not held(i):
            counts.update(split(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(split(t)), sum(counts[w] > 0 for w in split(t)), round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split(t)), 5)) for i, t in texts)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 5)) for r in rows) == want
    assert {r.train_tokens for r in rows} == {n} and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert rnnlm.scored(none, Scratch(none.sparkSession)).count() == 0


def test_rare_words_are_joined(docs, monkeypatch):
    whole = {(r.doc_id, r.n_tokens): (r.n_known, round(r.base_score, 4)) for r in rnnlm.scored(docs, Scratch(docs.sparkSession)).collect()}
    monkeypatch.setattr(rnnlm, "MID", 5)
    assert whole == {(r.doc_id, r.n_tokens): (r.n_known, round(r.base_score, 4)) for r in rnnlm.scored(docs, Scratch(docs.sparkSession)).collect()}


def test_gradients():
    import numpy as np

    r = np.random.default_rng(3)
    p = {k: v.astype(np.float64) for k, v in rnnlm.new_model(np.arange(300, 0, -1.0), 50.0).items()}
    inputs, targets = r.integers(0, 300, (3, 2)), r.integers(0, 300, (3, 2))

    def loss(q):
        h, states = np.zeros((2, rnnlm.STATE)), []
        for t in range(3):
            h = rnnlm._step(q, q["embed"][inputs[t]] @ q["wx"] + q["b"], h)[0]
            states.append(h)
        return -rnnlm.log_probability(q, np.concatenate(states), targets.ravel()).mean()

    trainer, kept = rnnlm.Trainer(p), {}
    real = np.zeros_like
    trainer.window(inputs, targets, np.zeros((2, rnnlm.STATE)))
    for name, at in (("u", (3, 5)), ("wx", (2, 70)), ("embed", (int(inputs[0, 0]), 1)), ("class_w", (4, 0)), ("word_w", (0, 3, 2))):
        for sign in (1, -1):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += sign * 1e-5
            kept[sign] = loss(q)
        slope = (kept[1] - kept[-1]) / 2e-5
        assert real is np.zeros_like and trainer.m[name][at] == pytest.approx(0.1 * slope * min(1.0, 1.0), rel=1e-2, abs=1e-6)
