"""The pipeline's stages, each against a brute-force version on the stage's own input."""

import random
import sys

import pytest
from test_documents import brute_components, edit_distance

sys.path[:0] = ["/root/repo"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, out = random.Random(8), tmp_path_factory.mktemp("sf")
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    say = lambda n: " ".join(word() for _ in range(n))
    item, line, base = say(24), say(9), say(80)
    rows = [(i, say(r.randint(12, 40)) + "\n" + say(8) + (" idiot scum trash" if i % 4 == 0 else "")) for i in range(60)]
    rows += [(70, base), (71, base + " more"), (72, base), (73, say(10) + "\n" + line), (74, line + "\n" + say(10)), (75, line[:-2] + "\n" + say(10)), (76, say(30) + " " + item + " " + say(30)), (77, None), (78, ""), (79, base.replace(" ", "\n", 1))]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def brute_lines(rows, tau=2, shortest=20):
    places = [(i, n, x) for i, t in sorted(rows) if t is not None for n, x in enumerate(t.split("\n")) if x.strip()]
    root = {x: x for _, _, x in places}
    for a in list(root):
        for b in list(root):
            if a < b and min(len(a), len(b)) >= shortest and abs(len(a) - len(b)) <= tau and edit_distance(a, b) <= tau:
                x, y = root[a], root[b]
                root = {k: y if v == x else v for k, v in root.items()}
    seen, gone = set(), set()
    for i, n, x in places:
        if root[x] in seen:
            gone.add((i, n))
        seen.add(root[x])
    out = []
    for i, t in rows:
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
        if kept is None or kept.strip() or kept == t:
            out.append((i, kept))
    return out


def brute_overlap(text, item):
    a, b = item.split(), (text or "").split()
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if a[i] == b[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h)) / (2 * len(a))


def test_stages_and_run(spark, folder):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    item = spark.read.parquet(f"{folder}/benchmark.parquet").where("text is not null").first().text
    inputs, results = [], []
    for _, stage in P.STAGES:
        inputs.append(sorted(((r.doc_id, r.text) for r in docs.collect())))
        docs = stage(spark, docs, folder).cache()
        results.append(docs)
        if stage is not P.STAGES[-1][1]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = [sorted((r.doc_id, r.text) for r in x.collect()) for x in results]
    assert not {i for i, _ in kept[0]} & {i for i in range(60) if i % 4 == 0} and len(kept[0]) == 55
    assert kept[1] == sorted(brute_lines(inputs[1]), key=str) or dict(kept[1]) == dict(brute_lines(inputs[1]))
    assert {r.doc_id: r.n_chars for r in results[1].collect()} == {i: len(t or "") for i, t in kept[1]}
    named = {i: c for i, _, c in brute_components(inputs[2], 5, 4, 5)}
    assert dict(kept[2]) == {i: t for i, t in inputs[2] if named[i] == i}
    assert dict(kept[3]) == {i: t for i, t in inputs[3] if brute_overlap(t, item) < 0.5} and 76 not in dict(kept[3])
    last = results[4].collect()
    assert {r.doc_id for r in last} == set(dict(kept[3])) and all(r.mix_rate > 0 for r in last)
    once = sorted(tuple(r) for r in P.run(spark, folder).drop("mix_rate").collect())
    assert once == sorted(tuple(r) for r in results[4].drop("mix_rate").collect())


def test_stages_on_clashing_columns_nulls_and_no_rows(spark, folder):
    import corpus_pipeline as P

    names = "removed string, mix_rate double, mix_domain string, root long, node long, h long, k string, star boolean, rate double"
    more = ("r", 0.5, "m", 1, 2, 3, "k", True, 0.25)
    a, b = "some words that are said once and then once again here", "another text with words that nobody else has ever used"
    rows = [(1, a, None, "s", None), (1, b, "en", None, 3), (1, a, None, "s", None), (None, a, "en", "s", 1), (None, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n ", "en", "s", 0), (4, "word " * 30_000, "en", "s", 1)]
    docs = spark.createDataFrame([(*x, *more) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, " + names)
    for docs_now, n in ((docs, 7), (docs.limit(0), 0)):
        for _, stage in P.STAGES:
            columns = docs_now.columns
            docs_now = stage(spark, docs_now, folder).cache()
            assert docs_now.columns[: len(columns)] == columns or stage is P.STAGES[-1][1] and set(columns) <= set(docs_now.columns)
        kept = sorted(map(str, ((r.doc_id, (r.text or "")[:20]) for r in docs_now.collect())))
        assert docs_now.count() <= n and (not n or str((1, a[:20])) in kept and str((1, b[:20])) in kept and str((None, a[:20])) not in kept and str((None, "")) in kept)
