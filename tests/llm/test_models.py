"""Held-out quality of the trained models, and the effect of swapped identity terms."""

import random

import pytest

from tessel.llm import suffix, toxicity
from tessel.llm.common import Scratch, connected, table

SF = "/root/testdata/sf0.01"


def test_held_out_toxicity(spark):
    rows = toxicity.scored(table(spark, SF, "documents"), table(spark, SF, "labels")).join(table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.93
    assert sum(r.predicted and not r.toxic for r in rows) <= 2


def test_identity_mentions_weigh_less_with_the_penalty():
    r, texts, labels = random.Random(4), [], []
    plain = "we walked home slowly after lunch with many good friends today".split()
    for i in range(600):
        words = r.sample(plain, 6)
        bad = i % 3 == 0
        if bad:
            words.append(r.choice(["idiot", "scum", "trash"]))
        if r.random() < (0.7 if bad else 0.05):
            words.append(r.choice(["muslims", "women", "jews"]))
        texts.append(" ".join(words) + ".")
        labels.append(int(bad))
    free, shipped, held = (toxicity.fit(texts, labels, penalty=x) for x in (0.0, toxicity.PENALTY, 20.0))
    neutral = "we had lunch with muslims and women today"
    assert held.score(neutral) < free.score(neutral) and held.score("you idiot scum") > 0.5
    assert shipped.score(neutral) < 0.5 * free.score(neutral) and shipped.score("you idiot scum") > 0.5


def test_repeated_ids_train_once(spark):
    r = random.Random(3)
    say = lambda bad: " ".join(r.choice("lunch walked friends today morning garden".split()) for _ in range(6)) + (" idiot scum" if bad else "")
    rows = [(i, say(i % 3 == 0)) for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    once = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    again = toxicity.learn(spark.createDataFrame(rows + [(1, "zzz " + t) for _, t in rows], "doc_id long, text string"), labels.unionByName(labels))
    assert once.weights and once.weights == pytest.approx(again.weights)


def test_deep_shallow_order():
    r = random.Random(6)
    for _ in range(60):
        s = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 90))) for _ in range(r.randint(0, 70))]
        s += s[: len(s) // 3]
        order, lcp = suffix.deep_shallow(s)
        assert [s[i] for i in order] == sorted(s)
        assert all(lcp[j] == suffix._common(s[order[j - 1]], s[order[j]]) for j in range(1, len(s)))


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (3, 4), (9, 8), (5, 5), (7, 6), (6, 9), (1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)]])
def test_components(spark, edges):
    roots = {r.node: r.root for r in connected(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()}
    want = {n: n for e in edges for n in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert {k: v for k, v in roots.items()} == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}
