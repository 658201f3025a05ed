"""That operators do their whole job: nothing of the input is left out."""

from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tessel.llm import decontaminate, html, rnnlm


def test_every_token_is_trained_on_with_the_state_carried():
    r = np.random.default_rng(5)
    documents = [r.integers(1, 9, n).tolist() for n in (700, 90, 3, 0, 411, 48, 49)]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 7, pa.int32()), pa.array(range(7), pa.int64()), pa.array([" ".join(f"w{x}" for x in d).encode() for d in documents], pa.binary())], names=["shard", "place", "b"])
    made = next(rnnlm._texts(iter([batch]), SimpleNamespace(value={f"w{i}".encode(): i for i in range(1, 9)})))
    trainer = rnnlm.Trainer(rnnlm.new_model(np.arange(9, 0, -1.0), 1.0))
    pairs, carried, real = Counter(), [], trainer.window

    def window(inputs, targets, h):
        have = targets >= 0
        pairs.update(zip(inputs[have].tolist(), targets[have].tolist(), strict=True))
        carried.append(h)
        out = real(inputs, targets, h)
        carried.append(out[1])
        return out

    trainer.window = window
    trainer.run([np.frombuffer(x, dtype="<i2") for x in made.column("tokens").to_pylist()])
    want = Counter(p for d in documents for p in zip([rnnlm.START, *d], [*d, rnnlm.END], strict=True))
    passes = pairs.total() // want.total()
    assert passes and pairs == Counter({k: v * passes for k, v in want.items()})
    assert sum(a is b for a, b in zip(carried[1::2], carried[2::2], strict=False)) == len(carried) // 2 - passes  # anew in each pass only


@pytest.mark.parametrize("counts", [[], [1] * 9, [5] * 9, list(range(1, 4000)), [1] * 50 + [2] * 5 + [10**9, 10**9 + 1, 3 * 10**11]])
def test_the_count_that_bounds_the_words(spark, counts):
    table = spark.createDataFrame([(c,) for c in counts], "c long")
    for bound in (0, 3, 8, 9, 60, 5000):
        least = rnnlm.least_count(table, max(counts, default=0), bound, 16)
        assert sum(c >= least for c in counts) <= bound and (least == 1 or sum(c >= least - 1 for c in counts) > bound)


def test_score_beats_the_base_on_held_out_text(spark):
    """Text with word order to learn: a first-order chain. The margin asked for is 0.1 log10 a token."""
    import random

    from tessel.llm.common import Scratch

    r = random.Random(1)
    after = {i: [r.randrange(60) for _ in range(4)] for i in range(60)}

    def text():
        at, out = r.randrange(60), []
        for _ in range(r.randint(5, 60)):
            out.append(f"w{at}")
            at = r.choice(after[at])
        return " ".join(out)

    rows = rnnlm.scored(spark.createDataFrame([(i, text()) for i in range(600)], "doc_id long, text string"), Scratch(spark)).where("held_out").collect()
    assert sum(x.score - x.base_score for x in rows) / sum(x.n_tokens for x in rows) > 0.1


def test_scores_are_those_of_one_text_at_a_time():
    r = np.random.default_rng(8)
    p = rnnlm.new_model(np.arange(300, 0, -1.0), 50.0)
    texts = [np.append(r.integers(1, 300, n), 0).astype(np.int32) for n in (0, 3, 700, 40, 41)]
    table = p["embed"] @ p["wx"] + p["b"]
    for x, got in zip(texts, rnnlm.score_texts(p, table, texts), strict=True):
        h, total = np.zeros((1, rnnlm.STATE), np.float32), 0.0
        for before, target in zip([rnnlm.START, *x[:-1]], x, strict=True):
            h = rnnlm._step(p, table[[before]], h)[0]
            total += float(rnnlm.log_probability(p, h, np.array([target]))[0])
        assert got == pytest.approx(total / np.log(10), rel=1e-4)


def test_gradients_stop_at_the_start_of_a_document():
    r = np.random.default_rng(3)
    p = {k: v.astype(np.float64) for k, v in rnnlm.new_model(np.arange(300, 0, -1.0), 50.0).items()}
    inputs, targets = r.integers(1, 300, (4, 2)), r.integers(0, 300, (4, 2))
    inputs[2, 0] = rnnlm.START
    before = r.standard_normal((2, rnnlm.STATE))

    def loss(q):
        h, states = before, []
        for t in range(4):
            h = rnnlm._step(q, q["embed"][inputs[t]] @ q["wx"] + q["b"], np.where((inputs[t] == rnnlm.START)[:, None], 0, h))[0]
            states.append(h)
        return -rnnlm.log_probability(q, np.concatenate(states), targets.ravel()).mean()

    trainer = rnnlm.Trainer(p)
    got, _ = trainer.window(inputs, targets, before)
    assert got == pytest.approx(loss(p))
    for name, at in (("u", (3, 5)), ("wx", (2, 70)), ("embed", (int(inputs[1, 0]), 1))):
        kept = []
        for sign in (1, -1):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += sign * 1e-5
            kept.append(loss(q))
        assert trainer.m[name][at] == pytest.approx(0.1 * (kept[0] - kept[1]) / 2e-5, rel=1e-2, abs=1e-6)


def test_a_short_item_with_one_seed_left_is_aligned(spark):
    item = [f"word{i}" for i in range(12)]
    copy = [f"other{i}" if i in (2, 5, 8) else w for i, w in enumerate(item)]
    docs = spark.createDataFrame([(1, "before it " + " ".join(copy) + " after it"), (2, "nothing of the kind is here")], "doc_id long, text string")
    found = decontaminate.overlaps(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.score) for r in found] == [(1, 7, 0.625)]


def test_long_blocks_of_middling_stop_words_follow_their_neighbours():
    plain = "The house by the river was old and it had been there for as long as we could remember. " * 3
    linked = 'Some <a href="/x">harvest figures</a> of northern valley farms show that grain prices rose sharply during dry summers, ' + "while the wool trade with coastal towns fell slowly and many mills closed. " * 2
    listed = "Copper kettles, iron pans, glass bowls, wooden spoons, linen towels, paper lanterns, candles, matches. " * 3  # no stop words
    text = html.main_text(f"<body><div>{plain}</div><div>{linked}</div><div>{plain}</div><div>{listed}</div></body>")
    assert "harvest figures" in text and "kettles" not in text
