"""Work that is done once, and arithmetic that must not lose rows for it."""

from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tessel.llm import rnnlm, warc


def test_scoring_takes_the_numbers_that_training_took(monkeypatch):
    monkeypatch.setattr(rnnlm, "CHUNK", 40)
    texts = [" ".join(f"w{(i * k) % 11}" for k in range(i)) for i in (30, 0, 7, 45, 12)]
    known, counts = {f"w{i}".encode(): i for i in range(1, 9)}, np.array([5.0, *range(30, 22, -1)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array([x.encode() for x in texts], pa.binary())], names=["row", "b"])
    made = next(rnnlm._texts(iter([batch]), SimpleNamespace(value=known), SimpleNamespace(value=np.log10(counts + 0.1).tobytes())))
    assert made.column("n_tokens").to_pylist() == [len(x.split()) + 1 for x in texts]
    assert made.column("n_tail").to_pylist() == [sum(w.encode() not in known for w in x.split()) for x in texts]
    p = rnnlm.new_model(counts, 1.0)
    out = list(rnnlm._score(iter([made.select(["row", "tokens"])]), SimpleNamespace(value=rnnlm.pack(p).tobytes())))
    assert len(out) > 1 and [i for b in out for i in b.column("row").to_pylist()] == list(range(5))
    got = [x for b in out for x in b.column("network").to_pylist()]
    numbers = [np.frombuffer(x, "<i2").astype(np.int32) for x in made.column("tokens").to_pylist()]
    assert np.allclose(got, [rnnlm.score_texts(p, p["embed"] @ p["wx"] + p["b"], [x])[0] for x in numbers], rtol=1e-4)


def test_rows_far_below_the_others_keep_their_shares():
    x = np.array([[500.0, 499.0], [-500.0, -499.0], [0.0, 0.0]], np.float32)
    want = [np.log(1 / (1 + np.exp(-1.0))), np.log(1 / (1 + np.exp(1.0))), np.log(0.5)]
    assert np.allclose(rnnlm._softmax(x, np.zeros(3, int))[1], want, atol=1e-5)


def test_derived_records_take_one_python_worker_a_task(spark, capsys):
    rows = [(1, "http://a.example/", "<p>one</p>"), (2, None, None), (None, "http://b.example/x", "<h1>two</h1><p>three</p>"), (1, "http://a.example/", "<p>one</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(warc.derive_pages(pages)) == key(warc.derive(warc.responses(pages))) and warc.derive_pages(pages.limit(0)).count() == 0
    warc.derived_digests(pages).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1


def test_texts_are_numbered_many_at_a_time(monkeypatch):
    """One look-up for all texts of a portion; portions of any size give the same rows, rare and missing words, null and empty texts included."""
    r = np.random.default_rng(4)
    texts = [None, b"", b" \t ", *(" ".join(f"W{k}" for k in r.integers(0, 30, n)).encode() for n in r.integers(0, 40, 200)), b"x y x", None]
    known, counts = {f"w{i}".encode(): i for i in range(1, 20)}, np.array([5.0, *range(30, 12, -1), 0.0])
    calls, real, head = [], rnnlm.numbers, 9

    def numbers(words, known):
        calls.append(len(words))
        return real(words, known)

    monkeypatch.setattr(rnnlm, "numbers", numbers)
    monkeypatch.setattr(rnnlm, "HEAD", head)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], names=["row", "b"])
    run = lambda: pa.Table.from_batches(rnnlm._texts(iter([batch, batch.slice(0, 0)]), SimpleNamespace(value=known), SimpleNamespace(value=np.log10(counts + 0.1).tobytes()))).to_pylist()
    rows = run()
    assert len(calls) == 1
    logs = np.log10(counts + 0.1)
    for text, row in zip(texts, rows, strict=True):
        words = rnnlm.tokens(text)
        own = [known.get(w, -1) for w in words]
        assert np.frombuffer(row["tokens"], "<i2").tolist() == [rnnlm.TAIL if x < 0 or x >= head else x for x in own] + [rnnlm.END]
        assert (row["n_tokens"], row["n_known"], row["n_tail"]) == (len(own) + 1, 1 + sum(0 < x < 19 for x in own), sum(x < 0 or x >= head for x in own))
        assert np.isclose(row["logs"], sum(logs[x] for x in [*own, 0] if x >= 0)) and np.isclose(row["tail_logs"], sum(logs[x] for x in own if x >= head))
        assert dict(zip(row["words"], row["times"], strict=True)) == Counter(w for w in words if w not in known)
    monkeypatch.setattr(rnnlm, "PORTION", 100)
    assert [(x["tokens"], x["n_known"], x["words"]) for x in run()] == [(x["tokens"], x["n_known"], x["words"]) for x in rows] and len(calls) > 10


def test_softmaxes_in_blocks_are_those_of_all_rows_at_once(monkeypatch):
    r = np.random.default_rng(6)
    p = {k: v.astype(np.float64) for k, v in rnnlm.new_model(np.arange(300, 0, -1.0), 50.0).items()}
    inputs, targets = r.integers(1, 300, (4, 30)), r.choice([-1, 0, 1, 2, 64, 130, 299, rnnlm.TAIL], (4, 30))
    done = []
    for rows in (7, 512):
        monkeypatch.setattr(rnnlm, "BLOCK", rows)
        trainer = rnnlm.Trainer(p)
        loss, h = trainer.window(inputs, targets, np.zeros((30, rnnlm.STATE)))
        own = rnnlm.log_probability(p, r.standard_normal((120, rnnlm.STATE)) * 0 + h[0], np.where(targets < 0, 0, targets).ravel())
        done.append((loss, trainer.flat[2].copy(), own))
    assert all(np.allclose(a, b, rtol=1e-9, atol=1e-12) for a, b in zip(*done, strict=True)) and np.abs(done[0][1]).max() > 0


def test_gates_of_large_sums_are_closed_or_open():
    p = {"u": np.zeros((rnnlm.STATE, 3 * rnnlm.STATE), np.float32)}
    sums, h = np.linspace(-300, 300, 3 * rnnlm.STATE * 2, dtype=np.float32).reshape(2, -1), np.full((2, rnnlm.STATE), 0.5, np.float32)
    rz, n, out = (np.empty((k * rnnlm.STATE, 2), np.float32) for k in (2, 1, 1))
    with np.errstate(over="ignore"):
        rnnlm._advance(rnnlm._turned(sums).T, np.zeros((3 * rnnlm.STATE, 2), np.float32), h.T, rz, n, out)
    assert np.allclose(out.T, rnnlm._step(p, sums, h)[0], atol=1e-6)
