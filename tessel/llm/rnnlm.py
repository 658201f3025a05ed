"""LM scoring with a gated recurrent network, in numpy.

Counts. Word counts cover all training documents. A count threshold bounds the words that every task receives to MID; the
commonest HEAD - 1 of them and the end token are the network's vocabulary, all others share the tail class. A rarer word's
count is joined by word, so no count is left out, whatever the vocabulary's size.

Model. A GRU reads the previous token; the next one's probability is P(class | state) * P(word | class, state), classes
being runs of WORDS words by frequency. A tail word's share within its class is (c + 0.1) / (N_tail + 0.1 * (V_tail + 1)).
Output biases start at the logarithms of the counts.

Training. All tokens of all training documents are trained on, once in large tables. The documents are dealt by hash into
shards of about SHARD documents (fewer if they are long) and each shard's into ROUNDS parts; in each round every shard starts
from the shared parameters, takes Adam steps on the round's part and the shards' parameters are averaged (by blocks, in two
levels). A part's documents are dealt to lanes that advance together by truncated backpropagation over windows of WINDOW
tokens; the state is carried from window to window through the whole document and cleared at the next one's start. Small
parts are passed over again until there are LEAST_UPDATES.

Scoring. The documents of a chunk are dealt to lanes that advance together. The state is carried through the whole
document and cleared at the next one's start; each token of each document adds to its log10 probability.

Null or empty texts are one end token. Ids may be null or repeated: each row is scored for itself. Without training
documents all counts are 0. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_mod

HEAD, WORDS, MID, EMBED, STATE = 4096, 64, 1 << 17, 24, 32
WINDOW, LANES, SHARD, ROUNDS, LEAST_UPDATES, RATE = 16, 256, 16384, 2, 300, 0.004
SHARD_TOKENS = 1 << 23  # what a task holds, at 2 bytes each
CHUNK, SCORE_LANES, FLUSH = 1_500_000, 256, 400_000
PORTION = 1 << 18  # bytes of texts that are split into words at a time, unless one text has more
BLOCK = 512  # rows of softmax scores that are worked on while the processor's cache holds them
CLASSES = HEAD // WORDS
END, TAIL, START = 0, HEAD, HEAD + 1
_NAMES = ("embed", "wx", "u", "b", "class", "word")


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes: A-Z and the six ASCII white-space characters only


def numbers(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Numbers of words; -1 for others."""
    return np.fromiter(map(known.get, words, repeat(-1)), dtype=np.int32, count=len(words))


# ---------------------------------------------------------------- the network


def new_model(counts: np.ndarray, tail: float) -> dict[str, np.ndarray]:
    """counts: of the end token and the head words by frequency; tail: of all other words together."""
    r = np.random.default_rng(7)
    full = np.zeros(HEAD)
    full[: len(counts)] = counts + 0.1
    by_class = full.reshape(CLASSES, WORDS)
    share = np.append(by_class.sum(axis=1), tail + 0.1)
    with np.errstate(divide="ignore"):
        class_b, word_b = np.log(share / share.sum()), np.log(by_class / np.maximum(by_class.sum(axis=1, keepdims=True), 1e-30))
    draw = lambda *shape: (r.standard_normal(shape) / math.sqrt(shape[0])).astype(np.float32)
    return {
        "embed": (0.3 * r.standard_normal((HEAD + 2, EMBED))).astype(np.float32), "wx": draw(EMBED, 3 * STATE), "u": draw(STATE, 3 * STATE), "b": np.zeros(3 * STATE, np.float32),
        "class_w": 0.1 * draw(STATE, CLASSES + 1), "class_b": np.maximum(class_b, -40).astype(np.float32),
        "word_w": 0.1 * draw(CLASSES * STATE, WORDS).reshape(CLASSES, STATE, WORDS), "word_b": np.maximum(word_b, -40).astype(np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _softmax(x: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows' exponentials, less a number where they need it, in place of x; their sums, the logarithm of each row's share at one column, and that
    column's place in x."""
    top, low = x.max(initial=-np.inf), x.min(initial=np.inf)
    if top > 60 or low < -60:
        x -= x.max(axis=1, keepdims=True) if top - low > 80 else top  # one number for all rows would leave some of them nothing
    at = np.arange(0, x.size, x.shape[1])
    at += columns
    own = x.ravel().take(at)
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    own -= np.log(total)
    return total, own, at


def _loss_and_slope(x: np.ndarray, columns: np.ndarray, scale: np.float32) -> float:
    """The loss of softmax rows at one column each; its slope by the scores times scale, in place of x (whose rows follow each other in memory)."""
    total, own, at = _softmax(x, columns)
    x *= (scale / total)[:, None]
    x.reshape(-1)[at] -= scale
    return -float(own.sum())


def _blocks(classes: np.ndarray) -> list[list[tuple[int, slice]]]:
    """Classes in order, cut into runs of one class; the runs of a block have at most BLOCK rows together."""
    made, left = [], 0
    ends = np.searchsorted(classes, np.arange(CLASSES + 1)).tolist()
    for c in range(CLASSES):
        at = ends[c]
        while at < ends[c + 1]:
            if not left:
                made.append([])
                left = BLOCK
            n = min(left, ends[c + 1] - at)
            made[-1].append((c, slice(at, at + n)))
            at, left = at + n, left - n
    return made


def _whole(p: dict[str, np.ndarray], kind: str) -> np.ndarray:
    """A softmax's weights with the biases as the last row, for states that end with a one."""
    return np.concatenate([p[f"{kind}_w"], p[f"{kind}_b"][..., None, :]], axis=-2)


def log_probability(p: dict[str, np.ndarray], states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural logarithm of each target's probability after its state; a tail token's is that of the class."""
    classes = targets // WORDS  # TAIL is number CLASSES
    order = np.argsort(classes.astype(np.uint8), kind="stable")
    classes, columns, s = classes[order], targets[order] % WORDS, np.ones((len(order), STATE + 1), states.dtype)
    s[:, :STATE] = states.take(order, axis=0)
    class_w, word_w, by_class = _whole(p, "class"), _whole(p, "word"), np.empty(len(order), s.dtype)
    for at in range(0, len(s), BLOCK):
        by_class[at : at + BLOCK] = _softmax(s[at : at + BLOCK] @ class_w, classes[at : at + BLOCK])[1]
    room = np.empty((BLOCK, WORDS), s.dtype)
    for block in _blocks(classes):
        first, end = block[0][1].start, block[-1][1].stop
        for c, at in block:
            np.matmul(s[at], word_w[c], out=room[at.start - first : at.stop - first])
        by_class[first:end] += _softmax(room[: end - first], columns[first:end])[1]
    out = np.empty_like(by_class)
    out[order] = by_class
    return out


def _step(p: dict[str, np.ndarray], gx: np.ndarray, h: np.ndarray) -> tuple:
    gh = h @ p["u"]
    rz = _sigmoid(gx[:, : 2 * STATE] + gh[:, : 2 * STATE])
    r, z = rz[:, :STATE], rz[:, STATE:]
    n = np.tanh(gx[:, 2 * STATE :] + r * gh[:, 2 * STATE :])
    return n + z * (h - n), r, z, n, gh[:, 2 * STATE :]


def _turned(x: np.ndarray) -> np.ndarray:
    """What is added up for the exponentials of _advance: a gate's sum by -1, n's by 2."""
    out = 2 * x
    out[..., : 2 * STATE] *= -0.5
    return out


def _advance(gx: np.ndarray, gh: np.ndarray, h: np.ndarray, rz: np.ndarray, n: np.ndarray, out: np.ndarray) -> None:
    """_step for turned sums whose columns are the lanes, so that each part is one piece of memory; fills rz, n and out. A gate is 1 / (1 + exp(-x)),
    tanh(x) is 1 - 2 / (1 + exp(2x)); both are right where exp is infinite."""
    np.add(gx[: 2 * STATE], gh[: 2 * STATE], out=rz)
    np.exp(rz, out=rz)
    rz += 1
    np.reciprocal(rz, out=rz)
    np.multiply(rz[:STATE], gh[2 * STATE :], out=n)
    n += gx[2 * STATE :]
    np.exp(n, out=n)
    n += 1
    np.divide(-2, n, out=n)
    n += 1
    np.subtract(h, n, out=out)
    out *= rz[STATE:]
    out += n


class Trainer:
    """Parameters, gradients and Adam's moments as one array each, seen through p, g and m by name; updates allocate nothing."""

    def __init__(self, p: dict[str, np.ndarray]):
        whole = pack(p)
        self.flat = [whole, *(np.zeros_like(whole) for _ in range(3))]
        self.p, self.g, self.m, _ = (unpack(x, copy=False) for x in self.flat)
        self.t, self.rooms = 0, {}

    def _adam(self) -> None:
        kind = self.flat[0].dtype.type
        clip = kind(0.1 * min(1.0, 1.0 / max(math.sqrt(float(np.dot(self.flat[1], self.flat[1]))), 1e-12)))
        self.t += 1
        # v is ten times Adam's, as it is made of the tenths of slopes that m takes; the root of ten is in rate and in what keeps the quotient finite
        rate, least = kind(math.sqrt(10) * RATE * math.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)), kind(math.sqrt(10) * 1e-8)
        for at in range(0, len(self.flat[0]), 1 << 13):  # runs that stay in the processor's cache
            p, g, m, v = (x[at : at + (1 << 13)] for x in self.flat)
            g *= clip
            m *= kind(0.9)
            m += g
            v *= kind(0.999)
            g *= g
            v += g
            np.sqrt(v, out=g)
            g += least
            np.divide(m, g, out=g)
            g *= rate
            p -= g

    def _room(self, steps: int, lanes: int, kind: np.dtype) -> list[np.ndarray]:
        """Arrays for a window, made once: by steps, numbers and lanes, then by tokens, then for a block; the first's and the states' last number is one."""
        if (steps, lanes) not in self.rooms:
            by_step = [np.empty((steps, n, lanes), kind) for n in (STATE + EMBED + 1, 3 * STATE, STATE, 2 * STATE, STATE, 3 * STATE, 4 * STATE, STATE, STATE, STATE)]
            by_step[0][:, -1] = 1
            by_token = [np.ones((steps * lanes, n), kind) for n in (STATE + 1, STATE + 1, STATE, STATE)]
            self.rooms = {(steps, lanes): [*by_step, *by_token, *(np.empty((BLOCK, n), kind) for n in (CLASSES + 1, WORDS, STATE))]}
        return self.rooms[steps, lanes]

    def _softmaxes(self, s: np.ndarray, y: np.ndarray, scale: np.float32, ds: np.ndarray, rooms: list[np.ndarray]) -> float:
        """The loss of targets y (by class, the tail's last) after the states s; fills the softmax weights' gradients and ds, the slopes of s."""
        p, g, classes, columns, loss, last = self.p, self.g, y // WORDS, y % WORDS, 0.0, -1
        for at in range(0, len(y), BLOCK):
            own = s[at : at + BLOCK]
            d = np.matmul(own, p["class"], out=rooms[0][: len(own)])
            loss += _loss_and_slope(d, classes[at : at + BLOCK], scale)
            g["class"] += own.T @ d
            np.matmul(d, p["class_w"].T, out=ds[at : at + BLOCK])
        words, word_w, slopes = p["word"], p["word_w"].transpose(0, 2, 1), g["word"]
        for block in _blocks(classes):  # without the tail's
            first, end = block[0][1].start, block[-1][1].stop
            d, back = rooms[1][: end - first], rooms[2][: end - first]
            runs = [(c, s[at], d[at.start - first : at.stop - first], back[at.start - first : at.stop - first]) for c, at in block]
            for c, own, x, _ in runs:
                np.matmul(own, words[c], out=x)
            loss += _loss_and_slope(d, columns[first:end], scale)
            for c, own, x, out in runs:
                if c == last:  # began in the block before
                    slopes[c] += own.T @ x
                else:
                    np.matmul(own.T, x, out=slopes[c])
                np.matmul(x, word_w[c], out=out)
                last = c
            ds[first:end] += back
        return loss

    def window(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """One update from steps x lanes of tokens (targets -1: none; START clears the state); returns the loss a token and the state to carry."""
        p, g, (steps, lanes) = self.p, self.g, inputs.shape
        both, gx, states, rz, n, gh, dg, by_n, by_z, by_r, flat, s, ds, dflat, *rooms = self._room(steps, lanes, self.flat[0].dtype)
        before, x = both[:, :STATE], both[:, STATE:]  # x: with the ones
        ids = inputs.ravel()
        x[:, :EMBED] = p["embed"].take(ids, axis=0).reshape(steps, lanes, EMBED).transpose(0, 2, 1)
        np.matmul(_turned(np.concatenate([p["wx"], p["b"][None]])).T, x, out=gx)
        going = inputs != START  # the state before a START is not its document's
        whole = going.all(axis=1)
        u, h = np.ascontiguousarray(_turned(p["u"]).T), h.T
        with np.errstate(over="ignore"):
            for t in range(steps):
                np.multiply(h, going[t], out=before[t]) if not whole[t] else np.copyto(before[t], h)
                np.matmul(u, before[t], out=gh[t])
                _advance(gx[t], gh[t], before[t], rz[t], n[t], states[t])
                h = states[t]
        h = np.array(h.T)
        self.flat[1].fill(0)
        flat.reshape(steps, lanes, STATE + 1)[..., :STATE] = states.transpose(0, 2, 1)
        want = targets.ravel()
        have = np.flatnonzero(want >= 0)
        have = have[np.argsort((want[have] // WORDS).astype(np.uint8), kind="stable")]  # by class, the tail's last
        s, ds = s[: len(have)], ds[: len(have)]
        np.take(flat, have, axis=0, out=s, mode="clip")
        loss = self._softmaxes(s, want[have], np.float32(1 / max(1, len(have))), ds, rooms)
        if len(have) < len(want):
            dflat.fill(0)
        dflat[have] = ds
        dstates = states
        dstates[:] = dflat.reshape(steps, lanes, STATE).transpose(0, 2, 1)
        # what multiplies the slope of the state, for all steps at once; a step's own work is then a few products
        r, z = rz[:, :STATE], rz[:, STATE:]
        np.subtract(1, z, out=by_n)
        np.subtract(before, n, out=by_z)
        by_z *= z
        by_z *= by_n
        n *= n
        by_n *= np.subtract(1, n, out=n)
        np.subtract(1, r, out=by_r)
        by_r *= r
        by_r *= gh[:, 2 * STATE :]
        by_r *= 0.5  # gh is n's, doubled
        carry, back = np.zeros((STATE, lanes), dg.dtype), np.ascontiguousarray(p["u"])
        for t in reversed(range(steps)):
            dh, (dn, dr, dz, dm) = dstates[t], dg[t].reshape(4, STATE, lanes)  # dm: by the state's product with u, that is n's times r
            dh += carry
            np.multiply(dh, by_n[t], out=dn)
            np.multiply(dn, by_r[t], out=dr)
            np.multiply(dh, by_z[t], out=dz)
            np.multiply(dn, r[t], out=dm)
            np.matmul(back, dg[t, STATE:], out=carry)
            dh *= z[t]
            carry += dh
            if not whole[t]:
                carry *= going[t]
        slopes = np.matmul(both, dg.transpose(0, 2, 1)).sum(axis=0)  # of u in the state's rows, of wx in the embedding's, of b in the ones'; n's columns first, and last for u
        g["u"][:] = slopes[:STATE, STATE:]
        for name, slope in (("wx", slopes[STATE:-1]), ("b", slopes[-1])):
            g[name][..., 2 * STATE :], g[name][..., : 2 * STATE] = slope[..., :STATE], slope[..., STATE : 3 * STATE]
        dx = np.matmul(dg[:, : 3 * STATE].transpose(0, 2, 1), np.concatenate([p["wx"][:, 2 * STATE :], p["wx"][:, : 2 * STATE]], axis=1).T).reshape(-1, EMBED)
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        g["embed"][ids[first]] = np.add.reduceat(dx.take(order, axis=0), first, axis=0)
        self._adam()
        return loss / max(1, len(have)), h

    def run(self, texts: list[np.ndarray]) -> None:
        """texts: token numbers with the end token, each trained on from its first token to its last."""
        r = np.random.default_rng(11)
        lanes = max(1, min(LANES, sum(map(len, texts)) // max(map(len, texts))))
        done = 0
        while done < LEAST_UPDATES:
            dealt = deal([len(x) for x in texts], lanes)
            steps = max(sum(len(texts[i]) for i in mine) for mine in dealt)
            inputs, targets = np.full((steps, lanes), END, np.int32), np.full((steps, lanes), -1, np.int32)
            for k, mine in enumerate(dealt):
                at = 0
                for i in r.permutation(mine):
                    x = texts[i]
                    inputs[at, k], inputs[at + 1 : at + len(x), k] = START, x[:-1]
                    targets[at : at + len(x), k] = x
                    at += len(x)
            h = np.zeros((lanes, STATE), np.float32)
            for at in range(0, steps, WINDOW):
                _, h = self.window(inputs[at : at + WINDOW], targets[at : at + WINDOW], h)
                done += 1


def deal(lengths: list[int], lanes: int) -> list[list[int]]:
    """Numbers of texts by lane, about as many tokens in each."""
    heap, dealt = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n, k = heapq.heappop(heap)
        dealt[k].append(i)
        heapq.heappush(heap, (n + lengths[i], k))
    return dealt


def score_texts(p: dict[str, np.ndarray], table: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each text (token numbers with the end token). table: embed @ wx + b."""
    total, longest = sum(map(len, texts)), max(map(len, texts))
    lanes = max(1, min(SCORE_LANES, total // longest))
    dealt = deal([len(x) for x in texts], lanes)
    steps = max(sum(len(texts[i]) for i in mine) for mine in dealt)
    inputs, targets, owner = np.full((steps, lanes), END, np.int32), np.full((steps, lanes), END, np.int32), np.full((steps, lanes), len(texts), np.int32)
    for k, mine in enumerate(dealt):
        at = 0
        for i in mine:
            x = texts[i]
            inputs[at, k], inputs[at + 1 : at + len(x), k] = START, x[:-1]
            targets[at : at + len(x), k], owner[at : at + len(x), k] = x, i
            at += len(x)
    out, h = np.zeros(len(texts) + 1), np.zeros((STATE, lanes), np.float32)
    u, table = np.ascontiguousarray(_turned(p["u"]).T), np.ascontiguousarray(_turned(table).T)
    rz, n, gh = (np.empty((k * STATE, lanes), np.float32) for k in (2, 1, 3))
    window = max(1, 16384 // lanes)
    for at in range(0, steps, window):
        ids = inputs[at : at + window]
        gx, states = np.take(table, ids.ravel(), axis=1).reshape(3 * STATE, *ids.shape), np.empty((len(ids), STATE, lanes), np.float32)
        going = ids != START
        whole = going.all(axis=1)
        with np.errstate(over="ignore"):
            for t in range(len(ids)):
                if not whole[t]:
                    h = h * going[t]
                np.matmul(u, h, out=gh)
                _advance(gx[:, t], gh, h, rz, n, states[t])
                h = states[t]
        own = owner[at : at + window].ravel()
        have = np.flatnonzero(own < len(texts))
        got = log_probability(p, states.transpose(0, 2, 1).reshape(-1, STATE)[have], targets[at : at + window].ravel()[have])
        out += np.bincount(own[have], weights=got.astype(np.float64), minlength=len(out))
    return out[:-1] / math.log(10)


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    whole = p | {kind: _whole(p, kind) for kind in ("class", "word")}
    return np.concatenate([whole[k].ravel() for k in _NAMES])


def unpack(x: np.ndarray, copy: bool = True) -> dict[str, np.ndarray]:
    """Parameters by name; those of the softmaxes also with the biases as the last row, in the same memory."""
    shapes = {"embed": (HEAD + 2, EMBED), "wx": (EMBED, 3 * STATE), "u": (STATE, 3 * STATE), "b": (3 * STATE,), "class": (STATE + 1, CLASSES + 1), "word": (CLASSES, STATE + 1, WORDS)}
    out, at = {}, 0
    for k in _NAMES:
        n = math.prod(shapes[k])
        out[k] = np.array(x[at : at + n], dtype=np.float32).reshape(shapes[k]) if copy else x[at : at + n].reshape(shapes[k])
        at += n
    for k in ("class", "word"):
        out[f"{k}_w"], out[f"{k}_b"] = out[k][..., :STATE, :], out[k][..., STATE, :]
    return out


# ---------------------------------------------------------------- passes


_FACTS = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("n_tail", pa.int64()), ("logs", pa.float64()), ("tail_logs", pa.float64()), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
        counts.clear()
        return made

    for batch in batches:
        for text in batch.column(0):
            counts.update(tokens(text.as_py()))
            if len(counts) >= FLUSH:
                yield flush()
    if counts:
        yield flush()


def _portions(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about PORTION bytes, at least one text each and at most 1024."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and (size + len(text) > PORTION or i - start == 1024):
            yield start, i
            start, size = i, 0
        size += len(text)
    if texts:
        yield start, len(texts)


def _texts(batches: Iterator[pa.RecordBatch], known, logs=None) -> Iterator[pa.RecordBatch]:
    """Each row's token numbers in place of its text b; given the logarithms of counts, also what they make of the text."""
    counts = logs and np.append(np.frombuffer(logs.value, dtype=np.float64), 0.0)  # the last for number -1
    for whole in batches:
        texts = [x or b"" for x in whole.column("b").to_pylist()]
        for start, end in _portions(texts):
            batch, split = whole.slice(start, end - start), [tokens(x) for x in texts[start:end]]
            lengths = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
            ends = np.cumsum(lengths + 1) - 1
            starts, words = ends - lengths, list(chain.from_iterable(split))
            own = np.full(ends[-1] + 1, END, np.int32)
            is_word = np.ones(len(own), bool)
            is_word[ends] = False
            own[is_word] = numbers(words, known.value)
            tail = (own < 0) | (own >= HEAD)
            made = np.where(tail, TAIL, own).astype("<i2")
            bounds = np.append(starts, len(own)).astype(np.int32) * np.int32(2)
            more = []
            if logs:
                base, of = counts[own], np.add.reduceat
                places = np.flatnonzero(own < 0)
                cuts = np.searchsorted(places, np.append(starts, len(own)))
                places -= np.repeat(np.arange(len(split)), np.diff(cuts))  # among the words, which have no end tokens
                left, cuts = [words[i] for i in places.tolist()], cuts.tolist()
                rare = [Counter(left[at:to]) for at, to in zip(cuts, cuts[1:], strict=False)]
                # logs: sum of log10(c + 0.1) over known tokens; the tail words' part again for the network
                facts = lengths + 1, of((own >= 0) & (base > -0.999), starts, dtype=np.int64), of(tail, starts, dtype=np.int64), of(base, starts), of(np.where(tail, base, 0.0), starts), [list(x.keys()) for x in rare], [list(x.values()) for x in rare]
                more = [pa.array(x, kind) for x, (_, kind) in zip(facts, _FACTS, strict=True)]
            kept = [c for c in batch.schema.names if c != "b"]
            numbered = pa.Array.from_buffers(pa.binary(), len(split), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(made.tobytes())])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), numbered, *more], names=[*kept, "tokens", *(c for c, _ in _FACTS[: len(more)])])


def _train(table: pa.Table, shared, blocks: int) -> pa.Table:
    table = table.sort_by([("place", "ascending"), ("tokens", "ascending")])
    trainer = Trainer(unpack(np.frombuffer(shared.value, dtype=np.float32)))
    texts = [np.frombuffer(x.as_py(), dtype="<i2") for x in table.column("tokens")]
    trainer.run(texts)
    parts = np.array_split(pack(trainer.p).astype(np.float64), blocks)
    n = sum(map(len, texts))
    return pa.table({"block": pa.array(range(blocks), pa.int32()), "shard": pa.array([table.column("shard")[0].as_py()] * blocks, pa.int32()), "n": pa.array([n] * blocks, pa.int64()), "sums": pa.array([(x * n).tobytes() for x in parts], pa.binary())})


def _trains(shared, blocks: int):
    return lambda key, table: _train(table, shared, blocks)


def _add(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), dtype=np.float64) for x in table.column("sums"))
    return pa.table({"block": table.column("block")[:1], "shard": table.column("shard")[:1], "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Rows with token numbers: the network's log10 probability in place of them (the last column)."""
    p = unpack(np.frombuffer(shared.value, dtype=np.float32))
    table = p["embed"] @ p["wx"] + p["b"]
    held: list[pa.RecordBatch] = []
    texts: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal size
        rows, scores = pa.concat_batches(held), score_texts(p, table, texts)
        held.clear()
        texts.clear()
        size = 0
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(scores, pa.float64())], names=[*rows.schema.names, "network"])

    for batch in batches:
        start, own = 0, batch.select(batch.schema.names[:-1])
        for i, x in enumerate(batch.column(batch.num_columns - 1)):
            texts.append(np.frombuffer(x.as_py(), dtype="<i2").astype(np.int32))
            size += len(texts[-1])
            if size >= CHUNK:
                held.append(own.slice(start, i + 1 - start))
                start = i + 1
                yield flush()
        if start < batch.num_rows:
            held.append(own.slice(start))
    if held:
        yield flush()


def least_count(counts: DataFrame, most: int, bound: int, bins: int = 1024) -> int:
    """The smallest count that at most `bound` words reach, from the numbers of words in `bins` ranges of counts at a time."""
    low, high, above = 1, most + 1, 0  # `above` words have a count of `high` or more
    while low < high:
        width = -(-(high - low) // bins)
        found = counts.where(F.col("c").between(low, high - 1)).groupBy(F.floor((F.col("c") - low) / width).alias("bin")).agg(F.count("*").alias("n"))
        n, at = {r["bin"]: r["n"] for r in found.collect()}, -(-(high - low) // width) - 1
        while at >= 0 and above + n.get(at, 0) <= bound:
            above, at = above + n.get(at, 0), at - 1
        if at < 0:
            return low
        low, high = low + at * width, min(high, low + (at + 1) * width)
        if width == 1:
            return high
    return high


def scored(documents: DataFrame, scratch: Scratch, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    sc = documents.sparkSession.sparkContext
    kind = documents.schema[id_column].dataType.simpleString()
    b = F.coalesce(F.col(text_column).cast("string").cast("binary"), F.lit(b""))
    docs = documents.select(F.col(id_column).alias("__id"), (crc_mod(id_column, 10) == 0).alias("held_out"), b.alias("b"))
    train = docs.where("not held_out")
    n_train = train.count()
    counts = scratch.write(train.select("b").mapInArrow(_counts, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    n_words, v_words, most = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.max("c"), F.lit(0))).first()
    least = least_count(counts, most, MID)
    mid = sorted(((-r["c"], bytes(r["word"])) for r in counts.where(F.col("c") >= least).collect()))  # at most MID words
    n, v = n_words + n_train, v_words + (n_train > 0)
    head_counts = np.array([n_train, *(-c for c, _ in mid[: HEAD - 1])], dtype=float)
    n_tail, v_tail = n - head_counts.sum(), v_words - len(mid[: HEAD - 1])
    known = sc.broadcast({w: i + 1 for i, (_, w) in enumerate(mid)})
    logs = sc.broadcast(np.log10(np.array([n_train, *(-c for c, _ in mid)], dtype=float) + 0.1).tobytes())
    shards, blocks = max(1, -(-n_train // SHARD), -(-n // SHARD_TOKENS)), 16
    placed = docs.withColumn("place", F.pmod(F.xxhash64(F.md5("b"), "__id"), F.lit(1 << 40))).withColumn("shard", F.pmod("place", F.lit(shards)).cast("int"))
    placed = placed.select(F.monotonically_increasing_id().alias("row"), "__id", "held_out", "shard", (F.col("place") / shards).cast("bigint").alias("place"), "b")
    schema = f"row bigint, __id {kind}, held_out boolean, shard int, place bigint, tokens binary, n_tokens bigint, n_known bigint, n_tail bigint, logs double, tail_logs double, words array<binary>, times array<int>"
    texts = scratch.write(placed.mapInArrow(lambda x: _texts(x, known, logs), schema), "texts")  # for training and scoring, so texts are split into words once more only
    learned = texts.where("not held_out").select("shard", "place", "tokens")
    parts = ROUNDS if n_train > shards * LANES else 1  # documents that are too few for parts are trained on in every round
    params = pack(new_model(head_counts, n_tail))
    for k in range(ROUNDS if n_train else 0):
        shared = sc.broadcast(params.astype(np.float32).tobytes())  # one set of parameters
        own = learned.where(F.pmod("place", F.lit(parts)) == k % parts)
        sums = own.groupBy("shard").applyInArrow(_trains(shared, blocks), "block int, shard int, n bigint, sums binary")
        sums = sums.withColumn("g", F.pmod("shard", F.lit(32))).groupBy("block", "g").applyInArrow(_add, "block int, shard int, n bigint, sums binary")
        sums = sums.groupBy("block").applyInArrow(_add, "block int, shard int, n bigint, sums binary")
        rows = sorted(sums.collect(), key=lambda r: r["block"])  # one set of parameters
        if rows:
            params = np.concatenate([np.frombuffer(r["sums"], dtype=np.float64) / r["n"] for r in rows])
    shared = sc.broadcast(params.astype(np.float32).tobytes())
    stated = texts.select("row", "__id", "held_out", "n_tokens", "n_known", "n_tail", "logs", "tail_logs", "tokens")
    each = scratch.write(stated.mapInArrow(lambda x: _score(x, shared), f"row bigint, __id {kind}, held_out boolean, n_tokens bigint, n_known bigint, n_tail bigint, logs double, tail_logs double, network double"), "scores")
    scratch.sweep()
    for x in (known, shared, logs):
        x.unpersist()
    rare = texts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    few = counts.where(F.col("c") < least)
    found = rare.join(few, "word", "left").select("row", (F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("l"), F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0).alias("k"))
    sums = found.groupBy("row").agg(F.sum("l").alias("l"), F.sum("k").alias("k"))
    out = each.join(sums, "row", "left")
    extra = F.coalesce("l", F.lit(0.0))
    base = F.col("logs") + extra - F.col("n_tokens") * math.log10(n + 0.1 * (v + 1))
    tail = F.col("tail_logs") + extra - F.col("n_tail") * math.log10(max(n_tail, 0) + 0.1 * (v_tail + 1))
    return out.select(F.col("__id").alias(id_column), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).cast("bigint").alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"), base.alias("base_score"), (F.col("network") + tail).alias("score"))
