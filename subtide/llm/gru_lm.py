"""Language-model scores: a gated recurrent network in numpy beside corpus-wide word counts.

Tokens are the words of the text with A-Z in lower case, and one end.  Counts of all
tokens of the training documents give the base score.  The network predicts the
most frequent entries (one of them stands for all other words), ``PER_ROOT`` times the
square root of the training tokens but ``CLASSES * WIDE`` at least, with a softmax in
three factors, P(class | state) P(group | class, state) P(entry | group, state), whose biases start
at the corpus's unigram.  Groups have equal sums of square roots of frequencies, which makes
the least work: few frequent words in a group, many rare ones.  An unlisted word w adds its share (c(w) + 0.1) / Z of all
unlisted words and one unseen kind, so scores are log probabilities over the same
kinds as the base.  Training is truncated backpropagation over windows of ``STEPS``
tokens with the state carried on, data-parallel: in each of ``ROUNDS`` rounds the
workers start from one model, take the round's training documents of their blocks and
are averaged; every training document is in one round.  Scoring runs documents in lanes sorted by length, window after window, with
each document's state carried to its end, so scores are of complete texts.

Gradients and counts use all training documents.

Scale: texts become tokens once; these are written in blocks to the shared folder, as numbers
into a block's distinct words, and stay there.  Training and scoring look up a block's distinct words and
never see its text again.  The shuffles hold a row for each distinct word of a block (as a 64-bit hash), however often the word
occurs.  The driver holds one model, which grows with the square root of the tokens, as do
the distinct counts from which the listed words are found.

Defined results: a null or empty text is one end token; repeated rows are documents of
their own; a null doc_id is text "" for the held-out rule; without training documents
c and N are 0 and both scores take every token as unseen.  Only doc_id and text are read.
"""

from __future__ import annotations

import heapq
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .warc import Output, open_fs

FOLDS = 10
ADD = 0.1
CLASSES, WIDE, PER_ROOT = 32, 64, 4
EMBED, HIDDEN = 16, 24
SUFFIXES = 512
LANES, STEPS, PIECE = 512, 16, 1024
ROUNDS = 4
RATE = 0.15
WORKER_BLOCKS, WORKERS = 2, 1024  # a training task takes so many blocks; more from WORKERS tasks on
SHARED_BY = 3  # and so many tokens for each parameter at least: what tasks send is then no more than the texts
PIECE_SIZE = 1 << 16
BLOCK = 16 << 20
PART = 1 << 20  # bytes of text that become word hashes at a time
LOGITS = 1 << 17
CALLS = 0.25  # what a group's matrix costs, in logits for each token of a window
UPDATED = 512
END_HASH = np.uint64(0x5EED0FE2D0C5)
OTHER = 0  # the entry of all unlisted words
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


class Encoded:
    """Documents as word hashes, each with its end, and the hash of every word's last two bytes."""

    def __init__(self, rows: list[bytes]) -> None:
        block = C.TextBlock([x.translate(_LOWER) for x in rows])
        n = len(rows)
        self.size = block.n_words + 1
        self.stop = np.cumsum(self.size)
        self.start = self.stop - self.size
        ends = self.stop - 1
        words = np.ones(int(self.stop[-1]) if n else 0, bool)
        words[ends] = False
        self.hash = np.full(len(words), END_HASH)
        self.hash[words] = block.word
        tail = block.data[block.w1 - 1].astype(np.int64) * 257 + block.data[np.maximum(block.w1 - 2, block.w0)]
        self.suffix = np.zeros(len(words), np.int64)
        self.suffix[words] = tail * 40503 % 65536 % SUFFIXES


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct value is found, in rising order, and the place of every value among them."""
    order = np.argsort(x)
    new = np.concatenate(([True], (y := x[order])[1:] != y[:-1]))[: len(x)]
    place = np.empty(len(x), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[new], place


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class _Part:
    """Some rows' exponentials of logits, one run after another in ``flat``.

    ``runs`` has slices of weights, the slice of rows that ask each, and whether these are all that do.
    """

    def __init__(self, runs: list[tuple[slice, slice, bool]]) -> None:
        self.runs, self.rows = runs, slice(runs[0][1].start, runs[-1][1].stop)
        many = np.array([rows.stop - rows.start for _, rows, _ in runs])
        wide = np.array([own.stop - own.start for own, _, _ in runs])
        self.width = np.repeat(wide, many)
        stop = np.cumsum(self.width)
        self.start, self.own = stop - self.width, np.repeat([own.start for own, _, _ in runs], many)
        end = np.cumsum(many * wide)
        self.shapes = list(zip((end - many * wide).tolist(), end.tolist(), many.tolist(), wide.tolist(), strict=True))

    def exps(self, states: np.ndarray, weights: np.ndarray, number: np.ndarray, moved: bool) -> tuple[np.ndarray, np.ndarray]:
        """The logit of each row's ``number``, and the exponentials' sum; where ``moved``, each row's largest logit is taken from its logits."""
        self.flat = np.empty(self.shapes[-1][1], states.dtype)
        self.matrices = [self.flat[a:b].reshape(m, w) for a, b, m, w in self.shapes]
        for (own, rows, _), p in zip(self.runs, self.matrices, strict=True):
            np.matmul(states[rows], weights[own].T, out=p)
        if moved:
            self.flat -= np.repeat(np.maximum.reduceat(self.flat, self.start), self.width)
        right = self.flat[self.start + number[self.rows] - self.own]
        np.exp(self.flat, out=self.flat)
        return right, np.add.reduceat(self.flat, self.start)


def _parts(runs: list[tuple[slice, slice]]) -> list[_Part]:
    """Runs (rows one after another) in parts whose logits stay in a core's cache; long runs are cut."""
    out, mine, held = [], [], 0
    for own, rows in runs:
        wide, many = own.stop - own.start, rows.stop - rows.start
        step = many if many * wide <= LOGITS else max(256, LOGITS // wide)
        for a in range(rows.start, rows.stop, step):
            b = min(a + step, rows.stop)
            if mine and (held + (b - a) * wide > LOGITS or mine[-1][1].stop != a):
                out.append(_Part(mine))
                mine, held = [], 0
            mine.append((own, slice(a, b), step == many))
            held += (b - a) * wide
    return [*out, _Part(mine)] if mine else out


def _in_range(total: np.ndarray) -> bool:
    """Whether these sums of exponentials are numbers of full precision."""
    return bool(1e-25 < total.min(initial=1) and total.max(initial=1) < 1e25)


def _order(ids: np.ndarray, kinds: int) -> np.ndarray:
    return np.argsort(ids.astype(np.uint16 if kinds <= 1 << 16 else np.int32), kind="stable")


def _edges(weight: np.ndarray) -> np.ndarray:
    """Where parts of about 1 begin in what ``weight`` adds up to, and the number of entries."""
    total = np.cumsum(weight)
    parts = max(1, int(total[-1]))
    return np.unique(np.concatenate(([0], np.searchsorted(total, total[-1] * np.arange(1, parts) / parts), [len(weight)])))


def part_edges(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups begin in entries of probabilities ``p``, and where classes begin in groups; each with the end.

    A class costs one logit for every token, a group one for each token of its class, an entry one for
    each token of its group; a group costs ``CALLS`` logits for every token besides, as it is a matrix of its own.  Their sum is
    least for groups of (CALLS / p) ** 0.5 entries and classes of CALLS ** 0.25 / p ** 0.75.
    """
    p = p / p.sum()
    groups = _edges(np.sqrt(p / CALLS))
    return groups, _edges(np.add.reduceat(p**0.75, groups[:-1]) / CALLS**0.25)


def shape_of(tokens: int) -> tuple[int, int]:
    """Two factors of the number of entries for so many training tokens."""
    size = int(PER_ROOT * tokens**0.5)
    if size <= CLASSES * WIDE:
        return CLASSES, WIDE
    classes = int(size**0.5)
    return classes, -(-size // classes)


class Model:
    """Parameters: embeddings (entries, then suffixes of unlisted words), one GRU layer, outputs of classes, of groups and of entries."""

    NAMES = ("embed", "inputs", "bias", "recur", "classes", "groups", "entries")

    def __init__(self, edge: tuple[np.ndarray, np.ndarray], **arrays: np.ndarray) -> None:
        """The last column of outputs has their biases; group k has the entries from ``edge[0][k]`` on, class k the groups from ``edge[1][k]`` on."""
        self.edge = edge
        self.group_of, self.class_of = (np.repeat(np.arange(len(e) - 1), np.diff(e)) for e in edge)
        for k in self.NAMES:
            setattr(self, k, arrays[k])

    @classmethod
    def fresh(cls, log_unigram: np.ndarray, seed: int = 1) -> "Model":
        rng = np.random.default_rng(seed)
        f = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        p = np.exp(log_unigram)
        edge = part_edges(p)
        group = np.add.reduceat(p, edge[0][:-1])
        mass = np.add.reduceat(group, edge[1][:-1])
        biased = lambda x: np.concatenate((np.zeros((len(x), HIDDEN)), np.log(x)[:, None]), 1).astype(np.float32)
        return cls(
            edge, embed=f(len(p) + SUFFIXES, EMBED, scale=0.3), inputs=f(EMBED, 3 * HIDDEN, scale=EMBED**-0.5), bias=np.zeros(3 * HIDDEN, np.float32),
            recur=f(HIDDEN, 3 * HIDDEN, scale=0.5 * HIDDEN**-0.5), classes=biased(mass),
            groups=biased(group / np.repeat(mass, np.diff(edge[1]))), entries=biased(p / np.repeat(group, np.diff(edge[0]))),
        )

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def like(self, flat: np.ndarray) -> "Model":
        out, at = {}, 0
        for k in self.NAMES:
            a = getattr(self, k)
            out[k] = flat[at : at + a.size].reshape(a.shape).astype(np.float32)
            at += a.size
        return Model(self.edge, **out)

    def cell(self, x: np.ndarray, h: np.ndarray, u: np.ndarray, zr: np.ndarray, c: np.ndarray, new: np.ndarray) -> None:
        """One step from projected inputs, by unit and lane, into the given arrays: what the state adds, the two gates, the candidate and the new state."""
        np.matmul(self.recur.T, h, out=u)
        np.add(x[: 2 * HIDDEN], u[: 2 * HIDDEN], out=zr)
        _sigmoid(zr)
        np.multiply(zr[HIDDEN:], u[2 * HIDDEN :], out=c)
        c += x[2 * HIDDEN :]
        np.tanh(c, out=c)
        np.subtract(h, c, out=new)
        new *= zr[:HIDDEN]
        new += c

    def step(self, x: np.ndarray, h: np.ndarray):
        """One step from projected inputs by lane and unit: gates and the new state.

        Fastest where a gate's numbers of all lanes lie together, as ``projected`` lays them.
        """
        u, zr, c, new = (np.empty((k * HIDDEN, len(h)), np.result_type(x, h)) for k in (3, 2, 1, 1))
        self.cell(x.T, h.T, u, zr, c, new)
        return zr[:HIDDEN].T, zr[HIDDEN:].T, u[2 * HIDDEN :].T, c.T, new.T

    def projected(self, x: np.ndarray) -> np.ndarray:
        """What embeddings add to the gates, by gate and lane."""
        out = self.inputs.T @ x.T
        out += self.bias[:, None]
        return out

    def levels(self, y: np.ndarray):
        """For sorted entries: classes, groups and entries by name, the number that each of ``y`` has there, and slices of numbers that share a softmax with slices of ``y`` that ask it.

        A number that is alone is certain and left out.
        """
        group = self.group_of[y]
        kind = self.class_of[group]
        parts = (("classes", kind, np.array([0, len(self.classes)]), np.zeros_like(kind)), ("groups", group, self.edge[1], kind), ("entries", y, self.edge[0], group))
        for name, number, edge, owner in parts:
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            k = owner[first]
            several = edge[k + 1] - edge[k] > 1
            runs = (x[several].tolist() for x in (edge[k], edge[k + 1], first, np.append(first[1:], len(y))))
            yield name, number, [(slice(a, b), slice(i, j)) for a, b, i, j in zip(*runs, strict=True)]

    def log_probs(self, states: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of each target entry after its state."""
        order = _order(target, len(self.entries))
        y, states = target[order], np.concatenate((states[order], np.ones((len(states), 1), states.dtype)), 1)
        out, sums = np.empty(len(states), states.dtype), np.zeros(len(states), states.dtype)
        for name, number, runs in self.levels(y):
            weights = getattr(self, name)
            parts = _parts(runs)
            for moved in (False, True):
                right, total = np.zeros(len(y), states.dtype), np.ones(len(y), states.dtype)
                with np.errstate(over="ignore"):
                    for part in parts:
                        right[part.rows], total[part.rows] = part.exps(states, weights, number, moved)
                if _in_range(total):
                    break
            sums += right - np.log(total)
        out[order] = sums
        return out


class Trainer:
    """Adagrad over truncated windows."""

    def __init__(self, model: Model) -> None:
        self.m = model
        self.g = {k: np.full_like(getattr(model, k), 0.02) for k in Model.NAMES}

    def _update(self, name: str, at, grad: np.ndarray) -> None:
        g, p = self.g[name], getattr(self.m, name)
        if at is None or isinstance(at, slice):
            g, p = (g, p) if at is None else (g[at], p[at])
            g += grad * grad
            grad *= RATE
            grad /= np.sqrt(g)
            p -= grad
        else:
            g[at] += grad * grad
            p[at] -= RATE * grad / np.sqrt(g[at])

    @staticmethod
    def _softmax(weights: np.ndarray, states: np.ndarray, number: np.ndarray, runs: list, scale: np.float32) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of states and of weights, of ``scale`` times the loss of ``number`` in its runs."""
        inner, parts = weights[:, :-1], _parts(runs)
        for moved in (False, True):
            total, asked, back = np.ones(len(states), states.dtype), np.zeros(len(states), states.dtype), np.zeros((len(states), inner.shape[1]), states.dtype)
            grad = np.zeros(weights.shape, states.dtype)
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                for part in parts:
                    rows = part.rows
                    _, sums = part.exps(states, weights, number, moved)
                    total[rows], asked[rows] = sums, scale
                    part.flat[part.start + number[rows] - part.own] -= sums
                    weighed = states[rows] * (scale / sums)[:, None]
                    for (own, some, whole), p in zip(part.runs, part.matrices, strict=True):
                        np.matmul(p, inner[own], out=back[some])
                        q = weighed[some.start - rows.start : some.stop - rows.start]
                        if whole:
                            np.matmul(p.T, q, out=grad[own])
                        else:
                            grad[own] += p.T @ q
            if _in_range(total):
                break
        back *= (asked / total)[:, None]
        return back, grad

    def window(self, ids: np.ndarray, target: np.ndarray, real: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Learn from (steps, lanes) inputs and targets where ``real``; gives the state after the last step."""
        m, (t, n) = self.m, ids.shape
        x = m.embed[ids.ravel()]
        inputs = m.projected(x).reshape(-1, t, n)
        u, zr, c, old = (np.empty((k * HIDDEN, t, n), np.result_type(x, h)) for k in (3, 2, 1, 1))  # by unit, step and lane
        states, new = np.ones((t, n, HIDDEN + 1), old.dtype), np.empty((HIDDEN, n), old.dtype)
        old[:, 0] = h.T
        for k in range(t):
            after = old[:, k + 1] if k + 1 < t else new
            m.cell(inputs[:, k], old[:, k], u[:, k], zr[:, k], c[:, k], after)
            states[k, :, :-1] = after.T
        h = new.T
        at = np.flatnonzero(real.ravel())
        if not len(at):
            return h
        at = at[_order(target.ravel()[at], len(m.entries))]  # by entry, so by group and class too
        s_at, y = states.reshape(t * n, -1)[at], target.ravel()[at]
        scale, back, steps = np.float32(1 / n), np.zeros((len(at), HIDDEN), h.dtype), []
        for name, number, runs in m.levels(y):
            of_states, grad = self._softmax(getattr(m, name), s_at, number, runs, scale)
            back += of_states
            if name == "classes":
                steps.append((name, None, grad))
                continue
            first, stop = (np.array([getattr(own, x) for own, _ in runs], np.int64) for x in ("start", "stop"))
            gap = np.flatnonzero(first[1:] != stop[:-1]) + 1
            for a, b in zip(first[np.append(0, gap)].tolist() if runs else (), stop[np.append(gap - 1, -1)].tolist() if runs else (), strict=True):
                for i in range(a, b, UPDATED):  # in a core's cache
                    own = slice(i, min(i + UPDATED, b))
                    self._update(name, own, grad[own])
        d_states = np.zeros((t * n, HIDDEN), h.dtype)
        d_states[at] = back
        d_states = np.ascontiguousarray(d_states.T).reshape(HIDDEN, t, n)
        z, r, u = zr[:HIDDEN], zr[HIDDEN:], u[2 * HIDDEN :]
        of_c = (1 - z) * (1 - c * c)
        of_z = (old - c) * z * (1 - z)
        of_r = u * r * (1 - r)
        du, dc, d = np.empty((3 * HIDDEN, t, n), h.dtype), np.empty((HIDDEN, t, n), h.dtype), np.zeros((HIDDEN, n), h.dtype)
        for k in range(t - 1, -1, -1):
            d += d_states[:, k]
            np.multiply(d, of_c[:, k], out=dc[:, k])
            np.multiply(d, of_z[:, k], out=du[:HIDDEN, k])
            np.multiply(dc[:, k], of_r[:, k], out=du[HIDDEN : 2 * HIDDEN, k])
            np.multiply(dc[:, k], r[:, k], out=du[2 * HIDDEN :, k])
            d *= z[:, k]
            d += m.recur @ du[:, k]
        d_rec = old.reshape(HIDDEN, -1) @ du.reshape(3 * HIDDEN, -1).T
        du[2 * HIDDEN :] = dc
        d_in = du.reshape(3 * HIDDEN, -1)
        steps += [("recur", None, d_rec), ("inputs", None, x.T @ d_in.T), ("bias", None, d_in.sum(1))]
        dx = d_in.T @ m.inputs.T
        order = _order(ids.ravel(), len(m.embed))
        sorted_ids = ids.ravel()[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_ids[1:] != sorted_ids[:-1])))
        steps.append(("embed", sorted_ids[first], np.add.reduceat(dx[order], first, axis=0)))
        for name, where, grad in steps:
            self._update(name, where, np.clip(grad, -1, 1))
        return h

    def documents(self, entry: np.ndarray, given: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Documents, cut into pieces of ``PIECE`` tokens, one after another on ``LANES`` lanes.

        A piece begins at a window's start with a zero state; lanes that are done are left out.
        """
        if not len(start):
            return
        cuts = -(-size // PIECE)
        doc = np.repeat(np.arange(len(size)), cuts)
        skip = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * PIECE
        a, n = start[doc] + skip, np.minimum(size[doc] - skip, PIECE)
        windows = -(-n // STEPS)
        lanes = int(min(LANES, max(8, windows.sum() // (4 * windows.max()), windows.sum() // 64)))  # so many windows at least: few documents teach too
        heap = [(0, k) for k in range(lanes)]
        place = np.zeros((2, len(n)), np.int64)
        for i in np.argsort(-n, kind="stable"):
            load, k = heapq.heappop(heap)
            place[:, i] = load, k
            heapq.heappush(heap, (load + int(windows[i]), k))
        loads = np.zeros(lanes, np.int64)
        for load, k in heap:
            loads[k] = load
        rank = np.argsort(np.argsort(-loads, kind="stable"), kind="stable")  # longest lanes first
        t = int(loads.max()) * STEPS
        target, ids, fresh, real = (np.zeros((t, lanes), kind) for kind in (np.int64, np.int64, bool, bool))
        at = np.repeat(place[0] * STEPS - (np.cumsum(n) - n), n) + np.arange(n.sum())
        lane = np.repeat(rank[place[1]], n)
        word = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        before = np.where(np.isin(word, start), given_end(self.m), given[word - 1])
        target[at, lane], ids[at, lane], real[at, lane] = entry[word], before, True
        fresh[place[0] * STEPS, rank[place[1]]] = True
        live = np.sort(loads)[::-1]
        h = np.zeros((lanes, HIDDEN), np.float32)
        for w in range(int(live[0])):
            k, rows = int(np.count_nonzero(live > w)), slice(w * STEPS, (w + 1) * STEPS)
            h = np.where(fresh[w * STEPS, :k, None], np.float32(0), h[:k])
            h = self.window(ids[rows, :k], target[rows, :k], real[rows, :k], h)


def given_end(model: Model) -> int:
    """The input before a document's first token: the last suffix number is not used by words."""
    return len(model.embed) - 1


def score_documents(model: Model, entry: np.ndarray, given: np.ndarray, start: np.ndarray, size: np.ndarray, lanes: int = 4096, tokens: int = 1 << 15) -> np.ndarray:
    """Natural log probability of each whole document's entries, from windows of about ``tokens`` tokens of all lanes."""
    out = np.zeros(len(start))
    order = np.argsort(-size, kind="stable")
    for a in range(0, len(order), lanes):
        mine = order[a : a + lanes]
        s, n = start[mine], size[mine]
        h, w = np.zeros((len(mine), HIDDEN), np.float32), 0
        while w < n[0]:
            long = min(max(1, tokens // len(h)), int(n[0]) - w)
            now = np.searchsorted(-n, -np.arange(w, w + long), "left")  # sizes fall: the lanes that reach beyond each step
            stop = np.cumsum(now)
            lane = np.arange(stop[-1]) - np.repeat(stop - now, now)
            at = s[lane] + np.repeat(np.arange(w, w + long), now)
            x = given[at - 1]
            if w == 0:
                x[: now[0]] = given_end(model)
            inputs, states = model.projected(model.embed[x]), np.empty((len(at), HIDDEN), np.float32)
            for k, j in zip((stop - now).tolist(), stop.tolist(), strict=True):
                h = model.step(inputs[:, k:j].T, h[: j - k])[4]
                states[k:j] = h
            out[mine] += np.bincount(lane, model.log_probs(states, entry[at]), len(mine))
            w += long
    return out


# Steps that run in tasks.


class Block:
    """Documents as numbers into their distinct words, the most frequent first.

    ``docs`` their ids, ``length`` their bytes, ``size`` their tokens, each with its end; ``words`` the words' hashes,
    ``suffix`` the hashes of their last two bytes; ``number`` the word of each token, one document after another.
    """

    PLANES = 4  # bytes of a number, each kept apart: upper ones are mostly zero
    OPTIONS = pa.ipc.IpcWriteOptions(compression="zstd")

    def __init__(self, docs: list, length: np.ndarray, size: np.ndarray, words: np.ndarray, suffix: np.ndarray, number: np.ndarray) -> None:
        self.docs, self.length, self.size, self.words, self.suffix, self.number = docs, length, size, words, suffix, number

    @classmethod
    def of(cls, docs: list, rows: list[bytes]) -> "Block":
        parts = []
        for part in C.blocks(rows, PART):
            e = Encoded(rows[part])
            first, number = _distinct(e.hash)
            parts.append((e.size, e.hash[first], e.suffix[first], number))
        size, words, suffix, _ = map(np.concatenate, zip(*parts, strict=True))
        first, place = _distinct(words)
        places = np.split(place, np.cumsum([len(p[1]) for p in parts])[:-1])
        number = np.concatenate([k[p[3]] for k, p in zip(places, parts, strict=True)])
        order = np.argsort(-np.bincount(number, minlength=len(first)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        return cls(docs, np.array(list(map(len, rows))), size, words[first][order], suffix[first][order], rank[number])

    def packed(self) -> pa.Buffer:
        tables = (
            {"doc": pa.array(self.docs, pa.int64()), "length": self.length, "size": self.size},
            {"word": self.words, "suffix": self.suffix.astype(np.int16)},
            {f"b{k}": (self.number >> 8 * k).astype(np.uint8) for k in range(self.PLANES)},
        )
        sink = pa.BufferOutputStream()
        for table in map(pa.table, tables):
            with pa.ipc.new_stream(sink, table.schema, options=self.OPTIONS) as writer:
                writer.write_table(table)
        return sink.getvalue()

    @classmethod
    def unpacked(cls, raw: bytes) -> "Block":
        source = pa.BufferReader(raw)
        docs, words, tokens = (pa.ipc.open_stream(source).read_all() for _ in range(3))
        number = np.zeros(len(tokens), np.int32)
        for k, plane in enumerate(tokens.columns):
            number |= plane.to_numpy().astype(np.int32) << 8 * k
        return cls(docs.column("doc").to_pylist(), docs.column("length").to_numpy(), docs.column("size").to_numpy(), words.column("word").to_numpy(), words.column("suffix").to_numpy().astype(np.int64), number)


def write_blocks(folder: str):
    """Blocks of documents to files, as numbers of words; of each block its distinct word hashes with their training counts."""

    def run(batches):
        state: dict = {"out": None, "rows": [], "held": 0, "done": []}

        def flush():
            out = state["out"] = state["out"] or Output(folder, ".blocks")
            rows = state["rows"]
            block = Block.of([r[0] for r in rows], [r[1] for r in rows])
            raw = block.packed()
            name = f"{out.name}:{out.size}:{len(raw)}"
            out.write(raw)
            learn = np.repeat([not held_out(r[0]) for r in rows], block.size)
            total = np.bincount(block.number, learn, len(block.words)).astype(np.int64)
            state["done"].append((name, block.words.view(np.int64), total))
            state["rows"], state["held"] = [], 0

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), C.texts(batch.column("text")), strict=True):
                state["rows"].append((doc, text))
                state["held"] += len(text) + 64
                if state["held"] >= BLOCK:
                    flush()
        if state["rows"]:
            flush()
        if state["out"] is not None:
            state["out"].close()
        for name, words, total in state["done"]:
            yield pa.RecordBatch.from_pydict({"block": [name], "words": pa.array([words], pa.list_(pa.int64())), "counts": pa.array([total], pa.list_(pa.int64()))})

    return run


def _read_block(folder: str, name: str) -> Block:
    file, offset, length = name.split(":")
    fs, path = open_fs(folder)
    with fs.open_input_file(f"{path}/{file}") as f:
        f.seek(int(offset))
        return Block.unpacked(f.read(int(length)))


class Listed:
    """Entry numbers of the listed words."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]

    def entries(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], OTHER)


def encode(block: Block, listed: Listed) -> tuple[np.ndarray, np.ndarray]:
    """The entry of each of the block's words, and its input: an unlisted word comes in as its suffix."""
    entry = listed.entries(block.words)
    return entry.astype(np.int32), np.where(entry == OTHER, len(listed.sorted) + block.suffix % (SUFFIXES - 1), entry).astype(np.int32)


def train_round(folder: str, shared, number: int, rounds: int):
    """Each task takes its blocks' training documents of this round, dealt by hash, and gives back its model in pieces."""

    def run(batches):
        hashes, start = shared.value
        model, listed = start.like(start.flat()), Listed(hashes)
        trainer, seen, parts, held = Trainer(model), 0, [], 0

        def learn():
            size, entry, given = map(np.concatenate, zip(*parts, strict=True))
            trainer.documents(entry, given, np.cumsum(size) - size, size)
            return int(size.sum())

        for batch in batches:
            for name in batch.column("block").to_pylist():
                block = _read_block(folder, name)
                entry, given = encode(block, listed)
                mine = np.array([not held_out(doc) and number <= zlib.crc32(f"round {doc}".encode()) / 2**32 * rounds < number + 1 for doc in block.docs], bool)
                token, at = block.number[np.repeat(mine, block.size)], 0
                size, length = block.size[mine], block.length[mine]
                while len(size):
                    k = int(np.searchsorted(held + np.cumsum(length), C.BLOCK_BYTES)) + 1  # the documents that fill a block, if all do
                    n = int(size[:k].sum())
                    some = token[at : at + n]
                    parts.append((size[:k], entry[some], given[some]))
                    held += int(length[:k].sum())
                    at, size, length = at + n, size[k:], length[k:]
                    if held >= C.BLOCK_BYTES:  # documents of some blocks together: wide windows
                        seen += learn()
                        parts, held = [], 0
        if parts:
            seen += learn()
        if seen:
            flat = model.flat()
            for k, piece in enumerate(np.array_split(flat, -(-len(flat) // PIECE_SIZE))):
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "weight": pa.array([float(seen)]), "piece": pa.array([piece.astype(np.float32).tobytes()], pa.binary())})

    return run


def average(key, table: pa.Table) -> pa.Table:
    """The weighted mean of the workers' pieces."""
    weight = table.column("weight").to_numpy()
    total = 0
    for w, raw in zip(weight, table.column("piece"), strict=True):
        total = total + np.frombuffer(raw.as_py(), np.float32).astype(np.float64) * (w / weight.sum())
    return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "piece": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def score_block(folder: str, shared, names, n: int, v: int, rest: tuple[int, int]):
    """Scores of a block from its words' counts: ``names`` has the blocks by key, ``rest`` tokens and kinds of the unlisted words."""
    base_of = lambda c: np.log10((c + ADD) / (n + ADD * (v + 1)))
    other_of = lambda c: np.log10((c + ADD) / (rest[0] + ADD * (rest[1] + 1)))

    def run(key, table: pa.Table) -> pa.Table:
        hashes, model = shared.value
        listed = Listed(hashes)
        known, count = table.column("word").to_numpy().view(np.uint64), table.column("c").to_numpy()
        order = np.argsort(known)
        known, count = known[order], count[order]
        block = _read_block(folder, names.value[key[0].as_py()])
        entry, given = encode(block, listed)
        c, docs, tokens = count[np.searchsorted(known, block.words)], block.docs, block.size
        start = np.cumsum(tokens) - tokens
        of_all = lambda x: np.add.reduceat(x[block.number], start)
        seen, base, other = of_all((c > 0).astype(np.int64)), of_all(base_of(c)), of_all(np.where(entry == OTHER, other_of(c), 0.0))
        score = other + score_documents(model, entry[block.number], given[block.number], start, tokens) / np.log(10)
        return pa.table({
            "doc_id": pa.array(docs, pa.int64()), "held_out": [held_out(d) for d in docs], "n_tokens": tokens, "n_known": seen,
            "train_tokens": np.full(len(docs), n), "base_score": base, "score": score,
        })

    return run


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    folder = f"{C.shared_dir(spark)}/{uuid.uuid4().hex}"
    blocks = C.scratch(C.documents(docs).mapInArrow(write_blocks(folder), "block string, words array<long>, counts array<long>"), "blocks")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    names = {r["id"]: r["block"] for r in blocks.select("block", F.xxhash64("block").alias("id")).collect()}  # short keys for the rows of words
    words = blocks.select(F.xxhash64("block").alias("block"), F.explode(F.arrays_zip("words", "counts")).alias("x")).select("block", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    counts = C.scratch(words.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    by_count = sorted(((int(r["c"]), int(r["k"])) for r in counts.where("c > 0").groupBy("c").agg(F.count("*").alias("k")).collect()), reverse=True)
    n, v = sum(c * k for c, k in by_count), sum(k for _, k in by_count)
    classes, wide = shape_of(n)
    size, least, found = classes * wide, 1, 0
    for least, k in by_count:  # the count that the last listed word has
        found += k
        if found >= size:
            break
    end = int(END_HASH.astype(np.int64))
    top = counts.where((F.col("c") >= least) | ((F.col("word") == end) & (F.col("c") > 0)))
    top = top.orderBy((F.col("word") != end), F.desc("c"), "word").limit(size - 1).collect()  # the end is always listed
    top.sort(key=lambda r: (-r["c"], r["word"]))
    listed = sum(r["c"] for r in top)
    rest = (n - listed, v - len(top))
    number = np.zeros(size, np.uint64)
    number[0] = np.uint64(1)  # no word's hash in practice; the entry is for unlisted words
    number[1 : 1 + len(top)] = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    number[1 + len(top) :] = np.arange(2, 2 + size - 1 - len(top), dtype=np.uint64)
    mass = np.full(size, 1e-7)
    mass[0] = rest[0] + ADD * (rest[1] + 1)
    mass[1 : 1 + len(top)] = [r["c"] for r in top]
    model = Model.fresh(np.log(mass / mass.sum()))
    parts = int(np.clip(min(-(-len(names) // WORKER_BLOCKS), n // (SHARED_BY * len(model.flat()))), 1, WORKERS))  # the same on any cluster
    spread = blocks.select("block").repartitionByRange(parts, "block")
    for k in range(rounds if n else 0):
        shared = spark.sparkContext.broadcast((number, model))
        pieces = spread.mapInArrow(train_round(folder, shared, k, rounds), "k int, weight double, piece binary")
        got = C.by_group(pieces, ["k"], average, "k int, piece binary").collect()  # one model
        if got:
            model = model.like(np.concatenate([np.frombuffer(r["piece"], np.float32) for r in sorted(got, key=lambda r: r["k"])]))
        shared.unpersist()
    shared = spark.sparkContext.broadcast((number, model))
    known = words.select("block", "word").join(counts, "word").select("block", "word", "c")
    return C.by_group(known, ["block"], score_block(folder, shared, spark.sparkContext.broadcast(names), n, v, rest), schema)
