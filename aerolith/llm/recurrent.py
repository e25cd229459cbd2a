"""A gated recurrent language model in numpy, with class-factored output.

Tokens are numbered: the ``HEAD`` commonest words have a number each, in output
classes of ``CLASS`` words; any other word belongs to one of ``TAIL`` open
classes by its spelling, and is drawn within it by its corpus count.  So

    P(word) = P(class | state) * P(word | class, state)   for a common word,
    P(word) = P(class | state) * (c + 0.5) / Z(class)     for any other.

Output biases start at corpus frequencies.  Training is truncated
backpropagation: windows of ``WINDOW`` steps over parallel lanes of documents,
the state carried from window to window and reset where a document begins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HIDDEN = 16
HEAD = 1024
CLASS = 32
TAIL = 64
WINDOW = 16
LANES = 256


@dataclass
class Shape:
    """Sizes: common words, output classes (those of common words first)."""

    head: int

    @property
    def groups(self) -> int:
        return -(-self.head // CLASS)

    @property
    def classes(self) -> int:
        return self.groups + TAIL

    @property
    def start(self) -> int:
        """Number of the mark before the first token; tail class k is number head + k."""
        return self.head + TAIL

    def parts(self) -> dict[str, tuple[int, ...]]:
        h = HIDDEN
        return {"enter": (self.start + 1, 3 * h), "state": (h, 3 * h), "to_class": (h, self.classes), "class_bias": (self.classes,), "to_word": (self.groups * CLASS, h), "word_bias": (self.groups * CLASS,)}

    def width(self) -> int:
        return sum(int(np.prod(s)) for s in self.parts().values())

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, size in self.parts().items():
            n = int(np.prod(size))
            out[name] = flat[at : at + n].reshape(size)
            at += n
        return out

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.head, ids // CLASS, ids - self.head + self.groups)


def initial(shape: Shape, head_counts: np.ndarray, tail_mass: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(7)
    flat = np.zeros(shape.width(), dtype=np.float32)
    p = shape.views(flat)
    p["enter"][:] = rng.normal(0, 0.3, p["enter"].shape)
    p["state"][:] = rng.normal(0, 0.25, p["state"].shape)
    p["to_class"][:] = rng.normal(0, 0.02, p["to_class"].shape)
    p["to_word"][:] = rng.normal(0, 0.02, p["to_word"].shape)
    padded = np.zeros(shape.groups * CLASS)
    padded[: shape.head] = head_counts
    mass = np.concatenate([padded.reshape(-1, CLASS).sum(axis=1), tail_mass]) + 0.5
    p["class_bias"][:] = np.log(mass / mass.sum())
    p["word_bias"][:] = np.where(np.arange(len(padded)) < shape.head, np.log(padded + 0.5), -40)
    return flat


def _step(p: dict[str, np.ndarray], ids: np.ndarray, h: np.ndarray):
    n = HIDDEN
    x, u = p["enter"][ids], h @ p["state"]
    gates = x[:, : 2 * n] + u[:, : 2 * n]
    # the logistic function by way of tanh
    gates *= 0.5
    np.tanh(gates, out=gates)
    gates += 1
    gates *= 0.5
    z, r = gates[:, :n], gates[:, n:]
    new = r * u[:, 2 * n :]
    new += x[:, 2 * n :]
    np.tanh(new, out=new)
    out = h - new
    out *= z
    out += new
    return out, z, r, new, u


def _exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp(x - shift), its sums by row, and the shift: none while all values are small, else each row's greatest."""
    shift = 0.0
    if x.size and (x.max() > 60 or x.min() < -60):
        shift = x.max(axis=1)
        x = x - shift[:, None]
    e = np.exp(x)
    return e, e @ np.ones(e.shape[1], dtype=e.dtype), shift


def log_probability(shape: Shape, flat: np.ndarray, documents: list[np.ndarray], block: int = 8192) -> np.ndarray:
    """Natural log-probability of each document's numbers (the static part within tail classes left out)."""
    p = shape.views(flat)
    size = np.array([len(d) for d in documents], dtype=np.int64)
    out = np.zeros(len(documents))
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    if not len(order):
        return out
    sorted_size = size[order]
    all_ids = np.concatenate([documents[k] for k in order]).astype(np.int64)
    begin = np.cumsum(sorted_size) - sorted_size
    longest = int(sorted_size[0])
    active = np.searchsorted(-sorted_size, -np.arange(longest), side="left")
    h = np.zeros((len(order), HIDDEN), dtype=np.float32)
    previous = np.full(len(order), shape.start, dtype=np.int64)
    total = np.zeros(len(order))
    states, targets, owners, held = [], [], [], 0
    for t in range(longest):
        a = int(active[t])
        h = _step(p, previous[:a], h[:a])[0]
        ids = all_ids[begin[:a] + t]
        states.append(h)
        targets.append(ids)
        owners.append(a)
        held += a
        previous = ids
        if held >= block or t == longest - 1:
            who = np.concatenate([np.arange(k) for k in owners])
            total += np.bincount(who, _token_log(shape, p, np.concatenate(states), np.concatenate(targets)), minlength=len(order))
            states, targets, owners, held = [], [], [], 0
    out[order] = total
    return out


def _token_log(shape: Shape, p: dict[str, np.ndarray], states: np.ndarray, ids: np.ndarray, block: int = 8192) -> np.ndarray:
    out = np.empty(len(ids))
    to_word = p["to_word"].reshape(shape.groups, CLASS, HIDDEN)
    word_bias = p["word_bias"].reshape(shape.groups, CLASS)
    for at in range(0, len(ids), block):
        h, own = states[at : at + block], ids[at : at + block]
        kind = shape.class_of(own)
        logits = h @ p["to_class"] + p["class_bias"]
        _, total, shift = _exponentials(logits)
        log = logits[np.arange(len(own)), kind] - np.log(total) - shift
        common = np.flatnonzero(own < shape.head)
        common = common[np.argsort(kind[common], kind="stable")]
        edge = np.searchsorted(kind[common], np.arange(shape.groups + 1))
        for g in np.flatnonzero(np.diff(edge)):
            i = common[edge[g] : edge[g + 1]]
            inner = h[i] @ to_word[g].T + word_bias[g]
            _, total, shift = _exponentials(inner)
            log[i] += inner[np.arange(len(i)), own[i] % CLASS] - np.log(total) - shift
        out[at : at + block] = log
    return out


class Trainer:
    """Adagrad over windows of truncated backpropagation."""

    def __init__(self, shape: Shape, flat: np.ndarray, rate: float = 0.2):
        self.shape, self.rate = shape, rate
        self.flat = flat.copy()
        self.p = shape.views(self.flat)
        self.seen = np.full(len(flat), 1e-3, dtype=np.float32)
        self.tokens = 0

    def lanes(self, documents: list[np.ndarray]) -> None:
        """Train on documents laid end to end in lanes."""
        documents = [d for d in documents if len(d)]
        if not documents:
            return
        target = np.concatenate(documents).astype(np.int64)
        begins = np.zeros(len(target), dtype=bool)
        begins[np.cumsum([0, *(len(d) for d in documents[:-1])])] = True
        lanes = max(1, min(LANES, len(target) // WINDOW))
        length = -(-len(target) // lanes)
        pad = lanes * length - len(target)
        real = np.concatenate([np.ones(len(target), dtype=bool), np.zeros(pad, dtype=bool)]).reshape(lanes, length).T
        before = np.concatenate([[self.shape.start], target[:-1]])
        before[begins] = self.shape.start
        target, before, begins = (np.concatenate([x, np.zeros(pad, dtype=x.dtype)]).reshape(lanes, length).T for x in (target, before, begins))
        h = np.zeros((lanes, HIDDEN), dtype=np.float32)
        for at in range(0, length, WINDOW):
            w = slice(at, at + WINDOW)
            h = self.window(before[w], target[w], begins[w], real[w], h)
        self.tokens += int(real.sum())

    def window(self, before, target, begins, real, h) -> np.ndarray:
        shape, p, n = self.shape, self.p, HIDDEN
        steps, lanes = target.shape
        past, kept = [], []
        for t in range(steps):
            h = h * ~begins[t][:, None]
            past.append(h)
            h, *cache = _step(p, before[t], h)
            kept.append((h, *cache))
        grad = np.zeros_like(self.flat)
        g = shape.views(grad)
        states = np.concatenate([k[0] for k in kept])
        back = self._output(states, target.reshape(-1), real.reshape(-1), g).reshape(steps, lanes, n)
        carry = np.zeros((lanes, n), dtype=back.dtype)
        enters, throughs = (np.empty((steps, lanes, 3 * n), dtype=back.dtype) for _ in range(2))
        back_state = np.ascontiguousarray(p["state"].T)
        for t in range(steps - 1, -1, -1):
            d = carry + back[t]
            _, z, r, new, u = kept[t]
            shut = d - d * z
            through, own = throughs[t], enters[t]
            d_new = own[:, 2 * n :]
            np.multiply(shut, 1 - new * new, out=d_new)
            np.multiply(shut, (past[t] - new) * z, out=through[:, :n])
            np.multiply(d_new * u[:, 2 * n :], r - r * r, out=through[:, n : 2 * n])
            np.multiply(d_new, r, out=through[:, 2 * n :])
            carry = through @ back_state
            carry += d * z
            carry *= ~begins[t][:, None]
        throughs = throughs.reshape(-1, 3 * n)
        g["state"] += np.concatenate(past).T @ throughs
        enters[:, :, : 2 * n] = throughs.reshape(enters.shape)[:, :, : 2 * n]
        ids = before.reshape(-1)
        order = np.argsort(ids, kind="stable")
        rows, first = np.unique(ids[order], return_index=True)
        g["enter"][rows] = np.add.reduceat(enters.reshape(-1, 3 * n)[order], first, axis=0)
        norm = float(np.sqrt((grad * grad).sum())) / max(1, int(real.sum()))
        if norm > 1:
            grad /= norm
        grad /= lanes
        self.seen += grad * grad
        self.flat -= self.rate * grad / np.sqrt(self.seen)
        return h

    def _output(self, states, ids, real, g) -> np.ndarray:
        """Gradient of the loss by the states; that of the output weights goes to ``g``."""
        shape, p = self.shape, self.p
        kind = shape.class_of(ids)
        logits = states @ p["to_class"] + p["class_bias"]
        d, total, _ = _exponentials(logits)
        d *= (real / total)[:, None]
        d[np.arange(len(ids)), kind] -= real
        g["to_class"] += states.T @ d
        g["class_bias"] += np.ones(len(d), dtype=d.dtype) @ d
        back = d @ p["to_class"].T
        to_word, word_bias = p["to_word"].reshape(shape.groups, CLASS, HIDDEN), p["word_bias"].reshape(shape.groups, CLASS)
        g_word, g_bias = g["to_word"].reshape(shape.groups, CLASS, HIDDEN), g["word_bias"].reshape(shape.groups, CLASS)
        common = np.flatnonzero((ids < shape.head) & real)
        common = common[np.argsort(kind[common], kind="stable")]
        edge = np.searchsorted(kind[common], np.arange(shape.groups + 1))
        for k in np.flatnonzero(np.diff(edge)):
            i = common[edge[k] : edge[k + 1]]
            inner = states[i] @ to_word[k].T + word_bias[k]
            e, total, _ = _exponentials(inner)
            e /= total[:, None]
            e[np.arange(len(i)), ids[i] % CLASS] -= 1
            g_word[k] += e.T @ states[i]
            g_bias[k] += np.ones(len(e), dtype=e.dtype) @ e
            back[i] += e @ to_word[k]
        return back
