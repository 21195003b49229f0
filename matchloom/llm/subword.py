"""Text classifier on averaged, hashed subword vectors.

A word stands for its own hashed vector and those of its character n-grams
(with ``<`` and ``>`` at its ends); with ``pairs``, each two neighbouring words
have a vector as well.  A text is the mean of its vectors, a linear layer with
softmax sits on top, and both are learned by stochastic gradient descent in
numpy.  As the mean and the layer are linear, a trained model is a table of
class scores by bucket, of ``buckets * classes`` floats whatever the corpus;
that table is all that goes to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

#: Words that a worker remembers before it starts anew.
_REMEMBER = 200_000


@dataclass(frozen=True)
class Config:
    """Parameters of training; ``rows`` bounds the sample of labelled rows of each class, ``longest`` the characters of
    a text in it, so that what the driver holds is bounded (texts that are scored have any length)."""

    buckets: int = 1 << 17
    dim: int = 12
    ngrams: tuple[int, ...] = (2, 3)
    pairs: bool = False
    rows: int = 1500
    longest: int = 50_000
    epochs: int = 5
    rate: float = 0.3
    vector_rate: float = 2.0
    prior: float = 20.0  # vectors of value zero that every text has besides its own
    seed: int = 7


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _features(words: list[str], c: Config) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of words: for the words themselves and each length of n-grams an array by word
    and place (-1: no n-gram starts there), then where each word starts, and its length."""
    sizes = np.array([len(w) for w in words], np.int64) + 2
    chars = np.frombuffer(f"<{'><'.join(words)}>".encode("utf-32-le"), "<u4").astype(np.uint64)
    end = np.cumsum(sizes)
    first = end - sizes
    place = np.arange(len(chars)) - np.repeat(first, sizes)
    left = np.repeat(end, sizes) - np.arange(len(chars))
    whole = np.add.reduceat(_mixed(chars + (place.astype(np.uint64) << np.uint64(21))), first)
    own = np.full(len(chars), -1, np.int64)
    own[first] = (_mixed(whole) % np.uint64(c.buckets)).astype(np.int64)
    out = [own]
    for n in c.ngrams:
        key = np.full(len(chars), n, np.uint64)
        for k in range(n):
            key[: len(chars) - k] = _mixed(key[: len(chars) - k] + (chars[k:] << np.uint64(3)))
        out.append(np.where(left >= n, (key % np.uint64(c.buckets)).astype(np.int64), -1))
    return out, first, sizes


def _pair(a: np.ndarray, b: np.ndarray, c: Config) -> np.ndarray:
    mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B1) + b.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    at = ((mixed >> np.uint64(33)) % np.uint64(c.buckets)).astype(np.int64)
    at[a == b] = 0  # a word said twice is one feature, whichever word it is
    return at


def _counted(text: str, c: Config) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs, in four bytes each, as the driver holds those of the whole sample."""
    words = text.split()
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    features, first, _ = _features(words, c)
    own = features[0][first]
    at = np.concatenate([f[f >= 0] for f in features])
    if c.pairs and len(own) > 1:
        at = np.concatenate((at, _pair(own[:-1], own[1:], c)))
    at, count = np.unique(at, return_counts=True)
    return at.astype(np.int32), count.astype(np.int32)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class Model:
    classes: list
    config: Config
    table: np.ndarray  # class scores by bucket
    bias: np.ndarray
    temperature: float = 1.0
    _known: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def _scored(self, words: list[str]) -> np.ndarray:
        """Class scores of each word summed over its vectors, their number, and the word's own bucket."""
        features, first, _ = _features(words, self.config)
        out = np.zeros((len(words), len(self.classes) + 2))
        table = np.concatenate((self.table, np.zeros((1, self.table.shape[1]), self.table.dtype)))  # -1: nothing
        for f in features:
            out[:, :-2] += np.add.reduceat(table[f].astype(np.float64), first, axis=0)
            out[:, -2] += np.add.reduceat((f >= 0).astype(np.float64), first)
        out[:, -1] = features[0][first]
        return out

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """Class probabilities of each text; a text without words has those of the bias."""
        c, k = self.config, len(self.classes)
        known = self._known
        if not known or len(known["at"]) > _REMEMBER:
            known.clear()
            known |= {"at": {}, "matrix": np.empty((0, k + 2))}
        at = known["at"]
        ids: list[int] = []
        sizes, new = [], []
        for text in texts:
            n = len(ids)
            for w in text.split():
                i = at.get(w)
                if i is None:
                    at[w] = i = len(at)
                    new.append(w)
                ids.append(i)
            sizes.append(len(ids) - n)
        if new:
            known["matrix"] = np.concatenate((known["matrix"], *(self._scored(new[i : i + 20_000]) for i in range(0, len(new), 20_000))))
        sizes = np.array(sizes, np.int64)
        out = np.zeros((len(texts), k + 1))
        if ids:
            some = known["matrix"][np.array(ids, np.int64)]
            first = np.cumsum(sizes) - sizes
            full = np.flatnonzero(sizes)
            out[full] = np.add.reduceat(some[:, : k + 1], first[full], axis=0)
            if c.pairs and len(ids) > 1:
                own = some[:, -1].astype(np.int64)
                score = self.table[_pair(own[:-1], own[1:], c)].astype(np.float64)
                last = np.cumsum(sizes)[full] - 1
                score[last[last < len(score)]] = 0  # no pair across two texts
                score = np.concatenate((score, np.zeros((1, k))))
                out[full, :k] += np.add.reduceat(score, first[full], axis=0)
                out[full, k] += sizes[full] - 1
        mean = out[:, :k] / (out[:, k:] + c.prior)
        return _softmax((mean + self.bias) / self.temperature)


def train(rows: Iterable[tuple[str, object]], classes: list, c: Config) -> Model:
    """Fit on (text, label) rows, of which one text is held at a time; every tenth row sets the temperature only.

    Without rows the model knows its classes only, all alike.
    """
    rng = np.random.default_rng(c.seed)
    y = {label: k for k, label in enumerate(classes)}
    data = [(*_counted(text, c), y[label]) for text, label in rows]
    data = [d for d in data if len(d[0])]
    k = max(1, len(classes))
    vectors = ((rng.random((c.buckets, c.dim)) - 0.5) / c.dim).astype(np.float32)
    layer, bias = (rng.standard_normal((c.dim, k)) / c.dim).astype(np.float32), np.zeros(k, np.float32)
    seen = np.bincount([d[2] for d in data], minlength=k) if data else np.ones(k)
    weight = np.sqrt(seen.sum() / (k * np.maximum(seen, 1)))
    held, fit = list(range(0, len(data), 10)), [i for i in range(len(data)) if i % 10]
    total, step = max(1, c.epochs * len(fit)), 0
    for _ in range(c.epochs):
        for i in rng.permutation(fit):
            at, count, label = data[i]
            share = (count / (count.sum() + c.prior)).astype(np.float32)
            mean = share @ vectors[at]
            grad = _softmax(mean @ layer + bias)
            grad[label] -= 1
            grad *= weight[label]
            rate = 1 - step / total
            step += 1
            back = layer @ grad
            layer -= c.rate * rate * np.outer(mean, grad)
            bias -= 0.1 * c.rate * rate * grad
            vectors[at] -= (c.vector_rate * rate) * share[:, None] * back
    table = vectors @ layer if fit else np.zeros((c.buckets, k), np.float32)
    model = Model(list(classes), c, table, bias.astype(np.float64))
    if held:
        logits = np.array([(count / (count.sum() + c.prior)) @ table[at] + bias for at, count, _ in (data[i] for i in held)])
        label = np.array([data[i][2] for i in held])
        cost = lambda t: -np.log(_softmax(logits / t)[np.arange(len(label)), label] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 10, 81), key=cost))
    return model
