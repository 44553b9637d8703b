"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of two hashed embeddings, of the word and of its first
letters, so that inflected forms share what they have in common.  Filters of several
widths run over the words; each is max-pooled over the whole text, and a logistic
layer gives a logit.  It is trained in numpy on a bounded sample of labelled rows;
the log-odds of the hashed features there start one dimension of the embeddings.
Thresholds are calibrated by language on rows kept out of training; the language is
guessed from the text's own function words, so the score depends on the text alone.
A score is the sigmoid of the logit less its language's threshold.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import labelled_sample, map_text, words_of

BUCKETS = 1 << 15
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
PREFIX = 5
REACH = max(WIDTHS)
#: Bound of the sample that is learnt from, rows of either class.
SAMPLE = 4000
_BATCH_WORDS = 1 << 16
_KEEP = 500_000

# Frequent function words by language.
STOPWORDS = {
    "en": "the of and to in is that for was on are with this from".split(),
    "fr": "le la les des et une dans que sur est du pas pour".split(),
    "de": "der die das und den ist mit von zu ein auf nicht".split(),
    "es": "el los las que del por con una para no como".split(),
}
LANGUAGES = (*STOPWORDS, "other")
_LANGUAGE_OF: dict[bytes, int] = {}
for _k, _words in enumerate(STOPWORDS.values()):
    for _w in _words:
        _LANGUAGE_OF.setdefault(_w.encode(), _k)


class Hasher:
    """Words to feature numbers: bucket of the word and bucket of its beginning, packed, and above
    them the language of a function word; what is known is kept, within a bound."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def _miss(self, word: bytes) -> int:
        stem = word.decode("utf-8", "replace")[:PREFIX].encode()
        language = _LANGUAGE_OF.get(word, -1) + 1
        value = language << 32 | (zlib.crc32(word) % BUCKETS) << 16 | zlib.crc32(b"^" + stem) % BUCKETS | 1 << 40
        if len(self.known) >= _KEEP:
            self.known.clear()
        if len(word) <= 64:
            self.known[word] = value
        return value

    def __call__(self, text: bytes) -> tuple[np.ndarray, int]:
        """Features of the words, and the language by function words."""
        words = words_of(text)
        get, miss = self.known.get, self._miss
        features = np.array([get(w) or miss(w) for w in words], dtype=np.int64)
        votes = np.bincount(features >> 32 & 0xFF, minlength=len(LANGUAGES))[1:]
        language = int(votes.argmax()) if votes.any() else len(LANGUAGES) - 1
        return features & 0xFFFFFFFF, language


@dataclass
class Model:
    words: np.ndarray
    stems: np.ndarray
    kernel: np.ndarray  # (REACH * DIM, filters)
    bias: np.ndarray
    out: np.ndarray
    offset: float
    thresholds: np.ndarray

    @property
    def filters(self) -> int:
        return len(self.bias)

    def unfolded(self, features: np.ndarray) -> np.ndarray:
        """(n, REACH * DIM): each word's vector and those of the next words; zero past the end."""
        x = self.words[features >> 16] + self.stems[features & 0xFFFF]
        n = len(x)
        out = np.zeros((n, REACH * DIM), dtype=np.float32)
        for j in range(min(REACH, n)):
            out[: n - j, j * DIM : (j + 1) * DIM] = x[j:]
        return out

    def pooled(self, features: np.ndarray) -> np.ndarray:
        """The maximum of every filter over the whole text, a block at a time; zero for no words."""
        best = np.zeros(self.filters, dtype=np.float32)
        for i in range(0, len(features), _BATCH_WORDS):
            x = self.unfolded(features[i : i + _BATCH_WORDS + REACH - 1])
            best = np.maximum(best, (x @ self.kernel + self.bias).max(axis=0))
        return best

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        """Short texts share blocks; words of the next text never reach into one."""
        pooled = np.zeros((len(texts), self.filters), dtype=np.float32)
        group: list[int] = []
        size = 0

        def flush():
            nonlocal size
            if not group:
                return
            gap = np.zeros((REACH - 1, DIM), dtype=np.float32)
            parts, starts, n = [], [], 0
            for i in group:
                starts.append(n)
                parts += [self.words[texts[i] >> 16] + self.stems[texts[i] & 0xFFFF], gap]
                n += len(texts[i]) + REACH - 1
            x = np.concatenate(parts)
            x = np.concatenate([x, np.zeros((REACH - 1, DIM), dtype=np.float32)])
            wide = np.concatenate([x[j : j + n] for j in range(REACH)], axis=1)
            z = wide @ self.kernel
            for k, at in enumerate(starts):
                pooled[group[k]] = z[at : at + len(texts[group[k]])].max(axis=0) + self.bias
            group.clear()
            size = 0

        for i, t in enumerate(texts):
            if len(t) > _BATCH_WORDS:
                pooled[i] = self.pooled(t)
            elif len(t):
                group.append(i)
                size += len(t)
                if size >= _BATCH_WORDS:
                    flush()
        flush()
        return np.maximum(pooled, 0) @ self.out + self.offset


def _mask() -> np.ndarray:
    """Which kernel entries a filter of its width has."""
    mask = np.zeros((REACH * DIM, FILTERS * len(WIDTHS)), dtype=np.float32)
    for k, w in enumerate(WIDTHS):
        mask[: w * DIM, k * FILTERS : (k + 1) * FILTERS] = 1
    return mask


def train(samples: list[tuple[np.ndarray, int, int]], epochs: int = 6, rate: float = 0.02, seed: int = 7) -> Model:
    """``samples``: (features, language, label).  Every fifth row calibrates and is not trained on."""
    rng = np.random.default_rng(seed)
    fit = [s for i, s in enumerate(samples) if i % 5]
    held = samples[::5]
    n = FILTERS * len(WIDTHS)
    model = Model(
        rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32),
        (rng.normal(0, 0.2, (REACH * DIM, n)) * _mask()).astype(np.float32), np.zeros(n, dtype=np.float32), np.full(n, 0.1, dtype=np.float32), 0.0, np.zeros(len(LANGUAGES)),
    )
    labels = np.array([s[2] for s in fit], dtype=np.float32)
    if len(fit) and 0 < labels.sum() < len(labels):
        for table, shift, mask in ((model.words, 16, 0xFFFF), (model.stems, 0, 0xFFFF)):
            seen = np.full((2, BUCKETS), 0.3)
            for f, _, y in fit:
                seen[y][np.unique(f >> shift & mask)] += 1
            odds = np.log(seen[1] / (labels.sum() + 1)) - np.log(seen[0] / (len(labels) - labels.sum() + 1))
            odds -= 1.5 * np.sign(odds) * np.minimum(np.abs(odds) / 1.5, 1)  # what is seen once says little
            table[:, 0] = np.clip(odds, -4, 4) / 4
        model.kernel[0, :FILTERS] = 1.0
        model.out[:FILTERS] = 0.5
        _descend(model, fit, labels, epochs, rate, rng)
    model.thresholds[:] = _thresholds(model, held or samples)
    return model


def _descend(model: Model, fit: list, labels: np.ndarray, epochs: int, rate: float, rng) -> None:
    """Adam on the log loss; classes weigh the same.  A filter's gradient reaches the word it peaked at."""
    mask = _mask()
    params = [model.words, model.stems, model.kernel, model.bias, model.out]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    offset = np.zeros(3)
    weight = np.where(labels > 0, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(fit))
        for i in range(0, len(order), 64):
            rows = order[i : i + 64]
            grads = [None, None, np.zeros_like(model.kernel), np.zeros_like(model.bias), np.zeros_like(model.out)]
            at_words, at_stems, pieces = [], [], []
            offset_grad = 0.0
            for r in rows:
                f = fit[r][0]
                if len(f) == 0:
                    continue
                x = model.unfolded(f)
                z = x @ model.kernel
                top = z.argmax(axis=0)
                value = z[top, np.arange(len(top))] + model.bias
                active = np.maximum(value, 0)
                p = 1 / (1 + np.exp(-np.clip(active @ model.out + model.offset, -30, 30)))
                d = (p - labels[r]) * weight[r] / len(rows)
                grads[4] += d * active
                offset_grad += d
                dz = d * model.out * (value > 0)
                grads[3] += dz
                grads[2] += x[top].T * dz
                dx = (model.kernel * dz).T.reshape(len(top), REACH, DIM)
                for j in range(REACH):
                    at = np.minimum(top + j, len(f) - 1)
                    ok = top + j < len(f)
                    at_words.append(f[at] >> 16)
                    at_stems.append(f[at] & 0xFFFF)
                    pieces.append(dx[:, j] * ok[:, None])
            if not pieces:
                continue
            step += 1
            grads[2] *= mask
            piece = np.concatenate(pieces)
            for k, at in ((0, np.concatenate(at_words)), (1, np.concatenate(at_stems))):
                own, back = np.unique(at, return_inverse=True)
                g = np.zeros((len(own), DIM), dtype=np.float32)
                np.add.at(g, back, piece)
                # Rows that are not touched keep their moments (lazy Adam).
                first[k][own] = 0.9 * first[k][own] + 0.1 * g
                second[k][own] = 0.99 * second[k][own] + 0.01 * g * g
                params[k][own] -= 0.5 * rate * first[k][own] / (np.sqrt(second[k][own]) + 1e-6)
            for k in (2, 3, 4):
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.99 * second[k] + 0.01 * grads[k] ** 2
                params[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
            offset[0] = 0.9 * offset[0] + 0.1 * offset_grad
            offset[1] = 0.99 * offset[1] + 0.01 * offset_grad**2
            model.offset -= rate * (offset[0] / (1 - 0.9**step)) / (np.sqrt(offset[1] / (1 - 0.99**step)) + 1e-6)
        rate *= 0.7


def _best(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the widest gap of logits with the best F1."""
    order = np.argsort(-logits)
    z, y = logits[order], labels[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(len(y)) + 1 + y.sum())
    f1 = np.where(np.append(z[1:] < z[:-1], True), f1, -1)
    gaps = np.append(z[:-1] - z[1:], 1.0)
    k = max(np.flatnonzero(f1 >= f1.max() - 1e-9), key=lambda i: gaps[i])
    return float(z[k] - gaps[k] / 2)


def _thresholds(model: Model, held: list) -> np.ndarray:
    """By language, drawn towards that of all rows where a language has few labelled ones."""
    if not held:
        return np.zeros(len(LANGUAGES))
    logits = model.logits([s[0] for s in held])
    labels, languages = np.array([s[2] for s in held]), np.array([s[1] for s in held])
    if not 0 < labels.sum() < len(labels):
        return np.zeros(len(LANGUAGES))
    every = _best(logits, labels)
    out = np.full(len(LANGUAGES), every)
    for k in range(len(LANGUAGES)):
        own = languages == k
        n = int(labels[own].sum())
        if n >= 5 and n < own.sum():
            out[k] = (n * _best(logits[own], labels[own]) + 20 * every) / (n + 20)
    return out


def fit(docs: DataFrame, labels: DataFrame, keep, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from at most about ``sample`` labelled rows of either class, whole texts each,
    of those label rows for which ``keep`` holds."""
    hasher = Hasher()
    rows = labelled_sample(docs, labels, label, keep, sample, max_text_bytes=2 * _BATCH_WORDS).toLocalIterator()
    got = [(zlib.crc32(t), *hasher(t), y) for t, y in ((r["text"].encode(), r["label"]) for r in rows)]
    got.sort(key=lambda r: (r[0], r[3], len(r[1])))
    return train([r[1:] for r in got])


_hashers: list[Hasher] = []


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row, from its whole text.

    A null or empty text has the score of no words.  Null ids and repeated rows are
    kept, other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(texts: list[bytes]) -> dict[str, list]:
        if not _hashers:
            _hashers.append(Hasher())
        hasher, model = _hashers[0], held.value
        scores: list[float] = []
        for i in range(0, len(texts), 512):
            got = [hasher(t) for t in texts[i : i + 512]]
            z = model.logits([g[0] for g in got]) - model.thresholds[[g[1] for g in got]]
            scores += (1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))).tolist()
        return {"score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    return map_text(docs, id_col, text_col, rows, {"score": pa.float64(), "predicted": pa.int32()}, "score double, predicted int")
