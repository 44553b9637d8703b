"""Quality classifier: a sparse rule ensemble.

Shallow trees over statistics of the whole text are grown on bootstraps of a bounded
sample of labelled rows; every path from a root becomes a conjunctive rule.  A lasso
logistic regression over the rules keeps few of them, and those that are left are
compiled into one Spark column expression over the statistics columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, free_names, labelled_sample

SAMPLE = 8000
TREES = 16
DEPTH = 3
STATS = (
    "n_bytes", "n_words", "word_bytes", "upper", "digits", "marks", "max_mark_share", "bangs", "bars", "lines", "same_as_before",
    "longest_run", "distinct", "marked_words", "upper_words", "non_ascii",
)
_MARKS = b"*#$%&+=<>@^_{}[]\\/~`"
#: A mark that is there three times or more in a row.
_REPEATED = re.compile(rb"([" + re.escape(_MARKS) + rb"])\1\1+")
#: Classes of bytes, for one look-up over a text: 1 upper, 2 digit, 3 mark, 4 "!", 5 "|", 6 line end, 7 above ASCII.
_CLASS = bytes(
    1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b in _MARKS else 4 if b == 33 else 5 if b == 124 else 6 if b == 10 else 7 if b > 127 else 0
    for b in range(256)
)


def statistics(text: bytes) -> list[float]:
    """The values of ``STATS`` for a whole text."""
    n = len(text)
    if not n:
        return [0.0] * len(STATS)
    counts = np.bincount(np.frombuffer(text.translate(_CLASS), dtype=np.uint8), minlength=8)
    words = text.split()
    total = max(len(words), 1)
    letters = max(n - len(words), 1)
    same = longest = run = 0
    before = None
    for w in words:
        if w == before:
            run += 1
            same += 1
            if run > longest:
                longest = run
        else:
            run, before = 0, w
    marks = int(counts[3])
    most = len(_REPEATED.findall(text)) if marks else 0
    upper_words = len([w for w in words if w.isupper()]) if counts[1] > 2 else 0
    marked = len([w for w in words if w[-1] in _MARKS]) if marks else 0
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), letters / total, counts[1] / letters, counts[2] / letters, marks / letters, most / total,
        counts[4] / total, counts[5] / total, counts[6] / total, same / total, float(longest), len(set(words)) / total, marked / total, upper_words / total,
        counts[7] / letters,
    ]


def with_statistics(df: DataFrame, text_col: str = "text", prefix: str = "q_") -> DataFrame:
    """All columns and one double per statistic; null texts count as empty."""
    names = [prefix + s for s in STATS]

    def rows(texts: list[bytes]) -> dict[str, list]:
        got = np.array([statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), len(STATS))
        return {name: got[:, i] for i, name in enumerate(names)}

    return add_columns(df, text_col, rows, {n: pa.float64() for n in names}, ", ".join(f"`{n}` double" for n in names))


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic number, threshold, whether above it), and the weight."""

    conditions: tuple[tuple[int, float, bool], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for k, t, above in self.conditions:
            out &= (x[:, k] > t) == above
        return out


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[Rule, ...]
    offset: float

    def expression(self, prefix: str = "q_") -> Column:
        """The score as a column over the statistics: the logistic of the weights of the rules that hold."""
        total = F.lit(self.offset)
        for rule in self.rules:
            met = F.lit(True)
            for k, t, above in rule.conditions:
                c = F.col(prefix + STATS[k])
                met = met & ((c > t) if above else (c <= t))
            total = total + F.when(met, F.lit(rule.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.offset)
        for rule in self.rules:
            z += np.where(rule.holds(x), rule.weight, 0.0)
        return 1 / (1 + np.exp(-z))


def _grow(x, y, w, rows, depth, rng, path, out):
    """Splits by weighted Gini impurity over quantile thresholds of some statistics; every node but the root is a rule."""
    if path:
        out.add(path)
    if depth == 0 or len(rows) < 8:
        return
    yr, wr = y[rows], w[rows]
    total, hits = wr.sum(), (wr * yr).sum()
    if hits in (0, total):
        return
    best = (2 * hits * (total - hits) / total - 1e-9, None, None)
    for k in rng.permutation(x.shape[1])[: max(5, x.shape[1] * 2 // 3)]:
        v = x[rows, k]
        order = np.argsort(v, kind="stable")
        sv, cw, ch = v[order], np.cumsum(wr[order]), np.cumsum((wr * yr)[order])
        cuts = np.flatnonzero(sv[1:] > sv[:-1])
        if not len(cuts):
            continue
        if len(cuts) > 64:
            cuts = cuts[np.linspace(0, len(cuts) - 1, 64).astype(int)]
        lw, lh = cw[cuts], ch[cuts]
        rw, rh = total - lw, hits - lh
        impurity = 2 * lh * (lw - lh) / lw + 2 * rh * (rw - rh) / np.maximum(rw, 1e-12)
        i = int(impurity.argmin())
        if impurity[i] < best[0]:
            best = (impurity[i], int(k), float((sv[cuts[i]] + sv[cuts[i] + 1]) / 2))
    if best[1] is None:
        return
    _, k, t = best
    left = x[rows, k] <= t
    _grow(x, y, w, rows[left], depth - 1, rng, (*path, (k, t, False)), out)
    _grow(x, y, w, rows[~left], depth - 1, rng, (*path, (k, t, True)), out)


def _lasso(z: np.ndarray, y: np.ndarray, w: np.ndarray, strength: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient steps; the offset is free."""
    n, p = z.shape
    a = np.hstack([z, np.ones((n, 1))])
    rate = 4 / max(np.linalg.norm(a * np.sqrt(w)[:, None], 2) ** 2 / w.sum(), 1e-9)
    b = look = np.zeros(p + 1)
    t = 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(a @ look, -30, 30))) - y
        new = look - rate * (a.T @ (w * r)) / w.sum()
        new[:p] = np.sign(new[:p]) * np.maximum(np.abs(new[:p]) - rate * strength, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, b, t = new + (t - 1) / s * (new - b), new, s
    return b[:p], float(b[p])


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, strength: float = 2e-3, seed: int = 5) -> Ensemble:
    """An ensemble from statistics and labels; with one class only, the constant one."""
    if not len(y) or y.min() == y.max():
        return Ensemble((), 0.0 if not len(y) else 4.0 if y[0] else -4.0)
    rng = np.random.default_rng(seed)
    w = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    paths: set = set()
    for _ in range(trees):
        _grow(x, y, w, rng.integers(0, len(y), min(len(y), 4000)), depth, rng, (), paths)
    by_rows: dict[bytes, Rule] = {}
    for path in sorted(paths, key=lambda p: (len(p), p)):
        rule = Rule(path)
        held = rule.holds(x)
        if 0 < held.sum() < len(held):
            by_rows.setdefault(np.packbits(held).tobytes(), rule)
    rules = list(by_rows.values())
    z = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64)
    weights, offset = _lasso(z, y.astype(np.float64), w, strength)
    kept = tuple(Rule(r.conditions, round(float(v), 6)) for r, v in zip(rules, weights, strict=True) if abs(v) > 1e-3)
    model = Ensemble(kept, offset)
    # The offset is set so that 0.5 parts the classes best on the sample.
    s = model.scores(x)
    s = np.log(s / (1 - s))
    order = np.argsort(s)
    wrong = np.cumsum(y[order]) + (len(y) - y.sum() - np.cumsum(1 - y[order]))
    i = int(wrong.argmin())
    if wrong[i] < ((s >= 0) != y).sum() and i + 1 < len(s):
        model = Ensemble(kept, offset - float((s[order[i]] + s[order[i + 1]]) / 2))
    return model


def fit(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", sample: int = SAMPLE) -> Ensemble:
    """An ensemble from at most about ``sample`` labelled rows of either class for which ``keep`` holds;
    only their statistics come to the driver."""
    got = with_statistics(labelled_sample(docs, labels, label, keep, sample)).drop("text").toPandas()
    got = got.sort_values(list(got.columns)).to_numpy(dtype=np.float64)
    return train(got[:, 1:], got[:, 0].astype(int))


def score(docs: DataFrame, model: Ensemble, text_col: str = "text", name: str = "score", prefix: str = "__q_") -> DataFrame:
    """All columns of ``docs`` and the score.  Null and empty texts have the score of
    statistics that are all zero; repeated rows and null ids are kept."""
    return with_statistics(docs, text_col, prefix).withColumn(name, model.expression(prefix)).drop(*(prefix + s for s in STATS))


def keep_good(docs: DataFrame, model: Ensemble, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, their columns unchanged."""
    name, prefix = free_names(docs, "__score", "__q")
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return score(docs, model, text_col, name, prefix).where(F.col(name) >= least).select(*docs.columns)
