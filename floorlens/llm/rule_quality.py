"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees of small depth are grown on a bounded sample of labelled rows;
every path from a root to a node is a conjunction of comparisons. A logistic
regression with an L1 penalty over all of those rules keeps few of them, and
what is left is compiled into one Spark expression over the statistics, which
are Spark expressions themselves. Scoring runs no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

SAMPLE = 20_000
TREES, DEPTH, BINS, SHRINK, LEAST = 24, 3, 48, 0.3, 20
PENALTY, STEPS = 2e-3, 400
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
MARKS = "!#$%&*+/<=>@[]^_`{|}~\\"
CUTOFF = 0.3


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def statistics(text: Column) -> dict[str, Column]:
    """Numbers that describe a text; null is empty."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    words = F.split(text, " ")
    lines = F.split(text, "\n")

    def share(characters: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, characters, ""))) / size

    return {
        "log_size": F.log1p(F.length(text).cast("double")),
        "upper": share(UPPER),
        "digits": share(DIGITS),
        "marks": share(MARKS),
        "bangs": share("!"),
        "bars": share("|"),
        "stops": share(".,;:?"),
        "blanks": share(" "),
        "breaks": share("\n"),
        "fresh_words": F.size(F.array_distinct(words)) / F.size(words),
        "fresh_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "wide": (F.octet_length(text) - F.length(text)) / size,
    }


@dataclass(frozen=True)
class Rules:
    """``rules``: (weight, ((statistic, above, threshold), ...))."""

    bias: float
    rules: tuple[tuple[float, tuple[tuple[str, bool, float], ...]], ...]

    def score(self, values: dict[str, Column]) -> Column:
        total = F.lit(float(self.bias))
        for weight, parts in self.rules:
            holds = F.lit(True)
            for name, above, threshold in parts:
                holds &= (values[name] > threshold) if above else (values[name] <= threshold)
            total += F.when(holds, F.lit(float(weight))).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _grow(bins: np.ndarray, edges: list[np.ndarray], slope: np.ndarray, curve: np.ndarray):
    """One tree: its paths as tuples of (feature, above, threshold), and what
    it adds to each row."""
    paths, add = [], np.zeros(len(slope))

    def split(rows: np.ndarray, path: tuple):
        g, h = slope[rows], curve[rows]
        total_g, total_h = g.sum(), h.sum()
        best = (1e-6, None)
        for f in range(bins.shape[1] if len(path) < DEPTH else 0):
            b = bins[rows, f]
            left_g = np.cumsum(np.bincount(b, g, BINS + 1))[:-1]
            left_h = np.cumsum(np.bincount(b, h, BINS + 1))[:-1]
            n = np.cumsum(np.bincount(b, minlength=BINS + 1))[:-1]
            gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
            gain[(n < LEAST) | (len(rows) - n < LEAST)] = 0
            gain = gain[: len(edges[f])]
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (f, int(gain.argmax())))
        if best[1] is None:
            add[rows] = -SHRINK * total_g / (total_h + 1)
            return
        f, at = best[1]
        for above in (False, True):
            more = (*path, (f, above, float(edges[f][at])))
            paths.append(more)
            split(rows[(bins[rows, f] > at) == above], more)

    split(np.arange(len(slope)), ())
    return paths, add


def _merged(path: tuple) -> tuple:
    """A path with one comparison per statistic and direction."""
    tight: dict = {}
    for f, above, threshold in path:
        old = tight.get((f, above), threshold)
        tight[f, above] = max(old, threshold) if above else min(old, threshold)
    return tuple((f, above, t) for (f, above), t in sorted(tight.items()))


def train(values: np.ndarray, labels: np.ndarray, names: list[str]) -> Rules:
    """Without two classes among the labels the rules are empty and the bias
    is the smoothed share of label 1."""
    n = len(labels)
    mean = (labels.sum() + 0.5) / (n + 1)
    bias = float(np.log(mean / (1 - mean)))
    if len(set(labels.tolist())) < 2:
        return Rules(bias, ())
    edges = [np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1])) for v in values.T]
    bins = np.stack([np.searchsorted(e, v, side="left") for e, v in zip(edges, values.T, strict=True)], 1)
    margin, found = np.full(n, bias), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        paths, add = _grow(bins, edges, p - labels, p * (1 - p))
        margin += add
        found.update(dict.fromkeys(map(_merged, paths)))
    rules = list(found)
    x = np.ones((n, len(rules)), np.float32)
    for j, rule in enumerate(rules):
        for f, above, threshold in rule:
            x[:, j] *= (values[:, f] > threshold) == above
    # accelerated proximal gradient for the logistic loss with an L1 penalty
    centre = x.mean(0)
    spread = np.maximum(x.std(0), 1e-3)
    z = (x - centre) / spread
    bound = z.shape[1] / 4 if z.shape[1] else 1.0
    v = np.random.default_rng(1).normal(size=z.shape[1]).astype(np.float32)
    for _ in range(20):
        v = z.T @ (z @ v)
        bound = float(np.linalg.norm(v)) / n / 4
        v /= np.linalg.norm(v) + 1e-12
    rate = 1 / (1.1 * bound + 0.25)
    w, look, t = np.zeros(z.shape[1], np.float32), np.zeros(z.shape[1], np.float32), 1.0
    b = bias
    for _ in range(STEPS):
        error = (1 / (1 + np.exp(-(z @ look + b))) - labels).astype(np.float32)
        step = look - rate * (z.T @ error) / n
        fresh = np.sign(step) * np.maximum(np.abs(step) - rate * PENALTY, 0)
        b -= rate * float(error.mean())
        turn = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = fresh + (t - 1) / turn * (fresh - w), fresh, turn
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    weight = w / spread
    return Rules(
        float(b - (weight[kept] * centre[kept]).sum()),
        tuple((float(weight[j]), tuple((names[f], above, t) for f, above, t in rules[j])) for j in kept),
    )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Rules:
    """Learns ``labels.quality`` of rows that are not held out, from at most
    about ``sample`` labelled rows drawn by a hash of the id. The drawn labels
    are few, so they travel to the documents and no text is shuffled."""
    rows = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1e6 * sample / n)))
    drawn = F.broadcast(rows.select("doc_id", "quality").limit(2 * sample))
    values = statistics(F.col("text"))
    got = docs.select("doc_id", "text").join(drawn, "doc_id").select("quality", *[c.alias(k) for k, c in values.items()])
    got = got.toPandas().to_numpy(float).reshape(-1, len(values) + 1)
    order = np.lexsort(got.T)
    return train(got[order, 1:], (got[order, 0] > 0).astype(float), list(values))


def score(docs: DataFrame, rules: Rules, cutoff: float = CUTOFF) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from ``cutoff`` on) to each
    row. Null and empty texts are scored by their statistics like others.
    Columns of the same names are replaced."""
    values = {f"_{k}": c for k, c in statistics(F.col("text")).items()}
    out = docs.withColumns(values).withColumn("score", rules.score({k: F.col(f"_{k}") for k in statistics(F.col("text"))}))
    return out.withColumn("predicted", (F.col("score") >= cutoff).cast("int")).drop(*values)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``."""
    read = docs.select("doc_id", "text")
    scored = score(read, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
