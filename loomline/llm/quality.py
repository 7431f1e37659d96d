"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a document (shares of character classes, word and line shape, repetition) come from its whole
text, in numpy. Trees are grown on the driver from a bounded sample of labelled rows (`most_rows`, taken by
hash of the id), on histograms of at most BINS bins a statistic; then all trees lie in flat arrays, which are
broadcast (a few thousand numbers) and walked by all rows of a batch at once.

Defined results: null and empty texts have all statistics 0 and are scored by the same trees. With no labelled
row the score is 0.5, with labels of one kind it is near that kind's share. A document labelled more than once
counts as its least label, and an id that several texts have as the least statistics of them; labels other than 0 and 1, and null labels, teach nothing. Repeated rows each get the
same score; other columns pass through, and a column called like an added one gives way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.sparkkit import add_columns
from loomline.llm.textkit import STEP, text_bytes, words

BINS = 64
MOST_ROWS = 30_000
THRESHOLD = 0.3

_CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)), "space": b" \t\r\x0b\x0c", "line": b"\n",
    "stop": b".,;:?", "shout": b"!", "mark": b"*#$%&@^~", "bar": b"|<>{}[]\\", "quote": b"\"'`()", "join": b"-_/=+", "control": bytes([*range(9), *range(14, 32), 127]),
    "other": bytes(range(192, 256)),
}
STATISTICS = [
    "bytes", "words", "lines", *(f"share_{k}" for k in _CLASSES), "word_length", "longest_word", "words_a_line", "distinct_words", "repeated_next",
    "repeated_second", "most_frequent", "marked_words", "short_words", "upper_of_letters",
]


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text."""
    data, offs = text_bytes(column)
    n = len(offs) - 1
    counts = np.zeros((n, 256), np.int64)
    length = np.diff(offs)
    for at in range(0, len(data), STEP):
        part = data[at : at + STEP]
        lo, hi = int(np.searchsorted(offs, at, "right")) - 1, int(np.searchsorted(offs, at + len(part), "left"))
        edge = np.clip(offs[lo : hi + 1], at, at + len(part))
        row = np.repeat(np.arange(hi - lo), np.diff(edge))
        counts[lo:hi] += np.bincount(row * 256 + part, minlength=(hi - lo) * 256).reshape(-1, 256)
    chars = counts[:, :128].sum(axis=1) + counts[:, 192:].sum(axis=1)
    by = {k: counts[:, list(v)].sum(axis=1) for k, v in _CLASSES.items()}
    rows, h, size = words(data, offs)
    first = np.searchsorted(rows, np.arange(n + 1))
    total = np.diff(first)
    some = np.maximum(total, 1)
    size = size.astype(np.float64)
    add = lambda x: np.bincount(rows, x, n) if len(rows) else np.zeros(n)
    longest, distinct, most = np.zeros(n), np.zeros(n), np.zeros(n)
    nexts, second = np.zeros(len(rows)), np.zeros(len(rows))
    if len(rows):
        full = np.flatnonzero(total)
        longest[full] = np.maximum.reduceat(size, first[:-1][full])
        nexts[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
        second[2:] = (h[2:] == h[:-2]) & (rows[2:] == rows[:-2])
        key = np.sort((rows.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        run = np.diff(np.concatenate([starts, [len(key)]]))
        owner = (key[starts] >> np.uint64(40)).astype(np.int64)
        distinct = np.bincount(owner, minlength=n).astype(float)
        np.maximum.at(most, owner, run)
    marks = by["mark"] + by["shout"] + by["bar"]
    letters = np.maximum(by["upper"] + by["lower"] + by["other"], 1)
    wide = np.maximum(chars, 1)
    return np.column_stack([
        length, total, by["line"] + (chars > 0), *(by[k] / wide for k in _CLASSES), add(size) / some, longest, total / (by["line"] + 1), distinct / some,
        add(nexts) / some, add(second) / some, most / some, marks / some, add(size <= 2) / some, by["upper"] / letters,
    ])


@dataclass
class Forest:
    """All trees on end: at node i, statistic[i] <= cut[i] goes to left[i], else left[i] + 1; leaves have left 0."""

    base: float
    roots: np.ndarray
    statistic: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                down = self.left[node]
                node = np.where(down > 0, down + (x[rows, self.statistic[node]] > self.cut[node]), node)
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, least: int = 8, ridge: float = 1.0) -> Forest:
    """Boost trees for the logistic loss, on histograms of gradients."""
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
    binned = np.column_stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)]) if n else np.zeros((0, width), int)
    statistic, cut, left, value, roots = [], [], [], [], []
    margin = np.full(n, base)
    for _ in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, w = p - y, np.maximum(p * (1 - p), 1e-9)
        roots.append(len(left))
        at = np.full(n, len(left))
        for store in (statistic, cut, left, value):
            store.append(0)
        level = [roots[-1]]
        for _ in range(depth):
            place = np.full(len(left), -1)
            place[level] = np.arange(len(level))
            own = place[at]
            live = np.flatnonzero(own >= 0)
            table = np.zeros((3, len(level), width, BINS))
            for j in range(width):
                key = own[live] * BINS + binned[live, j]
                for k, v in enumerate((g[live], w[live], None)):
                    table[k, :, j] = np.bincount(key, v, len(level) * BINS).reshape(-1, BINS)
            total = table[:, :, :1].sum(axis=3, keepdims=True)
            low = np.cumsum(table, axis=3)[..., :-1]
            high = total - low
            gain = low[0] ** 2 / (low[1] + ridge) + high[0] ** 2 / (high[1] + ridge) - total[0] ** 2 / (total[1] + ridge)
            gain[(low[2] < least) | (high[2] < least)] = 0
            nexts = []
            for i, node in enumerate(level):
                j, b = divmod(int(gain[i].argmax()), BINS - 1)
                if gain[i, j, b] <= 1e-6 or b >= len(cuts[j]):
                    continue
                statistic[node], cut[node], left[node] = j, cuts[j][b], len(left)
                nexts += [len(left), len(left) + 1]
                for store in (statistic, cut, left, value):
                    store += [0, 0]
                mine = live[own[live] == i]
                at[mine] = left[node] + (binned[mine, j] > b)
            if not nexts:
                break
            level = nexts
        sums, weights = np.bincount(at, g, len(left)), np.bincount(at, w, len(left))
        for node in range(roots[-1], len(left)):
            value[node] = float(-rate * sums[node] / (weights[node] + ridge)) if weights[node] else 0.0
        margin += np.array(value)[at]
    array = lambda v, kind: np.array(v, kind)
    return Forest(base, array(roots, int), array(statistic, int), array(cut, float), array(left, int), array(value, float), depth)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", most_rows: int = MOST_ROWS) -> Forest:
    """Learn from at most most_rows labelled documents, those whose ids hash lowest."""
    marked = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).filter("label in (0, 1) and key is not null")
    sample = marked.groupBy("key").agg(F.min("label").alias("label")).orderBy(F.xxhash64("key"), "key").limit(most_rows)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample), "key")  # bounded by most_rows
    field = T.StructField("__statistics", T.ArrayType(T.DoubleType()))
    # A row for each key, whatever the order of arrival; at most most_rows of them.
    found = add_columns(rows, "text", _statistics_worker, [field]).groupBy("key").agg(F.min("label").alias("label"), F.min("__statistics").alias("__statistics")).toArrow()
    order = np.argsort(found["key"].to_numpy(), kind="stable")
    flat = found["__statistics"].combine_chunks()
    x = flat.flatten().to_numpy().reshape(-1, len(STATISTICS)) if len(flat) else np.zeros((0, len(STATISTICS)))
    y = found["label"].to_numpy().astype(float)
    return grow(x[order], y[order])


def _statistics_worker():
    def fn(column):
        x = statistics(column)
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(x.ravel()))]

    return fn


def score(docs: DataFrame, forest: Forest, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a quality score from 0 to 1; the text alone decides."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    return add_columns(docs, text, lambda: lambda column: [pa.array(shared.value.score(statistics(column)))], [T.StructField(out, T.DoubleType())])
