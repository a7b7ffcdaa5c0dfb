"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each whole text becomes a fixed row of statistics (``FEATURES``). Training bins
every statistic into quantiles of the sample, grows complete trees level by
level from gradient histograms (logistic loss), and flattens all trees into
arrays; scoring walks the arrays with vectorised numpy, one step per level.

The trees are fitted on the driver from at most ``SAMPLE_ROWS`` labelled rows
outside the held-out fold; only their statistics travel, so what the driver
gets is bounded by that parameter, however long the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE_ROWS = 8_000
TREES = 80
DEPTH = 4
BINS = 64
RATE = 0.2
LEAST_HESSIAN = 2.0
#: The contract's threshold for ``predicted``.
THRESHOLD = 0.3

#: Byte classes whose share of the text is a statistic.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
           "space": b" \t\r\x0b\x0c", "newline": b"\n", "stop": b".", "comma": b",", "bang": b"!", "question": b"?",
           "bar": b"|", "hash": b"#", "dollar": b"$", "percent": b"%", "ampersand": b"&", "star": b"*",
           "bracket": b"<>[]{}()", "slash": b"/\\", "at": b"@", "equals": b"=+~^", "underscore": b"_", "quote": b"'\"`",
           "colon": b":;", "dash": b"-", "high": bytes(range(128, 256)), "control": bytes(range(9)) + bytes(range(14, 32))}
FEATURES = ["log_bytes", "log_words", "mean_word", "longest_word", "distinct_words", "top_word", "lines_log",
            "mean_line", "distinct_lines", "capital_words", "mixed_words", "short_words", "most_byte",
            *(f"share_{k}" for k in CLASSES)]

_CLASS_OF = np.zeros((256, len(CLASSES)))
for _i, _members in enumerate(CLASSES.values()):
    _CLASS_OF[list(_members), _i] = 1


def statistics(text: bytes) -> list[float]:
    """The statistics of a whole text (UTF-8); an empty text gets zeros."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, "u1"), minlength=256)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x]
    times: dict[bytes, int] = {}
    for w in words:
        times[w] = times.get(w, 0) + 1
    k, m = max(1, len(words)), max(1, len(lines))
    distinct = list(times)
    d = max(1, len(distinct))
    return [np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / k, max(map(len, words), default=0),
            len(distinct) / k, max(times.values(), default=0) / k, np.log1p(len(lines)), n / m,
            len(set(lines)) / m, sum(map(bytes.isupper, distinct)) / d,
            sum(not w.isalpha() for w in distinct) / d, sum(len(w) < 4 for w in distinct) / d,
            counts.max() / n, *(counts @ _CLASS_OF / n)]


@dataclass
class Trees:
    """All trees' inner nodes, (trees, 2^depth - 1), and leaves, (trees, 2^depth)."""
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1 for each row of statistics."""
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            z += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Boost complete trees of one depth; a node without a useful split sends
    every row to its left child."""
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    share = (float((y * weight).sum()) + 0.5) / (float(weight.sum()) + 1)
    base = float(np.log(share / (1 - share)))
    empty = Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    if len(set(y.tolist())) < 2:
        return empty
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
    n_features = x.shape[1]
    z = np.full(len(y), base)
    feature, limit, leaf = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = (p - y) * weight, p * (1 - p) * weight
        f, t, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
        for level in range(DEPTH):
            first, width = 2 ** level - 1, 2 ** level
            key = ((node - first)[:, None] * n_features + np.arange(n_features)) * BINS + binned
            size = width * n_features * BINS
            G = np.bincount(key.ravel(), np.repeat(g, n_features), size).reshape(width, n_features, BINS).cumsum(2)
            H = np.bincount(key.ravel(), np.repeat(h, n_features), size).reshape(width, n_features, BINS).cumsum(2)
            GT, HT = G[:, :, -1:], H[:, :, -1:]
            gain = G ** 2 / (H + 1) + (GT - G) ** 2 / (HT - H + 1) - GT ** 2 / (HT + 1)
            gain[(H < LEAST_HESSIAN) | (HT - H < LEAST_HESSIAN)] = 0
            for k in range(width):
                j, b = np.unravel_index(gain[k].argmax(), gain[k].shape)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    f[first + k], t[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > t[node])
        G = np.bincount(node - inner, g, leaves)
        H = np.bincount(node - inner, h, leaves)
        values = -RATE * G / (H + 1)
        z += values[node - inner]
        feature.append(f), limit.append(t), leaf.append(values)
    return Trees(np.array(feature), np.array(limit), np.array(leaf), base)


def with_statistics(batches, column: str):
    """(batch, matrix of its texts' statistics), in bounded slices."""
    for b in common.slices(batches, 1024):
        texts = b.column(column).cast(pa.binary()).to_pylist()
        yield b, np.array([statistics(t) for t in texts], "f8").reshape(len(texts), len(FEATURES))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id",
          text_column: str = "text", rows: int = SAMPLE_ROWS) -> Trees:
    """Fit on at most ``rows`` labelled rows, weighted back to the shares that
    the classes have among all labelled rows (outside the held-out fold). No
    labels, or one class only: every text gets the same score."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull() & ~common.held_out(id_column))
    share = {r["y"]: r["n"] for r in known.groupBy((F.col(label) == 1).cast("int").alias("y"))
             .agg(F.countDistinct(id_column).alias("n")).collect()}
    sample = common.labelled_ids(labels, label, rows)
    joined = (documents.select(F.col(id_column).alias("_id"), common.text_of(text_column).alias("_text"))
              .join(F.broadcast(sample), "_id").select(F.col("_id").cast("string").alias("_id"), "_text", "_y"))

    def stats(batches):
        for b, x in with_statistics(batches, "_text"):
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y").cast(pa.int32()),
                                              pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y", "x"])

    got = common.one_of_each(common.map_arrow(joined, stats, "id string, y int, x binary"), "id").collect()
    got.sort(key=lambda r: r["id"])
    x = np.array([np.frombuffer(r["x"], "f8") for r in got]).reshape(-1, len(FEATURES))
    y = np.array([r["y"] for r in got], "f8")
    taken = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.array([share.get(int(k), 1) / taken[int(k)] for k in y])
    weight = weight / weight.mean() if len(weight) else weight
    return fit(x, y, weight)


def score(documents: DataFrame, trees: Trees, text_column: str = "text") -> DataFrame:
    """Every row with ``score`` (double, 0 to 1, higher: better) and
    ``predicted`` (1 if score >= ``THRESHOLD``). Input columns of these names
    are replaced; null texts count as empty, and empty texts are scored by
    their statistics, all zero."""
    made = ["score", "predicted"]
    rest = [c for c in documents.columns if c not in made]
    inner = documents.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"),
                             common.text_of(text_column).alias("text"))

    def scored(batches):
        for b, x in with_statistics(batches, "text"):
            s = trees.score(x)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(s), pa.array((s >= THRESHOLD).astype("i4"))],
                                             ["row", *made])

    kind = inner.schema["row"].dataType.simpleString()
    return common.map_arrow(inner, scored, f"row {kind}, score double, predicted int").select("row.*", *made)
