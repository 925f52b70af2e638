"""Quality classifier: histogram gradient-boosted trees over statistics of a document's text.

The statistics are counted where the texts are. The trees are fitted on a bounded sample of
labelled rows, binned once into histograms, and flattened into arrays; a batch of documents
walks all trees level by level in numpy.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postflow.llm.support import IS_SPACE, LOWER, slices, text_bytes, words_of

# Byte classes.
_BYTES = np.arange(256)
UPPER = (_BYTES >= ord("A")) & (_BYTES <= ord("Z"))
LETTER = UPPER | ((_BYTES >= ord("a")) & (_BYTES <= ord("z"))) | (_BYTES >= 128)
DIGIT = (_BYTES >= ord("0")) & (_BYTES <= ord("9"))
ENDING = np.isin(_BYTES, list(b".!?"))
COMMA = np.isin(_BYTES, list(b",;:"))
MARKUP = np.isin(_BYTES, list(b"|<>{}[]\\/=_#*~^@$%&+"))
NEWLINE = _BYTES == ord("\n")
CONTROL = (_BYTES < 32) & ~IS_SPACE

FEATURES = [
    "log_bytes", "log_words", "letter_share", "upper_share", "digit_share", "ending_share", "comma_share",
    "markup_share", "space_share", "newline_share", "control_share", "exclaim_share", "bytes_a_word",
    "long_word_share", "short_word_share", "letterless_word_share", "distinct_word_share", "repeated_word_share",
    "top_word_share", "distinct_pair_share", "log_lines", "distinct_line_share", "words_a_line", "wide_byte_share",
]


def text_features(texts: pa.Array) -> np.ndarray:
    """Statistics of whole texts: texts x FEATURES. Null and empty texts have all zeros."""
    data, starts = text_bytes(texts)
    out = np.zeros((len(starts) - 1, len(FEATURES)))
    for a, b in slices(starts):
        out[a:b] = _features(data[starts[a]:starts[b]], starts[a:b + 1] - starts[a])
    return out


def _features(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    n = len(starts) - 1
    size = np.diff(starts)
    some = np.flatnonzero(size)
    if not len(some):
        return np.zeros((n, len(FEATURES)))

    def count(table: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        out[some] = np.add.reduceat(table[data].astype(np.int64), starts[:-1][some])
        return out

    bytes_ = np.maximum(size, 1)
    first, last, owner, hashes = words_of(LOWER[data], starts)
    length = last - first
    words = np.bincount(owner, minlength=n)
    at_least_one = np.maximum(words, 1)
    per_word = lambda flags: np.bincount(owner, weights=flags, minlength=n) / at_least_one
    letters = np.concatenate([[0], np.cumsum(LETTER[data])])
    follows = np.zeros(len(owner), bool)
    follows[1:] = owner[1:] == owner[:-1]
    repeated = follows.copy()
    repeated[1:] &= hashes[1:] == hashes[:-1]
    distinct, top = _distinct(owner, hashes, n)
    with np.errstate(over="ignore"):
        pairs = hashes[1:] * np.uint64(3) + hashes[:-1]
    distinct_pairs, _ = _distinct(owner[1:][follows[1:]], pairs[follows[1:]], n)
    lines, distinct_lines = _lines(data, starts, first, owner, hashes, n)
    spread = np.maximum(words - 1, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(words), count(LETTER) / bytes_, count(UPPER) / bytes_, count(DIGIT) / bytes_,
        count(ENDING) / bytes_, count(COMMA) / bytes_, count(MARKUP) / bytes_, count(IS_SPACE) / bytes_,
        count(NEWLINE) / bytes_, count(CONTROL) / bytes_, count(_BYTES == ord("!")) / bytes_,
        per_word(length), per_word(length > 12), per_word(length < 3), per_word(letters[last] == letters[first]),
        distinct / at_least_one, per_word(repeated), top / at_least_one, distinct_pairs / spread,
        np.log1p(lines), distinct_lines / np.maximum(lines, 1), words / np.maximum(lines, 1), count(_BYTES >= 128) / bytes_,
    ])


def _distinct(owner: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per owner how many different values, and how often the most frequent occurs."""
    if not len(owner):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((values, owner))
    o, v = owner[order], values[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    heads = np.flatnonzero(new)
    runs = np.diff(np.append(heads, len(o)))
    top = np.zeros(n)
    np.maximum.at(top, o[heads], runs)
    return np.bincount(o[heads], minlength=n).astype(float), top


def _lines(data, starts, first, owner, hashes, n) -> tuple[np.ndarray, np.ndarray]:
    """Lines that hold a word, per text, and how many of them differ as sequences of words."""
    if not len(first):
        return np.zeros(n), np.zeros(n)
    breaks = np.cumsum(NEWLINE[data])
    line = breaks[first]
    new = np.ones(len(first), bool)
    new[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    place = np.arange(len(first)) - np.repeat(heads, np.diff(np.append(heads, len(first))))
    with np.errstate(over="ignore"):
        whole = np.add.reduceat(hashes * (2 * place.astype(np.uint64) + np.uint64(1)), heads)
    distinct, _ = _distinct(owner[heads], whole, n)
    return np.bincount(owner[heads], minlength=n).astype(float), distinct


@dataclass(frozen=True)
class Boosting:
    """How the trees are grown; `rows` bounds the labelled sample that reaches the driver."""

    rows: int = 20_000
    trees: int = 80
    depth: int = 4
    rate: float = 0.12
    bins: int = 64
    least_rows: int = 8
    penalty: float = 1.0


@dataclass(frozen=True)
class Forest:
    """All trees in flat arrays, each a full tree of `depth` levels; node i has children 2i+1 and 2i+2."""

    depth: int
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray  # go right where the value is above
    leaf: np.ndarray  # trees x leaves
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t][node]] > self.limit[t][node])
            total += self.leaf[t][node - self.feature.shape[1]]
        return 1.0 / (1.0 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, how: Boosting = Boosting()) -> Forest:
    """Fit on rows x features and labels 0 or 1; without both labels the forest is one constant."""
    inner, leaves = (1 << how.depth) - 1, 1 << how.depth
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    empty = Forest(how.depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    if len(y) < 2 * how.least_rows or len(np.unique(y)) < 2:
        return empty
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, how.bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)])
    n_features = x.shape[1]
    flat = binned + np.arange(n_features) * how.bins
    raw = np.full(len(y), base)
    features, limits, values = [], [], []
    for _ in range(how.trees):
        p = 1.0 / (1.0 + np.exp(-raw))
        gradient, weight = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(how.depth):
            first, width = (1 << level) - 1, 1 << level
            cell = ((node - first)[:, None] * n_features * how.bins + flat).ravel()
            shape = (width, n_features, how.bins)
            hist = lambda w: np.bincount(cell, np.repeat(w, n_features), width * n_features * how.bins).reshape(shape)
            g, h, c = (np.cumsum(hist(w), axis=2) for w in (gradient, weight, np.ones(len(y))))
            gain = _gain(g, h, c, how)
            best = gain.reshape(width, -1).argmax(axis=1)
            split = np.take_along_axis(gain.reshape(width, -1), best[:, None], 1)[:, 0] > 1e-6
            f, at = best // how.bins, best % how.bins
            for k in np.flatnonzero(split):
                if at[k] < len(cuts[f[k]]):
                    feature[first + k], limit[first + k] = f[k], cuts[f[k]][at[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, leaves), np.bincount(leaf, weight, leaves)
        value = -how.rate * g / (h + how.penalty)
        raw += value[leaf]
        features.append(feature)
        limits.append(limit)
        values.append(value)
    return Forest(how.depth, np.array(features), np.array(limits), np.array(values), base)


def _gain(g: np.ndarray, h: np.ndarray, c: np.ndarray, how: Boosting) -> np.ndarray:
    """What splitting each node at each bin of each feature wins."""
    all_g, all_h, all_c = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
    score = lambda a, b: a * a / (b + how.penalty)
    gain = score(g, h) + score(all_g - g, all_h - h) - score(all_g, all_h)
    return np.where((c >= how.least_rows) & (all_c - c >= how.least_rows), gain, 0.0)


def fit_quality(
    documents: DataFrame, labels: DataFrame, learn: Column | None = None, how: Boosting = Boosting(), key: str = "doc_id"
) -> Forest:
    """Fit on the rows of `labels` `(key, quality)` that `learn` allows, over its own `key`.

    Of more than `how.rows` labels those with the least hash of their key are taken; a key labelled
    twice counts twice, a null label or text not at all. Only the statistics reach the driver.
    """
    allowed = F.coalesce(learn, F.lit(False)) if learn is not None else F.lit(True)
    rows = labels.where(allowed).select(F.col(key).alias("_key"), F.col("quality").cast("int").alias("_label"))
    rows = rows.where(F.col("_label").isin(0, 1)).orderBy(F.xxhash64(F.lit(11), "_key"), "_key", "_label").limit(how.rows)
    texts = documents.select(F.col(key).alias("_key"), F.col("text").cast("string").alias("text"))
    # At most `how.rows` labels.
    joined = texts.where(F.col("text").isNotNull()).join(F.broadcast(rows), "_key").select("text", "_label", "_key")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_features(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_label"), pa.array(list(found), pa.list_(pa.float64())), batch.column("_key").cast(pa.string())],
                names=["label", "x", "k"],
            )

    fitted = joined.mapInArrow(measure, "label int, x array<double>, k string").toPandas().sort_values(["k", "label"])
    if not len(fitted):
        return grow(np.zeros((0, len(FEATURES))), np.zeros(0), how)
    return grow(np.stack(fitted["x"].to_numpy()), fitted["label"].to_numpy(float), how)


def quality_score(forest: Forest) -> Callable[[Column], Column]:
    """An expression for the score of a text, 0 to 1, higher where label 1 is likelier.

    Null and empty texts are scored by their zero statistics.
    """

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(forest.predict(text_features(texts)))

    return lambda text: score(F.coalesce(text.cast("string"), F.lit("")))


def score_quality(documents: DataFrame, forest: Forest, key: str = "doc_id") -> DataFrame:
    """`(key, score)` per row of `documents`, from `text` alone.

    Rows are independent: no shuffle, repeated rows and ties stay, further columns are ignored;
    an empty table gives no rows.
    """
    return documents.select(F.col(key), quality_score(forest)(F.col("text")).alias("score"))
