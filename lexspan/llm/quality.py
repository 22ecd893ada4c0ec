"""Quality classifier: a sparse rule ensemble over statistics of whole texts.

Statistics are counted per text from its bytes and word hashes. Small trees, boosted on a bounded sample
of labelled rows (`SAMPLE`), give their paths as conjunctive rules; logistic weights of the rules are
fitted with an L1 penalty, so most rules drop out, and what stays is compiled into one Spark column.

Defined results: null and empty texts have zero statistics and are scored like any other; with no
labelled rows, or with labels of one kind, every score is the share of good labels (0.5 without any);
repeated rows score alike; rows with several labels count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField

from . import _spark, _text

SAMPLE, TREES, DEPTH, PENALTY = 20_000, 24, 3, 0.002

STATS = (
    "bytes_log", "words_log", "word_size", "letters", "digits", "capitals", "spaces", "lines", "marks", "bars", "shouts", "high",
    "stops", "commas", "distinct_words", "top_word", "repeated_lines", "repeated_triples", "marked_words", "long_words", "short_words", "longest_log",
    "words_a_line", "words_a_stop", "other", "runs", "title_words", "angle", "url_marks", "capital_words",
)

_CLASS = {
    "letters": b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "spaces": b" \t", "lines": b"\n",
    "marks": b"$%&#*@^~=+_\\", "bars": b"|", "shouts": b"!", "high": bytes(range(128, 256)), "stops": b".?", "commas": b",;", "other": bytes([*range(9), *range(14, 32), 127]), "angle": b"<>{}[]", "url_marks": b":/",
}
_IS = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASS.items()}
_CLASSES = np.stack([_IS[k] for k in _CLASS], axis=1).astype(float)
_MARKS = np.isin(np.arange(256), list(b"$%&#*@^~=+_|!<>{}[]"))
_U = np.uint64


def _class_counts(buf: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The bytes of each class (column) in each text (row), from a histogram of the text's bytes."""
    out = np.empty((len(start) - 1, len(_CLASS)))
    for i in range(0, len(out), 1024):
        ends = list(zip(start[i : i + 1024].tolist(), (start[i + 1 : i + 1025] - 1).tolist(), strict=False))
        rows = np.zeros((len(ends), 256), np.int64)
        for d, (a, z) in enumerate(ends):
            for x in range(a, z, _text.SEGMENT):
                rows[d] += np.bincount(buf[x : min(z, x + _text.SEGMENT)], minlength=256)
        out[i : i + 1024] = rows @ _CLASSES
    return out


def _repeats(key: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, distinct keys, count of the commonest key) of each text; 44 bits of a key tell it from others in its text."""
    count = np.bincount(doc, minlength=n)
    top = np.zeros(n, np.int64)
    if not len(key):
        return count, top, top
    x = np.sort((doc.astype(_U) << _U(44)) | (key >> _U(20)))
    new = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    size = np.diff(np.append(new, len(x)))
    d = (x[new] >> _U(44)).astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
    top[d[head]] = np.maximum.reduceat(size, head)
    return count, np.bincount(d, minlength=n), top


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATS for each text."""
    buf_all, start_all = _text.join(texts)
    out = np.zeros((len(texts), len(STATS)))
    for i, j in _text.slices(start_all):
        n = j - i
        buf, start = buf_all[start_all[i] : start_all[j]], start_all[i : j + 1] - start_all[i]
        size = np.diff(start) - 1
        per = np.maximum(size, 1)
        s: dict[str, np.ndarray] = {"bytes_log": np.log1p(size)}
        counts = _class_counts(buf, start)
        s |= {k: counts[:, c] / per for c, k in enumerate(_CLASS)}
        lines_n = counts[:, list(_CLASS).index("lines")] + 1
        stops_n = counts[:, list(_CLASS).index("stops")] + 1
        a, z, h = _text.all_words(buf, _text.spaced)
        doc = np.repeat(np.arange(n), np.diff(np.searchsorted(a, start)))
        words, distinct, top = _repeats(h, doc, n)
        w = np.maximum(words, 1)
        length = z - a
        mean = lambda x: np.bincount(doc, x, n) / w
        s["words_log"], s["word_size"] = np.log1p(words), mean(length)
        s["distinct_words"], s["top_word"] = distinct / w, top / w
        s["words_a_line"], s["words_a_stop"] = np.log1p(words / lines_n), np.log1p(words / stops_n)
        last, first, second = (buf[z - 1], buf[a], buf[np.minimum(a + 1, z - 1)]) if len(a) else (np.zeros(0, np.uint8),) * 3
        s["marked_words"] = mean(_MARKS[last])
        s["long_words"], s["short_words"] = mean(length > 15), mean(length <= 2)
        s["title_words"] = mean(_IS["capitals"][first] & ~_IS["capitals"][second])
        s["capital_words"] = mean(_IS["capitals"][first] & _IS["capitals"][second] & (length > 1))
        longest = np.zeros(n)
        np.maximum.at(longest, doc, length)
        s["longest_log"] = np.log1p(longest)
        triple = _text.window_hashes(h, 3)
        inside = doc[: len(triple)] == doc[2:] if len(triple) else np.zeros(0, bool)
        count, distinct, _ = _repeats(triple[inside], doc[: len(triple)][inside], n)
        s["repeated_triples"] = 1 - distinct / np.maximum(count, 1) * (count > 0) - (count == 0)
        same = np.concatenate(([False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))) if len(h) else np.zeros(0, bool)
        s["runs"] = mean(same)
        # a line's hash is the sum of the hashes of its bytes at their places: words of the line in order
        newline = np.flatnonzero(buf == 10)
        line = np.searchsorted(newline, a) + doc  # each text begins another line
        if len(a):
            heads = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
            place = np.arange(len(a)) - np.repeat(heads, np.diff(np.append(heads, len(a))))
            with np.errstate(over="ignore"):
                lh = np.add.reduceat(h * (_text.mix(place.astype(np.uint64)) | np.uint64(1)), heads)
            count, distinct, _ = _repeats(lh, doc[heads], n)
            s["repeated_lines"] = 1 - distinct / np.maximum(count, 1) * (count > 0) - (count == 0)
        else:
            s["repeated_lines"] = np.zeros(n)
        out[i:j] = np.stack([s[k] for k in STATS], axis=1)
    return out


def _stats(texts: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
    for some in texts:
        yield [pa.FixedSizeListArray.from_arrays(pa.array(statistics(some).ravel()), len(STATS)).cast(pa.list_(pa.float64()))]


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with its columns as c0, c1, ... and the statistics of its text as _x0."""
    return _spark.appended(docs, "text", _stats, [StructField("stats", ArrayType(DoubleType()))])


Rule = tuple[tuple[int, bool, float], ...]


def _tree(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, path: Rule, rules: set[Rule], feats: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """Splits by the gain in the second-order loss; adds the path of every node to rules; gives the leaves."""
    g, h = grad[rows].sum(), hess[rows].sum()
    leaf = [(rows, -g / (h + 1.0))]
    if depth == 0 or len(rows) < 40:
        return leaf
    best = (1e-6, -1, 0)
    for f in feats.tolist():
        m = len(edges[f]) + 1
        if m < 2:
            continue
        gs = np.bincount(bins[rows, f], grad[rows], m).cumsum()[:-1]
        hs = np.bincount(bins[rows, f], hess[rows], m).cumsum()[:-1]
        n = np.bincount(bins[rows, f], minlength=m).cumsum()[:-1]
        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g * g / (h + 1)
        gain[(n < 15) | (n > len(rows) - 15)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, k)
    if best[1] < 0:
        return leaf
    _, f, k = best
    left = bins[rows, f] <= k
    out = []
    for side, some in ((True, rows[left]), (False, rows[~left])):
        p = (*path, (f, side, float(edges[f][k])))
        rules.add(p)
        out += _tree(x, bins, edges, grad, hess, some, depth - 1, p, rules, feats)
    return out


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, below, t in rule:
        out &= (x[:, f] <= t) if below else (x[:, f] > t)
    return out


class Ensemble:
    """A bias and weighted rules; a rule is a conjunction of (statistic, at most?, threshold)."""

    def __init__(self, bias: float, rules: list[tuple[Rule, float]]):
        self.bias, self.rules = bias, rules

    def column(self, stats: Column) -> Column:
        """The score as one Spark expression over the array of statistics."""
        total = F.lit(self.bias)
        for rule, w in self.rules:
            tests = [(stats[f] <= t) if below else (stats[f] > t) for f, below, t in rule]
            test = tests[0]
            for x in tests[1:]:
                test = test & x
            total = total + F.when(test, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = 5) -> Ensemble:
    n = len(y)
    p0 = (y.sum() + 1) / (n + 2) if n else 0.5
    bias = float(np.log(p0 / (1 - p0)))
    if n < 40 or y.min() == y.max():
        return Ensemble(bias, [])
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 48))) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    f, rules = np.full(n, bias), set()
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        rows = np.flatnonzero(rng.random(n) < 0.7)
        feats = rng.permutation(x.shape[1])[: max(8, x.shape[1] // 2)]
        for leaf, v in _tree(x, bins, edges, p - y, p * (1 - p) + 1e-6, rows, depth, (), rules, feats):
            f[leaf] += 0.3 * v
    if not rules:
        return Ensemble(bias, [])
    names = sorted(rules)
    r = np.stack([holds(k, x) for k in names], axis=1).astype(float)
    _, first = np.unique(r, axis=1, return_index=True)  # of rules that hold for the same rows, the first
    keep = np.sort(first)
    names, r = [names[k] for k in keep], r[:, keep]
    share = r.mean(axis=0)
    scale = np.sqrt(share * (1 - share)) + 0.05
    z = r / scale
    w, b, v, t = np.zeros(z.shape[1]), bias, np.zeros(z.shape[1]), 1.0
    step = 4.0 / max(np.linalg.norm(z, 2) ** 2 / n + 1.0, 1e-9)
    vb = b
    for _ in range(400):  # accelerated proximal gradient
        e = 1 / (1 + np.exp(-(z @ v + vb))) - y
        u = v - step * (z.T @ e) / n
        w2 = np.sign(u) * np.maximum(np.abs(u) - step * penalty, 0)
        b2 = vb - step * e.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return Ensemble(float(b), [(k, float(c / s)) for k, c, s in zip(names, w, scale, strict=True) if abs(c) > 1e-4])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ensemble:
    """docs: doc_id, text of the texts to learn from; labels: doc_id, quality. About `sample` labelled rows at most are used, evenly by a hash of the doc_id."""
    own = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
    share = min(1.0, sample / max(1, own.count()))
    drawn = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(share * (1 << 20)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(share * (1 << 20)))
    named = with_statistics(texts.join(drawn, "doc_id").select("doc_id", "quality", "text")).select(F.col("c0").alias("doc_id"), F.col("c1").alias("quality"), F.col("_x0").alias("stats"))
    rows = named.toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])  # about `sample` rows
    if not rows.num_rows:
        return fit_rules(np.zeros((0, len(STATS))), np.zeros(0))
    x = rows["stats"].combine_chunks().flatten().to_numpy().reshape(-1, len(STATS))
    return fit_rules(x, rows["quality"].to_numpy())


def score(docs: DataFrame, model: Ensemble, *keep: str) -> DataFrame:
    """The columns `keep` of docs, and score."""
    slim = docs.select(*keep, F.col("text").cast("string").alias("text"))
    return with_statistics(slim).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], model.column(F.col("_x0")).alias("score"))


def accepted(docs: DataFrame, model: Ensemble, least: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least `least`."""
    kept = with_statistics(docs).where(model.column(F.col("_x0")) >= least)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
