"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word
is the sum over all its segmentations into pieces, by the forward algorithm; that of a text is the
product over its words times the language's prior. Piece probabilities are fitted by expectation
maximisation over the same lattices, on a bounded sample of labelled texts: `SAMPLE` a language.

Words are runs of letters, digits and non-ASCII bytes that hold a letter, lower-cased, each with a word
mark before it. The sums run over whole words of any length: words of over `SHORT` characters take the same
recurrence in logarithms, which do not underflow. Whole texts are scored.

Defined results: a text that is null or has no letter is `und` with score 0, as is every text when no
labelled text was given; ties go to the alphabetically first language; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from . import _spark, _text, _tokens

VOCABULARY = "piece_bpe_32k.model"
SAMPLE, ROUNDS, SHORT, LONGEST = 1200, 4, 32, 32
#: Words whose probabilities a worker keeps, their most bytes, and characters of long words that are scored at once.
KEPT, KEPT_BYTES, AT_ONCE = 100_000, 64, 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = 1e-8


@lru_cache(2)
def vocabulary(file: str) -> list[str]:
    """The pieces of the public vocabulary that hold no capital, with the word mark as it stands there."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=file)
    return sorted({p for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and (p := sp.id_to_piece(i)) == p.lower() and len(p) <= LONGEST})


def _hash(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes of each row of characters, from 0 for none."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    m = _text.mix(codes.astype(np.uint64) + np.uint64(1))
    with np.errstate(over="ignore"):
        for i in range(codes.shape[1]):
            out[:, i + 1] = out[:, i] * _BASE + m[:, i]
    return out


class Pieces:
    """Piece numbers by hash."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        h = np.array([_hash(np.array([[ord(c) for c in p]], np.uint32))[0, -1] for p in pieces], np.uint64)
        self.order = np.argsort(h)
        self.keys = h[self.order]
        self.longest = max(map(len, pieces), default=1)
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.full(self.longest + 1, _BASE, np.uint64))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash's piece, or -1."""
        at = np.minimum(np.searchsorted(self.keys, h), self.n - 1)
        return np.where(self.keys[at] == h, self.order[at], -1)


def lattices(words: list[str], pieces: Pieces) -> Iterator[tuple[np.ndarray, int, list[tuple[int, int, np.ndarray, np.ndarray]]]]:
    """For words of each length: their places, the length with the mark, and edges (from, to, rows, piece numbers)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        codes = np.frombuffer("".join(words[i] for i in at.tolist()).encode("utf-32-le"), np.uint32).reshape(len(at), n)
        codes = np.concatenate((np.full((len(at), 1), 0x2581, np.uint32), codes), axis=1)
        h = _hash(codes)
        edges = []
        for z in range(1, n + 2):
            for a in range(max(0, z - pieces.longest), z):
                with np.errstate(over="ignore"):
                    got = pieces.find(h[:, z] - h[:, a] * pieces.powers[z - a - 1])
                rows = np.flatnonzero(got >= 0) if z - a > 1 else np.arange(len(at))
                if len(rows):
                    edges.append((a, z, rows, got[rows]))
        yield at, n + 1, edges


def forward(words: list[str], pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """log probability of each word (row) in each language (column). probs: pieces x languages, last row for unknown."""
    out = np.zeros((len(words), probs.shape[1]))
    for at, n, edges in lattices(words, pieces):
        alpha = np.zeros((n + 1, len(at), probs.shape[1]))
        alpha[0] = 1
        for a, z, rows, ids in edges:
            alpha[z, rows] += alpha[a, rows] * probs[ids]
        out[at] = np.log(np.maximum(alpha[n], 1e-300))
    return out


def _long_lattices(words: list[str], pieces: Pieces) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of words of like length: their places, their lengths with the mark, and piece numbers [past character, length - 1, word].

    A single character without a piece is pieces.n, the unknown; a longer stretch without one is pieces.n + 1.
    """
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    order, i = np.argsort(-size, kind="stable"), 0
    while i < len(order):
        n = int(size[order[i]])
        at = order[i : i + max(1, AT_ONCE // n)]
        i += len(at)
        codes = np.zeros((len(at), n), np.uint32)
        for k, w in enumerate(at.tolist()):
            codes[k, 1 : size[w]] = np.frombuffer(words[w].encode("utf-32-le"), np.uint32)
        codes[:, 0] = 0x2581
        h = _hash(codes)
        ids = np.full((n + 1, pieces.longest, len(at)), pieces.n + 1, np.int32)
        for m in range(1, min(pieces.longest, n) + 1):
            with np.errstate(over="ignore"):
                got = pieces.find(h[:, m:] - h[:, :-m] * pieces.powers[m - 1])
            ids[m:, m - 1] = np.where(got < 0, pieces.n if m == 1 else pieces.n + 1, got).T
        yield at, size[at], ids


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exponentials over the first axis."""
    top = np.maximum(x.max(axis=0), -1e300)
    return top + np.log(np.maximum(np.exp(x - top).sum(axis=0), 1e-300))


def _log_forward(ids: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Log probability of the first characters of each word in each language: [characters, word, language]."""
    n, longest, rows = ids.shape
    alpha = np.full((n, rows, logs.shape[1]), -np.inf)
    alpha[0] = 0
    for z in range(1, n):
        m = min(z, longest)
        alpha[z] = _log_sum(alpha[z - m : z][::-1] + logs[ids[z, :m]])
    return alpha


def _with_none(logs: np.ndarray) -> np.ndarray:
    return np.concatenate((logs, np.full((1, logs.shape[1]), -np.inf)))


def scored(words: list[str], pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """forward() of words of any length."""
    out = np.zeros((len(words), probs.shape[1]))
    long = np.fromiter((len(w) > SHORT for w in words), bool, len(words))
    short = np.flatnonzero(~long)
    out[short] = forward([words[i] for i in short.tolist()], pieces, probs)
    far = np.flatnonzero(long)
    logs = _with_none(np.log(probs))
    for at, size, ids in _long_lattices([words[i] for i in far.tolist()], pieces):
        out[far[at]] = _log_forward(ids, logs)[size, np.arange(len(at))]
    return out


def _expect_long(words: list[str], counts: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected count of each piece in words of any length, in logarithms."""
    c, logs = np.zeros(pieces.n + 2), _with_none(np.log(p)[:, None])[:, 0]
    for at, size, ids in _long_lattices(words, pieces):
        n, longest, rows = ids.shape
        alpha = _log_forward(ids, logs[:, None])[:, :, 0]
        beta = np.full((n + longest, rows), -np.inf)
        beta[size, np.arange(rows)] = 0
        whole = alpha[size, np.arange(rows)]
        for a in range(n - 2, -1, -1):
            m = min(n - 1 - a, longest)
            own = ids[np.arange(a + 1, a + 1 + m), np.arange(m)]  # the stretches that begin here, by length
            x = beta[a + 1 : a + 1 + m] + logs[own]
            ends = a < size
            beta[a, ends] = _log_sum(x[:, ends])
            gone = np.exp(np.where(ends, alpha[a] + x - whole, -np.inf))
            c += np.bincount(own.ravel(), (gone * counts[at]).ravel(), pieces.n + 2)
    return c[:-1]


def expect(words: list[str], counts: np.ndarray, pieces: Pieces, rounds: int) -> np.ndarray:
    """Expected count of each piece, and of unknown characters, after so many rounds."""
    long = np.fromiter((len(w) > SHORT for w in words), bool, len(words))
    far, near = np.flatnonzero(long), np.flatnonzero(~long)
    held = list(lattices([words[i] for i in near.tolist()], pieces))
    far_words, far_counts, counts = [words[i] for i in far.tolist()], counts[far], counts[near]
    p = np.full(pieces.n + 1, 1.0 / (pieces.n + 1))
    c = p
    for _ in range(rounds):
        c = _expect_long(far_words, far_counts, pieces, p)
        for at, n, edges in held:
            w = counts[at]
            alpha, beta = np.zeros((n + 1, len(at))), np.zeros((n + 1, len(at)))
            alpha[0] = beta[n] = 1
            for a, z, rows, ids in edges:
                alpha[z, rows] += alpha[a, rows] * p[ids]
            for a, z, rows, ids in reversed(edges):
                beta[a, rows] += beta[z, rows] * p[ids]
            scale = w / np.maximum(alpha[n], 1e-300)
            for a, z, rows, ids in edges:
                c += np.bincount(np.where(ids < 0, pieces.n, ids), alpha[a, rows] * p[ids] * beta[z, rows] * scale[rows], pieces.n + 1)
        p = (c + 1e-3) / (c.sum() + 1e-3 * len(c))
        p[-1] = min(p[-1], UNKNOWN)
    return c


def _word_table(texts: pa.Array) -> Iterator[tuple[int, int, list[bytes], np.ndarray, np.ndarray]]:
    """For ranges of texts: (first, past, distinct words, code of each word, number of words in each text)."""
    buf_all, start_all = _text.join(texts)
    for i, j in _text.slices(start_all, 4 << 20):
        buf, start = buf_all[start_all[i] : start_all[j]], start_all[i : j + 1] - start_all[i]
        k = _text.alnum(buf)
        a, z = _text.edges(k)
        offs = np.concatenate(([0], np.cumsum(z - a)))
        low = _text.lower(buf[k])
        arr = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(offs), pa.py_buffer(low)])
        d = pc.dictionary_encode(arr)
        yield i, j, d.dictionary.to_pylist(), d.indices.to_numpy(), np.diff(np.searchsorted(a, start))


def _lettered(word: bytes) -> str | None:
    """The lower-cased word; None if it has no letter."""
    s = word.decode().lower()
    return s if not s.isdigit() and any(map(str.isalpha, s)) else None


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for i, j, words, code, count in _word_table(batch.column("text")):
            owner = np.repeat(np.arange(i, j), count)
            for lang in sorted(set(langs[i:j])):
                n = np.bincount(code[langs[owner] == lang], minlength=len(words)) if len(code) else []
                at = np.flatnonzero(n)
                yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array([words[x] for x in at.tolist()], pa.binary()), pa.array(n[at] if len(at) else [], pa.int64())], ["lang", "word", "n"])


class Model:
    """Languages, log priors, and the probability of each piece in each language."""

    def __init__(self, langs: list[str], priors: np.ndarray, probs: np.ndarray, file: str):
        self.langs, self.priors, self.probs, self.file = langs, priors, probs, file


def fit(docs: DataFrame, file: str | None = None, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """docs: text and lang of the texts to learn from. About `sample` different texts a language are drawn, evenly by a hash of the text; copies count in the priors alone."""
    file = file or _tokens.path(VOCABULARY)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    hashed = rows.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.count("*").alias("k"))
    sizes = hashed.groupBy("lang").agg(F.sum("k").alias("k"), F.count("*").alias("texts")).collect()
    total, texts = {r["lang"]: r["k"] for r in sizes}, {r["lang"]: r["texts"] for r in sizes}
    langs = sorted(total)
    if not langs:
        return Model([], np.zeros(0), np.zeros((0, 0)), file)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample / texts[k])))])
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share[F.col("lang")] * F.lit(1 << 20)).distinct()
    counts = drawn.mapInArrow(_spark.bounded(_counted), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    pieces = Pieces(vocabulary(file))
    table = counts.toArrow()
    lang, word, n = table["lang"].to_pylist(), table["word"].to_pylist(), table["n"].to_numpy()
    expected = []
    for x in langs:
        own: dict[str, float] = {}
        for i in [i for i, y in enumerate(lang) if y == x]:
            s = _lettered(word[i])
            if s is not None:
                own[s] = own.get(s, 0) + float(n[i])
        expected.append(expect(list(own), np.fromiter(own.values(), float, len(own)), pieces, rounds) if own else np.zeros(pieces.n + 1))
    c = np.array(expected).T[:-1]
    shared = (c.sum(axis=1) + 0.01) / (c.sum() + 0.01 * len(c))
    weight = 200.0
    probs = (c + weight * shared[:, None]) / (c.sum(axis=0) + weight)
    probs = np.concatenate((probs, np.full((1, len(langs)), UNKNOWN)))
    seen = np.array([total[x] for x in langs], float)
    return Model(langs, np.log(seen / seen.sum()), probs, file)


class _Words:
    """Log probabilities of words by language, and whether they have a letter; those of short words are kept."""

    def __init__(self, model: Model):
        self.model, self.pieces, self.g = model, Pieces(vocabulary(model.file)), len(model.langs)
        self.place: dict[bytes, int] = {}
        self.rows = np.zeros((0, self.g + 1))

    def _fresh(self, words: list[bytes]) -> np.ndarray:
        logs = np.zeros((len(words), self.g + 1))
        lettered = [(k, s) for k, w in enumerate(words) if (s := _lettered(w)) is not None]
        if lettered:
            at = np.fromiter((k for k, _ in lettered), np.int64, len(lettered))
            if self.g:
                logs[at, : self.g] = scored([s for _, s in lettered], self.pieces, self.model.probs)
            logs[at, self.g] = 1
        return logs

    def table(self, words: list[bytes]) -> np.ndarray:
        """A row for each word."""
        found = np.fromiter((self.place.get(w, -1) for w in words), np.int64, len(words))
        out = np.empty((len(words), self.g + 1))
        out[found >= 0] = self.rows[found[found >= 0]]
        new = np.flatnonzero(found < 0)
        if len(new):
            own = [words[i] for i in new.tolist()]
            out[new] = logs = self._fresh(own)
            keep = [k for k, w in enumerate(own) if len(w) <= KEPT_BYTES]
            if len(self.place) + len(keep) > KEPT:
                self.place.clear()
                self.rows = self.rows[:0]
                keep = keep[:KEPT]
            self.place.update((own[k], len(self.rows) + x) for x, k in enumerate(keep))
            self.rows = np.concatenate((self.rows, logs[keep]))
        return out


def _predict(shared):
    def run(texts: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
        m: Model = shared.value
        kept, g = _Words(m), len(m.langs)
        for some in texts:
            n = len(some)
            score, lettered = np.zeros((n, g)), np.zeros(n, bool)
            for i, _, words, code, count in _word_table(some):
                if not len(code):
                    continue
                table = kept.table(words)
                first = np.concatenate(([0], np.cumsum(count)[:-1]))
                live = np.flatnonzero(count)
                total = np.add.reduceat(table[code], first[live], axis=0)
                score[i + live] = total[:, :g]
                lettered[i + live] = total[:, g] > 0
            if g:
                score += m.priors
                score -= score.max(axis=1, keepdims=True)
                p = np.exp(score)
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                top = np.where(lettered, p[np.arange(n), best], 0.0)
                pred = [m.langs[b] if x else "und" for b, x in zip(best.tolist(), lettered.tolist(), strict=True)]
            else:
                top, pred = np.zeros(n), ["und"] * n
            yield [pa.array(pred, pa.string()), pa.array(top, pa.float64())]

    return run


def _predicted(docs: DataFrame, model: Model) -> DataFrame:
    """docs with its columns as c0, c1, ..., the language as _x0 and its posterior as _x1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages: bounded by the vocabulary
    return _spark.appended(docs, "text", _predict(shared), [StructField("lang", StringType()), StructField("score", DoubleType())])


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns `keep` of docs, lang_pred, and score, the posterior of that language."""
    slim = docs.select(*keep, F.col("text").cast("string").alias("text"))
    return _predicted(slim, model).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("_x0").alias("lang_pred"), F.col("_x1").alias("score"))


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that have a language with a posterior of at least `least`."""
    kept = _predicted(docs, model).where((F.col("_x0") != "und") & (F.col("_x1") >= least))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
