"""Edit-aware token counts: a segment tree over the pre-token pieces of each document.

A leaf is a piece of text that no pre-token crosses; nodes hold the sums of bytes and ids below them. An
edit replaces a range of bytes. Only the leaves that it touches are cut and encoded again, with the leaf
before it and the few bytes after it that decide where text may be cut; where the edit makes or leaves
an added token (<|endoftext|>), all leaves that the token can reach; then the sums above them are updated. Other leaves keep their counts.

Defined results: null text is the empty text, with count 0; an edit beyond the end counts from the end; an
edit that would split a character takes in the whole character; null or empty edits change nothing;
repeated rows count alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _spark, _text, _tokens

LEAVES = 64  # leaves in a bottom node
CONTEXT = 3  # bytes before a place that decide whether text may be cut there
SMALL = 512  # bytes up to which a text is cut without arrays
EDIT = "array<struct<at:bigint,remove:bigint,insert:string>>"


def pieces(file: str, text: bytes) -> tuple[list[int], list[int]]:
    """(bytes, ids) of each piece of a text."""
    if not text:
        return [], []
    if len(text) <= SMALL:
        return _tokens.small_piece_counts(file, text)
    buf, start = np.frombuffer(text + b"\xff", np.uint8), np.array([0, len(text) + 1])
    at, ids = _tokens.piece_counts(file, buf, start)
    return np.diff(at).tolist(), ids[:-1].tolist()


class Tree:
    """Bottom nodes of up to 2 * LEAVES leaves, and a binary tree of sums over them.

    A bottom node is a range of the text and leaves that the tree was made from, until an edit reaches it.
    """

    def __init__(self, text: bytes, sizes, counts):
        sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
        self._text, self._sizes, self._counts = text, sizes, counts
        self.nodes: list[tuple | list] = []  # (first leaf, past leaf, first byte, past byte), or [text, sizes, counts]
        self._bytes: list[int] = []
        self._ids: list[int] = []
        if len(sizes):
            at = np.arange(0, len(sizes), LEAVES)
            own = np.add.reduceat(sizes, at)
            self._bytes, self._ids = own.tolist(), np.add.reduceat(counts, at).tolist()
            ends = np.cumsum(own).tolist()
            self.nodes = [(i, min(i + LEAVES, len(sizes)), z - n, z) for i, z, n in zip(at.tolist(), ends, self._bytes, strict=True)]
        self._raise()

    def _node(self, i: int) -> list:
        x = self.nodes[i]
        if isinstance(x, tuple):
            a, z, p, q = x
            x = [self._text[p:q], self._sizes[a:z].tolist(), self._counts[a:z].tolist()]
        return x

    def _raise(self) -> None:
        if not self.nodes:
            self.nodes, self._bytes, self._ids = [[b"", [], []]], [0], [0]
        self.width = 1 << (len(self.nodes) - 1).bit_length()
        pad = [0] * (self.width - len(self.nodes))
        self.size, self.count = [0] * self.width + self._bytes + pad, [0] * self.width + self._ids + pad
        for i in range(self.width - 1, 0, -1):
            self.size[i], self.count[i] = self.size[2 * i] + self.size[2 * i + 1], self.count[2 * i] + self.count[2 * i + 1]

    def _update(self, node: int) -> None:
        i = self.width + node
        self.size[i], self.count[i] = self._bytes[node], self._ids[node]
        i >>= 1
        while i:
            self.size[i], self.count[i] = self.size[2 * i] + self.size[2 * i + 1], self.count[2 * i] + self.count[2 * i + 1]
            i >>= 1

    @property
    def total(self) -> int:
        return self.count[1]

    @property
    def text(self) -> bytes:
        return b"".join(self._text[n[2] : n[3]] if isinstance(n, tuple) else n[0] for n in self.nodes)

    def leaves(self) -> tuple[list[int], list[int]]:
        nodes = [self._node(i) for i in range(len(self.nodes))]
        return [x for n in nodes for x in n[1]], [x for n in nodes for x in n[2]]

    def _find(self, at: int) -> tuple[int, int]:
        """(bottom node that holds byte `at`, its first byte); the last one for the end."""
        i, first = 1, 0
        while i < self.width:
            i *= 2
            if at >= first + self.size[i] and self.size[i + 1]:
                first += self.size[i]
                i += 1
        return min(i - self.width, len(self.nodes) - 1), first

    def _byte(self, at: int) -> int:
        node, first = self._find(at)
        x = self.nodes[node]
        return self._text[x[2] + at - first] if isinstance(x, tuple) else x[0][at - first]

    def edit(self, file: str, at: int, remove: int, insert: bytes) -> int:
        """Replaces bytes; gives the number of bytes that were encoded again."""
        n = self.size[1]
        a = min(max(at, 0), n)
        z = min(a + max(remove, 0), n)
        while 0 < a < n and self._byte(a) & 0xC0 == 0x80:
            a -= 1
        while z < n and self._byte(z) & 0xC0 == 0x80:
            z += 1
        if a == z and not insert:
            return 0
        # bottom nodes from the one before the edit to the one that holds the last byte that cuts or added tokens depend on
        reach = _tokens.reach(file)
        back, ahead = max(1, reach), max(CONTEXT, reach)
        left, left_first = self._find(max(a - back, 0))
        right, right_first = self._find(min(z + ahead, n - 1) if n else 0)
        held = [self._node(k) for k in range(left, right + 1)]
        text = b"".join(x[0] for x in held)
        sizes, counts = [y for x in held for y in x[1]], [y for x in held for y in x[2]]
        p, q = a - left_first, z - left_first
        if not _tokens.holds_added(file, text[max(p - reach, 0) : p] + insert + text[q : q + reach]):
            back, ahead = 1, CONTEXT
        # leaves from the one that holds the first such byte before the edit to the one that holds the last after it
        ends = np.cumsum(sizes) if sizes else np.zeros(0, np.int64)
        i = int(np.searchsorted(ends, max(a - back, 0) - left_first, "right"))
        j = min(int(np.searchsorted(ends, min(z + ahead, n - 1) - left_first, "right")) + 1, len(sizes)) if n else 0
        x, y = (int(ends[i - 1]) if i else 0), (int(ends[j - 1]) if j else 0)
        again = text[x : a - left_first] + insert + text[z - left_first : y]
        s, c = pieces(file, again)
        sizes[i:j], counts[i:j] = s, c
        text = text[:x] + again + text[y:]
        fresh, p = [], 0
        step = LEAVES if len(sizes) > 2 * LEAVES * len(held) else max(1, -(-len(sizes) // len(held)))
        for k in range(0, len(sizes), step):
            w = sum(sizes[k : k + step])
            fresh.append([text[p : p + w], sizes[k : k + step], counts[k : k + step]])
            p += w
        self.nodes[left : right + 1] = fresh
        self._bytes[left : right + 1] = [len(x[0]) for x in fresh]
        self._ids[left : right + 1] = [sum(x[2]) for x in fresh]
        if len(fresh) == len(held):
            for k in range(left, right + 1):
                self._update(k)
        else:
            self._raise()
        return len(again)


_LEAF = pa.list_(pa.int32())


def _built(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                some = batch.slice(k, 1024)
                buf, start = _text.join(some.column("text"), _tokens.END)
                sizes, counts = [], []
                for i, j in _text.slices(start, _tokens.BATCH):
                    b, s = buf[start[i] : start[j]], start[i : j + 1] - start[i]
                    at, ids = _tokens.piece_counts(file, b, s)
                    size = np.diff(np.append(at, len(b)))
                    first = np.searchsorted(at, s)
                    for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                        # the piece after a text is its end; an empty text has no other
                        sizes.append(size[x : y - 1])
                        counts.append(ids[x : y - 1])
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(sizes, _LEAF), pa.array(counts, _LEAF)], [*some.schema.names, "_sizes", "_counts"])

    return run


def build(docs: DataFrame, file: str) -> DataFrame:
    """docs with _sizes and _counts, the leaves of each text's tree; they can be stored with the texts."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_spark.bounded(_built(file)), f"{schema}, _sizes array<int>, _counts array<int>")


def _edited(file: str, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                some = batch.slice(k, 1024)
                before, after, again, n, text, sizes, counts = [], [], [], [], [], [], []
                raw = some.column("text").cast(pa.binary()).to_pylist()
                leaf = [some.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("_sizes", "_counts")]
                ends = np.cumsum(some.column("_sizes").value_lengths().fill_null(0).to_numpy()).tolist()
                for t, a, z, edits in zip(raw, [0, *ends], ends, some.column("edits").to_pylist(), strict=False):
                    tree = Tree(t or b"", leaf[0][a:z], leaf[1][a:z])
                    before.append(tree.total)
                    edits = [e for e in (edits or []) if e is not None]
                    again.append(sum(tree.edit(file, e["at"] or 0, e["remove"] or 0, (e["insert"] or "").encode()) for e in edits))
                    after.append(tree.total)
                    n.append(tree.size[1])
                    if texts:
                        text.append(tree.text.decode())
                        x, y = tree.leaves()
                        sizes.append(x)
                        counts.append(y)
                rest = some.drop_columns(["text", "_sizes", "_counts", "edits"])
                more = [pa.array(x, pa.int64()) for x in (before, after, again, n)]
                names = [*rest.schema.names, "n_before", "n_after", "bytes_encoded", "bytes_after"]
                if texts:
                    more += [pa.array(text, pa.string()), pa.array(sizes, _LEAF), pa.array(counts, _LEAF)]
                    names += ["text", "_sizes", "_counts"]
                yield pa.RecordBatch.from_arrays([*rest.columns, *more], names)

    return run


def apply(trees: DataFrame, file: str, texts: bool = True) -> DataFrame:
    """trees: build()'s rows and edits (EDIT, applied in order). Adds n_before, n_after, bytes_encoded, bytes_after and, with texts, the new text and leaves."""
    rest = trees.drop("text", "_sizes", "_counts", "edits")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    schema += ", n_before long, n_after long, bytes_encoded long, bytes_after long" + ", text string, _sizes array<int>, _counts array<int>" * texts
    return trees.withColumn("edits", F.col("edits").cast(EDIT)).mapInArrow(_spark.bounded(_edited(file, texts)), schema)
