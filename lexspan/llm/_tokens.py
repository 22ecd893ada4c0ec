"""Token ids of whole texts by the tokenizers library, once for each distinct piece of text.

A text is cut before white space, and between a letter or digit and a punctuation mark, only where
no pre-token of the public tokenizers can cross and never inside a string that the tokenizer's file
adds as one token (<|endoftext|>); the ids of a text are then the ids of its pieces in order. Each distinct piece of a batch is encoded once, and short pieces stay in a bounded cache.
"""

from __future__ import annotations

import array
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import _text

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of text that are encoded at once, and pieces that a worker keeps.
BATCH, KEPT, KEPT_BYTES = 4 << 20, 120_000, 24

_WS = np.zeros(256, bool)
_WS[[9, 10, 13, 32]] = True
_ALNUM = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _ALNUM[_a:_b] = True
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_MARK = _SOLID & ~_ALNUM
_MARK[0x27] = False  # an apostrophe joins contractions


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def tokenizer(file: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


@lru_cache(4)
def added(file: str) -> tuple[bytes, ...]:
    """The strings that the file adds as one token each; in a text they are that token."""
    import json

    with open(file, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens") or []
    for x in tokens:
        if x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized"):
            raise ValueError(f"the added token {x['content']} does not stand for its exact bytes alone")
    return tuple(x["content"].encode() for x in tokens)


def holds_added(file: str, text: bytes) -> bool:
    return any(s in text for s in added(file))


@lru_cache(4)
def reach(file: str) -> int:
    """Bytes on either side of a change that may belong to an added token with it."""
    return max(map(len, added(file)), default=1) - 1


#: Stands after each text in the joined buffer; it is in no UTF-8 text and has no ids.
END = 0xFF


def cuts(file: str, buf: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Places where the joined texts may be cut: the start and end of each text and the safe places in it."""
    ok = np.zeros(len(buf), bool)
    at = np.flatnonzero(_WS[buf])
    at = at[at > 0]
    prev = buf[at - 1]
    ok[at[_SOLID[prev]]] = True
    high = at[(prev >= 0x80) & (at > 2)]
    # a non-ASCII character before it may be white space: all of those begin with C2, E1, E2 or E3
    lead2, lead3 = buf[high - 2], buf[high - 3]
    ok[high[(lead2 != 0xC2) & ~((lead3 >= 0xE1) & (lead3 <= 0xE3))]] = True
    at = np.flatnonzero(_MARK[buf])
    at = at[at > 0]
    ok[at[_ALNUM[buf[at - 1]]]] = True
    for s in added(file):
        at = np.flatnonzero(buf[: len(buf) - len(s) + 1] == s[0]) if len(buf) >= len(s) else at[:0]
        for k in range(1, len(s)):
            at = at[buf[at + k] == s[k]]
        for k in range(1, len(s)):
            ok[at + k] = False
    ok[start[:-1]] = True
    ok[start[1:] - 1] = True
    return np.flatnonzero(ok)


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(4)
def _single(file: str):
    """A function that gives a piece's one pre-token as the model takes it, or None if it may have more."""
    import json

    with open(file, encoding="utf-8") as f:
        spec = json.load(f)
    chars, norm, pre = _byte_chars(), spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    lowers = bool(norm) and [x.get("type") for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):

        def one(b: bytes) -> str | None:
            s = b.decode()
            return b.decode("latin-1").translate(chars) if (s[1:] if s[0] == " " else s).isalpha() else None

    elif lowers:

        def one(b: bytes) -> str | None:
            s = b.decode().strip(" \t\n\r")
            if not s.isalpha() or max(s) > "\u024f":  # without marks, NFC leaves these letters as they are
                return None
            return "".join(map(str.lower, s)).encode().decode("latin-1").translate(chars) if "\u0130" not in s else None

    else:

        def one(b: bytes) -> str | None:
            return None

    return one


_cache: dict[str, dict[bytes, np.ndarray]] = {}


def _ids(file: str, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces, end of each)."""
    kept = _cache.setdefault(file, {b"\xff": b""})
    keys = pieces.to_pylist()
    found = list(map(kept.get, keys))
    missing = [i for i, x in enumerate(found) if x is None]
    if missing:
        if len(kept) + len(missing) > KEPT:
            kept.clear()
            kept[b"\xff"] = b""
        t, one, pack = tokenizer(file), _single(file), array.array
        model, rest = t.model.tokenize, []
        for i in missing:
            k = keys[i]
            s = one(k)
            if s is None:
                rest.append(i)
                continue
            found[i] = x = pack("I", [y.id for y in model(s)]).tobytes()
            if len(k) <= KEPT_BYTES and len(kept) < KEPT:
                kept[k] = x
        for a in range(0, len(rest), 50_000):
            part = rest[a : a + 50_000]
            for i, e in zip(part, t.encode_batch_fast([keys[i].decode() for i in part], add_special_tokens=False), strict=True):
                found[i] = x = pack("I", e.ids).tobytes()
                if len(keys[i]) <= KEPT_BYTES and len(kept) < KEPT:
                    kept[keys[i]] = x
    size = np.fromiter(map(len, found), np.int64, len(found)) // 4
    return np.frombuffer(b"".join(found), np.uint32), np.cumsum(size)


def encode(file: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, index of the first id of each text and the end). Null and empty give none."""
    buf, start = _text.join(texts, END)
    out, total = [], np.zeros(len(start), np.int64)
    for i, j in _text.slices(start, BATCH):
        b, s = buf[start[i] : start[j]], start[i : j + 1] - start[i]
        at = cuts(file, b, s)
        offs = np.append(at, len(b)).astype(np.int64)
        arr = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offs), pa.py_buffer(b)])
        d = pc.dictionary_encode(arr)
        ids, end = _ids(file, d.dictionary)
        code = d.indices.to_numpy()
        size = np.diff(end, prepend=0)
        first = (end - size)[code]
        size = size[code]
        stop = np.cumsum(size)
        first -= stop - size
        take = np.repeat(first, size)
        take += np.arange(stop[-1])
        out.append(ids[take])
        total[i + 1 : j + 1] = np.add.reduceat(size, np.searchsorted(at, s[:-1]))
    return (np.concatenate(out) if out else np.zeros(0, np.uint32)), np.cumsum(total)


def piece_counts(file: str, buf: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each piece of joined texts, number of its ids). The byte after each text is a piece without ids."""
    at = cuts(file, buf, start)
    offs = np.append(at, len(buf)).astype(np.int64)
    arr = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offs), pa.py_buffer(buf)])
    d = pc.dictionary_encode(arr)
    _, end = _ids(file, d.dictionary)
    return at, np.diff(end, prepend=0)[d.indices.to_numpy()]


_LISTS = tuple(x.tolist() for x in (_WS, _ALNUM, _SOLID, _MARK))


def small_piece_counts(file: str, text: bytes) -> tuple[list[int], list[int]]:
    """(bytes, ids) of the pieces of one short text, by the rules of cuts() without arrays."""
    ws, alnum, solid, mark = _LISTS
    at = [0]
    for i in range(1, len(text)):
        c, p = text[i], text[i - 1]
        if ws[c]:
            if solid[p] or (p >= 0x80 and i > 2 and text[i - 2] != 0xC2 and not 0xE1 <= text[i - 3] <= 0xE3):
                at.append(i)
        elif mark[c] and alnum[p]:
            at.append(i)
    if holds_added(file, text):
        inside = {m.start() + k for s in added(file) for m in re.finditer(re.escape(s), text) for k in range(1, len(s))}
        at = [i for i in at if i not in inside]
    at.append(len(text))
    kept = _cache.setdefault(file, {b"\xff": b""})
    sizes, counts = [], []
    for a, z in zip(at, at[1:], strict=False):
        piece = text[a:z]
        ids = kept.get(piece)
        if ids is None:
            one, t = _single(file)(piece), tokenizer(file)
            found = [y.id for y in t.model.tokenize(one)] if one is not None else t.encode(piece.decode(), add_special_tokens=False).ids
            ids = array.array("I", found).tobytes()
            if len(piece) <= KEPT_BYTES and len(kept) < KEPT:
                kept[piece] = ids
        sizes.append(z - a)
        counts.append(len(ids) // 4)
    return sizes, counts
