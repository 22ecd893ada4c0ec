"""Canonical JSON, revision identities and set digests."""

from __future__ import annotations

import base64
import hashlib
import json
import math
from typing import Any

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType


def _plain(v: Any) -> Any:
    if isinstance(v, float):
        if not math.isfinite(v):
            raise ValueError("a number must be finite")
        return int(v) if v.is_integer() and abs(v) < 1e21 else v
    if isinstance(v, dict):
        return {str(k): _plain(x) for k, x in v.items() if x is not None}
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v


def canonical_json(v: Any) -> str:
    """Sorted keys, no spaces, whole numbers without a point; keys without a value are left out."""
    return json.dumps(_plain(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_digest(v: Any) -> str:
    return "sha256:" + hashlib.sha256(canonical_json(v).encode()).hexdigest()


def revision_id(prefix: str, v: Any) -> str:
    """prefix_ and the lower-case base32, without padding, of the canonical JSON's SHA-256."""
    return f"{prefix}_{base64.b32encode(hashlib.sha256(canonical_json(v).encode()).digest()).decode().lower().rstrip('=')}"


def canonical_json_column(c: Column) -> Column:
    """Of a column of JSON text."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else canonical_json(json.loads(x)))

    return run(c)


def revision_column(prefix: str, c: Column) -> Column:
    """revision_id of a column of JSON text."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else revision_id(prefix, json.loads(x)))

    return run(c)


def stable_id(prefix: str, *parts: Column) -> Column:
    """A deterministic logical id from what an entity is first seen with: a retried task gives the same."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\u001f", *parts).cast("binary"), 256), 1, 32))


def uuid7(ms: Column, key: Column) -> Column:
    """A version 7 UUID of a time in milliseconds whose random bits come from the key: a retried task gives the same."""
    t, h = F.lpad(F.lower(F.hex(ms.cast("long"))), 12, "0"), F.sha2(key.cast("binary"), 256)
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.ascii(F.substring(h, 4, 1)) % 4 + 1).cast("int"))
    return F.concat(F.substring(t, 1, 8), F.lit("-"), F.substring(t, 9, 4), F.lit("-7"), F.substring(h, 1, 3), F.lit("-"), variant, F.substring(h, 5, 3), F.lit("-"), F.substring(h, 8, 12))


def set_digest(rows: Column) -> Column:
    """Digest of an array of texts, whatever its order."""
    return F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.array_sort(rows), "\n").cast("binary"), 256))


def bytes_of(c: Column) -> Column:
    return F.octet_length(c).cast("long")
