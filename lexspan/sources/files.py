"""Document sources: registration, observation of changed files, and the state of a source."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T

MOST_BYTES = 10 * 1024 * 1024
SUFFIXES = (".md", ".markdown")
_SECRET = re.compile(r"(?i)(password|secret|token|api[_-]?key|authorization)")
_READERS: dict[str, Callable[[SparkSession, dict], DataFrame]] = {}


def register(kind: str, reader: Callable[[SparkSession, dict], DataFrame]) -> None:
    """Makes a kind of source known; reader gives source_key and content (binary)."""
    _READERS[kind] = reader


def reader(kind: str) -> Callable[[SparkSession, dict], DataFrame]:
    if kind not in _READERS:
        raise ValueError(f"no source adapter for {kind}")
    return _READERS[kind]


def check_configuration(kind: str, configuration: dict) -> dict:
    """Refuses inline secrets, unknown kinds and other files than Markdown."""
    for k, v in configuration.items():
        if _SECRET.search(k) or (isinstance(v, str) and re.search(r"://[^/@\s]+:[^/@\s]+@", v)):
            raise ValueError(f"{k}: a source must not hold a secret")
    reader(kind)
    if kind == "markdown" and not str(configuration.get("path", "")).strip():
        raise ValueError("path: missing")
    return configuration


def _markdown(spark: SparkSession, configuration: dict) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(configuration["path"])
    return files.where(F.lower("path").rlike("\\.(md|markdown)$")).select(F.col("path").alias("source_key"), "length", "content", F.col("modificationTime").alias("modified_at"))


register("markdown", _markdown)


def observe(spark: SparkSession, kind: str, configuration: dict, known: DataFrame | None = None) -> DataFrame:
    """source_id, source_key, text, content_digest and problem of each file; those whose digest is known (source_id, content_digest) are left out.

    A file that is too large or is no UTF-8 has a problem and no text; a null path never occurs.
    """
    raw = reader(kind)(spark, check_configuration(kind, configuration))
    decoded = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    problem = F.when(F.col("length") > MOST_BYTES, "too_large").when(decoded.isNull(), "not_utf8")
    out = raw.select(F.concat(F.lit("src_"), F.substring(F.sha2("source_key", 256), 1, 32)).alias("source_id"), "source_key", F.when(problem.isNull(), T.canonical_text(decoded)).alias("text"), problem.alias("problem"))
    out = out.withColumn("content_digest", T.digest(F.col("text")))
    return out if known is None else out.join(known.select("source_id", "content_digest"), ["source_id", "content_digest"], "left_anti")


def new_sources(candidates: DataFrame, registered: DataFrame) -> DataFrame:
    """Candidates whose target_key is not registered, one for each."""
    return candidates.join(registered.select("target_key"), "target_key", "left_anti").dropDuplicates(["target_key"])


def target_key(path: Column) -> Column:
    return F.concat(F.lit("file:"), F.sha2(path, 256))


def commit(observations: DataFrame, more: DataFrame) -> DataFrame:
    """observations with those of more that are not in it yet; the first with an observation_id stays."""
    fresh = more.join(observations.select("observation_id"), "observation_id", "left_anti").dropDuplicates(["observation_id"])
    return observations.unionByName(fresh)


#: What a source may become after each event.
TRANSITIONS = {
    ("active", "idle", "start"): ("active", "running"),
    ("active", "succeeded", "start"): ("active", "running"),
    ("active", "failed", "start"): ("active", "running"),
    ("active", "running", "succeed"): ("active", "succeeded"),
    ("active", "running", "fail"): ("active", "failed"),
    ("active", "idle", "disable"): ("disabled", "idle"),
    ("active", "succeeded", "disable"): ("disabled", "succeeded"),
    ("active", "failed", "disable"): ("disabled", "failed"),
    ("disabled", "idle", "enable"): ("active", "idle"),
    ("disabled", "succeeded", "enable"): ("active", "succeeded"),
    ("disabled", "failed", "enable"): ("active", "failed"),
}


def advance(lifecycle: str, execution: str, event: str) -> tuple[str, str]:
    if (lifecycle, execution, event) not in TRANSITIONS:
        raise ValueError(f"a source that is {lifecycle} and {execution} cannot {event}")
    return TRANSITIONS[lifecycle, execution, event]


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """The list of sources in a JSON file: name, type, path."""
    return spark.read.schema("name string, type string, path string").option("multiLine", "true").option("mode", "FAILFAST").json(path)


def parse_publications(lines: DataFrame, schema: str, most_bytes: int = 16 * 1024 * 1024) -> DataFrame:
    """Contract records from JSON text (column value); a record that is too large or does not fit the schema fails the read."""
    checked = F.when(F.octet_length("value") <= most_bytes, F.col("value")).otherwise(F.raise_error(F.lit("a publication is too large")).cast("string"))
    return lines.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("p")).select("p.*")


def to_json(value: object) -> str:
    return json.dumps(value, sort_keys=True)
