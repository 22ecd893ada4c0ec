"""Card selection: policy, lexical and hybrid scores, verdicts, and the plan of scopes to read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions import text as T

ADMIT, REJECT, TOP = 0.85, 0.35, 32
CATALOG_CARDS = 10_000
LIMITS = {"cards": 32, "items": 128, "targets": 64, "chunks": 8, "associations": 256, "guide_bytes": 65_536}


def eligible(cards: DataFrame, usage: str = "retrieval", allow_sensitive: bool = False) -> DataFrame:
    """Cards whose policy lets them be used; a malformed policy refuses the whole catalog."""
    bad = cards.where(F.col("sensitive").isNull() | F.col("allowed_usage").isNull() | (F.size("allowed_usage") == 0))
    if not bad.isEmpty():
        raise ValueError("a card's policy is malformed")
    return cards.where(F.array_contains("allowed_usage", usage) & (~F.col("sensitive") | F.lit(allow_sensitive)))


def bounded_catalog(cards: DataFrame, most: int = CATALOG_CARDS) -> DataFrame:
    """The catalog, once its size is known to be within the limit."""
    if cards.limit(most + 1).count() > most:
        raise ValueError(f"the catalog has over {most} cards")
    return cards


def contains_term(query: Column, term: Column) -> Column:
    return (term != "") & F.contains(query, term)


#: Cards and queries whose grams meet in one matrix.
CARD_BLOCK, QUERY_BLOCK = 512, 1024


class _Catalog:
    """The catalog's terms and grams. A block's grams have numbers of their own; a column of its matrix is a question or a description."""

    def __init__(self, rows: list[dict]):
        self.ids = np.array([r["version_id"] for r in rows])
        self.terms = [r["terms"] or [] for r in rows]
        self.blocks = [self._block(rows[i : i + CARD_BLOCK]) for i in range(0, len(rows), CARD_BLOCK)]

    @staticmethod
    def _block(rows: list[dict]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sets = [(i, g or []) for i, r in enumerate(rows) for g in r["question_grams"] or []]
        first = np.searchsorted([i for i, _ in sets], np.arange(len(rows) + 1))
        sets += [(i, r["description_grams"] or []) for i, r in enumerate(rows)]
        names = sorted({x for _, g in sets for x in g})
        number = {x: k for k, x in enumerate(names)}
        gram = np.array([number[x] for _, g in sets for x in g], np.int64)
        size = np.array([len(g) for _, g in sets], np.int64)
        return pa.array(names, pa.string()), gram, np.repeat(np.arange(len(sets)), size), size, first

    def direct(self, q: str) -> np.ndarray:
        hit = np.array([sum(t in q for t in own) for own in self.terms], float)
        return np.where(hit > 0, 0.9 + 0.1 * hit / np.maximum([len(t) for t in self.terms], 1), 0.0)

    def likeness(self, grams: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(best question's, description's) Jaccard similarity: queries x cards."""
        size = grams.value_lengths().fill_null(0).to_numpy()
        row, flat = np.repeat(np.arange(len(grams)), size), grams.flatten()
        question, described = [], []
        for names, gram, column, n, first in self.blocks:
            m = np.zeros((len(names), len(n)), np.float32)
            m[gram, column] = 1
            q = np.zeros((len(grams), len(names)), np.float32)
            at = pc.index_in(flat, names)
            known = np.asarray(at.is_valid())
            q[row[known], at.drop_null().to_numpy()] = 1
            both = (q @ m).astype(float)  # whole numbers far below 2**24
            like = np.divide(both, size[:, None] + n[None, :] - both, out=np.zeros_like(both), where=both > 0)
            k = len(first) - 1
            best = np.zeros((len(grams), k))
            own = np.flatnonzero(np.diff(first))
            if len(own):
                best[:, own] = np.maximum.reduceat(like[:, : first[-1]], first[own], axis=1)
            question.append(best)
            described.append(like[:, first[-1] :])
        return np.concatenate(question, axis=1), np.concatenate(described, axis=1)


SIGNALS = ("none", "description", "question", "declared_term")


def lexical_scores(queries: DataFrame, cards: DataFrame) -> DataFrame:
    """query_id, version_id, score, signal for each query and card.

    queries: query_id, text; cards: version_id, keywords, questions, description. Texts are normalised
    first, and their bigrams are made once for each query and card. A declared term in the query scores
    0.9 and up; otherwise the likest question, or half the description's likeness, counts; of equal
    signals the first declared stays. The catalog is refused above its limit and sent to all tasks; a
    block of queries meets a block of cards in one product of their gram matrices. A null query text
    scores 0 with every card.
    """
    few = bounded_catalog(
        cards.select(
            "version_id",
            F.filter(F.transform("keywords", T.query_text_native), lambda k: k != "").alias("terms"),
            F.transform("questions", lambda q: T.bigrams(T.query_text_native(q))).alias("question_grams"),
            T.bigrams(T.query_text_native(F.col("description"))).alias("description_grams"),
        )
    )
    kinds = StructType([queries.schema["query_id"], cards.schema["version_id"], StructField("score", DoubleType()), StructField("signal", StringType())])
    rows = [r.asDict() for r in few.collect()]  # CATALOG_CARDS at most
    if not rows:
        return queries.sparkSession.createDataFrame([], kinds)
    shared = queries.sparkSession.sparkContext.broadcast(rows)
    version = pa.array([r["version_id"] for r in rows])
    signals = pa.array(SIGNALS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        catalog = _Catalog(shared.value)
        k = len(catalog.ids)
        for batch in batches:
            for i in range(0, batch.num_rows, QUERY_BLOCK):
                some = batch.slice(i, QUERY_BLOCK)
                n = some.num_rows
                direct = np.stack([catalog.direct(x or "") for x in some.column("q").to_pylist()])
                question, described = catalog.likeness(some.column("grams"))
                described *= 0.5
                score = np.clip(np.maximum(direct, np.maximum(question, described)), 0, 1)
                kind = np.select([direct > 0, (question > 0) & (question >= described), described > 0], [3, 2, 1], 0)
                yield pa.record_batch(
                    [some.column("query_id").take(pa.array(np.repeat(np.arange(n), k))), version.take(pa.array(np.tile(np.arange(k), n))), pa.array(score.ravel()), signals.take(pa.array(kind.ravel()))],
                    ["query_id", "version_id", "score", "signal"],
                )

    q = queries.select("query_id", T.query_text_native(F.col("text")).alias("q"))
    return q.withColumn("grams", T.bigrams(F.col("q"))).mapInArrow(run, kinds)


def verdict(score: Column, admit: float = ADMIT, reject: float = REJECT) -> Column:
    """Closed on the decisive sides; what is not finite is rejected."""
    bad = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    return F.when(bad, "reject").when(score >= admit, "admit").when(score <= reject, "reject").otherwise("defer")


def judged(scores: DataFrame, admit: float = ADMIT, reject: float = REJECT) -> DataFrame:
    """scores with position and verdict: finite scores first, falling, then by version."""
    w = Window.partitionBy("query_id").orderBy(F.when(F.isnan("score") | F.col("score").isNull(), 1).otherwise(0), F.desc("score"), "version_id")
    return scores.withColumn("position", F.row_number().over(w)).withColumn("verdict", verdict(F.col("score"), admit, reject))


def best(scores: DataFrame, by: str, top: int = TOP) -> DataFrame:
    """(query_id, version_id) of the highest scores of each query."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "version_id"))
    return scores.withColumn("_r", place).where(F.col("_r") <= top).select("query_id", "version_id")


def hybrid(lexical: DataFrame, semantic: DataFrame, top: int = TOP) -> DataFrame:
    """lexical (query_id, version_id, score) with cosine (of semantic) for the union of both top lists, and the combined score."""
    union = best(lexical, "score", top).unionByName(best(semantic, "cosine", top)).distinct().join(semantic, ["query_id", "version_id"])
    out = lexical.join(union, ["query_id", "version_id"], "left")
    return out.select("query_id", "version_id", F.col("score").alias("lexical"), "cosine", T.hybrid_score(F.col("score"), T.semantic_score(F.coalesce("cosine", F.lit(0.0)))).alias("score"))


def planned(admitted: DataFrame) -> DataFrame:
    """One item for each scope of a query's admitted cards: query_id, scope_key, definition, selected_by (cards in rank order).

    admitted: query_id, version_id, position, scope_key, definition. A scope with two definitions is refused.
    """
    items = admitted.groupBy("query_id", "scope_key").agg(
        F.min("definition").alias("definition"), F.count_distinct("definition").alias("_n"), F.array_sort(F.collect_set(F.struct("position", "version_id"))).alias("_by")
    )
    one = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("two definitions of scope "), F.col("scope_key").cast("string"))).cast("string")).otherwise(F.col("definition").cast("string"))
    return items.select("query_id", "scope_key", one.alias("definition"), F.transform("_by", lambda x: x["version_id"]).alias("selected_by"))


def plan_sizes(plan: DataFrame) -> DataFrame:
    """query_id, selected and definition_bytes of each item of a plan with its texts (definition) and cards (selected_by)."""
    return plan.select("query_id", F.size("selected_by").alias("selected"), F.octet_length("definition").alias("definition_bytes"))


def plan_violations(sizes: DataFrame) -> DataFrame:
    """query_id and limit for each plan that is too large. sizes: query_id, selected, definition_bytes of each item, so that no text has to be at hand."""
    a = sizes.groupBy("query_id").agg(F.count("*").alias("items"), F.sum("selected").alias("associations"), F.sum("definition_bytes").alias("guide_bytes"))
    checks = F.filter(F.array(*[F.when(F.col(k) > LIMITS[k], F.lit(k)) for k in ("items", "associations", "guide_bytes")]), lambda x: x.isNotNull())
    return a.select("query_id", F.explode(checks).alias("limit"))


def summary(judgements: DataFrame) -> DataFrame:
    n = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return judgements.groupBy("query_id").agg(n("admit"), n("defer"), n("reject"))
