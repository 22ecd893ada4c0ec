"""Identity of blocks and units across versions of a document, and what changed."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from .passes import by_key

#: Fixed values of the lineage policy.
BLOCK_LEAST, BLOCK_MARGIN, UNIT_LEAST, UNIT_MARGIN = 0.85, 0.10, 0.60, 0.15


def unique_matches(previous: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """(doc_id, previous, current, key...) of blocks that are the only ones with their key on both sides. Both: doc_id, ord and the key."""
    one = lambda df, name: df.groupBy("doc_id", *key).agg(F.count("*").alias("_n"), F.min("ord").alias(name)).where("_n = 1").drop("_n")
    return one(previous, "previous").join(one(current, "current"), ["doc_id", *key])


def without(rows: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    return rows.join(matches.select("doc_id", F.col(side).alias("ord")), ["doc_id", "ord"], "left_anti")


def longest_rising(pairs: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """A longest run of pairs that rise on both sides, by patience sorting."""
    pairs = sorted(pairs)
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tails, y)
        back[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(y)
            at.append(i)
        else:
            tails[k], at[k] = y, i
    out, i = set(), at[-1] if at else -1
    while i >= 0:
        out.add(pairs[i])
        i = back[i]
    return out


class _Block:
    """A block of one side; its text is only made where it is asked for."""

    __slots__ = ("_at", "_texts", "digest", "kind", "ord", "section")

    def __init__(self, ord, kind, section, digest, texts: pa.Array, at: int):
        self.ord, self.kind, self.section, self.digest, self._texts, self._at = ord, kind, section, digest, texts, at

    @property
    def text(self) -> str | None:
        return self._texts[self._at].as_py()


Pairs = list[tuple[int, int]]


def _only(previous: list[_Block], current: list[_Block], key: Callable[[_Block], tuple[Hashable, ...]]) -> Pairs:
    """Pairs of blocks that are the only ones with their key on both sides; a key with nothing in a place is equal to none."""

    def one(side: list[_Block]) -> dict:
        found: dict = {}
        for b in side:
            k = key(b)
            found[k] = None if k in found else b
        return found

    there = one(current)
    return [(b.ord, there[k].ord) for k, b in one(previous).items() if b is not None and None not in k and there.get(k) is not None]


def _likeness(sets: list[frozenset], others: list[frozenset], least: float) -> Iterator[tuple[int, int, float]]:
    """(place, other place, Jaccard similarity) of all that are at least `least` alike, which have a token of both their prefixes in common."""
    often = Counter(t for x in (*sets, *others) for t in x)
    least = max(least - 1e-9, 0.0)

    def prefix(x: frozenset) -> list[str]:
        return sorted(x, key=lambda t: (often[t], t))[: len(x) - math.ceil(least * len(x) - 1e-9) + 1]

    index = defaultdict(list)
    for i, x in enumerate(sets):
        for t in prefix(x):
            index[t].append(i)
    for j, y in enumerate(others):
        for i in {i for t in prefix(y) for i in index.get(t, ())}:
            x = sets[i]
            if min(len(x), len(y)) < least * max(len(x), len(y)):
                continue
            both = len(x & y)
            if both and (score := both / (len(x) + len(y) - both)) >= least:
                yield i, j, score


def _likely(previous: list[_Block], current: list[_Block], least: float, margin: float) -> list[tuple[int, int, float]]:
    """(previous, current, score) of blocks of one kind that are each other's best by token Jaccard, clear of the next best.

    Blocks of equal token sets are compared once: several of them are each other's runners-up, so only single ones can match.
    A runner-up that is not within the margin of `least` decides nothing.
    """
    out = []
    for kind in {b.kind for b in previous if b.kind is not None} & {b.kind for b in current}:
        sides = []
        for side in (previous, current):
            same = defaultdict(list)
            for b in side:
                if b.kind == kind and (t := frozenset(T.token_list(b.text))):
                    same[t].append(b.ord)
            sides.append((list(same), list(same.values())))
        (ps, po), (cs, co) = sides
        scores = list(_likeness(ps, cs, least - margin))
        best: tuple[dict, dict] = (defaultdict(list), defaultdict(list))
        for i, j, score in scores:
            best[0][i] += [score] * min(len(co[j]), 2)
            best[1][j] += [score] * min(len(po[i]), 2)
        tops = [{k: (*sorted(v, reverse=True)[:2], 0.0)[:2] for k, v in x.items()} for x in best]
        for i, j, score in scores:
            (a, x), (b, y) = tops[0][i], tops[1][j]
            if score == a == b and score >= least and score - max(x, y) >= margin:
                out.append((po[i][0], co[j][0], score))
    return out


def _replaced(previous: list[_Block], current: list[_Block], anchors: set[tuple[int, int]]) -> Pairs:
    """Pairs where between two anchors each side has one block left, of the same kind."""

    def between(side: list[_Block], own: dict[int, int]) -> dict:
        gaps, gap = defaultdict(list), -1
        for b in sorted(side, key=lambda b: b.ord):
            if b.ord in own:
                gap = own[b.ord]
            else:
                gaps[gap].append(b)
        return {(g, x[0].kind): x[0].ord for g, x in gaps.items() if len(x) == 1 and x[0].kind is not None}

    there = between(current, {c: p for p, c in anchors})
    return [(x, there[k]) for k, x in between(previous, {p: p for p, _ in anchors}).items() if k in there]


def _identities(previous: list[_Block], current: list[_Block]) -> list[tuple[int, int, str]]:
    """(previous, current, how) of one document's blocks."""
    found: list[tuple[int, int, str]] = []
    rest: list[list[_Block]] = [previous, current]

    def take(pairs: Pairs, how: str) -> None:
        found.extend((p, c, how) for p, c in pairs)
        for side in (0, 1):
            used = {x[side] for x in pairs}
            rest[side] = [b for b in rest[side] if b.ord not in used]

    take(_only(*rest, lambda b: (b.kind, b.digest, b.section)), "in_place")
    take(_only(*rest, lambda b: (b.kind, b.digest)), "exact")
    rising = longest_rising(_only(*rest, lambda b: (b.kind, T.collapsed_lower(b.text))))
    take(sorted(rising), "sequence")
    take([(p, c) for p, c, _ in _likely(*rest, BLOCK_LEAST, BLOCK_MARGIN)], "likely")
    anchors = longest_rising([(p, c) for p, c, _ in found])
    loose = {(p, c) for p, c, _ in found} - anchors
    sides = [[b for b in side if b.ord not in {x[k] for x in loose}] for k, side in ((0, previous), (1, current))] if loose else [previous, current]
    return found + [(p, c, "replaced") for p, c in _replaced(*sides, anchors)]


def mutual_best(scores: DataFrame, group: list[str], least: float, margin: float) -> DataFrame:
    """Pairs (previous, current, score) that are best for both sides, at least `least`, and ahead of either side's runner-up by `margin`."""
    out = scores
    for side, other in (("previous", "current"), ("current", "previous")):
        w = Window.partitionBy(*group, side).orderBy(F.desc("score"), other)
        out = out.withColumn(f"_r_{side}", F.row_number().over(w)).withColumn(f"_next_{side}", F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    ahead = F.col("score") - F.greatest("_next_previous", "_next_current") >= margin
    return out.where((F.col("_r_previous") == 1) & (F.col("_r_current") == 1) & (F.col("score") >= least) & ahead).select(*group, "previous", "current", "score")


def anchored_headings(previous: DataFrame, current: DataFrame, matches: DataFrame) -> DataFrame:
    """(doc_id, previous, current) of unmatched headings that inherit through their content.

    A heading's anchor is the first matched block of its section that is no heading; the heading before that
    block's old place, unmatched and of the same level, is proposed; one that several claim goes to none.
    Both: doc_id, ord, kind, level; matches: doc_id, previous, current.
    """
    levels = range(1, 7)
    head = F.col("kind") == "heading"
    m = matches.select("doc_id", F.col("current").alias("ord"), F.col("previous").alias("was"))
    after = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    c = current.join(m, ["doc_id", "ord"], "left").withColumn("anchor", F.first(F.when(~head & F.col("was").isNotNull(), F.struct("ord", "was")), ignorenulls=True).over(after))
    ends = F.array(*[F.first(F.when(head & (F.col("level") <= k), F.col("ord")), ignorenulls=True).over(after) for k in levels])
    c = c.withColumn("end", F.get(ends, F.col("level").cast("int") - 1)).where(head & F.col("was").isNull())
    open_ = c.where(F.col("anchor").isNotNull() & (F.col("end").isNull() | (F.col("anchor.ord") < F.col("end")))).select("doc_id", F.col("ord").alias("current"), "level", F.col("anchor.was").alias("ord"))
    taken = matches.select("doc_id", F.col("previous").alias("ord"), F.lit(True).alias("used"))
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    free = previous.join(taken, ["doc_id", "ord"], "left")
    nearest = F.array(*[F.last(F.when(head & (F.col("level") == k) & F.col("used").isNull(), F.col("ord")), ignorenulls=True).over(before) for k in levels])
    proposed = open_.join(free.select("doc_id", "ord", nearest.alias("nearest")), ["doc_id", "ord"]).select("doc_id", "current", F.get("nearest", F.col("level").cast("int") - 1).alias("previous")).where("previous IS NOT NULL")
    once = proposed.groupBy("doc_id", "previous").agg(F.count("*").alias("n"), F.min("current").alias("current")).where("n = 1")
    return once.select("doc_id", "previous", "current")


def match_blocks(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(doc_id, previous, current, how) of blocks that keep their identity: exact in place, exact, in sequence, likely, replaced.

    Both: doc_id, ord, kind, section, text, digest. All of it is within a document, so its blocks are gathered once
    and matched in one pass; texts are read only of blocks that no digest has matched.
    """
    side = lambda x, n: x.select("doc_id", F.lit(n).alias("side"), "ord", "kind", "section", "digest", "text")
    rows = side(previous, 0).unionByName(side(current, 1)).where("doc_id IS NOT NULL")
    own, at = rows.schema["doc_id"], rows.schema["ord"].dataType

    def run(doc, batches: list[pa.RecordBatch]) -> Iterator[tuple]:
        sides: tuple[list[_Block], list[_Block]] = ([], [])
        for b in batches:
            texts = b.column(6)
            for i, (s, *block) in enumerate(zip(*(b.column(k).to_pylist() for k in range(1, 6)), strict=True)):
                sides[s].append(_Block(*block, texts, i))
        for p, c, how in _identities(*sides):
            yield doc, p, c, how

    return by_key(rows, StructType([own, StructField("previous", at), StructField("current", at), StructField("how", StringType())]), run)


def block_changes(previous: DataFrame, current: DataFrame, matches: DataFrame) -> DataFrame:
    """doc_id, previous, current, change: unchanged, modified, moved (off the longest rising run), added or removed."""
    none = F.lit(None).cast(previous.schema["ord"].dataType)
    rows = (
        previous.select("doc_id", F.col("ord").alias("previous"), none.alias("current"), "digest")
        .unionByName(current.select("doc_id", none.alias("previous"), F.col("ord").alias("current"), "digest"))
        .unionByName(matches.select("doc_id", "previous", "current", F.lit(None).cast("string").alias("digest")))
    )

    def run(doc, batches: list[pa.RecordBatch]) -> Iterator[tuple]:
        p, c, pairs = [], [], []
        for b in batches:
            for x, y, digest in zip(*(b.column(k).to_pylist() for k in range(1, 4)), strict=True):
                if y is None:
                    p.append((x, digest))
                elif x is None:
                    c.append((y, digest))
                else:
                    pairs.append((x, y))
        kept, to, now = longest_rising(pairs), dict(pairs), dict(c)
        met = set()
        for x, digest in p:
            y = to.get(x)
            if y is None or y not in now:
                yield doc, x, y, "removed"
                continue
            met.add(y)
            yield doc, x, y, "modified" if digest != now[y] else "unchanged" if (x, y) in kept else "moved"
        for y, _ in c:
            if y not in met:
                yield doc, None, y, "added"

    s = rows.schema
    return by_key(rows, StructType([s["doc_id"], StructField("previous", s["previous"].dataType), StructField("current", s["current"].dataType), StructField("change", StringType())]), run)


def unit_matches(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(doc_id, previous, current, score) of units by the Jaccard similarity of their blocks' ids. Both: doc_id, ord, kind, blocks (array)."""
    ex = lambda df, name, n: df.select("doc_id", "kind", F.col("ord").alias(name), F.size("blocks").alias(n), F.explode("blocks").alias("b"))
    both = ex(previous, "previous", "pn").join(ex(current, "current", "cn"), ["doc_id", "kind", "b"])
    s = both.groupBy("doc_id", "previous", "current").agg((F.count("*") / (F.first("pn") + F.first("cn") - F.count("*"))).alias("score"))
    return mutual_best(s, ["doc_id"], UNIT_LEAST, UNIT_MARGIN)


def operations(previous: DataFrame, current: DataFrame, key: str = "revision") -> DataFrame:
    """revision and operation: embed (new), reuse, or delete (gone)."""
    p, c = previous.select(key).distinct(), current.select(key).distinct()
    return (
        c.join(p, key, "left_anti").select(key, F.lit("embed").alias("operation"))
        .unionByName(c.join(p, key, "left_semi").select(key, F.lit("reuse").alias("operation")))
        .unionByName(p.join(c, key, "left_anti").select(key, F.lit("delete").alias("operation")))
    )


def rebuild_reasons(previous: dict, current: dict) -> list[str]:
    """Attributes whose change makes an incremental update impossible."""
    return sorted(k for k in previous.keys() | current.keys() if previous.get(k) != current.get(k))


def equivalence_violations(incremental: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows that only one of the two ways to build an index has; ids are left out before."""
    return incremental.exceptAll(rebuilt).withColumn("only_in", F.lit("incremental")).unionByName(rebuilt.exceptAll(incremental).withColumn("only_in", F.lit("rebuilt")))


def carried_chunks(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(doc_id, previous, current, how) of chunks that keep their identity: the only ones with their boundary, then with their unit, digest and split.

    Both: doc_id, ord, unit, first_block, first_at, last_block, last_at, last_length, digest, split. An end at a block's length counts as the block's end.
    """
    bound = lambda df: df.withColumn("_end", F.when(F.col("last_at") == F.col("last_length"), F.lit(-1)).otherwise(F.col("last_at")))
    first = unique_matches(bound(previous), bound(current), ["unit", "first_block", "first_at", "last_block", "_end"]).select("doc_id", "previous", "current", F.lit("boundary").alias("how"))
    rest = unique_matches(without(previous, first, "previous"), without(current, first, "current"), ["unit", "digest", "split"])
    return first.unionByName(rest.select("doc_id", "previous", "current", F.lit("content").alias("how")))


def unit_decisions(previous: DataFrame, current: DataFrame, matches: DataFrame) -> DataFrame:
    """doc_id, side (current or previous), ord and decision: inherited, new, split, merge or ambiguous for current units; deleted, split, merge or ambiguous for previous ones without a heir.

    Both: doc_id, ord, blocks; a unit that shares blocks with several of the other side is a merge or has been split.
    """
    ex = lambda df, name: df.select("doc_id", F.col("ord").alias(name), F.explode("blocks").alias("b"))
    over = ex(previous, "previous").join(ex(current, "current"), ["doc_id", "b"]).select("doc_id", "previous", "current").distinct()
    back = over.groupBy("doc_id", F.col("current").alias("ord")).agg(F.count("*").alias("sources"))
    ahead = over.groupBy("doc_id", F.col("previous").alias("ord")).agg(F.count("*").alias("heirs"))
    widest = over.join(ahead.withColumnRenamed("ord", "previous"), ["doc_id", "previous"]).groupBy("doc_id", F.col("current").alias("ord")).agg(F.max("heirs").alias("heirs"))
    narrow = over.join(back.withColumnRenamed("ord", "current"), ["doc_id", "current"]).groupBy("doc_id", F.col("previous").alias("ord")).agg(F.max("sources").alias("sources"))
    kept = lambda side: matches.select("doc_id", F.col(side).alias("ord"), F.lit(True).alias("_kept"))
    why = lambda none: F.when(F.coalesce("sources", "heirs").isNull(), none).when((F.col("heirs") > 1) & (F.col("sources") > 1), "ambiguous").when(F.col("sources") > 1, "merge").when(F.col("heirs") > 1, "split").otherwise("ambiguous")
    c = current.select("doc_id", "ord").join(back, ["doc_id", "ord"], "left").join(widest, ["doc_id", "ord"], "left").join(kept("current"), ["doc_id", "ord"], "left")
    p = previous.select("doc_id", "ord").join(ahead, ["doc_id", "ord"], "left").join(narrow, ["doc_id", "ord"], "left").join(kept("previous"), ["doc_id", "ord"], "left")
    return (
        c.select("doc_id", F.lit("current").alias("side"), "ord", F.when(F.col("_kept"), "inherited").otherwise(why("new")).alias("decision"))
        .unionByName(p.where("_kept IS NULL").select("doc_id", F.lit("previous").alias("side"), "ord", why("deleted").alias("decision")))
    )
