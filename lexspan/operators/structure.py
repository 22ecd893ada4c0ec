"""Documents as blocks, semantic units and chunks.

Parsing, segmentation and chunking fold over one document in order, so each document is one row of one
Arrow pass: no shuffle, and memory is bounded by a batch. What follows them (keywords, links, checks)
is relational.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from heapq import nsmallest
from itertools import accumulate
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import text as T
from .passes import by_key, tabled

#: Fixed values of the segmentation, chunk and keyword policies.
SEGMENT = {"least": 120, "target": 600, "most": 1200, "window": 3, "mad": 1.0, "flat_depth": 0.35, "sparse_words": 8, "least_gaps": 3}
CHUNK = {"target": 320, "most": 480, "overlap": 48, "header": 48}
KEYWORDS, KEYWORD_UNITS = 32, 64
KEYWORD_KINDS = ("paragraph", "list_item", "table", "quote")

PROSE = ("paragraph", "list_item", "quote")

_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^`]*)$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_ITEM = re.compile(r"([ \t]*)([-*+]|\d{1,9}[.)])[ \t]+(.*)$")
_QUOTE = re.compile(r" {0,3}>[ ]?(.*)$")
_DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_DEFINITION = re.compile(r" {0,3}\[[^\]]+\]:[ \t]*\S+")
_HTML = re.compile(r" {0,3}</?[A-Za-z!][^>]*>")


def _inline(s: str) -> str:
    """The text of inline marks: images' and links' labels, code, emphasis."""
    s = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", s)
    s = re.sub(r"`+([^`]*)`+", r"\1", s)
    return re.sub(r"(\*\*|__|\*|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", s).strip()


def _cells(line: str) -> list[str]:
    return [_inline(c) for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))]


def parse(source: str) -> tuple[list[dict], list[str]]:
    """Blocks in order (kind, text, level, ordered, language, cells, section, start, end), and diagnostics."""
    blocks: list[dict] = []
    problems: list[str] = []
    stack: list[tuple[int, str]] = []
    lines, starts, at = source.split("\n"), [], 0
    for x in lines:
        starts.append(at)
        at += len(x) + 1

    def add(kind: str, text: str, i: int, j: int, **more) -> None:
        blocks.append({"kind": kind, "text": text, "level": 0, "ordered": False, "language": None, "cells": None} | more | {"section": [t for _, t in stack], "start": starts[i], "end": starts[j - 1] + len(lines[j - 1])})

    def heading(level: int, title: str, i: int, j: int) -> None:
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, title))
        add("heading", title, i, j, level=level)

    i, n = 0, len(lines)
    while i < n:
        x = lines[i]
        if not x.strip():
            i += 1
        elif m := _FENCE.match(x):
            j = i + 1
            while j < n and not re.match(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$", lines[j]):
                j += 1
            add("code", "\n".join(lines[i + 1 : j]), i, min(j + 1, n), language=m[2].strip() or None)
            i = min(j + 1, n)
        elif m := _HEADING.match(x):
            heading(len(m[1]), _inline(m[2] or ""), i, i + 1)
            i += 1
        elif _RULE.match(x):
            add("divider", "", i, i + 1)
            i += 1
        elif "|" in x and i + 1 < n and _DELIMITER.match(lines[i + 1]) and "-" in lines[i + 1] and len(_cells(x)) == len(_cells(lines[i + 1])):
            j = i + 2
            while j < n and lines[j].strip() and "|" in lines[j]:
                j += 1
            rows = [_cells(lines[i]), *(_cells(y) for y in lines[i + 2 : j])]
            add("table", "\n".join(" | ".join(r) for r in rows), i, j, cells=rows)
            i = j
        elif _DEFINITION.match(x):
            problems.append("definition_not_indexed")
            i += 1
        elif m := _ITEM.match(x):
            j = i + 1
            while j < n and lines[j].strip() and not _ITEM.match(lines[j]) and not _HEADING.match(lines[j]) and not _FENCE.match(lines[j]):
                j += 1
            text = "\n".join([m[3], *(y.strip() for y in lines[i + 1 : j])])
            add("list_item", _inline(text), i, j, level=len(m[1].expandtabs(4)) // 2, ordered=m[2][0].isdigit())
            i = j
        elif _QUOTE.match(x):
            j = i
            while j < n and _QUOTE.match(lines[j]):
                j += 1
            add("quote", _inline("\n".join(_QUOTE.match(y)[1] for y in lines[i:j])), i, j)
            i = j
        else:
            j = i + 1
            while j < n and lines[j].strip() and not (_SETEXT.match(lines[j]) or _HEADING.match(lines[j]) or _FENCE.match(lines[j]) or _RULE.match(lines[j]) or _ITEM.match(lines[j]) or _QUOTE.match(lines[j])):
                j += 1
            if j < n and _SETEXT.match(lines[j]):
                heading(1 if "=" in lines[j] else 2, _inline(" ".join(y.strip() for y in lines[i:j])), i, j + 1)
                i = j + 1
                continue
            if _HTML.match(x):
                problems.append("unsupported_markdown_node")
            add("paragraph", _inline("\n".join(y.strip() for y in lines[i:j])), i, j)
            i = j
    return blocks, problems


def _words(s: str) -> list[str]:
    return re.findall(r"\w+", s.lower())


def _cosine(a: Counter, b: Counter) -> float:
    x, y = sum(v * v for v in a.values()), sum(v * v for v in b.values())
    return min(1.0, max(0.0, sum(v * b[k] for k, v in a.items()) / (x * y) ** 0.5)) if x and y else 0.0


def lexical_gaps(texts: list[str], policy: dict = SEGMENT, counted: set[int] | None = None) -> list[tuple[int, float, float]]:
    """(gap before block i, similarity, depth) for every gap between consecutive texts, or those counted.

    Both sides are up to `window` blocks, compared by words, or by character trigrams if either is sparse;
    the peaks are the greatest similarities up to and from the gap, itself included.
    """
    sims, at = [], [i for i in range(1, len(texts)) if counted is None or i in counted]
    for i in at:
        left, right = " ".join(texts[max(0, i - policy["window"]) : i]), " ".join(texts[i : i + policy["window"]])
        a, b = _words(left), _words(right)
        if min(len(a), len(b)) < policy["sparse_words"]:
            grams = lambda s: [s[k : k + 3] for k in range(max(1, len(s) - 2))] if s else []
            a, b = grams("".join(left.lower().split())), grams("".join(right.lower().split()))
        sims.append(_cosine(Counter(a), Counter(b)))
    before, after = list(accumulate(sims, max)), list(accumulate(reversed(sims), max))[::-1]
    return [(i, s, (x + y - 2 * s) / 2) for i, s, x, y in zip(at, sims, before, after, strict=True)]


def lexical_boundaries(texts: list[str], tokens: list[int], policy: dict = SEGMENT, prose: list[bool] | None = None) -> list[int]:
    """Gaps whose depth passes the median by a MAD, in order, where both sides are long enough: from the last one taken, and to the end.

    prose tells the blocks that are compared; others are skipped, and a gap counts only between two that adjoin.
    """
    places = [i for i in range(len(texts)) if prose is None or prose[i]]
    adjoin = {k for k in range(1, len(places)) if places[k] == places[k - 1] + 1}
    gaps = [(places[k], depth) for k, _, depth in lexical_gaps([texts[i] for i in places], policy, adjoin)]
    if len(gaps) < policy["least_gaps"]:
        return []
    depths = [x for _, x in gaps]
    mid = median(depths)
    mad = median([abs(x - mid) for x in depths])
    least = mid + policy["mad"] * mad if mad > 0 else policy["flat_depth"]
    out, last, upto = [], 0, [0, *accumulate(tokens)]
    for at, depth in gaps:
        if depth >= least and upto[at] - upto[last] >= policy["least"] and upto[-1] - upto[at] >= policy["least"]:
            out.append(at)
            last = at
    return out


def size_plan(tokens: list[int], policy: dict = SEGMENT) -> list[tuple[int, int]]:
    """Ranges of blocks: flushed at the target or before the most; an oversized block is alone; a short tail joins the one before."""
    out: list[tuple[int, int]] = []
    a, total = 0, 0
    for i, t in enumerate(tokens):
        if i > a and (total + t > policy["most"] or total >= policy["target"]):
            out.append((a, i))
            a, total = i, 0
        total += t
    if tokens:
        out.append((a, len(tokens)))
    if len(out) > 1 and sum(tokens[out[-1][0] :]) < policy["least"] and sum(tokens[out[-2][0] :]) <= policy["most"]:
        out[-2:] = [(out[-2][0], out[-1][1])]
    return out


def units(blocks: list[dict], policy: dict = SEGMENT) -> list[dict]:
    """Sections by heading, split where they are too long: kind, title, first and past block, boundary."""
    owners: list[tuple[int, int]] = []
    for i, b in enumerate(blocks):
        if b["kind"] == "heading" or not owners:
            owners.append((i, i + 1))
        else:
            owners[-1] = (owners[-1][0], i + 1)
    out = []
    for a, z in owners:
        tokens = [T.estimate(b["text"]) for b in blocks[a:z]]
        headed = blocks[a]["kind"] == "heading"
        title = blocks[a]["text"] if headed else None
        if sum(tokens) <= policy["most"]:
            out.append({"kind": "section" if headed else "segment", "title": title, "first": a, "past": z, "boundary": "heading" if headed else "root"})
            continue
        cut = lexical_boundaries([b["text"] for b in blocks[a:z]], tokens, policy, [b["kind"] in PROSE for b in blocks[a:z]])
        for x, y in zip([0, *cut], [*cut, z - a], strict=True):
            plans = size_plan(tokens[x:y], policy) if sum(tokens[x:y]) > policy["most"] else [(0, y - x)]
            for p, q in plans:
                out.append({"kind": "segment", "title": title, "first": a + x + p, "past": a + x + q, "boundary": "size" if len(plans) > 1 else "lexical"})
    return out


def _header(block: dict, policy: dict) -> tuple[int, int]:
    """(end, tokens) of the first row of a table that is short enough to stand over each of its parts; zeros if there is none."""
    end = block["text"].find("\n") + 1 if block["kind"] == "table" else 0
    tokens = T.estimate(block["text"][:end])
    return (end, tokens) if 0 < tokens <= policy["header"] else (0, 0)


def _pieces(block: dict, policy: dict) -> list[tuple[int, int, str]]:
    """(start, end, how) of the parts of an oversized block: rows or lines, sentences, then windows. Parts of a table leave room for its header."""
    text, spare = block["text"], _header(block, policy)[1]
    pattern, how = (r"[^\n]*\n|[^\n]+", "lines") if block["kind"] in ("table", "code") else (r"[^.!?。！？]*[.!?。！？]\s*|[^.!?。！？]+", "sentences")
    spans = []
    for m in re.finditer(pattern, text):
        if not m[0]:
            continue
        if T.estimate(m[0]) <= policy["most"]:
            spans.append((m.start(), m.end(), how))
        else:
            spans += [(m.start() + a, m.start() + z, "window") for a, z in T.windows(m[0], policy["target"], policy["most"])]
    out: list[tuple[int, int, str]] = []
    total = 0
    for a, z, h in spans:
        t = T.estimate(text[a:z])
        if out and total < policy["target"] and total + t + (spare if len(out) > 1 else 0) <= policy["most"] and out[-1][2] == h:
            out[-1] = (out[-1][0], z, h)
            total += t
        else:
            out.append((a, z, h))
            total = t
    return out


def chunks(blocks: list[dict], first: int, past: int, policy: dict = CHUNK) -> list[dict]:
    """Chunks of one unit: slices (block, start, end), text, tokens, split, and overlap taken from the chunk before."""
    plans: list[tuple[list[tuple[int, int, int]], str]] = []
    held: list[tuple[int, int, int]] = []
    total = 0

    def flush() -> None:
        nonlocal held, total
        if held:
            plans.append((held, "blocks"))
        held, total = [], 0

    for i in range(first, past):
        b = blocks[i]
        t = T.estimate(b["text"])
        if not t:
            continue
        if t > policy["most"]:
            flush()
            head, spare = _header(b, policy)
            for a, z, how in _pieces(b, policy):
                again = 0 < head <= a and how == "lines" and spare + T.estimate(b["text"][a:z]) <= policy["most"]
                plans.append(([(i, 0, head), (i, a, z)] if again else [(i, a, z)], "table_rows" if again else how))
            continue
        if held and (total >= policy["target"] or total + t > policy["most"]):
            flush()
        held.append((i, 0, len(b["text"])))
        total += t
    flush()
    out: list[dict] = []
    for slices, how in plans:
        size = sum(T.estimate(blocks[i]["text"][a:z]) for i, a, z in slices)
        extra: list[tuple[int, int, int]] = []
        if out and how == "blocks":
            taken = 0
            for s in reversed(out[-1]["slices"]):
                t = T.estimate(blocks[s[0]]["text"][s[1] : s[2]])
                if (s[1], s[2]) != (0, len(blocks[s[0]]["text"])) or s in slices or taken + t > policy["overlap"] or size + taken + t > policy["most"]:
                    break
                extra.insert(0, s)
                taken += t
        whole = [*extra, *slices]
        text = ("" if how == "table_rows" else "\n\n").join(blocks[i]["text"][a:z] for i, a, z in whole)
        out.append({"slices": whole, "overlap": len(extra) + (how == "table_rows"), "text": text, "tokens": sum(T.estimate(blocks[i]["text"][a:z]) for i, a, z in whole), "split": how})
    return out


_BLOCK = "doc_id long, ord int, kind string, level int, ordered boolean, language string, section array<string>, text string, start int, end int"
_UNIT = "doc_id long, unit int, kind string, title string, boundary string, first int, past int, tokens long"
_CHUNK = "doc_id long, unit int, ordinal int, text string, tokens long, split string, overlap int, slices array<struct<block:int,start:int,end:int>>"


def _kind(t: str) -> pa.DataType:
    return {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}.get(t) or pa.list_(pa.struct([("block", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def _over(docs: DataFrame, schema: str, rows) -> DataFrame:
    """rows(doc_id, text) for each document, as a table of bounded batches."""
    names = [f.split(" ")[0] for f in re.split(r", (?![^<]*>)", schema)]
    kinds = [_kind(f.split(" ", 1)[1]) for f in re.split(r", (?![^<]*>)", schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tabled((r for batch in batches for d, t in zip(*batch.columns, strict=True) for r in rows(d.as_py(), t.as_py() or "")), pa.schema(list(zip(names, kinds, strict=True))))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _rows(source: str, chunked: bool = True) -> tuple[list[dict], list[dict], list[dict]]:
    """The blocks, units and chunks (if wanted) of one text."""
    blocks, _ = parse(source)
    own = units(blocks)
    for i, u in enumerate(own):
        u |= {"unit": i, "tokens": sum(T.estimate(b["text"]) for b in blocks[u["first"] : u["past"]])}
    return blocks, own, [c | {"unit": i, "ordinal": k} for i, u in enumerate(own if chunked else ()) for k, c in enumerate(chunks(blocks, u["first"], u["past"]))]


def block_table(docs: DataFrame) -> DataFrame:
    return _over(docs, _BLOCK, lambda d, t: [(d, i, b["kind"], b["level"], b["ordered"], b["language"], b["section"], b["text"], b["start"], b["end"]) for i, b in enumerate(parse(t)[0])])


def diagnostic_table(docs: DataFrame) -> DataFrame:
    """doc_id, problem, n; a document with any is only partly indexed."""
    return _over(docs, "doc_id long, problem string, n long", lambda d, t: [(d, k, n) for k, n in sorted(Counter(parse(t)[1]).items())])


def unit_table(docs: DataFrame) -> DataFrame:
    return _over(docs, _UNIT, lambda d, t: [(d, u["unit"], *(u[k] for k in ("kind", "title", "boundary", "first", "past", "tokens"))) for u in _rows(t, False)[1]])


def chunk_table(docs: DataFrame) -> DataFrame:
    slices = lambda c: [{"block": b, "start": x, "end": y} for b, x, y in c["slices"]]
    return _over(docs, _CHUNK, lambda d, t: [(d, *(c[k] for k in ("unit", "ordinal", "text", "tokens", "split", "overlap")), slices(c)) for c in _rows(t)[2]])


def problems_of(source: str, blocks: list[dict], own: list[dict], chunk_rows: list[dict], policy: dict = CHUNK) -> set[str]:
    """The problems of one text's blocks, units and chunks: what block_violations, unit_violations, chunk_violations and uncovered find in tables."""
    out, end, at = set(), 0, 0
    for i, b in enumerate(blocks):
        if i and b["start"] < end:
            out.add("overlap")
        if b["start"] > end and T.token_list(source[end : b["start"]]):
            out.add("uncovered")
        end = b["end"]
        if (b["kind"] == "heading" and not 1 <= b["level"] <= 6) or (b["kind"] != "code" and b["language"] is not None):
            out.add("structure")
    for u in own:
        if u["first"] != at:
            out.add("ownership")
        at = u["past"]
    spans: dict[int, list[tuple[int, int]]] = {}
    for c in chunk_rows:
        if c["tokens"] > policy["most"]:
            out.add("tokens")
        for i, x, y in c["slices"]:
            spans.setdefault(i, []).append((x, y))
    for i, b in enumerate(blocks):
        upto = 0
        for x, y in sorted(spans.get(i, ())):
            if x > upto:
                break
            upto = max(upto, y)
        if upto < len(b["text"]) and T.estimate(b["text"]) > 0:
            out.add("coverage")
    return out


def violations(docs: DataFrame) -> DataFrame:
    """doc_id and problem of all structure checks, made where the document is parsed: nothing moves."""
    return _over(docs, "doc_id long, problem string", lambda d, t: [(d, p) for p in sorted(problems_of(t, *_rows(t)))])


def linked(chunk_rows: DataFrame) -> DataFrame:
    """chunk_rows with digest and the neighbours of each chunk in its unit."""
    w = Window.partitionBy("doc_id", "unit").orderBy("ordinal")
    return chunk_rows.withColumn("digest", T.digest(F.col("text"))).withColumn("previous", F.lag("ordinal").over(w)).withColumn("next", F.lead("ordinal").over(w))


def _chosen(terms: list[str], most: int) -> list[str]:
    """The commonest allowed terms of a list in order of place, then the first to occur, sorted."""
    n = {t: k for t, k in Counter(terms).items() if len(t) <= 64 and (len(t) >= 2 or unicodedata.category(t)[0] == "N")}
    return sorted(nsmallest(most, n, key=lambda t: -n[t]))  # a Counter keeps the order of first places, and so does nsmallest of equals


def keywords(blocks: DataFrame, key: str = "doc_id", most: int = KEYWORDS) -> DataFrame:
    """key and its sorted keywords: of eligible blocks, the commonest terms, then the first to occur, then by term. blocks: key, ord, kind, text.

    Texts move once, to where all of a key are; their terms are counted there. Of equal places (blocks of one key and ord) the terms go by the blocks' texts.
    """
    rows = blocks.where(F.col("kind").isin(*KEYWORD_KINDS) & F.col(key).isNotNull()).select(key, "ord", "text")
    schema = StructType([rows.schema[key], StructField("keywords", ArrayType(StringType()))])

    def run(k, batches: list[pa.RecordBatch]) -> Iterator[tuple]:
        found = _chosen([t for b in batches for x in b.column(2).to_pylist() for t in T.term_list(x)], most)
        if found:
            yield k, found

    return by_key(rows, schema, run, ["ord", "text"])


def uncovered(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """Stretches of source text between blocks that are not blank: doc_id, from, to."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    gaps = blocks.select("doc_id", F.coalesce(F.lag("end").over(w), F.lit(0)).alias("from"), F.col("start").alias("to"))
    return gaps.where(F.col("to") > F.col("from")).join(docs.select("doc_id", "text"), "doc_id").where(F.trim(F.regexp_replace(F.substr("text", F.col("from") + 1, F.col("to") - F.col("from")), T.SPACE + "+", " ")) != "").select("doc_id", "from", "to")


def block_violations(blocks: DataFrame) -> DataFrame:
    """doc_id and problem: order not contiguous, overlapping spans, a structure that its kind does not have."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    late = blocks.withColumn("_e", F.lag("end").over(w)).where(F.col("start") < F.col("_e")).select("doc_id", F.lit("overlap").alias("problem"))
    order = blocks.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("ord").alias("k"), F.max("ord").alias("m")).where("n <> k OR m <> n - 1").select("doc_id", F.lit("order").alias("problem"))
    odd = blocks.where(((F.col("kind") == "heading") & ~F.col("level").between(1, 6)) | ((F.col("kind") != "code") & F.col("language").isNotNull())).select("doc_id", F.lit("structure").alias("problem"))
    return late.unionByName(order).unionByName(odd).distinct()


def chunk_violations(chunk_rows: DataFrame, blocks: DataFrame, policy: dict = CHUNK) -> DataFrame:
    """doc_id and problem: too many tokens, too much overlap, or a searchable block that no chunk covers whole (gaps and islands over its slices)."""
    big = chunk_rows.where(F.col("tokens") > policy["most"]).select("doc_id", F.lit("tokens").alias("problem"))
    s = chunk_rows.select("doc_id", F.explode("slices").alias("s")).select("doc_id", F.col("s.block").alias("ord"), F.col("s.start").alias("a"), F.col("s.end").alias("z"))
    w = Window.partitionBy("doc_id", "ord").orderBy("a", "z").rowsBetween(Window.unboundedPreceding, -1)
    c = s.withColumn("_to", F.coalesce(F.max("z").over(w), F.lit(0))).groupBy("doc_id", "ord").agg(F.max(F.when(F.col("a") > F.col("_to"), 1).otherwise(0)).alias("gap"), F.max("z").alias("z"))
    want = blocks.where(T.token_estimate(F.col("text")) > 0).select("doc_id", "ord", F.length("text").alias("n"))
    own = want["doc_id"].eqNullSafe(c["doc_id"]) & (want["ord"] == c["ord"])
    short = want.join(c.select("doc_id", "ord", "gap", "z"), own, "left").select(want["doc_id"], "n", "gap", "z").where(F.col("z").isNull() | (F.col("gap") > 0) | (F.col("z") < F.col("n"))).select("doc_id", F.lit("coverage").alias("problem"))
    return big.unionByName(short).distinct()


def unit_violations(unit_rows: DataFrame) -> DataFrame:
    """doc_id and problem: units that do not follow each other without gaps."""
    w = Window.partitionBy("doc_id").orderBy("unit")
    return unit_rows.withColumn("_p", F.coalesce(F.lag("past").over(w), F.lit(0))).where(F.col("first") != F.col("_p")).select("doc_id", F.lit("ownership").alias("problem")).distinct()
