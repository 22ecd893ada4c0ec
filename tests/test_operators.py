import math

import pytest
from pyspark.sql import functions as F

from lexspan.operators import assembly, lineage, registry, search, selection, structure as S
from lexspan.sources import files, store
from lexspan.streaming import feed

MD = """# One

Intro *text* with [a link](http://x).

## Two

- item a
- item b
  more

| h1 | h2 |
|----|----|
| a  | b  |

```py
# not a heading
x = 1
```

> quoted
> again

---
<div>html</div>

[ref]: http://x
"""


def test_markdown_blocks():
    blocks, problems = S.parse(MD)
    assert [b["kind"] for b in blocks] == ["heading", "paragraph", "heading", "list_item", "list_item", "table", "code", "quote", "divider", "paragraph"]
    assert blocks[1]["text"] == "Intro text with a link." and blocks[3]["section"] == ["One", "Two"]
    assert blocks[5]["cells"] == [["h1", "h2"], ["a", "b"]] and blocks[6]["language"] == "py"
    assert problems == ["unsupported_markdown_node", "definition_not_indexed"]


def test_units_and_chunks():
    body = "\n\n".join(f"Paragraph {i} " + "word " * 150 for i in range(12))
    blocks, _ = S.parse("# Long\n\n" + body)
    u = S.units(blocks)
    assert u[0]["first"] == 0 and u[-1]["past"] == len(blocks) and all(a["past"] == b["first"] for a, b in zip(u, u[1:], strict=False))
    c = [x for y in u for x in S.chunks(blocks, y["first"], y["past"])]
    assert all(x["tokens"] <= 480 for x in c)
    big, _ = S.parse("start " + "Sentence number one is here. " * 400)
    assert all(x["tokens"] <= 480 for x in S.chunks(big, 0, 1)) and "".join(x["text"] for x in S.chunks(big, 0, 1)) == big[0]["text"]
    assert S.size_plan([300, 400, 100, 1300, 50]) == [(0, 2), (2, 3), (3, 5)] or S.size_plan([300, 400, 100, 1300, 50])[0] == (0, 2)


def test_lexical_boundary_at_a_clear_shift():
    a, b = ["alpha beta gamma delta " * 20] * 4, ["omega sigma kappa tau " * 20] * 4
    texts = a + b
    assert max(S.lexical_gaps(texts), key=lambda g: g[2])[0] == 4
    assert S.lexical_boundaries(texts, [50] * 8) == [3]  # taken in order: the first deep gap that is far enough from the start
    assert S.lexical_boundaries(texts, [1] * 8) == [] and S.lexical_boundaries(texts[:2], [500] * 2) == []


def test_longest_rising():
    assert lineage.longest_rising([]) == set()
    assert lineage.longest_rising([(0, 0), (1, 5), (2, 1), (3, 2)]) == {(0, 0), (2, 1), (3, 2)}


def test_block_lineage(spark):
    cols = "doc_id long, ord int, kind string, section string, text string"
    p = spark.createDataFrame([(1, 0, "p", "", "a b c d e f g h"), (1, 1, "p", "", "same"), (1, 2, "p", "", "old words here"), (1, 3, "p", "", "end")], cols)
    c = spark.createDataFrame([(1, 0, "p", "", "a b c d e f g h i"), (1, 1, "p", "", "same"), (1, 2, "p", "", "wholly other"), (1, 3, "p", "", "end")], cols)
    p, c = (x.withColumn("digest", F.sha2("text", 256)) for x in (p, c))
    m = lineage.match_blocks(p, c)
    assert {(r.previous, r.current, r.how) for r in m.collect()} == {(0, 0, "likely"), (1, 1, "in_place"), (2, 2, "replaced"), (3, 3, "in_place")}
    ch = lineage.block_changes(p, c, m.select("doc_id", "previous", "current"))
    assert {(r.previous, r.change) for r in ch.collect()} == {(0, "modified"), (1, "unchanged"), (2, "modified"), (3, "unchanged")}


@pytest.mark.parametrize(("score", "want"), [(0.85, "admit"), (0.35, "reject"), (0.8499, "defer"), (0.3501, "defer"), (math.nan, "reject"), (math.inf, "reject"), (None, "reject")])
def test_verdict(spark, score, want):
    assert spark.range(1).select(selection.verdict(F.lit(score).cast("double"))).first()[0] == want


def test_lexical_score_boundaries(spark):
    cards = spark.createDataFrame([(1, ["Refund", ""], ["how to refund"], "about money"), (2, [], [], "")], "version_id long, keywords array<string>, questions array<string>, description string")
    q = spark.createDataFrame([(1, "my refunding  case"), (2, "")], "query_id long, text string")
    got = {(r.query_id, r.version_id): (round(r.score, 6), r.signal) for r in selection.lexical_scores(q, cards).collect()}
    assert got[1, 1] == (1.0, "declared_term") and got[1, 2] == (0.0, "none") and got[2, 1] == (0.0, "none")


def test_catalog_is_refused(spark):
    bad = spark.createDataFrame([(1, None, ["retrieval"])], "version_id long, sensitive boolean, allowed_usage array<string>")
    with pytest.raises(ValueError, match="policy"):
        selection.eligible(bad)
    with pytest.raises(ValueError, match="over 1"):
        selection.bounded_catalog(spark.range(2), 1)


def test_plan_refuses_two_definitions(spark):
    a = spark.createDataFrame([(1, 1, 1, "s", "x"), (1, 2, 2, "s", "y")], "query_id long, version_id long, position int, scope_key string, definition string")
    with pytest.raises(Exception, match="two definitions"):
        selection.planned(a).collect()
    assert selection.planned(a.where("version_id = 1")).first().selected_by == [1]


CANDIDATE = "query_id long, target int, item int, rank int, revision long, digest string, units int"


def test_budget_and_repeats(spark):
    rows = [(1, 1, 1, 1, 10, "a", 5000), (1, 1, 1, 2, 11, "b", 3000), (1, 1, 1, 3, 12, "c", 1), (1, 2, 2, 1, 11, "b", 3000), (1, 2, 2, 2, 13, "a", 5000)]
    got = {r.revision: (r.outcome, r.context_rank) for r in assembly.kept(assembly.fused(spark.createDataFrame(rows, CANDIDATE))).collect()}
    assert got == {11: ("kept", 1), 10: ("kept", 2), 13: ("duplicate_content", None), 12: ("budget_exhausted", None)}
    with pytest.raises(ValueError, match="lower"):
        assembly.narrowed(8000, 9000)


def test_quarantine_takes_all_targets_of_a_contradiction(spark):
    rows = [(1, 1, 1, 1, 10, "a", 5), (1, 2, 2, 1, 10, "b", 5), (1, 3, 3, 1, 11, "c", 5)]
    assert {r.target for r in assembly.quarantined(spark.createDataFrame(rows, CANDIDATE)).collect()} == {1, 2}


def test_search_does_not_depend_on_partitions(spark):
    rows = spark.range(300).select("id", F.array(*[F.sin(F.col("id") * k) for k in range(1, 9)]).alias("embedding"), (F.col("id") % 3).alias("scope"))
    q = rows.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    a = {tuple(r) for r in search.top_k(rows.repartition(7), q, 4, same_scope=True).select("query_id", "id", "rank").collect()}
    assert a == {tuple(r) for r in search.top_k(rows.coalesce(1), q, 4, same_scope=True).select("query_id", "id", "rank").collect()} and len(a) == 60


def test_claims(spark):
    p = spark.createDataFrame([(1, 10, None), (1, 11, 10), (1, 12, 11), (1, 13, 10), (2, 20, None)], "source_id long, publication_id long, previous_id long")
    done = spark.createDataFrame([(10,), (11,)], "publication_id long")
    cur = spark.createDataFrame([(1, 11)], "source_id long, cursor long")
    assert {r.publication_id: r.claim for r in registry.claims(p, done, cur).collect()} == {10: "already_claimed", 11: "already_claimed", 12: "next", 13: "fork", 20: "first"}


def test_coverage_of_nothing_is_one(spark):
    assert registry.coverage(spark.createDataFrame([], "scope_id long, state string")).first().coverage == 1.0


def test_feed_step():
    c, n, forked, waiting, out = feed.take(None, 0, False, {}, [(3, 2), (1, None)])
    assert (c, n, forked, waiting) == (1, 1, False, {3: 2}) and out == [(1, "first", 1), (3, "deferred", None)]
    c, n, forked, waiting, out = feed.take(c, n, forked, waiting, [(2, 1), (3, 2)])
    assert (c, n, waiting) == (3, 3, {}) and [x[1] for x in out] == ["next", "next"]
    assert feed.take(3, 3, False, {}, [(4, 3), (5, 3)])[2]


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("﻿é\r\n# x".encode())
    (tmp_path / "b.md").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_text("no")
    got = {r.source_key.rsplit("/", 1)[1]: r for r in files.observe(spark, "markdown", {"path": f"file://{tmp_path}"}).collect()}
    assert set(got) == {"a.md", "b.md"} and got["a.md"].text == "é\n# x" and got["b.md"].problem == "not_utf8"
    known = spark.createDataFrame([(got["a.md"].source_id, got["a.md"].content_digest)], "source_id string, content_digest string")
    assert files.observe(spark, "markdown", {"path": f"file://{tmp_path}"}, known).count() == 1
    with pytest.raises(ValueError, match="secret"):
        files.check_configuration("markdown", {"path": "x", "api_key": "1"})
    assert files.advance("active", "running", "fail") == ("active", "failed")


def test_store_refuses_other_records(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}", "c")
    one = spark.createDataFrame([(1, [1.0])], "record_id long, embedding array<double>")
    assert s.publish("i", "v", one) == "published" and s.publish("i", "v", one) == "already_published"
    with pytest.raises(ValueError, match="other records"):
        s.publish("i", "v", one.withColumn("record_id", F.col("record_id") + 1))
    assert s.current().collect()[0].index_version == "v"


def test_every_label_has_an_index(spark, data, monkeypatch):
    from lexspan.plans import streams
    from lexspan.sources import store

    made = []
    monkeypatch.setattr(store, "Store", lambda *a, real=store.Store: made.append(real(*a)) or made[-1])
    streams.s9_s15_m22_index_store(spark, data)
    want = spark.read.parquet(f"{data}/embeddings.parquet")
    current = made[0].records().join(made[0].current(), ["document_index_id", "index_version"])
    got = sorted((r.document_index_id, r.record_id) for r in current.collect())
    assert got == sorted((f"label-{r.label}", r.vec_id) for r in want.collect())
    assert {r.index_version for r in current.select("index_version").distinct().collect()} == {"v1", "v2"}
