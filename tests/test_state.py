"""State changes, integrity checks, searches and structure on small cases: nulls, ties, repeats, empty tables, and plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspan.functions import identity, text as T
from lexspan.operators import checks, search, selection, state, structure
from lexspan.sources import publish, store
from lexspan.storage import new_folder, shared_dir


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_leases(spark):
    at = F.lit("2024-01-01").cast("timestamp")
    held = rows(spark, [("a", "x", "2024-06-01"), ("b", "x", "2023-06-01")], "version_id string, owner string, e string").select("version_id", "owner", F.col("e").cast("timestamp").alias("expires_at"))
    asked = rows(spark, [("a", "x", 1), ("a", "y", 0), ("b", "y", 2), ("b", "z", 2), ("b", "y", 1), ("c", "z", 1)], "version_id string, owner string, requested_at long")
    got = {(r.version_id, r.owner): r.outcome for r in state.leased(held, asked, at).collect()}
    assert got == {("a", "x"): "renewed", ("a", "y"): "busy", ("b", "y"): "acquired", ("b", "z"): "busy", ("c", "z"): "acquired"}
    assert state.leased(held.limit(0), asked.limit(0), at).count() == 0


def test_outbox_reports(spark):
    box = rows(spark, [(1, "delivering", "x", 0), (2, "delivering", "x", 3), (3, "pending", None, 0)], "publication_id long, state string, owner string, attempts int")
    said = rows(spark, [(1, "x", True), (2, "x", False), (2, "y", True), (3, "x", True), (9, "x", True)], "publication_id long, owner string, delivered boolean")
    got = {(r.publication_id, r.owner): (r.outcome, r.state, r.attempts, r.wait_ms) for r in state.reported(box, said).collect()}
    assert got == {(1, "x"): ("completed", "delivered", 0, None), (2, "x"): ("rescheduled", "pending", 4, 8000), (2, "y"): ("refused", "delivering", 3, None), (3, "x"): ("refused", "pending", 0, None), (9, "x"): ("refused", None, None, None)}


def test_compare_and_set_takes_the_first_that_fits(spark):
    now = rows(spark, [("a", 1)], "key string, value long")
    p = rows(spark, [("a", 0, 5, 1), ("a", 1, 6, 2), ("a", 1, 7, 3), ("b", None, 8, 1), ("b", None, 9, 2)], "key string, expected long, value long, order long")
    assert sorted((r.key, r.value) for r in state.compare_and_set(now, p, "key").where("outcome = 'set'").collect()) == [("a", 6), ("b", 8)]


def test_a_commit_is_seen_whole_or_not(spark):
    c = state.Commits(spark, new_folder(spark, "commits"))
    assert c.read("cards") is None
    assert c.commit("one", cards=spark.range(3), events=spark.range(2)) == "committed"
    spark.range(9).write.parquet(f"{c.root}/commits/commit_id=two/cards")  # a writer that stopped half-way
    assert c.read("cards").count() == 3
    assert c.commit("two", cards=spark.range(4)) == "committed" and c.commit("two", cards=spark.range(7)) == "already_committed"
    assert c.read("cards").count() == 7 and c.read("events").count() == 2


def test_publishing_is_leased_verified_and_recovered(spark):
    at = store.Store(spark, new_folder(spark, "p"), "c")
    one, two, now = publish.Publisher(at, "one"), publish.Publisher(at, "two"), F.lit("2024-01-01").cast("timestamp")
    recs = rows(spark, [("a", "x"), ("b", "y")], "record_id string, body string")
    assert one.publish("i", "v1", recs, now) == "published" and two.publish("i", "v1", recs, now) == "busy"
    assert two.publish("i", "v1", recs, F.lit("2024-01-02").cast("timestamp")) == "already_published"
    assert one.publish("i", "v2", recs.limit(1), now, stop_before_pointer=True) == "staged"
    assert at.current().first().index_version == "v1"
    assert one.recover() == [("i", "v2")] and one.recover() == [] and at.current().first().index_version == "v2"
    assert one.publish("i", "v1", recs, now) == "busy"  # the other's lease runs on
    with pytest.raises(ValueError):
        one.publish("i", "v1", rows(spark, [("a", "z"), ("b", "y")], "record_id string, body string"), F.lit("2024-01-03").cast("timestamp"))


def test_source_states(spark):
    e = rows(spark, [("a", "started", 1), ("a", "inspected", 2), ("a", "started", 3), ("b", "inspected", 1), ("b", "disabled", 2), ("b", "started", 3), ("c", "failed_inspection", 1)], "source_id string, kind string, append_order long")
    got = {r.source_id: (r.inspection, r.execution, r.lifecycle, r.refused) for r in state.source_states(e).collect()}
    assert got == {"a": ("ready", "running", "active", 1), "b": ("ready", "idle", "disabled", 1), "c": ("unavailable", "idle", "active", 0)}


def test_plan_order_of_items_alike_does_not_depend_on_input_order(spark):
    items = [(1, 2, "O", 7, n) for n in (3, 1, 2, None)] + [(1, 2, "F", 9, 5), (1, 1, "O", 9, 6), (2, 2, "O", 7, 4)]
    want = {(1, 6): 1, (1, 5): 2, (1, None): 3, (1, 1): 4, (1, 2): 5, (1, 3): 6, (2, 4): 1}
    for given in (items, items[::-1]):
        df = rows(spark, given, "query_id long, scope_id long, scope_version string, item_key long, n long").coalesce(1)
        assert {(r.query_id, r.n): r.place for r in checks.ordered_plan(df).collect()} == want


def test_checks_on_empty_tables(spark):
    none = rows(spark, [], "query_id long, card long")
    items = rows(spark, [], "query_id long, item_key string, guide string, scope long, limit int, target_key string, selected_by array<long>")
    assert checks.plan_invariants(items, items.select("query_id", "target_key", "scope", "limit"), none, none).count() == 0
    assert checks.catalog_limits(rows(spark, [], "text string, tokens int")).where("exceeded OR value <> 0").count() == 0
    one = rows(spark, [(1, None)], "revision long, x long")
    assert [tuple(r) for r in checks.unpaired(one, one.limit(0)).collect()] == [(1, "no_embedding")]


def test_shared_folder_is_not_local_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "a"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared_dir(Session())
    Context.master = "local[4]"
    assert shared_dir(Session()).startswith("file:")


def test_uuid7(spark):
    got = [r[0] for r in rows(spark, [(1_700_000_000_000, str(i)) for i in range(50)], "ms long, k string").select(identity.uuid7(F.col("ms"), F.col("k"))).collect()]
    import uuid

    assert len(set(got)) == 50 and all(uuid.UUID(x).version == 7 and uuid.UUID(x).variant == uuid.RFC_4122 and int(x[:8] + x[9:13], 16) == 1_700_000_000_000 for x in got)


def test_windows_are_the_longest_prefixes():
    random.seed(5)
    for _ in range(200):
        s = "".join(random.choices("ab1 .,é漢\n\x01_", k=random.randint(0, 60)))
        for target, most in ((1, 1), (3, 5), (0, 2)):
            at, want = 0, []
            while at < len(s):
                for limit in (target, most):
                    end = max((z for z in range(at, len(s) + 1) if T.estimate(s[at:z]) <= limit), default=at)
                    if end > at:
                        break
                end = max(end, at + 1)
                want.append((at, end))
                at = end
            assert T.windows(s, target, most) == want


def test_parts_of_a_table_repeat_its_header(spark):
    table = "| name | value |\n|---|---|\n" + "".join(f"| row{i} word word word word | {i} |\n" for i in range(200))
    docs = rows(spark, [(1, "# Title\n\n" + table), (2, None), (None, "text")], "doc_id long, text string")
    got = structure.chunk_table(docs).where("doc_id = 1").orderBy("unit", "ordinal").collect()
    parts = [r for r in got if r.split == "table_rows"]
    assert len(parts) > 1 and all(r.text.startswith("name | value\n") and r.tokens <= 480 and r.overlap == 1 for r in parts)
    assert structure.violations(docs).count() == 0
    rowsof = [line for r in got for line in r.text.split("\n") if line.startswith("row")]
    assert len(rowsof) == len(set(rowsof)) == 200


def test_structure_checks_find_planted_faults(spark):
    docs = rows(spark, [(1, "# A\n\none two\n\nthree four\n\n```py\nx\n```")], "doc_id long, text string")
    b = structure.block_table(docs)
    assert structure.block_violations(b).count() == 0
    problem = lambda df: {r.problem for r in structure.block_violations(df).collect()}
    assert problem(b.where("ord <> 1")) == {"order"}
    assert problem(b.withColumn("start", F.when(F.col("ord") == 2, 0).otherwise(F.col("start")))) == {"overlap"}
    assert problem(b.withColumn("level", F.when(F.col("kind") == "heading", 9).otherwise(F.col("level")))) == {"structure"}
    c = structure.chunk_table(docs)
    assert {r.problem for r in structure.chunk_violations(c.limit(0), b).collect()} == {"coverage"}
    assert {r.problem for r in structure.chunk_violations(c.withColumn("tokens", F.lit(999)), b).collect()} == {"tokens"}
    u = structure.unit_table(docs)
    assert {r.problem for r in structure.unit_violations(u.withColumn("first", F.col("first") + 1)).collect()} == {"ownership"}
    assert structure.uncovered(b.where("ord <> 1"), docs).count() == 1


def test_lexical_scores_against_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(selection, "CARD_BLOCK", 3)
    random.seed(9)
    word = lambda: "".join(random.choices("abc", k=random.randint(1, 4)))
    cards = [(i, [word() for _ in range(random.randint(0, 3))], [" ".join(word() for _ in range(random.randint(0, 4))) for _ in range(random.randint(0, 3))], " ".join(word() for _ in range(random.randint(0, 6)))) for i in range(11)]
    asked = [(i, " ".join(word() for _ in range(random.randint(0, 5)))) for i in range(17)] + [(17, None), (18, "")]
    grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)}
    like = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    got = {(r.query_id, r.version_id): (r.score, r.signal) for r in selection.lexical_scores(rows(spark, asked, "query_id long, text string"), rows(spark, cards, "version_id long, keywords array<string>, questions array<string>, description string")).collect()}
    assert len(got) == 19 * 11
    for qid, q in asked:
        for vid, terms, questions, about in cards:
            hit = sum(t in (q or "") for t in terms)
            direct = 0.9 + 0.1 * hit / len(terms) if hit else 0.0
            question = max((like(grams(q or ""), grams(x)) for x in questions), default=0.0)
            described = 0.5 * like(grams(q or ""), grams(about))
            signal = "declared_term" if direct else "question" if question and question >= described else "description" if described else "none"
            assert got[qid, vid] == (pytest.approx(max(direct, question, described)), signal)
    assert selection.lexical_scores(rows(spark, asked, "query_id long, text string"), rows(spark, [], "version_id long, keywords array<string>, questions array<string>, description string")).count() == 0


def test_searches_in_blocks_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(search, "ROWS", 7)
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((60, 4)), 1)
    x[20:50] = x[20]  # copies: ties go by id
    data = [(i, v, i % 3 if i % 10 else None) for i, v in enumerate(x.tolist())] + [(100, None, 0), (101, [1.0], 0), (102, [float("nan")] * 4, 0), (None, [1.0] * 4, 0)]
    df = rows(spark, data, "id long, embedding array<double>, scope long")
    asked = df.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    scope = {i: s for i, _, s in data}
    for block in (4096, 2):
        monkeypatch.setattr(search, "BLOCK", block)
        for same in (False, True):
            got = {}
            for r in search.top_k(df, asked, 5, "cosine", same).collect():
                got.setdefault(r.query_id, {})[r["rank"]] = r.id
            for q in (0, 20, 40):
                s = np.round(x @ x[q] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[q]), 12)
                ok = [i for i in range(60) if not same or (scope[i] is not None and scope[i] == scope[q])]
                want = sorted(ok, key=lambda i: (-s[i], i))[:5]
                assert [got.get(q, {}).get(k + 1) for k in range(len(want))] == want
    assert search.top_k(df, asked.limit(0), 5).count() == 0


def test_underlined_headings():
    blocks, _ = structure.parse("Title here\n===\n\ntext\n\nPart\n---\nmore\n\n---\n")
    assert [(b["kind"], b["text"], b["level"], b["section"]) for b in blocks] == [("heading", "Title here", 1, ["Title here"]), ("paragraph", "text", 0, ["Title here"]), ("heading", "Part", 2, ["Title here", "Part"]), ("paragraph", "more", 0, ["Title here", "Part"]), ("divider", "", 0, ["Title here", "Part"])]
