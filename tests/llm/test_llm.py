"""The operators of the subpackage against brute force, exact round trips or held-out accuracy, with nulls, ties, repeats and empty tables."""

import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import values
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lexspan.llm import _spark, _text, _tokens, components, decontaminate, jaccard_join, langid, license_scan, packing, quality, queries, token_counts, token_store, topk, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n", "one", "Ünï cödé 漢字  x", "a  b\r\n\tc", "don't we'll 'tis", "x" * 70_000, "<|endoftext|>", "1 2 3,4"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, data, name):
    assert values(queries.queries()[name](spark, data).toPandas()) == values(duck.execute(queries.oracle_sql()[name]).df())


# --- kernels


def test_word_kernel_is_the_regex():
    texts = [*ODD, "Hello, wörld_2 -- ok", "tail ", "\x0b\x0ca\x1cb"]
    buf, start = _text.join(pa.array(texts, pa.string()))
    for inside, pattern in ((_text.alnum, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (_text.spaced, r"[^\x20\x09-\x0D]+")):
        a, z, h = _text.all_words(buf, inside)
        first = np.searchsorted(a, start)
        got = [[_text.lower(buf[x:y]).tobytes().decode() for x, y in zip(a[p:q], z[p:q], strict=True)] for p, q in zip(first[:-1], first[1:], strict=True)]
        assert got == [re.findall(pattern, lower(t)) for t in texts]
        small = [np.concatenate(x) for x in zip(*_text.words(buf, inside, 64), strict=True)]
        assert (small[2] == h).all() and (small[0] == a).all()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokens_are_the_library_s(name, spark, data):
    file = _tokens.path(name)
    texts = [*ODD, "é ≠ a≠ x", "İstanbul ΣΑΣ Σ", "a\x85 d", *[r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(80).collect()]]
    ids, off = _tokens.encode(file, pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == _tokens.tokenizer(file).encode(t or "", add_special_tokens=False).ids


ADDED = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "x<|startoftext|>.y  <|endoftext|>\n z", "<|ENDOFTEXT|> <|endoftext|", "é<|endoftext|>\u0338 's", "w " * 400 + "<|endoftext|>'s " + "v, " * 400]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_added_tokens_are_the_library_s(name):
    from tokenizers import Tokenizer

    file = _tokens.path(name)
    fresh = Tokenizer.from_file(file)
    ids, off = _tokens.encode(file, pa.array([*ADDED, *ODD], pa.string()))
    for i, t in enumerate([*ADDED, *ODD]):
        want = fresh.encode(t or "", add_special_tokens=False).ids
        assert ids[off[i] : off[i + 1]].tolist() == want
        assert sum(token_counts.pieces(file, (t or "").encode())[1]) == len(want)
    assert off[1] == {"word_bpe_49k.json": 3, "byte_bpe_50k.json": 4}[name]
    random.seed(5)
    bits = ["<|endof", "text", "|>", "<|endoftext|>", "<|startoftext|>", "-", " ", "a", "<", "|", "é", ", now"]
    for _ in range(150):
        b = "".join(random.choices(bits, k=random.choice([6, 300]))).encode()
        tree = token_counts.Tree(b, *token_counts.pieces(file, b))
        for _ in range(15):
            a, n, new = random.randint(0, len(b)), random.choice([0, 0, 1, 3, 9]), "".join(random.choices(bits, k=random.randint(0, 2))).encode()
            tree.edit(file, a, n, new)
            x, y = min(a, len(b)), min(a + n, len(b))
            while 0 < x < len(b) and b[x] & 0xC0 == 0x80:
                x -= 1
            while y < len(b) and b[y] & 0xC0 == 0x80:
                y += 1
            b = b[:x] + new + b[y:] if x < y or new else b
            assert tree.text == b and tree.total == len(fresh.encode(b.decode(), add_special_tokens=False).ids)


# --- 1 decontamination


def windows_of(text, n=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return w, n


def test_decontamination(spark):
    words = [f"w{i}" for i in range(60)]
    items = [(1, " ".join(words[:30])), (2, "Short one here"), (3, None), (None, " ".join(words[40:52])), (1, " ".join(words[:30]))]
    texts = ["x " + " ".join(words[5:18]).upper() + " y", "a short ONE, here!", " ".join(words[40:51]), "nothing", None, "", " ".join(words[:9])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (250_000, 5):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.scan(docs(spark, texts), bench, most=most).collect()}
        assert got == {0: (15, 13, 1, True), 1: (4, 3, 1, True), 2: (11, 11, 0, True), 3: (1, 0, 0, False), 4: (0, 0, 0, False), 5: (0, 0, 0, False), 6: (9, 0, 0, False)}
    assert {r.doc_id for r in decontaminate.remove(docs(spark, texts), bench).collect()} == {3, 4, 5, 6}
    cut = {r.doc_id: r.text for r in decontaminate.remove(docs(spark, texts), bench, "spans").collect()}
    assert cut[0] == "x  y" and cut[3] == "nothing" and cut[4] is None
    assert decontaminate.scan(docs(spark, texts), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.scan(docs(spark, []), bench).count() == 0


def test_rows_are_decontaminated_one_by_one(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    bench = spark.createDataFrame([(1, " ".join(words[:30])), (2, " ".join(words[40:52]))], "item_id long, text string")
    rows = [(None, "x " + " ".join(words[5:18])), (None, "clean"), (7, " ".join(words[40:51])), (7, "also clean"), (7, "a b c d e f " + " ".join(words[:12]) + " z"), (8, None)]
    df = spark.createDataFrame([(i, t, "en", str(k), k) for k, (i, t) in enumerate(rows)], DOCS)
    for most in (250_000, 5):
        monkeypatch.setattr(decontaminate, "MOST_WINDOWS", most)
        out = decontaminate.remove(df, bench)
        assert out.columns == df.columns and sorted(r.n_chars for r in out.collect()) == [1, 3, 5]
        cut = {r.n_chars: (r.doc_id, r.text, r.source) for r in decontaminate.remove(df, bench, "spans").collect()}
        assert cut == {0: (None, "x ", "0"), 1: (None, "clean", "1"), 2: (7, "", "2"), 3: (7, "also clean", "3"), 4: (7, "a b c d e f  z", "4"), 5: (8, None, "5")}


# --- 2 license scans


def test_license_scan(spark):
    random.seed(2)
    filler = lambda n: " ".join("".join(random.choices("abcdefgh", k=5)) for _ in range(n))
    texts, want = [], []
    for name, t in license_scan.TEMPLATES.items():
        for before in (0, 3, 50, 333):
            texts.append(f"{filler(before)} {t.upper()}. {filler(40)}")
            want.append(name)
    texts += [None, "", filler(500), "the mit license released under"]
    got = [r.licenses for r in license_scan.scan(docs(spark, texts), "doc_id").orderBy("doc_id").collect()]
    assert all(w in {x.license for x in g} for w, g in zip(want, got, strict=False)) and [len(g) for g in got[-4:]] == [0, 0, 0, 0]
    edited = license_scan.TEMPLATES["GPL-3.0-header"].replace("modify it", "change it")
    hit = license_scan.scan(docs(spark, [filler(9) + " " + edited]), "doc_id").first().licenses
    assert [(x.license, x.share < 1) for x in hit] == [("GPL-3.0-header", True)]


def _word_hashes(texts):
    buf, start = _text.join(pa.array(texts, pa.string()))
    a, _, h = _text.all_words(buf, _text.alnum)
    first = np.searchsorted(a, start)
    return h, first[:-1], np.diff(first)


def test_license_windows_against_full_containment():
    """Edited templates amid other text: every template of which 0.8 is there is found, whatever stands around the text."""
    random.seed(12)
    filler = lambda n: ["".join(random.choices("abcdefgh", k=5)) for _ in range(n)]
    texts = []
    for name in sorted(license_scan.TEMPLATES) * 8:
        words = license_scan.TEMPLATES[name].split()
        for i in random.sample(range(len(words)), random.randint(0, len(words) // 40)):
            words[i] = random.choice(["", "changed", words[i] + " indeed"])
        texts.append(" ".join([*filler(random.choice([0, 0, 5, 200])), *words, *filler(random.choice([0, 0, 5, 200]))]))
    index = license_scan.Index(license_scan.TEMPLATES)
    got = {(d, name) for d, name, share, *_ in index.find(*_word_hashes(texts)) if share >= 0.8}
    want = set()
    for d, t in enumerate(texts):
        h, _, _ = _word_hashes([t])
        for (k, _), own in index.groups.items():
            held = _text.window_hashes(h, k)
            want |= {(d, name) for name, s in own if np.isin(s, held).mean() >= 0.8}
    assert got <= want and len(got) >= 0.99 * len(want) > 200
    alone = {(d, name) for d, t in enumerate(texts) for _, name, share, *_ in index.find(*_word_hashes([t])) if share >= 0.8}
    assert alone == got


def test_license_index_is_small_where_it_is_sent():
    index = license_scan.Index(license_scan.TEMPLATES)
    sent = cloudpickle.dumps(license_scan._scan(index, license_scan.SHARE))
    assert len(sent) < 1 << 20  # larger functions are written to the disk of the driver and of every executor
    again = cloudpickle.loads(cloudpickle.dumps(index))
    assert again.keys.keys() == index.keys.keys() and all(np.array_equal(x, y) for k in index.keys for x, y in zip(index.keys[k], again.keys[k], strict=True))


def test_license_scan_with_odd_rows(spark, tmp_path):
    text = license_scan.TEMPLATES["MIT"]
    (tmp_path / "House").write_text("one two three four five six seven eight nine ten")
    df = spark.createDataFrame([(1, text, 5), (1, text, 5), (None, None, None), (2, "", 0), (3, "x " * 200_000 + text, 1)], "doc_id long, text string, licenses_ long")
    got = license_scan.scan(df, "doc_id", "licenses_").collect()
    assert [[x.license for x in r.licenses] for r in sorted(got, key=lambda r: r.doc_id or 0)] == [[], ["MIT"], ["MIT"], [], ["MIT"]]
    assert license_scan.scan(df.limit(0), "doc_id").count() == 0
    own = license_scan.scan(docs(spark, ["see one two three four five six seven eight nine ten"]), "doc_id", templates=license_scan.templates_in(str(tmp_path))).first()
    assert [x.license for x in own.licenses] == ["House"]


# --- 3 top-k


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(700, 12)).astype(np.float32)
    m[100:400] = m[7]  # one very common vector: ties go by id
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(800, None), (801, [float("nan")] * 12), (802, [None] * 12), (803, [float("inf")] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.search(df.repartition(5), lambda i: i % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = np.floor(256 * m.astype(float)).astype(np.int64)
    for i in range(0, 700, 50):
        s = q @ q[i]
        best = sorted((-int(s[j]), j) for j in range(700) if j != i)[:5]
        assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert len(got) == 14
    assert topk.search(df.limit(0), lambda i: i % 50 == 0).count() == 0
    assert topk.search(df.where("vec_id < 3"), lambda i: i % 50 == 0).count() == 2


def test_topk_prunes_blocks_of_clustered_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    x = np.repeat(centres, 100, axis=0) + 0.05 * rng.standard_normal((4000, 16))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "BLOCK", 64)
    seen = topk.Report()
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(df, lambda i: i % 50 == 0, report=seen).collect()}
    v = np.floor(256 * x).astype(np.int64)
    for q in range(0, 4000, 50):
        s = v @ v[q]
        order = [i for i in np.lexsort((np.arange(4000), -s)).tolist() if i != q][:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, s[i]) for i in order]
    assert seen.pruned > 0.5


# --- 4 token files


@pytest.mark.parametrize("bits", [1, 7, 8, 15, 16, 17])
def test_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    sizes = np.array([0, 1, 5, 70, 300])
    ids = rng.integers(0, 1 << bits, sizes.sum()).astype(np.uint32)
    first = np.concatenate(([0], np.cumsum(sizes)))
    f = token_store.TokenFile(token_store.encode_file([3, None, 5, 6, 7], first, ids, bits, block=64))
    assert f.doc_ids == [3, None, 5, 6, 7]
    for i in range(5):
        assert (f.document(i) == ids[first[i] : first[i + 1]]).all()


def test_token_files(spark):
    file = _tokens.path("word_bpe_49k.json")
    df = docs(spark, ODD).unionByName(docs(spark, ["dup"]))
    files = token_store.write(df.repartition(3), file, _spark.new_folder(spark, "t"), 1)
    got = token_store.digests(spark, files).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted([0, *range(len(ODD))]) and got[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    ids = [*_tokens.tokenizer(file).encode(ODD[4], add_special_tokens=False).ids, 1]
    assert next(r for r in got if r.doc_id == 4).ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert token_store.digests(spark, token_store.write(docs(spark, []), file, _spark.new_folder(spark, "t"), 1)).count() == 0


# --- 5 quality


def test_quality_on_held_out(spark, data):
    big = data.replace("sf0.001", "sf0.01")
    got = queries.op5_quality(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert ((held.score >= 0.3) == (held.quality == 1)).mean() > 0.93 and got.score.between(0, 1).all()


def test_quality_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs(spark, ODD), none)
    assert [round(r.score, 6) for r in quality.score(docs(spark, ODD), model, "doc_id").collect()] == [0.5] * len(ODD)
    odd = docs(spark, ODD).withColumn("_stats", F.lit(1)).withColumn("score", F.lit(2))
    assert quality.accepted(odd, model).columns == odd.columns and quality.accepted(odd, model).count() == len(ODD)
    rule = ((0, True, 1.0), (1, False, 2.0))
    x = np.array([[0.0, 3.0], [0.0, 2.0], [2.0, 3.0]])
    assert quality.holds(rule, x).tolist() == [True, False, False]


# --- 6 near duplicates


def components_by_force(rows, n=5):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: (len(sets[d]), top(d)) for d in sets}


@pytest.mark.parametrize("hot", [32, 3])
def test_near_duplicates(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    if hot == 3:
        monkeypatch.setattr(jaccard_join, "PIVOTS", 1)
        monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    random.seed(3)
    word = lambda: "".join(random.choices("abcdefg", k=4))
    texts = []
    for _ in range(3):
        base = [word() for _ in range(60)]
        for _ in range(20):
            b = list(base)
            for _ in range(random.choice([0, 0, 1, 2, 3, 4])):
                b[random.randrange(60)] = word()
            texts.append(" ".join(b[: random.choice([60, 60, 52])]))
    common = [word() for _ in range(12)]
    texts += [" ".join(common + [word() for _ in range(random.randint(0, 3))]) for _ in range(30)]
    texts += [None, "", " \n", "one two", "One two", "a b c d e"]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs(spark, texts)).collect()}
    assert got == components_by_force(rows)


def test_one_of_each(spark):
    t = "a b c d e f g h i j"
    df = docs(spark, [t, t, "other words entirely here now", None]).unionByName(docs(spark, [t])).unionByName(spark.createDataFrame([(None, t, None, None, None)], DOCS))
    assert sorted((r.doc_id for r in jaccard_join.one_of_each(df).collect()), key=str) == [0, 2, 3, None]
    assert jaccard_join.near_duplicates(docs(spark, [])).count() == 0


def test_sketch_bound_is_sound():
    rng = np.random.default_rng(0)
    for _ in range(200):
        both = rng.integers(0, 1 << 63, rng.integers(1, 900)).astype(np.uint64)
        x = np.unique(np.concatenate((both, rng.integers(0, 1 << 63, rng.integers(0, 300)).astype(np.uint64))))
        y = np.unique(np.concatenate((both, rng.integers(0, 1 << 63, rng.integers(0, 300)).astype(np.uint64))))
        k = len(np.intersect1d(x, y))
        if 5 * k >= 4 * (len(x) + len(y) - k):
            assert jaccard_join.near_possible(len(x), jaccard_join.sketch(x), len(y), jaccard_join.sketch(y), 4, 5)


def test_one_of_each_moves_no_texts_that_surely_stay(spark):
    rows = [(i, f"text {i // 2 if i < 40 else i} of five words or more") for i in range(400)] + [(7, "another text of the same id"), (None, "no id"), (None, "no id")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = jaccard_join.one_of_each(df)
        found = {(r.doc_id, r.text) for r in got.collect()}
        parts = got._jdf.queryExecution().optimizedPlan().children()
        still = parts.apply(0).toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert parts.size() > 1 and not re.search("Join|Aggregate|Repartition", still)
    groups = {i: i // 2 * 2 if i < 40 else i for i in range(400)}
    assert {i for i, _ in found} == set(groups.values()) | {None} and got.count() == 380 + 2
    ids = spark.createDataFrame([(i,) for i in (1, 3, 7)], "_gone long")
    alone, some = jaccard_join._parted(df, "doc_id", ids)
    assert alone.count() + some.count() == len(rows) and {1, 3, 7} <= {r.doc_id for r in some.collect()} and some.count() < 20
    assert sorted(map(str, alone.unionByName(some).collect())) == sorted(map(str, df.collect()))


def test_settled_tables_leave_no_shuffle_files(spark):
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {x for at in folders for _, _, names in os.walk(at) for x in names if x.startswith("shuffle_")}
    before = files()
    out = _spark.settled(spark.range(1000).repartition(5).groupBy((F.col("id") % 7).alias("k")).count(), "few")
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(_spark.CLEANUP) == "false"
    assert sorted(r["count"] for r in out.collect()) == [142] * 1 + [143] * 6


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(40, 30), (30, 35), (50, 50)], "a long, b long")
    assert {r.id: r.component for r in components.components(links).collect()} == {i: 0 for i in range(21)} | {30: 30, 35: 30, 40: 30}
    assert components.components(links.limit(0)).count() == 0


def jobs(spark, run):
    """(what run gives, the number of Spark jobs that it took)."""
    sc, group = spark.sparkContext, f"counted-{random.random()}"
    sc.setJobGroup(group, "counted")
    try:
        return run(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("held", [1 << 18, 24, 3])
def test_components_by_tasks_and_by_stars(spark, monkeypatch, held):
    """One task holds all links; or only what the first tasks leave, here of links that come twenty times; or never."""
    monkeypatch.setattr(components, "HELD", held)
    random.seed(held)
    pairs = [(random.randrange(-30, 30), random.randrange(-30, 30)) for _ in range(25)] * 20 if held == 24 else [(i, i + 1) for i in range(64)] + [(i, i + 7) for i in range(100, 160)]
    up: dict[int, int] = {}

    def top(x):
        while x in up:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        if a != b:
            up[b] = a
    ids = {x for a, b in pairs if a != b for x in (a, b)}
    got, took = jobs(spark, lambda: components.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert sorted((r.id, r.component) for r in got) == sorted((x, top(x)) for x in ids)
    if held == 1 << 18:  # a chain of 64 takes stars more than five rounds of several jobs
        assert took <= 8


def test_bit_sets_take_no_job_for_each_partition(spark):
    """Of a shuffle: a run with 211 of them took 17 s for one bit set."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesced = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        packed, took = jobs(spark, lambda: jaccard_join._bit_set(spark.range(500).select("id"), 20))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    at = jaccard_join._place(np.arange(500).astype(np.uint64), 20)
    assert np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")).tolist() == sorted(set(at.tolist()))
    assert took <= 30


# --- 7 packing


def test_packing(spark, data):
    file = _tokens.path("byte_bpe_50k.json")
    df = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(docs(spark, ODD).select((-F.col("doc_id") - 1).alias("doc_id"), "text"))
    got = packing.pack(df, file, group=64).toPandas()
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 2048
    for d, g in got.sort_values("piece").groupby("doc_id"):
        assert g.piece.tolist() == list(range(len(g))) and (g.start == g.length.cumsum() - g.length).all() and (g.length[1:] == 2048).all()
    long = max(df.collect(), key=lambda r: len(r.text or ""))
    ids = np.array([*_tokens.tokenizer(file).encode(long.text, add_special_tokens=False).ids, 0], "<u4")
    for r in got[got.doc_id == long.doc_id].itertuples():
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert got.sequence_id.nunique() <= 1.03 * -(-got.length.sum() // 2048) + 4
    assert packing.pack(docs(spark, []), file).count() == 0


def test_groups_trade_what_they_leave_empty(spark):
    rng = np.random.default_rng(2)
    df = docs(spark, ["a " * int(n) for n in rng.integers(20, 900, 800)])
    apart, traded = (packing.pack(df, _tokens.path("byte_bpe_50k.json"), group=100, trades=k).toPandas() for k in (0, 3))
    least = -(-int(apart.length.sum()) // 2048)
    n, m = apart.sequence_id.nunique(), traded.sequence_id.nunique()
    assert m <= least + 1 and m < n
    full = traded.groupby("sequence_id").agg(n=("length", "sum"), last=("offset", "max"))
    assert (full.n <= 2048).all() and len(traded) == len(apart) and traded.doc_id.is_unique


def test_genetic_steps():
    rng = np.random.default_rng(4)
    size = rng.integers(1, 101, 400)
    one, two = packing._start(size, rng.permutation(400), 100), packing._start(size, np.argsort(-size), 100)
    child = packing.cross(size, one, two, 100, rng)
    assert np.bincount(child, size).max() <= 100 and np.bincount(child).min() > 0
    best = packing.evolve(size, 100, 1, [])
    assert best.max() + 1 <= min(one.max(), two.max()) + 1


# --- 8 token counts


def test_token_trees():
    file = _tokens.path("byte_bpe_50k.json")
    count = lambda b: len(_tokens.tokenizer(file).encode(b.decode(), add_special_tokens=False).ids)
    random.seed(1)
    for t in ["", "é ", "  a  b\n\n", "don't stop, now. " * 90, "漢字 text x " * 30]:
        b = t.encode()
        tree = token_counts.Tree(b, *token_counts.pieces(file, b))
        for _ in range(25):
            a, n, new = random.randint(0, len(b) + 3), random.choice([0, 1, 5, 40, 300]), random.choice(["", "x", " ", "é", "'s", "\n\n now", " big " * 90]).encode()
            x = min(a, len(b))
            y = min(x + n, len(b))
            while 0 < x < len(b) and b[x] & 0xC0 == 0x80:
                x -= 1
            while y < len(b) and b[y] & 0xC0 == 0x80:
                y += 1
            tree.edit(file, a, n, new)
            b = b[:x] + new + b[y:]
            assert tree.text == b and tree.total == count(b)


def test_token_counts_of_documents(spark):
    file = _tokens.path("byte_bpe_50k.json")
    edits = F.array(F.struct(F.lit(3).cast("long").alias("at"), F.lit(2).cast("long").alias("remove"), F.lit(" new").alias("insert")), F.lit(None))
    got = token_counts.apply(token_counts.build(docs(spark, ODD).select("doc_id", "text"), file).withColumn("edits", edits), file).collect()
    for r in got:
        enc = lambda t: len(_tokens.tokenizer(file).encode(t or "", add_special_tokens=False).ids)
        assert r.n_before == enc(ODD[r.doc_id]) and r.n_after == enc(r.text)
        assert sum(r["_counts"]) == r.n_after and sum(r["_sizes"]) == r.bytes_after


# --- 9 WARC


def test_warc(spark):
    rows = [(3, "http://a", "same"), (1, None, "same"), (2, "u\r\nx", None), (4, "v", ""), (5, "w", "other é"), (None, "n", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for least, want in ((0, {3: 1, 4: 2, None: 1}), (1, {3: 1, None: 1})):
        files = warc.write(pages.repartition(2), _spark.new_folder(spark, "w"), least)
        got = {r.page_id: r for r in warc.records(warc.read(spark, [f["path"] for f in files])).collect()}
        assert {k: r.refers_to for k, r in got.items() if r.record_type == "revisit"} == want
        assert got[5].payload == "other é" and got[5].payload_bytes == 8 and got[3].payload_digest == warc.payload_digest(b"same")
    assert warc.read(spark, [f["path"] for f in warc.write(pages.limit(0), _spark.new_folder(spark, "w"))]).count() == 0


def test_salvage():
    parts = [warc.member(warc.record("response", i, f"http://a/{i}", f"<p>{i}</p>".encode() * 40)) for i in range(12)]
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    whole = b"".join(parts)
    assert len(warc.salvage(whole)[0]) == 12 and not warc.salvage(whole)[1]
    bad = bytearray(whole)
    bad[at[5] + 60] ^= 0xFF
    records, gaps = warc.salvage(bytes(bad))
    assert len(records) == 11 and [(a, z) for a, z, _ in gaps] == [(at[5], at[6])]
    records, gaps = warc.salvage(whole[: at[3] + 20] + whole[at[4] :])
    assert len(records) == 11 and gaps[0][0] == at[3]
    plain = b"".join(warc.record("response", i, None, b"x" * i) for i in range(5))
    assert len(warc.salvage(plain)[0]) == 5
    records, gaps = warc.salvage(b"junk" + plain)
    assert len(records) == 5 and gaps[0][:2] == (0, 4)


def test_archives_are_read_as_streams(monkeypatch):
    """Records that span windows, members of many records, damage at every kind of place; the window is a few bytes."""
    monkeypatch.setattr(warc.Source, "STEP", 64)
    rec = [warc.record("response" if i % 3 else "revisit", i, f"http://a/{i}", bytes([65 + i % 26]) * (i * 37), refers_to=0) for i in range(30)]
    for data in (b"".join(rec), b"".join(map(warc.member, rec)), warc.member(b"".join(rec)), warc.member(b"".join(rec[:10])) + b"".join(rec[10:20]) + warc.member(b"".join(rec[20:]))):
        records, gaps = warc.salvage(data)
        assert sorted(int(h["warc-page-id"]) for h, _, _ in records) == list(range(30)) and not gaps
    members = [warc.member(r) for r in rec]
    at = np.cumsum([0, *map(len, members)]).tolist()
    bad = bytearray(b"".join(members))
    bad[at[7] + 12] ^= 255
    bad[at[20]] = 0
    records, gaps = warc.salvage(bytes(bad))
    assert [int(h["warc-page-id"]) for h, _, _ in records] == [i for i in range(30) if i not in (7, 20)]
    assert [(a, z) for a, z, _ in gaps] == [(at[7], at[8]), (at[20], at[21])]
    records, gaps = warc.salvage(bytes(bad[: at[29] + 9]))
    assert len(records) == 27 and gaps[-1][:2] == (at[29], at[29] + 9)
    inside = bytearray(b"".join(rec))
    inside[inside.index(b"WARC-Payload-Digest", sum(map(len, rec[:10]))) + 30] ^= 1
    records, gaps = warc.salvage(warc.member(bytes(inside)))
    assert 10 not in {int(h["warc-page-id"]) for h, _, _ in records} and len(records) == 29 and len(gaps) == 1


# --- 10 language


def test_language(spark, data):
    big = data.replace("sf0.001", "sf0.01")
    got = queries.op10_language_id(spark, big).join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    model = langid.fit(spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("x", None)], "text string, lang string"))
    r = {x.doc_id: (x.lang_pred, x.score) for x in langid.predict(docs(spark, [None, "", "123 !?", "und die katze", "the dog"]), model, "doc_id").collect()}
    assert [r[i] for i in range(3)] == [("und", 0.0)] * 3 and r[3][0] == "de" and r[4][0] == "en"
    empty = langid.fit(spark.createDataFrame([], "text string, lang string"))
    assert langid.predict(docs(spark, ["a"]), empty, "doc_id").first().lang_pred == "und"


def test_copies_do_not_shrink_what_languages_are_learnt_from(spark):
    random.seed(6)
    texts = ["".join(random.choices("abcdefgh", k=30)) for _ in range(60)]
    one = lambda x: langid.fit(spark.createDataFrame([(t, "en") for t in x], "text string, lang string"), sample=100)
    assert np.allclose(one(texts + texts[:1] * 3000).probs, one(texts).probs)


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(["▁", "▁a", "a", "b", "ab"])
    p = np.array([[0.1], [0.2], [0.3], [0.05], [0.15], [1e-8]])
    ways = 0.1 * 0.3 * 0.05 + 0.2 * 0.05 + 0.1 * 0.15
    assert langid.forward(["ab"], pieces, p)[0, 0] == pytest.approx(np.log(ways))


def test_long_words_take_the_same_sums():
    random.seed(8)
    pieces = langid.Pieces(["▁", "▁a", "a", "b", "c", "ab", "bca", "▁abc", "cc"])
    p = np.random.default_rng(1).random((10, 3)) / 10
    words = ["".join(random.choices("abcx", k=k)) for k in (33, 33, 40, 41, 64, 90)]
    assert np.allclose(langid.scored(words, pieces, p), langid.forward(words, pieces, p))
    long = langid.scored(["abc" * 3000, "b"], pieces, p)
    assert np.isfinite(long).all() and (long[0] < -5000).all()  # no underflow, and no cut
    n = np.array([2.0, 1, 1, 3, 1, 1])
    one = langid.expect(words, n, pieces, 2)
    langid.SHORT, before = 1000, langid.SHORT
    try:
        assert np.allclose(one, langid.expect(words, n, pieces, 2))
    finally:
        langid.SHORT = before


# --- the pipeline


def test_pipeline_stages_with_odd_rows(spark, data, tmp_path):
    """Null ids and texts, repeated rows, a very long text, columns named like the operators' own, and no rows at all."""
    import corpus_pipeline as c

    at = spark.read.parquet(f"{data}/documents.parquet")
    odd = [(None, t, None, None, None) for t in (None, "", "one word", "x" * 300_000, "a b c " * 30_000)] + [(10**9 + i // 2, t, "en", "s", 1) for i, t in enumerate(["", "", "the same row " * 20, "the same row " * 20])]
    docs_ = at.limit(150).unionByName(spark.createDataFrame(odd, at.schema)).withColumns({k: F.lit(1) for k in ("c0", "_x0", "_cast", "_text", "_spans", "_first", "row", "score", "n", "component_id")})
    for rows in (docs_, docs_.limit(0)):
        seen = _spark.written(rows, "odd")
        for name, stage in c.STAGES:
            out = _spark.written(stage(spark, seen, data), name)
            if name != "packing":
                assert out.columns == rows.columns and out.exceptAll(seen).isEmpty(), name
            else:
                assert out.select("doc_id").distinct().exceptAll(seen.select("doc_id").distinct()).isEmpty()
                assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
            seen = out


def test_pipeline_against_a_plain_version(spark, data):
    import corpus_pipeline as c

    at = spark.read.parquet(f"{data}/documents.parquet")
    seen = at
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, seen, data)
        assert out.columns == at.columns, name
        rows = [(r.doc_id, r.text) for r in seen.collect()]
        kept = {r.doc_id for r in out.collect()}
        if name == "near_duplicates":
            assert kept == {d for d, (_, top) in components_by_force(rows).items() if d == top}
        if name == "decontamination":
            bad = {r.doc_id for r in decontaminate.scan(seen, spark.read.parquet(f"{data}/benchmark.parquet")).where("contaminated").collect()}
            assert kept == {d for d, _ in rows} - bad
        seen = _spark.written(out, name)
    assert {r.doc_id for r in c.STAGES[-1][1](spark, seen, data).collect()} == {r.doc_id for r in seen.collect()}
