"""Jaccard join, suffix dedup, components, and the pipeline."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_texts import prose
from pyspark.sql import functions as F

from resultfeed.llm import graph, jaccard, repeats
from resultfeed.llm.suffixes import Text, repeated, sort_within

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def table(spark, tmp_path, rows, parts=3):
    path = str(tmp_path / f"t{random.random()}.parquet")
    spark.createDataFrame(rows, DOCS).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


def sets(texts):
    out = []
    for t in texts:
        w = WORD.findall(t or "")
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_links(texts):
    s = sets(texts)
    links, parent = Counter(), list(range(len(s)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) * 10 >= 8 * len(s[i] | s[j]):
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return links, [root(i) for i in range(len(s))]


def near_copies(rng, n, words=150):
    base = prose(rng, words, 3000).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_links_by_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 8)  # many pairs of blocks
    monkeypatch.setattr(jaccard, "PAIRED_BLOCKS", 2)
    monkeypatch.setattr(jaccard, "LINKS_AT_ONCE", 50)
    monkeypatch.setattr(jaccard, "LETTERS_AT_ONCE", 300)
    rng = random.Random(7)
    texts = near_copies(rng, 60) + near_copies(rng, 25) + [prose(rng, 80, 3000) for _ in range(40)]
    texts += [texts[0], texts[0], texts[3] + " \n", "", None, "one two", "one two", " one  two ", "one"]
    rng.shuffle(texts)
    links, root = brute_links(texts)
    got = {r.doc_id: r for r in jaccard.groups(table(spark, tmp_path, list(enumerate(texts)))).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].n_links, got[i].class_id) == (links[i], root[i]), i
        assert got[i].copy_id == (min(j for j, t in enumerate(texts) if t == texts[i]) if WORD.search(texts[i] or "") else i)
    assert sum(r.first for r in got.values()) == len(set(root))


def test_pruning_keeps_what_can_reach_the_threshold():
    for n in range(8, 129, 8):
        m = jaccard.least_equal(n)
        assert m / n < 0.8 and (m == 0 or jaccard.least_equal(n, tolerance=0.5) > m)
    # a pair at the threshold is dropped with a probability of about 1e-6 at most over all steps
    rng = np.random.default_rng(0)
    equal = np.cumsum(rng.random((20000, 128)) < 0.8, axis=1)
    assert not any((equal[:, n - 1] < jaccard.least_equal(n)).any() for n in range(8, 129, 8))


def test_minhash_estimates_similarity():
    rng = random.Random(3)
    a = near_copies(rng, 2, 3000)
    x, y = sets(a)
    data = [t.encode() for t in a]
    code, ends = jaccard.shingles(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
    assert np.diff(ends).tolist() == [len(x), len(y)]
    s = jaccard.signatures(code, ends, 2048)
    assert abs((s[0] == s[1]).mean() - len(x & y) / len(x | y)) < 0.03


def test_jaccard_of_odd_rows(odd, odd_rows, clashing, empty):
    out = jaccard.groups(odd).collect()
    assert len(out) == len(odd_rows)
    six = [r for r in out if r.doc_id in (6, 7) and r.n_links]
    assert len(six) == 4 and all((r.class_id, r.copy_id) == (6, 6) for r in six)
    assert [r.first for r in out if r.doc_id == 6 and not r.n_links] == [True]  # another text with the same id
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.first for r in out)
    assert jaccard.keep_one(clashing).columns == clashing.columns and jaccard.keep_one(clashing).count() == kept.count()
    assert jaccard.groups(empty).count() == 0 and jaccard.keep_one(empty).count() == 0


def test_ids_of_other_types(spark, tmp_path):
    a, b = near_copies(random.Random(3), 1, 400)[0], "some other words " * 30
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([("x", a), ("y", a + " tail"), ("a", b), (None, b), ("q", None)], "doc_id string, text string").write.parquet(path)
    df = spark.read.parquet(path)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.groups(df).collect()}
    assert got == {"x": ("x", 1), "y": ("x", 1), "a": ("a", 1), None: ("a", 1), "q": ("q", 0)}
    assert {r.doc_id for r in jaccard.keep_one(df).collect()} == {"x", "a", "q"}


def test_forest():
    rng = random.Random(2)
    for n in (1, 5, 60):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)]
        parent = list(range(n))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in edges:
            i, j = sorted((root(i), root(j)))
            parent[j] = i
        pairs = ((np.array([i]), np.array([j])) for i, j in edges)
        assert jaccard.forest(n, pairs).tolist() == [root(i) for i in range(n)]


def test_shingles_of_one_text_and_of_many_agree():
    texts = [prose(random.Random(i), n).encode() for i, n in enumerate((1, 4, 5, 6, 300))]
    code, ends = jaccard.shingles(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    for i, t in enumerate(texts):
        alone, _ = jaccard.shingles(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert alone.tolist() == code[ends[i] : ends[i + 1]].tolist()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(50)] + [(5000, i) for i in range(2000, 2400)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in got} and {a for e in edges if e[0] != e[1] for a in e} == set(got)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removed(texts):
    seen, out = set(), []
    for t in texts:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        rest = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) > 0).sum())
        out.append((len(data), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return out


def passages_corpus(seed):
    rng = random.Random(seed)
    shared = [prose(rng, n, 90) for n in (15, 18, 30, 60)] + ["é" * 70, "ab" * 80, "x" * 250]
    line = prose(rng, 12, 90)[:70]
    texts = []
    for i in range(70):
        parts = [prose(rng, rng.randint(0, 40), 90) for _ in range(rng.randint(1, 3))]
        if i % 3 == 0:
            parts.insert(rng.randrange(len(parts) + 1), line)
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            a = rng.randrange(max(1, len(s) - 60))
            parts.insert(rng.randrange(len(parts) + 1), s[a:] if rng.random() < 0.5 else s)
        texts.append("\n".join(parts))
    return texts + [texts[4], texts[4], None, "", "q" * 99, "r" * 100, "r" * 100, "st" * 600, "a" * 2000, "a" * 2000 + "b"]


@pytest.mark.parametrize("seed, few", [(1, False), (2, True)])
def test_removed_by_brute_force(spark, tmp_path, monkeypatch, seed, few):
    if few:  # marked grams, several levels and local passes, short claims, and texts cut into parts
        monkeypatch.setattr(repeats, "FAN", 2)
        monkeypatch.setattr(repeats, "CLAIM_BYTES", 64)
        monkeypatch.setattr(repeats, "MANY_LOCAL", 2)
        monkeypatch.setattr(repeats, "MANY", 4)
        monkeypatch.setattr(repeats, "LOCAL_BYTES", 3000)
        monkeypatch.setattr(repeats, "PART_BYTES", 700)
    texts = passages_corpus(seed)
    want = brute_removed(texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digest(table(spark, tmp_path, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_suffix_sort():
    rng = np.random.default_rng(0)
    for trial in range(20):
        data = rng.integers(97, 99 + trial % 3, 800).astype(np.uint8)
        depth = int(rng.integers(1, 30))
        text, n = Text(data), len(data) - depth + 1
        starts = rng.permutation(n)[: int(rng.integers(1, n))]
        bucket = np.sort(rng.integers(0, 4, len(starts)))
        keys = [(b, data[s : s + depth].tobytes()) for b, s in zip(bucket, starts, strict=True)]
        assert sort_within(text, starts, bucket, depth).tolist() == sorted(range(len(keys)), key=keys.__getitem__)
        seen, want = set(), []
        for k in keys:
            want.append(k in seen)
            seen.add(k)
        assert repeated(text, starts, bucket, depth).tolist() == want


def test_collisions_are_verified(monkeypatch):
    """With hashes that collide at will, bytes decide."""
    data = np.frombuffer(b"abcdabcdabceabcd", np.uint8)
    text = Text(data)
    monkeypatch.setattr(Text, "same", lambda self, a, b, length: np.ones(len(a), bool))
    starts = np.array([0, 4, 8, 12])
    assert repeated(text, starts, np.zeros(4, int), 4).tolist() == [False, True, False, True]


@pytest.mark.parametrize("few", [False, True])
def test_colliding_hashes_remove_nothing(spark, tmp_path, monkeypatch, few):
    """Contents of runs collide at will with the first seed: bytes refute the claims, and the next seed decides."""
    real, tried = repeats.runs_of, []
    monkeypatch.setattr(repeats, "runs_of", lambda data, bounds, seed=1: (lambda r: (*r[:4], r[4] % np.uint64(3) if seed == 1 else r[4], r[5]))(real(data, bounds, seed)))
    attempt = repeats._attempt
    monkeypatch.setattr(repeats, "_attempt", lambda rows, seed: (tried.append(seed), attempt(rows, seed))[1])
    if few:
        monkeypatch.setattr(repeats, "LOCAL_BYTES", 3000)
    texts = passages_corpus(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digest(table(spark, tmp_path, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts) and tried == [1, 2]


def test_equal_ranges(monkeypatch):
    from resultfeed.llm import suffixes

    monkeypatch.setattr(suffixes, "_AT_ONCE", 16)
    data = np.frombuffer(b"abcdeXabcdfXabcdeX", np.uint8)
    assert suffixes.equal_ranges(data, np.array([0, 0, 0, 6]), np.array([6, 12, 6, 12]), np.array([5, 6, 4, 5])).tolist() == [False, True, True, False]


def test_one_very_long_text(spark, tmp_path):
    """Twenty megabytes in one row, half of it a copy of the other half, beside short ones."""
    rng = np.random.default_rng(1)
    half = "".join(map(chr, rng.integers(97, 123, 10_000_000)))
    rows = [(1, "short " * 30), (2, half + half), (3, half[5000:5400] + "!")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.digest(table(spark, tmp_path, rows, 2)).collect()}
    assert got[2] == (20_000_000, 10_000_000, 1) and got[3] == (401, 400, 1) and got[1][0] == 180


def test_dedup_of_odd_rows(odd, odd_rows, clashing, empty):
    out = repeats.digest(odd)
    assert out.count() == len(odd_rows)
    kept = repeats.dedup(odd)
    assert kept.columns == odd.columns
    rows = {r.doc_id: r for r in kept.collect() if r.doc_id is not None}
    assert 7 not in rows and rows[6].text is not None and rows[0].text is None and rows[1].text == "" and rows[10].n_chars == len(rows[10].text)
    assert repeats.dedup(clashing).columns == clashing.columns and repeats.dedup(clashing).count() == kept.count()
    assert repeats.digest(empty).count() == 0 and repeats.dedup(empty).count() == 0


def test_texts_are_cut_between_characters(spark, tmp_path):
    shared = prose(random.Random(1), 40)
    df = table(spark, tmp_path, [(1, "é" + shared + "é"), (2, "è" + shared + "è")])
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: r for r in repeats.dedup(df).collect()}
    assert got[1].text == "é" + shared + "é" and "\ufffd" not in got[2].text and got[2].n_chars == len(got[2].text) < 3


def test_rows_keep_their_numbers_when_splits_change(spark, tmp_path, monkeypatch):
    """After each step the table's files are dealt to partitions anew, as when executors come or go."""
    rng, key = random.Random(4), "spark.sql.files.openCostInBytes"
    texts = near_copies(rng, 30) + [prose(rng, rng.randint(20, 200), 3000) for _ in range(30)]
    texts += texts[:10]
    df = table(spark, tmp_path, list(enumerate(texts)), parts=9)
    sizes = iter(["1k", "128m"] * 100)
    parts = set()

    def dealt(f):
        def run(*args, **more):
            out = f(*args, **more)
            spark.conf.set(key, next(sizes))
            parts.add(df.select("text").rdd.getNumPartitions())
            return out

        return run

    for module, name in ((jaccard, "cut"), (repeats, "stored"), (jaccard, "numbered"), (repeats, "numbered")):
        if hasattr(module, name):
            monkeypatch.setattr(module, name, dealt(getattr(module, name)))
    before = spark.conf.get(key)
    try:
        links, root = brute_links(texts)
        got = {r.doc_id: (r.n_links, r.class_id) for r in jaccard.groups(df).collect()}
        assert got == {i: (links[i], root[i]) for i in range(len(texts))}
        assert sorted(r.doc_id for r in jaccard.keep_one(df).collect()) == sorted(set(root))
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digest(df).collect()}
        assert [got[i] for i in range(len(texts))] == brute_removed(texts)
        assert len(parts) > 1
    finally:
        spark.conf.set(key, before)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_pipeline_stage_by_stage(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    from resultfeed.llm.common import stored

    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, d))
        at[name] = (before.orderBy("doc_id").collect(), docs.collect())
        assert docs.columns == columns
    before, after = at["language_id"]
    assert len(after) >= 0.98 * len(before)
    before, after = at["near_duplicates"]
    _, root = brute_links([r.text for r in before])
    assert sorted(r.doc_id for r in after) == sorted({before[i].doc_id for i in root})
    before, after = at["passages"]
    want = {r.doc_id: w for r, w in zip(before, brute_removed([r.text for r in before]), strict=True)}
    for r in after:
        if want[r.doc_id][1] == 0:
            assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][3]
    assert {i for i, w in want.items() if w[1] < w[0]} >= {r.doc_id for r in after}
    before, after = at["mix"]
    assert set(Counter(r.doc_id for r in after).values()) <= {1, 2, 3} and {r.doc_id for r in after} <= {r.doc_id for r in before}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert packed.agg(F.sum("length")).first()[0] >= len(after)
    assert corpus_pipeline.run(spark, d).columns == packed.columns


@pytest.mark.parametrize("kind", ["odd", "clashing", "empty"])
def test_pipeline_of_odd_tables(spark, tmp_path, request, kind):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = request.getfixturevalue(kind)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, seen = seen, stage(spark, seen, str(tmp_path))
        assert seen.columns == docs.columns, name
        path = str(tmp_path / f"{name}.parquet")
        seen.write.parquet(path)
        seen = spark.read.parquet(path)
        rows = {r.doc_id for r in seen.select("doc_id").collect()}
        assert rows <= {r.doc_id for r in before.select("doc_id").collect()}, name
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in seen.select("doc_id").collect()}
    assert (packed.count() == 0) == (kind == "empty")
