import os
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from resultfeed.llm import mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DIR = "/root/testdata/sf0.001"


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in stopped)
        open_ = sum(weight[s] for s in order if s not in stopped)
        share = {s: cap * sizes[s] if s in stopped else left * weight[s] / open_ for s in order} if open_ else {s: cap * sizes[s] for s in order}
        above = {s for s in order if s not in stopped and share[s] > cap * sizes[s]}
        if not above:
            return share
        stopped |= above


def test_mix_of_odd_rows(odd, odd_rows):
    got = mixing.mix_plan(odd).collect()
    assert len(got) == len(odd_rows)
    sizes = defaultdict(int)
    for r in odd_rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 3 and abs(r.copies - (r.target / r.source_size if r.source_size else 0)) < 1


def test_targets_reshare(spark):
    rows = [(i, f"s{i // 100:02d}", (1 if i < 300 else 400)) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = {r.source: r.target for r in mixing.source_rates(df).table.collect()}
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    assert got == pytest.approx(brute_targets(sizes)) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_ranges_rank_like_one_sort(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANK_ROWS", 7)
    df = spark.createDataFrame([(s, 1) for s in [*map(str, range(40)), "Ä", "z", None]], "source string, source_size long")
    got = sorted((r["rank"], r.source) for r in mixing._ranked(df, 43).collect())
    assert [s for _, s in got] == sorted([*map(str, range(40)), "Ä", "z"]) + [None] and [k for k, _ in got] == list(range(43))


def test_salted_join_equals_broadcast(odd, monkeypatch):
    want = Counter(map(tuple, mixing.mix(odd).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert Counter(map(tuple, mixing.mix(odd).collect())) == want


def test_mix_emits_copies(odd, clashing, empty):
    plan = Counter()
    for r in mixing.mix_plan(odd).collect():
        plan[r.doc_id] += r.copies
    out = mixing.mix(odd)
    assert out.columns == odd.columns and Counter(r.doc_id for r in out.collect()) == +plan
    more = mixing.mix(clashing)
    assert more.columns == clashing.columns and more.count() == out.count()
    assert mixing.mix(empty).count() == 0 and mixing.mix_plan(empty).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_op2_oracle(spark):
    got = sorted(map(tuple, mixing.op2(spark, DIR).select("doc_id", "size", "source_size", "target", "taken").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DIR}/documents.parquet')")
    want = sorted(con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE_SQL})").fetchall())
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_words_taken_come_near_the_targets(spark):
    """Within what whole documents and independent draws allow: four standard deviations of the draw, per source."""
    rows = mixing.op2(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    taken, target, spread = Counter(), {}, Counter()
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        rate = r.target / r.source_size if r.source_size else 0
        spread[r.source] += r.size**2 * (rate % 1) * (1 - rate % 1)
        assert r.taken <= 3 * r.size
    for s, t in target.items():
        assert abs(taken[s] - t) <= 4 * spread[s] ** 0.5 + 1, s
    assert abs(sum(taken.values()) - sum(target.values())) <= 0.03 * sum(target.values())


def brute_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts_of_odd_rows(odd, odd_rows, clashing, empty):
    got = Counter((r.doc_id, *[r[c] for c in quality.COUNTS], r.base_failed) for r in quality.judge(odd, keep_columns=["doc_id"])[0].collect())
    want = Counter()
    for r in odd_rows:
        c = brute_counts(r[1])
        want[(r[0], *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert got == want
    more, names = quality.judge(clashing)
    assert more.count() == len(odd_rows) and more.columns[: len(clashing.columns)] == clashing.columns and names["kept"] != "kept"
    one, same = more.where("doc_id = 9").first(), clashing.where("doc_id = 9").first()
    assert (one.kept, one.quality, one.n_words) == (same.kept, same.quality, same.n_words) and one[names["n_words"]] == brute_counts(same.text)[0]
    assert quality.judge(empty)[0].count() == 0


def test_em_sees_all_documents(odd, odd_rows, monkeypatch):
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda patterns: seen.extend(patterns) or fit(patterns))
    rows = quality.judge(odd, keep_columns=["doc_id"])[0].collect()
    assert any(r.base_failed for r in rows) and sum(n for _, n in seen) == len(odd_rows)


def test_em_finds_the_better_rules():
    import random

    rng, counts = random.Random(1), Counter()
    accuracy = [0.95, 0.9, 0.8, 0.85]
    for _ in range(5000):
        good = rng.random() < 0.8
        counts[tuple(0 if rng.random() < 0.2 else (1 if good == (rng.random() < a) else -1) for a in accuracy)] += 1
    share, right = quality.fit(sorted(counts.items()))
    assert abs(share - 0.8) < 0.05 and all(abs(g - a) < 0.06 for (g, _), a in zip(right, accuracy, strict=True))
    assert quality.fit([]) == (quality.START_GOOD, [])


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_verdicts_agree_with_labels(spark):
    d = "/root/testdata/sf0.01"
    got = quality.op3(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.col("quality").alias("truth")), "doc_id").where("not base_failed")
    n, right, lost = got.agg(F.count("*"), F.sum((F.col("kept") == (F.col("truth") == 1)).cast("int")), F.sum((~F.col("kept") & (F.col("truth") == 1)).cast("int"))).first()
    assert right >= 0.95 * n and lost <= 0.02 * n
