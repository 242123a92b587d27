"""Token counts, packing, sharding."""

import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from resultfeed.llm import packing, sharding, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x600), max_size=60) | st.text(alphabet=" \n\t\r'sdtm\xa0aé1-.,\u2013\u2028\x85", max_size=40))
def test_ids_equal_the_library(text):
    from tokenizers import Tokenizer

    tool = tokens.encoder()
    exact = tokens.process_cache("test exact", lambda: Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY)))
    assert tool.ids(text).tolist() == exact.encode(text, add_special_tokens=False).ids
    assert (tool.ends(text)[-1] if text else 0) == len(text.encode())


def test_ids_of_hard_texts(plain, odd_rows):
    tool = tokens.encoder()
    for text in ["<|endoftext|>", "a<|endoftext|>b", "日本語 🙂", "x" * 250_000, " " * 250_000, "a\u0301", *[r[1] for r in odd_rows if r[1]]]:
        assert tool.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_long_texts_in_parts(plain, monkeypatch):
    """Parts end where no token can cross: the ids are those of the whole text."""
    rng = random.Random(3)
    monkeypatch.setattr(tokens, "PART", 40)
    tool = tokens.encoder()
    bits = ["word", " two", "Don't", " ", "  ", "\n", "12", " 3", "é", " à", "日本", "a b", " <|endoftext|> x", ".", " 's", "'s t"]
    for n in range(300):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(60, 200)))
        assert tool.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_sections_of_odd_rows(odd, odd_rows, plain, clashing, empty):
    out, names = tokens.section_counts(odd.select("doc_id", "text"))
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += r.n_tokens
    want = Counter()
    for r in odd_rows:
        want[r[0]] += len(plain.encode(r[1] or "", add_special_tokens=False).ids)
    assert +got == +want
    assert tokens.section_counts(empty)[0].count() == 0
    more, names = tokens.section_counts(clashing)
    assert names["section"] != "section" and more.count() == out.count()


def test_op9_has_every_document(spark, tmp_path):
    rows = [(1, "a b\n\nc"), (2, None), (3, ""), (4, " \n"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    out = tokens.op9(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.section, r.start_byte, r.n_bytes) for r in out if r.doc_id in (1, 4)) == [(1, 0, 0, 5), (1, 1, 5, 1), (4, 0, 0, 2)]
    for i in (2, 3, 5):
        assert [tuple(r) for r in out if r.doc_id == i] == [(i, None, None, 0, 0, False)]


def test_attribution_by_brute_force():
    rng = random.Random(2)
    tool = tokens.encoder()
    for _ in range(50):
        text = "".join(rng.choice(["word ", "é", "\n", "\n\n", "x", " \n", "don't ", "12"]) for _ in range(rng.randint(1, 60)))
        data = text.encode()
        starts, ends = tokens.section_bounds(data), tool.ends(text)
        counts, over = tokens.attribute(ends, starts)
        first = [0, *ends[:-1].tolist()]
        bounds = [*starts.tolist(), len(data)]
        assert counts.tolist() == [sum(a <= f < b for f in first) for a, b in zip(bounds, bounds[1:], strict=False)]
        assert over.tolist() == [any(f < b < e for f, e in zip(first, ends.tolist(), strict=True)) and b < len(data) for b in bounds[1:]]
        assert starts[0] == 0 and all(re.search(rb"\S", data[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)) or not data.strip()


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_a_packing(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([rng.randint(1, 64), rng.randint(1, 12), 64, 33]) for _ in range(rng.choice([1, 5, 400, 3000])))
    runs, n = packing.plan(dict(counts), 64)
    used, bins = Counter(), {}
    for r in runs:
        assert r.first == used[r.length]
        used[r.length] += r.n
        for k in range(r.n):
            bins.setdefault(r.sequence + k, []).append((r.offset, r.length))
    assert used == counts and len(bins) == n
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    assert n <= 1.02 * max(-(-sum(k * v for k, v in counts.items()) // 64), sum(v for k, v in counts.items() if k > 32)) + 2
    assert packing.plan({}, 64) == ([], 0)


def test_common_lengths_are_dealt_to_salts(spark, tmp_path, monkeypatch):
    """Several salts per length, and the plan joined by shuffle: still a packing, as full as before."""
    rows = [(i, "word " * (i % 7)) for i in range(900)] + [(1000 + i, "word " * 5000) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    before = {r.sequence_id for r in packing.pack(docs).collect()}
    monkeypatch.setattr(packing, "RANKED", 40)
    monkeypatch.setattr(packing, "MOST_RUNS", 0)
    got = packing.pack(docs).collect()
    assert len({r.sequence_id for r in got}) == len(before) and len(got) == 900 + sum(r.length == 2048 for r in got) + 3
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in places.values():
        ends = np.cumsum([0, *[n for _, n in sorted(items)]]).tolist()
        assert [a for a, _ in sorted(items)] == ends[:-1] and ends[-1] <= 2048
    assert all(len(places[r.sequence_id]) == 1 for r in got if r.length == 2048)
    named = packing.pack(docs.limit(50).withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))
    assert named.count() == 50 and named.schema["doc_id"].dataType.typeName() == "string"


def test_packing_of_odd_rows(odd, odd_rows, plain, clashing, empty):
    rows = packing.pack(odd, keep_ids=True).collect()
    got = Counter()
    by_doc = {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.ids))
        got[r.doc_id] += r.length
    want = Counter()
    for r in odd_rows:
        want[r[0]] += len(plain.encode(r[1] or "", add_special_tokens=False).ids) + 1
    assert got == want
    parts = sorted(by_doc[9])  # the long text
    ids = np.concatenate([np.frombuffer(p[2], "<u4") for p in parts]).tolist()
    assert ids == [*plain.encode(odd_rows[9][1], add_special_tokens=False).ids, 0] and len(parts) > 1
    assert [p[1] for p in parts] == np.concatenate([[0], np.cumsum([len(p[2]) // 4 for p in parts])])[:-1].tolist() and all(len(p[2]) == 8192 for p in parts[1:])
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in places.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty).count() == 0 and packing.pack(clashing).count() == len(rows)


def test_store_versions_and_conflicts(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=40_000, fan_in=3)
    with pytest.raises(FileNotFoundError):
        store.read()
    df = spark.range(0, 900).select("id", F.concat(F.lit("é"), F.col("id")).alias("arrival"), F.lit(None).cast("string").alias("z"))
    for i in range(5):
        store.append(df.where(F.col("id") % 5 == i).coalesce(1))
    assert store.versions() == [1, 2, 3, 4, 5] and store.read(2).count() == 360
    done = store.compact()
    assert len(store.shards(done)) < 5 and sorted(map(tuple, store.read().collect())) == sorted(map(tuple, df.collect()))
    assert store.read(5).count() == 900  # older versions stay until vacuum
    assert store.vacuum() > 0 and store.read().count() == 900 and store.vacuum() == 0
    with pytest.raises(sharding.Conflict):
        store._commit(sharding.Manifest(done.version, done.schema))
    with pytest.raises(sharding.Conflict):
        store._change(done.schema, [], {"data/gone.parquet"}, "merge")
    other = sharding.ShardStore(spark, str(tmp_path / "s"))
    store.append(df.limit(3)), other.append(df.limit(2))
    assert store.read().count() == 905


def test_store_of_odd_rows(spark, tmp_path, odd, clashing, empty):
    for i, df in enumerate((odd, clashing, empty)):
        store = sharding.ShardStore(spark, str(tmp_path / f"s{i}"), target_bytes=1 << 20, fan_in=2)
        store.append_many(df, F.pmod(F.xxhash64("doc_id"), F.lit(6)).cast("int"))
        store.compact()
        assert store.read().columns == df.columns
        assert Counter(map(tuple, store.read().collect())) == Counter(map(tuple, df.collect()))


def test_compaction_passes_over_stuck_tiers(spark, tmp_path, monkeypatch):
    """A tier whose merge makes no progress waits; the others are merged, and its files don't stay."""
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=1 << 20, fan_in=2)
    store.append(spark.range(10).repartition(4))
    store.append(spark.range(100_000).repartition(4))
    small = {s.path for s in store.manifest().open if s.n_rows < 100}
    real = store._merge

    def merge(shards, schema):
        if {s.path for s in shards} <= small:  # as many files as before
            below = "data/again"
            store.spark.range(10).repartition(4).write.parquet(f"{store.root}/{below}")
            return store._shards(below, schema, store._rows(below, schema), 1)
        return real(shards, schema)

    monkeypatch.setattr(store, "_merge", merge)
    done = store.compact()
    assert small <= {s.path for s in done.open} and len(done.open) < 8 and store.read().count() == 100_010
    assert not store._listed("data/again")


def test_finished_shards_go_to_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "PARTS_FAN_IN", 3)
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=2000, fan_in=2)
    for i in range(10):
        store.append(spark.range(i * 1000, i * 1000 + 1000).coalesce(1))  # each finished as it comes
    now = store.manifest()
    assert not now.open and 1 <= len(now.parts) < 10 and sum(p.n_shards for p in now.parts) == 10
    assert store.read().count() == 10_000 and store.read(4).count() == 4000
    sizes = [len(store._text(f"manifests/v{v:012d}.json")) for v in store.versions()]
    assert sizes[-1] < sizes[0] + 3 * 120  # a commit does not list all shards
    store.vacuum()
    assert len(list((tmp_path / "s" / "manifests").glob("part-*"))) == len(now.parts) and store.read().count() == 10_000


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_op6_gives_all_rows(spark):
    assert sharding.op6(spark, "/root/testdata/sf0.001").count() == 200


def test_shared_folder(tmp_path):
    """The session's own setting; a local folder only where all runs in one process."""
    from types import SimpleNamespace

    from resultfeed.llm.common import shared_dir

    class Folder:
        def __init__(self, place=None):
            self.place = place

        def isDefined(self):  # noqa: N802
            return self.place is not None

        def get(self):
            return self.place

    def session(master, setting=None):
        state = {"dir": Folder()}
        context = SimpleNamespace(master=master, setCheckpointDir=lambda d: state.update(dir=Folder(d)), _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: state["dir"])))
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: setting), sparkContext=context)

    assert shared_dir(session("spark://host:7077", "hdfs:///tmp/x")) == "hdfs:///tmp/x"
    assert os.path.isdir(shared_dir(session("local[4]")))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint.dir"):
            shared_dir(session(master))
