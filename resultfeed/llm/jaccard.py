"""N-gram Jaccard join with Bayesian candidate pruning (operator 8).

Documents are linked if the Jaccard similarity of their sets of 5-word shingles is 0.8 or more.

1. Equal texts are one class of copies (128-bit hash, summed before the shuffle): all later steps see one
   text of each.
2. Each text gets 128 MinHash values; 32 bands of 4 name buckets.  Texts that share no bucket with another
   are done.  A pair at the threshold shares none with probability 5e-8.
3. The others are put into blocks of bounded count and bytes, together with what they share buckets
   with.  The unit of pairing is a block, or a pair of blocks that some bucket connects, never a pair of
   documents: a bucket with thousands of texts is a few block pairs, and a text is sent to its block and to
   those pairs of blocks that its own buckets connect.  The pairs of a bucket with many blocks are made in
   many tasks.
4. In a block pair, pairs whose sizes cannot reach the threshold are dropped, then MinHash values are
   compared eight at a time: with m of n equal, the posterior of a uniform prior is Beta(m + 1, n - m + 1),
   and a pair goes when its probability of reaching the threshold falls below 1e-9.  The rest are verified by
   exact intersection of the shingle sets.  What leaves the task are sums of links by text and a
   spanning forest of them, not the links.
5. Components of the forests give the groups.

Defined cases: a text of one to four words has one shingle, all its words; null and blank texts have
none, hence no links, and are groups of their own; equal rows are copies of one another; rows with
equal ids and different texts are different documents; ids may be of any type that can be ordered.  Rows are numbered once and stored with their
numbers; every later scan reads that table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import frugal, pieces, utf8
from .common import WORD_PATTERN, cut, free_name, numbered, read_table
from .graph import components

THRESHOLD, SHINGLE = 0.8, 5
HASHES, BAND_ROWS = 128, 4
STEP, TOLERANCE = 8, 1e-9
BLOCK_ROWS, BLOCK_BYTES = 1024, 8 << 20
#: Blocks of one bucket that are paired with all its blocks in one task.
PAIRED_BLOCKS = 64
#: Pairs compared at once in a task, links gathered at once, and bytes of words hashed at once.
PAIRS_AT_ONCE, LINKS_AT_ONCE, LETTERS_AT_ONCE = 1 << 18, 1 << 16, 1 << 19

_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _MULTIPLIER, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each word, some words at a time."""
    size, out = ends - starts, np.zeros(len(starts), np.uint64)
    total, at = np.cumsum(size), 0
    power = _powers(int(size.max()) if len(size) else 0)
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + LETTERS_AT_ONCE, "right")))
        n = size[at:end]
        edge = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(edge, n)
        letters = data[np.repeat(starts[at:end], n) + place].astype(np.uint64) + np.uint64(1)
        out[at:end] = mixed(np.add.reduceat(letters * power[place], edge) + n.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        at = end
    return out


def shingles(data: np.ndarray, bounds: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's distinct shingles, sorted, and their bounds by text."""
    n = len(bounds) - 1
    space = np.ones(len(data) + 1, bool)
    np.take(_SPACE, data, out=space[:-1]) if len(data) else None
    first = np.zeros(len(data) + 1, bool)
    first[bounds[:-1]] = True  # a text's first byte begins a word whatever stands before it
    starts = np.flatnonzero(~space[:-1] & (np.concatenate([[True], space[:-2]]) | first[:-1])) if len(data) else np.zeros(0, np.int64)
    last = np.zeros(len(data) + 1, bool)
    last[bounds[1:]] = True
    ends = np.flatnonzero(~space[:-1] & (space[1:] | last[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    hashes = _word_hashes(data, starts, ends)
    if n == 1 and len(hashes) >= width:  # one long text: no rows to keep apart
        code = np.zeros(len(hashes) - width + 1, np.uint64)
        for k in range(width):
            code = code * _MULTIPLIER + hashes[k : k + len(code)]
        code = np.unique(mixed(code))
        return code, np.array([0, len(code)])
    of_text = np.searchsorted(bounds, starts, "right") - 1
    words = np.bincount(of_text, minlength=n)
    at = np.concatenate([[0], np.cumsum(words)])
    # windows of `width` words that stay in their text; shorter texts: one window of all words
    windows = max(len(hashes) - width + 1, 0)
    code = np.zeros(windows, np.uint64)
    for k in range(width):
        code = code * _MULTIPLIER + hashes[k : k + windows]
    inside = np.arange(windows) + width <= at[of_text[:windows] + 1]
    code, row = mixed(code[inside]), of_text[:windows][inside]
    short = np.flatnonzero((words > 0) & (words < width))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = k < words[short]
            extra[has] = extra[has] * _MULTIPLIER + hashes[at[short[has]] + k]
        code, row = np.concatenate([code, mixed(extra + words[short].astype(np.uint64))]), np.concatenate([row, short])
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    return code[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=n))])


def signatures(code: np.ndarray, bounds: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """(texts, hashes) MinHash values, 32 bits each; all ones where a text has no shingle."""
    out = np.full((len(bounds) - 1, hashes), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    seeds = mixed(np.arange(1, 2 * hashes + 1, dtype=np.uint64) * _MULTIPLIER)
    if len(full):
        for k in range(hashes):
            value = (code ^ seeds[hashes + k]) * (seeds[k] | np.uint64(1))
            out[full, k] = (np.minimum.reduceat(value, bounds[:-1][full]) >> np.uint64(32)).astype(np.uint32)
    return out


def bands(signature: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """(texts, bands) bucket names, 64 bits each."""
    parts = signature.reshape(len(signature), -1, rows).astype(np.uint64)
    out = np.zeros(parts.shape[:2], np.uint64)
    for k in range(rows):
        out = out * _MULTIPLIER + parts[:, :, k]
    return mixed(out + np.arange(out.shape[1], dtype=np.uint64)[None, :] * np.uint64(0xD1342543DE82EF95)).view(np.int64)


def least_equal(compared: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest equal values of ``compared`` with P(similarity >= threshold) >= tolerance under a uniform prior.

    The upper tail of Beta(m + 1, n - m + 1) is a lower tail of the binomial of n + 1.
    """
    tail = 0.0
    for m in range(compared + 1):
        tail += math.comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if tail >= tolerance:
            return m
    return compared


def linked_pairs(code: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray, signature: np.ndarray, threshold: float = THRESHOLD):
    """Yields arrays (a, b) of linked rows: a from ``left``, b from ``right``; a < b where both are the same rows.

    ``code`` must be sorted in each row.
    """
    size = np.diff(bounds)
    same = left is right
    # the vocabulary of the block pair, so that sets are ranges of small numbers
    names = np.unique(code, return_inverse=True)[1].astype(np.int64) if len(code) else np.zeros(0, np.int64)
    mark = np.zeros(int(names.max()) + 1 if len(names) else 0, bool)
    right = right[np.argsort(size[right], kind="stable")]
    sizes = size[right]
    least = {n: least_equal(n, threshold) for n in range(STEP, signature.shape[1] + 1, STEP)}
    pending, held = [], 0

    def verified(a, b):
        for at in (0, *range(STEP, signature.shape[1], STEP)):
            if not len(a):
                break
            equal = (signature[a, at : at + STEP] == signature[b, at : at + STEP]).sum(axis=1)
            total = equal if at == 0 else total + equal  # noqa: F821
            on = total >= least[at + STEP]
            a, b, total = a[on], b[on], total[on]
        if not len(a):
            return
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        cuts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        for i, j in zip(cuts, np.append(cuts[1:], len(a)), strict=True):
            x, partners = a[i], b[i:j]
            own = names[bounds[x] : bounds[x + 1]]
            mark[own] = True
            n = size[partners]
            where = np.repeat(bounds[partners] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.add.reduceat(mark[names[where]].astype(np.int64), np.cumsum(n) - n)
            mark[own] = False
            # exact in integers: common / (|A| + |B| - common) >= p / 1000
            p = round(threshold * 1000)
            good = common * 1000 >= p * (len(own) + n - common)
            if good.any():
                yield np.full(int(good.sum()), x), partners[good]

    for x in left.tolist():
        if not size[x]:
            continue
        low = np.searchsorted(sizes, math.ceil(size[x] * threshold - 1e-9))
        high = np.searchsorted(sizes, math.floor(size[x] / threshold + 1e-9), "right")
        b = right[low:high]
        if same:
            b = b[b > x]
        if len(b):
            pending.append((np.full(len(b), x), b))
            held += len(b)
        if held >= PAIRS_AT_ONCE:
            yield from verified(*(np.concatenate(z) for z in zip(*pending, strict=True)))
            pending, held = [], 0
    if held:
        yield from verified(*(np.concatenate(z) for z in zip(*pending, strict=True)))


def forest(n: int, pairs) -> np.ndarray:
    """Each of ``n`` rows' root, the smallest row it is linked to by any path; ``pairs`` yields arrays of links, which are
    not kept."""
    parent = np.arange(n)

    def joined(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal parent
        while len(a):
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up
            x, y = parent[a], parent[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))

    held, size = [], 0
    for pair in pairs:
        held.append(pair)
        size += len(pair[0])
        if size >= LINKS_AT_ONCE:
            joined(*(np.concatenate(z) for z in zip(*held, strict=True)))
            held, size = [], 0
    if held:
        joined(*(np.concatenate(z) for z in zip(*held, strict=True)))
    return parent


def _prepared(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, their bounds by text, and signatures, made piece by piece."""
    codes, sizes, signed = [], [], []
    for piece in pieces(table.select(["text"]).combine_chunks().to_batches()[0], "text"):
        code, ends = shingles(*utf8(piece.column("text")))
        codes.append(code), sizes.append(np.diff(ends)), signed.append(signatures(code, ends))
    return np.concatenate(codes), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(signed)


def _block_pair(table: pa.Table, threshold: float) -> pa.Table:
    """Links inside one pair of blocks: rows (cid, other, links), ``other`` from the forest or null."""
    cid, at = np.unique(table.column("cid").to_numpy(), return_index=True)  # equal rows of one class come twice
    table = table.take(pa.array(at))
    mult = table.column("mult").to_numpy().astype(np.int64)
    code, ends, signature = _prepared(table)
    one = table.column("block").to_numpy() == table.column("b1").to_numpy()
    left = np.flatnonzero(one)
    right = left if table.column("b1")[0] == table.column("b2")[0] else np.flatnonzero(~one)
    links = np.zeros(len(cid), np.int64)

    def counted():
        for a, b in linked_pairs(code, ends, left, right, signature, threshold):
            np.add.at(links, a, mult[b])
            np.add.at(links, b, mult[a])
            yield a, b

    roots = forest(len(cid), counted())
    some = np.flatnonzero(links)
    hung = np.flatnonzero(roots != np.arange(len(cid)))
    return pa.table({
        "cid": pa.array(np.concatenate([cid[some], cid[hung]]), pa.int64()),
        "other": pa.array(np.concatenate([np.zeros(len(some), np.int64), cid[roots[hung]]]), pa.int64(), mask=np.concatenate([np.ones(len(some), bool), np.zeros(len(hung), bool)])),
        "links": pa.array(np.concatenate([links[some], np.zeros(len(hung), np.int64)]), pa.int64()),
    })


def _bucketed(rows: DataFrame) -> DataFrame:
    """(rid, buckets) for each text with words."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                code, ends = shingles(*utf8(piece.column("text")))
                has = np.flatnonzero(np.diff(ends))
                names = bands(signatures(code, ends))[has]
                yield piece.select(["rid"]).take(pa.array(has)).append_column("buckets", pa.FixedSizeListArray.from_arrays(pa.array(names.ravel()), names.shape[1]).cast(pa.list_(pa.int64())))

    return rows.mapInArrow(frugal(run), "rid long, buckets array<long>")


def groups(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: rid (its number), doc_id, copy_id (smallest id with the same text), class_id
    (smallest id of its group), n_links (other rows it is linked to, copies included), first (one row of each group)."""
    return _grouped(numbered(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), "rid"), threshold)


def _grouped(docs: DataFrame, threshold: float) -> DataFrame:
    """``groups`` for a stored table of rid, doc_id, text."""
    rows = docs.select("rid", "doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"), "text")
    # 1. copies
    ids = cut(rows.select("rid", "doc_id", "h1", "h2", F.octet_length("text").cast("long").alias("size"), F.col("text").rlike(WORD_PATTERN).alias("has")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("rid").alias("rid")))
    classes = ids.where("has").groupBy("h1", "h2").agg(first.alias("f"), F.count(F.lit(1)).alias("mult"), F.max("size").alias("size"))
    classes = cut(classes.select("h1", "h2", F.col("f.id").alias("copy_id"), F.col("f.rid").alias("cid"), "mult", "size"))
    # 2. buckets; a class goes by the row number of its first row
    named = cut(_bucketed(rows.select("rid", "text")).join(classes.select(F.col("cid").alias("rid")), "rid", "left_semi").select(F.col("rid").alias("cid"), F.explode("buckets").alias("bucket")))
    shared = named.groupBy("bucket").agg(F.min("cid").alias("leader"), F.max("cid").alias("other")).where(F.col("leader") != F.col("other")).select("bucket", "leader")
    met = cut(named.join(cut(shared), "bucket"))
    # 3. blocks
    led = cut(met.groupBy("cid").agg(F.min("leader").alias("label")))
    jump = led.select(F.col("cid").alias("label"), F.col("label").alias("next"))
    led = led.join(jump, "label", "left").select("cid", F.coalesce("next", "label").alias("label"))
    led = cut(led.join(classes.select("cid", "mult", "size"), "cid"))
    weight = led.groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_BYTES)).alias("parts"))
    total = led.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    mixed_blocks = max(1, -(-2 * total[0] // BLOCK_ROWS), -(-2 * total[1] // BLOCK_BYTES))
    sub = F.when(F.col("parts") > 1, F.xxhash64("label", F.pmod(F.xxhash64("cid"), F.col("parts")))).otherwise(F.pmod(F.xxhash64("label"), F.lit(mixed_blocks)))
    placed = cut(led.join(cut(weight), "label").select("cid", "mult", sub.alias("block")))
    # a text goes to its own block, and to each pair of blocks that one of its buckets connects
    members = cut(met.select("cid", "bucket").join(placed.select("cid", "block"), "cid"))
    across = members.groupBy("bucket").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo != hi").select("bucket")
    members = cut(members.join(cut(across), "bucket", "left_semi"))
    spread = cut(members.select("bucket", "block").distinct())
    # a bucket's blocks are dealt to salts, and all of them are sent to each salt: no task pairs a bucket's blocks alone
    salted = spread.join(spread.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / PAIRED_BLOCKS).cast("int").alias("salts")), "bucket")
    some = salted.select("bucket", F.col("block").alias("b1"), F.pmod(F.xxhash64("block"), F.col("salts")).cast("int").alias("salt"))
    all_ = salted.select("bucket", F.col("block").alias("b2"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    two = some.join(all_, ["bucket", "salt"]).where("b1 < b2").select("bucket", "b1", "b2")
    ends = two.select("bucket", F.col("b1").alias("block"), "b1", "b2").unionByName(two.select("bucket", F.col("b2").alias("block"), "b1", "b2"))
    routed = members.join(ends, ["bucket", "block"]).select("cid", "block", "b1", "b2").distinct()
    own = placed.select("cid", "block", F.col("block").alias("b1"), F.col("block").alias("b2"))
    routes = cut(own.unionByName(routed).join(placed.select("cid", "mult"), "cid"))
    # 4. links
    sent = rows.select("rid", "text").join(routes.select(F.col("cid").alias("rid"), "mult", "block", "b1", "b2"), "rid")
    sent = sent.select(F.col("rid").alias("cid"), "mult", "text", "block", "b1", "b2")
    found = cut(sent.groupBy("b1", "b2").applyInArrow(lambda table: _block_pair(table, threshold), "cid long, other long, links long"))
    links = found.where(F.col("other").isNull()).groupBy("cid").agg(F.sum("links").alias("links"))
    # 5. groups
    label = components(found.where(F.col("other").isNotNull()).select(F.col("cid").alias("a"), F.col("other").alias("b")))
    label = label.select(F.col("node").alias("cid"), "label")
    full = classes.join(label, "cid", "left").join(links, "cid", "left")
    full = cut(full.select("h1", "h2", "cid", "copy_id", "mult", F.coalesce("label", "cid").alias("label"), F.coalesce("links", F.lit(0)).alias("links")))
    grouped = full.where(F.col("links") > 0)
    least = F.min(F.struct(F.col("copy_id").isNull().alias("n"), F.col("copy_id").alias("id"), F.col("cid").alias("cid")))
    heads = cut(grouped.groupBy("label").agg(least.alias("f")).select("label", F.col("f.id").alias("class_id"), F.col("f.cid").alias("head")))
    named_classes = full.join(heads, "label", "left").select(
        "h1", "h2", "copy_id", F.when(F.col("head").isNull(), F.col("copy_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("head", "cid").alias("head"), (F.col("links") + F.col("mult") - 1).alias("n_links")
    )
    done = ids.where("has").join(cut(named_classes), ["h1", "h2"])
    done = done.select("rid", "doc_id", "copy_id", "class_id", "n_links", (F.col("rid") == F.col("head")).alias("first"))
    alone = ids.where(~F.col("has")).select("rid", "doc_id", F.col("doc_id").alias("copy_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"))
    return done.unionByName(alone)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The first document of each group, same columns."""
    rid = free_name(docs.columns, "rid")
    rows = numbered(docs, rid)
    kept = _grouped(rows.select(F.col(rid).alias("rid"), "doc_id", F.coalesce("text", F.lit("")).alias("text")), threshold)
    return rows.join(kept.where("first").select(F.col("rid").alias(rid)), rid, "left_semi").select(*docs.columns)


def op8(spark, sf_dir: str) -> DataFrame:
    return groups(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copy_id")


#: The same by definition: all pairs that share a shingle, and what each document reaches.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c * 10 >= 8 * (a.n + b.n - c)),
reach(x, y) AS (SELECT x, y FROM l UNION SELECT reach.x, l.y FROM reach JOIN l ON l.x = reach.y),
links AS (SELECT x, count(*) AS k FROM l GROUP BY x),
least_ AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
copies AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text)
SELECT d.doc_id, coalesce(least(d.doc_id, least_.y), d.doc_id) AS class_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, CASE WHEN len(w) > 0 THEN first_id ELSE d.doc_id END AS copy_id
FROM d JOIN copies USING (text) LEFT JOIN links ON links.x = d.doc_id LEFT JOIN least_ ON least_.x = d.doc_id
"""
