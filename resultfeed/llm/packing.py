"""Best-fit packing (operator 5): a linear grouping scheme over the histogram of lengths.

Documents become ids and an end token; only those above the capacity are cut, into full pieces behind
a shorter first one.  How to fill sequences is decided on the driver from the histogram of piece lengths
(at most ``capacity`` numbers, whatever the corpus):

1. Large lengths are put into groups of equal cardinality and rounded up to their group's largest.
2. For these few sizes, configurations (multisets that fit) are chosen one by one, each the fullest
   that subset sums allow around the largest size left, and used as often as the counts allow.
3. Actual lengths take the places of their groups, largest first; that leaves gaps.
4. Small pieces go by best fit, largest first, into the gaps, and then into new sequences.

The plan is a list of runs: ranks a..b among the pieces of one length go to sequences s.. at one offset.
A length is dealt to salts by its share of all pieces, so that no length, however common, is ordered in
one task, and the plan's runs are cut at the salts' edges: a piece finds its place by its rank within (length, salt).
Full pieces have a sequence of their own and take no part in this.  Several numbers of groups are tried and the plan
with the fewest sequences is taken.

Defined cases: a null or empty text is one piece with the end token only; repeated rows (and repeated
ids) are packed each; ids may be of any type that can be ordered; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import frugal, pieces
from .common import cut, read_table
from .tokens import encoder

CAPACITY, END = 2048, 0
#: Lengths from capacity / SMALL on are large.
SMALL = 8
GROUPS = (24, 48, 96, 192, 2048)
#: A length is dealt to salts of about this many pieces, or of this share of all pieces if that is more.
RANKED, RANKED_SHARE = 1_000, 1 / 20_000
#: Rows of a plan that are broadcast; a plan has some thousands.  A longer one is joined by shuffle.
MOST_RUNS = 200_000


@dataclass
class Run:
    """Pieces of one length with ranks first..first+n-1 go to sequences from ``sequence`` on, one each, at ``offset``."""

    length: int
    first: int
    n: int
    sequence: int
    offset: int


def _grouped(counts: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """Groups of equal cardinality, largest first: (rounded size, [[length, count], ..] largest first)."""
    total = sum(counts.values())
    each = max(1, -(-total // groups))
    out: list[tuple[int, list[list[int]]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room or (out[-1][0] != length and groups >= len(counts)):
                out.append((length, []))
                room = each
            take = left if groups >= len(counts) else min(left, room)
            out[-1][1].append([length, take])
            left -= take
            room = max(0, room - take) if groups < len(counts) else 1
    return out


def _fullest(sizes: list[int], have: list[int], start: int, capacity: int) -> list[int]:
    """Indices (with repeats) of a fullest multiset that fits and contains ``start``; sizes descend."""
    room = capacity - sizes[start]
    reach, step = 1, {0: -1}  # bit set of sums reached; the item that reached each sum first
    mask = (1 << (room + 1)) - 1
    for i in range(start, len(sizes)):
        n = have[i] - (i == start)
        for _ in range(min(n, room // sizes[i])):
            new = (reach << sizes[i]) & mask & ~reach
            if not new:
                break
            reach |= new
            while new:
                low = new & -new
                step[low.bit_length() - 1] = i
                new ^= low
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, [start]
    while at:
        out.append(step[at])
        at -= sizes[step[at]]
    return out


def _configured(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """Configurations that use up all counts: (how often, indices of sizes)."""
    have, out, i = list(counts), [], 0
    while i < len(sizes):
        if not have[i]:
            i += 1
            continue
        used = _fullest(sizes, have, i, capacity)
        need: dict[int, int] = {}
        for k in used:
            need[k] = need.get(k, 0) + 1
        times = min(have[k] // n for k, n in need.items())
        for k, n in need.items():
            have[k] -= n * times
        out.append((times, used))
    return out


def _planned(counts: dict[int, int], capacity: int, groups: int) -> tuple[list[Run], int]:
    large = {k: n for k, n in counts.items() if k * SMALL >= capacity}
    small = {k: n for k, n in counts.items() if k not in large}
    runs: list[Run] = []
    given = dict.fromkeys(counts, 0)
    sequences = 0

    def place(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append(Run(length, given[length], n, sequence, offset))
        given[length] += n

    grouped = _grouped(large, groups)
    blocks: dict[int, list[tuple[int, int]]] = {}  # gap -> [(first sequence, how many)]
    for times, used in _configured([g[0] for g in grouped], [sum(n for _, n in g[1]) for g in grouped], capacity):
        # substitute: each place takes its group's actual lengths, largest first, in runs of equal tuples
        left = times
        while left:
            # as many as the lengths in front last for; one, where a group's places take different lengths
            step = max(1, min(left, *[grouped[g][1][0][1] // used.count(g) for g in used]))
            offset = 0
            for g in used:
                length, n = grouped[g][1][0]
                place(length, step, sequences, offset)
                grouped[g][1][0][1] -= step
                if not grouped[g][1][0][1]:
                    grouped[g][1].pop(0)
                offset += length
            blocks.setdefault(capacity - offset, []).append((sequences, step))
            sequences += step
            left -= step

    gaps = sorted(blocks)
    for length in sorted(small, reverse=True):
        left = small[length]
        while left:
            i = bisect.bisect_left(gaps, length)
            if i == len(gaps):  # open new sequences, enough for what's left of this length
                step = -(-left // (capacity // length))
                gap, first = capacity, sequences
                sequences += step
            else:
                gap = gaps[i]
                first, step = blocks[gap].pop()
                if not blocks[gap]:
                    del blocks[gap], gaps[i]
            use = min(step, left)
            place(length, use, first, capacity - gap)
            left -= use
            for rest, at, n in ((gap - length, first, use), (gap, first + use, step - use)):
                if n:
                    if rest not in blocks:
                        bisect.insort(gaps, rest)
                        blocks[rest] = []
                    blocks[rest].append((at, n))
    return runs, sequences


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Runs and number of sequences for a histogram of lengths; the best of several group sizes."""
    if any(k < 1 or k > capacity for k in counts):
        raise ValueError("a length is outside 1..capacity")
    return min((_planned(counts, capacity, g) for g in GROUPS), key=lambda p: p[1])


PIECES = "piece int, start long, length long, ids_crc32 long"


def cut_lengths(n: int, capacity: int) -> np.ndarray:
    """Lengths of the pieces of n ids; the first may be shorter."""
    full, rest = divmod(n, capacity)
    return np.array(([rest] if rest else []) + [capacity] * full, np.int64)


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per piece of every document (doc_id and ``PIECES``), with ``ids`` (little-endian 32-bit, binary) if asked for."""

    def run(batches):
        tool = encoder(vocabulary, ranks)
        for batch in batches:
            for part in pieces(batch, "text"):
                row, number, start, length, crc, raw = [], [], [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = np.append(tool.ids(text or ""), np.uint32(END)).astype("<u4")
                    sizes = cut_lengths(len(ids), capacity)
                    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                    for k, (a, n) in enumerate(zip(at.tolist(), sizes.tolist(), strict=True)):
                        data = ids[a : a + n].tobytes()
                        row.append(i), number.append(k), start.append(a), length.append(n), crc.append(zlib.crc32(data))
                        if keep_ids:
                            raw.append(data)
                columns = [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * keep_ids, names=names + ["ids"] * keep_ids)

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string(PIECES + ", ids binary" * keep_ids).fields])
    return docs.select("doc_id", "text").mapInArrow(frugal(run), schema)


def _places(runs: list[Run], parts: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Runs cut at the salts' edges: (length, salt, first, behind, sequence, offset), ranks within the salt."""
    out, at = [], {k: [0, 0] for k in parts}  # salt under way, and its first rank
    for r in sorted(runs, key=lambda r: (r.length, r.first)):
        first, end = r.first, r.first + r.n
        i, base = at[r.length]
        while first < end:
            salt, n = parts[r.length][i]
            stop = min(end, base + n)
            if first < stop:
                out.append((r.length, salt, first - base, stop - base, r.sequence + first - r.first, r.offset))
                first = stop
            if first == base + n:
                i, base = i + 1, base + n
        at[r.length] = [i, base]
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``.

    Texts are encoded once; the pieces are checkpointed (without ids: some 50 bytes each).
    """
    spark = docs.sparkSession
    made = cut(pieces_of(docs, capacity, keep_ids, vocabulary, ranks))
    columns = [*made.columns]
    # full pieces: a sequence each, below zero.  Numbers of checkpointed rows stay.
    full = made.where(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = made.where(F.col("length") < capacity)
    total = {r[0]: r[1] for r in rest.groupBy("length").agg(F.count(F.lit(1))).collect()}  # capacity rows at most
    each = max(RANKED, math.ceil(sum(total.values()) * RANKED_SHARE))
    common = {k: -(-n // each) for k, n in total.items() if n > each}
    salts = F.coalesce(*[F.when(F.col("length") == k, F.lit(n)) for k, n in sorted(common.items())], F.lit(1))
    salted = rest.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), salts).cast("int"))
    parts: dict[int, list[tuple[int, int]]] = {k: [(0, n)] for k, n in total.items() if k not in common}
    if common:  # 2 / RANKED_SHARE rows at most
        for length, salt, n in salted.where(F.col("length").isin(*common)).groupBy("length", "salt").agg(F.count(F.lit(1))).orderBy("length", "salt").collect():
            parts.setdefault(length, []).append((salt, n))
    runs, _ = plan(total, capacity)
    places = _places(runs, parts)
    table = spark.createDataFrame(places, "length long, salt int, first long, behind long, sequence long, offset long")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1)
    a, b = ranked.alias("a"), (F.broadcast(table) if len(places) <= MOST_RUNS else table).alias("b")
    found = a.join(b, (F.col("a.length") == F.col("b.length")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("behind")))
    found = found.select(*[F.col(f"a.{c}") for c in columns], (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids]
    return found.unionByName(full).select(*names)


def op5(spark, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
