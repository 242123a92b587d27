"""Suffix-array dedup of passages (operator 4): bytes covered by a 100-byte string that starts earlier.

Every window of 100 bytes has a smallest 32-byte gram (by hash); equal windows have the same.  So windows
fall into runs that share their gram, some 37 bytes a run, and only runs with equal grams need comparing.

1. Each task hashes its documents in pieces, cuts the windows into runs, and drops runs whose gram and
   whole content occurred earlier in the task (their bytes are compared there): they are removed whatever other
   tasks hold.  So a passage that a third of all documents share leaves a task once, not once per document.
2. Runs meet by gram, packed in binary blocks, in a tree: at most ``FAN`` tasks' runs of a gram meet at once, and
   of a gram with more than ``MANY`` contents only a mark goes on.  A run with a gram of its own is done.  Of runs
   with equal hashes all but the earliest are claimed to be copies of it.  Runs with equal grams and different
   contents are open.
3. The texts of open runs are fetched and sorted: suffixes at their window starts, by the hash-compared
   mergesort of ``suffixes``, in buckets of one gram at one place.  A window equal to its predecessor is removed;
   bytes are compared, so that a hash collision removes nothing.
4. A gram with very many different runs (a short line that very many documents have) is not gathered.  Its
   windows are sorted in each task, then the earliest of each meet by window hash, again in a tree, and are
   sorted by the same mergesort.
5. Claims are verified by bytes: neighbouring ones are joined to ranges, the texts of targets and sources are fetched
   with those of open runs, and the least and the greatest content of each source range must be equal.  If ever
   they are not, two contents had one hash, and everything is done again with another seed.

So no byte is removed on a hash alone.  Rows are numbered once and stored with their numbers; every later
scan reads that table.  Order is that of (doc_id, row, start).  Defined cases: a null text is empty; null ids come
last; rows of one id are ordered as numbered; texts shorter than 100 bytes lose nothing; equal rows are copies: the
first stays.
``dedup`` drops the halves of characters that a removal cuts through, and rows that end up empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import PIECE_BYTES, appended, frugal, pieces, utf8
from .common import numbered, read_table, stored
from .suffixes import Text, equal_ranges, mixed, repeated

WINDOW, GRAM = 100, 32
#: Bytes hashed at once, and windows in one run at most.
PART_BYTES, RUN_WINDOWS = (1 << 20) - 128, 255
#: Text of one task between two local passes (its runs take about a byte per byte of text).
LOCAL_BYTES = 32 << 20
#: Different runs of one gram beyond which it is marked, in a task and where runs meet.
MANY_LOCAL, MANY = 32, 512
#: Tasks whose runs meet at once; with more tasks there are more levels.
FAN = 1024
#: Claims are joined to ranges that do not cross multiples of this in their source.
CLAIM_BYTES = 1024
#: Seeds of the hashes, tried in turn until no claim is refuted by bytes.
SEEDS = (1, 2, 3, 4)
LAST_ID = (1 << 63) - 1

#: What is packed of a run: gram and content hashes, order, place, windows, and whether its gram recurs in it.
RUN = np.dtype([("gram", "<u8"), ("whole", "<u8"), ("key", "<i8"), ("rid", "<i8"), ("lo", "<i8"), ("n", "<i4"), ("again", "?")])
MARK = 0  # number of windows of a mark row
#: kind REMOVED: windows lo..lo+n-1 are removed; OPEN: open run; MARKED: open run of a marked gram; CLAIM: windows that
#: are claimed to equal those from slo on in text srid.
REMOVED, OPEN, MARKED, CLAIM = 0, 1, 2, 3
DECIDED = np.dtype([("kind", "<i4"), ("rid", "<i8"), ("lo", "<i8"), ("n", "<i4"), ("gram", "<i8"), ("key", "<i8"), ("srid", "<i8"), ("slo", "<i8")])
FOUND = "kind int, rid long, lo long, n int, gram long, key long, srid long, slo long"


def _slide(x: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` (np.minimum, np.maximum) over all ranges of ``width``, by doubling."""
    step = 1
    while step * 2 <= width:
        x = of(x[:-step], x[step:])
        step *= 2
    return of(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def runs_of(data: np.ndarray, bounds: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the texts in ``data``: text, start, windows, gram hash, content hash, recurring gram."""
    width = WINDOW - GRAM + 1
    n = len(data) - WINDOW + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    text = Text(data, seed)
    gram = text.grams(GRAM)
    least = _slide(gram, width, np.minimum)
    size = np.diff(bounds)
    inside = np.zeros(n, bool)
    begin = np.zeros(n + 1, np.int8)
    full = np.flatnonzero(size >= WINDOW)
    begin[bounds[:-1][full]] += 1
    begin[bounds[1:][full] - WINDOW + 1] -= 1
    inside = np.cumsum(begin[:-1]) > 0
    new = inside.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    new[bounds[:-1][full]] = True
    lo = np.flatnonzero(new)
    doc = np.searchsorted(bounds, lo, "right") - 1
    end = np.minimum(np.append(lo[1:], n), bounds[doc + 1] - WINDOW + 1)
    # long runs (periodic text) in pieces
    parts = -(-(end - lo) // RUN_WINDOWS)
    if len(parts) and parts.max() > 1:
        at = np.repeat(np.cumsum(parts) - parts, parts)
        piece = np.arange(parts.sum()) - at
        lo, end, doc = np.repeat(lo, parts) + piece * RUN_WINDOWS, np.repeat(end, parts), np.repeat(doc, parts)
        end = np.minimum(lo + RUN_WINDOWS, end)
    # does the gram occur twice within the run's windows?  Its places are where a gram is least in some window.
    most = _slide(np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width, np.maximum)
    spots = np.flatnonzero(most == gram)
    twice = np.zeros(len(spots) + 1, np.int64)
    if len(spots) > 1:
        np.cumsum((gram[spots[1:]] == gram[spots[:-1]]) & (spots[1:] - spots[:-1] <= RUN_WINDOWS + width), out=twice[1:-1])
        twice[-1] = twice[-2]
    i, j = np.searchsorted(spots, lo), np.searchsorted(spots, end - 1 + width - 1, "right") - 1
    again = twice[np.maximum(j, i)] > twice[i]
    return doc, lo - bounds[doc], end - lo, least[lo], text.hash(lo, end - 1 + WINDOW), again


def _grouped(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (gram, content, key, rid, lo); starts of new grams and of new (gram, content) in that order."""
    order = np.lexsort((runs["lo"], runs["rid"], runs["key"], runs["whole"], runs["gram"]))
    gram, whole = runs["gram"][order], runs["whole"][order]
    new = np.ones(len(runs), bool)
    new[1:] = gram[1:] != gram[:-1]
    other = new.copy()
    other[1:] |= whole[1:] != whole[:-1]
    return order, new, other


def _split(runs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all runs: is a later copy; is the first of its content; different contents of its gram; a mark or
    more than ``most`` contents with its gram; the first of its content."""
    order, new, other = _grouped(runs)
    group = np.cumsum(new) - 1
    marks = runs["n"][order] == MARK
    contents = np.bincount(group, other & ~marks, minlength=group[-1] + 1 if len(group) else 0)
    hot = (np.bincount(group, marks, minlength=len(contents)) > 0) | (contents > most)
    again = np.bincount(group, runs["again"][order], minlength=len(contents)) > 0
    copy, first, open_, many = (np.zeros(len(runs), bool) for _ in range(4))
    copy[order] = ~other & ~marks
    first[order] = other & ~marks
    open_[order] = ((contents > 1) | again | hot)[group]
    many[order] = hot[group]
    leader = np.zeros(len(runs), np.int64)
    leader[order] = order[np.maximum.accumulate(np.where(other, np.arange(len(order)), 0))]
    return copy, first, open_, many, leader


def _decided(kind: int, runs: np.ndarray, source: np.ndarray | None = None) -> np.ndarray:
    out = np.zeros(len(runs), DECIDED)
    out["kind"], out["gram"] = kind, np.ascontiguousarray(runs["gram"]).view(np.int64)
    for c in ("rid", "lo", "n", "key"):
        out[c] = runs[c]
    if source is not None:
        out["srid"], out["slo"] = source["rid"], source["lo"]
    return out


def _joined(runs: np.ndarray) -> np.ndarray:
    """Runs of one text that follow on one another, as one (``n`` may be long)."""
    if len(runs) < 2:
        return runs
    runs = runs[np.lexsort((runs["lo"], runs["rid"]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs["rid"][1:] != runs["rid"][:-1]) | (runs["lo"][1:] != runs["lo"][:-1] + runs["n"][:-1])
    at = np.flatnonzero(new)
    out = runs[at].copy()
    out["n"] = np.add.reduceat(runs["n"], at)
    return out


BLOCKS = "bucket int, part int, runs binary"


def _packed(runs: np.ndarray, bucket: np.ndarray, part: int) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    runs, bucket = runs[order], bucket[order]
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    # column by column: neighbours are alike, and shuffles compress
    blobs = [b"".join(np.ascontiguousarray(some[c]).tobytes() for c in runs.dtype.names) for some in np.split(runs, edge[1:])] if len(edge) else []
    return pa.RecordBatch.from_arrays([pa.array(bucket[edge].astype(np.int32)), pa.array(np.full(len(edge), part, np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "part", "runs"])


def _unpacked(blob: bytes, kind: np.dtype) -> np.ndarray:
    n = len(blob) // sum(kind[c].itemsize for c in kind.names)
    out, at = np.empty(n, kind), 0
    for c in kind.names:
        out[c] = np.frombuffer(blob, kind[c], n, at)
        at += n * kind[c].itemsize
    return out


def _blocks(runs: np.ndarray, decided: list[np.ndarray], buckets: int, part: int) -> list[pa.RecordBatch]:
    """Blocks of runs, bucket < ``buckets`` by gram; from there on what is decided, by text."""
    number = lambda x: (mixed(x) % np.uint64(buckets)).astype(np.int64)
    done = np.concatenate(decided)
    return [_packed(runs, number(runs["gram"]), part), _packed(done, number(done["rid"].astype(np.uint64)) + buckets, part)]


def _marked(runs: np.ndarray, first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What goes on by gram (runs, and a mark for each marked gram), and the runs of marked grams."""
    hot = runs[first & many]
    marks = runs[many][np.unique(runs["gram"][many], return_index=True)[1]].copy()
    marks["n"] = MARK
    return np.concatenate([runs[first & ~many], marks]), hot


def _local(buckets: int, seed: int):
    """Step 1 for one task."""

    def hashed(piece, data, bounds):
        rid, key = piece.column("rid").to_numpy(), piece.column("key").to_numpy()
        for first in range(0, max(len(data), 1), PART_BYTES):
            # windows that start in this part; a text is hashed with what its last windows need behind it
            last = min(first + PART_BYTES, len(data))
            stop = min(last + WINDOW - 1, len(data))
            a = int(np.searchsorted(bounds, first, "right") - 1)
            b = int(np.searchsorted(bounds, stop, "left"))
            own = np.clip(bounds[a : b + 1], first, stop) - first
            doc, lo, n, gram, whole, again = runs_of(data[first:stop], own, seed)
            out = np.empty(len(doc), RUN)
            out["gram"], out["whole"], out["n"], out["again"] = gram, whole, n, again
            out["lo"] = lo + own[doc] + first - bounds[a + doc]
            out["rid"], out["key"] = rid[a + doc], key[a + doc]
            place = out["lo"] + bounds[a + doc]
            mine = place < last  # the bytes behind the part belong to the next one
            yield out[mine], place[mine]

    def passed(held, places, texts):
        if not held:
            return
        runs, place, data = np.concatenate(held), np.concatenate(places), np.concatenate(texts)
        if not len(runs):
            return
        copy, first, _, many, leader = _split(runs, MANY_LOCAL)
        at = np.flatnonzero(copy)
        good = runs["n"][at] == runs["n"][leader[at]]
        good[good] = equal_ranges(data, place[at[good]], place[leader[at[good]]], runs["n"][at[good]].astype(np.int64) + WINDOW - 1)
        first[at[~good]] = True  # refuted by bytes: goes on, is claimed where runs meet, and refuted there again
        on, hot = _marked(runs, first, many)
        gone = _joined(runs[at[good]])
        yield from _blocks(on, [_decided(REMOVED, gone), _decided(MARKED, hot)], buckets, TaskContext.get().partitionId())

    def run(batches):
        held, places, texts, size = [], [], [], 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                data, bounds = utf8(piece.column("text"))
                for out, place in hashed(piece, data, bounds):
                    held.append(out), places.append(place + size)
                texts.append(data)
                size += len(data)
                if size >= LOCAL_BYTES:
                    yield from passed(held, places, texts)
                    held, places, texts, size = [], [], [], 0
        yield from passed(held, places, texts)

    return run


def _meet(buckets: int, last: bool):
    """Step 2 for one bucket of runs of some tasks: blocks for the next level, or what is found at the last one."""

    def run(table: pa.Table) -> pa.Table:
        bucket, part = table.column("bucket")[0].as_py(), table.column("part")[0].as_py() // FAN
        if bucket >= buckets:
            done = np.concatenate([_unpacked(b, DECIDED) for b in table.column("runs").to_pylist()])
            on = np.zeros(0, RUN)
        else:
            runs = np.concatenate([_unpacked(b, RUN) for b in table.column("runs").to_pylist()])
            copy, first, open_, many, leader = _split(runs, MANY)
            claims = _decided(CLAIM, runs[copy], runs[leader[copy]])
            on, hot = _marked(runs, first, many)
            done = np.concatenate([claims, _decided(MARKED, hot)])
            if last:
                done = np.concatenate([done, _decided(OPEN, runs[first & open_ & ~many])])
        if last:
            return pa.table({c: done[c] for c in DECIDED.names})
        return pa.Table.from_batches(_blocks(on, [done], buckets, part))

    return run


def _contents(batches):
    """Texts with slices to fetch -> a row per slice with its bytes."""
    for batch in batches:
        for piece in pieces(batch, "text"):
            texts, lists = piece.column("text").cast(pa.large_binary()), piece.column("slices")
            of = np.repeat(np.arange(piece.num_rows), np.asarray(pc.list_value_length(lists)))
            flat = lists.flatten()
            lo, n = flat.field("lo").to_numpy(), flat.field("n").to_numpy()
            bytes_of = texts.to_pylist()
            # many slices of a long text come in several batches
            for a in range(0, len(of), 1 << 16):
                b = min(a + (1 << 16), len(of))
                content = [bytes_of[i][x : x + k + WINDOW - 1] for i, x, k in zip(of[a:b].tolist(), lo[a:b].tolist(), n[a:b].tolist(), strict=True)]
                part = flat.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[part.field(c) for c in ("kind", "lo", "n", "gram", "key", "srid", "slo")], piece.column("rid").take(pa.array(of[a:b])), pa.array(content, pa.binary())], names=["kind", "lo", "n", "gram", "key", "srid", "slo", "rid", "content"])


CONTENTS = "kind int, lo long, n int, gram long, key long, srid long, slo long, rid long, content binary"


def _rows_of(gone: np.ndarray, rid: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Removed windows as ranges: rid, lo, n."""
    rid, at = rid[gone], at[gone]
    order = np.lexsort((at, rid))
    rid, at = rid[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (rid[1:] != rid[:-1]) | (at[1:] != at[:-1] + 1)
    edge = np.flatnonzero(new)
    return {"rid": rid[edge], "lo": at[edge], "n": np.diff(np.append(edge, len(at))).astype(np.int32)}


GONE = "rid long, lo long, n int"


def _sort_runs(content: pa.Array, gram_of: np.ndarray, n: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of runs that stand in the order of documents: run, offset, whether an equal one stands earlier,
    and the bytes of all runs' windows as (data, start) for further use."""
    data, bounds = utf8(content)
    text, total = Text(data, seed), int(n.sum())
    row = np.repeat(np.arange(len(n)), n)
    offset = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    starts = bounds[:-1][row] + offset
    # the place of the gram in each window: its next occurrence from the window's start on
    gram = text.grams(GRAM)
    owner = np.searchsorted(bounds, np.arange(len(gram)), "right") - 1
    spots = np.flatnonzero(gram.view(np.int64) == gram_of[owner])
    place = spots[np.searchsorted(spots, starts)] - starts
    # buckets: gram and place; ties stay in the order of documents
    bucket = np.unique(gram_of, return_inverse=True)[1][row] * (WINDOW + 1) + place
    by = np.argsort(bucket, kind="stable")
    gone = np.zeros(total, bool)
    gone[by] = repeated(text, starts[by], bucket[by], WINDOW)
    return row, offset, gone, starts


def _chunks(key: np.ndarray, size: np.ndarray, most: int):
    """Ranges of rows, cut where ``key`` (sorted) changes, of about ``most`` bytes."""
    total, start = np.cumsum(size), 0
    edge = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    while start < len(key):
        want = (total[start - 1] if start else 0) + most
        k = np.searchsorted(edge, max(start + 1, int(np.searchsorted(total, want, "right"))))
        end = int(edge[min(k, len(edge) - 1)])
        yield start, end
        start = end


def _sorted_out(seed: int):
    """Step 3 for some grams: the windows that equal an earlier one with the same gram."""

    def run(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_numpy() for c in ("gram", "key", "rid", "lo", "n")}
        order = np.lexsort((columns["lo"], columns["rid"], columns["key"], columns["gram"]))
        columns = {c: v[order] for c, v in columns.items()}
        content, out = table.column("content").combine_chunks(), []
        for a, b in _chunks(columns["gram"], columns["n"] + WINDOW - 1, PIECE_BYTES):
            part = {c: v[a:b] for c, v in columns.items()}
            row, offset, gone, _ = _sort_runs(content.take(pa.array(order[a:b])), part["gram"], part["n"].astype(np.int64), seed)
            out.append(_rows_of(gone, part["rid"][row], part["lo"][row] + offset))
        return pa.table({c: np.concatenate([o[c] for o in out]) for c in ("rid", "lo", "n")})

    return run


#: Step 4: windows of marked grams on their way, and ranges that are removed (n > 0, no window).
WINDOWS = "w long, part int, key long, rid long, lo long, n int, window binary"


def _window_rows(gone: dict[str, np.ndarray], w, key, rid, at, window: np.ndarray, part: int) -> pa.RecordBatch:
    """Removed ranges (by text) and windows that go on (by their hash)."""
    k, m = len(gone["rid"]), len(rid)
    one = lambda a, b, t: pa.array(np.concatenate([a, b]).astype(t))
    offsets = np.concatenate([np.zeros(k, np.int32), np.arange(m + 1, dtype=np.int32) * WINDOW])
    binary = pa.Array.from_buffers(pa.binary(), k + m, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(window))])
    return pa.RecordBatch.from_arrays(
        [one(mixed(gone["rid"].astype(np.uint64)).view(np.int64), w, np.int64), pa.array(np.full(k + m, part, np.int32)), one(np.zeros(k), key, np.int64), one(gone["rid"], rid, np.int64), one(gone["lo"], at, np.int64), one(gone["n"], np.zeros(m), np.int32), binary],
        names=["w", "part", "key", "rid", "lo", "n", "window"],
    )


def _windows(seed: int):
    """Step 4 in a task: sorts the windows of its marked runs, and sends the earliest of each on."""

    def run(batches):
        part = TaskContext.get().partitionId()
        for batch in batches:
            for piece in pieces(batch, "content"):
                columns = {c: piece.column(c).to_numpy() for c in ("gram", "key", "rid", "lo", "n")}
                order = np.lexsort((columns["lo"], columns["rid"], columns["key"]))
                columns = {c: v[order] for c, v in columns.items()}
                content = piece.column("content").take(pa.array(order))
                row, offset, gone, starts = _sort_runs(content, columns["gram"], columns["n"].astype(np.int64), seed)
                data, _ = utf8(content)
                rid, at = columns["rid"][row], columns["lo"][row] + offset
                stay = np.flatnonzero(~gone)
                w = Text(data, seed + 100).hash(starts[stay], starts[stay] + WINDOW).view(np.int64)
                window = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
                ranges = _rows_of(gone, rid, at)
                for a in range(0, max(len(stay), 1), 1 << 16):
                    some = slice(a, a + (1 << 16))
                    yield _window_rows(ranges if not a else {c: v[:0] for c, v in ranges.items()}, w[some], columns["key"][row[stay[some]]], rid[stay[some]], at[stay[some]], window[starts[stay[some]]], part)

    return run


def _windows_meet(last: bool, seed: int):
    """Step 4 where windows of some tasks meet: windows that equal an earlier one; the others go on."""

    def run(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_numpy() for c in ("w", "key", "rid", "lo", "n")}
        done = columns["n"] > 0
        out = [{c: columns[c][done] for c in ("rid", "lo", "n")}]
        order = np.flatnonzero(~done)
        order = order[np.lexsort(tuple(columns[c][order] for c in ("lo", "rid", "key", "w")))]
        window = table.column("window").combine_chunks()
        on = np.zeros(len(order), bool)
        for a, b in _chunks(columns["w"][order], np.full(len(order), WINDOW), PIECE_BYTES // 2):
            at = order[a:b]
            by = at[np.lexsort(tuple(columns[c][at] for c in ("lo", "rid", "key")))]
            data, _ = utf8(window.take(pa.array(by)))
            # a first pass of the sort by eight bytes, the mergesort within
            starts = np.arange(len(by)) * WINDOW
            head = data.reshape(-1, WINDOW)[:, :8].copy().view(">u8")[:, 0].astype(np.uint64)
            near = np.argsort(head, kind="stable")
            gone = np.zeros(len(by), bool)
            gone[near] = repeated(Text(data, seed), starts[near], head[near], WINDOW)
            out.append(_rows_of(gone, columns["rid"][by], columns["lo"][by]))
            on[a:b] = ~gone
            order[a:b] = by
        ranges = {c: np.concatenate([o[c] for o in out]) for c in ("rid", "lo", "n")}
        if last:
            return pa.table(ranges)
        left = order[on]
        data, _ = utf8(window.take(pa.array(left)))
        return pa.Table.from_batches([_window_rows(ranges, columns["w"][left], columns["key"][left], columns["rid"][left], columns["lo"][left], data, table.column("part")[0].as_py() // FAN)])

    return run


def removed_ranges(size: int, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(k, 2) ranges of bytes that removed windows lo..lo+n-1 cover, merged, in order."""
    order = np.argsort(lo, kind="stable")
    begin, end = lo[order], np.maximum.accumulate((lo + n + WINDOW - 1)[order]) if len(lo) else lo
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(begin) - 1) if len(begin) else np.zeros(0, np.int64)
    return np.stack([begin[new], np.minimum(end[last], size)], axis=1)


def _applied(keep: list[str], kept_text: bool):
    """Final step for texts with their removed windows: digest columns, or the kept text."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "_text"):
                texts = piece.column("_text").cast(pa.large_binary()).to_pylist()
                lists = piece.column("_gone")
                rows = []
                flat = lists.flatten()
                lo, n = (flat.field(c).to_numpy() for c in ("lo", "n"))
                at = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))])
                for i, body in enumerate(texts):
                    cut = removed_ranges(len(body), lo[at[i] : at[i + 1]], n[at[i] : at[i + 1]].astype(np.int64)).tolist()
                    edges = [0, *[x for pair in cut for x in pair], len(body)]
                    rest = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if cut else body
                    rows.append((len(body), len(body) - len(rest), len(cut), rest.decode("utf-8", "ignore") if kept_text else hashlib.sha256(rest).hexdigest()))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield appended(piece.select(keep), dict(zip(("_n", "_removed", "_spans", "_out"), columns, strict=True)))

    return run


def _parts(df: DataFrame) -> int:
    return df._jdf.queryExecution().toRdd().getNumPartitions()  # planning only: nothing runs


def _claimed(found: DataFrame) -> DataFrame:
    """Claims joined to ranges: rid, lo, n, srid, slo."""
    claims = found.where(F.col("kind") == CLAIM)
    line = Window.partitionBy("rid").orderBy("lo")
    behind = lambda c: F.lag(F.col(c) + F.col("n")).over(line)
    block = lambda c: F.shiftright(c, CLAIM_BYTES.bit_length() - 1)
    on = (behind("lo") == F.col("lo")) & (behind("slo") == F.col("slo")) & (F.lag("srid").over(line) == F.col("srid")) & (F.lag(block("slo")).over(line) == block("slo"))
    marked = claims.select("rid", "lo", "n", "srid", "slo", F.when(on, 0).otherwise(1).alias("new"))
    marked = marked.withColumn("island", F.sum("new").over(line))
    return marked.groupBy("rid", "island").agg(F.min("lo").alias("lo"), F.sum("n").cast("int").alias("n"), F.first("srid").alias("srid"), F.min("slo").alias("slo")).drop("island")


def _attempt(rows: DataFrame, seed: int) -> DataFrame | None:
    """Steps 1 to 5 with one seed of the hashes; None if bytes refute a claim."""
    parts = _parts(rows)
    buckets = max(16, 4 * parts)
    blocks, tasks = rows.mapInArrow(frugal(_local(buckets, seed)), BLOCKS), parts
    while tasks > FAN:
        blocks = blocks.groupBy("bucket", F.floor(F.col("part") / FAN)).applyInArrow(_meet(buckets, last=False), BLOCKS)
        tasks = -(-tasks // FAN)
    found = stored(blocks.groupBy("bucket").applyInArrow(_meet(buckets, last=True), FOUND))
    claims = stored(_claimed(found))
    ends = claims.unionByName(claims.select(F.col("srid").alias("rid"), F.col("slo").alias("lo"), "n", "srid", "slo").distinct())
    ends = ends.select(F.lit(CLAIM).alias("kind"), "rid", "lo", "n", F.lit(0).cast("long").alias("gram"), F.lit(0).cast("long").alias("key"), "srid", "slo")
    asked = found.where(F.col("kind").isin(OPEN, MARKED)).unionByName(ends)
    slices = asked.groupBy("rid").agg(F.collect_list(F.struct("kind", "lo", "n", "gram", "key", "srid", "slo")).alias("slices"))
    contents = stored(rows.select("rid", "text").join(slices, "rid").mapInArrow(frugal(_contents), CONTENTS), codec="zstd")
    if refuted(contents):
        return None
    of = lambda kind: contents.where(F.col("kind") == kind)
    cold = of(OPEN).groupBy(F.pmod("gram", F.lit(buckets)).alias("part")).applyInArrow(_sorted_out(seed), GONE)
    hot = of(MARKED).select("gram", "key", "rid", "lo", "n", "content")
    windows, tasks = hot.mapInArrow(frugal(_windows(seed)), WINDOWS), _parts(hot)
    by = F.pmod("w", F.lit(buckets))
    while tasks > FAN:
        windows = windows.groupBy(by, F.floor(F.col("part") / FAN)).applyInArrow(_windows_meet(False, seed), WINDOWS)
        tasks = -(-tasks // FAN)
    hot = windows.groupBy(by).applyInArrow(_windows_meet(True, seed), GONE)
    return found.where(F.col("kind") == REMOVED).select("rid", "lo", "n").unionByName(claims.select("rid", "lo", "n")).unionByName(cold).unionByName(hot)


def refuted(contents: DataFrame) -> bool:
    """Whether some target of a claim differs from its source: then the least and the greatest bytes of a source's
    claims differ.  Both are combined before they move, however many targets a source has."""
    spread = contents.where(F.col("kind") == CLAIM).groupBy("srid", "slo", "n").agg(F.min("content").alias("a"), F.max("content").alias("b"))
    return not spread.where("a <> b").limit(1).isEmpty()


def removed_windows(rows: DataFrame) -> DataFrame:
    """Removed windows of ``rows`` (rid, key, text): rid, lo, n."""
    for seed in SEEDS:
        done = _attempt(rows, seed)
        if done is not None:
            return done
    raise RuntimeError(f"{len(SEEDS)} independent hashes each gave two contents one value")


def _judged(docs: DataFrame, keep: list[str], kept_text: bool, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    # the input's columns go by number, so that none can clash
    named = {c: f"k{i}" for i, c in enumerate(dict.fromkeys([*keep, doc_id, text]))}
    docs = numbered(docs.select(*[F.col(f"`{c}`").alias(k) for c, k in named.items()]), "_rid")
    body = F.coalesce(F.col(named[text]), F.lit(""))
    rows = docs.select(F.col("_rid").alias("rid"), F.coalesce(F.col(named[doc_id]).cast("long"), F.lit(LAST_ID)).alias("key"), body.alias("text"))
    gone = stored(removed_windows(rows), codec="zstd").groupBy(F.col("rid").alias("_rid")).agg(F.collect_list(F.struct("lo", "n")).alias("_gone"))
    kept = [T.StructField(named[c], docs.schema[named[c]].dataType) for c in keep]
    own = docs.select(*[f.name for f in kept], "_rid", body.alias("_text")).join(gone, "_rid", "left")
    schema = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in ("_n", "_removed", "_spans")], T.StructField("_out", T.StringType())])
    return own.mapInArrow(frugal(_applied([f.name for f in kept], kept_text)), schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    out = _judged(docs, ["doc_id"], kept_text=False)
    return out.select(F.col("k0").alias("doc_id"), F.col("_n").alias("n_bytes"), F.col("_removed").alias("n_removed"), F.col("_spans").alias("n_spans"), F.col("_out").alias("kept_sha256"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with its texts without the repeated passages, same columns; ``n_chars``, if there, counts the kept
    text.  Rows of which nothing is left go."""
    out = _judged(docs, docs.columns, kept_text=True)
    changed = F.col("_removed") > 0
    final = {c: F.col(f"k{i}") for i, c in enumerate(docs.columns)}
    final["text"] = F.when(changed, F.col("_out")).otherwise(final["text"])
    if "n_chars" in final:
        final["n_chars"] = F.when(changed, F.length("_out").cast(docs.schema["n_chars"].dataType)).otherwise(final["n_chars"])
    return out.where(~changed | (F.length(F.trim("_out")) > 0)).select(*[v.alias(c) for c, v in final.items()])


def op4(spark, sf_dir: str) -> DataFrame:
    return digest(read_table(spark, sf_dir, "documents"))


#: The same by definition: every window, and whether it starts earlier.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0))) AS i FROM d)),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS LAST, i) AS n FROM w) WHERE n > 1),
cuts AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM
  (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM gone)) GROUP BY doc_id, k),
rests AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM cuts UNION ALL SELECT doc_id, max(b), NULL FROM cuts GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (coalesce(y, length(h) // 2) - x)), '' ORDER BY x) AS h FROM rests JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM cuts GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
