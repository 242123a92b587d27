"""Token ids of the byte-level BPE vocabulary, and token counts by section (operator 9).

``Encoder`` gives the ids that ``tokenizers`` gives for a vocabulary file with byte-level BPE.  Texts in
plain Latin, Greek or Cyrillic script are encoded by the same merges through the rank file, which is
several times faster; the ids are the same (tested).  Texts with other characters, with long unbroken
runs, or with a special token's string go to ``tokenizers`` itself.

``attribute`` counts tokens by section.  A document is encoded once, whole.  Each token covers a span of
the text's bytes; sections are spans of the text as well; the interval join of the two is a merge of
sorted bounds.  The explicit rule for a token that crosses a boundary: it belongs to the section in which
its first byte lies.  So the counts of a document's sections add up to its tokens.

Defined cases: a null or empty text has no section and no row (``section_counts``), and in ``op9`` a row
without section, with zero bytes and tokens; empty lines belong to the section before; other columns pass through, with results under a free
name where the input has one of theirs.
"""

from __future__ import annotations

import base64
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import appended, frugal, pieces
from .common import free_name, process_cache, read_table

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Scripts in which both libraries split alike, whatever their Unicode version: letters up to Cyrillic
#: and general punctuation.
_PLAIN = re.compile("[\t\n\r -~\xa0-ӿ‐-‧‰-⁞€]*")
#: Longer unbroken runs (of letters, or of white space) are left to ``tokenizers``: the other library's
#: pattern matcher gives up on runs of about a million.
LONGEST_RUN = 100_000
#: Longer texts are encoded part by part, so that memory stays bounded.  A part ends before a space between two ASCII
#: letters: the pattern always begins a new word there, so the ids are those of the whole text.
PART = 1 << 20
_SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_LONG = re.compile(rf"\S{{{LONGEST_RUN}}}|\s{{{LONGEST_RUN}}}")


class Encoder:
    """Ids by ``tokenizers`` (add_special_tokens=False)."""

    def __init__(self, vocabulary: str, ranks: str | None = None, fast: bool = True):
        import tiktoken

        self._vocabulary, self._exact = vocabulary, None
        with open(vocabulary, encoding="utf-8") as f:
            found = json.load(f)
        self.special = [t["content"] for t in found.get("added_tokens", [])]
        #: Bytes of each id.
        self.sizes = np.zeros(max([*found["model"]["vocab"].values(), *[t["id"] for t in found.get("added_tokens", [])]]) + 1, np.int64)
        for word, i in found["model"]["vocab"].items():  # one character stands for one byte
            self.sizes[i] = len(word)
        for t in found.get("added_tokens", []):
            self.sizes[t["id"]] = len(t["content"].encode())
        self.quick = None
        if fast and ranks is not None:
            import public_tokenizers

            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text as uint32."""
        if len(text) <= 2 * PART:
            return self._ids(text)
        out, at = [], 0
        while at < len(text):
            end = _SAFE.search(text, at + PART) if at + 2 * PART < len(text) else None
            stop = end.start() if end else len(text)
            out.append(self._ids(text[at:stop]))
            at = stop
        return np.concatenate(out)

    def _ids(self, text: str) -> np.ndarray:
        if self.quick is not None and _PLAIN.fullmatch(text) and not any(s in text for s in self.special) and (len(text) < LONGEST_RUN or not _LONG.search(text)):
            return np.asarray(self.quick.encode_ordinary(text), np.uint32)
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)

    @property
    def exact(self):
        """The library itself, loaded when a text needs it."""
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self._vocabulary)
        return self._exact

    def ends(self, text: str) -> np.ndarray:
        """Where each token ends in the text's UTF-8 bytes."""
        return np.cumsum(self.sizes[self.ids(text)])


def encoder(vocabulary: str | None = None, ranks: str | None = None) -> Encoder:
    """The process's encoder; paths default to the installed vocabulary files."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary, ranks = public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS)
    return process_cache(f"encoder {vocabulary}", lambda: Encoder(vocabulary, ranks))


def section_bounds(data: bytes) -> np.ndarray:
    """Starts of a text's sections in bytes.

    A section is a line with a word and the blank lines that follow it; its line end is its own.
    Blank lines at the start belong to the first section.
    """
    starts, at = [], 0
    for line in data.split(b"\n"):
        if line.strip():
            starts.append(at)
        at += len(line) + 1
    if starts:
        starts[0] = 0
    elif data:
        starts = [0]
    return np.array(starts, np.int64)


def attribute(token_ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval join of tokens and sections: tokens by section (by each token's first byte), and for each
    section whether a token runs over its end."""
    first = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    owner = np.searchsorted(starts, first, "right") - 1
    counts = np.bincount(owner, minlength=len(starts))
    edges = starts[1:]
    over = np.zeros(len(starts), bool)
    if len(edges) and len(token_ends):
        token = np.searchsorted(token_ends, edges, "right")  # the first token that ends behind the edge
        over[:-1] = (token < len(first)) & (first[np.minimum(token, len(first) - 1)] < edges)
    return counts, over


def section_counts(docs: DataFrame, text: str = "text", vocabulary: str | None = None, ranks: str | None = None, every_row: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """One row per section: ``docs``'s columns without the text, section, start_byte, n_bytes, n_tokens, crosses.

    With ``every_row`` a text without sections gives a row too: no section and start, zero bytes and tokens.
    """
    keep = [f for f in docs.schema.fields if f.name != text]
    names: dict[str, str] = {}
    for c in ("section", "start_byte", "n_bytes", "n_tokens", "crosses"):
        names[c] = free_name([*docs.columns, *names.values()], c)
    fields = [T.StructField(v, T.BooleanType() if k == "crosses" else T.LongType()) for k, v in names.items()]

    def run(batches):
        tool = encoder(vocabulary, ranks)
        for batch in batches:
            for piece in pieces(batch, text):
                row, parts = [], []
                for i, t in enumerate(piece.column(text).to_pylist()):
                    if not t:
                        if every_row:
                            row.append(np.array([i]))
                            parts.append((np.array([-1]), np.array([-1]), np.array([0]), np.array([0]), np.array([False])))
                        continue
                    data = t.encode()
                    starts = section_bounds(data)
                    counts, over = attribute(tool.ends(t), starts)
                    row.append(np.full(len(starts), i))
                    parts.append((np.arange(len(starts)), starts, np.diff(np.append(starts, len(data))), counts, over))
                if row:
                    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
                    columns = [pa.array(x, mask=columns[0] < 0) for x in columns[:2]] + [pa.array(x) for x in columns[2:]]
                    chosen = piece.select([f.name for f in keep]).take(pa.array(np.concatenate(row)))
                    yield appended(chosen, dict(zip(names.values(), columns, strict=True)))

    return docs.select(*[F.col(f"`{f.name}`") for f in keep], text).mapInArrow(frugal(run), T.StructType([*keep, *fields])), names


def op9(spark, sf_dir: str) -> DataFrame:
    """Token counts of every section of every document; a document without text has one row of zero tokens."""
    out, _ = section_counts(read_table(spark, sf_dir, "documents").select("doc_id", "text"), every_row=True)
    return out
