"""Quality rules as weak supervision (operator 3), DataFrame functions only.

Every rule votes good (1), bad (-1) or abstains (0) on a document.  Expectation maximisation
estimates each rule's accuracy without labels: a document has a hidden class, a rule that votes is
right with a probability of its own for good and for bad documents.  What EM needs of the corpus
is how often each pattern of votes occurs, at most 3 ** (number of rules) rows, counted over all
documents and summed before the shuffle.  The verdict is the posterior probability of "good", which
replaces the all-must-pass filter.

Counting repeated word windows stays inside the row: hashes of the 3-word windows are sorted with
their places, equal neighbours are repeats, and covered words are counted by a fold over the places.
No rows are exploded, so a long document costs its own length only.

Defined cases: null and blank texts have no words and zero counts; ``base_failed`` is true for them
(fewer than 50 words).  Windows are compared by a 64-bit hash of their words.  Repeated rows are
judged alike.  An empty table gives an empty table.  Other columns pass through ``judge`` untouched;
results take a free name where the input has one of theirs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut, free_name, let, words_of

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
ROUNDS, TOLERANCE = 200, 1e-9
#: EM starts from rules that are right this often, and from this share of good documents.
START_ACCURACY, START_GOOD = 0.75, 0.8
#: Pseudo-counts (right, wrong) of a rule's accuracies; they keep them off 0 and 1 and on the better side of chance.
PRIOR = (8.0, 2.0)
KEEP_FROM = 0.5


def _covered(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in ``words``."""
    n = F.greatest(F.size(words) - 2, F.lit(0))
    windows = F.transform(F.slice(words, 1, n), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def repeats(placed: Column) -> Column:
        twice = F.filter(placed, lambda x, i: (x["h"] == F.get(placed, i - 1)["h"]) | (x["h"] == F.get(placed, i + 1)["h"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
        return F.aggregate(F.array_sort(F.transform(twice, lambda x: x["i"])), start, step, lambda a: a["n"])

    def count(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, repeats))

    return let(windows, count)


def _line_stats(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD_PATTERN))
    stats = lambda a: F.struct(F.size(a).cast("long").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"))
    return let(lines, stats)


def measures(text: Column) -> Column:
    """A struct of counts of a text, null for a null text; words are split once."""
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _covered(w).cast("long").alias("n_repeat_words")
    )
    return let(words_of(text), of_words)


def symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_lines", "n_upper", "n_stops", "n_odd", "n_marked")


def counted(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` (by names that none of the counts has) and the counts over each whole text."""
    a, b = "word_stats", "line_stats"
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(
        *keep, measures(body).alias(a), _line_stats(body).alias(b), symbols(body).alias("n_symbols"),
        (F.length(body) - F.length(F.regexp_replace(body, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        F.regexp_count(body, F.lit(r"[.!?](?:[\x20\x09-\x0D]|$)")).cast("long").alias("n_stops"),
        (F.length(body) - F.length(F.regexp_replace(body, r"[^\p{L}\p{M}\x20\x09-\x0D.,;:!?'\"()-]+", ""))).cast("long").alias("n_odd"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>](?=[\x20\x09-\x0D]|$)")).cast("long").alias("n_marked"),
    )
    return out.select(*keep, *[F.col(a)[c].alias(c) for c in ("n_words", "word_chars", "n_repeat_words")], *[F.col(b)[c].alias(c) for c in ("n_lines", "n_dup_lines")], "n_symbols", "n_upper", "n_stops", "n_odd", "n_marked")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes over the counts.  A rule abstains between its two bounds, and on texts without words."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / n
    return {
        "symbols": _vote(F.col("n_symbols") * 50 < n, F.col("n_symbols") * 10 > n),
        "repeats": _vote(F.col("n_repeat_words") * 20 < n, F.col("n_repeat_words") * 4 > n),
        "lines": _vote((F.col("n_lines") >= 3) & (F.col("n_dup_lines") == 0), F.col("n_dup_lines") * 4 > F.col("n_lines")),
        "capitals": _vote(F.col("n_upper") * 8 < F.col("word_chars"), F.col("n_upper") * 3 > F.col("word_chars")),
        "word_length": _vote((mean >= 3) & (mean <= 10), (mean < 2) | (mean > 15)),
        "sentences": _vote((F.col("n_stops") >= 2) & (F.col("n_stops") * 60 >= n), (F.col("n_words") >= 100) & (F.col("n_stops") * 400 < n)),
        "odd_characters": _vote(F.col("n_odd") * 33 < F.col("word_chars"), F.col("n_odd") * 12 > F.col("word_chars")),
        "marked_words": _vote(F.col("n_marked") * 50 < n, F.col("n_marked") * 10 > n),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[tuple[float, float]]]:
    """EM over counted vote patterns: share of good documents, and per rule (right on good, right on bad).

    No documents: the starting values.
    """
    width = len(patterns[0][0]) if patterns else 0
    total = sum(n for _, n in patterns)
    good, right, last = START_GOOD, [(START_ACCURACY, START_ACCURACY)] * width, None
    for _ in range(ROUNDS if total else 0):
        sums, mass, seen = [[PRIOR[0], PRIOR[1], PRIOR[0], PRIOR[1]] for _ in range(width)], 0.0, 0.0
        for votes, n in patterns:
            a, b = math.log(good), math.log(1 - good)
            for v, (g, w) in zip(votes, right, strict=True):
                if v:
                    a += math.log(g if v > 0 else 1 - g)
                    b += math.log(1 - w if v > 0 else w)
            p = 1 / (1 + math.exp(min(700.0, b - a)))
            seen += n * (max(a, b) + math.log1p(math.exp(-abs(a - b))))
            mass += n * p
            for s, v in zip(sums, votes, strict=True):
                if v:
                    s[0 if v > 0 else 1] += n * p
                    s[2 if v < 0 else 3] += n * (1 - p)
        good = (mass + PRIOR[0]) / (total + sum(PRIOR))
        right = [(s[0] / (s[0] + s[1]), s[2] / (s[2] + s[3])) for s in sums]
        if last is not None and abs(seen - last) <= TOLERANCE * abs(seen):
            break
        last = seen
    return good, right


def posterior(votes: list[Column], good: float, right: list[tuple[float, float]]) -> Column:
    """Probability of "good" given the votes, as an expression over vote columns."""
    odds = F.lit(math.log(good) - math.log(1 - good))
    for v, (g, w) in zip(votes, right, strict=True):
        odds = odds + F.when(v > 0, math.log(g) - math.log(1 - w)).when(v < 0, math.log(1 - g) - math.log(w)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def judge(docs: DataFrame, text: str = "text", keep_columns: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The columns asked for (default: all), the counts, ``base_failed``, ``quality`` and ``kept``; and the names that the
    results got.

    Texts are read once: the counts and the columns asked for are checkpointed between the
    counting of votes and the verdicts, so ask for narrow columns.
    """
    keep = docs.columns if keep_columns is None else keep_columns
    # the input's columns go by number, so that none can clash
    placed = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("body"))
    named = {f"vote_{k}": v for k, v in rules().items()}
    voted = cut(counted(placed, [f"k{i}" for i in range(len(keep))], "body").withColumns(named))
    names = list(named)
    patterns = [(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(*names).collect()]
    good, right = fit(patterns) if patterns else (START_GOOD, [(START_ACCURACY, START_ACCURACY)] * len(names))
    out = voted.withColumn("quality", posterior([F.col(c) for c in names], good, right)).withColumn("base_failed", base_failed())
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM))
    made: dict[str, str] = {}
    for c in (*COUNTS, *_MORE, "base_failed", "quality", "kept"):
        made[c] = free_name([*keep, *made.values()], c)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(c).alias(name) for c, name in made.items()]), made


def op3(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return judge(read_table(spark, sf_dir, "documents"), keep_columns=["doc_id"])[0].select("doc_id", *COUNTS, "base_failed", "kept", "quality")


def quality_counts(spark, sf_dir: str) -> DataFrame:
    """What op3's rules count, before they vote."""
    from .common import read_table

    return counted(read_table(spark, sf_dir, "documents"), ["doc_id"]).withColumn("base_failed", base_failed()).select("doc_id", *COUNTS, "base_failed")


COUNTS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS t(k) GROUP BY doc_id),
counts AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words FROM d JOIN l USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
"""
