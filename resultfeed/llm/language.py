"""Language identification (operator 10): averaged hashed subword embeddings and a linear softmax.

Subwords are byte n-grams (1 to 4 bytes) of the lower-cased text, in which everything ASCII that is
no letter counts as a word end.  Each hashes to a row of an embedding table; a text is the mean of its
rows; a linear layer and a softmax give the language.  Table and layer are trained by stochastic
gradient descent in numpy on the driver, on a bounded sample of labelled rows; a text's rows of the table move by
the gradient divided by the squared norm of their weights in the text, so that its mean moves as far whatever its
length.  A temperature fitted
on rows kept out of training calibrates the probabilities, and the same rows set the score below which
a prediction is rejected; where that would reject mostly right ones (labels that are wrong whatever the
score), it is ``ACCEPT_FROM``.  Prediction is a map over all rows: no shuffle, and whole texts in pieces.

Documented bound: at most ``PER_LANGUAGE`` texts of at most ``SAMPLE_BYTES`` bytes are drawn for each
language, by a hash of id and text; repeated rows count once.  The driver gets at most ``SAMPLE_ROWS`` texts:
with many languages each has an equal part of them.  More than ``LANGUAGES`` labels are refused.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and rejected; no labelled
rows at all: every text is ``und``; one language only: that one, with score 1.  Other columns pass
through ``identify`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import PIECE_BYTES, appended, frugal, pieces, row_sums, utf8
from .common import free_name, read_table

BITS, DIMENSIONS, ORDERS = 16, 16, (1, 2, 3, 4)
PER_LANGUAGE, SAMPLE_BYTES = 800, 200_000
SAMPLE_ROWS, LANGUAGES = 40_000, 400
#: Drawn by hash beyond the limit, since rows are counted by a sketch; the limit itself is exact.
SPARE = 1.25
EPOCHS, RATE, BATCH, CALIBRATION = 5, 2.0, 16, 5
ACCEPT_FROM, ACCEPT_PRECISION = 0.5, 0.99
#: A threshold that rejects a larger share must reject at least as many wrong predictions as right ones.
REJECTED_SHARE = 0.02
UNKNOWN = "und"

#: Bytes as they are hashed: ASCII letters and all of a multi-byte character as they are, the rest a word end.
_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def features(data: np.ndarray, bounds: np.ndarray, bits: int = BITS):
    """For each n-gram order: hashed ids of all n-grams, and their bounds by text.

    A word end is added at both ends of each text, so that every text has some n-gram.  A single text above
    ``PIECE_BYTES`` comes in several parts of each order, so that its n-grams are never all in memory.
    """
    n = len(bounds) - 1
    padded = np.full(len(data) + 2 * n, 32, np.uint8)
    at = bounds + 2 * np.arange(n + 1)
    inside = np.ones(len(padded), bool)
    inside[at[:-1]] = False
    inside[at[1:] - 1] = False
    padded[inside] = _FOLD[data]
    if n == 1 and len(data) > PIECE_BYTES:
        del inside
        for a in range(0, len(padded), PIECE_BYTES):
            part = padded[a : a + PIECE_BYTES + max(ORDERS) - 1].astype(np.uint32)
            for order in ORDERS:
                count = min(PIECE_BYTES, len(padded) - order + 1 - a)
                if count > 0:
                    code = np.zeros(count, np.uint32)
                    for k in range(order):
                        code |= part[k : k + count] << np.uint32(8 * k)
                    yield ((code + np.uint32(order)) * np.uint32(2654435761)) >> np.uint32(32 - bits), np.array([0, count])
        return
    code, ends = np.zeros(len(padded), np.uint32), at
    for order in ORDERS:
        if order > 1:
            code = code[:-1]
        code = code | (padded[order - 1 :].astype(np.uint32) << np.uint32(8 * (order - 1)))
        ids = ((code + np.uint32(order)) * np.uint32(2654435761)) >> np.uint32(32 - bits)
        whole = np.maximum(ends[1:] - ends[:-1] - (order - 1), 0)
        keep = np.ones(len(ids), bool)
        for back in range(1, order):  # n-grams that run into the next text
            over = at[1:-1] - back
            keep[over[(over >= 0) & (over < len(ids))]] = False
        yield ids[keep], np.concatenate([[0], np.cumsum(whole)])


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # 2 ** BITS x languages: the embeddings behind the linear layer
    bias: np.ndarray
    temperature: float
    accept: float

    def logits(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = len(bounds) - 1
        total, count = np.zeros((n, len(self.languages)), np.float32), np.zeros(n, np.int64)
        for ids, ends in features(data, bounds):
            total += row_sums(self.table[ids], ends)
            count += np.diff(ends)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and its calibrated probability, by text."""
        p = softmax(self.logits(data, bounds) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(best)), best].astype(np.float64)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 1) -> Model:
    """Embeddings, layer, temperature and rejection threshold from labelled texts."""
    languages = sorted(set(labels))
    if len(languages) < 2:
        return Model(languages, np.zeros((1 << BITS, len(languages)), np.float32), np.zeros(len(languages), np.float32), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.searchsorted(np.array(languages), np.array(labels))
    rows = []
    for text in pc.utf8_lower(pa.array(texts, pa.large_string())).to_pylist():  # as ``identify`` folds case
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        ids = np.concatenate([i for i, _ in features(data, np.array([0, len(data)]))])
        found, count = np.unique(ids, return_counts=True)
        rows.append((found, (count / count.sum()).astype(np.float32)))
    order = rng.permutation(len(rows))
    held = order[::CALIBRATION]
    fit = np.setdiff1d(order, held)
    table = rng.normal(0, 0.1, (1 << BITS, DIMENSIONS)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    steps, done = EPOCHS * -(-len(fit) // BATCH), 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(fit), -(-len(fit) // BATCH)):
            rate = np.float32(RATE * (1 - done / steps) / len(part))
            done += 1
            hidden = np.stack([rows[i][1] @ table[rows[i][0]] for i in part])
            wrong = softmax(hidden @ layer + bias)
            wrong[np.arange(len(part)), y[part]] -= 1
            back = wrong @ layer.T
            layer -= rate * (hidden.T @ wrong)
            bias -= rate * wrong.sum(axis=0)
            for i, g in zip(part, back, strict=True):  # each text's mean moves by the rate, however many n-grams it has
                table[rows[i][0]] -= rate * np.outer(rows[i][1] / (rows[i][1] @ rows[i][1]), g)
    model = Model(languages, (table @ layer).astype(np.float32), bias, 1.0, 0.0)
    z = np.stack([rows[i][1] @ model.table[rows[i][0]] for i in held]) + bias
    right = np.arange(len(held)), y[held]
    model.temperature = float(min(np.geomspace(0.05, 20, 61), key=lambda t: -np.log(np.maximum(softmax(z / t)[right], 1e-12)).mean()))
    p = softmax(z / model.temperature)
    score, hit = p.max(axis=1), p.argmax(axis=1) == y[held]
    model.accept = threshold(score, hit)
    return model


def threshold(score: np.ndarray, hit: np.ndarray) -> float:
    """The score from which held-back rows reach ``ACCEPT_PRECISION``, or ``ACCEPT_FROM`` where errors do not gather at low scores."""
    by = np.argsort(-score, kind="stable")
    good = np.flatnonzero(np.cumsum(hit[by]) >= ACCEPT_PRECISION * np.arange(1, len(by) + 1))
    if not len(good) or good[-1] == len(by) - 1:
        return ACCEPT_FROM
    lowest = max(ACCEPT_FROM, float(score[by][good[-1]]))
    rejected = (score < lowest) & (score >= ACCEPT_FROM)
    if rejected.sum() > REJECTED_SHARE * len(score) and hit[rejected].mean() > 0.5:
        return ACCEPT_FROM
    return lowest


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame) -> Model:
    """A model from the labelled rows that are not held out."""
    usable = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    usable = usable.where(F.octet_length("text") <= SAMPLE_BYTES).where(F.col("text").rlike(r"\p{L}")).select("text", "lang", F.xxhash64("doc_id", "text").alias("at"))
    counts = {r[0]: r[1] for r in usable.groupBy("lang").agg(F.approx_count_distinct("at")).limit(LANGUAGES + 1).collect()}
    if not counts:
        return train([], [])
    if len(counts) > LANGUAGES:
        raise ValueError(f"More than {LANGUAGES} values of lang")
    most = min(PER_LANGUAGE, SAMPLE_ROWS // len(counts))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, SPARE * most / max(n, 1)))) for k, n in sorted(counts.items())])
    # other bits than those of ``at`` itself, by which the first rows are taken
    drawn = usable.where(F.pmod(F.xxhash64("at"), F.lit(1 << 30)) < share * (1 << 30)).groupBy("lang", "at").agg(F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
    sample = drawn.withColumn("place", place).where(F.col("place") <= most).select("text", "lang", "at").toArrow().sort_by([("at", "ascending"), ("lang", "ascending")])
    return train(sample.column("text").to_pylist(), sample.column("lang").to_pylist())


def identify(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with prediction, score and acceptance; the names they got (``lang_pred``, ``score``, ``accepted``
    unless the input has such columns)."""
    names = {}
    for c in ("lang_pred", "score", "accepted"):
        names[c] = free_name([*docs.columns, *names.values()], c)
    letters = free_name([*docs.columns, *names.values()], "has_letter")
    marked = docs.withColumn(letters, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    fields = [T.StructField(names["lang_pred"], T.StringType()), T.StructField(names["score"], T.DoubleType()), T.StructField(names["accepted"], T.BooleanType())]
    languages = pa.array([*model.languages, UNKNOWN], pa.string())

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, text):
                known = np.asarray(piece.column(letters).to_numpy(zero_copy_only=False), bool)
                best, score = np.full(piece.num_rows, len(model.languages)), np.zeros(piece.num_rows)
                if len(model.languages) and known.any():
                    lower = pc.utf8_lower(piece.column(text).filter(pa.array(known)))
                    best[known], score[known] = model.predict(*utf8(lower))
                piece = piece.drop_columns([letters])
                yield appended(piece, {names["lang_pred"]: languages.take(pa.array(best)), names["score"]: pa.array(score), names["accepted"]: pa.array((best < len(model.languages)) & (score >= model.accept))})

    return marked.mapInArrow(frugal(run), T.StructType([*docs.schema.fields, *fields])), names


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is identified, same columns: a model from ``docs``, its rejections go."""
    out, names = identify(docs, fit(docs))
    return out.where(F.col(names["accepted"])).select(*docs.columns)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out, _ = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
