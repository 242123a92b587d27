import random

import pytest
from llm_texts import prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and blank and long texts, ties, repeated rows and ids."""
    rng = random.Random(5)
    base = prose(rng, 120)
    long = prose(rng, 30_000, 5000)
    texts = [None, "", " \n\t ", "a", "é", "one two three four", base, base, base + " tail", long, long + "x", base.replace("w1", "v1"), "🙂 " * 50, "ab" * 300, "\n".join(["same line here"] * 9), "x" * 99, "y" * 100, "y" * 101, "# * $ % & | < >", "0 1 2 3"]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "s1"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[6], (6, "other text with the same id", "en", "s1", 5), (None, base, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows, tmp_path_factory):
    """The rows as a table, since some operators read their input twice."""
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(odd_rows, DOCS).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def clashing(spark, odd, tmp_path_factory):
    """Extra columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    names = "size rate copies host path rule verdict rid key h1 h2 label score lang_pred accepted media pcm codec n_bytes section start_byte n_tokens crosses kind lo n gram n_words base_failed kept quality length piece start offset salt arrival _n _out _rid".split()
    path = str(tmp_path_factory.mktemp("clash") / "documents.parquet")
    odd.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)]).write.parquet(path)
    return spark.read.parquet(path)
