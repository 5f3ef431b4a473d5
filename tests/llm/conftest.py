import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" if rng.random() < 0.7 else rng.choice(["the", "of,", "Über", "naïve.", "and", "日本"]) for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Copies, near copies, shared lines and passages, nulls, empty and blank texts, one long text, ties, repeated rows."""
    rng = random.Random(7)
    texts = []
    passage = " ".join(words(rng, 60))
    line = "  A Shared Line of Over Twenty characters\t"
    for i in range(60):
        own = words(rng, rng.choice([3, 12, 40, 120, 300]))
        text = " ".join(own)
        if i % 5 == 0:
            text += "\n" + line + "\n" + " ".join(words(rng, 8))
        if i % 7 == 0:
            text = " ".join([*own[:20], passage, *own[20:]])
        texts.append(text)
    texts += [texts[3], texts[3], texts[3].replace("the", "teh", 1), texts[10] + " tail", "", None, "   \n\t ", "\n".join([line.lower()] * 3), "x", "a b c d e f g h i j " * 30]
    texts.append(" ".join(words(rng, 30_000, 20_000)) + "\n" + passage)
    texts.append("\u00a0odd\u2003space\x1c here's  two\n\n\nlines   ")
    texts += ["hello <|endoftext|> there", "<|startoftext|>A<|ENDOFTEXT|> b <|endoftext|>"]
    out = [(i * 3 + 1, t, ["en", "de", None][i % 3], ["s0", "s1", "s0", None][i % 4], len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[5], out[5]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same documents with further columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    names = ["id", "t", "c0", "fp", "cell", "bucket", "kept", "n_words", "n_lines", "copy", "length", "file", "of", "a.b", "h", "r", "label", "drop_id", "_id", "_first", "_row_id", "_stay", "copies", "shuffle_key", "kept_", "a`b", "column_0", "row", "u_", "id_"]
    return docs.select("*", *[F.lit(-7 - k).alias(n) for k, n in enumerate(names)])
