import pytest
from helpers import words
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


LONG = words(30_000, 10_000_000)


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and very long texts, copies, near copies, rows that repeat, shared lines."""
    line = "A  line that many documents share"
    texts = [None, "", "   \n\t", "one two", words(300), words(300), words(300).replace("w150", "x"), words(60) + " tail", LONG, LONG + " end",
             "été " * 40, "\u2581 <s> 漢字 😀 \x00 é\u0301"]
    texts += [f"{line}\nown {i} {words(40, 1000 * i + 5000)}\n\n{line.lower()}  " for i in range(12)]
    rows = [(i, t, ["en", "fr", None][i % 3], ["b", "a", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, words(300), None, None, None), (None, None, None, None, None), (7, words(80, 77_000), "en", "a", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F
    names = ["key", "n", "r", "k", "w", "size", "draws", "copy", "shard", "position", "target", "kept", "n_words", "stratum", "cutoffs", "n_lines",
             "n_dropped", "component", "digest", "node", "start", "end", "spans", "t1", "t2", "value", "_h", "_w", "_hot", "_key"]
    return docs.select("*", *(F.lit(f"own {n}").alias(n) for n in names))


@pytest.fixture(scope="session")
def small(tmp_path_factory):
    """Rows of a frame, sorted by their text, for comparison."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=str)
