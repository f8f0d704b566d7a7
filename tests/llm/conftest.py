import pytest
from pyspark.sql import functions as F

LONG = "alpha beta gamma. " * 20_000

# doc_id, text, lang, source: nulls, empty and blank texts, a very long one, repeated rows and ids
ROWS = [
    (7, "The cat sat on the mat and looked at the moon for a while", "en", "a"),
    (7, "The cat sat on the mat and looked at the moon for a while", "en", "a"),
    (7, "another text under the same id", "en", "b"),
    (None, "a row without an id", "en", None),
    (None, None, None, None),
    (3, None, "de", "b"),
    (4, "", "fr", "c"),
    (5, " \n\t ", "fr", "c"),
    (6, LONG, None, "a"),
    (9, "12345 --- !!! ###", "en", ""),
    (10, "one", "es", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
# names that the operators use for themselves
CLASHES = ["h", "fp", "cell", "size", "score", "copies", "bucket", "words", "s", "epochs", "cutoff", "row", "kept",
           "component_id", "root", "node", "low", "keep", "n_chars", "label", "target", "held_out", "start", "shard", "__rulefit_stats",
           "border", "draw", "terms", "seg", "codes", "m", "key", "bucket_", "one", "place"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("x"))
    return df.cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def by_id(rows):
    return sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(r)))
