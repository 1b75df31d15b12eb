"""Small frames that every operator must take without crashing."""

from pyspark.sql import functions as F

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("block", "fp", "key", "slice", "shard", "good", "host", "path", "rank", "lost", "component_id", "kept")


def docs_of(spark, texts, lang="en"):
    rows = [(k, t, lang, f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing extra columns."""
    words = "the cat sat on the mat and saw the dog run over a hill of sand by the sea while it was warm "
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \n\t\n ", None, None, 5),
        (None, words * 4, "en", "b", 1),
        (None, None, None, None, None),
        (5, words * 4, "en", "b", 1),
        (5, words * 4, "en", "b", 1),
        (5, "another text under the same number " * 5, "fr", "b", 1),
        (6, (words * 400).strip(), "en", "c", 1),
        (7, "x" * 30_000, "xx", "c", 30_000),
        (8, "one", "en", "c", 3),
        (9, "naïve café – 漢字 ́ ½ ﬁn İstanbul", "fr", None, 5),
    ]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    for k, name in enumerate(EXTRA):
        df = df.withColumn(name, F.lit(k))
    return df


def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
