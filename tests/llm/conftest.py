import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size string, target string, shard string, slot string, score string, kept string, "
    "digest string, n_words string, taken string, copies string, row string, held_out string, spans string, rank string, media string, part string, edge string"
)


def odd_rows():
    """Nulls, empty, blank and very long texts, repeated rows, equal texts, one doc_id twice."""
    sentence = "The quick brown fox jumps over the lazy dog near the river bank today.\n"
    texts = [
        (1, "one two three four five six seven eight nine ten", "a"),
        (2, "One TWO three four five six seven eight nine ten", "a"),
        (2, "another text under the same number, with some more words in it", "b"),
        (3, None, "a"),
        (4, "", None),
        (5, " \t\n  ", "b"),
        (None, "a document without a number but with several words", None),
        (None, None, None),
        (6, "x" * 200_000, "c"),
        (7, sentence * 3000, "c"),
        (8, "É ñ 日本 \U0001f600 ok", "a"),
        (9, "same row", "a"),
        (9, "same row", "a"),
        (10, "same row", "b"),
    ]
    rest = ["clash"] * 17
    return [(i, t, None, s, None, *rest) for i, t, s in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
