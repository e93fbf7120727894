"""Small tables with awkward rows: nulls, empty and very long texts, ties, repeats, clashing column names."""

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return [(r["doc_id"], r["text"]) for r in documents.collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward rows under columns that operators might use themselves."""
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two three four"), (4, "one two three four"), (None, "one two three four"),
        (5, "Ünïcode ﷽ 漢字 ▁ mark\x00nul"), (6, "a@b.c " * 3000), (7, "x" * 50_000), (None, None), (8, "\r\n\x0b\x0c a  b"),
    ]
    names = ["k", "fp", "score", "held_out", "label", "item_id", "n", "_toxicity", "h"]
    schema = SCHEMA + "".join(f", {n} string" for n in names)
    return spark.createDataFrame([(i, t, None, None, len(t or ""), *["extra"] * len(names)) for i, t in rows], schema)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
