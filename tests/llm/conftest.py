import pytest

#: Columns whose names the operators use themselves.
EXTRA = ["size", "row", "class", "whole", "key", "score", "print", "shard", "kept"]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, and extra columns with clashing names."""
    plain = "the small river runs past the old mill and the people of the town walk along it every day of the week in spring, "
    rows = [
        (1, plain * 3, "en", "a"), (1, plain * 3, "en", "a"), (2, plain * 3, "en", None), (3, None, "en", "a"), (4, "", None, "b"),
        (5, " \t\n", "en", "b"), (6, "12 345 !!", None, None), (None, "something else about the sea and its ships and harbours, " * 3, "en", "b"), (None, None, None, None),
        (7, "der kleine fluss und die alte muehle in der stadt, " * 4, "de", "b"), (8, "x" * 300_000 + " " + "word list " * 60_000, "en", "c"),
        (9, "Kurz.", "de", "c"), (10, "\u00e9t\u00e9 \ud55c\uad6d\uc5b4 \U0001f600 <|endoftext|> don't", None, "c"),
    ]
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    for name in EXTRA:
        docs = docs.selectExpr("*", f"doc_id AS {name}")
    return docs


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def folder(tmp_path_factory):
    """Writes DataFrames as tables of a folder: folder(documents=df, ...) gives its path."""

    def write(**tables) -> str:
        path = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return write
