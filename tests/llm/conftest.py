import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    def make(texts, ids=None):
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Writes given DataFrames as the tables of a folder and returns it."""

    def write(**frames):
        folder = str(tmp_path_factory.mktemp("tables"))
        for name, df in frames.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return folder

    return write
