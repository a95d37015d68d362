import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) or longer tuples."""

    def make(rows):
        full = [tuple(r) + (None,) * (5 - len(r)) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Writes tables as a data folder."""

    def make(**tables):
        path = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.coalesce(2).write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return make
