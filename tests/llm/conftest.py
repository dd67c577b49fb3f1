import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "wide river stones carry old songs under the bridge " * 6000


def awkward_rows():
    """Nulls in every column, empty and blank texts, a very long text, repeated rows."""
    plain = "the quick brown fox jumps over the lazy dog near the old stone bridge today"
    return [
        (1, plain, "en", "a", 10), (1, plain, "en", "a", 10), (2, plain, "en", None, None),
        (3, None, "en", "a", 0), (4, "", None, "b", 0), (5, " \t\n\v\f\r ", "fr", "b", 3),
        (6, LONG, "en", "a", len(LONG)), (None, "no identifier here at all", "en", "c", 5),
        (None, None, None, None, None), (7, "é" * 50 + " ▁ ß", "fr", "c", 1), (8, "1234 5678", "en", "", 2),
        (9, "x" * 5000, "en", "c", 5000),
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCUMENTS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture()
def tables(spark, tmp_path):
    """Writes frames as the tables of a data folder and returns the folder."""
    def write(**frames):
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)
    return write
