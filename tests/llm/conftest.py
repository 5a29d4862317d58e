import pytest

from corpusloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests-llm", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def docs_of(spark):
    def make(rows, extra=False):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:
            df = df.selectExpr("doc_id", "text", "'x' AS shard", "1 AS size", "'c' AS component", "true AS kept")
        return df

    return make
