import pytest


@pytest.fixture(scope="session")
def spark(spark, tmp_path_factory):
    """The session of all tests; intermediate tables go below a folder of this run."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        from servicelens import session

        folder = str(tmp_path_factory.mktemp("shared"))
        session._fallback_dirs[spark.sparkContext.applicationId] = folder
    return spark


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A table of documents of (doc_id, text) or (doc_id, text, lang) with two columns of clashing names."""

    def make(rows, extra=True):
        full = [(*r, *(None,) * (2 - len(r)))[:2] + (r[2] if len(r) > 2 else None, None, len(r[1] or "")) for r in rows]
        frame = spark.createDataFrame(full, DOCS)
        if extra:
            frame = frame.selectExpr("*", "1 AS key", "'x' AS fp", "2 AS bucket", "3 AS piece", "4 AS rank")
        return frame

    return make
