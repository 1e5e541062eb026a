import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Documents from texts; a text may come with a doc_id and a source."""
    def make(texts, extra=()):
        rows = []
        for i, t in enumerate(texts):
            doc_id, text, source = t if isinstance(t, tuple) else (i, t, f"s{i % 3}")
            rows.append((doc_id, text, "en", source, len(text or ""), *([1] * len(extra))))
        schema = ", ".join([SCHEMA, *(f"{c} int" for c in extra)])
        return spark.createDataFrame(rows, schema).repartition(3) if rows else spark.createDataFrame([], schema)
    return make
