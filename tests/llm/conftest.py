import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts (or from (doc_id, text, lang, source) rows), with clashing extra columns."""

    def build(rows, extra=True):
        full = []
        for i, row in enumerate(rows):
            if not isinstance(row, tuple):
                row = (i, row, "en", "s0")
            doc_id, text, lang, source = row
            full.append((doc_id, text, lang, source, len(text or "")))
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            for name in ("size", "digest", "key", "mark", "words", "label", "score", "copies", "node", "part", "line", "row_id", "component", "held_out", "features", "at", "n"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return build
