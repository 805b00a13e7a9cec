from __future__ import annotations

import pytest

SCHEMA = "extra string, text string, row long, doc_id long, lang string, source string, h long, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), among columns whose names the operators use inside."""

    def of(rows):
        full = [("x", r[1], 7, r[0], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", 5, 1) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return of


#: Nulls, empty and blank texts, a very long one, ties and a repeated row.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "Ab cd"), (5, "ab CD"), (6, "word " * 60_000), (4, "Ab cd"), (7, "x"), (8, None)]
