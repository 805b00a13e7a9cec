"""Listed items on a small table of their own."""

from __future__ import annotations

import duckdb

from corpusmill.plans import registry

from .sqlcheck import same

registry.load()


def test_texts_without_a_closing_word_are_not_cut(spark, tmp_path):
    """They are filtered before sentences are made; what the others list stays the same."""
    texts = ["果物は林檎、蜜柑、葡萄などがある。次の文、その次。", "a, b, c and d, e, f. " * 50, "りんご、みかん」\n」等が並ぶ", "等だけ", "x,y,z等", None, "", "東京、大阪が挙げられる。京都,奈良といった所。"]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = registry.QUERIES["listed_items"](spark, str(tmp_path))
    same(got, c, registry.ORACLE_SQL["listed_items"])
    filters = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x and "Contains" in x]
    assert any("split" not in x for x in filters)
