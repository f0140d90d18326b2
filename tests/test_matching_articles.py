"""Matching articles against their SQL where a title or a field is missing, short, or inside another."""

import duckdb
import pytest

from folioloom.plans import load

#: text, lang, source, quality
ROWS = [
    ("fee list\nx", "en", "web", 1), ("the fee list of may\ny", "en", "mail", 0), ("fee\nz", "en", "web", 1), ("new fee", "fr", "web", 0), (None, "en", "web", 0), ("", "en", "web", 1),
    ("a b c d", "de", "web", 1), ("x a b c d y", "de", "mail", 0), ("a b c d", "es", "web", 0), ("a b  C-D\n|", "de", None, 0), ("b c e", "fr", "mail", None), ("x b c e", "fr", "mail", 1), ("bc", None, "web", 1), ("feel", "en", "mail", 0),
]


@pytest.mark.parametrize("name", ["J5_matching_article", "J6_existing_match"])
def test_matches(spark, tmp_path, name):
    spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, (t, lang, source, _) in enumerate(ROWS)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, (*_, q) in enumerate(ROWS)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(load().SQL[name])
    got = load().QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want.fetchall(), key=key)
