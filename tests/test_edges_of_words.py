"""Word edges beside letters that are not ASCII, as the SQL tells them."""

import duckdb
import pytest

from folioloom.plans import load

TEXTS = ["leèauxou menten entre", "laéier en eaux queen", "derü tionne ouai long", "le mot est grand ici", "une chose ordinaire éde", "ending with éof. more", "öthe big words here", "theß (the) rest", "édé licensed underé", "ölicense 3. x 4. y", "ßversion 3 of it", "abc defg", "ABCDE FGHI\x0bJK", "twelve chars\x85", "d\xe9 d\xe9de de\xe9"]


@pytest.mark.parametrize("name", ["F11_title_noise", "F13_title_flags", "F19_document_kind_gate", "C6_document_type", "C28_intents", "P10_form_labels"])
def test_word_edges(spark, tmp_path, name):
    rows = [(i + 1, t, "fr", "web", len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(load().SQL[name])
    got = load().QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
