"""Titles of very many words: what is asked of them must not go one call deeper a word."""

import re

import duckdb
import pytest

from folioloom.operators import rules
from folioloom.plans import decisions, load, quality

WORDS = 5_000
TITLES = ["Abc " * WORDS + "x", "Abc " * WORDS + "Y", "Of The", "Of the", "A", "Äb Cd", "A ", "A  ", "One  Two", ""]


@pytest.fixture(scope="module")
def long_titles(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("long")
    texts = [f"{t}. The board met, and then it ended." for t in TITLES] + ["Abc " * WORDS, "1. Abc\n" * WORDS, "a | b\n" * WORDS]
    spark.createDataFrame([(i + 1, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["A10_review_groups", "A11_rescue_summary", "A12_funnel", "C29_tag_units", "C31_decision", "C25_candidate_score", "H13_client_bucket"])
def test_long_titles(spark, long_titles, name):
    df = load().QUERIES[name](spark, long_titles)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{long_titles}/documents.parquet/*.parquet'")
    want = con.sql(load().SQL[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)


def test_no_condition_repeats_a_group_that_gives_back():
    said = [c for rows in (quality.SCORE, quality.USEFUL, quality.BUCKETS, decisions.SERVICE, decisions.TAGS, decisions.FINAL, decisions.PUBLISH) for c, *_ in rows] + [c for _, c in [*quality.REASONS, *decisions.FLAGS, *decisions.GATE, *decisions.BLOCKERS]]
    assert not [c for c in said if re.search(r"\)(?:[+*](?![+])|\{\d*,\d*\}(?![+]))", rules.in_spark(c))]
