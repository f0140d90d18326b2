"""Scalar text operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioloom.functions import text as tf
from folioloom.operators import matching
from folioloom.plans.registry import query
from folioloom.sources.tables import ARTICLES, LINES, articles, lines, table

REPLACED = [("the ", "THE "), ("THE of", "the_of"), ("|", " / ")]
SPLITS = [("th", "er|en|is"), ("en", "ti|de"), ("qu", "e|i")]
HEADERS = ["ver", "einer", "queder", "nander", "that erea of", "the tion", "on the ing"]
FEE = r"(?i)^\s*(none|free|n/?a)\s*$"
MARKER = "----EXTRACTED METADATA----"


def docs(spark, d):
    return table(spark, d, "documents")


def _each(name: str, make, sql: str) -> None:
    """One column computed from each document's text."""

    def run(spark, d):
        return docs(spark, d).select("doc_id", make("text").alias("value"))

    query(name, f"SELECT doc_id, {sql} AS value FROM documents")(run)


_NORMAL = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
_TIDY = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


_OUT = r"[^\p{L}\p{N}_]"  # RE2 has only ASCII word bounds; these are bounds for all letters


def _letters(x: str) -> str:
    for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        for _ in range(2):  # neighbours share the character between them
            x = rf"regexp_replace({x}, '(^|{_OUT})([A-Za-z]*?){c}{{3,}}($|{_OUT})', '\1\2{c}\3', 'g')"
    return x


def _many(x: str) -> str:
    for a, b in REPLACED:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _rejoined(x: str) -> str:
    for a, b in SPLITS:
        for _ in range(2):
            x = rf"regexp_replace({x}, '(?i)(^|{_OUT})({a})\s+({b})($|{_OUT})', '\1\2\3\4', 'g')"
    return x


_each("P1_normal", tf.normal, _NORMAL)
_each("P2_normal_ascii", tf.normal_ascii, "trim(regexp_replace(replace(lower(text), 'ñ', 'n'), '[^a-z0-9]+', ' ', 'g'))")
_each("P3_title_key", tf.title_key, "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))")
_each("P5_tidy", tf.tidy, _TIDY.format("text"))
_each("P6_join_hyphens", tf.join_hyphens, r"regexp_replace(text, '(\w)-\n(\w)', '\1\2', 'g')")
_each("P7_replace_many", lambda c: tf.replace_many(c, REPLACED), _many("text"))
_each("P8_rejoin", lambda c: tf.rejoin(c, SPLITS), _rejoined("text"))
_each("P9_collapse_letters", lambda c: tf.collapse_letters(c), _letters("text"))
_each("P15_display", lambda c: tf.strip(F.regexp_replace(F.regexp_replace(tf.join_hyphens(c), "[ \t]+", " "), r"\n{3,}", "\n\n")), r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(\w)-\n(\w)', '\1\2', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')")
_each("P18_word_count", lambda c: F.size(tf.words(c)).cast("long"), r"len(regexp_extract_all(text, '\S*[\p{L}\p{N}_]\S*'))")
_each("P20_slug", lambda c: tf.slug(F.substring(c, 1, 80)), "regexp_replace(regexp_replace(lower(substring(text, 1, 80)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')")
_each("P30_numbered_prefix", lambda c: F.regexp_replace(c, r"^(\s*(\d+|[a-zA-Z])[.)]\s+)+", ""), r"regexp_replace(text, '^(\s*(\d+|[a-zA-Z])[.)]\s+)+', '')")
_each("P10_form_labels", lambda c: F.regexp_replace(F.regexp_replace(c, tf.edged(r"(?i)\blicensed?\s+under\b"), "License:"), tf.edged(r"(?i)\bversion\s+(\d)"), "V$1"), r"regexp_replace(regexp_replace(text, '(?i)\blicensed?\s+under\b', 'License:', 'g'), '(?i)\bversion\s+(\d)', 'V\1', 'g')")
_each("P12_clean_pipeline", lambda c: tf.tidy(F.regexp_replace(tf.replace_many(tf.collapse_letters(tf.rejoin(tf.replace_many(tf.join_hyphens(c), REPLACED), SPLITS)), REPLACED), r"[-_=]{4,}", "\n")), _TIDY.format(r"regexp_replace(" + _many(_letters(_rejoined(_many(r"regexp_replace(text, '(\w)-\n(\w)', '\1\2', 'g')")))) + r", '[-_=]{4,}', chr(10), 'g')"))


@query("P4_match_keys", r"SELECT page_id, lower(trim(regexp_replace(regexp_replace(url, '^\s*\d+[.)]\s*', ''), '\s+', ' ', 'g'))) AS title, lower(trim(regexp_replace(string_split_regex(url, '[/\\]')[-1], '\s+', ' ', 'g'))) AS filename FROM pages")
def match_keys(spark, d):
    return table(spark, d, "pages").select("page_id", tf.match_title("url").alias("title"), tf.match_filename("url").alias("filename"))


@query("P11_fuzzy_headers")
def fuzzy_headers(spark, d):
    """Cells of piped lines that are nearly a known header, with the closest one. The measure is no SQL function, so it is tested against difflib."""
    cells = lines(spark, d).where(F.contains("line", F.lit("|"))).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.posexplode(F.split("line", r"\|")).alias("cell_no", "cell"))
    found = matching.closest_headers(cells.withColumn("cell_no", F.col("cell_no").cast("long")), "cell", HEADERS)
    return found.select("doc_id", "line_no", "cell_no", "header", (F.floor(F.col("ratio") * 1000 + 0.5) / 1000).alias("ratio"))


def _edges(name: str, edge: int, share: float, protect: str | None) -> None:
    """Lines that stand at the edge of many documents of a source; each document is one page of its source."""
    guard = "" if protect is None else f" AND NOT regexp_matches(line, '{protect}')"
    sql = rf"""WITH {LINES}, filled AS (SELECT doc_id, source, line_no, trim(regexp_replace(line, '\s+', ' ', 'g')) line FROM lines WHERE trim(regexp_replace(line, '\s+', ' ', 'g')) <> ''),
 placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) a, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) b FROM filled),
 pages AS (SELECT source, count(DISTINCT doc_id) n FROM filled GROUP BY source),
 hits AS (SELECT source, line, count(DISTINCT doc_id) pages FROM placed WHERE (a <= {edge} OR b <= {edge}){guard} GROUP BY source, line)
 SELECT source, line, pages FROM hits JOIN pages USING (source) WHERE n >= 2 AND hits.pages >= greatest(2, floor({share} * n))"""

    @query(name, sql.replace("SELECT source, line, pages FROM hits", "SELECT source, line, hits.pages AS pages FROM hits"))
    def run(spark, d):
        from pyspark.sql import Window

        filled = lines(spark, d).withColumn("line", tf.collapse("line")).where("line <> ''")
        w = Window.partitionBy("doc_id")
        placed = filled.withColumn("a", F.row_number().over(w.orderBy("line_no"))).withColumn("b", F.row_number().over(w.orderBy(F.desc("line_no"))))
        pages = filled.groupBy("source").agg(F.count_distinct("doc_id").alias("n"))
        near = placed.where(f"a <= {edge} OR b <= {edge}")
        if protect is not None:
            near = near.where(~F.col("line").rlike(protect))
        found = near.groupBy("source", "line").agg(F.count_distinct("doc_id").alias("pages"))
        return found.join(pages, "source").where((F.col("n") >= 2) & (F.col("pages") >= F.greatest(F.lit(2), F.floor(F.lit(share) * F.col("n"))))).select("source", "line", "pages")


_edges("P13_repeated_edges", 3, 0.05, None)
_edges("P14_repeated_edges_guarded", 8, 0.04, "^The ")


@query("P16_sentences", r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+([A-Z"''(])', '\1' || chr(1) || '\2', 'g'), chr(1))) x FROM documents)
 SELECT doc_id, count(*) AS sentences, max(length(regexp_replace(x, '^\s+|\s+$', '', 'g'))) AS longest FROM s WHERE regexp_replace(x, '^\s+|\s+$', '', 'g') <> '' GROUP BY doc_id""")
def sentence_counts(spark, d):
    s = docs(spark, d).select("doc_id", tf.sentences("text").alias("s"))
    return s.where(F.size("s") > 0).select("doc_id", F.size("s").cast("long").alias("sentences"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"))


def _cut_sql(limit: int, least: float) -> str:
    x = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
    head = f"substring({x}, 1, {limit})"
    at = rf"regexp_extract({head}, '(?s)^(.*)\s', 1)"
    return f"CASE WHEN length({x}) <= {limit} THEN {x} ELSE rtrim(CASE WHEN length({at}) >= {int(limit * least)} THEN {at} ELSE {head} END) || '...' END"


for _name, _limit, _least in (("P17a_summary", 350, 0.6), ("P17b_preview", 180, 0.0), ("P17c_unit_preview", 280, 0.5), ("P17d_message_preview", 140, 0.4)):
    _each(_name, lambda c, n=_limit, s=_least: tf.cut_at_space(c, n, s), _cut_sql(_limit, _least))


@query("P19_citation", "SELECT doc_id, coalesce(nullif(doc_id % 7, 0), nullif(n_chars % 5, 0), 1)::BIGINT AS page, coalesce(nullif(source, ''), 'unknown') AS section, CASE WHEN length(text) > 400 THEN substring(text, 1, 400) || '...' ELSE text END AS excerpt FROM documents")
def citation(spark, d):
    page = F.coalesce(F.nullif(F.col("doc_id") % 7, F.lit(0)), F.nullif(F.col("n_chars") % 5, F.lit(0)), F.lit(1)).cast("long")
    excerpt = F.when(F.length("text") > 400, F.concat(F.substring("text", 1, 400), F.lit("..."))).otherwise(F.col("text"))
    return docs(spark, d).select("doc_id", page.alias("page"), F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("section"), excerpt.alias("excerpt"))


@query("P21_stable_id", r"SELECT doc_id, sha1(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) || '|' || lower(regexp_replace(lang, '^\s+|\s+$', '', 'g')) || '|' || lower(regexp_replace(substring(text, 1, 40), '^\s+|\s+$', '', 'g'))) AS id FROM documents")
def stable_ids(spark, d):
    return docs(spark, d).select("doc_id", tf.stable_id("source", "lang", F.substring("text", 1, 40)).alias("id"))


@query("P22_keywords", r"""WITH k AS (SELECT event_id, list_filter(list_transform(string_split(event_type || ', ' || user_id || ',,' || props, ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') k FROM events) SELECT event_id, len(k) AS n, k[1] AS lead, k[-1] AS last FROM k""")
def keyword_lists(spark, d):
    raw = F.concat("event_type", F.lit(", "), F.col("user_id").cast("string"), F.lit(",,"), F.col("props"))
    k = table(spark, d, "events").select("event_id", tf.keywords(raw).alias("k"))
    return k.select("event_id", F.size("k").cast("long").alias("n"), F.element_at("k", 1).alias("lead"), F.element_at("k", -1).alias("last"))


@query("P23_embedded_metadata", f"""WITH c AS (SELECT event_id, event_type || chr(10) || '{MARKER}' || props AS content FROM events) SELECT event_id, string_split(content, '{MARKER}')[1] AS body, (string_split(content, '{MARKER}')[2]::JSON ->> '$.k')::BIGINT AS k FROM c""")
def embedded_metadata(spark, d):
    content = F.concat("event_type", F.lit("\n" + MARKER), "props")
    parts = F.split(content, MARKER, 2)
    return table(spark, d, "events").select("event_id", parts[0].alias("body"), F.from_json(parts[1], "k long")["k"].alias("k"))


# Metadata as it comes: every seventh broken, every fifth nested, every third with a list.
_META = "CASE WHEN event_id % 7 = 0 THEN '{\"k\": ' || event_id WHEN event_id % 5 = 0 THEN '{\"k\": {\"deep\": ' || event_id || '}, \"kind\": \"' || event_type || '\"}' WHEN event_id % 3 = 0 THEN '{\"tags\": [\"a\", \"' || event_type || '\"], \"k\": ' || event_id || '}' ELSE props END"


@query(
    "P23_variant_metadata",
    f"""WITH m AS (SELECT event_id, {_META} AS meta FROM events), j AS (SELECT event_id, CASE WHEN json_valid(meta) THEN meta::JSON END AS v FROM m)
 SELECT event_id, v IS NOT NULL AS sound, try_cast(v ->> '$.k' AS BIGINT) AS k, try_cast(v ->> '$.k.deep' AS BIGINT) AS deep, v ->> '$.kind' AS kind, v ->> '$.tags[1]' AS tag FROM j""",
)
def variant_metadata(spark, d):
    """Metadata of unknown shape, parsed once; what is malformed is null, and so is a path that is not there or of another type."""
    v = F.try_parse_json(F.expr(_META))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    return table(spark, d, "events").select("event_id", v.alias("v")).select("event_id", F.col("v").isNotNull().alias("sound"), get("$.k", "bigint").alias("k"), get("$.k.deep", "bigint").alias("deep"), get("$.kind", "string").alias("kind"), get("$.tags[1]", "string").alias("tag"))


LANGUAGES = {"en": "English", "fr": "French", "de": "German", "es": "Spanish"}


@query("P24_canonical_names", "SELECT doc_id, CASE lang " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LANGUAGES.items()) + " ELSE lang END AS language FROM documents")
def canonical_names(spark, d):
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return docs(spark, d).select("doc_id", F.coalesce(F.try_element_at(names, F.col("lang")), F.col("lang")).alias("language"))


@query("P25_title_from_filename", r"""WITH p AS (SELECT page_id, string_split(trim(regexp_replace(regexp_replace(regexp_replace(string_split(url, '/')[-1], '\.[^.]*$', ''), '[_-]+', ' ', 'g'), '\s+', ' ', 'g')), ' ') w FROM pages)
 SELECT page_id, array_to_string(list_transform(w, lambda x: CASE WHEN x = lower(x) THEN upper(substring(x, 1, 1)) || substring(x, 2) ELSE x END), ' ') AS title FROM p""")
def titles_from_urls(spark, d):
    return table(spark, d, "pages").select("page_id", tf.title_case_stem("url").alias("title"))


@query("P26_labels", "SELECT doc_id, source || ' (' || upper(lang) || ', ' || n_chars || ' characters)' AS label, '/documents/' || doc_id || CASE WHEN doc_id % 7 > 0 THEN '#page=' || (doc_id % 7) ELSE '' END AS url FROM documents")
def labels_of(spark, d):
    page = F.col("doc_id") % 7
    return docs(spark, d).select("doc_id", F.format_string("%s (%s, %d characters)", "source", F.upper("lang"), "n_chars").alias("label"), F.concat(F.lit("/documents/"), F.col("doc_id").cast("string"), F.when(page > 0, F.concat(F.lit("#page="), page.cast("string"))).otherwise("")).alias("url"))


@query("P27_fees", "WITH f AS (SELECT p_partkey, CASE WHEN p_size < 5 THEN 'free' WHEN p_size < 20 THEN p_size::VARCHAR ELSE 'PHP ' || p_size || '.00' END fee FROM part) SELECT p_partkey, CASE WHEN regexp_matches(fee, '(?i)^\\s*(none|free|n/?a)\\s*$') THEN 'None' WHEN regexp_matches(fee, '^\\d{1,3}$') THEN NULL ELSE regexp_replace(fee, '(?i)^php\\s*', 'P') END AS fee FROM f".replace("\\\\", "\\"))
def fees(spark, d):
    """Fee text in one form; a bare page number is none."""
    fee = F.when(F.col("p_size") < 5, "free").when(F.col("p_size") < 20, F.col("p_size").cast("string")).otherwise(F.concat(F.lit("PHP "), F.col("p_size").cast("string"), F.lit(".00")))
    p = table(spark, d, "part").select("p_partkey", fee.alias("fee"))
    return p.select("p_partkey", F.when(F.col("fee").rlike(FEE), "None").when(F.col("fee").rlike(r"^\d{1,3}$"), None).otherwise(F.regexp_replace("fee", r"(?i)^php\s*", "P")).alias("fee"))


TIME = r"(\d+\s+(?:minutes?|hours?|days?)(?:\s*(?:and|,)?\s*\d+\s+(?:minutes?|hours?|days?))*)"


@query("P28_total_line", rf"WITH t AS (SELECT l_orderkey, l_linenumber, 'TOTAL: ' || l_quantity::INT || '.00 ' || (l_linenumber + 1) || ' hours and ' || (l_orderkey % 50 + 2) || ' minutes' AS s FROM lineitem) SELECT l_orderkey, l_linenumber, trim(regexp_replace(regexp_replace(s, '{TIME}', ''), '^TOTAL:\s*', '')) AS fee, regexp_extract(s, '{TIME}', 1) AS duration FROM t")
def total_line(spark, d):
    """Fee and duration of a total line: the first run of times, and what remains."""
    s = F.concat(F.lit("TOTAL: "), F.col("l_quantity").cast("int").cast("string"), F.lit(".00 "), (F.col("l_linenumber") + 1).cast("string"), F.lit(" hours and "), (F.col("l_orderkey") % 50 + 2).cast("string"), F.lit(" minutes"))
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", s.alias("s")).withColumn("duration", F.regexp_extract("s", TIME, 1))
    return t.select("l_orderkey", "l_linenumber", F.trim(F.regexp_replace(F.replace("s", "duration", F.lit("")), r"^TOTAL:\s*", "")).alias("fee"), "duration")


@query("P29_time_and_person", rf"WITH t AS (SELECT s_suppkey, (s_nationkey + 2) || ' minutes ' || s_name AS s FROM supplier) SELECT s_suppkey, regexp_extract(s, '^{TIME}\s*(.*)$', 1) AS time, regexp_extract(s, '^{TIME}\s*(.*)$', 2) AS person FROM t")
def time_and_person(spark, d):
    t = table(spark, d, "supplier").select("s_suppkey", F.concat((F.col("s_nationkey") + 2).cast("string"), F.lit(" minutes "), "s_name").alias("s"))
    return t.select("s_suppkey", F.regexp_extract("s", rf"^{TIME}\s*(.*)$", 1).alias("time"), F.regexp_extract("s", rf"^{TIME}\s*(.*)$", 2).alias("person"))


__all__ = ["ARTICLES", "articles"]
