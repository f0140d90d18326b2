"""Article browsing: filters, ranking, facets, groups and collection statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioloom.functions import text as tf
from folioloom.operators import assignment
from folioloom.operators.numbering import ranked
from folioloom.plans.registry import query
from folioloom.sources.tables import ARTICLES, ASKED, CHUNKS, TITLE, articles, asked, chunks, table

STOP = ["the", "and", "que", "der", "die", "das", "les", "des", "with", "of"]
TERMS = ["hanre", "wher", "the"]
PHRASE = "of the"


def _blob():
    return tf.normal(F.concat_ws(" ", "title", "category", "subcategory", "content"))


_BLOB = r"trim(regexp_replace(lower(concat_ws(' ', title, category, subcategory, content)), '\s+', ' ', 'g'))"


@query("F1_article_filter", f"WITH {ARTICLES} SELECT doc_id, category FROM articles WHERE contains({_BLOB}, 'of the') AND category = 'en'")
def article_filter(spark, d):
    return articles(spark, d).where(F.contains(_blob(), F.lit("of the")) & (tf.normal("category") == "en")).select("doc_id", "category")


@query("F5_term_match", rf"WITH {CHUNKS}, {ASKED}, q AS (SELECT conv_id, list_filter(list_distinct(regexp_extract_all(lower(question), '[a-z]+')), lambda t: length(t) >= 3 AND NOT list_contains({STOP}, t)) terms FROM asked) SELECT doc_id, count(*) AS chunks, count_if(contains(lower(text), 'hanre') OR contains(lower(text), 'wher')) AS matching FROM chunks WHERE EXISTS (SELECT 1 FROM q) GROUP BY doc_id")
def term_match(spark, d):
    low = F.lower("text")
    hit = F.exists(F.array(F.lit("hanre"), F.lit("wher")), lambda t: F.contains(low, t))
    return chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(hit).alias("matching"))


@query("F5_search_terms", rf"WITH {ASKED} SELECT conv_id, len(list_filter(list_distinct(regexp_extract_all(lower(question), '[a-z]+')), lambda t: length(t) >= 3 AND NOT list_contains({STOP}, t))) AS terms FROM asked")
def search_terms(spark, d):
    found = F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit("[a-z]+"), F.lit(0)))
    stop = F.array(*(F.lit(x) for x in STOP))
    return asked(spark, d).select("conv_id", F.size(F.filter(found, lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))).cast("long").alias("terms"))


@query("F21_library_filter", f"WITH {ARTICLES} SELECT doc_id, title FROM articles WHERE published AND subcategory IN ('src1', 'src2') AND contains(lower(title), 'a')")
def library_filter(spark, d):
    return articles(spark, d).where(F.col("published") & F.col("subcategory").isin("src1", "src2") & F.contains(F.lower("title"), F.lit("a"))).select("doc_id", "title")


@query("T2_article_page", f"WITH {ARTICLES} SELECT doc_id, title, n AS total FROM (SELECT doc_id, title, count(*) OVER () n FROM articles WHERE published AND category = 'fr') ORDER BY title, doc_id LIMIT 20 OFFSET 10")
def article_page(spark, d):
    """One page of a category; the limit is the feature. The total comes from an aggregate, not from a window."""
    a = articles(spark, d).where("published AND category = 'fr'")
    total = a.agg(F.count("*").alias("total"))
    return a.orderBy("title", "doc_id").offset(10).limit(20).select("doc_id", "title").crossJoin(F.broadcast(total))


def _points(x):
    return F.when(F.contains(x, F.lit(PHRASE)), 8).otherwise(0) + tf.hits(x, TERMS)


_POINTS = f"(CASE WHEN contains({_BLOB}, '{PHRASE}') THEN 8 ELSE 0 END + " + " + ".join(f"contains({_BLOB}, '{t}')::INT" for t in TERMS) + ")"


@query("T3_rank_articles", f"WITH {ARTICLES}, s AS (SELECT doc_id, category, {_POINTS} points, length(content) n FROM articles) SELECT doc_id, category, points::BIGINT AS points, row_number() OVER (PARTITION BY category ORDER BY points DESC, n DESC, doc_id) AS rank FROM s QUALIFY rank <= 25")
def rank_articles(spark, d):
    """Best 25 of each category (top-k)."""
    s = articles(spark, d).select("doc_id", "category", _points(_blob()).cast("long").alias("points"), F.length("content").alias("n"))
    w = Window.partitionBy("category").orderBy(F.desc("points"), F.desc("n"), "doc_id")
    return s.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 25").select("doc_id", "category", "points", "rank")


POPULAR = 200


@query(
    "T6_popular",
    f"""WITH RECURSIVE {ARTICLES}, terms AS (SELECT term, row_number() OVER (ORDER BY n DESC, term) AS ord FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS term, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1) QUALIFY ord <= {POPULAR}),
 cand AS (SELECT ord, doc_id FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(content), '[a-z]{{4,}}'))) AS term FROM articles WHERE published) JOIN terms USING (term)),
 lists AS (SELECT ord, list(doc_id ORDER BY doc_id) AS docs FROM cand GROUP BY ord),
 given AS (SELECT t.ord, term, coalesce(docs, []) AS docs FROM terms t LEFT JOIN lists l ON l.ord = t.ord),
 g AS (SELECT 0::BIGINT AS ord, NULL::BIGINT AS doc_id, []::BIGINT[] AS taken
  UNION ALL SELECT n.ord, list_filter(n.docs, lambda d: NOT list_contains(g.taken, d))[1], list_concat(g.taken, list_filter(n.docs, lambda d: NOT list_contains(g.taken, d))[1:1]) FROM g JOIN given n ON n.ord = g.ord + 1)
 SELECT g.ord, term, doc_id FROM g JOIN terms ON terms.ord = g.ord""",
)
def popular(spark, d):
    """For each of the most popular words of requests, in order, the first article that has it and that no word before it took, or none."""
    word = r"[a-z]{4,}"
    said = table(spark, d, "conversations").where("role = 'user'").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(word), F.lit(0))).alias("term"))
    top = said.groupBy("term").count().orderBy(F.desc("count"), "term").limit(POPULAR)
    terms = top.select("term", F.row_number().over(Window.orderBy(F.desc("count"), "term")).cast("long").alias("ord"))  # at most POPULAR rows
    words = articles(spark, d).where("published").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(word), F.lit(0)))).alias("term"))
    hits = words.join(F.broadcast(terms), "term").select("ord", F.col("doc_id").alias("rank"), F.col("doc_id").alias("item"))
    return F.broadcast(terms).join(assignment.first_free(hits, POPULAR), "ord", "left").select("ord", "term", F.col("item").alias("doc_id"))


@query("A2_collection", f"WITH {CHUNKS} SELECT source, count(DISTINCT doc_id) AS documents, count(*) AS chunks, count_if(char_start > 0) AS continued, max(chunk_index) AS last_chunk, arg_max(doc_id, struct_pack(a := length(text), b := -doc_id)) AS longest FROM chunks GROUP BY source")
def collection(spark, d):
    c = chunks(spark, d)
    return c.groupBy("source").agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.count_if(F.col("char_start") > 0).alias("continued"), F.max("chunk_index").cast("long").alias("last_chunk"), F.max_by("doc_id", F.struct(F.length("text"), -F.col("doc_id"))).alias("longest"))


@query("A3_categories", f"WITH {ARTICLES}, r AS (SELECT category, title, row_number() OVER (PARTITION BY category ORDER BY title, doc_id) k FROM articles WHERE published) SELECT a.category, count(*) AS articles, count(DISTINCT subcategory) AS subcategories, any_value(s.samples) AS samples FROM articles a JOIN (SELECT category, string_agg(title, ' ~ ' ORDER BY k) samples FROM r WHERE k <= 4 GROUP BY category) s USING (category) WHERE published GROUP BY a.category")
def categories(spark, d):
    a = articles(spark, d).where("published")
    w = Window.partitionBy("category").orderBy("title", "doc_id")
    first = a.withColumn("k", F.row_number().over(w)).where("k <= 4").groupBy("category").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "title"))), lambda x: x["title"]), " ~ ").alias("samples"))
    return a.groupBy("category").agg(F.count("*").alias("articles"), F.count_distinct("subcategory").alias("subcategories")).join(first, "category")


@query("A4_subcategories", f"WITH {ARTICLES} SELECT lower(category) AS category, lower(subcategory) AS subcategory, count(*) AS n FROM articles GROUP BY 1, 2")
def subcategories(spark, d):
    return articles(spark, d).groupBy(tf.normal("category").alias("category"), tf.normal("subcategory").alias("subcategory")).agg(F.count("*").alias("n"))


@query("A9_metadata_summary", "WITH p AS (SELECT conv_id, unnest(string_split(role || ',' || conv_id % 3, ',')) v FROM conversations) SELECT v AS value, count(*) AS uses, count(DISTINCT conv_id) AS conversations FROM p GROUP BY v")
def metadata_summary(spark, d):
    p = table(spark, d, "conversations").select("conv_id", F.explode(F.split(F.concat("role", F.lit(","), (F.col("conv_id") % 3).cast("string")), ",")).alias("value"))
    return p.groupBy("value").agg(F.count("*").alias("uses"), F.count_distinct("conv_id").alias("conversations"))


@query("A13_context_groups", rf"WITH {CHUNKS} SELECT source, lang, count(*) AS chunks, count(DISTINCT trim(regexp_replace(regexp_extract(text, '{TITLE}', 1), '\s+', ' ', 'g'))) AS titles FROM chunks GROUP BY source, lang")
def context_groups(spark, d):
    return chunks(spark, d).groupBy("source", "lang").agg(F.count("*").alias("chunks"), F.count_distinct(tf.collapse(F.regexp_extract("text", TITLE, 1))).alias("titles"))


@query("A14_page_range", f"WITH {CHUNKS} SELECT doc_id, CASE WHEN min(chunk_index) = max(chunk_index) THEN (min(chunk_index) + 1)::VARCHAR ELSE (min(chunk_index) + 1) || '-' || (max(chunk_index) + 1) END AS pages FROM chunks GROUP BY doc_id")
def page_range(spark, d):
    a, b = (F.col(x).cast("string") for x in ("a", "b"))
    g = chunks(spark, d).groupBy("doc_id").agg((F.min("chunk_index") + 1).alias("a"), (F.max("chunk_index") + 1).alias("b"))
    return g.select("doc_id", F.when(F.col("a") == F.col("b"), a).otherwise(F.concat_ws("-", a, b)).alias("pages"))


PAIRS = [("en", "src0"), ("en", "src1"), ("fr", "src2"), ("xx", "src3")]


@query("A19_configured_groups", f"WITH {ARTICLES}, pairs AS (SELECT * FROM (VALUES {', '.join(map(str, PAIRS))}) t(category, subcategory)), n AS (SELECT category, subcategory, count(*) n, min(doc_id) lead FROM articles GROUP BY 1, 2) SELECT category, subcategory, coalesce(n, 0) AS n, lead, pairs.category IS NOT NULL AS configured FROM pairs FULL JOIN n USING (category, subcategory)".replace("pairs.category IS NOT NULL AS configured", "coalesce(c, false) AS configured").replace("pairs AS (SELECT *", "pairs AS (SELECT *, true c"))
def configured_groups(spark, d):
    """Every configured pair, even without articles, and every pair found."""
    pairs = spark.createDataFrame(PAIRS, "category string, subcategory string").withColumn("c", F.lit(True))
    n = articles(spark, d).groupBy("category", "subcategory").agg(F.count("*").alias("n"), F.min("doc_id").alias("lead"))
    return pairs.join(n, ["category", "subcategory"], "full").select("category", "subcategory", F.coalesce("n", F.lit(0)).alias("n"), "lead", F.coalesce("c", F.lit(False)).alias("configured"))


@query("A20_focused_groups", f"WITH {CHUNKS} SELECT lang || ':' || source AS key, count(DISTINCT doc_id) AS sections, arg_min(substring(text, 1, 80), struct_pack(a := doc_id, b := chunk_index)) AS preview, min(chunk_index) AS low, max(chunk_index) AS high FROM chunks GROUP BY 1")
def focused_groups(spark, d):
    return chunks(spark, d).groupBy(F.concat_ws(":", "lang", "source").alias("key")).agg(F.count_distinct("doc_id").alias("sections"), F.min_by(F.substring("text", 1, 80), F.struct("doc_id", "chunk_index")).alias("preview"), F.min("chunk_index").cast("long").alias("low"), F.max("chunk_index").cast("long").alias("high"))


@query("A21_retrieved_groups", f"WITH {CHUNKS}, s AS (SELECT *, {' + '.join(f'contains(lower(text), {chr(39)}{t}{chr(39)})::INT' for t in TERMS)} points FROM chunks) SELECT source, max(points)::BIGINT AS points, arg_max(substring(text, 1, 60), struct_pack(a := points, b := -doc_id, c := -chunk_index)) AS summary, count(DISTINCT doc_id) AS sections FROM s WHERE points > 0 GROUP BY source")
def retrieved_groups(spark, d):
    s = chunks(spark, d).withColumn("points", tf.hits(F.lower("text"), TERMS)).where("points > 0")
    return s.groupBy("source").agg(F.max("points").cast("long").alias("points"), F.max_by(F.substring("text", 1, 60), F.struct("points", -F.col("doc_id"), -F.col("chunk_index"))).alias("summary"), F.count_distinct("doc_id").alias("sections"))


@query("T4_chunk_search", f"WITH {CHUNKS}, s AS (SELECT *, ({' + '.join(f'contains(lower(text), {chr(39)}{t}{chr(39)})::INT' for t in TERMS)}) / 3.0::DOUBLE score FROM chunks WHERE lang = 'en'), top AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id, chunk_index) rank FROM s QUALIFY rank <= 60), best AS (SELECT source, max(score) m FROM top GROUP BY source) SELECT source, count(*) AS kept FROM top JOIN best USING (source) WHERE score >= greatest(0.2, m - 0.45) GROUP BY source")
def chunk_search(spark, d):
    """Top 60 of each source by term share, cut at the relevance floor, counted by group."""
    s = chunks(spark, d).where("lang = 'en'").withColumn("score", tf.hits(F.lower("text"), TERMS) / F.lit(3.0))
    w = Window.partitionBy("source").orderBy(F.desc("score"), "doc_id", "chunk_index")
    top = s.withColumn("rank", F.row_number().over(w)).where("rank <= 60").withColumn("m", F.max("score").over(Window.partitionBy("source")))
    return top.where(F.col("score") >= F.greatest(F.lit(0.2), F.col("m") - 0.45)).groupBy("source").agg(F.count("*").alias("kept"))


@query("T5_keyword_search", f"WITH {CHUNKS} SELECT source, count(DISTINCT doc_id) AS articles, count(*) AS chunks FROM chunks WHERE contains(lower(text), 'hanre') OR contains(lower(text), 'wher') GROUP BY source")
def keyword_search(spark, d):
    low = F.lower("text")
    return chunks(spark, d).where(F.contains(low, F.lit("hanre")) | F.contains(low, F.lit("wher"))).groupBy("source").agg(F.count_distinct("doc_id").alias("articles"), F.count("*").alias("chunks"))


@query("T7_intent_chunks", f"WITH {CHUNKS} SELECT doc_id, chunk_index, row_number() OVER (PARTITION BY source ORDER BY doc_id, chunk_index) AS rank FROM chunks WHERE regexp_matches(text, '^[A-Z][a-z]+ing')")
def intent_chunks(spark, d):
    c = chunks(spark, d).where(F.col("text").rlike("^[A-Z][a-z]+ing")).select("source", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"))
    return ranked(c, ["source"], "doc_id", "rank", then=["chunk_index"]).drop("source")


@query("D11_display", f"WITH {ARTICLES} SELECT doc_id, upper(category) AS category, replace(title, chr(10), ' ') AS title FROM articles WHERE published")
def display(spark, d):
    return articles(spark, d).where("published").select("doc_id", F.upper("category").alias("category"), F.replace("title", F.lit("\n"), F.lit(" ")).alias("title"))


@query("D14_facets", f"WITH {ARTICLES} SELECT 'category' AS facet, category AS value FROM articles WHERE category <> '' GROUP BY 2 UNION ALL SELECT 'subcategory', subcategory FROM articles WHERE subcategory <> '' GROUP BY 2")
def facets(spark, d):
    a = articles(spark, d)
    return a.select(F.explode(F.array(F.struct(F.lit("category").alias("facet"), F.col("category").alias("value")), F.struct(F.lit("subcategory").alias("facet"), F.col("subcategory").alias("value")))).alias("x")).select("x.*").where("value <> ''").distinct()


@query("J9_related", f"WITH {ARTICLES}, p AS (SELECT doc_id, category, subcategory, row_number() OVER (PARTITION BY category, subcategory ORDER BY doc_id) r FROM articles WHERE published) SELECT a.doc_id, b.doc_id AS related, row_number() OVER (PARTITION BY a.doc_id ORDER BY b.r) AS rank FROM p a JOIN p b ON a.category = b.category AND a.subcategory = b.subcategory AND a.doc_id <> b.doc_id AND b.r <= 7 QUALIFY rank <= 6")
def related(spark, d):
    """The first six others of each article's group. Only a group's first seven can be among them, so no group is paired with itself."""
    keys = ["category", "subcategory"]
    p = articles(spark, d).where("published").select("doc_id", *keys)
    few = p.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id"))).where("r <= 7").select(*keys, F.col("doc_id").alias("related"), "r")
    w = Window.partitionBy("doc_id").orderBy("r")
    return p.join(few, keys).where("doc_id <> related").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 6").select("doc_id", "related", "rank")


@query("H2_hierarchy", "SELECT doc_id, concat_ws(' > ', nullif(lang, ''), nullif(source, ''), nullif(substring(text, 1, doc_id % 3), '')) AS path FROM documents")
def hierarchy(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat_ws(" > ", F.nullif("lang", F.lit("")), F.nullif("source", F.lit("")), F.nullif(F.substr("text", F.lit(1), (F.col("doc_id") % 3).cast("int")), F.lit(""))).alias("path"))


@query("H3_category_of_path", "WITH p AS (SELECT p_partkey, list_filter(list_transform(string_split(p_type || ' > ' || p_brand, ' > '), lambda x: trim(regexp_replace(x, '(?i)^brand', ''))), lambda x: NOT regexp_matches(x, '^[#0-9]*$')) v FROM part) SELECT p_partkey, coalesce(v[1], 'General') AS category FROM p")
def category_of_path(spark, d):
    parts = F.transform(F.split(F.concat_ws(" > ", "p_type", "p_brand"), r"\s*>\s*"), lambda x: F.trim(F.regexp_replace(x, "(?i)^brand", "")))
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.get(F.filter(parts, lambda x: ~x.rlike("^[#0-9]*$")), F.lit(0)), F.lit("General")).alias("category"))


@query("H4_display_path", f"WITH {ARTICLES} SELECT doc_id, CASE WHEN starts_with(lower(title), 'the') THEN category || ' > ' || subcategory ELSE category END AS path FROM articles")
def display_path(spark, d):
    return articles(spark, d).select("doc_id", F.when(F.startswith(F.lower("title"), F.lit("the")), F.concat_ws(" > ", "category", "subcategory")).otherwise(F.col("category")).alias("path"))


@query("H11_admin_articles", f"WITH {ARTICLES} SELECT doc_id, title, published, row_number() OVER (PARTITION BY subcategory ORDER BY doc_id DESC) AS rank FROM articles")
def admin_articles(spark, d):
    a = articles(spark, d).select("doc_id", "title", "published", "subcategory")
    return ranked(a, ["subcategory"], "doc_id", "rank", descending=True).drop("subcategory")


@query("H12_compact", r"SELECT conv_id, turn, substring(text, 1, 200) AS text, len(list_slice(string_split(text, ' '), 1, 30)) AS words FROM conversations")
def compact(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.substring("text", 1, 200).alias("text"), F.size(F.slice(F.split("text", " "), 1, 30)).cast("long").alias("words"))


@query("R10_article_rows", f"WITH {ARTICLES} SELECT doc_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, '/articles/' || doc_id AS url, published FROM articles")
def article_rows(spark, d):
    return articles(spark, d).select("doc_id", tf.slug("title").alias("slug"), F.concat(F.lit("/articles/"), F.col("doc_id").cast("string")).alias("url"), "published")


@query("U4_bulk_publish", f"WITH {ARTICLES}, k AS (SELECT sha1(content) h, min(doc_id) lead FROM articles GROUP BY 1) SELECT doc_id, CASE WHEN length(content) < 50 THEN 'too_short' WHEN doc_id <> lead THEN 'duplicate' WHEN published THEN 'already_published' ELSE 'created' END AS code FROM articles JOIN k ON sha1(content) = h")
def bulk_publish(spark, d):
    """The outcome of publishing each article: gates first, then duplicates, then what is there already."""
    a = articles(spark, d).withColumn("h", F.sha1("content"))
    lead = a.groupBy("h").agg(F.min("doc_id").alias("lead"))
    code = F.when(F.length("content") < 50, "too_short").when(F.col("doc_id") != F.col("lead"), "duplicate").when(F.col("published"), "already_published").otherwise("created")
    return a.join(lead, "h").select("doc_id", code.alias("code"))


@query("U5_unpublish", f"WITH {ARTICLES} SELECT doc_id, published AND subcategory <> 'src3' AS published, published AND subcategory = 'src3' AS changed FROM articles")
def unpublish(spark, d):
    return articles(spark, d).select("doc_id", (F.col("published") & (F.col("subcategory") != "src3")).alias("published"), (F.col("published") & (F.col("subcategory") == "src3")).alias("changed"))
