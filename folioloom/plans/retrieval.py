"""Vector top-k, rule reranking with reasons, context selection and answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioloom.functions import text as tf
from folioloom.operators.rules import Rule, added, added_sql, decided, decided_sql, first, first_sql, holds, holds_sql, scored, scored_sql, spaced, spaced_sql
from folioloom.operators.vectors import nearest
from folioloom.plans.registry import query
from folioloom.sources.shared import written
from folioloom.sources.tables import ASKED, CHUNKS, asked, chunks, table

_COS = "list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"
_HITS = f"hits AS (SELECT q.vec_id query_id, e.vec_id, e.label, floor(greatest(0, {_COS}) * 1e4 + 0.5) / 1e4 score FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 100 = 0), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM hits QUALIFY rank <= 30)"


def hits(spark, d, k=30):
    """The stated query set (ids divisible by 100) against all rows."""
    e = table(spark, d, "embeddings")
    return nearest(e.where("vec_id % 100 = 0"), e, k)


@query("T1_nearest", f"WITH {_HITS} SELECT query_id, vec_id, score, rank FROM ranked WHERE rank <= 10")
def top_k(spark, d):
    return hits(spark, d, 10).select("query_id", "vec_id", "score", "rank")


@query("W14_ranks", f"WITH {_HITS} SELECT query_id, vec_id, label, score AS original_score, rank AS original_rank, score - lag(score, 1, score) OVER (PARTITION BY query_id ORDER BY rank) AS step FROM ranked WHERE rank <= 10")
def ranks(spark, d):
    """Ranks with scores, and how far each lies below the one before."""
    before = F.lag("score", 1).over(Window.partitionBy("query_id").orderBy("rank"))
    return hits(spark, d, 10).select("query_id", "vec_id", "label", F.col("score").alias("original_score"), F.col("rank").alias("original_rank"), (F.col("score") - F.coalesce(before, "score")).alias("step"))


@query("F6_relevant", f"WITH {_HITS} SELECT query_id, vec_id FROM (SELECT *, max(score) OVER (PARTITION BY query_id) m FROM ranked) WHERE score >= greatest(0.2, m - 0.45)")
def relevant(spark, d):
    top = F.max("score").over(Window.partitionBy("query_id"))
    return hits(spark, d).withColumn("m", top).where(F.col("score") >= F.greatest(F.lit(0.2), F.col("m") - 0.45)).select("query_id", "vec_id")


#: Features of a question or passage: what words show them, and what it is worth if both have one.
FEATURES = [
    Rule("english", any=("the", "and", "of"), blocked=("der", "que"), weight=0.22), Rule("german", any=("der", "die", "das", "und"), weight=0.18), Rule("french", any=("le", "les", "des", "une"), weight=0.32),
    Rule("spanish", any=("el", "los", "las", "una"), weight=0.28), Rule("definite", any=("the", "der", "le", "la"), weight=0.28), Rule("negated", any=("not", "nicht", "pas"), weight=0.24),
    Rule("joined", all=("and", "of"), weight=0.28), Rule("placed", any=("in the", "on the", "by the"), weight=0.26), Rule("past", any=("was", "were", "war", "fue"), weight=0.24),
    Rule("present", any=("is", "are", "ist", "est", "es"), weight=0.16), Rule("personal", any=("he", "she", "er", "sie", "il", "elle"), weight=0.32), Rule("demonstrative", any=("this", "that"), required=("is", "was"), weight=0.25),
    Rule("licensed", any=("license", "copyright"), weight=0.26), Rule("tabular", any=("|",), weight=0.20), Rule("asking", any=("?", "what", "who"), weight=0.16), Rule("relative", any=("which", "que", "qui"), weight=0.18),
    Rule("causal", any=("because", "weil", "car"), weight=0.22), Rule("both_articles", all=("the", "a"), weight=0.24), Rule("towards", any=("to the", "zu", "vers"), weight=0.20), Rule("without", any=("without", "ohne", "sans", "sin"), weight=0.26),
    Rule("partitive", any=("du", "del", "von"), weight=0.16), Rule("compared", any=("as", "than", "als", "comme"), weight=0.18), Rule("private", any=("email", "phone", "password"), weight=0.20), Rule("numbered", any=("1", "2", "3"), weight=0.16),
]
#: The first of these that holds is the domain.
DOMAINS = [x for n in ("licensed", "private", "tabular", "french", "spanish", "german", "english") for x in FEATURES if x.name == n]
#: Topics that count against a passage if the question has none of their words.
NOISE = [Rule("legal", any=("license", "copyright", "warranty"), weight=0.65), Rule("table", any=("|",), weight=0.35), Rule("personal_data", any=("email", "phone", "password"), weight=0.48), Rule("foreign_german", any=("der", "die", "und"), weight=0.28), Rule("foreign_romance", any=("le", "les", "que", "los"), weight=0.28)]

_TALK = ", ".join(f"{holds_sql(r, 'q')} AS is_{r.name}" for r in FEATURES)
_ASKED = f"{ASKED}, t AS (SELECT conv_id, question, {spaced_sql('question')} q FROM asked)"


def questions(spark, d):
    return asked(spark, d).withColumn("q", spaced(F.col("question")))


@query("C11_query_profile", f"WITH {_ASKED} SELECT conv_id, {_TALK}, {first_sql(DOMAINS, 'q')} AS domain FROM t")
def query_profile(spark, d):
    q = F.col("q")
    return questions(spark, d).select("conv_id", *(holds(r, q).alias(f"is_{r.name}") for r in FEATURES), first(DOMAINS, q).alias("domain"))


#: What a question is searched with besides its own words.
EXPANSIONS = [
    Rule("article", any=("the",), blocked=("que",), adds=("article", "definite")), Rule("romance", any=("que", "des"), required=("la", "le", "de"), adds=("romance", "article")), Rule("german", any=("der", "und"), adds=("german", "umlaut")),
    Rule("pair", all=("the", "of"), adds=("genitive", "definite")), Rule("place", any=("in the", "on the"), adds=("place", "where")), Rule("time", any=("was", "were"), required=("the", "a", "that"), blocked=("is",), adds=("past", "when")),
    Rule("legal", any=("license", "copyright"), adds=("terms", "permission")), Rule("people", any=("he", "she"), adds=("person",)),
]
#: Patterns that add a word of their own.
PATTERNS = [(r"[0-9]{4}", "year"), (r"[a-z]+tion ", "noun"), (r" [a-z]+ing ", "gerund")]
BROWSE = [
    Rule("help", any=("what", "who", "?"), adds=("faq", "help")), Rule("english", any=("the", "and"), adds=("guide", "english")), Rule("romance", any=("les", "los", "des"), blocked=("the",), adds=("guide", "romance")),
    Rule("table", any=("|",), adds=("table", "list")), Rule("contact", any=("email", "phone"), required=("to", "at", "and"), adds=("contact",)), Rule("german", all=("der", "die"), adds=("guide", "german")),
]


@query("C12_expansion", f"WITH {_ASKED}, x AS (SELECT conv_id, trim(q) q, list_concat({added_sql(EXPANSIONS, 'q')}, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(q, '{p}') THEN '{w}' END" for p, w in PATTERNS) + "], lambda v: v IS NOT NULL)) l FROM t), y AS (SELECT conv_id, q, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), ' ') added FROM x) SELECT conv_id, added, trim(q || ' ' || added) AS expanded FROM y")
def expansion(spark, d):
    """Words that rules and patterns add to a question, in order, each once, and the question with them."""
    q = F.col("q")
    found = F.array_compact(F.array(*(F.when(q.rlike(p), F.lit(w)) for p, w in PATTERNS)))
    more = F.array_join(F.array_distinct(F.concat(added(EXPANSIONS, q), found)), " ")
    return questions(spark, d).select("conv_id", more.alias("added"), F.trim(F.concat_ws(" ", F.trim(q), more)).alias("expanded"))


@query("C13_browse_expansion", f"WITH {_ASKED}, x AS (SELECT conv_id, {added_sql(BROWSE, 'q')} l FROM t) SELECT conv_id, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), ' ') AS added, len(list_distinct(l))::BIGINT AS terms FROM x")
def browse_expansion(spark, d):
    more = added(BROWSE, F.col("q"))
    return questions(spark, d).select("conv_id", F.array_join(more, " ").alias("added"), F.size(more).cast("long").alias("terms"))


# A vector stands for the document with its id: question and passage have texts, titles (the first line) and sources.
_WORDS4 = r"list_distinct(list_filter(regexp_extract_all({}, '[a-z]+'), lambda w: length(w) >= 4))"
_PAIRS = rf"""texts AS (SELECT doc_id, min(lang) lang, min(source) source, min({spaced_sql('text')}) body, min({spaced_sql("split_part(text, chr(10), 1)")}) title, min(n_chars) n_chars FROM documents GROUP BY doc_id),
 marked AS (SELECT doc_id, max(quality) quality FROM labels GROUP BY doc_id),
 pairs AS (SELECT r.query_id, r.vec_id, r.label, r.score, r.rank, y.label asked_label, coalesce(a.body, '') q, coalesce(c.body, '') body, coalesce(c.title, '') title, c.source, c.n_chars, m.quality, c.doc_id IS NOT NULL known,
  {first_sql(DOMAINS, "coalesce(a.body, '')")} domain, {first_sql(DOMAINS, "coalesce(c.body, '')")} passage_domain
  FROM ranked r JOIN embeddings y ON y.vec_id = r.query_id LEFT JOIN texts a ON a.doc_id = r.query_id LEFT JOIN texts c ON c.doc_id = r.vec_id LEFT JOIN marked m ON m.doc_id = r.vec_id)"""


def pairs(spark, d):
    """Hits beside question and passage; only documents that a hit names are normalised."""
    found = written(hits(spark, d))
    named_ids = found.select(F.col("query_id").alias("doc_id")).unionByName(found.select(F.col("vec_id").alias("doc_id"))).distinct()
    t = table(spark, d, "documents").join(named_ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("source").alias("source"), F.min(spaced(F.col("text"))).alias("body"), F.min(spaced(F.split("text", "\n")[0])).alias("title"), F.min("n_chars").alias("n_chars"))
    m = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).select(F.col("doc_id").alias("vec_id"), "quality")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").cast("long").alias("asked_label"))
    question = t.select(F.col("doc_id").alias("query_id"), F.col("body").alias("q"))
    passage = t.withColumnRenamed("doc_id", "vec_id").withColumn("known", F.lit(True))
    out = found.join(e, "query_id").join(question, "query_id", "left").join(passage, "vec_id", "left").join(m, "vec_id", "left")
    out = out.fillna("", ["q", "body", "title"]).fillna(False, ["known"])
    return out.withColumn("domain", first(DOMAINS, F.col("q"))).withColumn("passage_domain", first(DOMAINS, F.col("body")))


def _words4(x):
    return F.array_distinct(F.filter(F.regexp_extract_all(x, F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 4))


def _deltas():
    """Changes of a score in their order: overlap with the title, domain, shared features, noise, citation."""
    q, body = F.col("q"), F.col("body")
    overlap = F.size(F.array_intersect(_words4(q), _words4(F.col("title"))))
    out = [("overlap", overlap > 0, F.least(F.lit(0.18), overlap * F.lit(0.045))), ("domain_path", F.coalesce(F.col("domain") == F.col("passage_domain"), F.lit(False)), F.lit(0.30))]
    out += [(r.name, holds(r, q) & holds(r, body), F.lit(r.weight)) for r in FEATURES]
    out += [(f"not_{r.name}", holds(r, body) & ~holds(r, q), F.lit(-r.weight)) for r in NOISE]
    out += [("external", F.col("label") == 9, F.lit(-0.85)), ("sample", F.contains(body, F.lit(" sample ")), F.lit(-0.40)), ("no_id", ~F.col("known"), F.lit(-0.08)), ("page", F.col("n_chars") > 0, F.lit(0.05))]
    out += [("ready", F.col("quality") == 1, F.lit(0.14)), ("orphan", F.col("quality").isNull(), F.lit(-0.10))]
    return [(n, F.coalesce(c, F.lit(False)), v) for n, c, v in out]


def _deltas_sql():
    overlap = f"len(list_intersect({_WORDS4.format('q')}, {_WORDS4.format('title')}))"
    out = [("overlap", f"{overlap} > 0", f"least(0.18::DOUBLE, {overlap} * 0.045::DOUBLE)"), ("domain_path", "coalesce(domain = passage_domain, false)", "0.30")]
    out += [(r.name, f"{holds_sql(r, 'q')} AND {holds_sql(r, 'body')}", str(r.weight)) for r in FEATURES]
    out += [(f"not_{r.name}", f"{holds_sql(r, 'body')} AND NOT {holds_sql(r, 'q')}", str(-r.weight)) for r in NOISE]
    out += [("external", "label = 9", "-0.85"), ("sample", "contains(body, ' sample ')", "-0.40"), ("no_id", "NOT known", "-0.08"), ("page", "coalesce(n_chars > 0, false)", "0.05")]
    return out + [("ready", "coalesce(quality = 1, false)", "0.14"), ("orphan", "quality IS NULL", "-0.10")]


_TOTAL, _REASONS = scored_sql(_deltas_sql())
_RERANKED = f"{_PAIRS}, rerank AS (SELECT *, rank AS original_rank, score AS original_score, floor((score + {_TOTAL}) * 1e4 + 0.5) / 1e4 reranked_score, coalesce(quality = 1, false) ready, {_REASONS} reasons FROM pairs), final AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY reranked_score DESC, ready DESC, original_rank) rank FROM rerank)"


def reranked(spark, d):
    total, reasons = scored(_deltas())
    out = pairs(spark, d).withColumnsRenamed({"rank": "original_rank", "score": "original_score"})
    out = out.withColumns({"reranked_score": F.floor((F.col("original_score") + total) * 1e4 + 0.5) / 1e4, "ready": F.coalesce(F.col("quality") == 1, F.lit(False)), "reasons": reasons})
    w = Window.partitionBy("query_id").orderBy(F.desc("reranked_score"), F.desc("ready"), "original_rank")
    return out.withColumn("rank", F.row_number().over(w).cast("long"))


@query("C14_rerank", f"WITH {_HITS}, {_RERANKED} SELECT query_id, vec_id, original_score, reranked_score, array_to_string(reasons, ',') AS reasons FROM final")
def rerank(spark, d):
    return reranked(spark, d).select("query_id", "vec_id", "original_score", "reranked_score", F.array_join("reasons", ",").alias("reasons"))


#: Kinds of passage and what they are worth: name, condition in SQL on a pair, change.
KINDS = [("same_label", "label = asked_label", 0.22), ("procedure", "contains(body, ' 1 ') AND contains(body, ' 2 ')", 0.24), ("form", "contains(body, ' | ') AND NOT contains(q, ' | ')", -0.35), ("form_asked", "contains(body, ' | ') AND contains(q, ' | ')", 0.30), ("short_notice", "length(body) < 200 AND length(q) >= 200", -0.10), ("other_label", "label <> asked_label AND domain = passage_domain", -0.05)]
_KIND_TOTAL, _KIND_REASONS = scored_sql([(n, f"coalesce({c}, false)", str(v)) for n, c, v in KINDS])


@query("C16_type_boosts", f"WITH {_HITS}, {_PAIRS} SELECT query_id, vec_id, floor({_KIND_TOTAL} * 1e4 + 0.5) / 1e4 AS boost, array_to_string({_KIND_REASONS}, ',') AS reasons FROM pairs")
def type_boosts(spark, d):
    """Boosts for passages of the asked kind, penalties for forms that nobody asked for."""
    total, reasons = scored([(n, F.coalesce(F.expr(c), F.lit(False)), F.lit(v)) for n, c, v in KINDS])
    return pairs(spark, d).select("query_id", "vec_id", (F.floor(total * 1e4 + 0.5) / 1e4).alias("boost"), F.array_join(reasons, ",").alias("reasons"))


@query("W15_order", f"WITH {_HITS}, {_RERANKED} SELECT query_id, vec_id, rank FROM final WHERE rank <= 5")
def order(spark, d):
    return reranked(spark, d).where("rank <= 5").select("query_id", "vec_id", "rank")


POSITIVE = ["overlap", "domain_path", *(r.name for r in FEATURES)]
STRONG = ["external", "sample", *(f"not_{r.name}" for r in NOISE if r.weight >= 0.4)]


def _of(names: list[str]):
    return F.filter("reasons", lambda r: r.isin(names))


def _of_sql(names: list[str]) -> str:
    return f"list_filter(reasons, lambda r: list_contains({names}, r))"


@query("F15_gates", f"WITH {_HITS}, {_RERANKED} SELECT query_id, vec_id, contains(body, ' | ') OR length(body) < 60 AS noise, len({_of_sql(STRONG)}) > 0 AS penalised, array_to_string({_of_sql(POSITIVE)}, ',') AS positive FROM final")
def gates(spark, d):
    noise = F.contains("body", F.lit(" | ")) | (F.length("body") < 60)
    return reranked(spark, d).select("query_id", "vec_id", noise.alias("noise"), (F.size(_of(STRONG)) > 0).alias("penalised"), F.array_join(_of(POSITIVE), ",").alias("positive"))


#: A question is broad if it has one of the phrases, or two of the words.
BROAD_PHRASES = Rule("broad", any=("all the", "list of", "of the"))
BROAD = ["the", "all", "que", "des", "los", "die"]
_BROAD = f"({holds_sql(BROAD_PHRASES, 'q')} OR len(list_intersect(string_split(trim(q), ' '), {BROAD})) >= 2)"


def _broad(q):
    return holds(BROAD_PHRASES, q) | (F.size(F.array_intersect(F.split(F.trim(q), " "), F.array(*(F.lit(x) for x in BROAD)))) >= 2)


_KEPT = f"kept AS (SELECT *, {_BROAD} broad, len({_of_sql(STRONG)}) > 0 strong, len({_of_sql(POSITIVE)}) > 0 positive FROM final), fit AS (SELECT * FROM kept WHERE label <> 9 AND NOT strong AND (positive OR (rank = 1 AND NOT broad)))"


def _fit(spark, d):
    k = reranked(spark, d).withColumns({"broad": _broad(F.col("q")), "strong": F.size(_of(STRONG)) > 0, "positive": F.size(_of(POSITIVE)) > 0})
    return k.where((F.col("label") != 9) & ~F.col("strong") & (F.col("positive") | ((F.col("rank") == 1) & ~F.col("broad"))))


@query("W12_context", f"WITH {_HITS}, {_RERANKED}, {_KEPT}, g AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) turn FROM fit), s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) k FROM g WHERE NOT broad OR turn = 1) SELECT query_id, vec_id, broad, k AS place FROM s WHERE k <= CASE WHEN broad THEN 15 ELSE 3 END")
def context(spark, d):
    """Passages that a question is answered from: the first needs no reason unless the question is broad; broad ones take one of each group, up to 15, others three."""
    turn = F.row_number().over(Window.partitionBy("query_id", "label").orderBy("rank"))
    s = _fit(spark, d).withColumn("turn", turn).where(~F.col("broad") | (F.col("turn") == 1))
    s = s.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long"))
    return s.where(F.col("place") <= F.when(F.col("broad"), 15).otherwise(3)).select("query_id", "vec_id", "broad", "place")


@query("W13_collection_context", f"WITH {_HITS}, {_RERANKED}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reranked_score DESC, title, n_chars NULLS FIRST, vec_id) turn FROM final WHERE label <> 9 AND coalesce(domain = passage_domain, true)), f AS (SELECT *, row_number() OVER (PARTITION BY query_id, title ORDER BY turn) g FROM o) SELECT query_id, vec_id, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn) k FROM f WHERE g = 1) WHERE k <= 15")
def collection_context(spark, d):
    """Passages of the question's domain by score, title, length and id; the first of each title, up to 15."""
    o = reranked(spark, d).where((F.col("label") != 9) & F.coalesce(F.col("domain") == F.col("passage_domain"), F.lit(True)))
    o = o.withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("reranked_score"), "title", F.asc_nulls_first("n_chars"), "vec_id")))
    f = o.withColumn("g", F.row_number().over(Window.partitionBy("query_id", "title").orderBy("turn"))).where("g = 1")
    return f.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("turn")).cast("long")).where("place <= 15").select("query_id", "vec_id", "place")


_TIER = "CASE WHEN contains(body, ' | ') THEN 3 WHEN NOT known THEN 2 WHEN ready AND label = asked_label THEN 0 WHEN label = asked_label THEN 1 ELSE 2 END"


@query("H1_prefer", f"WITH {_HITS}, {_RERANKED}, v AS (SELECT query_id, vec_id, rank, {_TIER} tier, contains(q, ' | ') form FROM final), w AS (SELECT *, min(tier) OVER (PARTITION BY query_id) best FROM v) SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN form OR best > 1 THEN 0 ELSE tier END, rank) AS place FROM w")
def prefer(spark, d):
    """Usable passages of the asked kind, then others of it, the rest, and forms last; as ranked if the question asks for forms or none is preferred."""
    tier = F.when(F.contains("body", F.lit(" | ")), 3).when(~F.col("known"), 2).when(F.col("ready") & (F.col("label") == F.col("asked_label")), 0).when(F.col("label") == F.col("asked_label"), 1).otherwise(2)
    v = reranked(spark, d).withColumns({"tier": tier, "form": F.contains("q", F.lit(" | "))})
    v = v.withColumn("best", F.min("tier").over(Window.partitionBy("query_id")))
    plain = F.when(F.col("form") | (F.col("best") > 1), 0).otherwise(F.col("tier"))
    return v.select("query_id", "vec_id", F.row_number().over(Window.partitionBy("query_id").orderBy(plain, "rank")).cast("long").alias("place"))


@query("C20_confidence", f"WITH {_HITS}, {_RERANKED}, {_KEPT}, g AS (SELECT query_id, any_value(broad) broad, max(reranked_score) top, count_if(coalesce(domain = passage_domain, false)) matched, count_if(positive) good, count_if(strong) bad FROM kept WHERE rank <= 5 GROUP BY query_id) SELECT query_id, CASE WHEN broad AND matched >= 3 AND bad = 0 THEN 'high' WHEN NOT broad AND top >= 0.82 AND matched > 0 AND good > 0 AND bad = 0 THEN 'high' WHEN top >= 0.58 AND good > 0 THEN 'medium' ELSE 'low' END AS confidence FROM g")
def answer_confidence(spark, d):
    """From the best score, the domain's match, and what speaks for or against the first five."""
    k = reranked(spark, d).where("rank <= 5").withColumns({"broad": _broad(F.col("q")), "strong": F.size(_of(STRONG)) > 0, "positive": F.size(_of(POSITIVE)) > 0})
    g = k.groupBy("query_id").agg(F.any_value("broad").alias("broad"), F.max("reranked_score").alias("top"), F.count_if(F.coalesce(F.col("domain") == F.col("passage_domain"), F.lit(False))).alias("matched"), F.count_if("positive").alias("good"), F.count_if("strong").alias("bad"))
    high = F.expr("broad AND matched >= 3 AND bad = 0") | F.expr("NOT broad AND top >= 0.82 AND matched > 0 AND good > 0 AND bad = 0")
    return g.select("query_id", F.when(high, "high").when(F.expr("top >= 0.58 AND good > 0"), "medium").otherwise("low").alias("confidence"))


STOP = ["the", "of", "and", "to", "in", "is", "a", "der", "die", "und", "le", "la", "les", "de", "des", "el", "los", "que", "en"]
_TOKENS = "list_filter(string_split(trim({}), ' '), lambda w: length(w) >= 2 AND NOT list_contains(" + str(STOP) + ", w))"


@query("C15_title_similarity", f"WITH {_HITS}, {_PAIRS}, w AS (SELECT query_id, vec_id, {_TOKENS.format('q')} q, {_TOKENS.format('title')} title FROM pairs), g AS (SELECT query_id, vec_id, title, list_filter(flatten(list_transform([1, 2, 3], lambda n: list_transform(range(1, greatest(len(q) - n + 2, 1)::BIGINT), lambda i: list_distinct(list_slice(q, i, i + n - 1))))), lambda x: len(x) > 0) grams FROM w), s AS (SELECT query_id, vec_id, coalesce(list_max(list_transform(grams, lambda x: len(list_intersect(x, title))::DOUBLE / len(x) * CASE WHEN len(x) = 1 THEN 0.5 ELSE 1 END)), 0) sim FROM g) SELECT query_id, vec_id, (CASE WHEN sim >= 0.95 THEN 0.5 WHEN sim >= 0.6 THEN 0.38 WHEN sim >= 0.5 THEN 0.2 ELSE 0 END)::DOUBLE AS boost FROM s")
def title_similarity(spark, d):
    """The best share of a run of one to three words of the question that the passage's title has."""
    tokens = lambda x: F.filter(F.split(F.trim(x), " "), lambda w: (F.length(w) >= 2) & ~w.isin(STOP))
    w = pairs(spark, d).select("query_id", "vec_id", tokens(F.col("q")).alias("q"), tokens(F.col("title")).alias("title"))
    starts = lambda n: F.when(F.size("q") >= n, F.sequence(F.lit(1), F.size("q") - n + 1)).otherwise(F.array().cast("array<int>"))
    run = lambda n: F.transform(starts(n), lambda i: F.array_distinct(F.slice("q", i, n)))
    runs = F.concat(*map(run, (1, 2, 3)))
    share = F.array_max(F.transform(runs, lambda x: F.size(F.array_intersect(x, F.col("title"))) / F.size(x) * F.when(F.size(x) == 1, 0.5).otherwise(1.0)))
    sim = F.coalesce(share, F.lit(0.0))
    return w.select("query_id", "vec_id", F.when(sim >= 0.95, 0.5).when(sim >= 0.6, 0.38).when(sim >= 0.5, 0.2).otherwise(0.0).alias("boost"))


_NOISE_TOTAL, _NOISE_REASONS = scored_sql([(r.name, f"{holds_sql(r, 'body')} AND NOT {holds_sql(r, 'q')}", str(-r.weight)) for r in NOISE])


@query("C17_noise_penalty", f"WITH {_HITS}, {_PAIRS} SELECT query_id, vec_id, floor({_NOISE_TOTAL} * 1e4 + 0.5) / 1e4 AS penalty, array_to_string({_NOISE_REASONS}, ',') AS reasons FROM pairs")
def noise_penalty(spark, d):
    """What a passage loses for topics that the question did not ask for."""
    total, reasons = scored([(r.name, holds(r, F.col("body")) & ~holds(r, F.col("q")), F.lit(-r.weight)) for r in NOISE])
    return pairs(spark, d).select("query_id", "vec_id", (F.floor(total * 1e4 + 0.5) / 1e4).alias("penalty"), F.array_join(reasons, ",").alias("reasons"))


INTENTS = [Rule("requirement", any=("license", "password", "email")), Rule("location", any=("in the", "on the", "dans", "dans le")), Rule("definition", any=("is", "est", "ist"), required=("the", "le", "der", "a")), Rule("person", any=("he", "she", "er", "elle")), Rule("history", any=("was", "were")), Rule("procedure", any=("to", "zu", "pour"))]
COLLECTIONS = [Rule("everything", all=("all", "the")), Rule("tables", any=("|",)), Rule("languages", all=("the", "que")), Rule("pairs", all=("and", "of"), blocked=("que",))]


@query("C18_intent", f"WITH {_ASKED} SELECT conv_id, {first_sql(INTENTS, 'q', 'general')} AS intent, {first_sql(COLLECTIONS, 'q', 'none')} AS collection, {_BROAD} AS broad, CASE WHEN {holds_sql(BROAD_PHRASES, 'q')} THEN 'phrase' WHEN {_BROAD} THEN 'words' END AS why FROM t")
def question_intent(spark, d):
    q = F.col("q")
    why = F.when(holds(BROAD_PHRASES, q), "phrase").when(_broad(q), "words")
    return questions(spark, d).select("conv_id", first(INTENTS, q, "general").alias("intent"), first(COLLECTIONS, q, "none").alias("collection"), _broad(q).alias("broad"), why.alias("why"))


@query("C19_domain", f"WITH {_HITS}, {_PAIRS} SELECT query_id, vec_id, domain, coalesce(domain = passage_domain, false) AS matches, domain IS NULL OR " + " OR ".join(f"(domain = '{r.name}' AND {holds_sql(Rule(r.name, any=r.any or r.all), 'body')})" for r in DOMAINS) + " AS broadly FROM pairs")
def domain(spark, d):
    """The question's domain; whether it is the passage's first one too, or at least one that the passage has words of."""
    has = reduce(lambda a, b: a | b, ((F.col("domain") == r.name) & holds(Rule(r.name, any=r.any or r.all), F.col("body")) for r in DOMAINS))
    return pairs(spark, d).select("query_id", "vec_id", "domain", F.coalesce(F.col("domain") == F.col("passage_domain"), F.lit(False)).alias("matches"), (F.col("domain").isNull() | has).alias("broadly"))


@query("C21_scope", rf"WITH {_HITS}, {_PAIRS} SELECT query_id, vec_id, nullif(regexp_extract(q, ' (?:in|of|de|von) ([\p{{L}}]{{4,}}) ', 1), '') AS scope, coalesce(contains(body, ' ' || nullif(regexp_extract(q, ' (?:in|of|de|von) ([\p{{L}}]{{4,}}) ', 1), '') || ' '), true) AS within, (4 * (label = asked_label)::INT + least(len(list_intersect({_WORDS4.format('q')}, {_WORDS4.format('title')})), 5) + 2 * coalesce(domain = passage_domain, false)::INT)::BIGINT AS points FROM pairs")
def scope(spark, d):
    """What the question is limited to, whether the passage is inside, and the passage's points."""
    named = F.nullif(F.regexp_extract("q", r" (?:in|of|de|von) ([\p{L}]{4,}) ", 1), F.lit(""))
    within = F.coalesce(F.contains("body", F.concat(F.lit(" "), named, F.lit(" "))), F.lit(True))
    points = 4 * (F.col("label") == F.col("asked_label")).cast("int") + F.least(F.size(F.array_intersect(_words4(F.col("q")), _words4(F.col("title")))), F.lit(5)) + 2 * F.coalesce(F.col("domain") == F.col("passage_domain"), F.lit(False)).cast("int")
    return pairs(spark, d).select("query_id", "vec_id", named.alias("scope"), within.alias("within"), points.cast("long").alias("points"))


#: What kind of answer is left when nothing was found; the first that holds.
FALLBACKS = [("words < 3", "clarification", "too_short"), ("procedure", "service", "procedure"), ("asking", "service", "asked"), ("person", "person", "person"), ("rule", "policy", "rule"), ("broad AND words > 40", "clarification", "too_broad")]
_FALL = Rule("procedure", any=("to", "zu", "pour"), required=("?", "the", "der", "le")), Rule("asking", any=("?", "what", "which")), Rule("person", any=("he", "she", "er", "elle")), Rule("rule", any=("the", "der", "le", "el"))


@query("C24_fallback", f"WITH {_ASKED}, f AS (SELECT conv_id, len(string_split(trim(q), ' ')) words, {_BROAD} broad, " + ", ".join(f"{holds_sql(r, 'q')} {r.name}" for r in _FALL) + f" FROM t) SELECT conv_id, {decided_sql(FALLBACKS, ('policy', 'default'), 0)} AS fallback, {decided_sql(FALLBACKS, ('policy', 'default'), 1)} AS why FROM f")
def fallback(spark, d):
    q = F.col("q")
    f = questions(spark, d).select("conv_id", F.size(F.split(F.trim(q), " ")).alias("words"), _broad(q).alias("broad"), *(holds(r, q).alias(r.name) for r in _FALL))
    return f.select("conv_id", decided(FALLBACKS, ("policy", "default"), "fallback", "why").alias("x")).select("conv_id", "x.*")


#: Words that no document of the collection is about, and what makes a question specific.
OUTSIDE = Rule("outside", any=("password", "phone"), blocked=("the", "que", "der"))
SPECIFIC = Rule("specific", all=("the", "of"), required=("in", "is", "was"))


@query("F14_query_gates", f"WITH {_ASKED} SELECT conv_id, {holds_sql(OUTSIDE, 'q')} OR NOT regexp_matches(q, '[a-z]') AS out_of_scope, {holds_sql(SPECIFIC, 'q')} OR regexp_matches(q, ' [0-9]+ ') AS specific, {_BROAD} AND NOT ({holds_sql(SPECIFIC, 'q')}) AS broad FROM t")
def query_gates(spark, d):
    q = F.col("q")
    return questions(spark, d).select("conv_id", (holds(OUTSIDE, q) | ~q.rlike("[a-z]")).alias("out_of_scope"), (holds(SPECIFIC, q) | q.rlike(" [0-9]+ ")).alias("specific"), (_broad(q) & ~holds(SPECIFIC, q)).alias("broad"))


@query("R1_extractive_answer", f"WITH {CHUNKS}, k AS (SELECT * FROM chunks WHERE chunk_index < 3) SELECT doc_id, string_agg(substring(text, 1, 120), ' / ' ORDER BY chunk_index) AS answer FROM k GROUP BY doc_id")
def extractive_answer(spark, d):
    k = chunks(spark, d).where("chunk_index < 3")
    return k.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", F.substring("text", 1, 120).alias("t")))), lambda x: x["t"]), " / ").alias("answer"))


@query("R2_context_blocks", f"WITH {_HITS}, {_RERANKED} SELECT query_id, string_agg('[' || rank || '] vector ' || vec_id || ' (' || array_to_string(reasons, ',') || ')', chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM final WHERE rank <= 5 GROUP BY query_id")
def context_blocks(spark, d):
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] vector "), F.col("vec_id").cast("string"), F.lit(" ("), F.array_join("reasons", ","), F.lit(")"))
    return reranked(spark, d).where("rank <= 5").groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n---\n").alias("context"))


@query("R3_sources", f"WITH {_HITS}, {_RERANKED} SELECT query_id, label, count(*) AS citations, min(rank) AS first_rank, max(reranked_score) AS score FROM final WHERE rank <= 15 GROUP BY query_id, label")
def sources(spark, d):
    return reranked(spark, d).where("rank <= 15").groupBy("query_id", "label").agg(F.count("*").alias("citations"), F.min("rank").alias("first_rank"), F.max("reranked_score").alias("score"))


@query("R4_fallback_answer", r"WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) x FROM documents) SELECT doc_id, CASE WHEN length(x) <= 520 THEN x ELSE rtrim(CASE WHEN length(regexp_extract(substring(x, 1, 520), '(?s)^(.*)\s', 1)) >= 312 THEN regexp_extract(substring(x, 1, 520), '(?s)^(.*)\s', 1) ELSE substring(x, 1, 520) END) || '...' END AS excerpt FROM t")
def fallback_answer(spark, d):
    return table(spark, d, "documents").select("doc_id", tf.cut_at_space("text", 520).alias("excerpt"))


@query("R5_intent_answer", f"WITH {ASKED} SELECT conv_id, CASE WHEN length(question) < 40 THEN 'Please say more about: ' || question ELSE 'Nothing found for: ' || substring(question, 1, 60) END AS answer FROM asked")
def intent_answer(spark, d):
    return asked(spark, d).select("conv_id", F.when(F.length("question") < 40, F.concat(F.lit("Please say more about: "), "question")).otherwise(F.concat(F.lit("Nothing found for: "), F.substring("question", 1, 60))).alias("answer"))


@query("R7_summary", r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z"''(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') s FROM documents) SELECT doc_id, substring(array_to_string(list_slice(s, 1, 2), ' '), 1, 350) AS summary FROM s""")
def summary(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring(F.array_join(F.slice(tf.sentences("text"), 1, 2), " "), 1, 350).alias("summary"))


@query("C5_metadata_boost", f"WITH {_HITS}, {_PAIRS}, k AS (SELECT query_id, vec_id, pairs.source, domain, passage_domain, a.source asked_source FROM pairs LEFT JOIN (SELECT doc_id, min(source) source FROM documents GROUP BY doc_id) a ON a.doc_id = query_id) SELECT query_id, vec_id, (CASE WHEN coalesce(domain = passage_domain, false) THEN 0.16 ELSE 0 END + CASE WHEN coalesce(source = asked_source, false) THEN 0.24 ELSE 0 END)::DOUBLE AS boost, concat_ws(',', CASE WHEN domain = passage_domain THEN 'category' END, CASE WHEN source = asked_source THEN 'subcategory' END) AS reasons FROM k")
def metadata_boost(spark, d):
    """What a passage gains for being of the question's category and subcategory."""
    a = table(spark, d, "documents").groupBy(F.col("doc_id").alias("query_id")).agg(F.min("source").alias("asked_source"))
    k = pairs(spark, d).join(a, "query_id", "left")
    category, sub = (F.coalesce(F.col(x) == F.col(y), F.lit(False)) for x, y in (("domain", "passage_domain"), ("source", "asked_source")))
    boost = F.when(category, 0.16).otherwise(0.0) + F.when(sub, 0.24).otherwise(0.0)
    return k.select("query_id", "vec_id", boost.alias("boost"), F.concat_ws(",", F.when(category, "category"), F.when(sub, "subcategory")).alias("reasons"))


#: What is offered when a search finds nothing.
SUGGESTIONS = [Rule("law", any=("license", "copyright"), adds=("terms of use", "permissions")), Rule("english", any=("the", "and"), blocked=("que", "der"), adds=("guides", "definitions")), Rule("romance", any=("que", "les", "los"), adds=("guias", "guides en francais")), Rule("german", any=("der", "die", "und"), adds=("anleitungen",)), Rule("asking", any=("?", "what"), adds=("frequent questions",))]


@query("H5_suggestions", f"WITH {_ASKED}, x AS (SELECT conv_id, {added_sql(SUGGESTIONS, 'q')} l FROM t) SELECT conv_id, CASE WHEN len(l) = 0 THEN 'all topics' ELSE array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), '; ') END AS suggestion FROM x")
def suggestions(spark, d):
    found = added(SUGGESTIONS, F.col("q"))
    return questions(spark, d).select("conv_id", F.when(F.size(found) == 0, "all topics").otherwise(F.array_join(found, "; ")).alias("suggestion"))


#: Topics of a text, and the concepts that are named in it.
CLUSTERS = [Rule("legal", any=("license", "copyright", "warranty")), Rule("tables", any=("|",)), Rule("private", any=("email", "phone", "password")), Rule("english", all=("the", "of")), Rule("german", any=("der", "die"), required=("und", "von")), Rule("french", any=("le", "les"), required=("des", "une")), Rule("spanish", any=("el", "los"), required=("que", "una"))]
CONCEPTS = ["of the", "in the", "to the", "de la", "que la", "und die", "in der", "copyright", "license", "email"]
_BODIES = f"bodies AS (SELECT doc_id, {spaced_sql('text')} q FROM documents)"
_TOPICS = "list_filter([" + ", ".join(f"CASE WHEN {holds_sql(r, 'q')} THEN '{r.name}' END" for r in CLUSTERS) + "], lambda x: x IS NOT NULL)"


def bodies(spark, d):
    q = spaced(F.col("text"))
    t = table(spark, d, "documents").select("doc_id", q.alias("q"))
    return t.withColumn("topics", F.array_compact(F.array(*(F.when(holds(r, F.col("q")), F.lit(r.name)) for r in CLUSTERS))))


@query("C27_mixed_scope", f"WITH {_BODIES}, n AS (SELECT doc_id, {_TOPICS} topics FROM bodies) SELECT doc_id, array_to_string(topics, ',') AS topics, len(topics) >= 3 OR (list_contains(topics, 'english') AND len(list_filter(topics, lambda x: list_contains(['german', 'french', 'spanish'], x))) > 0) AS mixed FROM n")
def mixed_scope(spark, d):
    """Three topics, or two languages, make a text mixed."""
    other = F.size(F.filter("topics", lambda x: x.isin("german", "french", "spanish"))) > 0
    return bodies(spark, d).select("doc_id", F.array_join("topics", ",").alias("topics"), ((F.size("topics") >= 3) | (F.array_contains("topics", "english") & other)).alias("mixed"))


@query("C36_concepts", f"WITH {_BODIES}, n AS (SELECT doc_id, {_TOPICS} topics, list_filter({CONCEPTS}, lambda c: contains(q, ' ' || c || ' ')) concepts FROM bodies) SELECT doc_id, CASE WHEN list_contains(topics, 'legal') THEN 'policy' WHEN list_contains(topics, 'tables') THEN 'form' WHEN len(topics) > 0 THEN topics[1] ELSE 'general' END AS kind, array_to_string(concepts, ', ') AS concepts FROM n")
def concepts(spark, d):
    """The kind of a text by its topics, and the phrases found in it in their fixed order."""
    known = F.filter(F.array(*(F.lit(x) for x in CONCEPTS)), lambda c: F.contains("q", F.concat(F.lit(" "), c, F.lit(" "))))
    has = lambda x: F.array_contains("topics", x)
    kind = F.when(has("legal"), "policy").when(has("tables"), "form").otherwise(F.coalesce(F.get("topics", F.lit(0)), F.lit("general")))
    return bodies(spark, d).select("doc_id", kind.alias("kind"), F.array_join(known, ", ").alias("concepts"))


@query("F23_foreign_terms", f"WITH {_BODIES}, h AS (SELECT doc_id, {spaced_sql('split_part(text, chr(10), 1)')} q, {spaced_sql('text')} body FROM documents), a AS (SELECT doc_id, {_TOPICS} told FROM h), b AS (SELECT doc_id, {_TOPICS} topics FROM bodies) SELECT a.doc_id, array_to_string(list_filter(told, lambda x: NOT list_contains(topics, x)), ',') AS foreign_topics, len(list_intersect(told, topics))::BIGINT AS shared, len(told) = 0 OR len(list_intersect(told, topics)) > 0 AS grounded FROM a JOIN (SELECT doc_id, any_value(topics) topics FROM b GROUP BY doc_id) b ON a.doc_id = b.doc_id")
def foreign_terms(spark, d):
    """Whether the summary (the first line) speaks of topics that the text has."""
    first_line = table(spark, d, "documents").select("doc_id", spaced(F.split("text", "\n")[0]).alias("line"), spaced(F.col("text")).alias("q"))
    topics = lambda x: F.array_compact(F.array(*(F.when(holds(r, x), F.lit(r.name)) for r in CLUSTERS)))
    t = first_line.select("doc_id", topics(F.col("line")).alias("told"), topics(F.col("q")).alias("topics"))
    shared = F.size(F.array_intersect("told", "topics"))
    return t.select("doc_id", F.array_join(F.array_except("told", "topics"), ",").alias("foreign_topics"), shared.cast("long").alias("shared"), ((F.size("told") == 0) | (shared > 0)).alias("grounded"))


#: What makes an article useful or not, and titles that it must not have.
USEFUL = [("boost", Rule("boost", any=("the", "and", "of")), 1.5), ("guide", Rule("guide", any=("to", "zu", "pour", "para")), 1.5), ("legal", CLUSTERS[0], -2.0), ("tables", CLUSTERS[1], -2.0), ("private", CLUSTERS[2], -2.0)]
TITLES = [("shouting", "^[^a-z]{6,}$", -3.0), ("one_word", "^[^ ]+$", -2.5)]
_USEFUL = " + ".join([f"CASE WHEN {holds_sql(r, 'q')} THEN ({v})::DOUBLE ELSE 0::DOUBLE END" for _, r, v in USEFUL] + [f"CASE WHEN regexp_matches(title, '{p}') THEN ({v})::DOUBLE ELSE 0::DOUBLE END" for _, p, v in TITLES])


@query("H19_usefulness", f"WITH u AS (SELECT doc_id, {spaced_sql('text')} q, trim(split_part(text, chr(10), 1)) title FROM documents) SELECT doc_id, {_USEFUL} AS usefulness FROM u")
def usefulness(spark, d):
    u = table(spark, d, "documents").select("doc_id", spaced(F.col("text")).alias("q"), F.trim(F.split("text", "\n")[0]).alias("title"))
    parts = [F.when(holds(r, F.col("q")), F.lit(v)).otherwise(F.lit(0.0)) for _, r, v in USEFUL] + [F.when(F.col("title").rlike(p), F.lit(v)).otherwise(F.lit(0.0)) for _, p, v in TITLES]
    return u.select("doc_id", reduce(lambda a, b: a + b, parts).alias("usefulness"))


#: Sections that a complete article has.
SECTIONS = [("opening", "(?m)^[^\\s].*"), ("sentences", "[.!?]"), ("commas", ","), ("capital", "(?m)^[A-Z]"), ("second_line", "\\n.+"), ("length", "(?s).{200,}"), ("closing", "(?s)[.!?]\\s*$"), ("no_table", "^[^|]*$")]
PLACEHOLDER = "(?i)(\\[needs review\\]|_{4,}|[.]{4,}|lorem ipsum)"


@query("H7_sections_present", "SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN NOT regexp_matches(text, '{p}') THEN '{n}' END" for n, p in SECTIONS) + f"], lambda x: x IS NOT NULL)[1] AS first_missing, " + " AND ".join(f"regexp_matches(text, '{p}')" for _, p in SECTIONS) + f" AS complete, regexp_matches(text, '{PLACEHOLDER}') AS placeholder FROM documents")
def sections_present(spark, d):
    """Whether all eight sections are there, which one is missing first, and whether text is still to be filled in."""
    has = lambda p: F.col("text").rlike(p)
    missing = F.array_compact(F.array(*(F.when(~has(p), F.lit(n)) for n, p in SECTIONS)))
    return table(spark, d, "documents").select("doc_id", F.get(missing, F.lit(0)).alias("first_missing"), (F.size(missing) == 0).alias("complete"), has(PLACEHOLDER).alias("placeholder"))
