"""Rule and similarity classification of chunks, documents and questions."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from math import sqrt

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioloom.functions import text as tf
from folioloom.operators import aliases
from folioloom.plans.registry import query
from folioloom.plans.tickets import HIGH, MEDIUM, URGENT, _hits
from folioloom.sources.tables import ASKED, CHUNKS, OFFICES, asked, chunks, offices, table

#: category, its keywords, subcategory, its office, its keywords; in order of preference.
TAXONOMY = [
    ("english", ["the", "and", "of"], "gerunds", "ALGERIA", ["ing", "inger"]),
    ("english", ["the", "and", "of"], "nouns", "BRAZIL", ["tion", "able", "ent"]),
    ("french", ["les", "des", "dans"], "vowels", "CANADA", ["eau", "oi"]),
    ("french", ["les", "des", "dans"], "accents", "EGYPT", ["é", "ê", "ç"]),
    ("german", ["der", "und", "ein"], "abstracts", "FRANCE", ["keit", "heit", "lich"]),
    ("german", ["der", "und", "ein"], "umlauts", "INDIA", ["ä", "ö", "ü"]),
    ("spanish", ["los", "del", "una"], "endings", "IRAN", ["mente", "ción", "ado"]),
    ("spanish", ["los", "del", "una"], "tildes", "JAPAN", ["ñ", "í"]),
]


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_TAXONOMY = "taxonomy AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}', {_list(ck)}, '{s}', '{o}', {_list(sk)})" for i, (c, ck, s, o, sk) in enumerate(TAXONOMY)) + ") t(ord, category, cat_kw, subcategory, office, sub_kw))"
_RULE = "2.5 * len(list_filter(sub_kw, lambda k: contains(t, k))) + len(list_filter(cat_kw, lambda k: contains(t, k))) + CASE WHEN contains(t, subcategory) THEN 3 ELSE 0 END + CASE WHEN contains(t, category) THEN 1 ELSE 0 END"


def rule_class(x):
    """Struct of category, subcategory, office and confidence: the first of the best-scoring pairs."""
    t = tf.normal(x)
    has = lambda w: F.contains(t, F.lit(w)).cast("int")
    rated = [
        F.struct((tf.hits(t, sk) * 2.5 + tf.hits(t, ck) + 3 * has(s) + has(c)).cast("double").alias("score"), F.lit(-i).alias("rank"), F.lit(c).alias("category"), F.lit(s).alias("subcategory"), F.lit(o).alias("office"))
        for i, (c, ck, s, o, sk) in enumerate(TAXONOMY)
    ]
    return F.array_max(F.array(*rated))


def confidence(score):
    return F.floor(F.least(F.lit(0.98), score / 8) * 1000 + 0.5) / 1000


def _best(source: str, key: str, text: str) -> str:
    return rf"scored AS (SELECT {key}, category, subcategory, office, ord, ({_RULE})::DOUBLE score FROM (SELECT {key}, trim(regexp_replace(lower({text}), '\s+', ' ', 'g')) t FROM {source}) CROSS JOIN taxonomy), best AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, ord) r FROM scored QUALIFY r = 1), classed AS (SELECT {key}, CASE WHEN score > 0 THEN category ELSE 'General' END category, CASE WHEN score > 0 THEN subcategory ELSE 'General' END subcategory, CASE WHEN score > 0 THEN office END office, floor(least(0.98, score / 8) * 1000 + 0.5) / 1000 confidence FROM best)"


def classed(df, text="text"):
    b = F.col("best")
    some = b["score"] > 0
    return df.withColumn("best", rule_class(text)).withColumns({"category": F.when(some, b["category"]).otherwise("General"), "subcategory": F.when(some, b["subcategory"]).otherwise("General"), "office": F.when(some, b["office"]), "confidence": confidence(b["score"])}).drop("best")


@query("documents_by_category", f"WITH {CHUNKS}, {_TAXONOMY}, {_best('chunks', 'doc_id, chunk_index', 'text')} SELECT category, count(*) AS chunks, floor(avg(confidence) * 1e6 + 0.5) / 1e6 AS confidence FROM classed GROUP BY category")
def documents_by_category(spark, d):
    """The flagship: chunk every document, classify the chunks, count by category."""
    return classed(chunks(spark, d)).groupBy("category").agg(F.count("*").alias("chunks"), (F.floor(F.avg("confidence") * 1e6 + 0.5) / 1e6).alias("confidence"))


@query("C1_rules", f"WITH {_TAXONOMY}, {_best('documents', 'doc_id', 'text')} SELECT doc_id, category, subcategory, confidence FROM classed")
@query("J10_taxonomy_join", f"WITH {_TAXONOMY}, {_best('documents', 'doc_id', 'text')} SELECT doc_id, category, subcategory, confidence FROM classed")
def rules(spark, d):
    return classed(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "category", "subcategory", "confidence")


DESCRIPTORS = [(i, c, " ".join([c, s, *ck, *sk])) for i, (c, ck, s, _, sk) in enumerate(TAXONOMY)]
_DESC = "descriptors AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}', '{t}')" for i, c, t in DESCRIPTORS) + ") t(ord, category, words))"
_TF = r"""tf AS (SELECT id, tok, count(*)::DOUBLE n FROM (SELECT {0} id, unnest(regexp_extract_all(lower({1}), '[a-z]{{3,}}')) tok FROM {2}) GROUP BY id, tok)"""


def _similar_sql(key: str, text: str, source: str) -> str:
    """The nearest descriptor of each text: id, ord, sim."""
    return f"{_DESC}, " + _TF.format(key, text, source) + r""", dt AS (SELECT ord, tok, count(*)::DOUBLE m FROM (SELECT ord, unnest(regexp_extract_all(lower(words), '[a-z]{3,}')) tok FROM descriptors) GROUP BY ord, tok),
 dn AS (SELECT ord, sqrt(sum(m * m)) nrm FROM dt GROUP BY ord), tn AS (SELECT id, sqrt(sum(n * n)) nrm FROM tf GROUP BY id),
 s AS (SELECT tf.id, dt.ord, sum(n * m) / (any_value(tn.nrm) * any_value(dn.nrm)) sim FROM tf JOIN dt USING (tok) JOIN tn ON tn.id = tf.id JOIN dn ON dn.ord = dt.ord GROUP BY tf.id, dt.ord),
 nearest AS (SELECT id, ord::BIGINT AS ord, category alike, floor(least(0.7, sim) * 1000 + 0.5) / 1000 likeness FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY floor(sim * 1e9) DESC, ord) r FROM s) JOIN descriptors USING (ord) WHERE r = 1)"""


_WEIGHTS = [(i, c, Counter(re.findall("[a-z]{3,}", words.lower()))) for i, c, words in DESCRIPTORS]
#: Sum of squared counts of a sorted array's elements; p is the element before, n how often it came.
_SQUARES = "aggregate(sort_array(toks), struct('' AS p, 0L AS n, 0L AS s), (a, t) -> if(t = a.p, struct(t AS p, a.n + 1L AS n, a.s AS s), struct(t AS p, 1L AS n, a.s + a.n * a.n AS s)), a -> a.s + a.n * a.n)"


def _by_count(counts):
    """How often, and the words that occur so often as a list for IN."""
    return [(n, ", ".join(f"'{w}'" for w in sorted(counts) if counts[w] == n)) for n in sorted(set(counts.values()))]


def nearest_descriptor(texts):
    """texts: id, text. Term-frequency cosine against each descriptor; texts that share no term with any give no row.

    Descriptors are a rule table of fixed size, folded into the expression: a text is
    counted in its own row, so its terms are never shuffled. Texts of one id count as one.
    """
    whole = texts.groupBy("id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    t = whole.select("id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)).alias("toks"))
    known = sorted({w for _, _, ws in _WEIGHTS for w in ws})
    t = t.withColumn("hits", F.filter("toks", lambda w: w.isin(known))).where(F.size("hits") > 0).withColumn("tn", F.sqrt(F.expr(_SQUARES).cast("double")))
    looks = []
    for i, category, ws in _WEIGHTS:
        dot = F.expr(f"aggregate(hits, 0L, (a, w) -> a + CASE {' '.join(f'WHEN w IN ({in_list}) THEN {n}L' for n, in_list in _by_count(ws))} ELSE 0L END)").cast("double")
        looks.append((i, category, dot, sqrt(sum(n * n for n in ws.values()))))
    t = t.select("id", "tn", *(dot.alias(f"dot_{i}") for i, _, dot, _ in looks))
    each = [F.struct(F.floor(F.col(f"dot_{i}") / (F.col("tn") * dn) * 1e9).alias("k"), F.lit(-i).cast("long").alias("o"), (F.col(f"dot_{i}") / (F.col("tn") * dn)).alias("sim"), F.lit(c).alias("alike")) for i, c, _, dn in looks]
    best = F.array_max(F.array(*(F.when(F.col(f"dot_{looks[j][0]}") > 0, x) for j, x in enumerate(each))))
    return t.select("id", best.alias("x")).select("id", (-F.col("x.o")).alias("ord"), F.col("x.alike").alias("alike"), (F.floor(F.least(F.lit(0.7), "x.sim") * 1000 + 0.5) / 1000).alias("likeness"))


@query("C2_similarity", f"WITH {_similar_sql('conv_id * 100 + turn', 'text', 'conversations')} SELECT id, ord, alike AS category, likeness AS confidence FROM nearest")
def similarity(spark, d):
    t = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return nearest_descriptor(t).select("id", "ord", F.col("alike").alias("category"), F.col("likeness").alias("confidence"))


RULE_ENOUGH, WEAK = 0.72, 0.45
_METHOD = f"CASE WHEN confidence >= {RULE_ENOUGH} OR likeness IS NULL OR likeness <= confidence THEN 'rule' ELSE 'similarity' END"


def _cascade_sql(source: str, key: str, text: str) -> str:
    """Rules, then similarity: chosen has the key, category, office, method and confidence."""
    return f"{_TAXONOMY}, {_best(source, key, text)}, {_similar_sql(key, text, source)}, both_ AS (SELECT classed.*, alike, likeness, {_METHOD} method FROM classed LEFT JOIN nearest ON nearest.id = classed.{key}), chosen AS (SELECT {key}, CASE WHEN method = 'rule' THEN category ELSE alike END category, CASE WHEN method = 'rule' THEN office END office, method, CASE WHEN method = 'rule' THEN confidence ELSE likeness END confidence FROM both_)"


def cascaded(df, key: str, text: str):
    """Rules win from RULE_ENOUGH on; below, similarity wins if it is strictly better."""
    found = classed(df, text).join(nearest_descriptor(df.select(F.col(key).alias("id"), F.col(text).alias("text"))).withColumnRenamed("id", key).drop("ord"), key, "left")
    rule = F.coalesce((F.col("confidence") >= RULE_ENOUGH) | F.col("likeness").isNull() | (F.col("likeness") <= F.col("confidence")), F.lit(True))
    out = found.withColumn("rule", rule)
    return out.select(key, F.when(F.col("rule"), F.col("category")).otherwise(F.col("alike")).alias("category"), F.when(F.col("rule"), F.col("office")).alias("office"), F.when(F.col("rule"), "rule").otherwise("similarity").alias("method"), F.when(F.col("rule"), F.col("confidence")).otherwise(F.col("likeness")).alias("confidence"))


@query("C3_cascade", f"WITH {_cascade_sql('documents', 'doc_id', 'text')} SELECT doc_id, category, method, confidence, confidence < {WEAK} AS ask FROM chosen")
def cascade(spark, d):
    """`ask` marks what is too uncertain for both, where a further judge would be asked."""
    c = cascaded(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return c.select("doc_id", "category", "method", "confidence", (F.col("confidence") < WEAK).alias("ask"))


@query("C4_enriched", f"WITH {CHUNKS}, {_TAXONOMY}, h AS (SELECT doc_id, chunk_index, lang || ' ' || source || ' ' || text hay FROM chunks), {_best('h', 'doc_id, chunk_index', 'hay')} SELECT doc_id, chunk_index, category, coalesce(office, 'Unassigned') AS office, confidence FROM classed")
def enriched(spark, d):
    c = chunks(spark, d).withColumn("hay", F.concat_ws(" ", "lang", "source", "text"))
    return classed(c, "hay").select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "category", F.coalesce("office", F.lit("Unassigned")).alias("office"), "confidence")


SIGNALS = {"form": [r"\|", r"_{3,}"], "procedure": [r"(?i)\blicense", r"\d\."], "policy": [r"(?i)\bthe\b", r"(?i)\bde\b"]}


def _signal_sql(kind: str) -> str:
    return "(" + " + ".join(f"regexp_matches(text, '{p}')::INT" for p in SIGNALS[kind]) + ")"


def signal(kind: str):
    return reduce(lambda a, b: a + b, (F.col("text").rlike(tf.edged(p)).cast("int") for p in SIGNALS[kind]))


@query("C6_document_type", f"SELECT doc_id, CASE WHEN {_signal_sql('form')} >= 2 THEN 'form' WHEN {_signal_sql('procedure')} >= 2 THEN 'procedure' WHEN {_signal_sql('policy')} >= 1 THEN 'policy' ELSE 'unknown' END AS type FROM documents")
def document_type(spark, d):
    return table(spark, d, "documents").select("doc_id", F.when(signal("form") >= 2, "form").when(signal("procedure") >= 2, "procedure").when(signal("policy") >= 1, "policy").otherwise("unknown").alias("type"))


@query("C7_knowledge_type", f"WITH s AS (SELECT doc_id, {_signal_sql('form')} f, {_signal_sql('procedure')} p, {_signal_sql('policy')} + CASE WHEN {_signal_sql('form')} >= 2 THEN 4 ELSE 0 END i FROM documents) SELECT doc_id, CASE greatest(f, p, i) WHEN 0 THEN 'information' WHEN f THEN 'form' WHEN p THEN 'procedure' ELSE 'policy' END AS type FROM s")
def knowledge_type(spark, d):
    s = table(spark, d, "documents").select("doc_id", signal("form").alias("f"), signal("procedure").alias("p"), (signal("policy") + F.when(signal("form") >= 2, 4).otherwise(0)).alias("i"))
    top = F.greatest("f", "p", "i")
    return s.select("doc_id", F.when(top == 0, "information").when(top == F.col("f"), "form").when(top == F.col("p"), "procedure").otherwise("policy").alias("type"))


TYPES = {"manual": "procedure", "guide": "procedure", "memo": "policy", "rule": "policy"}


@query("C8_base_type", "SELECT p_partkey, CASE lower(string_split(p_type, ' ')[1]) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPES.items()) + " ELSE 'information' END AS type FROM part")
def base_type(spark, d):
    names = F.create_map(*(F.lit(x) for p in TYPES.items() for x in p))
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.try_element_at(names, F.lower(F.split("p_type", " ")[0])), F.lit("information")).alias("type"))


@query("C9_document_kind", f"WITH s AS (SELECT doc_id, {_signal_sql('form')} f, {_signal_sql('policy')} p FROM documents) SELECT doc_id, CASE WHEN greatest(f, p) = 0 THEN 'generic' WHEN f >= p THEN 'form' ELSE 'policy' END AS kind, least(greatest(f, p) / 5.0, 1)::DOUBLE AS confidence FROM s")
def document_kind(spark, d):
    s = table(spark, d, "documents").select("doc_id", signal("form").alias("f"), signal("policy").alias("p"))
    top = F.greatest("f", "p")
    return s.select("doc_id", F.when(top == 0, "generic").when(F.col("f") >= F.col("p"), "form").otherwise("policy").alias("kind"), F.least(top / F.lit(5.0), F.lit(1.0)).alias("confidence"))


CONTENT = [("message", "(?i)^the "), ("form_template", r"\|"), ("requirement", "(?i)licen[sc]e"), ("procedure", r"(?m)^\d+\.")]


@query("C10_content_type", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in CONTENT) + " ELSE 'policy' END AS type FROM documents")
def content_type(spark, d):
    c = reduce(lambda acc, x: acc.when(F.col("text").rlike(x[1]), x[0]), CONTENT[1:], F.when(F.col("text").rlike(CONTENT[0][1]), CONTENT[0][0]))
    return table(spark, d, "documents").select("doc_id", c.otherwise("policy").alias("type"))


ALIASES = [(3, "canad", 1.0, True), (0, "alger", 1.2, True), (6, "franc", 0.9, True), (7, "german", 1.1, True), (2, "brazil", 1.0, False)]
_ALIASES = "aliases AS (SELECT * FROM (VALUES " + ", ".join(f"({o}, '{a}', {w}, {str(x).lower()})" for o, a, w, x in ALIASES) + ") t(office_id, alias, weight, is_active))"


@query("J1_alias_rows", f"WITH {OFFICES}, {_ALIASES} SELECT office, alias, weight::DOUBLE AS weight, row_number() OVER (ORDER BY length(alias) DESC, weight DESC, alias) AS ord FROM aliases JOIN offices USING (office_id) WHERE is_active")
def alias_rows(spark, d):
    """Active aliases in matching order; a rule table, so its order comes from one small sorted array."""
    a = spark.createDataFrame(ALIASES, "office_id int, alias string, weight double, is_active boolean").where("is_active")
    rows = offices(spark, d).join(F.broadcast(a), "office_id")
    w = Window.orderBy(F.desc(F.length("alias")), F.desc("weight"), "alias")
    return rows.select("office", "alias", "weight", F.row_number().over(w).cast("long").alias("ord"))


WORDS = [(1, "hanre", 1.0), (2, "wher", 1.1), (3, "thered", 0.9), (4, "the", 1.0), (5, "que", 1.0)]
# Aliases of offices: what documents begin with, one to three words; every seventh is not active.
_OPENINGS = r"""openings AS (SELECT office_id, alias, max(weight) weight FROM (SELECT doc_id % 25 office_id, array_to_string(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ')[1:1 + doc_id % 3], ' ') alias, 0.7 + (doc_id % 11) / 10.0 AS weight FROM documents WHERE doc_id % 7 <> 0) WHERE alias <> '' GROUP BY office_id, alias)"""
_SCORE = "greatest(0.1, weight) * (0.65 + 0.35 * least(1, length(alias) / greatest(12, least(length(t), 80))::DOUBLE))"


def _matched_sql(texts: str, keys: str, rows: str) -> str:
    """CTEs that leave `sure`: the office of each text that is sure and leads the next."""
    return f"""m AS (SELECT {keys}, office_id, max({_SCORE}) s, arg_max(alias, (({_SCORE}), length(alias), alias)) alias FROM {texts} JOIN {rows} ON contains(t, alias) AND regexp_matches(t, '(^|[^a-z0-9])' || regexp_escape(alias) || '($|[^a-z0-9])') GROUP BY {keys}, office_id),
 r AS (SELECT *, least(1, s / {aliases.FULL}) AS confidence, row_number() OVER w k, lead(least(1, s / {aliases.FULL})) OVER w nxt FROM m WINDOW w AS (PARTITION BY {keys} ORDER BY s DESC, office_id)),
 sure AS (SELECT {keys}, office_id, alias, confidence FROM r WHERE k = 1 AND confidence >= {aliases.LEAST} AND (nxt IS NULL OR confidence - nxt >= {aliases.MARGIN}))"""


@query("J2_office_match", rf"""WITH {_OPENINGS}, q AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) t FROM conversations), {_matched_sql('q', 'conv_id, turn', 'openings')}
 SELECT conv_id, turn, office_id::BIGINT AS office_id, alias, floor(confidence * 1000 + 0.5) / 1000 AS confidence FROM sure""")
def office_match(spark, d):
    """The office whose alias fits best, if it is sure and leads the next by the margin."""
    words = F.array_join(F.slice(F.split(tf.normal("text"), " "), F.lit(1), (F.col("doc_id") % 3 + 1).cast("int")), " ")
    rows = table(spark, d, "documents").where("doc_id % 7 <> 0").select((F.col("doc_id") % 25).alias("office_id"), words.alias("alias"), (F.lit(0.7) + F.col("doc_id") % 11 / 10.0).alias("weight"))
    sure = aliases.offices_of(table(spark, d, "conversations"), ["conv_id", "turn"], "text", rows)
    return sure.select("conv_id", "turn", "office_id", "alias", (F.floor(F.col("confidence") * 1000 + 0.5) / 1000).alias("confidence"))


SHORT = {"help desk": "nation_3", "records": "nation_4"}
PREFERRED = ["front desk", "nation_2"]
_LABEL = "CASE c_custkey % 7 WHEN 0 THEN '  ' || n_name || ' ' WHEN 1 THEN lower(n_name) || ' desk' WHEN 2 THEN 'nowhere' WHEN 3 THEN c_mktsegment WHEN 4 THEN 'please ask the Bureau ' || c_nationkey WHEN 5 THEN 'Help  Desk' ELSE '' END"


@query(
    "J4_office_cascade",
    rf"""WITH {OFFICES}, q AS (SELECT c_custkey, trim(regexp_replace(lower({_LABEL}), '\s+', ' ', 'g')) t FROM customer JOIN nation ON c_nationkey = n_nationkey),
 bureaus AS (SELECT n_nationkey office_id, 'bureau ' || n_nationkey alias, 1.5 weight FROM nation), {_matched_sql('q', 'c_custkey', 'bureaus')},
 short AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in SHORT.items())}) v(a, b)),
 c AS (SELECT c_custkey, t, any_value(lower(o.office)) FILTER (WHERE lower(o.office) = t) exact, min(lower(o.office)) FILTER (WHERE t <> '' AND (contains(t, lower(o.office)) OR contains(lower(o.office), t))) part FROM q, offices o GROUP BY c_custkey, t),
 x AS (SELECT c_custkey, t, exact, lower(o.office) alias, part, b FROM c LEFT JOIN sure USING (c_custkey) LEFT JOIN offices o USING (office_id) LEFT JOIN short ON a = t)
 SELECT c_custkey, coalesce(exact, alias, part, b, '{PREFERRED[1]}') AS office, CASE WHEN exact IS NOT NULL THEN 0 WHEN alias IS NOT NULL THEN 1 WHEN part IS NOT NULL THEN 2 WHEN b IS NOT NULL THEN 3 ELSE 4 END::BIGINT AS tier FROM x""",
)
def office_cascade(spark, d):
    """Exact name, else a sure alias, else one name inside the other, else a shorthand, else the first preferred office. The 25 names are a fixed table kept in one array."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    q = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", F.expr(_LABEL).alias("label")).withColumn("t", tf.normal("label"))
    sure = aliases.offices_of(q, ["c_custkey"], "label", n.select(F.col("n_nationkey").alias("office_id"), F.concat(F.lit("bureau "), F.col("n_nationkey").cast("string")).alias("alias"), F.lit(1.5).alias("weight")))
    by_alias = sure.join(F.broadcast(n), F.col("office_id") == n.n_nationkey).select("c_custkey", tf.normal("n_name").alias("by_alias"))
    names = offices(spark, d).agg(F.sort_array(F.collect_list(tf.normal("office"))).alias("names"))
    exact = F.when(F.array_contains("names", F.col("t")), F.col("t"))
    part = F.when(F.col("t") != "", F.get(F.filter("names", lambda o: F.contains(F.col("t"), o) | F.contains(o, F.col("t"))), F.lit(0)))
    short = F.try_element_at(F.create_map(*(F.lit(x) for p in SHORT.items() for x in p)), F.col("t"))
    short = F.when(F.array_contains("names", short), short)
    default = F.coalesce(*(F.when(F.array_contains("names", F.lit(p)), F.lit(p)) for p in PREFERRED), F.get("names", F.lit(0)))
    tiers = [exact, F.col("by_alias"), part, short]
    tier = reduce(lambda w, x: w.when(x[1].isNotNull(), x[0]), list(enumerate(tiers))[1:], F.when(tiers[0].isNotNull(), 0)).otherwise(4)
    return q.join(by_alias, "c_custkey", "left").crossJoin(F.broadcast(names)).select("c_custkey", F.coalesce(*tiers, default).alias("office"), tier.cast("long").alias("tier"))


_TOLD = "told AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) told FROM conversations WHERE role = 'user' GROUP BY conv_id)"
_LEVEL = f"CASE WHEN {_hits('k', URGENT)} >= 1 THEN 'Urgent' WHEN {_hits('k', HIGH)} + {_hits('p', HIGH)} >= 2 THEN 'High' WHEN {_hits('k', MEDIUM)} >= 1 THEN 'Medium' ELSE 'Low' END"


@query("C23_triage", rf"WITH {ASKED}, {_TOLD}, {_cascade_sql('asked', 'conv_id', 'question')}, n AS (SELECT conv_id, trim(regexp_replace(lower(told), '\s+', ' ', 'g')) k, trim(regexp_replace(lower(told), '[^a-z0-9]+', ' ', 'g')) p FROM told), o AS (SELECT conv_id, CASE WHEN office IS NOT NULL THEN office " + " ".join(f"WHEN contains(k, '{a}') THEN 'desk {o}'" for o, a, _ in WORDS) + f" ELSE 'ALGERIA' END office, {_LEVEL} priority, category, method, confidence FROM chosen JOIN n USING (conv_id)) SELECT conv_id, category, method, office, priority, confidence FROM o")
def triage(spark, d):
    """Category by the cascade on the question, office of the rule or of an alias in the whole request, priority by its words."""
    c = table(spark, d, "conversations").where("role = 'user'")
    told = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("told"))
    k, p = tf.normal("told"), tf.title_key("told")
    level = F.when(tf.hits(k, URGENT) >= 1, "Urgent").when(tf.hits(k, HIGH) + tf.hits(p, HIGH) >= 2, "High").when(tf.hits(k, MEDIUM) >= 1, "Medium").otherwise("Low")
    alias = F.coalesce(*(F.when(F.contains(k, F.lit(a)), F.lit(f"desk {o}")) for o, a, _ in WORDS), F.lit("ALGERIA"))
    told = told.select("conv_id", level.alias("priority"), alias.alias("alias"))
    return cascaded(asked(spark, d), "conv_id", "question").join(told, "conv_id").select("conv_id", "category", "method", F.coalesce("office", "alias").alias("office"), "priority", "confidence")


@query("C28_intents", r"SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)^the') THEN 'policy' WHEN contains(text, '|') THEN 'form' WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'requirement' ELSE 'information' END AS article_type, (regexp_matches(text, '(?i)licen[sc]e')::INT + regexp_matches(text, '\|')::INT + regexp_matches(text, '(?i)\bthe\b')::INT)::BIGINT AS intents FROM documents")
def intents(spark, d):
    hits = [F.col("text").rlike(tf.edged(p)) for p in ("(?i)licen[sc]e", r"\|", r"(?i)\bthe\b")]
    found = F.array_compact(F.array(*(F.when(h, F.lit(i)) for i, h in enumerate(hits))))
    kind = F.when(F.col("text").rlike("(?i)^the"), "policy").when(F.contains("text", F.lit("|")), "form").when(hits[0], "requirement").otherwise("information")
    return table(spark, d, "documents").select("doc_id", kind.alias("article_type"), F.size(found).cast("long").alias("intents"))


@query("C34_category_map", "SELECT s_suppkey, CASE WHEN s_acctbal > 8000 THEN 'Preferred' WHEN n_name LIKE 'A%' THEN 'Records' WHEN s_name LIKE '%7' THEN 'Scholarship' ELSE 'General' END AS category FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def category_map(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    kind = F.when(F.col("s_acctbal") > 8000, "Preferred").when(F.col("n_name").like("A%"), "Records").when(F.col("s_name").like("%7"), "Scholarship").otherwise("General")
    return s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", kind.alias("category"))


@query("C38_group_name", "SELECT p_partkey, coalesce(CASE WHEN p_retailprice > 1500 THEN 'office:' || p_brand END, CASE WHEN p_size > 25 THEN 'category:' || p_type END, 'Uncategorized') AS grp FROM part")
def group_name(spark, d):
    g = F.coalesce(F.when(F.col("p_retailprice") > 1500, F.concat(F.lit("office:"), "p_brand")), F.when(F.col("p_size") > 25, F.concat(F.lit("category:"), "p_type")), F.lit("Uncategorized"))
    return table(spark, d, "part").select("p_partkey", g.alias("grp"))
