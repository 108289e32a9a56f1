"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions.portuguese import MOST_LETTERS, stem, stem_sql, stop_words
from quarry.operators import cite, evaluate, expand, lookup, ordered, search, temporal, tree

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
AT = "1998-06-01"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- validity and versions


def _order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.version_chain(t(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"])


_VERSIONS = """SELECT *, row_number() OVER w AS version, lead(o_orderdate) OVER w AS valid_to, lead(1) OVER w IS NULL AS is_current
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""


@query(f"SELECT o_custkey, o_orderkey, CAST(version AS INT) AS version, o_orderdate, valid_to, is_current FROM ({_VERSIONS})")
def q_version_chain(spark, sf_dir):
    return _order_versions(spark, sf_dir).select("o_custkey", "o_orderkey", "version", "o_orderdate", "valid_to", "is_current")


@query(f"SELECT o_custkey, o_orderkey, o_totalprice FROM ({_VERSIONS}) WHERE o_orderdate <= TIMESTAMP '{AT}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AT}')")
def q_in_force_at(spark, sf_dir):
    at = F.lit(AT).cast("timestamp_ntz")
    return _order_versions(spark, sf_dir).where(temporal.in_force(at, "o_orderdate", "valid_to")).select("o_custkey", "o_orderkey", "o_totalprice")


@query(f"SELECT o_custkey, o_orderkey, is_current FROM ({_VERSIONS}) WHERE o_orderdate <= TIMESTAMP '{AT}'")
def q_include_revoked(spark, sf_dir):
    at = F.lit(AT).cast("timestamp_ntz")
    return _order_versions(spark, sf_dir).where(temporal.in_force(at, "o_orderdate", "valid_to", include_revoked=True)).select("o_custkey", "o_orderkey", "is_current")


@query("""SELECT p.event_id, p.user_id, p.ts, v.event_id AS version_id, v.ts AS ts_found
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def q_as_of_join(spark, sf_dir):
    events = t(spark, sf_dir, "events")
    probes = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    versions = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("version_id"), F.col("ts"))
    found = temporal.as_of_join(probes, versions, ["user_id"], "ts", "ts", ["version_id"], ["version_id"])
    return found.select("event_id", "user_id", "ts", "version_id", "ts_found")


# ---- joins


@query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q_semi(spark, sf_dir):
    return lookup.by_ids(t(spark, sf_dir, "documents").select("doc_id", "lang"), t(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q_anti(spark, sf_dir):
    return lookup.without(t(spark, sf_dir, "documents").select("doc_id", "lang"), t(spark, sf_dir, "labels"), "doc_id")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def q_left_fallback(spark, sf_dir):
    return lookup.with_defaults(t(spark, sf_dir, "documents").select("doc_id"), t(spark, sf_dir, "labels"), "doc_id", {"quality": -1, "toxic": -1})


@query("SELECT l.doc_id, CAST(row_number() OVER (ORDER BY d.n_chars DESC, l.doc_id) AS INT) AS rank, d.lang, l.quality FROM labels l JOIN documents d ON d.doc_id = l.doc_id QUALIFY rank <= 50")
def q_hydrate(spark, sf_dir):
    """The 50 longest labelled documents: a top-k report, hydrated after the cut."""
    docs, labels = t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels")
    top = lookup.by_ids(docs.select("doc_id", "n_chars"), labels, "doc_id").orderBy(F.desc("n_chars"), "doc_id").limit(50)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")))
    shown = lookup.hydrate(lookup.hydrate(ranked, docs.select("doc_id", "lang"), "doc_id"), labels.select("doc_id", "quality"), "doc_id")
    return shown.select("doc_id", "rank", "lang", "quality")


@query("SELECT d.doc_id, b.item_id, CAST(instr(d.text, b.text) AS INT) AS at FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def q_overlap_contains(spark, sf_dir):
    return cite.contained(t(spark, sf_dir, "documents"), t(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "at")


# ---- trees: region / nation / customer as paths


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer = (t(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    r = region.select(F.concat(F.lit("r"), "r_regionkey").alias("path"), F.lit("titulo").alias("type"), F.col("r_regionkey").cast("long").alias("ordinal"), F.col("r_name").alias("name"))
    n = nation.select(F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey").alias("path"), F.lit("secao").alias("type"), F.col("n_nationkey").cast("long").alias("ordinal"), F.col("n_name").alias("name"))
    c = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(  # nation is a fixed table of 25 rows
        F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey", F.lit("/c"), "c_custkey").alias("path"), F.lit("artigo").alias("type"), (-F.col("c_custkey")).alias("ordinal"), F.col("c_name").alias("name")
    )
    return r.union(n).union(c)


_TREE = """(SELECT 'r' || r_regionkey AS path, 'titulo' AS type, CAST(r_regionkey AS BIGINT) AS ordinal, r_name AS name, NULL AS parent FROM region
UNION ALL SELECT 'r' || n_regionkey || '/n' || n_nationkey, 'secao', n_nationkey, n_name, 'r' || n_regionkey FROM nation
UNION ALL SELECT 'r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey, 'artigo', -c_custkey, c_name, 'r' || n_regionkey || '/n' || n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(f"""WITH tree AS {_TREE} SELECT path, parent AS ancestor, 1 AS distance FROM tree WHERE parent IS NOT NULL
UNION ALL SELECT c.path, n.parent, 2 FROM tree c JOIN tree n ON n.path = c.parent WHERE n.parent IS NOT NULL""")
def q_path_closure(spark, sf_dir):
    return tree.ancestors(_tree(spark, sf_dir)).select("path", "ancestor", "distance")


@query(f"WITH tree AS {_TREE} SELECT r.path AS root, d.path FROM tree r JOIN tree d ON starts_with(d.path, r.path || '/') WHERE r.type = 'secao'")
def q_subtree(spark, sf_dir):
    nodes = _tree(spark, sf_dir)
    return tree.subtree(nodes, nodes.where("type = 'secao'")).select("root", "path")


@query(f"""WITH tree AS {_TREE} SELECT path, CASE type WHEN 'secao' THEN path WHEN 'artigo' THEN parent END AS nearest FROM tree""")
def q_nearest_ancestor(spark, sf_dir):
    return tree.nearest_of_type(_tree(spark, sf_dir), ["secao"]).select("path", "nearest")


@query("""SELECT path, CAST(row_number() OVER (ORDER BY r, kind, n, c DESC) AS BIGINT) AS position FROM (
SELECT 'r' || r_regionkey AS path, r_regionkey AS r, 0 AS kind, -1 AS n, 0 AS c FROM region
UNION ALL SELECT 'r' || n_regionkey || '/n' || n_nationkey, n_regionkey, 1, n_nationkey, CAST(9223372036854775807 AS BIGINT) FROM nation
UNION ALL SELECT 'r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey, n_regionkey, 1, n_nationkey, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def q_doc_order(spark, sf_dir):
    """Reading order: ranges of the key give the partitions, counts of earlier ones the start of each."""
    placed = tree.document_order(_tree(spark, sf_dir)).select("path", "doc_key")
    return ordered.numbered(placed, ["doc_key"]).select("path", "position")


_RICH = "c_mktsegment = 'BUILDING' AND c_acctbal > 9000"


@query(f"""WITH kept AS (SELECT * FROM customer WHERE {_RICH})
SELECT 'r' || r_regionkey AS path, CAST(NULL AS VARCHAR) AS parent_path FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation JOIN kept ON c_nationkey = n_nationkey)
UNION ALL SELECT 'r' || n_regionkey || '/n' || n_nationkey, 'r' || n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM kept)
UNION ALL SELECT 'r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey, 'r' || n_regionkey || '/n' || n_nationkey FROM kept JOIN nation ON c_nationkey = n_nationkey""")
def q_prune_reattach(spark, sf_dir):
    rich = t(spark, sf_dir, "customer").where(_RICH).select(F.concat(F.lit("c"), "c_custkey").alias("last"))
    nodes = _tree(spark, sf_dir).withColumn("last", F.element_at(tree.segments(F.col("path")), -1))
    nodes = nodes.where("type <> 'artigo'").unionByName(nodes.join(rich, "last", "left_semi").select(*nodes.columns))
    return tree.prune_empty(nodes, X.is_structural(F.col("type")), F.col("type") == "artigo").select("path", "parent_path")


# ---- order-sensitive operators over events


@query("SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS ordinal FROM events")
def q_sibling_ordinal(spark, sf_dir):
    return ordered.sibling_ordinal(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "ordinal")


@query("SELECT event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS max_before FROM events")
def q_running_max(spark, sf_dir):
    return ordered.running_max_before(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "value", "max_before")


@query("SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM events")
def q_islands(spark, sf_dir):
    return ordered.islands(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup").select("event_id", "user_id", "island")


@query("SELECT event_id, bool_or(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seen FROM events")
def q_cum_flag(spark, sf_dir):
    return ordered.flag_from(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase").select("event_id", "seen")


@query("SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def q_dedup_first(spark, sf_dir):
    return ordered.first_of(t(spark, sf_dir, "events"), ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")]).select("user_id", "event_type", "event_id", "ts")


@query("""WITH new AS (SELECT * FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
old AS (SELECT * FROM events WHERE event_type = 'signup' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1)
SELECT user_id, event_id, event_type FROM new UNION ALL SELECT user_id, event_id, event_type FROM old WHERE user_id NOT IN (SELECT user_id FROM new)""")
def q_upsert_latest(spark, sf_dir):
    events = t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    old = ordered.first_of(events.where("event_type = 'signup'"), ["user_id"], [F.asc("ts"), F.asc("event_id")])
    return ordered.upsert(old, events.where("event_type = 'purchase'"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


# ---- scalar functions


@query("""WITH n AS (SELECT DISTINCT p_size AS v FROM part)
SELECT v AS p_size, (['', 'M', 'MM', 'MMM', 'MMMM'])[v // 1000 + 1] || (['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'])[v // 100 % 10 + 1]
|| (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[v // 10 % 10 + 1] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[v % 10 + 1] AS roman, v AS back FROM n""")
def q_roman(spark, sf_dir):
    sizes = t(spark, sf_dir, "part").select("p_size").distinct().withColumn("roman", X.int_to_roman(F.col("p_size")))
    return sizes.withColumn("back", X.roman_to_int(F.col("roman")))


@query(f"SELECT doc_id, md5(trim(regexp_replace(lower(translate(text, '{X.ACCENTED}', '{X.PLAIN}')), '[\\s\\x{{00A0}}]+', ' ', 'g'))) AS normal_md5 FROM documents")
def q_normalise(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(X.normalise(F.col("text"))).alias("normal_md5"))


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path,
regexp_extract(url, '\\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages""")
def q_url_parts(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", X.url_parts(F.col("url")).alias("u")).select("page_id", "u.*")


@query("SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def q_sha_keys(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.text_key(F.col("text")).alias("text_sha256"))


@query(f"""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
FROM (SELECT doc_id, lower(sha1(unhex('{X.POINT_NAMESPACE.replace("-", "")}') || encode('doc:' || doc_id))) AS h FROM documents)""")
def q_uuid5(spark, sf_dir):
    """Point ids; compared with Python's uuid5 in the tests too."""
    return t(spark, sf_dir, "documents").select("doc_id", X.uuid5(F.concat(F.lit("doc:"), "doc_id")).alias("point_id"))


@query("SELECT o_orderkey, CAST(date_diff('day', DATE '0001-01-01', CAST(o_orderdate AS DATE)) + 1 AS INT) AS day FROM orders")
def q_day_ordinal(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", X.day_number(F.col("o_orderdate").cast("date")).alias("day"))


LABEL = r"^\s*([IVXLCDM]+|[a-z]|\d{1,3})\s*[-.)|]"


@query(f"SELECT doc_id, regexp_extract(text, '{LABEL}', 1) AS label, CASE WHEN regexp_matches(text, '^(?s)\\s*[A-ZÀ-Þ]') THEN 'prose' ELSE 'other' END AS opening, len(regexp_extract_all(text, '[.!?]')) AS sentences FROM documents")
def q_label_classify(spark, sf_dir):
    opening = F.when(F.col("text").rlike(r"^\s*[A-ZÀ-Þ]"), "prose").otherwise("other")
    return t(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", LABEL, 1).alias("label"), opening.alias("opening"), F.size(F.regexp_extract_all("text", F.lit("[.!?]"), 0)).cast("long").alias("sentences"))


@query("""SELECT page_id, CAST(i - 1 AS INT) AS pos, href FROM (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) AS i
FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages))""")
def q_xrefs(spark, sf_dir):
    """Outgoing links of every page, in order."""
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    return t(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("pos", "href"))


@query()
def q_block_extract(spark, sf_dir):
    """Leaf blocks of every page; compared with small pages in the tests."""
    from quarry.sources.html import blocks

    return blocks(t(spark, sf_dir, "pages").select("page_id", "html"), ["page_id"])


# ---- retrieval

_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda x: x <> '')"
_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')"
_POSTS = f"""words AS (SELECT doc_id AS id, {_TOKENS} AS w FROM documents),
posts AS (SELECT id, term, count(*) AS tf, any_value(n) AS length FROM (SELECT id, len(w) AS n, unnest(w) AS term FROM words) GROUP BY id, term),
dfs AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM posts GROUP BY term)"""


@query(f"WITH {_POSTS} SELECT id AS doc_id, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS words, max(tf) AS most FROM posts GROUP BY id")
def q_postings(spark, sf_dir):
    posts = search.postings(t(spark, sf_dir, "documents"))
    return posts.groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("words"), F.max("tf").alias("most"))


@query(f"WITH {_POSTS} SELECT term, df, round(idf, 6) AS idf FROM dfs")
def q_idf(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    return search.idf(search.postings(docs), docs.count()).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"""WITH {_POSTS}, asked AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark),
scored AS (SELECT query_id, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / 256.0))), 6) AS score FROM asked JOIN posts USING (term) JOIN dfs USING (term) GROUP BY query_id, id)
SELECT query_id, id AS doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM scored QUALIFY rank <= 10""")
def q_bm25_topk(spark, sf_dir):
    docs, asked = t(spark, sf_dir, "documents"), t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.bm25(asked, search.packed(docs, search.asked_terms(asked)), docs.count(), k=10).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


_COSINE = """dense AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))
/ sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / sqrt(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))), 6) AS score, q.label AS ql, e.label AS el
FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def _asked(vectors: DataFrame) -> DataFrame:
    """The stated query set: every id divisible by 20."""
    return vectors.where("id % 20 = 0").withColumnRenamed("id", "query_id")


@query(f"WITH {_COSINE} SELECT query_id, id AS vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM dense QUALIFY rank <= 10")
def q_cosine_topk(spark, sf_dir):
    vectors = _vectors(spark, sf_dir).drop("label")
    return search.cosine(_asked(vectors), vectors, k=10).select("query_id", F.col("id").alias("vec_id"), "score", "rank")


@query(ORACLE["q_cosine_topk"])
def q_vector_index_topk(spark, sf_dir):
    """The same rows from an index of parts, of which those are skipped that cannot hold a near vector."""
    from quarry.plans.vectors import VectorIndex

    vectors = _vectors(spark, sf_dir).drop("label")
    return VectorIndex.build(vectors).search(_asked(vectors), k=10).select("query_id", F.col("id").alias("vec_id"), "score", "rank")


def _rrf_sql(filtered: bool) -> str:
    d = " WHERE ql = el" if filtered else ""
    s = " JOIN documents a ON a.doc_id = query_id JOIN documents b ON b.doc_id = id AND b.lang = a.lang" if filtered else ""
    return f"""WITH {_POSTS}, {_COSINE}, asked AS (SELECT DISTINCT id AS query_id, unnest(w) AS term FROM words WHERE id IN (SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0)),
sparse AS (SELECT query_id, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / 256.0))), 6) AS score FROM asked JOIN posts USING (term) JOIN dfs USING (term){s} GROUP BY query_id, id),
legs AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM dense{d} QUALIFY r <= 150
UNION ALL SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM sparse QUALIFY r <= 150),
fused AS (SELECT query_id, id, round(sum(1.0 / (2 + r - 1)), 6) AS score FROM legs GROUP BY query_id, id)
SELECT query_id, id AS doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM fused QUALIFY rank <= 8"""


def _legs(spark: SparkSession, sf_dir: str, filtered: bool) -> DataFrame:
    docs, vectors = t(spark, sf_dir, "documents").select("doc_id", "text", "lang"), _vectors(spark, sf_dir)
    asked = _asked(vectors.withColumnRenamed("label", "group"))
    texts = docs.join(asked.select(F.col("query_id").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("query_id"), "text", F.col("lang").alias("ql"))
    n = docs.count()
    if not filtered:
        posts = search.packed(docs, search.asked_terms(texts))
        return search.fuse([search.cosine(asked.drop("group"), vectors.drop("label"), search.LEG), search.bm25(texts.drop("ql"), posts, n)])
    dense = search.cosine(asked, vectors.withColumnRenamed("label", "group"), search.LEG)
    # one leg for each language: the filter comes before the cut
    terms = search.asked_terms(texts.withColumnRenamed("ql", "group"), search.LETTERS, "group")
    posts = search.packed(docs.withColumnRenamed("lang", "group"), terms, more=("group",))
    return search.fuse([dense, search.best_of_blocks(terms, posts, n, search.LEG)])


@query(_rrf_sql(False))
def q_rrf_hybrid(spark, sf_dir):
    return _legs(spark, sf_dir, False).where(F.col("rank") <= search.FINAL).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


@query(_rrf_sql(True))
def q_rrf_filtered_legs(spark, sf_dir):
    return _legs(spark, sf_dir, True).where(F.col("rank") <= search.FINAL).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


_PAIRS = "(SELECT c.conv_id AS query_id, c.turn AS id, c.turn AS rank, q.text AS question, c.text AS passage FROM conversations c JOIN conversations q ON q.conv_id = c.conv_id AND q.turn = 0)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = t(spark, sf_dir, "conversations")
    first = turns.where("turn = 0").select("conv_id", F.col("text").alias("question"))
    return turns.join(first, "conv_id").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("id"), F.col("turn").alias("rank"), "question", F.col("text").alias("passage"))


@query(f"SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS rank FROM {_PAIRS} QUALIFY rank <= 16")
def q_rerank_identity(spark, sf_dir):
    return search.rerank(_pairs(spark, sf_dir), F.lit(None)).select("query_id", "id", "rank")


_T = lambda c: f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}]+'), lambda x: x <> ''))"


@query(f"""SELECT query_id, id, score AS rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS INT) AS rank FROM
(SELECT query_id, id, rank AS old, round(len(list_intersect({_T('question')}, {_T('passage')})) / greatest(len({_T('question')}), 1), 6) AS score FROM {_PAIRS}) QUALIFY rank <= 16""")
def q_rerank_overlap(spark, sf_dir):
    return search.rerank(_pairs(spark, sf_dir), search.overlap_score(F.col("question"), F.col("passage"))).select("query_id", "id", "rerank_score", "rank")


# ---- passages: a conversation is an article, its turns the lines; the first and the longest are reserved

_LIMIT = 1500


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = t(spark, sf_dir, "conversations").withColumn("line", F.concat_ws(": ", "role", "text"))
    longest = Window.partitionBy("conv_id").orderBy(F.length("line").desc(), "turn")
    marked = turns.withColumn("reserved", (F.col("turn") == 0) | (F.row_number().over(longest) == 1))
    return expand.budget(marked, ["conv_id"], ["turn"], F.length("line") + 1, F.col("reserved"), _LIMIT)


_LINES = f"""lines AS (SELECT conv_id, turn, concat_ws(': ', role, text) AS line FROM conversations),
marked AS (SELECT *, turn = 0 OR row_number() OVER (PARTITION BY conv_id ORDER BY length(line) DESC, turn) = 1 AS reserved FROM lines),
kept AS (SELECT *, reserved OR coalesce(sum(CASE WHEN reserved THEN length(line) + 1 ELSE 0 END) OVER (PARTITION BY conv_id), 0)
 + sum(CASE WHEN reserved THEN 0 ELSE length(line) + 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) <= {_LIMIT} AS kept,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM marked),
shown AS (SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY conv_id ORDER BY turn) > 1, false) AS mark FROM kept WHERE kept),
placed AS (SELECT *, CAST(coalesce(sum(length(line) + 1 + CASE WHEN mark THEN 4 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN mark THEN 4 ELSE 0 END AS BIGINT) AS begins FROM shown)"""


@query(f"WITH {_LINES} SELECT conv_id, turn, kept FROM kept")
def q_expand_budget(spark, sf_dir):
    return _lines(spark, sf_dir).select("conv_id", "turn", "kept")


@query(f"WITH {_LINES} SELECT conv_id, md5(string_agg(CASE WHEN mark THEN '[…]' || chr(10) || line ELSE line END, chr(10) ORDER BY turn)) AS passage_md5 FROM shown GROUP BY conv_id")
def q_omission_marks(spark, sf_dir):
    texts = expand.passages(expand.with_marks(_lines(spark, sf_dir), ["conv_id"], ["turn"]), ["conv_id"], ["turn"])
    return texts.select("conv_id", F.md5("text").alias("passage_md5"))


@query(f"WITH {_LINES} SELECT conv_id, turn, begins AS start, CAST(begins + length(line) AS BIGINT) AS \"end\" FROM placed")
def q_offsets(spark, sf_dir):
    marked = expand.with_marks(_lines(spark, sf_dir), ["conv_id"], ["turn"])
    return expand.with_offsets(marked, ["conv_id"], ["turn"]).select("conv_id", "turn", "start", "end")


@query(f"""WITH {_LINES}, spans AS (SELECT conv_id, turn AS span_id, begins - 40 AS f, begins + 60 AS t FROM placed)
SELECT conv_id, span_id, turn, CAST(shared AS BIGINT) AS shared FROM (SELECT s.conv_id, span_id, p.turn, least(t, begins + length(line)) - greatest(f, begins) AS shared FROM spans s JOIN placed p ON p.conv_id = s.conv_id)
WHERE shared > 0 QUALIFY row_number() OVER (PARTITION BY conv_id, span_id ORDER BY shared DESC, turn) = 1""")
def q_overlap_argmax(spark, sf_dir):
    lines = expand.with_offsets(expand.with_marks(_lines(spark, sf_dir), ["conv_id"], ["turn"]), ["conv_id"], ["turn"])
    spans = lines.select("conv_id", F.col("turn").alias("span_id"), (F.col("start") - 40).alias("from"), (F.col("start") + 60).alias("to"))
    return expand.overlap(spans, lines.select("conv_id", "turn", "start", "end"), ["conv_id"], ["turn"]).select("conv_id", "span_id", "turn", "shared")


_BY_SOURCE = f"WITH hits AS ({_rrf_sql(False)}), grouped AS (SELECT query_id, source, min(rank) AS best, max(score) AS score, count(*) AS found FROM hits JOIN documents USING (doc_id) GROUP BY query_id, source)"


def _by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lookup.hydrate(q_rrf_hybrid(spark, sf_dir), t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return expand.in_order_of_best(expand.first_seen(hits, ["query_id"], ["source"]), ["query_id"], ["source"])


@query(f"{_BY_SOURCE} SELECT query_id, source, score, found, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best) AS INT) AS rank FROM grouped")
def q_first_seen_groups(spark, sf_dir):
    return _by_source(spark, sf_dir).select("query_id", "source", "score", "found", "rank")


@query(f"{_BY_SOURCE} SELECT query_id, 'D' || row_number() OVER (PARTITION BY query_id ORDER BY best) AS ref, source FROM grouped")
def q_refs(spark, sf_dir):
    return _by_source(spark, sf_dir).select("query_id", cite.ref(F.col("rank")).alias("ref"), "source")


# ---- evaluation: labels of neighbours are what a search should find

_RANKED = f"ranked AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, ql, el FROM dense WHERE query_id <> id QUALIFY rank <= 20)"
_FOUND = """expected AS (SELECT DISTINCT query_id, e FROM (SELECT query_id, unnest([ql, (ql + 1) % 10]) AS e FROM dense)),
found AS (SELECT x.query_id, x.e, min(r.rank) AS position, any_value(x.e) AS any_e FROM expected x LEFT JOIN ranked r ON r.query_id = x.query_id AND r.el = x.e GROUP BY x.query_id, x.e),
measured AS (SELECT query_id, round(avg(CASE WHEN position <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN position <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10,
round(avg(CASE WHEN position <= 20 THEN 1.0 ELSE 0.0 END), 6) AS recall_20, round(coalesce(1.0 / min(position), 0.0), 6) AS mrr FROM found GROUP BY query_id)"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    asked = _asked(vectors)
    near = search.cosine(asked.drop("label"), vectors.drop("label"), k=20, same_id=False).join(vectors.select("id", F.col("label").alias("covered")), "id")
    rankings = near.select(F.col("query_id").alias("item"), F.col("rank").alias("position"), "covered")
    expected = asked.select(F.col("query_id").alias("item"), F.explode(F.array("label", (F.col("label") + 1) % 10)).alias("expected")).distinct()
    return evaluate.hits(expected, rankings)


@query(f"WITH {_COSINE}, {_RANKED}, {_FOUND} SELECT query_id AS item, recall_5, recall_10, recall_20, mrr FROM measured")
def q_recall_mrr(spark, sf_dir):
    return evaluate.recall_and_mrr(_found(spark, sf_dir))


@query(f"""WITH {_COSINE}, {_RANKED}, {_FOUND} SELECT CASE WHEN grouping(label) = 1 THEN 'all' ELSE 'group' END AS level, label, count(*) AS items,
round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(recall_20), 6) AS recall_20, round(avg(mrr), 6) AS mrr
FROM measured JOIN embeddings ON vec_id = query_id GROUP BY GROUPING SETS ((), (label))""")
def q_eval_grouping_sets(spark, sf_dir):
    items = evaluate.recall_and_mrr(_found(spark, sf_dir)).join(_vectors(spark, sf_dir).select(F.col("id").alias("item"), "label"), "item")
    return evaluate.report(items, "label", ["recall_5", "recall_10", "recall_20", "mrr"]).select("level", "label", "items", "recall_5", "recall_10", "recall_20", "mrr")


@query(f"WITH {_COSINE}, {_RANKED}, {_FOUND} SELECT query_id AS item, e AS expected FROM found WHERE coalesce(position, 99) > 5")
def q_missing(spark, sf_dir):
    return evaluate.missing(_found(spark, sf_dir), 5)


@query("""SELECT d.lang, count(*) AS n, round(avg(toxic), 6) AS toxic_rate, round(avg(CASE WHEN toxic = 0 THEN quality END), 6) AS quality_if_clean, round(coalesce(avg(CASE WHEN n_chars > 5000 THEN toxic END), 0), 6) AS long_toxic_rate
FROM documents d JOIN labels l USING (doc_id) GROUP BY d.lang""")
def q_abstention_rates(spark, sf_dir):
    joined = t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(t(spark, sf_dir, "labels"), "doc_id")
    toxic, clean = F.col("toxic"), F.col("toxic") == 0
    measures = {"toxic_rate": (F.lit(True), toxic), "quality_if_clean": (clean, F.col("quality")), "long_toxic_rate": (F.col("n_chars") > 5000, toxic)}
    return evaluate.rates(joined, ["lang"], measures, {"quality_if_clean": None, "toxic_rate": None}).withColumnRenamed("items", "n")


@query("""SELECT d.source, CAST(sum(floor(n_chars / 3.0)) AS BIGINT) AS tokens, CASE WHEN bool_or(p.price IS NULL) THEN NULL ELSE round(sum(floor(n_chars / 3.0) * p.price / 1000000), 9) END AS cost
FROM documents d LEFT JOIN (VALUES ('src1', 3.0), ('src10', 5.0), ('src2', 1.0), ('src3', 2.0)) p(prefix, price) ON starts_with(d.source, p.prefix)
AND length(p.prefix) = (SELECT max(length(x.prefix)) FROM (VALUES ('src1'), ('src10'), ('src2'), ('src3')) x(prefix) WHERE starts_with(d.source, x.prefix)) GROUP BY d.source""")
def q_cost_null_poison(spark, sf_dir):
    """Token costs by the longest price prefix; a source with an unpriced row has no total."""
    prices = spark.createDataFrame([("src1", 3.0, 0.0), ("src10", 5.0, 0.0), ("src2", 1.0, 0.0), ("src3", 2.0, 0.0)], "prefix string, input double, output double")
    calls = t(spark, sf_dir, "documents").groupBy(F.col("source").alias("model")).agg(F.sum(evaluate.estimated_tokens(F.col("n_chars"))).alias("tokens"))
    priced = evaluate.price(prices, calls)
    zero = F.lit(0)
    return priced.groupBy(F.col("model").alias("source")).agg(F.sum("tokens").alias("tokens"), F.round(evaluate.total_or_null(evaluate.cost(F.col("tokens"), zero, zero, F.col("input_price"), F.col("output_price"))), 9).alias("cost"))


@query(f"""WITH {_COSINE}, {_RANKED}, {_FOUND} SELECT CASE WHEN grouping(mechanism) = 1 THEN 'all' ELSE 'group' END AS level, mechanism, count(*) AS items,
round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(recall_20), 6) AS recall_20, round(avg(mrr), 6) AS mrr
FROM measured JOIN (SELECT vec_id, 'm' || label AS mechanism FROM embeddings WHERE vec_id % 100 <> 0) ON vec_id = query_id GROUP BY GROUPING SETS ((), (mechanism))""")
def q_gold_report(spark, sf_dir):
    """A gold run over neighbours as passages: a neighbour shows a wording of its label; every fifth item is one to abstain from."""
    from quarry.plans import gold_run

    vectors = _vectors(spark, sf_dir)
    label = lambda c: F.concat(F.lit("n!l"), c.cast("string"))
    own = F.col("label")
    asked = _asked(vectors).select("query_id", "vector", F.col("query_id").cast("string").alias("item"), F.concat(F.lit("m"), "label").alias("mechanism"), F.array(label(own), label((own + 1) % 10)).alias("expected"), (F.col("query_id") % 100 == 0).alias("should_abstain"))
    near = search.cosine(asked.select("query_id", "vector"), vectors.drop("label"), k=20, same_id=False).join(vectors.select("id", "label"), "id")
    passages = near.select("query_id", "rank", F.array(F.concat(label(own), F.lit("@2"))).alias("provisions"))
    return gold_run.report(gold_run.measured(asked, passages))


@query("""WITH each AS (SELECT doc_id, CASE WHEN doc_id % 10 <> 3 THEN sha256(coalesce(text, '')) END AS k, n_chars FROM documents), cache AS (SELECT DISTINCT k FROM each JOIN labels USING (doc_id) WHERE toxic = 0),
once AS (SELECT k, any_value(n_chars) AS n FROM each WHERE k IS NOT NULL AND k NOT IN (SELECT k FROM cache WHERE k IS NOT NULL) GROUP BY k)
SELECT (SELECT count(*) FROM each) AS questions, (SELECT count(*) FROM each WHERE k IS NULL) AS no_candidates, (SELECT count(*) FROM each WHERE k IN (SELECT k FROM cache)) AS stored, count(*) AS payable,
round(sum((floor(n / 3.0) * 3.0 + 500 * 15.0) / 1000000), 9) AS least_cost, round(sum((floor(n / 3.0) * 3.0 + 8192 * 15.0) / 1000000), 9) AS most_cost FROM once""")
def q_cost_estimate(spark, sf_dir):
    """Documents as requests, those of every tenth without passages; labelled clean ones were answered before, some by another backend."""
    from quarry.plans import answer, gold_run

    docs = t(spark, sf_dir, "documents")
    key = F.when(F.col("doc_id") % 10 != 3, F.sha2(F.coalesce("text", F.lit("")), 256))
    sent = docs.select(F.col("doc_id").alias("query_id"), key.alias("request_sha"), F.col("n_chars").alias("characters"))
    labelled = t(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"), F.when(F.col("toxic") == 0, F.lit("extractive")).otherwise("other").alias("backend"))
    cache = sent.where("request_sha IS NOT NULL").join(labelled, "query_id").select("request_sha", "backend", F.lit("").alias("answer"), F.lit(None).cast("array<string>").alias("quotes"))
    prices = spark.createDataFrame([("m", 3.0, 15.0)], "prefix string, input double, output double")
    return gold_run.estimate(sent, cache, answer.Extractive(), "m-1", prices)


# ---- labels, references and ids over texts that are put together from the tables

_ART = "'Art. ' || CASE WHEN l_orderkey > 999 THEN format('{:,}', l_orderkey) ELSE CAST(l_orderkey AS VARCHAR) END"


@query(f"""SELECT l_orderkey, l_linenumber, 'paragrafo' AS type, 'par' || l_linenumber || 'a' AS segment, '§ ' || l_linenumber || 'º-A' AS label, l_returnflag AS rest FROM lineitem WHERE l_linenumber % 3 = 0
UNION ALL SELECT l_orderkey, l_linenumber, 'artigo', 'art' || l_orderkey, replace({_ART}, ',', '.') || CASE WHEN l_orderkey < 10 THEN 'º' ELSE '' END, l_returnflag FROM lineitem WHERE l_linenumber % 3 = 1
UNION ALL SELECT l_orderkey, l_linenumber, NULL, NULL, NULL, NULL FROM lineitem WHERE l_linenumber % 3 = 2""")
def q_labels_of_blocks(spark, sf_dir):
    """Every line item as a block: paragraphs, articles, and prose that mentions one."""
    from quarry.functions.labels import classified

    n, key = F.col("l_linenumber").cast("string"), F.col("l_orderkey").cast("string")
    block = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("§ "), n, F.lit("º-A. "), "l_returnflag")).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("Art. "), X.dotted(F.col("l_orderkey")), F.lit(".  "), "l_returnflag")).otherwise(F.concat(F.lit("na forma do art. "), key))
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", classified(block).alias("l"))
    return rows.select("l_orderkey", "l_linenumber", "l.type", "l.segment", "l.label", F.col("l.text").alias("rest"))


@query("""SELECT 'o' || l_orderkey || '_' || l_linenumber AS origin_id, 'n!art' || l_orderkey || '_par' || l_linenumber AS target_urn, 'art. ' || l_orderkey || ', § ' || l_linenumber AS original_text FROM lineitem
UNION SELECT 'o' || l_orderkey || '_' || l_linenumber, 'n!art' || l_partkey || '_inc4', 'artigo ' || l_partkey || ', IV' FROM lineitem""")
def q_text_references(spark, sf_dir):
    """References in a sentence about each line item."""
    from quarry.plans.parse import links

    key, n, part = (F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey"))
    text = F.concat(F.lit("Na forma do art. "), key, F.lit(", § "), n, F.lit(" desta lei, e do artigo "), part, F.lit(", IV, aplica-se."))
    return links(t(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), key, F.lit("_"), n).alias("id"), F.lit("n").alias("norm_urn"), text.alias("text")))


@query("""SELECT o_orderkey, 'federal' AS sphere, 'lei' AS type, CAST(o_orderdate AS DATE) AS date, CAST(o_custkey AS VARCHAR) AS number, 'art' || o_orderkey || '_inc2' AS fragment, 'urn:lex:br:federal:lei:' || strftime(o_orderdate, '%Y-%m-%d') || ';' || o_custkey AS norm FROM orders""")
def q_urn_parts(spark, sf_dir):
    """An id for every order, taken apart again."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    urn = F.concat(F.lit("urn:lex:br:federal:lei:"), day, F.lit(";"), "o_custkey", F.lit("!art"), "o_orderkey", F.lit("_inc2"))
    rows = t(spark, sf_dir, "orders").select("o_orderkey", urn.alias("u")).select("o_orderkey", X.urn_parts(F.col("u")).alias("p"), X.norm_of(F.col("u")).alias("norm"))
    return rows.select("o_orderkey", "p.sphere", "p.type", "p.date", "p.number", "p.fragment", "norm")


# ---- lookups


def _lines_as_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ids below their order; every second wording is a superseded one."""
    version = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("@"), "l_linenumber")).otherwise("")
    return t(spark, sf_dir, "lineitem").select(F.concat(F.lit("n!o"), "l_orderkey", F.lit("_s"), F.col("l_suppkey") % 3, version).alias("id"), "l_orderkey", "l_linenumber", "l_suppkey")


@query("SELECT 'n!o' || l_orderkey AS prefix, l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'")
def q_ids_below(spark, sf_dir):
    from quarry.operators import lookup

    urgent = t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("n!o"), "o_orderkey").alias("prefix"))
    return lookup.below(_lines_as_ids(spark, sf_dir), urgent).select("prefix", "l_orderkey", "l_linenumber")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark) OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def q_rows_by_id(spark, sf_dir):
    from quarry.operators import lookup

    wanted = t(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("doc_id")).union(t(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"))
    return lookup.by_ids(t(spark, sf_dir, "documents"), wanted, "doc_id").select("doc_id", "lang", "n_chars")


@query("""SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey = m THEN 2147483647 ELSE o_orderkey END) AS INT) AS nth
FROM (SELECT *, max(o_orderkey) OVER (PARTITION BY o_custkey) AS m FROM orders) JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'""")
def q_wordings(spark, sf_dir):
    """Orders as wordings of their customer's id: the last is current, the others carry a version."""
    from quarry.operators import lookup

    orders = t(spark, sf_dir, "orders")
    last = orders.groupBy(F.col("o_custkey").alias("c")).agg(F.max("o_orderkey").alias("m"))
    version = F.when(F.col("o_orderkey") == F.col("m"), "").otherwise(F.concat(F.lit("@"), "o_orderkey"))
    rows = orders.join(last, F.col("o_custkey") == F.col("c")).select(F.concat(F.lit("n!c"), "o_custkey", version).alias("id"), "o_custkey", "o_orderkey")
    wanted = t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("n!c"), "c_custkey", F.lit("@7")).alias("id"))
    return lookup.wordings(rows, wanted).select("o_custkey", "o_orderkey", "nth")


@query("SELECT d.doc_id, d.lang, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -2) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def q_rows_with_defaults(spark, sf_dir):
    from quarry.operators import lookup

    return lookup.with_defaults(t(spark, sf_dir, "documents").select("doc_id", "lang"), t(spark, sf_dir, "labels"), "doc_id", {"quality": -1, "toxic": -2})


# ---- evaluation of answers


@query("""SELECT lang, count(*) AS items, sum(toxic) AS unanswerable, coalesce(round(avg(CASE WHEN toxic = 1 THEN CAST(quality = 0 AS INT) END), 6), 0.0) AS abstained_rightly,
coalesce(round(avg(CASE WHEN toxic = 0 THEN CAST(quality = 0 AS INT) END), 6), 0.0) AS abstained_wrongly, round(avg(CAST((toxic = 1) = (quality = 0) AS INT)), 6) AS agreement FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def q_abstention(spark, sf_dir):
    """Labels as items: toxic ones should not be answered, poor ones were not."""
    items = t(spark, sf_dir, "documents").select("doc_id", "lang").join(t(spark, sf_dir, "labels"), "doc_id")
    return evaluate.abstention(items.select("lang", (F.col("toxic") == 1).alias("should"), (F.col("quality") == 0).alias("abstained")), ["lang"])


@query("""WITH cited AS (SELECT o_custkey AS item, o_orderstatus || '_' || substr(o_orderpriority, 1, 1) AS c FROM orders)
SELECT c_custkey AS item, count(c) AS cited, count(CASE WHEN substr(c, 1, 1) = 'F' OR c = 'O_1' THEN 1 END) AS "right", coalesce(round(count(CASE WHEN substr(c, 1, 1) = 'F' OR c = 'O_1' THEN 1 END) / nullif(count(c), 0), 6), 0.0) AS accuracy
FROM customer LEFT JOIN cited ON item = c_custkey GROUP BY c_custkey""")
def q_citation_accuracy(spark, sf_dir):
    """Orders as citations of their customer: status and priority; all of F and O_1 are expected."""
    items = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"))
    cited = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"), F.concat("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, "@3").otherwise(""), F.lit("_"), F.substring("o_orderpriority", 1, 1)).alias("cited"))
    expected = items.select("item", F.explode(F.array(F.lit("F"), F.lit("O@2_1"))).alias("expected"))
    return evaluate.citation_accuracy(cited, expected, items)


@query("""SELECT key, CASE WHEN a AND b THEN 'both' WHEN a THEN 'missing' ELSE 'unexpected' END AS kind FROM (SELECT key, bool_or(s = 1) AS a, bool_or(s = 2) AS b
FROM (SELECT c_nationkey AS key, 1 AS s FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT s_nationkey, 2 FROM supplier) GROUP BY key)""")
def q_differences(spark, sf_dir):
    expected = t(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("key"))
    return evaluate.differences(expected, t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key")), ["key"])


@query("SELECT DISTINCT sha256(text) AS request_sha FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(d.text) FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE d.text IS NOT NULL)")
def q_unanswered(spark, sf_dir):
    from quarry.plans.answer import unanswered

    docs = t(spark, sf_dir, "documents").select("doc_id", X.text_key(F.col("text")).alias("request_sha"))
    return unanswered(docs, docs.join(t(spark, sf_dir, "labels"), "doc_id", "left_semi").where("request_sha IS NOT NULL")).select("request_sha")


@query("SELECT list_sort(list(DISTINCT source)) AS models FROM documents WHERE source IS NOT NULL")
def q_models_used(spark, sf_dir):
    return evaluate.models_used(t(spark, sf_dir, "documents").select(F.col("source").alias("model")))


@query("SELECT doc_id, CAST(greatest(floor(n_chars / 3.0), 500) AS BIGINT) AS tokens, md5('Doc ' || doc_id || chr(10) || coalesce(text, '')) AS rerank_md5 FROM documents")
def q_rerank_text(spark, sf_dir):
    """What a reranker reads of each document, and the output that it is reckoned to take."""
    text = search.rerank_text(F.concat(F.lit("Doc "), "doc_id"), F.coalesce("text", F.lit("")))
    return t(spark, sf_dir, "documents").select("doc_id", evaluate.estimated_output(F.col("n_chars")).alias("tokens"), F.md5(text).alias("rerank_md5"))


@query("""WITH dense AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))
/ sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / sqrt(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))), 6) AS score
FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id % 97 >= e.vec_id % 61 AND q.vec_id % 97 < e.vec_id % 61 + 30)
SELECT query_id, id AS vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM dense QUALIFY rank <= 10""")
def q_cosine_at_each_day(spark, sf_dir):
    """Nearest vectors that are in force on the day of each query: the filter comes before the cut."""
    vectors = _vectors(spark, sf_dir).drop("label")
    dated = vectors.withColumns({"from_day": F.col("id") % 61, "to_day": F.col("id") % 61 + 30})
    return search.cosine(_asked(vectors).withColumn("day", F.col("query_id") % 97), dated, k=10).select("query_id", F.col("id").alias("vec_id"), "score", "rank")


# ---- sets and stores


@query("""SELECT lang || '!' || doc_id AS provision_id, lang AS norm_urn, CAST(datediff('day', DATE '0001-01-01', DATE '1990-09-11') + 1 AS INT) AS valid_from_day,
sha256('Art. ' || doc_id || ' ' || CASE WHEN lang = 'de' THEN 'neu ' ELSE '' END || text) AS text_sha256 FROM documents WHERE trim(text) <> ''""")
def q_index_replaced(spark, sf_dir):
    """Documents as articles of a norm for each language, indexed; then one norm's texts change and it is indexed again."""
    from quarry import schema
    from quarry.plans import index
    from quarry.sources.store import Store

    store, docs = Store.scratch(spark), t(spark, sf_dir, "documents").where("lang IS NOT NULL")
    own = {"id": F.concat("lang", F.lit("!"), "doc_id"), "norm_urn": F.col("lang"), "type": F.lit("artigo"), "label": F.concat(F.lit("Art. "), "doc_id"), "path": F.concat(F.lit("art"), "doc_id"), "text": F.col("text")}
    rows = docs.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.PROVISION])
    known = {"urn": F.col("lang"), "published": F.lit("1990-09-11")}
    store.put_norms(docs.select("lang").distinct().select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.NORM]))
    store.replace("provision", rows)
    encode = search.hashed_encoder(16)
    index.build(store, encode, "hashed", 16, rows.select("norm_urn"))
    changed = rows.where("norm_urn = 'de'").withColumn("text", F.when(F.trim("text") != "", F.concat(F.lit("neu "), "text")).otherwise(F.col("text")))
    store.replace("provision", changed)
    index.build(store, encode, "hashed", 16, changed.select("norm_urn"))
    return store.read("chunk").select("provision_id", "norm_urn", "valid_from_day", "text_sha256")


@query("""SELECT count(*) AS requests, count(CASE WHEN s THEN 1 END) AS stored, count(DISTINCT CASE WHEN NOT s THEN h END) AS sent
FROM (SELECT sha256(text) AS h, sha256(text) IN (SELECT sha256(d.text) FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE d.text IS NOT NULL) AS s FROM documents WHERE text IS NOT NULL)""")
def q_cache_use(spark, sf_dir):
    from quarry.plans.answer import cache_use

    docs = t(spark, sf_dir, "documents").select("doc_id", X.text_key(F.col("text")).alias("request_sha"))
    return cache_use(docs, lookup.by_ids(docs, t(spark, sf_dir, "labels"), "doc_id"))


@query("""WITH d AS (SELECT d.source, d.lang, l.doc_id IS NOT NULL AS shown FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id))
SELECT count(*) AS questions, count(*) FILTER (NOT shown) AS no_candidates, count(*) FILTER (shown AND lang = 'en') AS stored,
count(DISTINCT (source, lang)) FILTER (shown AND lang <> 'en') AS sent, count(DISTINCT (source, lang)) FILTER (shown AND lang <> 'en' AND ends_with(source, '1')) AS failed FROM d""")
def q_answer_calls(spark, sf_dir):
    """Documents ask by their source and are shown their language, if labelled; what is in English is stored, the backend fails for sources that end in 1.

    The row is what was counted while the answers were made.
    """
    from quarry.plans import answer

    class Failing(answer.Extractive):
        def generate(self, system, documents, question):
            if question.endswith("1"):
                raise answer.BackendFailed(question)
            return super().generate(system, documents, question)

    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("source").alias("text"), "lang")
    shown = lookup.by_ids(docs, t(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id")), "query_id")
    passages = lambda df: df.select("query_id", F.lit(1).alias("rank"), F.col("lang").alias("text"))
    backend, calls, day, english = Failing(), answer.Calls(), "2024-01-01", shown.where("lang = 'en'")
    cache = answer.answer(english, passages(english), answer.Extractive(), day).where("request_sha IS NOT NULL")
    answer.answer(docs, passages(shown), backend, day, cache, calls, tolerant=True).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([calls.counts()], "questions long, no_candidates long, stored long, sent long, failed long")


@query("""SELECT 'both' AS kind, key FROM (SELECT c_nationkey AS key FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'only customers', key FROM (SELECT c_nationkey AS key FROM customer WHERE c_acctbal > 9900 EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'either', key FROM (SELECT c_nationkey AS key FROM customer WHERE c_acctbal > 9900 UNION SELECT s_nationkey FROM supplier)""")
def q_setops(spark, sf_dir):
    a = t(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("key"))
    b = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"))
    named = evaluate.differences(a, b, ["key"]).replace({"missing": "only customers"}, subset=["kind"])
    kinds = F.when(F.col("kind") == "unexpected", F.array(F.lit("either"))).otherwise(F.array(F.lit("either"), F.col("kind")))
    return named.select(F.explode(kinds).alias("kind"), "key")


@query("SELECT doc_id, sha256(text) AS request_sha FROM documents WHERE sha256(text) NOT IN (SELECT sha256(d.text) FROM documents d JOIN labels l ON l.doc_id = d.doc_id)")
def q_cache_misses(spark, sf_dir):
    """Requests whose answer is not stored: texts of labelled documents stand for the store."""
    docs = t(spark, sf_dir, "documents").select("doc_id", X.text_key(F.col("text")).alias("request_sha"))
    return lookup.without(docs, lookup.by_ids(docs, t(spark, sf_dir, "labels"), "doc_id"), "request_sha").select("doc_id", "request_sha")


@query("""WITH names AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part WHERE p_partkey % 2 = 0 UNION SELECT DISTINCT p_name FROM part WHERE p_partkey % 5 = 0),
texts AS (SELECT p_partkey, p_name || ', Art. ' || p_size AS text FROM part),
met AS (SELECT p_partkey, name FROM texts LEFT JOIN names ON starts_with(text, name || ' ') OR starts_with(text, name || ',') QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(name) DESC) = 1)
SELECT p_partkey, 'urn:' || name AS found, CASE WHEN name IS NULL THEN 'no known name' END AS reason, trim(replace(replace(lower(substr(text, coalesce(length(name), 0) + 1)), ',', ''), '.', '')) AS rest FROM met JOIN texts USING (p_partkey)""")
def q_names_at_start(spark, sf_dir):
    """Labels that start with the name of a part: the longest known name, what follows it, or why there is none."""
    part = t(spark, sf_dir, "part")
    firsts = part.where("p_partkey % 2 = 0").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"))
    names = firsts.unionByName(part.where("p_partkey % 5 = 0").select(F.col("p_name").alias("name"))).select("name", F.concat(F.lit("urn:"), "name").alias("urn"))
    texts = part.select("p_partkey", F.concat("p_name", F.lit(", Art. "), "p_size").alias("text"))
    return lookup.named_at_start(texts, names).select("p_partkey", "found", "reason", F.array_join("rest", " ").alias("rest"))


@query("""SELECT position, o_orderkey, event_id FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders)
JOIN (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS position FROM events WHERE event_id < (SELECT count(*) FROM orders)) USING (position)""")
def q_zipped(spark, sf_dir):
    """The n-th dearest order beside the n-th event of as many."""
    orders = t(spark, sf_dir, "orders").select("o_orderkey", (-F.col("o_totalprice")).alias("_price"))
    n = orders.count()
    events = t(spark, sf_dir, "events").where(F.col("event_id") < n).select("event_id", "ts")
    held = ordered.numbered(events, ["ts", "event_id"]).where(F.col("position") <= n).drop("position")
    firsts = orders if held.count() == n else ordered.numbered(orders, ["_price", "o_orderkey"]).where(F.col("position") <= held.count()).drop("position")
    return ordered.zipped(firsts, held, ["_price", "o_orderkey"], ["ts", "event_id"]).select("position", "o_orderkey", "event_id")


# ---- a key that holds half of all rows

_HALF = "(SELECT * REPLACE (CASE WHEN event_id % 2 = 0 THEN -1 ELSE user_id END AS user_id) FROM events)"


@query(f"""SELECT event_id, row_number() OVER w AS ordinal, max(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS max_before,
CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island, bool_or(event_type = 'purchase') OVER (w ROWS UNBOUNDED PRECEDING) AS seen
FROM {_HALF} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def q_hot_key_windows(spark, sf_dir):
    """Scans in two levels, whatever the size, over events of which one user has half."""
    events = t(spark, sf_dir, "events").withColumn("user_id", F.when(F.col("event_id") % 2 == 0, F.lit(-1)).otherwise(F.col("user_id")))
    keys, order = ["user_id"], ["ts", "event_id"]
    out = ordered.sibling_ordinal(events, keys, order, hot_rows=0)
    out = ordered.running_max_before(out, keys, order, "value", hot_rows=0)
    out = ordered.islands(out, keys, order, F.col("event_type") == "signup", hot_rows=0)
    out = ordered.flag_from(out, keys, order, F.col("event_type") == "purchase", hot_rows=0)
    return out.select("event_id", F.col("ordinal").cast("long").alias("ordinal"), "max_before", "island", "seen")


# ---- the stored inverted index


@query(stem_sql(f"(SELECT DISTINCT unnest({_TOKENS}) AS word FROM documents)"))
def q_stems(spark, sf_dir):
    """The stem of every word of the texts."""
    words = t(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", stem(F.col("word")).alias("stem"))


@query(f"""WITH texts AS (SELECT doc_id AS id, CASE WHEN source = (SELECT min(source) FROM documents) THEN text || ' ' || lang ELSE text END AS text FROM documents),
stemmed AS ({stem_sql(f"(SELECT DISTINCT unnest({_WORDS}) AS word FROM (SELECT text FROM texts UNION ALL SELECT text FROM benchmark))")}),
kept AS (SELECT word, stem FROM stemmed WHERE length(word) <= {MOST_LETTERS} AND word NOT IN ({", ".join(f"'{w}'" for w in stop_words())})),
words AS (SELECT id, stem AS term FROM (SELECT id, unnest({_WORDS}) AS word FROM texts) JOIN kept USING (word)),
lengths AS (SELECT id, count(*) AS length FROM words GROUP BY id),
posts AS (SELECT id, term, count(*) AS tf, any_value(length) AS length FROM words JOIN lengths USING (id) GROUP BY id, term),
dfs AS (SELECT term, ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM posts GROUP BY term),
asked AS (SELECT DISTINCT query_id, stem AS term FROM (SELECT item_id AS query_id, unnest({_WORDS}) AS word FROM benchmark) JOIN kept USING (word)),
scored AS (SELECT query_id, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / 256.0))), 6) AS score FROM asked JOIN posts USING (term) JOIN dfs USING (term) GROUP BY query_id, id)
SELECT query_id, id AS doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM scored QUALIFY rank <= 10""")
def q_indexed_bm25(spark, sf_dir):
    """Documents indexed by source, one source written again with other texts, then searched through the buckets of the asked terms."""
    from quarry.plans import terms
    from quarry.sources.store import Store

    store, docs = Store.scratch(spark), t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("norm_urn"), "text", "lang")
    terms.build(store, docs)
    first = docs.agg(F.min("norm_urn").alias("norm_urn"))
    changed = docs.join(F.broadcast(first), "norm_urn").withColumn("text", F.concat("text", F.lit(" "), "lang"))
    terms.build(store, changed)
    asked = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return terms.bm25(store, asked, k=10).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


@query("SELECT doc_id, lang AS norm_urn, CASE WHEN lang = 'de' THEN -n_chars ELSE n_chars END AS n_chars FROM documents")
def q_replace_partition(spark, sf_dir):
    """Documents stored by language, one language written again: see the tests for what must not change."""
    from quarry.sources.store import Store

    store = Store.scratch(spark)
    docs = t(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("norm_urn"), "n_chars")
    store.replace("docs", docs)
    store.replace("docs", docs.where("norm_urn = 'de'").withColumn("n_chars", -F.col("n_chars")))
    return store.read("docs").select("doc_id", "norm_urn", "n_chars")
