"""Topics: given topic numbers for the SQL-checked tables, fitted ones for the rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinionmill.operators import density, features, hierarchy, topics
from opinionmill.plans import fixtures as fx
from opinionmill.plans.catalogue.registry import query

SQL_TOKENS = r"""regexp_extract_all(lower(regexp_replace(regexp_replace(review, '[\n\t]', ' ', 'g'), '[^A-Za-z0-9 ]+', '', 'g')), '[\p{L}\p{N}_]{2,}')"""


def sql_words(by: str) -> str:
    return f"""tt AS (SELECT {by}, unnest({SQL_TOKENS}) AS term FROM doc_vectors),
tc AS (SELECT {by}, term, count(*) AS tf FROM tt GROUP BY {by}, term),
tn AS (SELECT {by}, sum(tf) AS n FROM tc GROUP BY {by}),
tw AS (SELECT {', '.join('tc.' + c.strip() for c in by.split(','))}, tc.term, tf, tf / n * ln(1 + (SELECT floor(avg(n)) FROM tn) / f) AS weight
  FROM tc JOIN tn ON {' AND '.join(f'tc.{c.strip()} IS NOT DISTINCT FROM tn.{c.strip()}' for c in by.split(','))}
  JOIN (SELECT term, sum(tf) AS f FROM tc GROUP BY term) tf ON tc.term = tf.term)"""


@query("topic_words", f"WITH {fx.SQL_DOC_VECTORS}, {sql_words('topic')} SELECT topic, term, tf, round(weight, 9) AS weight FROM tw")
def topic_words(spark, d):
    return topics.words(fx.doc_vectors(spark, d)).withColumn("weight", F.round("weight", 9))


def top_words_sql(k: int) -> str:
    order = "PARTITION BY topic ORDER BY round(weight, 9) DESC, term"
    return f"SELECT topic, CAST(row_number() OVER ({order}) AS INTEGER) AS rank, term FROM tw QUALIFY row_number() OVER ({order}) <= {k}"


def given_words(spark, d):
    return topics.words(fx.doc_vectors(spark, d)).withColumn("weight", F.round("weight", 9))


@query(
    "topic_top_words",
    f"""WITH {fx.SQL_DOC_VECTORS}, {sql_words('topic')}, big AS (SELECT topic FROM doc_vectors GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 8),
best AS ({top_words_sql(8)}) SELECT b.topic, rank, term FROM best b JOIN big ON b.topic = big.topic""",
)
def topic_top_words(spark, d):
    """Best 8 words of the 8 biggest topics."""
    docs = fx.doc_vectors(spark, d)
    big = topics.largest_topics(docs, 8).select("topic")
    return topics.top_words(given_words(spark, d).join(F.broadcast(big), "topic", "left_semi"), 8).select("topic", "rank", "term")


SQL_CENTRE = """flat AS (SELECT topic, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM doc_vectors),
centre AS (SELECT topic, list(x ORDER BY i) AS centroid FROM (SELECT topic, i, avg(x) AS x FROM flat GROUP BY topic, i) GROUP BY topic)"""


@query(
    "topic_info",
    f"""WITH {fx.SQL_DOC_VECTORS}, {sql_words('topic')}, {SQL_CENTRE}, best AS ({top_words_sql(10)}),
sim AS (SELECT d.topic, doc_id, row_number() OVER (PARTITION BY d.topic ORDER BY round(list_cosine_similarity(embedding, centroid), 9) DESC, doc_id) AS rn
  FROM doc_vectors d JOIN centre c ON d.topic = c.topic),
docs AS (SELECT topic, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY rn) AS representative_docs FROM sim WHERE rn <= 3 GROUP BY topic),
sizes AS (SELECT topic, count(*) AS "count" FROM doc_vectors GROUP BY topic)
SELECT s.topic, s."count", s.topic || '_' || string_agg(term, '_' ORDER BY rank) FILTER (WHERE rank <= 4) AS name,
  string_agg(term, ' ' ORDER BY rank) AS words, any_value(representative_docs) AS representative_docs
FROM sizes s JOIN best b ON s.topic = b.topic JOIN docs ON docs.topic = s.topic GROUP BY s.topic, s."count\"""",
)
def topic_info(spark, d):
    table = topics.info(fx.doc_vectors(spark, d), given_words(spark, d), fx.vectors(spark, d))
    return table.select("topic", "count", "name", F.array_join("words", " ").alias("words"), F.array_join("representative_docs", " ").alias("representative_docs"))


@query(
    "topic_polarity",
    f"""WITH {fx.SQL_DOC_VECTORS} SELECT topic, round(avg(label), 6) AS pos_share, count(label) AS "count" FROM doc_vectors
GROUP BY topic ORDER BY count(label) DESC, topic LIMIT 15""",
)
def topic_polarity(spark, d):
    return topics.label_share(fx.doc_vectors(spark, d)).withColumn("pos_share", F.round("pos_share", 6))


@query(
    "topic_docs_concat",
    f"""WITH {fx.SQL_DOC_VECTORS}, f AS (SELECT topic, doc_id, review FROM doc_vectors QUALIFY row_number() OVER (PARTITION BY topic ORDER BY doc_id) <= 50)
SELECT topic, md5(string_agg(review, ' ' ORDER BY doc_id)) AS digest, CAST(length(string_agg(review, ' ' ORDER BY doc_id)) AS BIGINT) AS n FROM f GROUP BY topic
ORDER BY topic LIMIT 8""",
)
def topic_docs_concat(spark, d):
    joined = topics.concatenated(fx.doc_vectors(spark, d), 50, n_topics=8)
    return joined.select("topic", F.md5("text").alias("digest"), F.char_length("text").cast("long").alias("n"))


@query(
    "topic_assign",
    f"""WITH {fx.SQL_DOC_VECTORS}, {SQL_CENTRE}, s AS (SELECT d.doc_id, c.topic, round(list_cosine_similarity(embedding, centroid), 6) AS similarity
  FROM doc_vectors d, centre c) SELECT doc_id, topic, similarity + 0.0 AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, topic) = 1""",
)
def topic_assign(spark, d):
    docs = fx.doc_vectors(spark, d)
    found = topics.assign(docs, topics.centroids(docs, docs.select("doc_id", "topic")))
    return found.withColumn("similarity", F.round("similarity", 6))


@query("topic_count", f"WITH {fx.SQL_VECTORS} SELECT count(DISTINCT topic) AS n_topics FROM vectors")
def topic_count(spark, d):
    return topics.topic_count(fx.vectors(spark, d))


@query("topic_keyphrases_tf")
def topic_keyphrases_tf(spark, d):
    return topics.keyphrases_by_frequency(fx.doc_vectors(spark, d).select("topic", F.col("review").alias("text")), 8)


STOPS = ("the", "of", "and", "to", "in", "is", "de", "la", "der", "die", "und")


@query(
    "topic_keyphrases_given_stops",
    f"""WITH {fx.SQL_DOC_VECTORS}, j AS (SELECT topic, list_filter({fx.sql_words("review", False)}, lambda t: t NOT IN ({', '.join(f"'{w}'" for w in STOPS)})) AS t FROM doc_vectors),
c AS (SELECT topic, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM j),
n AS (SELECT topic, term, count(*) AS tf FROM c GROUP BY topic, term)
SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY tf DESC, term) AS INTEGER) AS rank, term, tf FROM n
QUALIFY row_number() OVER (PARTITION BY topic ORDER BY tf DESC, term) <= 8""",
)
def topic_keyphrases_given_stops(spark, d):
    """Most frequent phrases over all texts of each topic."""
    texts = fx.doc_vectors(spark, d).select("topic", F.col("review").alias("text"))
    return topics.keyphrases_by_frequency(texts, 8, stop_words=STOPS)


@query("topic_keyphrases")
def topic_keyphrases(spark, d):
    docs = fx.doc_vectors(spark, d)
    model = features.fit_embedder(docs, dim=32)
    return topics.keyphrases(docs.select("doc_id", "topic", F.col("review").alias("text")), model, 8)


@query("topic_kmeans")
def topic_kmeans(spark, d):
    """All vectors reduced to five dimensions and clustered; small clusters and far points are noise."""
    reduced = topics.reduce_dims(fx.vectors(spark, d), 5)
    return topics.cluster(reduced, k=8, min_size=40, noise_quantile=0.95)


@query("topic_density")
def topic_density(spark, d):
    reduced = topics.reduce_dims(fx.vectors(spark, d), 3)
    return topics.density(reduced, cell=0.1, min_points=3, min_size=10)


@query(
    "topic_density_grid",
    """WITH RECURSIVE p AS (SELECT doc_id, ln(1 + length(text)) AS x, ln(1 + length(text) - length(replace(text, ' ', ''))) AS y FROM documents),
g AS (SELECT doc_id, CAST(floor(x / 0.1::DOUBLE) AS BIGINT) AS a, CAST(floor(y / 0.1::DOUBLE) AS BIGINT) AS b FROM p),
dense AS (SELECT a, b FROM g GROUP BY a, b HAVING count(*) >= 4),
walk(a, b, ra, rb) AS (SELECT a, b, a, b FROM dense UNION SELECT d.a, d.b, w.ra, w.rb FROM walk w JOIN dense d ON abs(d.a - w.a) + abs(d.b - w.b) = 1),
root AS (SELECT a, b, min(ra || ',' || rb) AS c FROM walk GROUP BY a, b),
m AS (SELECT doc_id, c FROM g LEFT JOIN root ON g.a = root.a AND g.b = root.b),
sizes AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) - 1 AS topic FROM m WHERE c IS NOT NULL GROUP BY c HAVING count(*) >= 20)
SELECT doc_id, CAST(coalesce(topic, -1) AS INTEGER) AS topic FROM m LEFT JOIN sizes ON m.c = sizes.c""",
)
def topic_density_grid(spark, d):
    """Density topics over two plain measures of every document, checked against a recursive query."""
    docs = fx.load(spark, d, "documents", "doc_id")
    chars = F.char_length("text")
    spaces = chars - F.char_length(F.replace("text", F.lit(" "), F.lit("")))
    placed = docs.select("doc_id", F.array(F.log(F.lit(1) + chars), F.log(F.lit(1) + spaces)).alias("reduced"))
    return topics.density(placed, cell=0.1, min_points=4, min_size=20)


SQL_FIRST_AXES = """p AS (SELECT vec_id AS doc_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z
  FROM embeddings WHERE embedding IS NOT NULL)"""


def first_axes(spark, d):
    """Every document vector cut to three coordinates, which SQL can compute too."""
    vectors = fx.load(spark, d, "embeddings").where("embedding IS NOT NULL")
    return vectors.select(F.col("vec_id").alias("doc_id"), F.slice(F.col("embedding").cast("array<double>"), 1, 3).alias("reduced"))


@query(
    "topic_density_exact",
    f"""WITH RECURSIVE {SQL_FIRST_AXES},
near AS (SELECT a.doc_id AS a, b.doc_id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2
  FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.06::DOUBLE * 0.06::DOUBLE),
core AS (SELECT a AS c FROM near GROUP BY a HAVING count(*) >= 6),
e AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
walk(v, m) AS (SELECT c, c FROM core UNION SELECT e.b, w.m FROM walk w JOIN e ON e.a = w.v AND w.m < e.b),
root AS (SELECT v, min(m) AS m FROM walk GROUP BY v),
border AS (SELECT a AS v, b AS c FROM near WHERE a NOT IN (FROM core) AND b IN (FROM core) QUALIFY row_number() OVER (PARTITION BY a ORDER BY d2, b) = 1),
member AS (SELECT v, m FROM root UNION ALL SELECT border.v, m FROM border JOIN root ON border.c = root.v),
sizes AS (SELECT m, row_number() OVER (ORDER BY count(*) DESC, min(v)) - 1 AS topic FROM member GROUP BY m HAVING count(*) >= 5)
SELECT doc_id, CAST(coalesce(topic, -1) AS INTEGER) AS topic FROM p LEFT JOIN member ON doc_id = v LEFT JOIN sizes USING (m)""",
)
def topic_density_exact(spark, d):
    """Density clusters of all document vectors over three coordinates."""
    return density.density_exact(first_axes(spark, d), eps=0.06, min_points=6, min_size=5)


@query(
    "topic_reachability_tree",
    f"""WITH RECURSIVE {SQL_FIRST_AXES},
near AS (SELECT a.doc_id AS a, b.doc_id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM p a, p b),
core AS (SELECT a AS c, d2 AS c2 FROM near QUALIFY row_number() OVER (PARTITION BY a ORDER BY d2) = 8),
reach AS (SELECT a, b, greatest(d2, x.c2, y.c2) AS w2 FROM near JOIN core x ON a = x.c JOIN core y ON b = y.c WHERE a <> b),
-- One position after the other: the lightest edge from those in the tree to the others.
grown(step, inside, w2) AS (
  SELECT 0, [(SELECT min(doc_id) FROM p)], 0.0::DOUBLE
  UNION ALL
  SELECT step + 1, list_append(inside, o.b), o.w2 FROM grown g,
    LATERAL (SELECT arg_min(r.b, (r.w2, r.b)) AS b, min(r.w2) AS w2 FROM reach r WHERE list_contains(g.inside, r.a) AND NOT list_contains(g.inside, r.b)) o
  WHERE o.b IS NOT NULL
)
SELECT round(w2, 12) AS w2, count(*) AS n FROM grown WHERE step > 0 GROUP BY round(w2, 12)""",
)
def topic_reachability_tree(spark, d):
    """The weights of the spanning tree over all document vectors, which do not depend on how ties are broken."""
    *_, tree, _ = hierarchy.reachability_tree(first_axes(spark, d), min_points=8)
    return tree.groupBy(F.round("w2", 12).alias("w2")).agg(F.count(F.lit(1)).alias("n"))


@query("topic_hierarchy")
def topic_hierarchy(spark, d):
    """Clusters of any density over all document vectors, reduced to three dimensions."""
    return hierarchy.hierarchical_topics(topics.reduce_dims(fx.vectors(spark, d), 3), min_size=10)


@query("lda_topics")
def lda_topics(spark, d):
    return topics.lda(fx.texts(spark, d), k=8)


@query(
    "topic_table",
    f"WITH {fx.SQL_DOC_VECTORS} SELECT doc_id, label, topic, review FROM doc_vectors",
)
def topic_table(spark, d):
    """Rows with their topic, written and read back."""
    from opinionmill.plans.catalogue.preparing import scratch
    from opinionmill.sources import tables

    path = tables.write_table(fx.doc_vectors(spark, d).select("doc_id", "label", "topic", "review"), f"{scratch(spark)}/topics")
    return tables.read_table(spark, path)
