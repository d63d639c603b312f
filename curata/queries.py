
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions import text as tx
from curata.functions import vectors as vx
from curata.operators import decide, evaluate, neardup, sampling, scans
from curata.plans import extended, persisted, portable
from curata.sources.tables import TABLES, load, register
from curata.streaming import votes

QUERIES: dict = {}
ORACLE_SQL: dict = {}
FLAGSHIP = "leakage_audit"
COS, HAM = 0.3, 20


def _portable(sql: str):
    import re

    names = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, names)
        return spark.sql(sql)

    return run


for _name, _sql in portable.SQL.items():
    QUERIES[_name], ORACLE_SQL[_name] = _portable(_sql), _sql


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    return rows.select("vec_id", "label", vx.unit("embedding").alias("unit"), vx.sign_bits("embedding").alias("bits"))


#: Unit vectors and sign bits in DuckDB.
V = """u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS e,
  list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS s FROM embeddings)"""
PAIRS = V + """, p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, list_dot_product(a.e, b.e) AS cos,
  list_sum(list_transform(list_zip(a.s, b.s), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::INT AS ham FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id)"""


# Near pairs within a block
@query(f"WITH {PAIRS} SELECT label, a, b, round(cos, 6) AS cos, ham FROM p WHERE cos >= 0.3 OR ham <= 20")
def near_pairs(spark, sf_dir):
    found = neardup.near_pairs(vectors(spark, sf_dir), "vec_id", "label", COS, HAM)
    return found.select(F.col("block").alias("label"), "a", "b", F.round("cos", 6).alias("cos"), F.col("ham").cast("int").alias("ham"))


# J6 4.3: exact banded Hamming join over all vectors
@query(f"""WITH {V} SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(list_zip(a.s, b.s), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::INT AS ham FROM u a JOIN u b ON a.vec_id < b.vec_id
  WHERE list_sum(list_transform(list_zip(a.s, b.s), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) <= 15""")
def banded_hamming(spark, sf_dir):
    return neardup.banded_pairs(vectors(spark, sf_dir).select("vec_id", "bits"), "vec_id", 15).withColumn("ham", F.col("ham").cast("int"))


# Leakage guard without a block key
@query(f"""WITH {V} SELECT c.vec_id FROM u c WHERE c.vec_id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM u p WHERE p.vec_id % 5 = 0 AND (list_dot_product(c.e, p.e) >= 0.35
  OR list_sum(list_transform(list_zip(c.s, p.s), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) <= 18))""")
def leak_guard(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return neardup.unleaked(rows.where("vec_id % 5 <> 0"), rows.where("vec_id % 5 = 0"), "vec_id", 0.35, 18).select("vec_id")


NEAREST = V + """, n AS (SELECT q.vec_id, any_value(q.label) AS label, coalesce(max(list_dot_product(q.e, b.e)), 0) AS near_cos FROM u q LEFT JOIN u b ON b.label = q.label AND b.vec_id % 5 <> 0 WHERE q.vec_id % 5 = 0 GROUP BY q.vec_id),
  a AS (SELECT q.vec_id, arg_max(b.label, list_dot_product(q.e, b.e)) AS predicted FROM u q, u b WHERE q.vec_id % 5 = 0 AND b.vec_id % 5 <> 0 GROUP BY q.vec_id)"""


# Nearest train row of each test row
@query(f"WITH {NEAREST} SELECT vec_id, round(near_cos, 6) AS near_cos FROM n")
def nearest_train(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return neardup.nearest(rows.where("vec_id % 5 = 0"), rows.where("vec_id % 5 <> 0"), "vec_id", "label").select("vec_id", F.round("near_cos", 6).alias("near_cos"))


def predictions(spark, sf_dir) -> DataFrame:
    """Test rows with the label of the nearest centroid of the train rows, and the largest cosine to their own label's train rows."""
    rows = vectors(spark, sf_dir).withColumn("test", F.col("vec_id") % 5 == 0)
    centroids = rows.where("not test").select("label", F.posexplode("unit").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    centroids = centroids.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    test = rows.where("test")
    # one row per label: the centroids are as many as there are labels, and the optimiser broadcasts them only below its size bound
    scored = test.select("vec_id", F.col("label").alias("truth"), "unit").join(centroids, how="cross").select("vec_id", "truth", F.col("label").alias("predicted"), F.round(vx.dot("unit", "c"), 9).alias("score"))
    best = scored.groupBy("vec_id", "truth").agg(F.max_by("predicted", F.struct("score", -F.col("predicted"))).alias("predicted"))
    near = neardup.nearest(test, rows.where("not test"), "vec_id", "label")
    return best.join(near, "vec_id")


CENTROIDS = V + """, c AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM u WHERE vec_id % 5 <> 0) GROUP BY label, i) GROUP BY label),
  s AS (SELECT u.vec_id, u.label AS truth, c.label AS predicted, round(list_dot_product(e, c), 9) AS score FROM u, c WHERE vec_id % 5 = 0),
  b AS (SELECT vec_id, truth, predicted FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, predicted) AS place FROM s) WHERE place = 1),
  n AS (SELECT q.vec_id, coalesce(max(list_dot_product(q.e, t.e)), 0) AS near_cos FROM u q LEFT JOIN u t ON t.label = q.label AND t.vec_id % 5 <> 0 WHERE q.vec_id % 5 = 0 GROUP BY q.vec_id),
  r AS (SELECT b.*, near_cos, near_cos < 0.3 AS clean, truth % 2 = 0 AS field FROM b JOIN n USING (vec_id)),
  z AS (SELECT 'all' AS slice, truth, predicted FROM r UNION ALL SELECT 'clean', truth, predicted FROM r WHERE clean UNION ALL SELECT 'field', truth, predicted FROM r WHERE field UNION ALL SELECT 'field_clean', truth, predicted FROM r WHERE field AND clean)"""


# The flagship; sliced scores with the clean test set
@query(f"""WITH {CENTROIDS}, l AS (SELECT slice, truth AS label, count(*) AS s, sum(CASE WHEN truth = predicted THEN 1 ELSE 0 END) AS hit FROM z GROUP BY slice, truth),
  q AS (SELECT slice, predicted AS label, count(*) AS q FROM z GROUP BY slice, predicted)
  SELECT slice, sum(s)::BIGINT AS n, round(sum(hit) / sum(s), 6) AS accuracy, round(avg(2 * hit / (s + coalesce(q, 0))), 6) AS macro_f1 FROM l LEFT JOIN q USING (slice, label) GROUP BY slice""")
def leakage_audit(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("clean", F.col("near_cos") < COS).withColumn("field", F.col("truth") % 2 == 0)
    rows = rows.withColumn("all", F.lit(True)).withColumn("field_clean", F.col("field") & F.col("clean"))
    found = evaluate.summary(rows, "truth", "predicted", ["all", "clean", "field", "field_clean"])
    return found.select("slice", "n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


# Confusion matrix over the label domain with row shares
@query("""WITH d AS (SELECT unnest([0, 1]) AS label), c AS (SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL)
  SELECT a.label AS truth, b.label AS predicted, coalesce(n, 0) AS n, round(coalesce(n, 0) / greatest(sum(coalesce(n, 0)) OVER (PARTITION BY a.label), 1), 6) AS share
  FROM d a CROSS JOIN d b LEFT JOIN c ON c.truth = a.label AND c.predicted = b.label""")
def confusion_matrix(spark, sf_dir):
    domain = spark.createDataFrame([(0,), (1,)], "label int")
    return evaluate.confusion(load(spark, sf_dir, "labels"), "quality", "toxic", domain).withColumn("share", F.round("share", 6))


# Per-class report
@query(f"""WITH {CENTROIDS}, l AS (SELECT truth AS label, count(*) AS s, sum(CASE WHEN truth = predicted THEN 1 ELSE 0 END) AS hit FROM b GROUP BY truth), q AS (SELECT predicted AS label, count(*) AS q FROM b GROUP BY predicted)
  SELECT label, round(coalesce(hit / nullif(q, 0), 0), 6) AS precision, round(coalesce(hit / nullif(s, 0), 0), 6) AS recall, round(coalesce(2 * coalesce(hit, 0) / (coalesce(s, 0) + coalesce(q, 0)), 0), 6) AS f1, coalesce(s, 0) AS support FROM l FULL JOIN q USING (label)""")
def class_report(spark, sf_dir):
    found = evaluate.class_report(predictions(spark, sf_dir), "truth", "predicted")
    return found.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


# A3: a split pivoted into columns
@query("SELECT source, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en FROM documents GROUP BY source")
def pivot_splits(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["de", "en"]).count().na.fill(0)


# Order-dependent scans; the SQL goes through the rows or pairs one by one in a recursion
LINKS = PAIRS + """, g AS (SELECT a, b, a % 3 AS la, b % 3 AS lb, row_number() OVER (ORDER BY a, b) AS i FROM p WHERE cos >= 0.3 OR ham <= 20)"""
GREEDY = f"""WITH RECURSIVE {LINKS},
  e AS (SELECT a AS id, b AS other FROM g UNION ALL SELECT b, a FROM g),
  x AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS i, coalesce(near, []) AS near FROM embeddings LEFT JOIN (SELECT id, list(other) AS near FROM e GROUP BY id) n ON n.id = vec_id),
  r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS done, []::STRUCT(id BIGINT, status INT)[] AS found
    UNION ALL SELECT x.i, CASE WHEN list_contains(done, x.id) THEN done ELSE list_concat(done, [x.id], list_filter(near, lambda y: NOT list_contains(done, y))) END,
      CASE WHEN list_contains(done, x.id) THEN found WHEN len(list_filter(near, lambda y: NOT list_contains(done, y) AND y % 3 <> x.id % 3)) > 0
        THEN list_concat(found, list_transform(list_concat([x.id], list_filter(near, lambda y: NOT list_contains(done, y))), lambda y: {{'id': y, 'status': 3}}))
        ELSE list_concat(found, [{{'id': x.id, 'status': 1}}], list_transform(list_filter(near, lambda y: NOT list_contains(done, y)), lambda y: {{'id': y, 'status': 2}})) END
    FROM r JOIN x ON x.i = r.i + 1)
  SELECT f.id, f.status FROM (SELECT unnest(found) AS f FROM r WHERE i = (SELECT count(*) FROM embeddings))"""
MERGED = f"""WITH RECURSIVE {LINKS},
  r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS gone UNION ALL SELECT g.i, CASE WHEN la <> lb THEN list_concat(gone, [a, b]) WHEN list_contains(gone, a) THEN gone ELSE list_concat(gone, [b]) END FROM r JOIN g ON g.i = r.i + 1)
  SELECT vec_id AS id, list_contains(gone, vec_id) AS dropped FROM embeddings, (SELECT gone FROM r WHERE i = (SELECT count(*) FROM g))"""
CAPPED = f"""WITH RECURSIVE {LINKS},
  r AS (SELECT 0::BIGINT AS i, (SELECT map_from_entries(list({{'k': vec_id, 'v': vec_id}})) FROM embeddings) AS home, []::BIGINT[] AS skips
    UNION ALL SELECT i, CASE WHEN fits THEN map_from_entries(list_transform(map_entries(home), lambda m: {{'key': m.key, 'value': CASE WHEN m.value = ca OR m.value = cb THEN least(ca, cb) ELSE m.value END}})) ELSE home END,
      CASE WHEN ca <> cb AND NOT fits THEN list_concat(skips, [a]) ELSE skips END
    FROM (SELECT *, ca <> cb AND len(list_filter(map_values(home), lambda v: v = ca OR v = cb)) <= 4 AS fits FROM (SELECT g.i, a, home, skips, home[a] AS ca, home[b] AS cb FROM r JOIN g ON g.i = r.i + 1)))
  SELECT vec_id AS id, home[vec_id] AS cluster, len(list_filter(skips, lambda s: s = vec_id))::BIGINT AS blocked FROM embeddings, (SELECT home, skips FROM r WHERE i = (SELECT count(*) FROM g))"""


def _near(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label").alias("block"), (F.col("vec_id") % 3).alias("label"), "unit", "bits")


@query(GREEDY)
def greedy_dedup(spark, sf_dir):
    return scans.greedy_dedup(_near(spark, sf_dir), "id", "block", "label", COS, HAM)


@query(MERGED)
def merge_copies(spark, sf_dir):
    return scans.merge_copies(_near(spark, sf_dir), "id", "block", "label", COS, HAM)


@query(CAPPED)
def capped_clusters(spark, sf_dir):
    return scans.capped_clusters(_near(spark, sf_dir), "id", "block", 4, COS, HAM)


# Seeded sample per key
@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('s:' || doc_id), doc_id) AS place FROM documents) WHERE place <= 50")
def sample_per_key(spark, sf_dir):
    return sampling.sample_per_key(load(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 50)


# F8: the sample that a seeded Mersenne generator draws from each key (no SQL; tested against Python's random)
@query()
def seeded_sample(spark, sf_dir):
    return sampling.seeded_sample(load(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 50)


# Fair cap across sources (the shares by the closed form of water-filling)
@query("""WITH s AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL),
  f AS (SELECT lang, source, n, row_number() OVER w AS i, count(*) OVER (PARTITION BY lang) AS m FROM s WINDOW w AS (PARTITION BY lang ORDER BY n, source)),
  t AS (WITH RECURSIVE r AS (SELECT lang, source, i, m, least(n, 60 // m) AS take, 60 - least(n, 60 // m) AS lft FROM f WHERE i = 1
    UNION ALL SELECT f.lang, f.source, f.i, f.m, least(f.n, r.lft // (f.m - f.i + 1)), r.lft - least(f.n, r.lft // (f.m - f.i + 1)) FROM r JOIN f ON f.lang = r.lang AND f.i = r.i + 1) SELECT * FROM r)
  SELECT doc_id FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('s:' || doc_id), doc_id) AS place FROM documents) d JOIN t USING (lang, source) WHERE place <= take""")
def fair_cap(spark, sf_dir):
    return sampling.fair_cap(load(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "lang", "source", "doc_id", 60).select("doc_id")


# Group-safe split with official lists
MD5 = "(" + " + ".join(f"('0x' || substr(md5(k::VARCHAR), {1 + 8 * i}, 8))::BIGINT % 5 * {pow(2, 32 * (3 - i), 5)}" for i in range(4)) + ") % 5"


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'train' WHEN o_orderstatus = 'P' THEN 'val' END AS official FROM orders),
  m AS (SELECT k, official FROM (SELECT k, official, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, official) AS place FROM o WHERE official IS NOT NULL GROUP BY k, official) WHERE place = 1)
  SELECT o_orderkey, coalesce(m.official, CASE WHEN {MD5.replace('k::', 'o.k::')} = 0 THEN 'val' ELSE 'train' END) AS split FROM o LEFT JOIN m ON m.k = o.k""")
def group_split(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "P", "val").alias("official"))
    return sampling.group_split(orders, "o_custkey", "official").select("o_orderkey", "split")


# Clusters to test until the share is reached
@query("""WITH c AS (SELECT o_custkey AS cluster, min(o_orderpriority) AS label, count(*) AS size FROM orders GROUP BY o_custkey)
  SELECT cluster, CASE WHEN coalesce(sum(size) OVER (PARTITION BY label ORDER BY md5('split:' || cluster), cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.15 * sum(size) OVER (PARTITION BY label) THEN 'test' ELSE 'train' END AS split FROM c""")
def cluster_split(spark, sf_dir):
    clusters = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cluster")).agg(F.min("o_orderpriority").alias("label"), F.count(F.lit(1)).alias("size"))
    return sampling.cluster_split(clusters).select("cluster", "split")


# Class-balanced weights with a boost
@query("SELECT doc_id, round((CASE WHEN source <> 'src0' THEN 3.0 ELSE 1.0 END / sum(CASE WHEN source <> 'src0' THEN 3.0 ELSE 1.0 END) OVER (PARTITION BY lang))::DOUBLE, 9) AS weight FROM documents")
def boosted_weights(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("source") != "src0").alias("field"))
    return sampling.boosted_weights(rows, "lang", "field").select("doc_id", F.round("weight", 9).alias("weight"))


# Weighted draw with replacement
@query("""WITH w AS (SELECT event_id, value / 100 AS w, ('0x' || substr(md5('draw:' || event_id), 1, 12))::BIGINT / 281474976710656.0 AS u FROM events),
  c AS (SELECT event_id, (floor(w) + CASE WHEN u < w - floor(w) THEN 1 ELSE 0 END)::BIGINT AS copies FROM w) SELECT event_id, copies FROM c WHERE copies > 0""")
def weighted_draw(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", (F.col("value") / 100).alias("w"))
    return sampling.weighted_draw(rows, "event_id", "w").select("event_id", "copies")


# decisions
@query("""WITH p AS (SELECT user_id AS photo, substr(event_type, 1, 1) AS crop, event_type AS label, exp(avg(value) / 50) AS x FROM events GROUP BY ALL),
  q AS (SELECT photo, crop, label, x / sum(x) OVER (PARTITION BY photo) AS p FROM p),
  s AS (SELECT photo, crop, sum(p) AS share, row_number() OVER (PARTITION BY photo ORDER BY sum(p) DESC, crop) AS place FROM q GROUP BY photo, crop),
  t AS (SELECT photo, max(crop) FILTER (WHERE place = 1) AS detected, max(share) FILTER (WHERE place = 1) AS top, coalesce(max(share) FILTER (WHERE place = 2), 0) AS second, count(*) AS crops FROM s GROUP BY photo),
  c AS (SELECT photo, crop AS chosen, share AS chosen_share FROM s WHERE photo % 3 = 0 AND crop = 'c'),
  f AS (SELECT t.*, chosen, chosen IS NULL AND crops > 1 AND (top < 0.5 OR top - second < 0.35) AS ambiguous, coalesce(chosen IS NOT NULL AND chosen <> detected AND chosen_share < 0.15, false) AS mismatch FROM t LEFT JOIN c USING (photo)),
  r AS (SELECT q.photo, detected, top - second AS lead, ambiguous, mismatch, label, q.p / sum(q.p) OVER (PARTITION BY q.photo) AS p FROM q JOIN f USING (photo) WHERE coalesce(chosen, CASE WHEN NOT ambiguous THEN detected END) IS NULL OR q.crop = coalesce(chosen, CASE WHEN NOT ambiguous THEN detected END))
  SELECT photo, detected, round(lead, 6) AS lead, ambiguous, mismatch, label, round(p, 6) AS p, CASE WHEN ambiguous THEN 'ask' WHEN mismatch THEN 'mismatch' WHEN p < 0.28 THEN 'unsure' ELSE 'sure' END AS kind
  FROM (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY p DESC, label) AS place FROM r) WHERE place = 1""")
def decisions(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    logits = events.groupBy(F.col("user_id").alias("photo"), F.col("event_type").alias("label")).agg(F.exp(F.avg("value") / 50).alias("x"))
    from pyspark.sql import Window

    probs = logits.select("photo", F.substring("label", 1, 1).alias("crop"), "label", (F.col("x") / F.sum("x").over(Window.partitionBy("photo"))).alias("p"))
    chosen = events.select(F.col("user_id").alias("photo")).distinct().where("photo % 3 = 0").withColumn("crop", F.lit("c"))
    return decide.decide(probs, chosen).withColumn("lead", F.round("lead", 6)).withColumn("p", F.round("p", 6))


# names
@query(f"""SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS norm, regexp_replace(lower(p_type), '[^a-z0-9]+', '', 'g') AS tight, trim(regexp_replace(lower(p_brand), '[^A-Za-z0-9]+', '_', 'g'), '_') AS slug,
  upper(substr(p_type, 1, 1)) || substr(p_type, 2) AS shown, ({MD5.replace('k::', 'p_partkey::')})::INT AS bucket FROM part""")
def name_functions(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    return part.select("p_partkey", tx.norm(F.col("p_name")).alias("norm"), tx.norm_tight(F.col("p_type")).alias("tight"), tx.slug(F.col("p_brand")).alias("slug"), tx.display(F.col("p_type")).alias("shown"), tx.stable_bucket(F.col("p_partkey").cast("string"), 5).alias("bucket"))


# a query parameter of a URL, blank as null
@query("SELECT page_id, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM pages")
def url_parameter(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.nullif(F.trim(F.parse_url("url", F.lit("QUERY"), F.lit("ref"))), F.lit("")).alias("ref"))


# Templates filled from parameters
@query("SELECT n_nationkey, 'Visit ' || n_name || ' in {month}' AS text FROM nation")
def template_fill(spark, sf_dir):
    return load(spark, sf_dir, "nation").select("n_nationkey", tx.fill(F.lit("Visit {name} in {month}"), F.create_map(F.lit("name"), F.col("n_name"))).alias("text"))


# keywords of a title
@query("SELECT item_id, len(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: len(w) >= 3 AND w NOT IN ('the', 'and', 'for')))) AS n FROM benchmark")
def title_keywords(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", F.size(tx.keywords(F.col("text"), ("the", "and", "for"))).cast("long").alias("n"))


# learning-rate schedule
@query("SELECT event_id, round(CASE WHEN event_id < 50 THEN (event_id + 1) / 50.0 ELSE 0.5 * (1 + cos(pi() * least(1.0, (event_id - 50) / 950.0))) END, 6) AS rate FROM events")
def lr_schedule(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.round(vx.cosine_schedule(F.col("event_id"), 1000, 50), 6).alias("rate"))


# Statistics of a grey frame; the vector stands in for an 8 x 8 image
@query("""WITH f AS (SELECT vec_id, embedding::DOUBLE[] AS g FROM embeddings)
  SELECT vec_id, round(list_avg(g), 6) AS mean, round(list_stddev_pop(g), 6) AS spread, round(list_var_pop(list_transform(list_filter(range(64), lambda i: i % 8 > 0 AND i % 8 < 7 AND i >= 8 AND i < 56), lambda i: 4 * g[i + 1] - g[i] - g[i + 2] - g[i - 7] - g[i + 9])), 6) AS sharpness FROM f""")
def frame_statistics(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("g"))
    return rows.select("vec_id", *[F.round(c, 6).alias(n) for n, c in vx.luma_stats(F.col("g"), 8).items()])


# Size that fits
@query("SELECT p_partkey, greatest(1, round(p_partkey * least(1.0::DOUBLE, 512.0::DOUBLE / greatest(p_partkey, p_size))))::INT AS w, greatest(1, round(p_size * least(1.0::DOUBLE, 512.0::DOUBLE / greatest(p_partkey, p_size))))::INT AS h FROM part")
def fit_sizes(spark, sf_dir):
    w, h = vx.fit_within(F.col("p_partkey"), F.col("p_size"), 512)
    return load(spark, sf_dir, "part").select("p_partkey", w.alias("w"), h.alias("h"))


# Digests and JSON
@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_digest(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("SELECT event_id, (props->>'k')::INT AS k FROM events")
def json_decode(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# Vote smoothing per session; the SQL recursion takes the k-th row of every session at once
@query("""WITH RECURSIVE e AS (SELECT user_id AS session, event_id AS seq, substr(event_type, 1, 1) || '::' || event_type AS label, least(value / 100, 1.0) AS p,
    CASE WHEN event_id % 17 = 0 THEN 'reset' WHEN event_type = 'error' THEN 'ambiguous' ELSE '' END AS control, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
  r AS (SELECT session, 0::BIGINT AS k, 0::BIGINT AS seq, []::STRUCT(label VARCHAR, p DOUBLE)[] AS recent, 0 AS streak, NULL::VARCHAR AS spoken, '' AS state, NULL::VARCHAR AS label, 0 AS votes, NULL::DOUBLE AS mean, false AS announced FROM e GROUP BY session
    UNION ALL SELECT session, k, seq, recent,
      CASE control WHEN 'reset' THEN streak WHEN 'ambiguous' THEN 0 ELSE CASE WHEN p < 0.28 THEN streak + 1 ELSE 0 END END,
      CASE WHEN control = 'reset' THEN NULL WHEN control = 'ambiguous' THEN 'ask' WHEN p < 0.28 THEN CASE WHEN streak + 1 >= 3 THEN NULL ELSE spoken END WHEN votes >= 3 AND mean >= 0.5 THEN label ELSE spoken END,
      CASE WHEN control = 'reset' THEN 'reset' WHEN control = 'ambiguous' THEN 'ask' WHEN p < 0.28 THEN CASE WHEN streak + 1 >= 2 THEN 'unsure' ELSE 'watch' END WHEN votes >= 3 AND mean >= 0.5 THEN 'sure' ELSE 'watch' END,
      CASE WHEN control = '' THEN label END, CASE WHEN control = '' THEN votes ELSE 0 END, CASE WHEN control = '' THEN mean END,
      CASE WHEN control = 'reset' THEN false WHEN control = 'ambiguous' THEN spoken IS DISTINCT FROM 'ask' ELSE p >= 0.28 AND votes >= 3 AND mean >= 0.5 AND spoken IS DISTINCT FROM label END
    FROM (SELECT *, len(same)::INT AS votes, list_sum(list_transform(same, lambda x: x.p)) / len(same) AS mean
      FROM (SELECT *, list_filter(recent, lambda x: x.label = label) AS same
        FROM (SELECT r.session, e.k, e.seq, e.label, e.p, e.control, r.streak, r.spoken, CASE WHEN control <> '' THEN [] ELSE list_concat(r.recent, [{'label': e.label, 'p': e.p}])[-5:] END AS recent FROM r JOIN e ON e.session = r.session AND e.k = r.k + 1))))
  SELECT session, seq, state, label, votes, round(mean, 6) AS mean, announced FROM r WHERE k > 0""")
def vote_smoother(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    control = F.when(F.col("event_id") % 17 == 0, "reset").when(F.col("event_type") == "error", "ambiguous").otherwise("")
    scans = events.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.substring("event_type", 1, 1).alias("crop"), F.col("event_type").alias("label"), F.least(F.col("value") / 100, F.lit(1.0)).alias("p"), control.alias("control"))
    return votes.smooth_batch(scans, 0.28, 0.5).withColumn("mean", F.round("mean", 6))


QUERIES.update(extended.QUERIES | persisted.QUERIES)
ORACLE_SQL.update(extended.ORACLE_SQL | persisted.ORACLE_SQL)
