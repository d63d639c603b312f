"""

The tables stand in for the reference's: users of `events` for sessions or photos, event types for labels (their first letter for the crop), languages
and sources of `documents` for crops and sources, vectors for images and logits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curata.functions import text as tx
from curata.functions import vectors as vx
from curata.operators import advice, cluster, evaluate, neardup, ordered, sampling
from curata.plans import portable
from curata.sources import tables
from curata.sources.tables import load
from curata.streaming import pace

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def by_user() -> Window:
    return Window.partitionBy("user_id").orderBy("event_id")


r6 = lambda c, name: F.round(c, 6).alias(name)


# Chosen rows by label columns only, their payload by file and row number
@query("SELECT doc_id, length(text) AS n FROM documents WHERE doc_id % 10 = 0")
def late_rows(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    at = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")]
    chosen = docs.where("doc_id % 10 = 0").select("doc_id", *at)
    return docs.select("text", *at).join(chosen, ["file", "row"]).select("doc_id", F.length("text").cast("long").alias("n"))


# Integer labels by their place in a list of names
@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'africa' WHEN 1 THEN 'america' WHEN 2 THEN 'asia' ELSE n_regionkey::VARCHAR END AS label FROM nation")
def decoded_labels(spark, sf_dir):
    names = F.array(F.lit("africa"), F.lit("america"), F.lit("asia"))
    return load(spark, sf_dir, "nation").select("n_nationkey", tables.decode_label(F.col("n_regionkey"), names).alias("label"))


# Payloads against their expected digests
@query("SELECT doc_id::VARCHAR AS file, octet_length(encode(text))::BIGINT AS length, doc_id % 7 <> 0 AND doc_id % 5 <> 0 AS verified FROM documents")
def verified_payloads(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), "doc_id", F.encode("text", "UTF-8").alias("content"))
    files = docs.select("file", "content", F.length("content").cast("long").alias("length"))
    expected = docs.where("doc_id % 5 <> 0").select("file", F.when(F.col("doc_id") % 7 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.upper(F.sha2("content", 256))).alias("sha256"))
    return tables.verified(files, expected)


# One scan per physical source serves the many classes that use it
@query("""WITH t(crop, source) AS (VALUES ('en', 'src0'), ('de', 'src0'), ('en', 'src1'), ('fr', 'src1')) SELECT t.source, t.crop, count(d.doc_id) AS n FROM t LEFT JOIN documents d ON d.source = t.source AND d.lang = t.crop GROUP BY ALL""")
def shared_scans(spark, sf_dir):
    wanted = spark.createDataFrame([("en", "src0"), ("de", "src0"), ("en", "src1"), ("fr", "src1")], "crop string, source string")
    return tables.shared_scans(wanted, load(spark, sf_dir, "documents").select("source", F.col("lang").alias("crop"), "doc_id"), "source", "crop").withColumnRenamed("count", "n")


# An optional source filter, then wrong rows in seeded order
@query("""SELECT doc_id FROM labels JOIN documents USING (doc_id) WHERE quality = toxic AND source IN (SELECT DISTINCT source FROM documents WHERE source LIKE '%1') ORDER BY md5('7:' || doc_id), doc_id LIMIT 16""")
def mistakes_by_source(spark, sf_dir):
    rows = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").where("quality = toxic")
    return tables.only_sources(rows, "source", F.col("source").endswith("1")).orderBy(sampling.draw_order("7", "doc_id"), "doc_id").limit(16).select("doc_id")


# The column that a value set belongs to is found by counting hits
@query("SELECT c_custkey FROM customer WHERE lower(trim(c_mktsegment)) IN ('building', 'machinery')")
def discovered_filter(spark, sf_dir):
    return tables.by_value_set(load(spark, sf_dir, "customer"), {"building", "machinery"}).select("c_custkey")


# Rejected rows with an error code
@query("""SELECT page_id, CASE WHEN html IS NULL OR html = '' THEN 'no_body' WHEN length(html) > 8000 THEN 'too_large' WHEN position('<article' IN html) = 0 THEN 'not_readable' ELSE 'ok' END AS code,
  CASE WHEN nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') IN ('x', 'y') THEN nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') END AS crop FROM pages""")
def checked_input(spark, sf_dir):
    crop = F.nullif(F.regexp_extract("url", "[?&]ref=([^&#]*)", 1), F.lit(""))
    code = F.when(F.coalesce("html", F.lit("")) == "", "no_body").when(F.length("html") > 8000, "too_large").when(~F.contains("html", F.lit("<article")), "not_readable").otherwise("ok")
    return load(spark, sf_dir, "pages").select("page_id", code.alias("code"), F.when(crop.isin("x", "y"), crop).alias("crop"))


# The mode of a group on each of its rows, ties to the smaller value
@query("""WITH c AS (SELECT o_custkey, o_orderpriority AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS place FROM orders GROUP BY o_custkey, o_orderpriority)
  SELECT o_orderkey, v AS usual FROM orders JOIN c USING (o_custkey) WHERE place = 1""")
def group_mode(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    return orders.join(orders.groupBy("o_custkey").agg(F.mode("o_orderpriority", True).alias("usual")), "o_custkey").select("o_orderkey", "usual")


V = """u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS e,
  list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS s FROM embeddings)"""


def vectors(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", vx.unit("embedding").alias("unit"), vx.sign_bits("embedding").alias("bits"))


# Near pairs of the whole pool
@query(f"""WITH {V}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.e, b.e) AS cos, list_sum(list_transform(list_zip(a.s, b.s), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::INT AS ham FROM u a JOIN u b ON a.vec_id < b.vec_id)
  SELECT a, b, round(cos, 6) AS cos, ham FROM p WHERE cos >= 0.4 OR ham <= 17""")
def near_pool(spark, sf_dir):
    return neardup.near_pairs(vectors(spark, sf_dir), "vec_id", None, 0.4, 17).select("a", "b", r6("cos", "cos"), "ham")


# Rows joined by position
@query("SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey DESC) AS i FROM supplier) USING (i)")
def positional_zip(spark, sf_dir):
    one = ordered.ranked(load(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"])
    return one.join(ordered.ranked(load(spark, sf_dir, "supplier").select("s_suppkey"), [F.desc("s_suppkey")]), "place").select("c_custkey", "s_suppkey")


# A class number's label and crop as a struct
@query("SELECT vec_id, 'label' || label AS name, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS crop FROM embeddings")
def struct_lookup(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "label")
    names = rows.select("label").distinct().select("label", F.struct(F.concat(F.lit("label"), "label").alias("name"), F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("crop")).alias("of"))
    return rows.join(names, "label").select("vec_id", "of.name", "of.crop")


#: Truth, and a prediction that the value decides.
GUESS = "CASE WHEN value >= 100 THEN 'click' WHEN value >= 50 THEN 'signup' ELSE event_type END"


def guesses(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("truth"), F.expr(GUESS).alias("predicted"))


CLASS_SQL = f"""g AS (SELECT event_type AS t, {GUESS} AS p FROM events), s AS (SELECT t AS label, count(*) AS support, sum((t = p)::INT) AS hit FROM g GROUP BY t), q AS (SELECT p AS label, count(*) AS said FROM g GROUP BY p),
  r AS (SELECT label, coalesce(hit / nullif(said, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall, coalesce(2 * hit / (coalesce(support, 0) + coalesce(said, 0)), 0) AS f1, coalesce(support, 0)::BIGINT AS support FROM s FULL JOIN q USING (label))"""


# Per class, macro and weighted averages, accuracy
@query(f"""WITH {CLASS_SQL}, a AS (SELECT * FROM r UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM r
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM r
  UNION ALL SELECT 'accuracy', avg((t = p)::INT), avg((t = p)::INT), avg((t = p)::INT), count(*) FROM g) SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM a""")
def full_report(spark, sf_dir):
    found = evaluate.full_report(guesses(spark, sf_dir), "truth", "predicted")
    return found.select("label", *(r6(c, c) for c in ("precision", "recall", "f1")), "support")


# The weakest classes
@query(f"WITH {CLASS_SQL} SELECT label, round(f1, 6) AS f1 FROM r WHERE support > 0 ORDER BY r.f1, label LIMIT 3")
def weakest_classes(spark, sf_dir):
    found = evaluate.class_report(guesses(spark, sf_dir), "truth", "predicted").where("support > 0")
    return found.orderBy("f1", "label").limit(3).select("label", r6("f1", "f1"))


# Scores per slice, free and with the crop given
@query("""WITH m AS (SELECT user_id, event_type AS label, sum(value) AS p, count(*) AS n FROM events GROUP BY ALL),
  t AS (SELECT user_id, label AS truth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, label) AS k FROM m) WHERE k = 1),
  f AS (SELECT user_id, label AS free FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, label) AS k FROM m) WHERE k = 1),
  c AS (SELECT user_id, label AS given FROM (SELECT m.*, row_number() OVER (PARTITION BY m.user_id ORDER BY p DESC, label) AS k FROM m JOIN t ON t.user_id = m.user_id AND label[1] = truth[1]) WHERE k = 1),
  z AS (SELECT 'all' AS slice, * FROM t JOIN f USING (user_id) JOIN c USING (user_id) UNION ALL SELECT 'field', * FROM t JOIN f USING (user_id) JOIN c USING (user_id) WHERE user_id % 2 = 0)
  SELECT slice, count(*) AS n, round(avg((truth = free)::INT), 6) AS accuracy, round(avg((truth = given)::INT), 6) AS given_accuracy FROM z GROUP BY slice""")
def crop_given(spark, sf_dir):
    sums = load(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("label")).agg(F.sum("value").alias("p"), F.count(F.lit(1)).alias("n"))
    truth = evaluate.first_by(sums, ["user_id"], [F.desc("n"), "label"]).select("user_id", F.col("label").alias("truth"))
    rows = evaluate.free_and_given(sums.withColumn("crop", F.substring("label", 1, 1)), truth.withColumn("crop", F.substring("truth", 1, 1)), "user_id")
    slices = F.filter(F.array(F.lit("all"), F.when(F.col("user_id") % 2 == 0, "field")), lambda x: x.isNotNull())
    ok = lambda c: F.avg((F.col("truth") == F.col(c)).cast("double"))
    return rows.withColumn("slice", F.explode(slices)).groupBy("slice").agg(F.count(F.lit(1)).alias("n"), r6(ok("free"), "accuracy"), r6(ok("given"), "given_accuracy"))


# Accuracy and macro-F1 of each crop over its full class domain
@query("""WITH d(label) AS (VALUES (0), (1), (2)), r AS (SELECT lang, quality AS t, 1 - toxic AS p FROM documents JOIN labels USING (doc_id)),
  c AS (SELECT lang, label, (SELECT count(*) FROM r WHERE r.lang = x.lang AND t = label) AS s, (SELECT count(*) FROM r WHERE r.lang = x.lang AND p = label) AS q, (SELECT count(*) FROM r WHERE r.lang = x.lang AND t = label AND p = label) AS h FROM (SELECT DISTINCT lang FROM r) x, d)
  SELECT lang, round(sum(h) / sum(s), 6) AS accuracy, round(avg(CASE WHEN s + q > 0 THEN 2 * h / (s + q) ELSE 0 END), 6) AS macro_f1 FROM c GROUP BY lang""")
def crop_scores(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels"), "doc_id").select("lang", F.col("quality").alias("truth"), (1 - F.col("toxic")).alias("predicted"))
    return evaluate.domain_scores(rows, "lang", "truth", "predicted", [0, 1, 2]).select("lang", r6("accuracy", "accuracy"), r6("macro_f1", "macro_f1"))


# Mix-ups with their share of the true class and whether the crop is the same
@query(f"""WITH g AS (SELECT event_type AS truth, {GUESS} AS predicted FROM events), t AS (SELECT truth, count(*) AS total FROM g GROUP BY truth)
  SELECT truth, predicted, n, round(n / total, 3) AS share, truth[1] = predicted[1] AS same_crop FROM (SELECT truth, predicted, count(*) AS n FROM g WHERE truth <> predicted GROUP BY ALL) JOIN t USING (truth) ORDER BY n DESC, truth, predicted LIMIT 30""")
def mixups(spark, sf_dir):
    return evaluate.mixups(guesses(spark, sf_dir), "truth", "predicted", lambda c: F.substring(c, 1, 1), 30)


# Counters of one pass
@query("SELECT source, count(*) AS images, sum((n_chars < 20)::INT)::BIGINT AS too_short, sum((lang NOT IN ('en', 'de'))::INT)::BIGINT AS unmapped FROM documents GROUP BY source")
def scan_counters(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("n_chars") < 20).alias("too_short"), F.count_if(~F.col("lang").isin("en", "de")).alias("unmapped"))


# Votes, mean and share within the last five rows of a session
@query("""WITH w AS (SELECT event_id, event_type, list({'l': event_type, 'p': least(value / 100, 1.0)}) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l FROM events),
  f AS (SELECT event_id, len(l) AS n, list_filter(l, lambda x: x.l = event_type) AS m FROM w) SELECT event_id, len(m)::INT AS votes, round(list_avg(list_transform(m, lambda x: x.p)), 6) AS mean, round(len(m) / n, 6) AS share FROM f""")
def vote_shares(spark, sf_dir):
    last = F.collect_list(F.struct(F.col("event_type").alias("l"), F.least(F.col("value") / 100, F.lit(1.0)).alias("p"))).over(by_user().rowsBetween(-4, 0))
    rows = load(spark, sf_dir, "events").withColumn("last", last).withColumn("same", F.filter("last", lambda x: x["l"] == F.col("event_type")))
    return rows.select("event_id", F.size("same").alias("votes"), r6(F.aggregate("same", F.lit(0.0), lambda s, x: s + x["p"]) / F.size("same"), "mean"), r6(F.size("same") / F.size("last"), "share"))


# The first epoch of the second phase, from its third on, that reaches the bound
@query("""WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events), p AS (SELECT *, step > 5 AS fine, step - 5 AS epoch FROM s)
  SELECT user_id, count(*) FILTER (WHERE step <= coalesce(stop, step)) AS steps, min(stop) AS stop FROM p LEFT JOIN (SELECT user_id, min(step) AS stop FROM p WHERE fine AND epoch >= 3 AND value >= 97 GROUP BY user_id) USING (user_id) GROUP BY user_id""")
def early_stop_phases(spark, sf_dir):
    steps = load(spark, sf_dir, "events").withColumn("step", F.row_number().over(by_user()).cast("long"))
    stop = F.min(F.when((F.col("step") >= 8) & (F.col("value") >= 97), F.col("step"))).over(Window.partitionBy("user_id"))
    return steps.withColumn("stop", stop).groupBy("user_id").agg(F.count_if(F.col("step") <= F.coalesce("stop", "step")).alias("steps"), F.min("stop").alias("stop"))


# Announced when it differs from the last announced label, which three unsure rows in a row forget
@query("""WITH e AS (SELECT *, CASE WHEN value < 28 THEN 1 ELSE 0 END AS low FROM events), i AS (SELECT *, sum(1 - low) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM e),
  s AS (SELECT *, CASE WHEN low = 1 THEN sum(low) OVER (PARTITION BY user_id, island ORDER BY event_id) ELSE 0 END AS streak FROM i)
  SELECT a.event_id FROM s a WHERE a.value >= 55 AND coalesce((SELECT CASE WHEN b.value < 55 THEN NULL ELSE b.event_type END FROM s b WHERE b.user_id = a.user_id AND b.event_id < a.event_id AND (b.value >= 55 OR b.streak >= 3) ORDER BY b.event_id DESC LIMIT 1), '') <> a.event_type""")
def announced(spark, sf_dir):
    rows = load(spark, sf_dir, "events").withColumn("low", F.col("value") < 28)
    run = F.sum((~F.col("low")).cast("int")).over(by_user())
    streak = F.row_number().over(Window.partitionBy("user_id", "run", "low").orderBy("event_id"))
    marks = rows.withColumn("run", run).withColumn("forget", F.col("low") & (streak >= 3)).where("value >= 55 or forget")
    spoken = F.lag(F.when(~F.col("forget"), F.col("event_type"))).over(by_user())
    return marks.withColumn("spoken", spoken).where("not forget and not (spoken <=> event_type)").select("event_id")


# A capture fires at the fifth calm frame in a row (little change, bright and rich enough), once the session has been live for a day
@query("""WITH d AS (SELECT event_id, user_id, ts, value, (props->>'k')::INT AS spread, min(ts) OVER (PARTITION BY user_id) AS since, row_number() OVER w AS k, abs(value - lag(value) OVER w) AS diff FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  c AS (SELECT *, coalesce(diff < 60 AND value > 10 AND spread > 1, false) AS calm FROM d), i AS (SELECT *, k - row_number() OVER (PARTITION BY user_id, calm ORDER BY event_id) AS island FROM c)
  SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) AS run FROM i WHERE calm) WHERE run >= 5 AND ts > since + INTERVAL 1 DAY""")
def auto_capture(spark, sf_dir):
    since = F.min("ts").over(Window.partitionBy("user_id"))
    rows = load(spark, sf_dir, "events").withColumn("since", since).withColumn("diff", F.abs(F.col("value") - F.lag("value").over(by_user()))).withColumn("spread", F.from_json("props", "k int")["k"])
    rows = rows.withColumn("calm", F.coalesce((F.col("diff") < 60) & (F.col("value") > 10) & (F.col("spread") > 1), F.lit(False)))
    breaks = F.sum((~F.col("calm")).cast("int")).over(by_user())
    steady = F.sum(F.col("calm").cast("int")).over(Window.partitionBy("user_id", "breaks").orderBy("event_id"))
    live = F.col("ts") > F.col("since") + F.expr("INTERVAL 1 DAY")
    return rows.withColumn("breaks", breaks).withColumn("steady", steady).where(F.col("calm") & (F.col("steady") >= 5) & live).select("event_id")


# The newest request of a session stands, older ones are cancelled
@query("SELECT conv_id, turn, CASE WHEN turn = (SELECT max(turn) FROM conversations o WHERE o.conv_id = c.conv_id) THEN 'current' ELSE 'cancelled' END AS state FROM conversations c")
def cancelled_requests(spark, sf_dir):
    newest = F.max("turn").over(Window.partitionBy("conv_id"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") == newest, "current").otherwise("cancelled").alias("state"))


# After a scan of a session the next one at least a gap later
@query("""WITH RECURSIVE e AS (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY user_id, ts),
  n AS (SELECT a.user_id, a.event_id, arg_min(b.event_id, b.ts) AS following FROM e a JOIN e b ON a.user_id = b.user_id AND a.ts + INTERVAL 36 HOUR <= b.ts GROUP BY a.user_id, a.event_id),
  r AS (SELECT user_id, arg_min(event_id, ts) AS event_id FROM e GROUP BY user_id UNION ALL SELECT n.user_id, n.following FROM r JOIN n ON n.user_id = r.user_id AND n.event_id = r.event_id)
  SELECT user_id, event_id FROM r""")
def throttled(spark, sf_dir):
    return pace.throttled(load(spark, sf_dir, "events"), "user_id", "ts", "event_id", 36 * 3600 * 1_000_000)


# Progress of a transfer as states
@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'FAILED' WHEN k = n THEN 'DONE' WHEN k = 1 THEN 'STARTED' ELSE 'RUNNING' END AS state, floor(100 * k / n)::INT AS percent
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)""")
def progress_states(spark, sf_dir):
    rows = load(spark, sf_dir, "events").withColumn("k", F.row_number().over(by_user())).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    state = F.when(F.col("event_type") == "error", "FAILED").when(F.col("k") == F.col("n"), "DONE").when(F.col("k") == 1, "STARTED").otherwise("RUNNING")
    return rows.select("event_id", state.alias("state"), F.floor(100 * F.col("k") / F.col("n")).cast("int").alias("percent"))


# A send queue: an attempt before its due time waits, a client that is done is not sent again, the fifth failure is the last
_ATTEMPTS = ["a1 AS (SELECT client, arg_min(event_id, (t, event_id)) AS event_id, min(t) AS t, arg_min(ok, (t, event_id)) AS ok, 1 AS attempt FROM s GROUP BY client)"]
_ATTEMPTS += [f"a{k} AS (SELECT s.client, arg_min(s.event_id, (s.t, s.event_id)) AS event_id, min(s.t) AS t, arg_min(s.ok, (s.t, s.event_id)) AS ok, {k} AS attempt FROM a{k - 1} p JOIN s USING (client) WHERE NOT p.ok AND s.t >= p.t + INTERVAL {21600 * 2 ** (k - 2)} SECOND GROUP BY s.client)" for k in range(2, 6)]


@query(f"""WITH s AS (SELECT user_id || ':' || event_type AS client, event_id, ts AS t, value >= 90 AS ok FROM events), {", ".join(_ATTEMPTS)},
  m AS (SELECT *, CASE WHEN ok THEN 'DONE' WHEN attempt = 5 THEN 'FAILED' ELSE 'PENDING' END AS state FROM ({" UNION ALL ".join(f"SELECT * FROM a{k}" for k in range(1, 6))})),
  j AS (SELECT s.client, s.event_id, m.attempt, m.event_id AS made, m.state, row_number() OVER (PARTITION BY s.event_id ORDER BY m.attempt DESC) AS place FROM s JOIN m ON m.client = s.client AND (m.t, m.event_id) <= (s.t, s.event_id))
  SELECT client, event_id, attempt, CASE WHEN made = event_id THEN state WHEN state = 'DONE' THEN 'REPEATED' WHEN state = 'FAILED' THEN 'REFUSED' ELSE 'WAITING' END AS state FROM j WHERE place = 1""")
def queue_attempts(spark, sf_dir):
    sends = load(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", "event_type").alias("client"), "event_id", "ts", (F.col("value") >= 90).alias("ok"))
    return pace.queue_states(sends, "client", "ts", "event_id", "ok", base_s=21600)


# The newest 100 of an owner; their display goes after 90 days
@query("""SELECT event_id, ts >= (SELECT max(ts) FROM events) - INTERVAL 90 DAY AS has_display FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 100""")
def retention(spark, sf_dir):
    rows = load(spark, sf_dir, "events")
    now = rows.agg(F.max("ts").alias("now"))
    kept = evaluate.first_by(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], 100)
    return kept.join(now, how="cross").select("event_id", (F.col("ts") >= F.col("now") - F.expr("INTERVAL 90 DAY")).alias("has_display"))


# K5: a global order by priority, numbered without a single-task window
@query("SELECT doc_id, row_number() OVER (ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, doc_id) AS place FROM documents")
def priority_order(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2).alias("priority"))
    return ordered.ranked(rows, ["priority", "doc_id"]).select("doc_id", "place")


# A random cut in seeded order
@query("SELECT doc_id, CASE WHEN place <= 0.8 * n THEN 'train' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) AS place, count(*) OVER () AS n FROM documents)")
def random_cut(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("h"))
    n = rows.count()
    return ordered.ranked(rows, ["h", "doc_id"]).select("doc_id", F.when(F.col("place") <= F.lit(0.8 * n), "train").otherwise("test").alias("split"))


# Identical texts share one clip number
@query("SELECT doc_id, dense_rank() OVER (ORDER BY text) AS clip FROM documents WHERE lang = 'es'")
def shared_clips(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").where("lang = 'es'").select("doc_id", "text")
    return rows.join(ordered.ranked(rows.select("text").distinct(), ["text"], "clip", long="text"), "text").select("doc_id", "clip")


def totals_in_order(events: DataFrame) -> DataFrame:
    """Per user and event type: total, whole (of the user) and place. Doubles add up to other last digits in another order of rows, so equal totals would be placed by chance;
    values are added as decimals, and as doubles only in groups that hold a value that is no decimal(38, 18)."""
    exact = F.try_sum(F.col("value").try_cast("decimal(38,18)"))
    whole = F.count("value") == F.count(F.col("value").try_cast("decimal(38,18)"))
    totals = events.groupBy("user_id", "event_type").agg(F.coalesce(F.when(whole, exact).cast("double"), F.sum("value")).alias("total"))
    user = Window.partitionBy("user_id")
    return totals.withColumn("whole", F.sum("total").over(user)).withColumn("place", F.row_number().over(user.orderBy(F.desc("total"), "event_type")))


# K1 K3: top three of each
@query(portable.SQL["top_three"])
def top_three(spark, sf_dir):
    return totals_in_order(load(spark, sf_dir, "events")).where("place <= 3").select("user_id", "event_type", "place")


# K4: two always, a third only with a share of 0.05
@query(portable.SQL["crop_buttons"])
def crop_buttons(spark, sf_dir):
    return totals_in_order(load(spark, sf_dir, "events")).where("place <= 2 or (place = 3 and (whole = 0 and total >= 0 or whole <> 0 and total / whole >= 0.05))").select("user_id", "event_type")


# K6: names in a collation that ignores case, a fixed one first
@query("SELECT c_mktsegment AS name, row_number() OVER (ORDER BY CASE WHEN c_mktsegment = 'MACHINERY' THEN 0 ELSE 1 END, lower(c_mktsegment)) AS place FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def collated_names(spark, sf_dir):
    names = load(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    return ordered.ranked(names, [F.when(F.col("name") == "MACHINERY", 0).otherwise(1), F.collate("name", "UNICODE_CI")]).select("name", "place")


# Both slug policies, label parts, path parts
@query("""SELECT page_id, regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^.*/', '') AS name, coalesce(list_extract(string_split(split_part(split_part(url, '?', 1), '#', 1), '/'), -2), '') AS parent,
  trim(regexp_replace(lower(url), '[^A-Za-z0-9]+', '_', 'g'), '_') AS slug, trim(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '_') AS slug_cased, split_part(url, '://', 1) AS scheme FROM pages""")
def path_parts(spark, sf_dir):
    bare = F.regexp_replace("url", "[?#].*$", "")
    scheme = F.get(F.split("url", "://", 2), 0)
    return load(spark, sf_dir, "pages").select("page_id", tx.path_name(bare).alias("name"), F.coalesce(tx.path_parent(bare), F.lit("")).alias("parent"), tx.slug(F.col("url")).alias("slug"), tx.slug(F.col("url"), lower=False).alias("slug_cased"), scheme.alias("scheme"))


# leaf keys of photo names: masks, copies and endings cut, options that hold the label, else a key of its own
@query("""WITH p AS (SELECT doc_id, lang, 'x___' || source || ' ' || doc_id % 3 || CASE WHEN doc_id % 2 = 0 THEN ' copy 2.JPG' ELSE '_final_masked.png' END AS file FROM documents),
  k AS (SELECT doc_id, lang, lower(trim(regexp_replace(split_part(split_part(replace(file, '_final_masked', ''), '___', 2), 'copy', 1), '\\.(jpe?g|png)$', '', 'i'))) AS k FROM p)
  SELECT doc_id, CASE WHEN k = 'src0 1' THEN 'only option' WHEN k = 'src1 1' AND lang = 'en' THEN 'b en' WHEN k = 'src1 1' AND lang = 'de' THEN 'a de' ELSE lang || ':::solo_' || k END AS leaf FROM k""")
def leaf_keys(spark, sf_dir):
    file = F.concat(F.lit("x___"), "source", F.lit(" "), (F.col("doc_id") % 3).cast("string"), F.when(F.col("doc_id") % 2 == 0, " copy 2.JPG").otherwise("_final_masked.png"))
    leaves = spark.createDataFrame([("src0 1", ["only option"]), ("src1 1", ["a de", "b en"])], "key string, options array<string>")
    rows = load(spark, sf_dir, "documents").select("doc_id", "lang", tx.leaf_key(file).alias("key"))
    return rows.join(leaves, "key", "left").select("doc_id", tx.leaf_choice(F.col("lang"), F.col("key"), F.col("options")).alias("leaf"))


# the sum of a vector and its mirror image, of length one
@query("""WITH m AS (SELECT vec_id, list_transform(list_zip(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), lambda z: z[1] + z[2]) AS m FROM embeddings) SELECT vec_id, round(m[1] / sqrt(list_sum(list_transform(m, lambda x: x * x))), 6) AS head FROM m""")
def mirrored_unit(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.withColumn("both", F.zip_with("e", F.reverse("e"), lambda x, y: x + y))
    return rows.select("vec_id", r6(F.get(vx.unit("both"), 0), "head"))


# Softmax of two views, their mean, the first best class, its confidence and title
@query("""WITH l AS (SELECT vec_id, embedding[1:3]::DOUBLE[] AS a, embedding[4:6]::DOUBLE[] AS b FROM embeddings),
  s AS (SELECT vec_id, list_transform(a, lambda x: exp(x) / list_sum(list_transform(a, lambda y: exp(y)))) AS a, list_transform(b, lambda x: exp(x) / list_sum(list_transform(b, lambda y: exp(y)))) AS b FROM l),
  m AS (SELECT vec_id, [round((a[i] + b[i]) / 2, 12) for i in [1, 2, 3]] AS p FROM s)
  SELECT vec_id, list_position(p, list_max(p))::INT AS best, round(list_max(p), 6) AS p, CASE WHEN list_max(p) >= 0.8 THEN 'high' WHEN list_max(p) >= 0.55 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN list_max(p) < 0.4 THEN 'Not sure' WHEN list_position(p, list_max(p)) = 1 THEN 'Looks healthy' ELSE 'disease ' || list_position(p, list_max(p)) END AS title FROM m""")
def mean_views(spark, sf_dir):
    view = lambda at: vx.softmax(F.slice(F.col("embedding").cast("array<double>"), at, 3))
    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.transform(vx.mean_views(view(1), view(4)), lambda x: F.round(x, 12)).alias("ps"))
    rows = rows.select("vec_id", F.array_max("ps").alias("top"), F.array_position("ps", F.array_max("ps")).cast("int").alias("best"))
    disease = F.when(F.col("best") > 1, F.concat(F.lit("disease "), "best"))
    title = F.when(F.col("top") < 0.4, "Not sure").otherwise(F.coalesce(disease, F.lit("Looks healthy")))
    return rows.select("vec_id", "best", r6("top", "p"), vx.confidence(F.col("top")).alias("confidence"), title.alias("title"))


# First rule, any keyword, excluded titles
@query("""SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%econ%' OR lower(p_type) LIKE '%small%' THEN 'cheap' WHEN lower(p_type) LIKE '%promo%' THEN 'offer' ELSE 'other' END AS rule,
  len(list_intersect(list_filter(string_split_regex(lower(p_name), '[^a-z]+'), lambda w: len(w) >= 3 AND w <> 'the'), ['cold', 'gear', 'widget'])) > 0 AS named, regexp_matches(p_name, 'rot\\b|bolt|spot', 'i') AS sick FROM part""")
def title_rules(spark, sf_dir):
    rule = tx.first_rule(F.col("p_type"), [("cheap", ("econ", "small")), ("offer", ("promo",))], "other")
    wanted = F.array(F.lit("cold"), F.lit("gear"), F.lit("widget"))
    return load(spark, sf_dir, "part").select("p_partkey", rule.alias("rule"), F.arrays_overlap(tx.keywords(F.col("p_name"), ("the",)), wanted).alias("named"), F.rlike("p_name", F.lit(r"(?i)rot\b|bolt|spot")).alias("sick"))


# dark and blurry frames
@query("""WITH f AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: 40 + 100 * x) AS g FROM embeddings),
  s AS (SELECT vec_id, list_avg(g) AS mean, list_var_pop(list_transform(list_filter(range(64), lambda i: i % 8 > 0 AND i % 8 < 7 AND i >= 8 AND i < 56), lambda i: 4 * g[i + 1] - g[i] - g[i + 2] - g[i - 7] - g[i + 9])) AS sharp FROM f)
  SELECT vec_id, mean < 35 AS dark, sharp < 3000 AS blurry FROM s""")
def frame_flags(spark, sf_dir):
    found = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("g"))
    found = found.select("vec_id", *(c.alias(n) for n, c in vx.luma_stats(F.col("g"), 8).items()))  # of x; the frame is 40 + 100 x
    return found.select("vec_id", (40 + 100 * F.col("mean") < 35).alias("dark"), (10000 * F.col("sharpness") < 3000).alias("blurry"))


# the shorter side to floor(side / 0.9), then a centred square
@query("""WITH p AS (SELECT p_partkey, p_partkey + 100 AS w, p_size + 100 AS h, floor(224 / 0.9)::INT AS s FROM part), r AS (SELECT *, greatest(s, floor(w * s / least(w, h)))::INT AS rw, greatest(s, floor(h * s / least(w, h)))::INT AS rh FROM p)
  SELECT p_partkey, rw, rh, ((rw - 224) // 2)::INT AS x, ((rh - 224) // 2)::INT AS y FROM r""")
def crop_geometry(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") + 100).alias("w"), (F.col("p_size") + 100).alias("h"))
    return rows.select("p_partkey", *(c.alias(n) for n, c in vx.centre_crop(F.col("w"), F.col("h"), 224).items()))


# Mock probabilities from a digest, the same for the same content
@query("""WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents), w AS (SELECT doc_id, i, 1 + ('0x' || substr(h, 1 + 4 * i, 4))::BIGINT % 97 AS w FROM d, (SELECT unnest([0, 1, 2, 3, 4]) AS i))
  SELECT doc_id, i::INT AS class, round(w / sum(w) OVER (PARTITION BY doc_id), 6) AS p FROM w""")
def mock_distribution(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(vx.mock_weights(F.sha2("text", 256), 5)).alias("class", "w"), vx.mock_weights(F.sha2("text", 256), 5).alias("all"))
    return rows.select("doc_id", "class", r6(F.col("w") / F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + x), "p"))


# Rows as JSON
@query("""SELECT n_nationkey, '{"id":' || n_nationkey || ',"name":"' || n_name || '"}' AS json FROM nation""")
def json_encode(spark, sf_dir):
    return load(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("json"))


# Classes below the minimum go, each source of a class is capped, then the class by fair shares
@query("""WITH d AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('s:' || doc_id), doc_id) AS place FROM documents WHERE lang IN (SELECT lang FROM documents GROUP BY lang HAVING count(*) >= 30)),
  c AS (SELECT * FROM d WHERE place <= 40), s AS (SELECT lang, source, count(*) AS n FROM c GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n, source) AS i, count(*) OVER (PARTITION BY lang) AS m FROM s),
  t AS (WITH RECURSIVE r AS (SELECT lang, source, i, m, least(n, 90 // m) AS take, 90 - least(n, 90 // m) AS lft FROM f WHERE i = 1 UNION ALL SELECT f.lang, f.source, f.i, f.m, least(f.n, r.lft // (f.m - f.i + 1)), r.lft - least(f.n, r.lft // (f.m - f.i + 1)) FROM r JOIN f ON f.lang = r.lang AND f.i = r.i + 1) SELECT * FROM r)
  SELECT doc_id FROM c JOIN t USING (lang, source) WHERE place <= take""")
def capped_classes(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return sampling.capped_classes(rows, "lang", "source", "doc_id", per_source=40, per_class=90, least=30).select("doc_id")


# Draws with replacement by weight
@query("""WITH w AS (SELECT event_id, (value * 100)::BIGINT AS w FROM events), c AS (SELECT event_id, sum(w) OVER (ORDER BY event_id) - w AS lo, sum(w) OVER (ORDER BY event_id) AS hi FROM w WHERE w > 0),
  d AS (SELECT i AS draw, ('0x' || substr(md5('draw:' || i), 1, 12))::BIGINT % (SELECT sum(w) FROM w WHERE w > 0)::BIGINT AS t FROM range(2000) r(i)) SELECT draw, event_id FROM d JOIN c ON t >= lo AND t < hi""")
def drawn_rows(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", F.round(F.col("value") * 100).cast("long").alias("w"))
    return ordered.drawn(rows, "event_id", "w", 2000)


# Checks that must find nothing
@query("""WITH s AS (SELECT text, lang, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, source FROM documents) SELECT (SELECT count(*) FROM (SELECT text FROM s GROUP BY text HAVING count(DISTINCT split) > 1)) AS shared_groups,
  (SELECT count(*) FROM s WHERE source = 'src0' AND split = 'train') AS protected_in_train, (SELECT count(*) FROM (SELECT DISTINCT lang FROM s) a WHERE lang NOT IN (SELECT lang FROM s WHERE split = 'test')) AS missing_classes""")
def sanity_checks(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("text", "lang", "source", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"))
    return evaluate.split_checks(rows, "text", "lang", "split", protected=F.col("source") == "src0")


# A seeded pool of rows of other crops for each crop
@query("SELECT lang, doc_id FROM (SELECT a.lang, d.doc_id, row_number() OVER (PARTITION BY a.lang ORDER BY md5(a.lang || ':' || d.doc_id), d.doc_id) AS place FROM (SELECT DISTINCT lang FROM documents) a JOIN documents d ON d.lang <> a.lang) WHERE place <= 20")
def background_pool(spark, sf_dir):
    return sampling.background_pool(load(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 20)


# Statuses of a pool: protected rows are deduplicated alone, look-alikes of protected rows go, the rest is deduplicated by priority
@query()
def dedup_statuses(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("source", F.element_at(F.array(*map(F.lit, ("protected", "first", "second", "third"))), (F.col("vec_id") % 4 + 1).cast("int")))
    return cluster.dedup_statuses(rows, "vec_id", "label", "source", {"first": 0, "second": 1, "third": 2}, "protected", near=(0.3, 20), leak=(0.4, 17)).groupBy("source", "status").count()


# Dark, ask, mismatch, unsure, sure, in this order; a crop that the user trusts is no mismatch
@query("""WITH f AS (SELECT vec_id, abs(embedding[1]) AS best, abs(embedding[2]) AS share, embedding[3] < -0.15 AS dark, vec_id % 3 = 0 AS chosen, vec_id % 7 = 0 AS trusted, abs(embedding[4]) AS lead FROM embeddings)
  SELECT vec_id, CASE WHEN dark THEN 'dark' WHEN NOT chosen AND lead < 0.05 THEN 'ask' WHEN chosen AND share < 0.05 AND NOT trusted THEN 'mismatch' WHEN best < 0.1 THEN 'unsure' ELSE 'sure' END AS kind FROM f""")
def result_kinds(spark, sf_dir):
    e = lambda i: F.get("embedding", i - 1)
    rows = load(spark, sf_dir, "embeddings").withColumn("chosen", F.col("vec_id") % 3 == 0).withColumn("trusted", F.col("vec_id") % 7 == 0)
    mismatch = F.col("chosen") & (F.abs(e(2)) < 0.05) & ~F.col("trusted")
    return rows.select("vec_id", advice.result_kind(dark=e(3) < -0.15, ambiguous=~F.col("chosen") & (F.abs(e(4)) < 0.05), mismatch=mismatch, best=F.abs(e(1)), unsure=0.1).alias("kind"))


# The ordered steps of a result, the first two without safety and expert steps where spoken by itself
@query("""WITH s(grp, i, step, tpl) AS (VALUES (0, 0, 'safety', 'wear gloves'), (0, 1, 'prune', 'prune in {days} days'), (0, 2, 'spray', 'spray {chem}'), (0, 3, 'expert', 'ask'), (1, 0, 'water', 'water less'), (1, 1, 'safety', 'wash'), (1, 2, 'wait', 'wait {days} days')),
  r AS (SELECT n_nationkey, n_regionkey % 2 AS grp, n_nationkey % 3 = 0 AS spoken FROM nation), j AS (SELECT n_nationkey, spoken, i, step, replace(replace(tpl, '{days}', '7'), '{chem}', 'copper') AS text, row_number() OVER (PARTITION BY n_nationkey ORDER BY i) AS k FROM r JOIN s USING (grp) WHERE NOT (spoken AND step IN ('safety', 'expert')))
  SELECT n_nationkey, (k - 1)::INT AS place, text FROM j WHERE NOT spoken OR k <= 2""")
def advice_steps(spark, sf_dir):
    steps = spark.createDataFrame(advice.STEPS, "grp int, steps array<struct<step:string,template:string>>")
    results = load(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_regionkey") % 2).alias("grp"), (F.col("n_nationkey") % 3 == 0).alias("spoken"))
    return advice.steps(results, steps, "grp", "spoken", {"days": "7", "chem": "copper"}).select("n_nationkey", "place", "text")


# Of several searches the first that finds something; titles must name a keyword, sick ones go, equal titles count once, eight at most
@query("""WITH q(subject, turn, word) AS (VALUES ('a', 1, 'nothing'), ('a', 2, 'cold'), ('b', 1, 'gear'), ('b', 2, 'cold'), ('c', 1, 'zzz')),
  h AS (SELECT subject, turn, p_name AS title, min(p_partkey) AS pos FROM q JOIN part ON position(word IN lower(p_name)) > 0 WHERE NOT regexp_matches(p_name, 'rot\\b|bolt', 'i') GROUP BY ALL),
  f AS (SELECT * FROM h WHERE turn = (SELECT min(turn) FROM h o WHERE o.subject = h.subject)) SELECT subject, title, place FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY pos) AS place FROM f) WHERE place <= 8""")
def chosen_candidates(spark, sf_dir):
    searches = spark.createDataFrame([("a", 1, "nothing"), ("a", 2, "cold"), ("b", 1, "gear"), ("b", 2, "cold"), ("c", 1, "zzz")], "subject string, turn int, word string")
    return advice.candidates(searches, load(spark, sf_dir, "part").select(F.col("p_partkey").alias("at"), F.col("p_name").alias("title")), r"(?i)rot\b|bolt", 8)


# Only sure results are saved, the newest twenty of an owner
@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE value >= 28 AND value / 100 >= 0.55) WHERE k <= 20")
def saved_history(spark, sf_dir):
    sure = load(spark, sf_dir, "events").where(advice.result_kind(F.lit(False), F.lit(False), F.lit(False), F.col("value") / 100, 0.55) == "sure")
    return evaluate.first_by(sure, ["user_id"], [F.desc("event_id")], 20).select("user_id", "event_id")


# Group and reason of a term: healthy, crop-specific, explicit, rule, default
GROUP_SQL = """g AS (SELECT DISTINCT p_brand AS crop, p_type AS term FROM part), r AS (SELECT crop, term, CASE WHEN term = 'STANDARD' THEN 'healthy' WHEN crop = 'Brand#11' AND term = 'SMALL' THEN 'algal' WHEN term = 'PROMO' THEN 'rust' WHEN lower(term) LIKE '%econ%' OR lower(term) LIKE '%med%' THEN 'virus' ELSE 'fungal_spot' END AS grp,
  CASE WHEN term = 'STANDARD' THEN 'explicit' WHEN crop = 'Brand#11' AND term = 'SMALL' THEN 'crop-specific' WHEN term = 'PROMO' THEN 'explicit' WHEN lower(term) LIKE '%econ%' OR lower(term) LIKE '%med%' THEN 'rule' ELSE 'default' END AS reason FROM g)"""


def groups(spark, sf_dir) -> DataFrame:
    terms = load(spark, sf_dir, "part").select(F.col("p_brand").alias("crop"), F.col("p_type").alias("term")).distinct()
    own = spark.createDataFrame([("Brand#11", "SMALL", "algal")], "crop string, term string, own string")
    explicit = spark.createDataFrame([("PROMO", "rust")], "term string, explicit string")
    return advice.groups(terms, own, explicit, "STANDARD", [("virus", ("econ", "med"))])


@query(f"WITH {GROUP_SQL} SELECT crop, term, grp, reason FROM r")
def advice_groups(spark, sf_dir):
    return groups(spark, sf_dir)


# Which classes each group and reason holds
@query(f"WITH {GROUP_SQL} SELECT grp, reason, string_agg(DISTINCT term, ',' ORDER BY term) AS terms, count(*) AS n FROM r GROUP BY grp, reason")
def provenance(spark, sf_dir):
    return groups(spark, sf_dir).groupBy("grp", "reason").agg(F.array_join(F.sort_array(F.collect_set("term")), ",").alias("terms"), F.count(F.lit(1)).alias("n"))


# Maps of terms, the last crop wins, and of crop-specific terms
@query(f"WITH {GROUP_SQL} SELECT crop || '::' || term AS k, grp FROM r WHERE reason = 'crop-specific' UNION ALL SELECT term, arg_max(grp, crop) FROM r WHERE reason <> 'crop-specific' GROUP BY term")
def term_maps(spark, sf_dir):
    return advice.term_maps(groups(spark, sf_dir))


# Checks of templates, languages, causes, products and spoken digits
@query("""SELECT 'digits' AS problem, count(*) AS n FROM nation WHERE regexp_matches(n_name, '[0-9]') UNION ALL SELECT 'languages', count(*) FROM (SELECT source FROM documents GROUP BY source HAVING count(DISTINCT lang) <> 4)
  UNION ALL SELECT 'causes', count(*) FROM nation WHERE n_regionkey NOT IN (0, 1, 2, 3) UNION ALL SELECT 'products', count(*) FROM (SELECT DISTINCT p_brand FROM part) WHERE p_brand NOT IN ('Brand#11', 'Brand#12')""")
def completeness_full(spark, sf_dir):
    nation, docs = load(spark, sf_dir, "nation"), load(spark, sf_dir, "documents")
    causes = spark.createDataFrame([(k,) for k in range(4)], "n_regionkey int")
    products = spark.createDataFrame([("Brand#11", "ek"), ("Brand#12", "do")], "p_brand string, spoken string")
    digits = nation.where(F.rlike("n_name", F.lit("[0-9]")))
    languages = docs.groupBy("source").agg(F.countDistinct("lang").alias("n")).where("n <> 4")
    found = [("digits", digits), ("languages", languages), ("causes", nation.join(causes, "n_regionkey", "left_anti")), ("products", load(spark, sf_dir, "part").select("p_brand").distinct().join(products, "p_brand", "left_anti"))]
    return advice.problems(found)


# Every phrase of a language by kind and id, in English where it has none
@query("""WITH l(lang) AS (VALUES ('en'), ('hi')), n AS (SELECT lang, 'crop:' || n_nationkey AS k, CASE WHEN lang = 'hi' AND n_nationkey % 2 = 0 THEN 'hi ' || n_name ELSE n_name END AS text FROM nation, l),
  r AS (SELECT lang, 'cause:' || r_regionkey, r_name FROM region, l), s AS (SELECT lang, 'term:' || p_type, lower(p_type) FROM (SELECT DISTINCT p_type FROM part), l), u AS (SELECT lang, 'ui:' || c_mktsegment, c_mktsegment FROM (SELECT DISTINCT c_mktsegment FROM customer), l),
  t AS (SELECT lang, 'step:' || o_orderpriority, replace('do {x}', '{x}', o_orderpriority) FROM (SELECT DISTINCT o_orderpriority FROM orders), l) SELECT * FROM n UNION ALL SELECT * FROM r UNION ALL SELECT * FROM s UNION ALL SELECT * FROM u UNION ALL SELECT * FROM t""")
def phrase_inventory(spark, sf_dir):
    nation = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("en"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("hi "), "n_name")).alias("hi"))
    plain = lambda t, c, text=None: load(spark, sf_dir, t).select(F.col(c).cast("string").alias("id"), (text if text is not None else F.col(c)).alias("en")).distinct().withColumn("hi", F.lit(None).cast("string"))
    kinds = {"crop": nation, "cause": plain("region", "r_regionkey", F.col("r_name")), "term": plain("part", "p_type", F.lower("p_type")), "ui": plain("customer", "c_mktsegment"), "step": plain("orders", "o_orderpriority", tx.fill(F.lit("do {x}"), F.create_map(F.lit("x"), F.col("o_orderpriority"))))}
    return advice.inventory(kinds, ["en", "hi"])


# advice from weather, and the score 0.4 W + 0.3 I + 0.3 H with its bands
@query("""WITH w AS (SELECT event_id, value AS rain, value / 8 AS heat, user_id % 40 AS wind, user_id % 2 = 0 AS wet FROM events)
  SELECT event_id, concat_ws('; ', CASE WHEN rain >= 60 THEN 'delay irrigation' END, CASE WHEN heat >= 35 AND rain < 60 THEN 'heat stress' END, CASE WHEN wind >= 20 THEN 'avoid spraying' END, CASE WHEN wet AND rain >= 60 THEN 'raise the alert' END) AS advice FROM w""")
def weather_advice(spark, sf_dir):
    rows = load(spark, sf_dir, "events")
    return rows.select("event_id", advice.weather(rain=F.col("value"), heat=F.col("value") / 8, wind=F.col("user_id") % 40, fungal=F.col("user_id") % 2 == 0).alias("advice"))


@query("""WITH s AS (SELECT event_id, round(0.4 * 100 * least(1.0, 50 / greatest(value, 1.0)) + 0.3 * (100 - user_id % 50) + 0.3 * CASE WHEN event_type = 'view' THEN 100 ELSE 100 * (1 - least(value / 100, 1.0)) END, 6) AS score FROM events)
  SELECT event_id, score, CASE WHEN score >= 80 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'needs action' END AS band FROM s""")
def sustainability(spark, sf_dir):
    health = F.when(F.col("event_type") == "view", F.lit(100.0)).otherwise(100 * (1 - F.least(F.col("value") / 100, F.lit(1.0))))
    rows = load(spark, sf_dir, "events").select("event_id", F.round(advice.score(need=F.lit(50.0), applied=F.greatest("value", F.lit(1.0)), inputs=100 - F.col("user_id") % 50, health=health), 6).alias("score"))
    return rows.withColumn("band", advice.band(F.col("score")))
