"""Operators against plain loops, invariants, and every query against its SQL at a small scale."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from curata.functions import text as tx
from curata.operators import cluster, evaluate, sampling
from curata.queries import ORACLE_SQL, QUERIES
from curata.sources import archives, tables
from curata.streaming import votes

SF = "/root/testdata/sf0.001"


def _links(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long")


def test_greedy_dedup_is_not_transitive(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (9, None)], "id long, label string")
    found = dict(cluster.greedy_dedup(rows, _links(spark, [(1, 2), (2, 3)])).collect())
    assert found == {1: cluster.KEPT, 2: cluster.DUPLICATE, 3: cluster.KEPT, 9: cluster.KEPT}


def test_conflicts_differ_between_scans(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "id long, label string")
    links = _links(spark, [(1, 2), (2, 3)])
    assert dict(cluster.greedy_dedup(rows, links).collect()) == {1: 3, 2: 3, 3: 1}
    assert dict(cluster.merge_copies(rows, links).collect()) == {1: True, 2: True, 3: True}


def test_null_labels_are_equal(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "x")], "id long, label string")
    assert dict(cluster.greedy_dedup(rows, _links(spark, [(1, 2)])).collect()) == {1: 1, 2: 2, 3: 1}


def test_cluster_cap_blocks_a_chain(spark):
    rows = spark.createDataFrame([(i, "x") for i in range(70)], "id long, label string")
    found = cluster.capped_clusters(rows, _links(spark, [(i, i + 1) for i in range(69)]), 64).toPandas()
    assert found.groupby("cluster").size().max() == 64 and found["blocked"].sum() == 1


def test_fair_shares(spark):
    sizes = spark.createDataFrame([("k", "a", 5), ("k", "b", 50), ("k", "c", 5000)], "key string, source string, n long")
    assert {r.source: r["take"] for r in sampling.fair_shares(sizes, "key", "source", 300).collect()} == {"a": 5, "b": 50, "c": 245}


def test_seeded_sample_equals_the_generator(spark):
    import hashlib
    import random

    sizes = {f"key {k} é": 1 + (k * 7) % 23 for k in range(1000)} | {"hot": 3000}
    rows = spark.createDataFrame([(k, 10_000 * n + i) for n, (k, size) in enumerate(sizes.items()) for i in range(size)], "k string, id long").repartition(5)
    got = {}
    for r in sampling.seeded_sample(rows, "k", "id", 9).orderBy("k", "drawn").collect():
        got.setdefault(r.k, []).append(r.id)
    for n, (k, size) in enumerate(sizes.items()):
        ids = [10_000 * n + i for i in range(size)]
        assert got[k] == (ids if size <= 9 else random.Random(int(hashlib.md5(k.encode()).hexdigest()[:12], 16)).sample(ids, 9))
    odd = spark.createDataFrame([(None, 1), ("", None), ("x", 2)], "k string, id long")
    assert sampling.seeded_sample(odd, "k", "id", 1).count() == 2 and sampling.seeded_sample(odd.limit(0), "k", "id", 1).count() == 0


def test_group_split_keeps_groups_and_breaks_ties_low(spark):
    rows = spark.createDataFrame([("g", "val"), ("g", "train"), ("g", None), ("h", None)], "g string, official string")
    found = sampling.group_split(rows, "g", "official").collect()
    assert {r.split for r in found if r.g == "g"} == {"train"} and len(found) == 4


def test_weights_sum_to_one_per_class(spark):
    rows = spark.createDataFrame([("a", True), ("a", False), ("b", False)], "label string, field boolean")
    sums = sampling.boosted_weights(rows, "label", "field").groupBy("label").agg(F.sum("weight").alias("s")).collect()
    assert all(math.isclose(r.s, 1) for r in sums)


def test_macro_f1_ignores_predicted_only_classes(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "z"), ("b", "b")], "t string, p string").withColumn("all", F.lit(True))
    found = evaluate.summary(rows, "t", "p", ["all"]).first()
    assert math.isclose(found.macro_f1, (2 / 3 + 1) / 2) and math.isclose(found.accuracy, 2 / 3)


def test_text_functions(spark):
    import hashlib

    row = spark.createDataFrame([("Apple___Black rot (old) copy 2.JPG",)], "x string").select(tx.norm("x").alias("a"), tx.norm_tight("x").alias("b"), tx.slug(F.col("x")).alias("c"), tx.stable_bucket(F.col("x"), 5).alias("d"), tx.leaf_choice(F.lit("u"), tx.leaf_key(F.col("x")), F.array(F.lit("u black rot (old)"), F.lit("v"))).alias("e")).first()
    assert row.a == "apple black rot old copy 2 jpg" and row.b == "appleblackrotoldcopy2jpg" and row.c == "apple_black_rot_old_copy_2_jpg"
    assert row.d == int(hashlib.md5(b"Apple___Black rot (old) copy 2.JPG").hexdigest(), 16) % 5 and row.e == "u black rot (old)"


def test_sources(spark, tmp_path):
    import zipfile

    (tmp_path / "d" / "rust").mkdir(parents=True)
    (tmp_path / "d" / "rust" / "b.PNG").write_bytes(b"1")
    (tmp_path / "d" / "rust" / "b.txt").write_bytes(b"1")
    assert [(r.label, r.file) for r in tables.image_files(spark, str(tmp_path / "d")).select("label", "file").collect()] == [("rust", "b.PNG")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("rust/a.jpg", b"xy")
        z.writestr("readme.md", b"no")
    assert [(r.member, bytes(r.payload)) for r in tables.zip_members(spark, str(tmp_path / "z.zip")).collect()] == [("rust/a.jpg", b"xy")]
    (tmp_path / "split.txt").write_text("x/rust/a.jpg\n\n")
    assert [tuple(r) for r in tables.read_split_list(spark, str(tmp_path / "split.txt")).collect()] == [("rust", "a.jpg")]


def _key(value):
    if value is None or str(value) in ("nan", "<NA>", "NaT", "None"):
        return "null"
    kind = type(value).__name__
    return f"{float(value):.5g}" if "float" in kind or "Decimal" in kind else str(int(value)) if "int" in kind else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, name):
    found = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE_SQL:
        assert len(found)
        return
    c = duckdb.connect()
    for t in tables.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wanted = c.sql(ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    order = sorted(found.columns)
    rows = lambda df: sorted(tuple(map(_key, r)) for r in df[order].itertuples(index=False))
    assert rows(found) == rows(wanted)


def test_order_dependent_scans_equal_plain_loops(spark):
    import random

    random.seed(3)
    n, most = 60, 8
    label = [random.choice("xxxy") for _ in range(n)]
    pairs = sorted({tuple(sorted(random.sample(range(n), 2))) for _ in range(70)})
    near = {i: sorted({b if a == i else a for a, b in pairs if i in (a, b)}) for i in range(n)}
    status, gone, home, blocked = {}, set(), {i: {i} for i in range(n)}, dict.fromkeys(range(n), 0)
    for i in range(n):
        if i not in status:
            taken = [j for j in near[i] if j not in status]
            clash = any(label[j] != label[i] for j in taken)
            status.update({j: cluster.CONFLICT if clash else cluster.DUPLICATE for j in taken} | {i: cluster.CONFLICT if clash else cluster.KEPT})
    for a, b in pairs:
        if label[a] != label[b]:
            gone |= {a, b}
        elif a not in gone:
            gone.add(b)
        if home[a] is not home[b]:
            if len(home[a]) + len(home[b]) > most:
                blocked[a] += 1
            else:
                both = home[a] | home[b]
                home.update(dict.fromkeys(both, both))
    rows, links = spark.createDataFrame(list(enumerate(label)), "id long, label string"), _links(spark, [*pairs, pairs[0][::-1], (5, 5), (4, 999)])
    for gather in (1000, 45, 7):  # in packed components, in rounds, in slices
        assert dict(cluster.greedy_dedup(rows, links, gather).collect()) == status
        assert {r.id for r in cluster.merge_copies(rows, links, gather).collect() if r.dropped} == gone
        assert {r.id: (r.cluster, r.blocked) for r in cluster.capped_clusters(rows, links, most, gather).collect()} == {i: (min(home[i]), blocked[i]) for i in range(n)}
    assert cluster.greedy_dedup(rows.limit(0), links).count() == 0


def test_components_are_packed_into_tasks_and_long_chains_end(spark):
    n = 400  # a chain in id order, far longer than the bound, beside many small components
    pairs = [(i, i + 1) for i in range(n - 1)] + [(1000 + 3 * k, 1000 + 3 * k + j) for k in range(60) for j in (1, 2)]
    ids = [*range(n), *range(1000, 1180)]
    rows, links = spark.createDataFrame([(i, "x") for i in ids], "id long, label string"), _links(spark, pairs)
    arcs = links.select("a", "b")
    assert {r.node: r.component for r in cluster.components(arcs.repartition(5)).collect()} == {**dict.fromkeys(range(n), 0), **{i: 1000 + (i - 1000) // 3 * 3 for i in ids[n:]}}
    small, large = cluster._packed(arcs, 50)
    assert large.count() == n - 1 and small.select("bucket").distinct().count() > 2 and small.rdd.getNumPartitions() > 2
    status = dict(cluster.greedy_dedup(rows, links, 50).collect())
    assert status == {i: cluster.KEPT if (i < n and i % 2 == 0) or (i >= 1000 and (i - 1000) % 3 == 0) else cluster.DUPLICATE for i in ids}
    found = {r.id: (r.cluster, r.blocked) for r in cluster.capped_clusters(rows, links, 64, 50).collect()}
    assert all(found[i][0] == i // 64 * 64 for i in range(n)) and sum(b for _, b in found.values()) == (n - 1) // 64


def test_dedup_statuses_of_a_small_pool(spark):
    e = [[1.0, 0.0], [0.0, 1.0], [0.6, 0.8], [-1.0, 0.0]]
    pool = [(0, "x", "safe", 0), (1, "x", "safe", 0), (2, "x", "low", 0), (3, "x", "low", 1), (4, "x", "high", 1), (5, "y", "low", 3), (6, "x", "high", 3)]
    rows = spark.createDataFrame([(k, lab, s, e[v], (1 << 50) * v) for k, lab, s, v in pool], "id long, label string, source string, unit array<double>, bits long")
    got = {r.id: r.status for r in cluster.dedup_statuses(rows, "id", "label", "source", {"high": 0, "low": 1}, "safe", near=(0.99, -1), leak=(0.99, -1)).collect()}
    assert got == {0: "kept", 1: "duplicate", 2: "lookalike", 3: "duplicate", 4: "kept", 5: "label_conflict", 6: "label_conflict"}


def test_banded_pairs_equal_all_pairs(spark):
    import random

    from curata.operators import neardup

    random.seed(1)
    words = [random.getrandbits(64) for _ in range(20)]
    words += [w ^ sum(1 << p for p in random.sample(range(64), k)) for w in words for k in (0, 1, 3, 5, 9)]
    rows = spark.createDataFrame([(i, w - (1 << 64) if w >> 63 else w) for i, w in enumerate(words)], "id long, bits long")
    for distance in (0, 3, 9):
        wanted = {(i, j) for j in range(len(words)) for i in range(j) if (words[i] ^ words[j]).bit_count() <= distance}
        assert {(r.a, r.b) for r in neardup.banded_pairs(rows, "id", distance).collect()} == wanted


def test_files_in_and_out(spark, tmp_path):
    import zipfile

    from pyspark.sql import types as T

    base = tmp_path / "d"
    for at in ("one/train/rust", "one/train/ok", "two"):
        (base / at).mkdir(parents=True)
    (base / "one/train/rust/a.jpg").write_bytes(b"1")
    names = lambda found: [x.split("/d/")[1] for x in found]
    assert names(tables.walk_dirs(spark, str(base), 1)) == ["one", "two"] and names(tables.walk_dirs(spark, str(base), 9)) == ["one", "two", "one/train", "one/train/ok", "one/train/rust"]
    assert names([tables.find_dir(spark, str(base), lambda c: "rust" in c)]) == ["one/train"] and tables.find_dir(spark, str(base), lambda c: "no" in c) is None
    assert [tables.choose_config(x) for x in (["b_augmented", "default", "raw"], ["x_augmented", "default"], ["augmented", "y"], [])] == ["raw", "default", "y", None]
    assert [tuple(r) for r in tables.file_cursor(spark, str(base / "one/train/rust/a.jpg")).collect()] == [("a.jpg", 1)] and tables.file_cursor(spark, str(base / "none")).count() == 0
    files = spark.createDataFrame([("en", "b.jpg", b"22"), ("en", "a.jpg", b"1"), ("de", "c.jpg", b"3")], "role string, file string, payload binary")
    archives.write_zips(files, str(tmp_path / "zips"), "role")
    got = {(p.name.split("-")[1], name): z.read(name) for p in (tmp_path / "zips").iterdir() for z in [zipfile.ZipFile(p)] for name in z.namelist()}
    assert got == {("en", "a.jpg"): b"1", ("en", "b.jpg"): b"22", ("de", "c.jpg"): b"3"}
    rows = spark.createDataFrame([("x", "NA"), ("", None)], "a string, b string")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in "ab"])
    tables.write_csv(rows, str(tmp_path / "csv"))
    assert {tuple(r) for r in tables.read_csv(spark, str(tmp_path / "csv"), schema, keep_empty=True).collect()} == {("x", "NA"), ("", "")}
    tables.write_json(rows, str(tmp_path / "json"))
    assert spark.read.schema(schema).json(str(tmp_path / "json")).count() == 2
    (tmp_path / "one.json").write_text('{"a": "é",\n "z": 1}')
    assert [tuple(r) for r in tables.read_json(spark, str(tmp_path / "one.json"), schema).collect()] == [("é", None)]
    tables.write_partitioned(rows, str(tmp_path / "parts"), "a")
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 2
    assert tables.card(rows.where("a = 'x'"), "t") == "# t\n\n| a | b |\n|-|-|\n| x | NA |"


def test_split_labels_and_capped_weights(spark):
    row = spark.createDataFrame([("a::b::c", "x/y/z.tar.gz")], "l string, p string").select(*tx.split_label(F.col("l")), tx.stem(F.col("p"))).first()
    assert tuple(row) == ("a", "b::c", "z.tar")
    rows = spark.createDataFrame([("a",)] * 100 + [("b",)] * 2, "label string")
    weights = {r.label: r.weight for r in sampling.capped_weights(rows, "label", 100).distinct().collect()}
    assert weights == {"a": 0.5, "b": 4.0}


def test_stream_drops_repeated_sends(spark, tmp_path):
    spark.createDataFrame([("k", 1), ("k", 2), ("m", 3)], "client_id string, s long").selectExpr("client_id", "timestamp_seconds(s) AS ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = votes.deduplicated(spark.readStream.schema("client_id string, ts timestamp").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("sends_out").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.client_id for r in spark.table("sends_out").collect()) == ["k", "m"]


def test_equal_totals_go_by_name_in_any_order_of_rows(spark):
    from curata.plans import extended

    # 0.1 + 0.2 + 0.3 and 0.6 are equal totals; as doubles 0.1 + 0.2 is more than 0.3 and 0.6 is less than 0.1 + 0.2 + 0.3
    values = [(1, "a", 0.6), (1, "b", 0.1), (1, "b", 0.2), (1, "b", 0.3), (2, "a", float("inf")), (2, "b", 1e30), (2, "c", None), (2, "d", 2.5)]
    for rows in (values, values[::-1]):
        got = extended.totals_in_order(spark.createDataFrame(rows, "user_id long, event_type string, value double").coalesce(1)).collect()
        assert {(r.user_id, r.event_type): r.place for r in got} == {(1, "a"): 1, (1, "b"): 2, (2, "a"): 1, (2, "b"): 2, (2, "d"): 3, (2, "c"): 4}


def test_long_texts_are_ranked_without_whole_texts_at_the_driver(spark):
    from curata.operators import ordered

    texts = ["a" * k for k in (0, 1, 255, 256, 257, 300)] + ["a" * 256 + c for c in "\n z\u00e9\U0001f600\uffff"] + [c * 3 for c in "Bb\u00e9\U0001f600\uffff"] + [f"{k % 7}{'x' * 400}{k}" for k in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    got = {r.text: r.place for r in ordered.ranked(rows, ["text"], long="text").collect()}
    assert got == {t: i for i, t in enumerate(sorted(texts, key=lambda t: t.encode()), 1)}
    plan = ordered._sorted(rows, ["text"], "text")._jdf.queryExecution().toString()
    assert "rangepartitioning(_range" in plan and "rangepartitioning(text" not in plan


def test_links_are_shuffled_once_to_be_distinct_and_joined(spark):
    links = _links(spark, [(1, 2), (2, 1), (2, 3), (3, 3), (None, 1)])
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id long, label string")
    found = cluster._arcs(rows, links)
    assert {tuple(r) for r in found.select("a", "b", "la", "lb").collect()} == {(1, 2, "x", "y"), (2, 3, "y", None)}
    distinct = cluster._pairs(links).join(rows.withColumnRenamed("id", "a").hint("merge"), "a")
    assert distinct._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(a#") == 2
