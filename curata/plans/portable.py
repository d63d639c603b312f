"""Queries that one SQL text expresses for Spark and for the oracle: counts, windows, top-k, sets, lookups and rules.

"""

from __future__ import annotations

SQL: dict[str, str] = {
    # Counts by one to three keys
    "count_by_keys": "SELECT lang, source, count(*) AS n FROM documents WHERE lang IN ('en', 'de') GROUP BY lang, source",
    # A2 P10: crosstab over the full domain, zero-filled
    "crosstab_zero_fill": """SELECT l.lang, s.source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (SELECT DISTINCT source FROM documents) s
      LEFT JOIN (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source) c ON c.lang = l.lang AND c.source = s.source""",
    # A4 A5: most frequent value, ties to the smaller one
    "majority_label": """SELECT user_id, event_type AS majority, n FROM (SELECT user_id, event_type, count(*) AS n,
      row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS place FROM events GROUP BY user_id, event_type) x WHERE place = 1""",
    # Largest number of splits in a group, which must be 1
    "splits_per_group": """SELECT max(n) AS most FROM (SELECT o_custkey, count(DISTINCT CASE WHEN o_custkey % 5 = 0 THEN 'val' ELSE 'train' END) AS n FROM orders GROUP BY o_custkey) x""",
    # A7 A26
    "distinct_counts": "SELECT lang, count(DISTINCT text) AS texts, count(DISTINCT source) AS sources FROM documents GROUP BY lang",
    # Mean of a flag, top 15
    "flag_share_top": """SELECT source, round(avg(CAST(CASE WHEN quality = 1 THEN 1 ELSE 0 END AS DOUBLE)), 6) AS share, count(*) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id
      GROUP BY source ORDER BY share DESC, source LIMIT 15""",
    # Counts per class, thin classes, kind of coverage
    "thin_classes": """SELECT lang, min(n) AS least, min(n) < 100 AS thin, CASE WHEN max(good) = 1 AND min(good) = 0 THEN 'full' WHEN max(good) = 1 THEN 'healthy_only' ELSE 'diseases_only' END AS coverage
      FROM (SELECT lang, quality, count(*) AS n, quality AS good FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang, quality) x GROUP BY lang""",
    # Agreement of two models, with its gate
    "agreement_gate": "SELECT round(avg(CAST(CASE WHEN quality = 1 - toxic THEN 1 ELSE 0 END AS DOUBLE)), 6) AS agreement, avg(CAST(CASE WHEN quality = 1 - toxic THEN 1 ELSE 0 END AS DOUBLE)) >= 0.99 AS passes FROM labels",
    # Weighted mean of losses
    "weighted_loss": "SELECT event_type, round(sum(value * user_id) / sum(user_id), 6) AS loss FROM events GROUP BY event_type",
    # Best so far, the first of equals wins
    "best_checkpoint": """SELECT user_id, event_id, best FROM (SELECT user_id, event_id, value AS best, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events) x WHERE place = 1""",
    "rolling_best": "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM events",
    # Early stop at the first step, from the third on, that reaches the bound
    "early_stop": """SELECT e.user_id, count(*) AS steps FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events) e
      LEFT JOIN (SELECT user_id, min(step) AS stop FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events) y WHERE step >= 3 AND value >= 150 GROUP BY user_id) s
      ON s.user_id = e.user_id WHERE step <= coalesce(stop, step) GROUP BY e.user_id""",
    # A seeded sample of wrong rows
    "mistakes_sample": "SELECT doc_id FROM labels WHERE quality = toxic ORDER BY md5(concat('7:', CAST(doc_id AS VARCHAR(20)))), doc_id LIMIT 16",
    # Label mapping with unmatched rows kept and counted
    "mapping_unmatched": """SELECT d.source, count(*) AS n, count(m.canonical) AS mapped, count(*) - count(m.canonical) AS unmapped FROM documents d
      LEFT JOIN (SELECT 'en' AS raw, 'English' AS canonical UNION ALL SELECT 'de', 'German') m ON m.raw = lower(d.lang) GROUP BY d.source""",
    # Inner lookup and left lookup with counted misses
    "lookup_missing": "SELECT lang, count(*) AS n, sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END) AS missing FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang",
    # Official split lists, train first, then test, else null
    "official_split": """SELECT d.doc_id, coalesce(CASE WHEN a.doc_id IS NOT NULL THEN 'train' END, CASE WHEN b.doc_id IS NOT NULL THEN 'test' END) AS split FROM documents d
      LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) a ON a.doc_id = d.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) b ON b.doc_id = d.doc_id""",
    # A group's aggregate on each of its rows
    "group_back": """SELECT o_orderkey, m.top_status FROM orders o JOIN (SELECT o_custkey, min(o_orderstatus) AS top_status FROM orders GROUP BY o_custkey) m ON m.o_custkey = o.o_custkey""",
    # Key join for what was joined by position
    "late_payload": "SELECT d.doc_id, length(d.text) AS n FROM documents d JOIN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 1) c ON c.doc_id = d.doc_id",
    # Set algebra
    "set_intersection": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'",
    "set_difference": "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'",
    "set_union": "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer",
    "subset_test": "SELECT count(*) = 0 AS is_subset FROM (SELECT DISTINCT o_custkey FROM orders) o LEFT JOIN customer c ON c.c_custkey = o.o_custkey WHERE c.c_custkey IS NULL",
    # U1
    "union_all": "SELECT kind, count(*) AS n FROM (SELECT 'doc' AS kind, doc_id AS id FROM documents UNION ALL SELECT 'page', page_id FROM pages UNION ALL SELECT 'item', item_id FROM benchmark) x GROUP BY kind",
    # Specific, then general, then default
    "cascade_lookup": """SELECT n.n_name, coalesce(s.cause, g.cause, 'unknown') AS cause FROM nation n LEFT JOIN (SELECT 3 AS k, 'frost' AS cause UNION ALL SELECT 7, 'drought') s ON s.k = n.n_nationkey
      LEFT JOIN (SELECT 1 AS r, 'fungus' AS cause UNION ALL SELECT 2, 'pest') g ON g.r = n.n_regionkey""",
    # Language, then English, then the id as a name
    "translation_lookup": """SELECT r.r_regionkey, coalesce(t.text, e.text, r.r_name) AS shown FROM region r LEFT JOIN (SELECT 0 AS k, 'Afrika' AS text UNION ALL SELECT 3, 'Europa') t ON t.k = r.r_regionkey
      LEFT JOIN (SELECT 0 AS k, 'Africa' AS text UNION ALL SELECT 1, 'America') e ON e.k = r.r_regionkey""",
    # Reuse by text, new work, and orphans
    "clip_reuse": """SELECT d.doc_id, o.clip, o.clip IS NULL AS fresh FROM documents d LEFT JOIN (SELECT text, min(doc_id) AS clip FROM documents WHERE doc_id % 2 = 0 GROUP BY text) o ON o.text = d.text WHERE d.doc_id % 2 = 1""",
    "orphans": "SELECT l.doc_id FROM labels l LEFT JOIN (SELECT doc_id FROM documents WHERE lang = 'en') d ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL",
    # Group size on each row; rare classes go
    "rare_class_drop": "SELECT p_partkey, p_brand, n FROM (SELECT p_partkey, p_brand, count(*) OVER (PARTITION BY p_brand, p_size) AS n FROM part) x WHERE n >= 3",
    # One row per (cluster, label)
    "first_of_group": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS place FROM documents) x WHERE place = 1",
    # File numbering
    "file_numbers": "SELECT doc_id, concat(lang, '_', lpad(CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS VARCHAR(10)), 6, '0')) AS file FROM documents",
    # Votes and mean of the last five
    "last_five_votes": """SELECT event_id, v1 + v2 + v3 + v4 + 1 AS votes, round((p + v1 * p1 + v2 * p2 + v3 * p3 + v4 * p4) / (v1 + v2 + v3 + v4 + 1), 6) AS mean FROM (SELECT event_id, p, coalesce(p1, 0) AS p1, coalesce(p2, 0) AS p2, coalesce(p3, 0) AS p3, coalesce(p4, 0) AS p4,
      CASE WHEN t1 = t THEN 1 ELSE 0 END AS v1, CASE WHEN t2 = t THEN 1 ELSE 0 END AS v2, CASE WHEN t3 = t THEN 1 ELSE 0 END AS v3, CASE WHEN t4 = t THEN 1 ELSE 0 END AS v4 FROM (SELECT event_id, event_type AS t, least(value / 100, 1.0) AS p,
      lag(event_type, 1) OVER w AS t1, lag(event_type, 2) OVER w AS t2, lag(event_type, 3) OVER w AS t3, lag(event_type, 4) OVER w AS t4,
      lag(least(value / 100, 1.0), 1) OVER w AS p1, lag(least(value / 100, 1.0), 2) OVER w AS p2, lag(least(value / 100, 1.0), 3) OVER w AS p3, lag(least(value / 100, 1.0), 4) OVER w AS p4 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) x) y""",
    # Consecutive unsure rows, reset by a sure one
    "unsure_streak": """SELECT event_id, CASE WHEN low = 1 THEN row_number() OVER (PARTITION BY user_id, island, low ORDER BY event_id) ELSE 0 END AS streak FROM (
      SELECT event_id, user_id, low, sum(1 - low) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (
      SELECT event_id, user_id, CASE WHEN value < 35 THEN 1 ELSE 0 END AS low FROM events) x) y""",
    # Difference to the previous frame, calm frames
    "frame_change": """SELECT event_id, round(abs(value - before), 6) AS diff, abs(value - before) < 5 AS calm FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) x""",
    # A change against the row before
    "announce_changes": """SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events WHERE value >= 55) x WHERE before IS NULL OR before <> event_type""",
    # Newest rows per owner
    "latest_per_owner": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE value >= 28) x WHERE place <= 20",
    # Newest wins
    "newest_wins": "SELECT conv_id, max(turn) AS newest FROM conversations GROUP BY conv_id",
    # K1 K3: top three of each
    "top_three": "SELECT user_id, event_type, place FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY sum(value) DESC, event_type) AS place FROM events GROUP BY user_id, event_type) x WHERE place <= 3",
    # K4: two always, a third only with a share of 0.05
    "crop_buttons": """SELECT user_id, event_type FROM (SELECT user_id, event_type, sum(value) / sum(sum(value)) OVER (PARTITION BY user_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY sum(value) DESC, event_type) AS place
      FROM events GROUP BY user_id, event_type) x WHERE place <= 2 OR (place = 3 AND p >= 0.05)""",
    # K6: a fixed value first, then by name
    "healthy_first": "SELECT n_name, row_number() OVER (ORDER BY n_regionkey, CASE WHEN n_name = 'CHINA' THEN 0 ELSE 1 END, n_name) AS place FROM nation",
    # Most frequent mix-ups with their share
    "top_mixups": """SELECT truth, predicted, n, round(n / total, 3) AS share FROM (SELECT o_orderstatus AS truth, o_orderpriority AS predicted, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY o_orderstatus) AS DOUBLE) AS total
      FROM orders GROUP BY o_orderstatus, o_orderpriority) x ORDER BY n DESC, truth, predicted LIMIT 30""",
    # Threshold and flag
    "clean_set": "SELECT event_id, event_type <> 'view' AS field FROM events WHERE value < 95",
    # A filter by a normalised value set
    "value_set_filter": "SELECT c_custkey FROM customer WHERE lower(trim(c_mktsegment)) IN ('building', 'machinery')",
    # Computed keys; other values folded
    "fold_other": "SELECT concat(CASE WHEN lang IN ('en', 'fr') THEN lang ELSE '__other' END, '::', source) AS k, count(*) AS n FROM documents GROUP BY CASE WHEN lang IN ('en', 'fr') THEN lang ELSE '__other' END, source",
    # Kept rows only, a column subset
    "kept_export": "SELECT d.doc_id, lang, quality AS predicted FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE toxic = 0 AND lang IS NOT NULL",
    # Reject reasons, size bounds
    "reject_reasons": "SELECT CASE WHEN html IS NULL THEN 'unreadable' WHEN length(html) > 8000 THEN 'too_large' WHEN length(html) < 48 THEN 'too_small' ELSE 'ok' END AS reason, count(*) AS n FROM pages GROUP BY CASE WHEN html IS NULL THEN 'unreadable' WHEN length(html) > 8000 THEN 'too_large' WHEN length(html) < 48 THEN 'too_small' ELSE 'ok' END",
    # rounding, half up
    "rounded": "SELECT l_orderkey, l_linenumber, round(l_discount * 100, 0) AS percent, round(l_tax, 1) AS tax FROM lineitem",
    # Buckets, status with a default, title
    "confidence_buckets": """SELECT event_id, CASE WHEN value / 100 >= 0.8 THEN 'high' WHEN value / 100 >= 0.55 THEN 'medium' ELSE 'low' END AS level,
      CASE event_type WHEN 'purchase' THEN 'DISEASE' WHEN 'view' THEN 'HEALTHY' ELSE 'UNCERTAIN' END AS status FROM events""",
    # titles of the sick left out
    "title_exclusion": "SELECT count(*) AS n FROM documents WHERE NOT (lower(text) LIKE '%disease%' OR lower(text) LIKE '%rot%')",
    # Capped equal-share weights
    "capped_share_weights": """SELECT l.event_id, round(least(CAST(10000 AS DOUBLE) / c.classes, CAST(4 AS DOUBLE) * s.n) / s.n, 9) AS weight FROM events l JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) s ON s.event_type = l.event_type
      CROSS JOIN (SELECT count(DISTINCT event_type) AS classes FROM events) c""",
    # Sources that failed do not stop the others
    "source_isolation": "SELECT source, count(*) AS n, sum(CASE WHEN n_chars < 20 THEN 1 ELSE 0 END) AS failed, sum(CASE WHEN n_chars < 20 THEN 1 ELSE 0 END) * 10 > count(*) AS isolated FROM documents GROUP BY source",
    # Keyword rules, first match wins, with the reason
    "rule_groups": """SELECT grp, reason, count(*) AS n FROM (SELECT CASE WHEN lower(p_type) LIKE '%steel%' THEN 'metal' WHEN lower(p_type) LIKE '%polished%' THEN 'finish' ELSE 'fungal_spot' END AS grp,
      CASE WHEN lower(p_type) LIKE '%steel%' OR lower(p_type) LIKE '%polished%' THEN 'rule' ELSE 'default' END AS reason FROM part) x GROUP BY grp, reason""",
    # Completeness checks as empty results, counted
    "completeness": "SELECT (SELECT count(*) FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey WHERE r.r_regionkey IS NULL) AS nations_without_region, (SELECT count(*) FROM labels WHERE quality NOT IN (0, 1)) AS odd_labels",
    # An inventory keyed kind:id
    "speech_inventory": "SELECT concat('nation:', CAST(n_nationkey AS VARCHAR(5))) AS k, n_name AS text FROM nation UNION ALL SELECT concat('region:', CAST(r_regionkey AS VARCHAR(5))), r_name FROM region",
    # Merge, and drop obsolete keys
    "merge_keys": "SELECT n.n_nationkey AS k, coalesce(o.text, n.n_name) AS text FROM nation n LEFT JOIN (SELECT 1 AS k, 'kept' AS text UNION ALL SELECT 99, 'obsolete') o ON o.k = n.n_nationkey",
    # Attempts, states and idempotence of a send queue
    "send_queue": """SELECT user_id, event_type, count(*) AS attempts, CASE WHEN max(value) >= 90 THEN 'DONE' WHEN count(*) >= 5 THEN 'FAILED' ELSE 'PENDING' END AS state FROM events GROUP BY user_id, event_type""",
}
