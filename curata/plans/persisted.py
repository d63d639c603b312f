"""

What they write goes below a folder of their own in the shared checkpoint folder."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from curata.functions import scripts
from curata.operators import clips
from curata.operators.scratch import folder
from curata.sources import archives, guarded
from curata.sources.tables import load

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def own_folder(spark) -> str:
    return f"{folder(spark).rstrip('/')}/run-{uuid.uuid4().hex}"


# Texts as members of archives by source, read back by ranges of bytes
@query("SELECT coalesce(doc_id::VARCHAR, 'unnamed') AS member, octet_length(encode(coalesce(text, '')))::BIGINT AS size, sha256(coalesce(text, '')) AS sha256 FROM documents")
def archived_texts(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("file"), F.encode("text", "UTF-8").alias("payload"))
    at = own_folder(spark)
    archives.write_zips(docs, at, "source")
    return archives.read_zips(spark, at).select("member", "size", F.sha2("payload", 256).alias("sha256"))


# A missing source and one with a bad value leave the others whole
@query("""SELECT 'customer' AS source, count(*) AS rows, 'loaded' AS kind FROM customer UNION ALL SELECT 'absent', 0, 'missing' UNION ALL SELECT 'supplier', 0, CASE WHEN count(*) > 0 THEN 'failed' ELSE 'loaded' END FROM supplier
  UNION ALL SELECT 'documents', count(*), 'loaded' FROM documents""")
def guarded_sources(spark, sf_dir):
    bad = F.when(F.col("s_suppkey").isNull(), "").otherwise(F.raise_error(F.lit("bad value")).cast("string"))
    reads = {
        "customer": lambda p: spark.read.parquet(p).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text")),
        "absent": lambda p: spark.read.parquet(p).select("id", "text"),
        "supplier": lambda p: spark.read.parquet(p).select(F.col("s_suppkey").alias("id"), bad.alias("text")),
        "documents": lambda p: spark.read.parquet(p).select(F.col("doc_id").alias("id"), "text"),
    }
    got = guarded.load_sources(spark, [(k, f"{sf_dir}/{k}.parquet", read) for k, read in reads.items()], "id long, text string", own_folder(spark))
    counts = got.rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    return got.summary.select("source").join(counts, "source", "left").join(got.problems, "source", "left").select("source", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("kind", F.lit("loaded")).alias("kind"))


# Clips for the texts of items and conversations; an hour later, of conversations and documents
@query("""WITH p AS (SELECT 'doc:' || doc_id AS key, text FROM documents UNION ALL SELECT 'conv:' || conv_id || ':' || coalesce(turn::VARCHAR, ''), text FROM conversations),
  d AS (SELECT text FROM benchmark UNION SELECT text FROM conversations)
  SELECT key, CASE WHEN length(trim(p.text)) >= 2 AND contains(p.text, 'e') THEN sha256(p.text) END AS clip,
    CASE WHEN p.text IS NULL OR length(trim(p.text)) < 2 THEN 'short' WHEN NOT contains(p.text, 'e') THEN 'silent' WHEN d.text IS NOT NULL THEN 'reused' ELSE 'new' END AS status FROM p LEFT JOIN d ON d.text = p.text""")
def clip_index(spark, sf_dir):
    text = lambda table, key: load(spark, sf_dir, table).select(key.alias("key"), "text")
    turns = text("conversations", F.concat(F.lit("conv:"), "conv_id", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(""))))
    items, docs = text("benchmark", F.col("item_id").cast("string")), text("documents", F.concat(F.lit("doc:"), "doc_id"))
    make = lambda new: new.select("digest", F.when(F.contains("text", F.lit("e")), F.encode("text", "UTF-8")).alias("payload"))  # noqa: E731  # stands for the speech of a text; texts without an e are silent
    at, begun = own_folder(spark), datetime.datetime(2024, 1, 1)
    clips.refresh(items.unionByName(turns), at, make, "v1", begun, least=2)
    return clips.refresh(docs.unionByName(turns), at, make, "v1", begun + datetime.timedelta(hours=1), least=2)


#: Sounds of Latin letters in Devanagari, some of two letters.
SOUNDS = {"sh": "श", "ch": "च", "th": "थ", "kh": "ख", "gh": "घ", "dh": "ध", "bh": "भ", "ph": "फ", "aa": "आ", "ee": "ई", "oo": "ऊ", "k": "क", "g": "ग", "c": "च", "j": "ज", "t": "त", "d": "द", "n": "न", "p": "प", "b": "ब", "m": "म", "y": "य", "r": "र", "l": "ल", "v": "व", "s": "स", "h": "ह", "a": "अ", "i": "इ", "u": "उ", "e": "ए", "o": "ओ"}
VOICES = {"en": "te", "es": "ta", "fr": "as", "de": "gu"}
SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _voice_sql(lang: str) -> str:
    table = scripts.script_table(scripts.SCRIPTS[lang])
    said = f"regexp_replace(s, '([क-ह])({SPACE}|$)', '\\1्\\2', 'g')" if lang in scripts.STOPPED else "s"
    said = f"translate({said}, '{''.join(table)}', '{''.join(table.values())}')"
    return f"replace({said}, 'র', 'ৰ')" if lang == "as" else said


# texts by sounds in Devanagari, then in the script of a language
@query(f"""WITH m AS (SELECT MAP {{{", ".join(f"'{k}': '{v}'" for k, v in SOUNDS.items())}}} AS m), t AS (SELECT doc_id, lang, array_to_string(list_transform(regexp_extract_all(text, '(?s)({"|".join(SOUNDS)}|.)'), lambda x: coalesce(m[x], x)), '') AS s FROM documents, m)
  SELECT doc_id, length(said)::BIGINT AS n, md5(said) AS said FROM (SELECT doc_id, CASE lang {" ".join(f"WHEN '{k}' THEN {_voice_sql(v)}" for k, v in VOICES.items())} ELSE s END AS said FROM t)""")
def transliterated(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", scripts.transliterate(F.col("text"), SOUNDS).alias("s"))
    said = F.col("s")
    for lang, voice in VOICES.items():
        said = F.when(F.col("lang") == lang, scripts.spoken(F.col("s"), voice)).otherwise(said)
    return docs.select("doc_id", said.alias("said")).select("doc_id", F.length("said").cast("long").alias("n"), F.md5("said").alias("said"))
