"""Sources and sinks: parquet tables, folder-per-class files, zip members, CSV, JSON, text lists, verified payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.sources import archives

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: File name endings of photos.
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
PREDICTIONS = T.StructType([T.StructField(n, T.DoubleType() if n == "near_train_cos" else T.StringType()) for n in ("crop", "label", "domain", "near_train_cos", "predicted")])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """The tables as views; only what a query reads is scanned."""
    for name in names:
        load(spark, sf_dir, name).createOrReplaceTempView(name)


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """Photos below root with class and file taken from the path; the class is the parent folder. Contents are read only where used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    lower = F.lower("path")
    is_image = F.lit(False)
    for ending in IMAGE_ENDINGS:
        is_image = is_image | lower.endswith(ending)
    return files.where(is_image).select("path", "length", "content", F.element_at(parts, -2).alias("label"), F.element_at(parts, -1).alias("file"))


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """Photos inside the zip archives below path: one row per member. Other members are not read."""
    return archives.read_zips(spark, path, F.lower("member").rlike("(" + "|".join(IMAGE_ENDINGS).replace(".", r"\.") + ")$")).select(F.col("archive").alias("zip"), "member", "payload")


def verified(files: DataFrame, expected: DataFrame) -> DataFrame:
    """files (file, content) with whether their SHA-256 is the expected one (file, sha256); a file without one is not verified."""
    return files.join(expected, "file", "left").select("file", "length", F.coalesce(F.sha2("content", 256) == F.lower("sha256"), F.lit(False)).alias("verified"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, keep_empty: bool = False) -> DataFrame:
    """CSV with a header; with keep_empty an empty field is the empty string, else null. A byte-order mark is not part of the first name."""
    options = {"nullValue": "\u0000", "emptyValue": ""} if keep_empty else {}
    rows = spark.read.schema(schema).options(header="true", enforceSchema="true", **options).csv(path)
    return rows.na.fill("") if keep_empty else rows  # unquoted empty fields come as nulls whatever the options say


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON document per file; unknown keys are ignored and missing ones are null."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_split_list(spark: SparkSession, path: str) -> DataFrame:
    """(label, file): the last two parts of each line's path."""
    parts = F.split(F.trim("value"), "/")
    return spark.read.text(path).where(F.trim("value") != "").select(F.element_at(parts, -2).alias("label"), F.element_at(parts, -1).alias("file"))


def decode_label(value, names):
    """An integer label by its place in names; out of bounds and other values as they are."""
    number = value.cast("string").try_cast("int")
    return F.when(number.between(0, F.size(names) - 1), F.get(names, number)).otherwise(value.cast("string"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def card(counts: DataFrame, title: str, limit: int = 200) -> str:
    """A Markdown card of at most `limit` aggregate rows."""
    names = counts.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "-|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(str(v) for v in row) + " |" for row in counts.limit(limit).collect()])


def shared_scans(wanted: DataFrame, rows: DataFrame, source: str, crop: str) -> DataFrame:
    """wanted (crop, source): classes that draw on the same source share one scan of it. Counts per (source, crop), 0 where a source has none."""
    counts = rows.groupBy(source, crop).agg(F.count(F.lit(1)).alias("count"))
    return wanted.join(counts, [source, crop], "left").select(source, crop, F.coalesce("count", F.lit(0)).alias("count"))


def only_sources(rows: DataFrame, source: str, allowed=None) -> DataFrame:
    """rows, or where `allowed` is given those of sources that it holds for."""
    return rows if allowed is None else rows.where(F.col(source).isNotNull() & allowed)


def by_value_set(rows: DataFrame, values: set[str]) -> DataFrame:
    """The rows whose normalised value is one of `values`, in the text column that has most such rows (the first of equals): found in one aggregate."""
    names = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
    hit = lambda c: F.coalesce(F.lower(F.trim(c)).isin(*sorted(values)), F.lit(False))
    counts = rows.agg(*[F.count_if(hit(c)).alias(c) for c in names]).first()
    best = max(names, key=lambda c: counts[c])
    return rows.where(hit(best)) if counts[best] else rows.limit(0)


def _children(spark: SparkSession, folder: str) -> list[tuple[str, bool]]:
    """Paths in a folder of any file system that Spark reads, in order, and whether each is a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted((f.getPath().toString(), f.isDirectory()) for f in found)


def walk_dirs(spark: SparkSession, base: str, max_depth: int) -> list[str]:
    """Folders below base, at most max_depth deep; folders that hold files only are class folders and are not entered. A planning step on the driver."""
    out, level = [], [base]
    for _ in range(max_depth):
        level = [path for folder in level for path, is_folder in _children(spark, folder) if is_folder]
        out += level
    return out


def find_dir(spark: SparkSession, base: str, test, max_depth: int = 6) -> str | None:
    """The first folder, nearest to base, for whose children's names (a list) `test` holds."""
    for folder in [base, *walk_dirs(spark, base, max_depth)]:
        if test([p.rsplit("/", 1)[-1] for p, _ in _children(spark, folder)]):
            return folder
    return None


def choose_config(names: list[str]) -> str | None:
    """Of a data set's configurations "raw", else "default", else the first that is not augmented."""
    plain = [n for n in names if "augment" not in n.lower()]
    return next((n for wanted in ("raw", "default") for n in names if n.lower() == wanted), plain[0] if plain else None)


def file_cursor(spark: SparkSession, path: str) -> DataFrame:
    """display_name and size of a file, no row where it is missing; contents are not read."""
    path_ = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not path_.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path_):
        return spark.createDataFrame([], "display_name string, size long")
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("display_name"), F.col("length").alias("size"))
