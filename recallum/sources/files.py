"""Source trees as tables: reading, change detection and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Languages by extension, and folders that are not read.
LANGUAGES = {"php": "php", "js": "javascript", "ts": "typescript", "py": "python", "sql": "sql", "html": "html", "css": "css", "scss": "scss", "json": "json", "yaml": "yaml", "yml": "yaml", "xml": "xml", "sh": "bash", "env": "env"}
SKIPPED = ["node_modules", "vendor", ".git", "__pycache__", "venv", ".venv", ".eggs", "dist", "build", ".next", "cache", "logs", "tmp", ".sass-cache", "bower_components", ".idea", ".vscode", "coverage", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache"]


def language_of(path: Column) -> Column:
    """A file's language by its extension, or null."""
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))]


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, language, size, modified, hash, content) of all files of known languages under `root`."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    skip = "|".join(s.replace(".", r"\.") for s in SKIPPED)
    below = F.substring_index("path", root.rstrip("/"), -1)  # folders above the root may have any name
    kept = rows.where(~below.rlike(f"/(?:{skip})/")).withColumn("language", language_of(F.col("path"))).where("language IS NOT NULL")
    return kept.select("path", "language", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.md5(F.concat_ws("|", "length", "modificationTime")).alias("hash"), F.decode("content", "UTF-8").alias("content"))


def changes(manifest: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """(key, hash) of then and now → (key, state): new, changed, same or gone."""
    j = manifest.withColumnRenamed("hash", "was").join(listing, key, "full")
    return j.select(key, F.when(F.col("hash").isNull(), "gone").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("hash"), "changed").otherwise("same").alias("state"))


def digest_by(listing: DataFrame, by: str, key: str, hash_col: str) -> DataFrame:
    """One digest for each folder: the sum of 48 bits for each of its files, which partial sums make up in any order."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", key, hash_col)), 1, 12), 16, 10).cast("decimal(20,0)")
    return listing.groupBy(by).agg(F.count("*").alias("files"), F.sum(bits).cast("string").alias("digest"))
