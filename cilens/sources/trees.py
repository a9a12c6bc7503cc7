"""Source trees, language detection and content-addressed files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cilens import rules
from cilens.functions import text as X

ALL_EXTENSIONS = tuple(e for lang in rules.LANGUAGES for e in rules.EXTENSIONS[lang])


def _glob() -> str:
    """File name pattern for every supported extension in either case."""
    either = lambda ext: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext)
    return "*{" + ",".join(either(e) for e in ALL_EXTENSIONS) + "}"


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Supported source files under a folder, outside vendored segments, as (path, content).

    The name pattern is applied while listing, so files of other kinds are never opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _glob()).load(root)
    scheme = r"^[a-z0-9]+:/*(?=/)"
    inner = F.substr(F.regexp_replace("path", scheme, ""), F.lit(len(re.sub(scheme, "", root.rstrip("/"))) + 2))
    wanted = own_source(files.select(inner.alias("path"), "content"), "path")
    return wanted.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def own_source(files: DataFrame, path: str) -> DataFrame:
    return files.where(X.language_of_path(F.col(path)).isNotNull() & ~X.vendored(F.col(path)))


def manifest_language(name: Column) -> Column:
    out = None
    for lang in rules.LANGUAGES:
        hit = name.isin(*rules.MANIFESTS[lang])
        out = F.when(hit, lang) if out is None else out.when(hit, lang)
    return out


def repo_languages(files: DataFrame) -> DataFrame:
    """Languages of each repository in fixed order: by manifest names at the top level, or by
    extensions when no manifest names a language. ``files`` has repo_id and path."""
    path = X.slashes(F.col("path"))
    top = ~F.contains(path, F.lit("/"))
    seen = files.select("repo_id", F.when(top, manifest_language(path)).alias("m"),
                        F.when(~X.vendored(path), X.language_of_path(path)).alias("e"))
    sets = seen.groupBy("repo_id").agg(F.collect_set("m").alias("m"), F.collect_set("e").alias("e"))
    chosen = F.when(F.size("m") > 0, F.col("m")).otherwise(F.col("e"))
    ordered = F.filter(F.array(*[F.lit(l) for l in rules.LANGUAGES]), lambda l: F.array_contains(chosen, l))
    return sets.select("repo_id", ordered.alias("languages"))


def file_index(files: DataFrame, content: str = "content") -> DataFrame:
    """Index rows for stored files: id and checksum from the content."""
    digest = F.sha2(F.col(content), 256)
    return files.withColumn("sha256", digest).withColumn("file_id", F.concat(F.lit("FILE_"), F.substring("sha256", 1, 12)))


def verify_integrity(files: DataFrame, index: DataFrame, content: str = "content") -> DataFrame:
    """Whether each indexed file still has the checksum on record; a missing file fails."""
    now = files.select("name", F.sha2(F.col(content), 256).alias("current"))
    return index.select("name", "file_id", "sha256").join(now, "name", "left").select(
        "name", "file_id", F.coalesce(F.col("current") == F.col("sha256"), F.lit(False)).alias("intact"))
