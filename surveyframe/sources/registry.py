"""A table registry with roles, and content checks of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyframe.functions.basics import CheckFailed, require_empty


def registry_problems(registry: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Violations of a registry (path, role, provenance): two roles, nested paths, excluded folders, no provenance."""
    two_roles = registry.groupBy("path").agg(F.count_distinct("role").alias("n")).filter("n > 1").select(
        "path", F.lit("in two roles").alias("problem"))
    # every ancestor folder of a path, matched by equality instead of comparing all pairs
    parts = F.split("path", "/")
    upto = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                       lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    above = registry.select("path", "role", F.explode(upto).alias("folder")).filter(F.col("folder") != F.col("path"))
    # one row per folder: some owner has another role if the least or the largest role is another
    owners = registry.groupBy(F.col("path").alias("folder")).agg(F.min("role").alias("least"), F.max("role").alias("largest"))
    nested = above.join(owners, "folder").filter((F.col("least") != F.col("role")) | (F.col("largest") != F.col("role"))).select(
        "path", F.lit("inside another role's folder").alias("problem"))
    bare = registry.filter(F.coalesce(F.trim("provenance"), F.lit("")) == "").select(
        "path", F.lit("no provenance").alias("problem"))
    out = two_roles.unionByName(nested).unionByName(bare)
    if excluded is not None:
        banned = excluded.select(F.col("path").alias("folder")).distinct()
        under = above.select("path", "folder").union(registry.select("path", F.col("path").alias("folder")))
        out = out.unionByName(under.join(banned, "folder").select("path", F.lit("under an excluded folder").alias("problem")))
    return out.distinct()


def load_role(spark: SparkSession, registry: DataFrame, present: DataFrame, role: str) -> dict[str, DataFrame]:
    """Every table of a role, by file name; missing files and clashing names are errors."""
    wanted = registry.filter(F.col("role") == role)
    require_empty(wanted.join(present, "path", "left_anti").select("path"), f"missing tables of role {role}")
    names = wanted.withColumn("name", F.regexp_extract("path", "([^/]+?)(\\.[A-Za-z0-9]+)?$", 1))
    require_empty(names.groupBy("name").count().filter("count > 1"), f"two tables of role {role} share a name")
    return {r["name"]: spark.read.parquet(r["path"]) for r in names.select("name", "path").collect()}


def assert_role(registry: DataFrame, path: str, role: str) -> None:
    found = registry.filter(F.col("path") == path).select("role").first()
    if found is None or found["role"] != role:
        raise CheckFailed(f"{path} is not registered as {role}")


def role_status(registry: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per registered table: whether it is present and how many rows it has."""
    return registry.join(counts, "name", "left").select(
        "name", "role", F.col("rows").isNotNull().alias("present"), F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of several tables as one union; parquet answers each from its footers."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """Count, bytes and newest change of a set of files, from metadata only."""
    return files(spark, path).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"),
                                  F.max("modificationTime").alias("newest"))


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    return files(spark, path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"))


def check_frozen(hashes: DataFrame, recorded: DataFrame) -> None:
    """Raise when a recorded file is missing or its content has changed."""
    r = recorded.select("name", F.col("sha256").alias("recorded"))
    changed = r.join(hashes, "name", "left").filter(~F.col("recorded").eqNullSafe(F.col("sha256")))
    require_empty(changed, "frozen inputs changed")


def row_fingerprint(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Order-free content hash per key: each row is hashed, and 32-bit halves of the hashes are summed."""
    row = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))
    half = lambda i: F.conv(F.substring(row, i, 8), 16, 10).cast("bigint")
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(half(1)).alias("hash_a"), F.sum(half(9)).alias("hash_b"))


def binary_screen(spark: SparkSession, path: str, magic: str, expected: DataFrame | None = None, block: int = 2880) -> DataFrame:
    """Files that are empty, not a multiple of the block size, or lack the leading bytes.

    Spark does not hand out files of length 0, so those are the names of `expected` that did not arrive.
    """
    f = files(spark, path)
    head = F.substring("content", 1, len(magic)).cast("string")
    reason = (F.when(F.col("length") % block != 0, "size not a multiple of the block")
              .when(head != magic, "missing magic prefix"))
    name = F.regexp_extract("path", "([^/]+)$", 1).alias("name")
    bad = f.select(name, "length", reason.alias("reason")).filter("reason is not null")
    if expected is None:
        return bad
    gone = expected.select("name").join(f.select(name), "name", "left_anti")
    return bad.unionByName(gone.select("name", F.lit(0).cast("bigint").alias("length"), F.lit("empty").alias("reason")))


def file_index(manifest: DataFrame, listing: DataFrame, pattern: str) -> DataFrame:
    """(mission, id) -> path; a blank file name is rebuilt from `pattern` (format_string of the id)."""
    named = manifest.withColumn("file", F.coalesce("file", F.format_string(pattern, "id")))
    require_empty(named.join(listing, "file", "left_anti").select("mission", "id", "file"), "listed files are missing")
    return named.join(listing, "file").select("mission", "id", "path")
