"""Observation and feature tables of the engine, and their views over the given Parquet tables.

Layout: ``obs(section, obs_id, label, x, y)`` has a row an observation, ``expr(section, obs_id, label, feature,
value)`` a row an observation and feature. Dense matrices keep their zeros; a sparse one goes with the number of
its observations, so that means and shares count the zeros that are not stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of orders that a task sums at a time.
COUNT_ROWS = 100_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _observed(embeddings: DataFrame, *more: Column) -> DataFrame:
    n = F.col("vec_id")
    return embeddings.select(
        F.concat(F.lit("s"), (n % 4).cast("string")).alias("section"), n.alias("obs_id"), F.concat(F.lit("r"), F.col("label").cast("string")).alias("label"),
        (n % 25).cast("double").alias("x"), F.floor(n / 25).cast("double").alias("y"), *more,
    )


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations: four sections, ten regions, places on a lattice of 25 columns."""
    return _observed(read(spark, sf_dir, "embeddings"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with their features as one array of doubles."""
    return _observed(read(spark, sf_dir, "embeddings"), F.col("embedding").cast("array<double>").alias("vector")).select("obs_id", "section", "label", "x", "y", "vector")


def raw_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense long matrix; values have both signs."""
    n = F.col("vec_id")
    return read(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("s"), (n % 4).cast("string")).alias("section"), n.alias("obs_id"), F.concat(F.lit("r"), F.col("label").cast("string")).alias("label"), F.posexplode("embedding").alias("pos", "v")
    ).select("section", "obs_id", "label", F.concat(F.lit("f"), F.col("pos").cast("string")).alias("feature"), F.col("v").cast("double").alias("value"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse matrix of quantities by order and brand, labelled by order priority, a section for each market segment.

    Lines are dealt by order over as many tasks as their number asks for, and what goes by order stays in these.
    """
    line, part, orders, customer = (read(spark, sf_dir, t) for t in ("lineitem", "part", "orders", "customer"))
    tasks = max(1, -(-line.count() // COUNT_ROWS))
    owners = orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_orderkey", "o_orderpriority", "c_mktsegment")
    lines = line.select("l_orderkey", "l_partkey", "l_quantity").repartition(tasks, "l_orderkey")
    joined = lines.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(owners, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("section"), F.col("l_orderkey").alias("obs_id"), F.col("o_orderpriority").alias("label"), F.col("p_brand").alias("feature")).agg(F.sum(F.col("l_quantity").cast("double")).alias("value"))


def sections(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Sections stored under ``path/section=<name>``; only their partitions are read."""
    return spark.read.option("basePath", path).parquet(path).where(F.col("section").isin(names))


def write_sections(df: DataFrame, path: str) -> None:
    """Store a table partitioned by section (and by cohort, level and modality where it has them)."""
    keys = [c for c in ("cohort", "level", "modality", "section") if c in df.columns]
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def read_coordinates(spark: SparkSession, path: str, id_column: str = "spot_id") -> DataFrame:
    """Coordinates from CSV with a header: ``(obs_id, x, y)`` from the id and ``pixel_x``, ``pixel_y`` columns."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.col(id_column).alias("obs_id"), F.col("pixel_x").cast("double").alias("x"), F.col("pixel_y").cast("double").alias("y"))


def write_coordinates(df: DataFrame, path: str, id_column: str = "spot_id") -> None:
    df.select(F.col("obs_id").alias(id_column), F.col("x").alias("pixel_x"), F.col("y").alias("pixel_y")).write.mode("overwrite").option("header", True).csv(path)


def images(spark: SparkSession, folder: str, pattern: str = "*.{jpg,jpeg,png,tif,tiff}") -> DataFrame:
    """Encoded images by path, undecoded: ``(path, length, content)``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", "content")


def align_features(features: DataFrame, obs: DataFrame) -> DataFrame:
    """Precomputed features of exactly the molecular observations, with their coordinates.

    ``features(section, obs_id, feature, value)``; clusterings stored with them (``kmeans_*`` columns) go. An
    observation that has no features is an error when rows are read.
    """
    kept = features.drop(*[c for c in features.columns if c.startswith("kmeans_")])
    have = kept.select("section", "obs_id").distinct().withColumn("_have", F.lit(True))
    checked = obs.join(have, ["section", "obs_id"], "left")
    wrong = F.raise_error(F.concat(F.lit("no features for observation "), F.col("obs_id").cast("string"))).cast("boolean")
    covered = checked.where(F.when(F.col("_have"), F.lit(True)).otherwise(wrong)).select("section", "obs_id", "x", "y")
    return kept.join(covered, ["section", "obs_id"])


def active_observations(features: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of a node's members, ``members(section, obs_id)``; a member without a row is an error when rows are read."""
    have = features.select("section", "obs_id").distinct().withColumn("_have", F.lit(True))
    wrong = F.raise_error(F.concat(F.lit("a member has no row: "), F.col("obs_id").cast("string"))).cast("boolean")
    checked = members.select("section", "obs_id").join(have, ["section", "obs_id"], "left")
    return features.join(checked.where(F.when(F.col("_have"), F.lit(True)).otherwise(wrong)).select("section", "obs_id"), ["section", "obs_id"])


def section_files(spark: SparkSession, template: str, sections: list[str], extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "tif", "tiff")) -> DataFrame:
    """The file of each section, ``(section, path, length)``, by a template with ``{section}`` and perhaps ``{ext}``.

    Listing goes by the templates' globs, contents are not read. A section without a file is an error.
    """
    if "{section}" not in template:
        raise ValueError("the template needs {section}")
    folder, _, pattern = template.rpartition("/")
    found = None
    for section in sections:
        glob = pattern.replace("{section}", section).replace("{ext}", "{" + ",".join(extensions) + "}")
        one = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select(F.lit(section).alias("section"), "path", "length")
        found = one if found is None else found.unionByName(one)
    rows = {r.section for r in found.select("section").distinct().collect()} if found is not None else set()
    lacking = [s for s in sections if s not in rows]
    if lacking or found is None:
        raise FileNotFoundError(f"no file for sections: {', '.join(lacking)}")
    return found
