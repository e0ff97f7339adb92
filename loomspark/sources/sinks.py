"""Results of the stages as Parquet tables under one folder, each table by its name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.neighbours import refine_labels
from loomspark.operators.transfer import Session

#: Columns by which a table is laid out, those that it has.
LAYOUT = ("cohort", "level", "modality", "section", "query", "label")


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """A folder a table; tables with a column of LAYOUT are partitioned by the first such."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        keys = [c for c in LAYOUT if c in df.columns and len(df.columns) > 1][:1]
        (writer.partitionBy(*keys) if keys else writer).parquet(f"{folder}/{name}")


def write_tree(result: dict[str, DataFrame], obs: DataFrame, folder: str) -> None:
    """Component distances, ranks, the split table, and observations by section."""
    sizes = obs.groupBy("section").agg(F.count(F.lit(1)).alias("n_obs"))
    write_tables({"components": result["components"], "ranks": result["ranked"], "splits": result["splits"], "sizes": sizes}, folder)


def write_transfer(session: Session, folder: str) -> None:
    """Final labels, rounds, and the nodes that ended with their reasons."""
    ended = session.query.sparkSession.createDataFrame(sorted(session.ended.items()), "node string, reason string")
    write_tables({"final_labels": session.labels(), "round_summary": session.summary(), "ended": ended}, folder)


def write_refined(labels: DataFrame, obs: DataFrame, folder: str, k: int = 8) -> None:
    """Labels after L09, with the coordinates."""
    placed = obs.select("section", "obs_id", "x", "y").join(labels.select("section", "obs_id", "label"), ["section", "obs_id"])
    refined = refine_labels(placed, k).withColumnRenamed("label", "initial")
    write_tables({"refined_labels": placed.select("section", "obs_id", "x", "y").join(refined, ["section", "obs_id"])}, folder)


def write_clustering_config(config: dict, folder: str, spark: SparkSession) -> None:
    """Scores of modalities and methods, and what was chosen."""
    chosen = spark.createDataFrame([(";".join(config["modalities"]), config["dim_reduction_method"])], "modalities string, dim_reduction_method string")
    write_tables({"modality_scores": config["modality_scores"], "method_scores": config["method_scores"], "chosen": chosen}, folder)


def write_heterogeneity(result: dict[str, DataFrame], folder: str) -> None:
    """Every table of the heterogeneity pipeline."""
    write_tables(result, folder)
