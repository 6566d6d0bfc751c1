"""Result sinks: CSV and JSON folders."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(folder)


def write_backtest(metrics: DataFrame, forecasts: DataFrame, folder: str, stamp: str | None = None) -> dict[str, str]:
    """Metrics and forecasts under time-stamped names; returns the folders written."""
    stamp = stamp or datetime.now().strftime("%Y%m%d_%H%M%S")
    targets = {
        "metrics": f"{folder}/occupancy_model_metrics_{stamp}",
        "forecasts": f"{folder}/occupancy_model_forecasts_{stamp}",
    }
    write_csv(metrics, targets["metrics"])
    write_csv(forecasts, targets["forecasts"])
    return targets


def write_sections(sections: dict[str, DataFrame], folder: str) -> None:
    """One JSON folder per report section."""
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def write_dictionary(dictionary: DataFrame, markdown: DataFrame, folder: str) -> None:
    write_csv(dictionary, f"{folder}/schema_dictionary")
    markdown.orderBy("table_name").select(F.col("section").alias("value")).write.mode("overwrite").text(
        f"{folder}/schema_dictionary_md"
    )
