"""Weekly building-management exports: very wide CSV files, repeated headers, text readings.

One Spark job reads all files of a folder, keeps the few columns that play a
role, and returns them under fixed names.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from roomtide.functions.scalars import local_moment

# Words that identify a role's header, words that rule it out.
SUPPLY_NOT = ["eff sp", "loop", "max sp", "min sp"]
ROLES = {
    "timestamp": [(["timestamp"], [])],
    "occ_ahu1": [(["ah-01", "occ eff status"], [])],
    "occ_ahu2": [(["ah-02", "occ eff status"], [])],
    "return_temp_ahu1": [(["ah-01", "return air temp"], [])],
    "supply_temp_ahu1": [(["ah-01", "supply air temp"], SUPPLY_NOT)],
    "return_temp_ahu2": [(["ah-02", "return air temp"], [])],
    "supply_temp_ahu2": [(["ah-02", "supply air temp"], SUPPLY_NOT)],
    "hvac_power_kw": [
        (["hvac meter", "hvac elec power"], [".1"]),
        (["whole building electric meter", "total elec power"], []),
    ],
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
UNKNOWN_MONTH = 99


def unique_headers(headers: Iterable[str]) -> list[str]:
    """Second ``A`` becomes ``A__dup2``, third ``A__dup3``; order is kept."""
    seen: dict[str, int] = {}
    out = []
    for name in headers:
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}__dup{seen[name]}")
    return out


def plain(name: str) -> str:
    return re.sub(r"\s+", " ", str(name).strip().lower())


def find_header(headers: Iterable[str], include: Sequence[str], exclude: Sequence[str] = ()) -> str | None:
    """First header with all words of ``include`` and none of ``exclude``."""
    for header in headers:
        text = plain(header)
        if all(plain(w) in text for w in include) and not any(plain(w) in text for w in exclude):
            return header
    return None


def find_roles(headers: Sequence[str]) -> dict[str, str]:
    """Header for each role; an error names the roles without one."""
    found = {}
    for role, rules in ROLES.items():
        hits = (find_header(headers, include, exclude) for include, exclude in rules)
        found[role] = next((h for h in hits if h is not None), None)
    missing = [role for role, header in found.items() if header is None]
    if missing:
        raise ValueError(f"no column for: {', '.join(missing)}")
    return found


def with_week_order(df: DataFrame, file_name: str = "file_name") -> DataFrame:
    """``week_month, week_day, stem`` from names such as ``...Week_Apr28.csv``; other names sort last."""
    pattern = r"Week_([A-Za-z]+)(\d+)"
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    month = F.substring(F.lower(F.regexp_extract(stem, pattern, 1)), 1, 3)
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), month).cast("int")
    return df.withColumns({
        "week_month": F.when(number > 0, number).otherwise(F.lit(UNKNOWN_MONTH)),
        "week_day": F.coalesce(F.regexp_extract(stem, pattern, 2).try_cast("int"), F.lit(0)),
        "stem": stem,
    })


def _layouts(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Files of a folder by header line, found in one job; the driver gets a header line and a name per file."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
    )
    first = lines.where(F.col("start") == 0).groupBy("file").agg(F.min_by("value", "at").alias("header"))
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in sorted(first.collect(), key=lambda r: r["file"]):
        groups.setdefault(tuple(next(csv.reader([row["header"]]))), []).append(row["file"])
    return groups


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """Role columns of all files as text, parsed timestamps, plus the file's week order.

    Files of all layouts are read in one scan. Its columns are named by
    position, and only the positions that play a role in some layout are parsed.
    The catalogue, one row per file, says which of them is which in a file.
    """
    layouts = _layouts(spark, path)
    if not layouts:
        raise ValueError(f"no files at {path}")
    places = []  # position of each role, per layout
    for header in layouts:
        names = unique_headers(header)
        roles = find_roles(names)
        places.append({role: names.index(column) for role, column in roles.items()})
    choices = {role: sorted({at[role] for at in places}) for role in ROLES}
    catalogue = spark.createDataFrame(
        [
            (file, *[choices[role].index(at[role]) for role in ROLES])
            for at, files in zip(places, layouts.values()) for file in files
        ],
        "file_path string, " + ", ".join(f"_at_{role} int" for role in ROLES),
    )
    width = max(map(len, layouts))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    files = [unquote(file) for files in layouts.values() for file in files]
    wide = spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(files)
    used = sorted({i for positions in choices.values() for i in positions})
    rows = wide.select(
        *[f"c{i}" for i in used], F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name")
    )
    # the file list is known to the driver, so its catalogue may be sent to all tasks
    rows = rows.join(F.broadcast(catalogue), "file_path").select(
        *[
            F.get(F.array(*[f"c{i}" for i in choices[role]]), F.col(f"_at_{role}")).alias(role) for role in ROLES
        ],
        "file_name",
    )
    return with_week_order(rows.withColumn("timestamp", local_moment("timestamp")), "file_name").drop("file_name")
