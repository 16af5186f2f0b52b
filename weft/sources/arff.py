"""Attribute-relation files as DataFrames. Lines are told apart by their form, so that a folder of part files reads as one relation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ATTRIBUTE = re.compile(r"@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.*)", re.IGNORECASE)


def _attributes(text: DataFrame) -> list[tuple[str, list[str] | None]]:
    """(name, values or None for a number) of each attribute, in file order; a relation has few."""
    lines = text.where(F.lower(F.trim("value")).startswith("@attribute")).withColumn("_at", F.monotonically_increasing_id()).orderBy("_at").collect()
    out = []
    for r in lines:
        if m := _ATTRIBUTE.match(r["value"].strip()):
            kind = m[2].strip()
            values = [v.strip().strip("'\"") for v in kind[1 : kind.rindex("}")].split(",")] if kind.startswith("{") else None
            out.append((m[1].strip("'\""), values))
    return out


def read_arff(spark: SparkSession, path: str, known_only: bool = True) -> DataFrame:
    """A column for each attribute: strings for nominal ones, doubles for numeric ones, ? as null. With ``known_only``, rows whose
    first field isn't a value of a nominal first attribute are left out; comments and blank lines always are."""
    text = spark.read.text(path)
    attributes = _attributes(text)
    if not attributes:
        raise ValueError("no @attribute line")
    line = F.trim("value")
    rows = text.where((line != "") & ~F.substring(line, 1, 1).isin("@", "%", "#")).select(F.transform(F.split(line, ","), lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", "")).alias("f")).where(F.size("f") == len(attributes))
    if known_only and attributes[0][1]:
        rows = rows.where(F.col("f")[0].isin(attributes[0][1]))
    return rows.select(*[F.when(F.col("f")[k] != "?", F.col("f")[k]).cast("string" if values else "double").alias(name) for k, (name, values) in enumerate(attributes)])


def write_arff(df: DataFrame, path: str, relation: str = "relation", max_values: int = 1000) -> None:
    """A folder of text files that read_arff() reads back: the header in one of them, the rows spread over the others."""
    header = [f"@relation {relation}"]
    for name, kind in df.dtypes:
        if kind == "string":
            values = [r[0] for r in df.select(name).where(F.col(name).isNotNull()).distinct().limit(max_values + 1).collect()]
            if len(values) > max_values:
                raise ValueError(f"{name} has over {max_values} values")
            header.append(f"@attribute {name} {{{','.join(sorted(values))}}}")
        else:
            header.append(f"@attribute {name} numeric")
    head = df.sparkSession.createDataFrame([("\n".join([*header, "@data"]),)], "value string")
    rows = df.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in df.columns]).alias("value"))
    head.union(rows).write.text(path)
