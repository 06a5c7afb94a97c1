"""Text tables: manifests of JSON lines, spreadsheets of CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from acervo.functions.scalars import guarded, unguarded
from acervo.operators.curation import latest


def read_manifest(spark: SparkSession, path: str, schema: StructType | str, key: str, sequence: str) -> DataFrame:
    """The last record of each key in a folder of JSON lines. A line that does not fit the schema is an error; manifest_faults() shows which."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return latest(rows, [key], [F.col(sequence).desc_nulls_last()])


def manifest_faults(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """(file, line): lines of a manifest that do not fit the schema."""
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"))
    probe = StructType([*wanted.fields, StructField("_corrupt_record", StringType())])
    read = lines.withColumn("__read", F.from_json("line", probe, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return read.where(F.col("__read._corrupt_record").isNotNull()).select("file", "line")


def read_samples(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Samples of a JSON file, an array or one object a line, as its first character tells."""
    head = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    many = bool(head) and head[0].value.lstrip("\ufeff \t").startswith("[")
    return spark.read.schema(schema).option("multiLine", many).option("mode", "FAILFAST").json(path)


def write_manifest(df: DataFrame, path: str, key: str) -> None:
    """JSON lines in the order of the key."""
    df.orderBy(key).write.mode("overwrite").json(path)


def read_sheet(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """A spreadsheet's CSV: separator as the header line shows, names in lower case and trimmed, formula guards taken off."""
    if separator is None:
        head = spark.read.text(path).limit(1).collect()
        line = head[0].value if head else ""
        separator = ";" if line.count(";") >= line.count(",") else ","
    rows = spark.read.csv(path, header=True, sep=separator, multiLine=True, escape='"', encoding="UTF-8")
    named = rows.toDF(*[c.lstrip("﻿").strip().lower() for c in rows.columns])
    return named.select(*[unguarded(F.col(f"`{c}`")).alias(c) for c in named.columns])


def write_sheet(df: DataFrame, path: str, separator: str = ";") -> None:
    """CSV with a header whose text cells no spreadsheet takes for formulas."""
    cells = [guarded(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in df.schema.fields]
    df.select(*cells).write.mode("overwrite").csv(path, header=True, sep=separator, escape='"', quoteAll=True)


def checked_overrides(df: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """(row as it is, problems): what is wrong with rows of a reviewers' sheet: key, decision, reviewer, repeated key."""
    from pyspark.sql import Window

    many = F.count(F.lit(1)).over(Window.partitionBy(key))
    number = F.col(key).try_cast("long")
    problems = F.array_compact(
        F.array(
            F.when(number.isNull(), "bad_key"),
            F.when(~F.coalesce(F.lower(F.trim("decision")).isin(allowed), F.lit(False)), "bad_decision"),
            F.when(F.coalesce(F.trim("reviewed_by"), F.lit("")) == "", "no_reviewer"),
            F.when(number.isNotNull() & (many > 1), "repeated_key"),
        )
    )
    return df.withColumn("problems", problems)
