"""Best representative of each duplicate group, field by field.

Each field is an own line of rows that hold a real value; a window ranks them by trust (sync did not fail), version,
recency and row id, and the first one survives. The rank filter lets Spark limit each group before the shuffle
(WindowGroupLimit), so a group of any size sends one row a field and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.functions.text import fold

# Fillers that say nothing is known, folded and without enclosing signs.
FILLERS = [
    "n/d", "nd", "s/n", "sn", "n/a", "na", "s/d", "s/i", "vazio", "em branco", "null", "nulo", "none", "nil", "nan", "undefined", "unknown", "tbd",
    "nao informado", "nao informada", "nao consta", "nao disponivel", "nao identificado", "nao se aplica", "sem informacao", "sem informacoes",
    "desconhecido", "desconhecida", "ignorado", "indefinido", "a preencher", "a definir", "a informar", "preencher",
]


def is_real(value: Column) -> Column:
    """Not null, not blank, no filler: neither a listed word nor signs only nor a run of x."""
    core = F.regexp_replace(F.trim(F.regexp_replace(fold(value), r"(?U)\s+", " ")), r"(?U)^[^\w]+|[^\w]+$", "")
    return F.coalesce((core != "") & ~core.rlike("^(x+|_+)$") & ~core.isin(FILLERS), F.lit(False))


def instant(text: Column) -> Column:
    """The instant of an ISO 8601 text, extended or compact; one without zone is in UTC; null where there is none."""
    extended = F.regexp_replace(F.trim(text), r"^(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})(\d{2})", "$1-$2-$3T$4:$5:$6")
    zoned = F.when(extended.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), extended).otherwise(F.concat(extended, F.lit("Z")))
    return zoned.try_cast("timestamp")


def surviving_fields(df: DataFrame, key: str, fields: list[str], row_id: str, order: list[Column]) -> DataFrame:
    """(key, field_name, row_id, value): for each key and field the row that supplies the surviving value.

    `order` ranks rows with a real value, best first; it must end in the row id, so that ties cannot occur between
    different rows. Defined results: rows with a null key belong to no group and are left out; a field without any
    real value in its group gives no row; repeated rows give one row; an empty table gives none; other columns of any
    name are not looked at.
    """
    held = [F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields]
    ranks = [f"__o{i}" for i in range(len(order))]
    lines = (
        df.where(F.col(f"`{key}`").isNotNull())
        .select(F.col(f"`{key}`").alias("__key"), F.col(f"`{row_id}`").alias("__row"), *[c.alias(n) for c, n in zip(order, ranks, strict=True)], F.array(*held).alias("__held"))
        .select("__key", "__row", *ranks, F.explode("__held").alias("__f"))
        .select("__key", "__row", *ranks, "__f.field_name", "__f.value")
        .where(is_real(F.col("value")))
    )
    best = Window.partitionBy("__key", "field_name").orderBy(*[F.col(n).desc_nulls_last() for n in ranks])
    return lines.withColumn("__rank", F.row_number().over(best)).where("__rank = 1").select(
        F.col("__key").alias(key), "field_name", F.col("__row").alias(row_id), "value"
    )


def surviving_records(df: DataFrame, key: str, fields: list[str], row_id: str, order: list[Column]) -> DataFrame:
    """One row for each non-null key: every field's surviving value (null where the group has none) and `<field>_row`, its supplier."""
    lines = surviving_fields(df, key, fields, row_id, order)
    picked = [
        x
        for f in fields
        for x in (
            F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f),
            F.max(F.when(F.col("field_name") == f, F.col(f"`{row_id}`"))).alias(f"{f}_row"),
        )
    ]
    groups = df.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias(key)).agg(F.count(F.lit(1)).alias("row_count"))
    return groups.join(lines.groupBy(key).agg(*picked), key, "left")


def curation_order() -> list[Column]:
    """Sync not failed, then highest version (null lowest), latest sync instant, highest row id."""
    return [
        F.coalesce(F.lower(F.trim("sync_status")) != "failed", F.lit(True)),
        F.col("mfiles_version"),
        instant(F.col("synced_at")),
        F.col("row_id"),
    ]
