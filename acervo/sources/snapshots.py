"""Immutable snapshots of tables: written once, verified by digest, published by a pointer."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a table, whatever the order of its rows: row digests are added, not gathered."""
    parts = [F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in sorted(df.columns)]
    h = F.sha2(F.concat_ws("\x1f", *parts), 256)
    sums = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i in range(4)]
    r = df.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    return r.n, "-".join(r[f"s{i}"] or "0" for i in range(4))


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """The file appears whole or not at all and an old one stays until then: written beside it, then renamed over it in one step."""
    fs, Path = _files(spark, path)
    fresh = Path(path + ".new")
    out = fs.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    context = jvm.FileContext.getFileContext(fresh.toUri(), spark.sparkContext._jsc.hadoopConfiguration()) if fresh.toUri().getScheme() else jvm.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    over[0] = jvm.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(fresh), fs.makeQualified(Path(path)), over)


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, Path = _files(spark, path)
    if not fs.exists(Path(path)):
        return None
    return "\n".join(r.value for r in spark.read.text(path).collect())


def publish_snapshot(df: DataFrame, path: str, version: str) -> None:
    """Write df under path/version with its digest, verify what was written and point `path` at it."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/{version}")
    rows, value = digest(spark.read.parquet(f"{path}/{version}"))
    _write_text(spark, f"{path}/{version}.manifest", json.dumps({"digest": value, "rows": rows, "version": version}, sort_keys=True))
    promote(spark, path, version)


def verify(spark: SparkSession, path: str, version: str) -> bool:
    """Whether a snapshot is what its manifest says."""
    manifest = _read_text(spark, f"{path}/{version}.manifest")
    if manifest is None:
        return False
    told = json.loads(manifest)
    return (told["rows"], told["digest"]) == digest(spark.read.parquet(f"{path}/{version}"))


def promote(spark: SparkSession, path: str, version: str) -> None:
    """Point at a version, newer or older; one that fails verification is refused."""
    if not verify(spark, path, version):
        raise ValueError(f"snapshot {version} is not what its manifest says")
    _write_text(spark, f"{path}/current", version)


def current_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that the pointer names, or None before the first one."""
    version = _read_text(spark, f"{path}/current")
    return None if version is None else spark.read.parquet(f"{path}/{version.strip()}")


def recover(spark: SparkSession, path: str) -> str | None:
    """The version in force after a crash: the pointer's if it verifies, else the newest written version that does, which is promoted; None where there is none."""
    named = _read_text(spark, f"{path}/current")
    if named is not None and verify(spark, path, named.strip()):
        return named.strip()
    fs, Path = _files(spark, path)
    if not fs.exists(Path(path)):
        return None
    written = sorted(((s.getModificationTime(), s.getPath().getName().removesuffix(".manifest")) for s in fs.listStatus(Path(path)) if s.getPath().getName().endswith(".manifest")), reverse=True)
    for _, version in written:
        if verify(spark, path, version):
            promote(spark, path, version)
            return version
    return None


def pinned(spark: SparkSession, path: str) -> tuple[str, DataFrame] | None:
    """(version, table) of the pointer as it is now: a run reads one version from beginning to end, whatever is promoted meanwhile."""
    version = _read_text(spark, f"{path}/current")
    return None if version is None else (version.strip(), spark.read.parquet(f"{path}/{version.strip()}"))
