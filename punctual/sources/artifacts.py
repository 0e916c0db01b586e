"""Versioned store of a model build (S6): all artifacts of a build under one version, published by its manifest.

Artifacts are tables.  Each is written below ``<base>/<version>/``; the manifest, which lists their schemas and row
counts, is written last under another name and renamed.  A version without a manifest does not exist for readers, so a
build that stopped half-way is never read.  All paths go through the Hadoop file system, as the data do.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "manifest.json"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, path_of = _fs(spark, path)
    draft = path_of(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, path_of(path)):
        raise FileExistsError(path)


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path).collect())      # a manifest is one line


def publish(spark: SparkSession, base: str, tables: dict[str, DataFrame], about: dict) -> str:
    """Write ``tables`` as a new version; returns its name.  ``about`` is kept in the manifest."""
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    listed = {}
    for name, df in tables.items():
        df.write.parquet(f"{base}/{version}/{name}")
        back = spark.read.parquet(f"{base}/{version}/{name}")
        listed[name] = {"schema": back.schema.jsonValue(), "rows": back.count()}
    _write_text(spark, f"{base}/{version}/{MANIFEST}", json.dumps({"version": version, "about": about, "tables": listed}))
    return version


def versions(spark: SparkSession, base: str) -> list[str]:
    """Published versions, oldest first."""
    fs, path_of = _fs(spark, base)
    if not fs.exists(path_of(base)):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(path_of(base)) if s.isDirectory()]
    return sorted(v for v in found if fs.exists(path_of(f"{base}/{v}/{MANIFEST}")))


def load(spark: SparkSession, base: str, version: str | None = None) -> tuple[dict[str, DataFrame], dict]:
    """(tables, about) of a version (default: the newest).  A table whose schema or row count is not the manifest's is
    an error."""
    known = versions(spark, base)
    version = version or (known[-1] if known else None)
    if version not in known:
        raise FileNotFoundError(f"{base}: no published version {version or ''}".rstrip())
    manifest = json.loads(_read_text(spark, f"{base}/{version}/{MANIFEST}"))
    tables = {}
    for name, want in manifest["tables"].items():
        df = spark.read.parquet(f"{base}/{version}/{name}")
        if df.schema.jsonValue() != want["schema"] or df.count() != want["rows"]:
            raise ValueError(f"{base}/{version}/{name} is not as published")
        tables[name] = df
    return tables, manifest["about"]
