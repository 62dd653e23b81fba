"""Writers: Parquet, CSV, JSON text; and a cache of derived tables keyed by their inputs."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline.functions.lists import flat_text
from tripline.sources.storage import remove


def parquet(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).parquet(path)
    return path


def csv(df: DataFrame, path: str, compression: str = "none") -> str:
    """With a header line; nested columns as text."""
    flat = df.select(*[flat_text(F.col(c), kind).alias(c) for c, kind in df.dtypes])
    flat.write.mode("overwrite").option("header", True).option("compression", compression).csv(path)
    return path


def json_lines(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def text_value(df: DataFrame, path: str) -> str:
    """A one-row frame's value column as a text file."""
    df.select("value").coalesce(1).write.mode("overwrite").text(path)
    return path


def summary_json(df: DataFrame, scalars: dict, top: DataFrame) -> DataFrame:
    """One row, value: a JSON object of the scalar aggregates and the rows of ``top``."""
    rows = top.agg(F.collect_list(F.struct(*top.columns)).alias("top"))
    return df.agg(*[c.alias(k) for k, c in scalars.items()]).crossJoin(rows).select(F.to_json(F.struct("*")).alias("value"))


def _files(df: DataFrame) -> list[str]:
    spark = df.sparkSession
    out = []
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return out


def manifest(inputs: list[DataFrame]) -> str:
    """What tells inputs apart: their plans, schemas, and files with sizes and times, as JSON."""
    each = [
        {"plan": x._jdf.queryExecution().analyzed().canonicalized().toString(), "hash": x.semanticHash(), "schema": x.schema.jsonValue(), "files": _files(x)}
        for x in inputs
    ]
    return json.dumps(each, sort_keys=True)


def published(spark: SparkSession, path: str, wanted: str) -> str | None:
    """The newest whole entry below the path whose manifest is the wanted one, if there is one."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    key = hashlib.sha256(wanted.encode()).hexdigest()
    found = [str(x.getPath()) for x in (fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{key}-*")) or [])]
    for place in sorted(found, key=lambda p: int(p.rsplit("-", 1)[1]), reverse=True):
        if spark.read.text(f"{place}/manifest", wholetext=True).first()[0].rstrip("\n") == wanted:
            return place
    return None


def _move(spark: SparkSession, old: str, new: str) -> bool:
    """One rename; False if the new name is taken."""
    jvm = spark._jvm
    to, hadoop = jvm.org.apache.hadoop.fs.Path(new), spark._jsc.hadoopConfiguration()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.getFileSystem(hadoop).makeQualified(to).toUri(), hadoop).rename(jvm.org.apache.hadoop.fs.Path(old), to, options)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName() or to.getFileSystem(hadoop).exists(to):
            return False
        raise
    return True


def cached(build: Callable[[], DataFrame], path: str, inputs: list[DataFrame], refresh: bool = False) -> DataFrame:
    """What build gives, kept as Parquet below the path for these inputs; built again only if refresh is set or another input comes.

    An entry is built under a name of its own, with the manifest of its inputs, and published by one rename: readers see it whole or not
    at all, and a build that fails leaves no entry. Of two builders of the same entry the second takes the first one's, or, if it is to refresh,
    publishes the next number; readers take the newest.
    """
    spark, wanted = inputs[0].sparkSession, manifest(inputs)
    place = published(spark, path, wanted)
    if place and not refresh:
        return spark.read.parquet(f"{place}/data")
    key = hashlib.sha256(wanted.encode()).hexdigest()
    number = int(place.rsplit("-", 1)[1]) + 1 if place else 0
    work = f"{path}/building-{uuid.uuid4().hex}"
    try:
        build().write.parquet(f"{work}/data")
        spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.text(f"{work}/manifest")  # JSON is one line
        while not _move(spark, work, f"{path}/{key}-{number}"):
            if not refresh and (place := published(spark, path, wanted)):
                return spark.read.parquet(f"{place}/data")
            number += 1
    finally:
        remove(spark, work)
    return spark.read.parquet(f"{path}/{key}-{number}/data")
