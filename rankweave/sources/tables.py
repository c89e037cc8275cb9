"""Schemas of the entities and the reader of a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "long": T.LongType(), "timestamp": T.TimestampType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _schema(ddl: str) -> T.StructType:
    """A flat schema from ``name kind`` pairs; needs no running session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split() for x in ddl.split(","))])


RECORD = _schema(
    "name string, total long, wins long, kos long, losses long, draws long, nationality string, wikipediaUrl string, "
    "lastUpdated timestamp, gender string, weightClass string, imageUrl string, previousRank long, secondaryScore long, "
    "thirdaryScore double, birthDate string, isSenior boolean"
)
NEWS_ENTRY = _schema("boxerName string, headline string, url string, source string, publishedAt string")
CATEGORY_EDGE = _schema("parent string, child string, kind string")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder, as lazily as Spark reads it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
