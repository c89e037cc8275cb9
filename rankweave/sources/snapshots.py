"""Versioned snapshots of boards and news: each run writes a folder of its own, readers take the last or the one before."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rankweave.session import checkpointed
from rankweave.sources.tables import NEWS_ENTRY, RECORD

BOARD_ROW = T.StructType([*RECORD.fields, T.StructField("board", T.StringType()), T.StructField("section", T.IntegerType()), T.StructField("rank", T.LongType())])
#: Names of the boards in the exported document.
DOC_NAMES = {"best": "fighters", "worst": "worst", "secondary": "secondary", "secondaryWorst": "secondaryWorst", "thirdary": "thirdary", "thirdaryWorst": "thirdaryWorst"}


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def runs(spark: SparkSession, root: str) -> list[str]:
    """Finished runs in order; a folder without its success mark is a run that broke off."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    jvm = spark.sparkContext._jvm
    done = [x.getPath() for x in fs.listStatus(p) if x.isDirectory() and fs.exists(jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    return sorted(x.getName().partition("=")[2] for x in done if x.getName().startswith("run_id="))


def write_snapshot(df: DataFrame, root: str, run_id: str, fmt: str = "json") -> None:
    """One run, into a new folder; an existing run is never overwritten."""
    df.write.mode("error").format(fmt).save(f"{root}/run_id={run_id}")


def read_snapshot(spark: SparkSession, root: str, schema: T.StructType, back: int = 0, fmt: str = "json") -> DataFrame:
    """The last finished run, or the one ``back`` runs before it; empty where there is none. Broken records read as nulls."""
    known = runs(spark, root)
    if len(known) <= back:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).load(f"{root}/run_id={known[-1 - back]}")


def read_boards(spark: SparkSession, root: str, back: int = 0) -> DataFrame:
    return read_snapshot(spark, root, BOARD_ROW, back)


def read_news(spark: SparkSession, root: str, back: int = 0) -> DataFrame:
    return read_snapshot(spark, root, NEWS_ENTRY, back)


def load_board(spark: SparkSession, root: str, board: str) -> DataFrame:
    """One stored board of the last run in its order."""
    return read_boards(spark, root).where(F.col("board") == board).orderBy("rank")


def write_news(df: DataFrame, root: str, run_id: str, allow_empty: bool = False) -> bool:
    """Writes merged news; without any the last run stays the last, unless an empty run is asked for. Tells whether it wrote."""
    if not allow_empty and df.isEmpty():
        return False
    write_snapshot(df.select(*NEWS_ENTRY.fieldNames()), root, run_id)
    return True


def as_stored(boards: DataFrame) -> DataFrame:
    """Boards with the fields each is stored with: its own score, birth year and senior flag on score boards, previous ranks on the two others."""
    plain = F.col("board").isin("best", "worst")
    own = {"secondaryScore": F.col("board").startswith("secondary"), "thirdaryScore": F.col("board").startswith("thirdary"), "birthDate": ~plain, "isSenior": ~plain, "previousRank": plain}
    return boards.withColumns({
        f.name: (F.when(own[f.name], F.col(f.name)) if f.name in own else F.col(f.name)) if f.name in boards.columns else F.lit(None).cast(f.dataType) for f in BOARD_ROW.fields
    }).select(*BOARD_ROW.fieldNames())


def write_boards(boards: DataFrame, root: str, run_id: str, rows_per_file: int = 1_000_000) -> None:
    """All boards of one run as files sorted by rank, a board that is large in several, all in parallel."""
    laid = as_stored(boards).withColumn("__file", F.floor(F.col("rank") / F.lit(rows_per_file)))
    laid = laid.repartition("board", "__file").sortWithinPartitions("board", "rank").drop("__file")
    write_snapshot(laid, root, run_id)


#: The one-document export is for readers of small boards; larger ones are read as files.
MAX_DOCUMENT_ROWS = 100_000


def rankings_document(boards: DataFrame, last_updated: str, max_rows: int = MAX_DOCUMENT_ROWS) -> DataFrame:
    """One row ``json``: the document of all boards. Empty optional boards are omitted, ``fighters`` never is; nulls are left out.

    An export for readers of one document. Some boards have no limit, so the
    rows are counted first and more than ``max_rows`` are refused; ``document_parts``
    gives the same text for boards of any size.
    """
    if (n := boards.limit(max_rows + 1).count()) > max_rows:
        raise ValueError(f"the boards have at least {n} rows; one document takes {max_rows}")
    boards = as_stored(boards)
    row = F.struct("rank", F.struct(*RECORD.fieldNames()).alias("r"))
    lists = [
        F.transform(F.sort_array(F.collect_list(F.when(F.col("board") == b, row))), lambda x: x["r"]).alias(name) for b, name in DOC_NAMES.items()
    ]
    doc = boards.agg(*lists)
    fields = [F.col("fighters")] + [F.when(F.size(n) > 0, F.col(n)).alias(n) for n in list(DOC_NAMES.values())[1:]]
    return doc.select(F.to_json(F.struct(F.lit(last_updated).alias("lastUpdated"), *fields)).alias("json"))


#: Entries in a part of the document.
PART_ROWS = 1_000


def document_parts(boards: DataFrame, last_updated: str, rows_per_part: int = PART_ROWS) -> DataFrame:
    """``(place, part, before, json)``: the document of all boards, of any size, in parts.

    Joined in order of ``place`` and ``part`` they are the text that
    ``rankings_document`` makes of small boards. ``place`` counts the boards in
    the document's order; its part 0 closes the list before and opens its own,
    the others hold at most ``rows_per_part`` entries each, of which ``before``
    stand in earlier parts of the list.
    """
    spark, names = boards.sparkSession, list(DOC_NAMES.values())
    at = F.array_position(F.array(*map(F.lit, DOC_NAMES)), F.col("board")).cast("int") - 1
    rows = as_stored(boards).where(F.col("board").isin(*DOC_NAMES)).select(
        at.alias("place"), (F.coalesce(F.floor(F.col("rank") / F.lit(rows_per_part)), F.lit(0)) + 1).alias("part"), "rank", F.to_json(F.struct(*RECORD.fieldNames())).alias("r")
    )
    before = F.sum("n").over(Window.partitionBy("place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per part
    index = checkpointed(rows.groupBy("place", "part").agg(F.count("*").alias("n")).select("place", "part", F.coalesce(before, F.lit(0)).alias("before")))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "r"))), lambda x: x["r"]), ",")
    lists = rows.groupBy("place", "part").agg(texts.alias("r")).join(index, ["place", "part"]).select(
        "place", "part", "before", F.concat(F.when(F.col("before") > 0, ",").otherwise(""), "r").alias("json")
    )
    mark = lambda df, place, text: df.select(place.cast("int").alias("place"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("before"), text.alias("json"))
    start = mark(spark.range(1), F.lit(0), F.lit(f'{{"lastUpdated":{json.dumps(last_updated, ensure_ascii=False)},"{names[0]}":['))
    opened = mark(index.where("before = 0 and place > 0"), F.col("place"), F.concat(F.lit('],"'), F.array(*map(F.lit, names))[F.col("place")], F.lit('":[')))
    end = mark(spark.range(1), F.lit(len(names)), F.lit("]}"))
    return start.unionByName(opened).unionByName(lists).unionByName(end)


def read_document(parts: DataFrame, entry: str) -> DataFrame:
    """``(board, rank, r)``: entries of a document in parts with the fields of the type ``entry``, and their places in their lists. A broken entry is an error."""
    entries = F.when(F.col("part") > 0, F.concat(F.lit("["), F.ltrim("json", F.lit(",")), F.lit("]")))  # the planner may parse a row before it is filtered
    read = F.from_json(entries, f"array<{entry}>", {"mode": "FAILFAST"})
    rows = parts.where("part > 0").select("place", "before", F.posexplode(read).alias("at", "r"))
    return rows.select(F.array(*map(F.lit, DOC_NAMES))[F.col("place")].alias("board"), (F.col("before") + F.col("at") + 1).cast("long").alias("rank"), "r")
