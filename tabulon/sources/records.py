"""Readers of stored tables and source records: canonical Parquet, JSON by key, deck files, paged and enveloped documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.sources.schemas import CANONICAL, IMPORT_COLUMNS

MOST_BYTES = 5_000_000


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one of the schema where there is none. Columns that files lack are NULL."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def canonical_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_or_empty(spark, f"{folder}/{name}.parquet", schema) for name, schema in CANONICAL.items()}


def json_records(spark: SparkSession, folder: str) -> DataFrame:
    """(key, body, changed, bytes): every .json file below the folder, by its path from there, with when it was written."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    name = folder.rstrip("/").rsplit("/", 1)[-1] + "/"
    key = F.element_at(F.split(F.col("_metadata.file_path"), f"/{name}", 2), -1)
    return files.select(key.alias("key"), F.col("value").alias("body"), F.col("_metadata.file_modification_time").alias("changed"), F.col("_metadata.file_size").alias("bytes"))


def stale(records: DataFrame, cached: DataFrame) -> DataFrame:
    """Records that are new or were written since they were cached, so that only these are parsed again."""
    return records.join(cached.select("key", "changed", "bytes"), ["key", "changed", "bytes"], "left_anti")


def refreshed(records: DataFrame, cached: DataFrame) -> DataFrame:
    """The cache brought up to date: what is unchanged from it, what is stale anew, and nothing that has vanished."""
    kept = cached.join(records.select("key", "changed", "bytes"), ["key", "changed", "bytes"], "left_semi")
    return kept.unionByName(stale(records, cached).select(kept.columns))


def dispatched(records: DataFrame, kinds: dict[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """Records by key prefix. kinds: name -> (prefix, schema of the body); each result has key, id (the file's name) and the body's fields.
    Bodies that don't parse are left to quarantined()."""
    out = {}
    for name, (prefix, schema) in kinds.items():
        r = records.filter(F.col("key").startswith(prefix)).withColumn("r", F.from_json("body", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
        out[name] = r.filter("r._bad is null").select("key", F.regexp_extract("key", r"([^/]+)\.json$", 1).alias("id"), "r.*").drop("_bad")
    return out


def quarantined(records: DataFrame, kinds: dict[str, tuple[str, str]]) -> DataFrame:
    """(key, reason, payload_hash) of records that no prefix takes or that don't parse; never the text itself."""
    bad = F.lit("unknown_prefix")
    for prefix, schema in kinds.values():
        parsed = F.from_json("body", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
        bad = F.when(F.col("key").startswith(prefix), F.when(parsed["_bad"].isNotNull(), "not_readable")).otherwise(bad)
    return records.withColumn("reason", bad).filter("reason is not null").select("key", "reason", F.sha2("body", 256).alias("payload_hash"))


def first_wins(*tables: DataFrame, key: str) -> DataFrame:
    """Rows of all tables, of each key those of the first table that has it; within a table the last by ``key`` and row text stays."""
    every = None
    for rank, t in enumerate(tables):
        t = t.withColumn("_rank", F.lit(rank))
        every = t if every is None else every.unionByName(t)
    whole = F.to_json(F.struct(*[c for c in every.columns if c != "_rank"]))
    place = F.row_number().over(W.partitionBy(key).orderBy("_rank", whole.desc()))
    return every.withColumn("_place", place).filter("_place = 1").drop("_place", "_rank")


def deck_file(spark: SparkSession, path: str) -> DataFrame:
    """(line, name, identity, card, qty) of an imported deck file: UTF-8 with or without a mark, quoted cells of several lines, each row
    with the line it starts at. A file without the columns, or over MOST_BYTES, is refused as a whole."""
    size = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
    if size > MOST_BYTES:
        raise ValueError(f"file over {MOST_BYTES} bytes")
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    missing = [c for c in IMPORT_COLUMNS if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    cells = [F.coalesce(F.col(c), F.lit("")) for c in rows.columns]
    wide = 1 + F.length(F.regexp_replace(F.concat_ws("", *cells), r"[^\n]", ""))
    # a file of a few megabytes is one task, in order
    order = W.orderBy("_at")
    rows = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_wide", wide)
    line = 2 + F.coalesce(F.sum("_wide").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.select(line.cast("long").alias("line"), *[F.coalesce(c, F.lit("")).alias(n) for c, n in zip(IMPORT_COLUMNS, ("name", "identity", "card", "qty"), strict=True)])


def paged(pages: DataFrame, limit: int) -> DataFrame:
    """Items of (page, body: a JSON array) up to the first short page. A page's size is that it was sent with, before bad items go."""
    p = pages.withColumn("items", F.from_json("body", "array<string>")).withColumn("n", F.json_array_length("body"))
    last = p.filter((F.col("n") < limit) | F.col("n").isNull()).agg(F.min("page").alias("last"))
    return p.join(F.broadcast(last), (F.col("page") <= F.col("last")) | F.col("last").isNull()).select("page", F.posexplode("items").alias("place", "item"))  # one row


def enveloped(documents: DataFrame) -> DataFrame:
    """(key, status, item) of bodies {"success": ..., "data": [...]}: found items; not_found where success is false and there are none; error
    without a list of data."""
    d = documents.withColumn("e", F.from_json("body", "success boolean, data array<string>"))
    none = F.coalesce(F.size("e.data"), F.lit(-1))
    status = F.when((none <= 0) & ~F.coalesce("e.success", F.lit(True)), "not_found").when(F.col("e.data").isNull(), "error").otherwise("found")
    return d.withColumn("status", status).select("key", "status", F.explode_outer(F.when(F.col("status") == "found", F.col("e.data"))).alias("item"))
