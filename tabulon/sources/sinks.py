"""Writers: canonical tables in key order, JSON records that changed, published versions with their manifest, imports by partition."""

from __future__ import annotations

import json
import os
import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.ratios import rounded
from tabulon.sources.schemas import CANONICAL, PRIMARY_KEYS

MOST_SLICE_BYTES = 2_000_000


def write_canonical(table: DataFrame, name: str, folder: str) -> None:
    """The table's declared columns in order of its key: dealt by ranges of it, sorted within, so any number of tasks writes."""
    columns = [c.split()[0] for c in CANONICAL[name].split(", ")]
    table.select(columns).sort(*PRIMARY_KEYS[name]).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def record_hash(fields: list[str], volatile: tuple[str, ...] = ("fetched_at", "record_hash")):
    """Of the fields in order of their names, without those that change with each fetch."""
    return F.sha2(F.to_json(F.struct(*sorted(f for f in fields if f not in volatile)), {"ignoreNullFields": "false"}), 256)


def append_changed(records: DataFrame, key: str, path: str, stored: DataFrame) -> DataFrame:
    """Appends as JSON the records whose hash is not the stored one of their key, and returns them."""
    r = records.withColumn("record_hash", record_hash(records.columns))
    changed = r.join(stored.select(key, "record_hash"), [key, "record_hash"], "left_anti")
    changed.write.mode("append").json(path)
    return changed


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def claimed_version(spark: SparkSession, root: str, now: datetime) -> str:
    """The first second from now on that no version has, claimed by creating its mark, which one writer alone can."""
    while not put_if_absent(spark, f"{root}/{(name := now.strftime('%Y%m%dT%H%M%SZ'))}/_claimed", "claimed"):
        now += timedelta(seconds=1)
    return name


def _renamed(spark: SparkSession, text: str, path: str, replace: bool) -> bool:
    """The text as a file that is there whole or not at all: written beside, then renamed, over an old one or only where there is none. False
    where there is one. Renaming is one step in HDFS and like stores; a local disk has steps of its own for it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs, to = file_system(spark, path)
    local = fs.getUri().getScheme() == "file"
    raw = fs.getRawFileSystem() if local else fs
    beside = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(to.getParent(), f"_{uuid.uuid4().hex}"))
    to = fs.makeQualified(to)
    out = raw.create(beside)
    out.write(text.encode())
    out.close()
    try:
        if local:
            (os.replace if replace else os.link)(beside.toUri().getPath(), to.toUri().getPath())
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "OVERWRITE" if replace else "NONE")
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(beside, to, options)
    except (FileExistsError, Py4JJavaError) as error:
        if replace or "FileAlreadyExists" not in str(getattr(error, "java_exception", "FileAlreadyExists")):
            raise
        return False
    finally:
        raw.delete(beside, False)
    return True


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Creates the file; False where it is there already. Of two writers at most one gets True."""
    return not exists(spark, path) and _renamed(spark, text, path, replace=False)


def overwrite(spark: SparkSession, path: str, text: str) -> None:
    _renamed(spark, text, path, replace=True)


def contents(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None where there is none."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def current(spark: SparkSession, root: str) -> str | None:
    text = contents(spark, f"{root}/manifest")
    return json.loads(text)["version"] if text else None


def advance(spark: SparkSession, root: str) -> str | None:
    """Brings the manifest up to the last version that was committed, also where its writer stopped before, and returns that version."""
    while (text := contents(spark, f"{root}/_after/{(version := current(spark, root)) or 'nothing'}")) is not None:
        overwrite(spark, f"{root}/manifest", contents(spark, f"{root}/{text}/manifest"))
    return version


def json_number(c, digits: int = 4):
    """A number as JSON text: whole ones without a fraction, others rounded by their exact binary value, never with an exponent."""
    return F.regexp_replace(rounded(c.cast("double"), digits).cast("decimal(38,10)").cast("string"), r"\.?0+$", "")


def json_rows(df: DataFrame, digits: dict[str, int] | None = None) -> DataFrame:
    """(value): each row as JSON, nulls included, its columns in their order; doubles and decimals by json_number()."""
    parts = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        number = json_number(c, (digits or {}).get(name, 4)) if kind in ("double", "float") or kind.startswith("decimal") else None
        value = F.coalesce(number, F.lit("null")) if number is not None else F.regexp_replace(F.to_json(F.array(c), {"ignoreNullFields": "false"}), r"^\[|\]$", "")
        parts.append(F.concat(F.lit(json.dumps(name, ensure_ascii=False) + ":"), value))
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("value"))


def publish(spark: SparkSession, slices: dict[str, DataFrame], root: str, now: datetime, errors: list[str] = (), manifest: dict | None = None, digits: dict[str, int] | None = None) -> str:
    """Writes each slice as JSON below a new version and commits it. With errors nothing is published. A slice over MOST_SLICE_BYTES is one.

    A version's folder never changes. It is committed by naming it the one after the version that is current, in a file that one writer alone
    can create; then the manifest is replaced by one rename, so readers have the old or the new one at any time. A writer that stops leaves
    the old version, or, once committed, its own for the next writer to bring up. A version older than the current one is not committed.
    """
    if errors:
        raise ValueError("; ".join(errors))
    version = claimed_version(spark, root, now)

    def write(name: str) -> None:
        rows = json_rows(slices[name], digits)
        if (rows.agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0) > MOST_SLICE_BYTES:
            raise ValueError(f"{name}: over {MOST_SLICE_BYTES} bytes")
        rows.write.text(f"{root}/{version}/{name}")

    with ThreadPoolExecutor(8) as pool:  # jobs of small slices side by side
        list(pool.map(write, sorted(slices)))
    overwrite(spark, f"{root}/{version}/manifest", json.dumps((manifest or {}) | {"version": version, "slices": sorted(slices)}, ensure_ascii=False))
    while True:
        before = advance(spark, root)
        if before is not None and before >= version:
            raise ValueError(f"{before} was published meanwhile; {version} is older")
        if put_if_absent(spark, f"{root}/_after/{before or 'nothing'}", version):
            advance(spark, root)
            return version


def csv_cells(df: DataFrame) -> DataFrame:
    """df as text that a spreadsheet takes for text: a cell that begins like a formula gets an apostrophe before it; numbers stay as they are."""
    cell = lambda c: F.when(c.rlike(r"^\s*[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
    return df.select([cell(F.col(f"`{n}`")).alias(n) if t == "string" else F.col(f"`{n}`").cast("string").alias(n) for n, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    """Result tables as CSV files with a header, quoted where needed, nulls empty."""
    csv_cells(df).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def replace_imports(decks: DataFrame, path: str, imported: DataFrame | None = None) -> None:
    """Each event's import replaces its last one; other events stay as they are. ``imported`` names all events (cobra_id) of this import:
    of those without a deck now nothing is left."""
    decks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cobra_id").parquet(path)
    if imported is not None:
        for row in imported.select("cobra_id").distinct().join(decks.select("cobra_id"), "cobra_id", "left_anti").toLocalIterator():
            fs, folder = file_system(decks.sparkSession, f"{path}/cobra_id={row[0]}")
            fs.delete(folder, True)


def insert_if_absent(new: DataFrame, stored: DataFrame, key: str = "hash") -> DataFrame:
    """Rows to append: of each key that is not stored yet, the one of the least text."""
    rows = new.join(stored.select(key), key, "left_anti")
    first = F.min(F.struct(*[c for c in rows.columns if c != key])).alias("r")
    return rows.groupBy(key).agg(first).select(key, "r.*").select(new.columns)
