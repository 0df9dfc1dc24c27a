"""The corpus pipeline: language ID, SimHash near-dedup, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; encoded() writes each as Parquet into the shared folder named in
``spark.checkpoint.dir`` and reads it again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import bpe, langid, mixing, simhash
from tabulon.llm.common import checkpointed, table

#: A text stays if the model is at least so sure of its language.
SURE = 0.5
#: And if its n-grams are not much less likely in that language than those the model learnt from. At sf0.01 the greatest gap of 1,000 texts
#: was 1.6 and of 1, 2, 3 and 5 words cut once at random from each 2.7; the least of 2,400 texts of 10 or 100 random words, of Latin, Cyrillic
#: or Han letters, was 3.3.
FAR = 3.2

#: Rows up to which the list of those that go is broadcast.
MOST_LISTED = 200_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters, those whose language the model is not sure of and those unlike what it learnt of that language. The
    model learns from docs' own labels."""
    model = langid.fit(docs)
    judged = docs.withColumn("_p", langid.predict(spark, model, F.col("text")))
    return judged.filter((F.col("_p.lang_pred") != langid.UNKNOWN) & (F.col("_p.score") >= SURE) & (F.col("_p.gap") <= FAR)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: of the least doc_id, and of rows with that id the one of the least hash; of equal rows, one. Rows with a
    null id stay only where nothing else in their group has an id.

    What goes is decided on narrow rows (a 128-bit hash a row, so null and repeated ids are rows like any other). Texts are shuffled only
    where the rows that go, or are equal, are more than MOST_LISTED; else their list is broadcast.
    """
    columns = [x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))]
    hashed = docs.withColumn("_h1", F.xxhash64(*columns)).withColumn("_h2", F.xxhash64(F.lit("second"), *columns))
    rows = simhash.near_duplicates(hashed, also=("_h1", "_h2")).groupBy("root", "doc_id", "_h1", "_h2").agg(F.count("*").alias("_n"))
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "_h1", "_h2")
    groups = rows.groupBy("root").agg(F.min(place).alias("first"), F.sum("_n").alias("_all")).filter("_all > 1").select("root", F.col("first._h1").alias("_f1"), F.col("first._h2").alias("_f2"))
    # of the rows of larger groups: whether they are the one that stays, and whether there are more of its like
    listed = rows.join(groups, "root").select("_h1", "_h2", ((F.col("_h1") == F.col("_f1")) & (F.col("_h2") == F.col("_f2"))).alias("_stays"), "_n")
    listed = checkpointed(listed.filter("not _stays or _n > 1"))
    few = listed.limit(MOST_LISTED + 1).count() <= MOST_LISTED
    judged = hashed.join(F.broadcast(listed) if few else listed.hint("shuffle_hash"), ["_h1", "_h2"], "left")
    once = judged.filter("_stays is null").select(docs.columns)
    return once.union(judged.filter("_stays").dropDuplicates(["_h1", "_h2"]).select(docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each repetition that the mix takes; of the document at a source's border the last one holds its first words only. Words are
    counted once for the sources' sizes and once where rows are written: that costs less than to write and read all texts once more."""
    rows = mixing.measured(docs)
    rows = mixing.take(rows, mixing.rates(rows.select("_row.*"), mixing.three_one_two)).filter("_mix.taken > 0")
    rows = rows.select("*", F.col("_mix.size").alias("_size"), F.col("_mix.taken").alias("_taken"))
    copies = F.sequence(F.lit(1).cast("long"), F.ceil(F.col("_taken") / F.col("_size")))
    left = F.least(F.col("_size"), F.col("_taken") - (F.col("_copy") - 1) * F.col("_size"))
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.when(F.col("_left") == F.col("_size"), F.col("text")).otherwise(F.array_join(F.slice(pieces, 1, F.col("_left").cast("int")), ""))
    rows = rows.withColumn("_copy", F.explode(copies)).withColumn("_left", left).withColumn("text", cut)
    return rows.withColumn("n_chars", F.when(F.col("_left") < F.col("_size"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, little-endian in four bytes each, and the digests of them and of what they decode to."""
    tokens = bpe.default_tokenizer(spark)
    return docs.select("doc_id", "lang", "source", tokens.encode_and_decode(F.col("text")).alias("b")).select("doc_id", "lang", "source", *bpe.digests(F.col("b.ids"), F.col("b.decoded")), F.col("b.ids").alias("ids"))


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("mixing", mixture), ("byte-level BPE", encode)]

#: Language ID and BPE have no SQL form, so neither has the whole; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's product: the last stage's Parquet, token ids included."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-pipeline-")
    folder = f"{folder}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product without the ids, which only encoded() and the Parquet hold."""
    return encoded(spark, sf_dir).drop("ids")
