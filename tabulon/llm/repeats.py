"""Removal of passages that occur more than once: every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else.

This is prefix doubling, distributed: positions are named by the bytes that follow them, Spark sorts (name, position), names that occur once
drop out, and the others are named anew from pairs of names at a greater offset, until they are past ``LENGTH``. Names are hashes of 64 bits,
so a name needs no other position, and equal strings have equal names in every task. Sorting every position of a corpus in every round would
move many times its size, so rounds do not begin at one byte and the first of them sorts a sample that loses nothing:

1. Names of ``NAME`` bytes (half of LENGTH) are made in the tasks, by a rolling hash. Each string of LENGTH bytes holds ``LENGTH - NAME + 1`` of
   them; the least one stands for it. Equal strings have their least name at the same place, so of all positions only those that are the
   least of some string are sorted, about one in a hundred, each with its run: the strings next to each other that it stands for. Names that
   occur once drop out, and with them their strings.
2. A run with another run of the same name and the same bytes repeats as a whole. Runs left over share a name, not all their bytes: of these,
   and of one run of each kind that they may be held against, the bytes are fetched. They are named anew, by ``BLOCK`` strings at a time:
   what these strings have in common, LENGTH - BLOCK + 1 bytes, is the name. Again unique names drop out, blocks of the same bytes repeat as
   a whole, and the others go on.
3. What is left are single strings, each with the pair of its names at offsets 0 and LENGTH - NAME, which together are LENGTH bytes. The pairs are
   sorted; a string whose pair occurs again is a repeat.
4. The repeats of a document are put together into spans, and what lies between them is kept.

Tables between the rounds are written to the shared folder, and deleted when the next one is there.

Sorts are by ranges and include the position, so equal names of any number are dealt to many tasks; a row is held against its neighbours only,
and against the first and last rows of other ranges. Strings of one document count like those of others, overlapping ones too.

Null texts are empty; texts shorter than LENGTH keep all their bytes. Rows alike in id and text are rows of their own, and repeats of each
other. Texts are bytes, so what is kept need not be UTF-8. The columns of the input stay as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tabulon.llm.common import short_batches, table
from tabulon.storage import shared_folder

LENGTH = 400
#: Bytes of text whose hashes are in memory at a time.
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15
PLACES = np.uint64((1 << 24) - 1)
#: Strings that are named together in the second round.
BLOCK = 16
WHOLE, OPEN, OTHERS = 0, 1, 2
#: Rows of a batch of narrow rows; batches have at most 4 MB besides.
NARROW_ROWS = 20_000
SPANS = "n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Names:
    """Names of any stretches of a buffer, of up to CHUNK bytes and a string: differences of running sums of its bytes by powers of BASE."""

    table = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    up = down = np.empty(0, np.uint64)

    def __init__(self, data: np.ndarray):
        if len(Names.up) <= len(data):
            n = max(len(data) + 1, CHUNK + 2048)
            Names.up, Names.down = powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=self.sums[1:])

    def stretch(self, lo: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return self.mixed((self.sums[stop] - self.sums[lo]) * self.down[lo])

    def all(self, length: int) -> np.ndarray:
        """The name of each stretch of ``length`` bytes, in the order of their places."""
        n = max(0, len(self.sums) - length)
        return self.mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])

    @staticmethod
    def mixed(x: np.ndarray) -> np.ndarray:
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        return x


def least(x: np.ndarray, window: int) -> np.ndarray:
    """The least of each ``window`` neighbours: of the end of one block and the beginning of the next."""
    n = len(x)
    padded = np.full(-(-n // window) * window, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - window + 1], ahead[window - 1 : n])


def chunks(sizes: list[int], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, first, stop): the strings that begin there, of texts of these sizes, as many as a chunk of bytes holds."""
    held, total = [], 0
    for i, size in enumerate(sizes):
        for at in range(0, size - length + 1, CHUNK):
            stop = min(at + CHUNK, size - length + 1)
            if held and total + stop - at + length > CHUNK + length:
                yield held
                held, total = [], 0
            held.append((i, at, stop))
            total += stop - at + length
    if held:
        yield held


def runs(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, lo, hi, name, bytes): runs of strings that one place stands for, from lo to hi, with its name and that of all bytes of the run."""
    half = -(-length // 2)
    for part in chunks([len(t) for t in texts], length):
        data = np.frombuffer(b"".join(texts[i][a : b + length - 1] for i, a, b in part), np.uint8)
        text, first, counts = np.array([p[0] for p in part]), np.array([p[1] for p in part]), np.array([p[2] - p[1] for p in part])
        begins = np.cumsum(counts + length - 1) - (counts + length - 1)
        names = Names(data)
        every = names.all(half)
        place = (every & ~PLACES) | np.arange(len(every), dtype=np.uint64)
        strings = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        stands = (least(place, length - half + 1)[strings] & PLACES).astype(np.int64)
        new = np.flatnonzero((np.diff(stands, prepend=-1) != 0) | (np.diff(strings, prepend=-1) != 1))
        lo, hi = strings[new], strings[np.append(new[1:], len(strings)) - 1]
        of = np.searchsorted(begins, lo, side="right") - 1
        move = first[of] - begins[of]
        yield text[of], lo + move, hi + move, every[stands[new]].view(np.int64), names.stretch(lo, hi + length).view(np.int64)


def named(frames: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Rows of (ref, key, text): ref, key and the document's runs, an array a column."""
    for frame in frames:
        texts = [t or b"" for t in frame["text"]]
        found = [[], [], [], []]
        owner = []
        for text, *columns in runs(texts, length):
            owner.append(text)
            for held, column in zip(found, columns, strict=True):
                held.append(column)
        if owner:
            owner = np.concatenate(owner)
            cuts = np.searchsorted(owner, np.arange(1, len(texts)))
            found = [np.split(np.concatenate(c), cuts) for c in found]
        else:
            found = [[np.empty(0, np.int64)] * len(texts)] * 4
        out = pd.DataFrame({"ref": frame["ref"], "key": frame["key"]})
        for name, column in zip(("lo", "hi", "name", "bytes"), found, strict=True):
            out[name] = pd.Series(list(column), index=out.index, dtype=object)
        yield out


def neighbours(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, slice, bool, bool]]:
    """Frames of sorted rows with one row of context on each side: the frame, its own rows, whether they begin and end the partition."""
    held = None
    begins = True
    for frame in frames:
        if not len(frame):
            continue
        now = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if len(now) - (not begins) >= 2:
            own = slice(0 if begins else 1, len(now) - 1)
            yield now, own, begins, False
            held, begins = now.iloc[-2:], False
        else:
            held = now
    if held is not None:
        yield held, slice(0 if begins else 1, len(held)), begins, True


def kinds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of (name, bytes, ref, lo, hi), sorted: WHOLE where another run has the same bytes; OPEN where others have the name only; OTHERS,
    besides, for the first of WHOLE runs that others of the name may be held against. Where a row's neighbours are in another range, it is
    opened: its strings then find theirs."""
    for now, own, begins, ends in neighbours(frames):
        same_name = np.diff(now["name"].to_numpy()) == 0
        same = same_name & (np.diff(now["bytes"].to_numpy()) == 0)
        before, after = np.r_[False, same], np.r_[same, False]
        name_before, name_after = np.r_[begins, same_name], np.r_[same_name, True]
        starts = np.flatnonzero(~before)
        # whether the class that begins at each start has another of its name before or after it
        others = np.zeros(len(now), bool)
        others[starts] = name_before[starts] | np.append(name_before[starts[1:]], True)
        whole = before | after
        mine = np.zeros(len(now), bool)
        mine[own] = True
        for kind, rows in ((WHOLE, whole), (OPEN, ~whole & (name_before | name_after)), (OTHERS, whole & others)):
            part = now.loc[rows & mine].drop(columns=["name", "bytes"])
            part["kind"] = kind
            yield part


def fetched(frames: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Rows of (ref, text, runs) as (ref, run, last, data): the bytes of each run, by its first and last string."""
    for frame in frames:
        rows = [(ref, r["lo"], r["hi"], text[r["lo"] : r["hi"] + length]) for ref, text, rs in zip(frame["ref"], frame["text"], frame["runs"], strict=True) for r in rs]
        yield pd.DataFrame(rows, columns=["ref", "run", "last", "data"])


def batches(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Parts of about a chunk of ``data``."""
    part = frame["data"].str.len().cumsum() // CHUNK
    yield from (rows for _, rows in frame.groupby(part.to_numpy()))


def expanded(counts: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def blocks(frames: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """fetched() rows as (name, bytes, ref, lo, hi, run): their strings by BLOCK, counted back from the place that stands for the run, so that
    equal strings are in blocks of one number. A block is named by what all strings of its number have in common."""
    half = -(-length // 2)
    for frame in frames:
        for part in batches(frame):
            sizes = part["data"].str.len().to_numpy()
            begins = np.cumsum(sizes) - sizes
            names = Names(np.frombuffer(b"".join(part["data"]), np.uint8))
            every = names.all(half) & ~PLACES
            place = np.array([np.argmin(every[b : b + length - half + 1]) for b in begins])
            run, last = part["run"].to_numpy(), part["last"].to_numpy()
            least_back, most_back = place - (last - run), place
            first = least_back // BLOCK
            counts = most_back // BLOCK - first + 1
            of = np.repeat(np.arange(len(part)), counts)
            number = first[of] + expanded(counts)
            lo = np.maximum(0, place[of] - number * BLOCK - BLOCK + 1)
            hi = np.minimum((last - run)[of], place[of] - number * BLOCK)
            at, common = begins[of], begins[of] + place[of] - number * BLOCK
            sign = number.astype(np.uint64) * np.uint64(2)
            yield pd.DataFrame({
                "name": Names.mixed(names.stretch(common, common + length - BLOCK + 1) ^ sign).view(np.int64),
                "bytes": Names.mixed(names.stretch(at + lo, at + hi + length) ^ (place[of] - lo).astype(np.uint64)).view(np.int64),
                "ref": part["ref"].to_numpy()[of], "lo": run[of] + lo, "hi": run[of] + hi, "run": run[of],
            })


def strings(frames: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Rows of (ref, run, data, blocks) as (one, two, ref, at, asks): each string of the blocks by the names of its halves."""
    half = -(-length // 2)
    for frame in frames:
        for part in batches(frame):
            sizes = part["data"].str.len().to_numpy()
            begins = np.cumsum(sizes) - sizes - part["run"].to_numpy()
            every = Names(np.frombuffer(b"".join(part["data"]), np.uint8)).all(half).view(np.int64)
            of = np.repeat(np.arange(len(part)), part["blocks"].str.len())
            lo, hi, kind = (np.array([r[c] for rs in part["blocks"] for r in rs]) for c in ("lo", "hi", "kind"))
            counts = hi - lo + 1
            at = np.repeat(lo, counts) + expanded(counts)
            place = np.repeat(begins[of], counts) + at
            yield pd.DataFrame({"one": every[place], "two": every[place + length - half], "ref": np.repeat(part["ref"].to_numpy()[of], counts), "at": at.astype(np.int32), "asks": np.repeat(kind == OPEN, counts)})


def repeated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows (one, two, ref, at, asks), sorted: those that ask and have a like neighbour, and the first and last row of the partition."""
    for now, own, begins, ends in neighbours(frames):
        same = (np.diff(now["one"].to_numpy()) == 0) & (np.diff(now["two"].to_numpy()) == 0)
        found = np.r_[False, same] | np.r_[same, False]
        edge = np.zeros(len(now), bool)
        if begins:
            edge[0] = True
        if ends:
            edge[-1] = True
        mine = np.zeros(len(now), bool)
        mine[own] = True
        yield now.assign(found=found, edge=edge)[mine & (edge | (found & now["asks"].to_numpy()))]


def identity(docs: DataFrame, key: str, text: str) -> Column:
    """Digest of id and text: rows that share it have one result."""
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("binary"), 256))


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, runs): for each text that holds repeats, by its identity(), the (lo, hi) of the strings that repeat: all from lo to hi."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/repeats-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    def deleted(name: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def judged(rows: DataFrame, name: str) -> DataFrame:
        order = ["name", "bytes", "ref", "lo"]
        kept = [c for c in rows.columns if c not in ("name", "bytes")]
        schema = ", ".join([f"{c} {t}" for c, t in rows.select(*kept).dtypes] + ["kind int"])
        return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(kinds, schema), name)

    texts = docs.select(identity(docs, key, text).alias("key"), F.col(f"`{text}`").cast("binary").alias("text")).filter(F.octet_length("text") >= length)
    short_batches(spark)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    names = texts.withColumn("ref", F.monotonically_increasing_id()).mapInPandas(lambda frames: named(frames, length), "ref long, key binary, lo array<int>, hi array<int>, name array<long>, bytes array<long>")
    names = written(names, "names")
    keys = written(names.select("ref", "key"), "keys")
    try:
        spark.conf.set(setting, str(NARROW_ROWS))
        runs = names.select("ref", F.explode(F.arrays_zip("lo", "hi", "name", "bytes")).alias("r")).select("r.name", "r.bytes", "ref", "r.lo", "r.hi")
        first = judged(runs, "first")
        deleted("names")
        spark.conf.set(setting, before)
        open_runs = first.filter(F.col("kind") != WHOLE).groupBy("ref").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
        open_runs = open_runs.join(keys, "ref").join(texts, "key").select("ref", "text", "runs")
        data = written(open_runs.mapInPandas(lambda frames: fetched(frames, length), "ref long, run int, last int, data binary"), "data")
        spark.conf.set(setting, str(NARROW_ROWS))
        second = judged(data.mapInPandas(lambda frames: blocks(frames, length), "name long, bytes long, ref long, lo int, hi int, run int"), "second")
        opened = second.filter(F.col("kind") != WHOLE).groupBy("ref", "run").agg(F.collect_list(F.struct("lo", "hi", "kind")).alias("blocks"))
        opened = data.join(opened, ["ref", "run"]).select("ref", "run", "data", "blocks")
        single = opened.mapInPandas(lambda frames: strings(frames, length), "one long, two long, ref long, at int, asks boolean")
        order = ["one", "two", "ref", "at"]
        found = written(single.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(repeated, "one long, two long, ref long, at int, asks boolean, found boolean, edge boolean"), "found")
        deleted("data")
    finally:
        spark.conf.set(setting, before)
    # like rows at the edges of ranges: two a range at most
    edges = found.filter("edge").groupBy("one", "two").agg(F.count("*").alias("n")).filter("n > 1").select("one", "two", F.lit(True).alias("again"))
    at_edges = found.filter("edge and asks").join(F.broadcast(edges), ["one", "two"], "left").filter("found or again").select("ref", "at", "at")
    whole = first.select("ref", "lo", "hi", "kind").union(second.select("ref", "lo", "hi", "kind")).filter(F.col("kind") == WHOLE).drop("kind")
    every = whole.union(found.filter("not edge").select("ref", "at", "at")).union(at_edges)
    one_each = keys.groupBy("key").agg(F.min("ref").alias("ref"))
    return every.groupBy("ref").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")).join(one_each, "ref").select("key", "runs")


def spans(lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches (start, stop) covered by strings that begin from lo to hi."""
    order = np.argsort(lo, kind="stable")
    lo, stop = lo[order], np.maximum.accumulate(hi[order] + length)
    new = np.flatnonzero(np.r_[True, lo[1:] > stop[:-1]])
    return lo[new], stop[np.append(new[1:], len(lo)) - 1]


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with a struct ``_repeats``: n_bytes, spans (start, stop) that are removed, and the bytes that are kept."""

    @pandas_udf(SPANS)
    def kept(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for data, rs in zip(texts, runs, strict=True):
            data = data or b""
            if rs is None or not len(rs):
                out.append((len(data), [], data))
                continue
            start, stop = spans(np.array([r["lo"] for r in rs], np.int64), np.array([r["hi"] for r in rs], np.int64), length)
            rest = b"".join(data[a:b] for a, b in zip(np.r_[0, stop], np.r_[start, len(data)], strict=True))
            out.append((len(data), [{"start": a, "stop": b} for a, b in zip(start.tolist(), stop.tolist(), strict=True)], rest))
        return pd.DataFrame(out, columns=["n_bytes", "spans", "kept"])

    found = repeats(docs, key, text, length).select(F.col("key").alias("_key"), F.col("runs").alias("_runs"))
    joined = docs.withColumn("_key", identity(docs, key, text)).join(found, "_key", "left")
    return joined.withColumn("_repeats", kept(F.col(f"`{text}`").cast("binary"), F.col("_runs"))).select(*[f"`{c}`" for c in docs.columns], "_repeats")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_repeats.*")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# texts as hexadecimal digits, two a byte; cut into blocks first, as reaching far into a string takes long
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS id, doc_id, hex(coalesce(text, '')) AS digits, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents),
b AS (SELECT id, first, least(256, n_bytes - 399 - first) AS n, substr(digits, 2 * first + 1, 1310) AS digits FROM
      (SELECT id, digits, n_bytes, unnest(range(0, n_bytes - 399, 256)) AS first FROM d WHERE n_bytes >= 400)),
s AS (SELECT id, first + j AS pos, md5(substr(digits, 2 * j + 1, 800)) AS string FROM (SELECT id, first, digits, unnest(range(n)) AS j FROM b)),
r AS (SELECT id, pos FROM s WHERE string IN (SELECT string FROM s GROUP BY string HAVING count(*) > 1)),
g AS (SELECT id, pos, sum(CASE WHEN pos - before <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY pos) AS span FROM
      (SELECT *, lag(pos) OVER (PARTITION BY id ORDER BY pos) AS before FROM r)),
p AS (SELECT id, span, min(pos) AS start, max(pos) + 400 AS stop FROM g GROUP BY id, span),
q AS (SELECT p.*, coalesce(lag(stop) OVER (PARTITION BY id ORDER BY start), 0) AS since FROM p),
k AS (SELECT id, sum(stop - start)::BIGINT AS n_removed, count(*) AS n_spans, max(stop) AS stop,
             string_agg(substr(digits, 2 * since + 1, 2 * (start - since)), '' ORDER BY start) AS kept FROM q JOIN d USING (id) GROUP BY id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(digits, 2 * coalesce(stop, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN k USING (id)
"""
