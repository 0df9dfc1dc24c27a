"""Embedding near-duplicates by product quantisation over inverted lists.

Vectors are normalised in double precision. The lists are the cells of a residual quantiser: the nearest centroid of a first codebook, then
that of what it leaves in the next one, so ``k`` centroids a level, fitted on a bounded sample, give ``k * k`` lists or more. Their number
grows with the rows, so that a list holds about ``PER_LIST`` vectors at any size and a vector is held against a bounded number of others.

Each vector is a member of its nearest list, where its whole vector goes once. To its ``PROBES`` nearest lists goes its code only: a byte a
subspace of its residual to that list, with the length of what the code leaves out. There the distances between the members and the codes
are looked up in the members' own tables (asymmetric distances). A vector can link to a member only if that distance is at most ``reach``,
the largest distance of two unit vectors that link, plus what its code leaves out (triangle inequality), so this step loses nothing.
Vectors are fetched for what remains only, and reranked by exact cosine.

A link is found if either vector's probes hold the other's list. One that both find is counted once for each end where that end asks; one
that only one of them finds is counted for both there. So found links are symmetric. Recall is below 1 only where neither list is probed.
The hardest links, of cosine 0.90 to 0.92 among vectors without any clusters, need more probes the more lists there are: ``growing()`` keeps
0.96 and more of them found at 256 to 100,000 lists (a test measures it), where 16 probes would find 0.99 down to 0.87.
``probes=None`` probes all lists and is exact, at the cost of all pairs of codes.

A list of any size is cut into blocks of members and chunks of codes; a task has one of each. It returns the members and codes that may
link, then for each vector the number of links and one edge to the least vector of its piece of the block's links, never all pairs. Vectors
that are null, zero or hold null or non-finite components link with nothing; those of another number of components are compared among
themselves. Rows with equal vectors are counted once with their number; a null vec_id is an id of its own kind and never the least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import checkpointed, connected_components, short_batches, table
from tabulon.storage import small

COSINE = 0.9
#: Vectors that the quantisers are fitted on, about; chosen by a hash of the vector.
SAMPLE = 20_000
#: Lists that each vector is looked for in. Recall for pairs of cosine 0.90 to 0.92 is measured in the tests and the README.
PROBES = 16
#: Up to so many lists PROBES of them are enough; beyond, probes grow with the fourth root of the lists.
ENOUGH_LISTS = 1_024
PER_LIST, LEAST, MOST = 256, 4, 1_024
SUBSPACES, CODES = 16, 256
BLOCK, CHUNK = 512, 8_192


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.empty(len(x), dtype=np.int64)
        for at in range(0, len(x), 4096):
            near[at : at + 4096] = ((centre * centre).sum(axis=1) - 2 * x[at : at + 4096] @ centre.T).argmin(axis=1)
        order = np.argsort(near, kind="stable")
        used, starts = np.unique(near[order], return_index=True)
        centre[used] = np.add.reduceat(x[order], starts, axis=0) / np.diff(starts, append=len(x))[:, None]
    return centre


def spread(x: np.ndarray, cosine: float) -> np.ndarray:
    """The rows without those that link to an earlier one: a group of copies would draw centroids into itself."""
    keep, narrow = np.ones(len(x), dtype=bool), x.astype(np.float32)
    for at in range(0, len(x), 1024):
        part = narrow[at : at + 1024]
        alike = part @ narrow[: at + len(part)].T >= cosine
        keep[at : at + 1024] = ~(alike & (np.arange(at + len(part)) < np.arange(at, at + len(part))[:, None])).any(axis=1)
    return x[keep]


class Quantiser:
    """Codebooks of the lists' levels and of the subspaces of what they leave. Its size depends on the parameters alone."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.size = sample.shape[1]
        levels = 2
        while MOST**levels < lists:
            levels += 1
        k = int(np.clip(np.ceil(lists ** (1 / levels)), LEAST, MOST))
        left, self.books = sample, []
        for level in range(levels):
            book = kmeans(left, k, 1 + level)
            left = left - book[((book**2).sum(axis=1) - 2 * left @ book.T).argmin(axis=1)]
            self.books.append(book)
        self.k = [len(b) for b in self.books]
        self.lists = int(np.prod(self.k))
        self.parts = np.array_split(np.arange(self.size), min(SUBSPACES, self.size))
        # codes stand for residuals to near lists too, not only to the nearest one
        near = np.concatenate([self.near(sample[at : at + 256], min(PROBES, self.lists)) for at in range(0, len(sample), 256)])
        left = np.concatenate([sample - self.centre(near[:, 0]), sample - self.centre(near[:, near.shape[1] // 2])])
        self.codes = [kmeans(left[:, p], CODES, 9 + i) for i, p in enumerate(self.parts)]

    def centre(self, lists: np.ndarray) -> np.ndarray:
        out, left = np.zeros((len(lists), self.size)), lists
        for book in reversed(self.books):
            out += book[left % len(book)]
            left = left // len(book)
        return out

    def near(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest lists of each row, the nearest first, by a beam over the levels."""
        d, path = (x * x).sum(axis=1)[:, None], np.zeros((len(x), 1, 0), dtype=np.int64)
        for level, book in enumerate(self.books):
            s = d[:, :, None] - 2 * (x @ book.T)[:, None, :] + (book**2).sum(axis=1)
            for before in range(level):
                s = s + 2 * (self.books[before] @ book.T)[path[:, :, before]]
            s = s.reshape(len(x), -1)
            wide = min(max(probes, PROBES), s.shape[1])
            top = np.argpartition(s, wide - 1, axis=1)[:, :wide]
            top = np.take_along_axis(top, np.argsort(np.take_along_axis(s, top, axis=1), axis=1, kind="stable"), axis=1)
            d = np.take_along_axis(s, top, axis=1)
            path = np.concatenate([np.take_along_axis(path, (top // len(book))[:, :, None], axis=1), (top % len(book))[:, :, None]], axis=2)
        lists = np.zeros(path.shape[:2], dtype=np.int64)
        for level, k in enumerate(self.k):
            lists = lists * k + path[:, :, level]
        return lists[:, :probes]

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what they leave out."""
        residual = x - self.centre(lists)
        codes, left = np.empty((len(x), len(self.parts)), dtype=np.uint8), np.zeros(len(x))
        for k, (p, book) in enumerate(zip(self.parts, self.codes, strict=True)):
            d = (residual[:, p] ** 2).sum(axis=1)[:, None] + (book**2).sum(axis=1) - 2 * residual[:, p] @ book.T
            codes[:, k] = d.argmin(axis=1)
            left += np.maximum(d.min(axis=1), 0)
        return codes, np.sqrt(left)

    def may_link(self, which: int, members: np.ndarray, codes: np.ndarray, left: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of members, row of codes) of all pairs that can have that cosine, by asymmetric distances."""
        most = (np.sqrt(max(0.0, 2 - 2 * cosine)) + left + 1e-4) ** 2
        residual = members - self.centre(np.full(1, which))
        for at in range(0, len(members), 256):
            part = residual[at : at + 256]
            apart = np.zeros((len(codes), len(part)), dtype=np.float32)
            for k, (p, book) in enumerate(zip(self.parts, self.codes, strict=True)):
                look = (book**2).sum(axis=1)[:, None] + (part[:, p] ** 2).sum(axis=1) - 2 * book @ part[:, p].T
                apart += look.astype(np.float32)[codes[:, k]]
            c, r = np.nonzero(apart <= most[:, None])
            yield r + at, c


def unit(data: pd.Series, kind: str) -> np.ndarray:
    x = np.stack([np.frombuffer(v, dtype=kind) for v in data]).astype(np.float64)
    # scaled first, so that squares neither overflow nor vanish
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fitted(x: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` components, zeros where there are fewer: distances get no larger by it."""
    return x[:, :size] if x.shape[1] >= size else np.pad(x, ((0, 0), (0, size - x.shape[1])))


def linked(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of a link to which of b, by exact cosine."""
    out = np.zeros((len(a), len(b)), dtype=bool)
    for at in range(0, len(a), 256):
        s = a[at : at + 256] @ b.T
        out[at : at + 256] = s >= cosine
        # products of matrices sum in an order of their own, so what is that near the border is summed pair by pair
        r, c = np.nonzero(np.abs(s - cosine) < 1e-9)
        for i in range(0, len(r), 4096):
            x, y = r[i : i + 4096] + at, c[i : i + 4096]
            out[x, y] = np.einsum("ij,ij->i", a[x], b[y]) >= cosine
    return out


def least_of_piece(link: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the ids of the rows and columns, the least id of the piece of the links that each belongs to."""
    while True:
        x, y = a, b
        for at in range(0, len(a), 256):
            part = link[at : at + 256]
            y = np.minimum(y, np.where(part, a[at : at + 256, None], b).min(axis=0))
        x = np.concatenate([np.minimum(a[at : at + 256], np.where(link[at : at + 256], y, a[at : at + 256, None]).min(axis=1)) for at in range(0, len(a), 256)])
        if (x == a).all() and (y == b).all():
            return a, b
        a, b = x, y


def growing(lists: int) -> int:
    """The probes that so many lists need."""
    return max(PROBES, int(np.ceil(PROBES * (lists / ENOUGH_LISTS) ** 0.25)))


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, probes: int | str | None = "growing") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row."""
    spark = rows.sparkSession
    short_batches(spark)
    kind = "<f4" if rows.schema[vector].dataType.elementType == T.FloatType() else "<f8"
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    # 128 bits of hash stand for equal vectors
    same = F.struct(F.xxhash64(v).alias("a"), F.xxhash64(F.lit("b"), v).alias("b"))
    rows = rows.select(F.col(key).alias("vec_id"), F.when(fine, same).alias("same"), F.when(fine, F.col(vector)).alias("v"))
    some = rows.filter("same is not null")
    sizes = some.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"))
    sizes = sizes.agg(F.sum("n").alias("n"), F.max_by("size", F.struct("n", "size")).alias("size")).first()
    if not sizes["n"]:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    size, total = sizes["size"], sizes["n"]
    share = min(1.0, SAMPLE / total)
    picked = some.filter(F.size("v") == size).filter(F.expr(f"(xxhash64('sample', same) & 9223372036854775807) / 9223372036854775807D <= {share}"))
    # a vector of very many copies counts once: a task hands on each vector once
    picked = picked.select("same.a", "same.b", "v").dropDuplicates(["a", "b"]).toPandas().sort_values(["a", "b"])
    data = [np.asarray(x, dtype=kind).tobytes() for x in picked["v"]]
    sample = spread(unit(pd.Series(data), kind), cosine) if data else np.eye(1, size)
    quantiser = spark.sparkContext.broadcast(Quantiser(sample, max(1, total // PER_LIST)))
    lists = quantiser.value.lists
    probed = lists if probes is None else min(growing(lists) if probes == "growing" else probes, lists)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            x = [np.asarray(v, dtype=kind) for v in whole["v"]]
            q, near = quantiser.value, np.empty((len(x), probed), dtype=np.int64)
            lengths = np.array([len(v) for v in x])
            for one in np.unique(lengths):
                of = np.flatnonzero(lengths == one)
                for at in range(0, len(of), 256):
                    i = of[at : at + 256]
                    near[i] = q.near(fitted(unit(pd.Series([x[j].tobytes() for j in i]), kind), size), probed)
            yield pd.DataFrame({"same": whole["same"], "n": whole["n"], "least": whole["least"], "size": lengths, "own": near[:, 0] if len(x) else [], "probes": list(near.astype(np.int32)), "x": [v.tobytes() for v in x]})

    distinct = some.groupBy("same").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    form = T.StructType([distinct.schema["same"], *(T.StructField(n, t) for n, t in (("n", T.LongType()), ("least", distinct.schema["least"].dataType), ("size", T.IntegerType()), ("own", T.IntegerType()), ("probes", T.ArrayType(T.IntegerType())), ("x", T.BinaryType())))])
    dealt = checkpointed(distinct.mapInPandas(deal, form).withColumn("node", F.monotonically_increasing_id()))
    part = ["size", "list", "block", "chunk"]

    def dealt_out(members: DataFrame, askers: DataFrame) -> DataFrame:
        """Rows (size, list, node, ...) of both, in tasks of a block of members and a chunk of askers of a list."""
        stored, asked = members.groupBy("size", "list").agg(F.count("*").alias("stored")), askers.groupBy("size", "list").agg(F.count("*").alias("asked"))
        plan = stored.join(asked, ["size", "list"]).select("size", "list", F.ceil(F.col("stored") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("asked") / CHUNK).cast("int").alias("chunks"))
        # by far the most lists have one task, so only the others are joined by
        plan = small(checkpointed(plan.filter("blocks > 1 or chunks > 1")))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
        of = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "node"), F.coalesce(n, F.lit(1))).cast("int")
        a = members.join(plan, ["size", "list"], "left").withColumn("block", of("blocks", "block")).withColumn("chunk", every("chunks")).withColumn("role", F.lit(0))
        b = askers.join(plan, ["size", "list"], "left").withColumn("block", every("blocks")).withColumn("chunk", of("chunks", "chunk")).withColumn("role", F.lit(1))
        return a.drop("blocks", "chunks").unionByName(b.drop("blocks", "chunks"))

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for _, batch in whole.groupby("size", sort=False):
                for at in range(0, len(batch), 256):
                    b = batch.iloc[at : at + 256]
                    lists, row = np.array(b["list"], dtype=np.int64), fitted(unit(b["x"], kind), size)
                    codes, left = quantiser.value.encode(row, lists)
                    yield pd.DataFrame({"size": b["size"], "list": b["list"], "block": b["block"], "chunk": b["chunk"], "role": b["role"], "node": b["node"], "x": [c.tobytes() for c in codes], "left": left})

    members = dealt.select("size", F.col("own").alias("list"), "node", "x")
    askers = dealt.select("size", F.explode("probes").alias("list"), "node", "x")
    tasks = dealt_out(members, askers)
    form = "size int, list int, block int, chunk int, role int, node long, x binary, left double"
    tasks = tasks.filter("role = 0").select(*part, "role", "node", "x", F.lit(0.0).alias("left")).union(tasks.filter("role = 1").select(*part, "role", "node", "x").mapInPandas(coded, form))

    def look_up(at: tuple, group: pd.DataFrame) -> pd.DataFrame:
        here, codes = group[group["role"] == 0], group[group["role"] == 1]
        out = [[], []]
        if len(here) and len(codes):
            nodes, others = here["node"].to_numpy(), codes["node"].to_numpy()
            known = np.stack([np.frombuffer(c, dtype=np.uint8) for c in codes["x"]])
            for r, c in quantiser.value.may_link(int(at[1]), fitted(unit(here["x"], kind), size), known, codes["left"].to_numpy(), cosine):
                other = nodes[r] != others[c]
                out[0].append(nodes[np.unique(r[other])])
                out[1].append(others[np.unique(c[other])])
        ends = [np.unique(np.concatenate(x)) if x else np.zeros(0, dtype=np.int64) for x in out]
        return pd.DataFrame({"size": at[0], "list": at[1], "role": np.repeat([0, 1], [len(e) for e in ends]), "node": np.concatenate(ends)})

    close = tasks.groupBy(*part).applyInPandas(look_up, "size int, list int, role int, node long").distinct()
    fetched = checkpointed(close.join(dealt.select("node", "n", "own", "probes", "x"), "node"))
    tasks = dealt_out(fetched.filter("role = 0").drop("role"), fetched.filter("role = 1").drop("role"))

    def rerank(at: tuple, group: pd.DataFrame) -> pd.DataFrame:
        block, chunk = group[group["role"] == 0], group[group["role"] == 1]
        if not len(block) or not len(chunk):
            return pd.DataFrame({"node": [], "links": [], "to": []}).astype("int64")
        here, there = chunk["node"].to_numpy(), block["node"].to_numpy()
        link = linked(unit(chunk["x"], kind), unit(block["x"], kind), cosine) & (here[:, None] != there)
        r, c = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
        if not len(r):
            return pd.DataFrame({"node": [], "links": [], "to": []}).astype("int64")
        link, chunk, block, here, there = link[np.ix_(r, c)], chunk.iloc[r], block.iloc[c], here[r], there[c]
        # the member finds the link too if it probes the asker's list
        own, near, both = chunk["own"].to_numpy(), np.stack(list(block["probes"])), np.zeros(link.shape, dtype=bool)
        for k in range(near.shape[1]):
            both |= own[:, None] == near[:, k]
        links = [link @ block["n"].to_numpy(), (link & ~both).T @ chunk["n"].to_numpy()]
        return pd.DataFrame({"node": np.concatenate([here, there]), "links": np.concatenate(links), "to": np.concatenate(least_of_piece(link, here, there))})

    found = checkpointed(tasks.groupBy(*part).applyInPandas(rerank, "node long, links long, to long"))
    roots = connected_components(found, "node", "to").withColumnRenamed("node", "id")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = dealt.select("same", "node", "n", "least").join(counts, "node", "left").join(roots, F.col("node") == F.col("id"), "left").withColumn("root", F.coalesce("root", "node"))
    known = known.join(known.groupBy("root").agg(F.min("least").alias("component")), "root").select("same", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component")
    out = rows.select("vec_id", "same", F.col("same").isNotNull().alias("fine")).join(known, "same", "left")
    component = F.when(F.col("fine") & F.col("component").isNotNull(), F.col("component")).otherwise(F.col("vec_id"))
    links = F.when(F.col("fine"), F.coalesce("links", F.lit(0))).otherwise(0).cast("long")
    return out.select("vec_id", links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS r FROM embeddings
           WHERE len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.r > 0 AND b.r > 0
      WHERE list_dot_product(a.v, b.v) / (a.r * b.r) >= 0.9),
t AS (WITH RECURSIVE t(id, node) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT t.id, p.b FROM t JOIN p ON p.a = t.node) SELECT id, min(node) AS component_id FROM t GROUP BY id)
SELECT e.vec_id, (SELECT count(*) FROM p WHERE p.a = e.vec_id) AS n_links, t.component_id, e.vec_id = t.component_id AS kept
FROM embeddings e JOIN t ON t.id = e.vec_id
"""
