"""Byte-level BPE encoding and decoding with a public rank file.

Texts are split by the tokenizer's pattern; every distinct piece that is no token itself is merged in numpy. Pieces of similar
length form padded matrices of token ids, one row a piece. Each round every row merges its leftmost pair of least rank: ranks of
neighbouring ids come from an open-addressing hash table over all pairs that form a token, the row closes the gap, and rows without
a mergeable pair leave the matrix. Rows longer than ``WIDEST`` bytes would take a quadratic number of steps, so they take the same
merges from a heap.

Ids are packed as little-endian unsigned 32-bit integers in one binary value a text, the form in which token shards are stored.
Null and empty texts give empty ids; decoding null gives null; unknown ids raise.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tabulon.llm.common import blocks, short_batches, table

NONE = np.int32(2**31 - 1)
WIDEST = 256
CELLS = 1 << 16
FEW = 32
#: Distinct pieces that a worker remembers; when full it forgets them all, which costs time only.
REMEMBERED = 100_000
#: A text of more characters is split in several steps, so that its pieces are never all in memory.
LONG = 4_000_000
CHUNK = 200_000


class ByteBpe:
    """ranks: token bytes -> rank, with all 256 single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.known: dict[str, bytes] = {}
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left = ranks.get(token[:k])
                if left is not None and (right := ranks.get(token[k:])) is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self._fill(np.array(keys, dtype=np.int64), np.array(values, dtype=np.int32))
        every = np.repeat(self.byte, 256), np.tile(self.byte, 256)
        self.byte_pairs = self.pair_ranks(*every).reshape(256, 256)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        owner = np.full(1 << bits, -1, dtype=np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while left.size:
            free = left[owner[slot[left]] < 0]
            owner[slot[free]] = free
            left = left[owner[slot[left]] != left]
            slot[left] = (slot[left] + 1) & self.mask
        used = owner >= 0
        self.slot_keys = np.full(1 << bits, -1, dtype=np.int64)
        self.slot_ranks = np.full(1 << bits, NONE, dtype=np.int32)
        self.slot_keys[used], self.slot_ranks[used] = keys[owner[used]], values[owner[used]]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where it forms no token or an id is below 0."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slot, out, left = self._slot(keys), np.full(keys.size, NONE, dtype=np.int32), np.flatnonzero(keys >= 0)
        while left.size:
            found = self.slot_keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.slot_ranks[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
            slot[left] = (slot[left] + 1) & self.mask
        return out

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        if len(pieces) <= FEW:  # too few rows to pay for a matrix
            return [self._merge_long(p) for p in pieces]
        out: list = [None] * len(pieces)
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        order = np.argsort(size, kind="stable")
        at = int(np.searchsorted(size[order], 1))
        for i in order[:at]:
            out[i] = np.empty(0, dtype=np.int32)
        while at < len(order):
            least = int(size[order[at]])
            width = least + 3 & ~3 if least <= 32 else 1 << (least - 1).bit_length()
            if width > WIDEST:
                for i in order[at:]:
                    out[i] = self._merge_long(pieces[i])
                break
            end = min(int(np.searchsorted(size[order], width, side="right")), at + max(1, CELLS // width))
            for i, ids in zip(order[at:end], self._merge_rows([pieces[i] for i in order[at:end]], size[order[at:end]], width), strict=True):
                out[i] = ids
            at = end
        return out

    def _merge_rows(self, pieces: list[bytes], size: np.ndarray, width: int) -> list[np.ndarray]:
        flat = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), dtype=np.uint8).reshape(-1, width)
        inside = np.arange(width) < size[:, None]
        ids = np.where(inside, self.byte[flat], np.int32(-1))
        rank = np.full(ids.shape, NONE, dtype=np.int32)  # of each id with the next
        rank[:, :-1] = np.where(inside[:, 1:], self.byte_pairs[flat[:, :-1], flat[:, 1:]], NONE)
        out: list = [None] * len(pieces)
        row = np.arange(len(pieces))
        while row.size:
            n = np.arange(row.size)
            best = rank.argmin(axis=1)
            least = rank[n, best]
            live = least < NONE
            if not live.all():
                over = np.flatnonzero(~live)
                length = (ids[over] >= 0).sum(axis=1)
                for i, k, m in zip(over.tolist(), row[over].tolist(), length.tolist(), strict=True):
                    out[k] = ids[i, :m]
                row, ids, rank, best, least = row[live], ids[live], rank[live], best[live], least[live]
                n = np.arange(row.size)
            if not row.size:
                break
            keep = np.ones(ids.shape, dtype=bool)  # each row merges one pair, so the matrix loses a column
            keep[n, best + 1] = False
            ids = ids[keep].reshape(row.size, -1)
            rank = rank[keep].reshape(row.size, -1)
            ids[n, best] = least
            last = ids.shape[1] - 1
            after = np.where(best < last, ids[n, np.minimum(best + 1, last)], -1)
            rank[n, best] = self.pair_ranks(least, after)
            inner = np.flatnonzero(best)
            rank[inner, best[inner] - 1] = self.pair_ranks(ids[inner, best[inner] - 1], least[inner])
        return out

    @cached_property
    def pairs(self) -> dict[int, int]:
        used = self.slot_keys >= 0
        return dict(zip(self.slot_keys[used].tolist(), self.slot_ranks[used].tolist(), strict=True))

    def _merge_long(self, piece: bytes) -> np.ndarray:
        ids = [int(self.byte[x]) for x in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := self.pairs.get(r << 32 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[after[i]]))
            if (h := before[i]) >= 0 and (x := self.pairs.get(ids[h] << 32 | r)) is not None:
                heapq.heappush(heap, (x, h, ids[h], r))
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def learn(self, words: set[str]) -> None:
        """Afterwards ``known`` has the packed ids of these pieces at least."""
        new = list(words.difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(words)
        data = [w.encode() for w in new]
        rank = [self.ranks.get(b, -1) for b in data]
        apart = [i for i, r in enumerate(rank) if r < 0]
        whole = np.array(rank, dtype="<i4").tobytes()
        self.known.update((w, whole[4 * i : 4 * i + 4]) for i, w in enumerate(new))
        for i, ids in zip(apart, self.merge([data[i] for i in apart]), strict=True):
            self.known[new[i]] = ids.tobytes()

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """The packed ids of each text. New pieces of about CHUNK characters of texts are merged together."""
        at = 0
        while at < len(texts):
            size, words, end = 0, [], at
            while end < len(texts) and size < CHUNK and len(texts[end] or "") <= LONG:
                words.append(self.pattern.findall(texts[end] or ""))
                size += len(texts[end] or "")
                end += 1
            if words:
                self.learn(set().union(*words))
                yield from (b"".join(map(self.known.__getitem__, w)) for w in words)
            else:
                yield self._encode_long(texts[end])
                end += 1
            at = end

    def _encode_long(self, text: str) -> bytes:
        out = []
        for part in blocks((m.group() for m in self.pattern.finditer(text)), 200_000):
            self.learn(set(part))
            out.append(b"".join(map(self.known.__getitem__, part)))
        return b"".join(out)


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {r: t for t, r in ranks.items()}

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def rank_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


_loaded: dict[tuple, ByteBpe | Decoder] = {}


def loaded(data: bytes, pattern: str) -> ByteBpe:
    """One tokenizer a worker process and rank file."""
    key = (hash(data), len(data), pattern)
    if key not in _loaded:
        _loaded[key] = ByteBpe(parse_ranks(data), pattern)
    return _loaded[key]


def decoder(data: bytes) -> Decoder:
    key = (hash(data), len(data))
    if key not in _loaded:
        same = next((x for k, x in _loaded.items() if k[:2] == key and isinstance(x, ByteBpe)), None)
        _loaded[key] = Decoder(same.ranks if same else parse_ranks(data))
    return _loaded[key]


class Tokenizer:
    """Column functions that encode and decode. The rank file is read on the driver and broadcast: its size is that of the vocabulary."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        short_batches(spark)
        self.pattern = pattern
        self.shared = spark.sparkContext.broadcast(rank_file(path))

    def encode(self, text: Column) -> Column:
        """string -> binary: the ids, four bytes each. Null texts give no ids."""
        shared, pattern = self.shared, self.pattern

        @pandas_udf("binary")
        def bpe_encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            bpe = loaded(shared.value, pattern)
            for texts in batches:
                yield pd.Series(list(bpe.encode_all(texts.tolist())), dtype=object)

        return bpe_encode(text)

    def encode_and_decode(self, text: Column) -> Column:
        """string -> struct(ids, decoded): what encode() gives, and what decode() gives of that, from one Python worker instead of two."""
        shared, pattern = self.shared, self.pattern

        @pandas_udf("ids binary, decoded binary")
        def bpe_round_trip(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            bpe, back = loaded(shared.value, pattern), decoder(shared.value)
            for texts in batches:
                ids = list(bpe.encode_all(texts.tolist()))
                yield pd.DataFrame({"ids": ids, "decoded": [back.decode(x) for x in ids]}, dtype=object)

        return bpe_round_trip(text)

    def decode(self, ids: Column) -> Column:
        """binary -> binary: the bytes of the text."""
        shared = self.shared

        @pandas_udf("binary")
        def bpe_decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            bpe = decoder(shared.value)
            for packed in batches:
                yield pd.Series([None if x is None else bpe.decode(x) for x in packed], dtype=object)

        return bpe_decode(ids)


def default_tokenizer(spark: SparkSession) -> Tokenizer:
    import public_tokenizers

    return Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def digests(ids: Column, decoded: Column) -> list[Column]:
    return [(F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256")]


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded; no SQL form, so tests hold it against the public library."""
    bpe = default_tokenizer(spark)
    return table(spark, sf_dir, "documents").select("doc_id", bpe.encode_and_decode(F.col("text")).alias("b")).select("doc_id", *digests(F.col("b.ids"), F.col("b.decoded")))
