"""Edit-aware token counts: a segment tree over pre-tokens for each document, of which an edit recounts a few leaves.

A leaf stands for up to ``LEAF`` consecutive pre-tokens (the pieces into which the tokenizer's pattern cuts a text) and holds their
characters and tokens. Above the leaves each node holds the sums of its two children, in one array (node 1 is the root, 2i and 2i + 1
are the children of i). An edit replaces a range of characters. A pre-token depends on the text from its start to ``AHEAD`` characters past
its end, so leaves that end before that stay; from the first other leaf the pattern is run over the new text, until a pre-token ends
where an untouched leaf starts. From there on nothing can have changed. The pre-tokens found go to the first leaf touched, the others touched
become empty, and the sums above them are mended: work in proportion to the edit and the logarithm of the text.

Null texts are like empty ones. Edits beyond the text's end are clamped to it. Edits of one document apply in the order given, each to the
text that the one before left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tabulon.llm.bpe import ByteBpe, Tokenizer, default_tokenizer, loaded
from tabulon.llm.common import table

LEAF, AHEAD = 16, 2
BATCH = 256
EDITS = "array<struct<start:long,length:long,text:string>>"
TREE = "struct<leaves:int,chars:array<int>,tokens:array<int>>"


class Tree:
    """Sums of characters and tokens; leaves stand at ``leaves`` and after."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.leaves = 1 << max(0, int(len(chars) - 1).bit_length()) if len(chars) else 1
        self.chars, self.tokens = np.zeros(2 * self.leaves, dtype=np.int64), np.zeros(2 * self.leaves, dtype=np.int64)
        self.chars[self.leaves : self.leaves + len(chars)] = chars
        self.tokens[self.leaves : self.leaves + len(tokens)] = tokens
        level = self.leaves
        while level > 1:
            for sums in (self.chars, self.tokens):
                sums[level // 2 : level] = sums[level : 2 * level].reshape(-1, 2).sum(axis=1)
            level //= 2

    def find(self, at: int) -> tuple[int, int]:
        """The leaf with the character at that place (the last leaf beyond the end), and where it starts."""
        node, start = 1, 0
        at = min(at, int(self.chars[1]) - 1)
        while node < self.leaves:
            node *= 2
            if at >= start + self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return node, start

    def put(self, node: int, chars: int, tokens: int) -> None:
        self.chars[node], self.tokens[node] = chars, tokens
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]


class Counter:
    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe

    def counts(self, pieces: list[str]) -> np.ndarray:
        self.bpe.learn(set(pieces))
        return np.fromiter((len(self.bpe.known[p]) >> 2 for p in pieces), dtype=np.int64, count=len(pieces))

    def trees(self, texts: list[str]) -> list[Tree]:
        """One tree a text; the pieces of all texts are merged together."""
        pieces = [self.bpe.pattern.findall(t) for t in texts]
        self.bpe.learn(set().union(*pieces))
        out = []
        for own in pieces:
            if not own:
                out.append(Tree(np.zeros(0), np.zeros(0)))
                continue
            starts = np.arange(0, len(own), LEAF)
            chars = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
            tokens = np.fromiter((len(self.bpe.known[p]) >> 2 for p in own), dtype=np.int64, count=len(own))
            out.append(Tree(np.add.reduceat(chars, starts), np.add.reduceat(tokens, starts)))
        return out

    def edit(self, tree: Tree, text: str, start: int, length: int, new: str) -> tuple[str, int]:
        """The text after the edit, whose counts the tree then holds, and the characters that were encoded anew."""
        start = min(max(0, start), len(text))
        length = min(max(0, length), len(text) - start)
        after = text[:start] + new + text[start + length :]
        moved = len(new) - length
        if not text:
            pieces = self.bpe.pattern.findall(after)
            tree.put(tree.leaves, len(after), int(self.counts(pieces).sum()))
            return after, len(after)
        leaf, at = tree.find(max(0, start - AHEAD - 1))
        first, begin = leaf, at
        # the first leaf that starts at or after the edit's end can stay if a pre-token of the new text ends where it starts
        end = at + int(tree.chars[leaf])
        pieces, place = [], begin
        for m in self.bpe.pattern.finditer(after, begin):
            pieces.append(m.group())
            place = m.end()
            while end + moved < place and leaf < 2 * tree.leaves - 1 or end < start + length:
                leaf += 1
                end += int(tree.chars[leaf])
            if end >= start + length and end + moved == place:
                break
        if place == len(after):  # no leaf after this one is left
            leaf = 2 * tree.leaves - 1
        for i in range(first + 1, leaf + 1):
            if tree.chars[i]:
                tree.put(i, 0, 0)
        tree.put(first, place - begin, int(self.counts(pieces).sum()))
        return after, place - begin


def token_trees(tokenizer: Tokenizer, text: Column) -> Column:
    """string -> the tree of its text, to be kept beside it."""
    shared, pattern = tokenizer.shared, tokenizer.pattern

    @pandas_udf(TREE)
    def build(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = Counter(loaded(shared.value, pattern))
        for texts in batches:
            trees = [t for at in range(0, len(texts), BATCH) for t in counter.trees([x or "" for x in texts.iloc[at : at + BATCH]])]
            yield pd.DataFrame({"leaves": [t.leaves for t in trees], "chars": [t.chars for t in trees], "tokens": [t.tokens for t in trees]})

    return build(text)


def apply_edits(tokenizer: Tokenizer, text: Column, tree: Column, edits: Column) -> Column:
    """struct(text, tree, tokens, encoded_chars) after the edits; only what they touch is encoded anew."""
    shared, pattern = tokenizer.shared, tokenizer.pattern

    @pandas_udf(f"struct<text:string,tree:{TREE},tokens:long,encoded_chars:long>")
    def edited(batches: Iterator[tuple[pd.Series, pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
        counter = Counter(loaded(shared.value, pattern))
        for texts, trees, changes in batches:
            out: list = []
            for text, leaves, chars, tokens, change in zip(texts, trees["leaves"], trees["chars"], trees["tokens"], changes, strict=True):
                tree = Tree.__new__(Tree)
                tree.leaves, tree.chars, tree.tokens = int(leaves), np.array(chars, dtype=np.int64), np.array(tokens, dtype=np.int64)
                text, encoded = text or "", 0
                for c in change if change is not None else ():
                    c = c if isinstance(c, dict) else c.asDict()
                    text, n = counter.edit(tree, text, int(c["start"]), int(c["length"]), c["text"] or "")
                    encoded += n
                out.append((text, {"leaves": tree.leaves, "chars": tree.chars.tolist(), "tokens": tree.tokens.tolist()}, int(tree.tokens[1]), encoded))
            yield pd.DataFrame(out, columns=["text", "tree", "tokens", "encoded_chars"])

    return edited(text, tree, edits)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text before and after three edits: a deletion, an insertion and a replacement. No SQL form."""
    bpe = default_tokenizer(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text").cast("long")
    edit = lambda start, length, text: F.struct(start.cast("long").alias("start"), F.lit(length).cast("long").alias("length"), text.alias("text"))
    edits = F.array(edit(F.floor(n / 3), 7, F.lit("")), edit(F.floor(n / 2), 0, F.lit(" an edit's 42 words\n ")), edit(F.floor(n * 2 / 3), 20, F.substring("text", 1, 30)))
    trees = docs.select("doc_id", "text", n.alias("n_chars"), token_trees(bpe, F.col("text")).alias("tree"), edits.alias("edits"))
    after = trees.select("doc_id", "n_chars", F.element_at("tree.tokens", 2).cast("long").alias("n_tokens"), apply_edits(bpe, F.col("text"), F.col("tree"), F.col("edits")).alias("e"))
    return after.select("doc_id", "n_chars", "n_tokens", F.length("e.text").cast("long").alias("edited_chars"), F.sha2("e.text", 256).alias("edited_sha256"), F.col("e.tokens").alias("edited_tokens"), "e.encoded_chars")
