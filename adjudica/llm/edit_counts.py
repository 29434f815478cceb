"""Token counts that follow edits: a segment tree over the pre-tokens of each document, kept beside its text.

A leaf is a run of pre-tokens of about ``RUN`` characters that ends after white space, where byte-level BPE never
joins anything; an inner node has its leaves' characters and tokens summed. ``with_trees`` encodes a text once and adds
the leaves' sums as a column. ``apply_edits`` takes text, tree and edits and gives back the new text and tree, so edits
can go on round by round without an untouched leaf ever being encoded again. An edit (position, characters to delete,
text to insert, in code points, in order, each on the text as the edits before it left it) goes down the tree to the
leaves it touches. Only those are encoded again, with the next leaf where the edit took away the white space between
them, and the sums on the paths up change; what has outgrown a leaf is cut into leaves again. Positions and lengths
beyond the text are cut to it.

Columns: a null text is empty, a null list of edits has none, a null edit or part of one counts as nothing, and a null
tree is built. A tree that is not of its text raises ValueError. Equal rows and null ids are kept each. An empty table
gives no rows. Other columns are not read; ``with_trees`` keeps them, replacing one that is named tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adjudica.llm import units

RUN = 240
SPACE = re.compile(r"[ \t\n\r]+")
TREE = "struct<chars:array<int>,tokens:array<int>>"
SCHEMA = "doc_id long, n_chars long, n_tokens long, n_edits long, n_chars_after long, n_tokens_after long, encoded_chars long"


def runs(text: str, run: int = RUN) -> list[str]:
    out, at = [], 0
    while at < len(text):
        found = SPACE.search(text, at + run)
        end = found.end() if found else len(text)
        out.append(text[at:end])
        at = end
    return out


class CountTree:
    def __init__(self, leaves: list[str], tokens: list[int]):
        self.grow(leaves, tokens)

    def grow(self, leaves: list[str], tokens: list[int]) -> None:
        """All sums from the leaves'."""
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        pad = self.size - len(leaves)
        self.leaves = leaves + [""] * pad
        self.chars = [0] * self.size + [len(x) for x in leaves] + [0] * pad
        self.tokens = [0] * self.size + tokens + [0] * pad
        for node in reversed(range(1, self.size)):
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @classmethod
    def of(cls, text: str, chars: list[int], tokens: list[int]) -> CountTree:
        """From a text and its leaves' sums, without encoding."""
        if sum(chars) != len(text) or len(chars) != len(tokens):
            raise ValueError("a tree is not of its text")
        ends = np.cumsum(chars, dtype=np.int64).tolist()
        return cls([text[end - n : end] for end, n in zip(ends, chars, strict=True)], list(tokens))

    def sums(self) -> dict[str, list[int]]:
        """The characters and tokens of the leaves that hold anything."""
        kept = [(n, t) for n, t in zip(self.chars[self.size :], self.tokens[self.size :], strict=True) if n]
        return {"chars": [n for n, _ in kept], "tokens": [t for _, t in kept]}

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds the position, and the position within it; the end belongs to the last leaf that holds
        anything."""
        last = position >= self.chars[1]
        position = max(0, self.chars[1] - 1) if last else position
        node = 1
        while node < self.size:
            node *= 2
            if position >= self.chars[node] and self.chars[node + 1]:
                position -= self.chars[node]
                node += 1
        return node - self.size, position + (last and self.chars[1] > 0)

    def touched(self, position: int, deleted: int, inserted: str) -> tuple[int, int, str]:
        """(first leaf, last leaf, their new text) of an edit."""
        position = min(max(0, position), self.n_chars)
        deleted = min(max(0, deleted), self.n_chars - position)
        first, at = self.find(position)
        last = self.find(position + deleted)[0] if deleted else first
        last = max(first, last)
        old = "".join(self.leaves[first : last + 1])
        new = old[:at] + inserted + old[at + deleted :]
        while new and not new[-1] in " \t\n\r" and last + 1 < self.size and self.chars_from(last + 1):
            last += 1
            new += self.leaves[last]
        return first, last, new

    def chars_from(self, leaf: int) -> int:
        """Characters of the leaf and all after it."""
        node, total = leaf + self.size, self.chars[leaf + self.size]
        while node > 1:
            if not node & 1:
                total += self.chars[node + 1]
            node >>= 1
        return total

    def replace(self, first: int, last: int, texts: list[str], tokens: list[int]) -> None:
        """The leaves from first to last hold these texts; where there are more of them, the tree grows."""
        room = last - first + 1
        if len(texts) > room:
            own = self.tokens[self.size :]
            leaves, counts = self.leaves[:first] + texts + self.leaves[last + 1 :], own[:first] + tokens + own[last + 1 :]
            kept = [i for i, leaf in enumerate(leaves) if leaf]
            return self.grow([leaves[i] for i in kept], [counts[i] for i in kept])
        texts, tokens = texts + [""] * (room - len(texts)), tokens + [0] * (room - len(tokens))
        for leaf, text, count in zip(range(first, last + 1), texts, tokens, strict=True):
            self.leaves[leaf] = text
            node = leaf + self.size
            self.chars[node], self.tokens[node] = len(text), count
            node >>= 1
            while node:
                self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
                self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
                node >>= 1

    def text(self) -> str:
        return "".join(self.leaves)


def counts(encoder: units.UnitEncoder, texts: list[str]) -> list[int]:
    """Tokens of each text, encoded in batches of bounded size."""
    column, out = pa.array(texts, pa.large_string()), []
    for at, n in units.slices(column):
        out += np.diff(encoder.encode(column.slice(at, n))[1]).tolist()
    return out


def trees_of(encoder: units.UnitEncoder, texts: list[str], run: int = RUN) -> list[CountTree]:
    split = [runs(t, run) for t in texts]
    sizes = iter(counts(encoder, [leaf for leaves in split for leaf in leaves]))
    return [CountTree(leaves, [next(sizes) for _ in leaves]) for leaves in split]


def edit_batch(encoder: units.UnitEncoder, trees: list[CountTree], edits: list[list[tuple[int, int, str]]], run: int = RUN) -> list[int]:
    """Applies each tree's edits; the characters that each had encoded again."""
    again = [0] * len(trees)
    for nth in range(max(map(len, edits), default=0)):
        own = [i for i, e in enumerate(edits) if nth < len(e)]
        regions = [trees[i].touched(*edits[i][nth]) for i in own]
        cut = [runs(new, run) if len(new) > 2 * run else [new] for *_, new in regions]
        sizes = iter(counts(encoder, [leaf for leaves in cut for leaf in leaves]))
        for i, (first, last, new), leaves in zip(own, regions, cut, strict=True):
            trees[i].replace(first, last, leaves, [next(sizes) for _ in leaves])
            again[i] += len(new)
    return again


def count_batch(encoder: units.UnitEncoder, texts: list[str], edits: list[list[tuple[int, int, str]]], run: int = RUN) -> list[tuple]:
    """(chars, tokens, edits, chars after, tokens after, characters encoded again, text after) of each text."""
    trees = trees_of(encoder, texts, run)
    before = [(t.n_chars, t.n_tokens) for t in trees]
    again = edit_batch(encoder, trees, edits, run)
    return [(*b, len(e), t.n_chars, t.n_tokens, a, t.text()) for b, e, t, a in zip(before, edits, trees, again, strict=True)]


def edits_of(column: pa.Array) -> list[list[tuple[int, int, str]]]:
    return [[(e["position"] or 0, e["deleted"] or 0, e["inserted"] or "") for e in x or [] if e] for x in column.to_pylist()]


TREE_TYPE = pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])


def with_trees(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """Adds ``tree``, the sums of each text's leaves."""
    vocabulary = path or units.vocabulary_path()

    @F.arrow_udf(TREE)
    def made(texts: pa.Array) -> pa.Array:
        out = []
        for at, n in units.slices(texts):
            out += [t.sums() for t in trees_of(units.encoder(vocabulary), [t or "" for t in texts.slice(at, n).to_pylist()])]
        return pa.array(out, TREE_TYPE)

    return df.withColumn("tree", made(F.col(text_col)))


def apply_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tree_col: str = "tree", edits_col: str = "edits", path: str | None = None) -> DataFrame:
    """The counts before and after, the characters that were encoded, and the new text and tree.
    ``edits_col``: array<struct<position: long, deleted: long, inserted: string>>."""
    vocabulary, names = path or units.vocabulary_path(), [c.split()[0] for c in SCHEMA.split(", ")]

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in units.slices(batch.column(1)):
                own = batch.slice(at, n)
                texts, held = [t or "" for t in own.column(1).to_pylist()], own.column(2).to_pylist()
                encoder = units.encoder(vocabulary)
                fresh = iter(trees_of(encoder, [t for t, h in zip(texts, held, strict=True) if h is None]))
                trees = [next(fresh) if h is None else CountTree.of(t, h["chars"], h["tokens"]) for t, h in zip(texts, held, strict=True)]
                edits = edits_of(own.column(3))
                before = [(t.n_chars, t.n_tokens) for t in trees]
                again = edit_batch(encoder, trees, edits)
                rows = [(*b, len(e), t.n_chars, t.n_tokens, a) for b, e, t, a in zip(before, edits, trees, again, strict=True)]
                numbers = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([own.column(0), *numbers, pa.array([t.text() for t in trees], pa.string()), pa.array([t.sums() for t in trees], TREE_TYPE)], [*names, "text", "tree"])

    given = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(tree_col).alias("tree"), F.col(edits_col).alias("edits"))
    return given.mapInArrow(edit, f"{SCHEMA}, text string, tree {TREE}")


def count_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", path: str | None = None) -> DataFrame:
    """The counts of every document and the crc32 of its text after the edits."""
    given = with_trees(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(edits_col).alias("edits")), path=path)
    done = apply_edits(given, path=path)
    return done.select(*[c.split()[0] for c in SCHEMA.split(", ")], F.crc32("text").alias("text_crc32_after"))
