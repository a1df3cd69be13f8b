"""Operator 6: token counts that follow edits.

A document's tree holds runs of its pre-tokens as leaves and sums of characters and
tokens above them. Trees are kept: build_trees() writes their leaves as a table, and
edit_trees() takes that table with edits, encodes only what they touch, and gives the
table of the new trees. An edit takes the leaves that it touches and one more on either
side, encodes that region anew and puts it back; only the sums above it change. Leaves end
where white space follows another character, a place that no pre-token crosses whatever
stands beyond it, so the untouched leaf on either side is context enough. A leaf's tokens
are counted by the tiktoken library; leaves of over WHOLE characters, which have no such
place, by the tree reduction of operator 1, whose time stays linear in them.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.bpe import DOUBTFUL, Codec, codec
from skein.llm.common import cut, per_document, saved, table, tokenizer_path

#: Characters of a leaf, unless one pre-token is longer: an edit encodes about three leaves.
LEAF = 128
#: Characters of a leaf that the library counts.
WHOLE = 4096


@lru_cache(maxsize=4)
def leaf_pattern(chars: int) -> re.Pattern:
    """So many characters at least, up to the first white space after another character."""
    return re.compile(rf"(?s).{{{chars - 1},}}?\S(?=\s)|.+")


def leaf_texts(text: str) -> list[str]:
    return [text] if DOUBTFUL.search(text) else leaf_pattern(LEAF).findall(text)


@lru_cache(maxsize=2)
def _library(encoder: Codec):
    import tiktoken

    return tiktoken.Encoding("leaves", pat_str=encoder.split.pattern, mergeable_ranks=encoder.ranks, special_tokens={})


def count(text: str, encoder: Codec) -> int:
    """Tokens of a leaf."""
    if len(text) <= WHOLE:
        return len(_library(encoder).encode_ordinary(text))
    return sum(len(encoder.known[u]) for u in encoder.units(text))


class Node:
    """A leaf with its text, or the sums of two nodes."""

    __slots__ = ("chars", "tokens", "left", "right", "text", "depth")

    def __init__(self, left: "Node | None" = None, right: "Node | None" = None, text: str = "", tokens: int = 0) -> None:
        self.left, self.right, self.text = left, right, text
        if left is None:
            self.chars, self.tokens, self.depth = len(text), tokens, 0
        else:
            self.chars, self.tokens = left.chars + right.chars, left.tokens + right.tokens
            self.depth = 1 + max(left.depth, right.depth)


class TokenTree:
    """Segment tree of one document; `encoded` counts the characters that were encoded for it."""

    def __init__(self, text: str, encoder: Codec) -> None:
        self.encoder, self.encoded = encoder, 0
        self.root = self.tree(text)

    @classmethod
    def stored(cls, leaves: list[tuple[str, int]], encoder: Codec) -> "TokenTree":
        """A tree from its leaves' texts and tokens; nothing is encoded."""
        one = cls.__new__(cls)
        one.encoder, one.encoded = encoder, 0
        one.root = one.above([Node(text=t, tokens=n) for t, n in leaves] or [Node()])
        return one

    @property
    def tokens(self) -> int:
        return self.root.tokens

    def tree(self, text: str) -> Node:
        self.encoded += len(text)
        return self.above([Node(text=t, tokens=count(t, self.encoder)) for t in leaf_texts(text)] or [Node()])

    def above(self, leaves: list[Node]) -> Node:
        if len(leaves) == 1:
            return leaves[0]
        half = len(leaves) // 2
        return Node(self.above(leaves[:half]), self.above(leaves[half:]))

    def leaf_at(self, place: int) -> tuple[int, int]:
        """Start and end of the leaf that holds a character; the last one's for the text's end."""
        node, start = self.root, 0
        while node.left is not None:
            if place < start + node.left.chars or not node.right.chars:
                node = node.left
            else:
                start += node.left.chars
                node = node.right
        return start, start + node.chars

    def leaves(self, node: Node | None = None, low: int = 0, high: int | None = None, start: int = 0) -> list[Node]:
        """Leaves that overlap the characters low..high."""
        node = node or self.root
        high = self.root.chars if high is None else high
        if node.left is None:
            return [node]
        out, middle = [], start + node.left.chars
        if low < middle and node.left.chars:
            out += self.leaves(node.left, low, high, start)
        if high > middle and node.right.chars:
            out += self.leaves(node.right, low, high, middle)
        return out

    def text(self) -> str:
        return "".join(x.text for x in self.leaves())

    def edit(self, start: int, removed: int, inserted: str) -> None:
        """Replace `removed` characters from `start` on; places outside the text count as its nearest end."""
        start = min(max(start, 0), self.root.chars)
        end = min(start + max(removed, 0), self.root.chars)
        low, high = self.leaf_at(start)[0], self.leaf_at(end)[1]
        low = self.leaf_at(low - 1)[0] if low else 0
        high = self.leaf_at(high)[1] if high < self.root.chars else high
        region = "".join(x.text for x in self.leaves(low=low, high=high))
        new = self.tree(region[: start - low] + inserted + region[end - low :])
        if low == 0 and high == self.root.chars:
            self.root = new
            return
        self.root = self.put(self.root, 0, low, high, new)
        if self.root.depth > 2 * self.root.chars.bit_length() + 8:
            self.root = self.above(self.leaves())

    def put(self, node: Node, start: int, low: int, high: int, new: Node) -> Node | None:
        """The node with the leaves of low..high replaced: the first by `new`, the others by nothing."""
        end = start + node.chars
        if end <= low or start >= high:
            return node
        if low <= start and end <= high:
            return new if start == low else None
        left = self.put(node.left, start, low, high, new)
        right = self.put(node.right, start + node.left.chars, low, high, new)
        return Node(left, right) if left is not None and right is not None else left if right is None else right


LEAVES = "leaves array<string>, tokens array<int>"
#: Edits of one document that are applied at once.
RUN = 1000


def build_trees(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """One tree for each row of docs: doc_id, n_chars, n_tokens, leaves and their tokens, and edits if edits_col names a column of them.

    A null text is empty and has one empty leaf. Texts of any length are encoded whole;
    repeated rows have a tree each. An empty table gives an empty result; other columns
    are not read.
    """
    edits = F.col(edits_col).cast(EDITS) if edits_col else F.lit(None).cast(EDITS)
    keyed = docs.select(F.struct(F.col(id_col).cast("long").alias("doc_id"), edits.alias("edits")).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def rows(keys, texts):
        trees = [TokenTree(t, codec(ranks_path)) for t in texts]
        leaves = [t.leaves() for t in trees]
        return {"doc_id": [k["doc_id"] for k in keys], "edits": [k["edits"] for k in keys], "n_chars": [len(t) for t in texts], "n_tokens": [t.tokens for t in trees], "leaves": [[x.text for x in v] for v in leaves], "tokens": [[x.tokens for x in v] for v in leaves]}

    trees = per_document(keyed, rows, f"doc_id long, n_chars long, n_tokens long, {LEAVES}, edits {EDITS}")
    return trees if edits_col else trees.drop("edits")


EDITS = "array<struct<start:int,removed:int,inserted:string>>"


def edit_trees(trees: DataFrame, ranks_path: str, edits_col: str = "edits") -> DataFrame:
    """The trees after their edits: doc_id, n_chars, n_tokens, leaves, tokens, n_chars_encoded for the edits, n_tokens_before.

    edits_col: array of (start, removed, inserted) in code points, applied in its order;
    null or empty means none, null fields count as 0 and "". Places outside a text count
    as its nearest end.
    """
    keyed = trees.select(F.struct("doc_id", F.col(edits_col).cast(EDITS).alias("edits"), "n_tokens", "n_chars", "tokens").alias("key"), "leaves")
    names = ["doc_id", "n_chars", "n_tokens", "leaves", "tokens", "n_chars_encoded", "n_tokens_before"]

    def rows(keys, stored):
        out, encoder = [], codec(ranks_path)
        for key, leaves in zip(keys, stored):
            if not key["edits"]:
                out.append((key["doc_id"], key["n_chars"], key["n_tokens"], leaves, key["tokens"], 0, key["n_tokens"]))
                continue
            tree = TokenTree.stored(list(zip(leaves, key["tokens"])), encoder)
            for e in key["edits"]:
                tree.edit(e["start"] or 0, e["removed"] or 0, e["inserted"] or "")
            now = [x for x in tree.leaves() if x.text] or [Node()]
            out.append((key["doc_id"], tree.root.chars, tree.tokens, [x.text for x in now], [x.tokens for x in now], tree.encoded, key["n_tokens"]))
        return dict(zip(names, map(list, zip(*out))))

    return per_document(keyed, rows, f"doc_id long, n_chars long, n_tokens long, {LEAVES}, n_chars_encoded long, n_tokens_before long")


def text_of(leaves: Column) -> Column:
    """The text of a tree's leaves."""
    return F.array_join(leaves, "")


def counts_with_edits(docs: DataFrame, ranks_path: str, edits_col: str = "edits", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens before and n_tokens_edited after its edits, the new text's sha256, its n_chars, and
    n_chars_encoded for the edits. Nulls, empties and repeats as in build_trees() and edit_trees()."""
    out = edit_trees(saved(build_trees(docs, ranks_path, id_col, text_col, edits_col)), ranks_path)
    return out.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), F.sha2(text_of(F.col("leaves")), 256).alias("edited_sha256"), "n_chars", "n_chars_encoded")


def counts_after(trees: DataFrame, edits: DataFrame, ranks_path: str, run: int = RUN) -> DataFrame:
    """The stored trees after a table of edits (doc_id, seq, start, removed, inserted): doc_id, n_chars, n_tokens, leaves, n_chars_encoded.

    A document's edits are applied by seq, ties by start, removed and inserted, nulls
    first, at most `run` at once; so many passes are made over the trees as the longest log
    needs, each from a stored table to a stored table, and no task holds more than `run`
    edits of a document. Edits of unknown documents and null ids are ignored; an empty
    table of edits changes nothing.
    """
    order = Window.partitionBy("doc_id").orderBy("seq", "start", "removed", "inserted")
    numbered = cut(edits.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "seq", "start", "removed", "inserted").withColumn("_n", F.row_number().over(order) - 1))
    passes = 1 + ((numbered.agg(F.max("_n")).first()[0] or 0) // run)
    now = trees.select("doc_id", "n_chars", "n_tokens", "leaves", "tokens", F.lit(0).cast("long").alias("_encoded"))
    for k in range(passes):
        some = numbered.where((F.col("_n") >= k * run) & (F.col("_n") < (k + 1) * run)).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "start", "removed", "inserted"))), lambda e: F.struct(e["start"].alias("start"), e["removed"].alias("removed"), e["inserted"].alias("inserted"))).alias("edits"))
        touched = saved(edit_trees(now.join(some, "doc_id"), ranks_path).select("doc_id", "n_chars", "n_tokens", "leaves", "tokens", F.col("n_chars_encoded").alias("_encoded")))
        others = now.join(some.withColumnRenamed("doc_id", "_of"), F.col("doc_id") == F.col("_of"), "left_anti")
        now = saved(others.unionByName(touched)) if passes > 1 else others.unionByName(touched)
    return now.withColumnRenamed("_encoded", "n_chars_encoded")


def revision(docs: DataFrame) -> DataFrame:
    """docs with a column of three edits that depend on the text: a word replaced at a third, one put in at two thirds, the start cut off."""
    n = F.coalesce(F.length("text"), F.lit(0))

    def one(start, removed, inserted):
        return F.struct(start.cast("int").alias("start"), F.lit(removed).alias("removed"), F.lit(inserted).alias("inserted"))

    return docs.withColumn("edits", F.array(one(n / 3, 7, "re-edited"), one(2 * n / 3, 0, " put in "), one(F.lit(0), 5, "")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_with_edits(revision(table(spark, sf_dir, "documents")), tokenizer_path("byte_bpe_50k.tiktoken"))
