"""Operator 9: token counts that follow edits.

A document is held as leaves of consecutive pre-token parts under a segment tree with the characters and tokens of
each subtree. Parts meet at spaces where byte-level BPE never joins, so a leaf's tokens don't depend on others. An
edit descends to the leaves it touches, with CONTEXT characters on either side so that the joints to the leaves that
stay are untouched, encodes their new text alone, and cuts it into as many leaves as it needs. The tree is split before
and after the leaves that go and joined again around the new ones, so only the sums on the way are computed anew: an
edit's work grows with its own text and the logarithm of the document.

Counting is a map over the scan; a tree lives as long as its document is in hand, and its memory is that of the text.

Defined results
* null or empty text: 0 tokens; it can be edited like any other (null as empty);
* an edit reaching past the end of the text is cut there; edits apply one after another, each to the text so far;
* very long texts have more leaves and a deeper tree; rows without a doc_id are counted and keep their null id;
* repeated rows give repeated results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from .packing import Encoder, encoder

#: Parts of a leaf on average and at least, where there are others, and characters on either side of an edit that are
#: encoded again with it.
LEAF, LEAST, CONTEXT = 32, 16, 4


class Leaf:
    """A leaf's text, its parts and tokens, and as a tree node the sums over its subtree."""

    __slots__ = ("text", "parts", "own", "left", "right", "leaves", "chars", "tokens")

    def __init__(self, text: str, parts: int, own: int):
        self.text, self.parts, self.own = text, parts, own
        self.left: Leaf | None = None
        self.right: Leaf | None = None
        self.sum_up()

    def sum_up(self) -> Leaf:
        self.leaves, self.chars, self.tokens = 1, len(self.text), self.own
        for child in (self.left, self.right):
            if child is not None:
                self.leaves += child.leaves
                self.chars += child.chars
                self.tokens += child.tokens
        return self


class TokenTree:
    """The tokens of one text under edits.

    The tree is kept balanced by chance: of two trees that are joined, the root is that of one or the other with the
    odds of their numbers of leaves.
    """

    def __init__(self, text: str, encode: Encoder):
        self.encode = encode
        self.encoded_chars = 0
        self.joined = 0
        self.random = random.Random(1)
        self.root = self._grown(self._leaves(text))

    def _leaves(self, text: str) -> list[Leaf]:
        """Leaves of a text whose first part stands alone."""
        first, *rest = self.encode.parts(text)
        texts = [first, *(" " + p for p in rest)]
        self.encoded_chars += len(text)
        counts = self.encode.counts(first, rest)
        n = max(1, round(len(texts) / LEAF))
        cuts = [len(texts) * k // n for k in range(n + 1)]
        return [Leaf("".join(texts[a:b]), b - a, sum(counts[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]

    def _grown(self, leaves: list[Leaf]) -> Leaf | None:
        if not leaves:
            return None
        middle = len(leaves) // 2
        root = leaves[middle]
        root.left, root.right = self._grown(leaves[:middle]), self._grown(leaves[middle + 1 :])
        return root.sum_up()

    def _split(self, tree: Leaf | None, n: int) -> tuple[Leaf | None, Leaf | None]:
        """The first n leaves of a tree, and the others."""
        if tree is None:
            return None, None
        self.joined += 1
        before = tree.left.leaves if tree.left else 0
        if n <= before:
            first, tree.left = self._split(tree.left, n)
            return first, tree.sum_up()
        tree.right, last = self._split(tree.right, n - before - 1)
        return tree.sum_up(), last

    def _join(self, a: Leaf | None, b: Leaf | None) -> Leaf | None:
        if a is None or b is None:
            return a or b
        self.joined += 1
        if self.random.randrange(a.leaves + b.leaves) < a.leaves:
            a.right = self._join(a.right, b)
            return a.sum_up()
        b.left = self._join(a, b.left)
        return b.sum_up()

    @property
    def n_chars(self) -> int:
        return self.root.chars if self.root else 0

    @property
    def n_tokens(self) -> int:
        return self.root.tokens if self.root else 0

    def _in_order(self, tree: Leaf | None) -> list[Leaf]:
        return [] if tree is None else [*self._in_order(tree.left), tree, *self._in_order(tree.right)]

    def text(self) -> str:
        return "".join(leaf.text for leaf in self._in_order(self.root))

    def _leaf(self, position: int) -> tuple[int, int]:
        """The number of the leaf that holds a character, the last one's for the end, and where the leaf starts."""
        tree, number, start = self.root, 0, 0
        while tree is not None:
            before = tree.left.chars if tree.left else 0
            if tree.left and position < start + before:
                tree = tree.left
                continue
            number += tree.left.leaves if tree.left else 0
            start += before
            if tree.right is None or position < start + len(tree.text):
                return number, start
            number, start, tree = number + 1, start + len(tree.text), tree.right
        return 0, 0

    def edit(self, start: int, end: int, replacement: str) -> None:
        """The characters from start up to end become the replacement."""
        start = min(max(start, 0), self.n_chars)
        end = min(max(end, start), self.n_chars)
        low, at = self._leaf(max(start - CONTEXT, 0))
        high, _ = self._leaf(min(end + CONTEXT, max(self.n_chars - 1, 0)))
        before, rest = self._split(self.root, low)
        region, after = self._split(rest, high + 1 - low)
        old = "".join(leaf.text for leaf in self._in_order(region))
        new = old[: start - at] + replacement + old[end - at :]
        if after is not None and new.count(" ") < LEAST:
            # too little for a leaf: the next one is taken in
            more, after = self._split(after, 1)
            new += more.text
        fresh = self._leaves(new) if new or (before is None and after is None) else []
        self.root = self._join(self._join(before, self._grown(fresh)), after)


def production_edits(n_chars: int) -> list[tuple[int, int, str]]:
    """The edits of the query: a replacement at the quarter, an insertion in the middle, a deletion near the end."""
    q = n_chars // 4
    return [(q, q + 12, "a revised passage"), (2 * q, 2 * q, " [inserted] "), (3 * q, 3 * q + 40, "")]


def count_edited(df: DataFrame, edits=production_edits, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_edited_tokens, n_chars, n_encoded_again) of each document under edits(n_chars).

    n_encoded_again: characters that the edits had encoded, of the edited text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts: Sequence[str] = [t or "" for t in part.column(1).to_pylist()]
                encode.learn(texts)
                out: list[list[int]] = [[], [], [], []]
                for t in texts:
                    tree = TokenTree(t, encode)
                    before, encoded = tree.n_tokens, tree.encoded_chars
                    for e in edits(len(t)):
                        tree.edit(*e)
                    for column, value in zip(out, (before, tree.n_tokens, tree.n_chars, tree.encoded_chars - encoded), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in out)], names=["doc_id", "n_tokens", "n_edited_tokens", "n_chars", "n_encoded_again"]
                )

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_edited_tokens bigint, n_chars bigint, n_encoded_again bigint")


def op9_token_counts(df: DataFrame) -> DataFrame:
    """Token counts of all documents before and after the production edits."""
    return count_edited(df)
