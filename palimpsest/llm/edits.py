"""Edit-aware token counts.

The pieces that the split pattern finds in a text are the leaves of a segment tree, in blocks; each node holds the code
points and the tokens below it. An edit replaces a range of code points. Only the pieces that it touches are split and
encoded anew, with boundary context: splitting starts at the last piece start at least LOOK code points before the edit
(no alternative of the pattern looks further ahead) and ends where a new piece start falls on an old one behind the
edit, from where on the pieces are the same. The sums on the paths to the root are updated.

Edge cases: null texts count as empty; a null or empty list of edits changes nothing; an edit's start and length are cut
to the text as it is by then; a null insert counts as empty; edits apply in list order; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.bpe import Codec, codec

#: Code points that the pattern may look at beyond a piece's end.
LOOK = 3
#: Pieces of a leaf.
LEAF = 64


class PieceTree:
    """A text's pieces, in leaves, with sums of code points and tokens."""

    def __init__(self, text: str, own: Codec, pieces: list[str] | None = None):
        self.own, self.text, self.encoded = own, text, 0
        self._plant(own.split(text) if pieces is None else pieces)

    def _tokens(self, pieces: list[str]) -> int:
        get = self.own.cache.__getitem__
        try:
            return len(b"".join(map(get, pieces))) >> 2
        except KeyError:
            self.own.learn(set(pieces))
            return len(b"".join(map(get, pieces))) >> 2

    def _plant(self, pieces: list[str]) -> None:
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.size = 1 << max(0, (len(self.leaves) - 1).bit_length())
        rest = [0] * (self.size - len(self.leaves))
        self.chars = [0] * self.size + [len("".join(x)) for x in self.leaves] + rest
        self.tokens = [0] * self.size + [self._tokens(x) for x in self.leaves] + rest
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _leaf_at(self, point: int) -> tuple[int, int]:
        """The leaf that holds a code point, and the code points before it."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if point >= before + self.chars[node]:
                before += self.chars[node]
                node += 1
        return min(node - self.size, len(self.leaves) - 1), before if node - self.size < len(self.leaves) else self.chars[1] - self.chars[self.size + len(self.leaves) - 1]

    def _update(self, leaf: int) -> None:
        node = self.size + leaf
        self.chars[node], self.tokens[node] = len("".join(self.leaves[leaf])), self._tokens(self.leaves[leaf])
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, drop: int, insert: str) -> None:
        start = max(0, min(start, len(self.text)))
        stop = min(len(self.text), start + max(0, drop))
        shift = len(insert) - (stop - start)
        text = self.text[:start] + insert + self.text[stop:]
        # The piece to start from: the last whose start is LOOK code points before the edit, or the first.
        leaf, before = self._leaf_at(max(0, start - LOOK))
        pieces = self.leaves[leaf]
        k, at = 0, before
        while k < len(pieces) and at + len(pieces[k]) + LOOK <= start:
            at += len(pieces[k])
            k += 1
        first_leaf, first_piece, begin = leaf, k, at
        # New pieces until one starts where an old one did, behind the edit.
        old_leaf, old_piece, old_at = leaf, k, at
        new: list[str] = []
        window, upto = "", begin
        done = False
        reach = 64
        while not done:
            window = text[begin : stop + shift + reach]
            whole = begin + len(window) >= len(text)
            new, upto = [], begin
            old_leaf, old_piece, old_at = first_leaf, first_piece, begin
            for p in self.own.split(window):
                if not whole and upto + len(p) + LOOK > begin + len(window):
                    break  # the window's end may have cut this piece
                new.append(p)
                upto += len(p)
                if upto >= stop + shift:
                    target = upto - shift
                    while old_at < target and old_leaf < len(self.leaves):
                        if old_piece == len(self.leaves[old_leaf]):
                            old_leaf, old_piece = old_leaf + 1, 0
                            continue
                        old_at += len(self.leaves[old_leaf][old_piece])
                        old_piece += 1
                    if old_at == target:
                        done = True
                        break
            if whole and not done:  # an empty rest
                old_leaf, old_piece, done = len(self.leaves), 0, True
            reach *= 8
        self.encoded += len(new)
        self.text = text
        rest = self.leaves[old_leaf][old_piece:] if old_leaf < len(self.leaves) else []
        grown = self.leaves[first_leaf][:first_piece] + new
        if old_leaf == first_leaf:
            grown += rest
        else:
            for i in range(first_leaf + 1, min(old_leaf, len(self.leaves))):
                self.leaves[i] = []
                self._update(i)
            if old_leaf < len(self.leaves):
                self.leaves[old_leaf] = rest
                self._update(old_leaf)
        self.leaves[first_leaf] = grown
        if len(grown) > 8 * LEAF:
            self._plant([p for x in self.leaves for p in x])
        else:
            self._update(first_leaf)


def count(docs: DataFrame, path: str, pattern: str, edits_col: str = "edits", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_pieces, n_tokens, n_edits, n_tokens_after, n_reencoded (pieces encoded for edits), n_chars_after.

    edits_col is array<struct<start int, drop int, insert string>> in code points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        names = ["id", "n_pieces", "n_tokens", "n_edits", "n_tokens_after", "n_reencoded", "n_chars_after"]
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part, rows = b.slice(i, 500), []
                many = [t or "" for t in part.column(1).to_pylist()]
                for t, edits, pieces in zip(many, part.column(2).to_pylist(), own.split_many(many), strict=True):
                    tree = PieceTree(t, own, pieces)
                    n = tree.total
                    for e in edits or []:
                        tree.edit(e["start"] or 0, e["drop"] or 0, e["insert"] or "")
                    rows.append((len(pieces), n, len(edits or []), tree.total, tree.encoded, len(tree.text)))
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    edits = F.col(edits_col).cast("array<struct<start:int,drop:int,insert:string>>").alias("edits")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), edits).mapInArrow(run, f"id {kind}, n_pieces long, n_tokens long, n_edits long, n_tokens_after long, n_reencoded long, n_chars_after long").withColumnRenamed("id", id_col)
