"""Byte-level BPE encoding of whole corpora with a public vocabulary.

The merges are reproduced without replaying them.  Two facts carry this: a
sequence of tokens is the encoding of its text exactly if each adjacent pair
is compatible (encoding the two tokens' bytes together gives the two tokens
back), and compatibility of a pair can be decided from the way the two tokens
were merged.  So a piece of text is covered greedily with longest matches,
found in a trie over the vocabulary whose bytes are mapped to Latin-1, and the
walk steps back to a shorter match where two neighbours are incompatible.
Positions from which no cover exists are remembered, which keeps this linear.
"""

from __future__ import annotations

import base64
import re
import sys
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from seqlume.plans.scratch import spread

#: The split pattern published with the vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern for texts without letter-like numbers and separators 1C-1F,
#: in terms of the standard library's faster classes.
_FAST = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+""")
_FULL = regex.compile(SPLIT.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"), regex.V0)
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Pieces remembered per Python worker; the table is emptied when it is full.
CACHE_PIECES = 400_000


def default_vocabulary() -> str:
    """Path of byte_bpe_50k as installed; a parameter everywhere else."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Vocabulary:
    """Ranks of a byte-level BPE, and what the walk needs of them."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ids = {base64.b64decode(token).decode("latin-1"): int(rank) for token, rank in pairs}
        self.text = {rank: token for token, rank in self.ids.items()}
        self.most = max(map(len, self.ids), default=0)  # no token is longer
        self.trie = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            self.trie.add_word(token, rank)
        self.shorter = {rank: self._longest(token, len(token) - 1) for token, rank in self.ids.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank in sorted(self.text):
            self._record_merge(rank)
        self._compatible: dict[tuple[int, int], bool] = {}
        # Letters and numbers that the two patterns class differently.
        self.odd = {chr(c) for c in range(0x80, sys.maxunicode + 1) if _class_differs(chr(c))}

    def _longest(self, text: str, limit: int) -> int | None:
        """Rank of the longest token that starts ``text``, of ``limit`` characters at most."""
        reach = min(self.trie.longest_prefix(text[:limit]), limit) if limit > 0 else 0
        while reach > 0:
            rank = self.ids.get(text[:reach])
            if rank is not None:
                return rank
            reach -= 1
        return None

    def _record_merge(self, rank: int) -> None:
        """Find the two tokens that merge into ``rank``: the compatible split."""
        token = self.text[rank]
        left = self.shorter[rank]
        while left is not None:
            right = self.ids.get(token[len(self.text[left]):])
            if right is not None and left < rank and right < rank and self._decide(left, right):
                self.merged[left, right] = rank
                self.parts[rank] = (left, right)
                return
            left = self.shorter[left]

    def _decide(self, a: int, b: int) -> bool:
        """Whether no merge across the seam precedes the merges inside a and b.

        Undo merges on either side of the seam, the latest first.  Each state is
        what stood beside the seam at that time; a merge of the two that comes
        earlier than what was just undone would have been taken instead.
        """
        before = sys.maxsize  # merges of this rank or later had not happened yet
        while True:
            joint = self.merged.get((a, b))
            if joint is not None and joint < before:
                return False
            a_parts, b_parts = self.parts.get(a), self.parts.get(b)
            if a_parts is None and b_parts is None:
                return True
            if b_parts is None or (a_parts is not None and a > b):
                before, a = a, a_parts[1]
            else:
                # Of equal ranks the left merge runs first, so b's own may tie.
                before, b = b + 1, b_parts[0]

    def compatible(self, a: int, b: int) -> bool:
        known = self._compatible.get((a, b))
        if known is None:
            if len(self._compatible) >= 1_000_000:
                self._compatible.clear()
            known = self._compatible[a, b] = self._decide(a, b)
        return known

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece of the split text."""
        raw = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self.ids.get(raw)
        if whole is not None:
            return (whole,)
        size, found, at = len(raw), [], 0
        dead = bytearray(size + 1)  # positions from which no cover continues
        nearest = self._longest(raw, size)
        while at < size:
            token = nearest
            while token is not None:
                end = at + len(self.text[token])
                if not dead[end] and (not found or self.compatible(found[-1], token)):
                    break
                token = self.shorter[token]
            if token is not None:
                found.append(token)
                at = end
                nearest = self._longest(raw[at : at + self.most], size - at)
            else:
                dead[at] = 1
                token = found.pop()
                at -= len(self.text[token])
                nearest = token
        return tuple(found)

    def pieces(self, text: str) -> list[str]:
        if text.isascii():
            odd = _SEPARATORS.search(text) is not None
        else:
            found = set(text)
            odd = not (found.isdisjoint(self.odd) and found.isdisjoint("\x1c\x1d\x1e\x1f"))
        return _FULL.findall(text) if odd else _FAST.findall(text)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return [i for piece in self.pieces(text) for i in self.encode_piece(piece)]


def _class_differs(ch: str) -> bool:
    import unicodedata

    kind = unicodedata.category(ch)
    if kind == "Cs":
        return False
    fast = "N" if ch.isdecimal() else "L" if ch.isalnum() else "S" if ch.isspace() else "O"
    full = kind[0] if kind[0] in "LN" else "S" if kind in ("Zs", "Zl", "Zp") or ch == "\x85" else "O"
    return fast != full


class _Cache(dict):
    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.vocabulary.encode_piece(piece)
        if len(piece) <= 64:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


_loaded: dict[str, _Cache] = {}


def encode(documents: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array<int>), one row for each row of ``documents``.

    Null and empty texts have the empty list.  No special tokens are produced;
    their spelling in a text is ordinary text.  Other columns are not read.
    ``vocabulary`` is the path of a rank file present on every executor.
    Texts are encoded whole and on their own: no shuffle, one pass.
    """
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _loaded.get(vocabulary)
        if cache is None:
            cache = _loaded[vocabulary] = _Cache(Vocabulary(vocabulary))
        split, get = cache.vocabulary.pieces, cache.__getitem__
        for batch in batches:
            ends, flat = [0], []
            for text in batch.column(1).to_pylist():
                if text:
                    flat.append(np.fromiter(chain.from_iterable(map(get, split(text))), np.int32))
                    ends.append(ends[-1] + len(flat[-1]))
                else:
                    ends.append(ends[-1])
            ids = pa.ListArray.from_arrays(
                pa.array(np.array(ends, np.int32)), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32))
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    return spread(documents.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")
