"""Held-out items that leaked into a corpus, verbatim or re-parameterised.

Texts become words as a reader sees them.  Words that several items share are
kept; numbers, units and all other words (names, as they belong to one item)
become typed placeholders.  Windows of such templates are hash-joined, and the
words in the slots are checked: equal slots mean a verbatim passage, slots
that correspond one to one mean the same question with other parameters.
Templates and slots are tested on the workers; only windows that fit leave them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlume.llm.lookalike import _TOKEN, by_table
from seqlume.plans.scratch import materialise, spread
from seqlume.plans.skew import small

#: Consecutive words of a window.
WINDOW = 12
#: A word is part of a template if this share of the items (and at least 3) have it.
SHARED_BY = 0.08
#: Template windows of items that are sent to the workers at once (8 bytes each).
BLOCK_WINDOWS = 2_000_000
#: Words that stand for a unit.
UNITS = frozenset(
    "gram grams kilogram kilograms milligram milligrams meter meters metre metres kilometer kilometers centimeter "
    "centimeters millimeter millimeters mile miles inch inches foot feet yard yards liter liters litre litres second "
    "seconds minute minutes hour hours day days week weeks month months year years degree degrees volt volts watt watts "
    "joule joules newton newtons pascal pascals hertz mole moles percent unit units kg g mg km cm mm ml dollar dollars euro euros"
    .split()
)
# Commands that change how their text looks leave no gap; all others do.
_LOOKS = re.compile(r"\\(?:emph|text[a-z]{2,6}|math[a-z]{2,4}|underline|uppercase|mbox)(?![a-zA-Z])\s*(?=\{)|\\[-/]")
_OTHER = re.compile(r"\\\\|\\[a-zA-Z]+\*?")
_PLAIN = re.compile(r"[0-9a-z]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits as they look: without case, markup or look-alike spellings."""
    if not text:
        return []
    text = by_table(text)
    if "\\" in text:
        text = _OTHER.sub(" ", _LOOKS.sub("", text))
    text = text.replace("{", "").replace("}", "").lower()
    return (_PLAIN if text.isascii() else _TOKEN).findall(text)


def _mix(text: str) -> int:
    """A 64-bit code of a word, the same in every process."""
    value = 0xCBF29CE484222325
    for byte in text.encode("utf-8", "surrogatepass"):
        value = ((value ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    value ^= value >> 29
    value = value * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    return value ^ value >> 32


class _Codes(dict):
    """Word -> code: its own if it is part of templates, else its type's."""

    def __init__(self, shared: list[str]):
        super().__init__((w, _mix("=" + w)) for w in shared if not self.typed(w))
        self.fixed = np.sort(np.array(list(self.values()), np.uint64))
        self.shared = len(self)

    @staticmethod
    def typed(word: str) -> str:
        return "number" if word[0].isdigit() and word[-1].isdigit() else "unit" if word in UNITS else ""

    def __missing__(self, word: str) -> int:
        code = _mix("<" + (self.typed(word) or "name"))
        if len(self) < self.shared + 500_000:
            self[word] = code
        return code


class _Words(dict):
    """Word -> its own code, whatever its part in templates."""

    def __missing__(self, word: str) -> int:
        code = _mix(word)
        if len(self) < 500_000:
            self[word] = code
        return code


def _rolled(codes: list[np.ndarray]) -> np.ndarray:
    """One code of several columns of codes, in order."""
    total = np.zeros(len(codes[0]), np.uint64)
    with np.errstate(over="ignore"):
        for column in codes:
            total = total * np.uint64(0x9E3779B97F4A7C15) + column
        return total ^ (total >> np.uint64(31))


class _Windows:
    """All windows of ``size`` words of some texts."""

    def __init__(self, texts: list[str | None], codes: _Codes, size: int):
        self.words: list[str] = []
        self.size = size
        lengths = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = words_of(text)
            lengths[i] = len(own)
            self.words += own
        self.code = np.fromiter(map(codes.__getitem__, self.words), np.uint64, len(self.words))
        owner = np.repeat(np.arange(len(texts)), lengths)
        n = max(0, len(self.words) - size + 1)
        start = np.flatnonzero(owner[:n] == owner[size - 1 : n + size - 1])
        self.owner, self.start = owner[start], start
        self.template = _rolled([self.code[j : n + j] for j in range(size)])[start] if n else np.empty(0, np.uint64)

    def keep(self, which: np.ndarray) -> None:
        self.owner, self.start, self.template = self.owner[which], self.start[which], self.template[which]

    def own_words(self, codes: _Codes) -> np.ndarray:
        """How many words of each window are part of its template."""
        before = np.concatenate([[0], np.cumsum(np.isin(self.code, codes.fixed))])
        return before[self.start + self.size] - before[self.start]

    def slots(self, full: _Words) -> tuple[np.ndarray, np.ndarray]:
        """Of each window the code of all its words, and that of which of them are equal."""
        wording, pattern = np.empty(len(self.start), np.uint64), np.empty(len(self.start), np.uint64)
        for i in range(0, len(self.start), 50_000):
            place = self.start[i : i + 50_000, None] + np.arange(self.size)
            used, inverse = np.unique(place, return_inverse=True)
            codes = np.fromiter((full[self.words[p]] for p in used.tolist()), np.uint64, len(used))[inverse.reshape(place.shape)]
            first = (codes[:, :, None] == codes[:, None, :]).argmax(2).astype(np.uint64)
            wording[i : i + 50_000] = _rolled(list(codes.T))
            pattern[i : i + 50_000] = _rolled(list(first.T + np.uint64(1)))
        return wording, pattern

    def batch(self, ids: pa.Array, id_col: str, more: dict[str, np.ndarray]) -> pa.RecordBatch:
        flat = [w for s in self.start.tolist() for w in self.words[s : s + self.size]]
        words = pa.ListArray.from_arrays(pa.array(np.arange(len(self.start) + 1, dtype=np.int32) * self.size), pa.array(flat, pa.string()))
        columns = {id_col: ids.take(pa.array(self.owner)), "template": pa.array(self.template.view(np.int64)), "words": words} | {k: pa.array(v) for k, v in more.items()}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def shared_words(items: DataFrame, text_col: str = "text", share: float = SHARED_BY) -> DataFrame:
    """Words that a share of all items have; their number is at most the words of an
    average item divided by ``share``.  They are what templates are made of.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for t in batch.column(0).to_pylist() for w in set(words_of(t))], pa.string())], names=["word"])

    texts = items.select(text_col).distinct()  # repeated items are one
    total = texts.agg(F.greatest(F.lit(3.0), F.count("*") * share).alias("least"))
    counted = texts.mapInArrow(run, "word string").groupBy("word").count()
    return counted.crossJoin(F.broadcast(total)).where("count >= least").select("word")  # total is one row


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some 4 million characters."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars < 4_000_000):
            chars += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def item_windows(items: DataFrame, id_col: str, text_col: str, shared: list[str], size: int = WINDOW) -> DataFrame:
    """Windows of ``size`` words: ``id_col``, ``template`` (64-bit hash), ``words``, ``own`` (how
    many words are the template's), ``wording`` and ``pattern`` (hashes of template and words, and of
    template and which words are equal)."""
    sent = items.sparkSession.sparkContext.broadcast(shared)
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, full = _Codes(sent.value), _Words()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, end in _chunks(texts):
                found = _Windows(texts[at:end], codes, size)
                if len(found.start):
                    wording, pattern = (_rolled([found.template, x]).view(np.int64) for x in found.slots(full))
                    yield found.batch(batch.column(0).slice(at, end - at), id_col, {"own": found.own_words(codes).astype(np.int32), "wording": wording, "pattern": pattern})

    return spread(items.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, template long, words array<string>, own int, wording long, pattern long")


def matching_windows(texts: DataFrame, id_col: str, text_col: str, shared: list[str], templates: np.ndarray, slots: np.ndarray, by: str, size: int = WINDOW) -> DataFrame:
    """Windows whose template is in ``templates`` and whose slots fit: ``id_col``, ``template``, ``words``.

    ``by`` is wording or pattern, ``slots`` the sorted hashes of ``item_windows``.
    Both tests are made where the text is, so only windows that pass both leave a task.
    """
    sent = texts.sparkSession.sparkContext.broadcast((shared, templates, slots))
    kind = texts.schema[id_col].dataType.simpleString()

    def among(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
        return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, wanted, fitting = sent.value
        codes, full = _Codes(vocabulary), _Words()
        mask = np.uint64(min(1 << 24, 1 << max(20, (8 * len(wanted)).bit_length())) - 1)
        first = np.zeros(int(mask) + 1, bool)  # most windows end here
        first[(wanted & mask).astype(np.int64)] = True
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, end in _chunks(texts):
                found = _Windows(texts[at:end], codes, size)
                found.keep(np.flatnonzero(first[(found.template & mask).astype(np.int64)]))
                found.keep(np.flatnonzero(among(wanted, found.template)))
                if len(found.start):
                    wording, pattern = found.slots(full)
                    found.keep(np.flatnonzero(among(fitting, _rolled([found.template, wording if by == "wording" else pattern]))))
                if len(found.start):
                    yield found.batch(batch.column(0).slice(at, end - at), id_col, {})

    return spread(texts.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, template long, words array<string>")


def candidates(documents: DataFrame, items: DataFrame, by: str, least_own: int = 0, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Windows of documents that have an item's template and fitting slots, and the items' windows.

    Slots fit if they are equal (``by`` wording) or equal in the same places (``by``
    pattern).  The held-out set is the query set: it is gone through in blocks of
    ``BLOCK_WINDOWS`` windows, each of which is one pass over the corpus.  Sets of
    usual size are one block.  Both results are written tables.
    """
    # Few by construction: the words of an average item divided by the share.
    vocabulary = [r.word for r in shared_words(items, text_col).orderBy("word").collect()]
    own = materialise(item_windows(items, item_col, text_col, vocabulary, size), "items").where(F.col("own") >= least_own)
    hashes = own.select("template", by).distinct()
    blocks = max(1, -(-hashes.count() // BLOCK_WINDOWS))
    found = None
    for block in range(blocks):
        part = hashes.where(F.pmod(F.xxhash64("template"), F.lit(blocks)) == block)
        pairs = np.array([tuple(r) for r in part.toLocalIterator()], np.int64).reshape(-1, 2).view(np.uint64)  # a block at most
        if not len(pairs):
            continue
        hits = matching_windows(documents, doc_col, text_col, vocabulary, np.unique(pairs[:, 0]), np.unique(pairs[:, 1]), by, size)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = own.select(F.lit(None).cast(documents.schema[doc_col].dataType).alias(doc_col), "template", "words").where("false")
    return materialise(found, "hits"), own


def verbatim(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(``doc_col``, ``item_col``) of documents that hold ``size`` consecutive words of an item.

    Null and empty texts and items of fewer words have no rows; repeated texts
    count under each of their ids; null ids are left out.
    """
    hits, own = candidates(documents, items, "wording", 0, doc_col, item_col, text_col, size)
    # The words themselves are compared, not their hashes alone.
    key = [F.col("template"), F.xxhash64("words").alias("slots"), F.col("words")]
    left = hits.where(F.col(doc_col).isNotNull()).select(doc_col, *key)
    right = own.where(F.col(item_col).isNotNull()).select(item_col, *key).distinct()
    right = F.broadcast(right) if small(right, 100_000) else right
    return left.join(right, ["template", "slots", "words"]).select(doc_col, item_col).distinct()


def reparameterised(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", size: int = WINDOW, least_shared: int = 5, every: bool = False) -> DataFrame:
    """Documents with an item's template but other parameters.

    ``doc_col``, ``item_col``, ``windows``, ``example``: with ``every`` a row for
    each item the document re-parameterises, else each window counts under the
    smallest of them.  The slots of passage and item correspond one to one, and at
    least ``least_shared`` words of a window are the template's own, else it is no
    template but any text.  Items are grouped by template and by which of their words
    are equal, so every wording counts.  Passages that some item has verbatim are left out.
    Null ids and texts have no row as items; documents are reported under each
    of their ids.
    """
    hits, own = candidates(documents, items, "pattern", least_shared, doc_col, item_col, text_col, size)
    # Words correspond one to one exactly if equal words stand in the same places.
    pattern = F.array_join(F.transform("words", lambda w: F.array_position("words", w)), " ").alias("pattern")
    known = own.where(F.col(item_col).isNotNull()).select(item_col, "template", "words").distinct()
    wordings = known.select("template", "words").distinct()
    asked = materialise(hits.select("template", "words").distinct().join(wordings, ["template", "words"], "left_anti").select("template", "words", pattern), "asked")
    other = wordings.select("template", pattern, F.col("words").alias("others"))
    other = F.broadcast(other) if small(other, 100_000) else other
    passed = asked.join(other, ["template", "pattern"]).select("template", "words", "others")
    named = passed.join(known.withColumnRenamed("words", "others"), ["template", "others"]).select("template", "words", item_col)
    named = named.distinct() if every else named.groupBy("template", "words").agg(F.min(item_col).alias(item_col))
    return hits.join(named, ["template", "words"]).groupBy(doc_col, item_col).agg(F.count_distinct("template").alias("windows"), F.min(F.array_join("words", " ")).alias("example"))
