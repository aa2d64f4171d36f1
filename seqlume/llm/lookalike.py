"""One form for texts that look the same.

The corpus vocabulary stands in tries.  A token that has look-alikes is walked
through them with a weighted edit automaton: look-alikes, characters without
width and composed or joined forms cost nothing, a second reading of a shape
(capital I and small l) a little, any other change more than the budget.  Of the
spellings that are reached at least cost the canonical one is chosen by a rule
that depends on the set only, so look-alike tokens agree.  Tokens that reach
nothing in the vocabulary are normalised by table.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlume.plans.scratch import materialise, spread
from seqlume.plans.skew import lookup, small

#: Letters of other scripts, and marks, with the shape of a Latin letter or common mark.
LOOK_ALIKE = {
    # Greek capitals and small letters
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ν": "v", "ο": "o", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "а": "a", "е": "e", "о": "o", "р": "p",
    "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "ӏ": "l", "Ӏ": "I", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ӕ": "Æ", "ӕ": "æ", "Ә": "Ə", "ә": "ə", "Ѵ": "V", "ѵ": "v", "Ꙇ": "I", "ꙇ": "i",
    # Armenian, and letters of Latin extensions
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "Տ": "S", "Օ": "O", "ɑ": "a", "ɡ": "g", "ı": "i", "ǃ": "!",
    # Coptic
    "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮒ": "h",
    "Ꮓ": "Z", "Ꮞ": "4", "Ꮟ": "b", "Ꮢ": "R", "Ꮪ": "S", "Ꮩ": "V", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏻ": "G", "Ᏼ": "B",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L",
    "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Marks
    "‐": "-", "‑": "-", "⁃": "-", "﹣": "-", "ʹ": "'", "ʼ": "'", "＇": "'", "‛": "'",
    "⁄": "/", "∕": "/", "∶": ":", "ː": ":", "‚": ",", "․": ".", "∗": "*", "µ": "μ", "Ω": "Ω", "∣": "|", "ǀ": "|",
}
#: A shape that is read in two ways: the second reading costs little, so a word of the
#: vocabulary is found by it where the first reading gives none.
SECOND = {"I": "l", "l": "I"}
SECOND_COST, EDIT_COST = 0.25, 1.0
#: What a token may cost to reach a spelling: two second readings, and no edit.
BUDGET = 0.5
#: Characters that tokens and spellings must share to be walked together (below the cost of an edit).
PREFIX = 6
#: Words of a trie where edits are allowed and every token is walked through every trie.
TRIE_WORDS = 200_000
#: Longer tokens are normalised by table.
LONGEST = 100
#: Characters without width outside the format category.
_NO_WIDTH = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))


def _by_rule(ch: str) -> str | None:
    """What decides for most characters: their decomposition in the Unicode data.

    Wide, narrow and no-break forms and joined letters are folded.  Raised
    digits, styled letters and the like are visible differences and stay.
    """
    if unicodedata.category(ch) == "Cf" or ch in _NO_WIDTH:
        return ""
    kind, _, codes = unicodedata.decomposition(ch).partition(" ")
    if kind in ("<wide>", "<narrow>", "<noBreak>"):
        return "".join(chr(int(c, 16)) for c in codes.split())
    if kind == "<compat>" and unicodedata.category(ch) in ("Ll", "Lu", "Lt", "Nl") and ch != "ſ":
        parts = [chr(int(c, 16)) for c in codes.split()]
        if all(p.isalpha() for p in parts) and (len(parts) > 1 or unicodedata.category(ch) == "Nl"):
            return "".join(parts)
    return None


def _table() -> dict[int, str]:
    found: dict[int, str] = {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000 or 0x3400 <= code < 0xA000 or 0xAC00 <= code < 0xD7A4 or 0x20000 <= code < 0xE0000:
            continue
        to = _by_rule(chr(code))
        if to is not None:
            found[code] = to
    for source, to in LOOK_ALIKE.items():
        found[ord(source)] = to
    for code, to in list(found.items()):  # a fold may lead to another
        found[code] = "".join(found.get(ord(c), c) for c in to)
    return found


TABLE = _table()


def _in_word(ch: str) -> bool:
    """Does a character belong to a word as it looks?  The same for look-alikes."""
    return all(unicodedata.category(c)[0] in "LNM" for c in TABLE.get(ord(ch), ch))


#: Folds of what is never part of a word, such as spaces and hyphens.
_BETWEEN = {code: to for code, to in TABLE.items() if not _in_word(chr(code))}


def _ranges(keep) -> str:  # noqa: ANN001
    """The characters beyond ASCII that ``keep`` accepts, as ranges of a character class."""
    found: list[list[int]] = []
    for code in range(0x80, sys.maxunicode + 1):
        if not 0xD800 <= code < 0xE000 and keep(chr(code)):
            if found and found[-1][1] == code - 1:
                found[-1][1] = code
            else:
                found.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found)


_LETTER = "[^\\W_" + _ranges(lambda c: c.isalnum() and not _in_word(c)) + "]"
_MARK = "(?![\\x00-\\x7f])[" + _ranges(lambda c: _in_word(c) and not c.isalnum()) + "]"
_TOKEN = re.compile(f"(?:{_LETTER}|{_MARK})+")
#: Only tokens that hold something beyond ASCII.
_FOREIGN = re.compile(f"(?<![0-9A-Za-z])[0-9A-Za-z]*+(?![\\x00-\\x7f])(?:{_LETTER}|{_MARK})+")


def _fold(piece: str, table: dict[int, str]) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", piece).translate(table))


class _Folds(dict):
    """Folded pieces by piece; emptied when full, and long pieces are not kept."""

    def __init__(self, table: dict[int, str]):
        super().__init__()
        self.table = table

    def __missing__(self, piece: str) -> str:
        to = _fold(piece, self.table)
        if len(piece) <= 40:
            if len(self) >= 200_000:
                self.clear()
            self[piece] = to
        return to

    def apply(self, text: str) -> str:
        """The text with each run beyond ASCII folded, with the character before it.

        Marks combine with that character at most, and characters of ASCII never
        with what precedes them, so this equals folding the text as a whole.
        """
        return _RUN.sub(lambda run: self[run.group()], text)


_RUN = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+")
_BY_TABLE, _BY_BETWEEN = _Folds(TABLE), _Folds(_BETWEEN)


def by_table(text: str) -> str:
    """The form of ``text`` by the table alone; equal for texts that look the same."""
    return text if text.isascii() else _BY_TABLE.apply(text)


def _shown(token: str) -> str:
    """The characters of ``token`` one by one as they look, without those that have no width."""
    return token if token.isascii() else unicodedata.normalize("NFD", token).translate(TABLE)


class _Node:
    __slots__ = ("children", "steps", "ends")

    def __init__(self) -> None:
        self.children: dict[str, _Node] = {}
        #: First character as it looks -> (what follows it, child); "" for characters without width.
        self.steps: dict[str, list[tuple[str, _Node]]] = {}
        self.ends: list[tuple[str, int]] = []


class Trie:
    """Vocabulary spellings, walked with an automaton of weighted edits.

    A spelling is stored under its decomposed characters.  A step from a node costs
    nothing if query and edge look alike or the edge has no width, ``SECOND_COST``
    for a second reading, and ``EDIT_COST`` for each other insertion, deletion or
    replacement, up to ``budget`` in all.
    """

    __slots__ = ("root", "budget")

    def __init__(self, spellings: dict[str, int], budget: float = 0):
        self.root = _Node()
        self.budget = budget
        for spelling, count in spellings.items():
            node = self.root
            for ch in spelling if spelling.isascii() else unicodedata.normalize("NFD", spelling):
                child = node.children.get(ch)
                if child is None:
                    child = node.children[ch] = _Node()
                    looks = TABLE.get(ord(ch), ch)
                    node.steps.setdefault(looks[:1], []).append((looks[1:], child))
                node = child
            node.ends.append((spelling, count))

    def search(self, query: str) -> list[tuple[float, str, int]]:
        """(cost, spelling, count) of every spelling within the budget."""
        wanted, budget = _shown(query), self.budget
        best: dict[str, tuple[float, int]] = {}
        stack: list[tuple[_Node, int, float]] = [(self.root, 0, 0)]
        seen: dict[tuple[int, int], float] = {}
        while stack:
            node, at, cost = stack.pop()
            if seen.get((id(node), at), budget + 1) <= cost:
                continue
            seen[id(node), at] = cost
            if at == len(wanted):
                for spelling, count in node.ends:
                    if cost < best.get(spelling, (budget + 1, 0))[0]:
                        best[spelling] = (cost, count)
            else:
                ch = wanted[at]
                for first, more in ((ch, 0), (SECOND.get(ch), SECOND_COST)):
                    for rest, child in node.steps.get(first, ()) if first else ():
                        paid = cost + more + self._rest(rest, wanted, at + 1)
                        if paid <= budget:
                            stack.append((child, at + 1 + len(rest), paid))
            for _, child in node.steps.get("", ()):
                stack.append((child, at, cost))
            if cost + EDIT_COST <= budget:
                for child in node.children.values():
                    stack.append((child, at, cost + EDIT_COST))
                    if at < len(wanted):
                        stack.append((child, at + 1, cost + EDIT_COST))
                if at < len(wanted):
                    stack.append((node, at + 1, cost + EDIT_COST))
        return sorted((cost, spelling, count) for spelling, (cost, count) in best.items())

    def _rest(self, rest: str, wanted: str, at: int) -> float:
        """What the further characters of a joined form cost."""
        paid = 0.0
        for i, ch in enumerate(rest):
            other = wanted[at + i : at + i + 1]
            if other != ch:
                paid += SECOND_COST if other and SECOND.get(other) == ch else self.budget + 1
        return paid


def _one_script(token: str) -> bool:
    scripts = {unicodedata.name(c, "?").split(" ")[0] for c in token if c.isalpha()}
    return len(scripts) <= 1


def _plain(token: str) -> bool:
    """Could this spelling be canonical: one script, composed, nothing folded by rule."""
    if token.isascii():
        return True
    return (
        unicodedata.is_normalized("NFC", token)
        and not any(ord(c) in TABLE and c not in LOOK_ALIKE for c in token)
        and _one_script(token)
    )


def _rank(form: str, cost: float, spelling: str, count: int) -> tuple:
    """The order in which spellings are canonical: least cost first; then the form by table
    (it is what readers of the Latin spelling get), the most frequent, and by code point."""
    return (cost, spelling != form, -count, spelling)


def vocabulary(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """Tokens of all texts: ``token``, ``n``.

    Counts gather in each Python worker and leave it when 300,000 tokens are
    held, so memory is bounded; the sums shuffle once, on distinct tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            tokens = list(counts)
            cols = [pa.array(tokens, pa.string()), pa.array([counts[t] for t in tokens], pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(cols, names=["token", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(_TOKEN.findall(text))
                if len(counts) > 300_000:
                    yield out()
        if counts:
            yield out()

    return spread(documents.select(text_col)).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _keyed(words: DataFrame) -> DataFrame:
    """``key``, ``token``, ``n``, ``asks`` (may its spelling change) and ``plain`` (may it be canonical).

    All spellings that a token reaches below the cost of an edit have its key: the
    first characters as they look, second readings brought together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for token in batch.column(0).to_pylist():
                shown, plain = _shown(token), _plain(token)
                # A plain spelling that is its own form by table is canonical.
                asks = not token.isascii() and (not plain or by_table(token) != token)
                rows.append((shown[:PREFIX].replace("I", "l") if len(shown) <= LONGEST else None, asks, plain))
            cols = [pa.array([r[0] for r in rows], pa.string()), batch.column(0), batch.column(1), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "token", "n", "asks", "plain"])

    return words.mapInArrow(run, "key string, token string, n long, asks boolean, plain boolean").where("key is not null")


def spellings(words: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``token`` and its canonical ``spelling``, for tokens with look-alikes, and their ``form`` by table.

    ``words`` is the result of ``vocabulary``.  ``known`` tells whether the
    vocabulary or the table gave the spelling.  Tries are built for the words of one
    prefix as it looks, which is all that can be reached without an edit.  If the
    budget allows edits, tries hold ``TRIE_WORDS`` each and every token is walked
    through all of them.
    """
    words = materialise(_keyed(words), "vocabulary")  # read twice, counted once
    asking = words.where("asks")
    edits = budget >= EDIT_COST
    if edits:
        tries = -(-words.where("plain").count() // TRIE_WORDS) or 1
        entries = words.where("plain").withColumn("key", F.pmod(F.xxhash64("token"), F.lit(tries)).cast("string"))
        asked = asking.withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)).cast("array<string>")))
    else:
        keys = asking.select("key").distinct()
        entries = words.where("plain").join(F.broadcast(keys) if small(keys) else keys, "key", "left_semi")
        asked = asking
    entries = entries.select("key", "token", "n", F.lit(False).alias("asks"))
    dealt = entries.unionByName(asked.select("key", "token", "n", F.lit(True).alias("asks"))).repartition("key").sortWithinPartitions("key", "asks", "token")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens, trie, at = {}, [], None, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["token", "form", "spelling", "cost", "n"])

        for batch in batches:
            for key, token, n, asks in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key != at:
                    held, trie, at = {}, None, key
                if not asks:
                    held[token] = n
                    continue
                trie = trie or Trie(held, budget)  # a prefix's words come before what asks
                form = by_table(token)
                cost, _, n, spelling = min((_rank(form, c, s, k) for c, s, k in trie.search(token)), default=(None, None, None, None))
                tokens.append((token, form, spelling, cost, None if n is None else -n))
            if tokens:
                yield out(tokens)
                tokens = []

    found = dealt.mapInArrow(run, "token string, form string, spelling string, cost double, n long")
    if edits:
        order = F.struct("cost", F.col("spelling") != F.col("form"), -F.col("n"), "spelling")
        found = found.groupBy("token", "form").agg(F.min_by("spelling", F.when(F.col("spelling").isNotNull(), order)).alias("spelling"))
    return found.select("token", F.coalesce("spelling", "form").alias("spelling"), F.col("spelling").isNotNull().alias("known"), "form")


def rewrite(text: str, spelling: dict[str, str]) -> str:
    """``text`` with each token in canonical spelling and the rest by table."""
    if text.isascii():
        return text

    def one(match: re.Match) -> str:
        token = match.group()
        found = spelling.get(token)
        return by_table(token) if found is None else found

    return _BY_BETWEEN.apply(_FOREIGN.sub(one, text))


def canonical(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_tokens: int = 400_000, budget: float = BUDGET) -> DataFrame:
    """``id_col``, ``text`` (the input) and ``canonical`` for every row.

    Null stays null and an empty text empty; null and repeated ids are kept.  Texts that look
    the same by the table are equal in ``canonical``, whatever the ``budget``.  The dictionary of
    changed spellings is broadcast if it has at most ``broadcast_tokens``
    entries; beyond that each text is joined with the spellings of its own
    tokens, which a text bounds.
    """
    source = documents.select(F.col(id_col), F.col(text_col).alias("text"))
    found = materialise(spellings(vocabulary(source), budget), "spellings")
    # Tokens that are not listed here get their form by table.
    changed = found.where("spelling != form").select("token", "spelling")
    if small(changed, broadcast_tokens):
        pairs = changed.agg(F.map_from_entries(F.collect_list(F.struct("token", "spelling"))).alias("spelling"))
        # One row with a map of checked size.
        table = documents.sparkSession.sparkContext.broadcast((pairs.first() or [{}])[0] or {})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = table.value
            for batch in batches:
                form = [t if t is None else rewrite(t, names) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(form, pa.string())], names=[id_col, "text", "canonical"])

        kind = source.schema[id_col].dataType.simpleString()
        return spread(source).mapInArrow(run, f"`{id_col}` {kind}, text string, canonical string")

    keyed = source.withColumn("_row", F.xxhash64("text", F.lit(7)))
    texts = keyed.where("text rlike '[^\\\\x00-\\\\x7F]'").select("_row", "text").distinct()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, w) for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in sorted(set(_TOKEN.findall(t))) if not w.isascii()]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.string())], names=["_row", "token"])

    own = texts.mapInArrow(tokens, "_row long, token string").distinct().join(changed, "token").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("token", "spelling"))).alias("names"))

    @F.pandas_udf("string")
    def apply(text, names):  # noqa: ANN001, ANN202
        return text.combine(names, lambda t, n: t if t is None else rewrite(t, dict(n or {})))

    return keyed.join(own, "_row", "left").select(id_col, "text", apply("text", "names").alias("canonical"))


def visible(col: Column) -> Column:
    """Whether a canonical text has anything to see."""
    return F.coalesce(col.rlike(r"\S"), F.lit(False))


def _looks(documents: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:  # noqa: ANN003
    """``doc``, ``look`` and ``text``: 128-bit digests of the canonical and the given form of what has something to see."""
    forms = canonical(documents, id_col, text_col, **options)

    def digest(name: str) -> Column:
        return F.struct(F.xxhash64(name).alias("a"), F.xxhash64(F.lit(11), F.col(name)).alias("b"))

    shown = forms.where(visible(F.col("canonical"))).where(F.col(id_col).isNotNull())
    return materialise(shown.select(F.col(id_col).alias("doc"), digest("canonical").alias("look"), digest("text").alias("text")), "looks")


def same_look(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:  # noqa: ANN003
    """Pairs (``doc_id_a`` < ``doc_id_b``) of texts that differ only in characters that look the same.

    Texts are compared by digests; what shuffles is a few longs a row.  Only groups
    with two or more different texts are paired, and never two exact copies of each
    other; ``looks_alike`` gives the same as classes.  Null ids, null texts
    and texts with nothing to see are in no pair; a repeated id gives a pair once.
    """
    marks = _looks(documents, id_col, text_col, **options)
    mixed = marks.groupBy("look").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo != hi").select("look")
    kept = marks.join(F.broadcast(mixed) if small(mixed) else mixed, "look", "left_semi")
    a, b = kept.alias("a"), kept.alias("b")
    return a.join(b, (F.col("a.look") == F.col("b.look")) & (F.col("a.doc") < F.col("b.doc")) & (F.col("a.text") != F.col("b.text"))).select(
        F.col("a.doc").alias("doc_id_a"), F.col("b.doc").alias("doc_id_b")
    ).distinct()


def looks_alike(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:  # noqa: ANN003
    """Classes of texts that look the same: ``id_col``, ``class_id`` (the smallest id), ``docs`` and ``texts`` (different ones) of the class.

    One row a document, whatever the size of its class; the rows of ``same_look`` are the
    pairs within classes of two or more texts.  Null ids and texts with nothing to
    see have no row; a repeated id has one row for each class it is in.
    """
    marks = _looks(documents, id_col, text_col, **options)
    texts = marks.groupBy("look", "text").agg(F.min("doc").alias("doc"), F.count("*").alias("n"))
    classes = texts.groupBy("look").agg(F.min("doc").alias("class_id"), F.sum("n").alias("docs"), F.count("*").alias("texts"))
    return lookup(marks, classes, ["look"], weight="docs").select(F.col("doc").alias(id_col), "class_id", "docs", "texts").distinct()
