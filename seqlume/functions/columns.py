"""Column expressions over reads.  All of them are built in and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A Phred score's character is its number plus this; scores end at 93.
PHRED_OFFSET, PHRED_MAX = 33, 93
#: Mean error of the Phred score q, in units of 10^-12, and the unit.
ERROR_UNIT = 1_000_000_000_000
ERRORS = [round(ERROR_UNIT * 10 ** (-q / 10)) for q in range(PHRED_MAX + 1)]


def norm(sequence: Column) -> Column:
    """Upper case, and N for anything that is not one of the four bases."""
    return F.regexp_replace(F.upper(sequence), "[^ACGT]", "N")


def reverse_complement(normal: Column) -> Column:
    return F.reverse(F.translate(normal, "ACGT", "TGCA"))


def canonical(normal: Column) -> Column:
    """The smaller of a sequence and its reverse complement."""
    return F.least(normal, reverse_complement(normal))


def bases_of(normal: Column, which: str) -> Column:
    """How many of the given bases a normal sequence has."""
    return F.length(normal) - F.length(F.translate(normal, which, ""))


def gc_bucket(normal: Column) -> Column:
    """Percentage of G and C among known bases, half rounded up; null without any."""
    known = bases_of(normal, "ACGT")
    return F.when(known > 0, F.round(100.0 * bases_of(normal, "CG") / known).cast("int"))


def phred(character: Column) -> Column:
    """The score a character stands for, or null if it is none."""
    q = F.ascii(character) - PHRED_OFFSET
    return F.when((q >= 0) & (q <= PHRED_MAX), q)


def phred_bin(score: Column) -> Column:
    """Twelve bins of four scores; the last is open."""
    return F.shiftright(F.when(score > 47, 47).otherwise(score), 2)


def error_rate(score: Column) -> Column:
    """The error probability of a score, from the fixed table."""
    return F.element_at(F.array(*[F.lit(e) for e in ERRORS]), score + 1) / float(ERROR_UNIT)


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def tile(name: Column) -> Column:
    """Tile of an Illumina header: the 1 to 18 digits between the 4th and 5th colon, or null."""
    return F.nullif(F.regexp_extract(name, r"^(?:[^:]*:){4}([0-9]{1,18}):", 1), F.lit("")).cast("bigint")


def is_illumina(name: Column) -> Column:
    """First word with six colons; a comment, if any, with three colons and Y or N second."""
    return name.rlike(r"^[^\s:]*(?::[^\s:]*){6}(?:\s+(?:[^:]*:[YN]:[^:]*:[^:]*)?)?$")


def is_nanopore(name: Column) -> Column:
    """A UUID, and a comment with words that begin with ch and st."""
    uuid = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\s"
    return name.rlike(uuid) & name.rlike(r"\sch\S*") & name.rlike(r"\sst\S*")


def header_value(name: Column, key: str) -> Column:
    """The value of ``key`` in the comment of a nanopore header, ``key=value`` words or ``key:type:value`` tags."""
    found = F.regexp_extract(name, rf"[ \t]{key}(?:=|:[A-Za-z]:)([^ \t]*)", 1)
    return F.nullif(found, F.lit(""))


def header_time(name: Column) -> Column:
    """Start time in a nanopore header, as a timestamp or null; offsets from UTC are honoured."""
    return F.coalesce(*[F.try_to_timestamp(header_value(name, k)) for k in ("start_time", "st")])


def whole_number(text: Column) -> Column:
    """1 to 18 digits as a number, else null."""
    return F.when(text.rlike(r"^[0-9]{1,18}\z"), text).cast("bigint")


def read_id(name: Column) -> Column:
    """The header up to the first blank."""
    return F.regexp_extract(name, r"^[^ \t]*", 0)


def same_template(name1: Column, name2: Column) -> Column:
    """Do two headers name mates of one template?  A last 1 or 2 does not count."""
    a, b = read_id(name1), read_id(name2)
    bare = F.regexp_replace(a, "[12]$", "") == F.regexp_replace(b, "[12]$", "")
    return (a == b) | (a.rlike("[12]$") & b.rlike("[12]$") & bare)


def uuid_valid(text: Column) -> Column:
    """Is the text a version 4 UUID?"""
    return F.coalesce(text.rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-4[0-9a-fA-F]{3}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"), F.lit(False))


def uuid_number(text: Column) -> Column:
    """First and last eight hex digits of a version 4 UUID as a number, 0 for others."""
    digits = F.concat(F.substring(text, 1, 8), F.substring(text, 29, 8))
    return F.when(uuid_valid(text), F.conv(digits, 16, 10)).otherwise(F.lit("0")).cast("decimal(20,0)")


def clock(seconds: Column) -> Column:
    """Hours and minutes."""
    return F.format_string("%02d:%02d", F.floor(seconds / 3600), F.floor((seconds % 3600) / 60))


def fragment_starts(length: Column, k: int, from_start: int, from_end: int) -> Column:
    """Where the fragments of a read begin: k apart, from both ends to the middle.

    The two runs meet at the middle of ceil(length / k) fragments and cover
    ``from_start`` and ``from_end`` bases at most; negative means all.
    """
    most = F.ceil(length / k).cast("int")
    half = F.floor(most / 2).cast("int")
    whole = 1 << 30
    front = F.least(F.lit(-(-from_start // k) if from_start >= 0 else whole), most - half)
    back = F.least(F.lit(-(-from_end // k) if from_end >= 0 else whole), half)
    none = F.array().cast("array<int>")
    left = F.when(front > 0, F.transform(F.sequence(F.lit(0), front - 1), lambda i: i * k)).otherwise(none)
    right = F.when(back > 0, F.transform(F.sequence(F.lit(0), back - 1), lambda i: length - (back - i) * k)).otherwise(none)
    return F.when(length >= k, F.concat(left, right)).otherwise(none)


def fragments(normal: Column, k: int, from_start: int, from_end: int) -> Column:
    """Canonical fragments of a read without N, repeats included."""
    cut = F.transform(fragment_starts(F.length(normal), k, from_start, from_end), lambda p: F.substr(normal, p + 1, F.lit(k)))
    return F.transform(F.filter(cut, lambda x: ~F.contains(x, F.lit("N"))), canonical)


def fingerprint(sequence: Column, front: int = 8, back: int = 8, front_offset: int = 64, back_offset: int = 0) -> Column:
    """What tells a read from another: a few bases near both ends, and its length class."""
    n = F.length(sequence)
    slack = F.floor((n - (front + back)) / 2).cast("int")
    head = F.substr(sequence, F.least(slack, F.lit(front_offset)) + 1, F.lit(front))
    tail = F.substr(sequence, n - (F.least(slack, F.lit(back_offset)) + back) + 1, F.lit(back))
    short = F.struct(sequence.alias("bases"), F.lit(0).alias("length_class"))
    return F.when(n <= front + back, short).otherwise(F.struct(F.concat(head, tail).alias("bases"), F.shiftright(n, 6).alias("length_class")))


def pair_fingerprint(first: Column, second: Column, front: int = 8, back: int = 8, front_offset: int = 0, back_offset: int = 0) -> Column:
    """The same for a pair: bases near the start of either mate."""

    def part(s: Column, size: int, offset: int) -> Column:
        n = F.length(s)
        return F.substr(s, F.least(F.lit(offset), n - F.least(F.lit(size), n)) + 1, F.lit(size))

    return F.struct(F.concat(part(first, front, front_offset), part(second, back, back_offset)).alias("bases"), F.shiftright(F.length(first) + F.length(second), 6).alias("length_class"))
