"""Small files the driver reads: FASTA libraries, adapter lists, and what a file's first bytes tell."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from seqlume.sources.bam import read_header
from seqlume.sources.defaults import known_sequences
from seqlume.sources.splits import compression_of, expand, open_binary


def _lines(path: str) -> Iterator[str]:
    """Lines of a file, or of all files of a folder."""
    for one in expand(path):
        with open_binary(one, compression_of(one)) as stream:
            yield from stream.read().decode("utf-8").splitlines()


def fasta(path: str) -> Iterator[tuple[str, str]]:
    """Names and sequences; a sequence may go over several lines."""
    name, parts = None, []
    for line in _lines(path):
        line = line.strip()
        if line.startswith(">"):
            if name is not None:
                yield name, "".join(parts)
            name, parts = line[1:], []
        elif line:
            parts.append(line)
    if name is not None:
        yield name, "".join(parts)


def library(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``name`` and ``sequence`` of all FASTA files; of equal names the last entry stays."""
    entries = {name: sequence for path in expand(paths) for name, sequence in fasta(path)}
    return spark.createDataFrame(list(entries.items()), "name string, sequence string")


def known_library(spark: SparkSession) -> DataFrame:
    """``name`` and ``sequence`` of the known sequences that come with the package."""
    return spark.createDataFrame(list(known_sequences().items()), "name string, sequence string")


def adapters(path: str, technology: str | None = None) -> list[tuple[str, str, str, str]]:
    """(name, technology, sequence, position) of a tab-separated list with # comments."""
    kept = "\n".join(line for line in map(str.strip, _lines(path)) if line and line[0] != "#")
    rows = [tuple(row) for row in csv.reader(io.StringIO(kept), "excel-tab", quoting=csv.QUOTE_NONE)]
    odd = {row[3:] for row in rows} - {("start",), ("end",)}
    if odd:
        raise ValueError(f"adapters lie at the start or the end of a read; the list has {sorted(odd)}")
    return [row for row in rows if technology is None or row[1] in (technology, "all")]


def adapters_table(spark: SparkSession, path: str, technology: str | None = None) -> DataFrame:
    return spark.createDataFrame(adapters(path, technology), "name string, sequencing_technology string, sequence string, sequence_position string")


def is_bam(path: str) -> bool:
    """By name, else by the first bytes."""
    if path.endswith(".bam"):
        return True
    with open_binary(path, compression_of(path)) as stream:
        return stream.read(4) == b"BAM\x01"


def header_technology(header: str) -> str | None:
    """What a FASTQ header looks like."""
    words = header.split(maxsplit=1)
    if words and words[0].count(":") == 6 and (len(words) == 1 or (words[1].count(":") == 3 and words[1].split(":")[1] in ("Y", "N"))):
        return "illumina"
    name, *rest = header.split() or [""]
    if re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", name) and any(w.startswith("ch") for w in rest) and any(w.startswith("st") for w in rest):
        return "nanopore"
    return None


def bam_technology(header: str) -> str | None:
    """The platform of the first read group that names a known one."""
    for line in header.splitlines():
        if line.startswith("@RG"):
            for field in line.split("\t")[1:]:
                tag, _, value = field.partition(":")
                if tag == "PL" and value in ("ONT", "Illumina"):
                    return {"ONT": "nanopore", "Illumina": "illumina"}[value]
    return None


def technology(path: str) -> str | None:
    """Sequencing technology of a FASTQ or BAM file, from its first header."""
    with open_binary(path, compression_of(path)) as stream:
        if is_bam(path):
            return bam_technology(read_header(stream))
        first = stream.read(1 << 16).split(b"\n", 1)[0]
    return header_technology(first[1:].decode("ascii", "replace")) if first.startswith(b"@") else None
