"""Adapters and known sequences that reports look for if no files are given."""

from __future__ import annotations

#: Probes of common adapters (name, technology, sequence, position).
ADAPTERS = [
    ("Illumina Universal Adapter", "illumina", "AGATCGGAAGAG", "end"),
    ("Illumina Small RNA 3' adapter", "illumina", "TGGAATTCTCGG", "end"),
    ("Illumina Small RNA 5' adapter", "illumina", "GATCGTCGGACT", "end"),
    ("Nextera Transposase Sequence", "illumina", "CTGTCTCTTATA", "end"),
    ("PolyG", "illumina", "GGGGGGGGGGGG", "end"),
    ("PolyA", "illumina", "AAAAAAAAAAAA", "end"),
    ("Oxford nanopore ligation kit or Adapter Mix (AMX), top strand", "nanopore", "TTACGTATTGCT", "start"),
    ("Oxford nanopore ligation kit or Adapter Mix (AMX), bottom strand ", "nanopore", "GCAATACGTAAC", "end"),
    ("Oxford nanopore cDNA RT Adapter (CRT)", "nanopore", "CTTGCGGGCGGC", "end"),
    ("Oxford nanopore RT Adapter (RTA), top strand", "nanopore", "GGTAGTAGGTTC", "start"),
    ("Oxford nanopore RT Adapter (RTA), and RNA Adapter Mix (RMX), bottom strand", "nanopore", "GAGGCGAGCGGT", "end"),
    ("Oxford nanopore RNA Adapter Mix (RMX); top strand", "nanopore", "CAAGATACGCAC", "start"),
    ("Oxford nanpore cDNA primer, forward sequence", "nanopore", "GTGACTTGCCTG", "start"),
    ("Oxford nanopore CDNA primer, forward and reverse sequence", "nanopore", "ATCGCCTACCGT", "end"),
    ("Oxford nanopore VN primer", "nanopore", "TCTATCTTCTTT", "end"),
    ("Oxford nanopore RT Primer (RTP)", "nanopore", "TCTTCAGAGGAG", "start"),
    ("Oford nanopore Strand Switching Primer (SSP)", "nanopore", "GATATTGCTGGG", "start"),
    ("Oxford nanopore Strand Switching Primer II (SSPII)", "nanopore", "TGATATTGCTTT", "start"),
    ("Oxford nanopore Native Adapter (NA), top strand", "nanopore", "GTACGTATTGCT", "start"),
    ("Oxford nanopore Native Adapter (NA), bottom strand", "nanopore", "ACGTAACTGAAC", "end"),
]

#: Own compilation of published adapter and primer sequences.
_PUBLISHED = {
    "Illumina P5 flow cell primer": "AATGATACGGCGACCACCGA",
    "Illumina P7 flow cell primer": "CAAGCAGAAGACGGCATACGAGAT",
    "Illumina TruSeq universal adapter": "AATGATACGGCGACCACCGAGATCTACACTCTTTCCCTACACGACGCTCTTCCGATCT",
    "Illumina TruSeq read 1 adapter": "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA",
    "Illumina TruSeq read 2 adapter": "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT",
    "Illumina read 1 sequencing primer": "ACACTCTTTCCCTACACGACGCTCTTCCGATCT",
    "Illumina read 2 sequencing primer": "GTGACTGGAGTTCAGACGTGTGCTCTTCCGATCT",
    "Illumina Nextera transposase, read 1": "TCGTCGGCAGCGTCAGATGTGTATAAGAGACAG",
    "Illumina Nextera transposase, read 2": "GTCTCGTGGGCTCGGAGATGTGTATAAGAGACAG",
    "Illumina small RNA 3' adapter": "TGGAATTCTCGGGTGCCAAGG",
    "Illumina small RNA 5' adapter": "GTTCAGAGTTCTACAGTCCGACGATC",
    "Oxford Nanopore ligation adapter, top strand": "CCTGTACTTCGTTCAGTTACGTATTGCT",
    "Oxford Nanopore ligation adapter, bottom strand": "GCAATACGTAACTGAACGAAGTACAGG",
    "Oxford Nanopore strand switching primer": "TTTCTGTTGGTGCTGATATTGCTGGG",
    "Oxford Nanopore VN primer": "ACTTGCCTGTCGCTCTATCTTCTTT",
}
#: Six bases of the TruSeq indexes 1 to 12.
_INDEXES = "ATCACG CGATGT TTAGGC TGACCA ACAGTG GCCAAT CAGATC ACTTGA GATCAG TAGCTT GGCTAC CTTGTA".split()


def adapters(technology: str | None = None) -> list[tuple[str, str, str, str]]:
    """The probes of a technology, or all of them if it is not known."""
    return [a for a in ADAPTERS if technology is None or a[1] in (technology, "all")]


def known_sequences() -> dict[str, str]:
    """Known sequences by name; single bases repeated and indexed adapters follow from rules."""
    indexed = {f"Illumina TruSeq adapter, index {i}": f"GATCGGAAGAGCACACGTCTGAACTCCAGTCAC{x}ATCTCGTATGCCGTCTTCTGCTTG" for i, x in enumerate(_INDEXES, 1)}
    repeated = {f"Poly-{b}": b * 40 for b in "ACGT"}
    return _PUBLISHED | indexed | repeated
