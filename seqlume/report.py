"""One report over a file of reads or a pair of files: a section for each kind of metric.

Every section is a small table that Spark has aggregated; only these reach the
driver.
"""

from __future__ import annotations

import html
import io
import json
import os
import zipfile
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlume.functions import columns as C
from seqlume.operators import adapters as A
from seqlume.operators import dedup, fragments, identify, nano, pairs, profile, reads
from seqlume.plans.bins import bins_for, label
from seqlume.plans.scratch import materialise
from seqlume.sources.small import header_technology

VERSION = "0.1"
ORDER = [
    "meta", "summary", "per_position_mean_quality_and_spread", "per_position_quality_distribution", "sequence_length_distribution", "per_position_base_content", "per_position_n_content",
    "per_sequence_gc_content", "per_sequence_quality_scores", "adapter_content", "per_tile_quality", "duplication_fractions", "overrepresented_sequences", "nanopore_metrics",
    "adapter_content_from_overlap", "insert_size_metrics",
]
_NAMES = [f"bottom {p}" for p in (1, 5, 10, 25, 50)] + ["mean"] + [f"top {p}" for p in (50, 25, 10, 5, 1)]


@dataclass(frozen=True)
class Options:
    """What the command line sets; the defaults are those of single-end runs."""

    fraction: float = 0.001
    least: int = 100
    most: int = (1 << 63) - 1
    most_fragments: int = fragments.MOST_UNIQUE
    fragment_length: int = fragments.K
    sample_every: int = fragments.SAMPLE_EVERY
    from_start: int = fragments.FROM_START
    from_end: int = fragments.FROM_END
    most_fingerprints: int = dedup.MOST_STORED
    front_length: int = 8
    back_length: int = 8
    front_offset: int | None = None
    back_offset: int | None = None


def _dense(rows: list, size: int, place: str, value: str, fill: float = 0) -> list:
    out = [fill] * size
    for row in rows:
        out[row[place]] = row[value]
    return out


def _positions(read_table: DataFrame) -> tuple[dict[str, list], int, list[tuple[int, int]]]:
    """All position counts by kind, the longest read, and its bins."""
    counts = materialise(profile.profile(read_table), "profile")
    longest = profile.longest_read(counts.where("kind = 'base'"))
    return counts, longest, bins_for(longest) if longest else []


def _quality_and_content(read_table: DataFrame) -> tuple[dict[str, dict], int, list[tuple[int, int]]]:
    counts, longest, bins = _positions(read_table)
    labels, size = [label(a, b) for a, b in bins], len(bins)
    ends = min(profile.END, longest)
    views = {"": ("", size, None), "front": ("", ends, "pos < 100"), "end": ("end_", ends, None)}

    def part(kind: str, view: str) -> DataFrame:
        lead, _, where = views[view]
        if not view:
            return profile.binned(counts, kind, [], longest)
        found = counts.where(F.col("kind") == lead + kind)
        if where:
            found = found.where(where)
        shift = F.lit(profile.END - ends) if view == "end" else F.lit(0)
        return found.select((F.col("pos") - shift).alias("bin"), "code", "n")

    def spread(view: str) -> list:
        rows = profile.quality_spread(part("phred", view), []).collect()
        return [[n, _dense([r for r in rows if r.series == n], views[view][1], "bin", "phred", 0.0)] for n in _NAMES]

    def shares(view: str) -> list:
        rows = profile.fractions(part("phred", view), []).collect()
        return [_dense([r for r in rows if r.code == c], views[view][1], "bin", "fraction", 0.0) for c in range(12)]

    def content(view: str) -> dict:
        rows = profile.base_content(part("base", view), []).collect()
        return {b: _dense([r for r in rows if r.code == c], views[view][1], "bin", "fraction", 0.0) for c, b in enumerate("ACGT")}

    unknown = profile.n_content(part("base", ""), []).collect()
    return {
        "per_position_mean_quality_and_spread": {"x_labels": labels, "percentiles": spread(""), "front_percentiles": spread("front"), "end_percentiles": spread("end")},
        "per_position_quality_distribution": {"x_labels": labels, "series": shares(""), "front_anchored_series": shares("front"), "end_anchored_series": shares("end")},
        "per_position_base_content": {"x_labels": labels, **content(""), "front_anchored": content("front"), "end_anchored": content("end")},
        "per_position_n_content": {"x_labels": labels, "n_content": _dense(unknown, size, "bin", "fraction", 0.0)},
    }, longest, bins


def _whole_reads(facts: DataFrame, longest: int, bins: list[tuple[int, int]]) -> dict[str, dict]:
    overview = reads.summary(facts, []).first().asDict()
    counts = materialise(reads.lengths(facts, []), "lengths")
    quantiles = (reads.length_percentiles(counts, []).first() or None) if overview["total_reads"] else None
    half = reads.n50_n90(counts, []).first()
    distribution = reads.length_distribution(counts, [], longest).collect()
    gc = _dense(reads.gc_histogram(facts, []).collect(), 101, "gc", "n")
    scores = _dense(reads.phred_histogram(facts, []).collect(), 94, "phred", "n")
    return {
        "summary": overview,
        "sequence_length_distribution": {
            "length_ranges": ["0", *[label(a, b) for a, b in bins]], "counts": _dense(distribution, len(bins) + 1, "slot", "n"),
            **{f"q{p}": (quantiles[f"q{p}"] if quantiles else 0) or 0 for p in reads.PERCENTILES}, "n50": half.n50 or 0, "n90": half.n90 or 0,
        },
        "per_sequence_gc_content": {
            "gc_content_counts": gc, "smoothened_gc_content_counts": [sum(gc[i : i + 2]) for i in range(0, 101, 2)],
            "x_labels": [str(i) for i in range(101)], "smoothened_x_labels": [str(i) for i in range(0, 101, 2)],
        },
        "per_sequence_quality_scores": {"average_quality_counts": scores, "x_labels": [str(i) for i in range(94)]},
    }


def _tiles(read_table: DataFrame, longest: int, bins: list[tuple[int, int]]) -> dict:
    first_bad = read_table.where(C.tile(F.col("name")).isNull()).agg(F.min_by("name", "read_idx").alias("name"), F.count("*").alias("n")).first()
    empty = {"x_labels": [], "normalized_per_tile_averages": [], "tiles_2x_errors": [], "tiles_10x_errors": []}
    if first_bad.n:
        return empty | {"skipped_reason": f"Can not parse header: {first_bad.name}"}
    deviation = materialise(profile.tile_deviation(profile.tile_errors(read_table, C.tile(F.col("name"))), [], longest), "tiles")
    flags = profile.flagged_tiles(deviation, []).collect()
    lines: dict[int, list[float]] = {}
    for row in deviation.orderBy("tile").collect():
        lines.setdefault(row.tile, [0.0] * len(bins))[row.bin] = row.deviation
    return {
        "x_labels": [label(a, b) for a, b in bins], "normalized_per_tile_averages": [[str(t), v] for t, v in lines.items()],
        "tiles_2x_errors": [str(r.tile) for r in flags if r.errors == "2x"], "tiles_10x_errors": [str(r.tile) for r in flags if r.errors == "10x"], "skipped_reason": None,
    }


def _overrepresented(read_table: DataFrame, library: DataFrame | None, o: Options) -> dict:
    lists = materialise(fragments.fragment_lists(fragments.sampled(read_table, o.sample_every), [], o.fragment_length, o.from_start, o.from_end), "fragments")
    counts = fragments.fragment_counts(lists, [])
    unique = counts.count()
    if unique > o.most_fragments:
        counts = fragments.first_come(fragments.sampled(read_table, o.sample_every), o.most_fragments, o.fragment_length, o.from_start, o.from_end)
    totals = fragments.fragment_totals(lists, [])
    found = fragments.overrepresented(counts, totals, [], o.fraction, o.least, o.most).orderBy(F.desc("n"), F.desc("fragment"))
    rows = found.withColumn("revcomp", C.reverse_complement(F.col("fragment"))).collect()  # at most bases / threshold
    known = {}
    if library is not None and rows:
        known = {r.query: r for r in identify.identified(found.select(F.col("fragment").alias("query")), library).collect()}
    total = totals.first()
    return {
        "overrepresented_sequences": [
            {"count": r.n, "fraction": r.fraction, "sequence": r.fragment, "revcomp_sequence": r.revcomp, "most_matches": known[r.fragment].matches if r.fragment in known else 0,
             "max_matches": o.fragment_length, "best_match": known[r.fragment].name if r.fragment in known else "No match"} for r in rows
        ],
        "max_unique_fragments": o.most_fragments, "collected_fragments": min(unique, o.most_fragments), "sample_every": o.sample_every, "sequence_length": o.fragment_length,
        "total_fragments": total.total_fragments, "total_sequences": read_table.count(), "sampled_sequences": total.sampled,
    }


def _duplicates(counts: DataFrame, o: Options, front_offset: int, back_offset: int) -> dict:
    kept, _ = dedup.subsampled(counts, o.most_fingerprints)
    histogram = materialise(dedup.duplication_histogram(kept, []), "duplicates")
    rows = histogram.orderBy("times").collect()
    total = sum(r.times * r.fingerprints for r in rows)
    unique = sum(r.fingerprints for r in rows)
    shares = dedup.duplication_buckets(histogram, []).orderBy("slot").collect()
    return {
        "tracked_unique_sequences": unique, "duplication_counts": [[r.times, r.fingerprints] for r in rows], "remaining_fraction": unique / total if total else 1.0,
        "estimated_duplication_fractions": {r.bucket: (r.fraction or 0.0) for r in shares}, "fingerprint_front_sequence_length": o.front_length,
        "fingerprint_back_sequence_length": o.back_length, "fingerprint_front_sequence_offset": front_offset, "fingerprint_back_sequence_offset": back_offset,
    }


def _nano(read_table: DataFrame) -> dict:
    empty = {k: [] for k in ("x_labels", "time_bases", "time_reads", "time_active_channels", "qual_percentages_over_time", "translocation_speed")} | {"per_channel_bases": {}, "per_channel_quality": {}, "reads_with_parent": None, "total_reads": None}
    table = read_table
    for name, kind in (("channel", "int"), ("start_time", "timestamp"), ("duration", "float"), ("parent_id", "string")):
        if name not in table.columns:
            table = table.withColumn(name, F.lit(None).cast(kind))
    facts = materialise(nano.nano_facts(table, []).withColumnRenamed("start", "start"), "nano")
    bad = facts.where("channel is null or start is null").count()
    if bad:
        first = read_table.where(C.header_value(F.col("name"), "ch").isNull() | C.header_time(F.col("name")).isNull()).agg(F.min_by("name", "read_idx")).first()[0]
        return empty | {"skipped_reason": f"Can not parse header: {first}"}
    slots = nano.time_slots(facts, []).orderBy("slot").collect()
    width = slots[1]["from"] if len(slots) > 1 else 1
    speeds = _dense(nano.translocation(facts, []).collect(), nano.SPEEDS, "slot", "n")
    by_channel = nano.channels(facts, []).orderBy("channel").collect()
    split = nano.split_reads(facts, []).first()

    def clock(seconds: int) -> str:
        return f"{seconds // 3600:02d}:{seconds % 3600 // 60:02d}"

    return {
        "x_labels": [f"{clock(r['from'])}-{clock(r['from'] + width)}" for r in slots], "time_bases": [r.bases for r in slots], "time_reads": [r.reads for r in slots],
        "time_active_channels": [r.channels for r in slots], "qual_percentages_over_time": [[r[f"bin{i}"] / max(r.reads, 1) for r in slots] for i in range(12)],
        "per_channel_bases": {str(r.channel): r.bases for r in by_channel}, "per_channel_quality": {str(r.channel): r.phred for r in by_channel}, "translocation_speed": speeds,
        "reads_with_parent": split.with_parent or None, "total_reads": split.reads, "skipped_reason": None,
    }


def _adapter_content(read_table: DataFrame, listed: list[tuple[str, str, str]], longest: int, bins: list[tuple[int, int]]) -> dict:
    counts = materialise(A.hit_counts(A.hits(read_table, listed, []), []), "adapters")
    totals = read_table.agg(F.count("*").alias("reads"))

    def view(name: str, size: int) -> list:
        if not longest or not listed:
            return [[n, []] for n, _, _ in listed]
        rows = A.curve(counts, totals, listed, [], longest, name).collect()
        return [[n, _dense([r for r in rows if r.adapter == b], size, "bin", "percent", 0.0)] for n, b, _ in listed]

    ends = min(100, longest)
    return {"x_labels": [label(a, b) for a, b in bins], "adapter_content": view("all", len(bins)), "front_adapter_content": view("front", ends), "end_adapter_content": view("end", ends)}


def _overlap(paired: DataFrame, library: DataFrame | None) -> dict[str, dict]:
    sized = materialise(pairs.insert_sizes(paired, []), "inserts")
    histogram = pairs.insert_histogram(sized, []).collect()
    found = materialise(pairs.overlap_adapters(sized, []), "tails")
    top = pairs.top_by_length(found, []).orderBy("mate", "length").collect()
    numbers = {r.mate: r.n for r in found.groupBy("mate").agg(F.sum("n").alias("n")).collect()}
    section: dict = {"total_reads": sum(r.n for r in histogram)}
    for mate in (1, 2):
        own = [[r.adapter, r.n] for r in top if r.mate == mate]
        longest, match = own[-1][0] if own else "", "No match"
        if longest and library is not None:
            match = identify.identified(sized.sparkSession.createDataFrame([(longest,)], "query string"), library).first().name
        section |= {f"number_of_adapters_read{mate}": numbers.get(mate, 0), f"adapters_read{mate}": own, f"longest_adapter_read{mate}": longest, f"longest_adapter_read{mate}_match": match}
    return {"adapter_content_from_overlap": section, "insert_size_metrics": {"insert_sizes": _dense(histogram, max([r.insert for r in histogram], default=0) + 1, "insert", "n")}}


def _one_file(read_table: DataFrame, library: DataFrame | None, o: Options) -> tuple[dict[str, dict], int, list[tuple[int, int]]]:
    found, longest, bins = _quality_and_content(read_table)
    found |= _whole_reads(materialise(reads.facts(read_table, []), "facts"), longest, bins)
    found["per_tile_quality"] = _tiles(read_table, longest, bins) if longest else {"x_labels": [], "normalized_per_tile_averages": [], "tiles_2x_errors": [], "tiles_10x_errors": [], "skipped_reason": None}
    found["overrepresented_sequences"] = _overrepresented(read_table, library, o)
    return found, longest, bins


def build(first: DataFrame, second: DataFrame | None = None, adapters: list[tuple[str, str, str]] | None = None, library: DataFrame | None = None, options: Options | None = None, paths: tuple[str, ...] = ()) -> dict[str, dict]:
    """The report of one table of reads or of two mates' tables, by section.

    ``first`` and ``second`` have ``read_idx``, ``name``, ``sequence`` and
    ``qualities``.  ValueError if mates do not belong together.
    """
    o = options or Options()
    sizes = [os.path.getsize(p) if os.path.exists(p) else 0 for p in paths]
    meta = {"seqlume_version": VERSION, "filename": os.path.basename(paths[0]) if paths else "", "filesize": sizes[0] if sizes else 0,
            "filename_read2": os.path.basename(paths[1]) if len(paths) > 1 else None, "filesize_read2": sizes[1] if len(sizes) > 1 else None}
    found: dict[str, dict] = {"meta": meta}
    own, longest, bins = _one_file(first, library, o)
    if second is None:
        found |= {k: v | {"read_pair_info": None} for k, v in own.items()}
        found["adapter_content"] = _adapter_content(first, adapters or [], longest, bins)
        offsets = (64 if o.front_offset is None else o.front_offset, 0 if o.back_offset is None else o.back_offset)
        prints = dedup.fingerprint_counts(first, C.fingerprint(F.coalesce("sequence", F.lit("")), o.front_length, o.back_length, *offsets), [])
        found["duplication_fractions"] = _duplicates(prints, o, *offsets)
    else:
        paired = materialise(pairs.zipped(first, second), "pairs")
        problems = {r.problem: (r.n, r.example) for r in paired.where("problem is not null").groupBy("problem").agg(F.count("*").alias("n"), F.min(F.struct("read_idx", "name1", "name2")).alias("example")).collect()}
        if "names differ" in problems:
            example = problems["names differ"][1]
            raise ValueError(f"Mates do not match: {example.name1!r} and {example.name2!r}")
        for problem, text in (("read 1 only", "FASTQ Files out of sync: more reads in file 1"), ("read 2 only", "FASTQ Files out of sync: more reads in file 2")):
            if problem in problems:
                raise ValueError(text)
        other, _, _ = _one_file(second, library, o)
        found |= {k: v | {"read_pair_info": "Read 1"} for k, v in own.items()}
        found |= {f"{k}_read2": v | {"read_pair_info": "Read 2"} for k, v in other.items()}
        found |= _overlap(paired, library)
        offsets = (o.front_offset or 0, o.back_offset or 0)
        prints = dedup.fingerprint_counts(paired.where("sequence1 is not null and sequence2 is not null"), C.pair_fingerprint(F.col("sequence1"), F.col("sequence2"), o.front_length, o.back_length, *offsets), [])
        found["duplication_fractions"] = _duplicates(prints, o, *offsets)
    header = first.where("name is not null").orderBy("read_idx").select("name").first()
    if header and header_technology(header.name) == "nanopore" or "channel" in first.columns:
        found["nanopore_metrics"] = _nano(first)
    else:
        found["nanopore_metrics"] = {"skipped_reason": f"Can not parse header: {header.name}" if header else None, "total_reads": None}
    keys = [k + suffix for k in ORDER for suffix in ("", "_read2")]
    return {k: found[k] for k in keys if k in found}


def write_json(report: dict[str, dict], path: str, indent: int | None = None) -> None:
    with open(path, "w") as out:
        json.dump(report, out, indent=indent)


#: Percent of reads that an adapter must reach to be drawn.
LEGEND_LEAST = 0.1


def _lines_svg(title: str, series: list[tuple[str, list[float]]], width: int = 720, height: int = 260) -> str:
    """Polylines of a few series over one axis."""
    longest = max([len(v) for _, v in series], default=0)
    top = max([max(v, default=0) for _, v in series], default=0) or 1
    low = min([min(v, default=0) for _, v in series] + [0])
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" role="img"><title>{html.escape(title)}</title>', f'<text x="8" y="16" font-size="13">{html.escape(title)}</text>']
    for i, (name, values) in enumerate(series):
        points = " ".join(f"{40 + (width - 60) * x / max(longest - 1, 1):.1f},{height - 20 - (height - 50) * (v - low) / (top - low):.1f}" for x, v in enumerate(values))
        parts.append(f'<polyline fill="none" stroke="hsl({i * 360 // max(len(series), 1)},60%,40%)" points="{points}"><title>{html.escape(name)}</title></polyline>')
    parts.append(f'<text x="2" y="34" font-size="11">{top:.4g}</text><text x="2" y="{height - 22}" font-size="11">{low:.4g}</text></svg>')
    return "".join(parts)


def plots(report: dict[str, dict]) -> dict[str, str]:
    """A picture of each section that has series, by file name."""
    found: dict[str, str] = {}
    for section, content in report.items():
        for field, value in content.items():
            name = f"{section}_{field}"
            if isinstance(value, list) and value and all(isinstance(v, list) and len(v) == 2 and isinstance(v[1], list) for v in value):
                shown = [(str(n), v) for n, v in value]
                if section == "adapter_content":  # adapters that reach a tenth of a percent, the most frequent first
                    shown = sorted((x for x in shown if max(x[1], default=0) >= LEGEND_LEAST), key=lambda x: -max(x[1]))
                if shown:
                    found[name] = _lines_svg(name.replace("_", " "), shown)
            elif isinstance(value, list) and value and all(isinstance(v, list) and v and all(isinstance(x, int | float) for x in v) and len(v) > 2 for v in value):
                found[name] = _lines_svg(name.replace("_", " "), [(str(i), v) for i, v in enumerate(value)])
            elif isinstance(value, dict) and value and all(isinstance(v, list) for v in value.values()):
                found[name] = _lines_svg(name.replace("_", " "), list(value.items()))
            elif isinstance(value, list) and len(value) > 1 and all(isinstance(v, int | float) for v in value):
                found[name] = _lines_svg(name.replace("_", " "), [(field, value)])
    return found


def write_html(report: dict[str, dict], path: str) -> None:
    """The report as one page: contents, and for each section its values and pictures."""
    pictures = plots(report)
    body = io.StringIO()
    body.write("<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>Read quality report</title><style>body{font-family:sans-serif;max-width:60em;margin:auto}td{padding:0 1em}svg{width:100%}</style></head><body><h1>Read quality report</h1><ul>")
    body.write("".join(f"<li><a href='#{k}'>{k.replace('_', ' ')}</a></li>" for k in report) + "</ul>")
    for section, content in report.items():
        body.write(f"<h2 id='{section}'>{section.replace('_', ' ')}</h2><table>")
        for field, value in content.items():
            if not isinstance(value, list | dict):
                body.write(f"<tr><td>{field.replace('_', ' ')}</td><td>{html.escape(str(value))}</td></tr>")
        for row in content.get("overrepresented_sequences", []):
            body.write(f"<tr><td><code>{row['sequence']}</code></td><td>{row['count']}</td><td>{html.escape(row['best_match'])}</td></tr>")
        body.write("</table>" + "".join(v for k, v in pictures.items() if k.startswith(section + "_") and not any(k.startswith(s + "_") and len(s) > len(section) for s in report)))
    body.write("</body></html>")
    with open(path, "w") as out:
        out.write(body.getvalue())


def write_images(report: dict[str, dict], path: str) -> None:
    """All pictures in an archive with a fixed date, so that equal reports make equal files."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, picture in plots(report).items():
            archive.writestr(zipfile.ZipInfo(f"{name}.svg", (1980, 1, 1, 0, 0, 0)), picture)
