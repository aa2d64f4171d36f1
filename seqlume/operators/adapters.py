"""Where adapters occur in reads, and how far they reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlume.functions.columns import norm
from seqlume.plans.bins import bin_index, bins_for

#: Adapters come from a short list; more than this is no such list.
MOST_ADAPTERS = 2_000


def listed(adapters: DataFrame, technology: str | None = None) -> list[tuple[str, str, str]]:
    """(name, normal sequence, position) of the adapters of a technology or of all.

    Entries of one sequence are one adapter, the last (by name) of them.
    """
    chosen = adapters if technology is None else adapters.where(F.lower(F.trim("sequencing_technology")).isin(technology, "all"))
    once = chosen.where("length(sequence) > 0").groupBy(norm(F.col("sequence")).alias("bases")).agg(F.max(F.struct(F.trim("name").alias("name"), F.lower(F.trim("sequence_position")).alias("position"))).alias("a"))
    rows = once.select("a.name", "bases", "a.position").orderBy("bases").limit(MOST_ADAPTERS + 1).collect()
    if len(rows) > MOST_ADAPTERS:
        raise ValueError(f"more than {MOST_ADAPTERS} adapters")
    for row in rows:
        if row.position not in ("start", "end"):
            raise ValueError(f"adapter {row.name}: position must be start or end, not {row.position}")
    return [tuple(row) for row in rows]


def hits(reads: DataFrame, adapters: list[tuple[str, str, str]], by: list[str]) -> DataFrame:
    """First occurrence of each adapter in each read: ``adapter``, ``pos`` from the start, ``back`` from the end.

    The adapters are literals of the projection, so nothing is joined.
    """
    if not adapters:
        return reads.select(*by, F.lit("").alias("adapter"), F.lit(0).alias("pos"), F.lit(0).alias("back")).where("false")
    texts = reads.select(*by, norm(F.col("sequence")).alias("s")).where("length(s) > 0")
    found = F.array(*[F.struct(F.lit(bases).alias("adapter"), (F.instr("s", bases) - 1).alias("pos")) for _, bases, _ in adapters])
    rows = texts.select(*by, F.length("s").alias("length"), F.explode(F.filter(found, lambda x: x["pos"] >= 0)).alias("x"))
    return rows.select(*by, "x.adapter", "x.pos", (F.col("length") - 1 - F.col("x.pos")).alias("back"))


def hit_counts(found: DataFrame, by: list[str]) -> DataFrame:
    """Reads by adapter and place of its first occurrence."""
    return found.groupBy(*by, "adapter", "pos", "back").agg(F.count("*").alias("n"))


def curve(counts: DataFrame, totals: DataFrame, adapters: list[tuple[str, str, str]], by: list[str], longest: int, view: str = "all", window: int = 100) -> DataFrame:
    """Share of reads, in percent, that an adapter has reached: ``adapter``, ``bin``, ``percent``.

    Adapters at the end count from the left, those at the start from the right.
    ``view`` is all (bins of ``longest``), front (the first ``window`` places, from
    the right) or end (the last ``window``, from the left; bin 0 is the farthest
    from the end).  ``totals`` has ``by`` and ``reads``.
    """
    if view == "all":
        stops = [stop for _, stop in bins_for(longest)] or [1]
        place, size = bin_index(F.col("pos"), stops), len(stops)
    elif view == "front":
        place, size = F.when(F.col("pos") < window, F.col("pos")), min(window, max(longest, 1))
    else:
        size = min(window, max(longest, 1))
        place = F.when(F.col("back") < size, size - 1 - F.col("back"))
    summed = counts.select(*by, "adapter", place.alias("bin"), "n").where("bin is not null").groupBy(*by, "adapter", "bin").agg(F.sum("n").alias("n"))
    entries = F.array(*[F.struct(F.lit(b).alias("adapter"), F.lit(n).alias("name"), F.lit(p).alias("position")) for n, b, p in adapters])
    frame = totals.select(*by, "reads", F.inline(entries)).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    on = [frame[c].eqNullSafe(summed[c]) for c in [*by, "adapter", "bin"]]
    full = frame.join(summed, on, "left").select(*[frame[c] for c in [*by, "reads", "name", "adapter", "position", "bin"]], F.coalesce("n", F.lit(0)).alias("n"))
    place_window = Window.partitionBy(*by, "adapter").orderBy("bin")
    left = F.sum("n").over(place_window.rowsBetween(Window.unboundedPreceding, 0))
    right = F.sum("n").over(place_window.rowsBetween(0, Window.unboundedFollowing))
    reached: Column = left if view == "end" else right if view == "front" else F.when(F.col("position") == "end", left).otherwise(right)
    return full.select(*by, "adapter", "name", "bin", F.round(reached * 100 / F.col("reads"), 6).alias("percent"))
