"""Nanopore runs over time and by channel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlume.functions.columns import header_time, header_value, norm, uuid_valid, whole_number
from seqlume.operators.profile import usable_scores
from seqlume.operators.reads import scores

SLOTS = 200
SPEEDS = 81


def nano_facts(reads: DataFrame, by: list[str]) -> DataFrame:
    """``by``, ``channel``, ``start`` (seconds), ``duration``, ``length``, ``error``, ``score`` and ``split``.

    A null channel, time or duration is taken from the header if that has it.
    ``score`` is the mean, rounded half to even, 0 for empty reads.  Rows that
    repeat a ``read_idx`` are one read.
    """
    name = F.col("name")
    once = reads.dropDuplicates(["read_idx"])
    start = F.coalesce(F.unix_timestamp(F.col("start_time").cast("timestamp")), F.unix_timestamp(header_time(name)))
    channel = F.coalesce(F.col("channel").cast("long"), whole_number(header_value(name, "ch")))
    duration = F.coalesce(F.col("duration").cast("double"), header_value(name, "du").try_cast("double"))
    parent = F.coalesce(F.col("parent_id"), header_value(name, "pi"))
    base = once.select(
        *by, channel.alias("channel"), start.alias("start"), duration.alias("duration"), F.coalesce(F.length(norm(F.col("sequence"))), F.lit(0)).alias("length"),
        scores(usable_scores(F.col("sequence"), F.col("qualities"))).alias("s"), uuid_valid(parent).alias("split"),
    )
    error = F.col("s.error")
    score = F.when((F.col("length") > 0) & (error > 0), F.bround(-10 * F.log10(error / F.col("length"))).cast("int")).otherwise(0)
    return base.select(*by, "channel", "start", "duration", "length", error.alias("error"), score.alias("score"), "split")


def time_range(facts: DataFrame, by: list[str], slots: int = SLOTS) -> DataFrame:
    """First and last start, and the width of a slot in whole minutes (1 second if all start at once)."""
    ends = facts.where("start > 0").groupBy(*by).agg(F.min("start").alias("first"), F.max("start").alias("last"))
    width = F.greatest(F.floor((F.ceil((F.col("last") - F.col("first")) / slots) + 59) / 60) * 60, F.lit(1))
    return ends.withColumn("width", width)


def time_slots(facts: DataFrame, by: list[str]) -> DataFrame:
    """``slot``, ``from`` (seconds after the first start), ``channels``, ``bases``, ``reads`` and the reads of each score bin.

    Slots without reads are included.
    """
    ranges = time_range(facts, by)
    placed = facts.where("start > 0")
    joined = placed.join(F.broadcast(ranges), by) if by else placed.crossJoin(F.broadcast(ranges))  # a row for each group
    slot = F.floor((F.col("start") - F.col("first")) / F.col("width")).cast("int").alias("slot")
    bins = F.shiftright(F.least(F.greatest("score", F.lit(0)), F.lit(47)), 2)
    summed = joined.groupBy(*by, slot).agg(
        F.count_distinct("channel").alias("channels"), F.sum("length").cast("long").alias("bases"), F.count("*").alias("reads"), *[F.count_if(bins == i).alias(f"bin{i}") for i in range(12)]
    )
    frame = ranges.select(*by, "width", F.explode(F.sequence(F.lit(0), F.floor((F.col("last") - F.col("first")) / F.col("width")).cast("int"))).alias("slot"))
    on = [frame[c].eqNullSafe(summed[c]) for c in [*by, "slot"]]
    counts = ["channels", "bases", "reads", *[f"bin{i}" for i in range(12)]]
    return frame.join(summed, on, "left").select(*[frame[c] for c in [*by, "slot"]], (frame["slot"] * frame["width"]).cast("long").alias("from"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])


def channels(facts: DataFrame, by: list[str]) -> DataFrame:
    """Bases and mean score of each channel; -1 stands for an unknown one."""
    summed = facts.groupBy(*by, F.coalesce("channel", F.lit(-1)).alias("channel")).agg(F.sum("length").cast("long").alias("bases"), F.sum("error").alias("error"))
    return summed.select(*by, "channel", "bases", F.when((F.col("bases") > 0) & (F.col("error") > 0), F.round(-10 * F.log10(F.col("error") / F.col("bases")), 4)).otherwise(0.0).alias("phred"))


def translocation(facts: DataFrame, by: list[str]) -> DataFrame:
    """Reads by speed, in slots of 10 bases a second; the last is open."""
    speed = F.bround(F.col("length") / F.col("duration")).cast("long")
    return facts.where("duration > 0").groupBy(*by, F.floor(F.least(speed, F.lit(800)) / 10).cast("int").alias("slot")).agg(F.count("*").alias("n"))


def split_reads(facts: DataFrame, by: list[str]) -> DataFrame:
    """Reads, and those that name a parent."""
    return facts.groupBy(*by).agg(F.count("*").alias("reads"), F.count_if("split").alias("with_parent"))
