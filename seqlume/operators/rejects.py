"""Loading delimited lines: valid rows on one side, the others with a reason.

Structural checks (quoting, number of fields) look at each line.  Values are
judged once each: the distinct values of a column are checked, what is invalid
goes into a dictionary with its reason, and the dictionary is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlume.plans.scratch import materialise
from seqlume.plans.skew import lookup

FIELDS = ["sample", "name", "sequence", "qualities"]


def _body(line: Column) -> Column:
    """The line without one carriage return at its end."""
    return F.when(line.endswith("\r"), F.expr("substring(line, 1, length(line) - 1)")).otherwise(line)


def _bad_quoting(parts: Column) -> Column:
    """``parts`` is the line cut at every quote: odd parts are inside quotes.

    Between two quoted parts there is nothing (an escaped quote) or something
    that begins and ends with a comma; likewise at the ends of the line.
    """
    last = F.size(parts) - 1

    def wrong(x: Column, i: Column) -> Column:
        opens = (i > 0) & ~x.startswith(",")
        closes = (i < last) & ~x.endswith(",")
        return (i % 2 == 0) & (x != "") & (opens | closes)

    return (F.size(parts) % 2 == 0) | (F.size(F.filter(parts, wrong)) > 0)


def _quoted_fields(parts: Column) -> Column:
    """Fields of a line with quotes: commas outside of quotes divide."""
    numbered = F.transform(parts, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    last = F.size(parts) - 1
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, part: Column) -> Column:
        x, i = part["x"], part["i"]
        cut = F.split(x, ",", -1)
        outside = F.when(F.size(cut) == 1, F.struct(state["done"].alias("done"), F.concat(state["open"], x).alias("open"))).otherwise(
            F.struct(
                F.concat(state["done"], F.array(F.concat(state["open"], cut[0])), F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 2, F.lit(0)))).alias("done"),
                F.element_at(cut, -1).alias("open"),
            )
        )
        inside = F.struct(state["done"].alias("done"), F.concat(state["open"], x).alias("open"))
        escaped = F.struct(state["done"].alias("done"), F.concat(state["open"], F.lit('"')).alias("open"))
        return F.when(i % 2 == 1, inside).when((x == "") & (i > 0) & (i < last), escaped).otherwise(outside)

    return F.aggregate(numbered, start, step, lambda s: F.concat(s["done"], F.array(s["open"])))


def parsed(lines: DataFrame, id_col: str = "row_id", line_col: str = "line") -> DataFrame:
    """``id_col``, ``problem`` (quoting, columns or null) and the four fields where there is none."""
    body = lines.select(F.col(id_col), F.col(line_col).alias("line")).select(id_col, _body(F.col("line")).alias("line"))
    cut = body.withColumn("parts", F.split("line", '"', -1)).withColumn(
        "fields", F.when(F.size("parts") == 1, F.split("line", ",", -1)).when(~_bad_quoting(F.col("parts")), _quoted_fields(F.col("parts")))
    )
    problem = F.when(F.col("line").isNull(), "columns").when(F.col("fields").isNull(), "quoting").when(F.size("fields") != len(FIELDS), "columns")
    return cut.select(id_col, problem.alias("problem"), *[F.when(problem.isNull(), F.get("fields", F.lit(i))).alias(f) for i, f in enumerate(FIELDS)])


def judged_values(rows: DataFrame) -> DataFrame:
    """``field``, ``value``, ``reason`` and ``rows``: a row for each distinct value of a judged column.

    The reason is worked out above the aggregate, so once for each distinct value
    and not for each row.  Valid values have a null reason, and their text is dropped.
    """
    values = rows.where("problem is null").select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("name", "qualities")])))
    counted = values.groupBy("field", "value").agg(F.count("*").alias("rows"))
    reason = (
        F.when((F.col("field") == "name") & (F.col("value") == ""), "empty")
        .when((F.col("field") == "name") & F.col("value").rlike(r"[^\x20-\x7E]"), "character")
        .when((F.col("field") == "qualities") & F.col("value").rlike(r"[^\x21-\x7E]"), "character")
    )
    return counted.select("field", "value", reason.alias("reason"), "rows").select("field", F.when(F.col("reason").isNotNull(), F.col("value")).alias("value"), "reason", "rows")


def invalid_values(rows: DataFrame) -> DataFrame:
    """The dictionary, a written table: each distinct invalid value once, with its reason.

    The verdicts are written before the valid ones are left out: as one plan the
    optimizer would move the judging below the aggregate, back to every row.
    """
    return materialise(judged_values(rows), "verdicts").where("reason is not null")


def checked(lines: DataFrame, id_col: str = "row_id", line_col: str = "line") -> DataFrame:
    """Every line with its fields and ``reason``, null for valid ones, and ``detail``.

    The reason is the first that holds: quoting, columns, name, qualities.  The
    detail is the dictionary's (empty, character), or length for qualities of
    another length than the sequence.  A null line has no fields (columns), an
    empty line has one (columns).  Empty sequence with empty qualities is valid;
    sample and sequence are not judged.  Repeated ids and lines are judged each on
    their own, and columns other than the two named are not read.
    """
    rows = materialise(parsed(lines, id_col, line_col), "lines")
    bad = invalid_values(rows)
    keep = [id_col, "problem", *FIELDS]
    for field in ("name", "qualities"):
        own = bad.where(F.col("field") == field).select(F.col("value").alias(field), F.col("reason").alias(f"{field}_reason"), F.col("rows"))
        rows = lookup(rows, own, [field], "left", weight="rows").select(*keep, f"{field}_reason")
        keep.append(f"{field}_reason")
    uneven = F.length("sequence") != F.length("qualities")
    reason = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("name_reason").isNotNull(), "name")
        .when(F.col("qualities_reason").isNotNull() | uneven, "qualities")
    )
    detail = F.when(F.col("problem").isNull(), F.coalesce("name_reason", "qualities_reason", F.when(uneven, "length")))
    return rows.select(id_col, *FIELDS, reason.alias("reason"), detail.alias("detail"))


def rejected(lines: DataFrame, id_col: str = "row_id", line_col: str = "line") -> DataFrame:
    """``id_col`` and ``reason`` of the lines that fail."""
    return checked(lines, id_col, line_col).where("reason is not null").select(id_col, "reason")


def accepted(lines: DataFrame, id_col: str = "row_id", line_col: str = "line") -> DataFrame:
    """``id_col`` and the four fields of the lines that are valid."""
    return checked(lines, id_col, line_col).where("reason is null").select(id_col, *FIELDS)
