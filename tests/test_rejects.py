import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqlume.operators import rejects


def walk(line):
    """The dialect, a character at a time: a reason or the four fields."""
    if line is None:
        return "columns"
    line = line[:-1] if line.endswith("\r") else line
    at, fields = 0, []
    while True:
        if line[at : at + 1] == '"':
            at, text = at + 1, ""
            while True:
                if at >= len(line):
                    return "quoting"
                if line[at] == '"':
                    if line[at + 1 : at + 2] != '"':
                        break
                    at += 1
                text += line[at]
                at += 1
            at += 1
            if at < len(line) and line[at] != ",":
                return "quoting"
        else:
            end = line.find(",", at)
            end = len(line) if end < 0 else end
            text, at = line[at:end], end
            if '"' in text:
                return "quoting"
        fields.append(text)
        if at >= len(line):
            break
        at += 1
    if len(fields) != 4:
        return "columns"
    if not fields[1] or any(not 32 <= ord(c) <= 126 for c in fields[1]):
        return "name"
    if len(fields[2]) != len(fields[3]) or any(not 33 <= ord(c) <= 126 for c in fields[3]):
        return "qualities"
    return tuple(fields)


def judge(spark, lines):
    rows = [(i, line, "x") for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "row_id long, line string, reason string")  # reason: a clashing name
    return {r.row_id: r.reason or (r["sample"], r["name"], r["sequence"], r["qualities"]) for r in rejects.checked(df).collect()}


def test_cases(spark):
    lines = [
        "s,n,AC,II", 's,"n",AC,II', '"s","n ""x""","AC","I"""', "s,n,AC,I\r", "s,n,AC,II\r", "s,n,,", "s,n,AC", "s,n,A,I,", 's,"n,AC,II', 's,n"x,AC,II', 's,"n"x,AC,II', ",,,", "", None, "\r",
        "s,n\x7f,A,I", "s,é,A,I", "s,n,A, ", "s, n,é,I", "s,n,A,I\r\r", '""""', '"', "s,n,A\n,I!", 's,"",A,I', "a" * 200_000 + ",n,,", '"' * 9_001 + ",b,,",
    ]
    got = judge(spark, lines)
    assert [got[i] for i in range(len(lines))] == [walk(x) for x in lines]


def test_random_lines(spark):
    rnd = random.Random(5)
    lines = ["".join(rnd.choice(['"', '"', "a", ",", ",", '""', "\r", '"a"', " ", "\n", "é", "AC", "II"]) for _ in range(rnd.randint(0, 16))) for _ in range(5_000)]
    got = judge(spark, lines)
    assert [got[i] for i in range(len(lines))] == [walk(x) for x in lines]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet='",ab\r', max_size=12), min_size=50, max_size=80))
def test_any_lines(spark, lines):
    got = judge(spark, lines)
    assert [got[i] for i in range(len(lines))] == [walk(x) for x in lines]


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "row_id long, line string")
    assert rejects.rejected(empty).count() == 0 and rejects.accepted(empty).count() == 0
    twice = spark.createDataFrame([(1, "s,n,A,I"), (1, "s,n,A,I"), (None, "bad")], "row_id long, line string")
    assert rejects.accepted(twice).count() == 2 and rejects.rejected(twice).count() == 1


@pytest.mark.parametrize("limit", [0, 10**6])
def test_hot_invalid_values(spark, monkeypatch, limit):
    from seqlume.plans import skew

    monkeypatch.setattr(skew, "small", lambda df, n=0: limit > 0)
    lines = ["s,,A,I"] * 300 + [f"s,n{i},A,I" for i in range(300)] + ["broken"] * 300
    got = judge(spark, lines)
    assert sum(v == "name" for v in got.values()) == 300 and sum(v == "columns" for v in got.values()) == 300


def test_values_are_judged_once_each_above_the_aggregate(spark):
    rows = rejects.parsed(spark.createDataFrame([(1, "s,n,A,I"), (2, "s,,A,I"), (3, "s,,A,I"), (4, "s,é,A,\x01"), (5, "bad")], "row_id long, line string"))
    plan = rejects.judged_values(rows)._jdf.queryExecution().executedPlan().toString().splitlines()
    final = next(i for i, line in enumerate(plan) if "HashAggregate" in line)  # results of the final aggregate, of which there is one a value
    assert "reason#" in plan[final] and not any("reason#" in line or "RLIKE" in line for line in plan[final + 1 :])
    found = {(r.field, r.value, r.reason, r.rows) for r in rejects.invalid_values(rows).collect()}
    assert found == {("name", "", "empty", 2), ("name", "é", "character", 1), ("qualities", "\x01", "character", 1)}


def test_reasons_come_back_from_the_dictionary(spark):
    df = spark.createDataFrame([(1, "s,n,A,I"), (2, "s,,A,I"), (3, "s,é,A,I"), (4, "s,n,A,\x01"), (5, "s,n,AA,I"), (6, "x")], "row_id long, line string")
    got = {r.row_id: (r.reason, r.detail) for r in rejects.checked(df).collect()}
    assert got == {1: (None, None), 2: ("name", "empty"), 3: ("name", "character"), 4: ("qualities", "character"), 5: ("qualities", "length"), 6: ("columns", None)}
