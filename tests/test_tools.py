import json

import pytest

from docweft.functions.tools import calculator_error, calculator_value, register_sql_functions
from docweft.operators.tools import calculator_registry, dispatched, last_wins, listed_calls_planner, tool_loop, union_of


@pytest.mark.parametrize(
    ("op", "x", "y", "value", "error"),
    [
        ("add", 15.0, 27.0, 42.0, None),
        ("divide", 144.0, 12.0, 12.0, None),
        ("multiply", 8.0, 9.0, 72.0, None),
        ("multiply", 25.5, 4.0, 102.0, None),
        ("subtract", 1000.0, 99.0, 901.0, None),
        ("divide", 5.0, 0.0, None, "Error: Division by zero"),
        ("power", 5.0, 2.0, None, "Error: Unknown operation"),
    ],
)
def test_calculator(spark, op, x, y, value, error):
    df = spark.createDataFrame([(op, x, y)], "op string, x double, y double")
    row = df.select(
        calculator_value(df.op, df.x, df.y).alias("v"), calculator_error(df.op, df.y).alias("e")
    ).first()
    assert (row.v, row.e) == (value, error)


def test_sql_functions(spark):
    register_sql_functions(spark)
    register_sql_functions(spark)
    row = spark.sql("SELECT add_numbers(36939.0, 8922.4) a, add_two(3) b, calculate('divide', 1, 0) c").first()
    assert (row.a, row.b, row.c) == (45861.4, 5, None)


def test_unknown_tools_are_rows_not_failures(spark):
    calls = spark.createDataFrame([("add", 1.0, 2.0), ("nope", 1.0, 2.0)], "name string, x double, y double")
    got = {r.name: (r.output, r.error) for r in dispatched(calls, calculator_registry(spark)).collect()}
    assert got == {"add": ("3.0000", None), "nope": (None, "Unknown tool: nope")}


def test_registries(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "name string, ord int, kind string")
    assert {r.name: r.kind for r in last_wins(rows, "ord").collect()} == {"a": "y", "b": "z"}
    both = union_of({"one": rows, "two": rows.where("name = 'a'")})
    assert sorted(map(tuple, both.collect())) == [("one", "a"), ("one", "b"), ("two", "a")]


def items(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.request_id, r.round)):
        out.setdefault(r.request_id, []).append((r.round, r.type, r.content))
    return out


def asking(spark, rows):
    made = [(i, answered, calls if isinstance(calls, str) else json.dumps([dict(zip(("name", "x", "y"), c, strict=True)) for c in calls])) for i, answered, calls in rows]
    return spark.createDataFrame(made, "request_id bigint, answered boolean, prompt string")


def test_loop_of_two_steps(spark):
    two = [("subtract", 100.0, 37.0), ("add", 63.0, 50.0)]
    got = items(tool_loop(asking(spark, [(1, False, two), (2, True, two), (3, False, [])]), listed_calls_planner))
    assert got == {
        1: [
            (1, "function_call", "subtract(100.0000, 37.0000)"),
            (2, "function_call_output", "63.0000"),
            (3, "function_call", "add(63.0000, 50.0000)"),
            (4, "function_call_output", "113.0000"),
            (5, "message", "Answer: 113.0000"),
        ],
        3: [(1, "message", "Answer: nothing to compute")],
    }


@pytest.mark.parametrize(("rounds", "n_calls", "stopped"), [(10, 4, False), (10, 5, True), (3, 1, True), (5, 1, False)])
def test_loop_is_bounded(spark, rounds, n_calls, stopped):
    """An answer given in the last allowed round is still followed by the stop message."""
    requests = asking(spark, [(1, False, [("add", 1.0, float(n)) for n in range(1, n_calls + 1)])])
    got = items(tool_loop(requests, listed_calls_planner, max_rounds=rounds))[1]
    assert (got[-1][2] == "Max iterations reached. Stopping.") == stopped
    assert len(got) <= rounds + 1
    if not stopped:
        assert got[-1] == (2 * n_calls + 1, "message", f"Answer: {1 + n_calls}.0000")


def test_loop_without_open_requests(spark):
    assert tool_loop(asking(spark, [(1, True, [("add", 1.0, 1.0)])]), listed_calls_planner).count() == 0


def test_planner_reacts_to_what_tools_give(spark):
    def doubling():
        def reply(conversation):
            messages = json.loads(conversation)
            outputs = [m["content"] for m in messages if m["type"] == "function_call_output"]
            if not outputs:
                return json.dumps({"name": "power", "x": 2.0, "y": 3.0})
            if outputs[-1].startswith("Error"):
                return json.dumps({"name": "multiply", "x": float(messages[0]["content"]), "y": 2.0})
            last = float(outputs[-1])
            return "enough" if last > 50 else json.dumps({"name": "multiply", "x": last, "y": 2.0})

        return lambda conversations: [reply(c) for c in conversations]

    got = items(tool_loop(asking(spark, [(1, False, "20"), (2, False, "40")]), doubling))
    failed = [(1, "function_call", "power(2.0000, 3.0000)"), (2, "function_call_output", "Error: Unknown operation")]
    assert got[2] == failed + [(3, "function_call", "multiply(40.0000, 2.0000)"), (4, "function_call_output", "80.0000"), (5, "message", "enough")]
    assert [c for _, _, c in got[1]][2:] == ["multiply(20.0000, 2.0000)", "40.0000", "multiply(40.0000, 2.0000)", "80.0000", "enough"]


def test_loop_runs_registered_tools_only(spark):
    registry = spark.createDataFrame([("add",)], "name string")
    got = items(tool_loop(asking(spark, [(1, False, [("subtract", 2.0, 1.0), ("add", 2.0, 1.0)])]), listed_calls_planner, registry))[1]
    assert [c for _, t, c in got if t == "function_call_output"] == ["Error: Unknown operation", "3.0000"]
