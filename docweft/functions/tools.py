"""Tool arithmetic and SQL-registered functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Operations and error texts of the calculator tool.
OPERATIONS = ("add", "subtract", "multiply", "divide")
DIVISION_ERROR = "Error: Division by zero"
OPERATION_ERROR = "Error: Unknown operation"


def calculator_value(op: Column, x: Column, y: Column) -> Column:
    return (
        F.when(op == "add", x + y)
        .when(op == "subtract", x - y)
        .when(op == "multiply", x * y)
        .when(op == "divide", F.try_divide(x, y))
    )


def calculator_error(op: Column, y: Column) -> Column:
    return F.when(~op.isin(*OPERATIONS), OPERATION_ERROR).when((op == "divide") & (y == 0), DIVISION_ERROR)


def number_text(value: Column) -> Column:
    """A number as text with four decimals, alike on every engine."""
    return F.round(value, 4).cast("decimal(38,4)").cast("string")


def value_or_error(error: Column, value: Column) -> Column:
    return F.coalesce(error, value)


def register_sql_functions(spark: SparkSession) -> None:
    """Scalar functions with declared types, replaced when they exist; callable by name."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION add_numbers(number_1 DOUBLE, number_2 DOUBLE) RETURNS DOUBLE "
        "COMMENT 'Sum of two numbers' RETURN number_1 + number_2"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION add_two(input BIGINT) RETURNS BIGINT "
        "COMMENT 'The input plus two' RETURN input + 2"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION calculate(operation STRING, x DOUBLE, y DOUBLE) RETURNS DOUBLE "
        "COMMENT 'Value of an arithmetic operation, null on error' "
        "RETURN CASE operation WHEN 'add' THEN x + y WHEN 'subtract' THEN x - y "
        "WHEN 'multiply' THEN x * y WHEN 'divide' THEN try_divide(x, y) END"
    )
