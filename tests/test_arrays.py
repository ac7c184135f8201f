from pyspark.sql import types as T

from eventloom.functions import arrays
from eventloom.functions.expressions import compile_expression


def test_primitives(spark):
    df = spark.createDataFrame([([[1.0, None], []], [1.0], True), (None, [], None)], "n array<array<double>>, a array<double>, b boolean")
    n, a = compile_expression("n", df.schema), compile_expression("a", df.schema)
    row = df.select(*[x.column for x in (arrays.counts(n), arrays.pad(n, 2), arrays.flatten(n), arrays.flatten(a), arrays.fill_none(n, 0), arrays.values_as_type(a, "int"), arrays.valid_entry_mask(n))]).collect()
    assert tuple(row[0]) == ([1, 0], [[1.0, None], [None, None]], [1.0, None], [1.0], [[1.0, 0.0], []], [1], True)
    assert row[1][-1] is False and arrays.filtered_len(df, "b") == 1 and arrays.only_valid_entries(df, "n", "b").count() == 1
    assert arrays.is_bool(T.ArrayType(T.BooleanType())) and arrays.dtype(df.schema["n"].dataType) == "float"
