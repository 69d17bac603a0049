import pytest

from tarnql.functions.types import Schema, Type


def test_type_grammar():
    assert Type("char(10)").size == 10 and Type("int").kind == "int"
    for bad in ("text", "char", "int(3)", "char(10) ", "varchar(3)", "", "double;"):
        with pytest.raises(ValueError):
            Type(bad)


def test_values():
    assert Type("char(3)").parse("abcdef") == "abc"
    assert Type("char(5)").parse("ab  ") == "ab"
    assert Type("date").parse("1995-03-15") == 19950315
    assert Schema("e", [("id", "int"), ("dob", "char(10)"), ("pay", "double")]).values_from_strings(["1", "1990-01-01", "2.5"]) == [1, "1990-01-01", 2.5]


def test_schema_operations():
    e = Schema("employee", [("id", "int"), ("age", "int")])
    assert e.schema() == [("id", "int"), ("age", "int")]
    assert e.default() == (0, 0) and e.instantiate(1, 2).age == 2
    assert e.rename("other", {"id": "id2", "age": "age2"}).fields == ["id2", "age2"]
    with pytest.raises(KeyError):
        e.rename("other", {"id": "id2"})
    assert e.match(Schema("x", [("id", "int"), ("age", "int")])) and not e.match(Schema("x", [("age", "int"), ("id", "int")]))
    assert e.project(e.instantiate(1, 2), Schema("a", [("age", "int")])) == (2,)
    with pytest.raises(ValueError):
        e.project(e.instantiate(1, 2), Schema("a", [("pay", "int")]))
    assert Schema.from_json(e.to_json()).schema() == e.schema()
    with pytest.raises(ValueError):
        Schema("twice", [("a", "int"), ("a", "int")])


def test_stored_columns(spark):
    df = spark.createDataFrame([("abcdé", 200)], "s string, n int")
    from pyspark.sql import functions as F

    assert df.select(Type("char(4)").stored(F.col("s"))).first()[0] == "abcd"
    assert df.select(Type("byte").stored(F.col("n"))).first()[0] == 200
    with pytest.raises(Exception):
        df.select(Type("byte").stored(F.col("n") * 2)).collect()
