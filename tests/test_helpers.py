"""Helpers: error messages in client output, array helpers, status documents,
loads without a conflict mode."""

import pytest
from pyspark.sql import functions as F

from keyspan.functions import (alter_state, element_pairs, expand_roles, parse_run_status, parse_vertical, parse_vertical_rows,
                               run_status_json, set_alter_state, sorted_set)
from keyspan.operators.transfer import import_rows


def test_error_messages(spark):
    df = spark.createDataFrame([("a: 1\nERROR 1045 (28000): denied\n",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(parse_vertical(F.col("t"))).collect()] == [{"a": "1", "error 1045 (28000)": "denied"}, {}, {}]
    for parse in (parse_vertical, parse_vertical_rows):
        with pytest.raises(Exception, match="denied"):
            df.select(parse(F.col("t"), errors="raise")).collect()
    fine = df.select(parse_vertical(F.lit("x: an ERROR inside"), errors="raise").alias("m")).first()["m"]
    assert fine == {"x": "an ERROR inside"}
    with pytest.raises(ValueError):
        parse_vertical(F.col("t"), errors="never")


def test_vertical_rows(spark):
    text = "*** 1. row ***\na: 1\n*** 2. row ***\na: 2\nb:\n"
    rows = spark.range(1).select(parse_vertical_rows(F.lit(text)).alias("r")).first()["r"]
    assert rows == [{"a": "1"}, {"a": "2"}]


def test_arrays(spark):
    df = spark.createDataFrame([([3, 1, 2],), ([7],), ([],), (None,)], "v array<int>")
    got = [r[0] if r[0] is None else [tuple(p) for p in r[0]] for r in df.select(element_pairs(F.col("v"))).collect()]
    assert got == [[(3, 1), (3, 2), (1, 2)], [], [], None]
    one = F.array(F.lit(2), F.lit(None).cast("int"), F.lit(5))
    assert [r[0] for r in df.select(sorted_set(F.col("v"), one)).collect()] == [[1, 2, 3, 5], [2, 5, 7], [2, 5], [2, 5]]
    roles = F.array(F.lit("Slave"), F.lit("MASTER"), F.lit("standby"))
    groups = {"slave": ["active", "standby", "backup"]}
    assert df.select(expand_roles(roles, groups)).first()[0] == ["active", "standby", "backup", "master"]


def test_status_documents(spark):
    one = spark.range(1)
    doc = run_status_json(F.lit("DB-1"), F.lit(42), F.lit(1_700_000_000))
    r = one.select(parse_run_status(doc).alias("r"), parse_run_status(F.lit("")).alias("none"),
                   parse_run_status(F.lit('{"FROM_HOST": "A", "From_Pid": 7}')).alias("upper")).first()
    assert tuple(r["r"]) == ("db-1", 42, 1_700_000_000) and r["none"] is None and tuple(r["upper"]) == ("a", 7, None)
    with pytest.raises(Exception, match="no previous pid"):
        one.select(parse_run_status(F.lit('{"from_host": "a"}'))).collect()
    changed = set_alter_state(F.lit(""), F.lit("needs_rename"))
    r = one.select(alter_state(F.lit("")).alias("a"), alter_state(changed).alias("b"),
                   alter_state(set_alter_state(changed, F.lit(None).cast("string"))).alias("c")).first()
    assert tuple(r) == ("can_be_altered", "needs_rename", "can_be_altered")


def test_import_without_mode(spark):
    rows = lambda *v: spark.createDataFrame(list(v), "a int, b int, x string")
    old = rows((1, 1, "p"), (None, 1, "q"))
    new = rows((1, 2, "r"), (None, 1, "s"), (None, 1, "s"), (2, None, "t"))
    assert import_rows(old, new, ["a", "b"]).count() == 6
    with pytest.raises(Exception, match="duplicate key on import"):
        import_rows(old, rows((1, 1, "p")), ["a", "b"]).collect()
