"""The operators' queries against their SQL, and what is registered."""
import pytest

import __spark_entry__ as E
from check_oracle import compare, duck
from tonekit.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_matches_oracle(spark, name):
    msg, ok = compare(spark, duck(SF), name, Q.QUERIES[name], Q.ORACLE[name], SF)
    assert ok, msg


def test_all_are_registered():
    names = set(E.queries())
    assert set(Q.QUERIES) | {"pipeline"} <= names
    assert {int(n[2:].split("_")[0]) for n in Q.QUERIES} == set(range(1, 14))
    assert set(Q.ORACLE) <= set(E.oracle_sql())


def test_nothing_else_imports_the_operators():
    import ast
    import pathlib

    root = pathlib.Path(E.__file__).parent
    for f in (root / "tonekit").rglob("*.py"):
        if f.parent.name != "llm":
            for node in ast.walk(ast.parse(f.read_text())):
                names = [a.name for a in node.names] if isinstance(node, (ast.Import, ast.ImportFrom)) else []
                assert "llm" not in f"{getattr(node, 'module', '')}.{'.'.join(names)}".split("."), f


def test_arrow_batches_are_bounded_and_lower_settings_stay(spark):
    from tonekit.llm import common as C

    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    was = {k: spark.conf.get(k) for k in (rows, size)}
    try:
        for given, held in (("64m", str(C.ARROW_BYTES)), ("67108864b", str(C.ARROW_BYTES)), ("2m", "2m"), ("1000", "1000")):
            spark.conf.set(size, given)
            C.bounded_batches(spark.range(1))
            assert spark.conf.get(size) == held
            assert 0 < int(spark.conf.get(rows)) <= C.ARROW_ROWS
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
