"""Every query that has SQL against DuckDB over the same tables."""

import duckdb
import pandas as pd
import pytest

from sitequarry import schema
from sitequarry.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    text = lambda v: "~" if v is None or v is pd.NA or (isinstance(v, float) and v != v) else str(v)
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module", autouse=True)
def compiled(spark):
    """Queries are tested with the generated code that they run with."""
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query(name, spark, data, duck):
    got, want = Q.QUERIES[name](spark, data).toPandas(), duck.sql(Q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_registry():
    """The codes that rules can give are the registry's, and no others."""
    import re
    from pathlib import Path

    root = Path(schema.__file__).parent
    used = {c for p in root.rglob("*.py") if p.name not in ("schema.py", "queries.py", "rulesets.py") for c in re.findall(r'"([A-Z]+(?:_[A-Z]+)+)"', p.read_text())}
    assert {c for c in used if c in schema.REGISTRY} == set(schema.REGISTRY)
    assert len(schema.REGISTRY) == 72
