import pytest

import seamline.registry as registry
from tests.oracle import SF, assert_same

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert_same(spark, registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    out = registry.entry(spark)
    assert out.count() > 0
    assert "content" in out.columns


def test_entry_module_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_capped_expansion_follows_the_greedy_rule(spark):
    from seamline.operators.rank import capped_expansion

    options = [(s, f"s{s}", p, f"c{(s * p) % 7}") for s in range(1, 6) for p in range(1, 12)]
    df = spark.createDataFrame([("t", s, i, p, c, "dependency", "exact", "") for s, i, p, c in options], "task_id string, seed_rank int, seed_id string, place int, chunk_id string, relation string, confidence string, evidence string")
    want, seen = [], set()
    for seed in range(1, 6):
        taken = 0
        for s, i, p, c in options:
            if s == seed and c not in seen and taken < 2 and len(want) < 5:
                seen.add(c)
                taken += 1
                want.append((i, c))
    got = [(r.seed_id, r.chunk_id) for r in capped_expansion(df, 2, 5).collect()]
    assert sorted(got) == sorted(want)
