"""Every registered query of the reference operators runs and, where SQL can say it, gives the same rows as DuckDB."""

import pytest

from compare import same
from quizlake.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE_SQL:
        same(df, duck.sql(ORACLE_SQL[name]))
    else:
        df.collect()


def test_fuzzy_match_is_brute_force(spark, sf_dir):
    """The flagship over whole tables against all pairs in plain Python."""
    from quizlake.functions.text import ratio
    from quizlake.plans import queries as Q

    source, ref = (sorted((r.id, r.t) for r in x.select("id", "t").collect()) for x in Q._bank(spark, sf_dir))
    want = {}
    for i, a in source:
        near = []
        for j, b in ref:
            low, high = sorted((len(a), len(b)))
            if min(len(a), len(b)) >= 5 and 2 * low >= 0.75 * (low + high) and (s := ratio(a, b)) >= 0.75:
                near.append((-s, j))
        near = sorted(near)[:5]
        want[i] = (near[0][1] if near else None, round(-near[0][0], 6) if near else 0.0, len(near))
    got = {r.source_id: (r.ref_id, r.similarity, max(r.n_candidates or 0, 0)) for r in QUERIES["fuzzy_match"](spark, sf_dir).collect()}
    assert got == want and any(n for _, _, n in want.values())


def test_nearest_module_is_brute_force(spark, sf_dir):
    import difflib

    table = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    names = {r[0] for r in table("part").select("p_name").distinct().collect()} | {r[0] for r in table("customer").select("c_mktsegment").distinct().collect()}
    modules = [(r.n_nationkey, r.n_name) for r in table("nation").collect()]
    want = {}
    for n in names:
        x = n.strip().lower()
        best = max(((1.0 if x == m.lower() else max(difflib.SequenceMatcher(None, x, m.lower()).ratio(), 0.85 if x in m.lower() or m.lower() in x else 0.0)), -k, m) for k, m in modules)
        if best[0] > 0.3:
            want[n] = (best[2], best[0])
    assert {r.name: (r.module, r.confidence) for r in QUERIES["nearest_module"](spark, sf_dir).collect()} == want
