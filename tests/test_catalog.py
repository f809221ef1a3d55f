"""Every query runs, and equals its SQL where it has one; without SQL it equals a plain recomputation."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from contrapoint.functions import text
from contrapoint.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect(config={"threads": 2})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if np.isnan(v) else round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rows = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in rows.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in rows.fetchall()), key=repr)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_text_queries_by_recomputation(spark):
    q, c = ([(r.sample_id, r.value) for r in df.collect()] for df in catalog._texts(spark, DATA))
    for name, metric in (("text_rouge_l_knn", "rouge_l"), ("text_lcs_knn", "lcs"), ("text_bleu_knn", "bleu"), ("text_rouge2_knn", "rouge_2")):
        got = {(r.query_id, r.rank): r.train_id for r in catalog.queries()[name](spark, DATA).collect()}
        f = text.SIMILARITIES[metric]
        for i, words in q:
            order = sorted((round(1 - f(words, w), 9), j) for j, w in c)
            assert [got[i, n] for n in (1, 2, 3)] == [j for _, j in order[:3]]


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
