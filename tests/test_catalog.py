"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else f"{round(float(v), 6) + 0.0:.6f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_whole_ngram_jobs(spark, tmp_path):
    docs = [(1, "a b c", "en"), (2, "a b d", "de"), (3, "a b e", None), (4, "x y " + " x y ".join(f"t{i:02}" for i in range(60)), "en"), (5, "a b c", "fr")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    assert {(r.lang, r.c1, r.c2, r.tok, r.n) for r in run("ngram_counts") if r.c1 == "a"} == {("en", "a", "b", "c", 1), ("de", "a", "b", "d", 1), (None, "a", "b", "e", 1), ("fr", "a", "b", "c", 1)}
    contrast = run("ngram_contrast")
    assert len([r for r in contrast if r.c1 == "a"]) == 1  # a context found once
    assert len([r for r in contrast if (r.c1, r.c2) == ("x", "y")]) == 50
    assert {r.doc_id: r.applied for r in run("sequence_scores")} == {1: 1, 2: 0, 3: 0, 4: 178, 5: 1}
