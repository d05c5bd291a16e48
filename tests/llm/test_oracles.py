"""Queries with SQL, on a small table with nulls, empty texts and repeats, and on the smallest test tables."""

import os
import random
from collections import Counter

import duckdb
import pytest

from newsloom.llm import oracles, registry

SF = "/root/testdata/sf0.001"


def compare(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{folder}/{t}.parquet') else ''}')")
    found = con.execute(oracles.SQL[name])
    names = [d[0] for d in found.description]
    df = registry.queries()[name](spark, folder)
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(r[n] for n in names) for r in df.collect()) == Counter(found.fetchall())


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = random.Random(4)
    lines = ["shared line of text", " Shared LINE of text\t", "", "a b c d", "Été | 5%", " ".join(f"p{i}" for i in range(30))]
    rows = [(i, "\n".join(rng.choice([*lines, " ".join(rng.choices([f"w{k}" for k in range(60)], k=rng.randint(0, 40)))]) for _ in range(rng.randint(0, 8)))) for i in range(80)]
    rows += [(80, None), (81, ""), (82, "\n"), (83, "x " * 3000)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    vectors = [(i, [rng.gauss(i % 4, 1) / 8 for _ in range(64)], 0) for i in range(120)]
    vectors += [(120, None, 0), (121, [], 0), (122, vectors[0][1][:63], 0), (123, [None, *vectors[0][1][1:]], 0), (124, [float("nan"), *vectors[0][1][1:]], 0), (125, vectors[7][1], 1), (8, vectors[9][1], 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_small(spark, small, name):
    compare(spark, small, name)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_smallest_tables(spark, name):
    compare(spark, SF, name)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - {"op12_phrase_collocations"}))
def test_every_query_gives_a_row_for_each_row_of_its_table(spark, name):
    table, key = ("embeddings", "vec_id") if name.startswith("op11") else ("documents", "doc_id")
    ids = {r[key] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    out = registry.queries()[name](spark, SF)
    assert {r[key] for r in out.select(key).collect()} == ids
