"""Operators against the SQL that is registered for them, on an independent engine."""

import os
import random

import duckdb
import pytest

from sonolith.llm import decontaminate, jaccard, licenses, oracles, queries, secrets

FOLDER = "/root/testdata/sf0.001"
REPORTS = {"op1_secret_scan": secrets.report, "op7_license_scan": licenses.scan, "op10_jaccard_join": jaccard.report}


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    plain = lambda x: f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(names), sorted(tuple(plain(r[k]) for k in order) for r in found)


def same(df, con, name):
    cur = con.execute(oracles.SQL[name]())
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", oracles.SQL)
def test_tables(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    same(queries.queries()[name](spark, FOLDER), con, name)


@pytest.fixture(scope="module")
def made():
    """Documents rich in what the operators seek."""
    rng = random.Random(17)
    words = "river stone lamp forest table glass window paper cloud iron bread salt".split()
    bits = ["password=Qw3rTy9LkJh2", "token: 'aaaaaaa'", "AKIA" + "Z9" * 9, "ab12cd34" * 4, "k3J9xPq27LmZw81RtYv5", "ghp_" + "a1B2" * 10, "x.k3J9xPq27LmZw81RtYv5", "released under the MIT license", "Apache License, Version 2.0", "CC BY 4.0", "licensed under the GNU Lesser General Public License", "é漢\U0001f600"]
    texts = [None, "", "river stone", "river stone", "12"]
    for i in range(120):
        texts.append(" ".join(rng.choices(words, k=rng.randint(1, 60)) + rng.sample(bits, rng.randint(0, 4))))
        if i % 5 == 0:
            near = texts[-1].split(" ")
            near[rng.randrange(len(near))] = "changed"
            texts += [" ".join(near), texts[-1]]
    return [(i, t, None if i % 7 == 0 else f"s{i % 4}") for i, t in enumerate(texts)]


def database(made, items=()):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", made)
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    if items:
        con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    return con


@pytest.mark.parametrize("name", REPORTS)
def test_made_documents(spark, made, name):
    same(REPORTS[name](spark.createDataFrame(made, "doc_id long, text string, source string")), database(made), name)


def test_few_owners_hold_a_value_in_many_documents(spark):
    """Breadth over owners decides, a share of them where there are many: not the number of documents."""
    held = {"password=Qw3rTy9LkJh2": 1, "k3J9xPq27LmZw81RtYv5": 4, "token=Hx4vNq8RzKd7": 20}
    docs = [(100 * k + i, f"note {i} {value} end", f"s{i % owners}") for k, (value, owners) in enumerate(held.items()) for i in range(40)]
    docs += [(1000 + i, f"plain {i}", f"s{i}" if i else None) for i in range(60)]
    same(secrets.report(spark.createDataFrame(docs, "doc_id long, text string, source string")), database(docs), "op1_secret_scan")


def test_two_notices_in_one_text(spark):
    """More licence words stand in a text than in any notice."""
    notices = [notice for _, notice, _ in licenses.TEMPLATES]
    docs = [(100 * i + j, f"{a} and here is more {b}", "s") for i, a in enumerate(notices) for j, b in enumerate(notices)]
    same(licenses.scan(spark.createDataFrame(docs, "doc_id long, text string, source string")), database(docs), "op7_license_scan")


def test_made_benchmark(spark, made):
    rng = random.Random(5)
    items = [(1, "river lamp"), (2, None), (3, "")]
    for k in range(10, 30):
        part = rng.choice(made[5:])[1].split(" ")[: rng.randint(5, 40)]
        for _ in range(rng.randint(0, 3)):
            part[rng.randrange(len(part))] = "other"
        items.append((k, " ".join(part)))
    docs = spark.createDataFrame(made, "doc_id long, text string, source string")
    same(decontaminate.report(docs, spark.createDataFrame(items, "item_id long, text string")), database(made, items), "op5_decontaminate")
