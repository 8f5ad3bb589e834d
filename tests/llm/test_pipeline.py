import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cladespark.llm import queries

from test_text_operators import slow_hits, toxic_corpus
from test_simhash import slow_components


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(7)
    docs, labels = toxic_corpus(300, 3)
    item = " ".join("item%d" % i for i in range(30))
    docs += [(1000 + i, docs[i][1]) for i in range(1, 40, 2)] + [(2000 + i, docs[i][1] + " " + item) for i in range(1, 20, 2)]
    rows = [(i, t, "en", "src%d" % rng.randrange(4), len(t)) for i, t in docs] + [(3000, None, None, None, None), (3001, "", "en", "src1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "absent words that no document has at all")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, dict(docs) | {3000: None, 3001: ""}, item


def test_stages(spark, tables):
    d, texts, item = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, d).cache()
        after = {r.doc_id for r in docs.select("doc_id").collect()} if k < 4 else None
        if k < 4:
            assert docs.columns == columns and docs.schema == spark.read.parquet(f"{d}/documents.parquet").schema
        if k == 0:
            bad = {i for i, t in texts.items() if t and any(w.strip(".!").startswith("b") for w in t.split())}
            assert len(bad & after) <= 0.05 * len(bad) and len(set(texts) - bad - after) <= 0.02 * len(texts)
        elif k == 1:
            label = slow_components(sorted(before.items()))
            assert after == {i for i, c in label.items() if i == c}
        elif k == 2:
            assert after == {i for i, t in before.items() if not slow_hits(t, [(1, item)])} and len(after) < len(before)
        elif k == 3:
            assert after <= set(before)
            words = sum(len(r.text.split()) for r in docs.collect())
            assert words == pytest.approx(1.5 * sum(len((t or "").split()) for t in before.values()), rel=0.05)
        else:
            assert docs.select(F.explode("doc_ids").alias("i")).distinct().count() <= len(before) and docs.count()


def test_run_and_queries(spark, tables):
    d, *_ = tables
    assert corpus_pipeline.run(spark, d).count() > 0
    assert sorted(queries.queries()) == sorted(n for n in queries.queries() if n.startswith("op"))
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 11)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    df = queries.queries()[name](spark, "/root/testdata/sf0.001")
    cur = con.execute(queries.oracle_sql()[name])
    order = [c[0] for c in cur.description]
    cols = sorted(df.columns)
    assert sorted(order) == cols
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[order.index(c)] for c in cols) for r in cur.fetchall()), key=repr)
