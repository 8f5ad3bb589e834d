import random
import time

import pytest

from cladespark.llm import neardup, simhash
from cladespark.llm.common import durable
from cladespark.llm.graph import components


def slow_set(text):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}


def slow_groups(rows, similarity=0.8):
    sets, label = [(i, slow_set(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if len(a & b) >= similarity * len(a | b):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def changed(ws, n, rng):
    out = list(ws)
    for k in rng.sample(range(len(out)), n):
        out[k] = "new%d" % rng.randrange(10**9)
    return out


def corpus():
    """Near copies 0.8 or more apart from five-word shingles, chains of them, one large group, and texts just too far."""
    rng = random.Random(5)
    word = lambda: "w%d" % rng.randrange(4000)
    texts = ["", None, " \n", "one", "One", "a b c", "a b c d e", "A b c d e"]
    for _ in range(60):
        base = [word() for _ in range(rng.randint(40, 400))]
        texts.append(" ".join(base))
        for _ in range(3):
            texts.append(" ".join(changed(base, max(1, len(base) // rng.randint(35, 70)), rng)))
            texts.append(" ".join(base[: round(len(base) * rng.uniform(0.7, 0.95))]))
    base = [word() for _ in range(300)]
    texts += [" ".join(changed(base, rng.randint(3, 9), rng)) for _ in range(200)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_groups_hold_against_all_pairs(spark):
    """The two-bit rule of op1 leaves most of these copies unlinked; similarity 0.8 links them all."""
    rows = corpus()
    want = slow_groups(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.groups(df).collect()}
    assert got == want
    assert {r.doc_id for r in neardup.drop_near_duplicates(df).collect()} == {i for i, c in want.items() if i == c}


def test_ids_repeated_and_null(spark):
    base = ["w%d" % i for i in range(100)]
    rows = [(5, " ".join(base)), (3, " ".join(base[:-4])), (3, "another text of six words entirely"), (9, "another text of six words ENTIRELY"), (None, " ".join(base)), (None, "alone here with no id at all"), (7, "quite by itself this one is here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in neardup.groups(df).collect()), key=repr)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (9, 3), (None, 3), (None, None), (7, 7)], key=repr)
    assert sorted((r.doc_id or 0) for r in neardup.drop_near_duplicates(df).collect()) == [0, 0, 3, 3, 7]


def test_stage_links_similarity(spark):
    import corpus_pipeline

    rows = corpus()
    want = slow_groups(rows)
    stage = dict(corpus_pipeline.STAGES)["near duplicates"]
    kept = {r.doc_id for r in stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert kept == {i for i, c in want.items() if i == c}


def test_stage_goes_through_simhash(spark, monkeypatch):
    """Fingerprints, blocks and Hamming distance give candidates of their own: without any band they link close copies,
    and they link no pair that is not similar."""
    monkeypatch.setattr(neardup, "bands", lambda s: [])
    rng = random.Random(8)
    base = ["w%d" % rng.randrange(4000) for _ in range(3000)]
    rows = [(0, " ".join(base))] + [(1 + k, " ".join(changed(base, 3, rng))) for k in range(20)]
    rows += [(100 + k, " ".join("v%d" % rng.randrange(4000) for _ in range(30))) for k in range(20)] + [(200, ""), (201, "0")]
    marks = neardup._marks(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id")
    fps = {r.doc_id: r.fp for r in marks.collect()}
    near = {(i, j) for i in fps for j in fps if i < j and ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= neardup.DISTANCE}
    assert {(0, k) for k in range(1, 21)} & near
    want = {i: i for i in fps}
    for _ in fps:
        for i, j in near:
            if slow_set(dict(rows)[i]) and len(slow_set(dict(rows)[i]) & slow_set(dict(rows)[j])) >= 0.8 * len(slow_set(dict(rows)[i]) | slow_set(dict(rows)[j])):
                want[i] = want[j] = min(want[i], want[j])
    got = {r.doc_id: r.component_id for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) < len(want)


@pytest.mark.parametrize("n", [0, 1, 2, 70])
def test_fingerprint_of_hashes(monkeypatch, n):
    import numpy as np

    monkeypatch.setattr(simhash, "CHUNK", 16)
    h = np.random.default_rng(n).integers(0, 1 << 64, n, np.uint64)
    assert simhash.of_hashes(h) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > n)


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}


def test_steps_leave_no_shuffle_files(spark):
    """Fails by disk otherwise: where there are many partitions, files of all steps are there at once."""
    before = shuffle_files(spark)
    edges = spark.range(1000).selectExpr("id a", "id + id % 7 b")
    of = components(edges)  # held, so that nothing is removed as garbage
    totals = durable(of.groupBy("component").count())
    for _ in range(100):  # they are removed in the background
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")
    assert totals.agg({"count": "sum"}).first()[0] == of.count()
