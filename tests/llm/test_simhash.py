import random
import re

import numpy as np
import pytest
import xxhash

from cladespark.llm import graph, simhash


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_components(rows):
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    label = {i: i for i, _ in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in fps:
        for j, b in fps:
            if bin(a ^ b).count("1") <= 2:
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in fps}


TEXTS = ["", None, "  \t\n", "one", "One TWO", "a b c", "É a b c", "x " * 50, "\x0b\x0cq w e r t y", "Ärger ÄRGER Z"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == slow_fingerprint(text)


def test_long_text_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcde", k=rng.randint(1, 6))) for _ in range(3000)).encode()
    whole = simhash.fingerprint(text)
    from cladespark.llm import common

    monkeypatch.setattr(simhash, "PIECE_BYTES", 100)
    monkeypatch.setattr(simhash, "pieces", lambda b: common.pieces(b, 100))
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == whole
    assert b"".join(common.pieces(text, 33)) == text


def near_texts(n=120):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    out = []
    for g in range(n // 6):
        base = rng.choices(vocabulary, k=150)
        for k in range(6):
            words = list(base)
            for _ in range(k // 2):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize("bucket", [64, 2])
def test_near_duplicates(spark, monkeypatch, bucket):
    rows = [(1000 - i, t) for i, t in enumerate([*near_texts(), *TEXTS, *TEXTS[:4]])]
    whole = simhash.links
    monkeypatch.setattr(simhash, "links", lambda c, d: whole(c, d, bucket=bucket))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    want = slow_components(rows)
    assert got == {i: (f"{slow_fingerprint(t):016x}", want[i]) for i, t in rows}
    assert len({c for _, c in got.values()}) < len(rows) - 20
    kept = {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}
    assert kept == {i for i, c in want.items() if i == c}


@pytest.mark.parametrize("distance", [1, 2, 3])
@pytest.mark.parametrize("bucket", [1, 64])
def test_links_match_all_pairs(spark, distance, bucket):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 2**63, 8)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(0, 4), replace=False)) for b in base for _ in range(12)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    place = {f: i for i, f in enumerate(fps)}
    got = {place[r.node]: place[r.component] for r in graph.components(simhash.links(df, distance, bucket=bucket)).collect()}
    import itertools

    label = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= distance:
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
    assert {n: got.get(n, n) for n in range(len(fps))} == dict(enumerate(label))


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert graph.components(df.filter("false")).count() == 0


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "zz yy xx ww vv")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(5, 5), (None, 5), (None, None)], key=repr)
    assert simhash.near_duplicates(df.filter("false")).count() == 0
