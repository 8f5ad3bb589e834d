import base64
import gzip
import hashlib
import io
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cladespark.llm import chat, mixing, packing, warc

# Chat.

CONTROL = ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "[\\\\/INST]", "</s", "s>", "<", "[", "", None, "a\nb", "é𝒳 [INST", "\\", "<s><s>[INST][/INST]</s>"]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_chat_round_trip(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<s>[INST]", "human"]), rng.choice(CONTROL)) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(77, 1, "user", x) for x in CONTROL] + [(78, None, "assistant", "later"), (78, 0, "assistant", "first"), (None, 0, "user", "x"), (79, 0, "assistant", "word " * 20_000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_turns(chat.canonical(df))
    back = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    dig = {r.conv_id: r for r in chat.digests(chat.read_back(formatted)).collect()}
    raw = {r.conv_id: r.formatted for r in formatted.collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append(((t is not None, t or 0), role or "", text or ""))
    assert set(back) == set(by)
    for c, turns in by.items():
        got = [(t.role, t.text) for t in back[c].turns]
        want = [x[1:] for x in sorted(turns, key=lambda x: x[0])]
        if c == 77:
            assert sorted(got) == sorted(want)
            continue
        assert got == want
        said = "".join(t for r, t in want if r == "assistant")
        assert back[c].loss_text == said and dig[c].loss_chars == len(said) and dig[c].loss_sha256 == digest(said)
        assert dig[c].turns_sha256 == digest("".join(f"{r}\n{t}\n" for r, t in want))
        assert dig[c].formatted_chars == len(raw[c]) and dig[c].n_turns == len(want)
        assert raw[c].count("</s>") == len(want) == len(re.findall(r"(?<!/)\[INST\]", raw[c]))
    assert chat.format_turns(chat.canonical(df.filter("false"))).count() == 0


def test_shapes(spark):
    records = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "id": 3},
        {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}], "system": "be kind"},
        {"prompt": "p", "completion": "c"}, {"instruction": "do", "input": "this", "output": "done"}, {"instruction": "do", "output": "done"}, {"question": "q", "answer": "a", "score": 0.5}, {"other": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(7, "{broken"), (8, None)], "conv_id long, record string")
    got = defaultdict(list)
    for r in chat.canonical_records(df, "record").orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.role, r.text))
    assert got[0] == [("user", "hi"), ("assistant", "yo")] and got[1] == [("system", "be kind"), ("user", "hi"), ("assistant", "yo")]
    assert got[2] == [("user", "p"), ("assistant", "c")] and got[3] == [("user", "do\n\nthis"), ("assistant", "done")] and got[4] == [("user", "do"), ("assistant", "done")] and got[5] == [("user", "q"), ("assistant", "a")]
    assert got[6] == got[7] == got[8] == [(None, None)]
    nested = spark.createDataFrame([(1, [("user", "hi"), ("model", None)])], "conv_id long, messages array<struct<role:string,content:string>>")
    assert [(r.role, r.text) for r in chat.canonical(nested).collect()] == [("user", "hi"), ("assistant", "")]
    with pytest.raises(ValueError):
        chat.canonical(spark.createDataFrame([(1,)], "x int"))


# Mixing.


def slow_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= 2 * sizes[s]}
        if not full:
            out |= {s: level * w[s] for s in open_}
            break
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def mixed_docs(seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        s = rng.choice(["b", "a", "é", "zz", None, "B", "hot", "hot", "hot"])
        rows.append((i, s, " ".join("w%d" % rng.randrange(99) for _ in range(rng.choice([0, 1, 30, 130, 700])))))
    rows += [(5, "a", "twin text"), (5, "a", "twin text"), (None, "a", "no id"), (900, "a", None), (901, "hot", "big " * 9000)]
    return rows


def test_mixing(spark):
    rows = mixed_docs()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, size int")
    got = mixing.taken(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want = slow_targets(sizes)
    by_size = {v: k for k, v in sizes.items()}
    assert len(by_size) == len(sizes)
    total = Counter()
    for r in got:
        s = by_size[r.source_size]
        assert r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        total[s] += r.taken
    for s in sizes:
        assert abs(total[s] - want[s]) <= mixing.BLOCK
    again = mixing.taken(df.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(again, key=key) == sorted(got, key=key)
    assert mixing.taken(df.filter("false")).count() == 0
    assert {r.taken for r in mixing.taken(df.filter("doc_id = 900")).collect()} == {0}


def test_mixed_texts(spark):
    rows = mixed_docs(2)
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, s, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    taken = Counter()
    for r in mixing.taken(df).collect():
        taken[r.doc_id] += r.taken
    clashing = df.withColumns({c: F.lit(None).cast("long") for c in ("key", "row", "mark", "size", "no", "all", "block", "shard", "words", "take", "chunk", "target")})
    assert mixing.mix(clashing).columns == clashing.columns and mixing.mix(clashing).count() == mixing.mix(df).count()
    out = mixing.mix(df)
    assert out.columns == df.columns
    words, texts = Counter(), {(i, s): t for i, s, t in rows}
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.text in texts[r.doc_id, r.source] and r.n_chars == len(r.text) and r.text.strip()
    assert words == Counter({k: v for k, v in taken.items() if v})


def test_slots_are_permutations(spark):
    sources = spark.createDataFrame([("a", 1000, 1700.0), ("b", 130, 260.0), ("c", 5, 3.0), ("d", 0, 0.0)], "key string, source_size long, target double")
    by = defaultdict(Counter)
    takes = Counter()
    shards = set()
    for r in mixing.slots(sources, block=128).collect():
        by[r.key][r.block] += 1
        takes[r.key] += r["take"]
        shards.add(r.shard)
    assert set(by["a"]) == set(range(8)) and sorted(by["a"].values()) in ([1, 1, 2, 2, 2, 2, 2, 2], [1] * 2 + [2] * 6)
    assert by["b"] == {0: 2, 1: 2} and by["c"] == {0: 1} and takes["c"] == 3 and "d" not in by


# Packing.


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_decreasing(sizes):
    rows = packing.best_fit_decreasing(sizes, 50)
    assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in r) <= 50 for r in rows)
    plain = []  # the same rule without a tree
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fit = [r for r in plain if sum(sizes[j] for j in r) + sizes[i] <= 50]
        if fit:
            max(fit, key=lambda r: sum(sizes[j] for j in r)).append(i)
        else:
            plain.append([i])
    assert sorted(sum(sizes[i] for i in r) for r in rows) == sorted(sum(sizes[i] for i in r) for r in plain)


def test_packed_rows_hold_every_text(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["", None, "é𝒳 hello", "  spaces  \n\n", "same", "same", "don't stop <|endoftext|>", "tok " * 3000] + [" ".join("w%d" % rng.randrange(10**6) for _ in range(rng.randint(1, 400))) for _ in range(40)]
    rows = list(enumerate(texts)) + [(4, "same"), (None, "nobody")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, parts int")
    got = packing.pack(df.coalesce(1), length=128).collect()
    segments = defaultdict(dict)
    names = set()
    for r in got:
        ids, pos = np.frombuffer(r.ids, "<i4"), np.frombuffer(r.position_ids, "<i4")
        assert len(ids) == len(pos) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 128
        for d, part, lo, hi in zip(r.doc_ids, r.parts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            segments[d].setdefault(part, []).append(ids[lo:hi].tolist())
            assert pos[lo:hi].tolist() == list(range(hi - lo))
        assert (ids[r.n_tokens :] == packing.END).all() and pos[r.n_tokens :].tolist() == list(range(128 - r.n_tokens))
        names.add((r.row_doc, r.row_part, r.row_copy))
    assert len(names) == len(got)
    e = packing.Encoder().encoding()
    for d, parts in segments.items():
        want = [t or "" for i, t in rows if i == d]
        for k in range(len(want)):
            ids = [x for p in sorted(parts) for x in parts[p][k]]
            assert ids[-1] == packing.END and e.decode(ids[:-1]) == want[k]
    assert sum(len(v) for p in segments.values() for k, v in p.items() if k == 0) == len(rows)
    m, p, cu = packing.matrices(got)
    assert m.shape == p.shape == (len(got), 128) and len(cu) == len(got)
    assert packing.pack(df.filter("false")).count() == 0
    long = "alpha beta'll 12 " * 500
    whole = e.encode_ordinary(long)
    monkeypatch.setattr(packing, "slices", lambda t, f=packing.slices: f(t, 100))
    assert packing.Encoder().encode(long).tolist() == whole


# WARC.


def page_rows():
    return [(3, "http://a/", "<p>é</p>"), (1, "http://b/", "<p>é</p>"), (2, "http://c/ x\r\nInjected: 1", ""), (4, None, None), (5, "http://d/", "x" * 100_000), (6, "http://e/", "<p>é</p>"), (7, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"), (None, "n", "<p>é</p>"), (1, "http://b/", "<p>é</p>")]


def test_warc(spark):
    df = spark.createDataFrame([(*r, "x") for r in page_rows()], "page_id long, url string, html string, content string")
    got = warc.round_trip(df).collect()
    first = {}
    for i, _, h in page_rows():
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in page_rows():
        b = (h or "").encode()
        revisit = i is not None and first[h or ""] != i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert warc.round_trip(df.filter("false")).count() == 0


def test_members_and_index(spark, monkeypatch):
    df = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    for a in warc.write(df).collect():
        name, content, index = a.archive, a.content, a["index"]
        whole = gzip.GzipFile(fileobj=io.BytesIO(content)).read()
        for x in index:
            one = gzip.decompress(content[x["offset"] : x["offset"] + x["length"]])
            assert one in whole and one.startswith(b"WARC/1.1\r\n") and one.count(b"WARC-Record-ID:") == 1
            assert b"\r\nInjected" not in one
        assert index[-1]["offset"] + index[-1]["length"] == len(content)
    plain = warc.write(df, normal=False).collect()
    for a in plain:
        again, places = warc.normalise(bytes(a.content))
        assert gzip.decompress(again) == gzip.decompress(bytes(a.content)) and len(places) >= 1 and not a["index"]
        assert warc.normalise(again) == (again, places) and len(list(warc.members(again))) == len(places)
    with pytest.raises(ValueError):
        warc.normalise(gzip.compress(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort"))
    least = {r.page_id: r.record_type for r in warc.pages_of(warc.read(warc.write(df, least=5))).collect()}
    assert least[4] == least[2] == "response" and least[6] == "revisit"
