"""Cases at the edges of the corpus operators: missing ids, odd records, short secrets, real licence files, foreign archives."""

import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cladespark.llm import chat, common, decontam, licences, mixing, packing, secrets, simhash, toxicity, warc


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_hot_join_is_a_join(spark):
    left = spark.createDataFrame([(i % 7 if i % 2 else 3, i) for i in range(400)], "k long, x long")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("y", F.col("k") * 10)
    got = common.hot_join(left, right, "k", "n")
    assert got.columns == ["k", "x", "y"]
    assert sorted(map(tuple, got.collect())) == sorted((r.k, r.x, r.k * 10) for r in left.collect())
    assert common.hot_join(left.filter("false"), right.filter("false"), "k", "n").count() == 0


def test_full_buckets_are_split_and_lose_no_link(spark):
    """Thousands of fingerprints that agree in most blocks: buckets are split again and again, and all pairs are found."""
    rng = random.Random(4)
    hub = rng.getrandbits(64)
    fps = {hub}
    for _ in range(900):
        x = hub
        for b in rng.sample(range(20, 44), rng.randint(1, 5)):
            x ^= 1 << b
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(map(signed, fps))
    for distance in (1, 2, 3):
        want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance}
        got = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), distance, bucket=8)
        assert {(r.a, r.b) for r in got.collect()} == want and want


def test_rows_without_id_link_others(spark, monkeypatch):
    """A fingerprint that only a row without an id has is a bridge between two others."""
    bits = {"a": 0x0, "b": 0x3, "c": 0xF, "far": 0xFF00}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.select("doc_id", F.create_map(*[F.lit(v) for kv in bits.items() for v in kv])[F.col("text")].cast("long").alias("fp")))
    rows = [(1, "a"), (None, "b"), (2, "c"), (5, "far"), (None, "far"), (1, "a")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == sorted((str(i), f"{bits[t]:016x}", 5 if t == "far" else 1) for i, t in rows)


RECORDS = [
    ('{"messages":[{"role":"user","content":null},{"role":"gpt","content":"hi"}]}', "messages", [("user", ""), ("assistant", "hi")]),
    ('{"messages":[{"role":"user"},{"role":"user","content":"x"}],"prompt":"unused"}', "messages", [("user", ""), ("user", "x")]),
    ('{"messages":[{"role":"user","content":[{"type":"text","text":"a"},{"type":"image"},"b"]}]}', "messages", [("user", "ab")]),
    ('{"messages":["odd",{"role":"user","content":"c"}]}', "messages", [("", ""), ("user", "c")]),
    ('{"prompt":null,"response":"r"}', "prompt and response", [("user", ""), ("assistant", "r")]),
    ('{"messages":[]}', None, [(None, None)]),
    ("broken", None, [(None, None)]),
]


def test_records_lose_no_turn(spark):
    df = spark.createDataFrame([(f"c{i}", r) for i, (r, _, _) in enumerate(RECORDS)], "conv_id string, record string")
    rows = chat.canonical_records(df, "record").orderBy("conv_id", "turn").collect()
    for i, (_, layout, turns) in enumerate(RECORDS):
        own = [r for r in rows if r.conv_id == f"c{i}"]
        assert {r.layout for r in own} == {layout} and [(r.role, r.text) for r in own] == turns


def test_tables_with_more_known_columns(spark):
    t = spark.createDataFrame([("x", "p", "r", "unused")], "conv_id string, prompt string, response string, question string")
    assert [(r.conv_id, r.role, r.text) for r in chat.canonical(t).orderBy("turn").collect()] == [("x", "user", "p"), ("x", "assistant", "r")]


# Mixing.


def mixed_docs(spark, n=120):
    rng = random.Random(2)
    word = lambda: "w%d" % rng.randrange(10**6)
    rows = [(i, rng.choice(["  ", ""]) + rng.choice([" ", "\n"]).join(word() for _ in range(rng.randint(0, 90))), "en", rng.choice(["a", "b", "c", "d", None])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257])
def test_permutations_are_exact(spark, n):
    at = lambda seed, back=False, x=F.col("id"): mixing.permuted(x, F.lit(n).cast("long"), F.lit(seed), back=back)
    rows = spark.range(n).select(at(1).alias("a"), at(2).alias("b"), at(1, True, at(1)).alias("id2"), "id").collect()
    assert sorted(r.a for r in rows) == sorted(r.b for r in rows) == list(range(n)) and all(r.id2 == r.id for r in rows)
    assert n < 10 or [r.a for r in rows] != [r.b for r in rows]


def test_shards_are_of_one_size_and_meet_the_targets(spark):
    rows, docs = mixed_docs(spark)
    plan = mixing.plan(docs, block=16, shard_slots=10).filter("shard is not null").collect()
    slots = {(r.shard, r.place): (r.key, r.block) for r in plan}
    shards = {}
    for s, _ in slots:
        shards[s] = shards.get(s, 0) + 1
    assert set(shards) == set(range(len(shards))) and all(n == 10 for s, n in shards.items() if s < len(shards) - 1)
    assert len({k for (s, _), (k, _) in slots.items() if s == 0}) > 1
    words = {}
    for r in mixing.taken(docs, block=16).collect():
        x = words.setdefault((r.source_size, r.target), [0, r.target])
        x[0] += r.taken
        assert r.taken <= 2 * r.size
    assert all(abs(n - t) <= 0.5 for n, t in words.values())


def test_documents_can_be_put_together_again(spark):
    rows, docs = mixed_docs(spark)
    texts = {i: t for i, t, _, _ in rows}
    got = mixing.mix(docs, places=True, block=16, shard_slots=10).collect()
    for r in got:
        assert len(r.text.split()) == r.n_words and texts[r.doc_id].split()[r.from_word : r.from_word + r.n_words] == r.text.split()
    whole = {}
    for r in got:
        whole.setdefault(r.doc_id, {}).setdefault(r.from_word, r.text)
    full = [i for i, p in whole.items() if sum(len(t.split()) for t in p.values()) == len(texts[i].split())]
    assert len(full) > 50 and all("".join(t for _, t in sorted(whole[i].items())) == texts[i] for i in full)


def test_shard_draw_shows_in_the_output(spark):
    _, docs = mixed_docs(spark)
    one = [(r.doc_id, r.text) for r in mixing.mix(docs, block=16, shard_slots=10).collect()]
    again = [(r.doc_id, r.text) for r in mixing.mix(docs, block=16, shard_slots=10).collect()]
    other = [(r.doc_id, r.text) for r in mixing.mix(docs, block=16, shard_slots=25, seed=1).collect()]
    assert sorted(one) == sorted(again) and one != other
    at = {}
    for r in mixing.mix(docs, places=True, block=16, shard_slots=10).withColumn("part", F.spark_partition_id()).collect():
        at.setdefault(r.part, []).append((r.shard, r.place, r.at_word))
    assert all(xs == sorted(xs) for xs in at.values())


def test_mix_with_odd_ids_and_columns(spark):
    rows = [(None, "one two three", "a", 1)] * 5 + [("x", "four five", "a", 2), ("x", "four five", "a", 2), ("y", None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string, shard int")
    assert mixing.taken(docs).count() == 8
    got = mixing.mix(docs, block=4).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "source", "shard"} and sum(len(r.text.split()) for r in got) == 29  # half as much again as 19, rounded up
    assert mixing.mix(docs.filter("false")).count() == 0


# Secrets, licences, toxicity.


def spans_of(spark, text):
    r = secrets.secrets(spark.createDataFrame([("t", text)], "doc_id string, text string")).first()
    return [tuple(x.split(":")) for x in r.spans.split(",") if x]


def test_short_secrets_and_ordinary_strings(spark):
    assert [k for k, *_ in spans_of(spark, "see xK9mP2qL7vR4tY8w and internationalization, 2024-05-17")] == ["markov"]
    for plain in ("550e8400-e29b-41d4-a716-446655440000", "aGVsbG8gd29ybGQgdGhpcyBpcyBwcm9zZQ==", "getCustomerAddressById", "src/main/java/Handler1", "=" * 60):
        assert spans_of(spark, f"a {plain} b") == []


def test_held_out_samples_are_told_apart(spark):
    table = secrets.train(secrets.default_samples(spark))
    held = secrets.default_samples(spark, 1000, 1 << 20).withColumn("hit", secrets.ratio(F.col("text"), table) > secrets.THRESHOLD)
    n = {(r.secret, r.hit): r["count"] for r in held.groupBy("secret", "hit").count().collect()}
    assert n[True, True] > 960 and n.get((False, True), 0) < 5


def template(name, least):
    return next(t for n, t in licences.TEMPLATES if n == name and len(t.split()) > least)


def wrapped(text, mark="", width=9):
    ws = text.split()
    return "\n".join(mark + " ".join(ws[i : i + width]) for i in range(0, len(ws), width))


def test_real_licence_files_and_wrapped_headers(spark):
    code = "\n".join("value%d = compute(alpha, beta)" % i for i in range(300))
    files = [
        ("p/LICENSE", "MIT License\n\nCopyright (c) 2020 Some One\n\n" + wrapped(template("MIT", 100))),
        ("p/a.c", "int main() {}"),
        ("b/COPYING.txt", "Copyright 2019, Some One\n\n" + wrapped(template("BSD-2-Clause", 100))),
        ("b/c/d.c", "x"),
        ("g/x.py", wrapped(template("GPL-3.0", 30), "# ") + "\n# (at your option) any later version.\n" + code),
        ("h/x.js", "/*\n" + wrapped(template("Apache-2.0", 50), " * ") + "\n */\n" + code),
        ("a/LICENSE", wrapped(template("Apache-2.0", 30)) + "\n" + code),
        ("a/deep/er/y", None),
        ("n/plain", "the license plate needs no permission " + code),
    ]
    got = {r.path: (r.licence, r.origin) for r in licences.licences(spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "doc_id long, path string, text string")).collect()}
    assert got == {
        "p/LICENSE": ("MIT", "own"), "p/a.c": ("MIT", "inherited"), "b/COPYING.txt": ("BSD-2-Clause", "own"), "b/c/d.c": ("BSD-2-Clause", "inherited"),
        "g/x.py": ("GPL-3.0", "own"), "h/x.js": ("Apache-2.0", "own"), "a/LICENSE": ("Apache-2.0", "own"), "a/deep/er/y": ("Apache-2.0", "inherited"), "n/plain": (None, None),
    }


def test_stems_cut_no_character():
    assert toxicity.stem_of("éèêëx".encode()) == "éèêë".encode() and toxicity.stem_of(b"plainly") == b"plai"


def test_telling_counts_follow_the_rule_for_all_rows():
    from math import comb

    pairs = [(0, 12, 3), (5, 5, 400), (9, 1, 20), (40, 2, 1), (2, 3, 1000)]
    flat = sorted((min(sum(comb(a + b, i) for i in range(b, a + b + 1)), sum(comb(a + b, i) for i in range(a, a + b + 1))) / 2 ** (a + b), a, b) for a, b, k in pairs for _ in range(k))
    last = max((i for i, x in enumerate(flat, 1) if x[0] <= 0.1 * i / len(flat)), default=0)
    assert toxicity.telling(pairs, 0.5) == {(a, b) for _, a, b in flat[:last]} != set()


# Decontamination and packing.


def test_index_compares_little_and_finds_what_counts():
    rng = random.Random(8)
    word = lambda: b"w%d" % rng.randrange(500)
    items = [(i, b" ".join(word() for _ in range(60))) for i in range(80)]
    index = decontam.Index(items)
    found = 0
    for i, t in items:
        ws = t.split()
        ws[rng.randrange(5, 55)] = b"changed"
        text = b" ".join([*[word() for _ in range(100)], *ws, *[word() for _ in range(100)]])
        found += i in {h[0] for h in index.hits(text)}
    assert found == 80 and index.met < 0.25 * index.looked
    free = decontam.Index(items)
    for i in range(20):  # texts that share scattered shingles only
        ws = [w for _, t in items[i : i + 30] for w in t.split()[10:16]]
        assert free.hits(b" ".join(ws)) == []
    assert free.looked > 1000 and free.met < 0.01 * free.looked


def test_many_parts_of_a_benchmark(spark, monkeypatch):
    rows = [(f"i{k}", " ".join(f"b{k}x{j}" for j in range(20))) for k in range(6)]
    docs = spark.createDataFrame([(f"d{k}", "start " + t + " end") for k, (_, t) in enumerate(rows)] + [("z", "clean " * 30), ("n", None)], "doc_id string, text string")
    bench = spark.createDataFrame(rows, "item_id string, text string")
    want = sorted((r.doc_id, r.item_id) for r in decontam.contamination(docs, bench).collect())
    monkeypatch.setattr(decontam, "PASS_BYTES", 200)
    assert sorted((r.doc_id, r.item_id) for r in decontam.contamination(docs, bench).collect()) == want == [(f"d{k}", f"i{k}") for k in range(6)]
    assert {r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()} == {"z", "n"}


def test_packing_windows_and_ids_are_parameters(spark):
    docs = spark.createDataFrame([(f"d{i}", "word " * (i % 40)) for i in range(200)], "doc_id string, text string").coalesce(1)
    wide, narrow = packing.pack(docs, length=64).collect(), packing.pack(docs, length=64, window=500).collect()
    for got in (wide, narrow):
        assert sorted(i for r in got for i in set(r.doc_ids)) == sorted(f"d{i}" for i in range(200))
    assert len(wide) <= len(narrow) and sum(r.n_tokens for r in wide) == sum(r.n_tokens for r in narrow)


# WARC.


def foreign():
    """A monolithic archive of another writer: warcinfo, a request, a response without a digest, a chunked one, a revisit."""
    out = []

    def put(kind, block, *more):
        out.append(("\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{len(out)}>", *more, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n")

    put("warcinfo", b"software: other\r\n")
    put("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "WARC-Target-URI: http://a/")
    put("response", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nplain body", "WARC-Target-URI: http://a/", "Content-Type: application/http;\r\n msgtype=response")
    put("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n6;x=1\r\n world\r\n0\r\n\r\n", "WARC-Payload-Digest: sha1:" + warc.digest(b"hello world"))
    put("revisit", b"HTTP/1.1 200 OK\r\n\r\n", "WARC-Refers-To: <urn:uuid:3>")
    put("resource", b"\r\n\r\nraw", "WARC-Payload-Digest: sha1:WRONG")
    return b"".join(out)


@pytest.mark.parametrize("pack", [gzip.compress, lambda x: x, lambda x: gzip.compress(x[:700]) + gzip.compress(b"") + gzip.compress(x[700:])])
def test_foreign_archives(spark, tmp_path, pack):
    source = tmp_path / "in"
    source.mkdir()
    (source / "crawl.warc.gz").write_bytes(pack(foreign()))
    warc.write_files(warc.normalised(warc.read_files(spark, str(source))), str(tmp_path / "out"))
    whole = (tmp_path / "out" / "crawl.warc.gz").read_bytes()
    assert gzip.decompress(whole) == foreign()
    rows = warc.read(warc.read_files(spark, str(tmp_path / "out"))).orderBy("offset").collect()
    assert [r.record_type for r in rows] == ["warcinfo", "request", "response", "response", "revisit", "resource"]
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    assert [(r.payload_bytes, r.payload_digest, r.intact) for r in rows[2:]] == [(10, sha(b"plain body"), None), (11, sha(b"hello world"), True), (None, None, None), (7, sha(b"\r\n\r\nraw"), False)]
    index = warc.read_index(spark, str(tmp_path / "out")).orderBy("offset").collect()
    assert [(x.archive, x.offset, x.length, x.record_id) for x in index] == [(r.archive, r.offset, r.length, r.record_id) for r in rows]
    for x in index:
        assert gzip.decompress(whole[x.offset : x.offset + x.length]).startswith(b"WARC/1.0")


def test_broken_archives(spark):
    for bad in (gzip.compress(foreign()[:-30]), gzip.compress(b"no archive at all\r\n\r\n"), gzip.compress(foreign())[:-20]):
        with pytest.raises(ValueError):
            warc.normalise(bad)
            list(warc.members(bad))
    assert warc.normalise(gzip.compress(foreign()[:-4]))[1][-1]["record_id"] == "<urn:uuid:5>"


def test_page_ids_of_any_type(spark):
    pages = spark.createDataFrame([("a b>", "u", "x"), ("é/1+", "v", "x"), (None, "w", "x"), ("none", "w", "")], "page_id string, url string, html string")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    assert got == sorted([("a b>", "response", None), ("é/1+", "revisit", "a b>"), (None, "response", None), ("none", "response", None)], key=str)
