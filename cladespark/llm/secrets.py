"""Secret scans: patterns for known forms, and character Markov models for random strings of no known form."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are matched whole, so their least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Candidates for the Markov models: whole runs with a digit, or an upper-case letter after a lower-case one, as short as
#: a value that counts after a name like ``password``. A run of one case without digits is a word of some language.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*?(?:[0-9]|[a-z][A-Z]))[A-Za-z0-9+/_=-]{8,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Log-likelihood ratio of a whole candidate above which it is taken to be random: the log of the prior odds against it.
THRESHOLD = 9.0
#: Labelled samples that the default models are trained from, of each kind.
SAMPLES = 4096
#: Words that make up ordinary identifiers and phrases in the samples; a fixed list.
IDENTIFIER_WORDS = (
    "account action active address agent amount answer append argument array attribute author balance banner batch before binary block border bottom "
    "branch browser buffer builder button cache callback cancel category center change channel character check child client close cluster code collection "
    "color column command comment commit common compare component config connect constant container content context control convert cookie copy count create "
    "current customer data database date debug default delete delivery description design detail device dialog direction directory display document domain "
    "double download driver editor element email enable encode engine entity entry error event example exception execute expand export expression extension "
    "factory failure feature fetch field file filter final first folder footer format forward frame function gateway general generate global group handle "
    "handler header height helper hidden history image import index info initial input insert instance integer interface internal invalid invoice item "
    "iterator job join kernel label language last layer layout left length level library limit line link list listener load local location lock log login "
    "manager map margin master match matrix memory menu merge message meta method middle missing mode model module monitor month mouse move name native "
    "network next node normal note notification number object observer offset open operation operator option order origin output owner package page panel "
    "parameter parent parser partition path pattern payment pending permission person phone plugin point policy pool port position prefix previous price "
    "primary print priority private process product profile program project property protocol provider proxy public query queue quick random range rate "
    "reader record redirect reference refresh region register relation release remote remove render repeat replace report request require reset resource "
    "response result return review right role root route rule runtime sample schedule schema scope screen script scroll search second section select sender "
    "sequence server service session setting shape share signal simple single size socket sort source space special split stack standard start state static "
    "status storage store stream string strong style subject submit success summary support switch symbol system table target task template terminal text "
    "theme thread time title toggle tool total track transaction transfer transform tree trigger type unique unit update upload user valid value variable "
    "vector version vertical video view visible visitor warning weight widget width window worker wrapper write zone with from that this there other thing "
    "about after again because between country different during every family great house large might never often people place school should small still "
    "their these things think through under until water where which while world would years young another nothing something whether without together"
).split()


def default_samples(spark: SparkSession, n: int = SAMPLES, first: int = 0) -> DataFrame:
    """``(text, secret)``: ``n`` strings of each label from the ids ``first`` and up. Secrets are pseudorandom base64, hex and
    alphanumeric strings of 12 to 64 characters; ordinary ones are words and identifiers of several styles, dates, UUIDs,
    paths, ruled lines and base64 of words."""
    ids = spark.range(first, first + n)
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.base64(F.unhex(digest))
    drawn = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("int")
    plain64 = F.regexp_replace(base64, "[+/=]", "")
    secret = F.when(F.col("id") % 4 == 0, base64).when(F.col("id") % 4 == 1, F.substr(digest, F.lit(1), drawn("hex", 33) + 32)).otherwise(F.substr(plain64, F.lit(1), drawn("cut", 29) + 12))
    words = F.array(*[F.lit(w) for w in IDENTIFIER_WORDS])
    parts = [F.element_at(words, drawn(k, len(IDENTIFIER_WORDS)) + 1) for k in range(4)]
    day = F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), drawn("day", 15000)), "yyyy-MM-dd")
    uuid = F.concat_ws("-", *[F.substr(digest, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    kinds = [
        F.concat_ws("_", *parts), F.concat(parts[0], *[F.initcap(p) for p in parts[1:]]), F.concat_ws("-", *parts), F.upper(F.concat_ws("_", *parts)),
        F.concat(*parts), F.concat_ws("/", *parts), F.concat(F.initcap(parts[0]), parts[1]), F.concat_ws("-", parts[0], day), F.concat(parts[0], parts[1], drawn("no", 1000).cast("string")),
        uuid, F.repeat(F.element_at(F.array(*[F.lit(c) for c in "-=_+/x0"]), drawn("rule", 7) + 1), 24), F.base64(F.encode(F.concat_ws(" ", *parts), "UTF-8")),
    ]
    plain = kinds[0]
    for i, k in enumerate(kinds[1:], 1):
        plain = F.when(F.col("id") % len(kinds) == i, k).otherwise(plain)
    return ids.select(secret.alias("text"), F.lit(True).alias("secret")).union(ids.select(plain.alias("text"), F.lit(False).alias("secret")))


def train(samples: DataFrame) -> list[float]:
    """Log-ratios of the character transitions of secrets and ordinary strings, at ``128 * first + second`` code.

    Pairs are counted on the cluster; at most two counts for each pair of the alphabet come to the driver. Samples are
    read as they are, null ones skipped; characters outside the alphabet break a string up.
    """
    inside = F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/_=-]+"), F.lit(0))
    runs = samples.filter("text is not null and secret is not null").select("secret", F.explode(inside).alias("s"))
    pairs = runs.filter(F.length("s") > 1).select("secret", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substr("s", i, F.lit(2)))).alias("p"))
    counts = {(r.secret, r.p): r.n for r in pairs.groupBy("secret", "p").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = [0.0] * (128 * 128)
    k = len(ALPHABET)
    rows = {(c, a): sum(counts.get((c, a + b), 0) for b in ALPHABET) for c in (True, False) for a in ALPHABET}
    alls = {c: sum(rows[c, a] for a in ALPHABET) for c in (True, False)}
    least = 0.5
    col = {(c, b): (sum(counts.get((c, a + b), 0) for a in ALPHABET) + least) / (alls[c] + least * k) for c in (True, False) for b in ALPHABET}
    for a in ALPHABET:
        for b in ALPHABET:
            # Transitions fall back to how often the second character comes at all.
            p = [(counts.get((c, a + b), 0) + 10 * col[c, b]) / (rows[c, a] + 10) for c in (True, False)]
            table[128 * ord(a) + ord(b)] = log(p[0]) - log(p[1])
    return table


def ratio(token: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a token: the sum over its transitions."""
    codes = F.transform(F.split(token, ""), F.ascii)
    logs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.get(F.array(*[F.lit(x) for x in table]), a * 128 + b))
    return F.aggregate(logs, F.lit(0.0), lambda s, x: s + x)


#: Elements that a running sum takes together; sums of such parts are summed first, so long lists stay cheap.
_PART = 512


def _starts(lengths: str) -> str:
    """SQL for the sums before each element of an array of longs."""
    run = "aggregate({xs}, named_struct('l', cast(array() as array<bigint>), 'p', {p}), (a, x) -> named_struct('l', array_append(a.l, a.p), 'p', a.p + x), a -> a.l)"
    n = f"cast(ceil(size({lengths}) / {_PART}D) as int)"
    part = f"slice({lengths}, b * {_PART} + 1, {_PART})"
    sums = f"transform(sequence(0, {n} - 1), b -> aggregate({part}, 0L, (s, x) -> s + x))"
    offs = run.format(xs=sums, p="0L")
    inner = run.format(xs=f"slice({lengths}, o.b * {_PART} + 1, {_PART})", p="o.p")
    return f"flatten(transform(transform({offs}, (p, b) -> named_struct('p', p, 'b', b)), o -> {inner}))"


def _sql(s: str) -> str:
    return "r'" + s + "'" if "'" not in s else 'r"' + s + '"' if '"' not in s else "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(text: str, pattern: str, kind: int, value: int = 0) -> str:
    """SQL for ``array<struct<start,kind,end,value>>``: the leftmost non-overlapping matches in code points.

    The text between matches and the matches take turns, so their lengths give the places.
    """
    p = _sql(pattern)
    gaps, found = f"split({text}, {p}, -1)", f"regexp_extract_all({text}, {p}, 0)"
    values = f"regexp_extract_all({text}, {p}, {value})"
    both = f"zip_with({gaps}, {found}, (g, m) -> named_struct('g', cast(length(g) as bigint), 'm', cast(length(m) as bigint)))"
    kept = f"filter({both}, x -> x.m is not null)"
    body = f"""transform(array(named_struct('xs', {kept}, 'vs', {values})), r -> zip_with(
        zip_with(r.xs, {_starts('transform(r.xs, x -> x.g + x.m)')}, (x, s) -> named_struct('start', s + x.g, 'end', s + x.g + x.m)),
        r.vs, (x, v) -> named_struct('start', x.start, 'kind', {kind}, 'end', x.end, 'value', v)))[0]"""
    none = "cast(array() as array<struct<start:bigint,kind:int,end:bigint,value:string>>)"
    return f"case when {text} rlike {p} then {body} else {none} end"


def scan(docs: DataFrame, table: list[float], text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, base, extra)`` for each row of ``docs``: spans ``struct<start,kind,end,value>`` sorted by start and kind.

    ``base`` are matches of the known forms; ``extra`` are candidates that the Markov models take to be random, which
    may lie on base spans. Whole texts are scanned, null ones as empty; repeated rows repeat; other columns are
    ignored; an empty table gives an empty result; ids may be of any type. All is done in the row, without a shuffle:
    the spans of a text are arrays of its row, so a text and some 40 bytes for each candidate in it must fit in a task.
    """
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = t.select("doc_id", F.expr(f"filter({_spans('t', ASSIGN, 0, 2)}, x -> length(x.value) >= 8)").alias("s0"), F.expr(_spans("t", ACCESS, 1)).alias("s1"), F.expr(_spans("t", HEX, 2)).alias("s2"), F.expr(_spans("t", CANDIDATE, 3)).alias("s3"))
    base = F.array_sort(F.concat("s0", "s1", "s2"))
    extra = F.filter("s3", lambda x: ratio(x["value"], table) > threshold)
    return t.select("doc_id", base.alias("base"), extra.alias("extra"))


def secrets(docs: DataFrame, samples: DataFrame | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The digest columns of a scan with models trained from ``samples`` (by default ``default_samples``)."""
    found = scan(docs, train(samples if samples is not None else default_samples(docs.sparkSession)), text, id_col)
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", n(0), n(1), n(2), F.sha2(said("base").cast("binary"), 256).alias("base_sha256"), said(F.array_sort(F.concat("base", "extra"))).alias("spans"))
