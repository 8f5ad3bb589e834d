"""Queries of trees, consensus, scores, densities and sampling over the driver's tables."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import density, scalar
from ..operators import alignment, consensus, likelihood, splits, trees
from ..sources import adapters as A
from ..sources import formats
from .registry import query
from .relational import rounded

TAXA = 8


def tree_texts(spark, d) -> DataFrame:
    """``(file_id, tree_id, newick)``: a comb of eight taxa for each order, in the order of a remainder."""
    o = A.table(spark, d, "orders").select((F.col("o_custkey") % 3).cast("int").alias("file_id"), F.col("o_orderkey").alias("tree_id"), "o_custkey")
    rank = F.transform(F.sequence(F.lit(1), F.lit(TAXA)), lambda t: F.struct(((F.col("tree_id") * 7 + t * t * 13 + F.col("o_custkey") * t) % 101).alias("k"), t.alias("t")))
    o = o.withColumn("p", F.transform(F.sort_array(rank), lambda x: x["t"].cast("string")))
    length = lambda k: ((F.col("tree_id") % 7 + k) / 100).cast("string")
    text = F.concat(F.get("p", F.lit(TAXA - 2)), F.lit(":0.1,"), F.get("p", F.lit(TAXA - 1)), F.lit(":0.1"))
    for k in range(TAXA - 3, 1, -1):
        text = F.concat(F.get("p", F.lit(k)), F.lit(":0.1,("), text, F.lit("):"), length(k + 1))
    text = F.concat(F.lit("("), F.get("p", F.lit(0)), F.lit(":0.1,"), F.get("p", F.lit(1)), F.lit(":0.1,("), text, F.lit("):"), length(2), F.lit(");"))
    return o.select("file_id", "tree_id", text.alias("newick"))


COMBS_SQL = f"""ranked as (
  select (o_custkey % 3)::int as file_id, o_orderkey as tree_id, list(t order by (o_orderkey * 7 + t * t * 13 + o_custkey * t) % 101, t) as p
  from orders, range(1, {TAXA + 1}) r(t) group by o_orderkey, o_custkey),
sides as (
  select file_id, tree_id, k, (tree_id % 7 + k) / 100.0::double as length, p[k + 1:] as s, p[:k] as c from ranked, range(2, {TAXA - 1}) r(k)),
combs as (
  select file_id, tree_id, length, array_to_string(list_sort(case when list_contains(s, 1) then c else s end), ',') as split from sides)"""


@query("t1_newick_splits", f"with {COMBS_SQL} select file_id, tree_id, split, round(length, 6) as length from combs")
def newick_splits(spark, d):
    s = trees.splits_table(tree_texts(spark, d))
    return rounded(s.withColumn("split", F.array_join(F.col("split").cast("array<string>"), ",")))


@query("s11_newick_edges", f"with ranked as (select o_orderkey as tree_id from orders) select tree_id, {2 * TAXA - 3}::bigint as edges, {TAXA}::bigint as tips, round({TAXA} * 0.1 + ({TAXA - 3} * (tree_id % 7) + {sum(range(2, TAXA - 1))}) / 100.0::double, 6) as total from ranked")
def newick_edges(spark, d):
    e = trees.edges_table(tree_texts(spark, d))
    return rounded(e.groupBy("tree_id").agg(F.count(F.lit(1)).alias("edges"), F.count_if("is_tip").alias("tips"), F.sum("length").alias("total")))


@query("a14_newick_asdsf", f"""with {COMBS_SQL}, sizes as (select file_id, count(distinct tree_id) as trees from combs group by 1),
cnt as (select file_id, split, count(*) as n from combs group by all),
freq as (select s.split, z.file_id, coalesce(n, 0)::double / trees as f from (select distinct split from combs) s cross join sizes z left join cnt c on c.split = s.split and c.file_id = z.file_id),
dev as (select split, stddev_samp(f) as sd from freq group by 1 having max(f) > 0.01)
select round(avg(sd), 9) as asdsf, round(max(sd), 9) as msdsf from dev""")
def newick_asdsf(spark, d):
    s = trees.splits_table(tree_texts(spark, d), with_length=False).withColumnRenamed("split", "split_id")
    return rounded(splits.asdsf(s, 0.01), 9)


@query("t4_consensus_support", f"""with {COMBS_SQL}, total as (select count(*) as total from orders)
select split, count(*) as occ, round(avg(length), 6) as mean, round(quantile_disc(length, 0.5), 6) as median from combs group by split having count(*) > (select total from total) * 0.05""")
def consensus_support(spark, d):
    s = consensus.split_support(trees.splits_table(tree_texts(spark, d)))
    out = s.filter("occ > total * 0.05").select(F.array_join(F.col("split").cast("array<string>"), ",").alias("split"), "occ", "mean", "median")
    return rounded(out)


@query("t5_consensus_tree")
def consensus_tree(spark, d):
    obs = trees.splits_table(tree_texts(spark, d), trivial=True)
    return spark.createDataFrame([(k, consensus.consensus(obs, TAXA, k)) for k in ("MR", "MRE", "STRICT")], "kind string, newick string")


@query("p15_compatible", f"""with {COMBS_SQL}, l as (select distinct split, string_split(split, ',') as s from combs)
select a.split as a, b.split as b, (len(list_intersect(a.s, b.s)) in (0, len(a.s), len(b.s))) as compatible from l a join l b on a.split < b.split""")
def compatible(spark, d):
    c = trees.splits_table(tree_texts(spark, d), with_length=False).select("split").distinct()  # eight taxa have at most 119
    top = c.withColumn("s", F.array_join(F.col("split").cast("array<string>"), ","))
    x, y = top.alias("x"), top.alias("y")
    return x.join(y, F.col("x.s") < F.col("y.s")).select(F.col("x.s").alias("a"), F.col("y.s").alias("b"), splits.compatible(F.col("x.split"), F.col("y.split")).alias("compatible"))


@query("p14_split_words", f"""with {COMBS_SQL}, l as (select distinct split, string_split(split, ',') as s from combs)
select split, list_sum(list_transform(s, lambda x: (1 << (x::bigint - 1))))::bigint as word, len(s)::int as bits from l""")
def split_words(spark, d):
    s = trees.splits_table(tree_texts(spark, d), with_length=False).select("split").distinct()
    w = F.get(splits.words(F.col("split"), 1), F.lit(0))
    return s.select(F.array_join(F.col("split").cast("array<string>"), ",").alias("name"), w.alias("word"), F.bit_count(w).alias("bits")).withColumnRenamed("name", "split")


@query("k7_split_listing", f"""with {COMBS_SQL}, l as (select distinct split, string_split(split, ',') as s from combs),
n as (select split, case when len(s) * 2 > {TAXA} then list_filter(['1','2','3','4','5','6','7','8'], lambda x: not list_contains(s, x)) else s end as side from l)
select split, array_to_string(list_transform(list_sort(side), lambda x: 't' || x), ',') as taxa from n""")
def split_listing(spark, d):
    s = trees.splits_table(tree_texts(spark, d), with_length=False).select("split").distinct()
    small = F.sort_array(splits.smaller_side(F.col("split"), TAXA))
    return s.select(F.array_join(F.col("split").cast("array<string>"), ",").alias("split"), F.array_join(F.transform(small, lambda t: F.concat(F.lit("t"), t.cast("string"))), ",").alias("taxa"))


@query("h2_named_topologies", f"""with {COMBS_SQL} select tree_id, p[1] as first_taxon from ranked""")
def named(spark, d):
    t = tree_texts(spark, d).withColumn("named", formats.with_names(F.col("newick"), {k: f"t{k}" for k in range(1, TAXA + 1)}))
    return t.select("tree_id", F.regexp_extract("named", r"^\(t(\d+):", 1).cast("long").alias("first_taxon"))


# Scores.


def _patterns(spark, d) -> DataFrame:
    return alignment.patterns(A.alignment(spark, d)).withColumn("part_id", F.lit(0))


@query("a23_parsimony", f"""with {A.ALIGNMENT_SQL}, cols as (select site, list({{'m': state, 'c': 0}} order by taxon_id desc) as l from aln group by 1),
folded as (select list_reduce(l, lambda a, b: {{'m': case when a.m & b.m = 0 then a.m | b.m else a.m & b.m end, 'c': a.c + case when a.m & b.m = 0 then 1 else 0 end}}) as r from cols)
select 0 as part_id, sum(r.c)::bigint as score from folded""")
def parsimony(spark, d):
    return likelihood.parsimony(_patterns(spark, d), likelihood.caterpillar(A.table(spark, d, "embeddings").count()))


@query("a22_likelihood")
def log_likelihood(spark, d):
    model = likelihood.reversible(np.ones(1), np.full(2, 0.5), 1.0)
    return rounded(likelihood.log_likelihood(_patterns(spark, d), likelihood.caterpillar(A.table(spark, d, "embeddings").count()), {}, model))


#: Protein columns of three taxa: letters by remainders, with ambiguous ones and gaps among them.
_LETTERS = "ARNDCQEGHILKMFPSTWYVBZX-"
_TAXA_KEYS = ("l_partkey", "l_partkey + l_suppkey", "l_partkey + 7 * l_linenumber")
_AA_SQL = f"""codes(ch, m) as (values {", ".join(f"('{c}', {alignment.AA_CODES[c]})" for c in _LETTERS)}),
cols as (select l_suppkey % 3 as part_id, {", ".join(f"substr('{_LETTERS}', (1 + ({k}) % {len(_LETTERS)})::int, 1) as c{i}" for i, k in enumerate(_TAXA_KEYS))} from lineitem),
pats as (select part_id, x.m as m0, y.m as m1, z.m as m2, count(*) as weight from cols join codes x on x.ch = c0 join codes y on y.ch = c1 join codes z on z.ch = c2 group by all)"""


def protein_patterns(spark, d) -> DataFrame:
    """``(part_id, pattern, weight)`` of protein characters read from text columns."""
    letter = lambda k: alignment.encode(F.substr(F.lit(_LETTERS), (F.expr(f"1 + ({k}) % {len(_LETTERS)}")).cast("int"), F.lit(1)), "PROT")
    cols = A.table(spark, d, "lineitem").select((F.col("l_suppkey") % 3).alias("part_id"), F.array(*[letter(k) for k in _TAXA_KEYS]).alias("pattern"))
    return cols.groupBy("part_id", "pattern").agg(F.count(F.lit(1)).alias("weight"))


_STAR = 0.3  # the length of each of the three branches
_P = "(1 / 20.0::double + 19 / 20.0::double * exp(-20 / 19.0::double * 0.3::double))"
_Q = "(1 / 20.0::double - 1 / 20.0::double * exp(-20 / 19.0::double * 0.3::double))"


@query("a22_protein_likelihood", f"""with {_AA_SQL},
parts as (select pats.*, {" * ".join(f"(bit_count(m{i}) * {_Q} + ((m{i} >> x::int) & 1) * ({_P} - {_Q}))" for i in range(3))} / 20 as l from pats, range(20) r(x)),
sites as (select part_id, m0, m1, m2, any_value(weight) as weight, ln(sum(l)) as lnl from parts group by part_id, m0, m1, m2)
select part_id, round(sum(weight * lnl), 4) as lnl from sites group by 1""")
def protein_likelihood(spark, d):
    return rounded(likelihood.log_likelihood(protein_patterns(spark, d), likelihood.caterpillar(3, _STAR), {}, likelihood.jukes_cantor(20)), 4)


@query("a23_protein_parsimony", f"""with {_AA_SQL}, s as (select *, case when m0 & m1 = 0 then m0 | m1 else m0 & m1 end as m, case when m0 & m1 = 0 then 1 else 0 end as c from pats)
select part_id, sum(weight * (c + case when m & m2 = 0 then 1 else 0 end))::bigint as score from s group by 1""")
def protein_parsimony(spark, d):
    return likelihood.parsimony(protein_patterns(spark, d), likelihood.caterpillar(3))


@query("p11_gamma_rates")
def gamma_rates(spark, d):
    rows = [(a, k, float(r)) for a in (0.1, 0.5, 1.0, 5.0) for k, r in enumerate(likelihood.gamma_rates(a))]
    return rounded(spark.createDataFrame(rows, "alpha double, category int, rate double"))


# Densities and scalar functions.


@query("r1_densities", """select event_id, round(ln(10.0::double) - 10 * value, 6) as exponential, round((2.5 - 1) * ln(value + 1) + 2.5 * ln(0.5) - lgamma(2.5) - (value + 1) * 0.5, 6) as gamma,
round(ln(1.5 / 20) + 0.5 * ln((value + 1) / 20) - power((value + 1) / 20, 1.5), 6) as weibull, round(lgamma(value + 1), 6) as ln_gamma from events""")
def densities(spark, d):
    e = A.table(spark, d, "events")
    x = F.col("value") + 1
    return rounded(e.select("event_id", density.ln_exponential(F.col("value"), 10.0).alias("exponential"), density.ln_gamma_density(x, 2.5, 0.5).alias("gamma"), density.ln_weibull(x, 20.0, 1.5).alias("weibull"), density.ln_gamma(x).alias("ln_gamma")))


@query("r1_dirichlet", """select l_orderkey, l_linenumber, round(lgamma(9.0) - lgamma(2.0) - lgamma(3.0) - lgamma(4.0) + ln(a) + 2 * ln(b) + 3 * ln(c), 6) as ln_dirichlet
from (select l_orderkey, l_linenumber, l_quantity / t as a, (l_partkey % 50 + 1) / t as b, (l_suppkey % 10 + 1) / t as c from (select *, l_quantity + l_partkey % 50 + 1 + l_suppkey % 10 + 1 as t from lineitem))""")
def dirichlet(spark, d):
    li = A.table(spark, d, "lineitem")
    v = scalar.to_sum(F.array(F.col("l_quantity").cast("double"), (F.col("l_partkey") % 50 + 1).cast("double"), (F.col("l_suppkey") % 10 + 1).cast("double")))
    return rounded(li.select("l_orderkey", "l_linenumber", density.ln_dirichlet(v, [2.0, 3.0, 4.0]).alias("ln_dirichlet")))


@query("a24_joint_prior", f"with {A.OBS_SQL} select file_id, tree_id, round(sum(ln(10.0::double) - 10 * length), 6) as ln_prior from obs group by all")
def joint_prior(spark, d):
    o = A.split_obs(spark, d)
    return rounded(o.groupBy("file_id", "tree_id").agg(density.joint_prior(density.Exponential(10.0).column(F.col("length"))).alias("ln_prior")))


@query("p2_branch_scale", f"with {A.OBS_SQL} select file_id, split_id, round(avg(exp(-length / 0.8)), 6) as z, round(avg(length), 6) as length from obs group by all")
def branch_scale(spark, d):
    o = A.split_obs(spark, d).withColumn("z", scalar.to_z(F.col("length"), 0.8))
    return rounded(o.groupBy("file_id", "split_id").agg(F.avg("z").alias("z"), F.avg(scalar.from_z(F.col("z"), 0.8)).alias("length")))


@query("p3_mean_rate", "select l_returnflag, round(sum(l_discount * l_tax), 6) as rate from lineitem group by 1")
def mean_rate(spark, d):
    return rounded(A.table(spark, d, "lineitem").groupBy("l_returnflag").agg(scalar.mean_substitution_rate(F.col("l_discount"), F.col("l_tax")).alias("rate")))


@query("p4_heats", "select r_regionkey as chain, round(1 / (1 + 0.1::double * r_regionkey), 9) as beta from region")
def heats(spark, d):
    return rounded(A.table(spark, d, "region").select(F.col("r_regionkey").alias("chain"), scalar.heat(0.1, F.col("r_regionkey")).alias("beta")), 9)


@query("p5_normalise", """with v as (select l_orderkey, l_linenumber, l_quantity as a, l_tax + 1 as b, l_discount + 2 as c from lineitem)
select l_orderkey, l_linenumber, round(a / (a + b + c), 9) as share, round(a / c, 9) as relative, round(b / (a + b + c) * 3, 9) as scaled from v""")
def normalise(spark, d):
    v = A.table(spark, d, "lineitem").withColumn("v", F.array("l_quantity", F.col("l_tax") + 1, F.col("l_discount") + 2))
    v = v.select("l_orderkey", "l_linenumber", F.get(scalar.to_sum(F.col("v")), F.lit(0)).alias("share"), F.get(scalar.relative_to_last(F.col("v")), F.lit(0)).alias("relative"), F.get(scalar.to_sum(F.col("v"), 3.0), F.lit(1)).alias("scaled"))
    return rounded(v, 9)


@query("p6_p7_triangle", "select n_nationkey, ((s * s - s) // 2)::int as rates from (select n_nationkey, n_nationkey + 2 as s from nation)")
def triangle(spark, d):
    return A.table(spark, d, "nation").select("n_nationkey", scalar.triangle(F.col("n_nationkey") + 2).alias("rates"))


@query("p8_bounds", "select event_id, round(greatest(least(value, 100.0), 0.02), 6) as clamped, value between 0.02 and 100 as inside from events")
def bounds(spark, d):
    return rounded(A.table(spark, d, "events").select("event_id", scalar.clamp(F.col("value"), 0.02, 100.0).alias("clamped"), scalar.inside(F.col("value"), 0.02, 100.0).alias("inside")))


@query("p17_p18_names", "select c_custkey, 'brlens$' || (c_custkey % 4) as name, case c_nationkey % 3 when 0 then 'topo' when 1 then 'bl' else 'pi' end as short from customer")
def names(spark, d):
    c = A.table(spark, d, "customer")
    category = F.element_at(F.array(F.lit("topology"), F.lit("brlens"), F.lit("statefreq")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    return c.select("c_custkey", scalar.run_name("brlens", F.col("c_custkey") % 4).alias("name"), scalar.short_name(category).alias("short"))


@query("p19_log_space", "select l_returnflag, round(sum(ln(l_extendedprice)), 4) as ln_product, round(sum(ln(l_extendedprice)) * 0.5, 4) as ln_root from lineitem group by 1")
def log_space(spark, d):
    s = scalar.ln_product("l_extendedprice")
    return rounded(A.table(spark, d, "lineitem").groupBy("l_returnflag").agg(s.alias("ln_product"), scalar.ln_power(s, 0.5).alias("ln_root")), 4)


@query("p20_trim", "select n_nationkey, trim(n_name, 'AEIOU') as trimmed from nation")
def trimmed(spark, d):
    return A.table(spark, d, "nation").select("n_nationkey", scalar.trim(F.col("n_name"), "AEIOU").alias("trimmed"))


@query("j8_priors", """with s as (select s_suppkey, s_suppkey % 5 as p from supplier)
select s_suppkey, case when p in (1, 2) then 'specific' when p < 4 then 'general' else 'default' end as prior from s""")
def priors(spark, d):
    """A prior given for a parameter's partitions comes before a general one, and that before the default."""
    from ..sampler import config

    given = config.parse("begin priors; brlenspr exponential(2); brlenspr{1,2} exponential(3); ratehetpr{1} uniform(0,9); end;", 5).priors
    names = {3.0: "specific", 2.0: "general", 10.0: "default"}
    # Partition 4 has its prior from a configuration without a general one.
    of = {p: names[config.prior_for("brlens", {p}, given if p < 4 else given[2:]).rate] for p in range(5)}
    return A.table(spark, d, "supplier").select("s_suppkey", F.element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), (F.col("s_suppkey") % 5).cast("int")).alias("prior"))


# Sampling and streams.


@query("x1_prior_sampling")
def prior_sampling(spark, d):
    """Two coupled chains in each of two runs, without data: branch lengths follow their prior."""
    from ..sampler import chains, config

    c = config.parse("begin run; numGen 200; numRuns 2; numCoupledChains 2; samplingFreq 20; end; begin proposals; stNNI 3; eSPR 0; parsimonySPR 0; likeSPR 0; blDistGamma 0; end;")
    data = chains.Data(None, None, 4, {"brlens": density.Exponential(10.0), "ratehet": density.Uniform(0.02, 200.0)})
    s = chains.Sampler(spark, data, c, 6, seed=7, available=frozenset({"topology", "brlens", "ratehet"})).run(200, batch=100)
    return rounded(chains.trace_of(s).filter("param in ('TL{0}', 'LnPr', 'alpha{0}')"))


@query("x7_stream_windows", "select date_trunc('hour', ts) as start, event_type as param, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_windows(spark, d):
    from ..streaming.monitor import running_counts

    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path + "*").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("param"), "value")
    name = "stream_" + uuid.uuid4().hex
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    q = running_counts(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{base}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.table(name)
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "param", "n", F.round("total", 4).alias("total"))
