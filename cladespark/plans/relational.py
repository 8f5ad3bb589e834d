"""Queries of traces, splits, topologies, alignments and counters over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import alignment, splits
from ..sampler.chains import is_sample
from ..sources import adapters as A
from ..sources import formats
from .registry import ORACLES, query

T, O, TR, TP, AL, C = A.TRACE_SQL, A.OBS_SQL, A.TREES_SQL, A.TOPOLOGY_SQL, A.ALIGNMENT_SQL, A.COUNTERS_SQL


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, since engines sum in different orders; minus zero becomes zero."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _trace_agg(name: str, make, sql: str):
    @query(name, f"with {T} select param, {sql} from trace group by param")
    def run(spark, d, make=make):
        return rounded(A.trace(spark, d).groupBy("param").agg(*make()))

    return run


_VAR = "case when count(value) = 1 then 0 else var_samp(value) end"
_trace_agg("a1_mean", lambda: [stats.mean("value").alias("mean")], "round(avg(value), 6) as mean")
_trace_agg("a2_variance", lambda: [stats.variance("value").alias("variance")], f"round({_VAR}, 6) as variance")
_trace_agg("a3_sd", lambda: [stats.sd("value").alias("sd")], f"round(sqrt({_VAR}), 6) as sd")
_trace_agg("a4_cv", lambda: [stats.coefficient_of_variation("value").alias("cv")], f"round(sqrt({_VAR}) / avg(value), 6) as cv")
_trace_agg(
    "a5_skewness", lambda: [stats.skewness("value").alias("skewness")],
    "round((sum(power(value - m, 3)) / count(*)) / power(sum(power(value - m, 2)) / (count(*) - 1), 1.5), 6) as skewness",
)

ORACLES["a5_skewness"] = f"""with {T}, c as (select *, avg(value) over (partition by param) as m from trace)
select param, round((sum(power(value - m, 3)) / count(*)) / power(sum(power(value - m, 2)) / (count(*) - 1), 1.5), 6) as skewness from c group by param"""
_PS = (0.05, 0.25, 0.5, 0.75, 0.95)
_trace_agg("a6_percentile", lambda: [stats.percentile("value", p).alias(f"p{int(p * 100)}") for p in _PS], ", ".join(f"percentile_disc({p}) within group (order by value) as p{int(p * 100)}" for p in _PS))
ORACLES["a6_percentile"] = f"""with {T}, r as (select *, row_number() over (partition by param order by value) as k, count(*) over (partition by param) as n from trace)
select param, {", ".join(f"round(max(case when k = greatest(1, ceil(n * {p}::double))::bigint then value end), 6) as p{int(p * 100)}" for p in _PS)} from r group by param"""


@query("a6_percentile_compat", f"""with {T}, r as (select *, row_number() over (partition by param order by value) as k, count(*) over (partition by param) as n from trace)
select param, {", ".join(f"round(max(case when k = least(n, ceil(n * {p}::double)::bigint + 1) then value end), 6) as p{int(p * 100)}" for p in _PS)} from r group by param""")
def _a6c(spark, d):
    return rounded(A.trace(spark, d).groupBy("param").agg(*[stats.percentile("value", p, True).alias(f"p{int(p * 100)}") for p in _PS]))


_PSRF = """per as (select {key}, {run} as r, count({x})::double as n, avg({x}) as m, case when count({x}) = 1 then 0 else var_samp({x}) end as v from {src} group by all),
mm as (select {key}, avg(m) as mm, avg(v) as w, avg(n) as n, count(*) as k from per group by {key}),
b as (select per.{key}, sum(per.n * power(m - mm, 2)) as b from per join mm using ({key}) group by all),
psrf as (select {key}, case when k = 1 then 1.0::double else sqrt(((1 - 1 / n) * w + b / (k - 1) / n) / w) end as psrf from mm join b using ({key}))"""


@query("a7_psrf", f"with {T}, {_PSRF.format(key='param', run='run_id', x='value', src='trace')} select param, round(psrf, 6) as psrf from psrf")
def _a7(spark, d):
    return rounded(stats.psrf(A.trace(spark, d), ["param"], "run_id", "value"))


@query("a8_ess")
def _a8(spark, d):
    return rounded(stats.ess(A.trace(spark, d), ["run_id", "param"], "ordinal", "value"), 4)


_LAGS = stats.MOST_LAGS
_ESS = f"""with {T}, c as (select run_id, param, ordinal, value - avg(value) over (partition by run_id, param) as d, count(*) over (partition by run_id, param) as n from trace),
ahead as (select *, unnest(range(0, least({_LAGS}, n - ordinal) + 1)) as k from c),
lags as (select x.run_id, x.param, x.k, max(x.n) as n, avg(x.d * y.d) as g from ahead x join c y on x.run_id = y.run_id and x.param = y.param and y.ordinal = x.ordinal + x.k group by all),
pairs as (select a.run_id, a.param, b.k / 2 as i, a.g + b.g as s from lags a join lags b on a.run_id = b.run_id and a.param = b.param and a.k % 2 = 1 and b.k = a.k + 1 where b.k < least(a.n - 1, {_LAGS})),
live as (select *, min(case when s > 0 then 1 else 0 end) over (partition by run_id, param order by i) as ok from pairs),
added as (select run_id, param, sum(case when ok = 1 then 2 * s else 0 end) as v from live group by all)"""


@query("a8_ess_sql_form", f"""{_ESS}
select l.run_id, l.param, round(case when l.n < 2 then l.n else l.g * l.n / (l.g + coalesce(v, 0)) end, 4) as ess from lags l left join added a on l.run_id = a.run_id and l.param = a.param where l.k = 0""")
def _a8s(spark, d):
    return rounded(stats.ess_sql_form(A.trace(spark, d), ["run_id", "param"], "ordinal", "value", _LAGS), 4)


ORACLES["a8_ess"] = ORACLES["a8_ess_sql_form"]


@query("w3_lag_products", f"{_ESS} select run_id, param, k::int as lag, round(g, 6) as gamma from lags")
def _w3(spark, d):
    return rounded(stats.lag_products(A.trace(spark, d), ["run_id", "param"], "ordinal", "value", _LAGS))


@query("a9_autocorrelation", f"""with {T}, c as (select *, value - avg(value) over (partition by run_id, param) as d from trace),
l as (select *, lead(d, 2) over (partition by run_id, param order by ordinal) as e from c)
select run_id, param, round(sum(d * e) / sum(d * d), 6) as autocorrelation from l group by all""")
def _a9(spark, d):
    return rounded(stats.autocorrelation(A.trace(spark, d), ["run_id", "param"], "ordinal", "value", 2))


@query("a10_pearson", f"""with {T}, p as (select a.param, a.value as x, b.value as y from trace a join trace b on a.param = b.param and a.ordinal = b.ordinal and a.run_id = 0 and b.run_id = 1)
select param, round(corr(x, y), 6) as r, round(corr(x, y) * (count(*) - 1), 5) as compat from p group by param""")
def _a10(spark, d):
    t = A.trace(spark, d)
    p = t.filter("run_id = 0").select("param", "ordinal", F.col("value").alias("x")).join(t.filter("run_id = 1").select("param", "ordinal", F.col("value").alias("y")), ["param", "ordinal"])
    out = p.groupBy("param").agg(stats.pearson("x", "y").alias("r"), stats.pearson("x", "y", True).alias("compat"))
    return out.select("param", F.round("r", 6).alias("r"), F.round("compat", 5).alias("compat"))


@query("a11_sums", f"with {T} select param, round(sum(value), 4) as total from trace group by param")
def _a11(spark, d):
    return rounded(A.trace(spark, d).groupBy("param").agg(F.sum("value").alias("total")), 4)


@query("a16_discrete", """with n as (select user_id % 4 as run_id, event_type, count(*) as n from events group by all),
p as (select *, n / sum(n) over (partition by run_id) as p from n)
select run_id, string_agg(event_type || ':' || printf('%.4f', p), ',' order by p desc, event_type) as distribution from p group by run_id""")
def _a16(spark, d):
    e = A.table(spark, d, "events").select((F.col("user_id") % 4).alias("run_id"), "event_type")
    return stats.discrete_distribution(e, "event_type", ["run_id"])


_KEPT = f"""{T}, sized as (select *, count(*) over (partition by run_id, param) as n from trace), kept as (select * from sized where ordinal > floor(n * 0.25))"""


@query("f5_trace_burnin", f"with {_KEPT} select run_id, param, count(*) as n, min(ordinal) as first_ordinal, round(avg(value), 6) as mean from kept group by all")
def _f5(spark, d):
    k = stats.drop_burnin(A.trace(spark, d), ["run_id", "param"], 0.25)
    return rounded(k.groupBy("run_id", "param").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first_ordinal"), F.avg("value").alias("mean")))


@query("f10_j3_parameters", f"with {T} select param, count(distinct run_id) as runs, count(*) as n from trace where param <> 'Gen' and param in (select param from trace where run_id = 0) group by param")
def _f10(spark, d):
    t = A.trace(spark, d).filter(F.col("param") != "Gen")
    return t.join(t.filter("run_id = 0").select("param").distinct(), "param", "left_semi").groupBy("param").agg(F.count_distinct("run_id").alias("runs"), F.count(F.lit(1)).alias("n"))


def _rank(p: float, x: str = "value") -> str:
    return f"round(max(case when k = greatest(1, ceil(n * {p}::double))::bigint then {x} end), 6)"


@query("k13_parameter_table", f"""with {T}, sized as (select *, count(*) over (partition by run_id, param) as c from trace),
kept as (select run_id, param, value from sized where ordinal > floor(c * 0.25)), {_PSRF.format(key='param', run='run_id', x='value', src='kept')},
r as (select *, row_number() over (partition by param order by value) as k, count(*) over (partition by param) as n from kept)
select r.param, round(avg(value), 6) as mean, round(case when count(*) = 1 then 0 else stddev_samp(value) end, 6) as sd, {_rank(.05)} as perc5, {_rank(.25)} as perc25, {_rank(.5)} as median, {_rank(.75)} as perc75, {_rank(.95)} as perc95, round(max(psrf), 6) as psrf
from r join psrf using (param) group by r.param""")
def _k13(spark, d):
    return rounded(stats.parameter_table(A.trace(spark, d), with_ess=False))


@query("k13_parameter_table_ess")
def _k13e(spark, d):
    return rounded(stats.parameter_table(A.trace(spark, d)), 4)


@query("k3_trace_wide", f"with {T} select ordinal, " + ", ".join(f"round(max(case when param = '{p}' then value end), 6) as \"{p}\"" for p in ("click", "error", "purchase", "signup", "view")) + " from trace where run_id = 0 group by ordinal")
def _k3(spark, d):
    return rounded(A.trace(spark, d).filter("run_id = 0").groupBy("ordinal").pivot("param", ["click", "error", "purchase", "signup", "view"]).agg(F.first("value")))


@query("w1_ordinals", f"with {T} select run_id, param, max(ordinal) as n, round(sum(ordinal * value), 2) as s from trace group by all")
def _w1(spark, d):
    return rounded(A.trace(spark, d).groupBy("run_id", "param").agg(F.max("ordinal").alias("n"), F.sum(F.col("ordinal") * F.col("value")).alias("s")), 2)


@query("w5_elapsed", "select user_id, max(epoch(ts) - epoch(p))::bigint as longest from (select user_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as p from events) group by user_id")
def _w5(spark, d):
    e = A.table(spark, d, "events").withColumn("p", F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.groupBy("user_id").agg(F.round(F.max((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("p").cast("timestamp"))) / 1e6)).cast("long").alias("longest"))


@query("w6_heats", f"""with {T}, f as (select param, ordinal, string_agg(run_id::varchar, ',' order by value desc, run_id) as o from trace group by all) select * from f""")
def _w6(spark, d):
    t = A.trace(spark, d)
    return t.groupBy("param", "ordinal").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("value")).alias("v"), "run_id"))), lambda x: x["run_id"].cast("string")), ",").alias("o"))


@query("w7_intervals", "select (event_id // 500) * 500 as gen, count(*) as n, min(least(event_id, 5000)) as lo from events group by 1")
def _w7(spark, d):
    return A.table(spark, d, "events").groupBy((F.floor(F.col("event_id") / 500) * 500).alias("gen")).agg(F.count(F.lit(1)).alias("n"), F.min(F.least("event_id", F.lit(5000))).alias("lo"))


# Splits.

_SIZES = "sizes as (select file_id, count(distinct tree_id) as trees from obs group by 1)"
_FREQ = f"""{_SIZES}, cnt as (select file_id, split_id, count(distinct tree_id) as n from obs group by all),
grid as (select split_id, file_id, trees from (select distinct split_id from obs) s, sizes),
freq as (select g.split_id, g.file_id, coalesce(c.n, 0)::double / g.trees as f from grid g left join cnt c using (split_id, file_id)),
dev as (select split_id, max(f) as largest, coalesce(stddev_samp(f), 0) as sd from freq group by 1 having max(f) > 0.1)"""


@query("a14_asdsf", f"with {O}, {_FREQ} select round(avg(sd), 9) as asdsf, round(max(sd), 9) as msdsf from dev")
def asdsf(spark, d):
    return rounded(splits.asdsf(A.split_obs(spark, d)), 9)


@query("f7_relevant_splits", f"with {O}, {_FREQ} select split_id, round(largest, 9) as largest, round(sd, 9) as sd from dev")
def _f7(spark, d):
    return rounded(splits.deviations(A.split_obs(spark, d)), 9)


@query("a12_split_counts", f"with {O} select file_id, split_id, count(distinct tree_id) as n from obs group by all")
def _a12(spark, d):
    return splits.counts(A.split_obs(spark, d))


_OCC = "occ as (select split_id, count(*) as occ, (select count(*) from (select distinct file_id, tree_id from obs)) as total from (select distinct split_id, file_id, tree_id from obs) group by 1)"


@query("a13_occurrences", f"with {O}, {_OCC} select * from occ")
def _a13(spark, d):
    return splits.occurrences(A.split_obs(spark, d))


@query("f8_majority", f"with {O}, {_OCC} select * from occ where occ > total * 0.15")
def _f8(spark, d):
    return splits.majority(A.split_obs(spark, d), 0.15)


@query("f8_majority_compat", f"with {O}, {_OCC} select * from occ where occ >= ceil(total * 0.15)")
def _f8c(spark, d):
    return splits.majority(A.split_obs(spark, d), 0.15, True)


@query("o1_o2_split_order", f"with {O}, {_OCC} select split_id, row_number() over (order by occ, split_id) as up, row_number() over (order by occ desc, split_id) as down from occ")
def _o1(spark, d):
    return splits.occurrence_places(A.split_obs(spark, d))


@query("a17_split_ids", f"with {O} select split_id, (dense_rank() over (order by split_id) - 1)::int as rank from (select distinct split_id from obs)")
def _a17(spark, d):
    return splits.split_ids(A.split_obs(spark, d))


@query("a21_tree_length", f"with {O} select file_id, tree_id, round(sum(length), 6) as tree_length from obs group by all")
def _a21(spark, d):
    return rounded(A.split_obs(spark, d).groupBy("file_id", "tree_id").agg(F.sum("length").alias("tree_length")))


@query("a27_min_trees", f"with {O}, {_SIZES} select min(trees) as least, (select trees from sizes order by file_id limit 1) as first_file from sizes")
def _a27(spark, d):
    return splits.file_sizes(A.split_obs(spark, d)).agg(F.min("trees").alias("least"), F.min_by("trees", "file_id").alias("first_file"))


@query("j1_presence", f"with {O}, {_SIZES}, cnt as (select file_id, split_id, count(distinct tree_id) as n from obs group by all) select s.split_id, f.file_id, coalesce(n, 0) as n from (select distinct split_id from obs) s cross join sizes f left join cnt using (split_id, file_id)")
def _j1(spark, d):
    return splits.presence(A.split_obs(spark, d))


@query("j2_lengths", f"with {O}, {_SIZES}, l as (select split_id, file_id, count(*) as n, string_agg(printf('%.2f', length), ',' order by length) as lengths from obs group by all) select s.split_id, f.file_id, coalesce(md5(lengths), md5('')) as lengths, coalesce(n, 0)::int as n from (select distinct split_id from obs) s cross join sizes f left join l using (split_id, file_id)")
def _j2(spark, d):
    l = splits.lengths(A.split_obs(spark, d))
    return l.select("split_id", "file_id", F.md5(F.array_join(F.transform("lengths", lambda x: F.format_string("%.2f", x)), ",").cast("binary")).alias("lengths"), F.size("lengths").alias("n"))


@query("k8_split_statistics", f"""with {O}, {_PSRF.format(key='split_id', run='file_id', x='length', src='obs')},
r as (select *, row_number() over (partition by split_id order by length) as k, count(*) over (partition by split_id) as n from obs)
select r.split_id, count(distinct (file_id, tree_id)) as count, round(avg(length), 6) as mean, round(case when count(*) = 1 then 0 else stddev_samp(length) end, 6) as sd, {_rank(.05, 'length')} as perc5, {_rank(.25, 'length')} as perc25, {_rank(.5, 'length')} as median, {_rank(.75, 'length')} as perc75, {_rank(.95, 'length')} as perc95, count(distinct file_id) as files, case when count(distinct file_id) > 1 then round(max(psrf), 6) end as psrf
from r join psrf using (split_id) group by r.split_id""")
def _k8(spark, d):
    return rounded(splits.statistics(A.split_obs(spark, d)))


@query("k9_branch_lengths", f"with {O} select split_id, file_id, round(length, 4) as length, count(*) as n from obs group by all")
def _k9(spark, d):
    return A.split_obs(spark, d).groupBy("split_id", "file_id", F.round("length", 4).alias("length")).agg(F.count(F.lit(1)).alias("n"))


@query("k10_file_names", f"with {O} select (dense_rank() over (order by file_id) - 1)::int as id, 'run.' || file_id as file_name from (select distinct file_id from obs)")
def _k10(spark, d):
    return A.split_obs(spark, d).select("file_id").distinct().select((F.dense_rank().over(W.partitionBy(F.lit(0)).orderBy("file_id")) - 1).alias("id"), F.concat(F.lit("run."), "file_id").alias("file_name"))


_N = "n as (select file_id, count(*) as n from trees group by 1)"
_W = "select file_id, count(*) as trees, min(t.ordinal) as lo, max(t.ordinal) as hi from trees t join n using (file_id)"


def _window(df):
    return df.groupBy("file_id").agg(F.count(F.lit(1)).alias("trees"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"))


@query("f1_burnin_smallest", f"with {TR}, {_N} {_W} where t.ordinal >= floor((select min(n) from n) * 0.25) group by 1")
def _f1(spark, d):
    return _window(splits.burnin_smallest(splits_trees(spark, d), 0.25))


@query("f2_burnin_first", f"with {TR}, {_N} {_W} where t.ordinal >= floor((select n from n order by file_id limit 1) * 0.25) group by 1")
def _f2(spark, d):
    return _window(splits.burnin_first(splits_trees(spark, d), 0.25))


@query("f3_burnin_each", f"with {TR}, {_N} {_W} where t.ordinal >= floor(n * 0.25) group by 1")
def _f3(spark, d):
    return _window(splits.burnin_each(splits_trees(spark, d), 0.25))


@query("f3_burnin_constant", f"with {TR}, {_N} {_W} where t.ordinal >= 100 group by 1")
def _f3c(spark, d):
    return _window(splits.burnin_each(splits_trees(spark, d), constant=100))


@query("f12_burnin_compat", f"with {TR}, {_N} {_W} where t.ordinal >= 100 - 2 and t.ordinal < n - 2 group by 1")
def _f12(spark, d):
    return _window(splits.burnin_each(splits_trees(spark, d), constant=100, compat=True))


@query("f4_no_burnin", f"with {TR}, {_N} {_W} group by 1")
def _f4(spark, d):
    return _window(splits_trees(spark, d))


def splits_trees(spark, d):
    return A.tree_sample(A.split_obs(spark, d))


@query("a14_asdsf_burnin", f"with {TR}, {_N}, late as (select file_id, tree_id from trees join n using (file_id) where ordinal >= floor(n * 0.25)), all_obs as (select * from obs), {_FREQ.replace('from obs', 'from all_obs join late using (file_id, tree_id)')} select round(avg(sd), 9) as asdsf, round(max(sd), 9) as msdsf from dev")
def _a14b(spark, d):
    obs = A.split_obs(spark, d)
    late = splits.burnin_each(A.tree_sample(obs), 0.25).select("file_id", "tree_id")
    return rounded(splits.asdsf(obs.join(late, ["file_id", "tree_id"], "left_semi")), 9)


@query("u1_union_distinct", f"with {O} select split_id from obs where file_id = 0 union select split_id from obs where file_id = 1 union select split_id from obs where file_id = 2")
def _u1(spark, d):
    o = A.split_obs(spark, d)
    parts = [o.filter(F.col("file_id") == k).select("split_id") for k in range(3)]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("u2_pooled", f"with {O} select split_id, count(*) as pooled, count(distinct tree_id) as trees from obs group by 1")
def _u2(spark, d):
    return A.split_obs(spark, d).groupBy("split_id").agg(F.count(F.lit(1)).alias("pooled"), F.count_distinct("tree_id").alias("trees"))


@query("u3_concat_burnin", f"with {TR}, {_N} select count(*) as trees, sum(ordinal)::bigint as s from trees join n using (file_id) where ordinal >= round(n * 0.1)")
def _u3(spark, d):
    t = splits_trees(spark, d)
    n = t.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return t.join(n, "file_id").filter(F.col("ordinal") >= F.round(F.col("n") * 0.1)).agg(F.count(F.lit(1)).alias("trees"), F.sum("ordinal").alias("s"))


_TC = "tc as (select topology, count(*) as n from topologies group by 1), tt as (select *, sum(n) over () as total, sum(n) over (order by n desc, topology rows unbounded preceding) - n as before from tc)"


@query("a15_topologies", f"with {TP}, {_TC} select topology, n, total::bigint as total from tt")
def _a15(spark, d):
    return splits.topology_counts(A.topology(A.split_obs(spark, d)))


@query("w2_credible_set", f"with {TP}, {_TC} select topology, n, round(n / total, 9) as freq from tt where before <= floor(total * 0.5::double)")
def _w2(spark, d):
    return rounded(splits.credible_set(A.topology(A.split_obs(spark, d)), 0.5), 9)


@query("a30_credible_size", f"with {TP}, {_TC} select s.s as share, (count(*) filter (before + n < total * s.s) + 1)::bigint as topologies from tt, (values (0.5::double), (0.99::double)) s(s) group by 1")
def _a30(spark, d):
    return splits.credible_size(A.topology(A.split_obs(spark, d)))


@query("o3_topology_order", f"with {TP}, {_TC} select topology, row_number() over (order by n desc, topology) as place from tt")
def _o3(spark, d):
    return splits.topology_places(A.topology(A.split_obs(spark, d)))


@query("a29_best_tree", f"with {T}, m as (select run_id, arg_max(ordinal, (value, -ordinal)) as ordinal, max(value) as value from trace where param = 'view' group by 1) select run_id, ordinal, round(value, 6) as value from m")
def _a29(spark, d):
    t = A.trace(spark, d).filter("param = 'view'")
    return rounded(t.groupBy("run_id").agg(F.max_by("ordinal", F.struct("value", -F.col("ordinal"))).alias("ordinal"), F.max("value").alias("value")))


@query("a28_best_likelihood", f"with {T} select run_id, round(max(value), 6) as best from trace group by 1")
def _a28(spark, d):
    return rounded(A.trace(spark, d).groupBy("run_id").agg(F.max("value").alias("best")))


@query("a31_concat_traces", f"with {_KEPT} select param, count(*) as n, round(avg(value), 6) as mean, round(min(value), 6) as lo, round(max(value), 6) as hi from kept group by 1")
def _a31(spark, d):
    k = stats.drop_burnin(A.trace(spark, d), ["run_id", "param"], 0.25)
    return rounded(k.groupBy("param").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi")))


@query("t18_rf_distances", f"with {TP}, s as (select topology as t, unnest(string_split(topology, ',')) as split_id from (select distinct topology from topologies)), k as (select t, count(*) as k from s group by 1) select a.t as a, b.t as b, (ka.k + kb.k - 2 * count(*))::bigint as rf from s a join s b on a.split_id = b.split_id and a.t < b.t join k ka on ka.t = a.t join k kb on kb.t = b.t group by a.t, b.t, ka.k, kb.k")
def _t18(spark, d):
    """Distances of distinct topologies, of which ten splits allow at most 1,023."""
    t = A.topology(A.split_obs(spark, d)).select("topology").distinct()
    return splits.rf_distances(t.select("topology", F.explode(F.split("topology", ",")).alias("split_id")), "topology")


# Alignments.


@query("a18_patterns", f"with {AL}, c as (select site, string_agg(state::varchar, '' order by taxon_id) as pattern from aln group by 1) select pattern, count(*) as weight from c group by 1")
def _a18(spark, d):
    p = alignment.patterns(A.alignment(spark, d))
    return p.select(F.array_join(F.col("pattern").cast("array<string>"), "").alias("pattern"), "weight")


_SCHEME = "(values ('odd', 1, 32, 2), ('even', 2, 32, 2), ('rest', 33, 64, 1)) p(name, lo, hi, stride)"


def _scheme(spark):
    return spark.createDataFrame([("odd", "BIN", 1, 32, 2), ("even", "BIN", 2, 32, 2), ("rest", "BIN", 33, 64, 1)], "name string, data_type string, lo int, hi int, stride int")


@query("j5_sites_to_partitions", f"with {AL} select p.name, a.taxon_id, count(*) as sites, sum(state)::bigint as s from aln a join {_SCHEME} on a.site between lo and hi and (a.site - lo) % stride = 0 group by all")
def _j5(spark, d):
    return A.alignment(spark, d).join(F.broadcast(alignment.sites_of(_scheme(spark))), "site").groupBy("name", "taxon_id").agg(F.count(F.lit(1)).alias("sites"), F.sum("state").alias("s"))


@query("s7_scheme_faults", "select s.s::int as site, coalesce(n, 0)::bigint as n from range(1, 65) s(s) left join (select x as site, count(*) as n from (values (1, 40), (38, 60)) p(lo, hi), range(1, 65) r(x) where x between lo and hi group by 1) c on c.site = s.s where coalesce(n, 0) <> 1")
def _s7(spark, d):
    s = spark.createDataFrame([("a", "BIN", 1, 40, 1), ("b", "BIN", 38, 60, 1)], "name string, data_type string, lo int, hi int, stride int")
    return alignment.scheme_faults(alignment.sites_of(s), 64)


@query("a19_contributions", f"with {AL}, w as (select p.name, count(distinct site) as w from aln a join {_SCHEME} on a.site between lo and hi and (a.site - lo) % stride = 0 group by 1) select name, round(w / sum(w) over (), 9) as contribution from w")
def _a19(spark, d):
    aln = A.alignment(spark, d).join(F.broadcast(alignment.sites_of(_scheme(spark))), "site")
    return rounded(alignment.contributions(alignment.patterns(aln, ["name"]), "name"), 9)


@query("f9_informative", f"with {AL}, n as (select site, state, count(*) as n from aln group by all) select site, count(*) > 1 and max(n) > 1 as informative from n group by 1")
def _f9(spark, d):
    return alignment.informative(A.alignment(spark, d), [1, 2])


@query("f9_informative_strict", f"with {AL}, n as (select site, state, count(*) as n from aln group by all) select site, count(*) filter (n > 1) >= 2 as informative from n group by 1")
def _f9s(spark, d):
    return alignment.informative(A.alignment(spark, d), [1, 2], strict=True)


@query("a20_frequencies", f"with {AL} select (state - 1)::int as bit, round(count(*) / (select count(*) from aln), 9) as frequency from aln group by 1")
def _a20(spark, d):
    return rounded(alignment.frequencies(alignment.state_counts(A.alignment(spark, d)), 2), 9)


@query("p1_encode", "select l_returnflag as ch, max(case l_returnflag when 'A' then 1 when 'N' then 15 when 'R' then 5 end)::int as code, count(*) as n from lineitem group by 1")
def _p1(spark, d):
    li = A.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("ch")).agg(F.count(F.lit(1)).alias("n"))
    return li.select("ch", alignment.encode(F.col("ch"), "DNA").cast("int").alias("code"), "n")


# Counters.


@query("a25_acceptance", f"with {C} select run_id, name, round(count(*) filter (accepted) / count(*), 9) as ratio, count(*) as seen from counters group by all")
def _a25(spark, d):
    return rounded(stats.acceptance(A.counters(spark, d), ["run_id", "name"]), 9)


@query("a26_merge", f"with {C}, part as (select run_id, name, gen % 8 as p, count(*) filter (accepted) as acc, count(*) filter (not accepted) as rej from counters group by all) select run_id, sum(acc)::bigint as acc, sum(rej)::bigint as rej from part group by 1")
def _a26(spark, d):
    return stats.merged_counts(A.counters(spark, d), ["run_id"])


@query("w4_batches", f"with {C}, k as (select *, (row_number() over (partition by run_id, name order by gen) - 1) // 10 as batch from counters) select run_id, name, batch, round(count(*) filter (accepted) / count(*), 9) as ratio from k group by all")
def _w4(spark, d):
    return rounded(stats.tuning_batches(A.counters(spark, d), ["run_id", "name"], "gen", 10), 9)


@query("d15_swap_matrix", "select least(user_id % 4, event_id % 4) as a, greatest(user_id % 4, event_id % 4) as b, count(*) filter (event_type = 'click') as acc, count(*) as seen from events where user_id % 4 <> event_id % 4 group by all")
def _d15(spark, d):
    e = A.table(spark, d, "events").select((F.col("user_id") % 4).alias("x"), (F.col("event_id") % 4).alias("y"), "event_type").filter("x <> y")
    return e.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count_if(F.col("event_type") == "click").alias("acc"), F.count(F.lit(1)).alias("seen"))


@query("f11_sampling", "select event_id as gen, event_type as param, round(value, 6) as value from events where user_id % 4 = 0 and event_id % 50 = 0")
def _f11(spark, d):
    e = A.table(spark, d, "events").filter(is_sample(F.col("user_id") % 4, F.col("event_id"), 50))
    return rounded(e.select(F.col("event_id").alias("gen"), F.col("event_type").alias("param"), "value"))


@query("k5_j11_restart", f"with {T} select run_id, count(*) as n, max(ordinal) as last from trace where ordinal <= 100 group by 1")
def _k5(spark, d):
    kept = formats.keep_until(A.trace(spark, d).withColumn("gen", F.col("ordinal")), 100)
    return kept.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max("ordinal").alias("last"))


@query("h1_columns", "select l_extendedprice, l_quantity, count(*) as n from lineitem group by all")
def _h1(spark, d):
    return formats.columns_like(A.table(spark, d, "lineitem"), "price$|quantity$").groupBy("l_extendedprice", "l_quantity").agg(F.count(F.lit(1)).alias("n"))


@query("h6_histogram", "select least(floor(value / 10), 100)::bigint as bucket, count(*) as n from events group by 1")
def _h6(spark, d):
    return A.table(spark, d, "events").groupBy(F.least(F.floor(F.col("value") / 10), F.lit(100)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
