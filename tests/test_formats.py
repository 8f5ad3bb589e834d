import pytest
from pyspark.sql import functions as F

from cladespark.operators.trees import splits_table
from cladespark.sources import formats, sinks

TREES = """#NEXUS
[ID: 7]
[Param: tree]
begin trees;
\ttranslate
\t1\talpha,
\t2\tbeta,
\t3\tgamma,
\t4\tdelta;
\ttree gen.0.{0} = [&U] (2:0.1,(3:0.1,4:0.1):0.2,1:0.3):0.0;
\ttree gen.500.{0} = [&U] (3:0.1,(2:0.1,4:0.1):0.2,1:0.3):0.0;
end;
"""


def test_phylip_shapes(spark, tmp_path):
    inter = " 3 8\na ACGT\nb AC-T\nc NNGT\n\nACGT\nACGT\nACGA\n"
    seq = "3 8\na ACGT\nACGT\nb AC-TACGT\nc NNGT ACGA\n"
    assert formats.parse_phylip(inter) == formats.parse_phylip(seq) == [("a", "ACGTACGT"), ("b", "AC-TACGT"), ("c", "NNGTACGA")]
    with pytest.raises(ValueError):
        formats.parse_phylip("2 4\na ACGT\nb ACG\n")
    p = tmp_path / "a.phy"
    p.write_text(inter)
    assert formats.guess_format(spark, str(p)) == "phylip"
    rows = formats.read_alignment(spark, str(p)).orderBy("taxon_id").collect()
    assert [(r.taxon_id, r.taxon, r.seq) for r in rows] == [(1, "a", "ACGTACGT"), (2, "b", "AC-TACGT"), (3, "c", "NNGTACGA")]


def test_fasta(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text(">a one\nACGT\nAC\n>b\nTT\n TTAA\n")
    assert formats.guess_format(spark, str(p)) == "fasta"
    rows = formats.read_alignment(spark, str(p)).orderBy("taxon_id").collect()
    assert [(r.taxon, r.seq) for r in rows] == [("a one", "ACGTAC"), ("b", "TTTTAA")]


def test_schemes(spark):
    s = formats.parse_scheme("DNA, p1 = 1-9/3, 12\nBIN, gene = 1 -10\nLGF,q=3\nASC_DNA, r = 4-5\n\n")
    assert [(x["name"], x["lo"], x["hi"], x["stride"]) for x in s] == [("p1", 1, 9, 3), ("p1", 12, 12, 1), ("gene", 1, 10, 1), ("q", 3, 3, 1), ("r", 4, 5, 1)]
    assert s[3]["model"] == "LG" and s[3]["empirical"] and s[4]["ascertained"]
    for bad in ("XXX, a = 1-2", "DNA a 1-2", "DNA, a = 5-2", "DNA, a = x"):
        with pytest.raises(ValueError):
            formats.parse_scheme(bad)
    sites = formats.scheme_sites(formats.scheme(spark, "DNA, a = 1-5\nDNA, b = 5-9"))
    from cladespark.operators.alignment import scheme_faults

    assert {(r.site, r.n) for r in scheme_faults(sites, 10).collect()} == {(5, 2), (10, 0)}
    assert formats.single_scheme(spark, "DNA", 4).first().hi == 4


def test_encoding(spark):
    seqs = spark.createDataFrame([(1, "a", "ANU0"), (2, "b", "-c?1")], "taxon_id int, taxon string, seq string")
    sites = formats.scheme_sites(formats.scheme(spark, "DNA, d = 1-3\nBIN, b = 4"))
    got = {(r.taxon_id, r.site): r.state for r in formats.encoded(formats.long_form(seqs), sites).collect()}
    assert [got[1, i] for i in range(1, 5)] == [1, 15, 8, 1] and [got[2, i] for i in range(1, 5)] == [15, 2, 15, 2]


def test_tree_files(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.tre").write_text(TREES if name == "a" else TREES.replace("beta", "other"))
    lines = formats.tree_lines(spark, str(tmp_path / "*.tre"))
    taxa = formats.read_taxa(lines)
    a = taxa.filter(F.col("file").endswith("a.tre"))
    assert {r.taxon_id: r["name"] for r in a.collect()} == {1: "alpha", 2: "beta", 3: "gamma", 4: "delta"}
    assert [r.taxon_id for r in formats.taxa_conflicts(taxa).collect()] == [2]
    assert {r.n for r in formats.count_trees(lines).collect()} == {2}
    trees = formats.read_trees(lines).filter(F.col("file").endswith("a.tre"))
    rows = trees.orderBy("ordinal").collect()
    assert [(r.ordinal, r.gen, r.partitions) for r in rows] == [(0, 0, "0"), (1, 500, "0")]
    named = trees.filter("gen = 0").select(formats.with_names(F.col("newick"), {1: "alpha", 2: "beta", 3: "gamma", 4: "delta"}).alias("x")).first().x
    assert named == "(beta:0.1,(gamma:0.1,delta:0.1):0.2,alpha:0.3):0.0;"
    keyed = trees.select(F.lit(0).alias("file_id"), F.col("gen").alias("tree_id"), "newick")
    assert {tuple(r.split) for r in splits_table(keyed).collect()} == {(3, 4), (2, 4)}
    out = [r.value for r in sinks.tree_text(trees, {1: "alpha", 2: "beta", 3: "gamma", 4: "delta"}, "7").collect()]
    assert "\n".join(out) + "\n" == TREES


def test_traces(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("[ID: 7]\nGen\tLnL\taaModel{1}\n0\t-5.5\tLG\n500\t-4.25\tWAG\n")
    t = formats.read_trace(spark, str(p), 3).orderBy("gen", "param").collect()
    assert [(r.run_id, r.ordinal, r.gen, r.param, r.value, r.label) for r in t] == [(3, 1, 0, "LnL", -5.5, None), (3, 1, 0, "aaModel{1}", None, "LG"), (3, 2, 500, "LnL", -4.25, None), (3, 2, 500, "aaModel{1}", None, "WAG")]
    long = formats.read_trace(spark, str(p), 3)
    out = tmp_path / "out"
    sinks.write_trace_file(long, ["LnL", "aaModel{1}"], "7", str(out))
    again = formats.read_trace(spark, str(out), 3).orderBy("gen", "param").collect()
    assert again == t
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_trace_file(long, ["LnL"], "7", str(out))
    assert formats.keep_until(long, 500).count() == 4 and formats.keep_until(long, 500, True, "trace").count() == 2
    assert formats.columns_like(formats.read_trace_wide(spark, str(p)), "lnl").columns == ["LnL"]


def test_listing_and_diagnostics(spark):
    s = spark.createDataFrame([(0, [2, 3]), (1, [2, 3, 4, 5])], "id int, split array<int>")
    got = {r.id: r.taxa for r in sinks.split_listing(s, {i: f"t{i}" for i in range(1, 7)}, 6).collect()}
    assert got == {0: "t2,t3", 1: "t1,t6"}
    d = spark.createDataFrame([(100, "x", 0.25, 8), (100, "y", 0.5, 4)], "gen long, name string, ratio double, seen long")
    assert sinks.diagnostics_wide(d, ["x", "y"]).first().x == "0.25,8"
