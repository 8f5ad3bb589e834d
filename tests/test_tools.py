import numpy as np
import pytest
from pyspark.sql import functions as F

from cladespark import cli
from cladespark.functions.density import generator
from cladespark.functions.register import register
from cladespark.operators.trees import random_tree
from cladespark.sources import compressed, formats


def tree_file(path, seed, n=6, trees=20):
    rng = generator(seed)
    head = "#NEXUS\nbegin trees;\n\ttranslate\n" + ",\n".join(f"\t{k}\tt{k}" for k in range(1, n + 1)) + ";\n"
    few = [random_tree(n, generator(0, k)) for k in range(4)]
    path.write_text(head + "".join(f"\ttree gen.{g}.{{0}} = [&U] {few[int(rng.integers(4))].newick()}\n" for g in range(trees)) + "end;\n")
    return str(path)


def test_tools(spark, tmp_path, capsys):
    a, b = tree_file(tmp_path / "a.tre", 1), tree_file(tmp_path / "b.tre", 2)
    cli.main(["sdsf", "-f", a, a], spark)
    assert capsys.readouterr().out.split("\n")[1].split("\t") == ["0.0", "0.0"]
    cli.main(["sdsf", "-f", a, b, "-b", "4", "--compat"], spark)
    assert 0 < float(capsys.readouterr().out.split("\n")[1].split("\t")[0]) < 1
    for kind in ("MR", "MRE", "75"):
        cli.main(["consense", "-f", a, b, "-t", kind], spark)
        assert capsys.readouterr().out.strip().endswith(";")
    cli.main(["credibleset", "-f", a, b, "-c", "90"], spark)
    lines = capsys.readouterr().out.strip().split("\n")
    assert lines[0].split("\t") == ["topology", "n", "freq"] and 2 <= len(lines) <= 5
    out = str(tmp_path / "bips")
    cli.main(["extractbips", "-f", a, b, "-n", out], spark)
    stat = spark.read.option("sep", "\t").option("header", True).csv(out + ".statistics")
    assert stat.count() == spark.read.option("header", True).csv(out + ".splits").count() and "psrf" in stat.columns
    with pytest.raises(Exception, match="(?i)exist"):
        cli.main(["extractbips", "-f", a, b, "-n", out], spark)
    for bad in (["sdsf", "-f", a, "-r", "1.0"], ["credibleset", "-f", a, "-c", "0"], ["parse", "-s", a]):
        with pytest.raises(SystemExit):
            cli.main(bad, spark)
    (tmp_path / "c.tre").write_text((tmp_path / "a.tre").read_text().replace("t3", "other"))
    with pytest.raises(ValueError):
        cli.main(["sdsf", "-f", a, str(tmp_path / "c.tre")], spark)


def test_parameters(spark, tmp_path, capsys):
    rng = np.random.default_rng(1)
    for k in range(2):
        rows = "\n".join(f"{g}\t{rng.normal():.5f}\t{rng.choice(['LG', 'WAG'])}" for g in range(40))
        (tmp_path / f"p{k}").write_text(f"[ID: 1]\nGen\tLnL\taaModel{{0}}\n{rows}\n")
    cli.main(["postprocparam", "-f", str(tmp_path / "p0"), str(tmp_path / "p1")], spark)
    out = capsys.readouterr().out.split("\n")
    assert out[1].startswith("LnL\t") and out[3].startswith("aaModel{0}\t") and ":0." in out[3]


def test_compressed(spark, tmp_path, capsys):
    p = tmp_path / "a.phy"
    p.write_text("3 6\na ACGTAC\nb ACGTAC\nc TCGTTC\n")
    (tmp_path / "s").write_text("DNA, one = 1-6/2\nDNA, two = 2-6/2\n")
    out = str(tmp_path / "out")
    cli.main(["parse", "-s", str(p), "-q", str(tmp_path / "s"), "-n", out], spark)
    pats, dims = compressed.read(spark, out)
    assert pats.agg(F.sum("weight")).first()[0] == 6 and {r["name"]: r.contribution for r in dims.collect()} == {"one": 0.5, "two": 0.5}
    assert compressed.read(spark, out, "one")[0].count() == 2
    seqs = formats.read_alignment(spark, str(p))
    with pytest.raises(ValueError, match="partitions"):
        compressed.compress(seqs, formats.scheme(spark, "DNA, a = 1-4"))
    with pytest.raises(ValueError, match="unknown"):
        compressed.compress(seqs, formats.scheme(spark, "BIN, a = 1-6"))
    cli.main(["parse", "-s", str(p), "-m", "DNA"], spark)
    assert "unnamedPartition" in capsys.readouterr().out


def test_sql_functions(spark):
    register(spark)
    df = spark.createDataFrame([(1, "((3:1,4:1):2,2:1,1:1);")], "id int, newick string")
    df.createOrReplaceTempView("texts")
    assert spark.sql("select split, length from texts, lateral newick_splits(newick, false)").collect()[0].split == [3, 4]
    assert spark.sql("select * from texts, lateral newick_edges(newick)").count() == 5
    spark.createDataFrame([(i, float(i % 7)) for i in range(1, 101)], "i long, x double").createOrReplaceTempView("xs")
    r = spark.sql("select ref_percentile(cast(i as double), 0.5D) p, ref_skewness(x) s, ess(i, x) e from xs").first()
    assert r.p == 51 and abs(r.s) < 0.2 and r.e > 0


def test_checkpoints(spark, tmp_path):
    from cladespark.functions import density
    from cladespark.sampler import chains, config

    c = config.parse("begin run; numRuns 1; numCoupledChains 2; samplingFreq 10; end; begin proposals; parsimonySPR 0; likeSPR 0; blDistGamma 0; end;")
    data = chains.Data(None, None, 4, {"brlens": density.Exponential(10.0)})
    make = lambda: chains.Sampler(spark, data, c, 5, seed=4, available=frozenset({"topology", "brlens"}))
    whole = make()
    want = {(r.gen, r.body) for r in whole.run(60, batch=30).collect()}
    first = make()
    got = {(r.gen, r.body) for r in first.run(30, batch=30).collect()}
    first.save(str(tmp_path / "state"))
    again = make()
    got |= {(r.gen, r.body) for r in again.run(60, batch=30, resume=again.load(str(tmp_path / "state"))).collect()}
    assert got == want
