"""The sub-commands end to end on a small graph."""

from arcweave import cli


def test_import_backbone_linkpred_batch(spark, tmp_path):
    (tmp_path / "ns").write_text("http://e/ e\n")
    (tmp_path / "g.nt").write_text("".join(f"<http://e/{a}> <http://e/p> <http://e/{b}> .\n" for a, b in ("ab", "bc", "cd", "ac", "ab")))
    out = str(tmp_path / "out")
    cli.main(["import", str(tmp_path / "ns"), str(tmp_path / "g.nt"), out])
    assert spark.read.csv(f"{out}/nodes", sep=" ").count() == 4
    assert {r.predicates for r in spark.read.parquet(f"{out}/edges").collect()} == {"e:p", "e:p,e:p"}
    cli.main(["backbone", f"{out}/adjacency", f"{out}/backbone", "4", "-u"])
    assert spark.read.parquet(f"{out}/backbone").count() > 0
    (tmp_path / "s").write_text("f0 0 a f3 3 d 1,2\nf0 0 a f1 1 b 3\n")
    (tmp_path / "uris").write_text("0 e:a\n1 e:b\n2 e:c\n3 e:d\n")
    cli.main(["linkpred", f"{out}/adjacency", str(tmp_path / "s"), f"{out}/links", "-u", "--uris", str(tmp_path / "uris")])
    found = {r.tid: (r.rem, r.paths) for r in spark.read.json(f"{out}/links").collect()}
    assert found == {3: (False, ["e:a", "e:c", "e:d"]), 1: (True, ["e:a", "e:c", "e:b"])}
    (tmp_path / "q").write_text("node_id\n0\n3\n")
    cli.main(["batch", f"{out}/adjacency", str(tmp_path / "q"), str(tmp_path / "q"), f"{out}/batch", "-u"])
    assert spark.read.csv(f"{out}/batch", header=True).columns == ["src", "0", "3"]
    (tmp_path / "two").write_text("0 a\n3 d\n")
    cli.main(["confmatrix", f"{out}/adjacency", str(tmp_path / "two"), str(tmp_path / "two"), f"{out}/conf", "-u"])
    assert spark.read.csv(f"{out}/conf", header=True).count() == 2


def test_batch_reports_every_unknown_row(spark, tmp_path, capsys):
    spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "row long, col long, weight double").write.parquet(str(tmp_path / "g"))
    (tmp_path / "uris").write_text("0 e:a\n1 e:b\n")
    missing = [f"e:x{i}" for i in range(25)]
    (tmp_path / "s").write_text("node_title\ne:a\n" + "".join(f"{m}\n" for m in missing))
    (tmp_path / "t").write_text("node_title\ne:b\n")
    out = str(tmp_path / "out")
    cli.main(["batch", str(tmp_path / "g"), str(tmp_path / "s"), str(tmp_path / "t"), out, "--uris", str(tmp_path / "uris")])
    assert sorted(r.uri for r in spark.read.parquet(f"{out}-unknown-sources").collect()) == sorted(missing)
    assert "unknown sources: 25 rows" in capsys.readouterr().out and not (tmp_path / "out-unknown-targets").exists()
    assert spark.read.csv(out, header=True).columns == ["src", "1"]
