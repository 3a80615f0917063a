import pytest

from marginalia.operators import evidence as V
from marginalia.sinks import publish
from marginalia.sources import latex as L


def test_groups_and_commands():
    assert L.group_end("{a{b}\\}c}x", 0) == 9 and L.group_end("{a", 0) is None and L.group_end("[a{]}]", 0) == 4
    text = r"\added[id=a]{x \deleted{y}} % \added{no}" + "\n" + r"\% \replaced{a}{b{c}}\cite*{k}"
    assert [c[1:] for c in L.commands(text)] == [
        ("deleted", [], ["y"], 1), ("added", ["id=a"], [r"x \deleted{y}"], 0), ("%", [], [], 0), ("replaced", [], ["a", "b{c}"], 0), ("cite*", [], ["k"], 0)
    ]
    assert all(text[c[0]] == "\\" for c in L.commands(text))


def test_macros_features_and_graphics(spark):
    text = r"\graphicspath{{a/}}\includegraphics{x}\added{one \deleted{two}}\add \begin{table}\cite{k}\cite*{l}" + "\n% \\added{no}\n" + r"\graphicspath{{b/}}\includegraphics[w]{y}"
    rows = L.command_rows(spark.createDataFrame([(1, text), (2, None)], "path long, text string")).cache()
    assert {(r["macro"], r["n"], r["nested"], r["degraded"]) for r in L.revision_macros(rows).collect()} == {("added", 1, 0, 0), ("deleted", 1, 1, 0), ("add", 1, 0, 1)}
    assert {r["feature"]: r["n"] for r in L.features(rows).collect()} == {"image": 2, "table": 1, "citation": 2}
    assert [(r["file"], r["options"], r["directories"]) for r in L.graphics(rows).orderBy("offset").collect()] == [("x", None, "{a/}"), ("y", "w", "{b/}")]


def test_paragraphs(spark):
    text = "  One line\nand more é  \n\n\\section{x}\nTwo\n\\end\nThree % c\nstill three\n\nFour $x$\nfour\n\r\nFive"
    got = L.paragraphs(spark.createDataFrame([(1, text), (2, ""), (3, "%")], "path long, text string")).collect()
    raw = text.encode()
    assert sorted(raw[r["start"] : r["end"]].decode() for r in got) == ["Five", "One line\nand more é"]
    long = L.paragraphs(spark.createDataFrame([(1, "word " * 40_000 + "% c")], "path long, text string"))
    assert long.count() == 0  # a long line has no frame for each of its characters


def test_publication(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    at = str(tmp_path / "x")
    assert [publish.write_new(rows, at), publish.write_new(rows.limit(1), at)] == ["written", "refused"]
    assert spark.read.parquet(at).count() == 2
    assert [publish.apply_once(r, at, ["k"]) for r in (rows.repartition(2), rows.limit(1), rows.replace("b", "c", "v"))] == ["reused", "conflict", "conflict"]
    files = spark.createDataFrame([("p", b"x"), ("q", b"x"), ("r", b"y")], "path string, content binary")
    store = str(tmp_path / "store")
    assert [publish.archive(files, store), publish.archive(files, store)] == ["written", "reused"]
    manifest = files.selectExpr("sha2(content, 256) AS sha256").filter("sha256 <> sha2('y', 256)")
    assert sorted(r["status"] for r in publish.verified_archive(spark, store, manifest).collect()) == ["same", "unexpected"]


def test_diffs(spark):
    pairs = spark.createDataFrame([("a/b.tex", "x\ny\n", "x\nz\n"), ("c", "same", "same"), ("d", None, "new")], "path string, before string, after string")
    diffs = {r["path"]: r["diff"] for r in publish.unified_diffs(pairs).collect()}
    assert diffs["a/b.tex"] == "--- a/a/b.tex\n+++ b/a/b.tex\n@@ -1,2 +1,2 @@\n x\n-y\n+z\n" and set(diffs) == {"a/b.tex", "d"}
    whole = spark.createDataFrame([(diffs["a/b.tex"] + diffs["d"],)], "t string").select(publish.diff_sections(__import__("pyspark").sql.functions.col("t")).alias("s"))
    assert [(s["path"], s["section"]) for s in whole.first()["s"]] == [("a/b.tex", diffs["a/b.tex"]), ("d", diffs["d"])]


def test_includes(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (1, 3)], "source long, target long")
    sizes = spark.createDataFrame([(1, 10), (2, 5), (3, 1), (4, 7)], "node long, size long")
    assert {r["node"]: r["total"] for r in V.expanded_sizes(edges, sizes).collect()} == {1: 23, 2: 6, 3: 1, 4: 7}
    with pytest.raises(ValueError, match="cycle"):
        V.expanded_sizes(edges.union(spark.createDataFrame([(3, 1)], edges.schema)), sizes)
    with pytest.raises(ValueError, match="more than 3"):
        V.require_within(sizes, 3)
    assert V.require_within(sizes, 4) is sizes
