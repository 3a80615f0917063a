import zipfile

import pytest
from pyspark.sql import functions as F

from marginalia.operators import validate
from marginalia.sources import files, packages
from marginalia.streaming import decisions

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCUMENT = f"""<w:document {W}><w:body><w:p><w:bookmarkStart w:id="0" w:name="u"/><w:r><w:t>Old </w:t></w:r>
<w:del w:id="1" w:author="A" w:date="2024-01-02T03:04:05Z"><w:r><w:delText>bad</w:delText></w:r></w:del>
<w:ins w:id="2" w:author="A" w:date="2024-01-02T03:04:05Z"><w:r><w:t>good</w:t><w:tab/></w:r></w:ins><w:r><w:t>end</w:t></w:r></w:p><w:tbl/></w:body></w:document>"""
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Type="x/image" Target="i.png"/><Relationship Id="b" Type="x/link" TargetMode="External" Target="http://a"/></Relationships>'


@pytest.fixture
def docx(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", DOCUMENT)
        z.writestr("word/_rels/document.xml.rels", RELS)
        z.writestr("word/footnotes.xml", f'<w:footnotes {W}><w:ins w:id="9" w:author="B"><w:r><w:t>note</w:t></w:r></w:ins></w:footnotes>')
        z.writestr("../evil", "x")
        z.writestr("word/header1.xml", "<!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>")
        z.writestr("word/header2.xml", "<a><b></a>")
    (tmp_path / "b.docx").write_bytes(b"no package")
    return str(tmp_path)


def test_packages(spark, docx):
    found = packages.packages(spark, docx)
    problems = {(r["path"].rpartition("/")[2], r["member"]): r["problem"] for r in packages.members(found).collect()}
    assert problems[("b.docx", None)] == "not_a_package" and problems[("a.docx", "../evil")] == "unsafe_name" and problems[("a.docx", "word/document.xml")] is None
    assert {r["problem"] for r in packages.members(packages.packages(spark, docx, most_bytes=20)).filter("path LIKE '%a.docx'").collect()} == {"too_large"}
    nodes = packages.nodes(found).cache()
    assert {r["part"]: r["text"] for r in nodes.filter("tag = '#problem'").collect()} == {"word/header1.xml": "declaration", "word/header2.xml": "not_well_formed"}
    assert packages.nodes(found, most_nodes=3).filter("tag = '#problem' AND text = 'too_many_nodes'").count() > 0
    view = {r["part"]: (r["original"], r["final"]) for r in packages.views(nodes).collect()}
    assert view["word/document.xml"] == ("Old badend", "Old good\tend")
    assert view["word/footnotes.xml"] == ("", "note")
    got = [(r["sequence"], r["kind"], r["author"], r["text"]) for r in packages.revision_events(nodes).orderBy("sequence").collect()]
    assert got == [(0, "delete", "A", "bad"), (1, "insert", "A", "good\t"), (2, "insert", "B", "note")]
    assert packages.relationships(nodes).first()[1:] == (2, 1, 1)
    assert packages.structure(nodes).first()[1:] == (1, 1, 0, 0, 1)


def test_file_scans(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "main.tex").write_text("\\input{sub/a} % \\input{no}\n\\usepackage{x, y}\\label{l}\\ref{l} \\added{new}\\replaced[id=q]{a}{b}\n")
    (tmp_path / "sub/a.tex").write_text("\\cite{k}\n100\\% \\cite{m}")
    found = files.inventory(spark, str(tmp_path))
    seen = spark.createDataFrame(found.collect(), found.schema)  # a cached frame would answer for the second scan as well
    assert seen.count() == 2
    texts = files.sources(spark, str(tmp_path))
    assert sorted(r["name"] for r in files.references(texts).collect()) == ["sub/a", "x", "y"]
    assert {r["feature"]: r["n"] for r in files.feature_counts(texts).collect()} == {"citation": 2, "display_math": 0, "image": 0, "label": 1, "reference": 1, "table": 0}
    assert {r["macro"]: r["n"] for r in files.macro_counts(texts).collect()} == {"added": 1, "replaced": 1}
    assert sorted(r["files"] for r in files.directory_totals(seen).collect()) == [1, 1]
    (tmp_path / "sub/a.tex").write_text("changed")
    after = files.inventory(spark, str(tmp_path))
    assert [r["status"] for r in files.drift(seen, after).collect()] == ["changed"]
    assert files.tree_hash(seen).first()[0] != files.tree_hash(after).first()[0]
    (tmp_path / "bad.tex").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="not UTF-8"):
        files.sources(spark, str(tmp_path)).collect()


def test_validators(spark):
    def rules(df):
        return sorted((r["key"], r["rule"]) for r in df.collect())

    runs = spark.createDataFrame([("a", 1, None), ("b", 1, "x"), ("c", 2, None)], "run_id string, revision int, previous string")
    assert rules(validate.run_manifest(runs)) == [("b", "first_has_no_previous"), ("c", "first_has_no_previous")]
    tree = spark.createDataFrame([("a", 0), ("c", 1), ("b", 2), ("a", 3)], "path string, ix int")
    assert rules(validate.source_manifest(tree, "m")) == [("a", "sorted"), ("a", "unique_path"), ("b", "sorted"), ("m", "main_present")]
    ops = spark.createDataFrame([("p", 1, 0, 5), ("p", 2, 4, 6), ("p", 3, 9, 8)], "path string, id long, start long, end long")
    assert rules(validate.patch_plan(ops)) == [("1", "no_overlap"), ("2", "no_overlap"), ("3", "range")]
    events = spark.createDataFrame([(1, "p", "delete", "n", ""), (2, "p", "insert", "n", "x")], "event_id long, part string, kind string, native_id string, text string")
    assert rules(validate.raw_events(events)) == [("1", "deletion_has_text")]
    changes = spark.createDataFrame([(1, [1], "safe", "exact"), (2, [7], "safe", "other"), (3, [], "manual", "exact")], "change_id long, raw_event_ids array<long>, safety string, resolution string")
    assert rules(validate.change_set(changes, events)) == [("2", "known_events"), ("2", "safe_is_exact"), ("3", "has_events")]
    with pytest.raises(ValueError, match="no_overlap"):
        validate.require_none(validate.patch_plan(ops))
    validate.require_none(validate.run_manifest(runs.limit(1)))


def test_streamed_decisions(spark, tmp_path):
    rows = [(k, f"2024-01-0{1 + k // 4} 00:0{k % 4}:00", k % 3, "accept" if k % 2 else "reject") for k in range(12)] + [(11, "2024-01-03 00:03:00", 2, "accept")]
    df = spark.createDataFrame(rows, "event_id long, ts string, change_id long, decision string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    job = decisions.entries(stream).writeStream.foreachBatch(decisions.append_batch(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    job.awaitTermination()
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == 12
    got = {r["change_id"]: r["decision"] for r in decisions.current(written).collect()}
    assert got == {0: "accept", 1: "reject", 2: "accept"}
    counted = decisions.decisions_per_window(stream).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    counted.awaitTermination()
    assert spark.table("windows").count() == 2  # an hour may still be missing from the second day
