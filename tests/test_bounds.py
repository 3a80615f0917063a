"""What is held or moved at once doesn't grow with the input."""

import pyarrow as pa

from marginalia.functions import batches
from marginalia.plans import markup, ranges
from marginalia.sources import latex, packages
from marginalia.sources import ranges as R

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_put_as_they_are_taken():
    taken = []
    rows = ((taken.append(k) or k,) for k in range(10))
    out = batches.put(rows, {"k": pa.int64()}, 4)
    assert next(out).num_rows == 4 and len(taken) == 4
    assert [b.num_rows for b in out] == [4, 2] and list(batches.put([], {"k": pa.int64()})) == []


def test_texts_go_to_python_in_bounded_batches(spark):
    latex.command_rows(spark.createDataFrame([(1, r"\a")], "path long, text string"))
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= batches.MOST_TEXTS


def test_packages_are_read_in_one_pass(spark):
    once = markup.stand_in(spark, SF)
    for made in (packages.views, packages.evidence_classes, packages.revisions):
        assert plan(made(packages.nodes(once), together=True)).count("Exchange") == 1  # of the texts, before they are packages
    assert plan(packages.run_properties(packages.nodes(once))).count("Join") == 0


def test_sweep_moves_no_nodes_that_stand_together(spark):
    nodes = ranges.stand_in(spark, SF)
    assert "Exchange" not in plan(R.sweep(nodes, together=True)) or plan(R.sweep(nodes, together=True)).count("Exchange") == plan(nodes).count("Exchange")
    assert "Scan ExistingRDD" not in plan(ranges.range_events(spark, SF))  # nothing is written between


def test_a_revision_is_plain_if_its_runs_hold_text_alone(spark):
    body = (
        '<w:p><w:ins w:id="1"><w:r><w:t>a</w:t></w:r><w:r w:rsidR="1"><w:t>b</w:t></w:r></w:ins><w:ins w:id="2"><w:r/></w:ins><w:ins w:id="3"/><w:del w:id="4"><w:r><w:t>c</w:t></w:r></w:del>'
        '<w:ins w:id="5"><w:r><w:t>d</w:t></w:r><w:del w:id="6"><w:r><w:delText>e</w:delText></w:r></w:del></w:ins><w:del w:id="7"><w:r><w:delText>f</w:delText></w:r></w:del></w:p>'
    )
    import io
    import zipfile

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{markup.W}"><w:body>{body}</w:body></w:document>')
    nodes = packages.nodes(spark.createDataFrame([("p", raw.getvalue())], "path string, content binary"))
    for together in (True, False):
        r = {x["native_id"]: (x["runs"], x["texts"], x["body"]) for x in packages.revisions(nodes, together).collect()}
        assert r == {
            "1": (True, True, "ab"), "2": (True, False, ""), "3": (False, False, ""), "4": (True, False, "c"), "5": (False, False, "d"), "6": (True, True, "e"), "7": (True, True, "f"),
        }
        got = [x["class"] for x in packages.evidence_classes(nodes, together).orderBy("ordinal").collect()]
        assert got == ["plain_text", "structured", "structured", "structured", "structured", "structured", "plain_text"]


def test_the_best_resolution_is_the_last_that_fits(spark):
    import math

    from marginalia.functions.policies import best_dpi

    sizes = [(w, h) for w in (1, 50, 255, 700, 960, 2000, 5000) for h in (1, 33, 400, 1500, 4000)] + [(None, 5)]
    got = spark.createDataFrame(sizes, "w int, h int")
    for wanted, least in ((300, 72), (72, 72), (50, 72)):
        fits = lambda w, h, d: max(a := math.ceil(w * d / 72), b := math.ceil(h * d / 72)) <= 4000 and a * b <= 6_000_000
        want = [None if w is None else max((d for d in range(min(wanted, least), wanted + 1) if fits(w, h, d)), default=None) for w, h in sizes]
        column = best_dpi(got["w"], got["h"], wanted, least, 4000, 6_000_000)
        assert [r[0] for r in got.select(column).collect()] == want
        assert "sequence(" not in plan(got.select(column))  # not every resolution is tried


def test_rounds_broadcast_nothing(spark):
    from marginalia.operators import evidence, reconcile

    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "source long, target long")
    assert {tuple(r) for r in reconcile.closure(edges, spark.createDataFrame([(1,)], "node long")).collect()} == {(1, 0), (2, 1), (3, 1)}
    plans = []
    for module in (reconcile, evidence):
        kept = module.checkpointed
        module.checkpointed = lambda df: plans.append(plan(df)) or kept(df)  # noqa: B023
        try:
            if module is reconcile:
                module.closure(edges, spark.createDataFrame([(1,)], "node long"))
            else:
                sizes = spark.createDataFrame([(1, 1), (2, 10), (3, 100)], "node long, size long")
                assert {tuple(r) for r in module.expanded_sizes(edges, sizes).collect()} == {(1, 211), (2, 110), (3, 100)}
        finally:
            module.checkpointed = kept
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)
