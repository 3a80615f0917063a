"""Nothing is lost for being deep."""

import json

from marginalia.operators import evidence, reconcile
from marginalia.sources import latex


def test_objects_at_any_depth(spark):
    depths = (0, 5, 7, 8, 9, 12, 50)

    def nested(d, k):
        value = {"sha256": f"h{k}", "size": d}
        for i in range(d):
            value = {"in": value} if i % 2 else [value]
        return value

    rows = [(k, json.dumps({"top": nested(d, k)})) for k, d in enumerate(depths)]
    found = evidence.nested_objects(spark.createDataFrame(rows, "k long, j string"), "k", "j", ["sha256", "size"]).collect()
    assert sorted((r["k"], int(r["size"])) for r in found) == list(enumerate(depths))


def test_commands_at_any_depth():
    text = "\\added{" * 300 + "x" + "}" * 300
    found = list(latex.commands(text))
    assert sorted(d for *_, d in found) == list(range(300)) and sorted(o for o, *_ in found) == [7 * k for k in range(300)]


def test_long_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "source long, target long")
    reached = reconcile.closure(edges, spark.createDataFrame([(0,)], "node long"))
    assert sorted((r["node"], r["depth"]) for r in reached.collect()) == [(k, k) for k in range(41)]
