import json
import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import canonical as C


@pytest.mark.parametrize(
    "x, text",
    [
        (0.0, "0"), (-0.0, "0"), (1.0, "1"), (-1.5, "-1.5"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-6, "0.000001"), (1e-7, "1e-7"), (5e-324, "5e-324"),
        (1.7976931348623157e308, "1.7976931348623157e+308"), (333333333.33333329, "333333333.3333333"), (4.50, "4.5"), (2e-3, "0.002"), (9007199254740994.0, "9007199254740994"),
    ],
)
def test_numbers(x, text):
    """Published examples of the canonical form."""
    assert C.number(x) == text


def test_numbers_come_back():
    rng = random.Random(1)
    for _ in range(2000):
        x = rng.uniform(-1, 1) * 10 ** rng.randrange(-30, 30)
        assert float(C.number(x)) == x


def test_objects(spark):
    raw = '{"\\u20ac":"Euro","\\r":"CR","\\ud83d\\ude02":"x","1":"One","\\u0080":"c","\\u00f6":"o","\\ufb33":"h","</script>":"b"}'
    want = '{"\\r":"CR","1":"One","</script>":"b","\u0080":"c","\u00f6":"o","\u20ac":"Euro","\U0001f602":"x","\ufb33":"h"}'
    assert C.canonical(C.parsed(raw)) == want  # keys in the order of their UTF-16 units
    rows = [(raw,), ('{"a":1,"a":2}',), ('{"a":NaN}',), ("no json",), (None,), ('[1.0,{"b":[],"a":null}]',), ("9007199254740993",), ('"\\ud800"',)]
    got = [r["c"] for r in spark.createDataFrame(rows, "t string").select(C.canonical_json(F.col("t")).alias("c")).collect()]
    assert got == [want, None, None, None, None, '[1,{"a":null,"b":[]}]', None, None]


def test_sealed_objects(spark):
    payload = {"b": 1, "a": [1.5, "x"]}
    sealed = {"run": "r", "payload": payload, "integrity": {"payload_sha256": C._sha(C.canonical(payload))}}
    sealed["integrity"]["document_sha256"] = C._sha(C.canonical(sealed))
    other = json.loads(json.dumps(sealed)) | {"run": "q"}
    changed = json.loads(json.dumps(sealed)) | {"payload": {"b": 2, "a": [1.5, "x"]}}
    rows = [(json.dumps(x, indent=1),) for x in (sealed, other, changed, {"payload": 1})]
    got = [r["f"] for r in spark.createDataFrame(rows, "t string").select(C.envelope_fault(F.col("t")).alias("f")).collect()]
    assert got == [None, "document_sha256", "payload_sha256", "unreadable"]
    hashes = {C._sha(C.canonical(json.loads(t) | {"run": None})) for t in (rows[0][0], rows[1][0])}
    assert len(hashes) == 1  # what the field holds doesn't matter to the commitment over it


def test_run_ids(spark):
    got = spark.range(1).select(C.run_id(F.lit(0x0123456789AB), F.lit(0xABC), F.lit((3 << 60) | 0x0123456789ABCDE)).alias("r")).first()["r"]
    assert got == "run_01234567-89ab-7abc-b012-3456789abcde"
