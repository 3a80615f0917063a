"""Segments of review texts: runs that are copied as they are make one segment."""

import random
import re

from marginalia.operators import intervals
from marginalia.plans import relations


def plain(text):
    """(review_start, review_end, source_start, source_end, identity), character by character."""
    out, at = [], 0
    for run in re.findall(r"\s+|\S+", text):
        kept = not run.isspace() or run == " "
        if out and kept and out[-1][2]:
            out[-1][1] += len(run)
        else:
            out.append([at, at + len(run), kept])
        at += len(run)
    size = lambda n: len(text[:n].encode())
    return [(a, b, size(a), size(b), kept) for a, b, kept in out]


def test_copied_runs_are_one_segment(spark, tmp_path):
    rng = random.Random(3)
    texts = ["", " ", "\n", "a b", " a", "a  ", "é b c", None] + ["".join(rng.choices("ab é \n ", k=rng.randrange(1, 40))) for _ in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = relations.mapped_segments(spark, str(tmp_path)).orderBy("path", "ix").collect()
    for path, text in enumerate(texts):
        assert [tuple(r[2:]) for r in rows if r["path"] == path] == plain(text or ""), text
    got = relations.offset_map(spark, str(tmp_path)).collect()
    known = lambda t, p: not any(a < p < b for a, b, _, _, kept in plain(t) if not kept)
    wanted = {(k, p): len(t[:p].encode()) if known(t, p) else None for k, t in enumerate(texts) if t is not None for p in range(0, len(t) + 1, 37)}
    assert {(r["path"], r["point"]): r["source"] for r in got} == wanted
    assert intervals.contiguity_violations(relations.mapped_segments(spark, str(tmp_path)).selectExpr("path", "ix", "source_start AS start", "source_end AS end", "source_end AS total")).filter("start != expected").isEmpty()
