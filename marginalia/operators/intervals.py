"""Half-open intervals: overlap, cover, segments and splices.

Whether a range overlaps any other is one sweep in the order of starts. Where the pairs themselves are asked for, each interval goes to
every bin of ``bin_width`` it touches and meets others there, so that a path with very many intervals is spread over its bins. A
pair counts in the first bin that both share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let


def overlaps(a: Column, b: Column, zero_width: bool) -> Column:
    """a and b have start and end. With zero_width, an empty range clashes with one that holds or equals its place."""
    strict = F.greatest(a["start"], b["start"]) < F.least(a["end"], b["end"])
    if not zero_width:
        return strict
    empty_a, empty_b = a["start"] == a["end"], b["start"] == b["end"]
    return (
        F.when(empty_a & empty_b, a["start"] == b["start"])
        .when(empty_a, (b["start"] <= a["start"]) & (a["start"] < b["end"]))
        .when(empty_b, (a["start"] <= b["start"]) & (b["start"] < a["end"]))
        .otherwise(strict)
    )


def _binned(ranges: DataFrame, width: int) -> DataFrame:
    last = F.greatest(F.col("start"), F.col("end") - 1)
    return ranges.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(last / width))))


def overlap_pairs(ranges: DataFrame, zero_width: bool = True, bin_width: int = 1024) -> DataFrame:
    """(path, a, b), a < b, of all overlapping pairs. ranges: (path, id, start, end)."""
    rows = _binned(ranges.select("path", "id", "start", "end"), bin_width)
    x, y = rows.alias("x"), rows.alias("y")
    a, b = (F.struct(F.col(f"{t}.start").alias("start"), F.col(f"{t}.end").alias("end")) for t in "xy")
    first = F.col("x.bin") == F.floor(F.greatest(F.col("x.start"), F.col("y.start")) / bin_width)
    same = (F.col("x.path") == F.col("y.path")) & (F.col("x.bin") == F.col("y.bin")) & (F.col("x.id") < F.col("y.id"))
    return x.join(y, same & first & overlaps(a, b, zero_width)).select("x.path", F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def flagged(ranges: DataFrame, zero_width: bool = True, bin_width: int = 1 << 16) -> DataFrame:
    """ranges (path, id, start, end, ...) with clash: whether another range of the path overlaps it. A sweep instead of a pair join.

    In the order of starts, filled ranges before empty ones, a range overlaps an earlier one if the greatest end so far lies beyond its
    start, and a later one if the next start lies before its end. A path is swept in bins of ``bin_width`` starts, each a window of its own;
    what comes before and after a bin is one row a bin."""
    empty = F.col("start") == F.col("end")
    own = ranges if zero_width else ranges.filter(~empty)
    binned = own.withColumns({"_bin": F.floor(F.col("start") / bin_width), "_empty": empty})
    w = Window.partitionBy("path", "_bin").orderBy("start", "_empty", "end", "id")
    swept = binned.withColumns(
        {
            "_reach": F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "_next": F.lead("start").over(w),
            "_twin": F.coalesce(F.lag(F.struct("start", "_empty")).over(w) == F.struct("start", "_empty"), F.lit(False))
            | F.coalesce(F.lead(F.struct("start", "_empty")).over(w) == F.struct("start", "_empty"), F.lit(False)),
        }
    )
    along = Window.partitionBy("path").orderBy("_bin")
    bins = binned.groupBy("path", "_bin").agg(F.max("end").alias("last"), F.min("start").alias("first"))
    bins = bins.select("path", "_bin", F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"), F.lead("first").over(along).alias("_follows"))
    before = F.coalesce(F.greatest("_reach", "_carry") > F.col("start"), F.lit(False))
    after = F.coalesce(F.coalesce("_next", "_follows") < F.col("end"), F.lit(False))
    clash = F.when(F.col("_empty"), before | F.col("_twin")).otherwise(before | after)
    found = swept.join(bins, ["path", "_bin"]).withColumn("clash", clash).select(*ranges.columns, "clash")
    return found if zero_width else found.unionByName(ranges.filter(empty).withColumn("clash", F.lit(False)))


def survivors(ranges: DataFrame, zero_width: bool = False) -> DataFrame:
    """The ranges that overlap no other; both sides of an overlap go."""
    return flagged(ranges, zero_width).filter(~F.col("clash")).drop("clash")


def outside(inner: DataFrame, blocks: DataFrame, bin_width: int = 1024) -> DataFrame:
    """The inner ranges that overlap no block of their path."""
    x, y = _binned(inner, bin_width).alias("x"), _binned(blocks.select("path", "start", "end"), bin_width).alias("y")
    a, b = (F.struct(F.col(f"{t}.start").alias("start"), F.col(f"{t}.end").alias("end")) for t in "xy")
    same = (F.col("x.path") == F.col("y.path")) & (F.col("x.bin") == F.col("y.bin"))
    hit = x.join(y, same & overlaps(a, b, False), "left_semi").select("path", "id").distinct()
    return inner.join(hit, ["path", "id"], "left_anti")


def contiguity_violations(segments: DataFrame) -> DataFrame:
    """segments: (path, ix, start, end, total): each must start where the one before ended, the last end at the total."""
    w = Window.partitionBy("path").orderBy("ix")
    expected = F.coalesce(F.lag("end").over(w), F.lit(0))
    last = F.lead("ix").over(w).isNull() & (F.col("end") != F.col("total"))
    return (
        segments.withColumns({"expected": expected, "short": last})
        .filter((F.col("start") != F.col("expected")) | F.col("short"))
        .select("path", "ix", "start", "end", "expected")
    )


def locate(points: DataFrame, segments: DataFrame) -> DataFrame:
    """points: (path, point); segments: (path, ix, review_start, review_end, ...), which cover their path in the order of ix without
    overlap. (path, point, segment): the first segment that holds the point, its ends included; null for a gap.

    One sort each way instead of a range join: the last segment that starts before the point, else the first one that starts at it."""
    names = [c for c in segments.columns if c != "path"]
    rows = points.select("path", "point", F.lit(None).cast(segments.select(F.struct(*names)).schema[0].dataType).alias("s")).unionByName(
        segments.select("path", F.col("review_start").alias("point"), F.struct(*names).alias("s"))
    )
    is_segment = F.col("s").isNotNull()
    forth = Window.partitionBy("path").orderBy("point", is_segment, "s.ix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy("path").orderBy(F.desc("point"), F.desc(is_segment), F.desc("s.ix")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.withColumns({"before": F.last("s", ignorenulls=True).over(forth), "after": F.last("s", ignorenulls=True).over(back)})
    hit = F.when(F.col("before.review_end") >= F.col("point"), F.col("before")).when(F.col("after.review_start") == F.col("point"), F.col("after"))
    return both.filter(~is_segment).select("path", "point", hit.alias("segment"))


def source_place(text: Column, point: Column, segment: Column) -> Column:
    """The source byte of a point of text: the ends of a segment are always known, its inside only where it is copied as it is.

    segment: review_start, review_end, source_start, source_end, identity. Where characters are bytes the text isn't read."""
    offset = point - segment["review_start"]
    narrow = segment["review_end"] - segment["review_start"] == segment["source_end"] - segment["source_start"]
    inside = F.octet_length(F.substring(text, segment["review_start"] + 1, offset))
    return (
        F.when(point == segment["review_start"], segment["source_start"])
        .when(point == segment["review_end"], segment["source_end"])
        .when(segment["identity"] & narrow, segment["source_start"] + offset)
        .when(segment["identity"], segment["source_start"] + inside)
    )


def first_lossy(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """spans: (path, id, start, end) in review places; segments as in ``locate``. (path, id, ix): the first segment without identity that a
    span enters; an empty span must lie strictly inside one.

    That is the first such segment that ends behind the span's start, if it begins before the span's end: one sort instead of a range join."""
    segment = F.struct("review_end", "ix", "review_start")
    lossy = segments.filter(~F.col("identity")).select("path", F.col("review_end").alias("point"), segment.alias("s"))
    none = F.lit(None)
    rows = spans.select("path", F.col("start").alias("point"), none.cast(lossy.schema["s"].dataType).alias("s"), "id", "end").unionByName(
        lossy.withColumns({"id": none.cast(spans.schema["id"].dataType), "end": none.cast(spans.schema["end"].dataType)})
    )
    is_segment = F.col("s").isNotNull()
    w = Window.partitionBy("path").orderBy(F.desc("point"), is_segment, F.desc("s.ix")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.withColumn("next", F.last("s", ignorenulls=True).over(w)).filter(~is_segment)
    return met.filter(F.col("next.review_start") < F.col("end")).select("path", "id", F.col("next.ix").alias("ix"))


def splice(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """texts: (path, text); edits: (path, start, end, replacement) in bytes, without overlap. (path, text) with all edits made; a null
    replacement is empty.

    An edit's text is what lies between the end of the edit before it and its start, then its replacement; the pieces are joined once."""
    per_path = edits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "end", F.coalesce("replacement", F.lit("")).alias("replacement")))).alias("edits"))

    def edited(raw: Column) -> Column:
        def between(start: Column, end: Column) -> Column:
            return F.decode(F.substring(raw, start.cast("int") + 1, (end - start).cast("int")), "UTF-8")

        def piece(e: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.get("edits", i - 1)["end"])
            return F.concat(between(before, e["start"]), e["replacement"])

        last = F.element_at("edits", -1)["end"]
        return F.concat(F.array_join(F.transform("edits", piece), ""), between(last, F.octet_length(raw)))

    joined = texts.join(per_path, "path", "left")
    return joined.select("path", F.when(F.col("edits").isNull(), F.col("text")).otherwise(let(F.encode("text", "UTF-8"), edited)).alias("text"))
