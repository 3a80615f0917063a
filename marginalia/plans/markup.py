"""Queries over packages of XML parts. The tables hold none, so each document is written as one: a paragraph and a bookmark for each line,
a run for each word; of ten words of a line, the second and fifth are inserted, the fourth is deleted (so the fourth and fifth are one
replacement), the seventh and eighth moved away and in, and the ninth is bold."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import bound_texts, put
from ..sources import packages as P
from .registry import query, table

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
RELS = (
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Type="x/image" Target="i.png"/>'
    '<Relationship Id="b" Type="x/link" TargetMode="External" Target="http://a"/></Relationships>'
)
_MARKS = {1: "ins", 3: "del", 4: "ins", 6: "moveFrom", 7: "moveTo"}


def _document(text: str) -> str:
    out, number = [f'<w:document xmlns:w="{W}"><w:body>'], 0
    for k, line in enumerate(text.split("\n")):
        out.append(f'<w:p><w:bookmarkStart w:id="{k}" w:name="{"_" if k % 4 == 3 else ""}u{k}"/>')
        for i, word in enumerate(w for w in line.split(" ") if w):
            mark = _MARKS.get(i % 10)
            tag = "delText" if mark in ("del", "moveFrom") else "t"
            properties = '<w:rPr><w:b/><w:i w:val="0"/><w:u w:val="single"/></w:rPr>' if i % 10 == 8 else ""
            run = f'<w:r>{properties}<w:{tag} xml:space="preserve">{escape(word)} </w:{tag}></w:r>'
            out.append(f'<w:{mark} w:id="{number}" w:author="A" w:date="2024-01-02T03:04:05Z">{run}</w:{mark}>' if mark else run)
            number += 1
        out.append(f'<w:bookmarkEnd w:id="{k}"/></w:p>')
    return "".join([*out, "</w:body></w:document>"])


def stand_in(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content): a package for each document."""

    def package(path: str, text: str) -> tuple[str, bytes]:
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo("word/document.xml"), _document(text))
            z.writestr(zipfile.ZipInfo("word/_rels/document.xml.rels"), RELS)
            z.writestr(zipfile.ZipInfo("word/footnotes.xml"), f'<w:footnotes xmlns:w="{W}"><w:ins w:id="1" w:author="B"><w:r><w:t>note {path}</w:t></w:r></w:ins></w:footnotes>')
            z.writestr(zipfile.ZipInfo("../outside"), "x")
        return path, raw.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from put((package(p.as_py(), t.as_py() or "") for p, t in zip(batch.column(0), batch.column(1), strict=True)), {"path": pa.string(), "content": pa.binary()}, 100)

    bound_texts(spark)
    # a text grows tenfold as nodes, so that a small file's only partition would be one long task
    texts = table(spark, sf, "documents").select(F.col("doc_id").cast("string"), "text").repartition(4 * spark.sparkContext.defaultParallelism)
    return texts.mapInArrow(run, "path string, content binary")


def all_nodes(spark: SparkSession, sf: str, *columns: str, parts: tuple[str, ...] = (".xml", ".rels")) -> DataFrame:
    """The node table, with the columns that are wanted. Every query reads it in one pass, so that it is written nowhere."""
    return P.nodes(stand_in(spark, sf), columns=columns, parts=parts)


#: (doc_id, k, i, w): each word of each line, k and i from 0.
WORDS_SQL = r"""li AS (SELECT doc_id, CAST(unnest(range(len(l))) AS BIGINT) AS k, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
wl AS (SELECT doc_id, k, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws FROM li),
wd AS (SELECT doc_id, k, CAST(unnest(range(len(ws))) AS BIGINT) AS i, unnest(ws) AS w FROM wl)"""


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS path, member, problem FROM documents, (VALUES ('word/document.xml', NULL), ('word/_rels/document.xml.rels', NULL),
    ('word/footnotes.xml', NULL), ('../outside', 'unsafe_name')) AS m(member, problem)"""
)
def package_members(spark: SparkSession, sf: str) -> DataFrame:
    """Members, and what is wrong with one."""
    return P.members(stand_in(spark, sf)).select("path", "member", "problem")


@query(
    f"""WITH {WORDS_SQL} SELECT CAST(doc_id AS VARCHAR) AS path, 2 + count(*) FILTER (i IS NULL) * 3 + CAST(sum(CASE WHEN i IS NULL THEN 0 WHEN i % 10 IN (1, 3, 4, 6, 7) THEN 3 WHEN i % 10 = 8 THEN 6 ELSE 2 END) AS BIGINT) AS nodes,
    count(*) FILTER (i IS NULL) AS paragraphs FROM (SELECT doc_id, k, NULL AS i FROM wl UNION ALL SELECT doc_id, k, i FROM wd) GROUP BY doc_id"""
)
def package_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Elements of the main part, and its paragraphs."""
    n = F.col("n")
    return P.tag_counts(stand_in(spark, sf), parts=("word/document.xml",)).groupBy("path").agg(F.sum(n).alias("nodes"), F.sum(F.when(F.col("tag") == "p", n).otherwise(0)).alias("paragraphs"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, CAST(2 AS BIGINT) AS total, CAST(1 AS BIGINT) AS external, CAST(1 AS BIGINT) AS images FROM documents")
def package_relationships(spark: SparkSession, sf: str) -> DataFrame:
    """S6."""
    return P.relationships(all_nodes(spark, sf, "path", "tag", "attrs", parts=(".rels",)))


@query(
    f"""WITH {WORDS_SQL} SELECT CAST(doc_id AS VARCHAR) AS path, 'word/document.xml' AS part, coalesce(string_agg(w || ' ', '' ORDER BY k, i) FILTER (i % 10 NOT IN (1, 4, 7)), '') AS original,
    coalesce(string_agg(w || ' ', '' ORDER BY k, i) FILTER (i % 10 NOT IN (3, 6)), '') AS final FROM wd GROUP BY doc_id
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'word/footnotes.xml', '', 'note ' || doc_id FROM documents"""
)
def revision_views(spark: SparkSession, sf: str) -> DataFrame:
    """The text with everything rejected, and with everything accepted."""
    return P.views_in(stand_in(spark, sf))


@query(
    f"""WITH {WORDS_SQL}, e AS (SELECT doc_id, 0 AS story, k, i, CASE WHEN i % 10 IN (1, 4) THEN 'insert' WHEN i % 10 = 3 THEN 'delete' WHEN i % 10 = 6 THEN 'move_from' ELSE 'move_to' END AS kind, w || ' ' AS text
      FROM wd WHERE i % 10 IN (1, 3, 4, 6, 7) UNION ALL SELECT doc_id, 1, 0, 0, 'insert', 'note ' || doc_id FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY story, k, i) - 1 AS INTEGER) AS sequence, kind, text FROM e"""
)
def package_revisions(spark: SparkSession, sf: str) -> DataFrame:
    """All revisions in the order of stories, the footnotes after the main text."""
    return P.revision_events_in(stand_in(spark, sf), "path", "sequence", "kind", "text")


@query(
    f"""WITH {WORDS_SQL}, p AS (SELECT *, lead(i) OVER (PARTITION BY doc_id, k ORDER BY i) AS after FROM wd),
    c AS (SELECT doc_id, CASE WHEN i % 10 = 3 AND after IS NOT NULL THEN 'replacement' WHEN i % 10 = 3 THEN 'deletion' WHEN i % 10 = 1 THEN 'insertion' ELSE 'move' END AS kind,
      CASE WHEN k % 4 = 3 THEN NULL ELSE 'u' || k END AS bookmark FROM p WHERE i % 10 IN (1, 3, 6, 7) UNION ALL SELECT doc_id, 'insertion', NULL FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS path, kind, count(*) AS n, count(DISTINCT bookmark) AS bookmarks FROM c GROUP BY ALL"""
)
def package_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of each kind, and under how many bookmarks."""
    return P.changes_in(stand_in(spark, sf), "path", "kind", "bookmark").groupBy("path", "kind").agg(F.count("*").alias("n"), F.count_distinct("bookmark").alias("bookmarks"))


@query(
    f"""WITH {WORDS_SQL} SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN i % 10 IN (6, 7) THEN 'not_applicable' ELSE 'plain_text' END AS class, count(*) AS n FROM wd WHERE i % 10 IN (1, 3, 4, 6, 7) GROUP BY ALL
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'structured', 1 FROM documents"""
)
def structural_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The insertion of the footnotes stands in no paragraph."""
    return P.evidence_classes_in(stand_in(spark, sf)).groupBy("path", "class").agg(F.count("*").alias("n"))


@query(f"""WITH {WORDS_SQL} SELECT CAST(doc_id AS VARCHAR) AS path, count(*) AS runs, count(*) AS bold, CAST(0 AS BIGINT) AS italic, min('single') AS underline FROM wd WHERE i % 10 = 8 GROUP BY doc_id""")
def run_styles(spark: SparkSession, sf: str) -> DataFrame:
    """A switch without a value is on, one with 0 is off."""
    return P.run_properties_in(stand_in(spark, sf)).groupBy("path").agg(
        F.count("*").alias("runs"), F.count_if("bold").alias("bold"), F.count_if("italic").alias("italic"), F.min("underline").alias("underline")
    )
