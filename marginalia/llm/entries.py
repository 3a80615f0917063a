"""The queries of the training-data operators, with their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bin_packing, bpe_matrix, collocations, conversation_trie, jaccard_regions, langid_crf, license_index, mtree_topk, quality_cascade, secret_grammar, simhash_ring, suffix_dedup, toxicity_fst
from .common import held_out, read


def tokenizer() -> tuple[str, str]:
    """Where the ranks of the public byte-level BPE are, and its split pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_langid_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = langid_crf.identify(docs, langid_crf.train(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


def op2_toxicity_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity_fst.train(docs, read(spark, sf_dir, "labels"))
    scored = toxicity_fst.score_toxicity(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(read(spark, sf_dir, "documents"))


def op4_simhash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_ring.near_duplicates(read(spark, sf_dir, "documents"), width=3, budget=2)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_fps")


def op5_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_index.scan_licenses(read(spark, sf_dir, "documents")).drop("matches")


def op6_bpe_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_matrix.encode(read(spark, sf_dir, "documents"), *tokenizer(), digest=True)


def op7_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_grammar.scan_secrets(read(spark, sf_dir, "documents")).drop("found")


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_cascade.apply_cascade(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mtree_topk.quantized(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return mtree_topk.top_k(rows.filter("vec_id % 20 = 0"), rows, k=20)


def op10_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.pack_documents(read(spark, sf_dir, "documents"), tokens=tokenizer())


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(read(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op13_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_regions.jaccard_join(read(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id
), s AS (
  SELECT d.doc_id, t, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN n USING (doc_id)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 10 * n_dup_lines > 3 * n_lines OR 5 * (length(t) - length(replace(t, '!', ''))) > n_words
            OR 2 * (length(t) - length(regexp_replace(t, '[^\p{L}\x20\x09-\x0D]', '', 'g'))) > word_chars
            OR 5 * (length(t) - length(regexp_replace(t, '[0-9]', '', 'g'))) > word_chars) AS kept
FROM b
"""


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS c,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'c': c, 'w': w} ORDER BY turn NULLS FIRST, c) AS own FROM t GROUP BY conv_id
), h AS (
  SELECT *, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
               lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 4 AS h
  FROM own
), r AS (
  SELECT h.conv_id, list_concat(list_slice(coalesce(b.own, []), 1, h.h), list_slice(h.own, h.h + 1, len(h.own))) AS s
  FROM h LEFT JOIN own b ON b.conv_id = h.base
), p AS (
  SELECT conv_id, d, len(s) = d AS ends, CASE WHEN d > 0 THEN s[d].w ELSE 0 END AS w,
         md5(array_to_string(list_transform(list_slice(s, 1, d), lambda x: x.c), '')) AS path
  FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM r)
), n AS (
  SELECT d, path, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w,
         string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends) AS ends
  FROM p GROUP BY d, path
), e AS (
  SELECT n.*, q.path AS above, m.conv_id AS parent
  FROM n LEFT JOIN p q ON q.conv_id = n.conv_id AND q.d = n.d - 1 LEFT JOIN n m ON m.d = q.d AND m.path = q.path
), c AS (
  SELECT d - 1 AS d, above AS path, count(*) AS c FROM e WHERE d > 0 GROUP BY ALL
), u AS (
  SELECT e.*, coalesce(c.c, 0) AS c FROM e LEFT JOIN c ON c.d = e.d AND c.path = e.path
), b AS (
  SELECT q.d, q.path, sum((u.n - 1) * u.w) AS saved, count(*) FILTER (u.c = 0) AS leaves
  FROM u JOIN p q ON q.conv_id = u.conv_id AND q.d <= u.d GROUP BY ALL
)
SELECT u.conv_id, u.d AS depth, u.parent AS parent_conv_id, u.n AS n_convs, u.c AS n_children, b.leaves AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(u.ends, '')) AS ends_sha256
FROM u JOIN b USING (d, path)
"""


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), n AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), k AS (
  SELECT unnest([1, 2, 3, 4]) AS k
), g AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, k)
), f AS (
  SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30
), c AS (
  SELECT lang, phrase, k AS size, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1
), s AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, 2000000 * c.a // (x.f + y.f) AS score
  FROM c
  JOIN f x ON x.lang = c.lang AND x.k = c.cut AND x.phrase = array_to_string(list_slice(c.w, 1, c.cut), ' ')
  JOIN f y ON y.lang = c.lang AND y.k = c.size - c.cut AND y.phrase = array_to_string(list_slice(c.w, c.cut + 1, c.size), ' ')
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), i AS (
  SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS above
  FROM (SELECT lang, w, size, a, m, unnest(range(1, size - m + 2)) AS i
        FROM (SELECT lang, string_split(phrase, ' ') AS w, k AS size, f AS a, unnest(range(2, k)) AS m FROM f WHERE k > 2))
  GROUP BY ALL
), d AS (
  SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE i.above IS NULL OR 100 * i.above < 80 * b.a
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d
)
SELECT o.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n.n, CAST(score AS BIGINT) AS score
FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""


OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS i, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT i, array_to_string(list_slice(w, k, k + 3), ' ') AS s FROM (SELECT i, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM d WHERE len(w) > 0)
), n AS (
  SELECT i, count(*) AS n FROM s GROUP BY i
), b AS (
  SELECT x.i AS a, y.i AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.i <> y.i GROUP BY ALL
), l AS MATERIALIZED (
  SELECT a, b FROM b JOIN n x ON x.i = a JOIN n y ON y.i = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), r AS (
  SELECT a AS i, a AS j FROM l UNION SELECT r.i, l.b FROM r JOIN l ON l.a = r.j
), c AS (
  SELECT r.i, min(d.doc_id) AS component_id FROM r JOIN d ON d.i = r.j GROUP BY r.i
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (i) LEFT JOIN c USING (i)
"""


def queries() -> dict:
    return {
        "op1_langid_crf": op1_langid_crf,
        "op2_toxicity_fst": op2_toxicity_fst,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_simhash_ring": op4_simhash_ring,
        "op5_license_index": op5_license_index,
        "op6_bpe_matrix": op6_bpe_matrix,
        "op7_secret_grammar": op7_secret_grammar,
        "op8_quality_cascade": op8_quality_cascade,
        "op9_mtree_topk": op9_mtree_topk,
        "op10_bin_packing": op10_bin_packing,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_collocations": op12_collocations,
        "op13_jaccard_regions": op13_jaccard_regions,
    }


def oracle_sql() -> dict:
    return {"op8_quality_cascade": OP8_SQL, "op9_mtree_topk": OP9_SQL, "op11_conversation_trie": OP11_SQL, "op12_collocations": OP12_SQL, "op13_jaccard_regions": OP13_SQL}
