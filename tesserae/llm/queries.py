"""The registered queries of the corpus operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of sampled segmentations of all documents; null texts are empty, no rows give none (pieces.encode_digest)."""
    from tesserae.llm.pieces import encode_digest

    return encode_digest(_table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of all documents; without words no tokens, sum 0, null mean; no rows give none (lm.pseudo_likelihood)."""
    from tesserae.llm.lm import pseudo_likelihood

    return pseudo_likelihood(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards by bytes; null texts count one byte; no rows give none (sharding.byte_shards)."""
    from tesserae.llm.sharding import byte_shards

    return byte_shards(_table(spark, sf_dir, "documents"), shards=8)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed to 4096 tokens; a null or empty text is the end token alone; no rows give none (packing.pack_documents)."""
    from tesserae.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), capacity=4096)


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates by two-word shingles; without words a document is alone; no rows give none (neardup.near_duplicates)."""
    from tesserae.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80).drop("text_hash")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best of every fiftieth vector; null or non-finite vectors take no part; no rows give none (topk.top_k)."""
    from pyspark.sql import functions as F

    from tesserae.llm.topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to an archive and read back; null payloads are empty; no rows give none (warc.archive_pages)."""
    from tesserae.llm.warc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated 100-byte strings; null texts are empty; no rows give none (suffixes.remove_repeats)."""
    from tesserae.llm.suffixes import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept_text")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of all documents; null and empty texts have grade 0; no rows give none (toxicity.severity)."""
    from tesserae.llm.toxicity import severity

    return severity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all documents; null and empty texts fail; no rows give none (quality.quality_verdicts)."""
    from tesserae.llm.quality import quality_verdicts

    return quality_verdicts(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors; null and non-finite ones go; no rows give none (codes.vector_codes)."""
    from tesserae.llm.codes import vector_codes

    return vector_codes(_table(spark, sf_dir, "embeddings")).drop("label")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of 20 words or more, ranked; null texts weigh 0; no rows give none (resample.resample)."""
    from tesserae.llm.resample import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents of Jaccard 0.9 or more in three-word shingles; without words a document is alone; no rows give none."""
    from tesserae.llm.jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), shingle=3, percent=90)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_lm_scoring, op3_sharding, op4_packing, op5_minhash_dedup, op6_topk_search, op7_warc, op8_suffix_array_dedup, op9_toxicity, op10_quality_rules, op11_vector_codes, op12_importance_resampling, op13_jaccard_join)}


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


OP3_SQL = """
WITH bits AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS UBIGINT), CAST(range(8) AS UBIGINT[])),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS crc_table),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
c AS (SELECT doc_id, CAST(octet_length(b) + 1 AS BIGINT) AS size, CAST(xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(b), '..'), lambda h: CAST('0x' || h AS UBIGINT))),
  lambda s, x: xor(s >> 8, crc_table[CAST(xor(s & 255, x) AS BIGINT) + 1]))) AS BIGINT) AS text_crc32 FROM d, bits),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS start, sum(size) OVER () AS total FROM c),
s AS (SELECT *, CAST(start * 8 // total AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b.b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, a FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""

OP13_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b.b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b.b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, a FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""

OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
o AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM o) GROUP BY doc_id),
s AS (SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed, n_symbols / CAST(greatest(word_chars, 1) AS DOUBLE) AS symbol_share, n_repeat_words / CAST(greatest(n_words, 1) AS DOUBLE) AS repeat_share,
  n_dup_lines * 10 / CAST(greatest(n_words, 1) AS DOUBLE) AS dup_line_share, word_chars / CAST(greatest(n_words, 1) AS DOUBLE) AS mean_word FROM s),
m AS (SELECT lang, source, unnest(['symbol_share', 'repeat_share', 'dup_line_share', 'mean_word', 'n_words']) AS metric, unnest([symbol_share, repeat_share, dup_line_share, mean_word, n_words]) AS v FROM b WHERE NOT base_failed),
k AS (SELECT lang, source, metric, CAST(ceil(round(ln(greatest(v, 0.0001)) / ln(1.02), 6)) AS INTEGER) AS bucket FROM m),
f AS (SELECT lang, source, metric, bucket, CAST(count(*) AS HUGEINT) AS n FROM k GROUP BY ALL), fs AS (SELECT lang, source, metric, sum(n) AS size FROM f GROUP BY ALL),
l AS (SELECT lang, metric, bucket, sum(n) AS n FROM f GROUP BY ALL), ls AS (SELECT lang, metric, sum(n) AS size FROM l GROUP BY ALL),
a AS (SELECT metric, bucket, sum(n) AS n FROM l GROUP BY ALL), al AS (SELECT metric, sum(n) AS size FROM a GROUP BY ALL),
lw AS (SELECT ls.lang, a.metric, a.bucket, coalesce(l.n, 0) * al.size + 50 * a.n AS w, (ls.size + 50) * al.size AS total
  FROM ls JOIN al USING (metric) JOIN a USING (metric) LEFT JOIN l ON l.lang IS NOT DISTINCT FROM ls.lang AND l.metric = a.metric AND l.bucket = a.bucket),
fw AS (SELECT fs.lang, fs.source, fs.metric, lw.bucket, coalesce(f.n, 0) * lw.total + 50 * lw.w AS w, (fs.size + 50) * lw.total AS total
  FROM fs JOIN lw ON lw.lang IS NOT DISTINCT FROM fs.lang AND lw.metric = fs.metric LEFT JOIN f ON f.lang IS NOT DISTINCT FROM fs.lang AND f.source IS NOT DISTINCT FROM fs.source AND f.metric = fs.metric AND f.bucket = lw.bucket),
c AS (SELECT *, sum(w) OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS upto FROM fw),
q AS (SELECT lang, source, metric, pow(1.02, min(CASE WHEN upto * 100 >= total * 25 THEN bucket END)) AS q25, pow(1.02, min(CASE WHEN upto * 100 >= total * 50 THEN bucket END)) AS q50, pow(1.02, min(CASE WHEN upto * 100 >= total * 75 THEN bucket END)) AS q75, pow(1.02, min(CASE WHEN upto * 100 >= total * 90 THEN bucket END)) AS q90 FROM c GROUP BY ALL),
t AS (SELECT q.*, greatest(q.q75 - q.q25, q.q90 - q.q50, CASE q.metric WHEN 'symbol_share' THEN 1 WHEN 'repeat_share' THEN 20 WHEN 'dup_line_share' THEN 10 ELSE 0 END / n.q50, q.q75 * (1.02 - 1)) * 4 AS span
  FROM q JOIN q n ON n.metric = 'n_words' AND n.lang IS NOT DISTINCT FROM q.lang AND n.source IS NOT DISTINCT FROM q.source),
x AS (SELECT lang, source, max(CASE metric WHEN 'symbol_share' THEN q75 + span END) AS hs, max(CASE metric WHEN 'repeat_share' THEN q75 + span END) AS hr, max(CASE metric WHEN 'dup_line_share' THEN q75 + span END) AS hd,
  max(CASE metric WHEN 'mean_word' THEN q75 + span END) AS hm, max(CASE metric WHEN 'mean_word' THEN q25 - span END) AS lm FROM t GROUP BY lang, source)
SELECT doc_id, b.lang, b.source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE NOT (symbol_share > hs OR repeat_share > hr OR dup_line_share > hd OR mean_word > hm OR mean_word < lm) END AS kept
FROM b LEFT JOIN x ON x.lang IS NOT DISTINCT FROM b.lang AND x.source IS NOT DISTINCT FROM b.source
"""



OP12_SQL = r"""
WITH bits AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS UBIGINT), CAST(range(8) AS UBIGINT[])),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS crc_table),
t AS (SELECT doc_id, text, true AS own FROM documents UNION ALL SELECT NULL, text, false FROM benchmark),
w AS MATERIALIZED (SELECT doc_id, own, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM t),
h AS MATERIALIZED (SELECT w, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda h: CAST('0x' || h AS UBIGINT))),
  lambda s, x: xor(s >> 8, crc_table[CAST(xor(s & 255, x) AS BIGINT) + 1]))) % 10000 AS bucket FROM (SELECT DISTINCT w FROM w), bits),
c AS (SELECT bucket, CAST(count(*) FILTER (own) AS DOUBLE) AS s, CAST(count(*) FILTER (NOT own) AS DOUBLE) AS t FROM w JOIN h USING (w) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM c) + 10000) / ((s + 1) * ((SELECT sum(t) FROM c) + 10000)))) AS BIGINT) AS gain FROM c),
f AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM w JOIN h USING (w) JOIN g USING (bucket) WHERE own GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS UBIGINT) AS h FROM documents LEFT JOIN f USING (doc_id)),
x AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (doc_id)
"""


def _op11_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Each round twice: the nearest entries n, then the codebook b of their parts' means."""
    steps = [
        """v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS uid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"x AS MATERIALIZED (SELECT uid, p AS part, e[p * len(e) // {parts} + 1:(p + 1) * len(e) // {parts}] AS x FROM v, range({parts}) AS r(p))",
        f"b0 AS (SELECT part, uid - 1 AS entry, x AS c FROM x WHERE uid <= {entries})",
    ]
    for i in range(rounds + 1):
        steps.append(f"""n{i} AS MATERIALIZED (SELECT uid, x.part, min(struct_pack(d := list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))), entry := entry)) AS best
  FROM x JOIN b{i} ON b{i}.part = x.part GROUP BY uid, x.part)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT part, entry, place, CAST(floor(sum(y) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS mean FROM (SELECT n.part, n.best.entry AS entry, unnest(x.x) AS y, unnest(range(len(x.x))) AS place FROM n{i} n JOIN x USING (uid, part)) GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN (SELECT part, entry, list(mean ORDER BY place) AS c FROM m{i} GROUP BY ALL) m USING (part, entry))""")
    steps.append(f"d AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})")
    steps.append(f"r AS (SELECT uid, lower(string_agg(printf('%02x', best.entry), '' ORDER BY part)) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM n{rounds} GROUP BY uid)")
    ctes = ",\n".join(steps)
    return f"WITH {ctes}\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN v USING (uid), d"


def oracle_sql() -> dict[str, str]:
    return {"op11_vector_codes": _op11_sql(), "op12_importance_resampling": OP12_SQL, "op13_jaccard_join": OP13_SQL, "op3_sharding": OP3_SQL, "op5_minhash_dedup": OP5_SQL, "op6_topk_search": OP6_SQL, "op7_warc": OP7_SQL, "op10_quality_rules": OP10_SQL}
