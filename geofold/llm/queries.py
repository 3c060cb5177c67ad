"""The registered queries of the corpus operators, and SQL for those that SQL can express.

Each query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofold.llm import checksum, classifier, html_text, language_id, line_rules, lm, mixing, packing, resampling, sharding, simhash, spelling, topk, url_rules
from geofold.llm.common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_rules.judge(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op5_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), label_col="quality")
    return rows.select("doc_id", "held_out", "score", "predicted")


def op6_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_block_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


#: The rules of the contract.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op8_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op9_va_file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op11_suffix_array_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op12_partial_matching_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op13_spelling_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash_near_duplicates, op2_vector_packing, op3_sampled_splitters, op4_line_frequency, op5_random_indexing_quality, op6_line_block_text, op7_block_mixing, op8_host_trust, op9_va_file_search, op10_backoff_automaton, op11_suffix_array_resampling, op12_partial_matching_language, op13_spelling_automata)}


def crc32_sql(x: str) -> str:
    """SQL of a text's CRC-32, bit by bit."""
    bits = f"list_transform(range(8 * octet_length(encode({x}))), lambda i: CAST((CAST('0x' || substr(hex(encode({x})), 2 * (i // 8) + 1, 2) AS BIGINT) >> (i % 8)) & 1 AS BIGINT))"
    return f"xor(list_reduce({bits}, lambda c, b: xor(c >> 1, {checksum.POLYNOMIAL} * (xor(c, b) & 1)), CAST(4294967295 AS BIGINT)), 4294967295)"


LOWER_SQL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_GRAMS = " UNION ALL ".join(f"SELECT {{0}}, unnest(list_transform(range(1, len(w) + {2 - n}), lambda i: " + " || ' ' || ".join(f"w[i + {k}]" for k in range(n)) + ")) AS f FROM {1}" for n in (1, 2, 3))
_RUNS = "coalesce(regexp_extract_all(" + LOWER_SQL.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

_LETTERS = r"unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+'))"

ORACLE_SQL: dict[str, str] = {
    "op9_va_file_search": """
        WITH w AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM w q JOIN w c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 5
    """,
    "op11_suffix_array_resampling": f"""
        WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_RUNS} AS w FROM documents), v AS (SELECT {_RUNS} AS w FROM benchmark),
        f AS MATERIALIZED ({_GRAMS.format("r", "w")}), g AS MATERIALIZED ({_GRAMS.format("0 AS r", "v")}),
        crc AS MATERIALIZED (SELECT f, {crc32_sql("f")} % 10000 AS bucket FROM (SELECT f FROM f UNION SELECT f FROM g)),
        s AS (SELECT bucket, count(*) AS s FROM f JOIN crc USING (f) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM g JOIN crc USING (f) GROUP BY 1),
        gains AS (SELECT i AS bucket, CAST(floor(1000 * ln(((CAST(coalesce(t, 0) AS DOUBLE) + 1) * ((SELECT count(*) FROM f) + 10000.0::DOUBLE)) / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * ((SELECT count(*) FROM g) + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM range(10000) b(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
        weights AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight, count(*) AS n_features FROM f JOIN crc USING (f) JOIN gains USING (bucket) GROUP BY r),
        scored AS (SELECT w.r, doc_id, len(w) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM w LEFT JOIN weights USING (r)),
        ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM scored WHERE n >= 20) * 5 // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
    """,
    "op13_spelling_automata": f"""
        WITH RECURSIVE runs AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, {LOWER_SQL.format(_LETTERS)} AS w FROM documents) GROUP BY ALL),
        hashed AS MATERIALIZED (SELECT w, k, {crc32_sql("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)")} AS h FROM runs),
        read AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word, k FROM hashed),
        words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM read WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
        cut AS MATERIALIZED (SELECT word, i, left(word, CAST(i AS INTEGER) - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
        near AS MATERIALIZED (SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION SELECT a.word, b.word FROM cut a JOIN words b ON b.word = a.rest UNION SELECT b.word, a.word FROM cut a JOIN words b ON b.word = a.rest),
        best AS (SELECT near.word, count(*) AS n_near, first(near ORDER BY w.n DESC, near) AS near, max(w.n) AS near_n FROM near JOIN words w ON w.word = near GROUP BY near.word),
        judged AS MATERIALIZED (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
        chain AS (SELECT word, word AS root, 0 AS step FROM judged UNION ALL SELECT chain.word, form, step + 1 FROM chain JOIN judged ON judged.word = root WHERE form IS NOT NULL)
        SELECT judged.word, form, root, n, n_near, form_n FROM judged JOIN (SELECT word, last(root ORDER BY step) AS root FROM chain GROUP BY word) USING (word)
    """,
}
