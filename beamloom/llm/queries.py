"""The registered queries of this subpackage and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat
from .common import table
from .exact_dedup import exact_dedup
from .filter_audit import audit
from .languages import identify
from .mixing import mix_plan
from .near_dedup import near_duplicates
from .neighbours import nearest
from .packing import pack_documents
from .quality import classify
from .secrets import scan_secrets
from .token_files import write_token_files
from .tokens import LARGE_CACHE, tokenizer_spec
from .toxicity import score_toxicity
from .vector_codes import compress


def vocabulary() -> str:
    import public_tokenizers

    return tokenizer_spec(public_tokenizers.path("word_bpe_49k.json"))


def op1_block_matrix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


OP1_SQL = """
WITH usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op3_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, similarity=(85, 100))


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words
), sets AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM shingled
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total, count(*) AS c
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85 GROUP BY ALL
), links AS (SELECT a, b FROM met WHERE 100 * c >= 85 * (total - c)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.b FROM reached r JOIN both_ways l ON r.other = l.a
), components AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM shingled JOIN components USING (doc_id)
"""


def op5_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_token_files(table(spark, sf_dir, "documents"), vocabulary(), end_id=1, cache_bytes=LARGE_CACHE).digests()


#: The layouts in which op7 hands over conversations, by their id.
HANDED_OVER = ("turn rows", "messages", "from and value", "prompt and response", "instruction", "question and answer")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], conversations.schema)
    turns = conversations.unionByName(extra)
    kind = F.coalesce(F.pmod(F.col("conv_id"), F.lit(len(HANDED_OVER))), F.lit(0)).cast("int")
    rows = chat.canonical_turns(turns.filter(kind == 0))
    name = F.element_at(F.array(*map(F.lit, HANDED_OVER)), kind + 1)
    records = chat.mixed_records(turns.filter(kind != 0), name)
    return chat.digests(chat.write_formatted(rows.unionByName(chat.record_table_turns(records))))


OP7_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), escaped AS (
  SELECT *, length(regexp_replace(replace(role || text, '\', '\\'), '<\|(turn|text|/turn|im_start|im_end|startoftext|endoftext|user|assistant|system|eot_id|start_header_id|end_header_id|begin_of_text)\|>|</?s>|\[/?INST\]|<</?SYS>>', '\0x', 'g')) AS size
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size + length('<|turn|><|text|><|/turn|>')) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(), capacity=2048, end_id=0, cache_bytes=LARGE_CACHE)


def op10_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"), toward_uniform=0.5, repeats=4.0, fewest=1.5)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


OP9_SQL = r"""
WITH hashed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM hashed
"""


def op11_partial_distance_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).drop("label")


def _near(book: int) -> str:
    """Each part's entry of the smallest distance, and that distance."""
    return f"""near{book} AS (
  SELECT rid, part, any_value(v) AS v, any_value(label) AS label, any_value(vec_id) AS vec_id, min(struct_pack(far := far, entry := entry)) AS best
  FROM (SELECT p.*, b.entry, CAST(list_sum(list_transform(list_zip(p.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS BIGINT) AS far
        FROM cut p JOIN book{book} b USING (part)) GROUP BY rid, part
)"""


def _moved(book: int) -> str:
    """The codebook after the one of that number: floored means, entries without parts stay."""
    return f"""sums{book} AS (
  SELECT part, entry, list(m ORDER BY place) AS v FROM (
    SELECT part, best.entry AS entry, place, CAST((sum(v[place]) - (sum(v[place]) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
    FROM near{book}, unnest(range(1, len(v) + 1)) AS u(place) GROUP BY ALL) GROUP BY ALL
), book{book + 1} AS (SELECT b.part, b.entry, coalesce(s.v, b.v) AS v FROM book{book} b LEFT JOIN sums{book} s USING (part, entry))"""


OP11_SQL = f"""
WITH usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % 16 = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), kept AS (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS rid FROM usable
  WHERE len(v) = (SELECT len(v) FROM usable GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
), cut AS (
  SELECT rid, vec_id, label, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS v FROM kept, unnest(range(16)) AS u(part)
), book0 AS (SELECT part, rid AS entry, v FROM cut WHERE rid < 64
), {_near(0)}, {_moved(0)}, {_near(1)}, {_moved(1)}, {_near(2)}, coded AS (
  SELECT rid, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.far) AS BIGINT) AS error
  FROM near2 GROUP BY rid
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book2) AS codebooks_sha256
FROM coded
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH told AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), masks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM texts LEFT JOIN told USING (doc_id)
), cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY part, mask
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own,
         CAST(coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0) AS BIGINT) AS before
  FROM orders, unnest(range(1, 6)) AS u(step)
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
       CAST(coalesce(sum(n) FILTER (mask & (before | own) = 0), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (mask & before = 0 AND mask & own <> 0), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (mask & before <> 0 AND mask & own <> 0), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (mask & before = 0 AND mask & own <> 0), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own <> 0), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & own <> 0), 0) AS BIGINT) AS shapley
FROM steps, cells GROUP BY part, filter_order, step, own, before
"""


def op13_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), folds=4, held_out=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_block_matrix_neighbours": op1_block_matrix_neighbours,
        "op2_secret_scan": op2_secret_scan,
        "op3_ordinal_toxicity": op3_ordinal_toxicity,
        "op4_minhash_near_dedup": op4_minhash_near_dedup,
        "op5_quality_discriminant": op5_quality_discriminant,
        "op6_huffman_token_files": op6_huffman_token_files,
        "op7_chat_format": op7_chat_format,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_temperature_mixing": op10_temperature_mixing,
        "op11_partial_distance_codes": op11_partial_distance_codes,
        "op12_filter_audit": op12_filter_audit,
        "op13_language_spans": op13_language_spans,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_block_matrix_neighbours": OP1_SQL,
        "op4_minhash_near_dedup": OP4_SQL,
        "op7_chat_format": OP7_SQL,
        "op9_exact_dedup": OP9_SQL,
        "op11_partial_distance_codes": OP11_SQL,
        "op12_filter_audit": OP12_SQL,
    }
