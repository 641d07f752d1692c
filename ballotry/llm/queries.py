"""The queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import chat_format, collocations, decontaminate, exact_dedup, html_text, line_dedup, near_dedup, pii, sentencepiece_codec, token_shards, toxicity, vector_codes, warc
from .common import model_path, ranks_path, table

Query = Callable[[SparkSession, str], DataFrame]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.read(token_shards.materialise(table(spark, sf_dir, "documents"), ranks_path()), with_ids=False).drop("ids")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).drop("url", "payload")


def op6_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents")).drop("found")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), model_path(), ("n_tokens", "ids_sha256", "spans_sha256", "decoded_sha256"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), words=2, threshold=80)


#: The added conversation, whose turns both say control strings.
_MARKED = "</s>[INST] ok [/INST]"


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_MARKED).alias("text"))
    examples = chat_format.expand(table(spark, sf_dir, "conversations").select(*marked.columns).union(marked))
    return chat_format.digests(chat_format.read_back(examples))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def _vector_codes_sql() -> str:
    """The rounds one after the other: assignments a, then codebooks c, from the starts."""
    nearest = lambda i: f"a{i} AS MATERIALIZED (SELECT row, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT row, p, e, list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN c{i} USING (p)) GROUP BY 1, 2)"
    means = lambda i: f"m{i} AS (SELECT p, e, k, CAST(floor_div(sum(v[k]), count(*)) AS BIGINT) AS m FROM x JOIN a{i - 1} USING (row, p), range(1, (SELECT w FROM n) + 1) t(k) GROUP BY 1, 2, 3), c{i} AS MATERIALIZED (SELECT p, e, coalesce(n.w, o.w) AS w FROM c{i - 1} o LEFT JOIN (SELECT p, e, list(m ORDER BY k) AS w FROM m{i} GROUP BY 1, 2) n USING (p, e))"
    rounds = ", ".join(f"{nearest(i - 1)}, {means(i)}" for i in range(1, 7))
    sql = f"""
            WITH g AS (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS v
                       FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
                 n AS (SELECT max(len(v)) // 8 AS w FROM g),
                 x AS MATERIALIZED (SELECT row, p, v[(p - 1) * w + 1:p * w] AS v FROM g, n, range(1, 9) t(p)),
                 c0 AS MATERIALIZED (SELECT p, row - 1 AS e, v AS w FROM x WHERE row <= 16), {rounds}, {nearest(6)},
                 r AS (SELECT row, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY 1)
            SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
                   (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) FROM c6) AS codebooks_sha256
            FROM g JOIN r USING (row)"""
    # floors of quotients in whole numbers: // rounds towards zero
    return sql.replace("floor_div(sum(v[k]), count(*))", "(sum(v[k]) - ((sum(v[k]) % count(*)) + count(*)) % count(*)) // count(*)")


def queries() -> dict[str, Query]:
    found = (op1_html_extraction, op2_exact_dedup, op3_training_order, op4_benchmark_decontamination, op5_warc, op6_fuzzy_line_dedup, op7_toxicity, op8_pii, op9_sentencepiece, op10_minhash_near_dedup, op11_chat_formatting, op12_vector_codes, op13_phrase_collocations)
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
        "op5_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
                 q AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
                              CASE WHEN strlen(html) >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first FROM p)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
            FROM q""",
        "op4_benchmark_decontamination": fr"""
            WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
                 b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
                 x AS (SELECT DISTINCT item, w[i:i + 9] AS win FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
                 n AS (SELECT DISTINCT len(win) AS n FROM x),
                 p AS (SELECT doc_id, i, w[i:i + n - 1] AS win FROM d, n, unnest(range(1, greatest(len(w) - n + 2, 1))) t(i)),
                 h AS (SELECT doc_id, i, item, len(win) AS n FROM p JOIN x USING (win)),
                 k AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + n)) t(j) GROUP BY 1),
                 m AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
            SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
                   sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
            FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)""",
        "op10_minhash_near_dedup": fr"""
            WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
                 s AS (SELECT DISTINCT doc_id, w[i:i + 1] AS sh FROM d, unnest(range(1, greatest(len(w) - 1, 1) + 1)) t(i) WHERE len(w) > 0),
                 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
                 c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
                 e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
                 r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, f.y FROM r JOIN (SELECT x, y FROM e UNION ALL SELECT y, x FROM e) f ON f.x = r.b),
                 g AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
            SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM g LEFT JOIN n USING (doc_id)""",
        "op11_chat_formatting": fr"""
            WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                       UNION ALL SELECT -1, i, ['user', 'assistant'][i + 1], '{_MARKED}' FROM range(2) t(i)),
                 w AS (SELECT *, 32 + length(regexp_replace(role, k, '\1\\\2\3', 'g')) + length(regexp_replace(text, k, '\1\\\2\3', 'g')) AS chars
                       FROM c, (SELECT '([<\[])(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])' AS k)),
                 u AS (SELECT *, sum(chars) OVER (o ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER o = count(*) OVER (PARTITION BY conv_id) AS last
                       FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
                   CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
                   CAST(sum(upto) FILTER (WHERE role = 'assistant' OR last) AS BIGINT) AS formatted_chars
            FROM u GROUP BY 1""",
        "op12_vector_codes": _vector_codes_sql(),
        "op13_phrase_collocations": fr"""
            WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
                       FROM documents, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) t(piece)),
                 f AS MATERIALIZED (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM d, range(1, 4) s(m), range(1, len(w) - m + 2) t(i) GROUP BY 1, 2, 3),
                 c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
                 h AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS held FROM c, range(1, 3) t(i) WHERE len(w) = 3 GROUP BY 1, 2),
                 k AS (SELECT c.lang, c.phrase, a, w, k FROM c LEFT JOIN h USING (lang, phrase), range(1, len(w)) t(k) WHERE held IS NULL OR 100 * held < 50 * a),
                 s AS (SELECT k.lang, k.phrase, a, k, x.f AS l, y.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
                       FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(w[:k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
                 b AS (SELECT lang, phrase, a, unnest(arg_min({{l: l, r: r, score: score}}, (score, k))) FROM s GROUP BY 1, 2, 3),
                 t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b),
                 n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY 1)
            SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000""",
    }
