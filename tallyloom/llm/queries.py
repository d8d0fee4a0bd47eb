"""The registered queries of the training-data operators: thin forms of the operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import licenses


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.simhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), words=3, most=2).select("doc_id", "fingerprint", "component_id")


#: Not a secret: these tables are synthetic. Callers of the operator bring their own.
PII_KEY = "synthetic-tables-only"


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.pii import replace_checked

    return replace_checked(_read(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text", "n_entities")


def op3_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.paragraphs import duplicate_paragraphs

    return duplicate_paragraphs(_read(spark, sf_dir, "documents"), 0.8)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.quality import held_out, score, train

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, _read(spark, sf_dir, "labels"), ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.chat import chat_digest, format_conversations, with_probe

    return chat_digest(format_conversations(with_probe(_read(spark, sf_dir, "conversations"), spark)))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.suffix import repeated_spans, span_digest

    return span_digest(repeated_spans(_read(spark, sf_dir, "documents"), 50))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tallyloom.llm.topk import quantised, top_k

    return top_k(quantised(_read(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, 5)


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tallyloom.llm.bpe import round_trip_digest

    return round_trip_digest(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.lm import score_documents

    return score_documents(_read(spark, sf_dir, "documents"), order=3, least=2)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.decontaminate import contamination_digest, find_contamination

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination_digest(find_contamination(docs, _read(spark, sf_dir, "benchmark"), size=10))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.licenses import scan_licenses

    found = scan_licenses(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tallyloom.llm.alignment import align

    return align(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.lexical import search

    return search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), 20)


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_pii_surrogates,
        op3_paragraph_dedup,
        op4_quality_classifier,
        op5_chat_formatting,
        op6_suffix_array_dedup,
        op7_exact_top_k,
        op8_bpe_transducer,
        op9_lm_scoring,
        op10_benchmark_decontamination,
        op11_license_scan,
        op12_token_alignment,
        op13_lexical_search,
    )
}
ORACLES: dict[str, str] = {
    "op5_chat_formatting": """
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, regexp_replace(text, '([<\\[])(\\\\*)(/?s>|</?SYS>>|/?INST\\]|/?ROLE\\]|END\\])', '\\1\\\\\\2\\3', 'g') AS x,
                     CASE role WHEN 'assistant' THEN 4 WHEN 'user' THEN 13 WHEN 'system' THEN 15
                               ELSE 18 + length(role) END AS marks FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(3 + sum(length(x) + marks) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op7_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS t FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, least(len(q.t), len(c.t)) + 1), lambda i: q.t[i] * c.t[i])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op11_license_scan": licenses.oracle(),
    "op13_lexical_search": """
        WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
        d AS (SELECT row_number() OVER () AS row, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0),
        total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
        tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM d) GROUP BY ALL),
        weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
        asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY ALL),
        s AS (SELECT item_id, row, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
              FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN d USING (row), total GROUP BY ALL),
        r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s JOIN d USING (row) WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
    """,
}
