"""One registered query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millpond.llm.common import table

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from millpond.llm.bpe import digests

    return digests(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    from millpond.llm.warc import archive_and_read

    return archive_and_read(spark, table(spark, folder, "pages"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    from millpond.llm.quality import judge

    return judge(table(spark, folder, "documents")).drop("_hash")


def op5_hilbert(spark: SparkSession, folder: str) -> DataFrame:
    from millpond.llm.sharding import hilbert_shards

    return hilbert_shards(table(spark, folder, "documents"))


def op10_urls(spark: SparkSession, folder: str) -> DataFrame:
    from millpond.llm.urls import judge

    return judge(table(spark, folder, "pages"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from millpond.llm.toxicity import score

    return score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    from millpond.llm.language import identify

    return identify(table(spark, folder, "documents"))


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    from millpond.llm.pii import report

    return report(table(spark, folder, "documents"))


def op8_neardup(spark: SparkSession, folder: str) -> DataFrame:
    from millpond.llm.neardup import report

    return report(table(spark, folder, "documents"))


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    from millpond.llm.decontaminate import leaks

    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    from millpond.llm.whitening import report

    return report(table(spark, folder, "embeddings"))


def op12_chat(spark: SparkSession, folder: str) -> DataFrame:
    from millpond.llm.chat import report

    return report(table(spark, folder, "conversations"))


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from millpond.llm.alignment import report

    return report(table(spark, folder, "documents"), public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_TOKENIZER))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_warc": op2_warc,
    "op4_quality": op4_quality,
    "op5_hilbert": op5_hilbert,
    "op10_urls": op10_urls,
    "op6_toxicity": op6_toxicity,
    "op9_language": op9_language,
    "op7_pii": op7_pii,
    "op8_neardup": op8_neardup,
    "op3_decontaminate": op3_decontaminate,
    "op11_whitening": op11_whitening,
    "op12_chat": op12_chat,
    "op13_alignment": op13_alignment,
}
SQL: dict[str, str] = {
    "op4_quality": r"""
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
              FROM d),
        g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
              FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
        again AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
        covered AS (SELECT r, count(DISTINCT i + j) AS n FROM again, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r),
        l AS (SELECT r, host, sig, len_line, line FROM (
                SELECT r, host, sig, length(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS len_line,
                       lower(regexp_replace(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
                FROM (SELECT r, host, md5(lower(array_to_string(words, ' '))) AS sig, unnest(lines) AS x FROM w))),
        hosts AS (SELECT host, count(DISTINCT md5(lower(array_to_string(words, ' ')))) AS docs FROM w GROUP BY host),
        often AS (SELECT host, line FROM l JOIN hosts USING (host) GROUP BY host, line, docs
                  HAVING count(DISTINCT sig) > 20 AND (count(DISTINCT sig) > 200 OR 100 * count(DISTINCT sig) > 2 * docs)),
        lost AS (SELECT r, sum(len_line) AS total, sum(CASE WHEN o.line IS NOT NULL THEN len_line ELSE 0 END) AS gone
                 FROM l LEFT JOIN often o ON o.host = l.host AND o.line = l.line GROUP BY r),
        m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                     length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                     CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                     coalesce(n, 0) AS n_repeat_words, coalesce(100 * gone > 70 * total, false) AS depleted
              FROM w LEFT JOIN covered USING (r) LEFT JOIN lost USING (r))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT depleted AS kept
        FROM m""",
    "op2_warc": """
        WITH p AS (
          SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
          FROM pages),
        g AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN keeper <> page_id THEN keeper END AS refers_to
        FROM p LEFT JOIN g USING (payload_digest)""",
    "op12_chat": r"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
          UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, '([<\[])(\\*/?(?:s>|SYS>>|INST\]|ROLE\]|TURN\]))' AS control FROM t),
        m AS (
          SELECT conv_id, turn, role, text,
                 length(regexp_replace(text, control, '\1\\\2', 'g'))
                 + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
                        ELSE 20 + length(regexp_replace(role, control, '\1\\\2', 'g')) END AS chars
          FROM e),
        g AS (
          SELECT conv_id, count(*) AS n_turns, sum(chars) AS chars,
                 string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
                 coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss
          FROM m GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
               CAST(chars AS BIGINT) AS formatted_chars
        FROM g""",
}
