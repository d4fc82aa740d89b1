"""The queries of this package, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voluma.llm.licenses import op8_licenses
from voluma.llm.lines import op10_line_dedup
from voluma.llm.mixing import op9_mixing
from voluma.llm.neighbours import op3_neighbours
from voluma.llm.packing import op1_packing
from voluma.llm.quality import op6_quality
from voluma.llm.simhash import op4_simhash
from voluma.llm.substrings import op5_substrings
from voluma.llm.syncmers import op2_syncmers
from voluma.llm.warc import op7_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_syncmers, op3_neighbours, op4_simhash, op5_substrings, op6_quality, op7_warc, op8_licenses, op9_mixing, op10_line_dedup)
}

ORACLES: dict[str, str] = {
    "op10_line_dedup": """
        WITH numbered AS (
            SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS held FROM documents
        ), split AS (
            SELECT r, doc_id, unnest(held) AS line, generate_subscripts(held, 1) AS pos FROM numbered
        ), keyed AS (
            SELECT r, doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM split
        ), hot AS (
            SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT r) >= 3
        ), marked AS (
            SELECT r, doc_id, pos, line, hot.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN hot USING (k)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY r, doc_id
    """,
    "op7_warc": """
        WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        sized AS (SELECT page_id, strlen(payload) AS n, sha256(payload) AS digest, min(page_id) OVER (PARTITION BY payload) AS first FROM payloads)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to
        FROM sized
    """,
    "op5_substrings": r"""
        WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        windows AS (
            SELECT doc_id, p, md5(array_to_string(words[p : p + 49], ' ')) AS h
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS p FROM split WHERE len(words) >= 50)
        ),
        firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
        covered AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 50)) AS q FROM windows JOIN firsts USING (h) WHERE first < doc_id)),
        placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS q FROM split),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS words FROM placed ANTI JOIN covered USING (doc_id, q) GROUP BY doc_id)
        SELECT doc_id, CAST(len(split.words) AS BIGINT) AS n_words, CAST(len(split.words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.words, '')) AS kept_sha256
        FROM split LEFT JOIN kept USING (doc_id)
    """,
}
