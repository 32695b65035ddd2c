"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op5_bpe_encoding
from .merkle import op2_merkle_fingerprints
from .mixing import op4_mixing
from .quality import op7_perplexity_rules
from .repeats import op8_suffix_array_dedup, op10_substring_dedup
from .sharding import op6_external_shuffle
from .simhash import op1_simhash_near_dedup
from .toxicity import op9_toxicity
from .warc import op3_warc_zstd

QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_merkle_fingerprints, op3_warc_zstd, op4_mixing, op5_bpe_encoding, op6_external_shuffle, op7_perplexity_rules, op8_suffix_array_dedup, op9_toxicity, op10_substring_dedup)}

#: The other queries depend on models, seeded draws, a tokenizer or XXH64, which SQL can't express.
ORACLE_SQL: dict[str, str] = {
    # Hex digits by fives are 20 bits, four characters of base32.
    "op3_warc_zstd": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     q AS (SELECT page_id, body, max(page_id) OVER (PARTITION BY body) AS response, sha1(body) AS hex FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4))) & 31), 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM q
""",
    # Windows of 200 bytes found more than once; runs of them; what is left between the runs.
    "op8_suffix_array_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
     w AS (SELECT doc_id, i, array_slice(b, i, i + 199) AS g FROM (SELECT doc_id, b, unnest(range(1, n - 198)) AS i FROM d)),
     m AS (SELECT doc_id, i FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)),
     s AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS opens FROM m),
     t AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
     r AS (SELECT doc_id, min(i) AS a, max(i) + 199 AS z FROM t GROUP BY doc_id, run),
     k AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS a, a - 1 AS z, z - a + 1 AS removed FROM r
           UNION ALL SELECT d.doc_id, coalesce(max(r.z), 0) + 1, any_value(d.n), 0 FROM d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, any_value(d.n)::BIGINT AS n_bytes, sum(k.removed)::BIGINT AS n_removed, (count(*) - 1)::BIGINT AS n_spans,
       sha256(unhex(string_agg(CASE WHEN k.a <= k.z THEN hex(array_slice(d.b, k.a, k.z)) ELSE '' END, '' ORDER BY k.a))) AS kept_sha256
FROM d JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id
""",
    # Windows of 13 words and the smallest doc_id of each; the words that no later copy covers.
    "op10_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
     w AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d)),
     m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM w),
     r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM m WHERE first < doc_id),
     x AS (SELECT doc_id, words[j] AS word, j FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS j FROM d)),
     k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text FROM x ANTI JOIN r USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, (len(d.words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
""",
}
