"""DuckDB SQL of those queries of this subpackage that SQL can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op1_warc_bundles": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
        ), f AS (
            SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d
        )
        SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
               CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first THEN first END AS refers_to
        FROM p LEFT JOIN f ON p.d = f.d""",
    "op7_preference_chat": """
        WITH t AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i,
                   coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL
        ), a AS (
            SELECT conv_id, max(i) AS spot FROM t WHERE role = 'assistant' GROUP BY conv_id
        ), turns AS (
            SELECT 'c' AS side, t.conv_id, i, role, text FROM t JOIN a ON t.conv_id = a.conv_id
            UNION ALL
            SELECT 'r', t.conv_id, i, role, text FROM t JOIN a ON t.conv_id = a.conv_id WHERE i < spot
            UNION ALL
            SELECT 'r', a.conv_id, a.spot, t.role, t.text
            FROM a JOIN a b ON b.conv_id = a.conv_id + 1 JOIN t ON t.conv_id = b.conv_id AND t.i = b.spot
        ), sizes AS (
            SELECT conv_id, count(*) FILTER (side = 'c') AS n_c, count(*) FILTER (side = 'r') AS n_r FROM turns GROUP BY conv_id
        ), differ AS (
            SELECT c.conv_id, min(c.i) AS i FROM turns c JOIN turns r
            ON c.side = 'c' AND r.side = 'r' AND c.conv_id = r.conv_id AND c.i = r.i AND (c.role <> r.role OR c.text <> r.text)
            GROUP BY c.conv_id
        ), prefix AS (
            SELECT s.conv_id, coalesce(d.i, least(n_c, n_r)) AS k FROM sizes s LEFT JOIN differ d ON s.conv_id = d.conv_id
        ), shown AS (
            SELECT CASE WHEN i < k THEN CASE side WHEN 'c' THEN 'p' ELSE 'x' END ELSE side END AS part, turns.conv_id, i, role,
                   '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body
            FROM turns JOIN prefix ON turns.conv_id = prefix.conv_id
        ), placed AS (
            SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, part ORDER BY i) AS fin FROM shown
        ), parts AS (
            SELECT conv_id, part, string_agg(head || body, '' ORDER BY i) AS said,
                   string_agg(CASE WHEN role = 'assistant' THEN (fin - length(body))::BIGINT || '-' || fin::BIGINT END, ',' ORDER BY i) AS mask
            FROM placed GROUP BY conv_id, part
        )
        SELECT x.conv_id, x.k::BIGINT AS prompt_turns, coalesce(p.said, '') AS prompt,
               coalesce(c.said, '') AS chosen_completion, coalesce(c.mask, '') AS chosen_mask,
               coalesce(r.said, '') AS rejected_completion, coalesce(r.mask, '') AS rejected_mask
        FROM prefix x
        LEFT JOIN parts p ON p.conv_id = x.conv_id AND p.part = 'p'
        LEFT JOIN parts c ON c.conv_id = x.conv_id AND c.part = 'c'
        LEFT JOIN parts r ON r.conv_id = x.conv_id AND r.part = 'r'""",
    "op9_decontamination": f"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS k, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
        ), b AS (
            SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
        ), windows AS (
            SELECT DISTINCT item_id, w[s + 1:s + 10] AS win
            FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - 9))) AS s FROM b WHERE len(w) > 0)
        ), lengths AS (
            SELECT DISTINCT len(win) AS n FROM windows
        ), starts AS (
            SELECT k, s, n, w[s + 1:s + n] AS win FROM (SELECT k, w, n, unnest(range(greatest(0, len(w) - n + 1))) AS s FROM d, lengths)
        ), hits AS (
            SELECT k, s, n, item_id FROM starts JOIN windows USING (win)
        ), covered AS (
            SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT k, s, n FROM hits)) GROUP BY k
        ), items AS (
            SELECT k, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS list
            FROM (SELECT DISTINCT k, item_id::VARCHAR AS item_id FROM hits) GROUP BY k
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (k) LEFT JOIN items USING (k)""",
}
