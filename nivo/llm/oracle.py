"""DuckDB SQL with the same rows as the queries of this subpackage, where SQL can express them."""

from __future__ import annotations

ORACLES: dict[str, str] = {
    "op1_near_dedup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS shingle
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (
            SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c
            FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY ALL
        ),
        l AS (
            SELECT u, v FROM o JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v
            WHERE 100 * c >= 85 * (a.n + b.n - c)
        ),
        r AS (
            SELECT doc_id AS v, doc_id AS root FROM d
            UNION
            SELECT l.v, r.root FROM r JOIN l ON l.u = r.v
        ),
        m AS (SELECT v AS doc_id, min(root) AS component_id FROM r GROUP BY v)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
    "op4_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ),
        b AS (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ),
        v AS (
            SELECT DISTINCT item, least(len(w), 10) AS n,
                   array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS phrase
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
        ),
        lengths AS (SELECT DISTINCT n FROM v),
        p AS (
            SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
        ),
        m AS (SELECT doc_id, i, n, item FROM p JOIN v USING (n, phrase)),
        h AS (
            SELECT doc_id, count(DISTINCT place) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, i, n FROM m))
            GROUP BY doc_id
        ),
        t AS (
            SELECT doc_id, count(DISTINCT item) AS n_items,
                   string_agg(DISTINCT item, ',' ORDER BY item) AS items
            FROM m GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
    "op6_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY body) AS keep_id,
               count(*) OVER (PARTITION BY body) AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY body) AS kept,
               sha256(body) AS text_sha256
        FROM d
    """,
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        f AS (SELECT page_id, octet_length(encode(body)) AS n, sha256(body) AS digest, body FROM p),
        g AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM f)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
        FROM g
    """,
    "op9_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT)
                       AS size
            FROM documents
        ),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (
            SELECT *, CAST(2 * source_size AS DOUBLE) AS cap,
                   CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1]
                       AS DOUBLE) AS weight
            FROM s
        ),
        b AS (SELECT 1.5::DOUBLE * CAST(sum(source_size) AS DOUBLE) AS budget FROM s),
        l AS (
            SELECT w.*, cap / weight AS ratio,
                   row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS turn,
                   (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
                   / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS attempt
            FROM w, b
        ),
        t AS (
            SELECT source, source_size,
                   least(cap, weight * (SELECT arg_min(attempt, turn) FROM l WHERE ratio >= attempt))
                       AS target
            FROM l
        ),
        q AS (
            SELECT doc_id, size, source_size, target,
                   row_number() OVER (ORDER BY d.source NULLS LAST, h, size) AS place,
                   CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, size
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS reached
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ),
        f AS (
            SELECT doc_id, place, turn, size, (reached + turn * source_size) / target AS finish
            FROM q, (VALUES (0), (1)) AS turns(turn)
            WHERE size > 0
        ),
        r AS (
            SELECT place, size, sum(size) OVER (ORDER BY finish, place, turn
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total
            FROM f
        ),
        k AS (SELECT place, count(*) AS copies FROM r, b WHERE total <= budget GROUP BY place)
        SELECT doc_id, size, source_size, target, size * coalesce(copies, 0) AS taken
        FROM q LEFT JOIN k USING (place)
    """,
    "op11_exact_topk": """
        WITH e AS (
            SELECT vec_id, [floor(1024 * CAST(c AS DOUBLE)) for c in embedding] AS x
            FROM embeddings
            WHERE embedding IS NOT NULL AND len([c for c in embedding if isfinite(c)]) = len(embedding)
        ),
        p AS (
            SELECT q.vec_id AS query_id, e.vec_id, CAST(list_inner_product(q.x, e.x) AS BIGINT) AS score
            FROM e q JOIN e ON q.vec_id <> e.vec_id AND len(q.x) = len(e.x)
            WHERE q.vec_id % 100 = 0
        ),
        r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM p
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op12_importance_resampling": r"""
        WITH steps AS (
            SELECT list(crc ORDER BY b) AS crcs
            FROM (
                SELECT b, list_reduce(range(8),
                           lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS crc
                FROM range(256) bytes(b)
            )
        ),
        d AS (
            SELECT doc_id, regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ),
        b AS (
            SELECT unnest(regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
            FROM benchmark
        ),
        raw AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM d) GROUP BY word),
        target AS (SELECT word, count(*) AS n FROM b GROUP BY word),
        hashed AS (
            SELECT word, xor(4294967295, list_reduce(
                       [CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT) for i in range(len(x) // 2)],
                       lambda c, byte: xor(c >> 8, crcs[(xor(c, byte) & 255) + 1]), CAST(4294967295 AS BIGINT)))
                       % 10000 AS bucket
            FROM (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM raw UNION SELECT word FROM target)),
                 steps
        ),
        s AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS s FROM raw JOIN hashed USING (word) GROUP BY bucket),
        t AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS t FROM target JOIN hashed USING (word) GROUP BY bucket),
        g AS (
            SELECT bucket, CAST(floor(1000.0::DOUBLE * ln(
                       ((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE)
                       / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))
                       AS BIGINT) AS gain
            FROM (SELECT DISTINCT bucket FROM hashed) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
        ),
        p AS (
            SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight
            FROM (SELECT doc_id, unnest(w) AS word FROM d) JOIN hashed USING (word) JOIN g USING (bucket)
            GROUP BY doc_id
        ),
        r AS (
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + CAST(floor(-1000.0::DOUBLE * ln(-ln(
                       (CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:8] AS BIGINT)
                        + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
            FROM d LEFT JOIN p USING (doc_id)
        ),
        q AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
            FROM r WHERE n_features >= 20
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
        FROM r LEFT JOIN q USING (doc_id)
    """,
}
