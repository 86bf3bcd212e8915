"""DuckDB SQL for the registered queries that SQL can express."""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES = {
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op5_line_dedup": f"""
        WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        lines AS (
            SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM parts
        ),
        keyed AS (
            SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ),
        owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key),
        judged AS (SELECT k.*, coalesce(o.owner < k.doc_id, false) AS dropped FROM keyed k LEFT JOIN owners o USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
    "op3_substring_dedup": r"""
        WITH texts AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ),
        starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM texts),
        windows AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS win FROM starts),
        owners AS (SELECT win, min(doc_id) AS owner FROM windows GROUP BY win),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i
            FROM windows JOIN owners USING (win) WHERE owner < doc_id
        ),
        words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM texts),
        kept AS (
            SELECT w.doc_id, count(g.i) AS n_removed, string_agg(w.word, ' ' ORDER BY w.i) FILTER (g.i IS NULL) AS body
            FROM words w LEFT JOIN gone g USING (doc_id, i) GROUP BY w.doc_id
        )
        SELECT t.doc_id, len(t.ws) AS n_words, coalesce(k.n_removed, 0) AS n_removed,
               sha256(coalesce(k.body, '')) AS kept_sha256
        FROM texts t LEFT JOIN kept k USING (doc_id)
    """,
    "op12_lexical_search": r"""
        WITH pattern AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS p),
        docs AS (
            SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p) AS ts
            FROM documents, pattern
        ),
        total AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM docs WHERE len(ts) > 0),
        items AS (
            SELECT item_id, unnest(regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p)) AS term
            FROM benchmark, pattern
        ),
        wanted AS (SELECT item_id, term, count(*) AS times FROM items GROUP BY ALL),
        words AS (SELECT row, doc_id, len(ts) AS n, unnest(ts) AS term FROM docs),
        counted AS (
            SELECT row, doc_id, n, term, count(*) AS tf FROM words
            WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
        ),
        weights AS (
            SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM counted, total GROUP BY term, n_docs
        ),
        scored AS (
            SELECT item_id, row, doc_id, sum(times * w
                * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
            FROM wanted JOIN weights USING (term) JOIN counted USING (term), total
            GROUP BY item_id, row, doc_id
        ),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
            FROM scored WHERE score > 0
        )
        SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20
    """,
}
