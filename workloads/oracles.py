"""The expected result of each query, computed by SQL from the keys of the tables."""

from __future__ import annotations

HOST = "https://site.example.org"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# every link of the star site with its target and tag
STAR = """
star AS (
  SELECT concat('nations/n', n_nationkey, '.md') AS doc_path, 3 AS doc_line,
         concat('../regions/r', n_regionkey, '.md') AS link, 0 AS pos, 'path' AS kind,
         concat('regions/r', n_regionkey, '.md') AS target, CAST(NULL AS VARCHAR) AS fragment,
         CASE WHEN r_regionkey IS NULL THEN 'NO_DOC' ELSE 'OK' END AS tag
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT concat('customers/c', c_custkey, '.md'), 3,
         CASE c_custkey % 7
           WHEN 0 THEN concat('../nations/n', c_nationkey, '.md#details')
           WHEN 1 THEN concat('../nations/n', c_nationkey, '.md#details-1')
           WHEN 2 THEN concat('../nations/n', c_nationkey, '.md#DETAILS')
           WHEN 3 THEN concat('../nations/n', c_nationkey, '-gone.md#details')
           WHEN 4 THEN concat('/nations/n', c_nationkey, '.md')
           WHEN 5 THEN concat('mailto:nations/n', c_nationkey, '@example.org')
           ELSE concat('../nations/n', c_nationkey, '.md#details-2') END, 0,
         CASE c_custkey % 7 WHEN 4 THEN 'absolute' WHEN 5 THEN 'url' ELSE 'path' END,
         CASE c_custkey % 7 WHEN 3 THEN concat('nations/n', c_nationkey, '-gone.md')
           WHEN 5 THEN concat('mailto:nations/n', c_nationkey, '@example.org')
           ELSE concat('nations/n', c_nationkey, '.md') END,
         CASE c_custkey % 7 WHEN 0 THEN 'details' WHEN 1 THEN 'details-1' WHEN 2 THEN 'DETAILS'
           WHEN 3 THEN 'details' WHEN 6 THEN 'details-2' END,
         CASE c_custkey % 7 WHEN 3 THEN 'NO_DOC' WHEN 4 THEN 'ABSOLUTE' WHEN 5 THEN 'PROTOCOL'
           ELSE CASE WHEN n_nationkey IS NULL THEN 'NO_DOC' ELSE
             CASE c_custkey % 7 WHEN 2 THEN 'CASE_FRAG' WHEN 6 THEN 'NO_FRAG' ELSE 'OK' END END END
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT concat('customers/c', c_custkey, '.md'), 4, '../nations/', 1, 'path', 'nations', NULL, 'DIR' FROM customer
  UNION ALL
  SELECT concat('orders/o', o_orderkey, '.md'), 4, concat('../customers/c', o_custkey, '.md#customer-', o_custkey), 0,
         'path', concat('customers/c', o_custkey, '.md'), concat('customer-', o_custkey),
         CASE WHEN c_custkey IS NULL THEN 'NO_DOC' ELSE 'OK' END
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
)"""

# every link to a web page: page key, whether it has a fragment, and the state of the page
PAGE_LINKS = f"""
page_links AS (
  SELECT concat('web/w', page_id, '.md') AS doc_path, 1 AS doc_line, '{HOST}/p/' AS base, page_id AS k, true AS frag FROM pages
  UNION ALL
  SELECT concat('web/w', page_id, '.md'), 2, '{HOST}/p/', page_id, false FROM pages
  UNION ALL
  SELECT concat('events/e', event_id, '.md'), 1, 'HTTPS://Site.Example.Org:443/x/../p/', user_id % 4, true FROM events
),
states AS (
  SELECT l.*, p.html, (p.page_id IS NOT NULL) AS fetched, (n.page_id IS NOT NULL) AS has_next, (b.page_id IS NOT NULL) AS has_back
  FROM page_links l LEFT JOIN pages p ON l.k = p.page_id LEFT JOIN pages n ON l.k + 1 = n.page_id
       LEFT JOIN pages b ON l.k - 5 = b.page_id
)"""


def _page_tag(follow: bool, found: str, found_next: str) -> str:
    after_hop = f"CASE WHEN frag THEN {found_next} ELSE 'OK' END" if follow else "'HTTP_301'"
    return f"""CASE WHEN NOT fetched THEN 'HTTP_OTH' ELSE CASE k % 10
      WHEN 1 THEN CASE WHEN has_next THEN {after_hop} ELSE 'HTTP_OTH' END
      WHEN 3 THEN 'HTTP_404' WHEN 4 THEN 'TIMEOUT' WHEN 5 THEN 'NO_MIME'
      WHEN 6 THEN CASE WHEN frag THEN 'NO_FRAG' ELSE 'OK' END WHEN 7 THEN 'MIME'
      WHEN 8 THEN CASE WHEN has_back THEN 'HTTP_404' ELSE 'HTTP_OTH' END WHEN 9 THEN 'HTTP_OTH'
      ELSE CASE WHEN frag THEN {found} ELSE 'OK' END END END"""


# every part as a URL in a block of eight
BLOCKS = f"""
blocks AS (
  SELECT p_partkey AS k, p_partkey % 8 AS j, (p_partkey // 8) % 5 = 0 AS loop,
         p_partkey - p_partkey % 8 + 7 AS last,
         CASE WHEN p_partkey % 3 = 0 THEN 302 ELSE 301 END AS status,
         concat('parts/p', p_partkey, '.md') AS doc_path,
         concat('{HOST}/r/', p_partkey) AS url
  FROM part
)"""

TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


def _unescaped(text: str) -> str:
    sql = text
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        sql = f"replace({sql}, '{entity}', '{char}')"
    return sql


HREFS = """
hrefs AS (
  SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS pos
  FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)
)"""

ORACLES: dict[str, str] = {
    "extract_links": """
      WITH d AS (SELECT concat('docs/d', doc_id, '.md') AS doc_path, doc_id, source, lang,
                        length(text) - length(replace(text, chr(10), '')) AS n FROM documents)
      SELECT doc_path, CAST(n + 5 AS INTEGER) AS doc_line, concat('d', doc_id + 1, '.md#doc-', doc_id + 1) AS link, 0 AS pos FROM d
      UNION ALL SELECT doc_path, CAST(n + 7 AS INTEGER), concat('s p/', source, '.md'), 1 FROM d
      UNION ALL SELECT doc_path, CAST(n + 8 AS INTEGER), concat('outer-', lang, '.md'), 2 FROM d""",
    "extract_ref_links": """
      WITH c AS (SELECT concat('customers/c', c_custkey, '.md') AS doc_path, c_nationkey, c_mktsegment FROM customer)
      SELECT doc_path, 1 AS doc_line, concat('../nations/n', c_nationkey, '.md') AS link, pos FROM c, (VALUES (0), (1), (2)) v(pos)
      UNION ALL SELECT doc_path, 3, concat('segments/', c_mktsegment, '.md'), 3 FROM c""",
    "extract_autolinks": """
      WITH c AS (SELECT concat('customers/c', c_custkey, '.md') AS doc_path, c_custkey FROM customer)
      SELECT doc_path, 1 AS doc_line, concat('https://example.org/c?id=', c_custkey, '&x=1') AS link, 0 AS pos FROM c
      UNION ALL SELECT doc_path, 1, concat('c', c_custkey, '@example.org'), 1 FROM c
      UNION ALL SELECT doc_path, 2, 'b.md', 2 FROM c""",
    "extract_skip_code": """
      WITH o AS (SELECT concat('orders/o', o_orderkey, '.md') AS doc_path, o_orderkey AS k, o_orderkey % 3 = 0 AS fenced FROM orders)
      SELECT doc_path, 3 AS doc_line, concat('a', k, '.md') AS link, 0 AS pos FROM o WHERE NOT fenced
      UNION ALL SELECT doc_path, CASE WHEN fenced THEN 9 ELSE 7 END, concat('b', k, '.md'), CASE WHEN fenced THEN 0 ELSE 1 END FROM o
      UNION ALL SELECT doc_path, CASE WHEN fenced THEN 18 ELSE 16 END, concat('c', k, '.md'), CASE WHEN fenced THEN 1 ELSE 2 END FROM o""",
    "extract_nav": f"""
      WITH {HREFS}
      SELECT concat('nav/', page_id, '.md') AS doc_path, CAST(3 + pos AS INTEGER) AS doc_line, {_unescaped('href')} AS link,
             CAST(pos AS INTEGER) AS pos FROM hrefs""",
    "extract_only": f"WITH {STAR} SELECT concat(doc_path, ':', doc_line, ':  ', link) AS line FROM star",
    "heading_texts": """
      WITH p AS (SELECT concat('parts/p', p_partkey, '.md') AS path, * FROM part)
      SELECT path, 0 AS pos, concat('The ', p_name, ' of ', p_brand, ' & `', p_type, '_`') AS text FROM p
      UNION ALL SELECT path, 1, concat(p_name, 'and ', p_brand) FROM p
      UNION ALL SELECT path, 2, concat('snake_case ', p_size) FROM p""",
    "heading_slugs": f"""
      SELECT concat('nav/', page_id, '.md') AS path,
             translate(regexp_replace({_unescaped(f'trim({TITLE})')}, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}} -]', '', 'g'),
                       '{UPPER} ', '{LOWER}-') AS slug
      FROM pages""",
    "heading_repeats": """
      WITH h AS (
        SELECT path, unnest(t) AS text, generate_subscripts(t, 1) - 1 AS pos FROM (
          SELECT concat('parts/p', p_partkey, '.md') AS path,
                 [p_name, p_brand, p_name, p_type, p_brand, p_name, upper(p_name), concat(p_name, '!')] AS t FROM part))
      SELECT path, CAST(pos AS INTEGER) AS pos, text,
             CAST(row_number() OVER (PARTITION BY path, text ORDER BY pos) - 1 AS INTEGER) AS nth FROM h""",
    "anchor_listing": f"""
      SELECT concat('regions/r', r_regionkey, '.md') AS target, translate(r_name, '{UPPER} ', '{LOWER}-') AS anchors FROM region
      UNION ALL SELECT concat('nations/n', n_nationkey, '.md'), concat('details,details-1,', translate(n_name, '{UPPER} ', '{LOWER}-')) FROM nation
      UNION ALL SELECT concat('customers/c', c_custkey, '.md'), concat('customer-', c_custkey) FROM customer
      UNION ALL SELECT concat('orders/o', o_orderkey, '.md'), concat('order-', o_orderkey) FROM orders""",
    "html_anchors": f"""
      WITH p AS (SELECT concat('{HOST}/p/', page_id) AS target, page_id, html FROM pages WHERE page_id % 10 IN (0, 2))
      SELECT target, concat('user-content-top-', page_id) AS anchor FROM p WHERE contains(html, '<h1>')
      UNION ALL SELECT target, concat('ad-', page_id) FROM p WHERE contains(html, '<div class="ad">')
      UNION ALL SELECT target, concat('nav-', page_id % 5) FROM p WHERE contains(html, '<nav>')
      UNION ALL SELECT target, concat('s-', page_id) FROM p WHERE contains(html, '<script>')""",
    "content_dispatch": f"""
      SELECT concat('{HOST}/p/', page_id) AS url,
             CASE page_id % 5 WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'application/xhtml+xml' WHEN 4 THEN NULL ELSE 'text/html' END AS media_type,
             CAST(CASE page_id % 5 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 4 THEN 0 ELSE
               CAST(contains(html, '<h1>') AS INTEGER) + CAST(contains(html, '<div class="ad">') AS INTEGER)
               + CAST(contains(html, '<nav>') AS INTEGER) + CAST(contains(html, '<script>') AS INTEGER) END AS INTEGER) AS n_anchors
      FROM pages""",
    "decode_body": "SELECT doc_id, md5(text) AS digest FROM documents",
    "decode_labelled": """
      WITH d AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7f]', '', 'g') AS t FROM documents)
      SELECT doc_id, md5(CASE doc_id % 6
        WHEN 0 THEN translate(t, 'abcdefghijklmnopqrstuvwxyz', 'абцдефгхийклмнопярстужвьыз') || '╔'
        WHEN 1 THEN translate(t, 'abcdefghijklmnopqrstuvwxyz', 'абвгдежзийклмнопрстуфхцчшщ') || 'Ґ'
        WHEN 2 THEN translate(t, 'abcdefghijklmnopqrstuvwxyz', 'абвгдежзийклмнопрстуфхцчшщ') || 'Ѕ'
        WHEN 3 THEN translate(t, 'abcdefghijklmnopqrstuvwxyz', 'αβγδεζηθικλμνξοπρςστυφχψωϊ') || '₯'
        WHEN 4 THEN translate(t, 'abcdefghijklmnopqrstuvwxyz', 'АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩ') || 'е'
        ELSE t || 'Ą' END) AS digest FROM d""",
    "decode_broken": """
      SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN concat(text, chr(65533)) WHEN 1 THEN concat(text, chr(65533), 'A')
                         ELSE concat(chr(65533), text) END) AS digest FROM documents""",
    "extract_long_blocks": """
      SELECT concat('docs/d', doc_id, '.md') AS doc_path, l.doc_line, concat(l.name, '-', doc_id, '.md') AS link, l.pos
      FROM documents, (VALUES (4, 'long', 0), (7, 'in', 1), (9, 'n', 2)) AS l(doc_line, name, pos)""",
    "extract_containers": """
      WITH d AS (SELECT concat('docs/d', doc_id, '.md') AS doc_path, doc_id, lang,
                        length(text) - length(replace(text, chr(10), '')) AS n FROM documents)
      SELECT doc_path, 1 AS doc_line, concat('in-', doc_id, '.md') AS link, 0 AS pos FROM d
      UNION ALL SELECT doc_path, CAST(n + 7 AS INTEGER), concat('out-', lang, '.md'), 1 FROM d""",
    "heading_containers": """
      WITH d AS (SELECT concat('docs/d', doc_id, '.md') AS path, doc_id, lang, source FROM documents)
      SELECT path, 0 AS pos, concat('T', doc_id, lang) AS text FROM d
      UNION ALL SELECT path, 1, concat('L', doc_id) FROM d
      UNION ALL SELECT path, 2, concat('S', source) FROM d
      UNION ALL SELECT path, 3, concat('N', lang) FROM d""",
    "heading_references": """
      WITH p AS (SELECT concat('parts/p', p_partkey, '.md') AS path, p_name, p_size, p_brand FROM part)
      SELECT path, 0 AS pos, concat('[x][y] ', p_name) AS text FROM p
      UNION ALL SELECT path, 1, concat('See docs ', p_size) FROM p
      UNION ALL SELECT path, 2, concat('a b i [j] k [', p_brand, ']') FROM p
      UNION ALL SELECT path, 3, '[a b c](d) docs' FROM p""",
    "check_hot_keys": """
      SELECT concat('types/', event_type, '.md#', CASE event_id % 3 WHEN 0 THEN 'top' WHEN 1 THEN 'TOP' ELSE 'gone' END) AS link,
             CASE event_id % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'CASE_FRAG' ELSE 'NO_FRAG' END AS tag, count(*) AS n_links
      FROM events GROUP BY ALL""",
    "unreadable_sources": """
      SELECT concat('docs/d', doc_id) AS source, CASE doc_id % 5 WHEN 0 THEN 'NOT_UTF8' ELSE 'denied' END AS reason
      FROM documents WHERE doc_id % 5 IN (0, 1)""",
    "target_kinds": """
      WITH c AS (SELECT c_custkey AS c, c_nationkey AS n, c_custkey % 12 AS v, concat('customers/c', c_custkey, '.md') AS doc_path FROM customer)
      SELECT doc_path,
        CASE WHEN v IN (0, 6, 7, 8, 10) THEN 'url' WHEN v IN (4, 5) THEN 'absolute' ELSE 'path' END AS kind,
        CASE v WHEN 0 THEN 'http://example.org/c/n?q=1' WHEN 1 THEN concat('nations/n', n, '.md')
          WHEN 2 THEN concat('customers/c', c, '.md?q') WHEN 3 THEN doc_path WHEN 4 THEN concat('abs/', n)
          WHEN 5 THEN concat('host/', n) WHEN 6 THEN concat('mailto:c', c, '@example.org') WHEN 7 THEN NULL WHEN 8 THEN NULL
          WHEN 9 THEN concat('../n', n, '.md') WHEN 10 THEN concat('ftp://h/', n, '%20/%C3%A9') ELSE doc_path END AS target,
        CASE v WHEN 0 THEN concat('F-', n) WHEN 1 THEN '' WHEN 3 THEN 'top' WHEN 4 THEN 'x#y' END AS fragment,
        CASE v WHEN 7 THEN 'EMPTY_HOST' WHEN 8 THEN 'BAD_PORT' END AS reject
      FROM c""",
    "rejected_links": """
      SELECT concat('customers/c', c_custkey, '.md:2') AS source,
             CASE c_custkey % 4 WHEN 0 THEN 'http:///' ELSE 'https://h:port/' END AS value,
             CASE c_custkey % 4 WHEN 0 THEN 'EMPTY_HOST' ELSE 'BAD_PORT' END AS reason
      FROM customer WHERE c_custkey % 4 IN (0, 1)""",
    "normalize_urls": "SELECT page_id, regexp_replace(url, '#.*$', '') AS key FROM pages",
    "distinct_targets": f"""
      WITH {STAR}
      SELECT kind, target, count(DISTINCT coalesce('#' || fragment, '')) AS n_fragments, count(*) AS n_links
      FROM star GROUP BY kind, target""",
    "rewrite_links": f"""
      WITH {STAR}
      SELECT doc_path, doc_line, regexp_replace(link, '\\.\\./([a-z]+)/', 'https://new.example.org/\\1/') AS link, pos FROM star""",
    "inventory": """
      SELECT concat('regions/r', r_regionkey, '.md') AS target, false AS is_dir FROM region
      UNION ALL SELECT concat('nations/n', n_nationkey, '.md'), false FROM nation
      UNION ALL SELECT concat('customers/c', c_custkey, '.md'), false FROM customer
      UNION ALL SELECT concat('orders/o', o_orderkey, '.md'), false FROM orders
      UNION ALL SELECT * FROM (VALUES ('', true), ('regions', true), ('nations', true), ('customers', true), ('orders', true))""",
    "check_local": f"WITH {STAR} SELECT doc_path, doc_line, link, tag FROM star",
    "check_corpus": """
      WITH d AS (SELECT concat('docs/d', a.doc_id, '.md') AS doc_path, a.doc_id, a.source, a.lang, b.doc_id AS next_id,
                        length(a.text) - length(replace(a.text, chr(10), '')) AS n
                 FROM documents a LEFT JOIN documents b ON a.doc_id + 1 = b.doc_id)
      SELECT doc_path, CAST(n + 5 AS INTEGER) AS doc_line, concat('d', doc_id + 1, '.md#doc-', doc_id + 1) AS link,
             CASE WHEN next_id IS NULL THEN 'NO_DOC' ELSE 'OK' END AS tag FROM d
      UNION ALL SELECT doc_path, CAST(n + 7 AS INTEGER), concat('s p/', source, '.md'), 'NO_DOC' FROM d
      UNION ALL SELECT doc_path, CAST(n + 8 AS INTEGER), concat('outer-', lang, '.md'), 'NO_DOC' FROM d""",
    "check_root": f"""
      WITH {STAR}
      SELECT doc_path, doc_line, link, CASE WHEN tag = 'ABSOLUTE' THEN
               CASE WHEN n_nationkey IS NULL THEN 'NO_DOC' ELSE 'OK' END ELSE tag END AS tag
      FROM star LEFT JOIN nation ON tag = 'ABSOLUTE' AND link = concat('/nations/n', n_nationkey, '.md')""",
    "check_urldecode": """
      WITH c AS (SELECT concat('customers/c', c_custkey, '.md') AS doc_path, c_custkey AS c, c_custkey % 4 AS v FROM customer)
      SELECT doc_path, 3 AS doc_line, concat('c', c, CASE v WHEN 0 THEN '.md' WHEN 1 THEN '%2Emd' WHEN 2 THEN '%2' ELSE '%2Bmd' END) AS link,
             CASE WHEN v < 2 THEN 'OK' ELSE 'NO_DOC' END AS tag FROM c
      UNION ALL SELECT doc_path, 4, '..%2Fcustomers', 'IO_ERR' FROM c""",
    "check_prefix": """
      WITH p AS (SELECT concat('parts/p', p_partkey, '.md') AS doc_path, p_size AS s, lower(replace(p_brand, '#', '')) AS b FROM part)
      SELECT doc_path, 4 AS doc_line, concat('#', s) AS link, 'PREFIXED' AS tag FROM p
      UNION ALL SELECT doc_path, 5, concat('#plain-', b), 'OK' FROM p
      UNION ALL SELECT doc_path, 6, concat('#USER-CONTENT-', s), 'CASE_FRAG' FROM p
      UNION ALL SELECT doc_path, 7, concat('#', s, 'x'), 'NO_FRAG' FROM p
      UNION ALL SELECT doc_path, 8, concat('#Content-', s), 'CASE_FRAG' FROM p""",
    "check_remote": f"""
      WITH {PAGE_LINKS}
      SELECT doc_path, doc_line, concat(base, k, CASE WHEN frag THEN concat('#user-content-top-', k) ELSE '' END) AS link,
             {_page_tag(False, "CASE WHEN contains(html, '<h1>') THEN 'OK' ELSE 'NO_FRAG' END", "''")} AS tag
      FROM states""",
    "check_remote_follow": f"""
      WITH {PAGE_LINKS}
      SELECT doc_path, doc_line, concat(base, k, CASE WHEN frag THEN concat('#NAV-', k % 5) ELSE '' END) AS link,
             {_page_tag(True, "CASE WHEN contains(html, '<nav>') THEN 'CASE_FRAG' ELSE 'NO_FRAG' END", "'NO_FRAG'")} AS tag
      FROM states""",
    "redirect_chains": f"""
      WITH {BLOCKS}
      SELECT url, CASE WHEN NOT loop THEN CAST(7 - j AS INTEGER) END AS n_hops,
             CASE WHEN NOT loop THEN concat('{HOST}/r/', last) END AS final_url,
             CASE WHEN loop OR j < 7 THEN status END AS first_status,
             CASE WHEN loop THEN 'redirects' END AS error
      FROM blocks""",
    "redirects_follow": f"""
      WITH {BLOCKS}
      SELECT doc_path, 1 AS doc_line, concat(url, '#x', last) AS link, CASE WHEN loop THEN 'HTTP_OTH' ELSE 'OK' END AS tag FROM blocks""",
    "redirects_nofollow": f"""
      WITH {BLOCKS}
      SELECT doc_path, 1 AS doc_line, concat(url, '#x', last) AS link,
             CASE WHEN loop THEN 'HTTP_OTH' WHEN j = 7 THEN 'OK' ELSE concat('HTTP_', status) END AS tag FROM blocks""",
    "report_roundtrip": """
      SELECT concat('orders/o:', o_orderkey, ':', o_custkey % 90 + 1, ':  ../customers/c', o_custkey, '.md') AS line
      FROM orders WHERE o_orderkey % 3 <> 2""",
    "malformed_lines": """
      SELECT o_orderkey AS line_no,
             concat('o', CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ':' END, o_custkey,
                    CASE WHEN o_orderkey % 5 = 0 THEN ' OK ' ELSE ': OK ' END, 'x.md') AS value,
             'invalid record format' AS reason
      FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 5 = 0""",
    "malformed_files": """
      WITH l AS (SELECT o_orderkey AS k, CAST(o_orderkey % 23 AS INTEGER) AS part,
                        row_number() OVER (PARTITION BY o_orderkey % 23 ORDER BY o_orderkey) AS line_no,
                        CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '30000000' END || CAST(o_custkey + 10000 AS VARCHAR) AS n FROM orders)
      SELECT part, line_no, CASE WHEN k % 6 <> 0 THEN CAST(n AS BIGINT) END AS doc_line,
             CASE WHEN k % 6 <> 0 THEN concat('x.md', repeat(chr(13), CAST(greatest(k % 3 - 1, 0) AS INTEGER)))
                  ELSE concat('o:', n, ': OK x.md', repeat(chr(13), CAST(k % 3 AS INTEGER)), ' y') END AS value
      FROM l""",
    "mute_report": f"""
      WITH {STAR} SELECT concat(doc_path, ':', doc_line, ': ', tag, ' ', link) AS line FROM star
      WHERE tag NOT IN ('OK', 'DIR', 'CASE_FRAG')""",
    "links_only": f"WITH {STAR} SELECT link AS line FROM star WHERE tag <> 'OK'",
    "tag_lookup": f"""
      WITH {PAGE_LINKS},
      tagged AS (SELECT {_page_tag(False, "CASE WHEN contains(html, '<script>') THEN 'OK' ELSE 'NO_FRAG' END", "''")} AS tag FROM states)
      SELECT tag, CASE tag WHEN 'OK' THEN 'Ok' WHEN 'HTTP_OTH' THEN 'HTTP error' WHEN 'TIMEOUT' THEN 'Timeout'
               WHEN 'HTTP_301' THEN 'Unexpected HTTP status 301 Moved Permanently' WHEN 'HTTP_404' THEN 'Unexpected HTTP status 404 Not Found'
               WHEN 'NO_MIME' THEN 'No mime type' WHEN 'MIME' THEN 'Unrecognized mime type' WHEN 'NO_FRAG' THEN 'Fragment not found' END AS description,
             CASE tag WHEN 'HTTP_301' THEN 301 WHEN 'HTTP_404' THEN 404 END AS http_status, count(*) AS n_links
      FROM tagged GROUP BY tag""",
    "details": f"""
      WITH {STAR}, bad AS (SELECT * FROM star WHERE tag <> 'OK')
      SELECT doc_path, doc_line, tag, 0 AS n, CASE tag WHEN 'NO_DOC' THEN 'Document not found'
               WHEN 'ABSOLUTE' THEN 'Unable to handle absolute path' WHEN 'PROTOCOL' THEN 'Unhandled protocol'
               WHEN 'DIR' THEN 'Document is a directory' WHEN 'NO_FRAG' THEN 'Fragment not found'
               ELSE 'Fragment not found case-sensitively' END AS detail FROM bad
      UNION ALL SELECT doc_path, doc_line, tag, 1, concat('  context: link = ', target) FROM bad
      UNION ALL SELECT doc_path, doc_line, tag, 2, concat('  context: fragment = #', fragment) FROM bad WHERE tag IN ('NO_FRAG', 'CASE_FRAG')
      UNION ALL SELECT doc_path, doc_line, tag, 3, '  context: anchor = #details' FROM bad WHERE tag = 'CASE_FRAG'""",
    "redirect_details": f"""
      WITH {BLOCKS}, bad AS (SELECT * FROM blocks WHERE loop OR j < 7)
      SELECT doc_path, 0 AS n, CASE WHEN loop THEN 'HTTP error' WHEN status = 301 THEN 'Unexpected HTTP status 301 Moved Permanently'
               ELSE 'Unexpected HTTP status 302 Found' END AS detail FROM bad
      UNION ALL SELECT doc_path, 1, concat('  context: link = ', url) FROM bad
      UNION ALL SELECT a.doc_path, CAST(2 + b.k - a.k AS INTEGER), concat('  context: redirect(', b.status, ') = {HOST}/r/', b.k + 1)
      FROM bad a JOIN bad b ON a.last = b.last AND b.k >= a.k AND NOT a.loop
      UNION ALL SELECT doc_path, 2, '  caused by: too many redirects' FROM bad WHERE loop""",
    "failure_causes": f"""
      WITH {PAGE_LINKS}
      SELECT doc_path, doc_line, 'HTTP_OTH' AS tag, concat('  caused by: ', cause) AS detail
      FROM (SELECT *, CASE WHEN NOT fetched THEN 'not fetched' WHEN k % 10 = 9 THEN 'other'
                           WHEN k % 10 = 1 AND NOT has_next THEN concat('not fetched: {HOST}/p/', k + 1)
                           WHEN k % 10 = 8 AND NOT has_back THEN concat('not fetched: {HOST}/p/', k - 5) END AS cause FROM states)
      WHERE cause IS NOT NULL""",
    "sorted_report": f"WITH {STAR} SELECT row_number() OVER (ORDER BY doc_path, pos) AS rank, concat(doc_path, ':', doc_line, ': ', tag, ' ', link) AS line FROM star",
    "tag_counts": f"WITH {STAR} SELECT tag, count(*) AS n_links FROM star GROUP BY tag",
}
