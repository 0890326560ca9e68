"""The queries' results as SQL for DuckDB, worked out the plain way: all windows, all pairs.

Two queries have none: a trained classifier and sampled pieces are beyond SQL.
"""

from __future__ import annotations

from . import secrets
from .licenses import NOTICES, TEMPLATES

BLANK = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 50, 50, 1000
MIN_PARAGRAPH = 20
STRETCH = 50


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(text: str, pattern: str = r"[^\x20\x09-\x0D]+") -> str:
    return f"regexp_extract_all({text}, {quoted(pattern)})"


def plain_lower(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def shingles(source: str, key: str, k: int) -> str:
    """(key, place, shingle) of a relation (key, words); a list shorter than k is one shingle."""
    return f"""
        SELECT {key}, place, array_to_string(list_slice(words, place + 1, place + {k}), ' ') AS shingle
        FROM (SELECT {key}, words, unnest(range(greatest(len(words) - {k - 1}, 1))) AS place
              FROM {source} WHERE len(words) > 0)"""


def quality_rules() -> str:
    return f"""
        WITH texts AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
                   {words("coalesce(text, '')")} AS words
            FROM documents),
        windows AS (
            SELECT r, place, shingle, count(*) OVER (PARTITION BY r, shingle) AS n
            FROM ({shingles("(SELECT r, words FROM texts WHERE len(words) >= 3)", "r", 3)})),
        repeated_words AS (
            SELECT r, count(DISTINCT place + o) AS n
            FROM windows, (VALUES (0), (1), (2)) AS offsets(o) WHERE n > 1 GROUP BY r),
        starts AS (
            SELECT r, unnest(list(i)) AS i
            FROM (SELECT r, text, unnest(range(1, length(text) - {MIN_REPEAT - 2})) AS i
                  FROM texts WHERE length(text) >= {MIN_REPEAT})
            GROUP BY r, md5(substr(text, i, {MIN_REPEAT})) HAVING count(*) > 1),
        covered AS (
            SELECT r, sum(least({MIN_REPEAT}, coalesce(next - i, {MIN_REPEAT}))) AS n
            FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM starts)
            GROUP BY r),
        long AS (
            SELECT DISTINCT r FROM starts JOIN texts USING (r)
            WHERE i + {MAX_REPEAT} <= length(text)
            GROUP BY r, md5(substr(text, i, {MAX_REPEAT + 1})) HAVING count(*) > 1),
        counted AS (
            SELECT t.r, doc_id, length(text) AS chars, len(words) AS n_words,
                   length(regexp_replace(text, {quoted(BLANK)}, '', 'g')) AS word_chars,
                   length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')))
                     - len(list_distinct(list_filter(string_split(text, chr(10)),
                                                     lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
                   coalesce(w.n, 0) AS n_repeat_words, CAST(coalesce(c.n, 0) AS BIGINT) AS repeat_chars,
                   long.r IS NOT NULL AS long
            FROM texts t LEFT JOIN repeated_words w USING (r) LEFT JOIN covered c USING (r) LEFT JOIN long USING (r))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, repeat_chars,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
                 AND 100 * repeat_chars <= {MAX_COVERED} * chars AND NOT long AS kept
        FROM counted"""


def warc() -> str:
    return """
        WITH pages_of AS (
            SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS bytes
            FROM pages),
        owned AS (
            SELECT *, CASE WHEN bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS owner
            FROM pages_of)
        SELECT page_id, bytes AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN owner IS NOT NULL AND page_id IS DISTINCT FROM owner THEN 'revisit' ELSE 'response' END
                 AS record_type,
               CASE WHEN page_id IS DISTINCT FROM owner THEN owner END AS refers_to
        FROM owned"""


def secret_spans() -> str:
    kinds = [
        f"""SELECT r, {i} AS listed, '{kind}' AS kind, '{role}' AS role,
                   regexp_extract_all(text, {quoted(p)}, 0) AS hits, string_split_regex(text, {quoted(p)}) AS gaps
            FROM texts WHERE regexp_matches(text, {quoted(p)})"""
        for i, (kind, p, role) in enumerate(secrets.KINDS)
    ]
    near = ", ".join(
        f"""coalesce(start - max("end") FILTER (role = '{role}') OVER before <= 200, false)
            OR coalesce(min(start) FILTER (role = '{role}') OVER behind - "end" <= 200, false) AS near_{role}"""
        for role in ("identifier", "secret", "endpoint")
    )
    union = "\nUNION ALL\n".join(kinds)
    written = "string_agg(kind || ':' || start || ':' || \"end\", ',' ORDER BY start, listed, \"end\")"
    strong = f"{written} FILTER (listed < 3)"
    return f"""
        WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        kinds AS ({union}),
        parts AS (
            SELECT r, listed, kind, role, hits[i] AS hit,
                   sum(length(gaps[i]) + length(hits[i])) OVER (PARTITION BY r, listed ORDER BY i) AS "end"
            FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM kinds)),
        found AS (
            SELECT r, listed, kind, role, CAST("end" - length(hit) AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end"
            FROM parts
            WHERE listed > 0 OR length(regexp_extract(hit, {quoted(secrets.ASSIGN)}, 2)) >= {secrets.SHORTEST_VALUE}),
        scoped AS (
            SELECT *, count(*) FILTER (kind = 'gap') OVER (PARTITION BY r ORDER BY start, listed, "end") AS scope,
                   max("end") FILTER (kind = 'assign') OVER (PARTITION BY r ORDER BY start, listed, "end"
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS assigned
            FROM found),
        beside AS (
            SELECT *, {near}
            FROM scoped WHERE kind <> 'gap' AND NOT (kind = 'secret' AND coalesce(assigned > start, false))
            WINDOW before AS (PARTITION BY r, scope ORDER BY start, listed, "end"
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                   behind AS (PARTITION BY r, scope ORDER BY start, listed, "end"
                              ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
        reported AS (
            SELECT * FROM beside
            WHERE listed < 3 OR role = 'secret' AND (near_identifier OR near_endpoint)
               OR role IN ('identifier', 'endpoint') AND near_secret)
        SELECT doc_id, count(listed) FILTER (listed = 0) AS n_assign, count(listed) FILTER (listed = 1) AS n_access,
               count(listed) FILTER (listed = 2) AS n_hex,
               sha256(coalesce({strong}, '')) AS base_sha256, coalesce({written}, '') AS spans
        FROM texts LEFT JOIN reported USING (r)
        GROUP BY texts.r, doc_id"""


def shards() -> str:
    """The CRC is taken bit by bit: every byte is followed by seven zeros in the list reduced."""
    return """
        WITH texts AS (
            SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size,
                   regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes
            FROM documents),
        slim AS (
            SELECT doc_id, source, size,
                   xor(list_reduce(
                           flatten(list_transform(bytes, lambda b: [CAST('0x' || b AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
                           lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1)), 4294967295),
                       4294967295) AS text_crc32
            FROM texts),
        hashed AS (
            SELECT *, CAST('0x' || substr(md5(concat_ws('|', 'shards', coalesce(CAST(doc_id AS VARCHAR), ''),
                                                        size, text_crc32)), 1, 15) AS BIGINT) AS h
            FROM slim),
        ranked AS (
            SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size, text_crc32)
                       - 1 + CAST(0.5 AS DOUBLE)) / count(*) OVER (PARTITION BY source) AS fraction
            FROM hashed),
        placed AS (
            SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, h, doc_id NULLS FIRST, size, text_crc32)
                        - 1 AS spot,
                   count(*) OVER () AS n
            FROM ranked)
        SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(spot * 8 // n AS INTEGER) AS shard,
               spot - (spot * 8 // n * n + 7) // 8 AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM placed"""


def components(nodes: str, links: str) -> str:
    """CTEs of a relation (node, component) from nodes and links (a, b), the smallest reachable."""
    return f"""
        reach AS (
            SELECT node AS a, node AS b FROM {nodes}
            UNION
            SELECT reach.a, linked.b
            FROM reach JOIN (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}) linked ON reach.b = linked.a),
        grouped AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a)"""


def jaccard_join() -> str:
    return f"""
        WITH RECURSIVE texts AS (
            SELECT doc_id, {words(plain_lower("coalesce(text, '')"))} AS words FROM documents),
        sets AS (SELECT DISTINCT doc_id AS node, shingle FROM ({shingles("texts", "doc_id", 4)})),
        sizes AS (SELECT node, count(*) AS n FROM sets GROUP BY node),
        links AS (
            SELECT a, b FROM (SELECT x.node AS a, y.node AS b, count(*) AS i
                              FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.node < y.node GROUP BY ALL)
            JOIN sizes s ON s.node = a JOIN sizes t ON t.node = b
            WHERE 100 * i >= 85 * (s.n + t.n - i)),
        {components("sizes", "links")}
        SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, doc_id) AS component_id
        FROM documents LEFT JOIN sizes ON sizes.node = doc_id LEFT JOIN grouped ON grouped.node = doc_id"""


def license_matches() -> str:
    """A template of fewer words than a shingle is one shingle of its own length, and looked for among
    the texts' shingles of that length."""
    wanted = TEMPLATES | NOTICES
    templates = ",\n".join(f"({quoted(name)}, {quoted(text)})" for name, text in sorted(wanted.items()))
    letters = r"[a-z0-9]+"
    return f"""
        WITH templates AS (
            SELECT name, words, least(len(words), 5) AS k
            FROM (SELECT name, {words(plain_lower("text"), letters)} AS words FROM (VALUES {templates}) AS t(name, text))),
        needed AS (
            SELECT DISTINCT name, k, array_to_string(list_slice(words, place + 1, place + k), ' ') AS shingle
            FROM (SELECT *, unnest(range(len(words) - k + 1)) AS place FROM templates)),
        sizes AS (SELECT name, count(*) AS n FROM needed GROUP BY name),
        texts AS (
            SELECT row_number() OVER () AS r, doc_id, {words(plain_lower("coalesce(text, '')"), letters)} AS words
            FROM documents),
        held AS (
            SELECT r, k, place, array_to_string(list_slice(words, place + 1, place + k), ' ') AS shingle
            FROM (SELECT r, k, words, unnest(range(len(words) - k + 1)) AS place
                  FROM texts CROSS JOIN (SELECT DISTINCT k FROM templates) WHERE len(words) >= k))
        SELECT doc_id, name AS template, any_value(n) AS n_shingles, count(DISTINCT shingle) AS n_found,
               min(place) AS first_word, max(place) + any_value(k) - 1 AS last_word
        FROM held JOIN needed USING (k, shingle) JOIN sizes USING (name) JOIN texts USING (r)
        GROUP BY r, doc_id, name
        HAVING 100 * count(DISTINCT shingle) >= 80 * any_value(n)"""


def contained_items() -> str:
    return f"""
        WITH items AS (
            SELECT row_number() OVER () AS q, item_id, {words("lower(coalesce(text, ''))")} AS words FROM benchmark),
        needed AS (SELECT DISTINCT q, shingle FROM ({shingles("items", "q", 5)})),
        sizes AS (SELECT q, count(*) AS n FROM needed GROUP BY q),
        texts AS (
            SELECT row_number() OVER () AS r, doc_id, {words("lower(coalesce(text, ''))")} AS words FROM documents),
        held AS (SELECT DISTINCT r, shingle FROM ({shingles("texts", "r", 5)}))
        SELECT doc_id, item_id, CAST(any_value(n) AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_found
        FROM held JOIN needed USING (shingle) JOIN sizes USING (q) JOIN items USING (q) JOIN texts USING (r)
        GROUP BY r, doc_id, q, item_id
        HAVING 100 * count(*) >= 80 * any_value(n)"""


def repeated_paragraphs() -> str:
    """Units are numbered in the order of id and place, so the smallest number names a class."""
    return f"""
        WITH RECURSIVE lines AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS number
            FROM documents),
        placed AS (
            SELECT *, coalesce(sum(len(words)) OVER (PARTITION BY doc_id ORDER BY number
                                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM (SELECT doc_id, number, {words(plain_lower("line"))} AS words FROM lines)),
        paragraphs AS (
            SELECT row_number() OVER (ORDER BY doc_id, start) AS node, doc_id, words, start AS first,
                   start + len(words) AS last
            FROM placed WHERE len(words) >= {MIN_PARAGRAPH}),
        sets AS (SELECT DISTINCT node, shingle FROM ({shingles("paragraphs", "node", 5)})),
        sizes AS (SELECT node, count(*) AS n FROM sets GROUP BY node),
        links AS (
            SELECT a, b FROM (SELECT x.node AS a, y.node AS b, count(*) AS i
                              FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.node < y.node GROUP BY ALL)
            JOIN sizes s ON s.node = a JOIN sizes t ON t.node = b
            WHERE 100 * i >= 80 * (s.n + t.n - i)),
        {components("sizes", "links")},
        repeated AS (SELECT component FROM grouped GROUP BY component HAVING count(*) > 1),
        all_words AS (
            SELECT doc_id, list_reduce(list(words ORDER BY number), lambda x, y: x || y) AS words
            FROM placed GROUP BY doc_id),
        ends AS (
            SELECT doc_id, start + len(words) AS stop FROM placed WHERE len(words) > 0
            UNION
            SELECT doc_id, place + 1 FROM (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS place
                                           FROM all_words)
            WHERE regexp_matches(word, '[.!?]$')),
        starts AS (SELECT doc_id, stop AS first FROM ends UNION SELECT doc_id, 0 FROM documents),
        runs AS (
            SELECT s.doc_id, s.first, min(e.stop) AS last
            FROM starts s JOIN ends e ON s.doc_id = e.doc_id AND e.stop >= s.first + {MIN_PARAGRAPH}
            GROUP BY s.doc_id, s.first),
        spelt AS (
            SELECT r.*, md5(array_to_string(list_slice(words, r.first + 1, r.last), ' ')) AS spelling
            FROM runs r JOIN all_words USING (doc_id)),
        run_heads AS (
            SELECT spelling, min(struct_pack(doc := doc_id, first := first)) AS head
            FROM spelt GROUP BY spelling HAVING count(*) > 1),
        windows AS (
            SELECT doc_id, first, first + {STRETCH} AS last,
                   md5(array_to_string(list_slice(words, first + 1, first + {STRETCH}), ' ')) AS spelling
            FROM (SELECT doc_id, words, unnest(range(len(words) - {STRETCH - 1})) AS first FROM all_words)),
        window_heads AS (
            SELECT spelling, min(struct_pack(doc := doc_id, first := first)) AS head
            FROM windows GROUP BY spelling HAVING count(*) > 1),
        found AS (
            SELECT p.doc_id, p.first, p.last, h.doc_id AS class_doc, h.first AS class_word
            FROM grouped JOIN repeated USING (component)
            JOIN paragraphs p ON p.node = grouped.node JOIN paragraphs h ON h.node = component
            UNION ALL
            SELECT doc_id, first, last, head.doc, head.first FROM spelt JOIN run_heads USING (spelling)
            UNION ALL
            SELECT doc_id, first, last, head.doc, head.first FROM windows JOIN window_heads USING (spelling)),
        marked AS (SELECT *, NOT (doc_id = class_doc AND first = class_word) AS removed FROM found),
        opened AS (
            SELECT *, CASE WHEN first < max(last) OVER (PARTITION BY doc_id, removed ORDER BY first, last
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new
            FROM marked),
        numbered AS (
            SELECT *, sum(new) OVER (PARTITION BY doc_id, removed ORDER BY first, last
                                     ROWS UNBOUNDED PRECEDING) AS stretch
            FROM opened)
        SELECT doc_id, CAST(min(first) AS INTEGER) AS first_word, CAST(max(last) AS INTEGER) AS last_word,
               min(struct_pack(doc := class_doc, word := class_word)).doc AS class_doc,
               CAST(min(struct_pack(doc := class_doc, word := class_word)).word AS INTEGER) AS class_word, removed
        FROM numbered GROUP BY doc_id, removed, stretch"""


def fill_in_middle() -> str:
    digits = ", ".join(
        f"CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}"
        for i in range(4)
    )
    blanks, word = BLANK + "*", r"[^\x20\x09-\x0D]+"
    return f"""
        WITH texts AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   {words("coalesce(text, '')", f"{blanks}{word}|{BLANK}+")} AS units, {digits}
            FROM documents),
        drawn AS (
            SELECT *, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low,
                   greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high,
                   CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain'
                        WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM texts),
        cut AS (
            SELECT *, array_to_string(list_slice(units, 1, low), '') AS prefix,
                   array_to_string(list_slice(units, low + 1, high), '') AS middle,
                   array_to_string(list_slice(units, high + 1, len(units)), '') AS suffix
            FROM drawn)
        SELECT doc_id, len(units) AS n, form,
               CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text
                                WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM cut"""


def mixed_sources() -> str:
    """A source is stopped if, filled up to where it is full, all together hold less than there is."""
    return f"""
        WITH texts AS (
            SELECT row_number() OVER () AS r, doc_id, source, len({words("coalesce(text, '')")}) AS size,
                   CAST('0x' || substr(md5(concat_ws('|', 'mix', coalesce(CAST(doc_id AS VARCHAR), ''),
                                                     md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS h
            FROM documents),
        held AS (
            SELECT source, CAST(sum(size) AS HUGEINT) AS source_size,
                   CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS HUGEINT) AS weight,
                   row_number() OVER (ORDER BY source NULLS LAST) AS number
            FROM texts GROUP BY source),
        everything AS (SELECT sum(source_size)::HUGEINT AS total FROM held),
        stopped AS (
            SELECT s.number, sum(least(3 * t.source_size * s.weight, 3 * s.source_size * t.weight))
                               < any_value(total) * any_value(s.weight) AS capped
            FROM held s CROSS JOIN held t CROSS JOIN everything GROUP BY s.number),
        level AS (
            SELECT any_value(total) AS total,
                   any_value(total) - coalesce(sum(3 * source_size) FILTER (capped), 0)::HUGEINT AS over,
                   greatest(coalesce(sum(weight) FILTER (NOT capped), 1), 1)::HUGEINT AS under
            FROM held JOIN stopped USING (number) CROSS JOIN everything),
        counted AS (SELECT *, (1::HUGEINT << greatest(1, CAST(ceil(log2(greatest(total, 1) / 64)) AS INTEGER))) AS n
                    FROM level),
        targets AS (
            SELECT *, CASE WHEN capped THEN 3 * source_size * under ELSE weight * over END AS units,
                   CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
                        ELSE CAST(weight * over AS DOUBLE) / CAST(under AS DOUBLE) END AS target
            FROM held JOIN stopped USING (number) CROSS JOIN counted),
        summed AS (SELECT *, sum(units) OVER (ORDER BY number) AS upto FROM targets),
        slotted AS (
            SELECT *, (2 * upto::HUGEINT * n + total * under) // greatest(1, 2 * total * under)
                      - (2 * (upto - units)::HUGEINT * n + total * under) // greatest(1, 2 * total * under) AS slots
            FROM summed),
        placed AS (
            SELECT doc_id, size, source_size, target, slots * total // n AS filled,
                   sum(size) OVER (PARTITION BY number ORDER BY h, r) AS upto
            FROM texts JOIN slotted ON texts.source IS NOT DISTINCT FROM slotted.source)
        SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
               CAST(list_sum(list_transform([0, 1, 2], lambda p: greatest(0,
                   least(upto + p * source_size, filled) - least(upto - size + p * source_size, filled)))) AS BIGINT) AS taken
        FROM placed"""


def source_divergence() -> str:
    lowered = plain_lower("coalesce(text, '')")
    return f"""
        WITH texts AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   {words(lowered, "[^\x00-\x40\x5B-\x60\x7B-\x7F]+")} AS terms
            FROM documents),
        spelt AS (SELECT r, lang, source, unnest(terms) AS term FROM texts),
        kept AS (
            SELECT lang, term, count(*) AS c FROM spelt GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
        counts AS (
            SELECT lang, source, term, count(*) AS c FROM spelt JOIN kept USING (lang, term) GROUP BY ALL),
        langs AS (
            SELECT lang, coalesce(any_value(v), 0) AS v, coalesce(any_value(n), 0) AS n
            FROM texts LEFT JOIN (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang) USING (lang)
            GROUP BY lang),
        sources AS (
            SELECT t.lang, t.source, coalesce(sum(c), 0) AS n
            FROM (SELECT DISTINCT lang, source FROM texts) t LEFT JOIN counts USING (lang, source)
            GROUP BY t.lang, t.source),
        shares AS (
            SELECT s.lang, s.source, kept.term, coalesce(counts.c, 0) AS c,
                   1 + 1000000000::HUGEINT * (coalesce(counts.c, 0) + 1) // (s.n + v)::HUGEINT AS p,
                   1 + 1000000000::HUGEINT * (kept.c + 1) // (langs.n + v)::HUGEINT AS q
            FROM sources s JOIN langs USING (lang) JOIN kept USING (lang)
            LEFT JOIN counts ON counts.lang = s.lang AND counts.source = s.source AND counts.term = kept.term),
        pairs AS (
            SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
            FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
            GROUP BY ALL),
        found AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
            FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM shares WHERE c > 0 AND p > q)
        SELECT lang, source, part, item, value,
               CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM found QUALIFY part = 'pair' OR rank <= 200"""


ORACLE = {
    "op1_quality_rules": quality_rules(),
    "op3_warc": warc(),
    "op4_secrets": secret_spans(),
    "op5_interleaved_shards": shards(),
    "op6_jaccard_join": jaccard_join(),
    "op8_licenses": license_matches(),
    "op9_decontamination": contained_items(),
    "op10_repeated_paragraphs": repeated_paragraphs(),
    "op11_fill_in_middle": fill_in_middle(),
    "op12_mixed_sources": mixed_sources(),
    "op13_source_divergence": source_divergence(),
}
