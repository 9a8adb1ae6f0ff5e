"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

ORACLE_SQL = {
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               row_number() OVER w = 1 AS kept, h AS text_sha256
        FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST)""",
    "op3_mix": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))),
                                   1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
            FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
            FROM d GROUP BY source),
        -- Sources by the level at which they reach twice their size; the level of the rest after each.
        o AS (
            SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS k FROM s),
        p AS (
            SELECT *, coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
                   sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
            FROM o),
        a AS (SELECT coalesce(sum(source_size), 0)::DOUBLE * 1.5 AS amount FROM s),
        l AS (
            SELECT min(k) AS first_open,
                   arg_min((amount - 2 * below)::DOUBLE, k) AS rest, arg_min(open::DOUBLE, k) AS open
            FROM p, a WHERE 2.0 * source_size * open > weight * (amount - 2 * below)),
        t AS (
            SELECT source, source_size,
                   CASE WHEN l.first_open IS NULL OR k < l.first_open THEN 2.0::DOUBLE * source_size
                        ELSE weight * l.rest / l.open END AS target
            FROM o, l),
        r AS (
            SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
        SELECT doc_id, size, source_size, target,
               (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source""",
    "op7_nearest": """
        WITH v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (
            SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) AS score
            FROM v AS q, v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_filter_audit": r"""
        WITH w AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        d AS (
            SELECT doc_id, part,
                   len(words) < 100 AS a, 100 * list_unique(words) < 80 * len(words) AS b,
                   100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c,
                   regexp_matches(t, '[#$%&*|]') AS d,
                   coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
            FROM w),
        l AS (
            SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic
            FROM labels GROUP BY doc_id),
        f AS (
            SELECT part, map(['A', 'B', 'C', 'D', 'E'], [a, b, c, d, e]) AS fails,
                   a::INT + b::INT + c::INT + d::INT + e::INT AS n_fails,
                   coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
            FROM d LEFT JOIN l USING (doc_id)),
        g AS (
            SELECT part, fails, n_fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (
            SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
            FROM x AS p, x AS q, x AS r, x AS s, x AS t
            WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
        k AS (
            SELECT filter_order, step, filter_order[step] AS mine,
                   string_split(filter_order[1:step - 1], '') AS before
            FROM o, range(1, 6) AS r(step)),
        m AS (
            SELECT part, filter_order, step, mine, n, good, toxic, n_fails, fails[mine] AS failing,
                   len(list_filter(before, lambda b: fails[b])) > 0 AS gone
            FROM g, k),
        h AS (
            SELECT part, filter_order, step, mine,
                   sum(CASE WHEN NOT failing AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
                   sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
                   sum(CASE WHEN failing AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
                   sum(CASE WHEN failing AND n_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
                   sum(CASE WHEN failing AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
                   sum(CASE WHEN failing AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
            FROM m GROUP BY ALL)
        SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, mine))::BIGINT AS shapley
        FROM h""",
    # States: 0 nothing yet, 1 after s, 2 after u, 3 after a.  The cheapest way to each state, row by row.
    "op12_conversation_repair": r"""
        WITH RECURSIVE crc_table AS (
            SELECT list_transform(range(256), lambda i: list_reduce(
                list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
        fate AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
                       string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                       lambda ch: ascii(ch)::BIGINT)),
                       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS fate
            FROM conversations, crc_table),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
                   CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM fate, range(2) AS r(copy) WHERE fate <> 0 AND (copy = 0 OR fate = 3)),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
                   substr(role, 1, 1) AS initial,
                   regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last
            FROM damaged),
        marked AS (
            SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS initial_before,
                   CASE WHEN last = '' THEN 'blank'
                        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                        WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
            FROM placed),
        faults AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (initial_before IS NOT NULL AND initial_before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
                   count(*) AS n
            FROM marked GROUP BY conv_id),
        inserted AS (
            SELECT * FROM (VALUES
                (0, 0, 0, '', []::VARCHAR[]), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']),
                (1, 1, 0, '', []), (1, 2, 2, 'I', ['user:']), (1, 3, 4, 'II', ['user:', 'assistant:']),
                (2, 2, 0, '', []), (2, 3, 2, 'I', ['assistant:']),
                (3, 3, 0, '', []), (3, 2, 2, 'I', ['user:'])) AS v(p, q, cost, letters, lines)),
        edits AS (
            SELECT * FROM (VALUES
                ('D', '', 0, 0, 3, NULL), ('D', '', 1, 1, 3, NULL), ('D', '', 2, 2, 3, NULL), ('D', '', 3, 3, 3, NULL),
                ('R', '', 0, 2, 2, 'user'), ('R', '', 1, 2, 2, 'user'), ('R', '', 3, 2, 2, 'user'), ('R', '', 2, 3, 2, 'assistant'),
                ('K', 's', 0, 1, 0, NULL), ('K', 'u', 0, 2, 0, NULL), ('K', 'u', 1, 2, 0, NULL), ('K', 'u', 3, 2, 0, NULL),
                ('K', 'a', 2, 3, 0, NULL)) AS v(edit, initial, p, q, cost, role)),
        moves AS (
            SELECT a.p, b.q, b.edit, b.initial, b.role, a.cost + b.cost AS cost, a.letters || b.edit AS letters, a.lines
            FROM inserted AS a JOIN edits AS b ON a.q = b.p),
        ways AS (
            SELECT conv_id, 0::BIGINT AS i, 0 AS q,
                   {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS best FROM faults
            UNION ALL
            SELECT w.conv_id, w.i + 1, m.q, min({
                'cost': w.best.cost + m.cost + CASE WHEN r.fault = 'truncated' AND m.edit <> 'D' THEN 1 ELSE 0 END,
                'audit': w.best.audit || m.letters,
                'lines': w.best.lines || m.lines || CASE m.edit
                    WHEN 'D' THEN []::VARCHAR[] ELSE [coalesce(m.role, r.role) || ':' || r.text] END})
            FROM ways AS w JOIN marked AS r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
            JOIN moves AS m ON m.p = w.q AND (m.edit = 'D' OR r.fault IN ('', 'truncated'))
                 AND (m.edit <> 'K' OR m.initial = r.initial)
            GROUP BY w.conv_id, w.i, m.q),
        ends AS (
            SELECT w.conv_id, min({'cost': w.best.cost + e.cost, 'audit': w.best.audit || e.letters,
                                   'lines': w.best.lines || e.lines}) AS best
            FROM ways AS w JOIN faults AS f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i
            JOIN inserted AS e ON e.p = w.q AND e.q IN (0, 3) GROUP BY w.conv_id)
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit,
               sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) AS c
        LEFT JOIN faults AS f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN ends AS e ON e.conv_id IS NOT DISTINCT FROM c.conv_id""",
    # Sets of shingles; pairs by shared shingles of distinct sets; labels spread along the links.
    "op13_minhash": r"""
        WITH RECURSIVE words AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        sets AS (
            SELECT r, doc_id, list_sort(list_distinct(CASE
                WHEN len(w) = 0 THEN []
                WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s
            FROM words),
        u AS (SELECT s, row_number() OVER () AS v, len(s) AS n FROM (SELECT DISTINCT s FROM sets WHERE len(s) > 0)),
        e AS (SELECT v, n, hash(x) AS x FROM (SELECT v, n, unnest(s) AS x FROM u)),
        pairs AS (
            SELECT a.v, b.v AS o FROM e AS a JOIN e AS b ON a.x = b.x AND a.v < b.v AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
            GROUP BY a.v, b.v, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        links AS (SELECT v, o FROM pairs UNION ALL SELECT o, v FROM pairs),
        reach AS (
            SELECT v, v AS root FROM u
            UNION
            SELECT l.o, reach.root FROM reach JOIN links AS l ON l.v = reach.v),
        roots AS (SELECT v, min(root) AS root FROM reach GROUP BY v),
        named AS (
            SELECT r, doc_id, len(s) AS n, root FROM sets LEFT JOIN u USING (s) LEFT JOIN roots USING (v))
        SELECT doc_id, n AS n_shingles, component_id, component_id IS NOT DISTINCT FROM doc_id AS kept
        FROM (SELECT doc_id, n, CASE WHEN root IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY root) END AS component_id
              FROM named)""",
}
