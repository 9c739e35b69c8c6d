"""The queries of this subpackage in DuckDB SQL, where SQL expresses them."""

OP9 = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s
    FROM words
), classes AS (
    SELECT min(doc_id) AS node, len(any_value(s)) AS n, any_value(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)
), shingles AS (
    SELECT node, n, unnest(s) AS shingle FROM classes
), links AS (
    SELECT a.node AS a, b.node AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.node <> b.node
    GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
    SELECT node, node AS other FROM classes
    UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
), roots AS (
    SELECT node, min(other) AS root FROM reach GROUP BY node
), members AS (
    SELECT s.doc_id, len(s.s) AS n, coalesce(r.root, s.doc_id) AS root FROM sets s
    LEFT JOIN classes c ON list_sort(s.s) = list_sort(c.s) LEFT JOIN roots r ON r.node = c.node
)
SELECT doc_id, n AS n_shingles, root AS component_id, doc_id = root AS kept FROM members
"""

OP4 = r"""
WITH sized AS (
    SELECT doc_id, source, md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
    FROM sized GROUP BY source
), limits AS (
    SELECT *, [5.0::DOUBLE, 2.0, 1.0][(place - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS most FROM sources
), levels AS (
    SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
        - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM limits
), targets AS (
    SELECT source, source_size, place, least(most, weight * max(level) OVER ()) AS target FROM levels
), timed AS (
    SELECT d.*, t.source_size, t.target, t.place,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS UNBOUNDED PRECEDING)::BIGINT AS total,
        row_number() OVER (PARTITION BY d.source ORDER BY d.key) AS nth
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), turns AS (
    SELECT *, CASE WHEN target > 0 THEN (source_size * round + total) / target ELSE 0 END AS finish
    FROM timed, (VALUES (0), (1)) r(round)
), queued AS (
    SELECT *, sum(size) OVER (ORDER BY finish, place, round, key, total ROWS UNBOUNDED PRECEDING) AS so_far,
        1.5 * sum(size) OVER () / 2 AS budget FROM turns
)
SELECT doc_id, size, source_size, target, sum(CASE WHEN so_far <= budget THEN size ELSE 0 END)::BIGINT AS taken
FROM queued GROUP BY doc_id, key, nth, size, source, source_size, target
"""

OP10 = r"""
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), digests AS (
    SELECT page_id, payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS original
    FROM payloads
)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(hex, 1 + (i // 4) * 5, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '')
        AS payload_digest,
    CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> original THEN original END AS refers_to
FROM digests
"""

OP5 = r"""
WITH RECURSIVE sound AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
    SELECT vec_id AS node, vec_id AS other FROM embeddings
    UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
), roots AS (
    SELECT node, min(other) AS root FROM reach GROUP BY node
), degrees AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, r.root AS component_id, e.vec_id = r.root AS kept
FROM embeddings e JOIN roots r ON r.node = e.vec_id LEFT JOIN degrees d ON d.a = e.vec_id
"""


def _op3(iterations: int = 20) -> str:
    """Rules, then both walks, one table per step."""
    walk = "".join(
        f"""
), ranks{n + 1} AS MATERIALIZED (
    SELECT s.kind, s.host, 0.15 * s.seed + 0.85 * coalesce(sum(e.share * r.rank), 0) AS rank,
        0.15 + 0.85 * coalesce(sum(e.share * r.reach), 0) AS reach
    FROM starts s LEFT JOIN shares e ON e.kind = s.kind AND e.goal = s.host
    LEFT JOIN ranks{n} r ON r.kind = e.kind AND r.host = e.origin GROUP BY s.kind, s.host, s.seed"""
        for n in range(iterations)
    )
    return rf"""
WITH rests AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest,
        html FROM pages
), parts AS (
    SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests
), rules(verdict, rhost, rpath) AS (
    VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'),
        ('allow', 'org', '/fr/')
), judged AS MATERIALIZED (
    SELECT p.page_id, p.host, p.path, p.html,
        (SELECT arg_max(struct_pack(rule := rhost || rpath, verdict := verdict), length(rhost || rpath)) FROM rules
         WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)) AS r
    FROM parts p
), seeds AS (
    SELECT host, count(*) FILTER (r.verdict = 'allow') / count(*) AS trust,
        count(*) FILTER (r.verdict = 'block') / count(*) AS distrust FROM judged WHERE host <> '' GROUP BY host
), found AS (
    SELECT host AS source, translate(unnest(regexp_extract_all(html,
        '(?i)href\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS target FROM judged WHERE host <> ''
), links AS MATERIALIZED (
    SELECT source, target, count(*) AS n FROM found WHERE source <> target GROUP BY ALL
), steps AS (
    SELECT 'trust' AS kind, source AS origin, target AS goal, n FROM links
    UNION ALL SELECT 'distrust', target, source, n FROM links
), hosts AS (
    SELECT host FROM seeds UNION SELECT source FROM links UNION SELECT target FROM links
), starts AS MATERIALIZED (
    SELECT 'trust' AS kind, h.host, coalesce(s.trust, 0) AS seed FROM hosts h LEFT JOIN seeds s USING (host)
    UNION ALL SELECT 'distrust', h.host, coalesce(s.distrust, 0) FROM hosts h LEFT JOIN seeds s USING (host)
), shares AS MATERIALIZED (
    SELECT kind, origin, goal, n / sum(n) OVER (PARTITION BY kind, origin) AS share FROM steps
    UNION ALL SELECT kind, host, host, 1 FROM starts s
    WHERE NOT EXISTS (SELECT 1 FROM steps e WHERE e.kind = s.kind AND e.origin = s.host)
), ranks0 AS MATERIALIZED (
    SELECT kind, host, seed AS rank, 1.0::DOUBLE AS reach FROM starts{walk}
), blocked AS (
    SELECT host FROM ranks{iterations} GROUP BY host
    HAVING max(rank / reach) FILTER (kind = 'distrust') > 0.5
        AND max(rank / reach) FILTER (kind = 'distrust') > max(rank / reach) FILTER (kind = 'trust')
)
SELECT page_id, j.host, path, r.rule AS rule,
    coalesce(r.verdict, CASE WHEN b.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN blocked b ON b.host = j.host
"""


#: CRC-32 of an ASCII text, from a table of 256 remainders that its rule makes.
CRC = r"""
crc_table AS (
    SELECT list_transform(range(256), lambda i: list_reduce([i] || [j FOR j IN range(8)],
        lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
)"""


def _crc(text: str) -> str:
    """The CRC-32 of a text, beside a table ``crc_table``."""
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    step = "lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)"
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}, {step}), 4294967295::BIGINT)"


def _field(name: str, value: str | None = None) -> str:
    text = f"({value or name})::VARCHAR"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


_LEAF = "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text"))) + ")"
_ALTERED = _LEAF.replace(_field("n_chars"), _field("n_chars", "n_chars + 1"))

OP13 = rf"""
WITH RECURSIVE {CRC.strip()}, leaves AS MATERIALIZED (
    SELECT doc_id, lang, {_LEAF} AS leaf,
        CASE WHEN coalesce({_crc("doc_id::VARCHAR")} % 7 = 0, false) THEN {_ALTERED} ELSE {_LEAF} END AS copied
    FROM documents, crc_table
), placed AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY lang) AS total FROM leaves
), nodes AS (
    SELECT lang, 0 AS level, pos AS idx, total, leaf AS hash FROM placed
    UNION ALL SELECT lang, level + 1, idx // 2, any_value((total + 1) // 2), sha256(string_agg(hash, '' ORDER BY idx))
    FROM nodes WHERE total > 1 GROUP BY lang, level, idx // 2
), kept_nodes AS MATERIALIZED (SELECT * FROM nodes
), subroots AS MATERIALIZED (
    SELECT lang, hash, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS total
    FROM kept_nodes WHERE total = 1
), tops AS (
    SELECT 0 AS level, place AS idx, total, hash FROM subroots
    UNION ALL SELECT level + 1, idx // 2, any_value((total + 1) // 2), sha256(string_agg(hash, '' ORDER BY idx))
    FROM tops WHERE total > 1 GROUP BY level, idx // 2
), kept_tops AS MATERIALIZED (SELECT * FROM tops
), ways AS (
    SELECT p.doc_id, p.lang, p.pos, 0 AS tree, n.level, n.idx, n.hash
    FROM placed p JOIN kept_nodes n ON n.lang IS NOT DISTINCT FROM p.lang AND n.total > 1
        AND n.idx = xor(p.pos >> n.level, 1)
    UNION ALL SELECT p.doc_id, p.lang, p.pos, 1, n.level, n.idx, n.hash
    FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang
    JOIN kept_tops n ON n.total > 1 AND n.idx = xor(s.place >> n.level, 1)
), proofs AS (
    SELECT lang, pos, sha256(string_agg(hash, '' ORDER BY tree, level)) AS proof FROM ways GROUP BY lang, pos
), folds AS (
    SELECT p.lang, p.pos, 0 AS tree, 0 AS level, p.pos AS idx, p.total, p.copied AS hash, s.place, s.total AS langs
    FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang
    UNION ALL
    SELECT f.lang, f.pos, f.tree + (f.total = 1)::INT, CASE WHEN f.total = 1 THEN 0 ELSE f.level + 1 END,
        CASE WHEN f.total = 1 THEN f.place ELSE f.idx // 2 END,
        CASE WHEN f.total = 1 THEN f.langs ELSE (f.total + 1) // 2 END,
        CASE WHEN f.total = 1 THEN f.hash
            WHEN f.idx % 2 = 1 THEN sha256(w.hash || f.hash) ELSE sha256(f.hash || coalesce(w.hash, '')) END,
        f.place, f.langs
    FROM folds f LEFT JOIN ways w ON w.lang IS NOT DISTINCT FROM f.lang AND w.pos = f.pos AND w.tree = f.tree
        AND w.level = f.level WHERE NOT (f.tree = 1 AND f.total = 1)
)
SELECT p.doc_id, p.leaf, s.hash AS subroot, r.hash AS root, coalesce(w.proof, sha256('')) AS proof_sha256,
    f.hash AS folded_root, f.hash = r.hash AS verified
FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang
JOIN (SELECT hash FROM kept_tops WHERE total = 1) r ON true
JOIN folds f ON f.lang IS NOT DISTINCT FROM p.lang AND f.pos = p.pos AND f.tree = 1 AND f.total = 1
LEFT JOIN proofs w ON w.lang IS NOT DISTINCT FROM p.lang AND w.pos = p.pos
"""


#: Repair as shortest ways through the four states of a finite automaton (o: start, s: after
#: the system's turn, u: after a user's, c: after an assistant's), up to two inserts a time.
OP11 = rf"""
WITH RECURSIVE {CRC.strip()}, filled AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {_crc("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS k
    FROM conversations, crc_table
), damaged AS (
    SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
        CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM filled, (VALUES (0), (1)) c(copy) WHERE k <> 0 AND (copy = 0 OR k = 3)
), named AS (
    SELECT *, sha256(strlen(role) || ':' || role || text) AS same, role[1] AS letter,
        regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM damaged
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, same) AS i FROM named
), copies AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM ranked
), faults AS MATERIALIZED (
    SELECT conv_id, turn, role, text, letter, i, CASE WHEN last = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
        WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
        lag(letter) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM copies
), moves(q, x, q2) AS (
    VALUES ('o', 's', 's'), ('o', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'c'), ('c', 'u', 'u')
), inserts(q, n, q2) AS (
    SELECT q, 0, q FROM (VALUES ('o'), ('s'), ('u'), ('c')) t(q)
    UNION ALL SELECT q, 1, q2 FROM moves WHERE x <> 's'
    UNION ALL SELECT a.q, 2, b.q2 FROM moves a JOIN moves b ON a.q2 = b.q WHERE a.x <> 's' AND b.x <> 's'
), edits AS MATERIALIZED (
    SELECT conv_id, i, q, 'D' AS edit, q AS q2, 4 AS cost FROM faults, (VALUES ('o'), ('s'), ('u'), ('c')) t(q)
    UNION ALL SELECT conv_id, i, q, 'K', q2, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END
    FROM faults f JOIN moves m ON m.x = f.letter WHERE fault IN ('none', 'truncated')
    UNION ALL SELECT conv_id, i, q, 'R', q2, CASE fault WHEN 'truncated' THEN 6 ELSE 3 END
    FROM faults, moves m WHERE m.x <> 's' AND fault IN ('none', 'truncated')
), walks AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS i, 'o' AS q, {{'cost': 0::BIGINT, 'audit': ''}} AS best FROM faults
    UNION ALL
    SELECT w.conv_id, e.i, e.q2, min({{'cost': (w.best.cost + 3 * s.n + e.cost)::BIGINT,
        'audit': w.best.audit || repeat('I', s.n) || e.edit}})
    FROM walks w JOIN inserts s ON s.q = w.q
    JOIN edits e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.q = s.q2
    GROUP BY w.conv_id, e.i, e.q2
), sizes AS (
    SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (i > 1 AND before || letter NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faults GROUP BY conv_id
), ends AS MATERIALIZED (
    SELECT w.conv_id, min({{'cost': (w.best.cost + 3 * s.n)::BIGINT, 'audit': w.best.audit || repeat('I', s.n)}}) AS best
    FROM walks w JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND z.n = w.i
    JOIN inserts s ON s.q = w.q WHERE s.q2 IN ('o', 'c') GROUP BY w.conv_id
), letters AS (
    SELECT conv_id, unnest(string_split(best.audit, '')) AS edit, unnest(range(1, length(best.audit) + 1)) AS pos
    FROM ends
), counted AS (
    SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS place
    FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
), placed AS (
    SELECT c.conv_id, c.pos, c.edit, c.place, f.role, f.text,
        bool_or(c.edit = 'K' AND f.letter = 's') OVER (PARTITION BY c.conv_id) AS opened
    FROM counted c LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.i = c.i AND c.edit <> 'I'
    WHERE c.edit <> 'D'
), repaired AS (
    SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role
        WHEN (place - opened::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10)
        ORDER BY pos)) AS digest FROM placed GROUP BY conv_id
)
SELECT c.conv_id, coalesce(z.gaps, 0) AS gaps, coalesce(z.blank, 0) AS blank, coalesce(z.duplicate, 0) AS duplicate,
    coalesce(z.truncated, 0) AS truncated, coalesce(z.illegal, 0) AS illegal, coalesce(e.best.cost, 0) AS cost,
    coalesce(e.best.audit, '') AS audit, coalesce(r.digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def statements() -> dict[str, str]:
    return {
        "op3_urls": _op3(),
        "op4_mixing": OP4,
        "op5_vectors": OP5,
        "op9_minhash": OP9,
        "op10_warc": OP10,
        "op11_repair": OP11,
        "op13_merkle": OP13,
    }
