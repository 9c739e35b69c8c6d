"""DuckDB statements the Spark queries are compared with.

They are written from the definitions and not from the Spark plans: contexts
are summed as vectors and windows are counted label by label.
"""

from __future__ import annotations

DELTA = "0.95::DOUBLE"
TEXT_DELTA = "0.55::DOUBLE"
DECAY = 0.7

_EMBEDDINGS = """
raw AS (
    SELECT vec_id // 20 AS conv_id, label, embedding::DOUBLE[] AS v,
           row_number() OVER (PARTITION BY vec_id // 20 ORDER BY vec_id) - 1 AS turn
    FROM embeddings)"""

_LINES = r"""
split AS (
    SELECT doc_id AS conv_id,
           string_split_regex(regexp_replace(text, '(\r\n|\r|\n)$', ''), '\r\n|\r|\n') AS lines
    FROM documents WHERE text <> ''),
numbered AS (SELECT conv_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM split),
lines AS (SELECT conv_id, i - 1 AS turn, lines[i] AS text FROM numbered)"""

_TOKENS = r"list_transform(regexp_extract_all(lower(text), '[a-z]+'), lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 256)"

_COUNTS = f"""
hashed AS (SELECT conv_id, turn, text, {_TOKENS} AS b FROM texts),
raw AS (
    SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn,
           list_transform(range(0, 256), lambda d: len(list_filter(b, lambda x: x = d))::DOUBLE) AS v
    FROM hashed WHERE len(b) > 0)"""

_CONVERSATION_TEXTS = "texts AS (SELECT conv_id, turn, text FROM conversations)"


def _scores(m: int = 2, legacy: bool = False, delta: str = DELTA, extra: str = "") -> str:
    """CTEs from ``raw (conv_id, turn, v)`` to ``history``; a = 0.5."""
    lags = ", ".join(f"lag(s, {i}) OVER w AS s{i}" for i in range(1, m + 1))
    terms = [
        f"{DECAY ** (i - 1)!r}::DOUBLE * coalesce(s{i}, zero)[j]" for i in range(1, m + 1)
    ]
    ready = "turn > 0" if legacy else f"turn >= {m}"
    warm = "NULL" if legacy else "d_prev"
    return f"""
unit AS (
    SELECT conv_id, turn{extra}, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS s,
           list_transform(v, lambda x: 0::DOUBLE) AS zero
    FROM raw),
past AS (SELECT *, {lags} FROM unit WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
context AS (
    SELECT *, 1 - list_dot_product(s1, s) AS d_prev,
           list_transform(range(1, len(s) + 1), lambda j: {" + ".join(terms)}) AS c
    FROM past),
distances AS (
    SELECT *, CASE WHEN turn = 0 THEN NULL WHEN NOT ({ready}) THEN {warm}
                   WHEN sqrt(list_dot_product(c, c)) > 1e-12
                   THEN 1 - list_dot_product(c, s) / sqrt(list_dot_product(c, c)) END AS d_ctx
    FROM context),
scores AS (
    SELECT *, CASE WHEN turn = 0 THEN 0::DOUBLE WHEN d_ctx IS NULL THEN d_prev
                   ELSE 0.5::DOUBLE * d_prev + 0.5::DOUBLE * d_ctx END AS delta_eff
    FROM distances),
flags AS (SELECT *, turn > 0 AND delta_eff >= {delta} AS is_boundary, delta_eff / {delta} AS graded_score FROM scores),
history AS (
    SELECT *, sum(is_boundary::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS topic_id
    FROM flags)"""


_EMB = f"WITH {_EMBEDDINGS},{_scores()}"
_TOKEN_COUNTS = f"""
WITH {_CONVERSATION_TEXTS}, cells AS (SELECT conv_id, turn, unnest({_TOKENS}) AS bucket FROM texts)
SELECT conv_id, turn, bucket, count(*) AS count FROM cells GROUP BY conv_id, turn, bucket"""
_CONV = f"WITH {_CONVERSATION_TEXTS},{_COUNTS},{_scores(delta=TEXT_DELTA, extra=', text')}"

_BAND = """CASE WHEN graded_score < 0.7::DOUBLE THEN 'very_weak' WHEN graded_score < 1 THEN 'weak'
                WHEN graded_score < 1.3::DOUBLE THEN 'normal' ELSE 'strong' END"""

_HISTORY = f"""{_EMB} SELECT conv_id, turn, topic_id, is_boundary, round(delta_eff, 6) AS delta_eff,
                             round(graded_score, 6) AS graded_score FROM history"""

_SEGMENTS = """SELECT conv_id, topic_id, min(turn) AS start, max(turn) + 1 AS end_exclusive
               FROM history GROUP BY conv_id, topic_id"""

_STRENGTH = ", ".join(
    f"count(*) FILTER (WHERE band = '{b}') AS {b}" for b in ("very_weak", "weak", "normal", "strong")
)

_GOLD = """
gold AS (
    SELECT conv_id, turn, coalesce((lead(label) OVER w <> label)::INT, 0) AS label
    FROM raw WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
sizes AS (
    SELECT conv_id, count(*) AS n, sum(label)::BIGINT AS b,
           greatest(2, round_even(count(*)::DOUBLE / (sum(label) + 1) / 2, 0))::INT AS k
    FROM gold GROUP BY conv_id)"""

# The last turn has no next one, so its gold label is 0 already.
_METRICS = """
starts AS (
    SELECT DISTINCT c.cand, z.conv_id, z.n, z.k, p.turn AS i
    FROM (SELECT DISTINCT cand FROM pred) c, sizes z JOIN pred p ON p.conv_id = z.conv_id AND p.turn <= z.n - z.k),
windows AS (
    SELECT s.cand, s.conv_id, s.i, sum(g.label) AS g, sum(p.label) AS p
    FROM starts s
    JOIN gold g ON g.conv_id = s.conv_id AND g.turn BETWEEN s.i AND s.i + s.k - 1
    JOIN pred p ON p.cand = s.cand AND p.conv_id = s.conv_id AND p.turn = g.turn
    GROUP BY s.cand, s.conv_id, s.i),
misses AS (
    SELECT cand, conv_id, avg(((g > 0) <> (p > 0))::INT) AS pk, avg((g <> p)::INT) AS wd
    FROM windows GROUP BY cand, conv_id),
hits AS (
    SELECT p.cand, p.conv_id,
           coalesce(2.0::DOUBLE * sum(g.label * p.label) / nullif(sum(g.label) + sum(p.label), 0), 0) AS f1
    FROM pred p JOIN gold g USING (conv_id, turn) GROUP BY p.cand, p.conv_id),
dialogues AS (SELECT * FROM misses JOIN hits USING (cand, conv_id)),
corpus AS (
    SELECT cand, avg(pk) AS pk, avg(wd) AS wd, avg(f1) AS f1,
           0.5 * avg(f1) + 0.25 * (1 - avg(pk)) + 0.25 * (1 - avg(wd)) AS score, count(*) AS n
    FROM dialogues GROUP BY cand)"""

_ONE_PRED = f"""
pred AS (
    SELECT 0 AS cand, conv_id, turn, coalesce((lead(delta_eff) OVER w >= {DELTA})::INT, 0) AS label
    FROM scores WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""

_POOL = """
pool AS (
    SELECT delta_eff AS x, row_number() OVER (ORDER BY delta_eff) - 1 AS r, count(*) OVER () AS total
    FROM scores WHERE turn > 0),
asked AS (SELECT unnest(range(1, 20)) AS cand),
places AS (
    SELECT DISTINCT cand, (cand * 5)::DOUBLE AS percentile, (total - 1) * ((cand * 5)::DOUBLE / 100) AS h
    FROM asked, pool),
thresholds AS (
    SELECT cand, percentile,
           CASE WHEN h - floor(h) < 0.5 THEN lo.x + (hi.x - lo.x) * (h - floor(h))
                ELSE hi.x - (hi.x - lo.x) * (1 - (h - floor(h))) END AS delta_star
    FROM places
    JOIN pool lo ON lo.r = floor(h)::BIGINT
    JOIN pool hi ON hi.r = least(floor(h)::BIGINT + 1, hi.total - 1)
    WHERE delta_star > 0)"""

_GRID_PRED = """
pred AS (
    SELECT cand, conv_id, turn, coalesce((ahead >= delta_star)::INT, 0) AS label
    FROM (SELECT conv_id, turn, lead(delta_eff) OVER (PARTITION BY conv_id ORDER BY turn) AS ahead FROM scores), thresholds)"""

_GRID = f"{_EMB},{_GOLD},{_POOL},{_GRID_PRED},{_METRICS}"
_FIGURES = "round(pk, 6) AS pk, round(wd, 6) AS wd, round(f1, 6) AS f1, round(score, 6) AS score, n"
_CHOSEN = f"""SELECT percentile, round(delta_star, 6) AS delta_star, {_FIGURES}
              FROM corpus JOIN thresholds USING (cand)"""


def _evaluated(metric: str) -> str:
    return f"""{_EMB},{_GOLD},{_ONE_PRED},{_METRICS}
               SELECT conv_id, round({metric}, 6) AS {metric} FROM dialogues"""


def _summary(part_turns: int) -> str:
    return f"""
        {_EMB}, spans AS ({_SEGMENTS}),
        listed AS (
            SELECT conv_id, start // {part_turns} AS part,
                   string_agg(start || '-' || end_exclusive, ',' ORDER BY start) AS segments
            FROM spans GROUP BY ALL),
        parts AS (
            SELECT conv_id, turn // {part_turns} AS part,
                   coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (WHERE is_boundary), '') AS boundaries,
                   string_agg(round(delta_eff * 1e6)::BIGINT::VARCHAR, ',' ORDER BY turn) AS scores,
                   string_agg(round(graded_score * 1e6)::BIGINT::VARCHAR, ',' ORDER BY turn) AS graded_scores
            FROM history GROUP BY ALL)
        SELECT conv_id, part, boundaries, coalesce(segments, '') AS segments, scores, graded_scores
        FROM parts LEFT JOIN listed USING (conv_id, part)"""


def _texts(part_turns: int) -> str:
    return f"""
        {_CONV}, starts AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, topic_id) AS first FROM history)
        SELECT conv_id, topic_id, (turn - first) // {part_turns} AS part, min(turn) AS start,
               max(turn) + 1 AS end_exclusive, string_agg(text, chr(10) ORDER BY turn) AS text
        FROM starts GROUP BY ALL"""


_FIT = _EMBEDDINGS.replace("FROM embeddings", "FROM embeddings WHERE vec_id % 13 <> 5").replace(
    "label,", "vec_id % 20 AS input_turn,"
)

_MATRIX_TURNS = f"WITH {_EMBEDDINGS} SELECT conv_id, turn, len(v)::INT AS dim, round(v[1], 6) AS first FROM raw"
_CALIBRATION_TURNS = f"""
    WITH {_EMBEDDINGS},{_GOLD}
    SELECT turn, gold.label::BIGINT AS label, round(v[1], 6) AS first FROM raw JOIN gold USING (conv_id, turn)"""
_EVALUATION = f"{_EMB},{_GOLD},{_ONE_PRED},{_METRICS} SELECT {_FIGURES} FROM corpus"
_DOCUMENT_SEGMENTS = f"""
    WITH {_LINES}, texts AS (SELECT * FROM lines), {_COUNTS},{_scores(delta=TEXT_DELTA)} {_SEGMENTS}"""


def statements() -> dict[str, str]:
    return {
        "turns_from_text": f"WITH {_LINES} SELECT conv_id, turn, text FROM lines",
        "text_file_turns": r"""
            SELECT conv_id // 64 AS bucket,
                   row_number() OVER (PARTITION BY conv_id // 64 ORDER BY conv_id, turn) - 1 AS turn,
                   regexp_replace(text, '[\r\n]+', ' ', 'g') AS text
            FROM conversations""",
        "session_turns": """
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, text
            FROM conversations WHERE role = 'user'""",
        "matrix_turns": _MATRIX_TURNS,
        "matrix_turns_parts": _MATRIX_TURNS,
        "calibration_json": _CALIBRATION_TURNS,
        "calibration_document": _CALIBRATION_TURNS,
        "evaluation_json": _EVALUATION,
        "evaluation_document": _EVALUATION,
        "numbered_turns": """
            SELECT o_custkey AS conv_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS turn,
                   o_orderkey FROM orders""",
        "hash_encode": _TOKEN_COUNTS,
        "encode_distinct": _TOKEN_COUNTS,
        "invalid_embeddings": f"""
            WITH {_EMBEDDINGS}
            SELECT conv_id, turn, CASE label WHEN 0 THEN 'zero' WHEN 1 THEN 'dimension' ELSE 'not_finite' END AS reason
            FROM raw WHERE label IN (0, 1, 2)""",
        "invalid_text_turns": f"""
            WITH {_LINES} SELECT conv_id, count(*) AS n,
                   count(*) FILTER (WHERE NOT regexp_matches(lower(text), '[a-z]')) AS n_invalid
            FROM lines GROUP BY conv_id""",
        "label_violations": f"""
            WITH {_EMBEDDINGS}
            SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE label = 0) AS bad_labels,
                   count(*) FILTER (WHERE label = 1) AS unpaired
            FROM raw GROUP BY conv_id HAVING count(*) < 2 OR count(*) FILTER (WHERE label IN (0, 1)) > 0""",
        "mixed_dimensions": f"""
            WITH {_EMBEDDINGS}
            SELECT conv_id, min(if(label = 1, 63, len(v)))::INT AS shortest, max(if(label = 1, 63, len(v)))::INT AS longest
            FROM raw GROUP BY conv_id HAVING shortest <> longest""",
        "unit_vectors": """
            WITH u AS (
                SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
            SELECT vec_id, i - 1 AS pos, round(v[i] / sqrt(list_dot_product(v, v)), 6) AS value FROM u""",
        "adjacent_distance": f"{_EMB} SELECT conv_id, turn, round(d_prev, 6) AS d_prev FROM distances",
        "context_distance": f"""
            SELECT 2 AS m, * FROM ({_EMB} SELECT conv_id, turn, round(d_ctx, 6) AS d_ctx FROM distances)
            UNION ALL
            SELECT 3 AS m, * FROM (
                WITH {_EMBEDDINGS},{_scores(3)} SELECT conv_id, turn, round(d_ctx, 6) AS d_ctx FROM distances)""",
        "context_distance_legacy": f"""
            WITH {_EMBEDDINGS},{_scores(4, legacy=True)}
            SELECT conv_id, turn, round(d_ctx, 6) AS d_ctx FROM distances""",
        "blended_score": f"{_EMB} SELECT conv_id, turn, round(delta_eff, 6) AS delta_eff FROM scores",
        "graded_score": f"{_EMB} SELECT conv_id, turn, round(graded_score, 6) AS graded_score FROM flags",
        "boundary_flags": f"{_EMB} SELECT conv_id, turn, is_boundary FROM flags",
        "topic_ids": f"{_EMB} SELECT conv_id, turn, topic_id FROM history",
        "history": _HISTORY,
        "history_sql": _HISTORY,
        "history_jvm": _HISTORY,
        "history_split": _HISTORY,
        "stream_segment": _HISTORY.replace("SELECT conv_id, turn, topic_id", "SELECT false AS late, conv_id, turn, topic_id"),
        "stream_set_aside": f"""
            WITH {_FIT},{_scores(extra=", input_turn")}
            SELECT conv_id, input_turn, turn, topic_id, round(delta_eff, 6) AS delta_eff, NULL AS reason FROM history
            UNION ALL
            SELECT vec_id // 20, vec_id % 20, NULL, NULL, NULL, 'zero' FROM embeddings WHERE vec_id % 13 = 5""",
        "stream_in_order": _HISTORY.replace("SELECT conv_id, turn, topic_id", "SELECT false AS late, conv_id, turn, topic_id"),
        "stream_segments": f"{_EMB} {_SEGMENTS}",
        "stream_segment_text": _texts(3),
        "strength_bands": f"{_EMB} SELECT conv_id, turn, {_BAND} AS band FROM flags",
        "strength_histogram": f"""
            {_EMB} SELECT conv_id, {_STRENGTH} FROM (SELECT *, {_BAND} AS band FROM flags) GROUP BY conv_id""",
        "strength_rollup": f"""
            {_EMB} SELECT conv_id, {_STRENGTH} FROM (SELECT *, {_BAND} AS band FROM flags)
            GROUP BY GROUPING SETS ((conv_id), ())""",
        "strength_totals": f"{_EMB} SELECT {_STRENGTH} FROM (SELECT *, {_BAND} AS band FROM flags)",
        "segments": f"{_EMB} {_SEGMENTS}",
        "segments_json": f"{_EMB} {_SEGMENTS}",
        "dialogue_summary": _summary(16384),
        "dialogue_summary_parts": _summary(6),
        "conversation_segments": f"{_CONV} {_SEGMENTS}",
        "segment_text": _texts(16384),
        "segment_text_parts": _texts(3),
        "document_segments": _DOCUMENT_SEGMENTS,
        "document_segments_split": _DOCUMENT_SEGMENTS,
        "turns_set_aside": """
            SELECT vec_id // 20 AS conv_id, vec_id % 20 AS turn, 'zero' AS reason FROM embeddings WHERE vec_id % 13 = 5""",
        "history_set_aside": _HISTORY.replace(_EMBEDDINGS, _FIT),
        "corpus_counts": "SELECT count(DISTINCT conv_id) AS n_sessions, count(*) AS n_exchanges FROM conversations",
        "end_turn_labels": f"{_EMB},{_ONE_PRED} SELECT conv_id, turn, label FROM pred",
        "metric_window_size": f"WITH {_EMBEDDINGS},{_GOLD} SELECT conv_id, n, b, k FROM sizes",
        "pk": _evaluated("pk"),
        "windowdiff": _evaluated("wd"),
        "boundary_f1": _evaluated("f1"),
        "evaluate_corpus": _EVALUATION,
        "threshold_candidates": f"{_EMB},{_POOL} SELECT percentile, round(delta_star, 6) AS delta_star FROM thresholds",
        "calibration_grid": f"{_GRID} {_CHOSEN}",
        "calibrate_score": f"{_GRID} {_CHOSEN} ORDER BY round(corpus.score, 12) DESC, cand LIMIT 1",
        "calibrate_f1": f"{_GRID} {_CHOSEN} ORDER BY round(corpus.f1, 12) DESC, cand LIMIT 1",
    }
