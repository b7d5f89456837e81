"""DuckDB SQL of the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

from . import mixing

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TOKENS = rf"regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+')"

OP2 = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
 i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
 n AS (SELECT *, least(13, len(w)) AS m FROM i WHERE len(w) > 0),
 g AS (SELECT DISTINCT item_id, m, w[a:a + m - 1] AS gram FROM n, unnest(generate_series(1, len(w) - m + 1)) AS s(a)),
 t AS (SELECT k, m, a, w[a:a + m - 1] AS gram FROM d, (SELECT DISTINCT m FROM g), unnest(generate_series(1, len(w) - m + 1)) AS s(a)),
 f AS (SELECT k, a, g.m, item_id FROM t JOIN g ON t.gram = g.gram AND t.m = g.m),
 h AS (SELECT k, count(DISTINCT p) AS n_hit FROM f, unnest(generate_series(a, a + m - 1)) AS s(p) GROUP BY k),
 j AS (SELECT k, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT k, item_id::VARCHAR AS x FROM f) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
 sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN j USING (k)"""

OP5 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[a:a + 2], ' ') AS x FROM d, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS r(a) WHERE len(w) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
 l AS (SELECT p.x, p.y FROM p JOIN n a ON a.doc_id = p.x JOIN n b ON b.doc_id = p.y WHERE 100 * c >= 85 * (a.n + b.n - c)),
 r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
 m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN m ON m.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

OP7 = """WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 w AS (SELECT k, a, md5(substr(h, 2 * a + 1, 400)) AS x FROM d, unnest(range(0, length(h) // 2 - 199)) AS r(a)),
 t AS (SELECT x FROM w GROUP BY x HAVING count(*) > 1),
 g AS (SELECT k, a, lag(a) OVER (PARTITION BY k ORDER BY a) AS b FROM w SEMI JOIN t USING (x)),
 i AS (SELECT k, a, count_if(b IS NULL OR a > b + 200) OVER (PARTITION BY k ORDER BY a) AS i FROM g),
 s AS (SELECT k, i, min(a) AS a, max(a) + 200 AS b FROM i GROUP BY k, i),
 e AS (SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS c FROM s),
 p AS (SELECT k, sum(b - a) AS gone, count(*) AS n, max(b) AS z, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS kept
  FROM e JOIN d USING (k) GROUP BY k)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
 sha256(unhex(coalesce(kept || substr(h, 2 * z + 1), h))) AS kept_sha256
FROM d LEFT JOIN p USING (k)"""


def _number(x: float) -> str:
    """A literal that is read as a double."""
    return f"{x!r}::DOUBLE" if "e" in repr(x) else f"{x!r}e0"


def _time(share: str, schedule) -> str:
    """Inverse of a schedule's integral, written out piece by piece."""
    pieces, total = mixing.pieces_of(schedule)
    done, out = f"({share} * {_number(total)})", ""
    for low, high, t0, w0, slope in pieces:
        left = f"greatest({done} - {_number(low)}, 0e0)"
        if slope == 0:
            root = f"{left} / {_number(w0)}"
        else:
            root = f"(sqrt(greatest({_number(w0 * w0)} + {_number(2 * slope)} * {left}, 0e0)) - {_number(w0)}) / {_number(slope)}"
        at = f"{_number(t0)} + {root}"
        out += f"WHEN {done} < {_number(high)} THEN {at} " if high < total else f"ELSE {at} "
    return f"least(CASE {out}END, 1e0)" if "WHEN" in out else f"least({at}, 1e0)"


def _copy(k: int) -> str:
    return f"({k} * source_size + middle <= target AND ({k} = 0 OR source_size > 0))"


_CAPPED = "weight * r.level > 3 * source_size"
OP6 = f"""WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
 w AS (SELECT source, source_size, (rank % 3)::INT AS place, [5, 2, 1][rank % 3 + 1] AS weight FROM s),
 r(k, level) AS (SELECT 0, (SELECT sum(source_size) / sum(weight) FROM w) UNION ALL
  SELECT k + 1, (SELECT sum(CASE WHEN {_CAPPED} THEN -2 * source_size ELSE source_size END) / nullif(sum(CASE WHEN {_CAPPED} THEN 0 ELSE weight END), 0) FROM w)
  FROM r WHERE k < 100 AND level IS NOT NULL),
 t AS (SELECT w.*, least(weight * (SELECT max(level) FROM r), (3 * source_size)::DOUBLE) AS target FROM w),
 o AS (SELECT doc_id, size, source_size, target, place,
  sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS UNBOUNDED PRECEDING)::BIGINT - size / 2 AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
 c AS (SELECT *, CASE WHEN target > 0 THEN middle / target ELSE 0e0 END AS share, {" + ".join(f"{_copy(k)}::INT" for k in range(3))} AS copies FROM o)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies,
 CASE WHEN copies > 0 THEN CASE place {" ".join(f"WHEN {i} THEN {_time('share', s)}" for i, s in enumerate(mixing.SCHEDULES))} END END AS first_position
FROM c"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": OP2, "op5_minhash": OP5, "op6_mixing": OP6, "op7_suffix_dedup": OP7}
