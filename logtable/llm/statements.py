"""SQL for the iterative operators, written out round by round or step by step."""

from __future__ import annotations

from logtable.llm import turn_repair as repair
from logtable.llm import vector_codes as codes


def vector_codes_sql(entries: int = codes.ENTRIES, rounds: int = codes.ROUNDS, parts: int = codes.PARTS) -> str:
    """Codebooks by rounds of common table expressions; vectors of one length, a multiple of the parts."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS k, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""cut AS MATERIALIZED (
  SELECT k, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS part FROM kept, range({parts}) AS r(p)
)""",
        f"book0 AS MATERIALIZED (SELECT p, k - 1 AS e, part AS centre FROM cut WHERE k <= {entries})",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""near{n} AS MATERIALIZED (
  SELECT k, p, part, min(struct_pack(d, e)) AS best FROM (
    SELECT k, c.p, part, e,
           list_sum(list_transform(list_zip(part, centre), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM cut c JOIN book{n} b ON c.p = b.p
  ) GROUP BY k, p, part
)"""
        )
        if n < rounds:
            steps.append(
                f"""mean{n} AS MATERIALIZED (
  SELECT p, e, list(CAST(m AS BIGINT) ORDER BY i) AS centre FROM (
    SELECT p, best.e AS e, i,
           (sum(part[i]) - ((sum(part[i]) % count(*)) + count(*)) % count(*)) // count(*) AS m
    FROM near{n}, LATERAL (SELECT unnest(range(1, len(part) + 1)) AS i) GROUP BY p, best.e, i
  ) GROUP BY p, e
)"""
            )
            steps.append(
                f"""book{n + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.centre, b.centre) AS centre FROM book{n} b LEFT JOIN mean{n} m ON b.p = m.p AND b.e = m.e
)"""
            )
    steps.append(
        f"""coded AS (
  SELECT k, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY k
)"""
    )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(centre, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (k)
"""


def _edit_rows() -> str:
    """Ways over one row, as SQL values: last role, kind of row, may it stay, letters, cost, next role."""
    out = []
    for last in range(4):
        for kind in range(4):
            for stays in (0, 1):
                ways = [("D", repair.DELETE, last)]
                if stays:
                    # with up to two turns put in before
                    at, before, paid = last, "", 0
                    for _ in range(3):
                        way = repair._NEXT[at]
                        ways.append((before + "R", paid + repair.REROLE, way))
                        if kind == way or (kind == repair.SYSTEM and at == repair.EMPTY):
                            ways.append((before + "K", paid + repair.KEEP, kind))
                        at, before, paid = way, before + "I", paid + repair.INSERT
                out += [f"({last}, {kind}, {stays}, '{letters}', {cost}, {to})" for letters, cost, to in ways]
    return ", ".join(out)


def turn_repair_sql() -> str:
    """Cheapest edits by a step per row over (conversation, last role)."""
    table = "(SELECT list(c ORDER BY b) FROM (SELECT b, {} AS c FROM range(256) AS r(b)))"
    step = "CAST(b AS BIGINT)"
    for _ in range(8):
        step = f"list_transform([{step}], lambda c: xor(c >> 1, 3988292384 * (c & 1)))[1]"
    crc = (
        "xor(4294967295, list_reduce(list_transform(string_split(key, ''), lambda c: CAST(ord(c) AS BIGINT)), "
        "lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1]), 4294967295))"
    )
    spaces = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE crcs AS MATERIALIZED (SELECT {table.format(step)} AS steps),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), faulty AS MATERIALIZED (SELECT conv_id, turn, role, text, {crc} % 20 AS fault FROM keyed, crcs),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM faulty, LATERAL (SELECT unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END))) AS copies WHERE fault <> 0
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS earlier FROM damaged
), judged AS (
  SELECT *, rtrim(text, {spaces}) AS shown, left(role, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), earlier) AS k
  FROM seen
), coded AS MATERIALIZED (
  SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN earlier > 1 THEN 'duplicate'
                 WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         CASE initial WHEN 's' THEN {repair.SYSTEM} WHEN 'u' THEN {repair.USER} WHEN 'a' THEN {repair.ASSISTANT} ELSE {repair.OTHER} END AS kind,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS pair
  FROM judged
), ways(last, kind, stays, letters, paid, next) AS (VALUES {_edit_rows()}),
ends(last, letters, paid) AS (VALUES ({repair.EMPTY}, '', 0), ({repair.SYSTEM}, 'II', {2 * repair.INSERT}), ({repair.USER}, 'I', {repair.INSERT}), ({repair.ASSISTANT}, '', 0)),
states(conv_id, k, last, best) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), {repair.EMPTY}, struct_pack(cost := 0, audit := '') FROM conversations
  UNION ALL
  SELECT s.conv_id, s.k + 1, w.next,
         min(struct_pack(cost := s.best.cost + w.paid + CASE WHEN c.fault = 'truncated' AND w.letters <> 'D' THEN {repair.CUT} ELSE 0 END,
                         audit := s.best.audit || w.letters))
  FROM states s JOIN coded c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.k = s.k + 1
  JOIN ways w ON w.last = s.last AND w.kind = c.kind AND w.stays = CASE WHEN c.fault IN ('blank', 'duplicate') THEN 0 ELSE 1 END
  GROUP BY s.conv_id, s.k + 1, w.next
), sizes AS (
  SELECT o.conv_id, count(c.k) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
  FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN coded c ON c.conv_id IS NOT DISTINCT FROM o.conv_id GROUP BY o.conv_id
), solved AS MATERIALIZED (
  SELECT z.conv_id, min(struct_pack(cost := s.best.cost + e.paid, audit := s.best.audit || e.letters)) AS best
  FROM sizes z JOIN states s ON s.conv_id IS NOT DISTINCT FROM z.conv_id AND s.k = z.n JOIN ends e ON e.last = s.last GROUP BY z.conv_id
), edits AS (
  SELECT conv_id, i, best.audit[i] AS letter, best.audit,
         len(replace(left(best.audit, i), 'I', '')) AS k, len(replace(left(best.audit, i), 'D', '')) AS place
  FROM solved, LATERAL (SELECT unnest(range(1, len(best.audit) + 1)) AS i)
), lines AS (
  SELECT e.conv_id, e.place,
         CASE WHEN letter = 'K' THEN c.role
              WHEN (place + CASE WHEN first_kept.kind = {repair.SYSTEM} THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
           || ':' || CASE WHEN letter = 'I' THEN '' ELSE c.text END AS line
  FROM edits e LEFT JOIN coded c ON c.conv_id IS NOT DISTINCT FROM e.conv_id AND c.k = e.k
  JOIN (SELECT f.conv_id, CASE WHEN f.letter = 'K' THEN g.kind ELSE {repair.USER} END AS kind
        FROM edits f LEFT JOIN coded g ON g.conv_id IS NOT DISTINCT FROM f.conv_id AND g.k = f.k
        WHERE f.place = 1 AND f.letter <> 'D') first_kept ON first_kept.conv_id IS NOT DISTINCT FROM e.conv_id
  WHERE letter <> 'D'
)
SELECT z.conv_id, gaps, blank, duplicate, truncated, illegal, CAST(s.best.cost AS BIGINT) AS cost, s.best.audit AS audit,
       sha256(coalesce(h.whole, '')) AS repaired_sha256
FROM sizes z JOIN solved s ON s.conv_id IS NOT DISTINCT FROM z.conv_id
LEFT JOIN (SELECT conv_id, string_agg(line, chr(10) ORDER BY place) AS whole FROM lines GROUP BY conv_id) h
  ON h.conv_id IS NOT DISTINCT FROM z.conv_id
"""
