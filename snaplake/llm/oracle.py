r"""SQL with the results of those queries of this package that SQL can express."""

#: The CRC-32 of the ASCII text ``x``, as a lambda over its bytes; -1 stands for a shift by one bit.
_CRC = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({x}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda s, e: CASE WHEN e >= 0 THEN xor(s, e) ELSE xor(s >> 1, (s & 1) * 3988292384) END))"""

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

op12_line_dedup = rf"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM texts
), keyed AS (
  SELECT *, translate(trim(line, {_WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeps FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeps AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_LEAF = "sha256(" + " || ".join(
    f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END" for c in ("doc_id", "source", "lang", "{n}", "text")
) + ")"


def _tree(name: str, leaves: str) -> str:
    """CTEs ``name`` (grp, level, place, hash) of all nodes above ``leaves`` (grp, place, hash), places from 0."""
    return f"""{name} AS (
  SELECT grp, 0 AS level, place, hash, count(*) OVER (PARTITION BY grp) AS n FROM {leaves}
  UNION ALL
  SELECT grp, level + 1, place // 2, sha256(string_agg(hash, '' ORDER BY place)), any_value((n + 1) // 2)
  FROM {name} WHERE n > 1 GROUP BY grp, level, place // 2
)"""


op13_merkle_manifest = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, {_LEAF.format(n="n_chars")} AS leaf,
    CASE WHEN {_CRC.format(x="doc_id::VARCHAR")} % 7 = 0 THEN {_LEAF.format(n="(n_chars + 1)")} ELSE {_LEAF.format(n="n_chars")} END AS now
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, leaf AS hash FROM docs
), {_tree("tree", "leaves")}, subroots AS (
  SELECT grp AS own, '' AS grp, hash, row_number() OVER (ORDER BY grp) - 1 AS place FROM tree WHERE n = 1
), {_tree("upper", "subroots")}, walked AS (
  SELECT l.doc_id, l.leaf, l.now, l.grp AS own, 1 AS part, l.grp, 0 AS level, l.place, '' AS siblings, l.now AS folded FROM leaves l
  UNION ALL
  SELECT w.doc_id, w.leaf, w.now, w.own,
    CASE WHEN t.n = 1 THEN 2 ELSE w.part END, CASE WHEN t.n = 1 THEN '' ELSE w.grp END,
    CASE WHEN t.n = 1 THEN 0 ELSE w.level + 1 END, CASE WHEN t.n = 1 THEN r.place ELSE w.place // 2 END,
    CASE WHEN t.n = 1 THEN w.siblings ELSE w.siblings || coalesce(s.hash, '') END,
    CASE WHEN t.n = 1 THEN w.folded WHEN w.place % 2 = 1 THEN sha256(s.hash || w.folded) ELSE sha256(w.folded || coalesce(s.hash, '')) END
  FROM walked w
  JOIN (SELECT 1 AS part, * FROM tree UNION ALL SELECT 2, * FROM upper) t USING (part, grp, level, place)
  LEFT JOIN (SELECT 1 AS part, * FROM tree UNION ALL SELECT 2, * FROM upper) s
    ON s.part = w.part AND s.grp = w.grp AND s.level = w.level AND s.place = xor(w.place, 1)
  LEFT JOIN subroots r ON r.own = w.own
  WHERE NOT (w.part = 2 AND t.n = 1)
), top AS (SELECT hash FROM upper WHERE n = 1)
SELECT w.doc_id, w.leaf, s.hash AS subroot, top.hash AS root, sha256(w.siblings) AS proof_sha256, w.folded AS folded_root, w.folded = top.hash AS verified
FROM walked w JOIN upper u ON w.part = 2 AND u.n = 1 AND u.level = w.level AND u.place = w.place
JOIN subroots s ON s.own = w.own CROSS JOIN top
"""

#: State 0 is before the first turn, 1 after the system turn, 2 after a user turn, 3 after an assistant turn.
#: A cost and its audit are one text, the cost with leading zeros, so that the least text is the least audit of the least cost.
_ADD = "lpad((left({t}, 12)::BIGINT + {c})::VARCHAR, 12, '0') || '{e}' || substr({t}, 13)"
_DROP = {s: _ADD.format(t=f"a{s}", c=3, e="D") for s in range(4)}
_MAKE = {s: _ADD.format(t=f"a{t}", c="2 + trunc", e="R") for s, t in enumerate((2, 2, 3, 2))}


def _kept(initial: str, to: int) -> str:
    return f"CASE WHEN initial = '{initial}' THEN {_ADD.format(t=f'a{to}', c='trunc', e='K')} END"


_BASE = {
    0: [_DROP[0], f"CASE WHEN NOT doomed THEN least({_MAKE[0]}, {_kept('s', 1)}, {_kept('u', 2)}) END"],
    1: [_DROP[1], f"CASE WHEN NOT doomed THEN least({_MAKE[1]}, {_kept('u', 2)}) END"],
    2: [_DROP[2], f"CASE WHEN NOT doomed THEN least({_MAKE[2]}, {_kept('a', 3)}) END"],
    3: [_DROP[3], f"CASE WHEN NOT doomed THEN least({_MAKE[3]}, {_kept('u', 2)}) END"],
}


def _insert(t: str) -> str:
    return _ADD.format(t=t, c=2, e="I")


op11_doubled_paths = rf"""
WITH RECURSIVE dealt AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_CRC.format(x="(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fault
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM dealt WHERE fault <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
    rtrim(text, {_WHITE}) AS bare, left(role, 1) AS initial
  FROM damaged
), marked AS (
  SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS duplicate,
    lead(initial) OVER (PARTITION BY conv_id ORDER BY place) AS after
  FROM placed
), judged AS (
  SELECT *, blank OR duplicate AS doomed, (NOT blank AND NOT duplicate AND right(bare, 1) NOT IN ('.', '!', '?'))::INT AS trunc FROM marked
), wrong AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, sum(trunc)::BIGINT AS truncated,
    count(*) FILTER (after IS NOT NULL AND initial || after NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS n
  FROM judged GROUP BY conv_id
), solved AS (
  SELECT conv_id, n + 1 AS place, '000000000000' AS a0, '000000000004II' AS a1, '000000000002I' AS a2, '000000000000' AS a3 FROM wrong
  UNION ALL
  SELECT conv_id, place, least(b0, {_insert("least(b2, " + _insert("b3") + ")")}), least(b1, {_insert("least(b2, " + _insert("b3") + ")")}),
    least(b2, {_insert("b3")}), least(b3, {_insert("b2")})
  FROM (
    SELECT s.conv_id, j.place, {", ".join(f"least({', '.join(_BASE[k])}) AS b{k}" for k in range(4))}
    FROM solved s JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.place = s.place - 1
  )
), best AS (
  SELECT conv_id, left(a0, 12)::BIGINT AS cost, substr(a0, 13) AS audit FROM solved WHERE place = 1
), edits AS (
  SELECT conv_id, k, audit[k] AS edit, length(replace(audit[1:k], 'I', '')) AS place, length(replace(audit[1:k], 'D', '')) AS nth
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM best)
), turns AS (
  SELECT e.conv_id, e.k, CASE WHEN e.edit = 'K' THEN j.role WHEN (e.nth % 2 = 1) = (coalesce(h.initial, '') <> 's') THEN 'user' ELSE 'assistant' END AS role,
    CASE WHEN e.edit = 'I' THEN '' ELSE j.text END AS text
  FROM edits e LEFT JOIN judged j ON e.edit <> 'I' AND j.conv_id IS NOT DISTINCT FROM e.conv_id AND j.place = e.place
  LEFT JOIN (
    SELECT f.conv_id, j.initial FROM edits f JOIN judged j ON j.conv_id IS NOT DISTINCT FROM f.conv_id AND j.place = f.place
    WHERE f.edit = 'K' AND f.nth = 1
  ) h ON h.conv_id IS NOT DISTINCT FROM e.conv_id
  WHERE e.edit <> 'D'
), texts AS (SELECT conv_id, sha256(string_agg(role || ':' || text, chr(10) ORDER BY k)) AS sha FROM turns GROUP BY conv_id)
SELECT c.conv_id, coalesce(w.gaps, 0) AS gaps, coalesce(w.blank, 0) AS blank, coalesce(w.duplicate, 0) AS duplicate,
  coalesce(w.truncated, 0) AS truncated, coalesce(w.illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost,
  coalesce(b.audit, '') AS audit, coalesce(t.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN wrong w ON w.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""
