"""DuckDB SQL of the queries that SQL can express.

DuckDB has no crc32, so it is spelled out as a fold over the hex digits of the
UTF-8 bytes, low digit first, with a table of 16 steps worked out here."""

from __future__ import annotations


def _steps() -> list[int]:
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def crc32(text: str) -> str:
    """SQL of the unsigned crc32 of a text's UTF-8 bytes."""
    digits = (f"list_transform(range(2 * octet_length(encode({text}))), "
              f"lambda i: instr('0123456789ABCDEF', substr(hex(encode({text})), (xor(i, 1) + 1)::INT, 1))::BIGINT - 1)")
    step = f"xor(c >> 4, ({_steps()}::BIGINT[])[(xor(c, d) & 15) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda c, d: {step}), 4294967295::BIGINT)"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, {_LOWER.format('run')} AS run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, c, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs),
vocab AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c
    FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN vocab b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN vocab b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 2 * v.n THEN b.other END AS form,
         CASE WHEN b.other_n >= 2 * v.n THEN b.other_n END AS form_n
  FROM vocab v LEFT JOIN best b ON v.word = b.word),
chain AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.at AS root FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, r.root, f.n::BIGINT AS n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM forms f JOIN roots r ON f.word = r.word
"""


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(({value})::VARCHAR))::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


def _levels(name: str, start: str) -> str:
    """Recursive levels of trees: (tree, lvl, idx, h, n)."""
    return f"""{name} AS (
  SELECT tree, 0 AS lvl, idx, h, n FROM {start}
  UNION ALL SELECT tree, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2
  FROM {name} WHERE n > 1 GROUP BY tree, lvl, idx // 2, n)"""


OP12 = f"""
WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n
  FROM (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf('n_chars')} AS h,
               CASE WHEN {crc32("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf('n_chars + 1')} ELSE {_leaf('n_chars')} END AS claim
        FROM documents)),
{_levels('inner_lv', 'leaves')},
subroots AS (SELECT '' AS tree, tree AS lang, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n
             FROM inner_lv WHERE n = 1),
{_levels('outer_lv', 'subroots')},
top AS (SELECT h FROM outer_lv WHERE n = 1),
-- every step of every leaf's way up: (tree, idx, at): its node's place at that step and the sibling, if any
steps AS (
  SELECT l.tree, l.idx, lv.lvl, (l.idx >> lv.lvl) % 2 = 1 AS is_right, s.h AS sibling
  FROM leaves l JOIN (SELECT DISTINCT tree, lvl FROM inner_lv WHERE n > 1) lv ON l.tree = lv.tree
  LEFT JOIN inner_lv s ON s.tree = l.tree AND s.lvl = lv.lvl AND s.idx = xor(l.idx >> lv.lvl, 1)
  UNION ALL
  SELECT l.tree, l.idx, 1000 + lv.lvl, (r.idx >> lv.lvl) % 2 = 1, s.h
  FROM leaves l JOIN subroots r ON l.tree = r.lang CROSS JOIN (SELECT DISTINCT lvl FROM outer_lv WHERE n > 1) lv
  LEFT JOIN outer_lv s ON s.lvl = lv.lvl AND s.idx = xor(r.idx >> lv.lvl, 1)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tree, idx ORDER BY lvl) AS k FROM steps),
proofs AS (SELECT tree, idx, sha256(coalesce(string_agg(sibling, '' ORDER BY k), '')) AS proof, max(k) AS last FROM numbered GROUP BY tree, idx),
folding AS (
  SELECT tree, idx, 0::BIGINT AS k, claim AS h FROM leaves
  UNION ALL
  SELECT f.tree, f.idx, s.k, sha256(CASE WHEN s.sibling IS NULL THEN f.h WHEN s.is_right THEN s.sibling || f.h ELSE f.h || s.sibling END)
  FROM folding f JOIN numbered s ON f.tree = s.tree AND f.idx = s.idx AND s.k = f.k + 1)
SELECT l.doc_id, l.h AS leaf, r.h AS subroot, top.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.h AS folded_root,
       f.h = top.h AS verified
FROM leaves l JOIN subroots r ON l.tree = r.lang CROSS JOIN top
LEFT JOIN proofs p ON p.tree = l.tree AND p.idx = l.idx
JOIN folding f ON f.tree = l.tree AND f.idx = l.idx AND f.k = coalesce(p.last, 0)
"""

OP13 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
placed AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (
  -- a backslash more for each backslash, for each # that two more follow, and for each control string
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
         + len(list_filter(range(1, length(text) - 1), lambda i: substr(text, i, 3) = '###'))
         + (length(text) - length(replace(text, '</turn>', ''))) // 7 + (length(text) - length(replace(text, '<next>', ''))) // 6
         + CASE WHEN before IS DISTINCT FROM role THEN 6 + length(url_encode(role)) ELSE 6 END
         + CASE WHEN after IS DISTINCT FROM role THEN 8 ELSE 0 END AS chars
  FROM placed)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
