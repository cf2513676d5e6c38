"""DuckDB SQL for the Merkle manifest: one step of the trees per subquery, siblings by joining runs."""

from __future__ import annotations

#: Steps written out: trees of 8^8 documents in a language, 8^4 languages.
STEPS, UPPER_STEPS = 8, 4

_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
    lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def _digest(text: str) -> str:
    values = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    fields = [f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values]
    return f"sha256({' || '.join(fields)})"


def _trees(name: str, steps: int) -> str:
    """name0 (seq, pos, h) and up: nodes, the siblings of each on both sides, and the last node as name_top."""
    parts = []
    for k in range(steps):
        several = f"seq IN (SELECT seq FROM {name}{k} GROUP BY seq HAVING count(*) > 1)"
        parts.append(
            f"{name}{k + 1} AS (SELECT seq, pos // 8 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h"
            f" FROM {name}{k} WHERE {several} GROUP BY seq, pos // 8)"
        )
        parts.append(
            f"{name}_side{k} AS (SELECT a.seq, a.pos,"
            f" coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,"
            f" coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r"
            f" FROM {name}{k} a JOIN {name}{k} b ON a.seq = b.seq AND a.pos // 8 = b.pos // 8"
            f" WHERE a.{several} GROUP BY a.seq, a.pos)"
        )
    tops = [
        f"SELECT seq, any_value(h) AS h FROM {name}{k} GROUP BY seq HAVING count(*) = 1" for k in range(steps + 1)
    ]
    return ",\n".join([*parts, f"{name}_top AS ({' UNION ALL '.join(tops)})"])


def _folds(name: str, start: str, seq: str, pos: str, steps: int) -> str:
    """start (x, proof) and up: the digest after each step, and the siblings passed."""
    parts = []
    for k in range(steps):
        before = start if k == 0 else f"{name}_fold{k - 1}"
        parts.append(
            f"{name}_fold{k} AS (SELECT f.* REPLACE (CASE WHEN s.seq IS NULL THEN x ELSE sha256(l || x || r) END AS x,"
            f" proof || coalesce(l || r, '') AS proof) FROM {before} f LEFT JOIN {name}_side{k} s"
            f" ON s.seq = f.{seq} AND s.pos = f.{pos} // {8**k})"
        )
    return ",\n".join(parts)


MANIFEST_SQL = f"""
WITH rows_ AS (SELECT doc_id, lang, {_digest("text")} AS leaf,
    CASE WHEN {_CRC} % 3 = 0 THEN {_digest(
        "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered
  FROM documents),
placed AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS seq,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows_),
d0 AS (SELECT seq, pos, leaf AS h FROM placed),
{_trees("d", STEPS)},
u0 AS (SELECT 0 AS seq, seq AS pos, h FROM d_top),
{_trees("u", UPPER_STEPS)},
begun AS (SELECT *, 0 AS whole, coalesce(tampered, leaf) AS x, '' AS proof FROM placed),
{_folds("d", "begun", "seq", "pos", STEPS)},
{_folds("u", f"d_fold{STEPS - 1}", "whole", "seq", UPPER_STEPS)}
SELECT doc_id, leaf, t.h AS subroot, w.h AS root, sha256(proof) AS proof_sha256, x AS folded_root,
  x = w.h AS verified
FROM u_fold{UPPER_STEPS - 1} f JOIN d_top t ON t.seq = f.seq CROSS JOIN u_top w
"""
