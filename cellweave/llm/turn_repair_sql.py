"""SQL of operator 12's query for DuckDB: the damage, the faults, and the cheapest edits as a walk over the four states of (s?(ua)+)?.

A state is a struct of cost, audit and text, so the least struct is the cheapest edit sequence, ties by audit.
"""

from __future__ import annotations

WHITE = r"\x20\x09-\x0D"
#: Reflected polynomial of the checksum.
STEP = "list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: {STEP.replace('[x,', '[xor(a, b),')}), 4294967295)"


def go(state: str, cost: str, edit: str, line: str | None = None) -> str:
    text = f"{state}.o" if line is None else f"{state}.o || chr(10) || {line}"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'o': {text}}} END"


def least(*states: str) -> str:
    return f"list_min(list_filter([{', '.join(states)}], lambda s: s IS NOT NULL))"


def take(state: str, letter: str, role: str) -> str:
    """A kept row of that letter, or another that gets the role."""
    keep, other = go(state, "more", "K", "role || ':' || text"), go(state, "more + 3", "R", f"'{role}:' || text")
    return f"CASE WHEN fault <> 'drop' THEN CASE WHEN letter = '{letter}' THEN {keep} ELSE {other} END END"


INSERT_USER = least("q2", *[go(q, "3", "I", "'user:'") for q in ("q0", "q1", "q3")])
INSERT_ASSISTANT = least("q3", go("p2", "3", "I", "'assistant:'"))
DELETE = {f"q{k}": go(p, "4", "D") for k, p in enumerate(("q0", "q1", "p2", "p3"))}
KEEP_SYSTEM = f"CASE WHEN fault <> 'drop' AND letter = 's' THEN {go('q0', 'more', 'K', chr(39).join(['role || ', ':', ' || text']))} END"
NEXT = {"q0": DELETE["q0"], "q1": least(DELETE["q1"], KEEP_SYSTEM), "q2": least(DELETE["q2"], *[take(p, "u", "user") for p in ("q0", "q1", "p3")]), "q3": least(DELETE["q3"], take("p2", "a", "assistant"))}
ZERO, NONE = "{'c': 0::BIGINT, 'a': '', 'o': ''}", "NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR)"

SQL = f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
how AS (SELECT *, {CRC} % 20 AS h FROM keyed),
bad AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM how WHERE h <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM bad),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS k, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed),
told AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{WHITE}]') THEN 'blank' WHEN k > 1 THEN 'duplicate' WHEN regexp_extract(text, '([^{WHITE}])[{WHITE}]*$', 1) NOT IN ('.', '!', '?') THEN 'cut' ELSE 'good' END AS kind FROM seen),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(CASE WHEN kind = 'blank' THEN 1 END) AS blank, count(CASE WHEN kind = 'duplicate' THEN 1 END) AS duplicate, count(CASE WHEN kind = 'cut' THEN 1 END) AS truncated, count(CASE WHEN pos > 1 AND before || substr(role, 1, 1) NOT IN ('su', 'ua', 'au') THEN 1 END) AS illegal, count(*) AS n FROM told GROUP BY conv_id),
rows_ AS (SELECT conv_id, pos, role, text, substr(role, 1, 1) AS letter, CASE WHEN kind IN ('blank', 'duplicate') THEN 'drop' ELSE kind END AS fault, CASE WHEN kind = 'cut' THEN 3 ELSE 0 END AS more FROM told),
walk(conv_id, pos, q0, q1, q2, q3) AS (SELECT conv_id, 0::BIGINT, {ZERO}, {NONE}, {NONE}, {NONE} FROM facts UNION ALL
  SELECT conv_id, pos, {NEXT['q0']}, {NEXT['q1']}, {NEXT['q2']}, {NEXT['q3']} FROM (SELECT *, {INSERT_ASSISTANT} AS p3 FROM (SELECT w.conv_id, r.pos, w.q0, w.q1, w.q2, w.q3, {INSERT_USER} AS p2, role, text, letter, fault, more FROM walk w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos + 1) a) b),
ends AS (SELECT conv_id, {least('q0', 'p3')} AS best FROM (SELECT *, {INSERT_ASSISTANT} AS p3 FROM (SELECT w.*, {INSERT_USER} AS p2 FROM walk w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND w.pos = f.n) a) b)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
