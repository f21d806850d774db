"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from packetlake.llm import licenses, quality

ORACLES: dict[str, str] = {"op9_licenses": licenses.oracle_sql()}
ORACLES["op8_top_products"] = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id,
    list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY q.row ORDER BY
      list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) DESC, c.vec_id NULLS LAST) AS rank
  FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 20 = 0) WHERE rank <= 20"""



def _quality_sql() -> str:
    rate = quality.FALSE_REJECTIONS / len(quality.RULES)
    scores = ", ".join(
        f"CAST(CASE WHEN {total} > 0 THEN floor(1000 * {part} / {total}) ELSE 0 END AS BIGINT) AS s_{rule}"
        for rule, (part, total) in quality.RULES.items()
    )
    unpivoted = " UNION ALL ".join(
        f"SELECT stratum, '{rule}' AS rule, s_{rule} AS score FROM good" for rule in quality.RULES
    )
    chosen = ", ".join(f"min(cutoff) FILTER (rule = '{rule}') AS c_{rule}" for rule in quality.RULES)
    names = ", ".join(f"CASE WHEN s_{rule} > c_{rule} THEN '{rule}' END" for rule in quality.RULES)
    cutoffs = ", ".join(f"({c})" for c in quality.CUTOFFS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(lang, '{quality.NO_STRATUM}') AS stratum,
  coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
spots AS (SELECT row, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w),
keyed AS (SELECT row, i, count(*) OVER (PARTITION BY row, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS n
  FROM spots),
covered AS (SELECT row, count(DISTINCT spot) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS spot
  FROM keyed WHERE n > 1) GROUP BY row),
m AS (SELECT doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  coalesce(c.n, 0) AS n_repeat_words,
  CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
  CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_shouts
  FROM w LEFT JOIN covered c USING (row)),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {scores} FROM m),
good AS (SELECT * FROM s WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels
  WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1)),
counts AS (SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (score > cutoff) AS k
  FROM ({unpivoted}) CROSS JOIN (VALUES {cutoffs}) c(cutoff) GROUP BY ALL),
tested AS (SELECT *, CASE WHEN k < n * {rate} THEN (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1)
      - lgamma(n - i + 1) + i * ln({rate}) + (n - i) * ln(1 - {rate}))) FROM range(0, k + 1) r(i))
    ELSE 1 END <= {quality.ERROR} / ({len(quality.RULES)} * (SELECT count(DISTINCT stratum) FROM counts)) AS safe
  FROM counts),
safe AS (SELECT * FROM (SELECT *, max(cutoff) FILTER (NOT safe) OVER (PARTITION BY stratum, rule) AS unsafe
  FROM tested) WHERE safe AND cutoff > coalesce(unsafe, -1)),
chosen AS (SELECT stratum, {chosen} FROM safe GROUP BY stratum),
judged AS (SELECT s.*, concat_ws(',', {names}) AS rejected_by FROM s LEFT JOIN chosen USING (stratum))
SELECT doc_id, {", ".join(quality.MEASURES)}, base_failed, NOT base_failed AND rejected_by = '' AS kept,
  stratum, rejected_by FROM judged"""


ORACLES["op4_quality_rules"] = _quality_sql()


def _repair_sql() -> str:
    """The cheapest edits row by row: for each state of the role pattern (z
    nothing, s, u and a the last role) the least (cost, audit) and its lines."""

    def least(*ways: str) -> str:
        return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"

    def way(state: str, cost: str, letter: str, line: str = "", only: str = "true") -> str:
        lines = f"list_append({state}.l, {line})" if line else f"{state}.l"
        return (
            f"CASE WHEN {state} IS NOT NULL AND {only} THEN "
            f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'l': {lines}}} END"
        )

    def edits(state: str, initial: str, sources: tuple[str, ...]) -> str:
        deleted = way(f"{state}i" if state in "ua" else state, "2", "D")
        kept = [way(x, "late", "K", "role || ':' || text", f"stays AND initial = '{initial}'") for x in sources]
        role = {"u": "user", "a": "assistant"}.get(state)
        moved = [way(x, "1 + late", "R", f"'{role}:' || text", "stays") for x in sources if role]
        return least(deleted, *kept, *moved)

    def inserted(source: str) -> str:
        new_user = [way(x, "5", "I", "'user:'") for x in ("z", "s", "a")]
        return (
            f"SELECT *, {least('a', way('ui', '5', 'I', QUOTED))} AS ai FROM "
            f"(SELECT *, {least('u', *new_user)} AS ui FROM {source})"
        )

    QUOTED = "'assistant:'"
    crc = (
        "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), "
        "lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT))), "
        "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
    )
    blank = r"[\x20\x09-\x0D]"
    kind = "STRUCT(c BIGINT, a VARCHAR, l VARCHAR[])"
    return f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
fated AS (SELECT *, {crc} % 20 AS fate FROM keyed, crc),
after AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
  CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy FROM fated WHERE fate <> 0),
numbered AS (SELECT *, left(role, 1) AS initial,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
  NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
  NOT regexp_matches(text, '[.!?]{blank}*$') AS open FROM after),
judged AS (SELECT *, NOT blank AND NOT again AS stays, CASE WHEN open THEN 5 ELSE 0 END AS late,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM numbered),
counts AS (SELECT conv_id, max(pos) AS n,
  coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
  count(*) FILTER (stays AND open) AS truncated,
  count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
parse AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS place, CAST({{'c': 0, 'a': '', 'l': []}} AS {kind}) AS z,
    CAST(NULL AS {kind}) AS s, CAST(NULL AS {kind}) AS u, CAST(NULL AS {kind}) AS a FROM conversations
  UNION ALL
  SELECT conv_id, pos, CAST({way("z", "2", "D")} AS {kind}), CAST({edits("s", "s", ("z",))} AS {kind}),
    CAST({edits("u", "u", ("z", "s", "ai"))} AS {kind}), CAST({edits("a", "a", ("ui",))} AS {kind})
  FROM ({inserted("(SELECT p.*, j.pos, j.role, j.text, j.initial, j.stays, j.late FROM parse p JOIN judged j "
                  "ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.pos = p.place + 1)")})),
ended AS (SELECT conv_id, place, {least("z", "ai")} AS best FROM ({inserted("parse")}))
SELECT e.conv_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))},
  best.c AS cost, best.a AS audit, sha256(array_to_string(best.l, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id WHERE e.place = coalesce(c.n, 0)"""


ORACLES["op13_conversation_repair"] = _repair_sql()
