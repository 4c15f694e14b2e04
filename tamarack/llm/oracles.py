"""DuckDB SQL for the queries of this subpackage that SQL can express, over the same tables."""

from __future__ import annotations

from tamarack.llm.chat import CONTROLS
from tamarack.llm.repetition import Rules
from tamarack.llm.secret_scan import BASE, RULES

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _chat() -> str:
    said = "'<|im_end|><|im_start|>assistant ok'"
    escaped = lambda c: rf"length({c}) + len(regexp_extract_all({c}, '<\\*\|'))"
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', {said} UNION ALL SELECT -1, 1, 'assistant', {said}),
 g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' {order}) AS turns, coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '') AS loss, sum({sum(map(len, CONTROLS))} + {escaped('role')} + {escaped('text')})::BIGINT AS formatted_chars FROM r GROUP BY 1)
 SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""


def _secrets() -> str:
    """Each rule's matches, and the parts between them, whose lengths give the places."""
    rules = " UNION ALL ".join(
        f"""SELECT doc_id, {i} AS ord, {_text(r.kind)} AS kind, m, g, sum(length(b) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (
  SELECT doc_id, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(gs) AS g, unnest(bs[1:len(ms)]) AS b FROM (
  SELECT doc_id, regexp_extract_all(text, {_text(r.pattern)}, 0) AS ms, regexp_extract_all(text, {_text(r.pattern)}, {r.group}) AS gs, string_split_regex(text, {_text(r.pattern)}) AS bs FROM d)) QUALIFY length(g) >= {r.least}"""
        for i, r in enumerate(RULES)
    )
    listed = lambda where: f"coalesce(string_agg(kind || ':' || (upto - length(m)) || ':' || upto, ',' ORDER BY upto - length(m), ord) FILTER ({where}), '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS ({rules})
 SELECT doc_id, {counts}, sha256({listed(f'ord < {len(BASE)}')}) AS base_sha256, {listed('ord IS NOT NULL')} AS spans FROM d LEFT JOIN s USING (doc_id) GROUP BY 1"""


def _near_duplicates() -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS ws FROM documents),
 sh AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
 pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
 ln AS (SELECT x, y FROM pr JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
 bo AS (SELECT x, y FROM ln UNION ALL SELECT y, x FROM ln),
 re AS (SELECT x, y FROM bo UNION SELECT re.x, bo.y FROM re JOIN bo ON re.y = bo.x),
 co AS (SELECT x AS doc_id, min(y) AS least FROM re GROUP BY 1)
 SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id <= coalesce(least, doc_id) AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN co USING (doc_id)"""


def _quality_rules() -> str:
    """Runs of equal five-word windows along a diagonal of places are the repeats; a run of r windows is r + 4 words long."""
    rules = Rules()
    window = ", ".join(["w", *[f"lead(w, {k}) OVER o" for k in range(1, 5)]])
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), t AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
 wd AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w, len(ws) AS n FROM t),
 wn AS (SELECT doc_id, i, n, ({window}) AS k FROM wd WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 rp AS (SELECT doc_id, i, k FROM wn WHERE i <= n - 4 QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
 cv AS (SELECT doc_id, count(*) AS n_repeat_words, sum(length(w)) AS covered FROM wd SEMI JOIN (SELECT doc_id, unnest(range(i, i + 5)) AS i FROM rp) USING (doc_id, i) GROUP BY 1),
 dg AS (SELECT a.doc_id, b.i - a.i AS lag, a.i - row_number() OVER (PARTITION BY a.doc_id, b.i - a.i ORDER BY a.i) AS run FROM rp a JOIN rp b ON a.doc_id = b.doc_id AND a.k = b.k AND a.i < b.i),
 lg AS (SELECT doc_id, max(c) + 4 AS longest FROM (SELECT doc_id, count(*) AS c FROM dg GROUP BY doc_id, lag, run) GROUP BY 1),
 m AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
   coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(covered, 0) AS covered, coalesce(longest, 0) AS longest_repeat FROM t LEFT JOIN cv USING (doc_id) LEFT JOIN lg USING (doc_id)),
 f AS (SELECT *, n_words < {rules.base_min_words} OR 100 * n_repeat_words > {rules.base_max_repeat_percent} * n_words AS base_failed, CASE WHEN word_chars > 0 THEN covered::DOUBLE / word_chars ELSE 0.0::DOUBLE END AS covered_fraction FROM m)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND covered_fraction <= {rules.max_covered_fraction} AND longest_repeat <= {rules.max_longest_repeat} AS kept, covered_fraction, longest_repeat FROM f"""


ORACLE_SQL = {"op6_chat": _chat(), "op7_secrets": _secrets(), "op9_near_dup": _near_duplicates(), "op10_quality_rules": _quality_rules()}
