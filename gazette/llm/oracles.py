"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from gazette.llm import quality

OP7 = r"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
o AS (SELECT *, lag(role) OVER w AS prev, row_number() OVER w AS k FROM t
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
x AS (SELECT *, length(text) + len(regexp_extract_all(text, '<\\*\|')) AS n_text,
             length(role) + len(regexp_extract_all(role, '<\\*\|')) AS n_role,
             prev IS NULL OR prev <> role AS starts FROM o)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n_text + CASE WHEN starts THEN 12 + n_role + 10 + 11 ELSE 11 END)::BIGINT AS formatted_chars
FROM x GROUP BY conv_id"""


def _op4() -> str:
    score = {r: e.replace("/", "::DOUBLE /") for r, e in quality.RULES.items()}
    above = [" OR ".join(f"{score[r]} > {quality.LADDERS[r][i]}" for r in score) for i in range(quality.LEVELS)]
    grid = " UNION ALL ".join(f"SELECT *, {i + 1} AS level, {x} AS hit FROM held" for i, x in enumerate(above))
    passed = " AND ".join(f"coalesce({e} <= ({list(quality.LADDERS[r])})[level], true)" for r, e in score.items())
    a = quality.ALPHA
    return rf"""WITH w AS (
  SELECT doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]]) AS g FROM w),
r AS (SELECT doc_id, g, unnest(range(1, len(g) + 1)) AS i, unnest(g) AS x FROM l WHERE len(g) > 0),
rr AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM
    (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM r) WHERE c > 1),
rep AS (SELECT doc_id, sum(CASE WHEN p IS NULL THEN 3 ELSE least(3, i - p) END) AS n FROM rr GROUP BY doc_id),
c AS (SELECT l.doc_id, stratum, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g'))::BIGINT AS n_upper,
    length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_exclaim FROM l LEFT JOIN rep USING (doc_id)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
held AS (SELECT j.*, q FROM j JOIN (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY 1)
    USING (doc_id) WHERE NOT base_failed),
risk AS (SELECT stratum, level, count(*) FILTER (q = 1) AS n, count(*) FILTER (q = 1 AND hit) AS k,
    count(*) FILTER (q = 0) AS nb, count(*) FILTER (q = 0 AND hit) AS kb FROM ({grid}) GROUP BY ALL),
tested AS (SELECT *, CASE WHEN k < n * {a} THEN list_sum(list_transform(range(0, k + 1), lambda i:
      exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({a}) + (n - i) * ln(1 - {a})))) ELSE 1 END AS p,
    kb - {quality.GOOD_COST} * k AS gain FROM risk),
certified AS (SELECT * FROM tested QUALIFY max(p) OVER (PARTITION BY stratum ORDER BY level) <=
    {quality.DELTA} / (SELECT count(DISTINCT stratum) FROM held)),
cut AS (SELECT stratum, arg_max(level, struct_pack(g := gain, l := -level)) AS level FROM certified WHERE gain > 0 GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {passed} AS kept FROM j LEFT JOIN cut USING (stratum)"""


OP11 = r"""WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
o AS (SELECT id, lang, source, term, count(*) AS n FROM w GROUP BY ALL),
kept AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(*) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, sum(n) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
a AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n FROM g JOIN kept USING (lang)
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p
      FROM a JOIN v USING (lang)),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
      FROM l JOIN v USING (lang)),
r AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  UNION ALL
  SELECT x.lang, x.source, 'pair', y.source, 0 FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  WHERE x.lang NOT IN (SELECT lang FROM v)
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
  (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10"""


SQL = {"op4_quality_rules": _op4(), "op7_chat_format": OP7, "op11_source_divergence": OP11}
