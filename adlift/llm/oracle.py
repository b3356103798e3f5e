"""DuckDB SQL twins of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"coalesce(len(regexp_extract_all({0}, '[^\x20\x09-\x0D]{1}')), 0)"

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) > 1)
SELECT x.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE s.first_doc < x.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(x.line, chr(10) ORDER BY x.pos)
                       FILTER (WHERE s.first_doc IS NULL OR s.first_doc >= x.doc_id), '')) AS kept_sha256
FROM keyed x LEFT JOIN shared s ON x.k = s.k
GROUP BY x.doc_id
"""

TOKEN_COUNTS = f"""
WITH marks AS (
  SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
live AS (
  SELECT coalesce(d.source, '') AS source, coalesce(d.lang, '') AS lang, m.toxic, d.text
  FROM documents d LEFT JOIN marks m USING (doc_id) WHERE m.quality IS DISTINCT FROM 0),
counted AS (
  SELECT source, lang, 'words-1' AS tokenizer,
         CASE WHEN toxic = 1 THEN {_WORDS.format('text', '{2,}')} ELSE {_WORDS.format('text', '+')} END AS n FROM live
  UNION ALL
  SELECT source, lang, 'pieces-2', {_WORDS.format('text', '{1,4}')} FROM live)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM counted GROUP BY ALL
"""


def _marks(mark: str) -> str:
    return f"(length(t) - length(replace(t, '{mark}', ''))) / {float(len(mark))}"


def source_mix(targets: dict[str, dict[str, float]], budget: float, sweeps: int = 8, steps: int = 6, seed: str = "mix") -> str:
    symbols = " + ".join(_marks(3 * c) for c in "#$%&*")
    parts = [f"""rows_ AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t,
         {_WORDS.format('text', '+')} AS tokens FROM documents)""",
             f"""d AS (
  SELECT doc_id, source, lang, tokens,
         CASE WHEN {_marks('|')} * 5 >= greatest(tokens, 1) THEN 'table'
              WHEN {_marks('!!')} * 5 >= greatest(tokens, 1) THEN 'shouting'
              WHEN ({symbols}) * 5 >= greatest(tokens, 1) THEN 'symbols'
              WHEN tokens < 50 THEN 'note' ELSE 'prose' END AS topic FROM rows_)""",
             "c AS MATERIALIZED (SELECT source, lang, topic, sum(tokens) AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0)"]
    for dim in ("source", "lang", "topic"):
        named = targets.get(dim, {})
        case = "CASE " + " ".join(f"WHEN v = '{k}' THEN {float(x)}" for k, x in named.items()) + " END" if named else "NULL"
        share = max(0.02, 1.0 - sum(named.values()))
        parts.append(f"""g_{dim} AS MATERIALIZED (
  SELECT v, coalesce(goal, n / sum(n) FILTER (WHERE goal IS NULL) OVER () * {share})
            / (coalesce(sum(goal) OVER (), 0) + CASE WHEN count(*) FILTER (WHERE goal IS NULL) OVER () > 0 THEN {share} ELSE 0 END) AS goal
  FROM (SELECT v, n, CAST({case} AS DOUBLE) AS goal FROM (SELECT {dim} AS v, CAST(sum(tokens) AS DOUBLE) AS n FROM c GROUP BY 1)))""")
    parts.append("w0 AS MATERIALIZED (SELECT *, CAST(tokens AS DOUBLE) / sum(tokens) OVER () AS weight FROM c)")
    k = 0
    for _ in range(sweeps):
        for dim in ("source", "lang", "topic"):
            parts.append(f"""w{k + 1} AS MATERIALIZED (
  SELECT source, lang, topic, tokens, weight * goal / sum(weight) OVER (PARTITION BY {dim}) AS weight
  FROM w{k} JOIN g_{dim} ON v = {dim})""")
            k += 1
    parts.append(f"q AS MATERIALIZED (SELECT source, lang, topic, tokens, weight / tokens / max(weight / tokens) OVER () AS p FROM w{k})")
    parts.append("s0 AS MATERIALIZED (SELECT 1.0::DOUBLE AS s)")
    for i in range(steps):
        parts.append(f"""s{i + 1} AS MATERIALIZED (
  SELECT coalesce(greatest(s, ({budget} * sum(tokens) - coalesce(sum(tokens) FILTER (WHERE p * s >= 1), 0))
                              / sum(tokens * p) FILTER (WHERE p * s < 1)), s) AS s FROM q CROSS JOIN s{i} GROUP BY s)""")
    parts.append(f"p AS (SELECT source, lang, topic, least(p * s, 1.0) AS p FROM q CROSS JOIN s{steps})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, source, lang, topic, tokens, round(coalesce(p, 1.0), 6) AS probability,
       CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < coalesce(p, 1.0) AS kept
FROM d LEFT JOIN p USING (source, lang, topic)"""
