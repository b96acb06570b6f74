"""DuckDB SQL for the queries that SQL expresses over whole tables."""

from __future__ import annotations

from .secret_scan import COPIED, COPIED_REPOS, KINDS, LIVE_CHARS, LIVE_DISTINCT, ORDER

_MIXING = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS key
  FROM documents
), sums AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM docs GROUP BY source
), sources AS (
  SELECT *, [5, 2, 1][CAST(place % 3 AS INT) + 1] AS weight, 2 * source_size AS cap FROM sums
), levels AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources
), level AS (
  SELECT arg_min(level, (cap / weight, place)) AS level FROM levels WHERE level * weight <= cap
), plan AS (
  SELECT source, source_size, weight, CASE WHEN level.level IS NULL THEN CAST(cap AS DOUBLE) ELSE least(level.level * weight, CAST(cap AS DOUBLE)) END AS target
  FROM sources CROSS JOIN level
), shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM plan
), masses AS (
  SELECT source, key, sum(size) AS mass FROM docs GROUP BY source, key
), middles AS (
  SELECT source, key, sum(mass) OVER (PARTITION BY source ORDER BY key) - mass + mass / 2 AS middle FROM masses
)
SELECT d.doc_id, d.size, CAST(s.source_size AS BIGINT) AS source_size, s.target,
       CAST(CASE WHEN s.source_size > 0 THEN d.size * (s.whole + CASE WHEN s.target - s.whole * s.source_size > 0 AND m.middle <= s.target - s.whole * s.source_size THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken
FROM docs d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source JOIN middles m ON d.source IS NOT DISTINCT FROM m.source AND d.key = m.key
"""


def _secrets() -> str:
    pieces = "\nUNION ALL\n".join(
        f"""SELECT rid, th, '{name}' AS kind, i, length(gaps[i]) AS gap, found[i] AS match, regexp_extract(found[i], '{p}', {group}) AS value, {least} AS least
FROM (SELECT rid, th, gaps, found, unnest(generate_series(1, len(found))) AS i
      FROM (SELECT rid, th, regexp_split_to_array(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS found FROM (SELECT DISTINCT rid, th, text FROM texts)))"""
        for name, pattern, group, least in KINDS
        for p in [pattern.replace("'", "''")]
    )
    rank = "list_position([" + ", ".join(f"'{k}'" for k in ORDER) + "], kind)"
    joined = f"string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, {rank})"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k[0]}') AS n_{k[0]}" for k in KINDS)
    outer = ", ".join(f"coalesce(n_{k[0]}, 0) AS n_{k[0]}" for k in KINDS)
    return f"""
WITH texts AS (
  SELECT doc_id, md5(coalesce(text, '')) AS th, coalesce(text, '') AS text, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo, coalesce('=' || CAST(doc_id AS VARCHAR), '') AS rid FROM documents
), pieces AS (
{pieces}
), spans AS (
  SELECT rid, th, kind, value, least, CAST(sum(gap + length(match)) OVER w - length(match) AS BIGINT) AS start, CAST(sum(gap + length(match)) OVER w AS BIGINT) AS stop
  FROM pieces WINDOW w AS (PARTITION BY rid, th, kind ORDER BY i)
), kept AS (
  SELECT *, stop - length(value) AS value_start FROM spans WHERE length(value) >= least
), owners AS (
  SELECT k.value, count(DISTINCT t.owner) AS owners, count(DISTINCT (t.owner, t.repo)) AS repos FROM kept k JOIN texts t ON k.rid = t.rid AND k.th = t.th GROUP BY k.value
), judged AS (
  SELECT k.*, o.owners, o.repos, CASE WHEN owners >= {COPIED} OR repos >= {COPIED_REPOS} THEN 'copied'
       WHEN owners = 1 AND length(k.value) >= {LIVE_CHARS} AND regexp_matches(k.value, '[0-9]') AND regexp_matches(k.value, '[A-Za-z]')
            AND len(list_distinct(string_split(k.value, ''))) >= {LIVE_DISTINCT} THEN 'live' ELSE 'unclear' END AS verdict
  FROM kept k JOIN owners o ON k.value = o.value
), base AS (
  SELECT rid, th, {counts}, sha256({joined}) AS base_sha256, count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'copied') AS n_copied, max(owners) AS most_owners, max(repos) AS most_repos
  FROM judged GROUP BY rid, th
), every AS (
  SELECT rid, th, {joined} AS spans FROM (
    SELECT rid, th, kind, start, stop FROM judged
    UNION ALL
    SELECT DISTINCT rid, th, verdict AS kind, value_start AS start, stop FROM judged WHERE verdict IN ('live', 'copied')
  ) GROUP BY rid, th
)
SELECT t.doc_id, {outer}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos
FROM texts t LEFT JOIN base b ON t.rid = b.rid AND t.th = b.th LEFT JOIN every e ON t.rid = e.rid AND t.th = e.th
"""


ORACLE_SQL = {"op8_source_mixing": _MIXING, "op10_secret_scan": _secrets()}
