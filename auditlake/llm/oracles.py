"""SQL that the queries of this package must agree with; the others are tested by brute force."""

_REPO = """
SELECT ordinal, lower(regexp_replace(trim(repo_url), '^([a-zA-Z][a-zA-Z0-9+.-]*://)?([^/@]*@)?(www\\.)?', '', 'i')) AS rest, lower(regexp_replace(split, '[^A-Za-z]+', '', 'g')) AS s
FROM new_detect WHERE trim(repo_url) <> '' AND split IS NOT NULL
"""

_LINKED = r"""
WITH RECURSIVE c AS (SELECT *, upper(regexp_extract(advisory_id, '(?i)GHSA(-[a-z0-9]{4}){3}', 0)) AS a,
  lower(list_filter(regexp_split_to_array(coalesce(fix_commit, ''), '[^0-9A-Fa-f]+'), lambda x: length(x) = 40)[1]) AS f FROM candidates),
k AS (SELECT candidate_id AS id, 'a' || a AS k FROM c WHERE a <> '' AND a <> 'GHSA-XXXX-XXXX-XXXX' UNION SELECT candidate_id, 'f' || f FROM c WHERE f <> repeat('0', 40)),
m AS (SELECT k, min(id) AS first FROM k GROUP BY k), e AS (SELECT DISTINCT k.id AS x, m.first AS y FROM k JOIN m USING (k)), s AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(id, g) AS (SELECT candidate_id, candidate_id FROM c UNION SELECT s.y, r.g FROM r JOIN s ON s.x = r.id WHERE r.g < s.y),
groups AS (SELECT id, min(g) AS group_id FROM r WHERE id IS NOT NULL GROUP BY id)
"""
_AT = r"""
coalesce(TRY_CAST(regexp_replace(replace(regexp_extract(collected_at, '^\s*(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}([T ]+\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?)', 1), 'T', ' '), '^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})', '\1-\2-\3') AS TIMESTAMP),
  TRY_CAST(regexp_replace(regexp_extract(collected_at, '^\s*(\d{8})', 1), '^(\d{4})(\d{2})(\d{2})', '\1-\2-\3') AS TIMESTAMP), TIMESTAMP '0001-01-01')
"""
_BEST = "coalesce(arg_max(ordinal, row({0}, coalesce(verified, false), moment, ordinal)) FILTER (WHERE {1}), -1)"
_SURVIVORS = rf"""
SELECT group_id, {_BEST.format("1", "a <> '' AND a <> 'GHSA-XXXX-XXXX-XXXX'")} AS advisory_row, {_BEST.format("1", "f <> repeat('0', 40)")} AS fix_commit_row, {_BEST.format("size", "size > 0")} AS code_fixed_row
FROM (SELECT *, {_AT} AS moment, length(regexp_replace(code_fixed, '^[\s\x{{0085}}\x{{00A0}}\x{{3000}}]+|[\s\x{{0085}}\x{{00A0}}\x{{3000}}]+$', '', 'g')) AS size FROM c) JOIN groups ON id = candidate_id GROUP BY group_id HAVING count(*) >= 2
"""


def _windows(key: str, source: str, parts: str, size: int) -> str:
    """(key, w): the runs of ``size`` consecutive parts of every text."""
    return f"""
SELECT {key}, array_to_string(parts[i:i + {size - 1}], ' ') AS w FROM (SELECT {key}, parts, unnest(range(1, len(parts) - {size - 2})) AS i FROM (SELECT {key}, {parts} AS parts FROM {source} WHERE text IS NOT NULL))
"""


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_LETTERS = r"string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g'), '')"
_CHINESE = "(SELECT * FROM benchmark_items WHERE lang = 'zh')"
_OTHERS = "(SELECT * FROM benchmark_items WHERE lang <> 'zh')"

SQL: dict[str, str] = {
    "p4_found": f"{_LINKED} SELECT id AS candidate_id, group_id FROM groups",
    "p5_found": f"{_LINKED} {_SURVIVORS}",
    "p9_found": f"""
SELECT DISTINCT doc_id, item_id FROM ({_windows("doc_id", "documents", _WORDS, 12)}) d JOIN ({_windows("item_id", _OTHERS, _WORDS, 12)}) i USING (w)
UNION SELECT DISTINCT doc_id, item_id FROM ({_windows("doc_id", "documents", _LETTERS, 20)}) d JOIN ({_windows("item_id", _CHINESE, _LETTERS, 20)}) i USING (w)
""",
    "p1_found": f"""
WITH r AS ({_REPO}),
k AS (SELECT concat_ws('/', regexp_extract(rest, '^([^/:]+)[/:]+([^/?# ]+)/+([^/?# ]+)', 1),
                            regexp_extract(rest, '^([^/:]+)[/:]+([^/?# ]+)/+([^/?# ]+)', 2),
                            regexp_replace(regexp_extract(rest, '^([^/:]+)[/:]+([^/?# ]+)/+([^/?# ]+)', 3), '\\.git$', '')) AS repo_key,
             CASE WHEN s IN ('train', 'training') THEN 'train' WHEN s IN ('val', 'valid', 'validation', 'dev') THEN 'val'
                  WHEN s IN ('test', 'testing') THEN 'test' END AS part FROM r)
SELECT repo_key FROM k WHERE repo_key <> '//' AND part IS NOT NULL GROUP BY repo_key HAVING count(DISTINCT part) >= 2
""",
}
