"""DuckDB SQL that gives the rows of op11 to op13."""

from __future__ import annotations


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def secret_scans(rules) -> str:
    """Places of matches are sums of the lengths of matches and of the gaps between them."""
    legs = [
        f"SELECT doc_id, {k} AS k, {_text(r.kind)} AS kind, {r.least} AS least, string_split_regex(text, {_text(r.pattern)}) AS gaps,"
        f" regexp_extract_all(text, {_text(r.pattern)}) AS hits, regexp_extract_all(text, {_text(r.pattern)}, {r.group}) AS parts FROM d"
        for k, r in enumerate(rules)
    ]
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), m AS (
  {" UNION ALL ".join(legs)}
), hit AS (
  SELECT doc_id, k, kind, least, gaps, hits, parts, unnest(range(1, len(hits) + 1)) AS j FROM m WHERE len(hits) > 0
), place AS (
  SELECT doc_id, k, kind, length(hits[j]) AS size,
         list_sum(list_transform(gaps[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:j - 1], lambda x: length(x))), 0) AS start
  FROM hit WHERE length(parts[j]) >= least
), span AS (
  SELECT doc_id, k, kind, CAST(start AS BIGINT) AS start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT) AS span FROM place
), found AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY start, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY start, k) AS spans
  FROM span GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN found ON found.doc_id = d.doc_id
"""


COLLOCATIONS = r"""
WITH piece AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece
), gram AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) > 1)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)
), f AS (
  SELECT lang, k, phrase, count(*) AS n FROM gram GROUP BY ALL
), total AS (
  SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10
), part AS (
  SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)
), scored AS (
  SELECT part.lang, part.phrase, a, cut, x.n AS l, y.n AS r, (1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n) AS score
  FROM part JOIN f x ON x.lang = part.lang AND x.phrase = head JOIN f y ON y.lang = part.lang AND y.phrase = tail
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), around AS (
  SELECT lang, phrase, max(a) AS around
  FROM (SELECT lang, a, w[1] || ' ' || w[2] AS phrase FROM c WHERE k = 3 UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM c WHERE k = 3) GROUP BY ALL
), kept AS (
  SELECT worst.* FROM worst LEFT JOIN around ON around.lang = worst.lang AND around.phrase = worst.phrase WHERE coalesce(100 * around < 50 * a, true)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT ranked.lang, rank, phrase, a, l, r, total.n, CAST(score AS BIGINT) AS score FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= 2000
"""

#: Levels of the SQL: trees of up to 8**LEVELS documents and 8**TOP_LEVELS languages.
LEVELS, TOP_LEVELS = 7, 2


def _tree(name: str, levels: int) -> str:
    """CTEs over `name`0 (t, i, n, node): the levels above, and each node's neighbours in its run."""
    out = []
    for k in range(levels):
        out.append(f"""{name}s{k} AS (
  SELECT t, i, n, coalesce(string_agg(node, '') OVER (PARTITION BY t, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
         coalesce(string_agg(node, '') OVER (PARTITION BY t, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a
  FROM {name}{k}
), {name}{k + 1} AS (
  SELECT t, i // 8 AS i, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN min(node) ELSE sha256(string_agg(node, '' ORDER BY i)) END AS node
  FROM {name}{k} GROUP BY t, i // 8, n
)""")
    return ", ".join(out)


def _climb(name: str, source: str, levels: int, out: str) -> str:
    """CTE `out`: rows of `source` (t, i, fold, proof) with both carried up the tree."""
    steps, last = [], source
    for k in range(levels):
        steps.append(f"""{out}{k} AS (
  SELECT x.* REPLACE (x.i // 8 AS i, CASE WHEN s.n = 1 THEN x.fold ELSE sha256(s.b || x.fold || s.a) END AS fold,
         CASE WHEN s.n = 1 THEN x.proof ELSE x.proof || s.b || s.a END AS proof)
  FROM {last} x JOIN {name}s{k} s ON s.t = x.t AND s.i = x.i
)""")
        last = f"{out}{k}"
    return ", ".join(steps) + f", {out} AS (SELECT * FROM {last})"


def merkle() -> str:
    fields = lambda text: " || ".join(
        f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)
    )
    return f"""
WITH RECURSIVE crc_bits AS (
  SELECT range AS c, range AS x, 0 AS step FROM range(256)
  UNION ALL SELECT c, xor(x >> 1, (x & 1) * 3988292384), step + 1 FROM crc_bits WHERE step < 8
), crc_table AS (
  SELECT list(x ORDER BY c) AS crcs FROM crc_bits WHERE step = 8
), d AS (
  SELECT doc_id, source, lang, n_chars, text, coalesce('1' || lang, '0') AS t,
         coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
                                  lambda x, c: xor(x >> 8, crcs[(xor(x, c) & 255) + 1])), 4294967295) % 3 = 0, false) AS hit
  FROM documents, crc_table
), leaf AS (
  SELECT doc_id, t, sha256({fields("text")}) AS leaf, sha256({fields("CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")}) AS found
  FROM d
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM leaf
), n0 AS (
  SELECT t, i, n, leaf AS node FROM placed
), {_tree("n", LEVELS)}, g0 AS (
  SELECT '' AS t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n, node, t AS of FROM n{LEVELS}
), {_tree("g", TOP_LEVELS)}, start AS (
  SELECT doc_id, leaf, t, i, found AS fold, '' AS proof FROM placed
), {_climb("n", "start", LEVELS, "up")}, middle AS (
  SELECT up.doc_id, leaf, g0.t, g0.i, fold, proof, g0.node AS subroot FROM up JOIN g0 ON g0.of = up.t
), {_climb("g", "middle", TOP_LEVELS, "top")}
SELECT doc_id, leaf, subroot, g{TOP_LEVELS}.node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = g{TOP_LEVELS}.node AS verified
FROM top, g{TOP_LEVELS}
"""
