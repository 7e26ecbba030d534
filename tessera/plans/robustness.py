"""Robustness queries: the starts of benchmark items ask documents, and memories of document starts, for what follows."""

from pyspark.sql import functions as F

from tessera.operators import robustness as B
from tessera.operators.stats import rounded
from tessera.plans import augmentation
from tessera.plans.retrieval import TOKENS
from tessera.registry import register
from tessera.sources.views import table, view, with_views

MODES = ("BASE", "MEM", "RL")
#: Words of an item that are asked with, and that are expected in the answer; characters of a memory.
ASKED, EXPECTED, MEMORY = 12, 3, 400
#: Words that stand for each other, and noise, in the language of the test tables.
POOL = {"the": ["thee", "that", "tha"], "of": ["ofe", "von"], "and": ["ande", "und"], "in": ["inne"], "de": ["des", "du"]}
NOISE = ("oh", "please", "well", "so")

CLEAN = "regexp_replace(regexp_replace(text, '[0-9]', '', 'g'), '[ \\n]+', ' ', 'g')"
view("trials", f"""SELECT item_id AS id, 'item ' || CAST(item_id AS VARCHAR) || ' ' || array_to_string(w[1:{ASKED}], ' ') AS query, array_to_string(w[{ASKED + 1}:{ASKED + EXPECTED}], ' ') AS expected
FROM (SELECT item_id, string_split({CLEAN}, ' ') AS w FROM benchmark)""")
view("swapped", augmentation.swapped("trials", POOL), "trials")
view("noised", augmentation.noised("trials", NOISE, 1) + " UNION ALL " + augmentation.noised("trials", NOISE, 2), "trials")
view("trial_forms", f"""SELECT id, NULL AS kind, 0 AS intensity, query FROM trials UNION ALL SELECT id, 'synswap', intensity, query FROM swapped
UNION ALL SELECT id, 'noise', intensity, query FROM noised
UNION ALL SELECT id, CASE WHEN s > 0 THEN 'num+' ELSE 'num-' END, abs(s), 'item ' || CAST(greatest(0, id + s) AS VARCHAR) || substr(query, 6 + length(CAST(id AS VARCHAR))) FROM trials, (SELECT unnest([1, 2, -1, -2]) AS s)""", "swapped", "noised")
view("form_terms", "SELECT id, kind, intensity, list_distinct(" + TOKENS.format(c="query") + ") AS terms FROM trial_forms", "trial_forms")
view("store_sizes", "SELECT unnest([n // 4, n // 2, n]) AS size FROM (SELECT count(*) AS n FROM documents)")


def hits(name: str, text: str) -> None:
    view(name, f"""SELECT id, kind, intensity, pid, CAST(count(*) AS DOUBLE) AS score FROM (SELECT doc_id AS pid, unnest(list_distinct({TOKENS.format(c=text)})) AS term FROM documents)
    JOIN (SELECT id, kind, intensity, unnest(terms) AS term FROM form_terms) USING (term) GROUP BY id, kind, intensity, pid""", "form_terms")


MEMORY_TEXT = f"substr(text, 1, {MEMORY})"
hits("doc_hits", "text")
hits("memory_hits", MEMORY_TEXT)
BEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, pid) AS nth FROM {rows}) WHERE nth = 1"
view("cells", "SELECT id, kind, intensity, len(terms) AS n_terms, size FROM form_terms, store_sizes WHERE kind IS NULL OR size = (SELECT min(size) FROM store_sizes)", "form_terms", "store_sizes")
view("evidence", f"""SELECT c.*, f.score AS fs, fd.text AS found, m.score AS ms, substr(md.text, 1, {MEMORY}) AS mem, expected FROM cells c JOIN trials USING (id)
LEFT JOIN ({BEST.format(keys='id, kind, intensity', rows='doc_hits')}) f ON f.id = c.id AND f.kind IS NOT DISTINCT FROM c.kind AND f.intensity = c.intensity LEFT JOIN documents fd ON fd.doc_id = f.pid
LEFT JOIN ({BEST.format(keys='id, kind, intensity, size', rows='(SELECT * FROM memory_hits JOIN store_sizes ON pid < size)')}) m ON m.id = c.id AND m.kind IS NOT DISTINCT FROM c.kind AND m.intensity = c.intensity AND m.size = c.size LEFT JOIN documents md ON md.doc_id = m.pid""",
"cells", "trials", "doc_hits", "memory_hits")
view("trial_rows", """SELECT CASE WHEN kind IS NULL THEN 'MEMSCALE' ELSE 'AUGMENT' END AS setting, CASE WHEN kind IS NULL THEN 'mem@' || CAST(size AS VARCHAR) ELSE kind || '@' || CAST(intensity AS VARCHAR) END AS param, mode, id,
CASE WHEN expected <> '' AND contains(lower(answer), lower(expected)) THEN 1 ELSE 0 END AS success, cost FROM (
  SELECT *, coalesce(CASE action WHEN 'MEM' THEN 'Memory: ' || mem WHEN 'MEMSYM' THEN coalesce('Memory: ' || mem, 'Search: ' || found) ELSE 'Search: ' || found END, 'No result found.') AS answer,
         CASE WHEN action IN ('MEM', 'MEMSYM') AND mem IS NOT NULL THEN 0.3 WHEN action <> 'MEM' AND found IS NOT NULL THEN 0.5 ELSE 0.1 END AS cost FROM (
    SELECT *, CASE WHEN mode <> 'RL' THEN mode WHEN coalesce(ms / greatest(n_terms, 1), 0) >= 0.45 THEN 'MEM' WHEN coalesce(fs / greatest(n_terms, 1), 0) >= 0.55 THEN 'SEARCH' ELSE 'MEMSYM' END AS action
    FROM evidence, (SELECT unnest(['BASE', 'MEM', 'RL']) AS mode)))""", "evidence")


def trials(spark, d):
    clean = F.regexp_replace(F.regexp_replace("text", "[0-9]", ""), "[ \n]+", " ")
    words, key = F.split(clean, " "), F.col("item_id").cast("string")
    query = F.concat(F.lit("item "), key, F.lit(" "), F.array_join(F.slice(words, 1, ASKED), " "))
    return table(spark, d, "benchmark").select(key.alias("id"), query.alias("query"), F.array_join(F.slice(words, ASKED + 1, EXPECTED), " ").alias("expected"))


def rows(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    memory = docs.select("key", F.col("key").alias("at"), F.substring("text", 1, MEMORY).alias("text"))
    n = docs.count()
    return B.evaluate(trials(spark, d), docs, memory, (n // 4, n // 2, n), MODES, pool=POOL, noise=NOISE)


@register("robustness_summary", with_views("SELECT setting, param, mode, count(*) AS n, round(avg(success), 6) AS accuracy, round(avg(cost), 6) AS avg_cost FROM trial_rows GROUP BY setting, param, mode", "trial_rows"))
def robustness_summary(spark, d):
    return B.summary(rows(spark, d)).withColumns({c: rounded(F.col(c)) for c in ("accuracy", "avg_cost")})


@register("robustness_detail", with_views("SELECT setting, param, CAST(id AS VARCHAR) AS id, success, CAST(cost AS DOUBLE) AS cost FROM trial_rows WHERE mode = 'RL'", "trial_rows"))
def robustness_detail(spark, d):
    return rows(spark, d).filter("mode = 'RL'").select("setting", "param", "id", "success", rounded(F.col("cost")).alias("cost"))
