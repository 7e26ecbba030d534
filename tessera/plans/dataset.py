"""Queries of normalisation, scoring, mining, augmentation and dataset building."""

from pyspark.sql import functions as F

from tessera.operators import mining as G
from tessera.operators import normalize as N
from tessera.operators import runs as R
from tessera.operators import text as T
from tessera.operators.stats import rounded
from tessera.plans import augmentation
from tessera.registry import register
from tessera.sources import files
from tessera.sources.views import questions, runs, table, view, with_views


def sql(body, *more):
    return with_views(body, "questions", *more)


def filled(*names):
    return "coalesce(" + ", ".join(f"nullif(trim({n}), '')" for n in names) + ")"


@register("canonical_questions", sql(f"SELECT id, {filled('query', 'question')} AS query, product, coalesce({filled('session')}, 's1') AS session, lower(coalesce({filled('type')}, 'open')) AS type, {filled('expected_contains', 'answer')} AS expected_contains FROM questions WHERE {filled('query', 'question')} IS NOT NULL"))
def canonical_questions(spark, d):
    return N.canonical_questions(questions(spark, d), "position")[0]


@register("canonical_passages", "SELECT CAST(doc_id AS VARCHAR) AS pid, trim(text) AS text, CAST(doc_id AS VARCHAR) AS doc_id, source AS title, '' AS domain FROM documents WHERE trim(text) <> ''")
def canonical_passages(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), F.col("text").alias("content"), "doc_id", F.col("source").alias("name"))
    return N.canonical_passages(docs)


RAW = "CASE l_linenumber WHEN 1 THEN 'x' WHEN 2 THEN 'inf' WHEN 3 THEN NULL ELSE CAST(l_quantity AS INTEGER)::VARCHAR END"


@register("coerce_numeric", f"SELECT l_linenumber AS line, round(sum(CASE WHEN v IS NULL OR isinf(v) OR isnan(v) THEN 0 ELSE v END), 4) AS total FROM (SELECT l_linenumber, TRY_CAST({RAW} AS DOUBLE) AS v FROM lineitem) GROUP BY l_linenumber")
def coerce_numeric(spark, d):
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string")
    raw = F.when(n == 1, "x").when(n == 2, "inf").when(n != 3, q)
    return table(spark, d, "lineitem").groupBy(n.alias("line")).agg(rounded(F.sum(N.coerce_numeric(raw)), 4).alias("total"))


@register("truthy", "SELECT o_orderpriority AS word, CASE WHEN lower(substr(trim(o_orderpriority), 1, 1)) IN ('1', 't', 'y') THEN 1.0 ELSE 0.0 END::DOUBLE AS value, count(*) AS n FROM orders GROUP BY o_orderpriority")
def truthy(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("word")).agg(F.max(N.truthy(F.substring(F.trim("o_orderpriority"), 1, 1))).alias("value"), F.count("*").alias("n"))


@register("map_columns", with_views("SELECT mode, success, latency_ms AS latency, steps, id AS qid FROM runs", "runs"))
def map_columns(spark, d):
    return N.map_columns(runs(spark, d), {"mode": ["run_mode", "mode"], "success": ["correct", "is_correct", "success"], "latency": ["latency", "latency_ms"], "steps": ["n_steps", "steps"], "qid": ["qid", "id"]})


@register("choose_confidence", with_views("SELECT 'prob' AS chosen, round(avg(confidence), 6) AS mean FROM runs", "runs"))
def choose_confidence(spark, d):
    df = runs(spark, d).withColumnRenamed("confidence", "prob").withColumn("confidence", F.lit("n/a"))
    name = N.choose_confidence(df)
    return df.agg(F.lit(name).alias("chosen"), rounded(F.avg(F.col(name).cast("double"))).alias("mean"))


view("said", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'recall' WHEN 1 THEN 'open' ELSE 'logic' END AS type, CASE p_partkey % 4 WHEN 0 THEN 'It is ' || upper(p_brand) || '!' WHEN 1 THEN 'yes it is' WHEN 2 THEN p_name ELSE '' END AS answer, CASE p_partkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN p_type WHEN 2 THEN '' ELSE p_brand END AS gold, [p_name, 'x ' || p_type] AS aliases FROM part")


def said(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("id"), F.when(k % 3 == 0, "recall").when(k % 3 == 1, "open").otherwise("logic").alias("type"), F.when(k % 4 == 0, F.concat(F.lit("It is "), F.upper("p_brand"), F.lit("!"))).when(k % 4 == 1, "yes it is").when(k % 4 == 2, F.col("p_name")).otherwise("").alias("answer"),
        F.when(k % 5 == 0, "yes").when(k % 5 == 1, F.col("p_type")).when(k % 5 == 2, "").otherwise(F.col("p_brand")).alias("gold"), F.array("p_name", F.concat(F.lit("x "), "p_type")).alias("aliases"),
    )


CANON = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
NORMAL = "trim(regexp_replace(lower({x}), '[ \\t\\n\\r]+', ' ', 'g'))"
A, GOLD = NORMAL.format(x="answer"), NORMAL.format(x="gold")
RECALL = f"CASE WHEN len(list_filter(list_transform(list_prepend(gold, aliases), lambda x: {CANON.format(x='x')}), lambda y: y <> '' AND contains({CANON.format(x='answer')}, y))) > 0 THEN 1 ELSE 0 END"
OPEN = f"CASE WHEN {GOLD} <> '' AND contains({A}, {GOLD}) THEN 1 ELSE 0 END"
LOGIC = f"CASE WHEN {A} = {GOLD} OR starts_with({A}, {GOLD} || ' ') THEN 1 ELSE 0 END"


def got():
    """Answer, gold and aliases."""
    return [F.col(c) for c in ("answer", "gold", "aliases")]


@register("score_recall", with_views(f"SELECT id, {RECALL} AS score FROM said", "said"))
def score_recall(spark, d):
    return said(spark, d).select("id", N.score_recall(*got()).alias("score"))


@register("score_open", with_views(f"SELECT id, {OPEN} AS score FROM said", "said"))
def score_open(spark, d):
    return said(spark, d).select("id", N.score_open(*got()[:2]).alias("score"))


@register("score_logic", with_views(f"SELECT id, {LOGIC} AS score FROM said", "said"))
def score_logic(spark, d):
    return said(spark, d).select("id", N.score_logic(*got()[:2]).alias("score"))


SUCCESS = f"CASE type WHEN 'recall' THEN {RECALL} WHEN 'open' THEN {OPEN} ELSE CASE WHEN {GOLD} IN ('yes', 'no') THEN {LOGIC} WHEN lower(gold) <> '' AND contains(lower(answer), lower(gold)) THEN 1 ELSE 0 END END"


@register("score_success", with_views(f"SELECT id, type, {SUCCESS} AS success FROM said", "said"))
def score_success(spark, d):
    return said(spark, d).select("id", "type", N.score_success(F.col("type"), *got()).alias("success"))


@register("domain_report_rows", with_views(f"SELECT id, type, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS stored, {SUCCESS} AS rescored FROM said", "said"))
def domain_report_rows(spark, d):
    """Rows of every domain."""
    return reported(said(spark, d))


def reported(rows):
    """Stored and re-scored success of rows that said() gives."""
    return rows.select("id", "type", (F.col("id") % 2 == 0).cast("int").alias("stored"), N.score_success(F.col("type"), *got()).alias("rescored"))


@register("repair_success", with_views("""SELECT id, CAST(CASE WHEN id % 2 = 0 THEN 1 WHEN len(t) > 0 AND len(list_filter(t, lambda x: NOT contains(lower(answer), trim(x)))) = 0 THEN 1 ELSE 0 END AS INTEGER) AS success
FROM (SELECT *, list_filter(string_split(lower(gold), ';'), lambda x: trim(x) <> '') AS t FROM said)""", "said"))
def repair_success(spark, d):
    stored = F.when(F.col("id") % 2 == 0, "1").otherwise("bad")
    return said(spark, d).select("id", N.repair_success(stored, F.col("answer"), F.col("gold")).alias("success"))


@register("repair_questions", sql(f"""SELECT status, count(*) AS n, count(DISTINCT type) AS types FROM (SELECT CASE WHEN coalesce(trim(query) <> '', false) AND coalesce(trim(expected_contains) <> '', false) THEN 'kept'
WHEN {filled('query', 'question')} IS NOT NULL AND {filled('expected_contains', 'session')} IS NOT NULL THEN 'repaired' ELSE 'dropped' END AS status,
coalesce(lower(type), CASE WHEN regexp_matches({filled('expected_contains', 'session')}, '[0-9]') THEN 'recall' ELSE 'open' END) AS type FROM questions) GROUP BY status"""))
def repair_questions(spark, d):
    q = questions(spark, d).withColumnsRenamed({"question": "q", "session": "span"})
    return N.repair_questions(q, "position").groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("type").alias("types"))


@register("normalize_ids", sql("""WITH x AS (SELECT CASE WHEN position % 5 = 0 THEN 'dup' ELSE id END AS id, domain, lower(coalesce(type, 'open')) AS type, position FROM questions),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY position) > 1 AS bad FROM x)
SELECT position, CASE WHEN bad THEN domain || '_' || substr(type, 1, 3) || '_' || lpad(CAST(row_number() OVER (PARTITION BY bad, domain, type ORDER BY position) AS VARCHAR), 5, '0') ELSE id END AS id FROM f"""))
def normalize_ids(spark, d):
    q = questions(spark, d).select(F.when(F.col("position") % 5 == 0, "dup").otherwise(F.col("id")).alias("id"), "domain", F.lower(F.coalesce("type", F.lit("open"))).alias("type"), "position")
    return N.normalize_ids(q, "position").select("position", "id")


@register("normalize_text", f"SELECT doc_id, {NORMAL.format(x='text')} AS normal, {CANON.format(x='text')} AS canonical FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normal(F.col("text")).alias("normal"), T.canonical(F.col("text")).alias("canonical"))


@register("localname", "SELECT page_id, regexp_extract(url, '([^#/]*)$', 1) AS name FROM pages")
def localname(spark, d):
    return table(spark, d, "pages").select("page_id", T.local_name(F.col("url")).alias("name"))


@register("lint_questions", sql("""SELECT id, unnest(list_filter([CASE WHEN coalesce(trim(query), '') = '' THEN 'missing query' END, CASE WHEN coalesce(trim(expected_contains), '') = '' THEN 'missing gold' END,
CASE WHEN NOT coalesce(lower(type) IN ('recall', 'logic', 'open'), false) THEN 'unusual type' END, CASE WHEN coalesce(trim(domain), '') = '' THEN 'missing domain' END], lambda x: x IS NOT NULL)) AS violation FROM questions"""))
def lint_questions(spark, d):
    return N.lint(questions(spark, d))


@register("validate_questions", """SELECT event_id, unnest(list_filter([CASE WHEN contains(props, '...') THEN 'placeholder' END, CASE WHEN NOT json_valid(props) THEN 'invalid json' WHEN json_extract_string(props, '$.k') IS NULL THEN 'missing k' END], lambda x: x IS NOT NULL)) AS violation FROM events""")
def validate_questions(spark, d):
    """Every row is parsed and checked."""
    return violations(table(spark, d, "events"))


def violations(e):
    return N.validate_json(e, "props", "event_id", "k string", ["k"]).select("event_id", "violation")


@register("dedup_keep_first", with_views("""WITH k AS (SELECT *, trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g')) AS key FROM documents)
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS nth, key FROM k) WHERE nth = 1 OR key = ''""", "questions"))
def dedup_keep_first(spark, d):
    docs = table(spark, d, "documents").withColumn("key", T.normal(F.col("text")))
    return R.dedup_keep_first(docs, [F.sha2("key", 256)], ["doc_id"], keep_blank="key").select("doc_id")


@register("cap_per_group", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents) WHERE nth <= 12")
def cap_per_group(spark, d):
    return R.cap_per_group(table(spark, d, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 12)


@register("round_robin_sessions", "WITH m AS (SELECT item_id AS position, text FROM benchmark), n AS (SELECT count(*) AS n FROM m) SELECT slot, 's' || CAST(slot % 3 + 1 AS VARCHAR) AS session_id, CASE WHEN slot < n THEN text ELSE text || ' [dup ' || CAST(slot AS VARCHAR) || ']' END AS content FROM (SELECT unnest(range(0, 500)) AS slot), n JOIN m ON m.position = slot % n")
def round_robin_sessions(spark, d):
    m = table(spark, d, "benchmark").select(F.col("item_id").alias("position"), F.col("text").alias("content"))
    return R.round_robin_sessions(m, 500, ["s1", "s2", "s3"])


@register("shuffle_take", "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '7'), doc_id LIMIT 25")
def shuffle_take(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("7"))), "doc_id").limit(25)


@register("novel_items", sql(f"""WITH present AS (SELECT {NORMAL.format(x='query')} AS k FROM questions WHERE position % 2 = 0 AND query IS NOT NULL), c AS (SELECT position, {NORMAL.format(x='query')} AS k FROM questions WHERE query IS NOT NULL)
SELECT position FROM (SELECT position, k, row_number() OVER (PARTITION BY k ORDER BY position) AS nth FROM c WHERE k NOT IN (SELECT k FROM present)) WHERE nth = 1"""))
def novel_items(spark, d):
    q = questions(spark, d).filter("query is not null")
    return N.novel_items(q, q.filter("position % 2 = 0"), "query", "position").select("position")


@register("corpus_qc", "SELECT count(*) AS n, count(DISTINCT trim(text)) AS n_distinct, count(*) FILTER (WHERE trim(text) = '') AS n_empty, count(*) FILTER (WHERE length(trim(text)) BETWEEN 1 AND 39) AS n_short, count(*) - count(DISTINCT trim(text)) AS n_duplicate FROM documents")
def corpus_qc(spark, d):
    return N.corpus_qc(table(spark, d, "documents"))


@register("hash_split", "SELECT doc_id, CASE WHEN ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT / 4294967295.0 < 0.3 THEN 'dev' ELSE 'test' END AS split FROM documents")
def hash_split(spark, d):
    return table(spark, d, "documents").select("doc_id", T.hash_split(F.col("doc_id").cast("string")).alias("split"))


@register("hash_ids", "SELECT doc_id, substr(sha1(lang || '|' || text), 1, 10) AS id FROM documents")
def hash_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", T.hash_id(F.col("lang"), F.col("text")).alias("id"))


CHUNKS = """WITH RECURSIVE pieces AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda y: y <> '') AS ps FROM documents),
walk AS (SELECT doc_id, ps, 1 AS i, ''::VARCHAR AS cur, NULL::VARCHAR AS out FROM pieces UNION ALL
SELECT doc_id, ps, i + 1, CASE WHEN cur = '' THEN ps[i] WHEN length(cur) + 1 + length(ps[i]) <= 1200 OR length(cur) < 600 THEN cur || chr(10) || ps[i] ELSE ps[i] END,
CASE WHEN cur <> '' AND length(cur) + 1 + length(ps[i]) > 1200 AND length(cur) >= 600 THEN cur END FROM walk WHERE i <= len(ps))
SELECT doc_id, out AS chunk FROM walk WHERE out IS NOT NULL UNION ALL SELECT doc_id, cur FROM walk WHERE i = len(ps) + 1 AND cur <> ''"""


@register("chunk_paragraphs", CHUNKS)
def chunk_paragraphs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(T.chunk_paragraphs(F.col("text"), separator="\n")).alias("chunk"))


LINES = "'Brand: ' || p_brand || chr(10) || '- Type = ' || p_type || chr(10) || 'Weight  ' || CAST(p_size AS VARCHAR) || ' kg, ' || CAST(p_size + 1 AS VARCHAR) || '.5 kWh' || chr(10) || 'plain line' || chr(10) || 'brand: ' || p_brand"
view("sheets", f"SELECT p_partkey AS doc, {LINES} AS text FROM part")


def sheets(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.concat(F.lit("Brand: "), "p_brand", F.lit("\n- Type = "), "p_type", F.lit("\nWeight  "), size.cast("string"), F.lit(" kg, "), (size + 1).cast("string"), F.lit(".5 kWh\nplain line\nbrand: "), "p_brand").alias("text"))


@register("extract_kv", "SELECT doc, label, value, line_no FROM (SELECT p_partkey AS doc, 'Brand' AS label, trim(p_brand) AS value, 0 AS line_no FROM part UNION ALL SELECT p_partkey, 'Type', trim(p_type), 1 FROM part UNION ALL SELECT p_partkey, 'Weight', CAST(p_size AS VARCHAR) || ' kg, ' || CAST(p_size + 1 AS VARCHAR) || '.5 kWh', 2 FROM part)")
def extract_kv(spark, d):
    return T.extract_kv(sheets(spark, d), "doc", "text")


@register("extract_numeric", "SELECT p_partkey AS doc, CAST(p_size AS VARCHAR) || ' kg' AS value, 1::BIGINT AS n FROM part UNION ALL SELECT p_partkey, CAST(p_size + 1 AS VARCHAR) || '.5 kWh', 1 FROM part")
def extract_numeric(spark, d):
    return T.extract_numeric(sheets(spark, d), "doc", "text")


@register("numeric_contexts", """WITH s AS (SELECT p_partkey AS doc, 'Pack ' || p_name || ', kept at ' || CAST(p_size AS VARCHAR) || ' °C for ' || CAST(p_size + 1 AS VARCHAR) || '.5 kWh ' || p_type AS t, CAST(p_size AS VARCHAR) || ' °C' AS a, CAST(p_size + 1 AS VARCHAR) || '.5 kWh' AS b FROM part),
v AS (SELECT doc, t, a AS value, strpos(t, 'kept at ') + 7 AS start FROM s UNION ALL SELECT doc, t, b, strpos(t, ' °C for ') + 7 FROM s)
SELECT doc, value, CAST(start AS INTEGER) AS start, substr(t, CAST(greatest(0, start - 40) + 1 AS BIGINT), CAST(start + length(value) + 40 - greatest(0, start - 40) AS BIGINT)) AS context FROM v""")
def numeric_contexts(spark, d):
    size = lambda n: (F.col("p_size") + n).cast("string")
    t = F.concat(F.lit("Pack "), "p_name", F.lit(", kept at "), size(0), F.lit(" °C for "), size(1), F.lit(".5 kWh "), "p_type")
    return T.numeric_contexts(table(spark, d, "part").select(F.col("p_partkey").alias("doc"), t.alias("t")), "doc", "t")


@register("extract_title", "SELECT p_partkey AS doc, CASE WHEN length(trim(p_name)) BETWEEN 3 AND 80 THEN trim(p_name) END AS title FROM part")
def extract_title(spark, d):
    t = F.concat(F.lit("Data sheet — "), "p_name", F.lit(" (2024)\nnext — line"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc"), T.extract_title(t).alias("title"))


CAPS = "(SELECT count(*) AS parts, count(*) + count(*) // 2 AS recalls FROM part)"
NEAR = "trim(regexp_replace(substr(text, CAST(greatest(0, start - 40) + 1 AS BIGINT), CAST(start + length(value) + 40 - greatest(0, start - 40) AS BIGINT)), '[ \\t\\n\\r]+', ' ', 'g'))"


@register("doc_questions", with_views(f"""WITH kv AS (SELECT p_partkey AS doc, 'Brand' AS label, trim(p_brand) AS value, 0 AS line_no, 'open' AS type FROM part UNION ALL SELECT p_partkey, 'Type', trim(p_type), 1, 'open' FROM part
UNION ALL SELECT p_partkey, 'Weight', CAST(p_size AS VARCHAR) || ' kg, ' || CAST(p_size + 1 AS VARCHAR) || '.5 kWh', 2, 'recall' FROM part),
places AS (SELECT doc, text, CAST(p_size AS VARCHAR) || ' kg' AS value, strpos(text, 'Weight  ') + 7 AS start FROM sheets JOIN part ON p_partkey = doc UNION ALL SELECT doc, text, CAST(p_size + 1 AS VARCHAR) || '.5 kWh', strpos(text, ' kg, ') + 4 FROM sheets JOIN part ON p_partkey = doc),
items AS (SELECT 1 AS pass, doc, line_no AS place, type, 'According to ' || CAST(doc AS VARCHAR) || ', what is the ' || label || '?' AS query, value AS expected FROM kv WHERE NOT (type = 'open' AND line_no = 0 AND doc % 10 = 0)
UNION ALL SELECT 2, doc, start, 'recall', 'In ' || CAST(doc AS VARCHAR) || ', what is the value reported near: "' || CASE WHEN length({NEAR}) > 120 THEN substr({NEAR}, 1, 120) || '...' ELSE {NEAR} END || '"?', value FROM places),
nth AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY pass, doc, place) AS nth FROM items), used AS (SELECT count(*) AS used FROM part WHERE p_partkey % 10 = 0)
SELECT CASE type WHEN 'open' THEN 'docopen-' || lpad(CAST(nth - 1 + used AS VARCHAR), 6, '0') ELSE 'docrec-' || lpad(CAST(nth - 1 AS VARCHAR), 6, '0') END AS id, type, CAST(doc AS VARCHAR) AS source, query, expected, CAST(pass AS INTEGER) AS pass
FROM nth, used, {CAPS} WHERE nth <= CASE type WHEN 'open' THEN parts ELSE recalls END""", "sheets"))
def doc_questions(spark, d):
    """Items of all sheets, up to one open and one and a half recall items for each; every tenth brand is asked already."""
    parts = table(spark, d, "part")
    docs = sheets(spark, d).select(F.col("doc").alias("at"), F.col("doc").cast("string").alias("source"), "text")
    asked, n = parts.filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("key")), parts.count()
    number = F.lpad((F.col("key") / 10).cast("long").cast("string"), 6, "0")
    existing = asked.select(F.concat(F.lit("docopen-"), number).alias("id"), F.concat(F.lit("ACCORDING to "), F.col("key").cast("string"), F.lit(",  what is the brand?")).alias("query"))
    return G.mine(docs, existing, n, n + n // 2)


@register("numshift", "SELECT p_partkey, CAST(greatest(0, p_size - 10) AS VARCHAR) || ' of x' || CAST(p_size AS VARCHAR) || ', ' || CAST(greatest(0, p_size - 9) AS VARCHAR) || '.' AS shifted FROM part")
def numshift(spark, d):
    size = F.col("p_size").cast("string")
    text = F.concat(size, F.lit(" of x"), size, F.lit(", "), (F.col("p_size") + 1).cast("string"), F.lit("."))
    return table(spark, d, "part").select("p_partkey", T.numbers_shifted(text, -10).alias("shifted"))


ASKED = "(SELECT id, query FROM questions WHERE query IS NOT NULL)"


def asked(spark, d):
    return questions(spark, d).filter("query is not null").select("id", "query")


@register("synswap", sql(augmentation.swapped(ASKED, augmentation.POOL)))
def synswap(spark, d):
    forms = [F.struct(F.lit(n).alias("intensity"), T.synonyms_swapped(F.col("id"), F.col("query"), n, augmentation.POOL).alias("query")) for n in (1, 2)]
    return asked(spark, d).select("id", F.explode(F.array(*forms)).alias("f")).select("id", "f.intensity", "f.query")


@register("insert_noise", sql(augmentation.noised(ASKED, augmentation.NOISE, 2)))
def insert_noise(spark, d):
    return asked(spark, d).select("id", F.lit(2).alias("intensity"), T.noise_inserted(F.col("id"), F.col("query"), 2, augmentation.NOISE).alias("query"))


@register("augment_grid", sql("SELECT kind, intensity, count(*) AS n FROM questions, (SELECT unnest(['synswap', 'noise', 'num+', 'num-']) AS kind), (SELECT unnest([1, 2]) AS intensity) WHERE query IS NOT NULL GROUP BY kind, intensity"))
def augment_grid(spark, d):
    return T.augment_grid(asked(spark, d), "id", "query", augmentation.POOL, augmentation.NOISE).groupBy("kind", "intensity").agg(F.countDistinct("id").alias("n"))


@register("paraphrase_variants", sql(augmentation.paraphrased(ASKED, 3, augmentation.PHRASES, augmentation.TRAILS)))
def paraphrase_variants(spark, d):
    return T.paraphrases(asked(spark, d), "id", "query", 3, augmentation.PHRASES, augmentation.TRAILS)


@register("contrastive_negatives", sql("SELECT id, false AS contrastive FROM questions UNION ALL SELECT 'neg-' || substr(sha1('neg|' || id), 1, 10), true FROM questions WHERE type IN ('recall', 'open')"))
def contrastive_negatives(spark, d):
    return T.contrastive_negatives(questions(spark, d)).select("id", "contrastive")


#: Characters of a chunk of flatten_corpus.
PIECE = 1000


@register("flatten_corpus", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, pid, text FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) || '#p1' AS pid, trim(text) AS text FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, CAST(doc_id AS VARCHAR) || '#' || CAST(i AS VARCHAR), trim(substr(text, CAST((i - 1) * {PIECE} + 1 AS BIGINT), {PIECE})) FROM (SELECT doc_id, text, unnest(range(1, length(text) // {PIECE} + 2)) AS i FROM documents WHERE doc_id % 3 = 0)) WHERE text <> ''")
def flatten_corpus(spark, d):
    """Chunks of PIECE characters over the whole text."""
    key = F.col("doc_id").cast("string")
    places = F.sequence(F.lit(1), F.floor(F.length("text") / PIECE).cast("int") + 1)
    pieces = F.transform(places, lambda i: F.struct(F.concat(key, F.lit("#"), i.cast("string")).alias("pid"), F.substring(F.col("text"), (i - 1) * PIECE + 1, F.lit(PIECE)).alias("text")))
    docs = table(spark, d, "documents").select(key.alias("doc_id"), F.lit(None).cast("string").alias("pid"), "text", F.when(F.col("doc_id") % 3 == 0, pieces).alias("chunks"))
    return files.flatten_corpus(docs)


@register("build_corpus_split", "SELECT id, min(text) AS text FROM (SELECT substr(sha1(text), 1, 12) AS id, text FROM documents UNION ALL SELECT 'gold:' || substr(sha1(text), 1, 10), text FROM benchmark) WHERE ('0x' || substr(md5(id), 1, 8))::BIGINT / 4294967295.0 < 0.3 GROUP BY id")
def build_corpus_split(spark, d):
    docs = table(spark, d, "documents").select(F.lit(None).cast("string").alias("id"), "text")
    return files.build_corpus_split(docs, table(spark, d, "benchmark").select("text"), "dev")


@register("id_domain_map", "SELECT coalesce(n_name, 'unknown') AS domain, count(*) AS n FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) ON c_nationkey = n_nationkey GROUP BY domain")
def id_domain_map(spark, d):
    names = table(spark, d, "nation").filter("n_nationkey % 4 <> 0")
    return table(spark, d, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.coalesce("n_name", F.lit("unknown")).alias("domain")).agg(F.count("*").alias("n"))


@register("read_alias_map", "SELECT n_name AS value, coalesce(term, 'none') AS term FROM nation LEFT JOIN (VALUES ('NATION_1', 'first'), ('first', 'first'), ('NATION_2', 'second'), ('second', 'second')) m(alias, term) ON alias = n_name")
def read_alias_map(spark, d):
    m = files.read_alias_map(spark, {"first": ["NATION_1"], "second": ["NATION_2"]})
    return table(spark, d, "nation").join(m, F.col("n_name") == F.col("alias"), "left").select(F.col("n_name").alias("value"), F.coalesce("term", F.lit("none")).alias("term"))


RULE_TEXTS = r"regexp_matches(text, '\bEN_?62133_?2\b.*\btests passed\b') OR regexp_matches(text, '\bppm *\( *>')"
view("contexts", "SELECT CAST(id AS VARCHAR) AS id, unnest([CASE WHEN id % 4 = 0 THEN 'per EN_62133_2 all tests passed' ELSE 'nothing' END, CASE WHEN id % 5 = 0 THEN 'lead 12 ppm ( > 10)' ELSE 'low' END]) AS text FROM (SELECT l_orderkey AS id FROM lineitem GROUP BY l_orderkey)")


def contexts(spark, d):
    k = F.col("l_orderkey")
    texts = F.array(F.when(k % 4 == 0, "per EN_62133_2 all tests passed").otherwise("nothing"), F.when(k % 5 == 0, "lead 12 ppm ( > 10)").otherwise("low"))
    return table(spark, d, "lineitem").select("l_orderkey").distinct().select(k.cast("string").alias("id"), texts.alias("contexts"))


#: Phrases in a context that count as a rule having fired (fixed values).
FIRES = r"(?i)\bEN_?62133_?2\b.*\btests passed\b|\bppm *\( *>"


@register("text_rule_fires", with_views(f"SELECT id, bool_or({RULE_TEXTS}) AS fired FROM contexts GROUP BY id", "contexts"))
def text_rule_fires(spark, d):
    return contexts(spark, d).select("id", F.exists("contexts", lambda c: c.rlike(FIRES)).alias("fired"))


@register("runs_trace_join", with_views(f"SELECT runs.mode, count(*) AS n_total, count(*) FILTER (WHERE coalesce(fired, false)) AS fired_n, round(avg(success) FILTER (WHERE fired), 6) AS precision FROM runs LEFT JOIN (SELECT id, bool_or({RULE_TEXTS}) AS fired FROM contexts GROUP BY id) t USING (id) GROUP BY mode", "runs", "contexts"))
def runs_trace_join(spark, d):
    traces = contexts(spark, d)
    joined = runs(spark, d).join(traces, "id", "left").withColumn("fired", F.exists(F.coalesce("contexts", F.array().cast("array<string>")), lambda c: c.rlike(FIRES)))
    return joined.groupBy("mode").agg(F.count("*").alias("n_total"), F.count_if("fired").alias("fired_n"), rounded(F.avg(F.when(F.col("fired"), F.col("success")))).alias("precision"))


@register("trace_digest", with_views("SELECT mode, success, count(*) AS n, min(id) AS least_id FROM (SELECT mode, success, id, row_number() OVER (PARTITION BY mode, success ORDER BY md5(id || '5'), id) AS nth FROM runs) WHERE nth <= 4 GROUP BY mode, success", "runs"))
def trace_digest(spark, d):
    return R.sample_per_group(runs(spark, d).select("mode", "success", "id"), ["mode", "success"], "id", 4, seed="5").groupBy("mode", "success").agg(F.count("*").alias("n"), F.min("id").alias("least_id"))


@register("sym_trace_sample", with_views(f"SELECT id, n_contexts FROM (SELECT id, count(*) AS n_contexts FROM contexts GROUP BY id HAVING bool_or({RULE_TEXTS})) ORDER BY id LIMIT 10", "contexts"))
def sym_trace_sample(spark, d):
    """The first rows that have a symbolic trace: a rule fired in one of their contexts."""
    traced = contexts(spark, d).filter(F.exists("contexts", lambda c: c.rlike(FIRES)))
    return traced.select("id", F.size("contexts").cast("long").alias("n_contexts")).orderBy("id").limit(10)
