"""Knowledge-graph queries: orders are products, their parts components; part types are classes in a small hierarchy."""

from pyspark.sql import functions as F

from tessera.operators import kg as K
from tessera.plans import augmentation
from tessera.registry import register
from tessera.sources.views import table, view, with_views

SCHEMA = [("Battery", "subClassOf", "Component"), ("WirelessModule", "subClassOf", "Electrical"), ("ElectricalModule", "subClassOf", "Electrical"), ("Electrical", "subClassOf", "Component"), ("Component", "subClassOf", "Thing"), ("WoolFabric", "subClassOf", "Fabric"), ("hasComponent", "domain", "Product"), ("usesMaterial", "subPropertyOf", "uses"), ("usesFabric", "subPropertyOf", "uses"), ("usesMaterial", "range", "Material"), ("Product", "subClassOf", "Thing")]
KIND = "p_partkey % 7"
NAMES = {0: "Battery", 1: "WirelessModule", 2: "Compressor", 3: "PrinterHead", 4: "TonerCartridge", 5: "MainBoard", 6: "ElectricalModule"}

view(
    "triples",
    f"""SELECT DISTINCT s, p, o, o_is_literal FROM (
SELECT 'o' || CAST(l_orderkey AS VARCHAR) AS s, 'hasComponent' AS p, 'p' || CAST(l_partkey AS VARCHAR) AS o, false AS o_is_literal FROM lineitem
UNION ALL SELECT 'o' || CAST(l_orderkey AS VARCHAR), 'hasStep', CASE WHEN l_linestatus = 'O' THEN 'BatteryTestStep' ELSE 'WirelessTestStep' END, false FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR), 'type', CASE {KIND} {' '.join(f"WHEN {k} THEN '{v}'" for k, v in NAMES.items())} END, false FROM part
UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR), 'label', p_name, true FROM part
UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR), 'brand', p_brand, true FROM part
UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR), 'usesMaterial', CASE WHEN p_size % 5 = 0 THEN 'LeadMaterial' ELSE 'SteelMaterial' END, false FROM part
UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR), 'usesFabric', CASE WHEN p_size % 2 = 0 THEN 'f1' ELSE 'f2' END, false FROM part WHERE p_size % 7 = 0
UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR), 'usesRefrigerant', 'R32', false FROM part WHERE p_size % 11 = 0
UNION ALL SELECT s, p, o, false FROM (VALUES {', '.join(map(str, [*SCHEMA, ('f1', 'type', 'WoolFabric'), ('f2', 'type', 'Fabric')]))}) v(s, p, o))""",
)


def triples(spark, d):
    item, part = table(spark, d, "lineitem"), table(spark, d, "part")
    node = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    make = lambda df, s, p, o, lit=False: df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(lit).alias("o_is_literal"))
    kinds = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    p, even = node("p", "p_partkey"), F.col("p_size") % 2 == 0
    rows = [
        make(item, node("o", "l_orderkey"), "hasComponent", node("p", "l_partkey")),
        make(item.filter("l_returnflag = 'R'"), node("o", "l_orderkey"), "hasStep", F.when(F.col("l_linestatus") == "O", "BatteryTestStep").otherwise("WirelessTestStep")),
        make(part, p, "type", kinds[(F.col("p_partkey") % 7).cast("int")]),
        make(part, p, "label", F.col("p_name"), True),
        make(part, p, "brand", F.col("p_brand"), True),
        make(part, p, "usesMaterial", F.when(F.col("p_size") % 5 == 0, "LeadMaterial").otherwise("SteelMaterial")),
        make(part.filter("p_size % 7 = 0"), p, "usesFabric", F.when(even, "f1").otherwise("f2")),
        make(part.filter("p_size % 11 = 0"), p, "usesRefrigerant", F.lit("R32")),
        spark.createDataFrame([(*t, False) for t in [*SCHEMA, ("f1", "type", "WoolFabric"), ("f2", "type", "Fabric")]], "s string, p string, o string, o_is_literal boolean"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.distinct()


def sql(body, *more):
    return with_views(body, "triples", *more)


@register("read_triples", sql("SELECT p, o_is_literal, count(*) AS n FROM triples GROUP BY p, o_is_literal"))
def read_triples(spark, d):
    return triples(spark, d).groupBy("p", "o_is_literal").agg(F.count("*").alias("n"))


view("classes", "WITH RECURSIVE c AS (SELECT s AS a, o AS b FROM triples WHERE p = 'subClassOf' UNION SELECT c.a, t.o FROM c JOIN triples t ON t.s = c.b AND t.p = 'subClassOf') SELECT * FROM c WHERE a <> b", "triples")
view(
    "closed",
    """WITH props AS (SELECT s AS a, o AS b FROM triples WHERE p = 'subPropertyOf'), facts AS (SELECT * FROM triples UNION SELECT t.s, props.b, t.o, t.o_is_literal FROM triples t JOIN props ON t.p = props.a),
dom AS (SELECT f.s, 'type' AS p, t.o, false AS o_is_literal FROM facts f JOIN triples t ON t.p = 'domain' AND t.s = f.p), rng AS (SELECT f.o AS s, 'type' AS p, t.o, false AS o_is_literal FROM facts f JOIN triples t ON t.p = 'range' AND t.s = f.p WHERE NOT f.o_is_literal),
ty AS (SELECT s, o FROM facts WHERE p = 'type' UNION SELECT s, o FROM dom UNION SELECT s, o FROM rng)
SELECT * FROM facts UNION SELECT * FROM dom UNION SELECT * FROM rng UNION SELECT a, 'subClassOf', b, false FROM classes UNION SELECT ty.s, 'type', classes.b, false FROM ty JOIN classes ON ty.o = classes.a""",
    "classes",
)


@register("kg_closure", sql("SELECT p, count(*) AS n, bit_xor(('0x' || substr(md5(s || '|' || o), 1, 8))::BIGINT) AS checksum FROM closed GROUP BY p", "closed"))
def kg_closure(spark, d):
    c = K.closure(triples(spark, d))
    return c.groupBy("p").agg(F.count("*").alias("n"), F.bit_xor(F.conv(F.substring(F.md5(F.concat("s", F.lit("|"), "o")), 1, 8), 16, 10).cast("long")).alias("checksum"))


@register("inferred_types", sql("SELECT s, o FROM closed WHERE p = 'type' EXCEPT SELECT s, o FROM triples WHERE p = 'type'", "closed"))
def inferred_types(spark, d):
    t = triples(spark, d)
    return K.inferred_types(t, K.closure(t))


def rule_sql(rule, source="triples"):
    """SQL twin of one rule over the base triples (plus `fired` heads that an `unless` looks for)."""
    match = f"t.p = '{rule.predicate}'" + (f" AND t.o = '{rule.object}'" if rule.object else "")
    via = f" AND t.o IN (SELECT s FROM {source} WHERE p = 'type' AND o = '{rule.via_type}')" if rule.via_type else ""
    unless = f" AND h.s NOT IN (SELECT s FROM {source} WHERE p = '{rule.unless[0]}' AND o = '{rule.unless[1]}')" if rule.unless else ""
    heads = ", ".join(map(str, rule.heads))
    return f"SELECT DISTINCT h.s, head.p, head.o, '{rule.name}' AS rule FROM {source} h JOIN {source} t ON h.p = 'hasComponent' AND h.o = t.s AND {match}{via}, (VALUES {heads}) head(p, o) WHERE true{unless}"


def added_sql(domain, skip=()):
    return " UNION ALL ".join(rule_sql(r) for r in K.RULES[domain] if r.name not in skip)


def _rules(domain):
    def run(spark, d):
        return K.apply_rules(triples(spark, d), K.RULES[domain])

    register(f"rules_{domain}", sql(added_sql(domain)))(run)


for _domain in K.RULES:
    _rules(_domain)

view("added", added_sql("battery"), "triples")


def added(spark, d):
    return K.apply_rules(triples(spark, d), K.RULES["battery"])


@register("apply_rules", sql("SELECT count(*) AS added FROM (SELECT DISTINCT s, p, o FROM added)", "added"))
def apply_rules(spark, d):
    return added(spark, d).select("s", "p", "o").distinct().agg(F.count("*").alias("added"))


@register("rule_ablation", sql(f"SELECT r.rule, (SELECT count(*) FROM (SELECT DISTINCT s, p, o FROM added)) AS n, (SELECT count(*) FROM (SELECT DISTINCT s, p, o FROM added a WHERE a.rule <> r.rule)) AS n_without FROM (VALUES {', '.join(f'({r.name!r})' for r in K.RULES['battery'])}) r(rule)", "added"))
def rule_ablation(spark, d):
    return K.rule_knockouts(triples(spark, d), K.RULES["battery"])


REQUIRED = "SELECT s AS product, coalesce(string_agg(DISTINCT o, ', ' ORDER BY o) FILTER (WHERE p = 'requiresCompliance'), '') AS compliances, coalesce(string_agg(DISTINCT o, ', ' ORDER BY o) FILTER (WHERE p = 'requiresStep'), '') AS steps FROM added GROUP BY s"


@register("required_compliance", sql(f"SELECT product, compliances FROM ({REQUIRED})", "added"))
def required_compliance(spark, d):
    return K.required(added(spark, d)).select("product", F.array_join("compliances", ", ").alias("compliances"))


@register("required_steps", sql(f"SELECT product, steps FROM ({REQUIRED})", "added"))
def required_steps(spark, d):
    return K.required(added(spark, d)).select("product", F.array_join("steps", ", ").alias("steps"))


@register("answer_symbolic", sql(f"SELECT product, concat_ws(' ', CASE WHEN compliances <> '' THEN 'Symbolic: standards for ' || product || ': ' || compliances || '.' END, CASE WHEN steps <> '' THEN 'Required steps: ' || steps || '.' END) AS answer FROM ({REQUIRED})", "added"))
def answer_symbolic(spark, d):
    return K.answers(added(spark, d)).select("product", "answer")


@register("sym_fire_flag", sql("SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS product, 'o' || CAST(o_orderkey AS VARCHAR) IN (SELECT s FROM added) AS fired FROM orders", "added"))
def sym_fire_flag(spark, d):
    flags = added(spark, d).select(F.col("s").alias("product"), F.lit(True).alias("f")).distinct()
    orders = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("product"))
    return orders.join(flags, "product", "left").select("product", F.coalesce("f", F.lit(False)).alias("fired"))


@register("rule_join", sql("SELECT h.s AS product, count(DISTINCT h.o) AS n FROM triples h JOIN triples t ON h.o = t.s AND t.p = 'type' AND t.o = 'Battery' WHERE h.p = 'hasComponent' GROUP BY h.s"))
def rule_join(spark, d):
    t = triples(spark, d)
    batteries = t.filter("p = 'type' and o = 'Battery'").select(F.col("s").alias("c"))
    return t.filter("p = 'hasComponent'").join(batteries, F.col("o") == F.col("c"), "left_semi").groupBy(F.col("s").alias("product")).agg(F.countDistinct("o").alias("n"))


@register("rule_not_exists", sql("SELECT DISTINCT s AS product FROM triples WHERE p = 'hasComponent' AND s NOT IN (SELECT s FROM triples WHERE p = 'hasStep' AND o = 'BatteryTestStep')"))
def rule_not_exists(spark, d):
    t = triples(spark, d)
    return t.filter("p = 'hasComponent'").select("s").distinct().join(t.filter("p = 'hasStep' and o = 'BatteryTestStep'").select("s"), "s", "left_anti").select(F.col("s").alias("product"))


@register("literal_facts", sql("SELECT s, p, o FROM triples WHERE o_is_literal AND p NOT IN ('label', 'type', 'sameAs')"))
def literal_facts(spark, d):
    return K.facts(triples(spark, d), True).select("s", "p", "o")


@register("object_facts", sql("SELECT p, count(*) AS n FROM triples WHERE NOT o_is_literal AND p NOT IN ('label', 'type', 'sameAs') GROUP BY p"))
def object_facts(spark, d):
    return K.facts(triples(spark, d), False).groupBy("p").agg(F.count("*").alias("n"))


@register("select_products", sql("SELECT DISTINCT s FROM triples WHERE p = 'type' AND o = 'Compressor'"))
def select_products(spark, d):
    return K.select_products(triples(spark, d), "Compressor")


view("named", "SELECT s AS node, min(o) AS label FROM triples WHERE p = 'label' GROUP BY s", "triples")


@register("label_lookup", sql("SELECT DISTINCT t.o AS node, coalesce(label, regexp_extract(t.o, '([^#/]*)$', 1)) AS label FROM triples t LEFT JOIN named ON named.node = t.o WHERE NOT o_is_literal", "named"))
def label_lookup(spark, d):
    t = triples(spark, d)
    return K.with_label(t.filter(~F.col("o_is_literal")).select(F.col("o").alias("node0")).distinct(), "node0", K.labels(t), "label").select(F.col("node0").alias("node"), "label")


CHECKS = [("refrigerant", ["usesRefrigerant"], None), ("lead", ["usesMaterial"], "LeadMaterial"), ("fabric or refrigerant", ["usesFabric", "usesRefrigerant"], None)]


@register("ask_checks", sql("""
WITH pr AS (SELECT DISTINCT s AS product FROM triples WHERE p = 'hasComponent'), checks(name) AS (VALUES ('refrigerant'), ('lead'), ('fabric or refrigerant')),
hits AS (SELECT DISTINCT h.s AS product, c.name FROM triples h JOIN triples t ON h.p = 'hasComponent' AND h.o = t.s JOIN checks c ON (c.name = 'refrigerant' AND t.p = 'usesRefrigerant') OR (c.name = 'lead' AND t.p = 'usesMaterial' AND t.o = 'LeadMaterial') OR (c.name = 'fabric or refrigerant' AND t.p IN ('usesFabric', 'usesRefrigerant')))
SELECT pr.product, checks.name AS "check", CASE WHEN hits.product IS NULL THEN 'no' ELSE 'yes' END AS answer FROM pr CROSS JOIN checks LEFT JOIN hits ON hits.product = pr.product AND hits.name = checks.name"""))
def ask_checks(spark, d):
    t = triples(spark, d)
    return K.ask_checks(t.filter("p = 'hasComponent'").select("s").distinct(), t, CHECKS)


SLOTS = {"brand": "brand", "material": "usesMaterial"}
view("recalled", "SELECT t.s AS product, CASE p WHEN 'brand' THEN 'brand' ELSE 'material' END AS slot, min(CASE WHEN o_is_literal THEN o ELSE coalesce(label, o) END) AS value FROM triples t LEFT JOIN named ON named.node = t.o WHERE p IN ('brand', 'usesMaterial') GROUP BY ALL", "named")


def recalled(spark, d):
    t = triples(spark, d)
    return K.recall_facts(t.filter("p = 'brand'").select("s").distinct(), t, SLOTS, K.labels(t)), K.labels(t)


@register("recall_facts", sql("SELECT * FROM recalled", "recalled"))
def recall_facts(spark, d):
    return recalled(spark, d)[0]


@register("fact_memories", sql("SELECT product, slot, coalesce(label, product) || ' ' || slot || ' is ' || value || '.' AS text FROM recalled LEFT JOIN named ON node = product", "recalled"))
def fact_memories(spark, d):
    return K.fact_memories(*recalled(spark, d))


@register("question_templates", sql("SELECT product, slot, replace(replace(t, '{name}', coalesce(label, product)), '{slot}', slot) AS query, value AS expected_contains FROM recalled LEFT JOIN named ON node = product, (SELECT unnest([" + ", ".join(f"'{t}'" for t in augmentation.TEMPLATES) + "]) AS t)", "recalled"))
def question_templates(spark, d):
    return K.question_templates(*recalled(spark, d), augmentation.TEMPLATES)


@register("kg_questions", sql("""
WITH inferred AS (SELECT s, o FROM closed WHERE p = 'type' EXCEPT SELECT s, o FROM triples WHERE p = 'type'),
q AS (SELECT t.s, CASE WHEN o_is_literal THEN 'recall' ELSE 'open' END AS type, 'What is the ' || p || ' of ' || coalesce(a.label, t.s) || '?' AS query, CASE WHEN o_is_literal THEN o ELSE coalesce(b.label, o) END AS gold FROM triples t LEFT JOIN named a ON a.node = t.s LEFT JOIN named b ON b.node = t.o WHERE p NOT IN ('label', 'type', 'sameAs')
UNION ALL SELECT i.s, 'logic', 'Is ' || coalesce(a.label, i.s) || ' a ' || coalesce(b.label, i.o) || '?', coalesce(b.label, i.o) FROM inferred i LEFT JOIN named a ON a.node = i.s LEFT JOIN named b ON b.node = i.o),
u AS (SELECT query, gold, type, min(s) AS s FROM q GROUP BY query, gold, type)
SELECT query, gold, type, s, 'kb.' || type || '.' || substr(sha1(query || '|' || gold), 1, 10) AS id FROM (SELECT *, row_number() OVER (PARTITION BY s, type ORDER BY query, gold) AS nth FROM u) WHERE nth <= 6""", "closed", "named"))
def kg_questions(spark, d):
    t = triples(spark, d)
    return K.kg_questions(t, K.closure(t))
