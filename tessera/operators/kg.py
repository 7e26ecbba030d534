"""Rules over a triples table: closure, compliance rules as joins, answers and mined questions.

triples: s, p, o, o_is_literal. Instance triples are large and are joined by key; schema triples (classes, properties) are
small, and the closure over them is what loops run on.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.text import local_name
from tessera.sources.shared import written

TYPE, SUBCLASS, SUBPROPERTY, DOMAIN, RANGE, LABEL, SAME = ("type", "subClassOf", "subPropertyOf", "domain", "range", "label", "sameAs")


def transitive(edges: DataFrame, name: str) -> DataFrame:
    """(a, b) of every path of edges a -> b, by doubling: each round joins paths to paths, so a chain of n edges takes log2(n) rounds."""
    pairs = written(edges.select("a", "b").filter("a <> b").distinct(), name)
    n = pairs.count()
    while True:
        longer = pairs.join(pairs.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).filter("a <> b")
        pairs = written(pairs.unionByName(longer).distinct(), name)
        grown = pairs.count()
        if grown == n:
            return pairs
        n = grown


def closure(triples: DataFrame) -> DataFrame:
    """The RDFS subset: subClassOf and subPropertyOf chains, their instances, and types from domain and range."""
    pairs = lambda p: triples.filter(F.col("p") == p).select(F.col("s").alias("a"), F.col("o").alias("b"))
    classes, properties = transitive(pairs(SUBCLASS), "classes"), transitive(pairs(SUBPROPERTY), "properties")
    triple = lambda df, s, p, o, lit=F.lit(False): df.select(s.alias("s"), p.alias("p"), o.alias("o"), lit.alias("o_is_literal"))
    c = F.col
    schema = triple(classes, c("a"), F.lit(SUBCLASS), c("b")).unionByName(triple(properties, c("a"), F.lit(SUBPROPERTY), c("b")))
    facts = written(triples.select("s", "p", "o", "o_is_literal").unionByName(triple(triples.join(properties, c("p") == c("a")), c("s"), c("b"), c("o"), c("o_is_literal"))), "facts")
    # Written, schema triples have a size that Spark knows: they are broadcast, and no task gets all triples of one predicate.
    domains, ranges = written(pairs(DOMAIN), "domains"), written(pairs(RANGE), "ranges")
    by_domain = triple(facts.join(domains, c("p") == c("a")), c("s"), F.lit(TYPE), c("b"))
    by_range = triple(facts.filter(~c("o_is_literal")).join(ranges, c("p") == c("a")), c("o"), F.lit(TYPE), c("b"))
    types = written(facts.filter(c("p") == TYPE).unionByName(by_domain).unionByName(by_range).distinct(), "types")
    lifted = triple(types.join(classes, c("o") == c("a")), c("s"), F.lit(TYPE), c("b"))
    return facts.unionByName(schema).unionByName(types).unionByName(lifted).distinct()


@dataclass(frozen=True)
class Rule:
    """If product p hasComponent c, and c has (predicate, object; None: any), then p gets the heads.

    via_type: the object of `predicate` must itself be of this type. unless: head (p, o) isn't added where p has this triple.
    """

    name: str
    predicate: str
    object: str | None
    heads: tuple[tuple[str, str], ...]
    via_type: str | None = None
    unless: tuple[str, str] | None = None


COMPLIANCE, STEP = "requiresCompliance", "requiresStep"


def _rule(name: str, predicate: str, obj: str | None, *heads: tuple[str, str], via: str | None = None, unless: tuple[str, str] | None = None) -> Rule:
    return Rule(name, predicate, obj, heads, via, unless)


#: What each domain's rules require (fixed values).
RULES: dict[str, tuple[Rule, ...]] = {
    "battery": (
        _rule("battery_safety", TYPE, "Battery", (COMPLIANCE, "BatterySafetyStandard")),
        _rule("battery_step", TYPE, "Battery", (STEP, "BatteryTestStep"), unless=("hasStep", "BatteryTestStep")),
        _rule("wireless_compliance", TYPE, "WirelessModule", (COMPLIANCE, "WirelessComplianceStandard")),
        _rule("wireless_step", TYPE, "WirelessModule", (STEP, "WirelessTestStep"), unless=("hasStep", "WirelessTestStep")),
        _rule("lead_rohs", "usesMaterial", "LeadMaterial", (COMPLIANCE, "RoHSStandard")),
    ),
    "textiles": (
        _rule("care_label", "usesFabric", None, (COMPLIANCE, "CareLabelStandard"), via="Fabric"),
        _rule("wool_care", "usesFabric", None, (COMPLIANCE, "WoolCareStandard"), via="WoolFabric"),
        _rule("wool_wash", "usesFabric", None, (STEP, "WoolWashTest"), via="WoolFabric", unless=(STEP, "WoolWashTest")),
        _rule("label_check", "usesFabric", None, (STEP, "LabelCheckStep"), unless=(STEP, "LabelCheckStep")),
    ),
    "hvac": (
        _rule("refrigerant_fgas", "usesRefrigerant", None, (COMPLIANCE, "FGasStandard")),
        _rule("compressor_tests", TYPE, "Compressor", (STEP, "PressureTestStep"), (STEP, "LeakCheckStep")),
        _rule("electrical_safety", TYPE, "ElectricalModule", (COMPLIANCE, "ElectricalSafetyStandard"), (STEP, "ElectricalSafetyTest")),
        _rule("lead_rohs", "usesMaterial", "LeadMaterial", (COMPLIANCE, "RoHSStandard")),
        _rule("wireless", TYPE, "WirelessModule", (COMPLIANCE, "WirelessComplianceStandard"), (STEP, "WirelessTestStep")),
    ),
    "printer": (
        _rule("wireless", TYPE, "WirelessModule", (COMPLIANCE, "WirelessComplianceStandard"), (STEP, "WirelessTestStep")),
        _rule("head_quality", TYPE, "PrinterHead", (STEP, "PrintQualityTest")),
        _rule("toner_weee", TYPE, "TonerCartridge", (COMPLIANCE, "WEEEStandard"), (STEP, "LabelCheckStep")),
        _rule("board_emc", TYPE, "MainBoard", (COMPLIANCE, "EMCStandard"), (COMPLIANCE, "Safety62368")),
        _rule("lead_rohs", "usesMaterial", "LeadMaterial", (COMPLIANCE, "RoHSStandard")),
    ),
}


def fire(triples: DataFrame, rule: Rule) -> DataFrame:
    """s, p, o and rule of the triples that a rule adds to `triples` (which may hold them already)."""
    c = F.col
    part = triples.filter(c("p") == "hasComponent").select(c("s").alias("product"), c("o").alias("component"))
    wanted = triples.filter(c("p") == rule.predicate)
    if rule.object is not None:
        wanted = wanted.filter(c("o") == rule.object)
    wanted = wanted.select(c("s").alias("component"), c("o").alias("value"))
    if rule.via_type is not None:
        typed = triples.filter((c("p") == TYPE) & (c("o") == rule.via_type)).select(c("s").alias("value"))
        wanted = wanted.join(typed, "value", "left_semi")
    products = part.join(wanted.select("component").distinct(), "component", "left_semi").select("product").distinct()
    if rule.unless is not None:
        has = triples.filter((c("p") == rule.unless[0]) & (c("o") == rule.unless[1])).select(c("s").alias("product"))
        products = products.join(has, "product", "left_anti")
    heads = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(o).alias("o")) for p, o in rule.heads]))
    return products.select(c("product").alias("s"), heads.alias("h")).select("s", "h.p", "h.o", F.lit(rule.name).alias("rule"))


def reads(rule: Rule, heads: Sequence[tuple[str, str]]) -> bool:
    """Whether heads may be triples that the rule's body or its `unless` looks for."""
    bodies = {rule.predicate, "hasComponent"} | ({TYPE} if rule.via_type is not None else set())
    return rule.unless in heads or any(p in bodies for p, _ in heads)


def _in_order(base: DataFrame, rules: Sequence[Rule], fired) -> DataFrame | None:
    """The union of fired(seen, rule) of all rules, in order, where `seen` is the base with what the rule may read of earlier ones.

    What a later rule reads is written once, so that chains of rules are read, not nested into each other's plans.
    """
    legs: list[tuple[Rule, DataFrame]] = []
    for k, rule in enumerate(rules):
        seen = base
        for earlier, leg in legs:
            if reads(rule, earlier.heads):
                seen = seen.unionByName(leg.select(*base.columns))
        new = fired(seen, rule)
        legs.append((rule, written(new, "heads") if any(reads(later, rule.heads) for later in rules[k + 1 :]) else new))
    out = None
    for _, leg in legs:
        out = leg if out is None else out.unionByName(leg)
    return out


def apply_rules(triples: DataFrame, rules: Sequence[Rule], disabled: Sequence[str] = ()) -> DataFrame:
    """s, p, o and rule of all triples that the rules add, in order and in one pass: later rules see what earlier ones added."""
    base = triples.select("s", "p", "o")
    added = _in_order(base, [rule for rule in rules if rule.name not in disabled], fire)
    if added is None:
        return base.limit(0).withColumn("rule", F.lit(""))
    known = base.filter(F.col("p").isin(*{p for rule in rules for p, _ in rule.heads}))
    return added.dropDuplicates(["s", "p", "o", "rule"]).join(known, ["s", "p", "o"], "left_anti")


#: Worlds that one pass may tell apart: bits of a positive long.
MOST_WORLDS = 62


def _fire_in_worlds(triples: DataFrame, rule: Rule, on: int) -> DataFrame:
    """As `fire`, over triples with `worlds`: in which worlds each head is added. on: worlds that have the rule."""
    c = F.col
    part = triples.filter(c("p") == "hasComponent").select(c("s").alias("product"), c("o").alias("component"), c("worlds").alias("wp"))
    wanted = triples.filter(c("p") == rule.predicate)
    if rule.object is not None:
        wanted = wanted.filter(c("o") == rule.object)
    wanted = wanted.select(c("s").alias("component"), c("o").alias("value"), c("worlds").alias("wc"))
    if rule.via_type is not None:
        typed = triples.filter((c("p") == TYPE) & (c("o") == rule.via_type)).groupBy(c("s").alias("value")).agg(F.bit_or("worlds").alias("wt"))
        wanted = wanted.join(typed, "value").withColumn("wc", c("wc").bitwiseAND(c("wt")))
    wanted = wanted.groupBy("component").agg(F.bit_or("wc").alias("wc"))
    products = part.join(wanted, "component").groupBy("product").agg(F.bit_or(c("wp").bitwiseAND(c("wc"))).alias("w")).withColumn("w", c("w").bitwiseAND(F.lit(on)))
    if rule.unless is not None:
        has = triples.filter((c("p") == rule.unless[0]) & (c("o") == rule.unless[1])).groupBy(c("s").alias("product")).agg(F.bit_or("worlds").alias("blocked"))
        products = products.join(has, "product", "left").withColumn("w", c("w").bitwiseAND(F.bitwise_not(F.coalesce("blocked", F.lit(0).cast("long")))))
    heads = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(o).alias("o")) for p, o in rule.heads]))
    return products.filter("w <> 0").select(c("product").alias("s"), heads.alias("h"), c("w").alias("worlds")).select("s", "h.p", "h.o", F.lit(rule.name).alias("rule"), "worlds")


def apply_rules_in_worlds(triples: DataFrame, rules: Sequence[Rule], disabled: Sequence[Sequence[str]]) -> DataFrame:
    """s, p, o, worlds of what the rules add, in one pass for many choices of rules: bit k is set where `apply_rules` with
    disabled=disabled[k] adds the triple.

    Each triple carries the worlds in which it holds: bodies intersect them, several derivations unite them, and an `unless`
    takes away those of the triple that it looks for, so that what a lost blocker sets free appears in just those worlds.
    """
    if len(disabled) > MOST_WORLDS:
        raise ValueError(f"at most {MOST_WORLDS} worlds a pass")
    everywhere = (1 << len(disabled)) - 1
    base = triples.select("s", "p", "o", F.lit(everywhere).cast("long").alias("worlds"))
    on = {rule.name: sum(1 << k for k, names in enumerate(disabled) if rule.name not in names) for rule in rules}
    rules = [rule for rule in rules if on[rule.name]]
    added = _in_order(base, rules, lambda seen, rule: _fire_in_worlds(seen, rule, on[rule.name]))
    if added is None:
        return base.limit(0)
    united = added.groupBy("s", "p", "o").agg(F.bit_or("worlds").alias("worlds"))
    known = triples.filter(F.col("p").isin(*{p for rule in rules for p, _ in rule.heads})).select("s", "p", "o")
    return united.join(known, ["s", "p", "o"], "left_anti")


def single_knockouts(rules: Sequence[Rule]) -> list[tuple[str, ...]]:
    """Worlds: all rules, then without each one."""
    return [(), *((rule.name,) for rule in rules)]


def rule_knockouts(triples: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rule, n (triples added with all rules) and n_without (without this one), by one pass."""
    worlds = apply_rules_in_worlds(triples, rules, single_knockouts(rules))
    bit = lambda k: F.sum(F.shiftright("worlds", k).bitwiseAND(F.lit(1).cast("long")))
    zero = F.lit(0).cast("long")
    counts = worlds.agg(*[F.coalesce(bit(k), zero).alias(f"n{k}") for k in range(len(rules) + 1)])
    rows = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col("n0").alias("n"), F.col(f"n{k}").alias("n_without")) for k, r in enumerate(rules, 1)]))
    return counts.select(rows.alias("r")).select("r.*")


def answers_in_worlds(added: DataFrame, n: int, domain_text: str = "standards") -> DataFrame:
    """product and answers: the symbolic answer in each of n worlds, null where nothing is required."""
    held = lambda p, k: F.sort_array(F.transform(F.filter("heads", lambda h: (h["p"] == p) & (F.shiftright(h["worlds"], k).bitwiseAND(F.lit(1).cast("long")) == 1)), lambda h: h["o"]))

    def answer(k: int) -> Column:
        stds, steps = held(COMPLIANCE, k), held(STEP, k)
        return F.nullif(F.concat_ws(" ", _standards(F.col("product"), stds, domain_text), _steps(steps)), F.lit(""))

    grouped = added.groupBy(F.col("s").alias("product")).agg(F.collect_list(F.struct("p", "o", "worlds")).alias("heads"))
    return grouped.select("product", F.array(*[answer(k) for k in range(n)]).alias("answers"))


def required(added: DataFrame) -> DataFrame:
    """product with sorted arrays of its required compliances and steps."""
    each = lambda p: F.sort_array(F.collect_set(F.when(F.col("p") == p, F.col("o"))))
    return added.groupBy(F.col("s").alias("product")).agg(each(COMPLIANCE).alias("compliances"), each(STEP).alias("steps"))


def labels(triples: DataFrame) -> DataFrame:
    """node and its label: the least, where there are several."""
    return triples.filter(F.col("p") == LABEL).groupBy(F.col("s").alias("node")).agg(F.min("o").alias("label"))


def with_label(df: DataFrame, column: str, named: DataFrame, to: str, literal: Column | None = None) -> DataFrame:
    """`df` with the label of a column's node, or the local name, or the value itself where it is literal."""
    other = named.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    value = F.coalesce("_label", local_name(F.col(column)))
    if literal is not None:
        value = F.when(literal, F.col(column)).otherwise(value)
    return df.join(other, F.col(column) == F.col("_node"), "left").withColumn(to, value).drop("_node", "_label")


def _standards(product: Column, compliances: Column, domain_text: str) -> Column:
    return F.when(F.size(compliances) > 0, F.concat(F.lit(f"Symbolic: {domain_text} for "), product, F.lit(": "), F.array_join(compliances, ", "), F.lit(".")))


def _steps(steps: Column) -> Column:
    return F.when(F.size(steps) > 0, F.concat(F.lit("Required steps: "), F.array_join(steps, ", "), F.lit(".")))


def answers(added: DataFrame, domain_text: str = "standards") -> DataFrame:
    """product, its symbolic answer, and the kinds of rules that fired."""
    r = required(added)
    stds, steps = _standards(F.col("product"), F.col("compliances"), domain_text), _steps(F.col("steps"))
    fired = F.array_compact(F.array(F.when(F.size("compliances") > 0, COMPLIANCE), F.when(F.size("steps") > 0, STEP)))
    return r.select("product", F.concat_ws(" ", stds, steps).alias("answer"), fired.alias("rules_fired"))


def facts(triples: DataFrame, literal: bool) -> DataFrame:
    """Triples with literal, or else node, objects that state something: no labels, types or identities."""
    return triples.filter((F.col("o_is_literal") == literal) & ~F.col("p").isin(LABEL, TYPE, SAME))


def inferred_types(base: DataFrame, closed: DataFrame) -> DataFrame:
    """Types of the closure that aren't asserted."""
    pick = lambda df: df.filter(F.col("p") == TYPE).select("s", "o").distinct()
    return pick(closed).join(pick(base), ["s", "o"], "left_anti")


def select_products(triples: DataFrame, cls: str) -> DataFrame:
    """Subjects of a class; without any, whatever has a label."""
    typed = triples.filter((F.col("p") == TYPE) & (F.col("o") == cls)).select("s").distinct()
    return triples.filter(F.col("p") == LABEL).select("s").distinct() if typed.isEmpty() else typed


def ask_checks(products: DataFrame, triples: DataFrame, checks: Sequence[tuple[str, Sequence[str], str | None]]) -> DataFrame:
    """product, check and answer (yes or no): has a component that any of the predicates links (to the object, if given)."""
    part = triples.filter("p = 'hasComponent'").select(F.col("s").alias("product"), F.col("o").alias("c"))
    links = triples.select(F.col("s").alias("c"), F.col("p").alias("lp"), F.col("o").alias("lo"))
    match = F.array_compact(F.array(*[F.when(F.col("lp").isin(*ps) & (F.lit(True) if o is None else F.col("lo") == o), F.lit(name)) for name, ps, o in checks]))
    hits = part.join(links.filter(F.col("lp").isin(*{p for _, ps, _ in checks for p in ps})), "c").select("product", F.explode(match).alias("check")).distinct().withColumn("hit", F.lit(True))
    grid = products.select(F.col("s").alias("product"), F.explode(F.array(*[F.lit(n) for n, _, _ in checks])).alias("check"))
    return grid.join(hits, ["product", "check"], "left").select("product", "check", F.when(F.col("hit"), "yes").otherwise("no").alias("answer"))


def recall_facts(products: DataFrame, triples: DataFrame, slots: dict[str, str], named: DataFrame) -> DataFrame:
    """product, slot and value: the least value of the slot's predicate, by label."""
    slot_of = F.create_map(*[F.lit(x) for slot, p in slots.items() for x in (p, slot)])
    own = triples.filter(F.col("p").isin(*slots.values())).join(products, "s", "left_semi")
    valued = with_label(own, "o", named, "value", F.col("o_is_literal"))
    return valued.groupBy(F.col("s").alias("product"), slot_of[F.col("p")].alias("slot")).agg(F.min("value").alias("value"))


def fact_memories(recalled: DataFrame, named: DataFrame) -> DataFrame:
    """One sentence for each fact."""
    named_rows = with_label(recalled, "product", named, "name")
    return named_rows.select("product", "slot", F.concat_ws(" ", "name", "slot", F.lit("is"), F.concat("value", F.lit("."))).alias("text"))


def question_templates(recalled: DataFrame, named: DataFrame, templates: Sequence[str]) -> DataFrame:
    """A question for each fact and template; {name} and {slot} are filled in."""
    rows = with_label(recalled, "product", named, "name").withColumn("t", F.explode(F.array(*map(F.lit, templates))))
    return rows.select("product", "slot", F.replace(F.replace("t", F.lit("{name}"), F.col("name")), F.lit("{slot}"), F.col("slot")).alias("query"), F.col("value").alias("expected_contains"))


def kg_questions(triples: DataFrame, closed: DataFrame, cap: int = 6) -> DataFrame:
    """Questions about literal and node facts and inferred types: at most `cap` a subject and type, no repeats, with ids."""
    from tessera.operators.runs import cap_per_group

    named = labels(triples)
    fact = triples.filter(~F.col("p").isin(LABEL, TYPE, SAME))
    fact = with_label(with_label(fact, "s", named, "sl"), "o", named, "gold", F.col("o_is_literal"))
    about = fact.select("s", F.when(F.col("o_is_literal"), "recall").otherwise("open").alias("type"), F.concat(F.lit("What is the "), local_name(F.col("p")), F.lit(" of "), "sl", F.lit("?")).alias("query"), F.col("gold"))
    typed = with_label(with_label(inferred_types(triples, closed), "s", named, "sl"), "o", named, "cl")
    logic = typed.select("s", F.lit("logic").alias("type"), F.concat(F.lit("Is "), "sl", F.lit(" a "), "cl", F.lit("?")).alias("query"), F.col("cl").alias("gold"))
    unique = about.unionByName(logic).groupBy("query", "gold", "type").agg(F.min("s").alias("s"))
    kept = cap_per_group(unique, ["s", "type"], ["query", "gold"], cap)
    return kept.withColumn("id", F.concat(F.lit("kb."), "type", F.lit("."), F.substring(F.sha1(F.concat_ws("|", "query", "gold")), 1, 10)))


def empty_triples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "s string, p string, o string, o_is_literal boolean")
