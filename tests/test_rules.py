"""Goldens of the rule engine and closure."""

from tessera.operators import kg as K


def triples(spark):
    rows = [
        ("ProductA", "hasComponent", "b1"), ("ProductA", "hasComponent", "w1"), ("ProductA", "hasComponent", "l1"), ("ProductB", "hasComponent", "l1"),
        ("ProductC", "hasComponent", "w1"), ("ProductC", "hasStep", "WirelessTestStep"), ("b1", "type", "Battery"), ("w1", "type", "WirelessModule"), ("l1", "usesMaterial", "LeadMaterial"),
    ]
    return spark.createDataFrame([(*r, False) for r in rows], "s string, p string, o string, o_is_literal boolean")


def test_products_need_what_the_goldens_say(spark):
    got = {r["product"]: (r["compliances"], r["steps"]) for r in K.required(K.apply_rules(triples(spark), K.RULES["battery"])).collect()}
    assert got == {
        "ProductA": (["BatterySafetyStandard", "RoHSStandard", "WirelessComplianceStandard"], ["BatteryTestStep", "WirelessTestStep"]),
        "ProductB": (["RoHSStandard"], []),
        "ProductC": (["WirelessComplianceStandard"], []),
    }


def test_answers(spark):
    got = {r["product"]: r["answer"] for r in K.answers(K.apply_rules(triples(spark), K.RULES["battery"])).collect()}
    assert got["ProductB"] == "Symbolic: standards for ProductB: RoHSStandard."
    assert got["ProductA"].endswith("Required steps: BatteryTestStep, WirelessTestStep.")


def test_rules_are_idempotent_and_can_be_disabled(spark):
    base = triples(spark)
    added = K.apply_rules(base, K.RULES["battery"])
    again = K.apply_rules(base.unionByName(added.selectExpr("s", "p", "o", "false AS o_is_literal")), K.RULES["battery"])
    assert again.count() == 0
    assert {r["rule"] for r in K.apply_rules(base, K.RULES["battery"], disabled=["lead_rohs"]).collect()}.isdisjoint({"lead_rohs"})
    assert K.apply_rules(base, []).count() == 0


def test_order_matters_where_a_rule_looks_for_an_earlier_head(spark):
    rows = [("p", "hasComponent", "c"), ("c", "usesFabric", "f"), ("f", "type", "WoolFabric")]
    t = spark.createDataFrame([(*r, False) for r in rows], "s string, p string, o string, o_is_literal boolean")
    assert {r["o"] for r in K.apply_rules(t, K.RULES["textiles"]).collect()} == {"WoolCareStandard", "WoolWashTest", "LabelCheckStep"}


def test_closure_of_chains_domains_and_ranges(spark):
    rows = [("a", "subClassOf", "b"), ("b", "subClassOf", "c"), ("c", "subClassOf", "a"), ("p", "subPropertyOf", "q"), ("q", "domain", "b"), ("q", "range", "r"), ("x", "p", "y")]
    t = spark.createDataFrame([(*r, False) for r in rows], "s string, p string, o string, o_is_literal boolean")
    got = {(r["s"], r["p"], r["o"]) for r in K.closure(t).collect()}
    assert {("a", "subClassOf", "c"), ("x", "q", "y"), ("x", "type", "b"), ("x", "type", "c"), ("y", "type", "r")} <= got
    assert K.closure(K.empty_triples(spark)).count() == 0
