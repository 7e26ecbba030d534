"""Canonical rows and scores: aliases of columns, defaults, repairs, validation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.text import canonical, normal

TYPES = ("recall", "logic", "open")


def first_filled(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of the columns that exist whose value isn't blank, as text."""
    found = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in names if c in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def canonical_passages(df: DataFrame) -> DataFrame:
    """pid, text, doc_id, title and domain from rows in any accepted form; rows without id or text are dropped."""
    out = df.select(
        first_filled(df, ["id", "pid", "passage_id"]).alias("pid"), first_filled(df, ["text", "content", "body"]).alias("text"),
        F.coalesce(first_filled(df, ["doc_id", "docId"]), F.lit("")).alias("doc_id"), F.coalesce(first_filled(df, ["title", "name"]), F.lit("")).alias("title"),
        F.coalesce(first_filled(df, ["domain"]), F.lit("")).alias("domain"),
    )
    return out.filter("pid is not null and text is not null")


def canonical_questions(df: DataFrame, position: str) -> tuple[DataFrame, DataFrame]:
    """Canonical questions, and the rows whose query is blank, for quarantine.

    Missing ids are {domain}_{position}; session s1; type open, in lower case; gold is the first filled of the known columns.
    """
    query = first_filled(df, ["query", "question"])
    rows = df.withColumn("_query", query)
    good = rows.filter("_query is not null")
    out = good.select(
        F.coalesce(first_filled(df, ["id"]), F.concat_ws("_", F.col("domain"), F.col(position).cast("string"))).alias("id"), F.col("_query").alias("query"), first_filled(df, ["product"]).alias("product"),
        F.coalesce(first_filled(df, ["session"]), F.lit("s1")).alias("session"), F.lower(F.coalesce(first_filled(df, ["type"]), F.lit("open"))).alias("type"), first_filled(df, ["expected_contains", "gold", "contains", "answer"]).alias("expected_contains"),
    )
    return out, rows.filter("_query is null").drop("_query")


def map_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """The first existing of each list of names under the canonical name; resolved from the schema, without a job."""
    picked = {to: next((c for c in names if c in df.columns), None) for to, names in aliases.items()}
    return df.select(*[F.col(c).alias(to) for to, c in picked.items() if c is not None])


def coerce_numeric(c: Column) -> Column:
    """A number from text: unreadable, infinite and not-a-number values are 0."""
    x = c.cast("string").try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def truthy(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("1", "true", "t", "yes", "y").cast("double")


CONFIDENCES = ("confidence", "prob", "p_correct", "router_conf", "score", "conf")


def choose_confidence(df: DataFrame) -> str | None:
    """The first of the confidence columns that has a numeric value, by one aggregate row."""
    names = [c for c in CONFIDENCES if c in df.columns]
    if not names:
        return None
    counts = df.agg(*[F.count(F.col(c).cast("string").try_cast("double")).alias(c) for c in names]).first()
    return next((c for c in names if counts[c]), None)


def score_recall(answer: Column, gold: Column, aliases: Column) -> Column:
    """The canonical answer equals, or holds, the canonical gold or one of its aliases."""
    said = canonical(answer)
    wanted = F.filter(F.transform(F.concat(F.array(gold), F.coalesce(aliases, F.array().cast("array<string>"))), lambda a: canonical(a)), lambda a: a != "")
    return F.coalesce(F.exists(wanted, lambda a: said.contains(a)), F.lit(False)).cast("int")


def score_open(answer: Column, span: Column) -> Column:
    return F.coalesce((normal(span) != "") & normal(answer).contains(normal(span)), F.lit(False)).cast("int")


def score_logic(answer: Column, label: Column) -> Column:
    said, want = normal(answer), normal(label)
    return F.coalesce((said == want) | said.startswith(F.concat(want, F.lit(" "))), F.lit(False)).cast("int")


def _score_yes_no(answer: Column, gold: Column, aliases: Column) -> Column:
    """Labels are compared only for yes and no, else the gold is looked for."""
    inside = F.coalesce((F.lower(gold) != "") & F.lower(answer).contains(F.lower(gold)), F.lit(False)).cast("int")
    return F.when(normal(gold).isin("yes", "no"), score_logic(answer, gold)).otherwise(inside)


Scorer = Callable[[Column, Column, Column], Column]
#: The scorer of each type of question, from answer, gold and aliases.
SCORERS: Mapping[str, Scorer] = {"recall": score_recall, "open": lambda answer, gold, aliases: score_open(answer, gold), "logic": _score_yes_no}


def score_success(kind: Column, answer: Column, gold: Column, aliases: Column, scorers: Mapping[str, Scorer] = SCORERS) -> Column:
    """By type, with the scorer that `scorers` has for it; types without one score 0."""
    out = F.lit(0)
    for name, scorer in scorers.items():
        out = F.when(kind == name, scorer(answer, gold, aliases)).otherwise(out)
    return out


def repair_success(success: Column, answer: Column, expected: Column) -> Column:
    """A readable number stays; else all of the expected tokens must be in the answer; without any 0."""
    given = success.cast("string").try_cast("double")
    tokens = F.filter(F.split(F.lower(expected), ";"), lambda t: F.trim(t) != "")
    held = (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.lower(answer).contains(F.trim(t)))
    return F.coalesce(given, F.coalesce(held, F.lit(False)).cast("double")).cast("int")


def lint(df: DataFrame) -> DataFrame:
    """id and violation of each rule that a question breaks."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    rules = [F.when(blank("query"), "missing query"), F.when(blank("expected_contains"), "missing gold"), F.when(~F.coalesce(F.lower("type").isin(*TYPES), F.lit(False)), "unusual type"), F.when(blank("domain"), "missing domain")]
    return df.select("id", F.explode(F.array_compact(F.array(*rules))).alias("violation"))


def validate_json(df: DataFrame, text: str, key: str, schema: str, needed: Sequence[str]) -> DataFrame:
    """key, violation and fatal for lines: placeholders, unreadable JSON, missing keys (fatal). An object without keys is readable."""
    parsed = F.from_json(text, f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    bad = parsed.isNull() | parsed["_corrupt"].isNotNull()
    found = [F.when(F.col(text).contains("..."), F.struct(F.lit("placeholder").alias("v"), F.lit(False).alias("f"))), F.when(bad, F.struct(F.lit("invalid json").alias("v"), F.lit(True).alias("f")))]
    found += [F.when(~bad & parsed[c].isNull(), F.struct(F.lit(f"missing {c}").alias("v"), F.lit(True).alias("f"))) for c in needed]
    return df.select(key, F.explode(F.array_compact(F.array(*found))).alias("x")).select(key, F.col("x.v").alias("violation"), F.col("x.f").alias("fatal"))


def normalize_ids(df: DataFrame, position: str) -> DataFrame:
    """Missing and repeated ids become {domain}_{type[:3]}_{seq:05d}, in order of position within domain and type."""
    nth = F.row_number().over(Window.partitionBy("id").orderBy(position))
    flagged = df.withColumn("_bad", F.col("id").isNull() | (F.trim("id") == "") | (nth > 1))
    good, bad = flagged.filter(~F.col("_bad")), flagged.filter("_bad")
    seq = F.row_number().over(Window.partitionBy("domain", "type").orderBy(position))
    renamed = bad.withColumn("id", F.concat("domain", F.lit("_"), F.substring("type", 1, 3), F.lit("_"), F.lpad(seq.cast("string"), 5, "0")))
    return good.unionByName(renamed).drop("_bad")


def repair_questions(df: DataFrame, position: str) -> DataFrame:
    """Rows with status kept, repaired or dropped: query from q, gold from span, value or alias, type from whether it has a
    digit, ids docfix-{domain}-{position}."""
    query, gold = first_filled(df, ["query", "q"]), first_filled(df, ["expected_contains", "span", "value", "alias"])
    whole = F.coalesce(F.trim(df["query"]) != "", F.lit(False)) & F.coalesce(F.trim(df["expected_contains"]) != "", F.lit(False))
    status = F.when(whole, "kept").when(query.isNotNull() & gold.isNotNull(), "repaired").otherwise("dropped")
    kind = F.coalesce(F.lower(df["type"]), F.when(gold.rlike("[0-9]"), "recall").otherwise("open"))
    ident = F.coalesce(df["id"], F.concat(F.lit("docfix-"), df["domain"], F.lit("-"), df[position].cast("string")))
    return df.select(ident.alias("id"), query.alias("query"), gold.alias("expected_contains"), kind.alias("type"), status.alias("status"))


def novel_items(candidates: DataFrame, present: DataFrame, key: str, order: str) -> DataFrame:
    """Candidates whose normal query isn't present; the first of each."""
    from tessera.operators.runs import dedup_keep_first

    new = candidates.withColumn("_k", normal(F.col(key))).join(present.select(normal(F.col(key)).alias("_k")), "_k", "left_anti")
    return dedup_keep_first(new, ["_k"], [order]).drop("_k")


def corpus_qc(df: DataFrame, text: str = "text", short: int = 40) -> DataFrame:
    """Rows, distinct texts, empty, short and repeated ones."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    q = df.agg(F.count("*").alias("n"), F.countDistinct(t).alias("n_distinct"), F.count_if(t == "").alias("n_empty"), F.count_if((F.length(t) > 0) & (F.length(t) < short)).alias("n_short"))
    return q.withColumn("n_duplicate", F.col("n") - F.col("n_distinct"))
