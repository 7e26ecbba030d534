"""Text and dataset operators: normal forms, chunks, mined labels and numbers, splits, ids and augmentations.

All are column expressions. Choices that a single-process program would draw at random are keyed by md5, so results don't
depend on partitioning; regular expressions use explicit classes, so other engines read them alike.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal(c: Column) -> Column:
    """Lower case, white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\r]+", " "))


def canonical(c: Column) -> Column:
    """`normal` with punctuation as blanks."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def hash_split(key: Column, dev: float = 0.3) -> Column:
    """dev or test by the first 32 bits of md5(key)."""
    return F.when(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967295.0 < dev, "dev").otherwise("test")


def hash_id(*parts: Column) -> Column:
    """First ten digits of the sha1 of the parts, joined by |."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 10)


def snippet(c: Column, n: int = 220) -> Column:
    """The first n characters of a trimmed text, with an ellipsis if there are more."""
    t = F.trim(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def local_name(iri: Column) -> Column:
    """The part of an IRI after its last # or /."""
    return F.regexp_extract(iri, r"([^#/]*)$", 1)


def chunk_paragraphs(text: Column, least: int = 600, most: int = 1200, separator: str = "\n\n") -> Column:
    """Paragraphs merged greedily: a chunk is given out when the next paragraph doesn't fit and it is long enough."""
    pieces = F.filter(F.transform(F.split(text, separator), lambda p: F.trim(p)), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def merge(acc: Column, p: Column) -> Column:
        out, cur = acc["out"], acc["cur"]
        joined = F.concat(cur, F.lit(separator), p)
        fits = F.length(cur) + len(separator) + F.length(p) <= most
        emit = ~fits & (F.length(cur) >= least)
        new_out = F.when((cur != "") & emit, F.concat(out, F.array(cur))).otherwise(out)
        new_cur = F.when((cur == "") | emit, p).otherwise(joined)
        return F.struct(new_out.alias("out"), new_cur.alias("cur"))

    return F.aggregate(pieces, start, merge, lambda acc: F.when(acc["cur"] != "", F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"]))


#: Separators between a label and its value (fixed values).
SEPARATORS = "[:=–—-]"


def extract_kv(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, label and value of `Label: value`, two-space and bulleted lines; once for each (lower label, value) of a key."""
    pattern = rf"^([A-Za-z][A-Za-z0-9_ /()%]*?) *{SEPARATORS} *([^ ].*)$"
    spaced = r"^([A-Za-z][A-Za-z0-9_ /()%-]*?) {2,}([^ ].*)$"
    # What one step finds is an element in the next, and not searched again wherever it is used; a label that is found isn't empty.
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line_no"), F.trim(x).alias("line")))
    bodies = F.transform(lines, lambda x: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), F.regexp_replace(x["line"], r"^[•*-] +", "").alias("body")))
    labels = F.transform(bodies, lambda x: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), x["body"].alias("body"), F.regexp_extract(x["body"], pattern, 1).alias("label")))
    pick = lambda x, g, one: F.when(x["label"] != "", one).otherwise(F.regexp_extract(x["line"], spaced, g))
    pairs = F.transform(labels, lambda x: F.struct(x["line_no"].alias("line_no"), F.trim(pick(x, 1, x["label"])).alias("label"), F.trim(pick(x, 2, F.regexp_extract(x["body"], pattern, 2))).alias("value")))
    found = df.select(key, F.explode(pairs).alias("_x")).select(key, "_x.line_no", "_x.label", "_x.value").filter("label <> '' and value <> ''")
    first = found.groupBy(key, F.lower("label").alias("k"), "value").agg(F.min_by("label", "line_no").alias("label"), F.min("line_no").alias("line_no"))
    return first.select(key, "label", "value", "line_no")


#: Units of numeric facts (fixed values).
UNITS = "kWh|Wh|W|kW|V|mAh|Ah|A|°C|C|kg|g|mm|cm|m|%|ppm|bar|psi|years?|months?|days?"
NUMERIC = rf"(?i)\b[0-9]+(?:[.,][0-9]+)? ?(?:{UNITS})(?![A-Za-z0-9])"


def extract_numeric(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and value of each number with a unit, once each, with how often it occurs."""
    values = F.regexp_extract_all(F.col(text), F.lit(f"({NUMERIC})"), F.lit(1))
    return df.select(key, F.explode(values).alias("value")).groupBy(key, "value").agg(F.count("*").alias("n"))


def numeric_contexts(df: DataFrame, key: str, text: str, width: int = 40) -> DataFrame:
    """key, value, start (from 0) and context of each number with a unit: the text from `width` characters before to as many after."""
    found = df.select(key, F.col(text).alias("_t"), F.regexp_extract_all(F.col(text), F.lit(f"({NUMERIC})"), F.lit(1)).alias("_v"), F.split(text, NUMERIC).alias("_p"))
    size = lambda column, k: F.aggregate(F.slice(column, 1, k), F.lit(0), lambda a, x: a + F.length(x))
    places = F.transform("_v", lambda v, k: F.struct(v.alias("value"), (size("_p", k + 1) + size("_v", k)).alias("start")))
    one = found.filter(F.size("_v") > 0).select(key, "_t", F.explode(places).alias("_x")).select(key, "_t", "_x.value", "_x.start")
    begin = F.greatest(F.lit(0), F.col("start") - width)
    context = F.substring("_t", begin + 1, F.col("start") + F.length("value") + width - begin)
    return one.select(key, "value", "start", context.alias("context"))


def extract_title(text: Column) -> Column:
    """What follows an em dash on the first line, up to a bracket; null unless 3 to 80 characters."""
    value = F.trim(F.regexp_extract(F.substring_index(text, "\n", 1), "— *([^(]{3,80})", 1))
    return F.when(F.length(value).between(3, 80), value)


def numbers_shifted(text: Column, shift: int) -> Column:
    """Standalone integers moved by `shift`, not below 0. Runs of word characters and of others alternate."""
    pieces = F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(1))
    moved = lambda p: F.greatest(F.lit(0).cast("decimal(38,0)"), p.cast("decimal(37,0)") + shift).cast("string")
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[0-9]+$"), moved(p)).otherwise(p)), "")


def _draw(n: int, *parts: Column) -> Column:
    """A number from 0 to n - 1 by md5 of the parts."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long") % n).cast("int")


def synonyms_swapped(key: Column, text: Column, most: int, pool: Mapping[str, Sequence[str]]) -> Column:
    """Up to `most` words of the pool, from the left, replaced by one of their synonyms; a capital stays. Blanks are kept."""
    names = list(pool)
    table = F.create_map(*[x for w in names for x in (F.lit(w), F.array(*map(F.lit, pool[w])))])
    is_known = lambda w: F.lower(w).isin(names)

    def one(words: Column, w: Column, i: Column) -> Column:
        options = F.element_at(table, F.lower(w))
        place = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", key, i.cast("string"))), 1, 8), 16, 10).cast("long"), F.size(options).cast("long")).cast("int")
        choice = F.get(options, place)
        before = F.size(F.filter(F.slice(words, F.lit(1), i), is_known))
        capital = F.concat(F.upper(F.substring(choice, 1, 1)), F.substring(choice, 2, 1000))
        return F.when(is_known(w) & (before < most), F.when(w.rlike("^[A-Z]"), capital).otherwise(choice)).otherwise(w)

    # Words are held as the only element of an array, or else the text would be split again for each word.
    return F.get(F.transform(F.array(F.split(text, " ")), lambda ws: F.array_join(F.transform(ws, lambda w, i: one(ws, w, i)), " ")), F.lit(0))


def noise_inserted(key: Column, text: Column, n: int, pool: Sequence[str]) -> Column:
    """n words of the pool inserted at places that md5 of the key chooses."""
    out = F.split(text, " ")
    for k in range(n):
        place = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", key, F.lit(f"p{k}"))), 1, 8), 16, 10).cast("long"), (F.size(out) + 1).cast("long")).cast("int")
        word = F.get(F.array(*map(F.lit, pool)), _draw(len(pool), key, F.lit(f"w{k}")))
        out = F.concat(F.slice(out, F.lit(1), place), F.array(word), F.slice(out, place + 1, F.greatest(F.lit(0), F.size(out) - place)))
    return F.array_join(out, " ")


def augment_grid(df: DataFrame, key: str, text: str, pool: Mapping[str, Sequence[str]], noise: Sequence[str], intensities: Sequence[int] = (1, 2)) -> DataFrame:
    """Every query in every kind and intensity; ids {id}_{kind}{n}, and the query's own as base. The grid is a literal of at most a dozen cells."""
    cells = []
    for n in intensities:
        made = {"synswap": synonyms_swapped(F.col(key), F.col(text), n, pool), "noise": noise_inserted(F.col(key), F.col(text), n, noise), "num+": numbers_shifted(F.col(text), n), "num-": numbers_shifted(F.col(text), -n)}
        cells += [F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("intensity"), q.alias("query")) for kind, q in made.items()]
    grid = df.select(F.col(key).alias("base"), F.explode(F.array(*cells)).alias("c"))
    return grid.select(F.concat("base", F.lit("_"), "c.kind", F.col("c.intensity").cast("string")).alias("id"), "base", "c.kind", "c.intensity", "c.query")


def paraphrases(df: DataFrame, key: str, text: str, n: int, phrases: Sequence[tuple[str, Sequence[str]]], trails: Sequence[str]) -> DataFrame:
    """n variants of each question: phrases replaced and a trail added, as md5 of (key, variant) chooses."""
    variants = df.select(F.col(key).alias("id"), F.col(text).alias("query"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("variant"))
    out, seed = F.col("query"), F.concat_ws("#", "id", F.col("variant").cast("string"))
    for k, (phrase, options) in enumerate(phrases):
        chosen = F.get(F.array(*map(F.lit, options)), _draw(len(options), seed, F.lit(f"r{k}")))
        out = F.replace(out, F.lit(phrase), chosen)
    trail = F.get(F.array(*map(F.lit, trails)), _draw(len(trails), seed, F.lit("t")))
    return variants.select("id", "variant", F.concat(out, trail).alias("query"))


def contrastive_negatives(df: DataFrame, key: str = "id") -> DataFrame:
    """`df` with a second row for each recall or open item, flagged contrastive, with an id from neg| and its own id."""
    base = df.withColumn("contrastive", F.lit(False))
    other = df.filter(F.col("type").isin("recall", "open")).withColumn(key, F.concat(F.lit("neg-"), hash_id(F.lit("neg"), F.col(key)))).withColumn("contrastive", F.lit(True))
    return base.unionByName(other)
