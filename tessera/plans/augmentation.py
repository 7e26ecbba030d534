"""SQL twins of word swaps and noise, for any table of id and query, and the word lists of the registered queries."""

from collections.abc import Mapping, Sequence

#: Words that stand for each other, noise, phrases and trails of the registered queries; the operators take whatever a caller gives.
POOL = {"brand": ["make", "maker"], "which": ["what", "whose"], "type": ["kind", "sort", "class"], "ring": ["hoop"], "bolt": ["pin", "rod"], "small": ["tiny", "little"]}
NOISE = ("oh", "well", "say", "so to speak")
PHRASES = (("What is", ("Tell me", "Name")), ("brand of", ("maker of", "firm behind", "make of")), ("?", ("?", " ?", "??")))
TRAILS = ("", "", " Thanks.", " (short answer)")
TEMPLATES = ("What is the {slot} of {name}?", "For {name}, what is the {slot}?", "{name} — state the {slot}.", "Please provide the {slot} for {name}.")


def draw(seed: str) -> str:
    """The number that the operators draw by md5 of `seed`."""
    return f"('0x' || substr(md5({seed}), 1, 8))::BIGINT"


def swapped(source: str, pool: Mapping[str, Sequence[str]], intensities: Sequence[int] = (1, 2)) -> str:
    """id, intensity and query, with up to `intensity` words of the pool swapped."""
    options = "MAP {" + ", ".join(f"{k!r}: {list(v)!r}" for k, v in pool.items()) + "}"
    seed = "CAST(id AS VARCHAR) || '|' || CAST(i - 1 AS VARCHAR)"
    words = f"SELECT id, w[i] AS w, i, list_contains({list(pool)!r}, lower(w[i])) AS known FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT id, string_split(query, ' ') AS w FROM {source}))"
    chosen = f"SELECT *, options[CAST({draw(seed)} % len(options) AS BIGINT) + 1] AS choice FROM (SELECT *, sum(CASE WHEN known THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS nth, ({options})[lower(w)] AS options FROM ({words}))"
    return f"""SELECT id, intensity, string_agg(CASE WHEN known AND nth <= intensity THEN CASE WHEN regexp_matches(w, '^[A-Z]') THEN upper(substr(choice, 1, 1)) || substr(choice, 2) ELSE choice END ELSE w END, ' ' ORDER BY i) AS query
FROM ({chosen}), (SELECT unnest({list(intensities)}) AS intensity) GROUP BY id, intensity"""


def noised(source: str, pool: Sequence[str], n: int) -> str:
    """id, intensity and query, with n words of the pool inserted."""
    rows = f"(SELECT id, string_split(query, ' ') AS w FROM {source})"
    for k in range(n):
        place, word = (draw(f"CAST(id AS VARCHAR) || '|{c}{k}'") for c in "pw")
        rows = f"""(SELECT id, list_concat(w[1:spot], [word], w[spot + 1:]) AS w FROM (
  SELECT id, w, CAST({place} % (len(w) + 1) AS BIGINT) AS spot, ({list(pool)!r})[CAST({word} % {len(pool)} AS BIGINT) + 1] AS word FROM {rows}))"""
    return f"SELECT id, {n} AS intensity, array_to_string(w, ' ') AS query FROM {rows}"


def paraphrased(source: str, variants: int, phrases: Sequence[tuple[str, Sequence[str]]], trails: Sequence[str]) -> str:
    """id, variant and query, with phrases replaced and a trail added."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    pick = lambda options, k: f"([{', '.join(map(quote, options))}])[CAST({draw(f'seed || {quote(chr(124) + k)}')} % {len(options)} AS BIGINT) + 1]"
    out = "query"
    for k, (phrase, options) in enumerate(phrases):
        out = f"replace({out}, {quote(phrase)}, {pick(options, f'r{k}')})"
    seeded = f"SELECT id, query, variant, CAST(id AS VARCHAR) || '#' || CAST(variant AS VARCHAR) AS seed FROM {source}, (SELECT unnest(range(1, {variants + 1})) AS variant)"
    return f"SELECT id, variant, {out} || {pick(trails, 't')} AS query FROM ({seeded})"
