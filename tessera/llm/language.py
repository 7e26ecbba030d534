"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

A model has, for each learned language, log probabilities of hashed character trigrams inside words and the scripts in which
the language is written. The score of a word under a language is the sum over its trigrams; languages that don't use the
word's script are out, unless none does. The best path through a text's words pays a penalty at each change of language, so
a stray word doesn't break a span while a passage in another language does. Many texts go through Viterbi in step, longest
first, one array operation for the k-th words of all that have one.

Counts for the model come from a bounded sample of labelled rows of each language (those of least hash).

Cases: null texts and texts without letters are `und` with score 0 and no span; rows with a null lang, a null doc_id or a
held-out id aren't learned from; without learned rows everything is `und`; languages are told apart at any number, one
included; a letter is a character of Unicode's category L, and marks continue a word; ties go to the language first in order; repeated rows get a row each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_and_text, slices

#: Labelled rows of each language that a model is counted on, about.
SAMPLE = 3_000
SPACE = 1 << 16
SMOOTHING = 0.5
#: Log-probability units that a change of language costs.
SWITCH = 12.0
#: A language uses a script that has at least this share of its letters.
SCRIPT_SHARE = 0.01
BLOCK_BYTES = 8 << 20
MEMO_WORDS = 600_000
#: A letter and the letters and marks that follow it.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UND = "und"

#: First code points of script ranges, ascending, and the script that begins there (fixed values).
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0E00, "thai"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0x20000, "han"),
)
SCRIPT_STARTS = np.array([s for s, _ in SCRIPTS])
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_CODES = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of words with a blank at either end: word index and trigram of each, and the words' scripts."""
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), "<u4").astype(np.uint64)
    mixed = points[:-2] * np.uint64(0x9E3779B185EBCA87) ^ points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ points[2:] * np.uint64(0x165667B19E3779F9)
    codes = (mixed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)
    blank = points == 32
    inner = ~blank[1:-1]
    owner = np.cumsum(blank[1:-1])
    first = points[np.flatnonzero(blank)[:-1] + 1]
    return owner[inner], codes[inner], SCRIPT_CODES[np.searchsorted(SCRIPT_STARTS, first, side="right") - 1]


@dataclass
class Model:
    """languages in order; logs: (SPACE, languages); uses: (scripts, languages) booleans."""

    languages: list[str]
    logs: np.ndarray
    uses: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words, languages) scores; minus infinity where a script rules a language out."""
        owner, codes, script = trigrams(words)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
        scores = np.add.reduceat(self.logs[codes], starts, axis=0)
        uses = self.uses[script]
        return np.where(uses | ~uses.any(1, keepdims=True), scores, np.float32(-np.inf))


def learnable(key: Column) -> Column:
    """Rows that a model may learn from: crc32 of the id's text is not 1 modulo 3."""
    return F.crc32(key.cast("string")) % 3 != 1


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of at most `sample` learnable rows for each language, counted where the rows are."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & learnable(F.col("doc_id")))
    counted = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    languages = sorted(r["lang"] for r in counted)
    if not languages:
        return Model([], np.zeros((SPACE, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool))
    # a hash below the quota's share keeps about `sample` rows of a language, wherever they are
    # (one row for each language, of which the model has a column of SPACE numbers)
    share = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], sample / r["n"]) for r in counted], "lang string, share double"))
    chosen = known.join(share, "lang").filter(F.abs(F.xxhash64("doc_id") % 1_000_000) < 1_000_000 * F.col("share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, scripts = np.zeros((len(languages), SPACE), np.int64), np.zeros((len(languages), len(SCRIPT_NAMES)), np.int64)
        place = {k: i for i, k in enumerate(languages)}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = WORD.findall(text.lower())
                if words:
                    _, codes, script = trigrams(words)
                    grams[place[lang]] += np.bincount(codes, minlength=SPACE)
                    scripts[place[lang]] += np.bincount(script, minlength=len(SCRIPT_NAMES))
        for kind, table in (("g", grams), ("s", scripts)):
            which, code = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(which), pa.string()), pa.array(which.astype(np.int32)), pa.array(code.astype(np.int32)), pa.array(table[which, code])], ["kind", "lang", "code", "n"])

    counts = chosen.select("lang", "text").mapInArrow(count, "kind string, lang int, code int, n long").groupBy("kind", "lang", "code").agg(F.sum("n").alias("n")).toPandas()
    grams, scripts = np.full((SPACE, len(languages)), SMOOTHING), np.zeros((len(SCRIPT_NAMES), len(languages)))
    for table, kind in ((grams, "g"), (scripts, "s")):
        part = counts[counts["kind"] == kind]
        table[part["code"], part["lang"]] += part["n"]
    logs = np.log(grams / grams.sum(0)).astype(np.float32)
    return Model(languages, logs, scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(0)))


class Labeller:
    """Labels the words of texts; word scores are kept in a memo."""

    def __init__(self, model: Model, switch: float):
        self.model, self.switch = model, np.float32(switch)
        self.places: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)), np.float32)

    def _places(self, words: list[str]) -> np.ndarray:
        if len(self.places) > MEMO_WORDS:
            self.places, self.scores = {}, self.scores[:0]
        missing = list(set(words) - self.places.keys())
        if missing:
            first = len(self.places)
            self.places.update(zip(missing, range(first, first + len(missing)), strict=True))
            self.scores = np.concatenate([self.scores, self.model.word_scores(missing)])
        return np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))

    def paths(self, texts: list[str]) -> list[np.ndarray]:
        """The language index of each word of each text."""
        split = [WORD.findall(t.lower()) for t in texts]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        places = self._places([w for words in split for w in words])
        begins = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        active = np.searchsorted(-lengths[order], -np.arange(1, int(lengths.max(initial=0)) + 1), side="right")
        best: np.ndarray | None = None
        came: list[np.ndarray] = []
        path = np.zeros(int(lengths.sum()), np.int32)
        final = np.zeros(len(split), np.int32)
        for k, n in enumerate(active.tolist()):
            now = self.scores[places[begins[order[:n]] + k]]
            if k:
                best = best[:n]
                top = best.argmax(1)
                change = np.take_along_axis(best, top[:, None], 1) - self.switch
                stay = best >= change
                came.append(np.where(stay, np.arange(best.shape[1], dtype=np.int32), top[:, None].astype(np.int32)))
                now = now + np.where(stay, best, change)
            best = now
            ends = active[k + 1] if k + 1 < len(active) else 0
            if ends < n:
                final[ends:n] = best[ends:n].argmax(1)
        state = final[:0]
        for k in range(len(active) - 1, -1, -1):
            n = int(active[k])
            state = np.concatenate([state, final[len(state) : n]])
            path[begins[order[:n]] + k] = state
            if k:
                state = came[k - 1][np.arange(n), state]
        return np.split(path, np.cumsum(lengths)[:-1])


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred (the language of most words), score (their share) and spans of every text.

    spans: array of first word, number of words and language, in order.
    """
    languages = model.languages
    span = pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model, switch)
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                texts = [x or "" for x in part.column(1).to_pylist()]
                paths = labeller.paths(texts) if languages else [np.zeros(0, np.int32)] * len(texts)
                names, scores, spans = [], [], []
                for path in paths:
                    if not len(path):
                        names.append(UND)
                        scores.append(0.0)
                        spans.append([])
                        continue
                    counts = np.bincount(path, minlength=len(languages))
                    top = int(counts.argmax())
                    names.append(languages[top])
                    scores.append(float(counts[top] / len(path)))
                    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
                    spans.append([{"first_word": a, "n_words": b - a, "lang": languages[path[a]]} for a, b in zip(cuts, cuts[1:], strict=False)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))], ["doc_id", "lang_pred", "score", "spans"])

    found = id_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<first_word:int,n_words:int,lang:string>>")
    return found.withColumn("held_out", ~learnable(F.col("doc_id")))
