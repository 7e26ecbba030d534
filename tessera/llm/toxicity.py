"""Toxicity: a linear classifier over words and word beginnings, regularised by counterfactuals.

Fitting takes a bounded sample of labelled rows (at most `sample` of each label, those of least hash), counts in how many
documents of either label each hashed feature occurs, keeps the features whose log-odds differ clearly, and fits logistic
regression on the presence of these. Identity terms (`terms`, in sets within which one may stand for another) always stay
among the features. For every sampled document that names a group, the names are swapped for those of another group, and the
squared change of its score (on the logit scale) is added to the loss: what a document says about a group counts, that it
names one does not.

Scoring is one narrow stage over whole texts: the kept features of a run between white space are looked up in a worker's memo,
and a document's logit is the sum over its distinct features.

Cases: null and empty texts get the score of a document without features; null labels, labels without a document and
documents without a label are not learned from; repeated labels of a document count as toxic if any is, and of repeated
documents of one doc_id the least text is learned from; a null doc_id is scored and never learned from; without labelled rows
of both kinds every score is near 1 or 0, as the one kind has it, or near 0 if there are none; other columns are ignored by
`score` and kept by `drop_toxic`, whatever their names; a text of any length is one value of one block.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Memo, Recent, cut, id_and_text, slices

#: Labelled rows of each label that a model is fitted on, at most.
SAMPLE = 10_000
THRESHOLD = 0.3
#: Hashed features, and how many of them a model keeps.
SPACE = 1 << 20
FEATURES = 8192
#: Word beginnings of these lengths, from the first to the last, are features beside the words.
BEGINNINGS = (3, 6)
LEAST_Z = 4.0
L2 = 1e-3
#: Weight of the counterfactual penalty.
COUNTERFACTUAL = 1.0
STEPS = 300
BLOCK_BYTES = 4 << 20
MEMO_ENTRIES = 300_000
WORD = re.compile(r"[^\W\d_]+")

#: Names of groups, in sets within which one may stand for another.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("female", "male"),
    ("black", "white", "asian", "latino"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives"),
    ("immigrant", "refugee", "native"),
    ("african", "american", "european", "mexican", "chinese", "indian", "arab"),
    ("old", "young"),
    ("disabled", "deaf", "blind"),
)


def swaps(terms: Sequence[Sequence[str]]) -> dict[str, str]:
    """For each term the next of its set, which stands in for it."""
    return {term: group[(i + 1) % len(group)] for group in terms for i, term in enumerate(group)}


def word_hashes(word: str) -> list[int]:
    """Hashed features of a word: the word, and its beginnings, whose checksums go on from each other."""
    raw = [zlib.crc32(("=" + word).encode())]
    if len(word) >= BEGINNINGS[0]:
        raw.append(zlib.crc32(("^" + word[: BEGINNINGS[0]]).encode()))
        for c in word[BEGINNINGS[0] : BEGINNINGS[-1]]:
            raw.append(zlib.crc32(c.encode(), raw[-1]))
    return [(x ^ x >> 12) & (SPACE - 1) for x in raw]


def word_features(word: str) -> bytes:
    """`word_hashes` as little-endian 32-bit integers."""
    return array("I", word_hashes(word)).tobytes()


_WORDS = Memo(word_features, MEMO_ENTRIES)


def document_features(text: str, other: dict[str, str] | None = None) -> np.ndarray:
    """Distinct features of a text; with `other`, of the text with its words replaced by what they map to."""
    words = set(WORD.findall(text.lower()))
    if other:
        words = {other.get(w, w) for w in words}
    return np.unique(np.frombuffer(b"".join(map(_WORDS.__getitem__, words)), "<u4"))


@dataclass
class Model:
    """Weights of the kept features, ascending by feature, and a bias."""

    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -20.0

    def kept(self, found: np.ndarray) -> np.ndarray:
        """Places of those of `found` that the model keeps."""
        if not len(self.features):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
        return at[self.features[at] == found]


class Scorer:
    """Scores blocks of texts, with a memo of bounded size."""

    def __init__(self, model: Model):
        self.model, self.memo = model, Recent(MEMO_ENTRIES)
        self.places = {feature: i for i, feature in enumerate(model.features.tolist())}

    def __call__(self, texts: list[str]) -> list[float]:
        split = [set(t.split()) for t in texts]
        missing = self.memo.missing(set().union(*split))
        new = self.memo.new
        new.update(zip(missing, self._kept(missing), strict=True))
        weights, bias, get, logits = self.model.weights, self.model.bias, new.__getitem__, []
        for runs in split:
            found = np.frombuffer(b"".join(map(get, runs)), "<i4")
            logits.append(bias + float(weights[np.unique(found)].sum()) if len(found) else bias)
        return (1 / (1 + np.exp(-np.clip(logits, -30, 30)))).tolist()

    def _kept(self, runs: list[str]) -> list[bytes]:
        """Kept features of runs between white space (words don't cross white space), as little-endian 32-bit integers."""
        place, out = self.places.get, []
        for run in runs:
            found = [i for word in WORD.findall(run.lower()) for i in map(place, word_hashes(word)) if i is not None]
            out.append(array("i", found).tobytes() if found else b"")
        return out


def learnable(key: Column) -> Column:
    """Rows that a model may learn from: crc32 of the id's text is not 2 modulo 4."""
    return F.crc32(key.cast("string")) % 4 != 2


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """toxic and text of at most `sample` learnable rows of each label: those whose ids have the least hashes.

    The chosen ids are at most 2 * sample rows, so they are broadcast and the documents are not shuffled.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & learnable(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for kind in (0, 1)]
    rows = id_and_text(docs).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text")


def _feature_counts(rows: DataFrame) -> DataFrame:
    """Documents of either label that have a feature; counts leave each task as at most SPACE rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SPACE), np.int32)
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic, document_features(text)] += 1
        found = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[1, found].astype(np.int64)), pa.array(counts[0, found].astype(np.int64))], ["feature", "p", "q"])

    return rows.mapInArrow(run, "feature int, p long, q long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))


def _log_odds(p: Column, q: Column, n_p: int, n_q: int) -> Column:
    odds = F.log((p + 0.5) / (F.lit(n_p) - p + 0.5)) - F.log((q + 0.5) / (F.lit(n_q) - q + 0.5))
    return F.abs(odds) / F.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))


def _kept_features(rows: DataFrame, model: Model, other: dict[str, str]) -> DataFrame:
    """The kept features of each sampled document, plain and with names of groups swapped (null if it names none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            plain = [model.kept(document_features(x)).tolist() for x in texts]
            swapped = [model.kept(document_features(x, other)).tolist() if other.keys() & set(WORD.findall(x.lower())) else None for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plain, pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.int32()))], ["toxic", "plain", "swapped"])

    return rows.mapInArrow(run, "toxic int, plain array<int>, swapped array<int>")


class _Rows:
    """Sparse 0/1 rows: products with weights, and their transpose."""

    def __init__(self, lists: list[list[int]], width: int):
        self.n, self.width = len(lists), width
        self.row = np.repeat(np.arange(self.n), [len(x) for x in lists])
        self.col = np.array([j for x in lists for j in x], np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n) if len(self.col) else np.zeros(self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=r[self.row], minlength=self.width) if len(self.col) else np.zeros(self.width)


def fit_weights(plain: list[list[int]], swapped: list[list[int] | None], toxic: np.ndarray, width: int, counterfactual: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise log loss + L2 + counterfactual * mean squared logit change (Adam, full batches)."""
    x = _Rows(plain, width)
    named = [i for i, s in enumerate(swapped) if s is not None]
    a, b = _Rows([plain[i] for i in named], width), _Rows([swapped[i] for i in named], width)
    w, bias = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        wrong = 1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -30, 30))) - toxic
        g = x.back(wrong) / x.n + L2 * w
        if named:
            change = a.dot(w) - b.dot(w)
            g += 2 * counterfactual * (a.back(change) - b.back(change)) / len(named)
        g = np.append(g, wrong.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, counterfactual: float = COUNTERFACTUAL, terms: Sequence[Sequence[str]] = IDENTITY_TERMS) -> Model:
    """A model of the learnable rows. What reaches the driver is bounded by `sample` and FEATURES.

    terms: names of groups, in lower case, in sets within which one may stand for another; counterfactual: the penalty's weight.
    """
    other = swaps(terms)
    rows = cut(labelled_sample(docs, labels, sample), "toxicity-sample")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_p, n_q = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_q:
        return Model(bias=20.0 if n_p else -20.0)
    named = sorted({int(i) for t in other for i in np.frombuffer(word_features(t)[:4], "<u4")})
    scored = _feature_counts(rows).withColumn("z", _log_odds(F.col("p"), F.col("q"), n_p, n_q))
    clear = scored.filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(FEATURES).select("feature")
    features = np.array(sorted({r["feature"] for r in clear.collect()} | set(named)), np.uint32)
    model = Model(features, np.zeros(len(features)), 0.0)
    kept = _kept_features(rows, model, other).toPandas()
    none = lambda x: x is None or isinstance(x, float)
    order = sorted(range(len(kept)), key=lambda i: (kept["toxic"][i], list(kept["plain"][i])))  # the sums don't depend on the order of rows
    plain = [list(kept["plain"][i]) for i in order]
    swapped = [None if none(kept["swapped"][i]) else list(kept["swapped"][i]) for i in order]
    weights, bias = fit_weights(plain, swapped, kept["toxic"].to_numpy()[order].astype(float), len(features), counterfactual)
    return Model(features, weights, bias)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every text."""
    scored = score_texts(id_and_text(docs), model)
    return scored.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of rows of doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scorer(model)
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                scores = of([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """The rows of `docs` whose text scores below `threshold`, with the columns of `docs`; the model is fitted if none is given."""
    place = docs.columns.index("text")
    model = model or fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scorer(model)
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                scores = of([x or "" for x in part.column(place).cast(pa.string()).to_pylist()])
                yield part.filter(pa.array(np.asarray(scores) < threshold))

    return docs.mapInArrow(run, docs.schema)
