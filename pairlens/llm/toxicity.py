"""Toxicity by maximum-scoring segments.

Each token scores its log-odds of toxic against clean labelled text under
Dirichlet priors (its own or a stem's, whichever is higher), drawn towards zero by how uncertain they are, less a drift that
makes clean text fall.  A linear scan (Ruzzo and Tompa) finds every maximal
segment of a document.  The best segment of clean documents, less the logarithm
of their length, follows an extreme-value law; fitted to labelled clean
documents it gives each passage its significance.  A logistic curve over the
significance of the two best passages and the number of significant ones turns
that into a probability.

Fitting reads at most ``MAX_LABELLED`` labelled documents, those whose id hashes
lowest.  The curve is fitted to each fold of them with the token counts of the
others, so it never sees a document's own counts; scoring uses all counts.  Counts live in ``BINS`` hashed bins, so the
model's size is fixed.  Scoring covers every text whole.

Defined results: null and empty texts have no passage and get the score of a
document without evidence.  An id that is labelled more than once counts as
toxic if any label says so; null ids or labels are not learned from.  With no
labels of either kind every score is 0.  Rows are scored one by one, so repeated
rows score alike; other columns are kept, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.llm.common import bounded_batches, by_value, durable, give_back, text_bytes

by_value(__name__)

MAX_LABELLED = 20_000
FOLDS = 5
BINS = 1 << 18
#: Strength of the Dirichlet prior in tokens; standard errors below which a token's log-odds count as nothing; the drift of a token; the highest score.
PRIOR, CAUTION, DRIFT, HIGHEST = 2_000.0, 3.0, 0.4, 5.0
#: Passages of at most this chance in clean text are significant.
CHANCE = 0.05
CACHED_WORDS = 200_000
#: Letters and digits, and all beyond ASCII: other bytes end a token.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b == 39 or b >= 128 else 32 for b in range(256))

PASSAGES = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField(
            "passages",
            T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("weight", T.DoubleType()), T.StructField("chance", T.DoubleType())])),
        ),
    ]
)


def tokens(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def bins_of(word: bytes) -> tuple[int, ...]:
    """Bins of a word and of its stems, its first three to six bytes."""
    return tuple(xxhash.xxh3_64_intdigest(x) % BINS for x in [word, *(b"^" + word[:k] for k in range(3, 7) if len(word) > k)])


class WordBins(dict):
    def __missing__(self, word: bytes) -> tuple[int, ...]:
        value = self[word] = bins_of(word)
        return value

    def count(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The bins of a text and how often each occurs."""
        if len(self) > CACHED_WORDS:
            self.clear()
        return np.unique(np.fromiter(chain.from_iterable(map(self.__getitem__, tokens(text))), np.int64), return_counts=True)


class WordScores(dict):
    """The score of a word: the best of its own and its stems'."""

    def __init__(self, table: np.ndarray):
        self.table = table

    def __missing__(self, word: bytes) -> float:
        value = self[word] = max(map(self.table.item, bins_of(word)))
        return value

    def of(self, text: bytes) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
        words = tokens(text)
        return np.fromiter(map(self.__getitem__, words), np.float64, len(words))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score), in linear time.

    A candidate keeps its cumulative sums before and after, and a link to the
    nearest candidate whose sum before is lower; only positive scores, often
    few, enter the loop.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    sums = np.r_[0.0, np.cumsum(scores)]
    starts: list[int] = []
    stops: list[int] = []
    before: list[float] = []
    after: list[float] = []
    links: list[int] = []
    for i, low, high in zip(at.tolist(), sums[at].tolist(), sums[at + 1].tolist()):
        start, stop = i, i + 1
        while True:
            j = len(starts) - 1
            while j >= 0 and before[j] >= low:
                j = links[j]
            if j < 0 or after[j] >= high:
                break
            start, low = starts[j], before[j]
            for held in (starts, stops, before, after, links):
                del held[j:]
        starts.append(start)
        stops.append(stop)
        before.append(low)
        after.append(high)
        links.append(j)
    return [(a, b, h - l) for a, b, l, h in zip(starts, stops, before, after)]


@dataclass(frozen=True)
class Model:
    """Scores of the bins; place and scale of the extreme-value law; the logistic curve."""

    table: np.ndarray
    place: float
    scale: float
    curve: tuple[float, ...]

    def chances(self, weights: np.ndarray, length: int) -> np.ndarray:
        """Chance that clean text of this length holds a passage of this weight."""
        x = (weights - math.log(length + 1.0) - self.place) / self.scale
        return -np.expm1(-np.exp(-np.clip(x, -30, 700)))

    def evidence(self, weights: np.ndarray, length: int) -> list[float]:
        """What the curve weighs: significance of the best and the second best passage, the number of significant passages."""
        if not len(weights):
            return [0.0, 0.0, 0.0]
        chance = self.chances(weights, length)
        best, second = (min(9.0, -math.log10(max(x, 1e-300))) for x in [*np.sort(chance)[:2].tolist(), 1.0][:2])
        return [best, second, math.log1p(float((chance <= CHANCE).sum()))]

    def score(self, evidence: list[float]) -> float:
        z = self.curve[0] + sum(a * b for a, b in zip(self.curve[1:], evidence))
        return 0.0 if z < -700 else 1.0 / (1.0 + math.exp(-z))


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, id_column: str, text: str, label: str, bound: int) -> DataFrame:
    """(id, text, toxic, fold) of at most ``bound`` labelled documents where ``learn`` holds."""
    ids = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(bound)  # bounded, hence broadcast
    rows = docs.where(learn).select(F.col(id_column).alias("id"), text_bytes(F.col(text)).alias("text"))
    return rows.join(F.broadcast(ids), "id").withColumn("fold", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(FOLDS)).cast("int"))


def bin_counts(sample: DataFrame) -> np.ndarray:
    """Tokens by fold of the sample, clean or toxic, and bin."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, sums = WordBins(), np.zeros((2 * FOLDS, BINS), np.int64)
        for batch in batches:
            for text, toxic, fold in zip(batch["text"], batch["toxic"], batch["fold"]):
                at, times = bins.count(text)
                sums[2 * fold + int(toxic > 0), at] += times
        at = np.flatnonzero(sums.sum(0))
        yield pd.DataFrame({"bin": at} | {c: sums[k, at] for k, c in enumerate(columns)})
        del bins, sums
        give_back()

    columns = [f"n{k}" for k in range(2 * FOLDS)]
    rows = sample.select("text", "toxic", "fold").mapInPandas(run, ", ".join(f"{c} long" for c in ["bin", *columns]))
    got = rows.groupBy("bin").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()  # BINS rows at most
    out = np.zeros((2 * FOLDS, BINS))
    out[:, got["bin"].to_numpy(np.int64)] = got[columns].to_numpy(np.float64).T
    return out.reshape(FOLDS, 2, BINS)


def token_table(counts: np.ndarray) -> np.ndarray:
    """The score of each bin from its clean and toxic counts."""
    totals = counts.sum(1)
    if not totals.all():
        return np.full(counts.shape[1], -DRIFT)
    prior = PRIOR * (counts.sum(0) + 0.5) / (totals.sum() + 0.5 * counts.shape[1])
    odds = [np.log((y + prior) / (n + PRIOR - y - prior)) for y, n in zip(counts, totals)]
    ratio = odds[1] - odds[0]
    # twice the log-likelihood ratio of the counts against equal shares: the square of how many standard errors the odds lie from zero
    means = [counts.sum(0) * n / totals.sum() for n in totals]
    with np.errstate(divide="ignore", invalid="ignore"):
        square = 2 * sum(np.where(y > 0, y * np.log(y / m), 0.0) for y, m in zip(counts, means))
    drawn = ratio * np.maximum(0, 1 - CAUTION**2 / np.maximum(square, 1e-9))
    return np.clip(drawn - DRIFT, -HIGHEST, HIGHEST)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, id_column: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = MAX_LABELLED) -> Model:
    """Learn from the labelled documents where ``learn`` holds, ``bound`` at most."""
    bounded_batches(docs.sparkSession)
    sample = durable(labelled_sample(docs, labels, learn, id_column, text, label, bound), "labelled")
    counts = bin_counts(sample)
    table = token_table(counts.sum(0))
    other = [token_table(counts.sum(0) - own) for own in counts]  # for each fold, what the others have taught

    def told(fact: Callable[[np.ndarray, int], list[float]], names: list[str]) -> pd.DataFrame:
        """A row for each document of the sample: toxic, and some facts about the weights of its segments and its length."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = [WordScores(x) for x in other]
            for batch in batches:
                rows = []
                for text, toxic, fold in zip(batch["text"], batch["toxic"], batch["fold"]):
                    scores = known[fold].of(text)
                    rows.append((int(toxic > 0), *fact(np.array([w for _, _, w in maximal_segments(scores)]), len(scores))))
                yield pd.DataFrame(rows, columns=["toxic", *names])
            del known
            give_back()

        return sample.select("text", "toxic", "fold").mapInPandas(run, "toxic int, " + ", ".join(f"{n} double" for n in names)).toPandas()

    first = told(lambda weights, length: [(weights.max() if len(weights) else 0.0) - math.log(length + 1.0)], ["best"])
    toxic = first["toxic"].to_numpy(np.int64)
    if not (toxic == 0).any() or not (toxic == 1).any():
        return Model(table, 0.0, 1.0, (-math.inf, 0.0, 0.0, 0.0))
    # by quantiles, so that toxic passages under a clean label do not stretch the law
    low, high = np.quantile(first["best"].to_numpy()[toxic == 0], [0.5, 0.9])
    scale = max(0.25, (high - low) / (math.log(-math.log(0.5)) - math.log(-math.log(0.9))))
    law = Model(np.empty(0), float(low + scale * math.log(-math.log(0.5))), float(scale), (0.0,))
    facts = told(law.evidence, ["most", "second", "often"])
    return Model(table, law.place, law.scale, logistic(np.c_[np.ones(len(facts)), facts[["most", "second", "often"]].to_numpy()], facts["toxic"].to_numpy(np.int64)))


def logistic(facts: np.ndarray, labels: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, ...]:
    """Newton's method with a small ridge."""
    curve = np.zeros(facts.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(facts @ curve, -30, 30)))
        step = np.linalg.solve((facts * (p * (1 - p) + 1e-6)[:, None]).T @ facts + ridge * np.eye(len(curve)), facts.T @ (labels - p) - ridge * curve)
        curve += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, curve))


def assess(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A struct for each text: score, and the significant passages as token spans."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(PASSAGES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        known = WordScores(model.table)
        for batch in batches:
            rows = []
            for raw in batch:
                scores = known.of(raw)
                found = maximal_segments(scores)
                weights = np.array([w for _, _, w in found])
                passages = [{"start": a, "stop": b, "weight": w, "chance": c} for (a, b, w), c in zip(found, model.chances(weights, len(scores)).tolist()) if c <= CHANCE] if found else []
                rows.append((model.score(model.evidence(weights, len(scores))), passages))
            yield pd.DataFrame(rows, columns=["score", "passages"])
        del known
        give_back()

    return run(text_bytes(F.col(text)))
