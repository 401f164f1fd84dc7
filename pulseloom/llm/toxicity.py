"""Toxicity scores by weak supervision.

Voters are words (a lexicon) and word beginnings of 4 to 6 bytes (patterns): those that at least LEAST learning rows
have and of which PRECISION are labelled toxic, the VOTERS most bound to toxic rows.  A voter votes toxic where it
stands and else abstains, which counts for nothing.  A generative label model with a hidden class estimates by
expectation maximisation, from the votes alone and starting from where any of them fires, how often each voter is
right when it fires, and the correlation of every two voters within a class.  The evidence of the voters that fire
on a row is weighted by the inverse of their correlations, so that voters that say the same count once.  Of the
labels the model knows their share alone.  A linear classifier on the voters and on EXTRA further terms, which fewer
rows have or which are less sure, is then trained on the model's posterior labels.  Its ridge, and whether the model's
posteriors must sum to the share of labels, are those of RIDGES and BALANCED that predict the labels of learning
rows left out best, in FOLDS folds; held-out rows decide nothing.

Learning reads rows whose crc32 of doc_id as text, modulo 4, is not 2, of these a sample by a hash of doc_id of
about `fit_rows`, the documented bound; a doc_id whose rows repeat counts with the first FIT_COPIES of them.  The
bounds are LEAST, PRECISION, VOTERS, EXTRA and fit_rows, all of the fit; scoring covers whole texts of all rows.
Only text enters a score.

Null and empty texts get the score of a text without features.  Repeated rows are scored alike.  Rows without
doc_id are scored, and not held out.  A doc_id that is labelled both ways counts as toxic.  Without labels, or without
toxic ones, all scores are 0 (to 300 digits), and if all are toxic, 1.  Labels that are null or not 0 or 1 are ignored;
so are other columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.llm.tables import give_back
from pulseloom.llm.words import slices, split_words

FIT_ROWS, FIT_COPIES = 20_000, 4
VOTERS, EXTRA = 400, 200
PRECISION = 0.7  # toxic share that a voter needs among the learning rows that have it; a further term needs half of it
LEAST = 6  # learning rows that must have a voter; a further term needs half of them
RIDGES, BALANCED, FOLDS = (1e-3, 1e-2, 3e-2), (True, False), 3
NEVER = 0.001  # posterior where no voter fires
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def terms(column: pa.Array, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, term) pairs; only: the sorted terms to look for."""
    words = split_words(column, True, _BETWEEN)
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    rows, found = [], []
    for h in (words.hashes & ~np.uint64(1), *map(words.heads, PREFIXES)):
        keep = h != 0
        if only is not None:
            at = np.minimum(np.searchsorted(only, h), max(len(only) - 1, 0))
            keep &= (only[at] == h) if len(only) else False
        k = np.flatnonzero(keep)
        rows.append(row[k])
        found.append(h[k])
    row, found = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    return row[new], found[new]


@dataclass
class LabelModel:
    """How often voters that fire are right, and how they correlate, fitted from their votes alone."""

    start: float  # log odds before any evidence
    right: np.ndarray  # of each voter, when it fires
    alike: np.ndarray  # correlations within a class

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return np.where(votes.any(1), 1 / (1 + np.exp(-np.clip(self.start + self.evidence(votes), -30, 30))), NEVER)

    def evidence(self, votes: np.ndarray, share: float | None = None, keep: float = 0.1) -> np.ndarray:
        """Log odds that the voters firing on each row add, with what they have in common counted once."""
        base = 0.1 if share is None else share
        own = np.log(self.right / (1 - self.right)) - np.log(base / (1 - base))
        out = np.zeros(len(votes))
        for k, row in enumerate(votes):
            if len(on := np.flatnonzero(row)):
                out[k] = np.linalg.solve(self.alike[np.ix_(on, on)] + keep * np.eye(len(on)), own[on] * (1 + keep)).clip(0).sum()
        return out

    @classmethod
    def fit(cls, votes: np.ndarray, share: float, times: np.ndarray | None = None, balanced: bool = True, rounds: int = 10) -> tuple[LabelModel, np.ndarray]:
        """The model, and the posterior of class 1 for each row; times: how often a row stands; share: that of class 1."""
        w, fires = np.ones(len(votes)) if times is None else times, votes.any(1)
        share = float(np.clip(share, 1e-4, 1 - 1e-4))
        odds, q = np.log(share / (1 - share)), np.where(fires, 0.9, NEVER)
        for _ in range(rounds):
            right = np.clip(((w * q) @ votes + 0.7) / (w @ votes + 1), 0.5, 0.995)
            model = cls(odds, right, cls.correlations(votes, w, q))
            evidence = model.evidence(votes, share)
            if balanced:  # the start at which posteriors sum to the share, or one that is a little more generous
                low, high = -30.0, odds + 2
                for _ in range(40):
                    model.start = (low + high) / 2
                    total = (w * np.where(fires, 1 / (1 + np.exp(-np.clip(model.start + evidence, -30, 30))), NEVER)).sum()
                    low, high = (low, model.start) if total > share * w.sum() else (model.start, high)
            new = np.where(fires, 1 / (1 + np.exp(-np.clip(model.start + evidence, -30, 30))), NEVER)
            done, q = np.abs(new - q).max(initial=0) < 1e-3, new
            if done:
                break
        return model, q

    @staticmethod
    def correlations(votes: np.ndarray, w: np.ndarray, q: np.ndarray) -> np.ndarray:
        zero, one = ((w * p) @ votes / max((w * p).sum(), 1e-9) for p in (1 - q, q))
        rest = votes - np.outer(1 - q, zero) - np.outer(q, one)
        both = (rest * w[:, None]).T @ rest / w.sum()
        spread = np.sqrt(np.diag(both)) + 1e-9
        alike = np.clip(both / np.outer(spread, spread), 0, 1)
        np.fill_diagonal(alike, 1.0)
        return alike


def _linear(x: np.ndarray, times: np.ndarray, target: np.ndarray, centre: np.ndarray, ridge: float, steps: int = 10) -> np.ndarray:
    """Weights, and the bias as the last of them, of a logistic regression on soft labels, by damped Newton steps; the ridge draws them to `centre`."""
    x, times, now = np.concatenate([x, np.ones((len(x), 1))], 1), times / times.sum(), centre.copy()

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float((times * (np.logaddexp(0, z) - target * z)).sum() + ridge * ((at - centre) ** 2).sum() / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ now, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) * times)[:, None]).T @ x + ridge * np.eye(len(now)), x.T @ ((p - target) * times) + ridge * (now - centre))
        before = loss(now)
        size = next((s for s in (1, 0.5, 0.25, 0.1, 0.01) if loss(now - s * step) < before - 1e-9), 0)
        now = now - size * step
        if not size:
            break
    return now


def ranking(score: np.ndarray, label: np.ndarray) -> float:
    """The share of (toxic, clean) pairs in which the toxic one has the higher score; ties count half."""
    order = np.sort(score[label == 0])
    low, high = np.searchsorted(order, score[label == 1]), np.searchsorted(order, score[label == 1], "right")
    return float((low + high).mean() / 2 / max(len(order), 1))


def train(x: np.ndarray, votes: np.ndarray, label: np.ndarray, fold: np.ndarray) -> tuple[LabelModel, np.ndarray, float]:
    """The label model, and weights and bias of the classifier; x: row x term, votes: which terms are voters."""
    # most rows have the same few terms
    kinds, kind = np.unique(x.astype(bool), axis=0, return_inverse=True)
    kind, share, best = kind.ravel(), float(label.mean()), (np.inf,)
    for balanced in BALANCED:
        model, posterior = LabelModel.fit(kinds[:, votes].astype(float), share, np.bincount(kind).astype(float), balanced)
        centre = np.zeros(x.shape[1] + 1)
        centre[:-1][votes], centre[-1] = np.log(model.right / (1 - model.right)) / 2, np.log(NEVER / (1 - NEVER))

        def linear(rows: np.ndarray, ridge: float, posterior=posterior, centre=centre) -> np.ndarray:
            some, times = np.unique(kind[rows], return_counts=True)
            return _linear(kinds[some].astype(float), times, posterior[some], centre, ridge)

        for ridge in RIDGES:
            score = np.zeros(len(label))
            for k in np.unique(fold):
                weights = linear(fold != k if (fold != k).any() else fold == k, ridge)
                score[fold == k] = x[fold == k] @ weights[:-1] + weights[-1]
            missed = float((np.logaddexp(0, score) - label * score).mean())
            if missed < best[0] - 1e-6:
                best = (missed, model, linear, ridge)
    _, model, linear, ridge = best
    weights = linear(np.ones(len(label), bool), ridge)
    return model, weights[:-1], float(weights[-1])


@dataclass
class Scorer:
    terms: np.ndarray  # sorted
    weights: np.ndarray
    bias: float
    model: LabelModel | None = None

    def __call__(self, column: pa.Array) -> np.ndarray:
        row, found = terms(column, self.terms)
        total = np.bincount(row, self.weights[np.searchsorted(self.terms, found)], len(column)) if len(found) else np.zeros(len(column))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Scorer:
    given = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = fit_rows / max(given.count(), 1)
    if share < 1:
        given = given.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # a broadcast of about fit_rows pairs of numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(given), "doc_id")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    rows = rows.withColumn("k", first).where(F.col("k") <= FIT_COPIES).drop("k")

    def count(batches):
        give_back()
        for batch in batches:
            for low, high in slices(batch.column("text"), 1 << 20):
                label = batch.column("label").slice(low, high - low).to_numpy()
                row, found = terms(batch.column("text").slice(low, high - low))
                term, at = np.unique(found, return_inverse=True)
                toxic = np.bincount(at, label[row], len(term)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(toxic), pa.array(np.bincount(at, minlength=len(term)).astype(np.int64))], ["term", "toxic", "rows"])

    counts = rows.select("label", "text").mapInArrow(count, "term long, toxic long, rows long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("rows").alias("rows")).where(F.col("rows") >= LEAST // 2)
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not ones or ones == n:
        return Scorer(np.zeros(0, np.uint64), np.zeros(0), -1e9 if not ones else 1e9)
    rate = ones / n
    z = (F.col("toxic") - F.col("rows") * rate) / F.sqrt(F.col("rows") * (rate * (1 - rate)))
    sure = (F.col("rows") >= LEAST) & (F.col("toxic") >= PRECISION * F.col("rows"))
    counts = counts.where(F.col("toxic") >= PRECISION / 2 * F.col("rows")).withColumns({"z": z, "sure": sure})
    best = counts.orderBy(F.desc("sure"), F.desc("z"), "term").limit(VOTERS + EXTRA).collect()
    best = [r for r in best if r.sure][:VOTERS] + [r for r in best if not r.sure][:EXTRA]
    best.sort(key=lambda r: np.int64(r.term).view(np.uint64))
    known, votes = np.array([r.term for r in best], np.int64).view(np.uint64), np.array([r.sure for r in best], bool)
    if not votes.any():
        return Scorer(np.zeros(0, np.uint64), np.zeros(0), float(np.log(rate / (1 - rate))))

    def fired(batches):
        give_back()
        for batch in batches:
            for low, high in slices(batch.column("text"), 1 << 20):
                row, found = terms(batch.column("text").slice(low, high - low), known)
                ends = np.searchsorted(row, np.arange(high - low + 1))
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(low, high - low), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.searchsorted(known, found), pa.int32()))], ["label", "terms"])

    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("label_fold")
    held = rows.select((F.col("label") * FOLDS + fold).alias("label"), "text").mapInArrow(fired, "label int, terms array<int>").toArrow()  # fit_rows * FIT_COPIES rows at most
    label, fold = np.divmod(held.column("label").to_numpy(), FOLDS)
    lists = held.column("terms").combine_chunks()
    x = np.zeros((len(label), len(known)), np.float32)
    x[np.repeat(np.arange(len(label)), np.asarray(pa.compute.list_value_length(lists))), np.asarray(pa.compute.list_flatten(lists))] = 1
    model, weights, bias = train(x, votes, label, fold)
    return Scorer(known, weights, bias, model)


def score(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""

    def run(batches):
        give_back()
        for batch in batches:
            for low, high in slices(batch.column("text"), 1 << 20):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(scorer(batch.column("text").slice(low, high - low)))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold."""

    def run(batches):
        give_back()
        for batch in batches:
            for low, high in slices(batch.column("text"), 1 << 20):
                part = batch.slice(low, high - low)
                yield part.filter(pa.array(scorer(part.column("text")) < threshold))

    return docs.mapInArrow(run, docs.schema)
