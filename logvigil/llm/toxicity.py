"""Toxicity by weak supervision.

1. **Terms.** A document's terms are its words and the first four and five letters of its words. Over a
   bounded sample of labelled documents, Spark counts in how many documents, and in how many toxic ones,
   each term occurs.
2. **Voters.** Terms whose documents are mostly toxic form lexicons: three kinds of term, each
   dealt over ``lexicons`` parts, so that there are many voters that each know part of the vocabulary. A
   lexicon votes *toxic* where a document has one of its terms. Pattern voters look at how many of a
   kind's terms there are (one, two or more) and vote *toxic* for several and *clean* for none.
3. **Label model.** Expectation maximisation estimates each voter's accuracy, as the chances of its vote in
   either class, without looking at labels. Voters that agree more than the model explains (correlations
   of the residuals) share their weight, so that five copies of one voter count like one.
4. **Classifier.** Logistic regression over the terms learns the label model's posteriors. It scores every
   document of the corpus in one pass without a shuffle.

Labels are used from ``labels`` rows with a label and only where the fold function says so; a document's own
label, language, source and id are never inputs of its score. The sample bound ``most`` (rows) is a
parameter: the classifier's training set does not grow with the corpus, everything else does.

Nulls: a null text is empty and scores the intercept, labels without id or value are ignored, of several
labels of one id the largest counts. Without labelled rows of both classes every score is the share of
toxic labels (0 without labels). Repeated rows get a row each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logvigil.llm.common import ship, texts

_EDGES = ".,;:!?\"'()[]{}<>#$%&*+-/=@^_`~|0123456789"
KINDS = ("w", "4", "5")


def terms(text: str) -> set[str]:
    """Words (``w``) and their beginnings (``4``, ``5``) of a whole text; the first letter of a term names its kind."""
    words = {w.strip(_EDGES) for w in set(text.lower().split())}
    words.discard("")
    found = {"w" + w for w in words}
    found.update("4" + w[:4] for w in words if len(w) > 4)
    found.update("5" + w[:5] for w in words if len(w) > 5)
    return found


def training_fold(id: Column) -> Column:
    """Rows whose crc32 of the id as text is no multiple of five; null ids are never used."""
    return F.crc32(id.cast("string")) % 5 != 0


def sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``text, label`` of at most ``most`` labelled training rows, chosen by a hash of the id.

    The chosen ids are at most ``most`` rows, which bounds the broadcast.
    """
    usable = labels.filter(F.col("label").isNotNull() & training_fold(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.join(F.broadcast(chosen), "doc_id").select("text", "label")


def counted(rows: DataFrame, least: int = 3) -> DataFrame:
    """``term, n, t``: documents and toxic documents with the term, for terms of at least ``least`` documents of the sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, toxic = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = terms(text)
                every.update(found)
                if label:
                    toxic.update(found)
            if every:
                yield pa.RecordBatch.from_pydict({"term": list(every), "n": list(every.values()), "t": [toxic[x] for x in every]})

    return rows.mapInArrow(run, "term string, n long, t long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).filter(F.col("n") >= least)


def telling(rows: DataFrame, documents: int, toxic: int, keep: int) -> list[tuple[str, float, float]]:
    """The ``keep`` terms whose share of toxic documents is furthest from the sample's, in standard errors, with that share."""
    base = toxic / documents
    z = (F.col("t") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    top = rows.withColumn("z", z).orderBy(F.abs("z").desc(), "term").limit(keep).collect()
    return [(r["term"], r["z"], r["t"] / r["n"]) for r in top]


class LabelModel:
    """Posterior of the hidden class from votes (1 toxic, -1 clean, 0 none), one column per voter."""

    def __init__(self, votes: np.ndarray, prior: float, rounds: int = 50):
        n, m = votes.shape
        self.prior = prior
        posterior = 1 / (1 + np.exp(-(votes.sum(axis=1) + np.log(prior / (1 - prior)))))
        self.weight = np.ones(m)
        one_hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(np.float64)
        for step in range(rounds):
            sums = np.stack([(1 - posterior) @ one_hot.reshape(n, -1), posterior @ one_hot.reshape(n, -1)]).reshape(2, m, 3)
            self.chance = (sums + 0.5) / (sums.sum(axis=2, keepdims=True) + 1.5)
            before, posterior = posterior, self.posterior(votes)
            if step in (2, 10):
                self.weight = self._weights(votes, posterior)
            if step > 12 and np.abs(before - posterior).max() < 1e-6:
                break

    def _weights(self, votes: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        """1 / (1 + sum of a voter's residual correlations with others)."""
        expected = np.stack([self.chance[c, :, 2] - self.chance[c, :, 0] for c in (0, 1)])
        residual = votes - ((1 - posterior)[:, None] * expected[0] + posterior[:, None] * expected[1])
        spread = residual.std(axis=0) + 1e-9
        correlation = (residual.T @ residual) / len(votes) / np.outer(spread, spread)
        np.fill_diagonal(correlation, 0)
        return 1 / (1 + np.clip(correlation, 0, 1).sum(axis=1))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        ratio = self.weight[:, None] * np.log(self.chance[1] / self.chance[0])
        logit = np.log(self.prior / (1 - self.prior)) + ratio[np.arange(votes.shape[1])[None, :], votes + 1].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def votes_of(hits: list[list[int]], lexicon: np.ndarray, kind: np.ndarray, lexicons: int) -> np.ndarray:
    """Votes of the lexicon voters, then of the pattern voters, for documents given as numbers of their terms.

    ``lexicon``: the lexicon of each term, -1 for terms that are in none.
    """
    out = np.zeros((len(hits), lexicons + 2 * len(KINDS) + 1), np.int8)
    for i, mine in enumerate(hits):
        mine = np.array(mine, np.int64)
        toxic = mine[lexicon[mine] >= 0]
        out[i, lexicon[toxic]] = 1
        per_kind = np.bincount(kind[toxic], minlength=len(KINDS))
        out[i, lexicons : lexicons + len(KINDS)] = np.where(per_kind > 0, 1, -1)
        out[i, lexicons + len(KINDS) : -1] = np.where(per_kind > 1, 1, 0)
        out[i, -1] = 1 if per_kind.sum() > 4 else -1 if not per_kind.sum() else 0
    return out


def regression(hits: list[list[int]], target: np.ndarray, m: int, decay: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Weights of m terms and an intercept for soft targets, by Adam on all rows."""
    row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    column = np.array([j for h in hits for j in h], np.int64)
    weights, first, second = np.zeros(m + 1), np.zeros(m + 1), np.zeros(m + 1)
    weights[m] = np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    for step in range(1, rounds + 1):
        logit = np.bincount(row, weights[column], len(hits)) + weights[m]
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target) / len(hits)
        slope = np.append(np.bincount(column, error[row], m), error.sum()) + decay * np.append(weights[:m], 0)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weights -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000, keep: int = 3000, lexicons: int = 12, lift: float = 4.0, share: float = 0.7) -> tuple[dict[str, float], float]:
    """(weight of each term, intercept). ``docs``: doc_id, text; ``labels``: doc_id, label.

    A lexicon takes terms that are ``lift`` standard errors more usual in toxic documents and of whose
    documents at least ``share`` are toxic: words of a language in which more is toxic do not qualify.
    """
    rows = sample(docs, labels, most)
    documents, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("label").cast("bigint")), F.lit(0))).first()
    if not 0 < toxic < documents:
        base = toxic / documents if documents else 0.0
        return {}, float(np.clip(np.log((base + 1e-9) / (1 - base + 1e-9)), -30, 30))
    found = telling(counted(rows), documents, toxic, keep)
    if not found:
        return {}, float(np.log(toxic / (documents - toxic)))
    number = {term: i for i, (term, _, _) in enumerate(found)}
    kind = np.array([KINDS.index(term[0]) for term in number])
    strong = np.array([z >= lift and of >= share for _, z, of in found])
    rank = np.cumsum(strong) - 1
    per_kind = max(1, lexicons // len(KINDS))
    lexicon = np.where(strong, kind * per_kind + rank % per_kind, -1)

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [sorted(number[x] for x in terms(text) if x in number) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.int32()))], names=["hits"])

    hits = [r["hits"] for r in rows.mapInArrow(mine, "hits array<int>").collect()]  # at most `most` rows of telling terms
    votes = votes_of(hits, lexicon, kind, per_kind * len(KINDS))
    posterior = LabelModel(votes, toxic / documents).posterior(votes)
    weights = regression(hits, posterior, len(found))
    return {term: float(weights[i]) for term, i in number.items()}, float(weights[-1])


def score_toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "toxic", **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document."""
    rows = texts(docs, id, text)
    marks = labels.select(F.col(label_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
    weights, intercept = train(rows, marks, **options)
    by_kind = [{t[1:]: w for t, w in weights.items() if t[0] == k} for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, four, five = by_kind
        for batch in batches:
            logits = []
            for text in batch.column(1).to_pylist():
                words = {w.strip(_EDGES) for w in set(text.lower().split())}
                total = intercept + sum(whole[w] for w in words if w in whole)
                total += sum(four[p] for p in {w[:4] for w in words if len(w) > 4} if p in four)
                total += sum(five[p] for p in {w[:5] for w in words if len(w) > 5} if p in five)
                logits.append(total)
            scores = 1 / (1 + np.exp(-np.clip(np.array(logits, np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
    return scored.select("doc_id", F.coalesce(~training_fold(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents predicted clean, with the columns they came with. Rows without an id stay or go by their text like others."""
    marks = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("label"))
    weights, intercept = train(texts(docs, id, text), marks, **options)
    return filtered(docs, text, weights, intercept)


def filtered(docs: DataFrame, text: str, weights: dict[str, float], intercept: float) -> DataFrame:
    """``docs`` whose score is below one half, in one pass over whole rows."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(text).to_pylist() if batch.num_rows else []
            keep = [intercept + sum(weights[x] for x in terms(t or "") if x in weights) < 0 for t in values]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
