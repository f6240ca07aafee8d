"""Quality classifier: weak-label models over heuristics, and a hashed linear scorer.

A document can be bad in its form or by insults. For either fault, overlapping
labellers vote good, bad or nothing: some look at the form, one at a lexicon of words and stems
that mark toxic rows of the labelled table, and the table itself votes where it covers a
document. Expectation-maximisation estimates, without true classes, how often
each labeller votes which way on good and on bad documents; only the counts of
distinct vote patterns are needed. The soft label of a document is the chance that it has
neither fault. A logistic scorer over hashed words and votes is fitted to soft
labels on a bounded sample, and scores all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airq.llm.lexer import Lexed, distinct_words, lexed
from airq.llm.rolling import grams, mix, run_starts
from airq.llm.shared import need, packed, unpacked, written

GOOD, NONE, BAD = 1, 0, -1
#: Documents that the scorer is fitted on, at most; they are the ones with the least hash of their id.
SAMPLE = 10_000
#: Labelled documents that the lexicon is taken from, at most, and the bytes of stems.
LEXICON_SAMPLE, STEMS = 6_000, (5, 6, 7)
#: Hashed features, and the sampled documents a feature must occur in to be used.
FEATURES, SUPPORT = 1 << 18, 4
THRESHOLD = 0.5

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FORM = ("symbols", "shouting", "repetition", "stutter", "table")


def form_votes(piece: Lexed, raw_upper: np.ndarray) -> np.ndarray:
    """Votes of the labellers that look at a document's form, one row per document.

    symbols: punctuation among visible characters. shouting: capitals among ASCII
    letters. repetition: distinct among all word trigrams. stutter: words that equal the
    word before. table: bars per word. Documents of under eight words tell too little
    for the shares; a document without words is bad by all of them.
    """
    n = len(piece.rows)
    begin, data = piece.start[:-1], piece.data
    count = lambda mask: np.add.reduceat(mask.astype(np.int32), begin)
    letter = (data >= 0x61) & (data <= 0x7A)
    visible = np.maximum(count(data > 0x20), 1)
    symbols = count((data > 0x20) & (data < 0x7F) & ~letter & ~((data >= 0x30) & (data <= 0x39)))
    bars = count(data == 0x7C)
    words = np.bincount(piece.doc, minlength=n)
    same = (piece.word[1:] == piece.word[:-1]) & (piece.doc[1:] == piece.doc[:-1])
    stutter = np.bincount(piece.doc[1:][same], minlength=n)
    doc, gram = piece.doc[2:], grams(piece.word, 3)
    own = np.flatnonzero(doc == piece.doc[:-2]) if len(gram) else np.zeros(0, dtype=np.int64)
    doc, gram = (doc[own], gram[own]) if len(own) else (own, gram[:0])
    order = np.lexsort((gram, doc))
    distinct = np.bincount(doc[order][run_starts(doc[order], gram[order])], minlength=n)
    trigrams = np.bincount(doc, minlength=n)
    few = words < 8

    def vote(bad, good):
        return np.where(words == 0, BAD, np.where(few, NONE, np.where(bad, BAD, np.where(good, GOOD, NONE)))).astype(np.int64)

    return np.stack([
        vote(symbols > 0.12 * visible, symbols < 0.08 * visible),
        vote(raw_upper > 0.5 * np.maximum(count(letter), 1), raw_upper < 0.2 * count(letter)),
        vote(distinct < 0.6 * trigrams, distinct > 0.8 * trigrams),
        vote(stutter > 0.2 * words, stutter < 0.15 * words),
        vote(bars > 0.1 * words, bars == 0),
    ], axis=1)


def judged(texts: pa.Array) -> Iterator[tuple[Lexed, np.ndarray]]:
    """Pieces of a text column with their form votes."""
    upper = np.array([sum(map(t.count, CAPITALS)) if t else 0 for t in texts.to_pylist()])
    for piece in lexed(texts):
        yield piece, form_votes(piece, upper[piece.rows.start:piece.rows.stop])


def marks_of(piece: Lexed) -> tuple[np.ndarray, np.ndarray]:
    """``doc, hash`` of every word and of its stems, from which a lexicon is taken."""
    parts = [(piece.doc, piece.word), *[piece.stems(size) for size in STEMS]]
    return np.concatenate([d for d, _ in parts]), np.concatenate([h for _, h in parts])


def insult_votes(piece: Lexed, lexicon: np.ndarray) -> np.ndarray:
    """Bad for documents with a word or stem of the lexicon (ascending hashes), good for others."""
    doc, mark = marks_of(piece)
    if not len(lexicon):
        return np.full(len(piece.rows), NONE)
    place = np.minimum(np.searchsorted(lexicon, mark), len(lexicon) - 1)
    hit = doc[lexicon[place] == mark]
    return np.where(np.bincount(hit, minlength=len(piece.rows)) > 0, BAD, GOOD)


def _signs(votes: np.ndarray) -> list[str]:
    return ["".join("-0+"[v + 1] for v in row) for row in votes.tolist()]


def _votes(signs: list[str], n: int) -> np.ndarray:
    return np.array([["-0+".index(c) - 1 for c in s] for s in signs], dtype=np.int64).reshape(-1, n)


class LabelModel(NamedTuple):
    """``given[labeller, class, vote]`` is the chance of a good vote (1) or a bad one (0)
    when the labeller votes at all; class 1 is good. An abstention says nothing."""

    prior: float
    given: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance of being good for rows of votes."""
        column = np.arange(votes.shape[1])
        which = (votes > 0).astype(np.int64)
        odds = np.where(votes == 0, 0.0, np.log(self.given[column, 1, which] / self.given[column, 0, which])).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds + np.log(self.prior / (1 - self.prior)), -40, 40)))


def fit_labels(votes: np.ndarray, counts: np.ndarray, rounds: int = 300, least: float = 1e-3) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns.

    The start says that a labeller is rather right when it votes; classes are thereby
    named. Smoothing by ``least`` of all rows keeps chances above zero; no rows give the start.
    """
    model = LabelModel(0.9, np.tile(np.array([[0.6, 0.4], [0.05, 0.95]]), (votes.shape[1], 1, 1)))
    if not len(votes) or not counts.sum():
        return model
    cast = np.stack([votes < 0, votes > 0], axis=2).astype(float)
    for _ in range(rounds):
        good = model.posterior(votes)
        weight = np.stack([counts * (1 - good), counts * good])
        made = np.einsum("cp,plv->lcv", weight, cast) + least * counts.sum() * np.array([[0.6, 0.4], [0.05, 0.95]])
        made /= made.sum(axis=2, keepdims=True)
        prior = float(np.clip(weight[1].sum() / counts.sum(), 0.01, 0.99))
        done = np.abs(made - model.given).max() < 1e-7
        model = LabelModel(prior, made)
        if done:
            break
    return model


class Scorer(NamedTuple):
    """Logistic scorer over hashed features."""

    weights: np.ndarray
    bias: float

    def score(self, doc: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        total = np.bincount(doc, weights=self.weights[feature] * value, minlength=n) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def features_of(piece: Lexed, votes: np.ndarray, size: int = FEATURES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``doc, feature, value``: every distinct word, scaled to length one per document, and every vote."""
    doc, word, _ = distinct_words(piece)
    value = 1 / np.sqrt(np.bincount(doc, minlength=len(votes)))[doc] if len(doc) else np.zeros(0)
    labeller = np.arange(1, votes.shape[1] + 1, dtype=np.uint64)
    own = mix(labeller * np.uint64(3) + (votes + 1).astype(np.uint64)).ravel()
    rows = np.repeat(np.arange(len(votes)), votes.shape[1])
    feature = (np.append(word, own) % np.uint64(size)).astype(np.int64)
    return np.append(doc, rows), feature, np.append(value, np.ones(len(own)))


def fit_scorer(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, target: np.ndarray, size: int = FEATURES,
               support: int = SUPPORT, rounds: int = 120, rate: float = 0.3, ridge: float = 1e-5) -> Scorer:
    """Logistic regression by accelerated gradient steps on all of the sample at once."""
    weights, bias, n = np.zeros(size), 0.0, len(target)
    if not n:
        return Scorer(weights, bias)
    use = np.bincount(feature, minlength=size)[feature] >= support
    doc, feature, value = doc[use], feature[use], value[use]
    ahead, ahead_bias = weights, bias
    for i in range(rounds):
        error = Scorer(ahead, ahead_bias).score(doc, feature, value, n) - target
        slope = np.bincount(feature, weights=error[doc] * value, minlength=size) / n + ridge * ahead
        new, new_bias = ahead - rate * slope, ahead_bias - rate * error.mean()
        push = i / (i + 3)
        ahead, ahead_bias = new + push * (new - weights), new_bias + push * (new_bias - bias)
        weights, bias = new, new_bias
    return Scorer(weights, bias)


class Quality(NamedTuple):
    """What a document's score comes from."""

    lexicon: np.ndarray
    form: LabelModel
    insults: LabelModel
    scorer: Scorer

    def votes(self, texts: pa.Array) -> Iterator[tuple[Lexed, np.ndarray]]:
        for piece, votes in judged(texts):
            yield piece, np.column_stack([votes, insult_votes(piece, self.lexicon)])

    def scores(self, texts: pa.Array) -> np.ndarray:
        parts = [self.scorer.score(*features_of(p, v), len(p.rows)) for p, v in self.votes(texts)]
        return np.concatenate([np.zeros(0), *parts])


def _sign(fault: Column, fine: Column) -> Column:
    return F.when(F.max(fault), "-").when(F.max(fine), "+").otherwise("0")


def _table(labels: DataFrame) -> DataFrame:
    """``labelled, table``: the votes on form and on insults as two signs; of several rows the worst."""
    quality, toxic = F.col("quality"), F.col("toxic")
    return labels.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(
        F.concat(_sign(quality == 0, quality == 1), _sign(toxic == 1, toxic == 0)).alias("table"))


def _sampled(rows: DataFrame, n: int, total: float) -> DataFrame:
    """About ``n`` of ``total`` rows: those with the least hash of their id."""
    share = min(1.0, n / max(1.0, total))
    return rows.filter(F.pmod(F.xxhash64("row", F.lit(7)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def _gathered(sample: DataFrame, make, width: int) -> list[np.ndarray]:
    """The ``width`` arrays that ``make`` yields per piece of a bounded sample.

    The first numbers the documents of the piece, the last has one value for each.
    """
    parts: list[list] = [[] for _ in range(width)]
    n = 0
    for r in sample.mapInArrow(make, "payload binary").toLocalIterator():
        doc, *others = unpacked(r["payload"])
        for part, own in zip(parts, [doc + np.int32(n), *others]):
            part.append(own)
        n += len(others[-1])
    return [np.concatenate(p) if p else np.zeros(0, dtype=np.int64) for p in parts]


def find_lexicon(doc: np.ndarray, word: np.ndarray, toxic: np.ndarray, support: int = 4, share: float = 0.9) -> np.ndarray:
    """Words and stems of which ``share`` of the documents are toxic, and at least ``support`` documents are.

    Documents with the same words and stems are copies and count once. The support rises
    until less than one word is expected to pass by chance.
    """
    if not len(doc):
        return word[:0].astype(np.uint64)
    # Two independent sums over the distinct marks of a document stand for their whole set.
    order = np.lexsort((word, doc))
    order = order[run_starts(doc[order], word[order])]
    doc, word = doc[order], word[order]
    begin, whole = np.flatnonzero(run_starts(doc)), np.zeros((2, len(toxic)), dtype=np.uint64)
    for k in range(2):
        whole[k, doc[begin]] = np.add.reduceat(mix(word + np.uint64(k + 1)), begin)
    order = np.lexsort((toxic[doc], whole[1, doc], whole[0, doc], word))
    order = order[run_starts(word[order], whole[0, doc][order], whole[1, doc][order], toxic[doc][order])]
    doc, word = doc[order], word[order]
    known, at = np.unique(word, return_inverse=True)
    hits = np.bincount(at, weights=toxic[doc], minlength=len(known))
    seen = np.bincount(at, minlength=len(known))
    while toxic.mean() ** support * (seen >= support).sum() > 1 and support < 64:
        support += 1
    return known[(hits >= support) & (hits >= share * seen)]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Quality:
    """Fit the lexicon, both label models and the scorer.

    Vote patterns are counted over all documents (at most 3 ** 8 counts). The lexicon
    is taken from ``LEXICON_SAMPLE`` labelled documents at most, and the scorer is fitted on about
    ``sample`` documents at most; both are chosen by a hash of their id.
    """
    need(docs, "doc_id", "text")
    need(labels, "doc_id", "quality", "toxic")
    rows = docs.select(F.col("doc_id").cast("long").alias("row"), "text")
    table = written(_table(labels))

    def words(batches):
        for batch in batches:
            toxic = np.array([t[1] == "-" for t in batch.column("table").to_pylist()], dtype=float)
            for piece in lexed(batch.column("text")):
                doc, mark = marks_of(piece)
                order = np.lexsort((mark, doc))
                order = order[run_starts(doc[order], mark[order])]
                yield pa.record_batch({"payload": [packed(doc[order].astype(np.int32), mark[order], toxic[piece.rows.start:piece.rows.stop])]})

    ids = table.select(F.col("labelled").alias("row"), "table").filter("row IS NOT NULL")
    # At most LEXICON_SAMPLE ids, so this is broadcast by right and no text moves.
    known = F.broadcast(ids.orderBy(F.xxhash64("row", F.lit(7)), "row").limit(LEXICON_SAMPLE))
    lexicon = find_lexicon(*_gathered(rows.join(known, "row").select("text", "table"), words, 3))

    def vote(batches):
        for batch in batches:
            signs = []
            for piece, votes in judged(batch.column("text")):
                signs += _signs(np.column_stack([votes, insult_votes(piece, lexicon)]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(signs, pa.string())], names=["row", "votes"])

    voted = rows.mapInArrow(vote, "row long, votes string").join(
        table, F.col("row") == F.col("labelled"), "left").select("row", F.concat("votes", F.coalesce("table", F.lit("00"))).alias("votes"))
    patterns = voted.groupBy("votes").count().collect()
    n = len(FORM)
    votes = _votes([p["votes"] for p in patterns], n + 3)
    counts = np.array([p["count"] for p in patterns], dtype=float)
    on_form, on_insults = [*range(n), n + 1], [n, n + 2]
    form, insults = fit_labels(votes[:, on_form], counts), fit_labels(votes[:, on_insults], counts)
    unfitted = Quality(lexicon, form, insults, Scorer(np.zeros(0), 0.0))

    def make(batches):
        for batch in batches:
            tables = batch.column("table").to_pylist()
            for piece, votes in unfitted.votes(batch.column("text")):
                doc, feature, value = features_of(piece, votes)
                own = _votes([t or "00" for t in tables[piece.rows.start:piece.rows.stop]], 2)
                every = np.column_stack([votes, own])
                target = form.posterior(every[:, on_form]) * insults.posterior(every[:, on_insults])
                yield pa.record_batch({"payload": [packed(doc.astype(np.int32), feature.astype(np.int32), value.astype(np.float32), target)]})

    chosen = _sampled(rows, sample, counts.sum()).join(table, F.col("row") == F.col("labelled"), "left").select("text", "table")
    return unfitted._replace(scorer=fit_scorer(*_gathered(chosen, make, 4)))


def scored(docs: DataFrame, model: Quality, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, kept``: the chance of being good for every row; no shuffle."""
    model = model._replace(scorer=Scorer(model.scorer.weights.astype(np.float32), model.scorer.bias))

    def score(batches):
        for batch in batches:
            value = model.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(value), pa.array(value >= threshold)], names=["doc_id", "score", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(score, "doc_id long, score double, kept boolean")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, score, kept`` for every row of ``docs``: train on it, then score it.

    A null text is empty, and an empty text is bad by every form vote. Labels of
    unknown documents, null labels and repeated labels (the worst counts) are fine, as
    are empty tables: without documents nothing is returned, without labels the form
    votes decide. Repeated rows are each scored; other columns are ignored.
    """
    return scored(docs, train(docs, labels, sample), threshold)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; columns are those of ``docs``."""
    model = train(docs, labels, sample)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column("text")) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
