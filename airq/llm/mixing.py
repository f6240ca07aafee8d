"""Mixing to target weights with soft domain membership.

A classifier that is fitted to the labelled documents gives every document a chance
for each domain. Its tokens count for the domains in these shares. Document rates are then
sought that are not negative and make the expected tokens of each domain equal its
target: a least-squares problem, solved by projected gradients. A step moves each
document's rate along its own shares, then cuts it at zero; only domain totals and
their curvature, a few numbers, are gathered per step, and a document's rate follows from
the list of steps, so nothing is written between them.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airq.llm.lexer import distinct_words, lexed
from airq.llm.shared import free_name, need, packed, unpacked, written

#: Hashed word features of the classifier.
FEATURES = 1 << 15
#: Labelled documents that the classifier is fitted to, at most: those with the least hash of their id.
LABELLED = 20_000
#: How much a document's words count together, as many words of independent evidence.
EVIDENCE = 12.0
#: Largest relative error of a domain's total, and most steps.
ERROR, STEPS = 1e-6, 40


class Domains(NamedTuple):
    """Naive-Bayes classifier over hashed words."""

    names: list[str]
    weights: np.ndarray  # log chance of each feature in each domain, features first
    prior: np.ndarray

    def shares(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """Chance of every domain for each of ``n`` documents; the prior where there are no words."""
        if not self.names:
            return np.zeros((n, 0))
        words = np.bincount(doc, minlength=n)
        total = np.stack([np.bincount(doc, weights=self.weights[feature, k], minlength=n) for k in range(len(self.names))], axis=1)
        odds = total / np.maximum(words, 1)[:, None] * np.minimum(words, EVIDENCE)[:, None] + self.prior
        odds -= odds.max(axis=1, keepdims=True)
        chance = np.exp(odds)
        return chance / chance.sum(axis=1, keepdims=True)


def _features(word: np.ndarray) -> np.ndarray:
    return (word % np.uint64(FEATURES)).astype(np.int64)


def fit_domains(labelled: DataFrame) -> Domains:
    """Classifier from all ``text, domain`` rows given; rows without a domain are left out.

    Tasks send one count per feature and domain each, which are added in the shuffle
    and on the driver: domains times ``FEATURES`` numbers, whatever the input.
    """
    rows = labelled.filter("domain IS NOT NULL").select(F.col("domain").cast("string").alias("domain"), "text")

    def count(batches):
        held: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            domains = np.array(batch.column("domain").to_pylist(), dtype=object)
            for piece in lexed(batch.column("text")):
                own = domains[piece.rows.start:piece.rows.stop]
                doc, word, _ = distinct_words(piece)
                for name in set(own.tolist()):
                    mine = own == name
                    counts = np.bincount(_features(word[mine[doc]]), minlength=FEATURES)
                    held[name] = held.get(name, 0) + counts
                    docs[name] = docs.get(name, 0) + int(mine.sum())
        for name, counts in held.items():
            yield pa.record_batch({"domain": [name], "docs": [docs[name]], "payload": [packed(counts.astype(np.int64))]})

    def add(key, table):
        total = sum(unpacked(p.as_py())[0] for p in table["payload"])
        return pa.table({"domain": [key[0].as_py()], "docs": [sum(table["docs"].to_pylist())], "payload": [packed(total)]})

    schema = "domain string, docs long, payload binary"
    # Eight groups a domain first, so that no task adds up what all tasks sent.
    parts = rows.mapInArrow(count, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(8)))
    added = parts.groupBy("domain", "salt").applyInArrow(add, schema).groupBy("domain").applyInArrow(add, schema).collect()
    found = sorted((r["domain"], r["docs"], unpacked(r["payload"])[0]) for r in added) if added else []
    if not found:
        return Domains([], np.zeros((FEATURES, 0)), np.zeros(0))
    counts = np.stack([f[2] for f in found], axis=1) + 0.5
    docs = np.array([f[1] for f in found], dtype=float)
    return Domains([f[0] for f in found], np.log(counts / counts.sum(axis=0)), np.log(docs / docs.sum()))


def _shares(texts: pa.Array, domains: Domains) -> Iterator[np.ndarray]:
    """Chance of every domain for each text, some texts at a time."""
    for piece in lexed(texts):
        doc, word, _ = distinct_words(piece)
        yield domains.shares(doc, _features(word), len(piece.rows))


def memberships(docs: DataFrame, domains: Domains) -> DataFrame:
    """``row, n_tokens, shares`` for every row of ``docs``; tokens are words."""
    n_domains = len(domains.names)

    def judge(batches):
        for batch in batches:
            shares, sizes = [np.zeros((0, n_domains)), *_shares(batch.column("text"), domains)], [np.zeros(0, dtype=np.int64)]
            for piece in lexed(batch.column("text")):
                sizes.append(np.bincount(piece.doc, minlength=len(piece.rows)))
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), pa.array(np.concatenate(sizes)),
                pa.array(list(np.concatenate(shares)), pa.list_(pa.float64()))], names=["row", "n_tokens", "shares"])

    rows = docs.select(F.col("doc_id").cast("long").alias("row"), "text")
    return rows.mapInArrow(judge, "row long, n_tokens long, shares array<double>")


def rates_of(shares: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after ``steps`` from one: each is taken along the shares and cut at zero."""
    rate = np.ones(len(shares))
    for step in steps:
        rate = np.maximum(0.0, rate + shares @ step)
    return rate


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.array(column.flatten()).reshape(-1, width) if len(column) else np.zeros((0, width))


def _totals(members: DataFrame, steps: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of every domain, and their change by a step, at the rates after ``steps``."""
    def add(batches):
        total, curve = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            shares, tokens = _matrix(batch.column("shares"), k), batch.column("n_tokens").to_numpy()
            rate = rates_of(shares, steps)
            total += (rate * tokens) @ shares
            curve += (shares * (tokens * (rate > 0))[:, None]).T @ shares
        yield pa.record_batch({"key": pa.array(range(k + k * k), pa.int32()), "value": [*total, *curve.ravel()]})

    sums = members.select("n_tokens", "shares").mapInArrow(add, "key int, value double").groupBy("key").agg(F.sum("value").alias("value"))
    found = np.zeros(k + k * k)
    for r in sums.collect():
        found[r["key"]] = r["value"]
    return found[:k], found[k:].reshape(k, k)


class Fit(NamedTuple):
    """Steps that lead to the rates, and the fewest copies of a document."""

    steps: list[np.ndarray]
    least: int


def fit_rates(members: DataFrame, names: list[str], weights: Mapping[str, float], total: float | None = None) -> Fit:
    """Steps whose rates bring every domain with a weight to its part of ``total`` tokens.

    Without ``total``, the least total is taken for which no domain has to shrink, and every document stays at least
    once: the rates of a domain that has its part already are a little below one, for what documents of
    other domains add to it, but its copies are not. A domain that ``weights`` does not name is not mixed: its
    tokens have no target, and no step moves along it. A weight of zero asks for none of a domain and needs a total. A
    domain that no document belongs to cannot be reached and is left out. ``ValueError`` when the targets
    are not met after ``STEPS`` steps.
    """
    k, least = len(names), 1 if total is None else 0
    if not k:
        return Fit([], least)
    have, _ = _totals(members, [], k)
    mixed = np.array([n in weights for n in names]) & (have > 0)
    weight = np.array([max(0.0, float(weights.get(n, 0.0))) for n in names]) * mixed
    if not weight.sum():
        return Fit([], least)
    if total is None and (weight[mixed] == 0).any():
        raise ValueError("a weight of zero needs a total: without one no document is dropped")
    weight = weight / weight.sum()
    goal = float((have[weight > 0] / weight[weight > 0]).max()) if total is None else float(total)
    steps, scale, last = [], 1.0, np.inf
    for _ in range(STEPS + 1):
        now, curve = _totals(members, steps, k)
        left = np.where(mixed, weight * goal - now, 0.0)
        error = np.abs(left).max() / goal
        if error < ERROR:
            return Fit(steps, least)
        # The cut at zero can make a step too long; after a good one the next may be longer again.
        scale = scale / 2 if error > last else min(1.0, 1.5 * scale)
        last = error
        # The gradient in the metric of the curvature; the ridge bounds steps along unseen directions.
        way = np.zeros(k)
        way[mixed] = scale * np.linalg.solve(curve[np.ix_(mixed, mixed)] + 1e-9 * goal * np.eye(int(mixed.sum())), left[mixed])
        steps.append(way)
    raise ValueError(f"the targets are not met: after {STEPS} steps a domain is off by {error:.2g} of the total")


def mixture(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float], domain: str = "lang", total: float | None = None) -> DataFrame:
    """``doc_id, n_tokens, shares, rate, copies`` for every row of ``docs``.

    ``labels`` names the documents (by doc_id) whose column ``domain`` is trusted; the classifier is
    fitted to at most ``LABELLED`` of these. ``copies`` is the rate rounded up or down by a hash of the id, so
    that its expectation is the rate; what it means for targets and totals is told in ``fit_rates``. Null texts have no tokens and the prior as
    shares; a null domain is not used. Repeated rows are rows of their own. Without
    labelled documents, or without a weight for any domain, every rate is one.
    """
    domains, members, fit = _fitted(docs, labels, weights, domain, total)
    k = len(domains.names)

    def rate(batches):
        for batch in batches:
            own = rates_of(_matrix(batch.column("shares"), k), fit.steps) if k else np.ones(batch.num_rows)
            yield batch.append_column("rate", pa.array(own)).append_column("copies", _copies(own, batch.column("chance"), fit.least))

    rated = members.withColumn("chance", _chance("row")).mapInArrow(
        rate, "row long, n_tokens long, shares array<double>, chance double, rate double, copies int")
    return rated.select(F.col("row").alias("doc_id"), "n_tokens", "shares", "rate", "copies")


def _chance(name: str) -> Column:
    """A number from 0 up to 1 that a row's id decides."""
    return F.pmod(F.xxhash64(F.col(f"`{name}`").cast("long"), F.lit(9)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _copies(rate: np.ndarray, chance: pa.Array, least: int) -> pa.Array:
    # A thousandth is added so that a rate of one that is a rounding error short stays one.
    copies = np.floor(rate + np.maximum(chance.to_numpy(zero_copy_only=False), 1e-3)).astype(np.int32)
    return pa.array(np.maximum(copies, least))


def _fitted(docs, labels, weights, domain, total) -> tuple[Domains, DataFrame, Fit]:
    need(docs, "doc_id", "text", domain)
    need(labels, "doc_id")
    ids = labels.select(F.col("doc_id").cast("long").alias("labelled")).filter("labelled IS NOT NULL").distinct()
    # At most LABELLED ids, so this is broadcast by right and no text moves.
    known = F.broadcast(ids.orderBy(F.xxhash64("labelled", F.lit(11)), "labelled").limit(LABELLED))
    rows = docs.select(F.col("doc_id").cast("long").alias("row"), "text", F.col(f"`{domain}`").alias("domain"))
    domains = fit_domains(rows.join(known, F.col("row") == F.col("labelled"), "left_semi"))
    members = written(memberships(docs, domains))
    return domains, members, fit_rates(members, domains.names, weights, total)


def mixed(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float], domain: str = "lang", total: float | None = None) -> DataFrame:
    """``docs`` with every row as often as its copies say; columns are those of ``docs``.

    Copies are those of ``mixture``. They are made in the task that reads the row; rows do not move.
    """
    domains, _, fit = _fitted(docs, labels, weights, domain, total)
    k, name, columns = len(domains.names), free_name(docs, "mixed_chance"), docs.columns

    def repeat(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # a row may come back many times
                part = batch.slice(at, 256)
                shares = np.concatenate([np.zeros((0, k)), *_shares(part.column("text"), domains)]) if k else None
                own = rates_of(shares, fit.steps) if k else np.ones(part.num_rows)
                copies = _copies(own, part.column(name), fit.least).to_numpy()
                rows = np.repeat(np.arange(part.num_rows), copies)
                for first in range(0, len(rows), 1024):
                    yield part.take(pa.array(rows[first:first + 1024])).select(columns)

    return docs.withColumn(name, _chance("doc_id")).mapInArrow(repeat, docs.schema)
