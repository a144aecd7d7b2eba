"""Mix documents to target weights of soft domains.

A classifier fitted on a table of labels gives every document a posterior over the domains. The
documents' rates, how often each is to be used, are nonnegative and fitted by least squares: the
expected tokens of each domain, summed over all documents, are to meet the domain's share of a total,
while rates stay near a common one. Each Newton step needs a few sums per domain
over all documents, which is a job with a partial sum in every task; a rate follows from the
document's own posterior and the domains' residuals, so no state is kept or shuffled.

The classifier is naive Bayes over hashed words, whose counts are summed by a shuffle into a table of
fixed size. Its mean log-likelihood per word, and the word that says most for each domain, are turned
into probabilities by a small multinomial regression on labelled documents held back for it. Both
use a bounded sample of the labels.

Defined results: a null or empty text has no words, the domains' prior as posterior, and rate 1 for
lack of any effect. A document labelled several times counts once for each label; a null id matches
no label; a null or unknown label teaches nothing. Repeated rows are rated alike and each count. A
domain without tokens cannot be met and the others come out as near as rates allow. Without labelled
rows posteriors are uniform. An empty table gives an empty result.
"""

import warnings
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.session import settle

from ._frames import shared_value, small_batches, trimmed
from ._text import ALPHANUMERIC, PART, SPACED, chunks, find_words, word_hashes

#: Hashed words the classifier tells apart.
FEATURES = 1 << 16


class Classifier(NamedTuple):
    """What a word says of each domain (see ``evidence``), then weights and offsets over a text's scores."""

    words: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray


def evidence(counts: np.ndarray, shrink: float = 10.0) -> np.ndarray:
    """For each word, from its counts by domain: log probabilities, and log shares over the domains' own.

    The shares lean on ``shrink`` imagined words, so that rare words say little.
    """
    sums = counts.sum(axis=0)
    likely = np.log(counts + 0.5) - np.log(sums + 0.5 * len(counts))
    prior = (sums + 1) / (sums + 1).sum()
    share = (counts + shrink * prior) / (counts.sum(axis=1, keepdims=True) + shrink)
    return np.hstack([likely, np.log(share / prior)])


def _features(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed lower-cased words, text by text, and where each text's begin. Runs of signs count as words too."""
    words = find_words(column, SPACED, lower=True)
    plain = find_words(column, ALPHANUMERIC, lower=True)
    text = np.concatenate([np.repeat(np.arange(len(column)), w.counts()) for w in (words, plain)])
    found = np.concatenate([word_hashes(words), word_hashes(plain, 1)])
    order = np.argsort(text, kind="stable")
    return (found[order] % np.uint64(FEATURES)).astype(np.int64), np.concatenate([[0], np.cumsum(words.counts() + plain.counts())])


def text_scores(column: pa.ChunkedArray, words: np.ndarray) -> np.ndarray:
    """Mean log-likelihood per word by domain, less their mean, and each domain's strongest word; 0 without words."""
    features, first = _features(column)
    domains = words.shape[1] // 2
    out = np.zeros((len(column), 2 * domains))
    some = np.flatnonzero(np.diff(first))
    if len(some):
        for k in range(2 * domains):
            fold = np.add if k < domains else np.maximum
            out[some, k] = fold.reduceat(words[features, k], first[some])
        out[some, :domains] /= np.diff(first)[some, None]
        out[:, :domains] -= out[:, :domains].mean(axis=1, keepdims=True)
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def regression(scores: np.ndarray, domain: np.ndarray, domains: int, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of a multinomial regression, fitted on standardised scores."""
    middle, spread = scores.mean(axis=0), scores.std(axis=0) + 1e-9
    x, y = (scores - middle) / spread, np.eye(domains)[domain]
    w, b = np.zeros((x.shape[1], domains)), np.zeros(domains)
    step = 1.0 / max(1, x.shape[1])  # no curvature exceeds half the number of standardised scores
    for _ in range(rounds):
        gap = y - softmax(x @ w + b)
        w += step * (x.T @ gap / len(x) - 1e-3 * w)
        b += step * gap.mean(axis=0)
    w = w / spread[:, None]
    return w, b - middle @ w


def train(
    docs: DataFrame,
    labels: DataFrame,
    domains: list[str],
    domain: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    labelled: int = 20_000,
) -> Classifier:
    """Fit on documents joined with ``labels``; ``domain`` is an expression over the labels' columns.

    At most about ``labelled`` rows of the labels are used, chosen by a hash; that bounds what is
    broadcast to find their documents. A quarter of them calibrates, the rest counts words.
    """
    small_batches(docs.sparkSession)
    number = F.create_map(*[F.lit(x) for k, d in enumerate(domains) for x in (d, k)])
    known = labels.select(F.col(label_id).alias("id"), number[domain].alias("domain")).where("id is not null and domain is not null")
    n = known.count()
    share = min(1.0, labelled / n) if n else 1.0
    place = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1_000_000))
    known = known.where(place < share * 1_000_000).withColumn("calibrates", place % 4 == 0)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    rows = settle(rows.select("domain", "calibrates", "text"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(domains), FEATURES), np.int64)
        for table in chunks(batches, "text", PART):
            features, first = _features(table["text"])
            own = np.repeat(table["domain"].to_numpy().astype(np.int64), np.diff(first))
            total += np.bincount(own * FEATURES + features, minlength=total.size).reshape(total.shape)
        d, f = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"domain": pa.array(d, pa.int32()), "feature": pa.array(f, pa.int32()), "n": total[d, f]})

    counted = rows.where("not calibrates").select("domain", "text").mapInArrow(trimmed(count), "domain int, feature int, n bigint")
    found = counted.groupBy("domain", "feature").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((FEATURES, len(domains)))
    total[found["feature"].to_numpy(), found["domain"].to_numpy()] = found["n"].to_numpy()
    words = evidence(total)
    shared = shared_value(docs.sparkSession, words)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared()
        for table in chunks(batches, "text", PART):
            found = text_scores(table["text"], known)
            yield pa.RecordBatch.from_pydict({"domain": pa.array(table["domain"].to_numpy(), pa.int32()), "scores": pa.array(list(found), pa.list_(pa.float64()))})

    scored = rows.where("calibrates").select("domain", "text").mapInArrow(trimmed(score), "domain int, scores array<double>").toArrow()
    if not scored.num_rows:
        return Classifier(words, np.zeros((2 * len(domains), len(domains))), np.zeros(len(domains)))
    x, y = np.array(scored["scores"].to_pylist()), scored["domain"].to_numpy()
    order = np.lexsort((*x.T, y))  # whatever the order rows arrive in
    return Classifier(words, *regression(x[order], y[order], len(domains)))


def posteriors(
    docs: DataFrame,
    model: Classifier,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[Column, ...] = (),
    keep_text: bool = False,
) -> DataFrame:
    """``id``, the columns of ``keep``, ``text`` if wanted, ``n_tokens`` (words) and ``posterior`` (by domain) of every row."""
    small_batches(docs.sparkSession)
    shared = shared_value(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared()
        for table in chunks(batches, "text", PART):
            column = table["text"]
            p = softmax(text_scores(column, found.words) @ found.weights + found.offsets)
            done = table if keep_text else table.drop_columns("text")
            done = done.append_column("n_tokens", pa.array(find_words(column, SPACED).counts()))
            yield from done.append_column("posterior", pa.array(list(p), pa.list_(pa.float64()))).to_batches()

    rows = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text"))
    kinds = [f"{name} {kind}" for name, kind in rows.dtypes if keep_text or name != "text"]
    return rows.mapInArrow(trimmed(run), ", ".join([*kinds, "n_tokens bigint", "posterior array<double>"]))


class Fit(NamedTuple):
    """What gives every document's rate: pull to ``base``, and each domain's scaled residual; and how near it came.

    ``targets`` and ``reached`` are the domains' expected tokens; ``gap`` bounds the projected gradient per token.
    """

    pull: float
    base: float
    residual: np.ndarray
    targets: np.ndarray
    reached: np.ndarray
    gap: float

    def shares(self) -> tuple[np.ndarray, np.ndarray]:
        """The shares of tokens that were wanted, and those reached."""
        return tuple(x / max(x.sum(), 1e-300) for x in (self.targets, self.reached))

    def rates(self, posterior: np.ndarray, n_tokens: np.ndarray) -> np.ndarray:
        return np.where(n_tokens > 0, np.maximum(0, self.base - posterior @ self.residual / self.pull), 1.0)


#: Parts of a Newton step that are tried in one job.
PARTS = 0.5 ** np.arange(8)


def measured(scored: DataFrame, k: int, base: float, pull: float, points: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For rates at each of the points (residuals): half their squares, the domains' tokens, and how these change.

    One job with a partial sum in every task.
    """
    width = 1 + k + k * k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(points), width))
        for batch in batches:
            if batch.num_rows:
                p = pc.list_flatten(batch.column("posterior")).to_numpy().reshape(batch.num_rows, -1)
                n = batch.column("n_tokens").to_numpy()
                for own, point in zip(out, points):
                    rate = np.maximum(0, base - p @ point / pull)
                    used = p[rate > 0]
                    own += np.concatenate([[(n * rate * rate).sum() / 2], (rate * n) @ p, ((used * n[rate > 0, None]).T @ used).ravel()])
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(out.size), pa.int32()), "x": out.ravel()})

    sums = scored.select("n_tokens", "posterior").mapInArrow(run, "place int, x double")
    out = np.zeros(len(points) * width)
    for place, x in sums.groupBy("place").agg(F.sum("x")).collect():
        out[place] = x
    return [(row[0], row[1 : 1 + k], row[1 + k :].reshape(k, k)) for row in out.reshape(len(points), -1)]


def fit_rates(
    scored: DataFrame, weights: list[float], total: float | None = None, pull: float = 1e-4, most: int = 60, tolerance: float = 1e-5
) -> Fit:
    """Rates that bring domains' expected tokens to ``weights`` of ``total``.

    Minimises the squared distances of the domains' token totals from their targets, each over the
    tokens the domain holds, plus ``pull`` (more than 0) times the squared distances of all tokens' rates
    from the common one. At the least a rate is the common one less the posterior times the residuals
    over ``pull``, cut off at zero, so the residuals alone are unknown: one number a domain, the least of
    a convex function made of quadratic pieces. Newton steps find it, each a job that tries parts of the
    step; their number follows the pieces, not the targets. Ends when the projected gradient per token is at most
    ``tolerance`` everywhere; a fit that does not come there in ``most`` steps is reported by a warning
    and by its ``gap``. ``total``: tokens to reach; by default as many as the domain with the least tokens
    for its weight allows without repeating any.
    """
    if pull <= 0:
        raise ValueError("pull has to be more than 0")
    shares = np.array(weights, float) / sum(weights)
    k = len(shares)
    sums = [F.sum(F.col("n_tokens") * F.element_at("posterior", d + 1)) for d in range(k)]
    held = np.array([x or 0.0 for x in scored.agg(*sums).first()])
    there = held.sum()
    if not there:
        return Fit(pull, 1.0, np.zeros(k), np.zeros(k), np.zeros(k), 0.0)
    if total is None:
        can = (held / np.where(shares > 0, shares, 1))[(shares > 0) & (held > 0)]
        total = float(can.min()) if len(can) else there
    base, targets = total / there, shares * total
    scale, wanted = np.where(held > 0, held, there), np.where(held > 0, targets, 0)
    points, at, least = np.zeros((1, k)), np.zeros(k), np.inf
    for step in range(most + 1):
        found = measured(scored, k, base, pull, points)
        values = [float(scale @ x**2 / 2 + wanted @ x + pull * half) for x, (half, _, _) in zip(points, found)]
        gaps = [float(np.abs(x + (wanted - got) / scale).max()) for x, (_, got, _) in zip(points, found)]
        best = int(np.argmin(gaps if min(gaps) <= tolerance else values))
        if gaps[best] <= tolerance or values[best] < least:
            at, least, gap, (_, reached, change) = points[best], values[best], gaps[best], found[best]
            part = PARTS
        else:
            part = part * PARTS[-1] / 2  # shorter ones than any tried
        if gap <= tolerance:
            break
        slope = scale * at + wanted - reached
        points = at - part[:, None] * np.linalg.solve(np.diag(scale) + change / pull, slope)
    fit = Fit(pull, base, at, targets, reached, gap)
    if gap > tolerance:
        warnings.warn(f"rates are off their optimum by {gap:.2g} after {step} steps: shares {fit.shares()[1]} for {fit.shares()[0]}", stacklevel=2)
    return fit


def rated(scored: DataFrame, fit: Fit) -> DataFrame:
    """``scored`` with each row's ``rate``."""
    kinds = ", ".join(f"{name} {kind}" for name, kind in scored.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            p = pc.list_flatten(batch.column("posterior")).to_numpy().reshape(batch.num_rows, -1)
            rate = fit.rates(p, batch.column("n_tokens").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], [*batch.schema.names, "rate"])

    return scored.mapInArrow(run, f"{kinds}, rate double")


def mix(
    docs: DataFrame,
    labels: DataFrame,
    weights: dict[str, float],
    domain: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    total: float | None = None,
    keep: tuple[Column, ...] = (),
    keep_text: bool = False,
) -> DataFrame:
    """``id_col``, the columns of ``keep``, ``text`` if wanted, ``n_tokens``, ``posterior`` (in ``weights``'s order) and ``rate``."""
    model = train(docs, labels, list(weights), domain, id_col, text_col)
    scored = settle(posteriors(docs, model, id_col, text_col, keep, keep_text), "domains")
    return rated(scored, fit_rates(scored, list(weights.values()), total)).withColumnRenamed("id", id_col)


def copies(rate: Column, *key: Column) -> Column:
    """How often a document of that rate is used: its whole part, and once more with the chance of the rest, by a hash."""
    chance = F.pmod(F.xxhash64(*key, F.lit("copies")), F.lit(1_000_000)) / 1_000_000
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("int")
