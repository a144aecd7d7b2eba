"""Personal data: fixed patterns, and a skip-chain conditional random field that adds to them.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers. Their spans stay. The
random field labels the tokens that could belong to such data (those with a digit or an ``@``) with a
kind or none. Its factors are

* the token's shape (digits, dots, signs, letters),
* the labels of tokens that follow one another (the chain), and
* the labels of distant tokens that are the same or nearly so (the skip edges): six or more letters
  and signs that are equal after case and surrounding punctuation are dropped, or the same six or
  more digits. Each mention is linked to the next one, and to the last one before it that lies in a
  pattern's span, or the first one after it, however far that is. So a text has at most four skip
  edges per token, and a held label reaches all mentions in one step.

Sum-product messages run over this loopy graph, for all texts of a chunk at once, until those of a
text move no more; tokens inside a pattern's span are held at its kind. A token whose marginal for a kind
reaches ``least`` becomes a span; so a number mentioned again in another form gets the label of
its first mention, while a token without such support stays as it is.

Weights are trained by pseudo-likelihood, with the patterns' labels as truth, on a sample of at most
about ``sample`` documents chosen by a hash. A token outside all spans counts as none, but for one
that repeats a token inside a span: its label is what the field is to decide, so it is left out. What a token contributes is its shape and its
neighbours' labels, all from small sets, so equal contributions are counted by a shuffle and the
driver gets a table whose size the shapes bound.

Defined results: a null or empty text has no spans. Offsets are code points, ends exclusive. Rows are
judged one by one, so ties, repeated rows, null ids and other columns change nothing. An empty table
is fine; a field trained on none adds nothing.
"""

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._frames import small_batches, trimmed
from ._text import PART, SPACED, chunks, find_words, text_bytes

KINDS = ("email", "ip", "card", "phone")
NONE, LABELS = len(KINDS), len(KINDS) + 1
#: Letters or digits that make a mention.
MENTION = 6
#: In contributions: no neighbour on that side.
ABSENT = LABELS

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")

SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
SPANS_SQL = "array<struct<kind: string, start: bigint, end: bigint, base: boolean>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches, by kind and then by start.

    An address is found from its ``@`` and read back to where its local part begins, which gives the
    leftmost match without trying every word of the text.
    """
    out, end = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((0, start, m.end()))
            end = m.end()
    for m in ADDRESS.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in NUMBER.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= len(DIGITS.findall(m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def shape(token: str) -> int:
    """A token's shape as a number below SHAPES."""
    digits, dots = len(DIGITS.findall(token)), min(token.count("."), 4)
    size = sum(digits >= n for n in (1, 4, 8, 12, 16, 20))
    out = size * 5 + dots
    for flag in ("@" in token, any(c.isalpha() for c in token), token[:1] == "+", "(" in token or ")" in token, "-" in token, "=" in token or ":" in token or "/" in token):
        out = 2 * out + flag
    return out


SHAPES = 7 * 5 * 2**6


def shape_features() -> np.ndarray:
    """The shapes as rows of 0 and 1: one, digits, dots, and the six flags."""
    n = np.arange(SHAPES)
    flags = n[:, None] >> np.arange(6) & 1
    rest = n >> 6
    return np.hstack([np.ones((SHAPES, 1)), np.eye(7)[rest // 5], np.eye(5)[rest % 5], flags])


class Graph(NamedTuple):
    """Tokens of some texts: shape, text, place, the pattern's label (ABSENT for none), and edges (first, second)."""

    shapes: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    held: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    #: Skip edges between a held mention and others that are not next to it; training leaves them out.
    hub: np.ndarray = np.zeros((0, 2), np.int64)


def hub_edges(mentions: list[list[int]], held: np.ndarray, skip: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each mention outside all spans, an edge with the last held one before it, or the first after it."""
    known, out = set(skip), []
    for own in mentions:
        fixed = [k for k in own if held[k] != ABSENT]
        for k in own if fixed else []:
            if held[k] == ABSENT:
                at = fixed[max(bisect_left(fixed, k) - 1, 0)]
                edge = (min(at, k), max(at, k))
                if edge not in known:
                    known.add(edge)
                    out.append(edge)
    return out


def graph_of(column: pa.ChunkedArray) -> tuple[Graph, list[list[tuple[int, int, int]]]]:
    """The random field's graph for a chunk of texts, and the patterns' spans of each."""
    words = find_words(column, SPACED)
    data = words.data
    bearing = ((data >= 0x30) & (data <= 0x39)) | (data == 0x40)
    before = np.concatenate([[0], np.cumsum(bearing)])
    token = np.flatnonzero(before[words.ends] > before[words.starts])
    letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    text = np.searchsorted(words.first, token, "right") - 1
    bounds = text_bytes(column)[1]
    start = letters[words.starts[token]] - letters[bounds[text]]
    end = letters[words.ends[token]] - letters[bounds[text]]
    strings = [data[a:z].tobytes().decode() for a, z in zip(words.starts[token].tolist(), words.ends[token].tolist())]
    spans: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
    held = np.full(len(token), ABSENT)
    skip, last, now, mentions = [], {}, -1, {}
    for t in np.unique(text).tolist():
        spans[t] = base_spans(column[t].as_py())
    firsts = np.searchsorted(text, np.arange(len(column) + 1))
    for t in np.unique(text).tolist():
        a, z = firsts[t], firsts[t + 1]
        for kind, s, e in reversed(spans[t]):
            i, j = a + np.searchsorted(end[a:z], s, "right"), a + np.searchsorted(start[a:z], e, "left")
            held[i:j] = kind
    for k, (t, string) in enumerate(zip(text.tolist(), strings)):
        if t != now:
            last, now = {}, t
        plain = string.lower().strip(".,;:!?()[]{}<>\"'")
        digits = "".join(DIGITS.findall(string))
        for key in [("same", plain)] * (len(plain) >= MENTION) + [("digits", digits)] * (len(digits) >= MENTION):
            if key in last and (not skip or skip[-1] != (last[key], k)):
                skip.append((last[key], k))
            last[key] = k
            mentions.setdefault((t, key), []).append(k)
    near = np.flatnonzero((token[1:] == token[:-1] + 1) & (text[1:] == text[:-1]))
    chain = np.stack([near, near + 1], axis=1)
    shapes = np.array([shape(s) for s in strings], np.int64)
    hub = hub_edges([own for own in mentions.values() if len(own) > 1], held, skip)
    return Graph(shapes, text, start, end, held, chain, *(np.array(x, np.int64).reshape(-1, 2) for x in (skip, hub))), spans


class Field(NamedTuple):
    """Log potentials: by feature and label, by labels of neighbours in the chain, and for equal labels of a skip edge."""

    token: np.ndarray
    chain: np.ndarray
    skip: float


#: Messages that would move by no more than that have settled.
STILL = 1e-8


def passed_on(belief: np.ndarray, back: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Messages of tokens of that belief over edges of that factor, without what came ``back`` over them."""
    out = (belief - back)[:, :, None] + factor
    most = out.max(axis=1)
    new = most + np.log(np.exp(out - most[:, None]).sum(axis=1))
    return new - new.max(axis=1, keepdims=True)


def marginals(graph: Graph, field: Field, rounds: int | None = None) -> np.ndarray:
    """Label probabilities of every token, by sum-product messages on the loopy graph.

    A text's messages run until none would move by more than STILL (or for ``rounds``, if given),
    whatever other texts do. Should they swing instead, and come no closer to rest in more rounds than the
    text has edges, their steps are halved; at an eighth of the first step the text is left as it is.
    """
    own = (shape_features() @ field.token)[graph.shapes]
    fixed = np.flatnonzero(graph.held != ABSENT)
    own[fixed] = -1e3
    own[fixed, graph.held[fixed]] = 0
    edges = np.concatenate([graph.chain, graph.skip, graph.hub])
    factors = np.stack([field.chain, field.skip * np.eye(LABELS)])
    which = (np.arange(len(edges)) >= len(graph.chain)).astype(int)
    text = graph.text[edges[:, 0]]
    texts = int(text.max()) + 1 if len(text) else 0
    patience = 100 + 4 * np.bincount(text, minlength=texts)
    best, since, step = np.full(texts, np.inf), np.zeros(texts, int), np.full(texts, 0.5)
    message = np.zeros((2, len(edges), LABELS))  # to the second token, to the first

    def beliefs(on: np.ndarray) -> np.ndarray:
        out = own.copy()
        np.add.at(out, edges[on, 1], message[0, on])
        np.add.at(out, edges[on, 0], message[1, on])
        return out

    on, done = np.arange(len(edges)), 0
    while len(on) and (rounds is None or done < rounds):
        done += 1
        belief, factor, old = beliefs(on), factors[which[on]], message[:, on]
        new = np.stack([passed_on(belief[edges[on, 0]], old[1], factor), passed_on(belief[edges[on, 1]], old[0], factor.transpose(0, 2, 1))])
        move = np.zeros(texts)
        np.maximum.at(move, text[on], np.abs(new - old).max(axis=(0, 2)))
        message[:, on] = old + step[text[on], None] * (new - old)
        closer = move < 0.9 * best
        best, since = np.where(closer, move, best), np.where(closer, 0, since + 1)
        stuck = since > patience
        step, since, best = np.where(stuck, step / 2, step), np.where(stuck, 0, since), np.where(stuck, np.inf, best)
        on = on[((move > STILL) & (step > 0.05))[text[on]]]
    belief = beliefs(np.arange(len(edges)))
    belief = np.exp(belief - belief.max(axis=1, keepdims=True))
    return belief / belief.sum(axis=1, keepdims=True)


#: What a token contributes to training, and where each part stands in a number.
PARTS = ("shape", "label", "left", "right", "earlier", "later")


def contributions(graph: Graph) -> np.ndarray:
    """One number per token: its shape and label, and its neighbours' labels in the chain and over skip edges."""
    label = np.where(graph.held == ABSENT, NONE, graph.held)
    sides = np.full((4, len(label)), ABSENT)
    for k, edges in ((0, graph.chain), (2, graph.skip)):
        sides[k, edges[:, 1]] = label[edges[:, 0]]
        sides[k + 1, edges[:, 0]] = label[edges[:, 1]]
    out = graph.shapes
    for part in (label, *sides):
        out = out * (ABSENT + 1) + part
    open_ = (label == NONE) & ((sides[2] < NONE) | (sides[3] < NONE))
    return out[~open_]


def fit(numbers: np.ndarray, counts: np.ndarray, rounds: int = 300, shrink: float = 1e-4) -> Field:
    """Weights of greatest pseudo-likelihood, by gradient steps of adapted length."""
    features = shape_features()
    parts = []
    for _ in range(5):
        parts.append(numbers % (ABSENT + 1))
        numbers = numbers // (ABSENT + 1)
    later, earlier, right, left, label = parts
    x, weight = features[numbers], counts / max(counts.sum(), 1)
    one = np.vstack([np.eye(LABELS), np.zeros(LABELS)])  # an absent neighbour has no part
    l, r, s = one[left], one[right], one[earlier] + one[later]
    size = features.shape[1] * LABELS
    at = np.zeros(size + LABELS * LABELS + 1)
    first, second = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, rounds + 1):
        token, chain, skip = at[:size].reshape(-1, LABELS), at[size:-1].reshape(LABELS, LABELS), at[-1]
        score = x @ token + l @ chain + r @ chain.T + skip * s
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        gap = (np.eye(LABELS)[label] - p) * weight[:, None]
        slope = np.concatenate([(x.T @ gap).ravel(), (l.T @ gap + (r.T @ gap).T).ravel(), [(gap * s).sum()]])
        slope -= shrink * at
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        at = at + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(at[:size].reshape(-1, LABELS), at[size:-1].reshape(LABELS, LABELS), max(0.0, float(at[-1])))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 5_000) -> Field:
    """Fit on at most about ``sample`` documents, with the patterns' labels as truth."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n = rows.count()
    chosen = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < min(1.0, sample / max(n, 1)) * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, "text", PART):
            numbers, counts = np.unique(contributions(graph_of(table["text"])[0]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"number": numbers, "n": counts})

    counted = chosen.select("text").mapInArrow(trimmed(run), "number bigint, n bigint").groupBy("number").agg(F.sum("n").alias("n"))
    found = sorted((r.number, r.n) for r in counted.collect())
    return fit(np.array([x for x, _ in found], np.int64), np.array([n for _, n in found], float))


def added_spans(graph: Graph, p: np.ndarray, least: float, strings) -> list[tuple[int, int, int, int]]:
    """(text, kind, start, end) of tokens the field labels beyond the patterns' spans."""
    best = p[:, :NONE].argmax(axis=1)
    hit = np.flatnonzero((graph.held == ABSENT) & (p[np.arange(len(p)), best] >= least))
    joined = {(int(a), int(b)) for a, b in graph.chain}
    out: list[list[int]] = []
    end = -2
    for k in hit.tolist():
        token = strings(int(graph.text[k]))[graph.start[k] : graph.end[k]]
        start = int(graph.start[k]) + len(token) - len(token.lstrip(".,;:!?[]{}<>\"'"))
        stop = int(graph.end[k]) - (len(token) - len(token.rstrip(".,;:!?[]{}<>\"'")))
        if out and (end, k) in joined and out[-1][0] == graph.text[k] and out[-1][1] == best[k]:
            out[-1][3] = stop
        else:
            out.append([int(graph.text[k]), int(best[k]), start, stop])
        end = k
    return [tuple(x) for x in out if x[2] < x[3]]


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of spans that overlap, replaced by the first one's kind."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_spans(
    docs: DataFrame,
    field: Field,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = 0.6,
    redact: bool = False,
    keep: tuple[Column, ...] = (),
) -> DataFrame:
    """``id_col``, the columns of ``keep``, ``spans`` (kind, start, end, base; by kind, then start)
    and with ``redact`` ``redacted``: the text with spans replaced; null for a null text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, "text", PART):
            column = table["text"]
            graph, base = graph_of(column)
            spans = [[(k, s, e, True) for k, s, e in own] for own in base]
            for t, kind, start, end in added_spans(graph, marginals(graph, field), least, lambda t: column[t].as_py()):
                spans[t].append((kind, start, end, False))
            for own in spans:
                own.sort()
            listed = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in own] for own in spans]
            done = table.drop_columns("text").append_column("spans", pa.array(listed, SPANS))
            if redact:
                texts = [redacted(x, [span[:3] for span in own]) if own else x for x, own in zip(column.to_pylist(), spans)]
                done = done.append_column("redacted", pa.array(texts, pa.string()))
            yield from done.to_batches()

    rows = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text"))
    kinds = [f"{name} {kind}" for name, kind in rows.dtypes if name != "text"]
    done = rows.mapInArrow(trimmed(run), ", ".join([*kinds, f"spans {SPANS_SQL}", *["redacted string"] * redact]))
    return done.withColumnRenamed("id", id_col)


def places(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
