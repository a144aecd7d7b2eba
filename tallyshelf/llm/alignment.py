"""Alignment of two tokenizers by byte offsets, in windows between whitespace-token anchors.

Texts are tokenised whole by both libraries, and it is verified that the bytes of either one's tokens join
to the text. Where a space-marked token of A and one of B begin at one byte, the tokens before them share an
end: an anchor. Anchors split a document into windows, which repeat far more often than documents
do. A window is aligned once, as a tuple of token ids, and its result is remembered; the windows of a chunk
are told apart by one dictionary encoding.

Tokens that end at one byte are linked. As the bytes of one of them then end in those of the other, a
pair is a token and one of the suffixes of its bytes: there are at most as many pairs as the tokens of both
vocabularies have bytes, whatever the corpus. So the corpus-wide counts of pairs, added up from one partial
count a task, are broadcast: their size is bounded by the vocabularies.

Defined results: a null or empty text, and one that a tokenizer does not give back byte by byte (B
turns U+2581 into a space), has no tokens: zeros and no groups. Rows are aligned one by one and each
counts, so a repeated row counts again; null ids are kept; other columns are not looked at.
"""

import json
from collections.abc import Iterable, Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.session import settle

from ._frames import id_type, shared_value, small_batches
from ._text import chunks

#: Bytes of text tokenised at a time, and of remembered windows before a task starts anew.
CHUNK, REMEMBERED = 1 << 20, 32 << 20


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1
    characters for themselves, the other bytes in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Vocabulary(NamedTuple):
    """Each token's bytes, their number, and whether they begin with a space."""

    tokens: list[bytes]
    lengths: np.ndarray
    spaced: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> "Vocabulary":
        return cls(tokens, np.array([len(t) for t in tokens], np.int64), np.array([t.startswith(b" ") for t in tokens], bool))


class ByteTokenizer:
    """A: a byte-level tokenizer file; strings of special tokens in a text are plain text.

    In such a file ids follow the order of the merges, so the vocabulary is a table of ranks, which the
    rank library encodes with to the same ids in a third of the time; a file without that order is refused.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        model, added = given["model"], {t["content"] for t in given["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"]["".join(m)] for m in merges]
        if given["normalizer"] or given["pre_tokenizer"]["type"] != "ByteLevel" or made != sorted(made):
            raise ValueError(f"{path} is not a plain byte-level vocabulary in order of its merges")
        alphabet = byte_alphabet()
        self.ranks = {bytes(alphabet[c] for c in t): k for t, k in model["vocab"].items() if t not in added}
        self.tool = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.tool.encode_ordinary(" " + text) for text in texts]

    def vocabulary(self) -> Vocabulary:
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, k in self.ranks.items():
            tokens[k] = token
        return Vocabulary.of(tokens)


class PieceTokenizer:
    """B: a piece model with byte fallback, which puts a space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.tool = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.tool.encode(texts, num_threads=1)

    def vocabulary(self) -> Vocabulary:
        pieces = [self.tool.id_to_piece(k) for k in range(self.tool.get_piece_size())]
        byte = self.tool.is_byte(list(range(len(pieces))))
        return Vocabulary.of([bytes([int(p[3:5], 16)]) if b else p.replace("▁", " ").encode() for p, b in zip(pieces, byte)])


class Aligned(NamedTuple):
    """Per text: tokens of A and B, groups and links, digests of the groups, and the links' pair codes."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    digests: list[str]
    links: list[bytes]


class Aligner:
    """Aligns texts; remembers windows by their token ids."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        self.of_a, self.of_b = a.vocabulary(), b.vocabulary()
        self.names = pa.array([str(k) for k in range(max(len(self.of_a.tokens), len(self.of_b.tokens)))])
        self.known: dict[bytes, tuple[str, int, bytes]] = {}
        self.size = 0

    def align_windows(self, keys: list[bytes]) -> Iterator[tuple[str, int, bytes]]:
        """Of each window: groups as text, their number, and the codes a * |B| + b of the links.

        Both sides of a window have the same bytes, so many windows are aligned in a row as one.
        """
        sizes = np.array([len(key) // 4 for key in keys])
        packed = np.frombuffer(b"".join(keys), "<i4")
        starts = np.cumsum(sizes) - sizes
        n_a = packed[starts]
        place = np.arange(len(packed)) - np.repeat(starts, sizes)
        of_b = place > np.repeat(n_a, sizes)
        a, b = packed[(place > 0) & ~of_b], packed[of_b]
        a_ends, b_ends = np.cumsum(self.of_a.lengths[a]), np.cumsum(self.of_b.lengths[b])
        at = np.searchsorted(b_ends, a_ends)
        i = np.flatnonzero(b_ends[at] == a_ends)
        j = at[i]
        sides = []
        for ids, last in ((a, i), (b, j)):
            listed = pa.ListArray.from_arrays(pa.array(np.append(0, last + 1), pa.int32()), self.names.take(pa.array(ids)))
            sides.append(pc.binary_join(listed, ","))
        groups = pc.binary_join_element_wise(*sides, "|")
        edges = np.append(0, np.searchsorted(i, np.cumsum(n_a) - 1, "right"))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), groups), ";").to_pylist()
        links = (a[i].astype(np.int64) * len(self.of_b.tokens) + b[j]).astype("<u4").tobytes()
        for text, start, end in zip(texts, edges[:-1].tolist(), edges[1:].tolist()):
            yield text, end - start, links[4 * start : 4 * end]

    def windows(self, keys: list[bytes]) -> tuple[pa.Array, np.ndarray, pa.Array]:
        if self.size > REMEMBERED:
            self.known, self.size = {}, 0
        new = [key for key in keys if key not in self.known]
        if new:
            for key, own in zip(new, self.align_windows(new)):
                self.known[key] = own
                self.size += len(key) + len(own[0]) + len(own[2]) + 200
        texts, counts, links = zip(*map(self.known.__getitem__, keys))
        return pa.array(texts, pa.string()), np.array(counts, np.int64), pa.array(links, pa.binary())

    def align(self, texts: list[str | None]) -> Aligned:
        some = [k for k, text in enumerate(texts) if text]
        given = [texts[k] for k in some]
        of_a, of_b = (t.encode(given) if given else [] for t in (self.a, self.b))
        good = []
        for k, text, x, y in zip(some, given, of_a, of_b):
            whole = b" " + text.encode()
            if b"".join(map(self.of_a.tokens.__getitem__, x)) == whole == b"".join(map(self.of_b.tokens.__getitem__, y)):
                good.append((k, x, y))
        n = len(texts)
        out = Aligned(np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [""] * n, [b""] * n)
        if not good:
            return out
        rows = np.array([k for k, _, _ in good])
        a, b = (np.array([i for g in good for i in g[side]], np.int64) for side in (1, 2))
        out.n_a[rows], out.n_b[rows] = ([len(g[side]) for g in good] for side in (1, 2))
        a_ends, b_ends = np.cumsum(self.of_a.lengths[a]), np.cumsum(self.of_b.lengths[b])
        a_starts, b_starts = a_ends - self.of_a.lengths[a], b_ends - self.of_b.lengths[b]
        anchors = np.intersect1d(a_starts[self.of_a.spaced[a]], b_starts[self.of_b.spaced[b]], assume_unique=True)
        firsts = a_starts[np.cumsum(out.n_a[rows]) - out.n_a[rows]]
        anchors = np.union1d(anchors, firsts)  # a text's first tokens begin with the space before it
        a_at = np.append(np.searchsorted(a_starts, anchors), len(a))
        b_at = np.append(np.searchsorted(b_starts, anchors), len(b))
        keys = self.window_keys(a, b, a_at, b_at)
        coded = keys.dictionary_encode()
        code = coded.indices.to_numpy()
        texts_of, groups_of, links_of = self.windows(coded.dictionary.to_pylist())
        edges = np.append(np.searchsorted(anchors, firsts), len(anchors))
        listed = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), texts_of.take(coded.indices))
        sums = np.concatenate([[0], np.cumsum(groups_of[code])])
        out.n_groups[rows] = np.diff(sums[edges])
        joined = pc.binary_join(listed, ";").to_pylist()
        flat = links_of.take(coded.indices)
        ends = np.frombuffer(flat.buffers()[1], "<i4")[: len(flat) + 1][edges]
        data = flat.buffers()[2].to_pybytes() if flat.buffers()[2] else b""
        for k, text, start, end in zip(rows.tolist(), joined, ends[:-1].tolist(), ends[1:].tolist()):
            out.digests[k] = sha256(text.encode()).hexdigest()
            out.links[k] = data[start:end]
        return out

    @staticmethod
    def window_keys(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> pa.Array:
        """One binary value per window: how many ids of A, those, and those of B."""
        n_a, n_b = np.diff(a_at), np.diff(b_at)
        ends = np.cumsum(1 + n_a + n_b)
        starts = ends - (1 + n_a + n_b)
        packed = np.empty(int(ends[-1]), "<i4")
        packed[starts] = n_a
        packed[np.arange(len(a)) + np.repeat(starts + 1 - a_at[:-1], n_a)] = a
        packed[np.arange(len(b)) + np.repeat(starts + 1 + n_a - b_at[:-1], n_b)] = b
        offsets = np.append(starts, ends[-1]) * 4
        parts = [None, pa.py_buffer(offsets.astype("<i4").tobytes()), pa.py_buffer(packed.tobytes())]
        return pa.Array.from_buffers(pa.binary(), len(starts), parts)


class Counts(NamedTuple):
    """Corpus-wide counts of linked pairs, by code, and the highest of each id of B."""

    codes: np.ndarray
    counts: np.ndarray
    best: np.ndarray


def pair_counts(aligned: DataFrame, size_b: int) -> Counts:
    """Add up the links of all texts; as many rows as there are pairs, which the vocabularies bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            new = np.concatenate([np.frombuffer(x, "<u4") for x in batch.column("links").to_pylist()]).astype(np.int64)
            own, n = np.unique(new, return_counts=True)
            codes, at = np.unique(np.concatenate([codes, own]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(codes)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["code", "n"])

    parts = aligned.select("links").mapInArrow(run, "code bigint, n bigint")
    found = parts.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    codes, counts = (found[c].to_numpy() for c in ("code", "n"))
    order = np.argsort(codes)
    codes, counts = codes[order].astype(np.int64), counts[order].astype(np.int64)
    best = np.zeros(size_b, np.int64)
    np.maximum.at(best, codes % size_b, counts)
    return Counts(codes, counts, best)


def aligned_texts(docs: DataFrame, path_a: str, pattern: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``n_a``, ``n_b``, ``n_groups``, ``groups_sha256`` and ``links`` (pair codes, packed) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(ByteTokenizer(path_a, pattern), PieceTokenizer(path_b))
        for table in chunks(batches, "text", CHUNK):
            done = aligner.align(table["text"].to_pylist())
            ids = table["id"].combine_chunks() if table.num_rows else pa.array([], table["id"].type)
            columns = [ids, *map(pa.array, done[:3]), pa.array(done.digests, pa.string()), pa.array(done.links, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    kind = id_type(docs, id_col)
    return rows.mapInArrow(run, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links binary")


def align(docs: DataFrame, path_a: str, pattern: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts by the byte-level file ``path_a``, split by ``pattern``, and the piece model ``path_b``.

    Per row: ``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair is the commonest
    of its id of B, ties included), ``count_sum`` (of the links' pairs), ``groups_sha256``."""
    spark = docs.sparkSession
    small_batches(spark)
    size_b = len(PieceTokenizer(path_b).vocabulary().tokens)
    if len(ByteTokenizer(path_a, pattern).vocabulary().tokens) * size_b > 2**32:
        raise ValueError("pairs of these vocabularies need more than 32 bits")
    aligned = settle(aligned_texts(docs, path_a, pattern, path_b, id_col, text_col), "aligned")
    shared = shared_value(spark, pair_counts(aligned, size_b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = shared()
        for batch in batches:
            links = [np.frombuffer(x, "<u4") for x in batch.column("links").to_pylist()]
            sizes = np.array([len(x) for x in links], np.int64)
            every = np.concatenate([np.zeros(0, "<u4"), *links]).astype(np.int64)
            held = counts[np.searchsorted(codes, every)] if len(every) else every
            edges = np.concatenate([[0], np.cumsum(sizes)])
            found = [np.diff(np.concatenate([[0], np.cumsum(x)])[edges]) for x in (held == best[every % size_b], held)]
            rest = [batch.column(c) for c in ("id", "n_a", "n_b", "n_groups")]
            columns = [*rest, pa.array(sizes), *(pa.array(x.astype(np.int64)) for x in found), batch.column("groups_sha256")]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    kind = id_type(docs, id_col)
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    done = aligned.mapInArrow(run, f"id {kind}, {', '.join(f'{n} bigint' for n in names)}, groups_sha256 string")
    return done.withColumnRenamed("id", id_col)
