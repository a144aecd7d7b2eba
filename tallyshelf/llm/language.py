"""Language identification by unigram pieces, with all segmentations of a word summed.

A language is a probability for each piece of a fixed public vocabulary. The probability of a word
is the sum, over all ways to cut it into pieces, of the product of their probabilities; a forward
recursion over the word's letters gives it. A text's score is the sum of the logarithms over its
words, for every language; with the languages' priors this becomes a posterior.

Training is expectation-maximisation: words of the labelled texts are counted per language by a
shuffle, each round computes the expected uses of every piece (forward and backward) where the
words lie, and only one number per piece and language comes back. The vocabulary bounds the model.
The labelled texts are a sample: at most about ``per_language`` of each language, chosen by a hash
of the id, or all where there are fewer.

A character outside the vocabulary is a piece of its own with the least probability in every
language. Words are runs of letters, lower-cased; all else is ignored.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Ties go to the
first language in order of name. Rows are judged one by one, so repeated rows, null ids and other
columns change nothing; rows with a null label or null text teach nothing. Without any labelled
row every text is ``und`` with score 0.
"""

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.session import settle

from ._frames import shared_value, small_batches, trimmed
from ._text import CHUNK, chunks

UNKNOWN = "und"
#: Runs of letters (with marks that belong to them).
WORD = r"\p{L}[\p{L}\p{M}]*"
#: Start of a word in the public vocabulary.
BEGIN = "▁"
#: No piece of a language is less likely than that.
FLOOR = 1e-7
#: Letters after which the recursion is scaled anew, so that long words cannot underflow.
RESCALE = 16
#: Distinct words whose results a task remembers.
REMEMBERED = 300_000
#: Numbers of one matrix (words by letters by languages).
BLOCK = 4_000_000


def vocabulary_pieces(path: str) -> list[str]:
    """All pieces of letters of the public model, in lower case."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_byte(i))
    wanted = regex.compile(f"{BEGIN}?(?:{WORD})").fullmatch
    return sorted({p for p in (piece.lower() for piece in plain) if wanted(p) or p == BEGIN})


def letter_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of code points, each begun by the word mark, zero-padded; and their lengths."""
    lengths = np.array([len(w) + 1 for w in words])
    flat = np.frombuffer("".join(BEGIN + w for w in words).encode("utf-32-le"), "<u4")
    out = np.zeros((len(words), int(lengths.max())), np.uint64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out, lengths


class Pieces:
    """Piece numbers of all substrings: rolling hashes looked up in a sorted table."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        self.size, self.longest = len(pieces), max(map(len, pieces), default=1)
        begun: dict[int, int] = {}  # hashes of all beginnings of pieces, and the piece each is
        for k, piece in enumerate(pieces):
            out = 0
            for letter in piece:
                out = ((out + ord(letter) + 1) * int(self.FACTOR)) & (1 << 64) - 1
                out ^= out >> 29
                begun.setdefault(out, self.size)
            begun[out] = k
        hashes, piece = np.array(list(begun), np.uint64), np.array(list(begun.values()), np.int64)
        order = np.argsort(hashes)
        self.hashes, self.piece = hashes[order], piece[order]

    def numbers(self, letters: np.ndarray) -> Iterator[np.ndarray]:
        """For n = 1, 2, ...: the piece beginning at each place with n letters, ``size`` if none.

        A single letter that is no piece has number ``size + 1``, the unknown letter. Only places
        where some piece begins with the letters so far are looked at again; ends when there are none.
        """
        rows, width = letters.shape
        flat = letters.ravel()
        place, rolling = np.arange(flat.size), np.zeros(flat.size, np.uint64)
        for n in range(1, min(self.longest, width) + 1):
            fits = place % width + n <= width
            place, rolling = place[fits], rolling[fits]
            rolling = (rolling + flat[place + n - 1] + np.uint64(1)) * self.FACTOR
            rolling ^= rolling >> np.uint64(29)
            if self.size:
                at = np.searchsorted(self.hashes, rolling)
                at[at == len(self.hashes)] = 0
                hit = self.hashes[at] == rolling
            else:
                at, hit = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
            place, rolling, piece = place[hit], rolling[hit], self.piece[at[hit]]
            if n > 1 and not len(place):
                return
            out = np.full((rows, width - n + 1), self.size + (n == 1))
            known = piece != self.size
            out[place[known] // width, place[known] % width] = piece[known]
            yield out


#: Letters of a piece from which on words without one are left out of the recursion.
SPARSE = 4


def add_pieces(total: np.ndarray, before: np.ndarray, numbers: np.ndarray, n: int, weights: np.ndarray) -> None:
    """Add to each word's ``total`` what pieces of n letters make of ``before``."""
    if n < SPARSE:
        total += before * weights[numbers]
        return
    hit = np.flatnonzero(numbers < len(weights) - 2)
    if len(hit):
        total[hit] += before[hit] * weights[numbers[hit]]


def forward(found: list[np.ndarray], weights: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all segmentations of each prefix, by language, and their logarithmic scale.

    ``found[n - 1][i, j]``: the piece of word i at letter j with n letters. ``weights``: pieces
    (with a zero row for none) by languages.
    """
    rows, languages = len(found[0]), weights.shape[1]
    alpha = np.zeros((width + 1, rows, languages))
    scale = np.zeros((width + 1, rows, languages))
    alpha[0] = 1
    now = np.zeros((rows, languages))
    for j in range(1, width + 1):
        for n in range(1, min(j, len(found)) + 1):
            add_pieces(alpha[j], alpha[j - n], found[n - 1][:, j - n], n, weights)
        if j % RESCALE == 0:  # what a later letter can still reach is divided by its largest value
            low = max(0, j - len(found) + 1)
            most = alpha[low : j + 1].max(axis=0)
            most[most == 0] = 1
            alpha[low : j + 1] /= most
            now = now + np.log(most)
            scale[low : j + 1] += np.log(most)
        if j < width:
            scale[j + 1] = now
    return alpha, scale


def word_scores(words: list[str], pieces: Pieces, weights: np.ndarray) -> np.ndarray:
    """log P(word | language) of distinct words, whatever their order."""
    out = np.zeros((len(words), weights.shape[1]))
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    sizes = [len(words[k]) for k in order]
    at = 0
    while at < len(order):
        to = min(bisect_right(sizes, sizes[at]), at + max(1, BLOCK // ((sizes[at] + 2) * weights.shape[1])))
        letters, lengths = letter_codes([words[k] for k in order[at:to]])
        width = int(lengths[0])
        alpha, scale = forward(list(pieces.numbers(letters)), weights, width)
        out[order[at:to]] = np.log(np.maximum(alpha[width], 1e-300)) + scale[width]
        at = to
    return out


def expected_uses(words: list[str], counts: np.ndarray, pieces: Pieces, weights: np.ndarray) -> np.ndarray:
    """Expected uses of every piece, by language, in words seen ``counts`` times (words by languages).
    Sums over the beginnings and over the ends of a word have scales of their own, so that long
    words cannot underflow.
    """
    uses = np.zeros((pieces.size + 2, weights.shape[1]))
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    for size, same in by_length.items():
        block = max(1, BLOCK // ((size + 2) * weights.shape[1]))
        for own in (same[i : i + block] for i in range(0, len(same), block)):
            letters, lengths = letter_codes([words[k] for k in own])
            width, found, count = int(lengths[0]), list(pieces.numbers(letters)), counts[own]
            with np.errstate(divide="ignore"):
                ahead, back = (np.log(x) + scale for x, scale in (forward(f, weights, width) for f in (found, [numbers[:, ::-1] for numbers in found])))
            for n, numbers in enumerate(found, 1):
                for j in range(width - n + 1):
                    hit = np.flatnonzero(numbers[:, j] != pieces.size)
                    if not len(hit):
                        continue
                    got, rest = numbers[hit, j], width - j - n
                    used = np.exp(ahead[j, hit] + back[rest, hit] - ahead[width, hit]) * weights[got] * count[hit]
                    for language in range(weights.shape[1]):
                        uses[:, language] += np.bincount(got, used[:, language], len(uses))
    return uses


def normalised(uses: np.ndarray, size: int) -> np.ndarray:
    """Piece probabilities from uses; every piece and the unknown letter have at least FLOOR."""
    weights = np.maximum(uses / np.maximum(uses.sum(axis=0), 1e-300), FLOOR)
    weights[size] = 0  # no piece
    weights[size + 1] = FLOOR  # the unknown letter
    return weights


class Model:
    def __init__(self, languages: list[str], pieces: list[str], weights: np.ndarray, prior: np.ndarray):
        self.languages, self.pieces, self.weights, self.prior = languages, pieces, weights, prior


def words_of(text: str | None) -> list[str]:
    return regex.findall(WORD, (text or "").lower())


def labelled_sample(docs: DataFrame, teaches: Column, per_language: int, id_col: str, lang_col: str) -> DataFrame:
    """Labelled rows: all of a language with at most ``per_language`` of them, else a hash's choice of about as many."""
    rows = docs.where(teaches & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    share = {lang: min(1.0, per_language / n) for lang, n in sizes.items()}
    if not share:
        return rows
    limit = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col(lang_col)]
    return rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(6)), F.lit(1_000_000)) < limit * 1_000_000)


def train(
    docs: DataFrame,
    path: str,
    teaches: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 1_000,
    rounds: int = 2,
) -> Model:
    """Fit on the labelled rows that ``teaches`` admits, ``per_language`` of each language at most."""
    small_batches(docs.sparkSession)
    vocabulary = vocabulary_pieces(path)
    pieces = Pieces(vocabulary)
    rows = labelled_sample(docs, teaches, per_language, id_col, lang_col)
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("text is not null")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, "text"):
            seen: dict[tuple[str, str], int] = {}
            for lang, text in zip(table["lang"].to_pylist(), table["text"].to_pylist()):
                for word in words_of(text):
                    seen[lang, word] = seen.get((lang, word), 0) + 1
            langs, words = zip(*seen) if seen else ((), ())
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array(langs, pa.string()), "word": pa.array(words, pa.string()), "n": pa.array(seen.values(), pa.int64())}
            )

    counted = rows.mapInArrow(count_words, "lang string, word string, n bigint")
    counted = settle(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    totals = {r[0]: r[1] for r in counted.groupBy("lang").agg(F.sum("n")).collect()}
    languages = sorted(totals)
    prior = np.array([totals[x] for x in languages], float)
    uses = np.ones((pieces.size + 2, len(languages)))
    uses[pieces.size :] = 0
    weights = normalised(uses, pieces.size)
    for _ in range(rounds if languages else 0):
        shared = shared_value(docs.sparkSession, (vocabulary, weights))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, now = shared()
            known, total = Pieces(own), None
            number = {x: k for k, x in enumerate(languages)}
            for batch in batches:
                words: dict[str, int] = {}
                at = [words.setdefault(w, len(words)) for w in batch.column("word").to_pylist()]
                counts = np.zeros((len(words), len(languages)))
                np.add.at(counts, (at, [number[x] for x in batch.column("lang").to_pylist()]), batch.column("n").to_numpy())
                found = expected_uses(list(words), counts, known, now)
                total = found if total is None else total + found
            if total is not None:
                piece, language = np.nonzero(total)
                yield pa.RecordBatch.from_pydict({"piece": piece, "language": language, "uses": total[piece, language]})

        summed = counted.mapInArrow(expect, "piece bigint, language bigint, uses double")
        uses = np.zeros_like(uses)
        for piece, language, n in summed.groupBy("piece", "language").agg(F.sum("uses")).collect():
            uses[piece, language] = n
        weights = normalised(uses, pieces.size)
    return Model(languages, vocabulary, weights, prior / max(prior.sum(), 1))


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple = (), keep_text: bool = False
) -> DataFrame:
    """``id_col``, the columns of ``keep``, ``text`` if wanted, ``lang_pred`` and ``score`` (that language's posterior)."""
    small_batches(docs.sparkSession)
    shared = shared_value(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared()
        pieces, languages = Pieces(found.pieces), len(found.languages)
        known: dict[str, int] = {}
        scores = np.zeros((0, languages))
        for table in chunks(batches, "text", CHUNK // 2):
            if len(known) > REMEMBERED:
                known, scores = {}, scores[:0]
            each = [words_of(text) for text in table["text"].to_pylist()]
            new = sorted(set().union(*each).difference(known)) if each else []
            known.update(zip(new, range(len(known), len(known) + len(new))))
            if languages:
                scores = np.concatenate([scores, word_scores(new, pieces, found.weights)])
            labels, posteriors = [], []
            for words in each:
                if not words or not languages:
                    labels.append(UNKNOWN)
                    posteriors.append(0.0)
                    continue
                numbers = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                total = scores[numbers].sum(axis=0) + np.log(found.prior)
                best = int(total.argmax())
                labels.append(found.languages[best])
                posteriors.append(float(1 / np.exp(total - total[best]).sum()))
            done = table if keep_text else table.drop_columns("text")
            done = done.append_column("lang_pred", pa.array(labels, pa.string()))
            yield from done.append_column("score", pa.array(posteriors, pa.float64())).to_batches()

    rows = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text"))
    kinds = [f"{name} {kind}" for name, kind in rows.dtypes if keep_text or name != "text"]
    done = rows.mapInArrow(trimmed(run), ", ".join([*kinds, "lang_pred string", "score double"]))
    return done.withColumnRenamed("id", id_col)
