"""Alignment against a plain version of its definition, with the libraries themselves."""

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from tallyshelf.llm import alignment, queries

from .helpers import clashing, documents, rows

FILES = (queries.BYTE_PAIRS, public_tokenizers.PATTERN, queries.PIECES)
SF = "/root/testdata/sf0.01"


def tools():
    a = Tokenizer.from_file(queries.BYTE_PAIRS)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


def tokens(a, b, text):
    """Ids and bytes of both sides, or nothing."""
    if not text:
        return None
    x, y = a.encode(" " + text, add_special_tokens=False), b.encode(text)
    decode = dict(zip(ordered(), sorted(range(256), key=lambda v: (not printable(v), v))))
    of_a = [bytes(decode[c] for c in t) for t in x.tokens]
    of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    whole = (" " + text).encode()
    return (x.ids, of_a, y, of_b) if b"".join(of_a) == whole == b"".join(of_b) else None


def printable(v):
    return 0x21 <= v <= 0x7E or 0xA1 <= v <= 0xAC or 0xAE <= v <= 0xFF


def ordered():
    return [chr(v) for v in range(256) if printable(v)] + [chr(256 + k) for k in range(256 - sum(map(printable, range(256))))]


def expected(texts):
    a, b = tools()
    out, counts = [], Counter()
    for text in texts:
        found = tokens(a, b, text)
        groups, links = [], []
        if found:
            ids_a, of_a, ids_b, of_b = found
            end, ends_a = 0, {}
            for i, t in enumerate(of_a):
                end += len(t)
                ends_a[end] = i
            end, from_a, from_b = 0, 0, 0
            for j, t in enumerate(of_b):
                end += len(t)
                if end in ends_a:
                    i = ends_a[end]
                    groups.append((ids_a[from_a : i + 1], ids_b[from_b : j + 1]))
                    links.append((ids_a[i], ids_b[j]))
                    from_a, from_b = i + 1, j + 1
        counts.update(links)
        out.append((found, groups, links))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    for found, groups, links in out:
        if not found:
            yield (0, 0, 0, 0, 0, 0, "")
            continue
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        n_best = sum(counts[link] == best[link[1]] for link in links)
        yield (len(found[0]), len(found[2]), len(groups), len(links), n_best, sum(counts[k] for k in links), hashlib.sha256(text.encode()).hexdigest())


def test_alphabet():
    assert sorted(alignment.byte_alphabet()) == sorted(ByteLevel.alphabet())
    assert all(alignment.byte_alphabet()[c] == v for v, c in zip(sorted(range(256), key=lambda v: (not printable(v), v)), ordered()))


def test_the_table_by_its_definition(spark):
    given_ = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = expected([r.text for r in given_])
    got = {tuple(r) for r in queries.op12_alignment(spark, SF).collect()}
    assert got == {(r.doc_id, *w) for r, w in zip(given_, want)}


def test_awkward_rows(spark):
    odd = ["", None, " ", "   ", "\n\n a\n", "x", "x" * 3000, "<|endoftext|> <s> </s> <0x41> <unk>", "▁ a", "é \U0001f600 \x00 \t\r\n  b", "a  b   c    d", "日本語のテキスト", "café naïve"]
    texts = [*odd, *odd[:5], "word " * 20000, " leading", "trailing ", "don't re-tokenise, it's 12,345.67!"]
    docs = documents(spark, [(k if k else None, t) for k, t in enumerate(texts)])
    want = sorted([(k if k else None, *w) for k, w in enumerate(expected(texts))], key=repr)
    assert rows(alignment.align(docs, *FILES)) == want
    assert rows(alignment.align(clashing(docs), *FILES)) == want
    assert want[-1][1] == 0 or any(w[1] == 0 for w in want)


def test_every_character_is_encoded_as_by_the_file():
    a, own = tools()[0], alignment.ByteTokenizer(*FILES[:2])
    texts = [f"a{c}{c}b1{c} {c}2" for c in map(chr, range(0x30000)) if not 0xD800 <= ord(c) < 0xE000]
    assert own.encode(texts) == [e.ids for e in a.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_empty(spark):
    assert alignment.align(documents(spark, []), *FILES).count() == 0
    none = alignment.align(documents(spark, [(1, None)]), *FILES)
    assert rows(none) == [(1, 0, 0, 0, 0, 0, 0, "")]


ALIGNER = []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\tab.'1▁"))), max_size=4))
def test_any_text(texts):
    if not ALIGNER:
        ALIGNER.append(alignment.Aligner(alignment.ByteTokenizer(*FILES[:2]), alignment.PieceTokenizer(queries.PIECES)))
    done = ALIGNER[0].align(texts)
    want = list(expected(texts))
    assert [(*r[:3], d) for r, d in zip(zip(done.n_a.tolist(), done.n_b.tolist(), done.n_groups.tolist()), done.digests)] == [(*w[:3], w[-1]) for w in want]
