"""Alignment against whole-text tokenization with both libraries, groups cut by hand, and counts by plain Python."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF

from barwright.llm import token_align as ta

TEXTS = [
    "the quick brown fox", "The  quick\n\n brown\tfox \n", " lead and trail  ", "naïve café — 日本語 😀 text", "don't we'll they've I'm x's",
    "a\r\nb\r\n  c\r", "non breaking  spaces　wide", "<|endoftext|> <s> </s> <unk> <0x41>", "tabs\t\tand \t mixed\n \n", "\x00 nul \x1c sep \x85 next",
    "12345 67,890.12 a1b2c3", "x" * 3000, "word " * 2000, "supercalifragilisticexpialidocious unbelievableness", "{\r\n}\r\n);\r\n", " ", "\n", "\t a", "é combining", "ﬁ ligature ½",
]
ODD = [None, "", "has ▁ in it", "▁"]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(ta.BYTE_BPE)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=ta.PIECE_BPE)


def plain(text, libraries):
    """(a ids, b ids, groups, links) of a text, or None: bytes by the libraries' own vocabularies, groups by the ends that both have."""
    a, b = libraries
    if not text:
        return None
    letters = {chr(c): x for x, c in ta._byte_letters().items()}
    ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != f" {text}".encode() or b"".join(bytes_b) != f" {text}".encode():
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    parts, links, i, j = [], [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        p, q = ends_a.index(end) + 1, ends_b.index(end) + 1
        parts.append((ids_a[i:p], ids_b[j:q]))
        links.append((ids_a[p - 1], ids_b[q - 1]))
        i, j = p, q
    return ids_a, ids_b, parts, links


def brute(rows, libraries):
    made = [(i, plain(t, libraries)) for i, t in rows]
    counts = Counter(x for _, m in made if m for x in m[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for i, m in made:
        if not m:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join("|".join(",".join(map(str, x)) for x in g) for g in m[2])
        out.append((i, len(m[0]), len(m[1]), len(m[2]), len(m[3]), sum(counts[x] == most[x[1]] for x in m[3]), sum(counts[x] for x in m[3]), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, n_a int, links string")


def random_texts(n, seed):
    rng = np.random.default_rng(seed)
    pieces = ["a", "th", "ing", "é", "日", " ", "  ", "\n", "\t", "\r", " ", " ", ".", "'s", "9", "😀", "\x1d", "Ω", "_", "x̀"]
    return ["".join(rng.choice(pieces, int(rng.integers(1, 40)))) for _ in range(n)]


@pytest.mark.parametrize("max_pairs", [ta.MAX_PAIRS, 0])
def test_equals_brute_force(spark, libraries, max_pairs):
    rows = [*enumerate(TEXTS + ODD + random_texts(120, 1)), (3, TEXTS[3]), (3, TEXTS[3]), (None, TEXTS[0])]
    assert rows_of(ta.align(frame(spark, rows), max_pairs=max_pairs)) == brute(rows, libraries)


def test_units_give_the_tokens_of_the_whole_text(libraries):
    aligner = ta.Aligner(ta.BYTE_BPE, ta.PIECE_BPE)
    texts = TEXTS + ODD + random_texts(1500, 2)
    for t, e in zip(texts, aligner.texts(texts)):
        p = plain(t, libraries)
        assert (p is None) == (e is None), repr(t)
        if p:
            assert (len(p[0]), len(p[1])) == e[:2] and e[3] == ";".join("|".join(",".join(map(str, x)) for x in g) for g in p[2]), repr(t)
            assert np.frombuffer(e[2], aligner.kind).tolist() == [a * len(aligner.b.size) + b for a, b in p[3]]


def test_cache_that_is_too_small(libraries, monkeypatch):
    monkeypatch.setattr(ta, "CACHE_UNITS", 5)
    monkeypatch.setattr(ta, "CACHE_LENGTH", 4)
    aligner = ta.Aligner(ta.BYTE_BPE, ta.PIECE_BPE)
    for t in TEXTS:
        assert aligner.texts([t, t])[1][3] == ";".join("|".join(",".join(map(str, x)) for x in g) for g in plain(t, libraries)[2])


def test_groups_by_union_find():
    of_a, of_b, links = ta.groups(np.array([2, 5, 6, 9]), np.array([1, 2, 3, 4, 6, 7, 9]))
    assert of_a.tolist() == [0, 1, 1, 2] and of_b.tolist() == [0, 0, 1, 1, 1, 2, 2]
    assert links.tolist() == [[0, 1], [2, 4], [3, 6]]


def test_pair_bound():
    assert ta.pair_bound([b"ab", b"b", b""], [b"b", b"b", b"cab"]) == 8  # ab: b, b; b: b, b; cab: ab, b; each b: b (equal ones count from either side)


def test_empty_table(spark):
    assert rows_of(ta.align(frame(spark, []))) == []


def test_query_equals_brute_force(spark, libraries):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(ta.op12_token_align(spark, SF)) == brute(rows, libraries)
