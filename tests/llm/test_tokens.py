import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from edges import ROWS, same, table, texts
from tokenizers import Tokenizer

from assetloom.llm import bpe, packing, token_counts

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = " \n\tabAÉ'sé<|>1.,日🙂　\x1c\x85tßİı́"


def odd_texts(n, seed):
    pick = random.Random(seed)
    return ["".join(pick.choice(ALPHABET) for _ in range(pick.randint(0, 40))) for _ in range(n)]


def brute_pieces(pieces, mark, word):
    text, at, n = mark + word, 0, 0
    while at < len(text):
        size = next((k for k in range(len(text) - at, 0, -1) if text[at : at + k] in pieces), 0)
        n += 1 if size else 0 if text[at] == mark else len(text[at].encode())
        at += size or 1
    return n


def test_automaton_against_greedy_matching():
    pick = random.Random(2)
    for _ in range(200):
        pieces = {"".join(pick.choice("ab▁é") for _ in range(pick.randint(1, 5))) for _ in range(pick.randint(1, 12))}
        words = ["".join(pick.choice("abé日x") for _ in range(pick.randint(1, 14))) for _ in range(40)]
        got = token_counts.Automaton(sorted(pieces), "▁").count(words)
        assert got.tolist() == [brute_pieces(pieces, "▁", w) for w in words]


def test_token_counts(spark):
    pieces = ["▁the", "▁", "th", "e", "▁qu", "ick", "▁wo", "rd", "é"]
    got = token_counts.count_tokens(table(spark), pieces).collect()
    words = [[w for w in t.encode().split()] for _, t in texts()]
    expected = [(i, len(w), sum(brute_pieces(set(pieces), "▁", x.decode()) for x in w)) for (i, _), w in zip(texts(), words)]
    assert same([tuple(r) for r in got], expected)
    assert token_counts.count_tokens(table(spark).limit(0), pieces).count() == 0


def test_byte_level_round_trip():
    library, own = Tokenizer.from_file(BYTES), bpe.ByteLevelCodec(BYTES)
    found = odd_texts(1500, 1) + [t for _, t in texts()]
    for text, encoded in zip(found, own.encode(found)):
        ids = np.frombuffer(encoded, np.int32).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_cut_characters_decode_as_in_the_library():
    library, own = Tokenizer.from_file(BYTES), bpe.ByteLevelCodec(BYTES)
    pick = random.Random(3)
    for _ in range(300):
        ids = [pick.randrange(50_257) for _ in range(pick.randint(0, 9))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_encode_documents(spark):
    library = Tokenizer.from_file(BYTES)
    got = bpe.encode_documents(table(spark), BYTES, decoded=True).collect()
    expected = [(i, library.encode(t, add_special_tokens=False).ids, t) for i, t in texts()]
    assert same([(r.doc_id, tuple(r.ids), r.text) for r in got], [(i, tuple(x), t) for i, x, t in expected])
    again = bpe.decode_documents(bpe.encode_documents(table(spark), BYTES), BYTES).collect()
    assert same([(r.doc_id, r.text) for r in again], [(i, t) for i, t in texts()])
    assert bpe.encode_documents(table(spark).limit(0), BYTES).count() == 0


def test_word_tokenizer():
    library, own = Tokenizer.from_file(WORDS), packing.WordTokenizer(WORDS)
    found = odd_texts(3000, 4) + [t for _, t in texts()] + ["<|endoftext|> x", "İstanbul ΣΑΣ", "it's WE'LL o'Reilly"]
    for text, encoded in zip(found, own.encode(found)):
        assert np.frombuffer(encoded, np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


def one_by_one(lengths, limit):
    """Remaining capacities after best-fit decreasing, piece by piece."""
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(limit - n)
    return sorted(free)


def places(rows):
    """Checks that sequences have no gap; returns what each has left of 50."""
    found = {}
    for sequence, offset, length in rows:
        found.setdefault(sequence, []).append((offset, length))
    left = []
    for own in found.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        left.append(50 - at)
    return sorted(left)


def test_pack_like_best_fit_decreasing(spark):
    pick = random.Random(5)
    for n in (0, 1, 40, 400):
        lengths = [pick.choice((50, 7, pick.randint(1, 50))) for _ in range(n)]
        rows = [(i // 2, i % 2, x, 1, 2) for i, x in enumerate(lengths)]
        pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long, offset2 long, _rank2 long")
        got = packing.pack(pieces, 50).collect()
        assert Counter(r.length for r in got) == Counter(lengths)
        assert places([(r.sequence_id, r.offset, r.length) for r in got]) == one_by_one(lengths, 50)


def test_many_of_one_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 10)
    pieces = spark.range(500).selectExpr("id AS doc_id", "0 AS piece", "CAST(if(id % 3 = 0, 20, 11) AS long) AS length")
    got = packing.pack(pieces, 50).collect()
    assert places([(r.sequence_id, r.offset, r.length) for r in got]) == one_by_one([r.length for r in got], 50)
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 51)], "doc_id long, piece int, length long"), 50)


def test_token_pieces(spark):
    library = Tokenizer.from_file(WORDS)
    got = packing.token_pieces(table(spark), WORDS, 100, 1, with_ids=True).collect()
    expected = []
    for i, t in texts():
        ids = library.encode(t, add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 100)):
            part = ids[at : at + 100]
            expected.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)))
    assert same([(*r[:5], tuple(r.ids)) for r in got], expected)
    assert packing.pack(packing.token_pieces(table(spark), WORDS, 100, 1), 100).count() == len(expected)
    assert len(ROWS) == len({(r.doc_id, r.ids_crc32) for r in got if r.piece == 0}) + 1
