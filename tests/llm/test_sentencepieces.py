"""Ids and texts against the sentencepiece library, and the memo against texts whose weak hashes are equal."""

import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from doctables.llm import sentencepieces as S
from doctables.llm.tokens import Encoder, tokenizer_path
from doctables.llm.transducer import Counter
from tests.llm.rows import SCHEMA, rows

MODEL = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def made_texts(seed):
    rng = random.Random(seed)
    kinds = ["abcdefghijklmnop      \n\t0123456789.,'ABC▁éß日𝔘\x00", "aeinrst ", " \n", "".join(map(chr, range(0x20, 0x3000, 7))), "\U0001f600\U0001f64f ​﻿", "ab"]
    return [None, "", " ", "▁", "<s> <0x0A> <unk></s>", "é ﬁ ①", *("".join(rng.choice(kind) for _ in range(rng.randint(0, 80))) for kind in kinds for _ in range(150))]


def test_ids_and_texts_of_whole_documents(spark, library):
    data = rows(5) + [(5000 + i, t, "en", "s", 1, "x", 7, 7, "x", "h") for i, t in enumerate(made_texts(3))]
    data += [(9000, "z9" * 900_000, *[None] * 8), (9001, "und so weiter " * 150_000, *[None] * 8)]  # above one slice
    coded = S.decoded(S.encoded(spark.createDataFrame(data, SCHEMA).repartition(3), MODEL), MODEL)
    got = {r.doc_id: (list(r.ids), r.text) for r in coded.collect()}
    for doc_id, text, *_ in data:
        want = library.encode(text or "")
        assert got[doc_id] == (want, library.decode(want)), text[:80]


def test_any_ids_are_decoded_as_the_library_does(library):
    rng, model = random.Random(4), S.coder(MODEL).model
    some = [[rng.choice([rng.randrange(32000), rng.randrange(260), 1, 0, 259]) for _ in range(rng.randint(0, 12))] for _ in range(3000)]
    flat = np.array([x for ids in some for x in ids], np.int64)
    assert model.decoded(flat, np.array([len(ids) for ids in some])) == [library.decode(ids) if ids else "" for ids in some]


def test_backtracking_takes_pieces_back(library):
    """A model whose longest pieces often do not fit: the failed places are used, and the pieces are those of merging."""
    model, rng = S.coder(MODEL).model, random.Random(8)
    back = 0
    for _ in range(400):
        text = "".join(rng.choice("aeinrstodl") for _ in range(rng.randint(2, 60)))
        greedy, k = [], 0
        while k < len(text):
            size = max([n for n in range(1, 17) if text[k : k + n] in model.id], default=1)
            greedy.append(text[k : k + size])
            k += size
        assert model.pieces(text) == model.merged(text)
        back += model.merged(text) != greedy
    assert back > 100


def test_rows_without_ids_repeated_rows_and_empty_tables(spark, library):
    some = [(None, "a b", *[None] * 8)] * 2 + [(3, None, *[None] * 8)] * 2 + [(3, "x", *[None] * 8)]
    table = S.digests(S.decoded(S.encoded(spark.createDataFrame(some, SCHEMA), MODEL), MODEL))
    assert sorted((str(r.doc_id), r.n_tokens) for r in table.collect()) == [("3", 0), ("3", 0), ("3", len(library.encode("x"))), ("None", 2), ("None", 2)]
    empty = S.digests(S.decoded(S.encoded(spark.createDataFrame([], SCHEMA), MODEL), MODEL))
    assert empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and empty.count() == 0


@pytest.mark.parametrize("letters", ["ab", "th", "in", "qu"])
def test_memos_compare_bytes(letters, library):
    """Words whose sums of byte values times powers are equal modulo 2**64 are different pieces."""
    word = "".join(letters[bin(i).count("1") & 1] for i in range(2048))
    other = word.translate(str.maketrans(letters, letters[::-1]))
    column = pa.array([word, other, word])
    for file in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder = Encoder(tokenizer_path(file))
        ids, counts = encoder.slice(column)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [encoder.whole(t).tolist() for t in column.to_pylist()]
    counter, encoder = Counter(tokenizer_path("byte_bpe_50k.json")), Encoder(tokenizer_path("byte_bpe_50k.json"))
    assert [counter.one(t.encode()) for t in (word, other)] == [len(encoder.whole(t)) for t in (word, other)]
    ids, counts = S.coder(MODEL).encode(column)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t) for t in column.to_pylist()]
