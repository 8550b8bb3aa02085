import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import CLASHING, documents

from rolescope.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "   ", "a", "\n", "\n\n", "a b  c   d", "▁a▁▁b", " lead", "trail ", "\t\tx\ty", "12345 67.89", "<s></s><unk><0x0A>", "é 你好 мир 🙂👨‍👩‍👧",
    "\x00\x01", "a" * 1400, "ab" * 900, "=-" * 2000, " " * 1500, "the.\nIn\n the \n  x", "ﬁ Å", "####  ####", "return  returnreturn\r\n", "word " * 30_000,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return pieces.PieceModel(PATH)


def same(own, library, texts):
    ids, lengths = own.encode(texts)
    cuts = np.cumsum(lengths)[:-1]
    want = [library.encode(t or "") + [2] for t in texts]
    assert [x.tolist() for x in np.split(ids, cuts)] == want
    assert own.decode(ids, lengths) == [library.decode(w) for w in want]


def test_like_the_library(own, library):
    same(own, library, ODD)
    draw = random.Random(4)
    same(own, library, ["".join(draw.choice("abcdeth in.\n ▁é你$%=#12 ") for _ in range(draw.randint(0, 200))) for _ in range(500)])
    known = [library.id_to_piece(i) for i in range(259, 32000)]
    same(own, library, ["".join(draw.choice(known) for _ in range(40)).replace("▁", " ") for _ in range(300)])
    same(own, library, ["".join(draw.choice(known).replace("▁", "") for _ in range(400)) for _ in range(10)])


def test_decodes_any_ids(own, library):
    draw = random.Random(9)
    lists = [[draw.choice([0, 1, 2, 3 + draw.randrange(256), draw.randrange(32000)]) for _ in range(draw.randint(0, 12))] for _ in range(500)]
    lists += [[], [2], [35, 259], [259, 259], [1, 259, 300]]
    flat = np.array([i for ids in lists for i in ids], np.int32)
    assert own.decode(flat, np.array([len(ids) for ids in lists])) == [library.decode(ids) for ids in lists]


def test_whole_tables(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (3, ODD[3]), (3, ODD[3])]
    docs = documents(spark, rows, **CLASHING)
    encoded = pieces.encode_documents(docs, PATH)
    got = pieces.decode_documents(encoded, PATH).select("doc_id", "text", "ids", "decoded").collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(r.text or "") + [2]
        assert r.ids == want and r.decoded == library.decode(want)
    once = pieces.encode_documents(docs, PATH, decoded=True).select("doc_id", "text", "ids", "decoded").collect()
    assert sorted(map(str, once)) == sorted(map(str, got))
    assert set(encoded.columns) == {"doc_id", "text", *CLASHING} and encoded.first()["row"] == "mine"
    assert pieces.encode_documents(documents(spark, []), PATH).count() == 0
