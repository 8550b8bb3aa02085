import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import CLASHING, documents, rng
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rolescope.llm import token_files
from rolescope.llm.token_files import TokenFile, pack
from rolescope.session import new_work_dir

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "\n", "a b", "A  B\n\tC\x0b\x0cd\r\n", "<|endoftext|> x<|startoftext|>", "ΑΣ ΣΑΣ ς", "é é 你好🙂", "\x1c\x1d x y z　", "it's we'll 'S",
       "İstanbul ǅ", "12345", "́ ́a ̈", "long " * 20_000, "x" * 30_000, "Å, b. C.\nd $$$, x", "A\u030A K\u0301, 1. 2,\n3.,4 a., b. <, x", "don't, It'S. <|ENDOFTEXT|>, A", "_, a", "., ."]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500), st.randoms())
def test_random_access(ids, draw):
    cuts = sorted(draw.randint(0, len(ids)) for _ in range(3))
    lengths = np.diff([0, *cuts, len(ids)])
    held = TokenFile(pack(np.array(ids, np.uint32), [4, None, 7, -9], lengths))
    assert held.docs == [4, None, 7, -9] and held.n_ids == len(ids) and held.starts.tolist() == [0, *cuts, len(ids)]
    at = np.array([draw.randrange(len(ids)) for _ in range(50)] if ids else [], np.int64)
    assert held.get(at).tolist() == [ids[i] for i in at]
    low = draw.randint(0, len(ids))
    high = draw.randint(low, len(ids))
    assert held.span(low, high).tolist() == ids[low:high]


PIECES = ["İ", "i̇", "Å", "A\u030A", "\u0301", "é", "ß", "ς", "Σ", "a", "B", "9", "_", "'s", "'", "<|endoftext|>", "<|", "你", "🙂", ".", ",", ". ", ", ", ".\n", ",\n", " ", "\n", "\t", "\u00a0", "\u200d", "-", "½", "Ⅷ", "ﬁ"]


@settings(max_examples=250, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=1, max_size=30))
def test_ids_like_the_library(texts):
    """Marks, letters that change their length in lower case, stops, commas and blanks in any order."""
    own, plain = token_files.tokenizer(PATH, 1), Tokenizer.from_file(PATH)
    ids, lengths = own.encode(texts)
    cuts = np.cumsum([0, *lengths]).tolist()
    for text, low, high in zip(texts, cuts, cuts[1:]):
        assert ids[low:high].tolist() == plain.encode(text, add_special_tokens=False).ids + [1], text


def test_access_needs_no_neighbours():
    """Every place of a large file on its own, against the whole."""
    ids = rng().integers(0, 1 << 20, 70_000).astype(np.uint32)
    held = TokenFile(pack(ids, [1], np.array([len(ids)])))
    at = rng().permutation(len(ids))
    assert (held.get(at) == ids[at]).all() and held.span(123, 65_432).tolist() == ids[123:65_432].tolist()
    assert len(held.data) < 4 * len(ids)
    with pytest.raises(ValueError):
        TokenFile(b"something else entirely")


@pytest.mark.parametrize("per_file", [1 << 21, 40])
def test_files_like_the_library(spark, per_file):
    rows = [(i * 3 - 5, t) for i, t in enumerate(ODD)] + [(None, "first"), (4, "a b"), (4, "a b"), (4, "other")]
    path = new_work_dir(spark, "token-test")
    manifest = token_files.write_tokens(documents(spark, rows, **CLASHING), path, PATH, 1, ids_per_file=per_file)
    got = sorted(token_files.read_tokens(spark, path, manifest).collect(), key=lambda r: r.start)
    plain = Tokenizer.from_file(PATH)
    want = [(d, plain.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in rows]
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=str) == sorted(want, key=str)
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert [r.start for r in got] == np.cumsum([0, *(len(r.ids) // 4 for r in got[:-1])]).tolist()
    assert manifest.count() > 1 or per_file > 40


def test_empty_table_and_digest(spark):
    path = new_work_dir(spark, "token-test")
    manifest = token_files.write_tokens(documents(spark, []), path, PATH, 1)
    assert token_files.read_tokens(spark, path, manifest).count() == 0
    value = spark.createDataFrame([(bytearray(b"\x01\x00\x00\x00"),)], "ids binary").select(F.crc32("ids")).first()[0]
    assert value == zlib.crc32(b"\x01\x00\x00\x00")
