"""BPE by transducer against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import bpe
from assayer.llm.common import tokenizer_path

PATH = tokenizer_path(bpe.VOCABULARY)
POOL = "abcdefghijklmnopqrstuvwxyzABCDEFΣσςİıſßÅÉé 'sdmtlv.,!?-_<|>0123456789\t\n\r\x0b\x0c\x85\xa0 　​\x1c\x00漢字かな한국🙂́̈éǅ①²½՘\U0003d000"
HARD = [
    None, "", " \n\t ", "a<|endoftext|>b <|startoftext|><|endoftext|> <|EndOfText|> <|endoftext |>", "a" * 500, "abcab" * 200, "thing " * 4000, "x" * 30_000,
    "I'd we've they'll it's 'S 'VE x'm 2's", "ΟΔΟΣ ΣΑΣ", "Straße ÉCOLE größer 漢字 \U0001f600 Ünï",
]


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def voc():
    return bpe.Vocabulary(PATH)


def _ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_encoder_equals_the_library_on_random_texts(lib, voc):
    rng = random.Random(4)
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice((rng.randrange(1, 0x3000), rng.randrange(0x3000, 0xD800), rng.randrange(0xE000, 0x1FFFF)))) for _ in range(40)) for _ in range(500)]
    e = bpe.Encoder(voc, None)
    for text, raw in zip(texts, e.encode(texts), strict=True):
        ids = raw.tolist()
        assert ids == lib.encode(text, add_special_tokens=False).ids, ascii(text)
        assert bpe.decoded(ids, voc.tokens).decode() == lib.decode(ids, skip_special_tokens=False)


def test_both_ways_to_merge_agree(voc):
    rng = random.Random(5)
    words = [bytes(rng.choice(b"theranion\xc3\xa9") for _ in range(rng.randint(1, 40))) for _ in range(600)]
    by_heap = [voc._by_heap([*voc.inner[[*w[:-1]]].tolist(), int(voc.last[w[-1]])] if len(w) > 1 else [int(voc.last[w[0]])]) for w in words]
    assert [_ids(x) for x in voc.merged(words)] == by_heap == [_ids(x) for x in voc._by_table(words)]
    long = [w * 40 for w in words[:40] if len(w) > 1]
    assert [_ids(x) for x in voc.merged(long)] == [_ids(x) for x in voc._by_table(long)]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6).map(lambda b: bytes(x % 4 + 97 for x in b)), st.lists(st.integers(0, 5), max_size=4), max_size=40))
def test_transducer_holds_exactly_its_words(entries):
    t = bpe.Transducer(bpe.compiled((w, tuple(entries[w])) for w in sorted(entries)))
    asked = [*entries, b"", b"zz", *(w + b"a" for w in entries), *(w[:-1] for w in entries)]
    assert [None if x is None else _ids(x) for x in t.find(asked)] == [entries.get(w) for w in asked]


def test_equal_futures_share_states():
    words = sorted(a + b for a in (b"b", b"cc", b"ddd") for b in (b"ing", b"ed", b"er"))
    t = bpe.Transducer(bpe.compiled((w, ()) for w in words))
    assert t.size == (9, 12)  # root, c, d, dd, the start of the shared endings, i, n, e, end


def test_a_lexicon_is_small_beside_its_words(voc):
    words = sorted({f"{a}{b}{c}".encode() for a in ("un", "re", "over", "") for b in ("think", "work", "lead", "read") for c in ("", "ing", "er", "ers")})
    ids = [_ids(x) for x in voc.merged(words)]
    t = bpe.Transducer(bpe.compiled(zip(words, map(tuple, ids), strict=True)))
    assert t.size[1] < sum(map(len, words)) / 2
    assert [_ids(x) for x in t.find(words)] == ids


@pytest.mark.parametrize("size", [0, 3, 10_000])
def test_query_parts_equal_the_library(spark, lib, size):
    rows = [(None if k == 1 else 2**53 + k // 2, t, "x") for k, t in enumerate(HARD + HARD[:4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    name = bpe.lexicon(docs, size) if size else None
    want = {}
    for d, t, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        key = (d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        want[key] = want.get(key, 0) + 1
    got = {}
    for r in bpe.digests(docs, name).collect():
        got[tuple(r)] = got.get(tuple(r), 0) + 1
    assert got == want
    coded = bpe.encode(docs, name)
    back = {r["key"]: r["text"] for r in bpe.decode(coded.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "key")).collect()}
    ids = {r["doc_id"]: r["ids"] for r in coded.collect() if r["doc_id"] is not None}
    assert set(back) == set(ids) and back[2**53] in ("", lib.decode(lib.encode(HARD[0] or "", add_special_tokens=False).ids, skip_special_tokens=False))


def test_counts_are_of_all_texts(spark):
    docs = spark.createDataFrame([(1, "The the, THE's"), (2, None), (3, "x" * 100 + " the")], "doc_id long, text string")
    assert {bytes(r["word"]): r["n"] for r in bpe.word_counts(docs).collect()} == {b"the": 4, b",": 1, b"'s": 1}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(docs, bpe.lexicon(docs)).collect() == []
