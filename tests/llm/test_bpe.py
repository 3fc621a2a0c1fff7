import hashlib
import random
from functools import cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe, queries
from tessera.llm.textkit import utf8

PATH = public_tokenizers.path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.001"
HARD = ["", " ", "  ", "it's ' 's's 'stop we'll  x'RE 'll'", "a <|endoftext|>  b<|endoftext|><|endoftext|>", "\n\nfoo\n bar \t baz\xa0\xa0q 　z ", "'''s", "1''s", "héé 日本 12½", "<|endoftext|>", None, "x" * 200, "ab" * 5000, "\U0001f600 a", "<|endoftext|", " <|endoftext|>'s", " 's", "\x00\x01"]


@cache
def both():
    return bpe.read_vocabulary(PATH), Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return both()[1]


@pytest.fixture(scope="module")
def vocabulary():
    return both()[0]


def same(vocabulary, library, texts):
    ids, at = vocabulary.encode(*utf8(pa.array(texts, pa.string())))
    data, cut = vocabulary.decode(ids)
    raw = data.tobytes()
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids[at[i] : at[i + 1]].tolist() == want
        assert raw[cut[at[i]] : cut[at[i + 1]]].decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_hard_texts(vocabulary, library):
    same(vocabulary, library, HARD)
    r = random.Random(2)
    letters = "aabcdestmrlvV'''  \n\t\xa0éß日1½!?. \U0001f600"
    for _ in range(60):
        same(vocabulary, library, ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) + r.choice(["", "", "<|endoftext|>"]) for _ in range(30)])


def test_long_words(vocabulary, library):
    r = random.Random(4)
    same(vocabulary, library, ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (1, 63, 64, 65, 66, 100, 1000, 30000)] + ["a" * 100_001, "aab" * 9999])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_texts(texts):
    same(*both(), [t.encode("utf-8", "ignore").decode() for t in texts])


def test_classes_are_the_librarys(library):
    """Every code point, cut from what is before it as the library cuts it."""
    kinds, split = bpe.classes(), library.pre_tokenizer.pre_tokenize_str
    for lo in range(0, 0x110000, 1 << 14):
        some = [c for c in range(lo, lo + (1 << 14)) if not 0xD800 <= c < 0xE000]
        for letter, kind in (("a", bpe.LETTER), ("1", bpe.NUMBER), ("!", bpe.OTHER)):
            # A word that goes on behind the letter has the letter's class.
            starts = {a for _, (a, _) in split("".join(f"\n{letter}{chr(c)}" for c in some))}
            assert [i * 3 + 2 not in starts for i in range(len(some))] == [kinds[c] == kind for c in some]


def test_words_of_one_hash_stay_apart(vocabulary, library, monkeypatch):
    real = bpe.word_hashes
    monkeypatch.setattr(bpe, "word_hashes", lambda *a, **k: real(*a, **k) % np.uint64(3))
    same(vocabulary, library, HARD)


def test_undecodable_and_unknown_ids(spark, library):
    v = bpe.shared(spark, PATH)
    ids = [[160], [160, 161], [], None, [-1, 64, None, 10**6], [50256, 64]]
    rows = spark.createDataFrame(list(enumerate(ids)), "doc_id long, ids array<int>")
    got = dict(bpe.decode_ids(rows, v).collect())
    assert [got[i] for i in range(6)] == [library.decode([x for x in y or [] if x is not None and 0 <= x < 50257], skip_special_tokens=False) for y in ids]


def test_rows_and_columns(spark, edge, edge_rows, none, library):
    v = bpe.shared(spark, PATH)
    clash = edge.withColumn("ids", edge["n_chars"]).withColumn("_text", edge["lang"])
    got = bpe.encode_texts(clash, v, keep=["doc_id", "source"])
    want = [(i, s, library.encode(t or "", add_special_tokens=False).ids) for i, t, _, s, *_ in edge_rows]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert bpe.encode_texts(none, v).count() == 0
    assert sorted(map(str, ((r[0], r[1], list(np.frombuffer(r[2], "<u4"))) for r in bpe.encode_texts(clash, v, keep=["doc_id", "source"], packed=True).collect()))) == sorted(str((i, s, list(np.array(x, "<u4")))) for i, s, x in want)
    for packed in (False, True):
        back = bpe.decode_ids(bpe.encode_texts(edge, v, packed=packed), v)
        assert sorted(map(str, (tuple(r) for r in back.collect()))) == sorted(str((i, t or "")) for i, t, *_ in edge_rows)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")
def test_query_is_the_library(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for i, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = queries.op11_byte_bpe(spark, DATA)
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert sorted(map(tuple, got.collect())) == sorted(want)
