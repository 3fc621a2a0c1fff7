import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.hashstore import HashStore, part_of, write_part
from tessera.llm.textkit import blocks, texts, utf8, word_hashes, words

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \n\t\x0b\x1c.", max_size=30)), min_size=1, max_size=8)


@settings(deadline=None, max_examples=60)
@given(TEXT)
def test_words_are_those_of_the_pattern(rows):
    data, off = utf8(pa.array(rows, pa.string()))
    start, end, row = words(data, off)
    got = [(r, data[s:e].tobytes()) for s, e, r in zip(start, end, row, strict=True)]
    assert got == [(i, w.encode()) for i, t in enumerate(rows) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    lower = lambda b: bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    seen = {}
    for (_, w), h in zip(got, word_hashes(data, start, end).tolist(), strict=True):
        assert seen.setdefault(lower(w), h) == h
    assert len(set(seen.values())) == len(seen)


def test_blocks_cover_every_row_within_the_budget():
    rows = ["a" * 10, None, "b" * 300, "", "c" * 5] * 7
    batch = pa.RecordBatch.from_pydict({"text": rows})
    cut = list(blocks(iter([batch.slice(2), batch.slice(0, 0)]), "text", 40))
    assert [x for b in cut for x in b.column("text").to_pylist()] == rows[2:]
    assert all(len(utf8(b.column("text"))[0]) <= 40 or b.num_rows == 1 for b in cut)
    assert texts(batch.column("text"))[:3] == [b"a" * 10, b"", b"b" * 300]


def test_hash_store(tmp_path):
    keys = np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64)
    keys = np.unique(keys)
    for p in range(7):
        own = keys[part_of(keys, 7) == p]
        write_part(str(tmp_path), p, own[::-1], {"v": (own[::-1] % 1000).astype(np.int64)})
    ask = np.concatenate([keys[::3], keys[:5] + np.uint64(1), keys[:1]])
    found, got = HashStore(str(tmp_path), 7, ("v",)).lookup(ask)
    assert found.tolist() == np.isin(ask, keys).tolist()
    assert (got["v"][found] == (ask[found] % 1000)).all()
    assert not HashStore(str(tmp_path / "no"), 7).lookup(ask)[0].any()
