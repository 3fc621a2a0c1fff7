import numpy as np

from tessera.llm import hashstore as h


def test_files_give_back_their_arrays(tmp_path):
    arrays = {"a": np.arange(5, dtype=np.uint64), "none": np.zeros(0, np.int32), "two": np.arange(6, dtype=np.int64).reshape(2, 3), "flag": np.array([True, False])}
    uri = f"file://{tmp_path}/x/000001"
    h.save(uri, **arrays)
    h.save(uri, **arrays)  # a repeated task
    got = h.load(uri)
    assert got.held == 0 and all(got[k].dtype == v.dtype and got[k].tolist() == v.tolist() for k, v in arrays.items())
    assert h.load(f"file://{tmp_path}/x/000002") is None and len(list((tmp_path / "x").iterdir())) == 1


def test_lookups_by_key_and_by_route(tmp_path):
    r = np.random.default_rng(1)
    keys, route = np.unique(r.integers(0, 2**63, 3000, dtype=np.uint64)), None
    route = r.integers(0, 2**64, len(keys), dtype=np.uint64)
    count = r.integers(0, 9, len(keys)).astype(np.uint32)
    for name, way in (("plain", keys), ("routed", route)):
        part = h.part_of(way, 7)
        for p in range(7):
            if (part == p).any() and p != 3:
                h.write_part(f"file://{tmp_path}/{name}", p, keys[part == p], {"c": count[part == p]})
        ask = np.concatenate([keys[::-1], keys[:50], np.array([1, 2], np.uint64)])
        by = np.concatenate([way[::-1], way[:50], np.array([1, 2], np.uint64)])
        hit, got = h.HashStore(f"file://{tmp_path}/{name}", 7, ("c",)).lookup(ask, None if name == "plain" else by)
        there = h.part_of(by, 7) != 3
        there[-2:] = False
        assert hit.tolist() == there.tolist()
        assert got["c"].tolist() == np.where(there, np.concatenate([count[::-1], count[:50], [0, 0]]), 0).tolist()


def test_unused_files_are_closed(tmp_path, monkeypatch):
    for i in range(6):
        h.save(f"file://{tmp_path}/{i}", k=np.arange(i + 1))
    kept = h.Recent(files=3)
    for i in (0, 1, 2, 0, 3):
        kept.get(f"file://{tmp_path}/{i}")
    assert [u[-1] for u in kept._have] == ["2", "0", "3"]
    monkeypatch.setattr(h, "IDLE", -1.0)
    kept.get(f"file://{tmp_path}/4")
    assert [u[-1] for u in kept._have] == ["4"] and set(kept._used) == set(kept._have)
    read = h.Recent(most=10)
    monkeypatch.setattr(h, "IDLE", 1e9)
    monkeypatch.setattr(h, "load", lambda uri: h.Arrays({}, 6))
    for i in range(3):
        read.get(str(i))
    assert len(read._have) == 1 and read.held == 6
