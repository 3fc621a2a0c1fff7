import hashlib
import struct
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

from tessera.llm import media


def test_companding_tables():
    mu, a = media.TABLES["mulaw"], media.TABLES["alaw"]
    assert (mu[0xFF], mu[0x7F], mu[0x00], mu[0x80], mu[0xF0]) == (0, 0, -32124, 32124, 120)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    assert len(set(a.tolist())) == 256 and len(set(mu.tolist())) == 255


def plain_adpcm(block):
    value, index = struct.unpack("<h", block[:2])[0], min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            d = step >> 3
            d += step >> 2 if n & 1 else 0
            d += step >> 1 if n & 2 else 0
            d += step if n & 4 else 0
            value = max(-32768, min(32767, value - d if n & 8 else value + d))
            index = max(0, min(88, index + int(media.MOVES[n & 7])))
            out.append(value)
    return out


def test_adpcm_equals_a_plain_decoder():
    data = np.random.default_rng(5).integers(0, 256, 192 * 9, dtype=np.uint8)
    got = media.decode_adpcm(data)
    assert got.tolist() == [plain_adpcm(data[i * 192 : i * 192 + 192].tobytes()) for i in range(9)]


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "adpcm", None])
def test_wave_files_give_back_their_bytes(codec):
    data = bytes(range(192)) * 2
    name, rate, back = media.read_wav(media.write_wav(data, codec))
    assert (name, rate, bytes(back)) == (codec, 8000, data)
    with pytest.raises(ValueError, match="WAVE"):
        media.read_wav(b"nothing")


def test_resampling_keeps_samples_and_levels():
    x = np.full(50, 1000, np.int16)
    y = media.resample(x)
    assert y[::2].tolist() == x.tolist() and abs(y[1::2].astype(int) - 1000).max() <= 1
    assert len(media.resample(x[:0])) == 0


def test_every_row_round_trips(edge, edge_rows, none):
    stored = media.encode_media(edge).collect()
    files = {}
    for r in stored:
        files.setdefault((r["doc_id"], hashlib.sha256(r["media"]).hexdigest()), bytes(r["media"]))
    got = media.telephony_media(edge).collect()
    assert len(got) == len(edge_rows) == len(stored)
    want = {}
    for i, t, *_ in edge_rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        want[i, len(raw), hashlib.sha256(payload).hexdigest()] = (len(payload), zlib.crc32(payload[-16:]), raw)
    for r in got:
        size, tail, raw = want[r["doc_id"], r["n_bytes"], r["payload_sha256"]]
        file = files[r["doc_id"], r["media_sha256"]]
        assert (r["payload_bytes"], r["tail_crc32"], r["media_bytes"]) == (size, tail, len(file))
        codec, rate, back = media.read_wav(file)
        assert bytes(back).rstrip(b" ") == raw.rstrip(b" ") and r["feature"].startswith(codec)
        pcm = bytes(r["pcm"])
        assert (len(pcm), hashlib.sha256(pcm).hexdigest()) == (r["pcm_bytes"], r["pcm_sha256"])
        samples = media.decode_adpcm(np.frombuffer(back, np.uint8)).reshape(-1) if codec == "adpcm" else media.expand(np.frombuffer(back, np.uint8), codec)
        assert pcm == media.write_wav(media.resample(samples).tobytes(), None, 16000)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r["payload_sha256"], (r["feature"], r["media_sha256"])) == (r["feature"], r["media_sha256"])
    short = media.telephony_media(none, keep_pcm=False)
    assert short.count() == 0 and "pcm" not in short.columns


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "adpcm"])
def test_segments_make_no_difference(codec, monkeypatch):
    data = np.random.default_rng(6).integers(0, 256, 192 * 23, dtype=np.uint8).tobytes()
    whole = media.described(media.write_wav(data, codec))
    monkeypatch.setattr(media, "SEGMENT", 192)
    assert media.described(media.write_wav(data, codec)) == whole
    parts = np.split(np.arange(-20, 21, dtype=np.int16), [1, 2, 3, 9, 10, 30])
    assert np.concatenate(list(media.resampled(parts))).tolist() == media.resample(np.arange(-20, 21, dtype=np.int16)).tolist()


def test_memory_of_a_text_of_100_megabytes():
    """Beside the file and its PCM a worker holds little."""
    code = """
import resource
from tessera.llm import media
text = b"some words of a very long text " * (100 * 2**20 // 31)
for codec, most in (("mulaw", 1100), ("adpcm", 1900)):
    file = media.write_wav(media.payload_of(text), codec)
    got = media.described(file)
    assert got["pcm_bytes"] > 4 * len(text) and len(got["pcm"]) == got["pcm_bytes"]
    del got
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < most * 1024
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[2])
