import hashlib
import math
import struct
import zlib

import numpy as np
import pytest

from docloom.llm import op10_media as ten


STEPS = ten.ima_steps().tolist()


def mu_law(byte):
    """A sample by the rule of G.711, bit by bit."""
    byte ^= 0xFF
    size = ((byte % 16) * 2 + 33) * 2 ** (byte // 16 % 8) - 33
    return -4 * size if byte >= 128 else 4 * size


def a_law(byte):
    byte ^= 0x55
    chord, step = byte // 16 % 8, byte % 16
    size = 2 * step + 1 if chord == 0 else (2 * step + 33) * 2 ** (chord - 1)
    return 8 * size if byte >= 128 else -8 * size


def ima(payload):
    """Samples of blocks that begin at 0 and step 7, one nibble after another."""
    out = []
    for i in range(0, len(payload), 64):
        value, index = 0, 0
        out.append(0)
        for byte in payload[i : i + 64]:
            for nibble in (byte % 16, byte // 16):
                step = STEPS[index]
                delta = step // 8 + sum(step // 2**n for n, bit in ((0, 4), (1, 2), (2, 1)) if nibble & bit)
                value = max(-32768, min(32767, value - delta if nibble >= 8 else value + delta))
                index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[nibble % 8]))
                out.append(value)
    return out


def expected(raw):
    """media and feature of a text's bytes, without numpy."""
    pay = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
    kind = zlib.crc32(pay) % 3
    data = b"".join(b"\0\0\0\0" + pay[i : i + 64] for i in range(0, len(pay), 64)) if kind == 2 else pay
    per = 129 if kind == 2 else 1
    align = 68 if kind == 2 else 1
    form = struct.pack("<HHIIHH", (7, 6, 17)[kind], 1, 8000, 8000 * align // per, align, 4 if kind == 2 else 8) + (struct.pack("<HH", 2, 129) if kind == 2 else b"\0\0")
    x = ima(pay) if kind == 2 else [(mu_law, a_law)[kind](b) for b in pay]
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, len(x)) + b"data" + struct.pack("<I", len(data)) + data
    media = b"RIFF" + struct.pack("<I", len(body)) + body
    y = [v for a, b in zip(x, x[1:] + x[-1:]) for v in (a, (a + b) // 2)]
    rms = math.sqrt(sum(v * v for v in y) / len(y))
    crossings = sum((a < 0) != (b < 0) for a, b in zip(y, y[1:]))
    pcm = struct.pack(f"<{len(y)}h", *y)
    return pay, media, f"rate=16000;samples={len(y)};rms={rms:.0f};peak={max(map(abs, y))};crossings={crossings};pcm_crc32={zlib.crc32(pcm)}", pcm


@pytest.mark.parametrize("where", ["sf", "odd_docs", "empty_docs"])
def test_payload(spark, where, request):
    d = request.getfixturevalue(where)
    want, kinds = [], set()
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        raw = (r.text or "").encode()
        pay, media, feature, pcm = expected(raw)
        kinds.add(media[20])
        want.append((r.doc_id, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, zlib.crc32(pcm)))
    got = [(*r[:8], zlib.crc32(bytes(r.pcm)[44:])) for r in ten.op10_media(spark, d).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert where != "sf" or kinds == {6, 7, 17}


def test_lower_rates_are_filtered():
    t = np.arange(8000) / 8000
    high, low = (np.sin(2 * np.pi * f * t) * 10000 for f in (3000, 300))
    kept = ten.resample(low.astype(np.int16), 8000, 4000)
    assert len(kept) == 4000 and np.abs(kept[100:-100] - low[::2][100:-100]).max() < 200
    assert np.abs(ten.resample(high.astype(np.int16), 8000, 4000)[100:-100]).max() < 200


def test_laws():
    mu, a = ten.mulaw_table(), ten.alaw_table()
    assert (mu[0], mu[0x80], mu[0xFF], mu[0x7F], mu[0x0F]) == (-32124, 32124, 0, 0, -16764)
    assert (a[0xD5], a[0x55], a[0x2A], a[0xAA]) == (8, -8, -32256, 32256)
    assert len(set(a.tolist())) == 256 and len(set(mu.tolist())) == 255


def test_ima_round_trip():
    t = np.arange(3000)
    x = (8000 * np.sin(t / 20)).astype(np.int16)
    data = ten.encode_ima(x, 64)
    y = ten.decode_ima(data, 64)[: len(x)]
    assert np.abs(y[200:].astype(int) - x[200:]).max() < 900
    # across blocks equals one block after another
    assert (np.concatenate([ten.decode_ima(data[i : i + 64], 64) for i in range(0, len(data), 64)])[: len(x)] == y).all()


def test_columns(spark):
    tone = (3000 * np.sin(np.arange(800) / 5)).astype("<i2")
    rows = [(1, ten.wav(bytes(range(256)))), (2, ten.wav(bytes(range(256)), ten.ALAW)), (3, ten.wav(ten.encode_ima(tone, 64), ten.IMA, 8000, 4, 64)), (4, ten.wav(tone.tobytes(), ten.PCM, 11025, 16, 2)), (5, None), (6, b"RIFFxxxx"), (7, b""), (8, ten.wav(b""))]
    got = {r.k: r for r in ten.telephony_to_pcm(spark.createDataFrame(rows, "k int, media binary")).collect()}
    assert got[1].seconds == got[2].seconds == 512 / 16000 and got[4].pcm_rate == 16000
    kind, rate, align, data = ten.read_wav(bytes(got[1].pcm))
    assert (kind, rate, align) == (1, 16000, 2) and (np.frombuffer(data, "<i2")[::2] == ten.mulaw_table()).all()
    assert got[5].error == "null" and got[5].pcm is None and got[6].error and got[7].error and got[8].seconds == 0
