"""Media columns: telephony audio.

Mu-law and A-law samples are expanded by lookup tables of 256 entries that are built from the two rules of
ITU-T G.711. IMA ADPCM is decoded with numpy across the blocks of all media of a batch: every block takes its next
nibble at once, so Python loops over the samples of a block, not over a file. What is decoded is resampled and stored
as a PCM WAV file: by linear interpolation, behind a low-pass filter where the rate falls.

The query stores each text's bytes in a WAV file: its payload's checksum chooses mu-law samples, A-law samples or the
nibbles of IMA ADPCM blocks, which all hold any bytes without loss (an ADPCM block has the payload's 64 bytes behind a
header of zeros). The files are written as a table in the shared folder and read back; digests and features are of
what was read, and the resampled PCM file is a column of the result.

Defined results: null and empty texts are 64 zero bytes; a very long text is one file (a WAV file holds 4 GB); media that
is null or can't be read gives null results and its reason in column error; a null id stays null; repeated rows give
repeated rows; an empty table gives none; columns of the input that bear a name of a result are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import BINARY, DOUBLE, INT, LONG, STRING, Scratch, append_columns, field, table, utf8

PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
BLOCK = 64
RATE, TARGET_RATE = 8_000, 16_000
#: Bytes of an ADPCM block before its nibbles, and taps of the low-pass filter.
IMA_HEAD, TAPS = 4, 127


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int64) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84) << ((code & 0x70) >> 4)
    return np.where(code & 0x80, 0x84 - size, size - 0x84).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int64) ^ 0x55
    exponent, low = (code & 0x70) >> 4, (code & 0x0F) << 4
    size = np.where(exponent == 0, low + 8, (low + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = mulaw_table(), alaw_table()


def ima_steps() -> np.ndarray:
    #: Fixed values of the IMA ADPCM format: its 89 step sizes.
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
        1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
        8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ], dtype=np.int64)


#: Fixed values of the IMA ADPCM format: change of the step index by the low three bits of a nibble.
IMA_MOVE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int64)


def decode_ima(data: bytes, block: int) -> np.ndarray:
    """Mono samples of whole blocks: each has a first sample, a step index and nibbles, the low one first."""
    steps = ima_steps()
    rows = np.frombuffer(data, np.uint8)[: len(data) // block * block].reshape(-1, block)
    if not len(rows):
        return np.empty(0, np.int16)
    value = rows[:, :2].copy().view("<i2")[:, 0].astype(np.int64)
    index = np.clip(rows[:, 2].astype(np.int64), 0, 88)
    out = np.empty((len(rows), 1 + 2 * (block - 4)), np.int16)
    out[:, 0] = value
    for k in range(block - 4):
        for half in (0, 1):
            nibble = (rows[:, 4 + k] >> (4 * half)).astype(np.int64) & 15
            step = steps[index]
            delta = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
            value = np.clip(value + np.where(nibble & 8, -delta, delta), -32768, 32767)
            index = np.clip(index + IMA_MOVE[nibble & 7], 0, 88)
            out[:, 1 + 2 * k + half] = value
    return out.ravel()


def encode_ima(samples: np.ndarray, block: int) -> bytes:
    """Blocks of samples, the last filled up with its last sample."""
    steps, per = ima_steps(), 1 + 2 * (block - 4)
    n = -(-len(samples) // per)
    rows = np.concatenate([samples, np.full(n * per - len(samples), samples[-1] if len(samples) else 0)]).astype(np.int64).reshape(n, per)
    out = np.zeros((n, block), np.uint8)
    out[:, :2] = rows[:, :1].astype("<i2").view(np.uint8)
    value, index = rows[:, 0].copy(), np.searchsorted(steps[:88], np.abs(rows[:, 1] - rows[:, 0]))
    out[:, 2] = index
    for k in range(per - 1):
        step, gap = steps[index], rows[:, k + 1] - value
        left, nibble, delta = np.abs(gap), np.where(gap < 0, 8, 0), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            on = left >= part
            nibble, delta, left = nibble | np.where(on, bit, 0), delta + np.where(on, part, 0), left - np.where(on, part, 0)
        value = np.clip(value + np.where(nibble & 8, -delta, delta), -32768, 32767)
        index = np.clip(index + IMA_MOVE[nibble & 7], 0, 88)
        out[:, 4 + k // 2] |= (nibble << (4 * (k % 2))).astype(np.uint8)
    return out.tobytes()


def wav(data: bytes, kind: int = MULAW, rate: int = RATE, bits: int = 8, align: int = 1) -> bytes:
    """A mono RIFF WAVE file; other than PCM also holds the count of samples, as the format asks."""
    per = 1 + 2 * (align - 4) if kind == IMA else 0
    extra = struct.pack("<HH", 2, per) if kind == IMA else b"" if kind == PCM else struct.pack("<H", 0)
    second = rate * align // per if kind == IMA else rate * align
    form = struct.pack("<HHIIHH", kind, 1, rate, second, align, bits) + extra
    count = len(data) // align * per if kind == IMA else len(data) // align
    fact = b"" if kind == PCM else b"fact" + struct.pack("<II", 4, count)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """Format, rate, bytes of a block, and stored samples."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            if form is None or at + 8 + size > len(media):
                raise ValueError("no format, or data cut short")
            if form[1] != 1:
                raise ValueError("more than one channel")
            return form[0], form[2], form[4], media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data")


def payload_of(kind: int, stored: bytes, align: int) -> bytes:
    """Stored bytes without the headers of blocks."""
    if kind != IMA:
        return stored
    return np.frombuffer(stored, np.uint8).reshape(-1, align)[:, IMA_HEAD:].tobytes()


def expand(media: list[tuple[int, bytes, int]]) -> list[np.ndarray]:
    """16 bit samples of each (format, stored bytes, bytes of a block). ADPCM blocks of one length are decoded together."""
    out: list = [None] * len(media)
    together: dict[int, list[int]] = {}
    for i, (kind, stored, align) in enumerate(media):
        if kind in (MULAW, ALAW):
            out[i] = (MULAW_TABLE if kind == MULAW else ALAW_TABLE)[np.frombuffer(stored, np.uint8)]
        elif kind == PCM and align == 2:
            out[i] = np.frombuffer(stored[: len(stored) // 2 * 2], "<i2")
        else:
            together.setdefault(align, []).append(i)
    for align, members in together.items():
        counts = [len(media[i][1]) // align for i in members]
        samples = decode_ima(b"".join(media[i][1][: n * align] for i, n in zip(members, counts)), align)
        for i, x in zip(members, np.split(samples, np.cumsum(counts)[:-1] * (1 + 2 * (align - IMA_HEAD)))):
            out[i] = x
    return out


def readable(data: bytes | None) -> tuple[int, int, int, bytes]:
    """As read_wav, of media that expand() takes; a ValueError says why not."""
    if data is None:
        raise ValueError("null")
    kind, rate, align, stored = read_wav(data)
    if rate <= 0:
        raise ValueError("no rate")
    if kind == IMA and align <= IMA_HEAD:
        raise ValueError("blocks too short")
    if kind not in (MULAW, ALAW, IMA) and not (kind == PCM and align == 2):
        raise ValueError(f"format {kind} isn't telephony audio")
    return kind, rate, align, stored


def low_pass(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """x without what is above half the target rate: a sinc under a Hann window, of gain 1 at rest."""
    at = np.arange(TAPS) - TAPS // 2
    taps = np.sinc(at * (target / rate)) * np.hanning(TAPS + 2)[1:-1]
    return np.convolve(np.pad(x.astype(np.float64), TAPS // 2, mode="edge"), taps / taps.sum(), mode="valid")


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation at the target's times, behind a low-pass filter for a lower rate; behind the last sample its value is held."""
    if rate == target or not len(x):
        return x
    if target == 2 * rate:
        out = np.empty(2 * len(x), np.int16)
        out[::2] = x
        wide = x.astype(np.int32)
        out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
        out[-1] = x[-1]
        return out
    at = np.arange(len(x) * target // rate) * (rate / target)
    smooth = low_pass(x, rate, target) if target < rate else x
    return np.clip(np.floor(np.interp(at, np.arange(len(x)), smooth)), -32768, 32767).astype(np.int16)


def features(x: np.ndarray, rate: int) -> str:
    """Length, level, peak, zero crossings and a digest of the samples."""
    wide = x.astype(np.int64)
    rms = (int(np.dot(wide, wide)) / max(1, len(x))) ** 0.5
    peak = int(np.abs(wide).max()) if len(x) else 0
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"rate={rate};samples={len(x)};rms={rms:.0f};peak={peak};crossings={crossings};pcm_crc32={zlib.crc32(x.astype('<i2').tobytes())}"


PCM_FIELDS = [field("pcm", BINARY), field("pcm_rate", INT), field("seconds", DOUBLE), field("feature", STRING), field("error", STRING)]
PAYLOAD_FIELDS = [field("payload_bytes", LONG), field("payload_sha256", STRING), field("tail_crc32", LONG), field("media_bytes", LONG), field("media_sha256", STRING)]


def pcm_columns(media: list, target: int) -> list[list]:
    """Values of PCM_FIELDS for each of the media."""
    rows: list = []
    for data in media:
        try:
            rows.append(readable(data))
        except (ValueError, struct.error) as e:
            rows.append(str(e))
    sounds = iter(expand([(r[0], r[3], r[2]) for r in rows if not isinstance(r, str)]))
    out: list[list] = [[] for _ in PCM_FIELDS]
    for r in rows:
        if isinstance(r, str):
            found = (None, None, None, None, r)
        else:
            x = resample(next(sounds), r[1], target)
            found = (wav(x.astype("<i2").tobytes(), PCM, target, 16, 2), target, len(x) / target, features(x, target), None)
        for values, value in zip(out, found):
            values.append(value)
    return out


def payload_columns(media: list, block: int) -> list[list]:
    """Values of PAYLOAD_FIELDS for each of the media."""
    out: list[list] = [[] for _ in PAYLOAD_FIELDS]
    for data in media:
        try:
            kind, _, align, held = readable(data)
            payload = payload_of(kind, held, align)
            found = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-block:]), len(data), hashlib.sha256(data).hexdigest())
        except (ValueError, struct.error):
            found = (None,) * len(out)
        for values, value in zip(out, found):
            values.append(value)
    return out


def telephony_to_pcm(df: DataFrame, media: str = "media", target: int = TARGET_RATE) -> DataFrame:
    """df with pcm (a 16 bit WAV file at the target rate), pcm_rate, seconds, feature and error."""
    return append_columns(df, [media], lambda: lambda c: pcm_columns(c.to_pylist(), target), PCM_FIELDS)


def stored_media(raw: bytes, block: int = BLOCK) -> bytes:
    """The WAV file of a text's bytes and zeros up to a positive multiple of block."""
    payload = raw + b"\0" * (-len(raw) % block or block * (not raw))
    kind = (MULAW, ALAW, IMA)[zlib.crc32(payload) % 3]
    if kind != IMA:
        return wav(payload, kind)
    rows = np.frombuffer(payload, np.uint8).reshape(-1, block)
    blocks = np.concatenate([np.zeros((len(rows), IMA_HEAD), np.uint8), rows], axis=1)
    return wav(blocks.tobytes(), IMA, bits=4, align=IMA_HEAD + block)


def store_payload(df: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """df with n_bytes of the text in UTF-8, and media, the WAV file that holds them."""
    return append_columns(df, [text], lambda: lambda c: [list(map(len, raw := utf8(c))), [stored_media(x, block) for x in raw]], [field("n_bytes", LONG), field("media", BINARY)])


def payload_report(df: DataFrame, media: str = "media", block: int = BLOCK, target: int = TARGET_RATE) -> DataFrame:
    """df with what its media holds (payload_bytes, payload_sha256, tail_crc32 of the last block bytes, media_bytes, media_sha256), and the columns of telephony_to_pcm."""
    return append_columns(df, [media], lambda: lambda c: payload_columns(x := c.to_pylist(), block) + pcm_columns(x, target), PAYLOAD_FIELDS + PCM_FIELDS)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = Scratch(spark, "media").write(store_payload(docs).drop("text"), "media")
    return payload_report(kept).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm")
