"""Media columns: telephony audio in WAV form, to linear and resampled PCM.

A media column holds RIFF/WAVE bytes: mu-law (format 7), A-law (6) or IMA ADPCM (17)
at 8 kHz mono. mu-law and A-law expand by 256-entry tables; ADPCM decodes all blocks
of a batch side by side, step by step along the block. Resampled PCM is 16 kHz, 16 bit,
little endian, by linear interpolation.

Null and edge cases: a null payload is the empty payload; payloads are padded with
bytes 0 to a positive multiple of 64 when they are stored from text; media that is null
or not in one of the three forms gives null PCM; repeated rows give equal results; an
empty table an empty result; other columns are kept.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docloom.llm.arrow import map_columns

UNIT = 64
RATE, OUT_RATE = 8000, 16000
ALAW, ULAW, ADPCM = 6, 7, 17
#: An ADPCM block: 4 bytes of header and two samples in each further byte.
BLOCK, BLOCK_SAMPLES = 64, 121


def ulaw_table() -> np.ndarray:
    """The 16-bit values of the 256 mu-law codes, by the G.711 rule."""
    code = ~np.arange(256) & 0xFF
    value = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -value, value).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The 16-bit values of the 256 A-law codes, by the G.711 rule."""
    code = np.arange(256) ^ 0x55
    step, low = (code >> 4) & 7, (code & 15) << 4
    value = np.where(step == 0, low + 8, (low + 0x108) << np.maximum(step - 1, 0))
    return np.where(code & 128, value, -value).astype(np.int16)


def step_table() -> np.ndarray:
    """The 89 IMA step sizes (fixed values of the published format)."""
    return np.array(
        "7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 143 157 173 190 "
        "209 230 253 279 307 337 371 408 449 494 544 598 658 724 796 876 963 1060 1166 1282 1411 1552 1707 1878 2066 "
        "2272 2499 2749 3024 3327 3660 4026 4428 4871 5358 5894 6484 7132 7845 8630 9493 10442 11487 12635 13899 15289 "
        "16818 18500 20350 22385 24623 27086 29794 32767".split(),
        dtype=np.int32,
    )


MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
ULAW_PCM, ALAW_PCM, STEPS = ulaw_table(), alaw_table(), step_table()


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM blocks (n, BLOCK) of bytes to samples (n, BLOCK_SAMPLES); all blocks move together."""
    out = np.empty((BLOCK_SAMPLES, len(blocks)), np.int16)
    low = blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int32) << 8)
    value = np.where(low >= 32768, low - 65536, low)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[0] = value
    data = np.ascontiguousarray(blocks[:, 4:].T).astype(np.int32)
    at = 1
    for byte in data:
        for nibble in (byte & 15, byte >> 4):
            step = STEPS[index]
            part = nibble & 7
            # ((2 * part + 1) * step) >> 3, but each bit's share is cut on its own, as the format says.
            delta = (step >> 3) + (part >> 2) * step + ((part >> 1) & 1) * (step >> 1) + (part & 1) * (step >> 2)
            value = np.clip(np.where(nibble & 8, value - delta, value + delta), -32768, 32767)
            index = np.clip(index + MOVES[part], 0, 88)
            out[at] = value
            at += 1
    return np.ascontiguousarray(out.T)


def wav(payload: bytes, code: int) -> bytes:
    """8 kHz mono WAVE bytes around 8-bit codes or ADPCM blocks."""
    if code == ADPCM:
        form = struct.pack("<HHIIHHHH", code, 1, RATE, RATE * BLOCK // BLOCK_SAMPLES, BLOCK, 4, 2, BLOCK_SAMPLES)
    else:
        form = struct.pack("<HHIIHHH", code, 1, RATE, RATE, 1, 8, 0)
    body = b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def read_wav(media: bytes | None) -> tuple[int, bytes] | None:
    """(format, data) of WAVE bytes, or None; other chunks are passed over."""
    if not media or len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, code = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and size >= 16:
            code, channels = struct.unpack_from("<HH", media, at + 8)
            if channels != 1 or code not in (ALAW, ULAW, ADPCM):
                return None
        elif name == b"data" and code is not None:
            data = media[at + 8 : at + 8 + size]
            return (code, data) if len(data) == size else None
        at += 8 + size + size % 2
    return None


def resample(pcm: np.ndarray) -> np.ndarray:
    """8 kHz to 16 kHz: each sample, then the middle to the next one (the last is held)."""
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    if len(pcm):
        wide = pcm.astype(np.int32)
        out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
        out[-1] = pcm[-1]
    return out


def feature(pcm: np.ndarray) -> str:
    """Samples, peak, mean square and zero crossings, in exact integers."""
    if not len(pcm):
        return "0:0:0:0"
    wide = pcm.astype(np.int64)
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{len(pcm)}:{int(np.abs(wide).max())}:{int(wide @ wide) // len(pcm)}:{crossings}"


def decode_all(media: list[bytes | None]) -> tuple[list, list, list, list]:
    """(format, payload, resampled PCM bytes, feature) of each media value."""
    read = [read_wav(m) for m in media]
    blocks = [r[1] if r and r[0] == ADPCM and len(r[1]) % BLOCK == 0 else b"" for r in read]
    flat = np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, BLOCK)
    samples, at = adpcm_blocks(flat), 0
    names = {ALAW: "alaw", ULAW: "ulaw", ADPCM: "adpcm"}
    codes, payloads, pcms, features = [], [], [], []
    for r, own in zip(read, blocks):
        if r is None:
            pcm = None
        elif r[0] == ADPCM:
            n = len(own) // BLOCK
            pcm = samples[at : at + n].reshape(-1) if len(own) == len(r[1]) else None
            at += n
        else:
            pcm = (ULAW_PCM if r[0] == ULAW else ALAW_PCM)[np.frombuffer(r[1], np.uint8)]
        codes.append(r and names[r[0]])
        payloads.append(r and r[1])
        pcms.append(None if pcm is None else resample(pcm).tobytes())
        features.append(None if pcm is None else feature(pcm))
    return codes, payloads, pcms, features


def store_text(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds ``media``: the UTF-8 text, padded, as the 8-bit codes or ADPCM blocks of a WAVE file.

    The form follows the payload's number of units (mu-law, A-law, ADPCM in turn), so that equal texts are stored alike.
    """

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for value in batch.column(text).cast(pa.large_binary()).to_pylist():
            data = value or b""
            units = max(1, -(-len(data) // UNIT))
            out.append(wav(data.ljust(units * UNIT, b"\0"), (ULAW, ALAW, ADPCM)[units % 3]))
        return {media: pa.array(out, pa.binary())}

    return map_columns(docs, run, tuple(docs.columns), f"{media} binary")


def transcode(df: DataFrame, media: str = "media", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Adds codec, payload (the stored codes read back), pcm (16 kHz linear) and feature."""
    keep = tuple(df.columns) if keep is None else keep

    def run(batch: pa.RecordBatch) -> dict:
        return dict(zip(("codec", "payload", "pcm", "feature"), decode_all(batch.column(media).to_pylist())))

    return map_columns(df, run, keep, "codec string, payload binary, pcm binary, feature string", limit=2 << 20)


def byte_length(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
