"""The query's features and resampled samples against plain Python, one sample at a time."""

import hashlib
import struct

from docloom.llm import queries, telephony


def ulaw(code):
    code = ~code & 255
    value = (((code & 15) * 8 + 132) << (code >> 4 & 7)) - 132
    return -value if code & 128 else value


def alaw(code):
    code ^= 0x55
    step, low = code >> 4 & 7, (code & 15) * 16
    value = low + 8 if step == 0 else (low + 264) << step - 1
    return value if code & 128 else -value


def adpcm(block):
    sizes = telephony.STEPS.tolist()
    value, index = struct.unpack_from("<hB", block)
    index = min(index, 88)
    out = [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            size = sizes[index]
            delta = size // 8 + sum(size >> cut for bit, cut in ((4, 0), (2, 1), (1, 2)) if nibble & bit)
            value = max(-32768, min(32767, value - delta if nibble & 8 else value + delta))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[nibble & 7]))
            out.append(value)
    return out


def test_features_and_pcm_equal_brute_force(spark, tmp_path):
    texts = ["a", "short text äöü " * 7, "x" * 128, None, "", "ÿ~ " * 61, "one more of 64 units" * 40, "z" * 190]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op1_telephony_audio(spark, str(tmp_path)).collect()}
    assert {r.codec for r in got.values()} == {"ulaw", "alaw", "adpcm"}
    for k, text in enumerate(texts):
        data = (text or "").encode()
        data = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
        if got[k].codec == "adpcm":
            samples = [v for at in range(0, len(data), 64) for v in adpcm(data[at : at + 64])]
        else:
            samples = [(ulaw if got[k].codec == "ulaw" else alaw)(b) for b in data]
        cross = sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:]))
        assert got[k].feature == f"{len(samples)}:{max(map(abs, samples))}:{sum(v * v for v in samples) // len(samples)}:{cross}"
        wide = [v for a, b in zip(samples, [*samples[1:], samples[-1]]) for v in (a, a + b >> 1)]
        assert got[k].pcm_sha256 == hashlib.sha256(struct.pack(f"<{len(wide)}h", *wide)).hexdigest()
