import random

import numpy as np
import pytest

from lamina.functions import wordlz as Z


def test_round_trip():
    r = random.Random(3)
    cases = [b"", b"a", b"abcdefg", b"abcdefgh" * 3, b"\0" * 700_000, r.randbytes(300_001), b"all work and no play makes jack a dull boy. " * 30_000]
    cases += [b"".join(r.choice([b"\0" * 8, b"12345678", b"ab", r.randbytes(5)]) for _ in range(r.randrange(400))) for _ in range(60)]
    cases += [np.arange(50_000, dtype="<u4").tobytes(), np.tile(np.arange(300, dtype="<u4"), 500).tobytes()]
    for data in cases:
        packed = Z.compress(data)
        assert Z.decompress(packed) == data and Z.decompressed_length(packed) == len(data) and Z.compressed_length(packed) == len(packed) <= Z.longest_compressed(len(data))
    assert len(Z.compress(cases[4])) < 200 and len(Z.compress(cases[6])) < len(cases[6]) / 2 and len(Z.compress(cases[5])) < len(cases[5]) + 100
    for bad in (b"WLZ0" + b"\0" * 16, Z.compress(b"abc")[:-1]):
        with pytest.raises(ValueError):
            Z.decompress(bad)


def test_hits_equal_a_table():
    r = random.Random(4)
    words = np.array([r.choice([1, 2, 3, r.getrandbits(64)]) for _ in range(5000)], "<u8")
    table, want = {}, []
    for w, h in zip(words.tolist(), Z.hashes(words).tolist(), strict=True):
        want.append(table.get(h) == w)
        table[h] = w
    assert Z.hits_of(words).tolist() == want
