"""Checksummed addresses: published vectors, and a plain Keccak one message at a time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkweave.functions import checksum
from linkweave.plans.queries import QUERIES

#: The vectors of the standard: all caps, all lower, and four others.
PUBLISHED = [
    "0x52908400098527886E0F7030069857D2E4169EE7",
    "0xde709f2102306220921060314715629080e2fb77",
    "0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed",
    "0xfB6916095ca1df60bB79Ce92cE3Ea74c37c5d359",
    "0xdbF03B407c01E7cD3CBea99509d93f8DDDC8C6FB",
    "0xD1220A0cf47c7B9Be7A2E6BA89F429762e7b9aDb",
]


def _keccak(message: bytes) -> bytes:
    """One message, by the definition over integers, with constants from the rule's bits."""
    mask = (1 << 64) - 1
    turn = lambda v, n: ((v << n) | (v >> (64 - n))) & mask if n else v
    padded = bytearray(message + b"\x01" + b"\0" * (135 - len(message)))
    padded[-1] |= 0x80
    s = {(i % 5, i // 5): int.from_bytes(padded[8 * i : 8 * i + 8], "little") if i < 17 else 0 for i in range(25)}
    lfsr = 1
    for _ in range(24):
        parity = [s[x, 0] ^ s[x, 1] ^ s[x, 2] ^ s[x, 3] ^ s[x, 4] for x in range(5)]
        s = {(x, y): v ^ parity[(x + 4) % 5] ^ turn(parity[(x + 1) % 5], 1) for (x, y), v in s.items()}
        x, y, held = 1, 0, s[1, 0]
        for t in range(24):
            x, y = y, (2 * x + 3 * y) % 5
            held, s[x, y] = s[x, y], turn(held, (t + 1) * (t + 2) // 2 % 64)
        s = {(x, y): s[x, y] ^ (~s[(x + 1) % 5, y] & mask & s[(x + 2) % 5, y]) for x in range(5) for y in range(5)}
        for j in range(7):
            s[0, 0] ^= (lfsr & 1) << (2**j - 1)
            lfsr = lfsr << 1 ^ (0x171 if lfsr >> 7 else 0)
    return b"".join(s[x, 0].to_bytes(8, "little") for x in range(4))


def _plain(address: str) -> str:
    digest = _keccak(address[2:].encode()).hex()
    return "0x" + "".join(c.upper() if int(d, 16) >= 8 else c for c, d in zip(address[2:], digest, strict=False))


def test_digests():
    assert checksum.keccak256(np.zeros((1, 0), np.uint8))[0].tobytes().hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    dice = random.Random(2)
    for length in (1, 8, 40, 135):
        messages = [bytes(dice.randrange(256) for _ in range(length)) for _ in range(20)]
        got = checksum.keccak256(np.array([list(m) for m in messages], dtype=np.uint8))
        assert [r.tobytes() for r in got] == [_keccak(m) for m in messages]
    with pytest.raises(ValueError):
        checksum.keccak256(np.zeros((1, 136), np.uint8))


def test_published_vectors(spark):
    rows = spark.createDataFrame([(n, a) for n, a in enumerate([*PUBLISHED, None, "0x12", f" {PUBLISHED[2].lower()} ", "0X" + PUBLISHED[2][2:]])], "n int, a string")
    got = rows.select("n", checksum.checksum_address(F.lower("a")).alias("c"), checksum.has_valid_checksum(F.col("a")).alias("ok")).orderBy("n").collect()
    assert [r["c"] for r in got[:6]] == PUBLISHED
    assert [r["ok"] for r in got[:6]] == [None, None, True, True, True, True]
    assert [r["c"] for r in got[6:9]] == [None, None, PUBLISHED[2]] and {r["ok"] for r in got[6:]} == {None}
    swapped = spark.createDataFrame([(PUBLISHED[2].swapcase().replace("0X", "0x"),)], "a string")
    assert swapped.select(checksum.has_valid_checksum(F.col("a"))).first()[0] is False
    assert rows.where("false").select(checksum.checksum_address(F.col("a"))).count() == 0


def test_query_against_the_plain_digest(spark):
    got = QUERIES["address_checksums"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 150 and all(r["checksummed"] == _plain(r["address"]) for r in got)
