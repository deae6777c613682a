"""Checksummed addresses (EIP-55): the case of each hex letter tells a bit of a Keccak-256 digest.

The digest is computed for all rows of an Arrow batch at once: the sponge's 25 lanes are arrays
with an entry a row, and an address fits one block. Rotations and round constants follow from
the permutation's own rules and are made once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from linkweave.functions.scalar import is_address

#: Bytes of a block of Keccak-256, and its rounds.
RATE, ROUNDS = 136, 24


def _rotations() -> np.ndarray:
    """offsets[x, y]: along the walk (x, y) -> (y, 2x + 3y), the triangular numbers."""
    offsets, x, y = np.zeros((5, 5), dtype=np.uint64), 1, 0
    for t in range(24):
        offsets[x, y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return offsets


def _constants() -> list[np.uint64]:
    """Bits 2^j - 1 of each round from the register with feedback x^8 + x^6 + x^5 + x^4 + 1."""
    found, register = [], 1
    for _ in range(ROUNDS):
        value = 0
        for j in range(7):
            value |= (register & 1) << (2**j - 1)
            register = (register << 1) ^ (0x171 if register & 0x80 else 0)
        found.append(np.uint64(value))
    return found


OFFSETS, CONSTANTS = _rotations(), _constants()


def _rotated(lane: np.ndarray, by: np.uint64) -> np.ndarray:
    return lane if not by else (lane << by) | (lane >> (np.uint64(64) - by))


def keccak256(messages: np.ndarray) -> np.ndarray:
    """Digests (n x 32 bytes) of messages of one length below :data:`RATE`, one a row of bytes."""
    n, length = messages.shape
    if length >= RATE:
        raise ValueError(f"messages of {length} bytes take more than one block")
    block = np.zeros((n, RATE), dtype=np.uint8)
    block[:, :length] = messages
    block[:, length] ^= 0x01
    block[:, RATE - 1] ^= 0x80
    words = block.view("<u8")
    a = [[words[:, x + 5 * y].copy() if x + 5 * y < RATE // 8 else np.zeros(n, np.uint64) for y in range(5)] for x in range(5)]
    for constant in CONSTANTS:
        c = [a[x][0] ^ a[x][1] ^ a[x][2] ^ a[x][3] ^ a[x][4] for x in range(5)]
        d = [c[x - 1] ^ _rotated(c[(x + 1) % 5], np.uint64(1)) for x in range(5)]
        b = [[np.empty(0)] * 5 for _ in range(5)]
        for x in range(5):
            for y in range(5):
                b[y][(2 * x + 3 * y) % 5] = _rotated(a[x][y] ^ d[x], OFFSETS[x, y])
        a = [[b[x][y] ^ (~b[(x + 1) % 5][y] & b[(x + 2) % 5][y]) for y in range(5)] for x in range(5)]
        a[0][0] ^= constant
    return np.stack([a[x][0] for x in range(4)], axis=1).astype("<u8").view(np.uint8).reshape(n, 32)


def checksummed(addresses: np.ndarray) -> np.ndarray:
    """Rows of 42 ASCII bytes, ``0x`` and lower-case hex, with letters raised where the digest's digit is 8 or more."""
    digits = addresses[:, 2:]
    digest = keccak256(digits)
    nibbles = np.stack([digest[:, :20] >> 4, digest[:, :20] & 15], axis=2).reshape(len(addresses), 40)
    out = addresses.copy()
    out[:, 2:] -= (((digits >= ord("a")) & (nibbles >= 8)) * 32).astype(np.uint8)
    return out


@F.arrow_udf(StringType())
def _checksums(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        known = column.drop_null().cast(pa.large_binary())
        rows = np.frombuffer(b"".join(known.to_pylist()), dtype=np.uint8).reshape(-1, 42)
        made = checksummed(rows)
        texts = iter([r.tobytes().decode() for r in made])
        yield pa.array([next(texts) if valid else None for valid in column.is_valid().to_pylist()], pa.string())


def checksum_address(c: Column) -> Column:
    """The checksummed form of an address in any case, trimmed; null for what is no address."""
    return _checksums(F.when(is_address(c), F.lower(F.trim(c))))


def has_valid_checksum(c: Column) -> Column:
    """Whether an address is written in its checksummed form; one letter case alone claims nothing and is null, as is what is no address."""
    own = F.trim(c)
    claims = is_address(c) & (F.substr(own, F.lit(3)) != F.lower(F.substr(own, F.lit(3)))) & (F.substr(own, F.lit(3)) != F.upper(F.substr(own, F.lit(3))))
    return F.when(claims, checksum_address(c) == own)
