"""Keccak-256 over batches of short byte strings (event signatures).

Spark has no Keccak, and event hashes are Keccak-256 of the canonical signature. Only
signatures are hashed, never log rows, so this stays off the data path. A batch of n
messages is one (25, n) array of 64-bit lanes, so each step is a NumPy vector operation.
"""

from __future__ import annotations

import numpy as np

RATE = 136
ROUNDS = 24


def _round_constants() -> list[np.uint64]:
    # One bit of the degree-8 LFSR x^8+x^6+x^5+x^4+1 per position 2^j-1.
    register, constants = 1, []
    for _ in range(ROUNDS):
        value = 0
        for j in range(7):
            if register & 1:
                value |= 1 << ((1 << j) - 1)
            register = (register << 1) ^ (0x171 if register & 0x80 else 0)
        constants.append(np.uint64(value))
    return constants


def _lane_walk() -> list[tuple[int, int, int]]:
    """(from lane, to lane, left rotation) of the combined rotate-and-move step."""
    walk, x, y = [(0, 0, 0)], 1, 0
    for t in range(24):
        nx, ny = y, (2 * x + 3 * y) % 5
        walk.append((x + 5 * y, nx + 5 * ny, ((t + 1) * (t + 2) // 2) % 64))
        x, y = nx, ny
    return walk


_CONSTANTS = _round_constants()
_WALK = _lane_walk()


def _rotate(lane: np.ndarray, n: int) -> np.ndarray:
    if n == 0:
        return lane.copy()
    return (lane << np.uint64(n)) | (lane >> np.uint64(64 - n))


def _permute(state: np.ndarray) -> np.ndarray:
    for constant in _CONSTANTS:
        grid = state.reshape(5, 5, -1)
        parity = np.bitwise_xor.reduce(grid, axis=0)
        mix = np.stack([parity[(x + 4) % 5] ^ _rotate(parity[(x + 1) % 5], 1) for x in range(5)])
        state = (grid ^ mix[None]).reshape(25, -1)
        moved = np.empty_like(state)
        for source, target, turn in _WALK:
            moved[target] = _rotate(state[source], turn)
        rows = moved.reshape(5, 5, -1)
        state = (rows ^ (~np.roll(rows, -1, axis=1) & np.roll(rows, -2, axis=1))).reshape(25, -1)
        state[0] ^= constant
    return state


def keccak256_many(messages: list[bytes]) -> list[str]:
    """Lower-case hex digests, without 0x, in input order."""
    digests = [""] * len(messages)
    by_blocks: dict[int, list[int]] = {}
    for i, message in enumerate(messages):
        by_blocks.setdefault(len(message) // RATE + 1, []).append(i)
    for blocks, rows in by_blocks.items():
        padded = np.zeros((len(rows), blocks * RATE), dtype=np.uint8)
        for r, i in enumerate(rows):
            message = messages[i]
            padded[r, : len(message)] = np.frombuffer(message, dtype=np.uint8)
            padded[r, len(message)] ^= 0x01
            padded[r, -1] ^= 0x80
        lanes = padded.view("<u8").reshape(len(rows), blocks, RATE // 8)
        state = np.zeros((25, len(rows)), dtype=np.uint64)
        for b in range(blocks):
            state[: RATE // 8] ^= lanes[:, b, :].T
            state = _permute(state)
        out = np.ascontiguousarray(state[:4].T).astype("<u8").tobytes()
        for r, i in enumerate(rows):
            digests[i] = out[32 * r : 32 * r + 32].hex()
    return digests


def event_hash(canonical_signature: str) -> str:
    """topic0 of an event, with 0x."""
    return "0x" + keccak256_many([canonical_signature.encode()])[0]
