"""Keccak-256 of short byte strings, for the handful of configured assets (never for log rows)."""

from __future__ import annotations

_LANES = 1 << 64
_RATE = 136


def _rotations() -> dict[tuple[int, int], int]:
    offsets = {(0, 0): 0}
    x, y = 1, 0
    for step in range(24):
        offsets[x, y] = (step + 1) * (step + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return offsets


def _round_constants() -> list[int]:
    constants, register = [], 1
    for _ in range(24):
        value = 0
        for j in range(7):
            if register & 1:
                value ^= 1 << ((1 << j) - 1)
            register = register << 1 ^ (0x171 if register & 0x80 else 0)
        constants.append(value)
    return constants


_ROTATIONS = _rotations()
_CONSTANTS = _round_constants()


def _rotate(value: int, by: int) -> int:
    return (value << by | value >> (64 - by)) % _LANES


def _permute(state: dict[tuple[int, int], int]) -> None:
    for constant in _CONSTANTS:
        parity = [0] * 5
        for (x, _), lane in state.items():
            parity[x] ^= lane
        moved = {}
        for (x, y), lane in state.items():
            mixed = lane ^ parity[(x + 4) % 5] ^ _rotate(parity[(x + 1) % 5], 1)
            moved[y, (2 * x + 3 * y) % 5] = _rotate(mixed, _ROTATIONS[x, y])
        for (x, y) in moved:
            state[x, y] = moved[x, y] ^ (~moved[(x + 1) % 5, y] % _LANES & moved[(x + 2) % 5, y])
        state[0, 0] ^= constant


def keccak256(message: bytes) -> bytes:
    padded = bytearray(message + b"\x01" + bytes(-(len(message) + 1) % _RATE))
    padded[-1] |= 0x80
    state = {(x, y): 0 for x in range(5) for y in range(5)}
    for start in range(0, len(padded), _RATE):
        for lane in range(_RATE // 8):
            at = start + 8 * lane
            state[lane % 5, lane // 5] ^= int.from_bytes(padded[at : at + 8], "little")
        _permute(state)
    return b"".join(state[x, 0].to_bytes(8, "little") for x in range(4))
