"""A signing key's 32 bytes from a small number, for fixtures: PCG32 fills a ChaCha20 key, whose first output is the seed."""

from __future__ import annotations

M32, M64 = 2**32 - 1, 2**64 - 1
# PCG32's multiplier and increment; ChaCha20's constants ("expand 32-byte k").
PCG_MULTIPLIER, PCG_INCREMENT = 6364136223846793005, 11634580027462260723
CHACHA = (0x61707865, 0x3320646E, 0x79622D32, 0x6B206574)


def _left(x: int, n: int) -> int:
    return (x << n | x >> 32 - n) & M32


def chacha20_block(key: bytes, counter: int = 0, nonce: int = 0) -> bytes:
    """64 bytes of the stream; counter and nonce have 64 bits each."""
    word = lambda b, i: int.from_bytes(b[4 * i : 4 * i + 4], "little")
    start = [*CHACHA, *(word(key, i) for i in range(8)), counter & M32, counter >> 32, nonce & M32, nonce >> 32]
    s = list(start)
    columns = [(i, i + 4, i + 8, i + 12) for i in range(4)]
    diagonals = [(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4) for i in range(4)]
    for _ in range(10):
        for a, b, c, d in columns + diagonals:
            for x, y, z, n in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
                s[x] = (s[x] + s[y]) & M32
                s[z] = _left(s[z] ^ s[x], n)
    return b"".join(((x + y) & M32).to_bytes(4, "little") for x, y in zip(s, start, strict=True))


def seed_of(number: int) -> bytes:
    """The 32 bytes that a 64-bit number stands for."""
    state, key = number & M64, b""
    for _ in range(8):
        state = (state * PCG_MULTIPLIER + PCG_INCREMENT) & M64
        mixed, turn = ((state >> 18 ^ state) >> 27) & M32, state >> 59
        key += _left(mixed, (32 - turn) % 32).to_bytes(4, "little")
    return chacha20_block(key)[:32]
