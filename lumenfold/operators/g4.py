"""CCITT T.6 (Group 4) coding of bilevel pages.

Each row is coded against the row above by the places where colour changes. The bit strings of all
rows are joined and closed by the end-of-block code.
"""

from __future__ import annotations

import numpy as np

# fixed values: the code tables of ITU-T T.4 and T.6
# run lengths 0 to 63 of white
WHITE = """00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101
101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010
00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010
00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100""".split()
# run lengths 64 to 1728 of white, in steps of 64
WHITE_MORE = """11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011
011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011""".split()
# run lengths 0 to 63 of black
BLACK = """0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000
0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001
000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111
000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111""".split()
# run lengths 64 to 1728 of black, in steps of 64
BLACK_MORE = """0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010
0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101""".split()
# run lengths 1792 to 2560 of either colour, in steps of 64
LONG = """00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111""".split()
PASS, HORIZONTAL = "0001", "001"
VERTICAL = {0: "1", 1: "011", 2: "000011", 3: "0000011", -1: "010", -2: "000010", -3: "0000010"}
END = "000000000001" * 2


class G4Error(ValueError):
    """The stream isn't a T.6 coding of a page of this size."""


def _run_codes(colour: int) -> list[str]:
    short, more = (BLACK, BLACK_MORE) if colour else (WHITE, WHITE_MORE)
    return short + more + LONG


def _run(length: int, colour: int) -> str:
    short, more = (BLACK, BLACK_MORE) if colour else (WHITE, WHITE_MORE)
    out = LONG[-1] * (length // 2560)
    length %= 2560
    if length >= 1792:
        out += LONG[length // 64 - 28]
    elif length >= 64:
        out += more[length // 64 - 1]
    return out + short[length % 64]


def changes(row: np.ndarray) -> list[int]:
    """Places where the colour differs from the pixel before; the first pixel's is white."""
    return np.flatnonzero(np.diff(np.r_[False, row])).tolist()


def _beyond(above: list[int], a0: int, colour: int, width: int, at: int) -> tuple[int, int, int]:
    """First change of ``above`` right of ``a0`` to the colour opposite to ``colour``, the next one, and an index to go on from."""
    while at > 0 and (at >= len(above) or above[at - 1] > a0):
        at -= 1
    while at < len(above) and (above[at] <= a0 or at % 2 != colour):
        at += 1
    return above[at] if at < len(above) else width, above[at + 1] if at + 1 < len(above) else width, at


def encode(mask: np.ndarray) -> bytes:
    """The stream of a mask (true: black)."""
    height, width = mask.shape
    out: list[str] = []
    above: list[int] = []
    for y in range(height):
        here = changes(mask[y])
        a0, colour, i, at = -1, 0, 0, 0
        while a0 < width:
            a1 = here[i] if i < len(here) else width
            b1, b2, at = _beyond(above, a0, colour, width, at)
            if b2 < a1:
                out.append(PASS)
                a0 = b2
            elif abs(a1 - b1) <= 3:
                out.append(VERTICAL[a1 - b1])
                a0, colour, i = a1, 1 - colour, i + 1
            else:
                a2 = here[i + 1] if i + 1 < len(here) else width
                out.append(HORIZONTAL + _run(a1 - max(a0, 0), colour) + _run(a2 - a1, 1 - colour))
                a0, i = a2, i + 2
        above = here
    bits = "".join(out) + END
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


_MODES = {PASS: "p", HORIZONTAL: "h"} | {code: d for d, code in VERTICAL.items()}
_RUNS = [{code: n if n < 64 else (n - 63) * 64 for n, code in enumerate(_run_codes(c))} for c in (0, 1)]


def decode(data: bytes, width: int, height: int) -> np.ndarray:
    """The mask of a stream; raises ``G4Error`` where it is malformed."""
    bits = bin(int.from_bytes(b"\x01" + data, "big"))[3:]
    pos = 0

    def read(table: dict, longest: int = 13):
        nonlocal pos
        for n in range(1, longest + 1):
            if (code := bits[pos : pos + n]) in table and len(code) == n:
                pos += n
                return table[code]
        raise G4Error(f"no code at bit {pos}")

    def run(colour: int) -> int:
        total = 0
        while True:
            n = read(_RUNS[colour])
            total += n
            if n < 64:
                return total

    mask = np.zeros((height, width), bool)
    above: list[int] = []
    for y in range(height):
        here: list[int] = []
        a0, colour, at = -1, 0, 0
        while a0 < width:
            b1, b2, at = _beyond(above, a0, colour, width, at)
            mode = read(_MODES, 7)
            if mode == "p":
                a0 = b2
            elif mode == "h":
                a1 = max(a0, 0) + run(colour)
                a2 = a1 + run(1 - colour)
                if a2 > width:
                    raise G4Error(f"row {y} is too long")
                here += [a1, a2]
                a0 = a2
            else:
                a1 = b1 + mode
                if a1 > width or a1 < max(a0, 0) or here and a1 < here[-1]:
                    raise G4Error(f"row {y} goes back or too far")
                here.append(a1)
                a0, colour = a1, 1 - colour
        # changes at the right border aren't changes of the row; an empty run gives two at one place
        marks = np.zeros(width + 1, np.int64)
        for x in here:
            marks[x] ^= 1
        mask[y] = (np.cumsum(marks[:-1]) % 2).astype(bool)
        above = changes(mask[y])
    return mask
