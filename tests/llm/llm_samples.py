"""Texts for the tests of this folder."""


def prose(seed: int, words: int, alphabet: int = 400) -> str:
    """Words of a fixed pseudo-random sequence, six to a line."""
    x, out = seed * 2654435761 % 2**32, []
    for n in range(words):
        x = (x * 1664525 + 1013904223) % 2**32
        out.append(f"w{x >> 12 & 0xFFFF % alphabet}x{'é' if x >> 28 == 3 else ''}" + ("\n" if n % 6 == 5 else ""))
    return " ".join(out)
