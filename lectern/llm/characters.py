"""Characters that look like others, and one form of a text for comparisons."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

#: Letters of other scripts drawn like a Latin letter.
CYRILLIC_ALIKE = dict(zip("АВЕКМНОРСТУХЅІЈҮԚԜӀѴаеорсухѕіјһԁԛԝӏѵЁЇёї", "ABEKMHOPCTYXSIJYQWIVaeopcyxsijhdqwlvËÏëï"))
GREEK_ALIKE = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo"))
ARMENIAN_ALIKE = dict(zip("ՕՏօսհոց", "OSouhng"))
LATIN_ALIKE = dict(zip("ɑɡ", "ag"))
ALIKE = CYRILLIC_ALIKE | GREEK_ALIKE | ARMENIAN_ALIKE | LATIN_ALIKE
#: Characters without a shape of their own.
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0]
#: Spaces other than the plain one.
ODD_SPACES = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
#: Hyphens other than the plain one.
ODD_HYPHENS = [0x2010, 0x2011, 0xFE63, 0xFF0D]


@functools.cache
def skeleton_table() -> np.ndarray:
    """For each code point of a compatibility-decomposed text the one that stands for it
    in comparisons: lower case, look-alikes as Latin letters, 0 for what does not count
    (everything but letters, digits and accents)."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L" or kind[0] == "N" or (kind == "Mn" and unicodedata.combining(chr(c))):
            low = ALIKE.get(chr(c), chr(c)).lower()
            low = ALIKE.get(low, low)
            out[c] = ord(unicodedata.normalize("NFD", low)[0])
    out[INVISIBLE] = 0
    return out
