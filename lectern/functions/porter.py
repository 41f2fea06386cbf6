"""English suffix stripping after Porter's published algorithm.

With the one departure that the text index of the reference data uses: the second step
turns ``bli`` into ``ble`` and leaves ``logi`` alone.  Words of one or two letters, and
words with anything but ASCII letters in their ending, stay as they are.
"""

from __future__ import annotations

from functools import lru_cache

#: Endings of step 2, replaced when what precedes them has a measure above 0.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
#: Endings of step 3, under the same condition.
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
#: Endings of step 4, dropped when the measure is above 1.
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """v for a vowel, c for a consonant; y is a vowel after a consonant."""
    out = []
    for c in word:
        out.append("v" if c in "aeiou" or (c == "y" and out and out[-1] == "c") else "c")
    return "".join(out)


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _replace(word: str, table: dict[str, str]) -> str:
    """The longest ending in the table decides, whether or not its condition holds."""
    for size in range(7, 1, -1):
        end = word[-size:]
        if len(word) > size and end in table:
            stem = word[:-size]
            return stem + table[end] if _measure(stem) > 0 else word
    return word


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word.endswith("s"):
        if any(word.endswith(end) and len(word) > len(end) for end in ("sses", "ies")):
            word = word[:-2]
        elif not word.endswith("ss"):
            word = word[:-1]
    if word.endswith("eed") and len(word) > 3:
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and len(word) > len(end) and "v" in _shape(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(word, STEP2)
    word = _replace(word, STEP3)
    for size in range(5, 1, -1):
        end = word[-size:]
        if len(word) > size and end in STEP4:
            rest = word[:-size]
            if _measure(rest) > 1 and (end != "ion" or rest[-1] in "st"):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short_end(rest)):
            word = rest
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
