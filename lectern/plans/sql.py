"""Pieces of DuckDB SQL that say what the column expressions say."""

from __future__ import annotations

from lectern.functions.text import ACCENTS

#: Accented letters by what they fold to, in lower case.
LETTERS = {
    "a": "àáâãäåāăą", "c": "çćĉċč", "d": "ďđ", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥħ", "i": "ìíîïĩīĭįı", "j": "ĵ", "k": "ķ", "l": "ĺļľł",
    "n": "ñńņň", "o": "òóôõöøōŏő", "r": "ŕŗř", "s": "śŝşš", "t": "ţťŧ", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž",
}
BASE = {accented: plain for plain, group in LETTERS.items() for accented in group}
BASE_CASED = BASE | {a.upper(): b.upper() for a, b in BASE.items() if a != "ı"}


def _pair(table: dict[str, str]) -> str:
    return f"'{''.join(table)}', '{''.join(table.values())}'"


def norm(x: str) -> str:
    """The tokens of a text between single spaces."""
    plain = f"trim(regexp_replace(translate(regexp_replace(lower({x}), '\\p{{Mn}}', '', 'g'), {_pair(ACCENTS)}), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+', ' ', 'g'))"
    return f"(CASE WHEN {plain} = '' THEN ' ' ELSE ' ' || {plain} || ' ' END)"


def ascii_fold(x: str) -> str:
    base = f"translate(regexp_replace(lower({x}), '[\\x{{300}}-\\x{{36F}}]', '', 'g'), {_pair(BASE)})"
    return f"trim(regexp_replace(replace(replace(replace({base}, 'æ', 'ae'), 'œ', 'oe'), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def fold(x: str) -> str:
    return f"replace(replace(regexp_replace({ascii_fold(x)}, 'ue(\\p{{L}})', 'u\\1', 'g'), 'aa', 'a'), 'oe', 'o')"


def skeleton(folded: str) -> str:
    return f"array_to_string(list_filter(string_split({folded}, ' '), lambda w: length(w) > 1), '')"


def deaccent(x: str) -> str:
    out = f"translate(regexp_replace({x}, '[\\x{{300}}-\\x{{36F}}]', '', 'g'), {_pair(BASE_CASED)})"
    for a, b in (("æ", "ae"), ("œ", "oe"), ("ß", "ss"), ("Æ", "AE"), ("Œ", "OE")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


def names(byline: str) -> str:
    return f"list_filter(list_transform(string_split({byline}, ';'), lambda x: trim(regexp_replace(x, '[\\s\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{85}}]+', ' ', 'g'))), lambda x: x <> '')"


def norm_title(x: str) -> str:
    return f"trim(lower(regexp_replace(regexp_replace({x}, '\\\\[A-Za-z]*', ' ', 'g'), '[^A-Za-z0-9]+', ' ', 'g')))"


def surnames(x: str) -> str:
    last = "CASE WHEN contains(n, ',') THEN string_split(n, ',')[1] ELSE regexp_split_to_array(n, '\\s+')[-1] END"
    return f"list_filter(list_transform(list_transform(string_split({x}, ' and '), lambda n: regexp_replace(n, '^\\s+|\\s+$', '', 'g')), lambda n: {norm_title(last)}), lambda s: s <> '')"


#: Papers with their analysed columns.
ANALYSED = f"(SELECT *, {norm('title')} AS t, {norm(fold('authors'))} AS a, {norm('abstract')} AS b, {norm('category')} AS c FROM papers)"


def anywhere(text: str) -> str:
    """One of the searchable columns contains the text."""
    return "(" + " OR ".join(f"contains({c}, '{text}')" for c in "tabc") + ")"
