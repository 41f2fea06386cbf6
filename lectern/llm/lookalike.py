"""One form for texts that look the same.

A look-alike mapping in SQL brings a value to ordinary characters: what cannot be seen
goes, odd spaces, hyphens, widths and ligatures become plain, letters of another script
inside a word become letters of the word's script.  Accents stay as they were typed: mapped
values are grouped under an accent-sensitive Unicode collation, for which composed and
decomposed accents are one, together with the composed form of each; every class gets a
deterministic canonical member, and the member is joined back.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.characters import ALIKE, ARMENIAN_ALIKE, CYRILLIC_ALIKE, GREEK_ALIKE, INVISIBLE, LATIN_ALIKE, ODD_HYPHENS, ODD_SPACES
from lectern.session import written

#: Values of these characters only are ordinary as they stand.
PLAIN = r"^[\x09\x0A\x0D\x20-\x7EÀ-ɏ]*\z"
#: Ligatures and the letters they are made of.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
FOREIGN = CYRILLIC_ALIKE | GREEK_ALIKE | ARMENIAN_ALIKE
#: Latin letters drawn like a Cyrillic one, for words that are Cyrillic otherwise.
TO_CYRILLIC = {b: a for a, b in reversed(CYRILLIC_ALIKE.items()) if b.isascii()}
WIDE = {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
#: Half-width kana and what they stand for; sound marks become combining ones.
HALF_KANA = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF61, 0xFFA0)}
WIDE_LETTERS = {a: b for a, b in WIDE.items() if b.isalnum()}
SCRIPTS = r"\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}"
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
#: Joiners that shape the letters around them in these scripts, or tie emoji together
#: (whose last half is what a look-behind sees).
JOINED = r"\p{IsArabic}\p{IsDevanagari}\p{IsBengali}\p{IsTamil}\p{IsTelugu}\p{IsKannada}\p{IsMalayalam}\p{IsSinhala}\p{IsKhmer}\p{IsMyanmar}\p{So}\x{D800}-\x{DFFF}\x{FE0F}"
_JOINERS, _EMOJI_STYLE = (0x200C, 0x200D), 0xFE0F
_UNSEEN = "".join(f"\\x{{{c:X}}}" for c in INVISIBLE if c not in (*_JOINERS, _EMOJI_STYLE))
_CONTROLS = r"\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x84\x86-\x9F"


def _translate(column: Column, table: dict[str, str]) -> Column:
    return F.translate(column, "".join(table), "".join(table.values()))


def _set(letters) -> str:
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in letters) + "]"


@F.pandas_udf(T.StringType())
def compose(values: pd.Series) -> pd.Series:
    """Composed accents."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def ordinary(value: Column) -> Column:
    """The look-alike mapping, but for accents; all of it inside the JVM."""
    seen = F.regexp_replace(value, f"[{_UNSEEN}{_CONTROLS}]", "")
    seen = F.regexp_replace(seen, rf"(?<![{JOINED}])[\x{{200C}}\x{{200D}}]|(?<![\p{{So}}\p{{Sk}}\x{{D800}}-\x{{DFFF}}\x{{23}}\x{{2A}}0-9\x{{203C}}-\x{{3299}}])\x{{FE0F}}", "")
    asian = seen.rlike(f"[{CJK}]")
    spaced = F.regexp_replace(seen, r"[\x{2028}\x{2029}\x{85}]", "\n")
    spaced = _translate(spaced, {chr(c): " " for c in ODD_SPACES if c != 0x3000} | {chr(c): "-" for c in ODD_HYPHENS if c != 0xFF0D} | WIDE_LETTERS | HALF_KANA)
    plain = F.when(asian, spaced).otherwise(_translate(spaced, {"　": " "} | WIDE))
    for ligature, letters in LIGATURES.items():
        plain = F.replace(plain, F.lit(ligature), F.lit(letters))
    latin_text = plain.rlike(r"\p{IsLatin}")
    other = rf"[{SCRIPTS}&&[^{_set(FOREIGN)[1:-1]}]]"
    foreign_text = plain.rlike(other)

    def word(w: Column) -> Column:
        latin, alike, more = w.rlike(r"\p{IsLatin}"), w.rlike(_set(FOREIGN)), w.rlike(other)
        return (
            F.when(latin & alike & ~more, _translate(w, ALIKE))
            .when(latin & w.rlike(r"\p{IsCyrillic}") & more & ~w.rlike(f"[\\p{{IsLatin}}&&[^{_set(TO_CYRILLIC)[1:-1]}]]"), _translate(w, TO_CYRILLIC))
            .when(alike & ~latin & ~more & latin_text & ~foreign_text, _translate(w, ALIKE))
            .when(w.rlike(_set(LATIN_ALIKE)) & w.rlike("[a-z]"), _translate(w, LATIN_ALIKE))
            .otherwise(w)
        )

    words = F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{M}]+|[^\p{L}\p{M}]+)"), F.lit(1))
    scripted = F.when(plain.rlike(f"[{SCRIPTS}{''.join(LATIN_ALIKE)}]"), F.array_join(F.transform(words, word), "")).otherwise(plain)
    return scripted


def canonical_values(rows: DataFrame, value: str = "value", salts: int = 8) -> DataFrame:
    """``rows`` with a column ``canonical``: the one form of ``value``.

    Equal-looking values get the same canonical form.  A class holds the mapped forms that
    are equal under the collation, the composed form of each, and the ordinary values
    equal to them; its canonical member is the one of the fewest characters, then bytes,
    then the smallest.  Values of ordinary characters stay as they are and are not joined.  Null stays null, '' stays
    ''.  Repeated rows stay.  Other columns pass through; ``_``-prefixed names are used
    inside and must not occur in ``rows``.  The join back is salted, so one value may be
    held by any share of the rows.
    """
    plain = F.col(value).rlike(PLAIN) | F.col(value).isNull()
    odd = rows.filter(~plain).withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    # one row per different value, each mapped once
    mapped = written(odd.select(value).distinct().withColumn("_mapped", ordinary(F.col(value))), "mapped")
    under = F.collate("_mapped", "UNICODE")
    odd_members = mapped.select(F.explode(F.array_distinct(F.array("_mapped", compose("_mapped")))).alias("_mapped"))
    odd_members = written(odd_members.distinct(), "members").withColumn("_class", under)
    # of the ordinary values only those of such a class count; how they are found depends on the size of the table just written
    plain_members = rows.filter(plain & F.col(value).isNotNull()).select(F.col(value).alias("_mapped")).withColumn("_class", under)
    plain_members = plain_members.join(odd_members.select(F.col("_class").alias("_wanted")), F.col("_class") == F.col("_wanted"), "left_semi")
    members = odd_members.select("_mapped", "_class").unionByName(plain_members.select("_mapped", "_class"))
    order = F.struct(F.length("_mapped"), F.octet_length("_mapped"), F.col("_mapped"))
    classes = members.groupBy("_class").agg(F.min_by("_mapped", order).alias("canonical"))
    named = mapped.withColumn("_class", under).join(classes, "_class")
    salted = named.select(F.col(value).alias("_value"), "canonical").withColumn("_at", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    joined = odd.join(salted, (odd[value] == salted["_value"]) & (odd["_salt"] == salted["_at"]))
    out = joined.select(*[odd[c] for c in rows.columns], "canonical")
    return out.unionByName(rows.filter(plain).withColumn("canonical", F.col(value)))


def field_values(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, field, value): one row per row and named column."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(key, F.inline(pairs))


def unusual_fields(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, field) of the values that differ from their canonical form."""
    odd = canonical_values(field_values(df, key, fields))
    return odd.filter(F.col("value") != F.col("canonical")).select(key, "field").distinct()
