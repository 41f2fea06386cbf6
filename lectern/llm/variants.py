"""Spellings of one person or organisation.

A spelling is taken apart (order of the parts, initials, particles, suffixes, kinds of
institutions) and put into one order.  Spellings with full given names are strings of a
metric space; an exact radius join by an edit metric (:mod:`lectern.llm.metric`) finds
those one slip apart, with digraphs collapsed or as typed, and a check of what the slip
changed decides which name the same person: a slip does, a different given name or another
family's surname does not.
Spellings with initials meet the persons of the same initial and surname, by equality
first and by a radius join where nobody has that surname.  Nicknames and the curated
aliases add equalities.  The links are closed to groups.

What counts as a given name, in which order a name without a comma stands, and whether two
similar given names are two names or a slip, is read off the whole table: counts by token,
joined back by shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.names import ascii_fold_text
from lectern.functions.names import fold_text as _fold_text
from lectern.llm.characters import ALIKE, INVISIBLE
from lectern.llm.metric import radius_pairs
from lectern.session import checkpoint, discard, written

#: Words of names come again and again.
fold_text = lru_cache(1 << 15)(_fold_text)
#: A slip: one edit or one swap of neighbours.
RADIUS = 1
#: Short forms of given names and the names they stand for.
NICKNAMES = {
    "alex": "alexander", "sasha": "alexander", "andy": "andrew andreas", "annie": "anna", "asia": "joanna", "basti": "sebastian", "bella": "isabella", "ben": "benjamin", "beth": "elizabeth",
    "bia": "beatriz", "bill": "william", "bob": "robert", "charlie": "charles", "chris": "christopher", "dan": "daniel", "dima": "dmitri", "ed": "edward", "fred": "frederick", "fritz": "friedrich",
    "gabe": "gabriel", "greg": "gregory", "grete": "margarete", "guga": "gustavo", "gus": "gustavo", "hannes": "johannes", "jackie": "jacqueline", "joe": "joseph", "jon": "jonathan", "kathi": "katharina",
    "kati": "katharina", "ken": "kenneth", "larry": "lawrence", "liz": "elizabeth", "lupe": "guadalupe", "matt": "matthew", "max": "maximilian", "mike": "michael", "mina": "wilhelmina amina", "nacho": "ignacio",
    "natasha": "natalia", "ned": "edward", "nick": "nicholas", "paco": "francisco", "penny": "penelope", "pepe": "jose", "rick": "richard", "rob": "robert", "ron": "ronald", "sam": "samuel",
    "steve": "stephen", "susi": "susanne", "ted": "theodore edward", "tim": "timothy", "tom": "thomas", "tony": "anthony", "uschi": "ursula", "vale": "valentina", "vicky": "victoria", "will": "william",
    "zack": "zachary", "zhenya": "yevgeni", "jim": "james", "jack": "john", "kate": "katherine", "dave": "david", "pete": "peter", "phil": "philip", "sue": "susan", "dick": "richard",
    "misha": "mikhail", "kolya": "nikolai", "volodya": "vladimir", "lola": "dolores", "pancho": "francisco", "chema": "jose", "gosia": "malgorzata", "kasia": "katarzyna", "hans": "johannes", "sepp": "josef",
}
#: The same, folded as names are.
SHORT_FORMS = {fold_text(k): " ".join(map(fold_text, v.split())) for k, v in NICKNAMES.items()}
#: Particles of surnames.
PARTICLES = {"van", "von", "de", "del", "della", "der", "den", "di", "da", "dos", "du", "la", "le", "ter", "ten", "zu", "af", "av", "al", "el", "bin", "ibn"}
#: Suffixes that are no part of the compared name.
SUFFIXES = {"jr", "sr", "ii", "iii", "iv", "jnr", "snr"}
#: Kinds of institutions.
KINDS = ("academy", "polytechnic", "institute", "laboratory", "university", "college", "school", "department", "centre", "center", "faculty")
_KIND_STARTS = {k[:4]: k for k in KINDS}
#: Spellings of a group that meet in one task.
BLOCK = 2000
_CLEAN = str.maketrans({**{a: b for a, b in ALIKE.items()}, **{chr(c): None for c in INVISIBLE}, **{chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}})
_INITIALS = re.compile(r"(?:[^\W\d_]\.?-?)(?:[^\W\d_]\.-?)*|(?:[^\W\d_]\.-?)+[^\W\d_]\.?")


def _kind(word: str) -> str | None:
    if word in KINDS:
        return word
    known = _KIND_STARTS.get(word[:4])
    return known if known and known.startswith(word) else None


@lru_cache(1 << 15)
def _initials(token: str, shout: bool) -> str | None:
    """The letters of a token of initials; None for a word."""
    bare = token.strip(".-")
    if _INITIALS.fullmatch(token) or (len(bare) in (2, 3) and bare.isalpha() and bare.isupper() and not shout):
        return fold_text(re.sub(r"[.\-]", " ", token)).replace(" ", "") if len(bare) > 1 and not bare.isalpha() else fold_text(bare)
    return None


def _cleaned(name: str) -> str:
    return name if name.isascii() else name.translate(_CLEAN)


def parse(name: str | None, fold=fold_text) -> dict:
    """What a spelling consists of, its words reduced by ``fold``.  ``shape``: org, full (given and surname as words, the
    order still open unless ``fixed``), initial (given names as initials) or none."""
    out = {"shape": "none", "fixed": False, "head": "", "tail": "", "words": [], "middle": "", "surname": "", "particle": ""}
    text = _cleaned(name or "")
    text = re.sub(r"[{}\"]", "", text)
    parts = [p.strip() for p in text.split(",")]
    parts = [p for p in parts if p and fold_text(p) not in SUFFIXES]
    if not parts:
        return out
    tokens = [t for p in parts for t in p.split()]
    folded = [fold(t).replace(" ", "") for t in tokens]
    kinds = [k for k in map(_kind, folded) if k]
    if kinds and len(parts) == 1 and len(tokens) > 1:
        place = "".join(w for w in folded if w not in ("the", "of", "and", "for") and not _kind(w))
        return out | {"shape": "org", "fixed": True, "words": [place, *kinds], "surname": place}
    letters = [c for c in text if c.isalpha()]
    shout = all(c.isupper() for c in letters)
    if len(parts) > 1:
        family, rest = parts[0].split(), [t for p in parts[1:] for t in p.split()]
        short = all(_initials(t, shout) for t in family) and not all(_initials(t, shout) for t in rest)
        if short:  # "F., Surname"
            family, rest = rest, family
        while rest and fold_text(rest[-1]) in PARTICLES and len(rest) > 1:
            family = [rest.pop(), *family] if fold_text(rest[-1]) in PARTICLES else family
        given, fixed = rest, True
    else:
        given, family, fixed = tokens, [], False
        while len(given) > 1 and fold_text(given[-1]) in SUFFIXES:
            given = given[:-1]
    marks = [_initials(t, shout) for t in given]
    clean = lambda ts: [w for w in (fold(t).replace(" ", "") for t in ts) if w]
    if fixed:
        words = [t for t, m in zip(given, marks) if not m]
        surname = "".join(clean(family))
        first = next((m for m in marks if m), "")
        if not words:
            letters_ = "".join(m for m in marks if m)
            return out | {"shape": "initial" if letters_ and surname else "none", "fixed": True, "head": letters_[:1], "middle": letters_[1:], "surname": surname}
        return out | {"shape": "full" if surname else "none", "fixed": True, "head": (clean(words) or [""])[0], "words": clean(words), "middle": first, "surname": surname}
    if len(tokens) < 2:
        return out | {"shape": "none", "surname": "".join(clean(tokens))}
    lead = 0
    while lead < len(marks) and marks[lead]:
        lead += 1
    trail = len(marks)
    while trail > lead and marks[trail - 1]:
        trail -= 1
    words = clean(given[lead:trail])
    if lead == len(marks):  # initials only
        return out
    if lead or trail < len(marks):
        if lead == 0 and trail < len(marks) and len(words) > 1 and words[0] not in PARTICLES and len(words) < 3:
            # "Surname Given M."
            return out | {"shape": "full", "head": words[0], "tail": words[-1], "words": words, "middle": "".join(m for m in marks[trail:] if m)}
        letters_ = "".join(m for m in marks[:lead] + marks[trail:] if m)
        return out | {"shape": "initial", "fixed": True, "head": letters_[:1], "middle": letters_[1:], "surname": "".join(words)}
    middle = "".join(m for m in marks if m)
    words = clean([t for t, m in zip(given, marks) if not m])
    if len(words) < 2:
        return out
    if words[0] in PARTICLES and len(words) > 2:  # "van Surname Given"
        return out | {"shape": "full", "fixed": True, "head": words[-1], "words": [words[-1]], "middle": middle, "surname": "".join(words[:-1])}
    return out | {"shape": "full", "head": words[0], "tail": words[-1], "words": words, "middle": middle}


_PARSED = "name_id long, shape string, fixed boolean, head string, tail string, words array<string>, middle string, surname string, particle string, raw array<string>"


def _particles(name: str | None) -> str:
    """The particles of a surname, joined; '' if it has none."""
    words = [fold_text(w) for w in _cleaned(name or "").replace(",", " ").split()]
    return "".join(w for w in words if w in PARTICLES)


def _raw(name: str | None) -> list[str]:
    """The words without the digraphs collapsed, a surname whose place is known last: a
    slip may fall on one of two letters that would collapse."""
    p = parse(name, ascii_fold_text)
    return p["words"] + [p["surname"]] if p["fixed"] and p["shape"] == "full" else p["words"]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = pd.DataFrame([parse(n) | {"particle": _particles(n), "raw": _raw(n)} for n in rows.name])
        out.insert(0, "name_id", rows.name_id.to_numpy())
        if len(rows):
            yield out


def _slip(a: str, b: str) -> bool:
    """One edit or one swap of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    if n > 2 and a[0] != b[0] and a[-1] != b[-1]:
        return False
    k = 0
    while k < n and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def _canonical_forms(names: DataFrame) -> DataFrame:
    """(name_id, shape, given, middle, surname, key): the parts in one order.  ``key`` is
    what the metric compares: given name and surname, or place and kind."""
    parsed = written(names.select(F.col("name_id").cast("long").alias("name_id"), "name").mapInPandas(_parse, _PARSED), "parsed")
    full = parsed.filter(F.col("shape") == "full")
    seen = full.select(F.explode(F.array(F.struct(F.col("head").alias("token"), F.lit(1).alias("g"), F.lit(0).alias("s")), F.struct(F.when(F.col("fixed"), F.col("surname")).otherwise(F.col("tail")).alias("token"), F.lit(0).alias("g"), F.lit(1).alias("s")))).alias("x")).select("x.*")
    tokens = seen.groupBy("token").agg((F.sum("g") / (F.sum("g") + F.sum("s"))).alias("share"))
    open_ = full.filter(~F.col("fixed"))
    placed = open_.join(tokens.select(F.col("token").alias("head"), F.col("share").alias("first_share")), "head", "left").join(tokens.select(F.col("token").alias("tail"), F.col("share").alias("last_share")), "tail", "left")
    turned = (F.col("last_share") > F.col("first_share")) & (F.col("last_share") > 0.5) & (F.col("first_share") < 0.5)
    rest = F.col("words")
    settled = placed.select(
        "name_id", "shape",
        F.when(turned, F.col("tail")).otherwise(F.col("head")).alias("given"), "middle",
        F.when(turned, F.array_join(F.slice(rest, 1, F.size(rest) - 1), "")).otherwise(F.array_join(F.slice(rest, 2, F.size(rest)), "")).alias("surname"), "particle",
        F.when(turned, F.concat(F.element_at("raw", -1), F.array_join(F.slice("raw", 1, F.size("raw") - 1), ""))).otherwise(F.array_join("raw", "")).alias("raw"),
    )
    fixed = parsed.filter((F.col("shape") != "full") | F.col("fixed")).select("name_id", "shape", F.when(F.col("shape") == "full", F.array_join("words", "")).otherwise(F.col("head")).alias("given"), "middle", "surname", "particle", F.array_join("raw", "").alias("raw"), F.array_join("words", "").alias("_words"))
    both = settled.withColumn("_words", F.lit("")).unionByName(fixed)
    key = F.when(F.col("shape") == "org", F.col("_words")).when(F.col("shape") == "full", F.concat("given", "surname")).when(F.col("shape") == "initial", F.concat("given", F.lit(" "), "surname"))
    bare = F.when((F.col("particle") != "") & F.startswith("surname", "particle"), F.substring(F.col("surname"), F.length("particle") + 1, F.length("surname"))).otherwise(F.col("surname"))
    return both.select("name_id", "shape", "given", "middle", "surname", key.alias("key"), bare.alias("bare"), "raw")


def _groups(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(key, group): the smallest key reachable, for every key that has an edge.

    Every key takes the smallest label among its neighbours' and its own, then the label
    of its label, until nothing changes; written down after each round."""
    both = written(edges.filter("a != b").select("a", "b").union(edges.filter("a != b").select("b", "a")).distinct(), "edges")
    label = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("group")).withColumnRenamed("a", "key"), "labels")
    for _ in range(rounds):
        offered = both.join(label.select(F.col("key").alias("b"), "group"), "b").groupBy("a").agg(F.min("group").alias("offer")).withColumnRenamed("a", "key")
        lower = label.select("key", "group").join(offered, "key").select("key", F.least("group", "offer").alias("group"), F.col("group").alias("old"))
        jump = lower.select(F.col("key").alias("group"), F.col("group").alias("far"))
        new = written(lower.join(jump, "group", "left").select("key", F.least("group", F.coalesce("far", "group")).alias("group"), "old"), "labels")
        changed = not new.filter(F.col("group") != F.col("old")).isEmpty()
        discard(label)
        if not changed:
            discard(both)
            return new.select("key", "group")
        label = new
    raise RuntimeError("groups did not settle")


def name_groups(names: DataFrame, aliases: DataFrame | None = None, radius: int = RADIUS) -> DataFrame:
    """(name_id, group): spellings with the same group name the same person or institution.

    ``names`` has ``name_id`` and ``name``; ``aliases``, if given, ``representative`` and
    ``stray`` (folded).  Names that are null, empty or a single word, and those of
    initials only, form groups of equal folded text, null and empty ones each their own.
    A spelling whose initials fit several persons of that surname stays with the other
    spellings of the same initials, apart from those persons.  Repeated rows are in one
    group.  Other columns are not read.
    """
    forms = written(_canonical_forms(names), "forms")
    people = forms.filter(F.col("shape").isin("full", "org"))
    # a form is a key; its parts are those of most of its spellings
    keys = people.groupBy("key", "shape", "given", "surname", "bare").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by(F.struct("shape", "given", "surname", "bare"), F.struct("n", "given", "surname", "bare")).alias("x"), F.sum("n").alias("n")).select("key", "x.*", "n")
    raws = people.groupBy("key").agg(F.collect_set("raw").alias("raws"))  # few: what folds alike
    keys = written(keys.join(raws, "key"), "keys")
    persons = keys.filter(F.col("shape") == "full")
    given = persons.groupBy("given").agg(F.count("*").alias("spread"))
    family = persons.groupBy("surname").agg(F.count_distinct("given").alias("members"))
    # a slip may fall on one of two letters that would collapse, so both forms are strings
    spelled = keys.select("key", F.explode(F.array_union("raws", F.array("key"))).alias("string"))
    near = radius_pairs(spelled.select(F.col("string").alias("key")), radius).select("a", "b")
    named = lambda s: spelled.select(F.col("string").alias(s), F.col("key").alias("key_" + s))
    alike = near.join(named("a"), "a").join(named("b"), "b").filter("key_a <> key_b").select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"))
    # different keys typed alike
    alike = alike.union(named("a").withColumnRenamed("a", "string").join(named("b").withColumnRenamed("b", "string"), "string").filter("key_a < key_b").select("key_a", "key_b")).distinct()
    parts = keys.join(given, "given", "left").join(family, "surname", "left")
    side = lambda s: parts.select(*[F.col(c).alias(c + s) for c in ("key", "shape", "given", "surname", "spread", "members")])
    pairs = alike.join(side("_a"), F.col("a") == F.col("key_a")).join(side("_b"), F.col("b") == F.col("key_b"))
    least, most = F.least("spread_a", "spread_b"), F.greatest("spread_a", "spread_b")
    # two given names in use, not a slip in one: both are frequent, or they differ in their ending alone
    stem = F.least(F.length("given_a"), F.length("given_b")) - 1
    ending = F.substring(F.col("given_a"), F.lit(1), stem) == F.substring(F.col("given_b"), F.lit(1), stem)
    two_givens = (F.col("given_a") != F.col("given_b")) & (F.col("surname_a") == F.col("surname_b")) & (((least >= 5) & (least >= 0.1 * most)) | (ending & (least >= 0.1 * most)))
    two_families = (F.col("surname_a") != F.col("surname_b")) & (F.least("members_a", "members_b") >= 2)
    same = pairs.filter(((F.col("shape_a") != F.col("shape_b")) | ~F.coalesce(two_givens, F.lit(False)) & ~F.coalesce(two_families, F.lit(False))))
    edges = same.select("a", "b")

    table = F.create_map(*[F.lit(x) for k, v in SHORT_FORMS.items() for x in (k, v)])
    called = persons.withColumn("_full", F.try_element_at(table, F.col("given"))).filter(F.col("_full").isNotNull())
    meant = called.select("key", "surname", F.posexplode(F.split("_full", " ")).alias("rank", "name")).select("key", "rank", F.concat("name", "surname").alias("other"))
    # the first meaning that somebody has; without any the first, so that short forms meet
    there = meant.join(keys.select(F.col("key").alias("other"), F.lit(0).alias("absent")), "other", "left")
    known = there.groupBy("key").agg(F.min_by("other", F.struct(F.coalesce("absent", F.lit(1)), "rank")).alias("other"))
    edges = edges.union(known.select(F.col("key").alias("a"), F.col("other").alias("b")))

    # a surname printed without its particles
    dropped = persons.filter(F.col("bare") != F.col("surname")).select(F.col("key").alias("a"), F.concat("given", "bare").alias("b"))
    edges = edges.union(dropped.join(keys.select(F.col("key").alias("b")), "b").select("a", "b"))

    if aliases is not None:
        spelled = names.select(F.col("name_id").cast("long").alias("name_id"), F.col("name")).join(forms.select("name_id", "key"), "name_id")
        from lectern.functions.names import fold_name

        by_fold = spelled.select(fold_name("name").alias("fold"), "key").distinct()
        curated = aliases.filter(F.col("stray").isNotNull()).select(fold_name("representative").alias("rep"), "stray")
        first = curated.join(by_fold.select(F.col("fold").alias("rep"), F.col("key").alias("a")), "rep")
        edges = edges.union(first.join(by_fold.select(F.col("fold").alias("stray"), F.col("key").alias("b")), "stray").select("a", "b"))

    edges = written(edges, "links")
    groups = _groups(edges)
    grouped = written(keys.join(groups, "key", "left").select("key", "shape", "given", "surname", F.coalesce("group", "key").alias("group"), "n"), "grouped")

    # initials: the persons of that initial and surname
    short = forms.filter(F.col("shape") == "initial")
    middles = forms.filter(F.col("shape") == "full").join(grouped.select("key", "group"), "key")
    target = F.try_element_at(table, F.col("given"))
    reduced = middles.select("group", F.concat(F.substring(F.coalesce(target, F.col("given")), 1, 1), F.lit(" "), "surname").alias("brief"), F.substring("middle", 1, 1).alias("m")).groupBy("brief", "group").agg(F.collect_set(F.when(F.col("m") != "", F.col("m"))).alias("ms"), F.count("*").alias("n"))
    reduced = written(reduced, "reduced")
    wanted = written(short.groupBy(F.col("key").alias("brief"), F.substring("middle", 1, 1).alias("m")).agg(F.count("*").alias("spellings")), "briefs")
    exact = wanted.join(reduced.select("brief", "group", "ms"), "brief")
    lone = wanted.select("brief").distinct().join(reduced.select("brief").distinct(), "brief", "left_anti")
    space = reduced.select(F.col("brief").alias("key"), F.lit(False).alias("query")).union(lone.select(F.col("brief").alias("key"), F.lit(True).alias("query")))
    close = radius_pairs(space, radius)
    slips = close.select(F.col("a").alias("brief"), F.col("b").alias("other")).union(close.select(F.col("b").alias("brief"), F.col("a").alias("other")))
    slipped = wanted.join(lone, "brief").join(slips, "brief").join(reduced.select(F.col("brief").alias("other"), "group", "ms"), "other").filter(F.substring("brief", 1, 1) == F.substring("other", 1, 1))
    offers = exact.select("brief", "m", "group", "ms").union(slipped.select("brief", "m", "group", "ms"))
    fits = offers.withColumn("agrees", F.when((F.col("m") == "") | (F.size("ms") == 0), 1).when(F.array_contains("ms", F.col("m")), 2).otherwise(0)).filter("agrees > 0")
    best = fits.groupBy("brief", "m").agg(F.max("agrees").alias("agrees"))
    chosen = fits.join(best, ["brief", "m", "agrees"]).groupBy("brief", "m").agg(F.count_distinct("group").alias("c"), F.min("group").alias("group")).filter("c = 1")
    brief_group = wanted.join(chosen.select("brief", "m", "group"), ["brief", "m"], "left").select("brief", "m", F.coalesce("group", F.concat(F.lit("~"), "brief")).alias("group"))

    of_people = people.select("name_id", "key").join(grouped.select("key", "group"), "key").select("name_id", "group")
    of_briefs = short.select("name_id", F.col("key").alias("brief"), F.substring("middle", 1, 1).alias("m")).join(brief_group, ["brief", "m"]).select("name_id", "group")
    others = forms.filter(F.col("shape") == "none").select("name_id", F.when(F.col("surname") != "", F.concat(F.lit("="), "surname")).otherwise(F.concat(F.lit("#"), F.col("name_id").cast("string"))).alias("group"))
    return of_people.unionByName(of_briefs).unionByName(others).distinct()


def same_name_pairs(names: DataFrame, aliases: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(name_id_a, name_id_b), a < b: all pairs within the groups of :func:`name_groups`.
    A group of more than ``block`` spellings is cut into blocks of about that many, and
    each two of them meet in a task of their own."""
    groups = checkpoint(name_groups(names, aliases).filter(F.col("name_id").isNotNull()).distinct())
    sizes = groups.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("n")).filter("n > 0")
    part = F.pmod(F.xxhash64("name_id"), F.col("n")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    cut = groups.join(sizes, "group")
    a = cut.select("group", part.alias("i"), every.alias("j"), F.col("name_id").alias("name_id_a"))
    b = cut.select("group", every.alias("i"), part.alias("j"), F.col("name_id").alias("name_id_b"))
    return a.join(b, ["group", "i", "j"]).filter("name_id_a < name_id_b").select("name_id_a", "name_id_b")
