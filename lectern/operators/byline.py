"""Curated aliases and bylines in their canonical spelling."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.names import byline_names, fold_name, fold_text, person_form_column, person_form_text, skeleton, skeleton_text

#: Keys of an alias table that is looked up in place.
MAP_KEYS = 2000


def alias_keys(aliases: DataFrame) -> DataFrame:
    """(kind, key, representative): the folded strays, and the skeletons of all spellings
    that are not shorter than two words.  A key that names several persons names none."""
    strays = aliases.filter(F.col("stray").isNotNull()).select(F.lit("stray").alias("kind"), fold_name("stray").alias("key"), "representative")
    own = aliases.select(F.lit("skeleton").alias("kind"), skeleton(fold_name("representative")).alias("key"), "representative")
    keys = strays.unionByName(own).filter(F.col("key") != "").distinct()
    sole = keys.groupBy("kind", "key").agg(F.count_distinct("representative").alias("n"), F.min("representative").alias("representative"))
    return sole.filter("n = 1").drop("n")


def canonical_names(names: DataFrame, aliases: DataFrame, column: str = "name") -> DataFrame:
    """``names`` with ``canonical``: the representative whose stray the folded name is,
    else the one whose skeleton it has, else null.  Two left joins; the alias table is
    curated and small, but joined without a hint, so its size decides."""
    keys = alias_keys(aliases)
    stray = keys.filter("kind = 'stray'").select(F.col("key").alias("_stray"), F.col("representative").alias("_by_stray"))
    bones = keys.filter("kind = 'skeleton'").select(F.col("key").alias("_bones"), F.col("representative").alias("_by_bones"))
    folded = names.withColumn("_fold", fold_name(column)).withColumn("_skeleton", skeleton(F.col("_fold")))
    joined = folded.join(stray, folded["_fold"] == stray["_stray"], "left").join(bones, folded["_skeleton"] == bones["_bones"], "left")
    return joined.withColumn("canonical", F.coalesce("_by_stray", "_by_bones")).drop("_fold", "_skeleton", "_stray", "_by_stray", "_bones", "_by_bones")


def canonical_needles(names: DataFrame, aliases: DataFrame, column: str = "name") -> DataFrame:
    """``names`` with ``needle``: what a name searched for is compared as, its
    representative, or else the name itself, folded."""
    return canonical_names(names, aliases, column).withColumn("needle", fold_name(F.coalesce("canonical", column))).drop("canonical")


def canonical_persons(names: DataFrame, aliases: DataFrame, column: str = "name") -> DataFrame:
    """``names`` with ``person``: "Last, First" turned, then the representative, if any."""
    turned = names.withColumn("_form", F.trim(person_form_column(column)))
    return canonical_names(turned, aliases, "_form").withColumn("person", F.coalesce("canonical", "_form")).drop("canonical", "_form")


@dataclass(frozen=True)
class AliasTable:
    """A curated alias table on the driver, for what a user typed."""

    strays: dict[str, str]
    skeletons: dict[str, str]

    @classmethod
    def of(cls, aliases: DataFrame, most: int = MAP_KEYS) -> AliasTable | None:
        """The table, or None if it has more than ``most`` keys."""
        rows = alias_keys(aliases).limit(most + 1).collect()
        if len(rows) > most:
            return None
        found = {kind: {r["key"]: r["representative"] for r in rows if r["kind"] == kind} for kind in ("stray", "skeleton")}
        return cls(found["stray"], found["skeleton"])

    def canonical(self, name: str) -> str | None:
        folded = fold_text(name)
        return self.strays.get(folded) or self.skeletons.get(skeleton_text(folded))

    def needle(self, name: str) -> str:
        """A name searched for, in the spelling that is stored."""
        return self.canonical(name) or name

    def person(self, name: str) -> str:
        turned = person_form_text(name).strip()
        return self.canonical(turned) or turned


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for k, v in sorted(table.items()) for x in (k, v)]
    return F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("string")


def canonical_bylines(papers: DataFrame, aliases: DataFrame, key: str = "id", byline: str = "authors", merged: Mapping[str, str] | None = None) -> DataFrame:
    """(key, ``byline``, ``canonical``): every byline with tidy spacing and each known
    name in its canonical spelling, order kept; doing it twice changes nothing more.

    ``merged`` says which folded names are two people in one, and how they are parted
    ("A B; C D"); the halves are looked up like other names.  Repeated rows each give
    their row, null bylines null.  A curated table of up to MAP_KEYS keys is looked up in
    place, without a shuffle; a larger one is joined by the distinct names."""
    names = byline_names(byline)
    if merged:
        parted = F.transform(names, lambda n: F.coalesce(byline_names(_lookup(dict(merged), fold_name(n))), F.array(n)))
        names = F.flatten(parted)
    known = AliasTable.of(aliases)
    if known is not None:

        def spelled(name: Column) -> Column:
            folded = fold_name(name)
            return F.coalesce(_lookup(known.strays, folded), _lookup(known.skeletons, skeleton(folded)), name)

        return papers.select(key, byline, F.array_join(F.transform(names, spelled), "; ").alias("canonical"))
    rows = papers.select(key, byline, F.monotonically_increasing_id().alias("_row"), names.alias("_names"))
    each = rows.select("_row", F.posexplode("_names").alias("pos", "name"))
    table = canonical_names(each.select("name").distinct(), aliases).filter(F.col("canonical").isNotNull())
    found = each.join(table, "name", "left").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("canonical", "name").alias("name")))).alias("x"))
    text = F.when(F.col(byline).isNotNull(), F.coalesce(F.array_join(F.transform("x", lambda x: x["name"]), "; "), F.lit("")))
    return rows.join(found, "_row", "left").select(key, byline, text.alias("canonical"))


def changed_bylines(papers: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, authors, authors_fold) of the bylines that differ from their canonical form:
    what a new alias table makes it necessary to rewrite."""
    return canonical_bylines(papers, aliases).filter(F.col("canonical") != F.col("authors")).select("id", F.col("canonical").alias("authors"), fold_name("canonical").alias("authors_fold"))


def alias_fingerprint(aliases: DataFrame) -> DataFrame:
    """One row ``fingerprint``: equal for equal alias tables, whatever their order."""
    rows = aliases.distinct().select(F.xxhash64("representative", "stray").alias("h"))
    return rows.agg(F.hex(F.coalesce(F.bit_xor("h"), F.lit(0))).alias("fingerprint"))


def person_form(name: Column | str) -> Column:
    return person_form_column(name)
