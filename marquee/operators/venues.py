"""Venue names to canonical names.

The alias list is a short, fixed dimension, so both lookups are expressions inside the scan: no join, no
shuffle, nothing broadcast that grows with the data. A longer alias table goes through ``resolve_with_table``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee import config
from marquee.functions.text import folded, let, squeeze_ends
def exact_venue(name: Column, aliases: list[tuple[int, str, str]] | None = None) -> Column:
    """Canonical name when the trimmed lower-case name is an alias, else null."""
    return _exact(squeeze_ends(F.lower(name)), aliases or config.venue_aliases())


def contained_venue(name: Column, aliases: list[tuple[int, str, str]] | None = None) -> Column:
    """Canonical name of the first alias that holds, or is held in, the name; null when there is none."""
    return let(squeeze_ends(F.lower(name)), lambda key: _contained(key, aliases or config.venue_aliases()))


def canonical_venue(name: Column, aliases: list[tuple[int, str, str]] | None = None) -> Column:
    """Exact alias, else first containment either way, else the trimmed name. A blank name takes the first alias."""
    table = aliases or config.venue_aliases()
    found = let(squeeze_ends(F.lower(name)), lambda key: F.coalesce(_exact(key, table), _contained(key, table)))
    return F.coalesce(found, squeeze_ends(name))


def _exact(key: Column, aliases: list[tuple[int, str, str]]) -> Column:
    return F.try_element_at(folded({alias: canonical for _, alias, canonical in aliases}, "map<string,string>"), key)


def _contained(key: Column, aliases: list[tuple[int, str, str]]) -> Column:
    table = folded([{"a": alias, "c": canonical} for _, alias, canonical in aliases], "array<struct<a:string,c:string>>")
    return F.get(F.filter(table, lambda t: F.contains(key, t["a"]) | F.contains(t["a"], key)), F.lit(0))["c"]


def resolve_with_table(df: DataFrame, alias_table: DataFrame, name_col: str, out_col: str) -> DataFrame:
    """The same lookup against an alias table ``(alias_rank, alias, canonical)`` of any size.

    Exact names are an equi-join. Only distinct names left over are searched for containment, and that too is an
    equi-join: a text inside another shares all its own runs of three characters with it, so the shorter side is keyed by
    the one that is rarest on the longer side, and the longer side by all its substrings of that length. Nothing is compared with every
    alias, and a run that half of all names hold keys only texts that have no rarer one.
    """
    key = squeeze_ends(F.lower(name_col))
    aliases = alias_table.select("alias_rank", "alias", "canonical")
    names = df.select(key.alias("_key")).distinct()
    exact = names.join(aliases, F.col("_key") == F.col("alias"), "left")
    rest = exact.where(F.col("canonical").isNull()).select("_key")
    name_grams = rest.select("_key", F.explode(substrings(F.col("_key"))).alias("gram"))
    in_name = name_grams.join(with_rarest_gram(aliases, "alias", name_grams), "gram").where(F.contains("_key", "alias"))
    alias_grams = aliases.select("*", F.explode(substrings(F.col("alias"))).alias("gram"))
    in_alias = with_rarest_gram(rest, "_key", alias_grams).join(alias_grams, "gram").where(F.contains("alias", "_key"))
    held = (in_name.select("_key", "canonical", "alias_rank").unionByName(in_alias.select("_key", "canonical", "alias_rank"))
            .groupBy("_key").agg(F.min_by("canonical", "alias_rank").alias("_hit")))
    table = (exact.where(F.col("canonical").isNotNull()).select("_key", F.col("canonical").alias("_hit"))
             .unionByName(held))
    return (df.withColumn("_key", key).join(table, "_key", "left")
            .withColumn(out_col, F.coalesce("_hit", squeeze_ends(F.col(name_col)))).drop("_key", "_hit"))


def with_rarest_gram(short: DataFrame, text: str, grams: DataFrame) -> DataFrame:
    """``short`` with ``gram``: of the text's runs of three characters the one with the fewest rows in ``grams``; a shorter text stands for itself."""
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    spots = F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1)))
    own = short.select(text).distinct().select(text, F.explode(F.array_distinct(F.transform(spots, lambda i: F.substr(F.col(text), i, F.lit(3))))).alias("gram"))
    rarest = own.join(counts, "gram", "left").groupBy(text).agg(F.min_by("gram", F.struct(F.coalesce("_n", F.lit(0)), "gram")).alias("gram"))
    return short.join(rarest, text)


def substrings(x: Column) -> Column:
    """Distinct substrings of up to three characters, the empty one included."""
    spots = F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(spots, lambda i: F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda n: F.substr(x, i, n)))))


def venue_or_tba(name: Column) -> Column:
    """Canonical venue of a non-empty name, else the placeholder."""
    return F.when(F.length(name) > 0, canonical_venue(name)).otherwise(F.lit(config.VENUE_TBA))
