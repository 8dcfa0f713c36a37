"""Set reconciliation between sources (RC*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitframe import rules
from transitframe.functions import codes
from transitframe.functions import text as tx


def two_way(left: DataFrame, right: DataFrame, key: str, left_name: str = "left", right_name: str = "right") -> DataFrame:
    """RC1: distinct keys with status both / only in one source."""
    l = left.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_l", F.lit(True))
    r = right.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_r", F.lit(True))
    status = (
        F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), f"only_{left_name}").otherwise(f"only_{right_name}")
    )
    return l.join(r, key, "full").select(key, status.alias("status"))


def status_counts(reconciled: DataFrame) -> DataFrame:
    return reconciled.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def version_diff(old: DataFrame, new: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """RC2: added/removed/kept between versions and whether the catalogue knows the key; one aggregation."""
    tagged = [
        df.select(key, *[F.lit(s == name).alias(f"in_{s}") for s in ("old", "new", "catalogue")]).filter(F.col(key).isNotNull())
        for name, df in (("old", old), ("new", new), ("catalogue", catalogue))
    ]
    merged = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    flags = merged.groupBy(key).agg(*[F.max(f"in_{s}").alias(f"in_{s}") for s in ("old", "new", "catalogue")])
    change = (
        F.when(F.col("in_new") & ~F.col("in_old"), "added")
        .when(F.col("in_old") & ~F.col("in_new"), "removed")
        .when(F.col("in_old") & F.col("in_new"), "kept")
        .otherwise("missing")
    )
    against = F.when(F.col("in_new") & F.col("in_catalogue"), "both").when(F.col("in_new"), "only_map").when(
        F.col("in_catalogue"), "only_catalogue"
    ).otherwise("neither")
    return flags.select(key, change.alias("change"), against.alias("catalogue_status"))


def active_against_system(active: DataFrame, system: DataFrame, exclusions: DataFrame | None = None) -> DataFrame:
    """RC3: official codes against system codes; known exclusions get their own status.

    ``active(code, name, service, company, ord)``, ``system(line_name, ord)``; turnstile rows are left out and a
    repeated code keeps its last row.
    """
    official = active.filter(F.col("service") != rules.TURNSTILE_TYPE).groupBy("code").agg(
        F.max_by(F.struct("name", "service", "company"), "ord").alias("_v")
    ).select("code", "_v.*")
    known = system.select(codes.code_dialect("line_name", "first_word").alias("code"), "line_name", "ord").groupBy("code").agg(
        F.max_by("line_name", "ord").alias("line_name")
    )
    if exclusions is None:
        literal = F.element_at(codes._literal_map(rules.KNOWN_EXCLUSIONS), F.col("code"))
        joined = official.join(known, "code", "full").withColumn("reason", literal)
    else:
        joined = official.join(known, "code", "full").join(exclusions.select("code", "reason"), "code", "left")
    status = (
        F.when(F.col("name").isNotNull() & F.col("line_name").isNotNull(), "both")
        .when(F.col("line_name").isNotNull(), "only_system")
        .when(F.col("reason").isNotNull(), "excluded")
        .otherwise("missing")
    )
    return joined.select("code", status.alias("status"), "name", "service", "company", "line_name")


def active_against_system_aliased(active: DataFrame, system: DataFrame) -> DataFrame:
    """RC4: comparison on normalised codes with the alias table; all names of a code are kept."""
    a = active.select(codes.code_dialect("code", "active_list").alias("code"), F.col("name").alias("active_name"), "ord").groupBy("code").agg(
        F.max_by("active_name", "ord").alias("active_name")
    )
    s = system.select(codes.with_alias(codes.line_code("line_name"), rules.ALIAS_COMPARE).alias("code"), "line_name").filter(
        F.col("code").isNotNull()
    )
    status = (
        F.when(F.col("line_name").isNull(), "new").when(F.col("active_name").isNull(), "gone").otherwise("both")
    )
    return a.join(s, "code", "full").select("code", status.alias("status"), "active_name", "line_name")


def _base(code: Column) -> Column:
    return F.substring(code, 1, 4)


def base_tolerant_diff(active: DataFrame, manual: DataFrame, system: DataFrame) -> DataFrame:
    """RC5: an official code is missing when absent and (its base is absent or it has a suffix); the
    reverse rule drops source codes whose base is official. Inputs: one ``code`` column each."""
    official = active.select("code").distinct()

    def missing(source: DataFrame, name: str) -> DataFrame:
        have = source.select("code").distinct()
        bases = have.select(_base(F.col("code")).alias("base")).distinct().withColumn("_b", F.lit(True))
        absent = official.join(have, "code", "left_anti").withColumn("base", _base(F.col("code"))).join(bases, "base", "left")
        return absent.filter(F.col("_b").isNull() | F.contains("code", F.lit("-"))).select("code", F.lit(True).alias(name))

    fm, fs = missing(manual, "m"), missing(system, "s")
    status = F.when(F.col("m") & F.col("s"), "missing_both").when(F.col("m"), "missing_manual").otherwise("missing_system")
    lost = fm.join(fs, "code", "full").select("code", status.alias("status"))
    bases = official.select(_base(F.col("code")).alias("base")).distinct().withColumn("_b", F.lit(True))

    def extra(source: DataFrame, status: str) -> DataFrame:
        unknown = source.select("code").distinct().join(official, "code", "left_anti")
        return (
            unknown.withColumn("base", _base(F.col("code"))).join(bases, "base", "left")
            .filter(~(F.col("_b").isNotNull() & ~F.contains("code", F.lit("-"))))
            .select("code", F.lit(status).alias("status"))
        )

    return lost.unionByName(extra(manual, "extra_manual")).unionByName(extra(system, "extra_system"))


def inventory_coverage(active: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """RC6: which official codes lack a document in either inventory, and documents without a line."""
    tagged = [
        df.select("code", *[F.lit(s == name).alias(f"in_{s}") for s in ("active", "first", "second")])
        for name, df in (("active", active), ("first", first), ("second", second))
    ]
    flags = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy("code").agg(
        *[F.max(f"in_{s}").alias(f"in_{s}") for s in ("active", "first", "second")]
    )
    status = (
        F.when(~F.col("in_active") & F.col("in_first") & F.col("in_second"), "extra_both")
        .when(~F.col("in_active") & F.col("in_first"), "extra_first")
        .when(~F.col("in_active"), "extra_second")
        .when(~F.col("in_first") & ~F.col("in_second"), "missing_both")
        .when(~F.col("in_first"), "missing_first")
        .when(~F.col("in_second"), "missing_second")
        .otherwise("covered")
    )
    return flags.select("code", status.alias("status"))


def neighbourhood_issues(listed: DataFrame, itinerary: DataFrame) -> DataFrame:
    """RC7: listed streets with an accent-only hit or no hit, itinerary streets never listed, and streets in
    several neighbourhoods. Best candidates for the no-hit rows come from ``nearest.no_match_candidates``."""
    rows = listed.select("neighbourhood", tx.strip("street").alias("street")).filter(F.col("street") != "")
    used = itinerary.select(tx.strip("street").alias("street")).filter(F.col("street") != "").distinct()
    used_keys = used.select(tx.norm_key("street").alias("key"), F.col("street").alias("other")).groupBy("key").agg(
        F.min("other").alias("other")
    )
    inexact = rows.distinct().join(used, "street", "left_anti").withColumn("key", tx.norm_key("street")).join(used_keys, "key", "left")
    unmatched = inexact.select(
        F.when(F.col("other").isNotNull(), "accent_only").otherwise("no_match").alias("issue"), "neighbourhood", "street", "other"
    )
    keys = rows.select("neighbourhood", tx.norm_key("street").alias("key"))
    missing = used.withColumn("key", tx.norm_key("street")).join(keys.select("key").distinct(), "key", "left_anti").select(
        F.lit("not_listed").alias("issue"), F.lit(None).cast("string").alias("neighbourhood"), "street",
        F.lit(None).cast("string").alias("other"),
    )
    several = keys.groupBy("key").agg(F.count_distinct("neighbourhood").alias("n")).filter("n > 1")
    repeated = several.select(
        F.lit("several_neighbourhoods").alias("issue"), F.lit(None).cast("string").alias("neighbourhood"),
        F.col("key").alias("street"), F.col("n").cast("string").alias("other"),
    )
    return unmatched.unionByName(missing).unionByName(repeated)


def compare_itineraries(left: DataFrame, right: DataFrame, keys: list[str], normalised: bool = False) -> DataFrame:
    """RC8/RC9: whether two sources list the same streets in the same order, per key.

    Positions meet in a full join on (key, seq): no street array is ever built.
    """
    shape = tx.norm_key("street") if normalised else F.col("street")
    l = left.select(*keys, "seq", shape.alias("_l"))
    r = right.select(*keys, "seq", shape.alias("_r"))
    compared = l.join(r, [*keys, "seq"], "full").groupBy(*keys).agg(
        F.count("_l").alias("left_streets"), F.count("_r").alias("right_streets"),
        F.sum(F.when(F.col("_l").eqNullSafe(F.col("_r")), 0).otherwise(1)).alias("differences"),
    )
    status = (
        F.when(F.col("left_streets") == 0, "only_right").when(F.col("right_streets") == 0, "only_left")
        .when(F.col("differences") == 0, "equal").otherwise("different")
    )
    return compared.withColumn("status", status)


def spelling_variants(itinerary: DataFrame) -> DataFrame:
    """RC9: spellings that share a comparison key with another spelling."""
    counts = itinerary.groupBy("street").agg(F.count(F.lit(1)).alias("times")).withColumn("key", tx.norm_key("street"))
    several = counts.groupBy("key").agg(F.count(F.lit(1)).alias("spellings")).filter("spellings > 1")
    return counts.join(several, "key")


def codes_outside_dictionary(streets: DataFrame, dictionary: DataFrame) -> DataFrame:
    """RC10: per distinct street: code unknown to the dictionary, no code but name known, no code and unknown."""
    entries = dictionary.select(tx.split_registry_name("name").alias("e")).filter(~F.col("e.needs_review"))
    known_codes = entries.select(F.col("e.street_code").alias("street_code")).filter("street_code is not null").distinct().withColumn("_c", F.lit(True))
    known_names = entries.select(
        tx.norm_key(F.regexp_replace("e.street", " 0000$", "")).alias("key")
    ).distinct().withColumn("_n", F.lit(True))
    joined = streets.join(known_codes, "street_code", "left").join(known_names, "key", "left")
    has_code = F.coalesce(F.length("street_code") > 0, F.lit(False))
    status = (
        F.when(has_code & F.col("_c").isNull(), "code_not_in_dictionary")
        .when(has_code, "coded")
        .when(F.col("_n").isNotNull(), "no_code_in_dictionary")
        .otherwise("no_code_not_in_dictionary")
    )
    return joined.select("key", "street", "street_code", "occurrences", status.alias("status"))


def union_first(parts: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """RC11: union of several sources keeping, per key, the first row (source order, then ``order``)."""
    tagged = [df.withColumn("_src", F.lit(i)) for i, df in enumerate(parts)]
    merged = tagged[0]
    for extra in tagged[1:]:
        merged = merged.unionByName(extra)
    columns = [c for c in merged.columns if c not in ("_src", key)]
    picked = F.min_by(F.struct(*columns), F.struct("_src", *order))
    return merged.groupBy(key).agg(picked.alias("_v")).select(key, "_v.*")


def street_coverage(new: DataFrame, reference: DataFrame) -> DataFrame:
    """RC12: distinct new streets: has a code, known to the reference without code, or unmatched; with uses."""
    ref = reference.withColumn("key", tx.norm_key("street")).groupBy("key").agg(
        F.max("street_code").alias("ref_code"), F.min("street").alias("ref_street")
    )
    streets = new.select(tx.strip("street").alias("street"), "street_code").groupBy("street").agg(
        F.max("street_code").alias("street_code"), F.count(F.lit(1)).alias("uses")
    )
    status = (
        F.when(F.coalesce("street_code", "ref_code").isNotNull(), "with_code")
        .when(F.col("ref_street").isNotNull(), "reference_without_code")
        .otherwise("unmatched")
    )
    return streets.withColumn("key", tx.norm_key("street")).join(ref, "key", "left").select(
        "street", status.alias("status"), F.coalesce("street_code", "ref_code").alias("street_code"), "uses"
    )


def line_contexts(coverage: DataFrame, itinerary: DataFrame) -> DataFrame:
    """RC12: where the unmatched streets of ``street_coverage`` are used: one row per street and ``code/DIRECTION``, with uses.

    ``itinerary(line_name, direction, street)``; a name without a code part stands for itself.
    """
    context = F.concat(tx.strip(F.split("line_name", " - ")[0]), F.lit("/"), F.upper("direction"))
    used = itinerary.select(tx.strip("street").alias("street"), context.alias("context")).groupBy("street", "context").agg(F.count(F.lit(1)).alias("uses"))
    return used.join(coverage.filter("status = 'unmatched'").select("street"), "street", "left_semi")
