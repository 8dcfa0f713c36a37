"""Entity resolution of street and line names (ER*, WN9).

Work always runs on distinct names; scores are computed only for pairs from ``candidates``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitframe import rules
from transitframe.functions import codes
from transitframe.functions import text as tx
from transitframe.functions.similarity import jaccard, mixed_score, sequence_ratio
from transitframe.operators.candidates import containment_join, jaccard_join, ratio_candidates, ratio_join
from transitframe.operators.ordered import best_per_key, last_wins, top_per_group
from transitframe.session import cut_lineage, once_per_value, store


def resolve_streets(queries: DataFrame, line_streets: DataFrame, registry: DataFrame) -> DataFrame:
    """ER1/JN4: street -> code by exact (line+direction, line, global, without complement), containment and
    fuzzy stages; each stage sees only what the earlier ones left over.

    ``queries(line_num, direction, street)``; ``line_streets(line_num, direction, street, street_code, ord)``
    lists streets already coded per line; ``registry(street_code, street, ord)``.
    Returns the distinct queries with ``street_code``, ``official`` and ``match``.
    """
    q = store(queries.select("line_num", "direction", "street").distinct())
    # the rules run once per spelling, not once per line
    forms = store(once_per_value(q, "street", {"norm": codes.code_match_key("street"), "norm_nc": codes.code_match_key("street", drop_complement=True)}))
    q = q.join(forms, "street", "left")
    hit = F.struct(F.col("street_code").alias("code"), F.col("street").alias("official"))
    place = F.when(F.col("direction") == "ida", 0).otherwise(1)

    # per line and direction: the key keeps its first position and its last value
    lined = line_streets.filter(F.col("line_num") != "").withColumn("norm", codes.code_match_key("street"))
    per_direction = lined.groupBy("line_num", "direction", "norm").agg(
        F.min("ord").alias("pos"), F.max_by(hit, "ord").alias("hit")
    )
    # one row per line and key, so that queries meet it once: the hits of the directions, the first and the last of them
    per_line = store(per_direction.groupBy("line_num", "norm").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("direction").isNotNull(), F.struct("direction", "hit")))).alias("hits"),
        F.min_by("hit", F.struct(place, "pos")).alias("hit"),
        F.max_by("hit", place).alias("merged_hit"),
        F.min(F.struct(place.alias("d"), "pos")).alias("pos"),
    ))
    everywhere = registry.withColumn("norm", codes.code_match_key("street")).groupBy("norm").agg(
        F.min_by(hit, "ord").alias("hit"), F.min("ord").alias("pos")
    )
    everywhere = store(everywhere)
    without = registry.withColumn("norm_nc", codes.code_match_key("street", drop_complement=True)).groupBy("norm_nc").agg(
        F.min_by(hit, "ord").alias("hit_nc")
    )

    staged = (
        q.join(per_line.select("line_num", "norm", "hits", F.col("hit").alias("h2")).hint("merge"), ["line_num", "norm"], "left")
        .withColumn("h1", F.col("hits")[F.col("direction")])
        .join(everywhere.select("norm", F.col("hit").alias("h3")), "norm", "left")
        .join(without, "norm_nc", "left")
    )
    match = (
        F.when(F.col("h1").isNotNull() | F.col("h2").isNotNull(), "exato")
        .when(F.col("h3").isNotNull(), "exato_global")
        .when(F.col("hit_nc").isNotNull(), "exato_sem_complemento")
    )
    staged = store(
        staged.select(
            "line_num", "direction", "street", "norm",
            F.coalesce("h1", "h2", "h3", "hit_nc").alias("hit"), match.alias("match"),
        )
    )
    open_queries = staged.filter(F.col("match").isNull()).select("line_num", "norm").distinct()

    # containment: the line's own streets when it has any, else the whole registry
    lines_known = per_line.select("line_num").distinct()
    own = open_queries.join(lines_known, "line_num", "left_semi")
    other = open_queries.join(lines_known, "line_num", "left_anti")
    # pairs carry keys and places alone; the hit comes back by the key that was chosen
    keys = per_line.select("line_num", "norm", "pos")
    chosen = lambda hit: per_line.select("line_num", F.col("norm").alias("_norm"), F.col(hit).alias("hit")).hint("merge")
    contained_line = containment_join(own, keys, "norm", on=["line_num"])
    contained_line = contained_line.groupBy("line_num", F.col("l_norm").alias("norm")).agg(F.min_by("r_norm", "r_pos").alias("_norm"))
    contained_line = contained_line.join(chosen("merged_hit"), ["line_num", "_norm"]).select("line_num", "norm", "hit")
    contained_all = containment_join(other.select("norm").distinct(), everywhere, "norm").groupBy(F.col("l_norm").alias("norm")).agg(
        F.min_by("r_hit", "r_pos").alias("hit")
    )
    contained = contained_line.unionByName(other.join(contained_all, "norm").select("line_num", "norm", "hit")).withColumn(
        "match", F.lit("contem")
    )
    contained = store(contained)
    still_open = open_queries.join(contained, ["line_num", "norm"], "left_anti")

    fuzzy_line = ratio_join(still_open, keys, "norm", rules.FUZZY_THRESHOLD, on=["line_num"])
    fuzzy_line = fuzzy_line.groupBy("line_num", F.col("l_norm").alias("norm")).agg(
        F.min_by("r_norm", F.struct(-F.col("score"), "r_pos")).alias("_norm")
    )
    fuzzy_line = fuzzy_line.join(chosen("hit"), ["line_num", "_norm"]).select("line_num", "norm", "hit", F.lit("fuzzy").alias("match"))
    fuzzy_line = store(fuzzy_line)
    last_open = still_open.join(fuzzy_line, ["line_num", "norm"], "left_anti")
    fuzzy_all = ratio_join(last_open.select("norm").distinct(), everywhere, "norm", rules.FUZZY_THRESHOLD)
    fuzzy_all = fuzzy_all.groupBy(F.col("l_norm").alias("norm")).agg(
        F.min_by("r_hit", F.struct(-F.col("score"), "r_pos")).alias("hit")
    )
    fuzzy_all = last_open.join(fuzzy_all, "norm").select("line_num", "norm", "hit", F.lit("fuzzy_global").alias("match"))
    late = contained.unionByName(fuzzy_line).unionByName(fuzzy_all).select(
        "line_num", "norm", F.col("hit").alias("late_hit"), F.col("match").alias("late_match")
    )
    done = staged.join(late, ["line_num", "norm"], "left")
    final = F.coalesce("hit", "late_hit")
    return done.select(
        "line_num", "direction", "street", final["code"].alias("street_code"), final["official"].alias("official"),
        F.coalesce("match", "late_match", F.lit("nao_encontrado")).alias("match"),
    )


def similar_pairs(streets: DataFrame, prefixes: tuple[str, ...] = rules.CORE_PREFIXES_REPORT) -> DataFrame:
    """ER3: pairs of distinct streets that share a core word and have 0.82 <= ratio < 1.

    ``streets(key, street, street_code, occurrences, first_seen)`` as from ``aggregates.distinct_streets``;
    the earlier street is side a.
    """
    cored = streets.withColumn("core", tx.core_name(F.col("key"), prefixes)).filter(F.length("core") >= rules.PAIR_MIN_CORE)
    cored = cored.withColumn("core_words", tx.words(F.col("core")))
    earlier = F.col("l_first_seen") < F.col("r_first_seen")
    related = F.arrays_overlap("l_core_words", "r_core_words")
    pairs = ratio_join(cored, cored, "key", rules.FUZZY_THRESHOLD, condition=earlier & related)
    return pairs.filter(F.col("score") < 1.0).select(
        *[F.col(f"{s}_{c}").alias(f"{c}_{t}") for s, t in (("l", "a"), ("r", "b")) for c in ("key", "core", "street", "street_code", "occurrences")],
        "score",
    )


def duplicate_candidates(spellings: DataFrame) -> DataFrame:
    """ER4: pairs of spellings with equal distinctive words and ratio >= 0.82 (a before b by spelling)."""
    keyed = spellings.select("street").distinct().withColumn("key", tx.norm_key("street"))
    signature = F.array_join(tx.distinctive_tokens(F.col("key"), rules.SPELLED_NUMBERS, rules.ROMAN_NUMERALS), "|")
    keyed = keyed.withColumn("signature", signature)
    before = F.col("l_street") < F.col("r_street")
    pairs = ratio_join(keyed, keyed, "key", rules.FUZZY_THRESHOLD, on=["signature"], condition=before)
    return pairs.select(F.col("l_street").alias("street_a"), F.col("r_street").alias("street_b"), "score")


def close_matches(names: DataFrame, candidates: DataFrame, cutoff: float = rules.CLOSE_MATCH_CUTOFF) -> DataFrame:
    """ER5 with cut-off: best candidate at or above it; the candidate is the first argument of the ratio and
    the greatest text wins a tie."""
    left = names.select("name").distinct().withColumn("text", tx.norm_key("name"))
    right = last_wins(candidates.withColumn("text", tx.norm_key("candidate")), ["text"], ["ord"], ["candidate"])
    pairs = ratio_join(left, right, "text", cutoff, right_first=True)
    return pairs.groupBy(F.col("l_name").alias("name")).agg(
        F.max_by(F.struct(F.col("r_candidate").alias("candidate"), "score"), F.struct("score", "r_text")).alias("_b")
    ).select("name", "_b.*")


def match_company_lines(listed: DataFrame, active: DataFrame) -> DataFrame:
    """ER6/JN12: best active line of the same company by word overlap of any of three names (>= 0.25).

    ``listed(listing_id, company, line, name_ida, name_volta)``, ``active(company, code, name, ord)``.
    """
    names = listed.select(
        "listing_id", "company", F.explode(F.array_distinct(F.array("line", "name_ida", "name_volta"))).alias("n")
    ).filter(F.coalesce(F.length("n"), F.lit(0)) > 0)
    left = cut_lineage(names.select("listing_id", "company", tx.relevant_words("n").alias("words")).filter(F.size("words") > 0).distinct())
    right = active.select("company", "code", "ord", F.array_sort(tx.relevant_words("name")).alias("words"))
    # of equal word sets the first line wins, so one line per set is left
    right = cut_lineage(right.filter(F.size("words") > 0).groupBy("company", "words").agg(F.min_by("code", "ord").alias("code"), F.min("ord").alias("ord")))
    equal = left.select("listing_id", "company", F.array_sort("words").alias("words")).join(right, ["company", "words"])
    best = cut_lineage(equal.groupBy("listing_id").agg(F.min_by(F.struct("code", F.lit(1.0).alias("score")), "ord").alias("_b")))
    # the best score is what counts: a listing that has found a line is not compared at lower levels
    for level in (*rules.COMPANY_LEVELS, rules.COMPANY_JACCARD):
        left = cut_lineage(left.join(best, "listing_id", "left_anti"))
        if left.isEmpty():
            break
        sets = left.select("company", "words").distinct()
        pairs = jaccard_join(sets, right, "words", level, on=["company"])
        nearest = pairs.groupBy("company", F.col("l_words").alias("words")).agg(
            F.min_by(F.struct(F.col("r_code").alias("code"), "score", F.col("r_ord").alias("ord")), F.struct(-F.col("score"), "r_ord")).alias("_n")
        )
        found = left.join(nearest, ["company", "words"]).groupBy("listing_id").agg(
            F.min_by(F.struct("_n.code", "_n.score"), F.struct(-F.col("_n.score"), "_n.ord")).alias("_b")
        )
        best = cut_lineage(best.unionByName(found))
    return listed.select("listing_id", "company").join(best, "listing_id", "left").select(
        "listing_id", "company", F.col("_b.code").alias("code"), F.col("_b.score").alias("score")
    )


def similar_name_clusters(itinerary: DataFrame, threshold: float = rules.CLUSTER_JACCARD) -> DataFrame:
    """ER7: clusters of spellings. In order of first appearance a key leads unless an earlier leader is
    similar to it; a member joins its earliest similar leader. Not connected components.

    Leaders and members are settled in rounds over the similarity edges (written out each round): a key
    whose earlier neighbours are all members leads, a key with an earlier leading neighbour is a member.
    """
    position = F.struct("ord", F.when(F.col("direction") == "ida", 0).otherwise(1).alias("d"), "seq")
    spelled = itinerary.groupBy("street").agg(F.min(position).alias("pos"), F.count(F.lit(1)).alias("occurrences"))
    spelled = cut_lineage(spelled.withColumn("key", tx.norm_key("street")))
    keys = spelled.groupBy("key").agg(F.min("pos").alias("pos")).withColumn(
        "words", F.array_distinct(F.filter(F.split("key", " "), lambda w: F.length(w) >= 3))
    )
    edges = cut_lineage(
        jaccard_join(keys, keys, "words", threshold, condition=F.col("l_pos") < F.col("r_pos")).select(
            F.col("l_key").alias("earlier"), F.col("l_pos").alias("earlier_pos"), F.col("r_key").alias("later")
        )
    )
    followers = edges.select(F.col("later").alias("key")).distinct().withColumn("_f", F.lit(True))
    settled = cut_lineage(
        keys.join(followers, "key", "left").select("key", F.when(F.col("_f").isNull(), F.lit(True)).alias("leads"))
    )
    while settled.filter("leads is null").take(1):
        state = settled.select(F.col("key").alias("earlier"), F.col("leads").alias("earlier_leads"))
        seen = (
            edges.join(settled.filter("leads is null").select(F.col("key").alias("later")), "later", "left_semi")
            .join(state, "earlier")
            .groupBy("later")
            .agg(
                F.max(F.coalesce("earlier_leads", F.lit(False))).alias("led"),
                F.min(F.col("earlier_leads").isNotNull()).alias("known"),
            )
        )
        decision = F.when(F.col("led"), F.lit(False)).when(F.col("known"), F.lit(True))
        settled = cut_lineage(
            settled.join(seen.withColumnRenamed("later", "key"), "key", "left").select("key", F.coalesce("leads", decision).alias("leads"))
        )
    leaders = settled.filter("leads")
    owned = (
        edges.join(leaders.select(F.col("key").alias("earlier")), "earlier", "left_semi")
        .join(settled.filter("not leads").select(F.col("key").alias("later")), "later", "left_semi")
        .groupBy(F.col("later").alias("key"))
        .agg(F.min_by("earlier", "earlier_pos").alias("leader"))
    )
    assigned = leaders.select("key", F.col("key").alias("leader")).unionByName(owned)
    members = spelled.join(assigned, "key")
    sizes = members.groupBy("leader").agg(
        F.count(F.lit(1)).alias("variants"), F.sum("occurrences").alias("total_occurrences")
    ).filter("variants > 1")
    return members.join(sizes, "leader").select("leader", "street", "occurrences", "variants", "total_occurrences")


def canonical_by_code(itinerary: DataFrame, manual: DataFrame) -> DataFrame:
    """ER8: per code with several spellings: the only one known to the manual list, else the most accented when
    they differ in accents only, else pending."""
    distinct = itinerary.filter(F.coalesce(F.length("street_code") > 0, F.lit(False))).select("street_code", "street").distinct()
    known = manual.select(tx.norm_key("street").alias("key")).distinct().withColumn("_m", F.lit(1))
    rated = distinct.withColumn("key", tx.norm_key("street")).join(known, "key", "left").withColumn("accents", tx.accent_score("street"))
    per_code = rated.groupBy("street_code").agg(
        F.count(F.lit(1)).alias("spellings"),
        F.count("_m").alias("in_manual"),
        F.max(F.when(F.col("_m") == 1, F.col("street"))).alias("manual_street"),
        F.min("key").alias("_k1"),
        F.max("key").alias("_k2"),
        F.min_by("street", F.struct(-F.col("accents"), "street")).alias("accented"),
    ).filter("spellings > 1")
    rule = (
        F.when(F.col("in_manual") == 1, "manual").when(F.col("_k1") == F.col("_k2"), "accent").otherwise("pending")
    )
    chosen = F.when(rule == "manual", F.col("manual_street")).when(rule == "accent", F.col("accented"))
    return per_code.select("street_code", "spellings", rule.alias("rule"), chosen.alias("canonical"))


def apply_canonical_codes(itinerary: DataFrame, canonical: DataFrame) -> DataFrame:
    """ER8: itinerary with canonical spellings and a ``changed`` flag."""
    chosen = canonical.filter("canonical is not null").select("street_code", "canonical")
    joined = itinerary.join(chosen, "street_code", "left")
    changed = F.coalesce(F.col("canonical") != F.col("street"), F.lit(False))
    return joined.withColumn("changed", changed).withColumn("street", F.coalesce("canonical", "street")).drop("canonical")


def canonical_by_key(itinerary: DataFrame) -> DataFrame:
    """ER9: per comparison key with several spellings the best one: most accents, then longest, then first seen."""
    position = F.struct("ord", F.when(F.col("direction") == "ida", 0).otherwise(1).alias("d"), "seq")
    spelled = itinerary.filter(F.col("street") != "").groupBy("street").agg(F.min(position).alias("pos"))
    rated = spelled.withColumns({"key": tx.norm_key("street"), "accents": tx.accent_score("street")})
    best = rated.groupBy("key").agg(
        F.count(F.lit(1)).alias("spellings"),
        F.min_by("street", F.struct(-F.col("accents"), -F.length("street"), "pos")).alias("canonical"),
    ).filter("spellings > 1")
    return rated.select("street", "key").join(best, "key").filter("street <> canonical").select("street", "canonical")


def apply_canonical_spellings(itinerary: DataFrame, canonical: DataFrame) -> DataFrame:
    """ER9: itinerary with canonical spellings and a ``changed`` flag."""
    joined = itinerary.join(canonical, "street", "left")
    return joined.withColumn("changed", F.col("canonical").isNotNull()).withColumn("street", F.coalesce("canonical", "street")).drop("canonical")


def classify_new(new: DataFrame, reference: DataFrame) -> DataFrame:
    """ER10: new streets: exact in the reference, exact after expanding abbreviations, or new."""
    known = reference.withColumn("k", tx.norm_keep_punct("street")).groupBy("k").agg(F.max_by("street", "ord").alias("ref"))
    fresh = new.select(tx.strip("street").alias("street")).distinct()
    exact = known.select(F.col("k").alias("k1"), F.col("ref").alias("r1"))
    expanded = known.select(F.col("k").alias("k2"), F.col("ref").alias("r2"))
    joined = (
        fresh.withColumns({"k1": tx.norm_keep_punct("street"), "k2": codes.expand("street", "expansion")})
        .join(exact, "k1", "left").join(expanded, "k2", "left")
    )
    status = F.when(F.col("r1").isNotNull(), "exact").when(F.col("r2").isNotNull(), "expanded").otherwise("new")
    return joined.select("street", status.alias("status"), F.coalesce("r1", "r2").alias("reference"))


def variant_candidates(new: DataFrame, reference: DataFrame, keep: int = 3) -> DataFrame:
    """WN9/SM3: for streets not in the reference, the best three reference names with score >= 0.50.

    score = (ratio + word overlap) / 2 >= 0.5 means overlap >= 0.3 or ratio > 0.7, so the union of those
    two exact joins holds every qualifying pair.
    """
    # the rules run once per spelling: the last row of each is all that counts of the reference
    latest = reference.groupBy("street").agg(F.max("ord").alias("ord"))
    forms = once_per_value(latest, "street", {"text": tx.norm_blank_punct("street")})
    ref = latest.join(forms, "street").groupBy("text").agg(F.max_by("street", "ord").alias("ref"))
    fresh = once_per_value(
        new.select(tx.strip("street").alias("street")), "street",
        {"plain": tx.norm_blank_punct("street"), "text": codes.expand("street", "variants")},
    )
    fresh = fresh.join(ref.select(F.col("text").alias("plain")), "plain", "left_anti").join(ref.select("text"), "text", "left_anti")
    texts = fresh.select("text").distinct().withColumn("words", tx.content_tokens(F.col("text"), rules.STOPWORDS))
    refs = ref.select("text").withColumn("words", tx.content_tokens(F.col("text"), rules.STOPWORDS))
    by_words = jaccard_join(texts, refs, "words", 0.3).select("l_text", "r_text", "l_words", "r_words")
    by_ratio = ratio_candidates(texts, refs, "text", 0.7, condition=jaccard(F.col("l_words"), F.col("r_words")) < 0.3)
    pairs = by_words.unionByName(by_ratio.select("l_text", "r_text", "l_words", "r_words"))
    pairs = pairs.withColumn("overlap", jaccard(F.col("l_words"), F.col("r_words")))
    scored = pairs.withColumn("score", mixed_score(sequence_ratio("l_text", "r_text"), F.col("overlap"))).filter(
        F.col("score") >= rules.VARIANT_SCORE
    )
    named = scored.join(ref.withColumnRenamed("text", "r_text"), "r_text")
    top = top_per_group(named, ["l_text"], [F.desc("score"), F.desc("ref"), F.desc("r_text")], keep)
    return fresh.select("street", "text").join(
        top.select(F.col("l_text").alias("text"), "rank", "ref", "score"), "text", "left"
    ).select("street", "rank", F.col("ref").alias("reference"), "score")


class MergeSides(NamedTuple):
    """The sides of ER11 with numbers for their streets: ``manual(line_code, line_name, _codes, direction, seq, fid, kid, sid, mid)`` and
    ``system(_codes, line_code, direction, seq, fid, kid, sid, mid)``; ``forms(fid, street)`` and ``sets(sid, words)``.

    ``_codes`` are the codes of a line name; names of the same codes share the system's streets. ``fid`` numbers the written-out
    forms in their order, ``kid`` their keys, ``sid`` their word sets; ``mid`` is ``sid``, or one number per key where the set is empty.
    """

    manual: DataFrame
    system: DataFrame
    forms: DataFrame
    sets: DataFrame


def merge_sides(manual: DataFrame, system: DataFrame) -> MergeSides:
    """ER11: both sides written once, slim: what depends on a spelling or on the codes alone is not repeated per row and line name."""
    written = store(manual.select("line_code", "line_name", "direction", "seq", "street"))
    listed = store(system.select("line_code", "direction", "seq", "street"))
    spelled = once_per_value(written.select("street").union(listed.select("street")).filter("street is not null"), "street", {"full": codes.expand("street", "merge")})
    keyed = once_per_value(spelled, "full", {"key": tx.norm_key("full")})
    keyed = keyed.withColumn("words", F.array_distinct(F.filter(F.split("key", " "), lambda w: F.length(w) >= 3)))
    forms = store(keyed.orderBy("full").withColumn("fid", F.monotonically_increasing_id()))
    forms = forms.join(forms.groupBy("key").agg(F.min("fid").alias("kid")), "key").join(forms.groupBy("words").agg(F.min("fid").alias("sid")), "words")
    forms = store(forms.withColumn("mid", F.when(F.size("words") == 0, -1 - F.col("kid")).otherwise(F.col("sid"))))
    numbers = store(spelled.join(forms, "full").select("street", "fid", "kid", "sid", "mid"))

    names = written.select("line_code", "line_name").distinct()
    several = names.groupBy("line_name").agg(F.array_sort(F.collect_set("line_code")).alias("_several")).filter(F.size("_several") > 1)
    several = store(several)
    with_codes = lambda df: df.join(several, "line_name", "left").withColumn("_codes", F.coalesce("_several", F.array("line_code"))).drop("_several")
    m = store(with_codes(written).join(numbers, "street", "left").drop("street"))
    members = with_codes(names).select("_codes", "line_code").distinct()
    # lines of one code may list the same street at the same place: it counts once
    s = listed.join(numbers, "street", "left").select("line_code", "direction", "seq", "fid", "kid", "sid", "mid").distinct()
    s = store(s.join(members, "line_code"))
    return MergeSides(m, s, forms.select("fid", F.col("full").alias("street")), forms.filter("fid = sid").select("sid", "words"))


def merge_streets(sides: MergeSides) -> DataFrame:
    """ER11: the manual streets, written out."""
    return sides.manual.join(sides.forms, "fid", "left").select("line_code", "line_name", "direction", "seq", "street")


def merge_pairs(sides: MergeSides) -> DataFrame:
    """ER11: manual streets without an exact match, with the system's street of the greatest word overlap (>= 0.4)."""
    on = ["_codes", "direction"]
    m, s, forms, sets = sides
    # the score depends on the word sets alone, so only distinct sets meet; occurrences come back at the end
    of_name = m.filter("line_name is not null")
    keys = of_name.select(*on, "kid", "sid").distinct()
    exact = s.select(*on, "kid").distinct()
    keys = store(keys.join(exact, [*on, "kid"], "left_anti"))
    s_sets = s.groupBy(*on, "sid").agg(F.min(F.struct("seq", "fid")).alias("first")).select(*on, "sid", "first.seq", "first.fid")
    pairs = jaccard_join(keys.select(*on, "sid").distinct().join(sets, "sid"), s_sets.join(sets, "sid"), "words", rules.MERGE_JACCARD, on=on)
    order = F.struct(-F.col("score"), "r_seq", "r_fid")
    nearest = pairs.groupBy(*on, F.col("l_sid").alias("sid")).agg(F.min_by(F.struct(F.col("r_fid").alias("system"), "score"), order).alias("_b"))
    best = of_name.join(keys.join(nearest, [*on, "sid"]).select(*on, "kid", "_b.*"), [*on, "kid"])
    best = best.join(forms.select("fid", F.col("street").alias("manual")), "fid")
    best = best.withColumnRenamed("system", "_fid").join(forms.select(F.col("fid").alias("_fid"), F.col("street").alias("system")), "_fid")
    return best.select("line_code", "line_name", "direction", "seq", "manual", "system", "score")


def merge_extras(sides: MergeSides) -> DataFrame:
    """ER11: streets of the system with neither an exact nor a fuzzy match among those of the line name."""
    on = ["_codes", "direction"]
    m, s, forms, sets = sides
    named = m.select(*on, "line_name", "sid", "mid").distinct()
    left = s.select(*on, "sid").distinct().join(sets, "sid")
    pairs = jaccard_join(left, named.select(*on, "sid").distinct().join(sets, "sid"), "words", rules.MERGE_JACCARD, on=on)
    pairs = pairs.select(*on, F.col("r_sid").alias("sid"), F.col("l_sid").alias("_reached"))
    # equal keys have equal sets and overlap wholly, except where the set is empty
    reached = named.join(pairs, [*on, "sid"]).select(*on, "line_name", F.col("_reached").alias("mid"))
    reached = reached.union(named.filter("mid < 0").select(*on, "line_name", "mid")).distinct()
    every = s.join(m.select("_codes", "line_name").distinct(), "_codes")
    extras = every.join(reached, [*on, "line_name", "mid"], "left_anti")
    return extras.join(forms, "fid", "left").select("line_code", "line_name", "direction", "seq", "street")


def merge_with_system(manual: DataFrame, system: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ER11: per (code, direction): the expanded manual streets, fuzzy manual-system pairs (word overlap >= 0.4,
    exact matches skipped), and system streets with neither an exact nor a fuzzy match.

    ``manual(line_code, line_name, direction, seq, street)``, ``system(line_code, direction, seq, street)``.
    """
    sides = merge_sides(manual, system)
    return merge_streets(sides), merge_pairs(sides), merge_extras(sides)


def suggest_neighbourhoods(streets: DataFrame, geocoded: DataFrame, zones: DataFrame, cell: float) -> DataFrame:
    """ER12: neighbourhood of streets without code from cached geocoder points: OK, outside all zones, no result."""
    from transitframe.operators.spatial import zone_of_points

    placed = zone_of_points(streets.join(geocoded, "street"), zones, cell)
    joined = streets.join(placed.select("street", "zone_name"), "street", "left")
    status = (
        F.when(F.col("zone_name").isNull(), "SEM_RESULTADO")
        .when(F.col("zone_name") == rules.OUTSIDE_ZONES, "FORA_DAS_ZONAS")
        .otherwise("OK")
    )
    return joined.select("street", F.col("zone_name").alias("suggested"), status.alias("confidence"))


def middle_vertices(points: DataFrame, keys: list[str]) -> DataFrame:
    """ER12: the vertex at half the number of vertices of each path; ``seq`` is dense from 0."""
    half = points.groupBy(*keys).agg(F.floor(F.count(F.lit(1)) / 2).alias("seq"))
    return points.join(half, [*keys, "seq"], "left_semi").select(*keys, "seq", "lat", "lon")
