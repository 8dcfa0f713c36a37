"""Line codes, abbreviation profiles, addresses and service types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from transitframe import rules
from transitframe.functions import text as tx


def _literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def _apply(value: Column, profile: list[tuple[str, str]], flags: str) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, f"(?{flags}){rule[0]}", rule[1]), profile, value)


def line_id(name: Column | str) -> Column:
    """stable id from the index key (trailing blank kept)."""
    return F.concat(F.lit("ln-"), F.substring(F.sha1(tx.norm_index(name)), 1, 10))


_CODE_HEAD = r"^([A-Z]{0,2})(\d{1,4})(?:\s*-{0,2}\s*([A-Z]))?(?=[\s\-/]|$)"


def line_code(name: Column | str) -> Column:
    """zero-padded number plus a letter found before or after it; null without a code."""
    upper = F.upper(tx.strip(name))
    prefix, digits, suffix = (F.regexp_extract(upper, _CODE_HEAD, i) for i in (1, 2, 3))
    letter = F.when(prefix != "", prefix).otherwise(suffix)
    return F.when(digits != "", F.concat(F.lpad(digits, 4, "0"), letter))


def _padded(value: Column) -> Column:
    return F.when(value.rlike(r"^\d+$") & (F.length(value) < 4), F.lpad(value, 4, "0")).otherwise(value)


def code_dialect(name: Column | str, dialect: str) -> Column:
    """the other code spellings in use; empty string or null where the source has none."""
    stripped = tx.strip(name)
    if dialect == "map_suffix":  # letter prefix kept, blank-separated suffix letter
        pattern = r"^([A-Z]?\d{3,4})(?:\s+([A-Z])(?=[\s\-/]|$))?"
        return _padded(F.concat(F.regexp_extract(stripped, pattern, 1), F.regexp_extract(stripped, pattern, 2)))
    if dialect == "map_plain":  # letter prefix kept, no suffix
        return _padded(F.regexp_extract(stripped, r"^([A-Z]?\d{3,4})", 1))
    if dialect == "prefix4":  # first four digits or nothing
        return F.regexp_extract(stripped, r"^(\d{4})", 1)
    if dialect == "hyphen_suffix":  # 1000-B, whole name when no code
        pattern = r"^\s*(\d{4})(?:\s?-\s?([A-Za-z])(?=\s*-))?"
        digits, letter = F.regexp_extract(F.col(name) if isinstance(name, str) else name, pattern, 1), F.regexp_extract(
            F.col(name) if isinstance(name, str) else name, pattern, 2
        )
        return F.when(digits == "", stripped).otherwise(
            F.concat(digits, F.when(letter != "", F.concat(F.lit("-"), F.upper(letter))).otherwise(F.lit("")))
        )
    if dialect == "active_list":  # 0004-M -> 0004M, other hyphens dropped
        upper = tx.strip(F.upper(stripped))
        return F.when(upper.rlike(r"^\d+-?(M|A|B)?$"), F.regexp_replace(upper, r"^(\d+)-?(M|A|B)?$", "$1$2")).otherwise(
            F.replace(upper, F.lit("-"), F.lit(""))
        )
    if dialect == "compact":  # upper case without hyphens and blanks
        return F.regexp_replace(F.upper(F.col(name) if isinstance(name, str) else name), "[- ]", "")
    if dialect == "leading_number":  # digits at the front, null without
        number = F.regexp_extract(stripped, r"^(\d+)", 1)
        return F.when(number != "", number)
    if dialect == "first_word":  # first blank-separated word, upper case
        return F.upper(F.regexp_extract(stripped, r"^(\S+)", 1))
    if dialect == "catalogue":  # numeric codes padded, others as they are
        return _padded(stripped)
    raise ValueError(f"unknown code dialect: {dialect}")


def zero_padded(number: Column, width: int) -> Column:
    """A whole number as text of at least ``width`` digits; longer numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def with_alias(code: Column, aliases: dict[str, str]) -> Column:
    """JN13: replace known wrong codes; the alias table is a small fixed literal."""
    return F.coalesce(F.element_at(_literal_map(aliases), code), code) if aliases else code


def description(name: Column | str) -> Column:
    """comparison key of the name without its code and deactivation tag."""
    upper = F.upper(tx.strip(name))
    rest = F.regexp_replace(F.regexp_replace(upper, _CODE_HEAD, ""), r"^[ \-/]+", "")
    return tx.norm_key(F.regexp_replace(rest, r"\(DESATIVADO\)", ""))


def description_words(name: Column | str) -> Column:
    """F5 over F4: distinct words of at least three characters."""
    return F.array_distinct(F.filter(F.split(description(name), " "), lambda w: F.length(w) >= 3))


def is_deactivated(name: Column | str) -> Column:
    return F.contains(F.upper(F.col(name) if isinstance(name, str) else name), F.lit("(DESATIVADO)"))


def should_rename(current: Column, new: Column) -> Column:
    """MG3: newly deactivated, or described in at least as many relevant words."""
    return (is_deactivated(new) & ~is_deactivated(current)) | (
        F.size(description_words(new)) >= F.size(description_words(current))
    )


def expand(value: Column | str, profile: str) -> Column:
    """spell abbreviations out with one of the six rule tables."""
    raw = F.col(value) if isinstance(value, str) else value
    if profile == "address":
        return tx.collapse(_apply(tx.strip(F.upper(raw)), rules.ADDRESS_PROFILE, "U"))
    if profile == "merge":
        return tx.collapse(_apply(tx.strip(raw), rules.MERGE_PROFILE, "iuU"))
    if profile == "code_match":
        table = _literal_map(rules.CODE_MATCH_WORDS)
        return F.array_join(
            F.transform(F.split(tx.norm_words(raw), " "), lambda w: F.coalesce(F.element_at(table, w), w)), " "
        )
    if profile == "expansion":
        return tx.norm_keep_punct(_apply(raw, rules.EXPANSION_PROFILE, "iuU"))
    if profile == "variants":
        return tx.norm_blank_punct(_apply(raw, rules.VARIANT_PROFILE, "iuU"))
    if profile == "registry":
        name = F.regexp_replace(
            tx.collapse(raw), r"(?U)(?<![\wÀ-Ú])T\.I\.?(?=\s|[A-ZÀ-Ú]|$)", "TERMINAL INTEGRADO "
        )
        dotted = [
            (rf"(?<![\wÀ-Ú]){key}\.(?=\s|[A-ZÀ-Ú]|$)", f"{full} ")
            for key, full in sorted(rules.REGISTRY_WORDS.items(), key=lambda kv: -len(kv[0]))
        ]
        name = F.when(F.contains(name, F.lit(".")), _apply(name, dotted, "U")).otherwise(name)
        undotted = [(rf"^{k}\s+", f"{rules.REGISTRY_WORDS[k]} ") for k in rules.REGISTRY_UNDOTTED_FIRST]
        return tx.collapse(_apply(name, undotted, "U"))
    raise ValueError(f"unknown abbreviation profile: {profile}")


def code_match_key(value: Column | str, drop_complement: bool = False) -> Column:
    """Key used by the street-to-code cascade."""
    return expand(tx.strip_parentheses(value) if drop_complement else value, "code_match")


def repair_extraction(value: Column | str) -> Column:
    """join words the text extraction split."""
    return _apply(F.col(value) if isinstance(value, str) else value, rules.EXTRACTION_REPAIRS, "U")


def street_of_address(address: Column | str) -> Column:
    """the street part of a full, comma-separated address."""
    raw = F.col(address) if isinstance(address, str) else address
    parts = F.transform(F.split(raw, ","), lambda p: F.upper(tx.strip(p)))
    types = "|".join(rules.STREET_TYPES)
    typed = F.filter(parts, lambda p: p.rlike(f"^(?:{types}) | (?:{types}) "))
    excluded = "|".join(rules.ADDRESS_EXCLUDED)
    plausible = F.filter(
        F.slice(parts, 1, 3),
        lambda p: ~p.rlike(r"^\d+(\s|$)") & ~p.rlike(excluded) & (F.length(p) > 3),
    )
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit(rules.UNKNOWN_STREET)).otherwise(
        F.coalesce(F.get(typed, 0), F.get(plausible, 0), F.get(parts, 0))
    )


def service_type(value: Column | str) -> Column:
    """service type by prefix; unknown types keep their own upper-case name."""
    upper = F.regexp_replace(F.upper(tx.strip(value)), r"\s+", " ")
    chain = F
    for prefix, label in rules.SERVICE_PREFIXES:
        chain = chain.when(F.startswith(upper, F.lit(prefix)), F.lit(label))
    return chain.otherwise(upper)


def sort_number(name: Column | str) -> Column:
    """SO1: leading number, 999999 without one."""
    number = F.regexp_extract(tx.strip(name), r"^(\d+)", 1)
    return F.coalesce(number.try_cast("bigint"), F.lit(999999).cast("bigint"))


def night_aware_sort(name: Column | str) -> Column:
    """SO2: struct sort key; night lines (letter M in front) after all others."""
    stripped = tx.strip(name)
    pattern = r"^(M)?0*(\d+)\s*-?\s*([A-Z])?\b"
    upper = F.upper(stripped)
    night, number, suffix = (F.regexp_extract(upper, pattern, i) for i in (1, 2, 3))
    rank = F.when(suffix == "", 0).when(suffix == "A", 1).when(suffix == "B", 2).otherwise(3)
    found = number != ""
    value = number.try_cast("bigint") + F.when(night == "M", F.lit(1_000_000)).otherwise(F.lit(0))
    return F.struct(
        F.when(found, value).otherwise(F.lit(999999)).alias("number"),
        F.when(found, rank).otherwise(F.lit(0)).alias("suffix_rank"),
        stripped.alias("name"),
    )


def service_rank(service: Column | str) -> Column:
    """SO3: fixed service-type order, unknown last."""
    order = F.array(*[F.lit(s) for s in rules.SERVICE_ORDER])
    position = F.array_position(order, F.col(service) if isinstance(service, str) else service)
    return F.when(position > 0, position - 1).otherwise(F.lit(99))
