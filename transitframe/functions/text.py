"""Street- and line-name canonicalisation as built-in column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85"

_FOLD_BLOCKS = ((0x00A0, 0x0250), (0x1E00, 0x1F00), (0x2000, 0x20A0), (0xFF01, 0xFF5F))
_MARK_BLOCK = (0x0300, 0x0370)


def _strip_marks(decomposed: str) -> str:
    return "".join(c for c in decomposed if not unicodedata.combining(c))


def fold_tables(form: str = "NFKD") -> tuple[str, str, str, dict[str, str]]:
    """Derive (source, target, marks, expansions) for one Unicode decomposition form.

    ``source[i]`` folds to the single character ``target[i]``; ``marks`` are dropped;
    ``expansions`` are the few characters that fold to several.
    """
    source, target, expansions = [], [], {}
    for start, stop in _FOLD_BLOCKS:
        for point in range(start, stop):
            char = chr(point)
            plain = _strip_marks(unicodedata.normalize(form, char))
            if plain == char:
                continue
            if len(plain) == 1:
                source.append(char)
                target.append(plain)
            elif plain:
                expansions[char] = plain
    for char in "ﬀﬁﬂﬃﬄﬅﬆ№™":
        plain = _strip_marks(unicodedata.normalize(form, char))
        if plain != char:
            expansions[char] = plain
    marks = "".join(chr(p) for p in range(*_MARK_BLOCK) if unicodedata.combining(chr(p)))
    return "".join(source), "".join(target), marks, expansions


FOLD_SOURCE, FOLD_TARGET, MARKS, EXPANSIONS = fold_tables("NFKD")
CANON_SOURCE, CANON_TARGET, _, _ = fold_tables("NFD")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Trim every whitespace character, not only blanks."""
    return F.btrim(_col(value), F.lit(WHITESPACE))


def collapse(value: Column | str) -> Column:
    return F.btrim(F.regexp_replace(_col(value), r"\s+", " "), F.lit(WHITESPACE))


def _beyond_ascii(text: Column) -> Column:
    """Cheap test that spares plain texts the character-by-character pass."""
    return F.octet_length(text) > F.length(text)


def _is_plain(value: Column | str) -> bool:
    """A bare column may be named several times; a computed value must appear once or it runs again."""
    return isinstance(value, str) or re.fullmatch(r"Column<'[\w.`]+'>", str(value)) is not None


def fold_accents(value: Column | str) -> Column:
    """Compatibility fold: base letters only, marks removed (one ``translate`` pass)."""
    text = _col(value)
    expanded = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), EXPANSIONS.items(), text)
    folded = F.translate(expanded, FOLD_SOURCE + MARKS, FOLD_TARGET)
    return F.when(_beyond_ascii(text), folded).otherwise(text) if _is_plain(value) else folded


def fold_accents_canonical(value: Column | str) -> Column:
    """Canonical fold: accents go, compatibility characters such as the ordinal sign stay."""
    text = _col(value)
    folded = F.translate(text, CANON_SOURCE + MARKS, CANON_TARGET)
    return F.when(_beyond_ascii(text), folded).otherwise(text) if _is_plain(value) else folded


def norm_index(value: Column | str) -> Column:
    """Index key. A name ending in punctuation keeps one trailing blank."""
    return F.regexp_replace(strip(F.upper(fold_accents(value))), "[^A-Z0-9]+", " ")


def norm_key(value: Column | str) -> Column:
    """Comparison key, N1 trimmed."""
    return F.btrim(norm_index(value))


def norm_words(value: Column | str) -> Column:
    """Word characters survive (underscore included), the rest become blanks."""
    return collapse(F.regexp_replace(strip(F.upper(fold_accents(value))), r"(?U)[^\w\s]", " "))


def norm_ascii(value: Column | str, compat: bool = False) -> Column:
    """Upper-case ASCII, punctuation kept; ``compat`` folds before dropping marks only."""
    if compat:
        return strip(F.upper(fold_accents(value)))
    return strip(F.upper(F.regexp_replace(fold_accents_canonical(value), r"[^\x00-\x7F]", "")))


def norm_keep_punct(value: Column | str) -> Column:
    """Canonical fold, upper, whitespace collapsed, punctuation kept."""
    return F.regexp_replace(fold_accents_canonical(strip(F.upper(_col(value)))), r"\s+", " ")


def norm_blank_punct(value: Column | str, squeeze: bool = True) -> Column:
    """N5 variants: every character outside ``A-Z0-9`` and blank becomes a blank."""
    blanked = F.regexp_replace(fold_accents_canonical(F.upper(strip(value))), "[^A-Z0-9 ]", " ")
    return collapse(blanked) if squeeze else strip(blanked)


def words(value: Column) -> Column:
    """Distinct blank-separated tokens of an already normalised name."""
    return F.array_distinct(F.filter(F.split(value, " "), lambda w: F.length(w) > 0))


def relevant_words(value: Column | str) -> Column:
    """distinct words of at least three characters of the comparison key."""
    return F.array_distinct(F.filter(F.split(norm_key(value), " "), lambda w: F.length(w) >= 3))


def content_tokens(normalised: Column, stopwords: tuple[str, ...]) -> Column:
    """F5 variant: words longer than two characters that are not stop words."""
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.array_distinct(
        F.filter(F.split(normalised, " "), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))
    )


def core_name(normalised: Column, prefixes: tuple[str, ...]) -> Column:
    """drop leading street-type words, repeatedly."""
    alternatives = "|".join(sorted(set(prefixes), key=lambda w: (-len(w), w)))
    return F.btrim(F.regexp_replace(normalised, f"^((?:{alternatives})(?: |$))+", ""))


def accent_score(value: Column | str) -> Column:
    """how many characters carry an accent or another compatibility form."""
    text = _col(value)
    bare = F.translate(text, FOLD_SOURCE + MARKS + "".join(EXPANSIONS), "")
    return F.when(_beyond_ascii(text), F.length(text) - F.length(bare)).otherwise(F.lit(0))


def strip_parentheses(value: Column | str) -> Column:
    """F8: remove parenthesised complements."""
    return F.regexp_replace(_col(value), r"\(.*?\)", "")


def distinctive_tokens(normalised: Column, spelled: tuple[str, ...], roman: tuple[str, ...]) -> Column:
    """sorted digits, spelled numbers, Roman numerals and single letters of a key."""
    known = F.array(*[F.lit(w) for w in spelled + roman])
    keep = F.filter(
        F.split(normalised, " "),
        lambda w: w.rlike("^[0-9]+$") | F.array_contains(known, w) | w.rlike("^[A-Z]$"),
    )
    return F.array_sort(F.array_distinct(keep))


def slug(value: Column | str) -> Column:
    """lower-case ASCII with hyphens for blanks."""
    ascii_only = F.regexp_replace(fold_accents(value), r"[^\x00-\x7F]", "")
    return F.replace(F.lower(ascii_only), F.lit(" "), F.lit("-"))


def safe_file_name(value: Column | str, limit: int = 80) -> Column:
    """accent-free name with reserved file characters replaced, cut to ``limit``."""
    return F.substring(strip(F.regexp_replace(fold_accents(value), r'[\\/*?:"<>|]', "-")), 1, limit)


def safe_sheet_name(value: Column | str, limit: int = 31) -> Column:
    """sheet name with reserved characters replaced, cut to ``limit``, never empty."""
    cut = F.substring(strip(F.regexp_replace(_col(value), r"[\\/*?:\[\]]", "-")), 1, limit)
    return F.when(F.length(cut) == 0, F.lit("linha")).otherwise(cut)


def title_case(value: Column | str) -> Column:
    """capital after every ASCII word boundary (also after an accented letter)."""
    marked = F.regexp_replace(F.lower(_col(value)), r"(?<![a-z0-9_])([a-z])", "\u0001$1")
    pieces = F.split(marked, "\u0001")
    return F.concat(
        F.element_at(pieces, 1),
        F.array_join(
            F.transform(
                F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
                lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30)),
            ),
            "",
        ),
    )


def split_registry_name(value: Column | str) -> Column:
    """struct(street_code, street, needs_review) of a dictionary entry."""
    raw = _col(value)
    review = F.startswith(F.upper(raw), F.lit("REVISAR:"))
    code = F.regexp_extract(raw, r"^(\d{5,8})", 1)
    name = strip(F.regexp_replace(raw, r"^\d{5,8}\s*", ""))
    name = F.when(F.endswith(name, F.lit(" 0000")), strip(F.substring(name, F.lit(1), F.length(name) - 5))).otherwise(name)
    return F.struct(
        F.when(~review & (code != ""), code).alias("street_code"),
        F.when(~review, name).alias("street"),
        review.alias("needs_review"),
    )


def split_option(value: Column | str) -> Column:
    """struct(line_code, line_name) of a 'code - name' option string."""
    text = strip(value)
    pattern = r"^([\dM]{3,5})\s*-\s*(.+)$"
    code = F.regexp_extract(text, pattern, 1)
    return F.struct(
        F.when(code != "", code).otherwise(F.lit("SEMCODIGO")).alias("line_code"),
        F.when(code != "", strip(F.regexp_extract(text, pattern, 2))).otherwise(text).alias("line_name"),
    )


def abbreviation_label(value: Column | str, patterns: list[tuple[str, str]]) -> Column:
    """label of the first abbreviation pattern found, null when none."""
    text = _col(value)
    return F.coalesce(*[F.when(text.rlike(f"(?iu){p}"), F.lit(label)) for p, label in patterns])


def pair_reason(a: Column, b: Column, core_a: Column, core_b: Column, score: Column, profile: str = "report") -> Column:
    """why two names look alike. The two report profiles test in a different order."""
    tok_a, tok_b = F.array_sort(words(core_a)), F.array_sort(words(core_b))
    within = (F.size(F.array_except(tok_a, tok_b)) == 0) | (F.size(F.array_except(tok_b, tok_a)) == 0)
    gap = F.abs(F.length(a) - F.length(b))
    percent = F.concat(F.format_number(F.rint(score * 100), 0), F.lit("%"))
    if profile == "report":
        return (
            F.when(gap <= 3, F.lit("diferença mínima de caracteres (possível typo)"))
            .when(within, F.lit("uma contém a outra (possível abreviação)"))
            .otherwise(F.concat(F.lit("similaridade alta ("), percent, F.lit(")")))
        )
    return (
        F.when(tok_a == tok_b, F.lit("mesmas palavras, ordem diferente"))
        .when(within, F.lit("uma contém a outra (possível abreviação)"))
        .when(gap <= 4, F.lit("diferença minima de caracteres (possivel typo)"))
        .otherwise(F.concat(F.lit("alta similaridade ("), percent, F.lit(")")))
    )


def pair_class(code_a: Column, code_b: Column) -> Column:
    """what the codes of two look-alike names suggest."""
    has_a = F.coalesce(F.length(code_a) > 0, F.lit(False))
    has_b = F.coalesce(F.length(code_b) > 0, F.lit(False))
    return (
        F.when(has_a & has_b & (code_a == code_b), F.lit("MESMO_CODIGO"))
        .when(has_a & has_b, F.lit("CODIGOS_DIFERENTES"))
        .when(has_a, F.lit("SUGERIR_A_PARA_B"))
        .when(has_b, F.lit("SUGERIR_B_PARA_A"))
        .otherwise(F.lit("SEM_CODIGO"))
    )
