"""Text primitives shared by every score, gate, classifier and extractor."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# The characters Unicode calls white space, as a regex class body and as plain text.
SPACE_CLASS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WORD_CLASS = r"\p{L}\p{N}_"


def rx(pattern: str, flags: str = "", ascii_words: bool = False) -> str:
    """A pattern in Unicode-aware notation as one Java understands the same way.

    ``\\w``, ``\\s``, ``\\d`` and ``\\b`` cover Unicode text, and ``.``, ``^`` and ``$`` know only
    the newline as a line end.
    """
    word = "a-zA-Z0-9_" if ascii_words else WORD_CLASS
    inside = {"w": word, "s": SPACE_CLASS, "d": r"\p{Nd}"}
    out, i, in_class = [], 0, False
    while i < len(pattern):
        char = pattern[i]
        if char == "\\":
            kind = pattern[i + 1]
            if kind in inside:
                out.append(inside[kind] if in_class else f"[{inside[kind]}]")
            elif kind == "b" and not in_class:
                out.append(f"(?:(?<=[{word}])(?![{word}])|(?<![{word}])(?=[{word}]))")
            else:
                out.append(char + kind)
            i += 2
            continue
        if char == "[" and not in_class:
            in_class = True
        elif char == "]" and in_class:
            in_class = False
        out.append(char)
        i += 1
    return f"(?d{flags})" + "".join(out)


def strip(text: Column) -> Column:
    """Both ends freed of any white space, in linear time."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def words(text: Column) -> Column:
    """Tokens between runs of white space."""
    return F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE_CLASS}]+", " ")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    return any_of([F.contains(text, F.lit(t)) for t in terms])


def count_present(text: Column, terms: Sequence[str]) -> Column:
    """How many of the distinct terms occur as substrings."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(t)).cast("int") for t in terms])


def matches_any(text: Column, patterns: Sequence[str], flags: str = "i") -> Column:
    return any_of([text.rlike(rx(p, flags)) for p in patterns])


def first_present(text: Column, labelled: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Label of the first group one of whose terms is a substring."""
    chain = None
    for label, terms in labelled:
        hit = contains_any(text, terms)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise(default)


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null where the pattern does not occur."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def repeat_subtract(start: Column, step: float, times: Column) -> Column:
    """``start`` less ``step`` taken off one at a time, as floating point accumulates it."""
    return F.aggregate(
        F.array_repeat(F.lit(step), times.cast("int")), start.cast("double"), lambda acc, x: acc - x
    )


def clamp01(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def bigrams(text: Column) -> Column:
    """Every pair of neighbouring characters of the lower-cased text, in order."""
    chars = F.split(F.lower(text), "")
    return F.when(F.length(text) < 2, F.array().cast("array<string>")).otherwise(
        F.zip_with(
            F.slice(chars, 1, F.size(chars) - 1),
            F.slice(chars, F.lit(2), F.size(chars) - 1),
            lambda a, b: F.concat(a, b),
        )
    )


def dedup_ignore_case(items: Column) -> Column:
    """First spelling of every item, compared without case, in order."""
    keys = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct items; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def present(conditions: Sequence[tuple[Column, Column | str]]) -> Column:
    """The values whose condition holds, in order."""
    return F.array_compact(
        F.array(*[F.when(c, v if isinstance(v, Column) else F.lit(v)) for c, v in conditions])
    )


def sha_key(*parts: Column, sep: str = "|") -> Column:
    return F.sha2(F.concat_ws(sep, *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def stable_uuid(*parts: Column) -> Column:
    """The first 16 bytes of the joined key's digest in UUID notation."""
    digest = sha_key(*parts)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in cuts])


def canonical_json(*names: str, of: str | None = None) -> Column:
    """One record as JSON with its keys sorted; equal records give equal text."""
    prefix = f"{of}." if of else ""
    fields = [F.col(prefix + n).alias(n) for n in sorted(names)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
