"""The index matcher: six tiers, their scores, and the final score by depth and visibility.

Every function takes columns, so a query may be a literal or a column of a
queries table.  Folded names must hold no byte below 0x20.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tiers' scores; a fuzzy match scores FUZZY plus up to FUZZY_SPAN by density.
EXACT, PREFIX, WORD, INITIALS, SUBSTRING, FUZZY, FUZZY_SPAN = 1.0, 0.9, 0.8, 0.7, 0.55, 0.3, 0.2
#: Fuzzy needs this many bytes, initials at most so many.
FUZZY_LEAST_BYTES, INITIALS_MOST_BYTES = 3, 8
#: Score falls by 1/(1 + 0.02 depth) to this depth, and to 0.85 for hidden and system entries.
DEPTH_STEP, DEEPEST, HIDDEN_SHARE = 0.02, 127, 0.85
#: Flags of an entry.
DIR, HIDDEN, SYSTEM, DEAD = 1, 2, 4, 8

_ONE = "\x01"


def quoted_chars(q: Column) -> Column:
    return F.transform(F.filter(F.split(q, "(?!^)"), lambda c: c != ""), lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E")))


def steps_to(chars: Column) -> Column:
    """Each step takes the nearest of its characters and is never taken back, so a match or a failure reads a text once."""
    return F.array_join(F.transform(chars, lambda c: F.concat(F.lit("(?>.*?"), c, F.lit(")"))), "")


def subsequence_pattern(q: Column | str) -> Column:
    """Finds a text's shortest beginning that has the characters of q in order; a constant where q is one."""
    if isinstance(q, str):
        return F.lit("(?s)^" + "".join(f"(?>.*?\\Q{c}\\E)" for c in q))
    return F.concat(F.lit("(?s)^"), steps_to(quoted_chars(q)))


def density(folded: Column, q: Column | str) -> Column:
    """Characters of q to the span they take, ended as early and begun as late as can be; null without a match."""
    head = F.call_function("regexp_extract", folded, subsequence_pattern(q), F.lit(0))
    back = q[::-1] if isinstance(q, str) else F.reverse(q)
    span = F.call_function("regexp_extract", F.reverse(head), subsequence_pattern(back), F.lit(0))
    return F.when(span != "", (F.lit(len(q)) if isinstance(q, str) else F.length(q)) / F.length(span))


def at_word(folded: Column, q: Column) -> Column:
    """Whether some occurrence, scanning left to right without overlap, follows a separator."""
    marked = F.replace(folded, q, F.lit(_ONE))
    own = F.right(q, F.lit(1)).isin("-", "_", ".", " ") & F.contains(marked, F.lit(_ONE + _ONE))
    return marked.rlike(r"[-_. ]\x01") | own


def tier_score(folded: Column, lane: Column, query: Column | str) -> Column:
    """The best tier's score, or null.  The tiers' scores fall strictly, so the first that holds is the best."""
    q = F.lit(query) if isinstance(query, str) else query
    fuzzy = F.when(F.octet_length(q) >= FUZZY_LEAST_BYTES, FUZZY + FUZZY_SPAN * density(folded, query))
    return (
        F.when((q == "") | q.rlike(r"[\x00-\x1f]"), F.lit(None).cast("double"))
        .when(folded == q, EXACT)
        .when(F.startswith(folded, q), PREFIX)
        .when(F.contains(folded, q) & at_word(folded, q), WORD)
        .when((F.octet_length(q) <= INITIALS_MOST_BYTES) & F.contains(lane, q), INITIALS)
        .when(F.contains(folded, q), SUBSTRING)
        .otherwise(fuzzy)
    )


def tier_name(base: Column) -> Column:
    return (
        F.when(base == EXACT, "exact").when(base == PREFIX, "prefix").when(base == WORD, "word").when(base == INITIALS, "initials").when(base == SUBSTRING, "substring").when(base.isNotNull(), "fuzzy")
    )


def rank_factor(depth: Column, flags: Column) -> Column:
    hidden = flags.bitwiseAND(HIDDEN | SYSTEM) != 0
    return F.when(hidden, HIDDEN_SHARE).otherwise(1.0) / (1 + DEPTH_STEP * F.least(depth, F.lit(DEEPEST)))


def may_match(mask: Column, query_mask: Column) -> Column:
    """A cheap necessary condition, to stand before the tiers."""
    return mask.bitwiseAND(query_mask) == query_mask


def occurrences(folded: Column, q: Column) -> Column:
    """Hits of q without overlap."""
    return (F.length(folded) - F.length(F.replace(folded, q, F.lit("")))) / F.length(q)
