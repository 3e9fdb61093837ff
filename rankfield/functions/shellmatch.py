"""The catalogs' matcher: twelve separators, camel humps as word starts, initials by prefix, fuzzy over the greedy span."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankfield.functions.match import EXACT, FUZZY, FUZZY_SPAN, INITIALS, PREFIX, SUBSTRING, WORD, quoted_chars, steps_to
from rankfield.functions.text import fold_text

#: Least characters for initials and fuzzy; a synonym's share of its score.
INITIALS_LEAST, FUZZY_LEAST, SYNONYM_SHARE = 2, 3, 0.9

_SEPARATOR = r"[-_. /\\()&+:,]"


def starts(name: Column) -> Column:
    """1-based places where a segment begins."""
    at = lambda i: F.substr(name, i, F.lit(1))
    begins = lambda i: (
        F.when(i == 1, ~at(i).rlike(_SEPARATOR)).otherwise(
            (at(i - 1).rlike(_SEPARATOR) & ~at(i).rlike(_SEPARATOR)) | (at(i - 1).rlike(r"\p{Ll}") & at(i).rlike(r"\p{Lu}"))
        )
    )
    return F.when(F.length(name) > 0, F.filter(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), begins)).otherwise(F.array().cast("array<int>"))


def span_pattern(q: Column | str) -> Column:
    """Takes from the first of q's first character to the nearest of each later one; a constant where q is one."""
    if isinstance(q, str):
        first, rest = f"\\Q{q[:1]}\\E", "".join(f"(?>.*?\\Q{c}\\E)" for c in q[1:])
        return F.lit(f"(?s)^(?>.*?(?={first}))({first}{rest})" if q else "()")
    chars = quoted_chars(q)
    first, rest = F.get(chars, F.lit(0)), F.slice(chars, F.lit(2), F.greatest(F.size(chars) - 1, F.lit(0)))
    return F.coalesce(F.concat(F.lit("(?s)^(?>.*?(?="), first, F.lit("))("), first, steps_to(rest), F.lit(")")), F.lit("()"))


def score(name: Column, query: Column | str) -> Column:
    """Score of a query, already folded and trimmed, against a name in original case; null without a match."""
    q = F.lit(query) if isinstance(query, str) else query
    folded, at, n = F.lower(name), starts(name), F.length(q)
    head = F.array_join(F.transform(at, lambda i: F.substr(folded, i, F.lit(1))), "")
    span = F.call_function("regexp_extract", folded, span_pattern(query), F.lit(1))
    return (
        F.when(q == "", F.lit(None).cast("double"))
        .when(folded == q, EXACT)
        .when(F.startswith(folded, q), PREFIX)
        .when(F.exists(at, lambda i: F.substr(folded, i, n) == q), WORD)
        .when((n >= INITIALS_LEAST) & F.startswith(head, q), INITIALS)
        .when(F.contains(folded, q), SUBSTRING)
        .when((n >= FUZZY_LEAST) & (span != ""), FUZZY + FUZZY_SPAN * n / F.length(span))
    )


def folded_query(q: str) -> str:
    """What was typed, trimmed and folded."""
    return fold_text(q.strip())


def score_with_synonyms(name: Column, synonyms: Column, q: Column | str) -> tuple[Column, Column]:
    """The better of the name's score and SYNONYM_SHARE of the best synonym's, and the name's own."""
    direct = score(name, q)
    other = F.array_max(F.transform(synonyms, lambda s: score(s, q))) * SYNONYM_SHARE
    return F.when(other > F.coalesce(direct, F.lit(-1.0)), other).otherwise(direct), direct
