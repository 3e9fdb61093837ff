"""Personal data in whole texts, in DataFrame functions only.

A regular expression proposes spans, a validator confirms them (Luhn for card
numbers, modulo 97 for bank accounts, ranges for addresses and digit counts),
and context words within CONTEXT characters before or after a span adjust its score,
whatever other matches stand there.  Spans of the base
kinds (email, ip, card, phone) stay whenever the validator holds; the kinds
that the method adds (iban, ssn, local phone) stay from score THRESHOLD.

Places are found without a user function: ``split`` gives the text between the
matches of an expression and ``regexp_extract_all`` the matches, so a match's
place is a running sum of lengths, taken in a window over the matches of one
row.  Only matches are shuffled, never texts.

The expressions are written so that Java neither recurses nor tries again
within a run of characters that has failed: repeated groups are possessive,
which changes no match since what follows cannot begin with what they hold, and
a look-behind keeps a try from starting inside a run.

Null texts are empty and have no spans.  Rows with the same doc_id, or none,
are searched one by one.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfield.llm.core import docs_table

#: Characters before a span, and after it, that are searched for context words.
CONTEXT = 40
THRESHOLD = 0.5


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _card(value: Column) -> Column:
    d = _digits(value)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def _ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda x: x.cast("double") <= 255)


def _phone(value: Column) -> Column:
    return F.length(_digits(value)).between(9, 15)


def _iban(value: Column) -> Column:
    """Country and check digits go last, letters become 10 to 35, and the number leaves 1 modulo 97."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    chars = F.filter(F.split(moved, "(?!^)"), lambda c: c != "")
    rest = F.aggregate(
        chars,
        F.lit(0).cast("long"),
        lambda acc, c: F.when(c.between("0", "9"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97,
    )
    return F.length(plain).between(15, 34) & (rest == 1)


def _ssn(value: Column) -> Column:
    a, b, c = (F.substring(value, *x) for x in ((1, 3), (5, 2), (8, 4)))
    return ~a.isin("000", "666") & (a < "900") & (b != "00") & (c != "0000")


def _always(value: Column) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: What a text must match to be searched at all.
    hint: str
    valid: Callable[[Column], Column]
    #: Score of a valid span without context, and with a context word.
    alone: float
    near: float
    context: str
    #: Characters of the shortest match.
    least: int
    base: bool = True


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", _always, 0.9, 1.0, "mail|contact|write to", 5),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", _ip, 0.7, 0.9, r"\bip\b|address|host|server", 7),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9](?:[\\x20-]?[0-9]){12}", _card, 0.8, 1.0, "card|visa|master|credit|debit|karte|carte|tarjeta", 2),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", _phone, 0.7, 0.95, "phone|tel|call|mobile|fax", 4),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", _iban, 0.9, 1.0, "iban|account|konto|compte|cuenta", 12, False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-[0-9]{4}", _ssn, 0.4, 0.9, r"\bssn\b|social security", 11, False),
    Kind("local_phone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])", "[0-9]{3}[ .-][0-9]{4}", _always, 0.3, 0.7, "phone|tel|call|mobile|fax", 12, False),
)
BASE = tuple(k.name for k in KINDS if k.base)


def _found(kind: Kind, text: Column) -> Column:
    """The matches m, each with the text p since the last one; at the end the rest of the text, with no match."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("m"), F.split(text, kind.pattern, -1).alias("p"))


def _each(found: Column, function: Callable[[Column, Column, Column], Column]) -> Column:
    """function of found, element and index, for each; found is made once, not again for each element."""
    return F.transform(F.array(found), lambda all_: F.transform(all_, lambda x, i: function(all_, x, i)))[0]


def _context(kind: Kind, found: Column, x: Column, i: Column) -> Column:
    """CONTEXT characters before and after match i, a line each, put together from as many neighbours as can stand there."""
    many = -(-CONTEXT // kind.least)
    last = lambda c: F.right(c, F.lit(CONTEXT))
    first = lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(CONTEXT))
    before = F.transform(F.slice(found, F.greatest(i - many, F.lit(0)) + 1, F.least(i, F.lit(many))), lambda y: F.concat(last(y["p"]), last(y["m"])))
    after = F.transform(F.slice(found, i + 2, F.lit(many + 1)), lambda y: F.concat(first(y["p"]), first(y["m"])))
    return F.concat(last(F.concat(F.array_join(before, ""), last(x["p"]))), F.lit("\n"), first(F.array_join(after, "")))


def _matches(kind: Kind, number: int, text: Column) -> Column:
    """kind, the length of the text before the match since the last one, the match, and its context if it is valid."""
    rows = _each(
        _found(kind, text),
        lambda found, x, i: F.struct(F.lit(number).alias("kind"), F.length(x["p"]).alias("gap"), x["m"].alias("value"), F.when(kind.valid(x["m"]), _context(kind, found, x, i)).alias("near")),
    )
    rows = F.filter(rows, lambda x: x["value"].isNotNull())
    return F.when(text.rlike(kind.hint), rows).otherwise(F.array().cast("array<struct<kind:int,gap:int,value:string,near:string>>"))


def _score(near: Column, kind: Column) -> Column:
    """Zero without a context, which a match has whose validator holds."""
    out = F.lit(0.0)
    for number, k in enumerate(KINDS):
        own = F.when(F.lower(near).rlike(k.context), F.lit(k.near)).otherwise(F.lit(k.alone))
        out = F.when((kind == number) & near.isNotNull(), own).otherwise(out)
    return out


def pii_spans(docs: DataFrame) -> DataFrame:
    """row, doc_id, kind, start, end and score of each confirmed span; a row without spans has one line of nulls.

    row tells rows of docs apart.  Places are in characters, the end exclusive.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    found = rows.select("row", "doc_id", F.posexplode_outer(F.concat(*(_matches(k, n, F.col("text")) for n, k in enumerate(KINDS)))).alias("at", "m")).select("row", "doc_id", "at", "m.*")
    order = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("value")
    placed = found.withColumn("end", F.sum(F.col("gap") + size).over(order)).withColumn("start", F.col("end") - size)
    scored = placed.withColumn("score", _score(F.col("near"), F.col("kind")))
    base = F.col("kind") < len(BASE)
    kept = (base & (F.col("score") > 0)) | (~base & (F.col("score") >= THRESHOLD))
    name = F.element_at(F.array(*(F.lit(k.name) for k in KINDS)), F.col("kind") + 1)
    held = lambda c: F.when(kept, c)
    return scored.select("row", "doc_id", held(F.col("kind")).alias("order"), held(name).alias("kind"), held(F.col("start")).alias("start"), held(F.col("end")).alias("end"), held(F.col("score")).alias("score"))


def pii(docs: DataFrame) -> DataFrame:
    """One line a row of docs: counts by kind, the base kinds' digest, all spans, and their scores in the same order."""
    spans = pii_spans(docs)
    one = F.concat_ws(":", "kind", "start", "end")
    lists = spans.groupBy("row", "doc_id").agg(
        *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in (x.name for x in KINDS)),
        F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("order", "start", "end", one.alias("span"), F.col("score").cast("string").alias("score"))))).alias("s"),
    )
    joined = lambda s: F.array_join(F.transform(s, lambda x: x["span"]), ",")
    base = F.filter("s", lambda x: x["order"] < len(BASE))
    return lists.select("doc_id", *(f"n_{k.name}" for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"), F.array_join(F.transform("s", lambda x: x["score"]), ",").alias("scores"))


#: What redaction of a kind leaves; no context word of another kind.
_MARKS = r"\[(?:" + "|".join(k.name.upper() for k in KINDS) + r")\]"


def _redact_one(text: Column, k: Kind) -> Column:
    def put(found: Column, x: Column, i: Column) -> Column:
        near = F.regexp_replace(_context(k, found, x, i), _MARKS, " ")
        score = F.when(F.lower(near).rlike(k.context), F.lit(k.near)).otherwise(F.lit(k.alone))
        gone = k.valid(x["m"]) & (F.lit(True) if k.base else score >= THRESHOLD)
        return F.concat(x["p"], F.when(x["m"].isNull(), F.lit("")).when(gone, F.lit(f"[{k.name.upper()}]")).otherwise(x["m"]))

    return F.when(text.rlike(k.hint), F.array_join(_each(_found(k, text), put), "")).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """docs with each confirmed span in text replaced by its kind in brackets, kind by kind in their order; null texts stay null."""
    out = docs
    for k in KINDS:
        out = out.withColumn("text", _redact_one(F.col("text"), k))
    return out


def op1_pii(spark, sf_dir: str) -> DataFrame:
    return pii(docs_table(spark, sf_dir))
