"""Golden cases of the matchers, filters, calculator, change log and merge."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from rankfield.functions import match, shellmatch
from rankfield.functions.calc import calculate
from rankfield.functions.ranges import match_ranges
from rankfield.functions.text import class_mask, cut_to_bytes, fold_any, fold_text, initials, mask_of, utf16_length
from rankfield.operators import filters, latency, merge, rank, tree
from rankfield.sources import journal
from rankfield.sources.adapters import with_derived
from rankfield.streaming import changes, sessions


def index_score(spark, name, query):
    """Through the search that is shipped: a name at depth 0 without flags keeps its tier's score."""
    row = with_derived(spark.createDataFrame([(1, name, 0, 0)], "frn long, name string, depth int, flags int"))
    found = rank.search(row, query, 1).collect()
    as_column = rank.scored(row, F.lit(fold_text(query))).collect()
    assert [x["score"] for x in found] == [x["score"] for x in as_column]
    return found[0]["score"] if found else None


@pytest.mark.parametrize(
    ("name", "query", "score"),
    [
        ("foo", "foo", 1.0), ("foobar", "foo", 0.9), ("my-foo.txt", "foo", 0.8), ("fat old otters", "foo", 0.7), ("xfoox", "foo", 0.55), ("README.md", "readme.md", 1.0), ("Cafe\u0301.txt", "CAF\u00c9", 0.9),
        ("\u6c49\u8bed\u624b\u518c.pdf", "\u8bed\u624b", 0.55), ("foo-barbaz.txt", "ba", 0.8), ("FooBar.txt", "fb", 0.7), ("abcx_bcd", "abcd", 0.4), ("abxcxd", "abcd", 0.3 + 0.2 * 4 / 6), ("abc", "zz", None), ("Report.txt", "REPORT", 0.9), ("\u00c4rger-Notiz", "\u00e4n", 0.7), ("\u0391\u03a3 x", "\u03b1\u03c3", 0.9), ("abc", "", None), ("a\u0130b", "zi", None),
    ],
)
def test_index_tiers(spark, name, query, score):
    assert index_score(spark, name, query) == (pytest.approx(score) if score is not None else None)


@pytest.mark.parametrize(
    ("name", "query", "tier", "ranges"),
    [
        ("README.md", "readme.md", "exact", [(0, 9)]), ("Cafe\u0301.txt", "CAF\u00c9", "prefix", [(0, 4)]), ("\u6c49\u8bed\u624b\u518c.pdf", "\u8bed\u624b", "substring", [(1, 3)]), ("\U0001d11eabc.txt", "\U0001d11e", "prefix", [(0, 2)]),
        ("foo-barbaz.txt", "ba", "word", [(4, 10)]), ("FooBar.txt", "fb", "initials", [(0, 1), (3, 4)]), ("abcx_bcd", "abcd", "fuzzy", [(0, 3), (7, 8)]), ("abxcxd", "abcd", "fuzzy", [(0, 2), (3, 4), (5, 6)]),
    ],
)
def test_ranges(name, query, tier, ranges):
    assert match_ranges(name, query, tier) == ranges


@pytest.mark.parametrize(("name", "query", "score"), [("Visual Studio Code", "code", 0.8), ("Visual Studio Code", "vsc", 0.7), ("PowerToys", "toys", 0.8), ("PowerToys", "pt", 0.7), ("Notepad", "tep", 0.55), ("Notepad", "xyz", None)])
def test_shell_tiers(spark, name, query, score):
    got = spark.createDataFrame([(name,)], "name string").select(shellmatch.score(F.col("name"), F.lit(query))).first()[0]
    assert got == (pytest.approx(score) if score else None)


def test_synonym_exact_is_nine_tenths(spark):
    best, direct = shellmatch.score_with_synonyms(F.col("n"), F.col("s"), F.lit("audio"))
    assert spark.createDataFrame([("Sound", ["audio"])], "n string, s array<string>").select(best, direct).first() == (0.9, None)


def test_text(spark):
    row = spark.createDataFrame([("\u039f\u0394\u039f\u03a3", "\U0001d11ea", "Foo-Bar_baz"), (None, None, None)], "a string, b string, c string")
    got = row.select(fold_any("a"), utf16_length("b"), initials(F.col("c")), cut_to_bytes(F.col("a"), 5)).collect()
    assert got[0] == ("\u03bf\u03b4\u03bf\u03c3", 3, "fbb", "\u039f\u0394")
    assert got[1][0] is None and got[1][1] is None


def test_depth_falls(spark):
    rows = spark.createDataFrame([(0, 0), (2, 0), (300, 0), (0, 2)], "depth int, flags int").select(0.9 * match.rank_factor(F.col("depth"), F.col("flags"))).collect()
    assert [r[0] for r in rows] == pytest.approx([0.9, 0.9 / 1.04, 0.9 / 3.54, 0.9 * 0.85])


def test_tree_cycles_and_self(spark):
    e = spark.createDataFrame([(1, 1, "self", 0), (2, 1, "a", 0), (3, 99, "lost", 0), (4, 5, "x", 0), (5, 4, "y", 0), (6, 5, "z", 0)], "frn long, parent_frn long, name string, flags int")
    got = {r["frn"]: (r["depth"], r["path"]) for r in tree.resolve(e, "C:").collect()}
    assert got[1] == (0, "C:\\self") and got[2] == (1, "C:\\self\\a") and got[3] == (0, "C:\\lost")
    assert got[4][0] == got[5][0] == got[6][0] == 127


@pytest.mark.parametrize(
    ("text", "name", "exts", "path"),
    [
        ("report kind:document path:projects ext:.PDF,md", "report", {"pdf", "md"}, "projects"), ("notes 12:30", "notes 12:30", set(), ""), ("x kind:image ext:png,rs", "x", {"png"}, ""), ("x kind:im", "x", set(), ""),
        ("report path:", "report", set(), ""), ("c:\\users report", "c:\\users report", set(), ""), ("x kind:image ext:p", "x", set(filters.KIND_EXTS["image"]), ""), ("x kind:image kind:im", "x", set(filters.KIND_EXTS["image"]), ""),
    ],
)
def test_grammar(text, name, exts, path):
    q = filters.parse_file_query(text)
    assert (q.name, set(q.exts), q.path, q.refused) == (name, exts, path, "")


@pytest.mark.parametrize("text", ["x kind:image ext:rs", "x kind:folder", "x kind:banana", "kind:image", "path:src", "kind:", "kind:im", "ext:", "path:", "x kind:image ext:zzz", "x kind:banana kind:image"])
def test_grammar_refuses(text):
    assert filters.parse_file_query(text).refused


def test_exts():
    assert [e for e in map(filters.normalized_ext, ["rs", ".RS", "", ".", " .Txt "]) if e] == [".rs", ".rs", ".txt"]


TODAY = dt.date(2026, 3, 10)


@pytest.mark.parametrize(
    ("text", "copy"),
    [
        ("2^3^2", "512"), ("200 + 10%", "220"), ("12 mi in km", "19.312128"), ("72 f in c", "22.2222222222"), ("1/0", None), ("2+2", "4"), ("-2^2", "-4"), ("10 mod 4", "2"), ("6 xor 3", "5"), ("1 << 4", "16"), ("(1+2)*3", "9"),
        ("50%", "0.5"), ("hello 2", None), ("5", None), ("0xff", None), ("days until 2026-03-20", "10"), ("days since mar 1", "9"), ("1.5e3 + 1", "1,501"), ("5 & 2.5", None), ("1,000 * 2", None), ("7 % 4", "3"),
        ("2**10", "1,024"), ("1234567 * 1", "1,234,567"), ("200 + (5 + 5)%", "220"), ("0xff + 1", "256"), ("6 nor 3", None), ("0 x 1", None), ("~0 + 1", "0"), ("1 kg in lb", "2.2046226218"), ("1.5 gb in mib", "1,430.5114746094"), ("90 min in h", "1.5"),
        ("100 kph in mph", "62.1371192237"), ("2*3 kg to g", "6,000"), ("12 mi in kg", None), ("-40 c in f", "-40"), ("0 c in kelvin", "273.15"), ("1 in in cm", "2.54"), ("10 st in kg", "63.5029318"), ("3 nmi in m", "5,556"), ("1 l in ml", None), ("72\u00b0f in c", None),
        ("days until 2099-01-01", "26595"), ("days until 2026-02-30", None), ("days until mar 1st", "356"), ("days until nope 25", None), ("1/(1/0)", "0"), ("1e400 + 1", None), ("(" * 300, None), ("2 * 1e15", "2e15"), ("1 << 63", "-9.223372036854776e18"),
    ],
)
def test_calculator(text, copy):
    found = calculate(text, TODAY)
    assert (found and found[1]) == copy


def test_calculator_display():
    assert calculate("0xff + 1", TODAY)[0] == "256  (0x100, 0b100000000)" and calculate("255 + 1", TODAY)[0] == "256"
    assert calculate("days until 2026-03-01", TODAY) == ("-9 days (was 2026-03-01)", "-9") and calculate("12 mi in km", TODAY)[0] == "19.312128 km"


def test_long_names_end_in_time(spark):
    """A failing fuzzy match reads a name once, whatever it repeats."""
    rows = with_derived(spark.createDataFrame([(k, "b" + "a" * n, 0, 0) for k, n in enumerate((26, 40, 400, 4000))], "frn long, name string, depth int, flags int"))
    began = time.time()
    for q in ("a" * 20 + "b", "a" * 200 + "b"):
        assert rank.search(rows, q).count() == rank.scored(rows, F.lit(q)).count() == 0
        assert rows.select(shellmatch.score(F.col("name"), q).alias("s"), shellmatch.score(F.col("name"), F.lit(q)).alias("t")).where("s is not null or t is not null").count() == 0
    assert time.time() - began < 20


def test_masks_agree(spark):
    names = ["abc", "Z-_. 9", "caf\u00e9", "\u6c49", "#+"]
    got = spark.createDataFrame([(n.lower(),) for n in names], "n string").select(class_mask(F.col("n"))).collect()
    assert [r[0] for r in got] == [mask_of(n.lower()) for n in names]


def test_usage_properties(spark):
    rows = spark.createDataFrame([(1, 0), (5, 0), (5, -604800), (10**6, 0)], "n int, t int").select(rank.usage_bonus(F.col("n"), F.col("t"), 0)).collect()
    one, five, older, many = (r[0] for r in rows)
    assert one < five < many < 0.09 and older == pytest.approx(0.09 * 2.5 / 4.5)


def test_percentiles(spark):
    row = spark.range(1, 101).select(F.lit("a").alias("class"), F.col("id").cast("double").alias("value"))
    got = latency.summary(row).first()
    assert (got["p50"], got["p95"], got["p99"]) == (50, 95, 99)


def test_journal_records(spark, tmp_path):
    good = journal.record(1, 100, 5, 0x100 | 0x200 | 0x80000000, 0x10, "a.txt") + journal.record(2, 101, 5, 0x80000000, 0, "b") + journal.record(3, 3, 5, 0x100, 0, "meta") + journal.record(4, 102, 5, 0x2000, 6, "\u00e9.txt")
    (tmp_path / "j").write_bytes(good + b"\xff" * 64)
    got = sorted(tuple(r) for r in journal.read_journal(spark, str(tmp_path / "j")).collect())
    assert got == [(1, "D", 100, 5, "a.txt", 1), (4, "R", 102, 5, "\u00e9.txt", 6)]


def test_walk(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "f.txt").write_text("")
    got = {r["name"]: r for r in journal.walk(spark, str(tmp_path)).collect()}
    assert got["d"]["parent_frn"] == 0 and got["f.txt"]["parent_frn"] == got["d"]["frn"] and got["e"]["flags"] == 1
    with pytest.raises(FileNotFoundError):
        journal.walk(spark, str(tmp_path / "none"))


def test_merge_exempt_rows_count(spark):
    rows = spark.createDataFrame([("app", str(k), f"n{k}", 1.0 - k / 10, None) for k in range(6)], "kind string, key string, name string, score double, ord int")
    frozen = spark.createDataFrame([("5", 0), ("4", 1)], "key string, frozen_pos int")
    assert [r["key"] for r in merge.merge(rows, frozen).orderBy("pos").collect()] == ["5", "4", "0"]


def test_cancel_raises_watermark(spark):
    r = spark.createDataFrame([(1, 1, "query", 1), (1, 2, "query", 2), (1, 2, "cancel", 3), (2, 1, "query", 4)], "session int, gen int, kind string, arrival int")
    assert [(x["session"], x["gen"]) for x in sessions.newest(r).collect()] == [(2, 1)]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "frn long, parent_frn long, name string, flags int")
    assert tree.resolve(e).count() == 0
    assert changes.fold(spark.createDataFrame([], "usn long, op string, frn long, parent_frn long, name string, flags int")).count() == 0
