"""Random names and histories against plain Python."""

import random

from pyspark.sql import functions as F

from rankfield.functions import match, shellmatch
from rankfield.sources.adapters import with_derived
from rankfield.streaming import changes

WORDS = ["aa", "ab", "ba", "bb", "ac", "ca", "AaBbCc", "Ab"]


def random_name(r):
    parts = [r.choice(WORDS) for _ in range(r.randint(1, 3))]
    name = r.choice("-_. ").join(parts)
    return name.upper() if r.random() < 0.5 else name


def segments(name, separators):
    out, before = [], ""
    for k, c in enumerate(name):
        if c not in separators and (not before or before in separators or (before.islower() and c.isupper())):
            out.append(k)
        before = c
    return out


def index_model(name, q):
    f = name.lower()
    lane = "".join(f[k] for k in segments(name, "-_. "))[:8]
    if f == q:
        return 1.0
    if f.startswith(q):
        return 0.9
    at = f.find(q)
    while at >= 0:
        if at and f[at - 1] in "-_. ":
            return 0.8
        at = f.find(q, at + len(q))
    if len(q) <= 8 and q in lane:
        return 0.7
    if q in f:
        return 0.55
    if len(q) < 3:
        return None
    place = -1
    for c in q:
        place = f.find(c, place + 1)
        if place < 0:
            return None
    end = begin = place + 1
    for c in reversed(q):
        begin = f.rfind(c, 0, begin)
    return 0.3 + 0.2 * len(q) / (end - begin)


def shell_model(name, q):
    f, starts = name.lower(), segments(name, " -_./\\()&+:,")
    if f == q:
        return 1.0
    if f.startswith(q):
        return 0.9
    if any(f[k : k + len(q)] == q for k in starts):
        return 0.8
    if len(q) >= 2 and "".join(f[k] for k in starts).startswith(q):
        return 0.7
    if q in f:
        return 0.55
    if len(q) < 3:
        return None
    first = place = f.find(q[0])
    for c in q[1:]:
        if place < 0:
            return None
        place = f.find(c, place + 1)
    return None if place < 0 or first < 0 else 0.3 + 0.2 * len(q) / (place + 1 - first)


def test_matchers(spark):
    r = random.Random(4)
    pairs = [(random_name(r), "".join(r.choice("abc-. ") for _ in range(r.randint(1, 5)))) for _ in range(1500)]
    rows = with_derived(spark.createDataFrame(pairs, "name string, q string"))
    got = rows.select("name", "q", match.tier_score(F.col("folded"), F.col("lane"), F.col("q")).alias("i"), shellmatch.score(F.col("name"), F.col("q")).alias("s")).collect()
    near = lambda a, b: (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)
    assert [(x["name"], x["q"]) for x in got if not near(x["i"], index_model(x["name"], x["q"]))] == []
    assert [(x["name"], x["q"]) for x in got if not near(x["s"], shell_model(x["name"], x["q"]))] == []


def test_change_log(spark):
    r, rows, want = random.Random(9), [], {}
    for usn in range(3000):
        frn, op = r.randint(1, 60), r.choice("CCDRRS")
        name, flags = r.choice(["", "a", "b", "c\x01"]) if r.random() < 0.3 else f"n{usn}", r.choice([0, 2])
        rows.append((usn, op, frn, usn % 5, name, flags))
        usable = name and "\x01" not in name
        if op == "C" and usable:
            want[frn] = (usn % 5, name, flags)
        elif op == "D":
            want.pop(frn, None)
        elif op == "R" and usable and frn in want:
            want[frn] = (usn % 5, name, want[frn][2])
    df = spark.createDataFrame(rows, "usn long, op string, frn long, parent_frn long, name string, flags int")
    got = {x["frn"]: (x["parent_frn"], x["name"], x["flags"]) for x in changes.fold(df).collect()}
    # a rename of a deleted entry is ignored until it is created again, and a create replaces what a rename left
    assert got.keys() == want.keys() and {k for k in want if got[k] != want[k]} == set()
