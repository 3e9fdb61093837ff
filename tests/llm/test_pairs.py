"""SimHash components and repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from rankfield.llm import op10_simhash as op10
from rankfield.llm.components import components, forest
from rankfield.llm.op4_repeated_phrases import repeated_phrases
from rankfield.llm.op10_simhash import fingerprints, links, simhash_components

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_roots(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(x) for x in range(len(fps))]


def test_fingerprints():
    r = random.Random(3)
    texts = [None, "", " \n", "One", "one TWO", "a b c", *(" ".join(r.choices(["ab", "CD", "Éf", "g"], k=r.randint(1, 40))) for _ in range(60))]
    assert fingerprints(pa.array(texts)).tolist() == [plain_fingerprint(t) for t in texts]


def near(r, n):
    """Fingerprints in chains and clusters, so that links matter."""
    out = [r.getrandbits(64) for _ in range(n // 8)]
    while len(out) < n:
        x = r.choice(out)
        for _ in range(r.randint(1, 4)):
            x ^= 1 << r.randrange(64)
        out.append(x)
    return list(dict.fromkeys(out))


def linked(spark, fps):
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    found = {r["node"]: r["root"] for r in components(links(df)).collect()}
    name = [int(np.uint64(x).view(np.int64)) for x in fps]
    return [found.get(x, x) for x in name], name


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_links_and_components(spark):
    fps = near(random.Random(5), 600)
    got, _ = linked(spark, fps)
    assert same_partition(got, plain_roots(fps))


def test_busy_anchors(spark, monkeypatch):
    monkeypatch.setattr(op10, "BLOCK", 16)
    r, base = random.Random(6), random.Random(7).getrandbits(64)
    fps = list(dict.fromkeys([base, *(base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(300)), *near(r, 100)]))
    got, _ = linked(spark, fps)
    assert same_partition(got, plain_roots(fps))


def test_forest():
    a, b = forest(np.array([5, 4, 9, 3]), np.array([4, 3, 8, 5]))
    assert dict(zip(a.tolist(), b.tolist())) == {4: 3, 5: 3, 9: 8}


def test_long_chain(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    assert {r["root"] for r in components(df).collect()} == {0}


def test_simhash_odd_rows(spark, odd_docs, docs_of):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = simhash_components(odd_docs).collect()
    assert sorted((r["doc_id"] or -1, r["fingerprint"]) for r in got) == sorted((i or -1, f"{plain_fingerprint(t):016x}") for i, t in rows)
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert simhash_components(docs_of([])).count() == 0


def plain_removal(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if (key := tuple(w[k : k + 20])) in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        out.append((i or -1, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out)


def removal(docs):
    return sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeated_phrases(docs).collect())


def test_repeated_phrases(docs_of):
    r = random.Random(8)
    passages = [[f"w{r.randrange(40)}" for _ in range(r.choice([19, 20, 21, 35, 60]))] for _ in range(12)]
    rows = [(k, " ".join(sum((r.choice(passages) if r.random() < 0.4 else [f"v{r.randrange(50)}" for _ in range(r.randint(1, 15))] for _ in range(r.randint(1, 6))), []))) for k in range(120)]
    assert removal(docs_of(rows)) == plain_removal(rows)


def test_repeated_phrases_odd_rows(docs_of, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert removal(odd_docs) == plain_removal(rows)
    assert removal(docs_of([])) == []


def test_only_what_the_automata_find_is_removed(docs_of, monkeypatch):
    import rankfield.llm.op4_repeated_phrases as op4

    shared = [" ".join(f"{x}{k}" for k in range(40)) for x in "pq"]
    rows = [(k, f"{k} a b {shared[k % 2]} end {k}") for k in range(6)]
    docs, whole = spark_free(rows), op4.locate
    phrases = sent_to_shard(docs)
    removed = lambda t: sum(len(x or b"") // 4 for x in t.column("removed").to_pylist())
    assert removed(op4._settle(docs, phrases)) == 2 * 2 * 24  # the second and third of each passage of 43 words
    # a shard that is sent only the phrases of one passage finds only that one
    one = phrases.filter(pc.match_substring(phrases.column("phrase").cast(pa.string()), "p"))
    assert removed(op4._settle(docs, one)) == 2 * 24
    monkeypatch.setattr(op4, "locate", lambda w, sent: np.zeros(len(w.start), bool))
    assert removed(op4._settle(docs, phrases)) == 0
    monkeypatch.setattr(op4, "locate", whole)


def spark_free(rows):
    return pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows]), "shard": pa.array([0] * len(rows), pa.int32())})


def sent_to_shard(docs):
    import rankfield.llm.op4_repeated_phrases as op4

    found = pa.Table.from_batches(list(op4._phrases(iter(docs.to_batches())))).sort_by("phrase")
    return pa.Table.from_batches(list(op4._recurring(iter(found.to_batches(max_chunksize=3)))))


def test_automata_find_every_occurrence():
    import rankfield.llm.op4_repeated_phrases as op4
    from rankfield.llm.core import Words

    r = random.Random(11)
    texts = [[r.choice("abc") for _ in range(r.randint(0, 60))] for _ in range(30)]
    raw = [r.choice([" ", "\n ", "\t"]).join(t).encode() for t in texts]
    w = Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    phrases = [[r.choice("abc") for _ in range(op4.PHRASE)] for _ in range(40)]
    want = [t[k : k + op4.PHRASE] in phrases for t in texts for k in range(len(t))]
    assert any(want) and op4.locate(w, [f" {' '.join(p)} ".encode() for p in phrases]).tolist() == want


def test_recurring_phrases_over_batches():
    import rankfield.llm.op4_repeated_phrases as op4

    r = random.Random(12)
    for _ in range(50):
        rows = sorted((bytes([r.randrange(97, 105)]), r.randrange(9), r.choice([1, 1, 1, 2])) for _ in range(r.randint(0, 14)))
        t = pa.table({"phrase": pa.array([x[0] for x in rows], pa.binary()), "tag": pa.array([x[1] << 1 | (x[2] > 1) for x in rows], pa.int64())})
        got = [(p, s) for b in op4._recurring(iter(t.to_batches(max_chunksize=r.randint(1, 4)))) for s, p in zip(b.column("shard").to_pylist(), b.column("phrase").to_pylist())]
        assert sorted(got) == sorted((p, s) for p, s, _ in rows if sum(n for q, _, n in rows if q == p) > 1)


def test_later_windows_over_batches():
    import rankfield.llm.op4_repeated_phrases as op4

    r = random.Random(13)
    for _ in range(50):
        rows = sorted((r.randrange(4), k, r.randrange(9) << 32 | r.randrange(2)) for k in range(r.randint(0, 20)))
        t = pa.table({"hash": pa.array([x[0] for x in rows], pa.int64()), "row": pa.array([x[1] for x in rows], pa.int64()), "place": pa.array([x[2] for x in rows], pa.int64())})
        got = [x for b in op4._later(iter(t.to_batches(max_chunksize=r.randint(1, 5)))) for x in zip(b.column("row").to_pylist(), b.column("at").to_pylist())]
        met, want = set(), []
        for h, row, place in rows:
            if (key := (h, place & 0xFFFFFFFF)) in met:
                want.append((row, place >> 32))
            met.add(key)
        assert sorted(got) == sorted(want)


def test_repeated_phrases_sql(spark, tmp_path):
    import duckdb

    from rankfield.llm.op4_repeated_phrases import SQL

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeated_phrases(docs).collect())
    assert got == sorted(con.sql(f"SELECT doc_id, n_words, n_removed, kept_sha256 FROM ({SQL})").fetchall())
    assert sum(r[2] for r in got)


def test_repeated_phrases_across_shards(docs_of, monkeypatch):
    import rankfield.llm.op4_repeated_phrases as op4

    monkeypatch.setattr(op4, "SHARD_BYTES", 400)
    monkeypatch.setattr(op4, "AUTOMATON", 5)
    shared = " ".join(f"p{k}" for k in range(50))
    rows = [(k, f"{k} a b {shared} end {k}") for k in range(40)]
    assert removal(docs_of(rows)) == plain_removal(rows)
