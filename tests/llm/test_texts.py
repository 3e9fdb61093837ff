"""Personal data, quality rules, language, toxicity, language models and decontamination on small fixtures."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankfield.llm import attention as A
from rankfield.llm import op3_quality_rules as op3
from rankfield.llm import op5_decontamination as op5
from rankfield.llm import op6_toxicity as op6
from rankfield.llm import op7_lm_scoring as op7
from rankfield.llm.op1_pii import pii, pii_spans, redact
from rankfield.llm.op2_language_id import language_id, table_bits, visible
from rankfield.llm.op5_decontamination import common_subsequence, contamination, uncontaminated
from rankfield.llm.op6_toxicity import toxicity
from rankfield.llm.op7_lm_scoring import lm_scores

WORD = re.compile("[^\x20\x09-\x0d]+")

# --- op1

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(s[::-1])) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def digest(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def test_pii_base_spans_on_random_texts(docs_of):
    r = random.Random(1)
    parts = ["a@b.c", "_d@e.f", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 123-4567", "+", " ", "-", "é", "\U0001f600", "7", "00", "x", "\n", "+49", "..", "a@b", "1.1.1.1.1.1.1.1.1"]
    rows = [(k, "".join(r.choices(parts, k=r.randint(0, 25)))) for k in range(400)]
    got = {x["doc_id"]: x["base_sha256"] for x in pii(docs_of(rows)).collect()}
    assert [rows[k] for k in got if got[k] != digest(base_spans(rows[k][1]))] == []


def test_pii_added_kinds_and_redaction(docs_of):
    rows = [(1, "IBAN: GB82 WEST 1234 5698 7654 32 ok"), (2, "iban GB82WEST12345698765433"), (3, "my SSN 123-45-6789"), (4, "part 123-45-6789"), (5, "call 555-123-4567 now"), (6, "mail a@b.org, ip 10.0.0.1"), (7, None)]
    docs = docs_of(rows)
    got = {x["doc_id"]: x for x in pii(docs).collect()}
    assert [got[k]["spans"].split(":")[0] for k in (1, 3, 5)] == ["iban", "ssn", "local_phone"]
    assert got[2]["spans"] == got[4]["spans"] == got[7]["spans"] == ""
    assert got[1]["spans"] == "iban:6:33" and got[1]["base_sha256"] == digest([])
    clean = {x["doc_id"]: x["text"] for x in redact(docs).collect()}
    assert clean[6] == "mail [EMAIL], ip [IP]" and clean[1] == "IBAN: [IBAN] ok" and clean[4] == rows[3][1] and clean[7] is None


def test_pii_odd_rows(docs_of, odd_docs):
    rows = [(x["doc_id"], x["text"]) for x in odd_docs.collect()]
    assert sorted((x["doc_id"] or -1, x["base_sha256"]) for x in pii(odd_docs).collect()) == sorted((i or -1, digest(base_spans(t))) for i, t in rows)
    assert pii(docs_of([])).count() == 0 and redact(odd_docs).columns == odd_docs.columns
    long = "1 " * 40_000 + "a." * 30_000 + "x" * 50_000 + "@b.c"
    got = pii(docs_of([(1, long)])).first()
    assert got["base_sha256"] == digest(base_spans(long))


def test_pii_runs_no_python(docs_of):
    plan = pii_spans(docs_of([(1, "a@b.c")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- op3


def plain_counts(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen, cover = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)), set()
    for k in range(len(w) - 4):
        if seen[tuple(w[k : k + 5])] > 1:
            cover.update(range(k, k + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


def test_quality_counts(docs_of, odd_docs):
    r = random.Random(4)
    rows = [(k, "".join(r.choices(["a ", "b ", "a b c d e ", "é#", "\n", "|", "line one\n", "\r\n", "\x0b"], k=r.randint(0, 40)))) for k in range(150)]
    for docs in (docs_of(rows), odd_docs):
        want = sorted((x["doc_id"] or -1, *plain_counts(x["text"])) for x in docs.select("doc_id", "text").collect())
        got = sorted((x["doc_id"] or -1, *(x[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for x in op3.statistics(docs).collect())
        assert got == want


def labelled(spark, docs_of, n=300):
    r = random.Random(2)
    rows, labels = [], []
    for k in range(n):
        words = [f"w{r.randrange(500)}" for _ in range(r.randint(30, 90))]
        bad = k % 5 == 0
        rows.append((k, " ".join(w.upper() + "!!" if bad else w for w in words)))
        labels.append((k, 0 if bad else 1, 0))
    return docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rules_are_learned_and_applied(spark, docs_of):
    docs, labels = labelled(spark, docs_of)
    rules = op3.fit_rules(op3.statistics(docs), labels)
    assert rules and all(len(x) <= op3.MOST_CONDITIONS for x in rules)
    got = {x["doc_id"]: x["kept"] for x in op3.quality_rules(docs, labels).collect()}
    assert all(got[k] == (k % 5 != 0) for k in got)
    kept = op3.accepted(docs, labels)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == [k for k in range(300) if k % 5]


def test_rules_without_labels(spark, docs_of, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = op3.quality_rules(odd_docs, none).collect()
    assert len(got) == odd_docs.count() and all(x["kept"] == (not x["base_failed"]) for x in got)
    assert op3.quality_rules(docs_of([]), none).count() == 0


# --- op2


def test_language_id(spark):
    text = {"en": "the and of that with from ing tion the this ", "de": "der die und ein mit nicht auf von keit heit ", "fr": "le la les des une dans avec pour est que "}
    docs = spark.createDataFrame([(k, t * 20, x) for k, (x, t) in enumerate(text.items())], "doc_id long, text string, lang string")
    page = lambda x, t: f"<html lang='{x}'><script>the and of</script><p>{t}</p></html>"
    rows = [(k, f"http://{x}{k % 2}.example.org/a", page(x, t)) for k, (x, t) in enumerate(list(text.items()) * 8)]
    rows += [(900, "http://de0.example.org/", "<html></html>"), (901, None, None), (902, "no url", page("de", text["fr"] * 3)), (903, "http://x.org/fr/1", page("zz", text["fr"])), (901, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit("x"))
    got = {x["page_id"]: x for x in language_id(pages, docs).collect()}
    assert all(got[k]["lang"] == list(text)[k % 3] for k in range(24))
    assert got[900]["lang"] == "de" and got[902]["text_lang"] == "fr" and got[903]["lang"] == "fr" and got[901]["lang"] in text
    assert language_id(pages, docs).count() == len(rows)
    assert language_id(pages.limit(0), docs).count() == 0
    assert language_id(pages, docs.limit(0)).where("lang is not null").count() == 0


def test_visible_text():
    for html, want in (
        (b"a<p>b</p>c", b"a b c"), (b"x<script>y</script >z", b"x z"), (b"x<SCRIPT a='>'>y<</Script>z", b"x z"), (b"<style>p{}</style><!-- n > -->t", b"  t"),
        (b"<scripty>t</scripty>", b" t "), (b"a < b", b"a  < b"), (b"<!-- open <p>t", b" t"), (b"<script>open <b>t", b" open  t"), (b"&amp;t&#228;", b" t "), (b"", b""),
    ):
        assert b" ".join(visible(html).split()) == b" ".join(want.split()), html


def test_language_id_of_long_and_broken_html(spark):
    docs = spark.createDataFrame([(1, "the and of that with from ing tion " * 20, "en"), (2, "der die und ein mit nicht auf von " * 20, "de")], "doc_id long, text string, lang string")
    odd = ["<script " * 60_000, "<" * 400_000, "<!--" * 100_000, "<html " * 60_000, "<meta " * 60_000, "&" * 300_000, "<html " + "x" * 50_000 + " lang='de'>", "<p>" * 100_000 + "der die und ein mit nicht " * 20]
    rows = [(k, "http://a.org/", x) for k, x in enumerate(odd)]
    began = time.time()
    got = {x["page_id"]: x for x in language_id(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert len(got) == len(odd) and time.time() - began < 60
    assert got[6]["declared"] == "de" and got[7]["text_lang"] == "de"


def test_languages_of_unseen_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pages = docs.where("doc_id % 2 = 1").select(F.col("doc_id").alias("page_id"), F.lit("").alias("url"), F.col("text").alias("html"))
    got = language_id(pages, docs.where("doc_id % 2 = 0")).join(docs.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("truth")), "page_id")
    right, all_ = got.agg(F.sum((F.col("text_lang") == F.col("truth")).cast("int")), F.count("*")).first()
    assert right >= 0.97 * all_


def test_many_languages_keep_their_table_small():
    assert table_bits(4) == 16 and table_bits(1 << 10) == 14 and table_bits(10**6) >= 8


# --- op6


def test_toxicity_on_held_out_rows(spark, docs_of):
    r = random.Random(3)
    bad = ["grubby", "vilest", "wretch"]
    rows, labels = [], []
    for k in range(1200):
        words = [f"w{min(int(r.expovariate(0.02)), 400)}" for _ in range(r.randint(20, 120))]
        toxic = r.random() < 0.2
        for _ in range(3 if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    docs, known = docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in toxicity(docs, known).collect()}
    out = [k for k in got if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k]["held_out"] == (k in set(out)) for k in got)
    assert np.mean([got[k]["predicted"] == labels[k][2] for k in out]) > 0.95
    # labels of held-out rows change nothing
    flipped = known.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {x["doc_id"]: x["score"] for x in toxicity(docs, flipped).collect()}
    assert all(abs(again[k] - got[k]["score"]) < 1e-9 for k in got)


def plain_kneser_ney(rows, least):
    """Log-likelihood ratio of each word of each text, by dictionaries; rows: words, label."""
    first, later, kinds = [Counter(), Counter()], [Counter(), Counter()], {}
    for words, label in rows:
        before = None
        for w in words:
            parts = [w[:k] for k in op6.STEPS if len(w) > k] + [w]
            first[label][parts[0]] += 1
            kinds.setdefault(parts[0], set()).add(before)
            later[label].update(zip(parts, parts[1:]))
            before = parts[0]
    cut = lambda n: max(n - op6.DISCOUNT, 0)

    def told(n, base):
        total = sum(n.values())
        left = total - sum(map(cut, n.values()))
        return {x: (cut(n[x]) + left * base[x]) / total if total else base[x] for x in n}

    known = [x for x in first[0] + first[1] if first[0][x] + first[1][x] >= least]
    n = [{x: f[x] for x in known} | {None: sum(v for x, v in f.items() if x not in set(known))} for f in first]
    share = {x: len(kinds[x]) + 1 for x in known} | {None: sum(len(v) for x, v in kinds.items() if x not in set(known)) + 1}
    base = {x: v / sum(share.values()) for x, v in share.items()}
    start = [told(m, base) for m in n]
    after = {}
    for h in {a for a, _ in later[0] + later[1]}:
        own = [{b: c for (a, b), c in x.items() if a == h} for x in later]
        names = [b for b in own[0].keys() | own[1].keys() if own[0].get(b, 0) + own[1].get(b, 0) >= least]
        if names:
            m = [{b: x.get(b, 0) for b in names} | {None: sum(v for b, v in x.items() if b not in names)} for x in own]
            pooled = told({b: m[0][b] + m[1][b] for b in m[0]}, dict.fromkeys(m[0], 1 / len(m[0])))
            after[h] = [told(x, pooled) for x in m]
    for p in (*start, *(q for x in after.values() for q in x)):
        assert sum(p.values()) == pytest.approx(1)
    out = []
    for words, _ in rows:
        r = []
        for w in words:
            parts = [w[:k] for k in op6.STEPS if len(w) > k] + [w]
            x = parts[0] if parts[0] in n[0] else None
            r.append(math.log(start[1][x] / start[0][x]))
            for a, b in zip(parts, parts[1:]):
                if a in after:
                    b = b if b in after[a][0] else None
                    r[-1] += math.log(after[a][1][b] / after[a][0][b])
        out.append(r)
    return out


def test_models_equal_plain_kneser_ney(spark, monkeypatch):
    monkeypatch.setattr(op6, "LEAST", 3)
    r = random.Random(13)
    stems = ["abcd", "abce", "efgh", "xé", "q", "ijklmno"]
    rows = [([r.choice(stems) + r.choice(["", "u", "uvw", "uvwxy", "zzzz"]) for _ in range(r.randint(0, 25))], int(r.random() < 0.3)) for _ in range(60)]
    df = spark.createDataFrame([(" ".join(w), y, 1) for w, y in rows], "text string, toxic int, fold int").repartition(3)
    model = op6.fit_model(op6.count_steps(df), ("n0", "n1"))
    for (words, _), want in zip(rows, plain_kneser_ney(rows, 3)):
        raw = " ".join(words).encode()
        piece, word, follows, _ = op6.steps(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        got = np.bincount(word, model.ratios(piece, follows), len(words)) if words else []
        assert list(got) == pytest.approx(want, abs=1e-5)


def test_probabilities_sum_to_one():
    r = np.random.default_rng(14)
    group = np.concatenate([np.arange(9), r.integers(0, 9, 60)])
    n0, n1 = r.integers(0, 6, (2, len(group)))
    for p in op6.both(group, n0, n1):
        assert np.bincount(group, p) == pytest.approx(1)


def test_tables_are_bounded_by_rarity(spark, monkeypatch):
    monkeypatch.setattr(op6, "LEAST", 1)
    monkeypatch.setattr(op6, "MOST_FIRST", 5)
    df = spark.createDataFrame([(f"w{k:03d} " * (1 + k % 7), k % 2, 1) for k in range(60)], "text string, toxic int, fold int")
    model = op6.fit_model(op6.count_steps(df), ("n0", "n1"))
    assert len(model.first[0]) <= 5 and math.isfinite(model.other)


def test_steps_beyond_the_tables_are_joined(spark, docs_of, monkeypatch):
    """Tables of a few rows give the scores of tables that hold all."""
    r = random.Random(31)
    bad = [f"bad{k}stem{k}" for k in range(12)]
    fine = [f"word{k}longer{k % 5}" for k in range(40)] + ["abcd", "\u00e9"]
    made = [(k, " ".join(r.choice(bad if k % 4 == 0 and r.random() < 0.3 else fine) for _ in range(r.randint(0, 40)))) for k in range(150)] + [(150, None), (3, "word1longer1 unseen")]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(150)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(op6, "LEAST", 2)
    scores = lambda: sorted((x["doc_id"], x["score"], x["predicted"]) for x in toxicity(docs_of(made), labels).collect())
    want = scores()
    monkeypatch.setattr(op6, "MOST_FIRST", 2)
    monkeypatch.setattr(op6, "MOST_PAIRS", 3)
    got = scores()
    assert [x[0] for x in got] == [x[0] for x in want] and [x[1] for x in got] == pytest.approx([x[1] for x in want], abs=1e-6)


def test_toxicity_odd_rows(spark, docs_of, odd_docs):
    none = spark.createDataFrame([(1, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity(odd_docs, none).collect()
    assert len(got) == odd_docs.count() and all(x["score"] == 0 for x in got)
    assert toxicity(docs_of([]), none).count() == 0


# --- op7


def test_word_counts(docs_of, odd_docs, monkeypatch):
    monkeypatch.setattr(op7, "FREQUENT", 20)
    monkeypatch.setattr(op7, "TRAIN_STEPS", 5)
    r = random.Random(5)
    made = docs_of([(k, " ".join(r.choice(["The", "cat", "É", f"w{r.randrange(60)}"]) for _ in range(r.randint(0, 30)))) for k in range(80)])
    for docs in (made, odd_docs):
        rows = [(x["doc_id"], WORD.findall("".join(c.lower() if c.isascii() else c for c in x["text"] or "")) + [None]) for x in docs.select("doc_id", "text").collect()]
        train = Counter(w for i, ws in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
        n, v = sum(train.values()), len(train)
        want = sorted((i or -1, len(ws), sum(train[w] > 0 for w in ws), round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in rows)
        got = lm_scores(docs).collect()
        assert sorted((x["doc_id"] or -1, x["n_tokens"], x["n_known"], round(x["base_score"], 6)) for x in got) == want
        assert {x["train_tokens"] for x in got} == {n} and all(math.isfinite(x["score"]) and x["score"] < 0 for x in got)


def test_lm_empty(docs_of):
    assert lm_scores(docs_of([])).count() == 0


def test_gradients():
    model, r = A.Attention(), np.random.default_rng(1)
    for k in model.w:
        model.w[k] = model.w[k].astype(np.float64)
    rows, target = r.integers(0, 50, (3, A.SPAN)), r.integers(0, A.CLASSES, (3, A.SPAN))
    real = r.random((3, A.SPAN)) < 0.8
    _, g = model.gradients(rows, target, real)
    for k in model.w:
        for _ in range(4):
            at = tuple(r.integers(0, s) for s in model.w[k].shape) if k != "e" else (int(rows[0, 0]), int(r.integers(0, A.WIDTH)))
            old, eps = model.w[k][at], 1e-5
            model.w[k][at] = old + eps
            up = model.gradients(rows, target, real)[0]
            model.w[k][at] = old - eps
            down = model.gradients(rows, target, real)[0]
            model.w[k][at] = old
            assert (up - down) / (2 * eps) == pytest.approx(g[k][at], abs=2e-5)


def test_context_only_positions_ask_nothing(monkeypatch):
    """Nothing is worked out for them, and the gradients stay those of the whole window, mixed with windows that begin a text."""
    model, r = A.Attention(), np.random.default_rng(21)
    for k in model.w:
        model.w[k] = (model.w[k] + 0.1 * r.standard_normal(model.w[k].shape)).astype(np.float64)
    rows, target = r.integers(0, 50, (6, A.SPAN)), r.integers(0, A.CLASSES, (6, A.SPAN))
    real = r.random((6, A.SPAN)) < 0.9
    real[:4, : A.SPAN - A.STEP] = False
    real[4:, 0] = True
    asked, plain = [], A._exp
    monkeypatch.setattr(A, "_exp", lambda x: asked.append(x.size) or plain(x))
    _, g = model.gradients(rows, target, real)
    assert sum(asked) == 4 * A.STEP * A.SPAN + 2 * A.SPAN * A.SPAN

    def loss() -> float:
        z = (model.forward(rows)[-1] @ model.w["c"] + model.w["b"])[real]
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), target[real]]).mean())

    for k in model.w:
        for _ in range(4):
            at = tuple(r.integers(0, s) for s in model.w[k].shape) if k != "e" else (int(r.choice(rows[0])), int(r.integers(0, A.WIDTH)))
            old, eps = model.w[k][at], 1e-5
            model.w[k][at] = old + eps
            up = loss()
            model.w[k][at] = old - eps
            down = loss()
            model.w[k][at] = old
            assert (up - down) / (2 * eps) == pytest.approx(g[k][at], abs=1e-6, rel=1e-4)


def test_large_class_scores_are_cut_in_training_too():
    model, r = A.Attention(), np.random.default_rng(22)
    model.w["c"] *= 200
    rows, target = r.integers(0, 50, (3, A.SPAN)), r.integers(0, A.CLASSES, (3, A.SPAN))
    loss, g = model.gradients(rows, target, np.ones((3, A.SPAN), bool))
    assert np.isfinite(loss) and all(np.isfinite(x).all() for x in g.values())


def test_each_token_is_scored_once():
    for n in (1, 2, A.SPAN, A.SPAN + 1, A.SPAN + A.STEP, 200):
        ids, at = np.arange(n) % 7, np.array([0, n])
        _, target, real, _ = A.window_table(ids, at, 9)
        assert target[real].tolist() == ids.tolist()


def test_scores_by_windows_equal_plain_ones():
    r = np.random.default_rng(2)
    counts = r.integers(1, 50, 300)
    group = r.integers(0, A.GROUPS, 300)
    classes, model = A.Classes(counts, group, r.integers(0, 9, (300, A.GROUPS))), A.Attention()
    ids = r.integers(0, 299, 130)
    got = A.score_texts(model, classes, ids, np.array([0, 30, 31, 130]), 299)
    for (a, b), score in zip(((0, 30), (30, 31), (31, 130)), got):
        text, want = ids[a:b], 0.0
        for k in range(len(text)):
            first = 0 if k < A.SPAN else -(-(k - A.SPAN + 1) // A.STEP) * A.STEP
            seen = [299 if j == 0 else int(text[j - 1]) for j in range(first, k + 1)]
            rows = np.zeros((1, A.SPAN), np.int64)
            rows[0, : len(seen)] = classes.row[seen]
            h = model.forward(rows)[-1][0, len(seen) - 1].astype(np.float64)
            z = h @ model.w["c"] + model.w["b"]
            want += (z[classes.of[text[k]]] - np.log(np.exp(z).sum())) / np.log(10) + classes.within_log10(299 if k == 0 else text[k - 1], text[k])
        assert score == pytest.approx(want, abs=1e-3)


def test_scoring_sees_what_training_sees():
    r = np.random.default_rng(15)
    model = A.Attention()
    model.w["r"] = r.standard_normal(A.SPAN).astype(np.float32)
    rows = r.integers(0, A.EMBEDDED, (A.HIDDEN + 5, A.SPAN))
    got = np.concatenate([x.copy() for x in model.hidden(rows)])
    assert got == pytest.approx(model.forward(rows)[-1], abs=1e-4)


def test_class_probabilities_sum_to_one():
    r = np.random.default_rng(3)
    counts = r.integers(0, 9, 1000)
    for classes in (A.Classes(counts), A.Classes(counts, r.integers(0, A.GROUPS, 1000), r.integers(0, 5, (1000, A.GROUPS)))):
        for within in classes.within:
            assert np.bincount(classes.of, 10**within, A.CLASSES)[np.unique(classes.of)] == pytest.approx(1, abs=1e-4)


def test_clusters_tell_two_languages_apart():
    r = np.random.default_rng(8)
    counts = r.integers(5, 50, 600)
    after = np.zeros((600, A.GROUPS))
    for k in range(600):  # even ids follow the first half of the groups, odd ones the second
        np.add.at(after[k], r.integers(0, A.GROUPS // 2, counts[k]) + (k % 2) * A.GROUPS // 2, 1)
    classes = A.Classes(counts, np.zeros(600, np.int64), after)
    for c in range(A.COMMON, A.CLASSES):
        assert len({k % 2 for k in np.flatnonzero(classes.of == c)}) <= 1


def test_every_training_text_teaches():
    r = np.random.default_rng(9)
    size = r.integers(1, 600, 200)
    at = np.concatenate([[0], np.cumsum(size)])
    ids = r.integers(0, 999, at[-1])
    some = np.frombuffer(b"".join(op7.taught(ids, at, 999)), "<i4").reshape(-1, 2, A.SPAN)
    text, _ = A.windows(size)
    assert len(some) >= np.maximum(1, np.bincount(text) // op7.WINDOW_SHARE).sum()
    before, target, real, _ = A.window_table(ids, at, 999)
    whole = {x.tobytes() for x in np.concatenate([before, np.where(real, target, -1)], axis=1).astype("<i4")}
    assert {x.tobytes() for x in some.reshape(len(some), -1)} <= whole


def test_every_position_of_every_training_text_teaches_once(spark):
    r = np.random.default_rng(12)
    texts = [r.integers(0, 60_000, n).astype(op7.id_type(60_000)) for n in (1, 31, 32, 33, 500, 3000, 5)]
    coded = spark.createDataFrame([(x.tobytes(),) for x in texts], "w binary").repartition(3)
    rows = [w for k in range(op7.ROUNDS) for w in op7.text_windows(coded, 60_000, 20, op7.ROUNDS, k).collect()]
    told = np.frombuffer(b"".join(x["w"] for x in rows), "<i4").reshape(-1, 2, A.SPAN)[:, 1]
    assert sorted(told[told >= 0].tolist()) == sorted(np.concatenate(texts).tolist())


def test_a_round_makes_only_its_own_windows(monkeypatch):
    r = np.random.default_rng(23)
    size = r.integers(1, 900, 40)
    texts = [r.integers(0, 60_000, n).astype(op7.id_type(60_000)) for n in size]
    made, plain = [], op7.window_table
    monkeypatch.setattr(op7, "window_table", lambda *x: made.append(plain(*x)) or made[-1])
    batch = pa.record_batch({"w": pa.array([x.tobytes() for x in texts], pa.binary())})
    told = [target for k in range(op7.ROUNDS) for _, _, target in op7._cut(iter([batch]), 60_000, 20, op7.ROUNDS, k)]
    assert sum(len(x[0]) for x in made) == len(A.windows(size)[0])
    told = np.concatenate(told)
    assert sorted(told[told >= 0].tolist()) == sorted(np.concatenate(texts).tolist())


def test_rounds_average_the_tasks(spark):
    """The start on the driver and the rounds over partitions leave a model that has learned."""
    r = np.random.default_rng(10)
    ids = np.cumsum(np.where(r.random(600_000) < 0.9, 1, r.integers(0, 50, 600_000))) % 50
    at = np.arange(0, 600_001, 60)
    counts = np.bincount(ids, minlength=300)
    classes = A.Classes(counts)
    rows = [(int(x), w) for x, w in zip(r.integers(-(1 << 62), 1 << 62, 10_000), op7.taught(ids, at, 299))]
    model = op7.fit_network(spark.createDataFrame(rows, "lot long, w binary").repartition(4), classes)
    got = A.score_texts(model, classes, ids[:3000], np.array([0, 3000]), 299)[0] / 3000
    assert got > -0.5  # mostly the id after the last one; -1.7 by chance


def test_model_beats_word_counts_on_held_out_rows(spark):
    mean = {}
    for table in ("sf0.01", "sf0.1"):
        x = lm_scores(spark.read.parquet(f"/root/testdata/{table}/documents.parquet")).where("held_out").selectExpr("sum(score) / sum(n_tokens)", "sum(base_score) / sum(n_tokens)").first()
        mean[table] = tuple(x)
    assert mean["sf0.1"][0] > mean["sf0.1"][1] + 0.15
    assert mean["sf0.1"][0] > mean["sf0.01"][0] + 0.1  # it learns from what it is given


def test_training_lowers_the_loss():
    r = np.random.default_rng(4)
    rows = np.tile(np.arange(A.SPAN) % 5, (64, 1))
    losses = A.Attention().train(rows, (rows + 1) % 5, r.random(rows.shape) < 2, 60, 32)
    assert np.mean(losses[-5:]) < 0.3 * np.mean(losses[:5])


def test_classes_and_span_are_not_cut():
    classes = A.Classes(np.arange(1000, 0, -1))
    assert len(np.unique(classes.of)) >= 192 and len(np.unique(classes.of[:168])) == 168
    assert np.bincount(classes.of)[classes.of[:168]].max() == 1
    _, _, real, _ = A.window_table(np.arange(200), np.array([0, 200]), 200)
    assert np.nonzero(real[1:])[1].min() + 1 >= 9 and real.shape[1] >= 32  # told from nine subwords at least


# --- op5


def test_common_subsequence():
    r = random.Random(6)
    for _ in range(200):
        a, b = ([r.randrange(5) for _ in range(r.randint(0, 12))] for _ in "ab")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert common_subsequence(a, b) == t[-1][-1]


def leaked(spark, docs_of):
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    items = [[word() for _ in range(r.choice([12, 25, 40, 70]))] for _ in range(20)]
    rows, want = [], set()
    for k in range(150):
        words = [word() if r.random() < 0.6 else r.choice(["the", "of", "and"]) for _ in range(r.randint(5, 400))]
        if k % 3 == 0:
            item = r.randrange(20)
            leak = [w for w in items[item] if r.random() > (0.1 if k % 2 else 0)]
            at = r.randrange(len(words))
            words[at:at] = [w.upper() + "," if k % 2 else w for w in leak]
            want.add((k, item))
        rows.append((k, " ".join(words)))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(50, None), (51, "")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    return docs_of(rows), bench, want


def test_contamination(spark, docs_of):
    docs, bench, want = leaked(spark, docs_of)
    got = {(x["doc_id"], x["item_id"]) for x in contamination(docs, bench).collect()}
    assert got == want
    clean = uncontaminated(docs, bench)
    assert clean.columns == docs.columns and {x["doc_id"] for x in clean.collect()} == set(range(150)) - {k for k, _ in want}


def leaks_by_definition(rows, items):
    """Kind of each document and item, from every passage's neighbourhood, without any candidate search."""
    split = lambda texts: op5.terms(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)]))
    d, q = split([t for _, t in rows]), split([t for _, t in items])
    out = {}
    for item, x, y in zip(range(len(items)), q.first[:-1], q.first[1:]):
        own = q.hashes[x:y].tolist()
        answer = own[-op5.ANSWER_WORDS :]
        for doc, begin, _ in zip(*op5.passages(d.first)):
            near = d.hashes[max(begin - len(own), d.first[doc]) : min(begin + op5.PASSAGE + len(own), d.first[doc + 1])].tolist()
            share = common_subsequence(own, near) / len(own)
            held = share >= op5.PARAPHRASE and common_subsequence(answer, near) >= op5.ANSWER * len(answer)
            if share >= op5.VERBATIM or held:
                key = rows[doc][0], items[item][0]
                out[key] = "verbatim" if share >= op5.VERBATIM or out.get(key) == "verbatim" else "paraphrase"
    return out


def test_paraphrases_against_all_pairs(spark, docs_of):
    r = random.Random(21)
    common, rare = [f"c{k}" for k in range(40)], ["".join(r.choices("abcdefghij", k=6)) for _ in range(1500)]
    word = lambda: r.choice(common) if r.random() < 0.4 else r.choice(rare)
    items = [(k, " ".join(word() for _ in range(r.choice([15, 30, 60])))) for k in range(15)]
    rows = []
    for k in range(120):
        words = [word() for _ in range(r.randint(60, 300))]
        if k % 4:
            item, rate = items[r.randrange(15)][1].split(), r.choice([0, 0.1, 0.2, 0.3, 0.38, 0.5])
            ends = op5.ANSWER_WORDS
            words[30:30] = [word() if j < len(item) - ends and r.random() < rate else w for j, w in enumerate(item)]
        rows.append((k, " ".join(words)))
    want = leaks_by_definition(rows, items)
    got = {(x["doc_id"], x["item_id"]): x["kind"] for x in contamination(docs_of(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got.keys() <= want.keys() and {"verbatim", "paraphrase"} <= set(got.values())
    assert len(got) >= 0.98 * len(want)


def test_copies_in_capitals(spark, docs_of):
    r = random.Random(23)
    alphabets = ["abcdefé", "ñüößàçabc", "αβγδεζ", "абвгдежя", "ąčęėįšųū"]
    items = [(k, " ".join("".join(r.choices(a, k=r.randint(3, 8))) for _ in range(25))) for k, a in enumerate(alphabets)]
    word = lambda: "".join(r.choices("ghijklmnop", k=6))
    rows = [(k, " ".join([word() for _ in range(60)] + [t.upper().replace("SS", "ß") if "ß" in t else t.upper()] + [word() for _ in range(60)])) for k, t in items]
    got = {(x["doc_id"], x["item_id"]) for x in contamination(docs_of(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k) for k, _ in items}


def test_contamination_by_a_very_long_item(spark, docs_of):
    r = random.Random(22)
    long_item = [f"w{r.randrange(5000)}" for _ in range(6000)]
    docs = docs_of([(1, " ".join(long_item)), (2, " ".join(long_item[:3000])), (3, " ".join(r.sample(long_item, 2000)))])
    got = {x["doc_id"] for x in contamination(docs, spark.createDataFrame([(1, " ".join(long_item)), (2, "x")], "item_id long, text string")).collect()}
    assert got == {1}


def test_contamination_odd_rows(docs_of, odd_docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(odd_docs, none).count() == 0 and uncontaminated(odd_docs, none).count() == odd_docs.count()
    some = spark.createDataFrame([(1, "no id"), (2, None)], "item_id long, text string")
    assert contamination(odd_docs, some).count() == 2  # two rows hold it
    assert contamination(docs_of([]), some).count() == 0


def test_copies_of_many_short_items(spark, docs_of):
    r = random.Random(9)
    common, rare = [f"c{k}" for k in range(60)], ["".join(r.choices("abcdefghij", k=6)) for _ in range(2500)]
    word = lambda: r.choice(common) if r.random() < 0.4 else r.choice(rare)
    items = [[word() for _ in range(r.choice([6, 8, 12, 20, 60]))] for _ in range(600)]  # more passages than directions
    rows = []
    for k, item in enumerate(items):
        words = [word() for _ in range(r.randint(80, 300))]
        at = r.randrange(len(words))
        rows.append((k, " ".join(words[:at] + item + words[at:])))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in contamination(docs_of(rows), bench).collect()}
    assert {(k, k) for k in range(600)} <= got
