"""Ids by pieces are those of the tokenizer; token files and packing give them back."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from rankfield.llm.core import Words, shared_path, text_groups
from rankfield.llm.op8_token_output import END_ID, read_tokens, token_output, write_tokens
from rankfield.llm.op9_best_fit_packing import best_fit_packing, plan
from rankfield.llm.tokens import encoder, vocabulary_path

PARTS = ["a", "B", "H", "̱", "̌", "T", "́", "é", "É", ".", " ", "\n", "\x0b", "'s", "'", "<", "|>", "1", "Σ", "İ", "\x1c", "\x85", ",", "!", "汉", "\x01", "'LL", "=", "̸", "ſ", "\x00", "K", "각", "ᄀ", "ᅡ", "\U0001f600"]


def test_ids_equal_the_tokenizers():
    code, r = encoder(vocabulary_path()), random.Random(2)
    texts = ["".join(r.choices(PARTS, k=r.randint(0, 25))) for _ in range(800)]
    for a, b, buf, off in text_groups(pa.array([*texts, None]), 200):
        ids, at = code.encode(buf, off)
        for k in range(a, b):
            want = code.tokenizer.encode(texts[k], add_special_tokens=False).ids if k < len(texts) else []
            assert ids[at[k - a] : at[k - a + 1]].tolist() == want


def test_words_are_runs_without_white_space():
    import re

    r = random.Random(1)
    texts = ["".join(r.choices("ab \t\n\x0b\x0c\r\x1c é", k=r.randint(0, 12))) for _ in range(200)]
    for a, _, buf, off in text_groups(pa.array(texts), 100):
        w = Words(buf, off)
        for k in range(len(w)):
            got = [buf[x:y].tobytes().decode() for x, y in zip(w.start[w.first[k] : w.first[k + 1]], w.end[w.first[k] : w.first[k + 1]])]
            assert got == re.findall("[^\x20\x09-\x0d]+", texts[a + k])


def truth(rows, end):
    code = encoder(vocabulary_path())
    return [(i, [*code.tokenizer.encode(t or "", add_special_tokens=False).ids, end]) for i, t in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = token_output(odd_docs).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((i or -1, len(x), crc(x)) for i, x in truth(rows, END_ID))
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] or -1 for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids)


def test_token_files_many_parts(spark, docs_of, monkeypatch):
    import rankfield.llm.op8_token_output as op8

    monkeypatch.setattr(op8, "PART_DOCS", 7)
    monkeypatch.setattr(op8, "BLOCK_TOKENS", 20)
    rows = [(k * 3 % 101, f"text number {k} " * (k % 9)) for k in range(60)]
    path = shared_path(spark, "t")
    write_tokens(docs_of(rows), path)
    got = read_tokens(spark, path).orderBy("part", "first").collect()
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got] == [(i, len(x), crc(x)) for i, x in sorted(truth(rows, END_ID))]


def test_empty_tables(spark, docs_of):
    assert token_output(docs_of([])).count() == 0
    assert best_fit_packing(docs_of([])).count() == 0


def check_packing(rows, got, capacity):
    by_doc, used = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    want = sorted((i or -1, k, min(capacity, len(x) - k * capacity), crc(x[k * capacity : (k + 1) * capacity])) for i, x in truth(rows, 1) for k in range(-(-len(x) // capacity)))
    assert sorted((r["doc_id"] or -1, r["piece"], r["length"], r["ids_crc32"]) for r in got) == want
    return len(used)


def test_packing(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = best_fit_packing(odd_docs).collect()
    used = check_packing(rows, got, 4096)
    assert used <= -(-sum(r["length"] for r in got) // 4096) + 1


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_best_fit(seed):
    r = random.Random(seed)
    lengths = [r.choice([1, 2, 5, 9, 30, 33, 50, 64, r.randint(1, 64)]) for _ in range(r.randint(1, 400))]
    count = {x: lengths.count(x) for x in set(lengths)}
    p = plan(count, 64)
    assert {x: int(p["many"][p["length"] == x].sum()) for x in count} == count
    fill = {}
    for length, many, first, fit, offset in zip(*(p[k].tolist() for k in ("length", "many", "sequence", "fit", "offset"))):
        for k in range(many):
            fill.setdefault(first + k // fit, []).append((offset + k % fit * length, length))
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    rooms = []
    for x in sorted(lengths, reverse=True):  # the plain form of the rule
        fits = [k for k, room in enumerate(rooms) if room >= x]
        if fits:
            k = min(fits, key=lambda k: rooms[k])
            rooms[k] -= x
        else:
            rooms.append(64 - x)
    assert len(fill) == len(rooms)
