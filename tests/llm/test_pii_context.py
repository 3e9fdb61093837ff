"""Context of personal data: before and after a span, whatever other matches stand between."""

import re

import pytest

from rankfield.llm.op1_pii import CONTEXT, KINDS, pii, pii_spans, redact

FAR = " and" * 15
TEXTS = {
    "SSN 123-45-6789, 234-56-7890": "SSN [SSN], [SSN]",
    "123-45-6789 (SSN)": "[SSN] (SSN)",
    "call 555-123-4567 or 555-987-6543": "call [LOCAL_PHONE] or [LOCAL_PHONE]",
    "555-123-4567 is my mobile": "[LOCAL_PHONE] is my mobile",
    "ssn 000-12-3456 123-45-6789": "ssn 000-12-3456 [SSN]",
    f"ssn{FAR} 123-45-6789{FAR} ssn": f"ssn{FAR} 123-45-6789{FAR} ssn",
    "123-45-6789, 555-123-4567": "123-45-6789, 555-123-4567",
}


def test_lists_and_trailing_context(docs_of):
    docs = docs_of(list(enumerate(TEXTS)))
    assert [x["text"] for x in redact(docs).orderBy("doc_id").collect()] == list(TEXTS.values())
    got = {x["doc_id"]: x["n_ssn"] + x["n_local_phone"] for x in pii(docs).collect()}
    assert [got[k] for k in range(len(TEXTS))] == [len(re.findall(r"\[", x)) for x in TEXTS.values()]


def test_scores_follow_the_text_around(docs_of):
    rows = ["1 22 333 4444 " * 4 + "4111 1111 1111 1111 " + ("5 " * 12) + "x card", "a@b.c,d@e.f;" * 9 + "mail", "card " + "ab 4111-1111-1111-1111 " * 3]
    for x in pii_spans(docs_of(list(enumerate(rows)))).where("kind is not null").collect():
        kind, text = next(k for k in KINDS if k.name == x["kind"]), rows[x["doc_id"]]
        around = text[max(x["start"] - CONTEXT, 0) : x["start"]] + "\n" + text[x["end"] : x["end"] + CONTEXT]
        assert x["score"] == pytest.approx(kind.near if re.search(kind.context, around.lower()) else kind.alone), (x, around)
