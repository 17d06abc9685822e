import hashlib
import re
from collections import Counter

from fixtures import documents_frame, some_documents
from hypothesis import example, given, settings
from hypothesis import strategies as st

from starscan.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(part) <= 255 for part in text.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits[::-1])]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text):
    spans = [
        (kind, m.start(), m.end())
        for kind, pattern in PATTERNS.items()
        for m in re.finditer(pattern, text)
        if passes(kind, m.group())
    ]
    return sorted(spans, key=lambda s: (s[1], pii.BASE.index(s[0])))


parts = st.sampled_from(
    ["a", "Z", "é", "İ", "@", "@@", ".", "..", "-", "+", "+1", " ", "(", ")", "0", "1", "25", "255", "256", "0007",
     "4111111111111111", "4845168114407329", "1.2.3.4", "x.y", "%", "\n", "account ", "iban", "://", "555-7713"]
)


@settings(max_examples=3000, deadline=None)
@given(st.lists(parts, max_size=14).map("".join))
@example("a@b.c.d@e.f a..@-.- @x.y 1.2.3.4.5.6.7.8 +1 (017) 555-7713")
@example("1234567.1.1.1.1.1 4111-1111 1111-1111 +12 +123 +1--- 5555555555")
def test_base_kinds_equal_the_patterns(text):
    found = [s for s in pii.find_spans(text) if s[0] in pii.BASE]
    assert found == base_spans(text)


def test_added_kinds_and_mask():
    text = "Account no: 12345678, two 7536784127813050 4845168114407329 ftp://u:w@h.org/x, x@y.zz; token = 'ab12cd34ef'"
    found = [(k, text[a:b]) for k, a, b in pii.find_spans(text)]
    assert ("account", "12345678") in found
    assert ("account", "4845168114407329") in found
    assert ("login", "ftp://u:w@h.org") in found
    assert ("account", "ab12cd34ef") in found
    clean = "Account of the token, version 3. CC BY-NC 4.0 and a secret place."
    assert pii.mask(clean) == clean
    assert pii.mask("é x@y.zz.") == "é [EMAIL]."


def expected(rows):
    out = Counter()
    for doc_id, text in rows:
        base = base_spans(text or "")
        n = Counter(k for k, _, _ in base)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in pii.find_spans(text or ""))
        out[doc_id, *(n[k] for k in pii.BASE), digest, spans] += 1
    return out


def test_query(spark, sf_dir):
    rows = some_documents(sf_dir)
    found = queries.personal_data(documents_frame(spark, rows))
    assert Counter(tuple(r) for r in found.collect()) == expected(rows)
    assert queries.personal_data(documents_frame(spark, [], 1)).collect() == []


def test_redact(spark):
    rows = [(1, "mail a@b.cc now"), (2, None), (3, ""), (3, "clean"), (None, "+1 (017) 555-7713")]
    frame = documents_frame(spark, rows)
    found = pii.redact(frame)
    assert found.columns == frame.columns
    got = Counter((r.doc_id, r.text, r.n_chars) for r in found.collect())
    assert got == Counter(
        [(1, "mail [EMAIL] now", 16), (2, None, None), (3, "", 0), (3, "clean", 5), (None, "[PHONE]", 7)]
    )


def test_whole_identifiers_behind_cues():
    long = "ab12" * 100
    iban = "DE89 3704 0044 0532 0130 00"
    even = "ES91 2100 0418 4502 0005 1332"
    assert pii.mask(f"token {long} end") == "token [ACCOUNT] end"
    assert pii.mask("account 1234 5678 9012 was closed") == "account [ACCOUNT] was closed"
    assert pii.mask(f"IBAN {iban} und mehr") == "IBAN [ACCOUNT] und mehr"
    assert pii.mask(f"iban: {even} THEN PAID") == "iban: [ACCOUNT] THEN PAID"
    assert pii.mask("account 12345678 2nd street") == "account [ACCOUNT] 2nd street"
    assert pii.mask("account 1234-5678-ab12 x") == "account [ACCOUNT] x"
    assert pii.mask("IBAN DE88 3702 no") == "IBAN DE88 3702 no"
