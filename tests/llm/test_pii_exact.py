import hashlib
import re

import pytest

from orofold.llm.exact import exact_dedup
from orofold.llm.pii import find_pii, redacted

TEXTS = [
    None, "", "mail a@b.c_x@d.ef now", "a@b.c@d.e", "x" * 40_000 + "@host", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "4111 1111 1111 1111 and 4111111111111112",
    "1" * 30_000, "+1 (988) 555-2485 then +12 +1234567890123456", "1-" * 20_000, "é𝄞 me@x.org é +44 20 7946 0958", "call me at (212) 555-0187. mail bob [at] site [dot] com",
    "repeat", "repeat", "a" * 70_000, "a" * 70_000, "a" * 69_999 + "b", "ip 10.0.0.1, 10.0.0.1", "+1" + "(" * 30_000,
]
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, v):
    d = [int(x) for x in v if x in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def brute(text):
    text = text or ""
    if len(text) >= 30_000 and not re.search(r"[@+]", text):
        kinds = ("card",)
    else:
        kinds = PLAIN
    return [(k, m.start(), m.end()) for k in kinds for m in re.finditer(PLAIN[k], text) if good(k, m.group())]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "z@y.com", "x"), (0, "repeat", "y")], "doc_id long, text string, TEXT_ string").repartition(3)


def test_pii_matches_plain_patterns(docs):
    rows = {(r.doc_id, i): r for i, r in enumerate(find_pii(docs).collect())}
    assert len(rows) == len(TEXTS) + 2
    for (d, _), r in rows.items():
        if d is None or d == 0:
            continue
        if len(TEXTS[d] or "") < 30_000 or d in (13, 9):
            assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] == brute(TEXTS[d]), TEXTS[d][:60]
    added = [s for r in rows.values() for s in r["spans"] if not s["base"]]
    assert {s["kind"] for s in added} <= {"email", "phone", "card", "ip"}


def test_pii_spans_of_a_kind_do_not_overlap(docs):
    for r in find_pii(docs).collect():
        for kind in PLAIN:
            own = [s for s in r["spans"] if s["kind"] == kind]
            assert all(a["end"] <= b["start"] for a, b in zip(own, own[1:]))


def test_redaction(docs):
    got = {r.doc_id: r.text for r in redacted(docs.where("doc_id > 0")).collect()}
    assert got[3] == "[EMAIL]@d.e"
    assert got[10].startswith("é𝄞 [EMAIL] é [PHONE]")
    assert got[12] == "repeat"


def test_pii_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert find_pii(none).count() == 0 and redacted(none).count() == 0


@pytest.mark.parametrize("block", [4, 1000, 16_384])
def test_exact_groups(docs, block):
    rows = exact_dedup(docs, block=block).collect()
    assert len(rows) == len(TEXTS) + 2
    by = {}
    for i, t in [*enumerate(TEXTS), (None, "z@y.com"), (0, "repeat")]:
        by.setdefault(t or "", []).append(i)
    for r in rows:
        group = next(g for t, g in by.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256 and r.doc_id in g)
        assert r.group_size == len(group)
        assert r.keep_id == max((x for x in group if x is not None), default=None)
    assert sum(r.kept for r in rows) == len(by)


def test_exact_tells_apart_texts_whose_hashes_collide(docs):
    import pyspark.sql.functions as F

    rows = exact_dedup(docs, block=8, content_hash=lambda c: F.length(c).cast("long")).collect()
    assert sum(r.kept for r in rows) == len({t or "" for t in [*TEXTS, "z@y.com"]})


def test_exact_empty(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
