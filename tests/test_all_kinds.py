"""Queries over every kind, against plain Python on a small table."""

import hashlib
import re

import pytest

from veilspan.functions import patterns
from veilspan.operators import pipeline
from veilspan.plans import registry

TEXTS = [
    ("s1", "c1", "Call (212) 555-0100 or mail a@x.example now"), ("s2", "c1", "ring 212-555-0101, then 212-555-0101 again"), ("s3", None, "call 212.555.0102"), ("s4", "c1", "nothing here"), ("s5", None, None),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, "wl1_pii", t, c, "b1") for i, c, t in TEXTS]
    spark.createDataFrame(rows, "id string, workload string, text string, client_id string, batch_id string").selectExpr("*", "timestamp '2026-01-01 10:00:00' AS created_at").write.parquet(f"{d}/samples.parquet")
    marks = [(1, "s1", "phone", "(212) 555-0100", 5, 19), (2, "s2", "phone", "212-555-0101", 5, 17), (3, "s1", "email", "a@x.example", 28, 39)]
    spark.createDataFrame(marks, "ann_id long, sample_id string, kind string, text string, span_start int, span_end int").selectExpr("*", "timestamp '2026-01-02 10:00:00' AS annotated_at").write.parquet(f"{d}/annotations.parquet")
    return d


def found(text):
    """Every match that is left when earlier, then longer ones win."""
    every = []
    for i, p in enumerate(patterns.PATTERNS):
        g = 2 if p.group else 0
        every += [(m.start(g), -m.end(g), i, p.kind, m.group(g)) for m in re.finditer(p.python, text or "")]
    out = []
    for a, b, _, kind, value in sorted(every):
        if not out or a >= out[-1][1]:
            out.append((a, -b, kind, value))
    return out


def redacted(text):
    names, count = {}, {}
    for _, _, kind, value in reversed(found(text)):
        if value not in names:
            count[kind] = count.get(kind, 0) + 1
            names[value] = f"⟨{kind.upper()}_{count[kind]}⟩"
    at, out = 0, ""
    for a, b, _, value in found(text):
        out, at = out + text[at:a] + names[value], b
    return out + text[at:]


def rows(spark, folder, name):
    return registry.queries()[name](spark, folder).collect()


def test_us_phone_numbers_are_redacted(spark, folder):
    want = {i: hashlib.md5(redacted(t).encode()).hexdigest() for i, _, t in TEXTS if t}
    assert {r.id: r.redacted_md5 for r in rows(spark, folder, "redact_samples") if r.redacted_md5} == want
    assert redacted(TEXTS[0][2]) == "Call ⟨PHONE_US_1⟩ or mail ⟨EMAIL_1⟩ now"
    assert {(r.id, r.original) for r in rows(spark, folder, "reverse_map_entries")} == {(i, v) for i, _, t in TEXTS for *_, v in found(t)}
    assert all(r.sent == 0 and r.detected == len(found(dict((i, t) for i, _, t in TEXTS)[r.id])) for r in rows(spark, folder, "leak_audit"))


def test_us_phone_numbers_are_counted(spark, folder):
    n = sum(len(found(t)) for _, _, t in TEXTS)
    assert {(r.id, r.start, r.end, r.kind) for r in rows(spark, folder, "detect_spans")} >= {(i, a, b, k) for i, _, t in TEXTS for a, b, k, _ in found(t)}
    for name in ("kind_categories", "detections_per_hour", "policy_filter"):
        got = {r.kind: r.n for r in rows(spark, folder, name)}
        assert got["phone_us"] == 4 and sum(got.values()) == n
    assert {r.kind: r.n for r in rows(spark, folder, "category_rollup") if r.kind}["phone_us"] == 4
    assert {r.option_name: r.exact_leaks for r in rows(spark, folder, "leak_summary") if r.option_name in ("baseline", "B")} == {"baseline": 3, "B": 0}
    assert {r.detections for r in rows(spark, folder, "false_positive_rate")} == {n}


def test_requests_hold_no_us_phone_number(spark, folder):
    got = {r.id: r.redacted_md5 for r in rows(spark, folder, "request_scope")}
    values = sorted(["(212) 555-0100", "212-555-0101"], key=lambda v: hashlib.md5(v.encode()).hexdigest())
    name = f"⟨PHONE_US_{values.index('212-555-0101') + 1}⟩"
    assert got["s2"] == hashlib.md5(f"ring {name}, then {name} again".encode()).hexdigest()


def test_round_trip_of_all_texts(spark, tmp_path):
    tag = hashlib.md5(b"h3").hexdigest()[:8]
    texts = [("h1", "⟨EMAIL_1⟩ wrote to a@x.example"), ("h2", "⟨EMAIL_1⟩ and ⟨X"), ("h3", f"⟨EMAIL_1·{tag}⟩ is a@x.example"), ("h4", "call 212-555-0100"), ("h5", None), ("h6", "")]
    spark.createDataFrame([(i, "wl1_pii", t) for i, t in texts], "id string, workload string, text string").write.parquet(f"{tmp_path}/samples.parquet")

    def restored(i, text):
        t = hashlib.md5(i.encode()).hexdigest()[:8]
        names, count, at, out = {}, {}, 0, ""
        for _, _, kind, value in reversed(found(text)):
            if value not in names:
                count[kind] = count.get(kind, 0) + 1
                names[value] = f"⟨{kind.upper()}_{count[kind]}·{t}⟩"
        for a, b, _, value in found(text):
            out, at = out + text[at:a] + names[value], b
        out += text[at:]
        for value, name in names.items():
            out = out.replace(name, value)
        return out == text

    ok = [restored(i, t) for i, t in texts if t is not None]
    assert [tuple(r) for r in rows(spark, str(tmp_path), "restore_roundtrip")] == [(5, sum(ok), len(ok) - sum(ok), sum(ok))] and sum(ok) == 4


def test_messages_without_client_are_requests(spark, folder):
    got = {r.id: (r.request, r.redacted_md5) for r in rows(spark, folder, "request_scope")}
    assert set(got) == {i for i, _, _ in TEXTS} and got["s1"][0] == got["s2"][0] == "c1/b1"
    assert got["s3"] == ("/s3", hashlib.md5(redacted(TEXTS[2][2]).encode()).hexdigest()) and got["s5"] == ("/s5", None)


def test_all_options_are_measured(spark, folder):
    values = {"s1": ["(212) 555-0100", "a@x.example"], "s2": ["212-555-0101"]}
    sent = {(r.sample_id, r.option_name): r.outgoing for r in registry._runs(spark, folder).select("sample_id", "option_name", "outgoing").collect()}
    assert {sent[("s1", o)] for o in ("baseline", "D")} == {TEXTS[0][2]} and {sent[("s1", o)] for o in ("B", "B+D")} == {redacted(TEXTS[0][2])} and {sent[("s1", o)] for o in "EFG"} == {""}
    want = {(i, o): sum(v in sent[(i, o)] for v in vs) for i, vs in values.items() for o in pipeline.OPTIONS}
    assert {(r.sample_id, r.option_name): r.exact_leaks for r in rows(spark, folder, "leak_by_sample")} == want
    total = {o: sum(want[(i, o)] for i in values) for o in pipeline.OPTIONS}
    assert {r.option_name: r.exact_leaks for r in rows(spark, folder, "leak_summary")} == total
    phones = {o: want[("s2", o)] + (values["s1"][0] in sent[("s1", o)]) for o in pipeline.OPTIONS}
    assert {r.option_name: r.leaked for r in rows(spark, folder, "leak_by_kind") if r.kind == "phone"} == phones
    assert {r.option_name: r.outgoing_tokens for r in rows(spark, folder, "token_cost")} == {o: sum(len(t.split()) for (_, x), t in sent.items() if x == o) for o in pipeline.OPTIONS}
    assert {r.option_name for r in rows(spark, folder, "option_matrix")} == set(pipeline.OPTIONS)
    assert {r.option_name for r in rows(spark, folder, "false_positive_rate")} == {o for o in pipeline.OPTIONS if "B" in o}
