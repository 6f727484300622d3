import base64
import math
import random
import struct
import time
from collections import Counter, defaultdict
from datetime import date
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspan.llm import mixing, neardup, packing, percentiles, pii, queries, sampling, secrets, spam, tokens


# ---------------------------------------------------------------- 1 percentiles
def test_order_key_is_the_ieee_order(spark):
    rng = random.Random(1)
    v = [0.0, -0.0, 1.0, 2.0, 0.5, 1e-320, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf"), -1.5, 1023.9999999999999, 1024.0]
    v += [rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300) for _ in range(3000)] + [float(2**k) for k in range(-60, 60)] + [math.nextafter(float(2**k), 0) for k in range(-60, 60)]
    df = spark.createDataFrame([(x,) for x in v], "x double")
    k = percentiles.order_key(F.col("x"))
    for r in df.select("x", k.alias("k"), percentiles.key_value(k).alias("b")).collect():
        bits = struct.unpack(">q", struct.pack(">d", abs(r.x)))[0]
        assert r.k == (-bits if r.x < 0 else bits) and r.b == r.x


def test_percentiles_exact_bounded_and_merged(spark):
    rng = random.Random(2)
    rows = [("hot", d, rng.lognormvariate(5, 2)) for d in range(3) for _ in range(700)] + [("one", 0, 3.0), (None, 0, 1.0), (None, 1, 2.0), ("ties", 0, 4.0), ("ties", 1, 4.0), ("ties", 1, 4.0)]
    rows += [("hot", 0, None), ("hot", 0, float("nan")), ("hot", 0, -1.0), ("none", 0, None)]
    df = spark.createDataFrame(rows, "g string, d int, v double").withColumn("__k", F.lit("clash")).withColumn("__n", F.lit(1))
    truth = defaultdict(list)
    for g, _, v in rows:
        if v is not None and v >= 0:
            truth[g].append(v)
    exact = {r.g: r for r in percentiles.radix_percentiles(df, ["g"], "v", least=0.0).collect()}
    hist = percentiles.radix_histogram(df, ["g"], "v", part=["d"], least=0.0)
    parts = hist.filter("d = 0").unionByName(hist.filter("d = 1")).unionByName(hist.filter("d = 2"))
    near = {r.g: r for r in percentiles.percentiles_from_histogram(parts, ["g"]).collect()}
    assert set(exact) == set(truth) == set(near)
    for g, v in truth.items():
        v.sort()
        for name, q in percentiles.QUANTILES.items():
            t = v[min(math.floor(q * len(v)), len(v) - 1)]
            assert exact[g][name] == t and exact[g].n == len(v) == near[g].n
            assert near[g][name + "_low"] <= t <= near[g][name + "_high"] and abs(near[g][name] - t) <= t * percentiles.relative_error(percentiles.DIGITS, 2)
    assert percentiles.radix_percentiles(df.limit(0), ["g"], "v").count() == 0


def test_wrong_reports(spark):
    r = spark.createDataFrame([(f"q{i}", "r", "B", "w", float(i), f"2026-01-{1 + i % 3:02d}") for i in range(1, 101)] + [("q1", "r", "B", "w", 1.0, "2026-01-09"), (None, "r", "B", "w", 5.0, None)], "request_id string, run_id string, option_name string, workload string, latency_ms double, received_at string")
    r = r.withColumn("received_at", F.to_timestamp("received_at")).withColumn("requested_at", F.when(F.col("request_id") == "q1", F.to_timestamp(F.lit("2026-01-02"))).otherwise(F.col("received_at")))
    e = lambda m, p: spark.createDataFrame([("r", "B", "w", m, p)], "run_id string, option_name string, workload string, latency_ms_median double, latency_ms_p95 double")
    assert percentiles.latency_percentiles(r).first().n == 101
    assert percentiles.wrong_reports(r, e(50.0, 95.0)).count() == 0 and percentiles.wrong_reports(r, e(70.0, None)).count() == 1 and percentiles.wrong_reports(r, e(None, None)).count() == 0


# ---------------------------------------------------------------- 2 sampling
@settings(max_examples=200, deadline=None)
@example([[1e-9, 1.5]])
@example([[1e-12, 1.5], [2.5, 1 - 1e-12]])
@example([[1e-9, 1 - 1e-9], [2 + 1e-9, 0.5], [1e-12, 3.0]])
@given(st.integers(1, 5).flatmap(lambda c: st.lists(st.lists(st.floats(0, 6) | st.integers(0, 4).map(float), min_size=c, max_size=c), min_size=1, max_size=6)))
def test_controlled_rounding(table):
    out = sampling.controlled_rounding(table)
    ok = lambda x, n: math.floor(x + 1e-9) <= n <= math.ceil(x - 1e-9)
    assert all(ok(x, n) for a, b in zip(table, out) for x, n in zip(a, b))
    assert all(ok(math.fsum(a), sum(b)) for a, b in zip(table, out))
    assert all(ok(math.fsum(r[j] for r in table), sum(r[j] for r in out)) for j in range(len(table[0])))
    assert ok(math.fsum(map(math.fsum, table)), sum(map(sum, out)))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 4).flatmap(lambda c: st.lists(st.lists(st.fractions(0, 5, max_denominator=10**12), min_size=c, max_size=c), min_size=1, max_size=5)))
def test_controlled_rounding_of_fractions_is_exact(table):
    out = sampling.controlled_rounding(table)
    ok = lambda x, n: math.floor(x) <= n <= math.ceil(x)
    assert all(ok(x, n) for a, b in zip(table, out) for x, n in zip(a, b))
    assert all(ok(sum(a), sum(b)) for a, b in zip(table, out)) and ok(sum(map(sum, table)), sum(map(sum, out)))
    assert all(ok(sum(r[j] for r in table), sum(r[j] for r in out)) for j in range(len(table[0])))


def test_draws_take_their_quotas(spark):
    kinds = ["Email", " e-mail", "EMAIL", "org name", "Org_Name", None]
    a = [(i, f"wl{1 + i % 3}_{i}", "b1", kinds[i % 6], f"2026-01-{1 + i % 9:02d}") for i in range(600)] + [(0, "wl1_0", "b1", "email", "2026-02-01"), (None, "wl1_1", "b1", "email", None)]
    ann = spark.createDataFrame(a, "ann_id long, sample_id string, batch_id string, kind string, annotated_at string").withColumn("annotated_at", F.to_timestamp("annotated_at")).withColumn("item", F.lit(1))
    leak = spark.createDataFrame([(f"wl1_{i}", "A + b", "b1", None) for i in range(7)], "sample_id string, option_name string, batch_id string, measured_at timestamp")
    t = spark.createDataFrame(
        [(1, sampling.ANNOTATIONS, "b1", 100, "e_mail", 0.6, 0), (1, sampling.ANNOTATIONS, "b1", 100, "org-name", 0.4, 250), (1, sampling.ANNOTATIONS, "b1", 100, "iban", 0.0, 3), (2, sampling.LEAKS, "b1", 10, "a+B", 0.5, 0), (3, sampling.LEAKS, "b9", 10, "A", 1.0, None)],
        "draw_id long, pool string, batch_id string, draw_size int, category string, target_share double, min_rows int",
    )
    rep = {(r.draw_id, r.category): (r.wanted, r.available, r.taken, r.short) for r in sampling.draw_report(sampling.quota_table(ann, leak, t)).collect()}
    assert rep == {(1, "e_mail"): (60, 300, 60, False), (1, "org-name"): (250, 200, 200, True), (1, "iban"): (3, 0, 0, True), (2, "a+B"): (5, 7, 5, False), (3, "A"): (10, 0, 0, True)}
    s = sampling.draw_sample(ann, leak, t).collect()
    assert Counter((r.draw_id, r.category) for r in s) == {(1, "e_mail"): 60, (1, "org-name"): 200, (2, "a+B"): 5} and len({(r.draw_id, r.item) for r in s}) == 265
    assert Counter(r.stratum for r in s if r.category == "e_mail") == {"wl1": 20, "wl2": 20, "wl3": 20}
    assert {(r.draw_id, r.category) for r in sampling.shortfalls(ann, leak, t).collect()} == {(1, "org-name"), (1, "iban"), (3, "A")}
    assert sampling.shortfalls(ann.limit(0), leak.limit(0), t.limit(0)).count() == 0


# ---------------------------------------------------------------- 3 personal information
NAMES = pii.Names(frozenset({"ada", "nils"}), frozenset({"holm", "o'dell", "gravel", "van-der-holm"}), (), frozenset({"ada", "nils", "holm", "o'dell"}))
PII = [
    ("Write ada.holm+x@mail.example or ada AT mail DOT example.", [("email", "ada.holm+x@mail.example"), ("email", "ada AT mail DOT example")]),
    ("user@localhost pinned redactor@2.18.0 postgres://app:pa@db.internal:1/x", []),
    ("ring (212)555-0100 ext. 12, +44 (0)1632 960962 or 030/23125-249", [("phone", "(212)555-0100 ext. 12"), ("phone", "+44 (0)1632 960962"), ("phone", "030/23125-249")]),
    ("Build 4155550917 passed, ticket 88-20-90091, Order 7731-415-0042", []),
    ("SSN 900 - 12 - 3456, 666256662; NI qq 12 34 56 b", [("ssn", "900 - 12 - 3456"), ("ssn", "666256662"), ("national_id", "qq 12 34 56 b")]),
    ("badge Emp#25675 at 12 Old Mill St.\nFenwick, GA 30301", [("employee_id", "Emp#25675"), ("address", "12 Old Mill St.\nFenwick, GA 30301")]),
    ("Herr Holm, Alderweg 49, 35023 Fenwick", [("person", "Holm"), ("address", "Alderweg 49, 35023 Fenwick")]),
    ("Holm, Ada met N. O'Dell and nils holm; ask Ada.", [("person", "Holm, Ada"), ("person", "N. O'Dell"), ("person", "nils holm"), ("person", "Ada")]),
    ("Ada Gravel left; Gravel said so. Lantern Gravel sells gravel.", [("person", "Ada Gravel"), ("person", "Gravel")]),
    ("O. van-der-Holm wrote", [("person", "O. van-der-Holm")]),
    ("⟨PERSON_1⟩ wrote to ⟨EMAIL_2⟩", []),
]


@pytest.mark.parametrize("text,want", PII)
def test_find_pii(text, want):
    got = pii.find_pii(text, NAMES)
    assert [(k, text[a:b]) for a, b, k in got] == want


def test_names_are_learnt():
    spans = [f"{g} {f}{e}" for g in ("Ada", "Nils") for f in ("Ash", "Tor", "Vel", "Hem", "Nor", "Pel", "Rav", "Sor", "Ulv") for e in ("mondar", "wickle")]
    n = pii.fit_names(spans, [("Ada Ashmondar met Ada", ["Ada Ashmondar", "Ada"])])
    assert n.given == {"ada", "nils"} and pii.find_names("Then Quilmondar said", n) == [(5, 15)] and pii.fit_names([], []) == pii.EMPTY


@settings(max_examples=150, deadline=None)
@given(st.text("0123456789", min_size=1, max_size=14), st.binary(min_size=1, max_size=8))
def test_digits_are_permuted(digits, key):
    there = pii.permute_digits(digits, key, "t")
    assert len(there) == len(digits) and there.isdigit() and pii.permute_digits(there, key, "t", back=True) == digits


KEY = bytes(range(16))


def test_pseudonyms_link_and_keep_the_format():
    assert len({pii.permute_digits(f"{i:03d}", KEY) for i in range(1000)}) == 1000
    d = date(1984, 2, 29)
    assert pii.permute_date(pii.permute_date(d, KEY), KEY, back=True) == d != pii.permute_date(d, KEY)
    core = lambda v: "".join(c for c in pii.pseudonym(v, "phone", KEY) if c.isdigit())
    assert core("(212) 555-0100") == core("+1 212 555 0100")[1:] and core("030/23125-426")[1:] == core("+49 30 23125 426")[2:]
    assert pii.pseudonym("900-12-3456", "ssn", KEY)[3] == "-" and pii.pseudonym("Holm, Ada", "person", KEY) == pii.pseudonym("ada holm", "person", KEY)
    text = "a 900-12-3456 é😀 b"
    out = pii.redaction(text, NAMES, KEY).text
    assert out.startswith("a ⟨SSN ") and out.endswith("⟩ é😀 b") and pii.redaction(None, NAMES, KEY) == (None, [])


NUMBERS = {
    "phone": ["(212) 555-0100 ext. 12", "+1 212 555 0100", "001-415-555-0199", "+44 (0)1632 960962", "030/23125-426", "2125550100"],
    "ssn": ["900-12-3456", "078 05 1120", "000121234", "666-00-0000"],
    "national_id": ["qq 12 34 56 b", "AB123456C"],
    "employee_id": ["EMP-00412", "emp#7"],
    "date": ["1984-02-29", "1984/2/9", "29.02.1984", "7/4/1999", "12/31/1999", "3. März 2001", "March 3rd, 2001", "3 de mayo de 1999", "14 FÉVRIER 1950", "Sep 9, 2020"],
}


@pytest.mark.parametrize("kind", sorted(NUMBERS))
def test_numbers_and_dates_come_back_under_the_key(kind):
    for v in NUMBERS[kind]:
        there = pii.pseudonym(v, kind, KEY)
        assert pii.pseudonym(there, kind, KEY, back=True) == v and there != pii.pseudonym(v, kind, KEY[::-1])
        assert [c for c in there if not c.isalnum()] == [c for c in v if not c.isalnum()], (v, there)
        if kind == "ssn":
            digits = lambda x: "".join(c for c in x if c.isdigit())
            assert pii.valid_digits("ssn", digits(v)) == pii.valid_digits("ssn", digits(there))
        if kind == "date":
            assert pii.read_date(there)[1] == pii.read_date(v)[1]


def test_dates_are_found_and_time_stamps_are_not():
    text = "born 1984-02-29 or 31.12.1999, not 30.02.1999; le 14 février 1950, May 4, 1999.\n2026-04-24 10:18:07 INFO 10.0.0.2"
    assert [text[a:b] for a, b, k in pii.find_pii(text, NAMES) if k == "date"] == ["1984-02-29", "31.12.1999", "14 février 1950", "May 4, 1999"]
    out = pii.redaction(text, NAMES, KEY)
    assert out.text.count("⟨DATE ") == 4 and [pii.pseudonym(n, k, KEY, back=True) for a, b, k, n in out.spans] == [text[a:b] for a, b, _, _ in out.spans]


def test_pii_tables(spark):
    s = spark.createDataFrame([("1", "blind", "Ada Holm, born 1984-02-29"), ("1", "blind", "Ada Holm, born 1984-02-29"), ("2", "blind", None), (None, "blind", ""), ("3", "labelled", "Ada Holm and Ada Holm"), ("4", "blind", "x" * 200_000)], "id string, split string, text string").withColumn("kind", F.lit("clash")).withColumn("starts", F.lit(1))
    a = spark.createDataFrame([("3", "Person", "Ada Holm"), ("3", " PERSON", "Ada Berg"), ("3", None, None)], "sample_id string, kind string, text string")
    assert [tuple(r) for r in pii.found(s, a, KEY).collect()] == [("1", 0, 8, "person")]
    assert pii.found(s.limit(0), a.limit(0), KEY).count() == 0
    done = pii.redacted_samples(s, NAMES, KEY).collect()
    assert sorted(r.spans for r in done) == [0, 0, 0, 2, 2, 2] and sum(r.redacted is None for r in done) == 1
    for bad in (b"", b"short", None):
        with pytest.raises(ValueError):
            pii.redactions(s, NAMES, bad)
    assert pii.session_key(spark) == pii.session_key(spark) and len(pii.session_key(spark)) == 32


# ---------------------------------------------------------------- 4 near duplicates
def brute(texts, width, sim):
    import re

    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    return {tuple(sorted(p)) for p in combinations(sets, 2) if sets[p[0]] and len(sets[p[0]] & sets[p[1]]) >= sim * len(sets[p[0]] | sets[p[1]]) - 1e-9}


@pytest.mark.parametrize("width,sim", [(3, 0.6), (5, 0.8)])
def test_similar_pairs_equal_brute_force(spark, width, sim):
    rng, words = random.Random(width), [f"w{i}" for i in range(60)]
    boiler = " ".join(words[:14])
    texts = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(8, 40))]
        for k in range(rng.randint(1, 3)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append((f"d{i:03d}_{k}", f"{boiler} {boiler if i % 3 else ''} " + " ".join(w)))
    texts += [("x1", "same words here again and more"), ("x2", "Same, words here AGAIN and_more!"), ("x3", "one two"), ("x4", ""), ("x5", None)]
    df = spark.createDataFrame([*texts, texts[0]], "id string, text string").withColumn("a", F.lit(1)).withColumn("cls", F.lit(2))
    want = brute(texts, width, sim)
    assert {tuple(r) for r in neardup.similar_pairs(df, width=width, similarity=sim).collect()} == want and want
    groups = {r.id: r.group_id for r in neardup.similar_groups(df, width=width, similarity=sim).collect()}
    assert len(groups) == len(texts) and all(groups[a] == groups[b] for a, b in want) and groups["x3"] == "x3"
    root = {i: i for i, _ in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in want:
        root[top(a)] = top(b)
    assert len({top(i) for i in root}) == len(set(groups.values()))


def met(reps, sim, frequent):
    names = {r.c: r.cls for r in reps.collect()}
    return sorted(tuple(sorted((names[r.a], names[r.b]))) for r in neardup.similar_classes(reps, sim, frequent).collect())


def test_frequent_combinations_lose_nothing(spark):
    texts = [(f"t{i:03d}", " ".join(f"a{(i * 7 + k) % 9}" if k % 4 else f"b{i % 12}" for k in range(30))) for i in range(80)]
    members, reps = neardup.classes(spark.createDataFrame(texts, "id string, text string"), "id", "text", 3)
    kept = {r.cls for r in reps.collect()}
    want = sorted(p for p in brute(texts, 3, 0.6) if set(p) <= kept)
    for f in (0, 3, 10**9):
        assert met(reps, 0.6, f) == want, f
    assert members.count() == 80


@pytest.mark.parametrize("sim", [0.6, 0.4])
def test_small_sets_of_frequent_shingles_are_met(spark, sim):
    rng = random.Random(8)
    texts = [("a", "w1 w2 w3 w4"), ("b", "w1 w2 w3 w4 w5"), ("c", "w1 w2 w3")] + [(f"t{i:02d}", " ".join(f"w{1 + (s + k) % 5}" for k in range(rng.randint(3, 8)))) for i, s in enumerate(rng.choices(range(4), k=40))]
    members, reps = neardup.classes(spark.createDataFrame(texts, "id string, text string"), "id", "text", 3)
    kept = {r.cls for r in reps.collect()}
    want = sorted(p for p in brute(texts, 3, sim) if set(p) <= kept)
    assert ("a", "b") in want
    for f in (0, 2):
        assert met(reps, sim, f) == want, f


def test_nothing_of_the_similarity_join_is_broadcast(spark):
    texts = [(f"t{i}", " ".join(f"w{(i + k * k) % 17}" for k in range(20))) for i in range(30)]
    _, reps = neardup.classes(spark.createDataFrame(texts, "id string, text string"), "id", "text", 3)
    for df in (neardup.ordered(reps, 0.6), neardup.similar_classes(reps, 0.6)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_keys_in_slices_lose_nothing_and_leave_no_shuffle_files(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SLICE_SETS", 10)
    places = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {p.name for d in places for p in Path(d).rglob("shuffle_*.data") if p.exists() and p.stat().st_size > 1_000}
    texts = [(f"t{i:03d}", " ".join(f"a{(i * 7 + k) % 9}" if k % 4 else f"b{i % 12}" for k in range(30)) + f" z{i}") for i in range(80)]
    _, reps = neardup.classes(spark.createDataFrame(texts, "id string, text string"), "id", "text", 3)
    names = {r.c: r.cls for r in reps.collect()}
    before = files()
    links = neardup.similar_classes(reps, 0.6)
    for _ in range(50):  # what is left are a few bytes of counts
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
    want = sorted(p for p in brute(texts, 3, 0.6) if set(p) <= set(names.values()))
    assert sorted(tuple(sorted((names[r.a], names[r.b]))) for r in links.collect()) == want and want


def test_hot_copies_get_a_representative(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FULL_PAIRS", 9)
    df = spark.createDataFrame([(f"c{i}", "one two three four five six") for i in range(6)], "id string, text string")
    assert {tuple(r) for r in neardup.similar_pairs(df).collect()} == {("c0", f"c{i}") for i in range(1, 6)}
    g = neardup.similar_groups(df).collect()
    assert {r.class_id for r in g} == {"c0"} and all(r.copies == 6 for r in g)
    assert neardup.similar_pairs(df.limit(0)).count() == 0


def test_large_groups_list_all_pairs_of_different_texts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FULL_PAIRS", 9)
    monkeypatch.setattr(neardup, "BLOCK", 3, raising=False)
    base = "one two three four five six seven eight nine ten eleven"
    texts = [(f"p{i:02d}", base.replace(" ", " " * (i + 1))) for i in range(12)] + [(f"q{i:02d}", base + " twelve" + "." * i) for i in range(11)]
    texts += [(f"r{i}", base.upper()) for i in range(7)]  # exact copies of one more
    want = {p for p in brute(texts, 3, 0.6) if not (p[0][0] == p[1][0] == "r" and p[0] != "r0")}
    got = [tuple(r) for r in neardup.similar_pairs(spark.createDataFrame(texts, "id string, text string"), width=3, similarity=0.6).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 400


# ---------------------------------------------------------------- 5 credentials
SECRETS = [
    ('db_password = "tree2001 $x"  # note', [("password", "tree2001 $x")]),
    ("app:\n  passwd: tree2001\n  port: 1", [("password", "tree2001")]),
    ("data:\n  password: " + base64.b64encode(b"tree2001").decode(), [("password", base64.b64encode(b"tree2001").decode())]),
    ("URL=postgres://u:p%40ss9@host:1/x", [("password", "p%40ss9")]),
    ("aws_access_key_id = AKIA" + "B2" * 8 + "\naws_secret_access_key = " + "a/" * 20, [("aws_access_key", "AKIA" + "B2" * 8), ("aws_secret_key", "a/" * 20)]),
    ('h = {"Authorization": "Bearer ' + "x1" * 12 + '"}', [("token", "x1" * 12)]),
    ("git clone https://u:ghp_" + "a1" * 18 + "@git.example/x", [("token", "ghp_" + "a1" * 18)]),
    ('{"apiKey": "' + "k3" * 12 + '", "n": 1}', [("api_key", "k3" * 12)]),
    ("mysql -h h -u u -p'tree 2001' db; curl -u me:tree2001 https://x", [("password", "tree 2001"), ("password", "tree2001")]),
    ("x: |\n  -----BEGIN EC PRIVATE KEY-----\n  abc=\n  -----END EC PRIVATE KEY-----\ny", [("private_key", "-----BEGIN EC PRIVATE KEY-----\n  abc=\n  -----END EC PRIVATE KEY-----")]),
    ("the password is tree2001. Use token npm_" + "a1" * 18 + " for it", [("password", "tree2001"), ("token", "npm_" + "a1" * 18)]),
    ("password: ${DB}\ndb_password: \"****\"\nAPI_KEY=<your-key-here>\nsecret_key: ⟨API_KEY_1⟩\nAuthorization: Bearer {{ token }}", []),
    ('password = getpass.getpass("db password: ")\nkey = os.environ["API_KEY"]\ntoken = vault.read("a/b")["token"]\ndef f(password: str, token: str = None): pass', []),
    ('cache_key = "a:b:c:1234567890"\nmax_tokens = 174553, pass: true\n"integrity": "sha512-' + "a" * 80 + '"\n-----BEGIN CERTIFICATE-----\nabc\n-----END CERTIFICATE-----', []),
]


V = "tree2001xQ"
PATHS = [
    f"<password>{V}</password>", f"<c><password><![CDATA[{V}]]></password></c>", f"password: |\n  {V}\nuser: x", f'{{"passwords": ["{V}", "{V}"]}}', f'password = """{V}"""', f"env:\n- name: DB_PASSWORD\n  value: {V}\n- name: HOST\n  value: db1234567",
    f'env:\n  - name: DB_PASSWORD\n    value: "{V}"', f"credentials:\n  value: {V}\n  name: bob", f'{{"name": "DB_PASSWORD", "value": "{V}"}}', f'[{{"value": "{V}", "name": "DB_PASSWORD"}}]', f'<add key="DbPassword" value="{V}"/>', f'<property name="password">{V}</property>',
    f'[database]\npassword = "{V}"', f"passwords:\n  - {V}\n  - {V}", f"set_password('{V}')", f"it's password = '{V}' there", f'define("DB_PASSWORD", "{V}")', f'x = {{"db": {{"passwords": {{"a": "{V}"}}}}}}',
]


@pytest.mark.parametrize("text", PATHS)
def test_secrets_of_key_paths(text):
    got = secrets.find_secrets(text)
    assert len(got) == text.count(V) and {(text[a:b], k) for a, b, k in got} == {(V, "password")}
    assert secrets.redact_secrets(text) == text.replace(V, "⟨PASSWORD⟩")


@pytest.mark.parametrize("text", ["private_key: /etc/ssl/key.pem", 'tokens: ["alpha", "beta"]', "password:\n  min_length: 12\n  value: 12", "secrets:\n  - db_password", '{"secrets": {"source": "vault1"}}'])
def test_paths_without_secrets(text):
    assert secrets.find_secrets(text) == []


def test_key_material_without_its_frame():
    text = "private_key: " + "9f8e7d6c5b4a3928" * 4
    assert secrets.find_secrets(text) == [(13, 77, "private_key")]


@settings(max_examples=150, deadline=None)
@given(st.text("ab1:='\"{}[](),<>/- \n|", max_size=60))
def test_settings_have_the_offsets_of_their_values(text):
    for path, value, a, b, _ in secrets.settings(text):
        assert text[a:b] == value and path
    assert secrets.redact_secrets(text, []) == text


@pytest.mark.parametrize("text,want", SECRETS)
def test_find_secrets(text, want):
    got = secrets.find_secrets(text)
    assert [(k, text[a:b]) for a, b, k in got] == want
    red, at = secrets.redact_secrets(text), 0
    for a, b, k in got:
        assert red.startswith(text[at:a]) and red[len(text[at:a]) :].startswith(f"⟨{k.upper()}⟩")
        red, at = red[len(text[at:a]) + len(k) + 2 :], b
    assert red == text[at:]


ALONE = [
    ("mysql -h h -u audit -p'U_CMk5 pjrmj $x' db", "U_CMk5 pjrmj $x"), ("curl -u me:tree2001 https.example", "tree2001"), ("sid=" + "x1" * 12, "x1" * 12), ("session_id: " + "x1" * 12, "x1" * 12), ('pat = "' + "x1" * 12 + '"', "x1" * 12),
    ("Basic\t" + base64.b64encode(b"me:tree2001").decode(), base64.b64encode(b"me:tree2001").decode()),
    *[(f"see {v} here", v) for v in ("ghp_" + "a1" * 18, "gho_" + "a1" * 18, "glpat-" + "a1" * 10, "npm_" + "a1" * 18, "pypi-" + "a1" * 18, "xoxb-" + "1" * 8 + "a2", "AIza" + "x1" * 18, "sk_live_" + "a1" * 12, "sk-" + "a1" * 12, "SG." + "a1" * 10 + "." + "b2" * 10, "SK" + "0a" * 16)],
    *[(f"see {v} here", v) for v in ("eyJ" + "a1" * 6 + ".eyJ" + "b2" * 6 + "." + "c3" * 8, *(p + "B2" * 8 for p in ("AGPA", "AIDA", "AROA", "AIPA", "ANPA", "ANVA")))],
]


@pytest.mark.parametrize("text,value", ALONE)
def test_a_secret_needs_no_other_word(text, value):
    assert [text[a:b] for a, b, _ in secrets.find_secrets(text)] == [value]


def test_secret_tables(spark):
    s = spark.createDataFrame([("1", "blind", "passwd: tree2001"), ("1", "blind", "passwd: tree2001"), (None, "blind", None), ("2", "blind", ""), ("3", "labelled", "passwd: tree2001"), ("4", "blind", "key " * 40_000)], "id string, split string, text string").withColumn("kind", F.lit(0))
    assert [tuple(r) for r in secrets.found(s).collect()] == [("1", 8, 16, "password")]
    assert secrets.redacted_samples(s).filter("redacted = 'passwd: ⟨PASSWORD⟩'").count() == 3 and secrets.found(s.limit(0)).count() == 0


# ---------------------------------------------------------------- 6, 7 tokens, packing, mixing
def test_token_counts_are_exact():
    c = tokens.counter()
    rng = random.Random(4)
    bits = ["word", "Über", "x1", " ", "  ", "\n", "\n    ", "\t", "'s", "...", "😀", " ", "日本", "\r\n", "\x0b"]
    for t in ["", " ", "a ", "\n \n", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(3000))]:
        assert c.count(t) == len(c.encode(t)), repr(t)
    assert c.count(None) == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=60))
def test_best_fit_and_its_bound(sizes):
    at = packing.best_fit_decreasing(np.array(sizes), 50)
    fill = np.bincount(at, weights=sizes)
    assert fill.max() <= 50 and packing.lower_bound(np.array(sizes), 50) <= len(fill)


def test_lower_bound_beats_the_volume():
    assert packing.lower_bound(np.array([26, 26, 26]), 50) == 3 and packing.lower_bound(np.array([17] * 5), 50) == 3


def test_packing(spark):
    rng = random.Random(6)
    sizes = [(i, rng.choice([0, 5, 9, 20, 33, 60, 99, 100, 101, 250, 300])) for i in range(3000)] + [(None, 7), (5, 5)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long")
    out = packing.pack_sizes(df, [(1, 100), (2, 1000), (3, 0)], per_partition=300).cache()
    for plan, cap in ((1, 100), (2, 1000)):
        rows = out.filter(F.col("plan_id") == plan)
        got = rows.groupBy("doc_id").agg(F.sum("size").alias("t")).collect()
        want = Counter()
        for i, n in sizes:
            want[i] += n
        assert {r.doc_id: r.t for r in got} == dict(want)
        assert rows.groupBy("container").agg(F.sum("size").alias("s")).filter(F.col("s") > cap).count() == 0
        s = packing.packing_summary(rows).first()
        assert 0 <= s.gap == s.containers - s.bound <= max(3, 0.02 * s.bound) and s.tokens == sum(n for _, n in sizes) <= s.bound * s.capacity and s.partitions >= s.optimal_partitions
        parts = rows.groupBy("part").agg(F.countDistinct("container").alias("n"), F.min("part_bins").alias("low"), F.max("part_bins").alias("high"), F.collect_list("size").alias("sizes"), F.max("part_bound").alias("bound")).collect()
        assert all(r.n == r.low == r.high and r.bound == packing.lower_bound(np.array(r.sizes), s.capacity) <= r.n for r in parts) and sum(r.n for r in parts) == s.containers
    assert {r.doc_id for r in packing.split_documents(out).collect()} == {i for i, n in sizes if n > 100}
    assert packing.pack_sizes(df.limit(0), [(1, 10)]).count() == 0 and packing.pack_sizes(df, []).count() == 0


def test_mixing(spark):
    rows = [(i, " Chat" if i % 2 else "chat", 10) for i in range(400)] + [(1000 + i, "wiki", 5) for i in range(20)] + [(2000, None, 999), (2001, " ", 999)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, tokens long").withColumn("source", mixing.fold_name(F.col("source"))).filter("source IS NOT NULL").cache()
    t = spark.createDataFrame([(1, "CHAT", 0.5, 1), (1, "wiki", 0.5, 3), (2, "chat", 0.25, 2), (2, "wiki", 0.05, 4), (2, "none", 0.7, 9), (3, "chat", None, None)], "mix_id int, source string, target_weight double, max_repeats int").withColumn("tokens", F.lit(1))
    rep = {(r.mix_id, r.source): r for r in mixing.mix_report(sizes, t).collect()}
    assert {k for k, r in rep.items() if r.short} == {(1, "wiki"), (2, "none")}
    assert rep[(1, "wiki")].tokens == 300 and rep[(1, "wiki")].most_copies == 3 and 2050 - 10 < rep[(1, "CHAT")].tokens <= 2050 and rep[(2, "wiki")].most_copies == 3
    empty = sizes.unionByName(spark.createDataFrame([(900 + i, "chat", 0) for i in range(5)], "doc_id long, source string, tokens long"))
    for repeats in (0, 1, 2):
        used = mixing.mix_from_sizes(empty, spark.createDataFrame([(7, "chat", 9.0, repeats, 1)], t.schema)).collect()
        assert max((r.copies for r in used), default=0) == repeats and sum(r.tokens * r.copies for r in used) == repeats * sum(r.tokens for r in sizes.filter("source = 'chat'").collect())
    m = mixing.mix_from_sizes(sizes, t)
    assert m.filter("mix_id = 2 AND target_source = 'wiki'").agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] == 205
    upto = [r.upto for r in mixing.prefix_sums(sizes).filter("source = 'chat'").orderBy("upto").collect()]
    assert upto == [10 * (i + 1) for i in range(400)]
    assert {tuple(r) for r in mixing.short_sources(sizes, t).collect()} == {(1, "wiki"), (2, "none")}
    assert mixing.short_sources(sizes.limit(0), t).count() == 0


# ---------------------------------------------------------------- 8 spam
def prose(n, rng):
    subject, verb, thing = ["The office", "A reviewer", "Our gateway", "The night shift", "Nobody"], ["moved", "checked", "forgot", "answered", "renewed"], ["the old ledger", "half of the mail", "a broken lamp", "the licence", "every second form"]
    return " ".join(f"{rng.choice(subject)} {rng.choice(verb)} {rng.choice(thing)} on day {rng.randint(1, 9999)} because {rng.choice(subject).lower()} {rng.choice(verb)} it." for _ in range(n))


def test_stuffed_pages(spark):
    rng = random.Random(8)
    key = lambda: " ".join(rng.choice(["cheap", "best", "buy", "free", "top"]) + " " + rng.choice(["amber sofa", "kelp watch"]) for _ in range(80))
    link = lambda: "\n".join(f"www.{rng.choice('abcdefgh')}{rng.randint(1, 99)}.example" for _ in range(60))
    logs = "\n".join(f"2026-04-{rng.randint(1, 28):02d} 10:{rng.randint(10, 59)}:07 INFO proxy: load ledger ok in {rng.randint(1, 999)} ms" for _ in range(30))
    code = "\n".join(f"value_{i} = load(x_{i}, 'y');" for i in range(40))
    gloss = "Glossary\n" + "\n".join(f"Term{i}: the shared record that the night office uses during the day." for i in range(25))
    stuffed = "Looking for amber sofa? Our amber sofa is the best amber sofa. " * 12
    rows = [(i, prose(12, rng), "en") for i in range(60)] + [(100, key(), "en"), (101, link(), None), (102, stuffed, "EN"), (103, logs, "en"), (104, code, "xx"), (105, gloss, "de"), (106, None, "en"), (107, "", None), (108, " \n", "en"), (109, prose(10, rng) + "\nTags: amber sofa, kelp", "fr"), (110, prose(3000, rng), "en"), (100, key(), "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("ratio", F.lit("x")).withColumn("step", F.lit(1))
    flagged = {r.doc_id: r for r in spam.redundant_pages(df).collect()}
    assert all(flagged[i].share < spam.FLAG for i in (100, 101, 102)) and flagged[102].share < spam.EXTREME and not set(flagged) & set(range(60))
    assert sorted(r.doc_id for r in spam.stuffed_pages(df).collect()) == [100, 101, 102]
    assert spam.stuffed_pages(df.limit(0)).count() == 0


def test_redundancy_decides_and_sentences_of_any_script_count():
    sparse = "Amber sofa, kelp watch, willow lamp, larch printer, otter chair"
    assert spam.confirmations(sparse, 0.5) == (True, 0.0) and spam.confirmations(sparse, 0.99) == (False, 0.0)
    for text in ("这是第一句话。这是第二句话。", "Это первое предложение. Это второе предложение.", "これは文です。"):
        assert len(spam._SENTENCE.findall(text)) >= 1 and spam.confirmations(text * 9, 0.3)[0] is False
    assert len(spam._SENTENCE.findall("a.b v1.2 3.5 x@y.example")) == 0


# ---------------------------------------------------------------- queries against SQL
@pytest.fixture(scope="module")
def duck():
    import os
    from pathlib import Path

    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = queries.queries()[name](spark, FOLDER)
    want = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    plain = lambda r, cols: tuple(round(r[cols.index(n)], 6) if isinstance(r[cols.index(n)], float) else r[cols.index(n)] for n in sorted(names))
    assert sorted((plain(tuple(r), got.columns) for r in got.collect()), key=repr) == sorted((plain(r, names) for r in want.fetchall()), key=repr)
