import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from veilspan import config
from veilspan.functions import noise, terms
from veilspan.operators import metrics, models, ner, pipeline
from veilspan.sources import io, workloads
from veilspan.streaming import restore as streams


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_entities_and_false_positives(spark):
    df = spark.createDataFrame([("Dear Anna Holm, see https://x.example today. Dr. Lisinopril",), (None,)], "text string")
    found = [[(s.kind, s.text) for s in r.s] for r in df.select(ner.entity_spans(F.col("text")).alias("s")).collect()]
    assert ("person", "Anna Holm") in found[0] and ("date_time", "today") in found[0] and found[1] == []
    kept = df.select(ner.without_false_positives(ner.entity_spans(F.col("text"))).alias("s")).first().s
    assert {s.text for s in kept} == {"Anna Holm", "https://x.example"}
    twice = lambda: lambda t: [(0, 4, "PERSON", 0.9), (0, 4, "LOCATION", 0.9), (0, 2, "CARDINAL", 0.9), (0, 3, "NRP", 0.4), (5, 9, "ODD", 0.5)]
    assert [(s.kind, s.start) for s in df.select(ner.entity_spans(F.col("text"), twice).alias("s")).first().s] == [("person", 0), ("odd", 5)]


@pytest.mark.parametrize(
    "raw,keep",
    [
        ('[{"span": 2, "verdict": "drop"}]', [True, False, True]), ('```json\n["KEEP", "KEEP", "DROP"]\n```', [True, True, False]), ("KEEP\nDROP it\nKEEP", [True, False, True]), ("garbage", [True] * 3),
        ('[{"span": 9, "verdict": "DROP"}, 5]', [True] * 3), ("", [True] * 3), ('{"span": 1}', [True] * 3),
    ],
)
def test_verdicts(spark, raw, keep):
    assert one(spark, ner.verdicts(F.lit(raw), F.lit(3))) == keep


def test_review_keeps_pattern_spans_and_survives_failure(spark):
    df = pipeline.with_spans(spark.createDataFrame([("Dear Anna Holm: a@x.example",)], "text string"), use_ner=True)
    seen = []
    drop = ner.with_review(df, "text", "spans", lambda p: '[{"span": 1, "verdict": "drop"}]' if "kind=person text=Anna Holm" in p else seen[0]).first().spans
    assert [s.kind for s in drop] == ["email"]

    def broken(prompt):
        raise OSError

    assert len(ner.with_review(df, "text", "spans", broken).first().spans) == 2


def test_noise(spark):
    text = "Please handle the important payload_x of bob@x.example in NASA v2 file.txt quickly,\nthen  rest"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")
    same = {r.id: r.n for r in df.select("id", noise.noised(F.col("text"), F.col("id"), 50.0).alias("n")).collect()}
    assert same[1].text == " ".join(text.split()) and same[1].substituted == 0 and same[1].words == len(text.split()) and same[2].text == ""
    all_ = {r.id: r.n for r in df.select("id", noise.noised(F.col("text"), F.col("id"), -50.0).alias("n")).collect()}
    words = all_[1].text.split()
    assert all(w in words for w in ("the", "payload_x", "bob@x.example", "NASA", "v2", "file.txt")) and words[0][0].isupper() and "Please" not in words
    many = spark.range(4000).select(noise.noised(F.lit("alpha bravo charlie"), F.col("id"), 1.0).alias("n")).agg(F.sum("n.substituted").alias("s"), F.sum("n.words").alias("w")).first()
    p = noise.substitution_probability(1.0)
    assert abs(many.s / many.w - p) < 4 * math.sqrt(p * (1 - p) / many.w)
    assert [len(v) for v in noise.POOLS.values()] == [35, 24, 24, 15] and len(set(noise.PRESERVED)) == 64


def test_terms(spark):
    t = one(spark, terms.technical_terms(F.lit("Python and python use a Docker API; SELECT the schema")))
    assert t == ["Python", "Docker", "API", "schema", "SELECT"]
    ok = one(spark, terms.survival(F.array(*map(F.lit, t)), F.lit("python DOCKER api schema")))
    assert ok.valid and ok.survival_rate == 0.8 and ok.dropped == ["SELECT"]
    assert one(spark, terms.survival(F.array().cast("array<string>"), F.lit("x"))).survival_rate == 1.0


def test_partial_leaks_equal_brute_force(spark):
    rng, rows = random.Random(3), []
    for i in range(400):
        a = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 9)))
        out = "".join(rng.choice("ab c") for _ in range(30))
        exact = a in out
        brute = any(len(w) >= 4 and w in out for w in a.split()) or any(a[i : i + k] in out for k in range(4, len(a)) for i in range(len(a) - k + 1))
        rows.append((i, a, out, not exact and brute))
    df = spark.createDataFrame(rows, "i int, a string, o string, want boolean")
    assert df.filter((~F.contains("o", "a") & metrics.survives_partly(F.col("a"), F.col("o"))) != F.col("want")).count() == 0


def test_options_and_metrics(spark):
    s = spark.createDataFrame([("s1", "wl1_pii", "Please mail Ann at ann@x.example"), ("s2", "wl1_pii", "line one\nSELECT a FROM b -- key EMP-12345"), ("s3", "wl1_pii", None)], "id string, workload string, text string")
    a = spark.createDataFrame([("s1", "email", "ann@x.example"), ("s1", "person", "Ann"), ("s2", "employee_id", "EMP-12345")], "sample_id string, kind string, text string")
    r = pipeline.runs(s).cache()
    got = {(x.sample_id, x.option_name): (x.label, x.outgoing) for x in r.collect()}
    assert len(got) == 2 * 12 and got[("s1", "baseline")][1] == "Please mail Ann at ann@x.example" and got[("s1", "B")][1] == "Please mail Ann at ⟨EMAIL_1⟩"
    assert got[("s1", "A")] == ("A(local)", "") and got[("s2", "A")][0] == "A(cloud)" and got[("s1", "B+C")] == ("B+C", "Kindly mail Ann at ⟨EMAIL_1⟩")
    assert all(got[("s1", o)][1] == "" for o in "EFG") and got[("s1", "D")][1] == got[("s1", "baseline")][1] and got[("s1", "B+H")][0] == "B+H(e=4)"
    leaks = metrics.annotation_leaks(r, a)
    by = {x.option_name: x for x in metrics.leak_summary(leaks).collect()}
    assert by["baseline"].exact_leak_rate == 1.0 and by["B"].exact_leaks == 1 and by["E"].combined_leak_rate == 0.0
    fp = {x.option_name: x.false_positive_rate for x in metrics.false_positive_rate(r, a).collect()}
    assert fp["B"] == 0.0
    rep = metrics.eval_report(leaks, metrics.false_positive_rate(r, a))
    assert rep.count() == 12 and metrics.option_matrix(rep, ["wl1_pii", "wl2_secrets"]).filter("wl2_secrets = 0").count() == 12
    cost = {x.option_name: x for x in metrics.token_cost(r).collect()}
    assert cost["E"].outgoing_tokens == 0 and cost["baseline"].delta == 0 and cost["E"].mean_delta_pct == -100.0
    with pytest.raises(ValueError):
        pipeline.runs(s, ["Z"])


def test_stubs(spark):
    assert one(spark, pipeline.split_activation(F.lit("é😀"))).token_ids == [233, 128512]
    assert one(spark, pipeline.split_activation(F.lit(""))).activation_shape == [0, 4096]
    f = one(spark, pipeline.fhe_score(F.lit("x" * 96)))
    assert f.sensitive and f.confidence == round(96 / 97, 3)
    shares = one(spark, pipeline.mpc_shares(F.lit("aé😀"), 4))
    assert [sum(s) % 32000 for s in shares] == [ord(c) % 32000 for c in "aé😀"] and all(0 <= v < 32000 for s in shares for v in s)
    assert not one(spark, pipeline.attested(F.lit(""), F.create_map(F.lit("a"), F.lit("b")))) and one(spark, pipeline.attested(F.lit("e"), F.create_map(F.lit("a"), F.lit("b"))))
    assert [one(spark, models.decision(F.lit(x))) for x in ("DECISION: trivial", "no idea", None)] == ["TRIVIAL", "COMPLEX", "COMPLEX"]
    assert one(spark, models.forwarded_headers(F.create_map(F.lit("Host"), F.lit("h"), F.lit("X-A"), F.lit("1")))) == {"X-A": "1"}


@pytest.mark.parametrize("n", [1, 2, 4, 20, 100])
def test_index_percentiles(spark, n):
    v = [float((i * 37) % 101) for i in range(n)]
    df = spark.createDataFrame([("g", x) for x in v] + [("g", None), ("g", float("nan"))], "g string, v double")
    r = metrics.index_percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (r.n, r.p50, r.p95) == (n, sorted(v)[n // 2], sorted(v)[min(int(n * 0.95), n - 1)])


def test_utility(spark):
    assert one(spark, metrics.self_consistent(F.lit(""), F.lit("x"))) and one(spark, metrics.self_consistent(F.lit("a b c"), F.lit("a b c d"))) and not one(spark, metrics.self_consistent(F.lit("a b"), F.lit("a c")))
    assert one(spark, metrics.preference(F.lit('{"preference": "Baseline", "score": 2}'))).preference == "baseline"
    bad = one(spark, metrics.preference(F.lit("??")))
    assert (bad.preference, bad.score) == ("tie", 0.0)
    u = metrics.utility_summary(spark.createDataFrame([("w", "tie", 0.5, True), ("w", "baseline", 1.0, None)], "w string, preference string, score double, consistent boolean"), ["w"]).first()
    assert (u.samples, u.tie, u.baseline, u.mean_score, u.consistency, u.baseline_preferred_pct) == (2, 1, 1, 0.75, 1.0, 50.0)


def test_hook(spark):
    assert one(spark, metrics.hook_findings(F.lit("mail A@X.EXAMPLE password = longenough"))) == ["Email address detected", "API key or secret in assignment"]
    payload = json.dumps({"tool_input": {"a": "x", "edits": [{"new": "900-12-3456"}]}})
    assert one(spark, metrics.hook_findings(metrics.tool_input_text(F.lit(payload)))) == ["SSN pattern detected"]
    assert one(spark, metrics.tool_input_text(F.lit("not json"))) == "" and one(spark, metrics.tool_input_text(F.lit('{"tool_input": "plain"}'))) == "plain"
    mixed = json.dumps({"tool_input": {"a": "x", "n": 4111111111111111, "o": {"deep": "y"}, "l": ["z", {"k": "v", "m": 5, "d": {"e": "f"}}]}})
    assert sorted(one(spark, metrics.tool_input_text(F.lit(mixed))).split("\n")) == ["v", "x"]


def test_workloads_and_sinks(spark, tmp_path):
    assert [len(workloads.TEMPLATES[w]) for w in ("wl1_pii", "wl4_code")] == [18, 11] and len(workloads.TEMPLATES["wl3_implicit"]) * 3 == 21
    for w, (n, _) in workloads.SIZES.items():
        df = workloads.generate(spark, w)
        assert df.count() == n and io.violations(df).count() == 0
    df = workloads.generate(spark, "wl1_pii", 20)
    assert sorted(df.collect()) == sorted(workloads.generate(spark, "wl1_pii", 20).collect())
    io.write_samples(df, str(tmp_path / "s"))
    assert sorted(io.read_samples(spark, str(tmp_path / "s")).select("id").collect()) == sorted(df.select("id").collect())
    with pytest.raises(ValueError):
        io.write_samples(df.withColumn("text", F.lit("other")), str(tmp_path / "t"))
    io.publish({"a": df, "b": df}, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).groupBy("workload").count().count() == 2


def test_reports(spark, tmp_path):
    rep = spark.createDataFrame([("B", "wl1_pii", 2, 3, 0.5, 0.25, 0.75, 0.1, None, 12.3456, None)], "option_name string, workload string, num_samples int, total_annotations int, exact_leak_rate double, partial_leak_rate double, combined_leak_rate double, false_positive_rate double, quality_delta double, latency_ms_median double, latency_ms_p95 double")
    row = io.csv_rows(rep).first()
    assert (row.exact_leak_rate, row.quality_delta, row.latency_ms_median, row.latency_ms_p95) == ("0.500000", "", "12.346", "")
    assert io.table_lines(rep, "latex").first().line == r"  B & wl1_pii & 2 & 0.500 & 0.250 & 0.750 & 0.100 & --- & 12.3 \\"
    kinds = spark.createDataFrame([("email", 0.5), ("ssn", 1.0), ("ip", 0.5)], "kind string, rate double")
    io.write_report(rep, kinds, str(tmp_path / "r"))
    back = io.parse_breakdown(spark, str(tmp_path / "r/leak_by_kind.md"))
    assert [(r.kind, r.rate) for r in back.collect()] == [("ssn", 1.0), ("email", 0.5), ("ip", 0.5)]
    assert io.read_csv(spark, str(tmp_path / "r/report_csv")).count() == 1 and io.read_csv(spark, str(tmp_path / "missing*")) is None
    lines = [('{"model":"m","messages":[{"role":"user","content":"x"}],"tools":[{"type":"function"}]}',), ('{"messages":[{"role":"user","content":[{"type":"text","text":"y"},{"type":"image"},{"type":"text","text":"z"}]}]}',), ("broken",)]
    bodies = io.request_bodies(spark.createDataFrame(lines, "value string"))
    got = bodies.select(io.message_text(F.col("body.messages")[0]).alias("t"), F.size("body.tools").alias("n"), F.col("body").isNull().alias("gone")).collect()
    assert [r.t for r in got] == ["x", "y\nz", None] and got[0].n == 1 and [r.gone for r in got] == [False, False, True]


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"pipeline": {"epsilon": 2.5, "odd": 1}, "requests": 7, "policy": {"categories": ["pii"]}}')
    c = config.load(tmp_path / "c.json", {"VEILSPAN_REQUESTS_SESSION_CAP": "5", "VEILSPAN_PIPELINE_STRICT": "no"})
    assert (c.pipeline.epsilon, c.requests.session_cap, c.policy.categories, c.pipeline.strict) == (2.5, 5, ("pii",), False)
    assert config.load(tmp_path / "none.json", {}) == config.Config() and config.custom_patterns(None) == {}
    (tmp_path / "p.json").write_text('{"patterns": {"ticket": "T-(\\\\d+)"}, "other": 1}')
    assert config.custom_patterns(tmp_path / "p.json") == {"ticket": r"T-(\d+)"}
    (tmp_path / "q.json").write_text('{"patterns": ["x"]}')
    assert config.custom_patterns(tmp_path / "q.json") == {}


def test_holding_back_at_every_cut():
    text, entries = "notified ⟨EMAIL_1⟩ today ⟨X", [("⟨EMAIL_1⟩", "a@x.example")]
    for i in range(len(text) + 1):
        kept, out = "", ""
        for n, d in enumerate((text[:i], text[i:])):
            piece, kept = streams.hold_back(kept, d, n == 1)
            out += streams.replace_all(piece, entries)
        assert out == "notified a@x.example today ⟨X"


def test_stream_restores_split_placeholders(spark, tmp_path):
    schema = "request_id string, choice int, seq bigint, delta string, last boolean, reverse_map array<struct<placeholder:string,original:string>>"
    m = [("⟨EMAIL_1⟩", "a@x.example")]
    for k, rows in enumerate([[("r", 0, 1, "to ⟨EMA", False, m), ("r", 1, 1, "⟨EM", False, m)], [("r", 0, 2, "IL_1⟩.", True, m), ("r", 1, 2, "AIL_1⟩", True, m)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        del k
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = streams.restore_stream(stream).writeStream.format("memory").queryName("restored").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {}
    for r in spark.table("restored").orderBy("choice", "seq").collect():
        got[r.choice] = got.get(r.choice, "") + r.delta
    assert got == {0: "to a@x.example.", 1: "a@x.example"}


def test_events_and_sessions(spark):
    e = spark.createDataFrame([("data: [DONE]",), (": ping",), ('data: {"choices":[{"index":1,"delta":{"content":"x"}}]}',), ("data: {bad",)], "value string")
    rows = {r.value: r for r in streams.parse_events(e).collect()}
    assert rows["data: [DONE]"].done and rows[": ping"].passed_through and rows["data: {bad"].passed_through
    assert [(r.choice, r.delta) for v, r in rows.items() if "index" in v] == [(1, "x")]
    s = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", 3)], "session_id string, created_at int")
    assert {r.session_id for r in streams.live_sessions(s, 2).collect()} == {"d", "b"}
    m = s.withColumn("reverse_map", F.array(F.struct(F.lit("⟨P_1⟩").alias("placeholder"), F.lit("x").alias("original"))))
    done, left = streams.restore_session(spark.createDataFrame([("a", "⟨P_1⟩"), ("z", "⟨P_1⟩")], "session_id string, text string"), m)
    back = {r.session_id: r for r in done.collect()}
    assert back["a"].text == "x" and back["z"].text == "⟨P_1⟩" and back["z"].error and {r.session_id for r in left.collect()} == {"b", "c", "d"}
    block = spark.createDataFrame([('data: {"type":"content_block_delta","index":2,"delta":{"type":"text_delta","text":"y"}}',), ('data: {"type":"message_stop"}',)], "value string")
    assert sorted((r.choice, r.delta, r.done) for r in streams.parse_events(block).collect()) == sorted([(2, "y", False), (0, None, True)], key=str) or [(r.choice, r.delta, r.done) for r in streams.parse_events(block).collect()] == [(2, "y", False), (0, None, True)]


@pytest.mark.parametrize("ranked", [0, 10_000])
def test_live_sessions_equal_sorting(spark, monkeypatch, ranked):
    monkeypatch.setattr(streams, "RANKED", ranked)
    rng = random.Random(6)
    rows = [(f"s{i}", rng.choice(["a", "b", None]), rng.choice([5, 5, 7, rng.randrange(10**9)])) for i in range(300)] + [("n", "a", None)]
    df = spark.createDataFrame(rows, "session_id string, g string, created_at long")
    digest = lambda i: hashlib.md5(i.encode()).hexdigest()
    for cap in (1, 40, 1000):
        want = set()
        for g in ("a", "b", None):
            mine = sorted((r for r in rows if r[1] == g and r[2] is not None), key=lambda r: (r[2], digest(r[0])), reverse=True)
            want |= {r[0] for r in mine[:cap]}
        assert {r.session_id for r in streams.live_sessions(df, cap, ["g"]).collect()} == want
    assert streams.live_sessions(df.limit(0), 5).count() == 0


def test_routing_counters_and_choices(spark):
    df = spark.createDataFrame([("1", "short a@x.example"), ("2", "two\nlines"), ("3", None)], "id string, text string")
    done, rest = pipeline.routed(df, "text", models.short_is_trivial, lambda t: t.upper())
    assert [(r.id, r.response) for r in done.collect()] == [("1", "SHORT A@X.EXAMPLE")] and {r.id for r in rest.collect()} == {"2", "3"}
    seen, o = pipeline.counted(pipeline.with_spans(df))
    seen.collect()
    assert o.get == {"texts": 3, "spans": 1, "uncertain": 0}
    sent, refused = pipeline.redact_pipeline(df, model=lambda t: "re: " + t)
    r = {x.id: x for x in sent.collect()}
    assert r["1"].redacted == "short ⟨EMAIL_1⟩" and r["1"].response == "re: short ⟨EMAIL_1⟩" and r["1"].restored == "re: short a@x.example" and refused.count() == 0
    plain = spark.createDataFrame([([(0, r["1"].response), (1, "no")], r["1"].reverse_map)], "c array<struct<index:int,content:string>>, m array<struct<placeholder:string,original:string,kind:string>>")
    back = plain.select(pipeline.restore_choices(F.col("c"), F.col("m")).alias("c")).first().c
    assert [x.content for x in back] == ["re: short a@x.example", "no"]


def test_online_options(spark):
    df = spark.createDataFrame([("1", "user", "Please mail a@x.example"), ("2", "system", "Please mail b@x.example"), ("3", "user", "line\nPlease use Docker Kubernetes")], "id string, role string, text string")
    told = lambda t: f"re: {t}"
    c = {r.id: r for r in pipeline.online(df, "B+C", told, role="role", rephraser=lambda t: t.replace("Please", "Kindly").replace("Docker Kubernetes", "containers"))[0].collect()}
    assert c["1"].outgoing == "Kindly mail ⟨EMAIL_1⟩" and c["1"].restored == "re: Kindly mail a@x.example" and c["1"].leak_audit.sent == 0
    assert c["2"].outgoing == "Please mail ⟨EMAIL_1⟩" and c["3"].label == "B(C-rejected)" and c["3"].outgoing.endswith("Docker Kubernetes")
    ab = {r.id: r for r in pipeline.online(df, "A+B", told, local=lambda t: "local")[0].collect()}
    assert (ab["1"].response, ab["1"].outgoing, ab["3"].label) == ("local", "", "A+B(cloud)") and ab["1"].leak_audit.outgoing_bytes == 0

    def broken(prompt):
        raise OSError("down")

    failed = pipeline.online(df, "B", broken, threads=3, retries=1)[0].collect()
    assert all(r.response is None and r.restored is None and r.response_error == "OSError: down" for r in failed)
    sent, refused = pipeline.online(df, "D", told, enclave=(F.when(F.col("id") != "2", F.col("id")), F.create_map(F.lit("p"), F.lit("q"))))
    assert {r.id for r in sent.collect()} == {"1", "3"} and [(r.id, r.refusal) for r in refused.collect()] == [("2", "enclave not attested")]
    assert pipeline.online(df, "D", told)[0].count() == 0
    with pytest.raises(ValueError):
        pipeline.online(df, "E", told)


def test_samples_with_many_annotations_are_split(spark, monkeypatch):
    monkeypatch.setattr(metrics, "PER_ROW", 3)
    s = spark.createDataFrame([("s1", "w", " ".join(f"value{i}" for i in range(20))), ("s2", "w", "none")], "id string, workload string, text string")
    a = spark.createDataFrame([("s1", "k", f"value{i % 25}") for i in range(50)] + [("s1", None, None), ("s3", "k", "x")], "sample_id string, kind string, text string")
    marked = metrics.with_marks(s, a)
    assert marked.count() > 5
    r = metrics.leak_summary(metrics.marked_leaks(pipeline.runs(marked, ("baseline",), carry=("marks",)))).collect()
    assert [(x.total_annotations, x.exact_leaks) for x in r] == [(50, 40)]
    again = metrics.leak_summary(metrics.annotation_leaks(pipeline.runs(s, ("baseline",)), a)).first()
    assert (again.total_annotations, again.exact_leaks) == (50, 40)


def test_pareto(spark):
    rows = [("a", 0.1, 5.0), ("b", 0.2, 5.0), ("c", 0.05, 9.0), ("d", 0.1, 9.0), ("e", 0.1, 5.0)]
    d = io.figure_data(spark.createDataFrame(rows, "option_name string, combined_leak_rate double, latency_ms_median double"))
    assert {r.option_name: r.dominated for r in d.collect()} == {"a": False, "b": True, "c": False, "d": True, "e": False}


def test_entry_sends_the_package_where_workers_lack_it(spark, monkeypatch, tmp_path):
    import __spark_entry__ as entry

    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("PYTHONPATH", "")
    run = entry._with_package(lambda s, d: s.range(1))
    assert run(spark, "").count() == 1 and spark.conf.get("spark.veilspan.sent") == "yes"
