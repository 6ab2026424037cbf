import random

import pytest
from pyspark.sql import functions as F

from sievewright.functions.text import tokens
from sievewright.models.clients import HttpClient, OfflineClient, load, responses
from sievewright.operators import chunking, dedup, joins, planning, questions, sampling, units
from sievewright.plans import loop
from sievewright.sources import files, html
from sievewright.streaming import rounds


def docs(spark, *counts):
    return spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(n))) for i, n in enumerate(counts)], "doc_id long, text string")


def test_chunks_cover_every_token_and_keep_inner_tails(spark):
    out = chunking.token_chunks(docs(spark, 0, 1, 10, 11, 14), 10, 4).orderBy("doc_id", "chunk_index").collect()
    sizes = {}
    for r in out:
        sizes.setdefault(r["doc_id"], []).append(r["n_tokens"])
    assert sizes == {1: [1], 2: [10, 4], 3: [10, 5], 4: [10, 8, 2]}
    assert out[0]["chunk_id"] == "1::chunk_0000"


def test_recursive_split():
    text = "aa bb.\n\ncc dd. " + "e" * 30 + ", ff. gg"
    parts = chunking.split_recursively(text, 12, 3)
    assert all(parts) and "".join("".join(parts).split()).replace(".", "").replace(",", "").startswith("aabb")
    assert chunking.split_recursively("", 10, 2) == []
    assert all(len(p) <= 12 for p in chunking.split_recursively("x" * 100, 12, 3))


def test_multi_text_numbers_run_on(spark):
    df = spark.createDataFrame([(1, ["a b c", "d e"])], "doc_id long, texts array<string>")
    got = chunking.multi_text_chunks(df, "texts", 2).orderBy("chunk_index").select("chunk_index", "text").collect()
    assert [tuple(r) for r in got] == [(0, "a b"), (1, "c"), (2, "d e")]


def test_windows_and_combos_do_not_depend_on_partitions(spark):
    c = chunking.token_chunks(docs(spark, 40, 25, 7, 60), 10, 0)
    results = []
    for n in (1, 4, 16):
        w = units.windows(c.repartition(n)).select("doc_id", "size", "first_index").collect()
        m = units.multihop_combos(c.repartition(n)).collect()
        results.append((sorted(map(tuple, w)), sorted(map(str, m))))
    assert results[0] == results[1] == results[2]
    assert sum(1 for r in results[0][0] if r[0] == 0) == 3 + 2


def pool(spark, n=30):
    return spark.range(n).select(F.lit("t").alias("topic"), F.col("id").cast("string").alias("unit_id"), F.when(F.col("id") % 3 == 0, "multi").otherwise("single").alias("unit_type"), (F.col("id") % 5 / 5).alias("mcq_score"), (F.col("id") % 7 / 7).alias("qa_score"), (F.col("id") % 4 / 4).alias("hard_score"), F.lit(0).alias("usage_count"), F.lit("A text. More.").alias("text"))


def test_weighted_samples(spark):
    p = pool(spark)
    a = sampling.weighted_sample(p, sampling.broad_weight("qa", "hard"), 5)
    assert a.count() == 5 and a.select("unit_id").distinct().count() == 5
    assert sorted(r["unit_id"] for r in a.collect()) == sorted(r["unit_id"] for r in sampling.weighted_sample(p.repartition(7), sampling.broad_weight("qa", "hard"), 5).collect())
    assert sampling.weighted_sample(p, F.lit(0.0), 5).count() == 5
    some = sampling.weighted_sample(p, F.when(F.col("unit_id") == "3", 1.0).otherwise(0.0), 3).orderBy("rank").collect()
    assert some[0]["unit_id"] == "3" and len(some) == 3
    assert sampling.weighted_sample(p, F.lit(1.0), 99).count() == 30
    mixed = sampling.with_multi_share(a.where("unit_type = 'single'"), p)
    assert mixed.where("unit_type = 'multi'").count() >= 1 and mixed.count() == a.where("unit_type = 'single'").count()


def test_apportionment_and_dealing(spark):
    plan = spark.createDataFrame([("m", 12, "easy", 0.25, 0), ("m", 12, "medium", 0.5, 1), ("m", 12, "hard", 0.25, 2), ("q", 6, "easy", 0.33, 3), ("q", 6, "medium", 0.34, 4), ("q", 6, "hard", 0.33, 5)], "mode string, count int, difficulty string, ratio double, pos int")
    got = planning.apportioned(plan).orderBy("pos").select("target").collect()
    assert [r[0] for r in got] == [3, 6, 3, 2, 2, 2]
    topics = spark.createDataFrame([("a", 0), ("b", 1)], "topic string, pos int")
    dealt = planning.topic_targets(planning.apportioned(plan), topics)
    assert {r["topic"]: r["n"] for r in dealt.groupBy("topic").agg(F.sum("target").alias("n")).collect()} == {"a": 10, "b": 8}


def test_gaps_of_the_worked_example(spark):
    t = spark.createDataFrame([("t", k, 5, i) for i, k in enumerate(("qa:easy", "qa:medium", "qa:hard"))], "topic string, key string, target int, pos int")
    done = spark.createDataFrame([("t", "qa:easy", 3), ("t", "qa:medium", 2), ("t", "qa:hard", 1)], "topic string, key string, n int")
    g = planning.remaining(t, done)
    assert tuple(planning.main_gap(g).first()) == ("t", "qa:hard", 4)
    assert abs(planning.coverage(g).first()["coverage"] - 0.4) < 1e-12
    assert "6/15 (40.0%)" in planning.coverage_summary(g).first()["summary"]
    assert planning.completion(g).first()["is_complete"] is False


def test_loop_guard_of_the_worked_example(spark):
    r = spark.createDataFrame([("t", 1, 10, 0.5), ("t", 2, 10, 0.5), ("t", 3, 10, 0.5), ("u", 1, 10, 0.1), ("u", 2, 8, 0.3), ("u", 3, 7, 0.4)], "topic string, round int, gap int, cov double")
    got = {(x["topic"], x["round"]): (x["is_stuck"], x["last_progress"]) for x in planning.loop_guard(r, "topic", "round", "gap", "cov").collect()}
    assert got["t", 3] == (True, 0) and got["t", 2] == (False, 0) and got["u", 3] == (False, 3)


def test_parameters():
    assert planning.check_parameters({"a": True}, {"a": "integer", "b": "string"}) == ["missing: b"]


def test_strict_filter_rejects_letters(spark):
    row = ("What is it about?", "B", "multiple_choice", "5", ["a", "b", "c", "d"], ["t"], "factual")
    df = spark.createDataFrame([row], "question string, answer string, question_mode string, estimated_difficulty string, choices array<string>, citations array<string>, question_type string")
    assert df.select(questions.reject_reason()).first()[0] is None
    assert df.select(questions.reject_reason(strict_compat=True)).first()[0] == "short_answer"
    assert questions.partitioned(df)[0].count() == 1


def test_parsing():
    q = '{"question": "a", "citations": [{"text": "]"}]}'
    for text in (f"[{q}]", f'{{"items": [{q}]}}', q, f"so ```json\n[{q}]\n``` end", f"<output_json>[{q}]</output_json>", f"[{q}, {{\"question\": "):
        assert [x["question"] for x in questions.parse_response(text)] == ["a"], text
    assert questions.parse_response("garbage [1, 2") == [] and questions.parse_response(None) == []
    assert questions.python_blocks("```python\n[{'a': 1}, ...]\n```") != [] and questions.python_blocks("```\n[{'a': 1},\n{'b'") == [{"a": 1}]


def test_near_duplicates_against_brute_force(spark):
    import random

    r = random.Random(1)
    base = [[r.choice("abcdefgh") + str(r.randint(0, 30)) for _ in range(60)] for _ in range(12)]
    texts = [" ".join(b) for b in base] + [" ".join(b[:50] + b[51:]) for b in base] + [" ".join(b[2:]) for b in base] + ["same text here"] * 3 + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(x["a"], x["b"]) for x in dedup.near_duplicates(df, "id", "text").collect()}

    def sh(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [sh(t) for t in texts]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[i] != sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    assert got == want and want


def test_model_errors_become_rows(spark):
    class Broken:
        name = "broken"

        def complete(self, prompts):
            raise OSError("down")

    p = spark.createDataFrame([(1, "Say. This"), (2, None)], "id long, prompt string")
    assert responses(p, Broken()).where("error IS NULL").count() == 0
    good = responses(p, OfflineClient()).collect()
    assert all(questions.parse_response(r["text"]) for r in good) and len({r["call_id"] for r in good}) == 2
    assert isinstance(load({"kind": "http", "name": "m", "url": "u"}), HttpClient)


def test_round_loop_meets_its_targets(spark, tmp_path):
    t = spark.createDataFrame([("t", "qa:easy", 2, 0), ("t", "qa:hard", 1, 1)], "topic string, key string, target int, pos int")
    gaps = loop.run(pool(spark), t, OfflineClient(), str(tmp_path), max_rounds=3)
    assert gaps.agg(F.sum("remaining")).first()[0] == 0


def test_rounds_again_change_nothing(spark, tmp_path):
    """All topics and keys are one plan a round; a round that runs again replaces its rows, and no topic gets more than its target."""
    names = [f"t{k}" for k in range(4)]
    one = pool(spark).drop("topic")
    units = one.crossJoin(spark.createDataFrame([(n,) for n in names], "topic string")).withColumn("unit_id", F.concat("topic", F.lit("-"), "unit_id"))
    targets = spark.createDataFrame([(n, key, k + 1, p) for k, n in enumerate(names) for p, key in enumerate(["qa:easy", "qa:hard", "qa:medium"])] + [("no units", "qa:easy", 3, 0)], "topic string, key string, target int, pos int")
    folder = str(tmp_path / "run")
    loop.run(units, targets, OfflineClient(), folder, max_rounds=2)
    state = lambda: [sorted(map(tuple, loop.stored(spark, folder, n).collect()), key=repr) for n in ("accepted", "used", "done")]
    before = state()
    assert [r[-1] for r in before[2]] == [1, 2] and {r[1] for r in before[0] if r[4] == 1} == {"qa:hard"}
    assert loop.play(units, targets, OfflineClient(), folder, 2) and state() == before
    left = loop.run(units, targets, OfflineClient(), folder, max_rounds=4)
    assert left.where("completed > target").count() == 0 and left.where("topic = 'no units'").first()["remaining"] == 3
    assert left.where("topic <> 'no units' AND remaining > 0").count() == 0


def test_html(spark):
    page = "<h1>T <b>x</b></h1><article><p>one[3]<p class=a>two &amp; more<div>no</div></p><p> </p></article>"
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    got = {r["page_id"]: r for r in html.extracted(df).collect()}
    assert got[1]["title"] == "T x" and got[1]["content"] == "one\ntwo &amp; more" and got[2]["status"] == "failed"
    assert html.sections_of("<h2>A</h2><p>" + "w " * 25 + "end. more</p><h2>References</h2><p>" + "w " * 30 + ".</p>") == ["#Subheading:A", "w " * 25 + "end. more."]
    assert html.repaired("caf\\u00c3\\u00a9") == "café" and html.repaired("\\") == ""


def test_files(spark, tmp_path):
    (tmp_path / "d/e").mkdir(parents=True)
    (tmp_path / "d/a.md").write_text(" text \nof two lines\n")
    (tmp_path / "d/e/b.txt").write_text("more")
    (tmp_path / "d/c.txt").write_text("  ")
    assert files.local_documents(spark, str(tmp_path / "d")).count() == 2
    schema = "call_id string, error string"
    assert files.read_jsonl(spark, str(tmp_path / "none"), schema).count() == 0
    calls = spark.createDataFrame([("x", None), ("y", "bad")], schema)
    files.append_jsonl(calls, str(tmp_path / "log"))
    assert [r["call_id"] for r in files.pending(calls, str(tmp_path / "log"), schema).collect()] == ["y"]
    assert files.config('{"a": "${NO_SUCH:7}"}', {}) == {"a": "7"}


def test_subcategories(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "x")], "category string, parent_category string")
    assert {tuple(r) for r in joins.subcategories(spark, e, "a").collect()} == {("b", 1), ("c", 2)}


def test_stream_equals_batch(spark, tmp_path):
    from tests.conftest import SF

    batch = spark.read.parquet(f"{SF}/events.parquet")
    log = rounds.read_log(spark, SF, batch.schema, "events.parquet")
    q = rounds.to_ledger(rounds.windowed_counts(log, late="0 seconds"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    days = batch.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("m")).select(F.col("w.start").alias("start"), "event_type", "m")
    joined = got.join(days, ["start", "event_type"])
    assert got.count() > 0 and joined.where("n = m").count() == got.count()


def test_tokens_of_null(spark):
    assert spark.createDataFrame([(None,), ("a  b",)], "t string").select(F.size(F.coalesce(tokens(F.col("t")), F.array()))).collect()[1][0] == 2


def brute_split(text, size, overlap):
    """split_recursively() from its definition: all cuts by recursion, then the farthest end for each beginning."""

    def cuts(start, end, seps):
        if end - start <= size:
            return [end]
        if not seps:
            return list(range(start + 1, end + 1))
        ends, at = [], start
        for i in range(start, end):
            if i >= at and text.startswith(seps[0], i) and i + len(seps[0]) <= end:
                at = i + len(seps[0])
                ends.append(at)
        ends = sorted({*ends, end})
        return [c for a, b in zip([start, *ends], ends) for c in cuts(a, b, seps[1:])]

    allowed = [0, *cuts(0, len(text), ["\n\n", "\n", ".", ","])]
    out, start = [], 0
    while True:
        end = max(c for c in allowed if c - start <= size)
        out.append(text[start:end])
        if end == len(text):
            return [c for c in out if c.strip()]
        following = min(c for c in allowed if c > end)
        start = min(c for c in allowed if c == end or (c <= end and end - c <= overlap and following - c <= size))


def test_recursive_chunks_against_brute_force(spark):
    import random

    from sievewright.operators import chunking

    r = random.Random(3)
    texts = ["", " \n", "abc", "a" * 50, *("".join(r.choice(["ab", "c d", ".", ",", "\n", "\n\n", " ", "eeeeeeeeeeeeeeeeeeeeee"]) for _ in range(r.randint(0, 60))) for _ in range(300))]
    for t in texts:
        for size, overlap in ((20, 5), (7, 0), (30, 29)):
            got = chunking.split_recursively(t, size, overlap)
            assert got == brute_split(t, size, overlap) and all(len(c) <= size and c in t for c in got)
    rows = chunking.recursive_chunks(spark.createDataFrame(list(enumerate(texts[:20])), "doc_id long, text string"), 20, 5).collect()
    assert [(x["doc_id"], x["chunk_index"], x["text"]) for x in rows] == [(i, k, c) for i, t in enumerate(texts[:20]) for k, c in enumerate(brute_split(t, 20, 5))]


def test_html_sections(spark):
    from sievewright.sources import html

    long = "word " * 25
    page = f"<h2>History</h2><p>{long}ends here</p><p>{long}why. Why?</p><p>{long}so. Yes!</p><p>too short. yes.</p><h3>Notes on rivers</h3><ul><li>{long}one. two</li></ul><h2>References and notes</h2><p>{long}gone. x</p><h2>More</h2>"
    text = long.strip()
    want = ["#Subheading:History", f"{text} why. Why?", f"{text} so. Yes!", "##Subheading:Notes on rivers", f"{text} one. two."]
    got = html.sections(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")).orderBy("pos").collect()
    assert [(r["page_id"], r["text"]) for r in got] == [(1, x) for x in want]
    assert html.sections_of("".join(f"<h2>t{i}</h2>" for i in range(15))) == [f"#Subheading:t{i}" for i in range(10)]
    assert len(html.sections_of("".join(f"<h2>t{i}</h2>" for i in range(15)), whole=True)) == 15


def test_model_tasks(spark):
    import json

    from sievewright.models import clients
    from sievewright.operators import tasks

    class Fixed:
        name = "fixed"

        def complete(self, prompts):
            return [json.dumps([{"question": f"q of {p.count(chr(10))} lines", "answer": "a", "category": " Rivers ", "parent_category": None}] * 2) for p in prompts]

    paragraphs = spark.createDataFrame([(d, k, f"text {k}") for d in (1, 2) for k in range(5 * d)], "doc_id long, pos int, text string")
    got = sorted((r["doc_id"], r["batch"], r["pos"], json.loads(r["question_json"])["question"]) for r in tasks.paragraph_questions(paragraphs, Fixed(), per=4).collect())
    lines = {(1, 0): 4, (1, 1): 1, (2, 0): 4, (2, 1): 4, (2, 2): 2}
    assert got == [(d, b, k, f"q of {n + 1} lines") for (d, b), n in lines.items() for k in (0, 1)]
    named = tasks.brainstormed(spark.createDataFrame([("geo",), ("sea",)], "topic string"), Fixed()).orderBy("topic").collect()
    assert [tuple(r) for r in named] == [("geo", "Rivers", "geo"), ("sea", "Rivers", "sea")]
    pairs = spark.createDataFrame([(1, "q", " Two", "two"), (2, "q", None, "two"), (3, "q || gold=", "x", "y")], "id long, question string, test_answer string, gold_answer string")
    assert [r["is_correct"] for r in tasks.judged(pairs, clients.JudgeClient()).orderBy("id").collect()] == [True, False, False]
    both = clients.load_all([{"kind": "ollama", "name": "m"}, {"kind": "vllm", "name": "v"}], {"judge": "v"})
    assert both["judge"] is both["v"] and both["m"].url.endswith("/api/generate")
    for bad in ([{"name": "a"}, {"name": "a"}], [{"kind": "none"}]):
        with pytest.raises(ValueError):
            clients.load_all(bad)


def test_http_clients():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from sievewright.models import clients

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = {"response": asked["prompt"][::-1]} if "prompt" in asked else {"choices": [{"message": {"content": asked["messages"][0]["content"].upper()}}]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(said).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/x"
    assert clients.load({"kind": "ollama", "name": "m", "url": url}).complete(["ab", "cd"]) == ["ba", "dc"]
    assert clients.load({"kind": "vllm", "name": "m", "url": url}).complete(["ab"]) == ["AB"]
    server.shutdown()


def test_router_and_files(spark, tmp_path):
    from sievewright.operators.routing import Router
    from sievewright.sources import files

    calls, router = [], Router()

    def flaky(state, n):
        calls.append(n)
        if len(calls) < 2:
            raise OSError("gone")
        return state + n

    router.register("add", flaky, retries=3, n=int)
    assert router.execute("add", {"n": 2}, 5).output == 7 and len(calls) == 2
    assert "unknown" in router.execute("none", {}).error and "missing" in router.execute("add", {}).error and "type" in router.execute("add", {"n": "x"}).error
    store = files.Store(spark, f"file://{tmp_path}/run")
    store.save("a.json", {"x": "é", "y": [1]})
    assert store.load("a.json") == {"x": "é", "y": [1]} and store.load("b.json") is None and store.names("*.json") == ["a.json"]
    questions = spark.createDataFrame([("t1", "q"), ("t2", "r")], "topic string, question string")
    files.save_run(store, questions, questions.select("topic"), {"n": 2}, {"status": "partial"})
    assert spark.read.parquet(f"{store.folder}/questions").count() == 2 and store.load("generation_report.json") == {"status": "partial"}
    made = files.config('{"a": {"b": ["${X:1}", "${Y:2}"]}, "run_id": "r"}', {"X": "9"}, run_id="s")
    assert made == {"a": {"b": ["9", "2"]}, "run_id": "s"}


def test_clusters_by_silhouette(spark):
    import numpy as np

    from sievewright.operators import evaluation

    r = np.random.default_rng(0)
    centre = np.eye(6)[:3]
    rows = [(i, (centre[i % 3] + 0.05 * r.normal(size=6)).tolist()) for i in range(90)] + [(90, [0.0] * 6), (91, None)]
    got = {x["id"]: x["cluster"] for x in evaluation.clusters_by_silhouette(spark.createDataFrame(rows, "id long, embedding array<double>"), most=5, depth=1).collect()}
    assert len(got) == 92 and got[90] == got[91] == "0"
    assert len({got[i] for i in range(90)}) == 3 and all(got[i] == got[i % 3] for i in range(90))


def test_evidence_stats_against_a_loop(spark):
    """Averages of both kinds, shares only in rounds that have them, null counts and maps."""
    rnd, rows = random.Random(5), []
    some = lambda names: rnd.choice([None, {}, {x: rnd.randrange(4) for x in names[: rnd.randrange(1, 3)]}])
    for topic in ("a", "b", None):
        for i in range(12):
            rows.append((topic, i, rnd.choice([None, 0, 2, 5]), rnd.randrange(3), rnd.randrange(9), rnd.choice([None, 0, 3, 4]), some(["qa", "mc"]), some(["easy", "hard"]), some(["qa", "mc"]), some(["easy", "hard"])))
    names = ["used_single_chunks", "used_multi_chunks", "candidate_count", "valid_count", "single_mode_counts", "single_difficulty_counts", "multi_mode_counts", "multi_difficulty_counts"]
    kinds = ["int"] * 4 + ["map<string,int>"] * 4
    want = {}

    def fold(*key_and_value):
        *key, x = key_and_value
        want[tuple(key)] = 0.3 * x + 0.7 * want.get(tuple(key), 0.0)

    for topic, _, s, m, c, v, *maps in rows:
        s, v = s or 0, v or 0
        for kind, used, by, (modes, levels) in (("single", s, s, maps[:2]), ("multi", m, s + m, maps[2:])):
            if used:
                fold(topic, kind, "candidate_rate", "", c / by)
                fold(topic, kind, "valid_rate", "", v / by)
                for measure, counts in (("mode", modes), ("difficulty", levels)):
                    for label, n in (counts or {}).items() if v else ():
                        fold(topic, kind, measure, label, n / v)
    df = spark.createDataFrame(rows, "topic string, round int, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    got = {tuple(r)[:4]: r["value"] for r in planning.evidence_stats(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert planning.evidence_stats(df.limit(0)).count() == 0


def test_what_python_finds_goes_back_in_parts(spark, monkeypatch):
    """A batch of many texts isn't answered by one batch; null texts, null items and order are kept."""
    import pyarrow as pa

    from sievewright.operators import rows

    monkeypatch.setattr(rows, "CHARS", 50)
    monkeypatch.setattr(rows, "ROWS", 7)
    batch = pa.RecordBatch.from_pydict({"id": [1, None, 3, 4], "text": ["a " * 20, "b", None, "word " * 60]})
    out = list(rows.parts(iter([batch, batch.slice(0, 0)]), lambda t: (t or "").split(), ["id", "pos", "word"]))
    assert max(x.num_rows for x in out) <= 7 and len(out) > 4
    got = [r for x in out for r in x.to_pylist()]
    assert got == [{"id": i, "pos": k, "word": w} for i, t in zip(batch["id"].to_pylist(), batch["text"].to_pylist()) for k, w in enumerate((t or "").split())]
    df = spark.createDataFrame([("x", "p q"), (None, "r"), ("y", None)], "name string, text string")
    made = rows.found_rows(df, "name", "text", lambda t: (t or "").split(), "pos", "word")
    assert sorted(map(str, map(tuple, made.collect()))) == ["('x', 0, 'p')", "('x', 1, 'q')", "(None, 0, 'r')"]
