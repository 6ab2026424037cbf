"""Filter audits, projected neighbours and conversation repair: odd tables, and brute force by other ways."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import conversation_repair as R
from sievewright.llm import filter_audit, projected_neighbours as P, queries
from tests.conftest import SF

DOCS = "doc_id long, text string, source string, lang string, part string, mask int, digest string, n int"


def arrow(df):
    return df.toArrow()


def test_audit_of_odd_tables(spark, same):
    long = " ".join(f"w{i}" for i in range(210))
    texts = [None, "", " \t\n", long, long, long, long + " #", "A " * 300, "é " * 250, long.upper(), "x\x0by " * 120, long + "\x85a"]
    rows = [(i, t, s, "en", "p", 3, "d", 1) for i, (t, s) in enumerate(itertools.product(texts, [None, "", "a", "b"]))]
    rows += [(5, long, "a", "en", None, 0, None, 0), (5, long, "a", "en", None, 0, None, 0), (None, long, "b", None, None, 0, None, 0), (None, "only here", None, None, None, 0, None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2, (i // 2) % 2, 9) for i in range(40)] + [(3, None, None, 9), (3, 1, 1, 9), (None, 1, 1, 9), (7, None, 1, 9)], "doc_id long, quality int, toxic int, part int")
    out = filter_audit.audit(docs, labels)
    same(out, filter_audit.audit_sql(), documents=arrow(docs), labels=arrow(labels))
    assert out.count() == 3 * 600
    empty = filter_audit.audit(docs.limit(0), labels.limit(0))
    assert empty.count() == 0 and empty.columns == out.columns
    assert filter_audit.audit(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_lattice_and_paths():
    assert len(filter_audit.lattice()) == 80 and len(filter_audit.steps()) == 600
    used = {(before, i) for _, _, _, before, i in filter_audit.steps()}
    assert used == set(filter_audit.lattice())


def test_copies_are_spread(spark):
    """Thousands of copies of one text don't meet in one task: the join that tells the first from the others is by digest and id."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "'same text' AS text", "'s' AS source")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    row = filter_audit.audit(docs, labels).where("filter_order = 'EABCD' AND step = 1").first()
    assert (row["kept"], row["removed"], row["shapley"]) == (1, 3999, 60 * 3999)  # the text is also too short, and E goes before A in half of the orders


def exact(rows, every=50, k=5):
    out = {}
    for i, q in rows:
        if i % every == 0:
            scores = [(-(sum(a * b for a, b in zip(q, v)) / np.sqrt(sum(a * a for a in q)) / np.sqrt(sum(a * a for a in v))), j) for j, v in rows if j != i]
            out[i] = [j for _, j in sorted(scores)[:k]]
    return out


def test_neighbours_recall(spark):
    big = SF.replace("0.001", "0.1")
    got = {}
    for r in queries.op12_projected_neighbours(spark, big).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    table = spark.read.parquet(f"{big}/embeddings.parquet").toPandas()
    ids, v = table["vec_id"].to_numpy(), np.array(table["embedding"].tolist(), float)
    unit, hit, total = v / np.linalg.norm(v, axis=1)[:, None], 0, 0
    for q in np.nonzero(ids % 50 == 0)[0]:
        cosine = unit @ unit[q]
        cosine[q] = -2
        best = np.lexsort((ids, -cosine))[:5]
        mine = got[ids[q]]
        assert len(mine) == 5 and all(abs(cosine[np.nonzero(ids == i)[0][0]] - s) < 1e-12 for i, s in mine.items())
        hit, total = hit + sum(ids[i] in mine for i in best), total + 5
    assert hit / total >= 0.97


def test_neighbours_of_odd_tables(spark):
    r = random.Random(4)
    vec = lambda: [r.gauss(0, 1) for _ in range(6)]
    rows = [(i, vec()) for i in range(1, 40)]
    rows += [(0, rows[0][1]), (100, [3 * x for x in rows[1][1]]), (50, [1e-160 * x for x in rows[2][1]]), (41, [1e150 * x for x in rows[2][1]])]
    odd = [(60, None), (61, [0.0] * 6), (62, [1.0, None]), (63, [float("nan")] * 6), (64, [float("inf")] + [1.0] * 5), (65, []), (None, vec()), (150, None), (200, [0.0])]
    made = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows + odd + rows[:3]], "vec_id long, embedding array<double>, cell string, salt int, row int")
    out = P.nearest(made)
    got = {}
    for x in out.orderBy("query_id", "rank").collect():
        assert x["rank"] == len(got.setdefault(x["query_id"], [])) + 1
        got[x["query_id"]].append(x["vec_id"])
    want = exact([(i, [v * (1e160 if i == 50 else 1e-150 if i == 41 else 1) for v in x]) for i, x in rows])
    assert got.keys() == want.keys() == {0, 50, 100}
    assert sum(a in want[q] for q in want for a in got[q]) >= 14 and got[50][0] in (3, 41) and all(len(x) == 5 for x in got.values())
    assert P.nearest(made.limit(0)).count() == 0
    few = P.nearest(spark.createDataFrame([(0, [1.0]), (1, [2.0, 0.0]), (2, [-1.0])], "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(x["vec_id"], x["score"]) for x in few] == [(1, 1.0), (2, -1.0)]


def test_equal_vectors_go_by_id(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(3000)] + [(i, [float(i), 1.0, 0.0]) for i in range(3000, 3100)]
    got = P.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).where("query_id IN (0, 50, 2950)").orderBy("query_id", "rank").collect()
    assert [x["vec_id"] for x in got] == [1, 2, 3, 4, 5] + [0, 1, 2, 3, 4] * 2


def test_searches_stop_early_where_vectors_cluster():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 64)) * 3
    v = np.repeat(centres, 100, 0) + rng.standard_normal((4000, 64)) * 0.2
    rows = P.Vectors.of(np.arange(4000), v)
    tree, stop = P.Tree(rows), P.quantile(P.CONFIDENCE, P.M)
    hit = verified = 0
    for i in range(0, 4000, 100):
        q = rows.take(slice(i, i + 1))
        search = P.Search(q, 5, -2.0, stop)
        search.run(tree, tree.boxes(q.p)[0])
        cosine = (rows.v @ q.v[0]) / rows.length / q.length[0]
        cosine[i] = -2
        hit, verified = hit + len({*np.argsort(-cosine)[:5]} & {*search.ids}), verified + search.verified
    assert hit >= 0.95 * 200 and verified < 0.2 * 40 * 4000


def test_chi_square():
    assert abs(P.chi_square(P.quantile(0.98, 8), 8) - 0.98) < 1e-12
    drawn = (np.random.default_rng(0).standard_normal((200_000, 8)) ** 2).sum(1)
    assert abs((drawn < 15.507).mean() - P.chi_square(15.507, 8)) < 0.003


def all_scripts(rows):
    """The cheapest (cost, audit, output) by trying every edit, insertions included, at every place."""
    best = (10**9, "", [])

    def go(i, state, cost, audit, out, inserted):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows) and state in ("", "a"):
            best = min(best, (cost, audit, out))
        for r, name in (("u", "user"), ("a", "assistant")):
            if inserted < 3 and r in follows[state]:
                go(i, r, cost + 3, audit + "I", [*out, f"{name}:"], inserted + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, state, cost + 4, audit + "D", out, 0)
            if fault in (R.BLANK, R.DUPLICATE):
                return
            extra = 3 if fault == R.CUT else 0
            if role[:1] and role[:1] in follows[state]:
                go(i + 1, role[:1], cost + extra, audit + "K", [*out, f"{role}:{text}"], 0)
            for r, name in (("u", "user"), ("a", "assistant")):
                if r in follows[state]:
                    go(i + 1, r, cost + extra + 3, audit + "R", [*out, f"{name}:{text}"], 0)

    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    go(0, "", 0, "", [], 0)
    return best


def test_repair_against_all_scripts():
    import hashlib

    r = random.Random(3)
    for _ in range(400):
        rows = [(r.choice(["user", "assistant", "system", "tool", "", " ", "a", "sys"]), f"t{r.randint(0, 9)}", r.choice([0, 0, 0, R.BLANK, R.DUPLICATE, R.CUT, R.CUT])) for _ in range(r.randint(0, 5))]
        state = R.Repair()
        for x in rows:
            state.step(*x)
        cost, audit, out = all_scripts(rows)
        assert state.end() == (cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()), rows


def test_repair_of_odd_tables(spark, same):
    r = random.Random(5)
    texts = [None, "", " ", "\t\n", "Yes.", "No", "Why?\n", "é!", "a\nb", "...", "x\x0b", "end.\x85", "K. "]
    roles = [None, "", "user", "assistant", "system", "tool", "User", "s"]
    rows = [(c, r.choice([None, *range(8)]), r.choice(roles), r.choice(texts), "m", 1) for c in [None, *range(60)] for _ in range(r.randint(1, 9))]
    made = spark.createDataFrame(rows + rows[:20], "conv_id long, turn long, role string, text string, _h string, copy int")
    same(R.repair(made), R.repair_sql(), conversations=arrow(made.select("conv_id", "turn", "role", "text")))
    assert R.repair(made).count() == 61
    assert R.repair(made.limit(0)).count() == 0


def test_conversation_whose_rows_all_went(spark):
    import zlib

    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    row = R.repair(spark.createDataFrame([(7, turn, "user", "Hello.")], "conv_id long, turn long, role string, text string")).first()
    assert tuple(row) == (7, 0, 0, 0, 0, 0, 0, "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")


def test_long_conversations_keep_little():
    import time

    state, began = R.Repair(), time.time()
    for i in range(60_000):
        state.step(("user", "assistant", "user", "system")[i % 4], f"t{i}.", R.CUT if i % 7 == 0 else 0)
    cost, audit, _ = state.end()
    assert cost > 0 and len(audit) >= 60_000 and time.time() - began < 20
    assert max(len(p.edits) for p in state.paths.values()) < 2000


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_projected_neighbours", "op13_conversation_repair"])
def test_reruns_agree(spark, name):
    a, b = (sorted(map(tuple, queries.queries()[name](spark, SF).collect()), key=repr) for _ in range(2))
    assert a == b and a


def test_stages_keep_columns_that_are_named_like_theirs(spark, tmp_path):
    """Null and shared ids, repeated rows and empty tables, with columns named like the stages' own."""
    import corpus_pipeline

    text = " ".join(f"word{i}" for i in range(60))
    spark.createDataFrame([("a", " ".join(f"bench{i}" for i in range(20)))], "item_id string, text string").selectExpr("hash(item_id) AS item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, text, "k1", "g"), (2, text, "k2", "g"), (None, text, "k3", "g"), (3, "leak " + " ".join(f"bench{i}" for i in range(20)), "k4", "g"), (4, None, None, None), (4, None, None, None), (5, "other words", "k5", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, _KEY_ string").withColumn("source", F.lit("s"))
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.decontaminated):
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert sorted((r["doc_id"], r["_key"]) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()) == [(1, "k1"), (3, "k4"), (4, None), (5, "k5")]
    kept = corpus_pipeline.decontaminated(spark, docs, str(tmp_path))
    assert kept.count() == 6 and {r["_key"] for r in kept.collect()} == {"k1", "k2", "k3", None, "k5"}
    mixed = corpus_pipeline.mixed(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and corpus_pipeline.mixed(spark, docs.limit(0), str(tmp_path)).count() == 0
