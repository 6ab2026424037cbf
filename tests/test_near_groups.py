"""Groups of near duplicates against all pairs, components against union-find, search against a scan, crawls of files."""

import random

import pytest
from pyspark.sql import functions as F

from sievewright.operators import dedup
from sievewright.operators.components import components
from sievewright.sources import crawl, search


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed, nodes, links", [(1, 60, 25), (2, 200, 300), (3, 40, 0)])
def test_components(spark, seed, nodes, links):
    r = random.Random(seed)
    pairs = [(r.randrange(nodes), r.randrange(nodes)) for _ in range(links)] + [(k, k + 1) for k in range(1000, 1030)] + [(2000, k) for k in range(2001, 2050)] + [(5, 5), (None, 3)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [p for p in pairs if None not in p and p[0] != p[1]]
    assert got == roots({x for p in real for x in p}, real)


def edited(r, words, share):
    out = list(words)
    for k in r.sample(range(len(out)), int(share * len(out))):
        out[k] = f"edit{r.randrange(10**6)}"
    return out


def test_near_groups_against_all_pairs(spark):
    r = random.Random(11)
    rows, n = [], 0
    for _ in range(60):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randint(40, 300))]
        for _ in range(r.randint(1, 8)):
            rows.append((n, " ".join(edited(r, words, r.choice([0, 0.005, 0.01, 0.02, 0.03])))))
            n += 1
    for _ in range(3):  # chains
        words = [f"c{r.randrange(5000)}" for _ in range(200)]
        for _ in range(12):
            rows.append((n, " ".join(words)))
            words, n = edited(r, words, 0.015), n + 1
    r.shuffle(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, "..."), (n + 3, "two words"), (n + 4, "two words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    pairs = [(x["a"], x["b"]) for x in dedup.near_duplicates(df, "doc_id", "text").collect()]
    got = {x["doc_id"]: x["representative"] for x in dedup.near_duplicate_groups(df, "doc_id", "text").collect()}
    same = {}
    for i, t in rows:
        same.setdefault(t, []).append(i)
    copies = [(min(v), i) for t, v in same.items() if t and t != "..." for i in v]
    want = roots([i for i, _ in rows], pairs + copies)
    linked = [(a, b) for a, b in pairs if got[a] == got[b]]
    assert len(linked) >= 0.99 * len(pairs) > 100  # recall of links
    assert all(want[i] == want[got[i]] for i in got)  # nothing is grouped that isn't linked
    assert sum(got[i] == want[i] for i in got) >= 0.99 * len(got) == 0.99 * len(rows)


def test_copies_make_rows_in_proportion(spark):
    """Near copies of one text: each is compared with a few others, not with all."""
    r = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    df = spark.createDataFrame([(k, " ".join(edited(r, words, 0.0025))) for k in range(600)], "doc_id long, text string")
    out = dedup.near_duplicate_groups(df, "doc_id", "text")
    assert out.where("representative = 0").count() == 600
    sets = dedup.shingle_sets(df, "doc_id", "text", 5)[0]
    assert sets.count() == 600  # all different, so 179,700 pairs


def test_near_groups_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, representative int")
    assert dedup.near_duplicate_groups(empty, "doc_id", "text").count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert dedup.near_duplicate_groups(nulls, "doc_id", "text").where("doc_id = 1 AND representative = 1").count() == 2


PAGES = [(1, "A b c. b b", "One", "u1"), (2, "b c", "Two", "u2"), (3, "C c c C B", "Three", "u3"), (4, None, None, None), (5, "", "Empty", "u5"), (2, "b", "Two again", "u2"), (6, "é É b", "Accent", "u6")]


def test_search(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, text string, title string, url string")
    index = search.build_index(pages, str(tmp_path / "index"))
    found = lambda q, n=5: [(r["item"], r["hits"], r["title"]) for r in search.find(index, q, n).collect()]
    assert found("b c") == [(3, 5, "Three"), (1, 4, "One"), (2, 3, "Two")]
    assert found("B  b C", 1) == [(3, 5, "Three")] and found("É") == [(6, 2, "Accent")] and found("zebra b") == [] and found("") == [] and found("...") == []
    queries = spark.createDataFrame([(1, "b c"), (2, "zebra b"), (3, None), (4, "É"), (5, "b b")], "query_id int, query string")
    got = {}
    for r in search.find_all(index, queries, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["item"], r["hits"]))
    assert got == {1: [(3, 5), (1, 4), (2, 3)], 4: [(6, 2)], 5: [(1, 3), (2, 2), (3, 1)]}
    plan = index.postings(["b"])._sc._jvm.PythonSQLUtils.explainString(index.postings(["b"])._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,b)]" in plan or "PushedFilters: [In(term, [b])]" in plan
    nothing = search.build_index(pages.limit(0), str(tmp_path / "none"))
    assert search.find(nothing, "b").count() == 0 and search.find_all(nothing, queries).count() == 0


def test_crawl(spark, tmp_path):
    for name, data in {"en/Green_tea.html": b"<p>tea</p>", "en/Green.html": b"g", "en/notes.txt": b"x", "fr/Th\xc3\xa9_vert.html".encode("latin1").decode(): "thé".encode(), "de/B.html": b"\xff bad"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    all_ = crawl.crawl(spark, str(tmp_path))
    assert {(r["language"], r["title"], r["html"], r["bytes"]) for r in all_.collect()} == {("en", "Green tea", "<p>tea</p>", 10), ("en", "Green", "g", 1), ("fr", "Thé vert", "thé", 4), ("de", "B", "� bad", 5)}
    assert [r["url"] for r in all_.where("language = 'fr'").collect()] == ["https://fr.example.org/wiki/Th%C3%A9_vert"]
    assert all_.where("language IN ('en', 'de') AND title LIKE 'Gr%' AND bytes > 5").select("title").collect()[0][0] == "Green tea"
    assert crawl.crawl(spark, str(tmp_path / "missing")).count() == 0


def test_crawl_filters_reach_the_listing(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

    for k in range(30):
        path = tmp_path / ("en" if k % 2 else "fr") / f"Page_{k}.html"
        path.parent.mkdir(exist_ok=True)
        path.write_text("x")
    reader = crawl.CrawlReader(str(tmp_path), "example.org")
    other = GreaterThan(("bytes",), 3)
    assert list(reader.pushFilters([EqualTo(("language",), "en"), StringStartsWith(("title",), "Page 1"), In(("language",), ("en", "de")), other])) == [other]
    assert sorted(t for p in reader.partitions() for t in (crawl.title_of(f[1]) for f in p.paths)) == ["Page 1", "Page 11", "Page 13", "Page 15", "Page 17", "Page 19"]


@pytest.mark.parametrize("bands", [1, 12])
def test_near_groups_are_the_closure_of_all_pairs(spark, monkeypatch, bands):
    """Whatever the bands miss: groups are exactly those of all similar pairs and equal sets."""
    monkeypatch.setattr(dedup, "BANDS", bands)
    r = random.Random(5)
    rows, n = [], 0
    for _ in range(40):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randint(20, 200))]
        for _ in range(r.randint(1, 6)):
            rows.append((n, " ".join(edited(r, words, r.choice([0, 0.01, 0.02, 0.025, 0.03])))))
            n += 1
    common = [f"line{k}" for k in range(60)]
    rows += [(n + k, " ".join(common + [f"x{k}.{i}" for i in range(r.randint(5, 40))])) for k in range(30)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for i, t in rows for w in [t.split()]}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    df = spark.createDataFrame([(i, t.replace(".", "_")) for i, t in rows], "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["representative"] for x in dedup.near_duplicate_groups(df, "doc_id", "text").collect()}
    assert got == roots(sets, pairs)
    listed = {(x["a"], x["b"]) for x in dedup.near_duplicates(df, "doc_id", "text").collect()}
    assert {p for p in pairs if sets[p[0]] != sets[p[1]]} >= listed and {got[a] == got[b] for a, b in listed} == {True}
    firsts = {}
    for i in sorted(sets):
        firsts.setdefault(frozenset(sets[i]), i)
    assert listed == {(a, b) for a, b in pairs if sets[a] != sets[b] and firsts[frozenset(sets[a])] == a and firsts[frozenset(sets[b])] == b}


def test_sets_like_no_other_one_are_not_shuffled(spark):
    """Of texts of which most are alone, only those that may have a similar one are kept as sets."""
    r = random.Random(3)
    rows = [(k, " ".join(f"w{r.randrange(10**6)}" for _ in range(300))) for k in range(60)]
    rows += [(60 + k, " ".join(edited(r, rows[k][1].split(), 0.01))) for k in range(5)]
    sets, membership = dedup.shingle_sets(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 5, 0.8)
    assert sorted(x["id"] for x in sets.select("id").collect()) == [*range(5), *range(60, 65)] and membership.count() == 65
