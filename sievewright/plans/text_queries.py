"""Queries over documents, pages and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import signals as S
from sievewright.functions import text as T
from sievewright.operators import chunking, joins, prompts, sampling, units
from sievewright.operators import evaluation as E
from sievewright.plans.base import CHUNKS_SQL, SCORES_SQL, SIZE, STRIDE, UNITS_SQL, chunks, hash_sql, race_sql, signals_sql, spread, table, units as scored_units
from sievewright.session import written
from sievewright.sources import html

Q, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def md5(c):
    return F.md5(c.cast("binary"))


TOP = 3


@query(f"WITH {UNITS_SQL} SELECT topic, rank::INTEGER AS rank, chunk_id, tokens, round(qa_score, 6) AS qa_score FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(qa_score, 9) DESC, chunk_id) AS rank FROM units) WHERE rank <= {TOP}")
def flagship(spark, d):
    """The three chunks of each source that suit open questions best."""
    from pyspark.sql import Window

    u = S.with_scores(S.with_signals(chunks(spark, d)))
    best = Window.partitionBy("topic").orderBy(F.round("qa_score", 9).desc(), "chunk_id")
    return u.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP).select("topic", "rank", "chunk_id", "tokens", F.round("qa_score", 6).alias("qa_score"))


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_index, tokens AS n_tokens, md5(text) AS text_md5 FROM chunks")
def token_chunks(spark, d):
    return chunks(spark, d).select("doc_id", "chunk_index", "n_tokens", md5(F.col("text")).alias("text_md5"))


@query(r"SELECT doc_id, i::INTEGER AS chunk_index, least(180, len(t) - i * 180)::INTEGER AS n FROM (SELECT doc_id, t, unnest(range(0, (len(t) - 1) // 180 + 1)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS t FROM documents) WHERE len(t) > 0)")
def word_chunks(spark, d):
    return chunking.word_chunks(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "chunk_index", F.col("n_tokens").alias("n"))


@query("SELECT doc_id, i::INTEGER AS chunk_index, len(substr(text, i * 1050 + 1, 1200))::INTEGER AS n FROM (SELECT doc_id, text, unnest(range(0, (len(text) - 1) // 1050 + 1)) AS i FROM documents WHERE len(text) > 0)")
def char_chunks(spark, d):
    return chunking.char_chunks(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "chunk_index", F.length("text").alias("n"))


SENT = r"list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '')"


@query(rf"WITH {CHUNKS_SQL}, s AS (SELECT chunk_id, {SENT} AS s FROM chunks), b AS (SELECT *, CASE WHEN len(s) > 0 AND NOT regexp_matches(s[1], '^\p{{Lu}}') THEN 1 ELSE 0 END AS f FROM s), c AS (SELECT *, CASE WHEN len(s) > f AND NOT regexp_matches(s[len(s)], '[.!?]$') THEN 1 ELSE 0 END AS l FROM b) SELECT chunk_id, len(s)::INTEGER AS n_sentences, coalesce(len(array_to_string(s[f + 1 : len(s) - l], ' ')), 0)::INTEGER AS trimmed_len FROM c")
def trim_partial_sentences(spark, d):
    return chunks(spark, d).select("chunk_id", F.size(T.sentences(F.col("text"))).alias("n_sentences"), F.length(T.trim_partial_sentences(F.col("text"))).alias("trimmed_len"))


@query(r"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS pos, len(p)::INTEGER AS n_chars FROM (SELECT doc_id, trim(unnest(x)) AS p, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '\[\d+\]', '', 'g'), E'\n') AS x FROM documents)) WHERE p <> ''")
def paragraphs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "p")).select("doc_id", "pos", F.length("p").alias("n_chars"))


@query(r"""WITH w AS (SELECT page_id, unnest(regexp_extract_all(lower(regexp_replace(html, '<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->|<[^>]*>', ' ', 'gis')), '[\p{L}\p{N}_]+')) AS term FROM pages), p AS (SELECT page_id, term, count(*) AS n FROM w GROUP BY ALL),
q AS (SELECT item_id AS query_id, list_filter(list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: x), lambda x: length(x) >= 3) AS ws FROM benchmark),
f AS (SELECT query_id, unnest(list_distinct([ws[1], ws[3]])) AS term, len(list_distinct([ws[1], ws[3]])) AS k FROM q WHERE ws[3] IS NOT NULL),
h AS (SELECT query_id, page_id, sum(n)::BIGINT AS hits FROM f JOIN p USING (term) GROUP BY query_id, page_id, k HAVING count(*) = k)
SELECT query_id, rank::INTEGER AS rank, page_id, hits FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, page_id) AS rank FROM h) WHERE rank <= 5""")
def page_search(spark, d):
    """For two words of each benchmark item, the five pages that have both most often, by an inverted index that is built once and read by term."""
    from sievewright.session import shared_folder
    from sievewright.sources import search

    pages = table(spark, d, "pages").select("page_id", search.visible(F.col("html")).alias("text"), F.lit("").alias("title"), "url")
    index = search.build_index(pages, shared_folder(spark, "search-index"))
    words = F.filter(search.terms_of(F.col("text")), lambda w: F.length(w) >= 3)
    queries = table(spark, d, "benchmark").where(F.get(words, F.lit(2)).isNotNull()).select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(2))).alias("query"))
    return search.find_all(index, queries).select("query_id", "rank", F.col("item").alias("page_id"), "hits")


BLOCK_SQL = r"(?i)</?(?:p|h[1-6]|div|ul|ol|li|table|article|section|nav|footer|header|aside|script|style|body|html)\b[^>]*>"


@query(rf"""WITH b AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'gis'), '<!--.*?-->', '', 'gs') AS body FROM pages),
p AS (SELECT page_id, html, list_filter(list_transform(regexp_split_to_array(body, '(?i)<p(?:\s[^>]*)?>')[2:], lambda x: trim(regexp_replace(regexp_replace(regexp_split_to_array(x, '{BLOCK_SQL}')[1], '<[^>]*>', '', 'g'), '\[\d+\]', '', 'g'), E' \t\r\n')), lambda x: x <> '') AS p FROM b)
SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), E' \t\r\n') AS title, len(p)::INTEGER AS n_paragraphs, len(left(coalesce(array_to_string(p, E'\n'), ''), 10000))::INTEGER AS content_len FROM p""")
def html_extract(spark, d):
    return html.extracted(table(spark, d, "pages")).select("page_id", "title", "n_paragraphs", F.length("content").alias("content_len"))


@query()
def html_sections(spark, d):
    return html.sections(table(spark, d, "pages"), least=5, whole=True)


FIRST, LAST = "2024-01-01 00:00:00", "2024-01-31 23:59:59"


@query(f"SELECT user_id, coalesce(round(sum(CASE WHEN ts BETWEEN TIMESTAMP '{FIRST}' AND TIMESTAMP '{LAST}' THEN value END), 6), 0) AS views FROM events GROUP BY user_id")
def pageviews(spark, d):
    return html.page_views(table(spark, d, "events"), "user_id", "value", "ts", FIRST, LAST)


@query("SELECT c_custkey AS user_id, coalesce(n, 0) AS views FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ON user_id = c_custkey ORDER BY views DESC, user_id LIMIT 5")
def saliency_topk(spark, d):
    views = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("views"))
    return sampling.saliency_top(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), views, "user_id")


@query("SELECT c_custkey AS key, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ON user_id = c_custkey")
def backlinks(spark, d):
    return joins.backlinks(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), table(spark, d, "events"), "key", "user_id")


NAMES = ["definition", "enumeration", "comparison", "causal", "mechanism", "conditional", "numeric", "entity"]


@query(f"WITH {CHUNKS_SQL}, {signals_sql('chunks')} SELECT chunk_id, {', '.join(f'round({n}, 6) AS {n}' for n in NAMES)} FROM sig")
def signals(spark, d):
    return S.with_signals(chunks(spark, d)).select("chunk_id", *[F.round(n, 6).alias(n) for n in NAMES])


def _one(name):
    @query(f"WITH {CHUNKS_SQL}, {signals_sql('chunks')} SELECT chunk_id, round({name}, 6) AS value FROM sig")
    def f(spark, d):
        return S.with_signals(chunks(spark, d)).select("chunk_id", F.round(name, 6).alias("value"))

    key = {"entity": "entity_density", "length": "length_signal"}.get(name, name)
    Q[key], SQL[key] = Q.pop("f"), SQL.pop("f")


for _name in ("entity", "length", "ambiguity"):
    _one(_name)

WITH_FIRST = "firsts AS (SELECT c.*, f.text AS summary FROM chunks c JOIN chunks f ON f.doc_id = c.doc_id AND f.chunk_index = 0)"


def _with_first(spark, d):
    """Chunks with the words of their document's first one as summary, which are taken before the document is cut: no join, one word set a document."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("topic"))
    first = F.array_join(F.slice(T.tokens(F.col("text")), 1, SIZE), " ")
    return chunking.token_chunks(spread(docs, "doc_id", "text").withColumn("summary", T.word_set(first)), SIZE, SIZE - STRIDE)


@query(f"WITH {CHUNKS_SQL}, {WITH_FIRST}, {signals_sql('firsts', 'sig', 'summary')} SELECT chunk_id, round(alignment, 6) AS alignment FROM sig")
def jaccard(spark, d):
    sets = _with_first(spark, d).select("chunk_id", T.word_set(F.col("text")).alias("a"), "summary")
    return sets.select("chunk_id", F.round(T.jaccard(F.col("a"), F.col("summary")), 6).alias("alignment"))


@query(f"WITH {CHUNKS_SQL}, {WITH_FIRST}, {signals_sql('firsts', 'sig', 'summary')}, sc AS (SELECT chunk_id, {SCORES_SQL} FROM sig) SELECT chunk_id, round(mcq_score, 6) AS mcq, round(qa_score, 6) AS qa, round(hard_score, 6) AS hard FROM sc")
def unit_scores(spark, d):
    u = S.with_scores(S.with_signals(_with_first(spark, d), "summary"))
    return u.select("chunk_id", F.round("mcq_score", 6).alias("mcq"), F.round("qa_score", 6).alias("qa"), F.round("hard_score", 6).alias("hard"))


TAGS = [(f"{n} > 0.5", n) for n in ("definition", "comparison", "causal", "mechanism", "enumeration")] + [("years >= 3", "timeline"), ("numeric > 0.6", "numeric_dense"), ("entity > 0.6", "entity_dense")]


@query(f"WITH {CHUNKS_SQL}, {signals_sql('chunks')} SELECT chunk_id, concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for c, n in TAGS)}) AS tags FROM sig")
def tags(spark, d):
    return S.with_tags(S.with_signals(chunks(spark, d))).select("chunk_id", F.array_join("tags", ",").alias("tags"))


@query(f"""WITH {CHUNKS_SQL}, {signals_sql('chunks')}, t AS (SELECT doc_id, chunk_index, chunk_id, list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for c, n in TAGS)}], lambda x: x IS NOT NULL) AS tags FROM sig),
w AS (SELECT a.doc_id, 2 AS size, a.chunk_id, list_concat(a.tags, b.tags) AS tags FROM t a JOIN t b ON b.doc_id = a.doc_id AND b.chunk_index = a.chunk_index + 1
 UNION ALL SELECT a.doc_id, 3, a.chunk_id, list_concat(list_concat(a.tags, b.tags), c.tags) FROM t a JOIN t b ON b.doc_id = a.doc_id AND b.chunk_index = a.chunk_index + 1 JOIN t c ON c.doc_id = a.doc_id AND c.chunk_index = a.chunk_index + 2)
SELECT doc_id, size, chunk_id AS first_chunk, array_to_string(list_sort(list_distinct(tags)), ',') AS tags FROM w""")
def window_tags(spark, d):
    """Tags of runs of two and three chunks: those of any of them."""
    rows = S.with_tags(S.with_signals(chunks(spark, d))).select("doc_id", "chunk_index", "chunk_id", "text", "tags")
    return units.windows(rows).select("doc_id", "size", F.get("chunk_ids", F.lit(0)).alias("first_chunk"), F.array_join("tags", ",").alias("tags"))


WINDOWS_SQL = """wins AS (SELECT a.doc_id, a.topic, 2 AS size, a.chunk_index AS first_index, a.chunk_id, a.text || ' ' || b.text AS text, (a.tokens + b.tokens)::INTEGER AS tokens FROM chunks a JOIN chunks b ON b.doc_id = a.doc_id AND b.chunk_index = a.chunk_index + 1
 UNION ALL SELECT a.doc_id, a.topic, 3, a.chunk_index, a.chunk_id, a.text || ' ' || b.text || ' ' || c.text, (a.tokens + b.tokens + c.tokens)::INTEGER FROM chunks a JOIN chunks b ON b.doc_id = a.doc_id AND b.chunk_index = a.chunk_index + 1 JOIN chunks c ON c.doc_id = a.doc_id AND c.chunk_index = a.chunk_index + 2)"""


@query(f"WITH {CHUNKS_SQL}, {WINDOWS_SQL} SELECT doc_id, first_index, size::INTEGER AS size, tokens AS n_tokens FROM wins WHERE tokens <= 1500")
def multi_units(spark, d):
    return units.multi_units(chunks(spark, d)).select("doc_id", "first_index", "size", "n_tokens")


MULTI = "((mcq_score + qa_score) / 2 * 0.6::DOUBLE + alignment * 0.25::DOUBLE + length * 0.15::DOUBLE)"


@query(f"WITH {CHUNKS_SQL}, {WINDOWS_SQL}, {signals_sql('wins')}, sc AS (SELECT *, {SCORES_SQL} FROM sig), r AS (SELECT *, {MULTI} AS score FROM sc) SELECT topic, rank::INTEGER AS rank, chunk_id AS first_chunk_id, size::INTEGER AS size, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, doc_id, first_index, size) AS rank FROM r) WHERE rank <= 10")
def multi_units_topn(spark, d):
    return units.top_multi_units(chunks(spark, d), 10, texts=False).select("topic", "rank", F.get("chunk_ids", F.lit(0)).alias("first_chunk_id"), "size", F.round("score", 6).alias("score"))


@query(f"""WITH {CHUNKS_SQL}, n AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id),
s AS (SELECT doc_id, n, unnest([2, 3, 4]) AS size, greatest(1, n // 2) AS target FROM n WHERE n >= 2),
dr AS (SELECT *, unnest(range(1, CASE WHEN greatest(1, target // 3) >= n THEN greatest(1, least(5, n // size)) ELSE greatest(1, target // 3) END + 1)) AS draw FROM s WHERE size <= n),
ix AS (SELECT *, unnest(range(0, n)) AS i FROM dr),
pk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, size, draw ORDER BY {hash_sql('doc_id', 'size', 'draw', 'i')}, i) AS p FROM ix),
cb AS (SELECT doc_id, target, size, draw, array_to_string(list_sort(list(i)), ',') AS combo FROM pk WHERE p <= size GROUP BY ALL),
fi AS (SELECT doc_id, target, combo, min(size * 1000000 + draw) AS f FROM cb GROUP BY ALL)
SELECT doc_id, combo FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f) AS p FROM fi) WHERE p <= target UNION ALL SELECT doc_id, '0' FROM n WHERE n = 1""")
def multihop_combos(spark, d):
    return units.multihop_combos(chunks(spark, d)).select("doc_id", F.array_join(F.transform("indices", lambda i: i.cast("string")), ",").alias("combo"))


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {hash_sql('42', 'chunk_id')}, chunk_id) AS p, count(*) OVER (PARTITION BY doc_id) AS n FROM chunks) WHERE p <= floor(n * 0.5)")
def sample_chunks(spark, d):
    return sampling.sample_per_group(chunks(spark, d), "doc_id", "chunk_id", "percentage", 0.5).select("doc_id", "chunk_index")


def sample_sql(weight: str, extra: str = "") -> str:
    return f"w AS (SELECT *, round({weight}, 9) AS w FROM units), samp AS (SELECT topic, unit_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY {race_sql('w', '42', 'unit_id')}, {hash_sql('42', 'unit_id')} DESC, unit_id) AS rank FROM w) WHERE rank <= 5)"


BROAD = "(qa_score * 0.7::DOUBLE + hard_score * 0.3::DOUBLE)"
BROAD_SQL = f"{UNITS_SQL}, {sample_sql(BROAD)}"


def _broad(spark, d):
    return sampling.weighted_sample(scored_units(spark, d), sampling.broad_weight("qa", "hard"), 5)


@query(f"WITH {BROAD_SQL} SELECT topic, unit_id, rank FROM samp")
def broad_sample(spark, d):
    return _broad(spark, d).select("topic", "unit_id", "rank")


@query(f"WITH {UNITS_SQL}, {sample_sql('(qa_score * 1.3::DOUBLE * 0.5::DOUBLE + hard_score * 1.5::DOUBLE)')} SELECT topic, unit_id, rank FROM samp")
def gap_sample(spark, d):
    return sampling.weighted_sample(scored_units(spark, d), sampling.gap_weight("qa", "hard"), 5).select("topic", "unit_id", "rank")


@query(f"""WITH {BROAD_SQL}, {WINDOWS_SQL}, {signals_sql('wins', 'msig')}, multi AS (SELECT topic, chunk_id || '+' || size AS unit_id, hard_score FROM (SELECT *, {SCORES_SQL} FROM msig)),
sp AS (SELECT topic, unit_id, row_number() OVER (PARTITION BY topic ORDER BY round(hard_score, 9) DESC, unit_id) AS p, count(*) OVER (PARTITION BY topic) AS have FROM multi),
mv AS (SELECT s.topic, least(floor(0.6::DOUBLE * s.n + 1e-9)::BIGINT, coalesce(h.have, 0), s.n) AS m, s.n FROM (SELECT topic, count(*) AS n FROM samp GROUP BY topic) s LEFT JOIN (SELECT topic, max(have) AS have FROM sp GROUP BY topic) h USING (topic))
SELECT topic, unit_id, 'single' AS unit_type FROM samp JOIN mv USING (topic) WHERE rank <= n - m UNION ALL SELECT topic, unit_id, 'multi' FROM sp JOIN mv USING (topic) WHERE p <= m""")
def multi_ratio_adjust(spark, d):
    """Chunks are counted once; the sample and the windows' scores are both made from the counts."""
    rows = written(spark, S.with_counts(chunks(spark, d), "n_tokens").drop("text", "n_tokens"), "counted")
    single = S.with_scores(S.signals_of_counted(rows)).withColumns({"unit_id": F.col("chunk_id"), "unit_type": F.lit("single"), "usage_count": F.lit(0)})
    picked = sampling.weighted_sample(single, sampling.broad_weight("qa", "hard"), 5).select("topic", "unit_id", "unit_type", "rank")
    m = units.scored_windows(rows, carry=("topic",))
    m = m.select("topic", F.concat(F.get("chunk_ids", F.lit(0)), F.lit("+"), F.col("size").cast("string")).alias("unit_id"), F.lit("multi").alias("unit_type"), "hard_score")
    return sampling.with_multi_share(written(spark, picked, "picked"), m)


@query(f"WITH {BROAD_SQL} SELECT unit_id FROM units WHERE unit_id IN (SELECT unit_id FROM samp)")
def selected_units(spark, d):
    return joins.selected_units(chunks(spark, d).select(F.col("chunk_id").alias("unit_id")), _broad(spark, d))


@query("SELECT event_type AS unit, count(*) AS usage FROM events GROUP BY event_type")
def usage_counts(spark, d):
    return sampling.usage_counts(table(spark, d, "events").withColumnRenamed("event_type", "unit"), "unit")


@query(f"WITH {CHUNKS_SQL}, {BROAD_SQL.split(CHUNKS_SQL + ', ')[1]} SELECT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT unit_id FROM samp)")
def resume_anti_join(spark, d):
    return joins.to_do(chunks(spark, d).select("chunk_id"), _broad(spark, d).select(F.col("unit_id").alias("chunk_id")), "chunk_id")


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, CASE WHEN count(*) >= 10 THEN 'sufficient' WHEN count(*) >= 5 THEN 'partial' ELSE 'insufficient' END AS bucket FROM chunks GROUP BY doc_id")
def evidence_sufficiency(spark, d):
    from sievewright.operators.planning import sufficiency

    return chunks(spark, d).groupBy("doc_id").agg(sufficiency(F.count("*")).alias("bucket"))


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, count(*) AS n, avg(tokens)::DOUBLE AS avg_len, min(tokens) AS min_len, max(tokens) AS max_len, sum(tokens)::BIGINT AS total_len FROM chunks GROUP BY doc_id")
def chunk_stats(spark, d):
    return E.length_stats(chunks(spark, d), "doc_id", "n_tokens")


@query(f"WITH {CHUNKS_SQL} SELECT topic, count(*) AS total, count(*) FILTER (tokens < 20) AS skipped, count(*) FILTER (tokens < 200 AND tokens >= 20) AS warnings, count(*) FILTER (tokens < 20)::DOUBLE / count(*) AS skip_rate FROM chunks GROUP BY topic")
def builder_metrics(spark, d):
    n = F.col("n_tokens")
    return chunks(spark, d).groupBy("topic").agg(F.count("*").alias("total"), F.count_if(n < 20).alias("skipped"), F.count_if((n < 200) & (n >= 20)).alias("warnings"), E.valid_rate(F.count_if(n < 20), F.count("*")).alias("skip_rate"))


@query(f"WITH {CHUNKS_SQL} SELECT count(*) AS total, count(*) FILTER (tokens < 20) AS skipped, count(*) FILTER (NOT regexp_matches(text, '[.!?]$')) AS errors, count(*) FILTER (tokens >= 20 AND tokens < 200) AS warnings, coalesce(count(*) FILTER (tokens < 20)::DOUBLE / nullif(count(*), 0), 0) AS skipped_rate FROM chunks")
def observed_build(spark, d):
    """Metrics of the chunk table, collected while it is written."""
    from sievewright.operators import observed
    from sievewright.session import shared_folder

    n = F.col("n_tokens")
    measures = observed.builder_measures(n < 20, ~F.col("text").rlike(r"[.!?]\z"), (n >= 20) & (n < 200))
    found = observed.write_observed(chunks(spark, d), shared_folder(spark, "chunks"), measures)
    kinds = {"total": "long", "skipped": "long", "errors": "long", "warnings": "long", "skipped_rate": "double"}
    return spark.createDataFrame([tuple(found[k] for k in kinds)], ", ".join(f"{k} {t}" for k, t in kinds.items()))


@query()
def bpe_windows(spark, d):
    """Windows of 200 byte-pair tokens, 150 apart, of every whole document; tests hold them against the tokenizers library."""
    import public_tokenizers

    from sievewright.functions import tokenizer

    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return tokenizer.token_windows(docs, public_tokenizers.path("word_bpe_49k.json"), SIZE, SIZE - STRIDE).select("doc_id", "chunk_index", "n_tokens", "begin", "end", md5(F.col("text")).alias("text_md5"))


ONE = "Title: {title}\nChunk: {chunk}\nExtra: {extra}"


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id AS id, md5('Title: ' || topic || E'\\nChunk: ' || text || E'\\nExtra: none') AS prompt_md5 FROM chunks")
def single_prompts(spark, d):
    p = prompts.filled(ONE, title=F.col("topic"), extra=F.lit("none"), chunk=F.col("text"))
    return chunks(spark, d).select(F.col("chunk_id").alias("id"), md5(p).alias("prompt_md5"))


@query(f"""WITH {CHUNKS_SQL}, w AS (SELECT a.chunk_id, '<text_chunk_0>' || a.text || E'</text_chunk_0>\\n<text_chunk_1>' || b.text || '</text_chunk_1>' AS t FROM chunks a JOIN chunks b ON b.doc_id = a.doc_id AND b.chunk_index = a.chunk_index + 1) SELECT chunk_id AS id, md5(t) AS prompt_md5 FROM w""")
def multihop_prompts(spark, d):
    w = units.windows(chunks(spark, d), (2,))
    return w.select(F.get("chunk_ids", F.lit(0)).alias("id"), md5(prompts.tagged_chunks(F.col("texts"))).alias("prompt_md5"))


@query(f"""WITH {CHUNKS_SQL}, s AS (SELECT doc_id, chunk_index AS i, false AS m, E'### Single evidence ' || (chunk_index + 1) || E'\\nID: ' || chunk_id || E'\\n' || text || E'\\n' AS t FROM chunks),
mm AS (SELECT a.doc_id, a.chunk_index AS i, true AS m, E'### Multiple evidence ' || (a.chunk_index + 1) || E'\\nID: ' || a.chunk_id || E'\\nContains:\\n1. ' || a.text || E'\\n2. ' || b.text || E'\\n' AS t FROM chunks a JOIN chunks b ON b.doc_id = a.doc_id AND b.chunk_index = a.chunk_index + 1)
SELECT doc_id, md5(string_agg(t, E'\\n' ORDER BY m, i)) AS evidence_md5 FROM (SELECT * FROM s UNION ALL SELECT * FROM mm) GROUP BY doc_id""")
def evidence_text(spark, d):
    c = chunks(spark, d)
    single = c.select("doc_id", F.col("chunk_index").alias("pos"), F.lit("single").alias("unit_type"), F.col("chunk_id").alias("unit_id"), F.array("text").alias("texts"))
    multi = units.windows(c, (2,)).select("doc_id", (F.col("first_index") + (1 << 30)).alias("pos"), F.lit("multi").alias("unit_type"), F.get("chunk_ids", F.lit(0)).alias("unit_id"), "texts")
    return prompts.evidence_text(single.unionByName(multi), "doc_id", "pos").select("doc_id", md5(F.col("evidence")).alias("evidence_md5"))


@query("SELECT conv_id, md5(string_agg(CASE role WHEN 'user' THEN E'<|im_start|>user\\n' || text || E'<|im_end|>\\n' WHEN 'assistant' THEN E'<|im_start|>assistant\\n' || text || E'<|im_end|>\\n' ELSE '' END, '' ORDER BY turn) || E'<|im_start|>assistant\\n') AS rendered_md5 FROM conversations GROUP BY conv_id")
def chat_render(spark, d):
    return prompts.chat_rendered(table(spark, d, "conversations"), "qwen").select("conv_id", md5(F.col("rendered")).alias("rendered_md5"))


CALLS_SQL = rf"""calls AS (SELECT doc_id, -1 AS call, text FROM (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM documents) WHERE n <= 400
 UNION ALL SELECT doc_id, i::INTEGER, array_to_string(t[i * 300 + 1 : i * 300 + 300], ' ') FROM (SELECT *, unnest(range(0, (len(t) - 1) // 300 + 1)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS t FROM documents) WHERE len(t) > 400))"""


@query(f"WITH {CALLS_SQL} SELECT doc_id, call::INTEGER AS call, md5(text) AS text_md5 FROM calls")
def summary_calls(spark, d):
    return chunking.summary_calls(table(spark, d, "documents").select("doc_id", "text"), 400, 300).select("doc_id", "call", md5(F.col("text")).alias("text_md5"))


@query(f"WITH {CALLS_SQL}, f AS (SELECT doc_id, call, regexp_extract(text, '^[^.]*') AS s FROM calls), j AS (SELECT doc_id, count(*) AS n, string_agg(s, ' ' ORDER BY call) AS s FROM f GROUP BY doc_id) SELECT doc_id, CASE WHEN n > 1 THEN regexp_extract(s, '^[^.]*') ELSE s END AS summary FROM j")
def hier_summary(spark, d):
    from sievewright.models.clients import hierarchical_summary

    return hierarchical_summary(chunking.summary_calls(table(spark, d, "documents").select("doc_id", "text"), 400, 300), lambda t: F.regexp_extract(t, r"^[^.]*", 0))


@query(r"""WITH p AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS pos, len(p) AS n FROM (SELECT doc_id, trim(unnest(x)) AS p, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '\[\d+\]', '', 'g'), E'\n') AS x FROM documents)) WHERE p <> ''),
b AS (SELECT *, pos // 5 AS batch FROM p), t AS (SELECT doc_id, batch, count(*) AS n, sum(n) AS chars FROM b GROUP BY ALL)
SELECT doc_id, batch::INTEGER AS batch, n::BIGINT AS n FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t) WHERE before < 12""")
def paragraph_batches(spark, d):
    p = table(spark, d, "documents").select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "p")).withColumn("made", F.lit(1))
    return chunking.paragraph_batches(p, 5, made="made", most=12).groupBy("doc_id", "batch").agg(F.count("*").alias("n"))


@query()
def recursive_chunks(spark, d):
    return chunking.recursive_chunks(table(spark, d, "documents"))
