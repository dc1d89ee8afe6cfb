"""Queries that measure retrieval and answers, and the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import encoder, search
from docloom.operators import evaluation as ev
from docloom.plans import fixtures as x
from docloom.plans import retrieval
from docloom.sources import shared
from docloom.streaming import index

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


BASE = f"{x.CHUNKS}, {x.RANKS}, {x.ranked_sql('coarse', False)}, {x.ranked_sql('fine', True)}, {x.RELEVANT}, nr AS (SELECT question_id, count(*) AS n FROM relevant GROUP BY question_id)"


def layer_sql(name: str, ranked: str) -> str:
    """Oracle of the first layer over one of the lists."""
    at = lambda k: f"coalesce(count(DISTINCT CASE WHEN r.chunk_id IS NOT NULL AND k.rank <= {k} THEN k.chunk_id END), 0)"
    ideal = "list_sum(list_transform(range(1, CAST(least(n, 10) AS BIGINT) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE)))"
    z = lambda c: f"CASE WHEN n > 0 THEN round({c}, 6) ELSE 0.0::DOUBLE END"
    return f"""{name}_a AS (
  SELECT q.item_id AS question_id, any_value(coalesce(nr.n, 0)) AS n, {at(5)} AS h5, {at(10)} AS h10, {at(30)} AS h30, {at(50)} AS h50, min(CASE WHEN r.chunk_id IS NOT NULL THEN k.rank END) AS first_rank,
    sum(CASE WHEN r.chunk_id IS NOT NULL AND k.rank <= 10 THEN 1 / log2(k.rank + 1.0::DOUBLE) ELSE 0 END) AS dcg
  FROM benchmark q LEFT JOIN {ranked} k ON k.question_id = q.item_id LEFT JOIN relevant r ON r.question_id = k.question_id AND r.chunk_id = k.chunk_id LEFT JOIN nr ON nr.question_id = q.item_id GROUP BY q.item_id
), {name} AS (SELECT question_id, {z('h10 / n')} AS recall_at_10, {z('h30 / n')} AS recall_at_30, {z('h50 / n')} AS recall_at_50, {z('h5 / 5')} AS precision_at_5, {z('h10 / 10')} AS precision_at_10,
  {z('coalesce(1.0::DOUBLE / first_rank, 0)')} AS mrr, {z(f'coalesce(dcg, 0) / {ideal}')} AS ndcg_at_10, CASE WHEN n > 0 AND first_rank IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_rate, CASE WHEN n > 0 THEN first_rank END AS first_rank FROM {name}_a)"""


def base(s, d):
    return x.table(s, d, "benchmark").select(F.col("item_id").alias("question_id")), x.ranked(s, d, False), x.relevant(s, d)


@query(f"WITH {BASE}, {layer_sql('l1', 'coarse')} SELECT * FROM l1")
def ev_layer1(s, d):
    q, coarse, rel = base(s, d)
    return ev.layer1(q, coarse, rel)


L3 = f"""{BASE}, {layer_sql('l1', 'coarse')}, {layer_sql('l2', 'fine')}, l3 AS (SELECT question_id, CASE WHEN l1.first_rank > 1 AND l2.first_rank = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS top1_improvement, round(l2.mrr - l1.mrr, 6) AS mrr_delta, round(l2.ndcg_at_10 - l1.ndcg_at_10, 6) AS ndcg_delta,
  CASE WHEN l2.first_rank > l1.first_rank THEN 1 ELSE 0 END AS degradation, l1.first_rank AS coarse_rank, l2.first_rank AS fine_rank FROM l1 JOIN l2 USING (question_id))"""


@query(f"WITH {L3} SELECT * FROM l3")
def ev_layer3(s, d):
    q, coarse, rel = base(s, d)
    return ev.layer3(ev.layer1(q, coarse, rel), ev.layer1(q, x.ranked(s, d, True), rel))


@query(f"WITH {L3} SELECT count(*) AS questions, round(avg(top1_improvement), 6) AS avg_top1_improvement, round(avg(mrr_delta), 6) AS avg_mrr_delta, round(avg(ndcg_delta), 6) AS avg_ndcg_delta, CAST(sum(degradation) AS BIGINT) AS total_degradation FROM l3")
def ev_averages(s, d):
    return ev.averages(ev_layer3(s, d))


@query(f"WITH {BASE}, {layer_sql('l1', 'coarse')} SELECT CAST(question_id % 4 AS BIGINT) AS category, count(*) AS questions, round(avg(mrr), 6) AS avg_mrr, round(avg(hit_rate), 6) AS avg_hit_rate FROM l1 GROUP BY ALL")
def ev_by_category(s, d):
    return ev.averages(ev_layer1(s, d).select((F.col("question_id") % 4).alias("category"), "mrr", "hit_rate"), ["category"])


@query(f"WITH {BASE}, {layer_sql('l1', 'coarse')} SELECT CAST(question_id % 4 AS BIGINT) AS category, count(*) AS n, round(avg(mrr), 6) AS mean, list_sort(list(mrr))[count(mrr) // 2 + 1] AS median, min(mrr) AS least, max(mrr) AS most FROM l1 GROUP BY ALL")
def ev_spread(s, d):
    return ev.spread(ev_layer1(s, d).withColumn("category", F.col("question_id") % 4), "mrr", ["category"])


TEXTS = f"""{x.CHUNKS}, {x.RANKS}, {x.ranked_sql('c0', False)}, {x.ranked_sql('f0', True)}, coarse AS (SELECT c0.question_id, c0.rank, c.* FROM c0 JOIN chunks c USING (chunk_id)), fine AS (SELECT f0.question_id, f0.rank, c.* FROM f0 JOIN chunks c USING (chunk_id)),
qs AS (SELECT item_id AS question_id, CASE WHEN item_id % 7 = 0 THEN []::VARCHAR[] ELSE list_slice(list_sort(list_distinct(regexp_extract_all(text, '[A-Za-z]{{7,}}'))), 1, 4) END AS keywords FROM benchmark)"""


def texts(s, d):
    coarse, fine = x.ranked(s, d, False).drop("doc_id"), x.ranked(s, d, True).drop("doc_id")
    chunks = shared.narrowed(x.chunks(s, d), coarse, "chunk_id")
    words = F.slice(F.array_distinct(F.array_sort(F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0)))), 1, 4)
    asked = x.table(s, d, "benchmark").select(F.col("item_id").alias("question_id"), F.when(F.col("item_id") % 7 == 0, F.array().cast("array<string>")).otherwise(words).alias("keywords"))
    return asked, coarse.join(chunks, "chunk_id"), fine.join(chunks, "chunk_id")


@query(f"WITH {TEXTS} SELECT DISTINCT question_id, chunk_id FROM coarse JOIN qs USING (question_id) WHERE len(list_filter(keywords, lambda k: contains(lower(text), lower(k)))) > 0")
def ev_keyword_relevance(s, d):
    q, coarse, _ = texts(s, d)
    return ev.keyword_relevance(coarse, q)


@query(f"""WITH {TEXTS}, kr AS (SELECT DISTINCT question_id, chunk_id FROM coarse JOIN qs USING (question_id) WHERE len(list_filter(keywords, lambda k: contains(lower(text), lower(k)))) > 0), lb AS (SELECT DISTINCT question_id, chunk_id FROM c0 WHERE question_id % 3 = 0 AND rank <= 2)
SELECT question_id, chunk_id FROM kr WHERE question_id NOT IN (SELECT question_id FROM lb) UNION ALL SELECT * FROM lb""")
def ev_relevance(s, d):
    q, coarse, _ = texts(s, d)
    labelled = x.ranked(s, d, False).where("question_id % 3 = 0 AND rank <= 2").select("question_id", "chunk_id").distinct()
    return ev.relevance(q, coarse, labelled)


@query(f"""WITH {TEXTS}, al AS (SELECT question_id, string_agg(lower(text), ' ' ORDER BY rank) AS t FROM fine WHERE rank <= 10 GROUP BY question_id)
SELECT question_id, array_to_string(list_sort(list_filter(keywords, lambda k: contains(coalesce(t, ''), lower(k)))), '|') AS keyword_hits, CASE WHEN len(keywords) > 0 THEN round(len(list_filter(keywords, lambda k: contains(coalesce(t, ''), lower(k)))) / len(keywords), 6) ELSE 0.0::DOUBLE END AS keyword_hit_rate FROM qs LEFT JOIN al USING (question_id)""")
def ev_keyword_hits(s, d):
    q, _, fine = texts(s, d)
    return ev.keyword_hits(q, fine)


@query(f"""WITH {TEXTS}, {x.RELEVANT}, e AS (SELECT question_id, CASE WHEN question_id % 5 = 0 THEN '' ELSE coalesce((SELECT any_value(regexp_extract(k.file_path, '[^/]*$')) FROM coarse k WHERE k.question_id = qs.question_id AND k.rank = 1 + qs.question_id % 3), '') END AS expected_doc, '配电' AS expected_domain, '技术文件' AS expected_category FROM qs),
p AS (SELECT k.question_id, max(CAST(regexp_extract(file_path, '[^/]*$') = expected_doc AS INT)) AS dh, count(DISTINCT regexp_extract(file_path, '[^/]*$')) AS docs, count(*) AS n, count(DISTINCT r.chunk_id) AS hits, arg_min(domain, rank) AS dm, arg_min(category, rank) AS ct FROM coarse k JOIN e USING (question_id) LEFT JOIN relevant r ON r.question_id = k.question_id AND r.chunk_id = k.chunk_id GROUP BY k.question_id)
SELECT e.question_id, CASE WHEN expected_doc <> '' AND dh = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS doc_recall, round(coalesce(hits / nullif((SELECT count(*) FROM relevant r WHERE r.question_id = e.question_id), 0), 0), 6)::DOUBLE AS chunk_recall, round(least(coalesce(docs, 0) / greatest(coalesce(p.n, 0), 1) * 100, 100), 6)::DOUBLE AS coverage_pct,
  CASE WHEN dm = expected_domain THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS domain_accuracy, CASE WHEN ct = expected_category THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS category_accuracy FROM e LEFT JOIN p USING (question_id)""")
def ev_layer2(s, d):
    q, coarse, _ = texts(s, d)
    i = F.col("question_id")
    found = coarse.where("rank = 1 + question_id % 3").select("question_id", F.regexp_extract("file_path", "[^/]*$", 0).alias("found_doc"))
    expected = q.join(found, "question_id", "left").select("question_id", F.when(i % 5 == 0, "").otherwise(F.coalesce("found_doc", F.lit(""))).alias("expected_doc"), F.lit("配电").alias("expected_domain"), F.lit("技术文件").alias("expected_category"))
    return ev.layer2(expected, coarse, x.relevant(s, d))


@query(f"""WITH {TEXTS}, h AS (SELECT question_id, rank, chunk_id, file_path, len(list_filter(keywords, lambda k: contains(lower(text), lower(k)))) AS hits FROM coarse JOIN qs USING (question_id)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY hits DESC, rank) AS n FROM h WHERE hits > 0) WHERE n = 1),
j AS (SELECT qs.question_id, coalesce(b.rank, -1) AS c, coalesce((SELECT min(f.rank) FROM fine f WHERE f.question_id = b.question_id AND f.chunk_id = b.chunk_id), -1) AS f, coalesce(b.hits, 0) AS hits, len(keywords) AS total, coalesce(b.file_path, '') AS file, (SELECT count(DISTINCT f.chunk_id) FROM fine f WHERE f.question_id = qs.question_id) AS kept, (SELECT count(*) FROM coarse k WHERE k.question_id = qs.question_id) AS pool FROM qs LEFT JOIN b USING (question_id))
SELECT question_id, c AS best_coarse_rank, f AS best_fine_rank, CAST(hits AS INTEGER) AS kw_hit_best, CAST(total AS INTEGER) AS kw_total, file AS file_best, CASE WHEN total = 0 OR pool = 0 THEN '无关键词' WHEN hits = 0 THEN '检索缺失: 50条候选池中无chunk包含任何预期关键词' WHEN c > 10 AND f = -1 THEN '粗排第' || c || '位, 精排后被挤出Top-' || kept WHEN c > 10 AND f > 10 THEN '粗排第' || c || '位, 精排后第' || f || '位, 未进入Top-10'
  WHEN c > 10 THEN '粗排第' || c || '位→精排后提升到第' || f || '位 (Reranker改善)' WHEN f <= 10 THEN '粗排第' || c || '位→精排后第' || f || '位 (已在Top-10内)' ELSE '粗排第' || c || '位' END AS diagnosis FROM j""")
def ev_best_chunk(s, d):
    q, coarse, fine = texts(s, d)
    first = lambda df: df.groupBy("question_id", "chunk_id", "file_path", "text").agg(F.min("rank").alias("rank"))
    return ev.best_chunk(q, coarse, first(fine))


def answers(s, d):
    i = F.col("item_id")
    return x.table(s, d, "benchmark").select(i.alias("question_id"), x.pick(x.ANSWERS, i).alias("answer"), x.pick(x.ANSWERS, i + 1).alias("gold"), x.pick(x.FACTS, i).alias("facts"), x.pick(x.EXPECTED, i).alias("expected_citations"), x.pick(x.KNOWN, F.floor(i / 2)).alias("known"))


A = f"a AS (SELECT item_id AS question_id, {x.pick_sql(x.ANSWERS, 'item_id')} AS answer, {x.pick_sql(x.EXPECTED, 'item_id')} AS expected, {x.pick_sql(x.KNOWN, 'item_id // 2')} AS known FROM benchmark)"


@query(f"WITH {A} SELECT question_id, CASE WHEN len(expected) > 0 THEN round(len(list_filter(expected, lambda e: contains(lower(answer), lower(trim(e))))) / len(expected), 6) ELSE 0.0::DOUBLE END AS citation_recall FROM a")
def ev_citations_in_text(s, d):
    return answers(s, d).select("question_id", ev.citations_in(F.col("answer"), F.col("expected_citations")).alias("citation_recall"))


@query(f"""WITH {A}, g AS (SELECT question_id, list_transform(regexp_extract_all(answer, '【([^】]+)】', 1), lambda c: lower(trim(c))) AS g, list_transform(expected, lambda c: lower(trim(c))) AS e FROM a)
SELECT question_id, CASE WHEN len(g) > 0 AND len(e) > 0 THEN round(len(list_filter(g, lambda v: len(list_filter(e, lambda w: contains(v, w) OR contains(w, v))) > 0)) / len(g), 6) ELSE 0.0::DOUBLE END AS precision, CASE WHEN len(e) > 0 THEN round(len(list_filter(e, lambda v: len(list_filter(g, lambda w: contains(v, w) OR contains(w, v))) > 0)) / len(e), 6) ELSE 0.0::DOUBLE END AS recall FROM g""")
def ev_citation_match(s, d):
    given = F.regexp_extract_all("answer", F.lit("【([^】]+)】"), F.lit(1))
    p, r = ev.citation_match(given, F.col("expected_citations"))
    return answers(s, d).select("question_id", p.alias("precision"), r.alias("recall"))


@query(f"""WITH {A}, c AS (SELECT question_id, known, list_distinct(list_transform(regexp_extract_all(answer, '(?i)(?:GB|GB/T|GB\\s*T|DL|DL/T|DL\\s*T|JGJ|CJJ|CECS|Q/GDW|SL|NB|YS|SH)\\s*[0-9]+[-0-9]*'), lambda v: regexp_replace(lower(trim(v)), '[ _]', '', 'g'))) AS codes, list_transform(list_filter(known, lambda v: v <> ''), lambda v: regexp_replace(lower(trim(v)), '[ _]', '', 'g')) AS src FROM a)
SELECT question_id, len(list_filter(codes, lambda v: len(list_filter(src, lambda w: contains(w, v) OR contains(v, w) OR contains(w, substring(v, 1, 6)))) = 0)) AS hallucinations FROM c""")
def ev_hallucinations(s, d):
    return answers(s, d).select("question_id", F.size(ev.unsupported(F.col("answer"), F.col("known"))).cast("long").alias("hallucinations"))


FACTS = f"""fx AS (SELECT item_id AS question_id, {x.pick_sql(x.ANSWERS, 'item_id')} AS answer, unnest({x.pick_sql(x.FACTS, 'item_id')}) AS fact FROM benchmark),
fp AS (SELECT *, list_filter(regexp_split_to_array(fact, '[,，;；/、()（）\\s]+'), lambda p: length(p) >= 3) AS parts, list_distinct(list_filter(regexp_extract_all(fact, '[0-9.]+[%kKVΩmAW]?'), lambda n: length(n) >= 3)) AS numbers FROM fx),
fc AS (SELECT *, list_concat(parts, list_filter(list_distinct(list_transform(list_filter(parts, lambda p: regexp_matches(p, '^[A-Z]{{2,}}\\s*[-_]?\\s*[0-9]')), lambda p: regexp_extract(p, '^([A-Z]{{2,}})', 1) || ' ' || regexp_extract(p, '^[A-Z]{{2,}}\\s*[-_]?\\s*([0-9]+)', 1))), lambda c: NOT list_contains(parts, c))) AS most FROM fp),
ff AS (SELECT *, list_concat(most, list_filter(numbers, lambda n: NOT list_contains(most, n))) AS found FROM fc),
fs AS (SELECT question_id, CASE WHEN len(found) < 2 THEN CAST(contains(lower(answer), lower(trim(fact))) AS INT)::DOUBLE ELSE len(list_filter(found, lambda p: contains(lower(answer), lower(p)))) / len(found) END AS share FROM ff),
facts AS (SELECT item_id AS question_id, round(CASE WHEN count(share) > 0 THEN (count(*) FILTER (share >= 0.6::DOUBLE) + count(*) FILTER (share >= 0.3::DOUBLE AND share < 0.6::DOUBLE) * 0.5::DOUBLE) / count(share) ELSE 0 END, 6)::DOUBLE AS coverage, CAST(count(*) FILTER (share >= 0.6::DOUBLE) AS INTEGER) AS hit,
  CAST(count(*) FILTER (share >= 0.3::DOUBLE AND share < 0.6::DOUBLE) AS INTEGER) AS partial, CAST(count(*) FILTER (share < 0.3::DOUBLE) AS INTEGER) AS miss FROM benchmark LEFT JOIN fs ON fs.question_id = item_id GROUP BY item_id)"""


@query(f"WITH {FACTS} SELECT question_id, coverage, hit, partial, miss FROM facts")
def ev_fact_coverage(s, d):
    return answers(s, d).select("question_id", ev.fact_coverage(F.col("answer"), F.col("facts")).alias("f")).select("question_id", "f.*")


#: Longest common subsequences of the distinct pairs of texts, a row of the table at a time.
ROUGE = """texts AS (SELECT DISTINCT replace(answer, ' ', '') AS a, replace(gold, ' ', '') AS g FROM qa),
dp AS (SELECT a, g, 0 AS i, list_transform(range(0, length(g) + 1), lambda j: 0) AS r FROM texts UNION ALL
  SELECT a, g, i + 1, list_transform(range(1, length(g) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN k = 1 THEN 0 ELSE greatest(r[k], r[k - 1] + CASE WHEN substring(a, i + 1, 1) = substring(g, k - 1, 1) THEN 1 ELSE 0 END) END))) FROM dp WHERE i < length(a)),
lcs AS (SELECT a, g, r[-1] AS n, CASE WHEN length(a) > 0 THEN r[-1] / length(a) ELSE 0 END AS p, CASE WHEN length(g) > 0 THEN r[-1] / length(g) ELSE 0 END AS q FROM dp WHERE i = length(a))"""
UNSUPPORTED = """cd AS (SELECT question_id, list_distinct(list_transform(regexp_extract_all(answer, '(?i)(?:GB|GB/T|GB\\s*T|DL|DL/T|DL\\s*T|JGJ|CJJ|CECS|Q/GDW|SL|NB|YS|SH)\\s*[0-9]+[-0-9]*'), lambda v: regexp_replace(lower(trim(v)), '[ _]', '', 'g'))) AS codes, list_transform(list_filter(known, lambda v: v <> ''), lambda v: regexp_replace(lower(trim(v)), '[ _]', '', 'g')) AS src FROM qa),
un AS (SELECT question_id, CAST(len(list_filter(codes, lambda v: len(list_filter(src, lambda w: contains(w, v) OR contains(v, w) OR contains(w, substring(v, 1, 6)))) = 0)) AS INTEGER) AS hallucinations FROM cd)"""


@query(f"""WITH RECURSIVE qa AS (SELECT item_id AS question_id, {x.pick_sql(x.ANSWERS, 'item_id')} AS answer, {x.pick_sql(x.ANSWERS, 'item_id + 1')} AS gold, {x.pick_sql(x.EXPECTED, 'item_id')} AS expected, {x.pick_sql(x.KNOWN, 'item_id // 2')} AS known FROM benchmark), {ROUGE}, {FACTS}, {UNSUPPORTED},
ct AS (SELECT question_id, CASE WHEN len(expected) > 0 THEN round(len(list_filter(expected, lambda e: contains(lower(answer), lower(trim(e))))) / len(expected), 6) ELSE 0.0::DOUBLE END AS share FROM qa)
SELECT qa.question_id, coverage, hit, partial, miss, share AS citation_precision, share AS citation_recall, hallucinations, CAST(length(answer) AS INTEGER) AS answer_length, round(CASE WHEN length(gold) > 0 THEN length(answer) / length(gold) ELSE 0 END, 6)::DOUBLE AS length_ratio,
  round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6)::DOUBLE AS rouge_l_f1, round(p, 6)::DOUBLE AS rouge_l_precision, round(q, 6)::DOUBLE AS rouge_l_recall
FROM qa JOIN facts USING (question_id) JOIN un USING (question_id) JOIN ct USING (question_id) JOIN lcs ON lcs.a = replace(answer, ' ', '') AND lcs.g = replace(gold, ' ', '')""")
def ev_answer_quality(s, d):
    """All measures of answers, ROUGE-L among them."""
    out = ev.answer_quality(answers(s, d)).drop("answer", "gold")
    return out.withColumns({c: F.round(c, 6) for c in ("rouge_l_f1", "rouge_l_precision", "rouge_l_recall")})


@query("SELECT doc_id, CASE WHEN p >= 90 THEN 5 WHEN p >= 75 THEN 4 WHEN p >= 60 THEN 3 WHEN p >= 40 THEN 2 ELSE 1 END AS stars, repeat('█', CAST(round_even(p / 100.0::DOUBLE * 20, 0) AS INTEGER)) || repeat('░', 20 - CAST(round_even(p / 100.0::DOUBLE * 20, 0) AS INTEGER)) AS bar FROM (SELECT doc_id, n_chars % 101 AS p FROM documents)")
def ev_stars(s, d):
    p = F.col("n_chars") % 101
    return x.table(s, d, "documents").select("doc_id", ev.stars(p).alias("stars"), ev.bar(p).alias("bar"))


@query("""WITH q AS (SELECT item_id AS question_id, CASE item_id % 3 WHEN 0 THEN 'a.pdf' WHEN 1 THEN 'b.pdf' ELSE 'c.pdf' END AS source_doc FROM benchmark)
SELECT question_id, 'EVAL-' || lpad(CAST(row_number() OVER (ORDER BY question_id) AS VARCHAR), 3, '0') AS eval_id, CASE WHEN source_doc = 'b.pdf' THEN 'B规范.pdf' ELSE source_doc END AS source_doc, CASE WHEN question_id % 2 = 0 THEN 'gold ' || question_id ELSE '' END AS gold_answer FROM q""")
def ev_dataset(s, d):
    i = F.col("question_id")
    q = x.table(s, d, "benchmark").select(F.col("item_id").alias("question_id")).withColumn("source_doc", x.pick(["a.pdf", "b.pdf", "c.pdf"], i))
    gold = q.where("question_id % 2 = 0").select("question_id", F.concat(F.lit("gold "), i.cast("string")).alias("gold_answer"))
    return ev.merged_dataset(q, gold, {"b.pdf": "B规范.pdf"}).select("question_id", "eval_id", "source_doc", "gold_answer")


@query("SELECT source AS category, count(*) AS questions FROM documents GROUP BY source")
def ev_category_counts(s, d):
    return x.table(s, d, "documents").groupBy(F.col("source").alias("category")).agg(F.count("*").alias("questions")).orderBy(F.desc("questions"), "category")


SMOKE = retrieval.reranked_from(retrieval.FOUND, "query", "score * boost", 8)


@query(f"""WITH {SMOKE}, nm AS (SELECT query_id, list(file_name ORDER BY fine_rank) AS names FROM fine WHERE fine_rank <= 3 GROUP BY query_id),
q AS (SELECT a.domain AS found, {x.pick_sql(x.TOPS, "a.query_id")} AS expected_domain, coalesce(names, []) AS names FROM analyzed a LEFT JOIN nm USING (query_id))
SELECT expected_domain, count(*) AS queries, count_if(found IS NOT DISTINCT FROM expected_domain) AS domain_hits, count_if(len(list_filter(names, lambda n: contains(n, 'GB'))) > 0) AS key_hits FROM q GROUP BY expected_domain""")
def ev_smoke(s, d):
    """Whole searches of all questions: the domain that the analysis finds, and whether a standard is among the first three files."""
    asked = retrieval.asked_whole(s, d)
    found = search.full_search(asked, x.store(s, d), encoder.hashed).where("fine_rank <= 3").groupBy("query_id").agg(F.collect_list("file_name").alias("names"))
    rows = asked.select("query_id", F.col("domain").alias("found_domain"), x.pick(x.TOPS, F.col("query_id")).alias("expected_domain"), F.lit("GB").alias("expected_key"))
    hits = rows.join(found, "query_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    return ev.smoke(hits).select("expected_domain", "queries", F.col("domain_hits").cast("long").alias("domain_hits"), F.col("key_hits").cast("long").alias("key_hits"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS finish, count(*) AS events FROM n GROUP BY user_id, k""")
def stream_sessions(s, d):
    form = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return index.sessions(x.table(s, d, "events")).select("user_id", form("start"), form("finish"), "events")
