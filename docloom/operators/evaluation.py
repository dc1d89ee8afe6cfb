"""Retrieval and answer quality as joins and aggregates over ranked lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import config as C
from docloom.functions import text as t
from docloom.operators.context import in_order


def marked(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """ranked: question_id, chunk_id, rank. relevant: question_id, chunk_id. Adds hit; a chunk's first place counts."""
    flagged = ranked.join(relevant.select("question_id", "chunk_id", F.lit(True).alias("hit")).distinct(), ["question_id", "chunk_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    again = F.row_number().over(Window.partitionBy("question_id", "chunk_id").orderBy("rank"))
    return flagged.withColumn("again", again > 1)


def layer1(questions: DataFrame, ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """A row for each question: recall, precision (always over k), reciprocal rank, NDCG, hit rate, first rank. Without relevant chunks all are 0."""
    rows = marked(ranked, relevant)
    at = lambda k: F.count_if(F.col("hit") & ~F.col("again") & (F.col("rank") <= k))
    gain = F.sum(F.when(F.col("hit") & (F.col("rank") <= 10), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    per = rows.groupBy("question_id").agg(*(at(k).alias(f"hits_{k}") for k in (5, 10, 30, 50)), gain.alias("dcg"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_rank"))
    sizes = relevant.groupBy("question_id").agg(F.countDistinct("chunk_id").alias("n"))
    df = questions.select("question_id").join(per, "question_id", "left").join(sizes, "question_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    some = F.col("n") > 0
    hits = lambda k: F.coalesce(F.col(f"hits_{k}"), F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    r = lambda c: F.round(F.when(some, c).otherwise(0.0), 6)
    return df.select(
        "question_id", *(r(hits(k) / F.col("n")).alias(f"recall_at_{k}") for k in (10, 30, 50)), *(r(hits(k) / k).alias(f"precision_at_{k}") for k in (5, 10)),
        r(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("mrr"), r(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal).alias("ndcg_at_10"),
        r(F.when(F.col("first_rank").isNotNull(), 1.0).otherwise(0.0)).alias("hit_rate"), F.when(some, F.col("first_rank")).alias("first_rank"),
    )


def keyword_relevance(ranked: DataFrame, questions: DataFrame) -> DataFrame:
    """Chunks of a question's list that hold any of its keywords, in either case."""
    rows = ranked.join(questions.select("question_id", "keywords"), "question_id")
    return rows.where(F.exists("keywords", lambda k: F.contains(F.lower("text"), F.lower(k)))).select("question_id", "chunk_id").distinct()


def relevance(questions: DataFrame, ranked: DataFrame, labelled: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """What is given, else what is labelled, else what keywords say."""
    out = keyword_relevance(ranked, questions)
    for better in (labelled, override):
        if better is not None:
            out = out.join(better.select("question_id").distinct(), "question_id", "left_anti").unionByName(better.select("question_id", "chunk_id"))
    return out


def keyword_hits(questions: DataFrame, fine: DataFrame, most: int = 10) -> DataFrame:
    """keyword_hits and keyword_hit_rate over the texts of the first fine results."""
    texts = fine.where(F.col("rank") <= most).groupBy("question_id").agg(in_order("text", "rank", " ").alias("all_text"))
    rows = questions.join(texts, "question_id", "left").withColumn("all_text", F.lower(F.coalesce("all_text", F.lit(""))))
    found = F.filter("keywords", lambda k: F.contains(F.col("all_text"), F.lower(k)))
    return rows.select("question_id", F.array_join(F.array_sort(found), "|").alias("keyword_hits"), F.round(F.when(F.size("keywords") > 0, F.size(found) / F.size("keywords")).otherwise(0.0), 6).alias("keyword_hit_rate"))


def layer2(questions: DataFrame, coarse: DataFrame, relevant: DataFrame) -> DataFrame:
    """questions: question_id, expected_doc, expected_domain, expected_category. Document and chunk recall, coverage, and whether the first result's domain and category are the expected."""
    rows = coarse.withColumn("doc", t.blank_to_null(t.basename(F.col("file_path")))).join(relevant.select("question_id", "chunk_id", F.lit(1).alias("hit")).distinct(), ["question_id", "chunk_id"], "left")
    rows = rows.join(questions.select("question_id", "expected_doc"), "question_id")
    per = rows.groupBy("question_id").agg(F.max((F.col("doc") == F.col("expected_doc")).cast("int")).alias("doc_hit"), F.countDistinct("doc").alias("docs"), F.count("*").alias("results"), F.countDistinct(F.when(F.col("hit") == 1, F.col("chunk_id"))).alias("hits"), F.min_by(F.struct("domain", "category"), "rank").alias("top"))
    sizes = relevant.groupBy("question_id").agg(F.countDistinct("chunk_id").alias("n"))
    df = questions.join(per, "question_id", "left").join(sizes, "question_id", "left")
    same = lambda want, got: F.when((want != "") & (want == got), 1.0).otherwise(0.0)
    return df.select(
        "question_id", F.when((F.col("expected_doc") != "") & (F.col("doc_hit") == 1), 1.0).otherwise(0.0).alias("doc_recall"), F.round(F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0)), 6).alias("chunk_recall"),
        F.round(F.least(F.coalesce(F.col("docs"), F.lit(0)) / F.greatest(F.coalesce("results", F.lit(0)), F.lit(1)) * 100, F.lit(100.0)), 6).alias("coverage_pct"),
        same(F.col("expected_domain"), F.col("top.domain")).alias("domain_accuracy"), same(F.col("expected_category"), F.col("top.category")).alias("category_accuracy"),
    )


def layer3(coarse: DataFrame, fine: DataFrame) -> DataFrame:
    """coarse, fine: layer1 of either list. What reranking changed."""
    b = coarse.select("question_id", F.col("first_rank").alias("coarse_rank"), F.col("mrr").alias("m0"), F.col("ndcg_at_10").alias("n0"))
    a = fine.select("question_id", F.col("first_rank").alias("fine_rank"), F.col("mrr").alias("m1"), F.col("ndcg_at_10").alias("n1"))
    worse = F.col("fine_rank") > F.col("coarse_rank")
    return b.join(a, "question_id").select(
        "question_id", F.when((F.col("coarse_rank") > 1) & (F.col("fine_rank") == 1), 1.0).otherwise(0.0).alias("top1_improvement"), F.round(F.col("m1") - F.col("m0"), 6).alias("mrr_delta"),
        F.round(F.col("n1") - F.col("n0"), 6).alias("ndcg_delta"), F.when(worse, 1).otherwise(0).alias("degradation"), "coarse_rank", "fine_rank",
    )


def averages(metrics: DataFrame, by: list[str] | None = None, sums: tuple[str, ...] = ("degradation",), skip: tuple[str, ...] = ("question_id", "coarse_rank", "fine_rank", "first_rank")) -> DataFrame:
    """Means over all questions (sums of counts), in all or by group."""
    names = [c for c, kind in metrics.dtypes if c not in (*skip, *(by or ())) and kind in ("double", "int", "bigint")]
    aggs = [F.count("*").alias("questions"), *(F.sum(c).alias(f"total_{c}") if c in sums else F.round(F.avg(c), 6).alias(f"avg_{c}") for c in names)]
    return metrics.groupBy(*(by or [])).agg(*aggs)


def spread(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, upper median, least and largest."""
    ordered = F.sort_array(F.collect_list(value))
    return values.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.element_at(ordered, (F.floor(F.count(value) / 2) + 1).cast("int")).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))


def best_chunk(questions: DataFrame, coarse: DataFrame, fine: DataFrame, fixed: bool = False) -> DataFrame:
    """Where the chunk with most keywords stood before and after reranking (-1: nowhere), and a diagnosis. fixed: dropping out from the first ten is told."""
    rows = coarse.join(questions, "question_id").withColumn("hits", F.size(F.filter("keywords", lambda k: F.contains(F.lower("text"), F.lower(k)))))
    top = rows.where("hits > 0").groupBy("question_id").agg(F.max_by(F.struct("hits", "rank", "chunk_id", "file_path"), F.struct("hits", -F.col("rank"))).alias("b")).select("question_id", "b.*")
    after = fine.select("question_id", "chunk_id", F.col("rank").alias("fine"))
    kept = fine.groupBy("question_id").agg(F.count("*").alias("kept"))
    pool = coarse.groupBy("question_id").agg(F.count("*").alias("pool"))
    df = questions.join(pool, "question_id", "left").join(kept, "question_id", "left").join(top, "question_id", "left").join(after, ["question_id", "chunk_id"], "left")
    c, f = F.coalesce("rank", F.lit(-1)), F.coalesce("fine", F.lit(-1))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    d = C.DIAGNOSIS
    out = say(d["coarse"], c, d["worse"])
    nothing = (F.size("keywords") == 0) | F.col("pool").isNull()
    diagnosis = F.when(nothing, d["none"]).when(F.col("hits").isNull(), d["missing"]).when((c > 10) & (f == -1), say(d["coarse"], c, d["pushed_out"], F.coalesce("kept", F.lit(0))))
    diagnosis = diagnosis.when((c > 10) & (f > 10), say(d["coarse"], c, d["after"], f, d["outside"])).when(c > 10, say(d["coarse"], c, d["raised"], f, d["better"]))
    if fixed:
        diagnosis = diagnosis.when(f == -1, out)
    diagnosis = diagnosis.when(f <= 10, say(d["coarse"], c, d["then"], f, d["inside"])).otherwise(say(d["coarse"], c, d["place"]))
    return df.select("question_id", c.alias("best_coarse_rank"), f.alias("best_fine_rank"), F.coalesce("hits", F.lit(0)).alias("kw_hit_best"), F.size("keywords").alias("kw_total"), F.coalesce("file_path", F.lit("")).alias("file_best"), diagnosis.alias("diagnosis"))


def fact_parts(fact: Column) -> Column:
    """What of a fact is looked for: its parts of three characters and more, short forms of codes, numbers; the fact itself if there are fewer than two."""
    parts = F.filter(F.split(fact, r"(?U)[,，;；/、()（）\s]+"), lambda s: F.length(s) >= 3)
    codes = F.transform(parts, lambda s: F.when(F.regexp_extract(s, r"(?U)^([A-Z]{2,})\s*[-_]?\s*(\d+)", 1) != "", F.concat(F.regexp_extract(s, r"(?U)^([A-Z]{2,})\s*[-_]?\s*(\d+)", 1), F.lit(" "), F.regexp_extract(s, r"(?U)^([A-Z]{2,})\s*[-_]?\s*(\d+)", 2))))
    codes = F.array_except(F.array_distinct(F.filter(codes, lambda c: c.isNotNull())), parts)
    both = F.concat(parts, codes)
    numbers = F.filter(F.regexp_extract_all(fact, F.lit(r"(?U)[\d.]+[%kKVΩmAW]?"), F.lit(0)), lambda n: F.length(n) >= 3)
    found = F.concat(both, F.array_except(F.array_distinct(numbers), both))
    return F.when(F.size(found) < 2, F.array(t.strip(fact))).otherwise(found)


def fact_coverage(answer: Column, facts: Column) -> Column:
    """Struct of coverage and of facts hit (0.6 of the parts), partly hit (0.3) and missed."""
    low = F.lower(answer)
    share = F.transform(facts, lambda f: F.when(F.size(fact_parts(f)) <= 1, F.contains(low, F.lower(t.strip(f))).cast("double")).otherwise(F.size(F.filter(fact_parts(f), lambda p: F.contains(low, F.lower(p)))) / F.size(fact_parts(f))))
    hit, part = F.size(F.filter(share, lambda s: s >= 0.6)), F.size(F.filter(share, lambda s: (s >= 0.3) & (s < 0.6)))
    return F.struct(F.round(F.when(F.size(facts) > 0, (hit + part * 0.5) / F.size(facts)).otherwise(0.0), 6).alias("coverage"), hit.alias("hit"), part.alias("partial"), (F.size(facts) - hit - part).alias("miss"))


def citation_match(given: Column, expected: Column) -> tuple[Column, Column]:
    """Precision and recall of citations, either holding the other."""
    norm = lambda xs: F.transform(xs, lambda x: F.lower(t.strip(x)))
    g, e = norm(given), norm(expected)
    close = lambda x, ys: F.exists(ys, lambda y: F.contains(x, y) | F.contains(y, x))
    share = lambda xs, ys: F.when((F.size(xs) > 0) & (F.size(expected) > 0), F.round(F.size(F.filter(xs, lambda x: close(x, ys))) / F.size(xs), 6)).otherwise(0.0)
    return share(g, e), share(e, g)


def citations_in(answer: Column, expected: Column) -> Column:
    """Share of expected citations that stand in the answer: its precision as well as its recall."""
    found = F.filter(expected, lambda e: F.contains(F.lower(answer), F.lower(t.strip(e))))
    return F.when(F.size(expected) > 0, F.round(F.size(found) / F.size(expected), 6)).otherwise(0.0)


def unsupported(answer: Column, known: Column) -> Column:
    """Codes of standards in the answer that no known source has (known: array of numbers and paths); the first six characters suffice."""
    norm = lambda x: F.regexp_replace(F.lower(t.strip(x)), "[ _]", "")
    codes = F.regexp_extract_all(answer, F.lit(r"(?iU)(?:GB|GB/T|GB\s*T|DL|DL/T|DL\s*T|JGJ|CJJ|CECS|Q/GDW|SL|NB|YS|SH)\s*\d+[-\d]*"), F.lit(0))
    sources = F.transform(F.filter(known, lambda k: k != ""), norm)
    return F.filter(F.array_distinct(F.transform(codes, norm)), lambda c: ~F.exists(sources, lambda k: F.contains(k, c) | F.contains(c, k) | F.contains(k, F.substring(c, 1, 6))))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of the shorter text: one step of big-integer arithmetic for each character of the longer."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & places.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def rouge_l(df: DataFrame, reference: str, candidate: str) -> DataFrame:
    """df with rouge_l_f1, rouge_l_precision and rouge_l_recall, on characters without blanks."""
    fields = [T.StructField(f"rouge_l_{n}", T.DoubleType()) for n in ("f1", "precision", "recall")]

    def run(batches):
        for batch in batches:
            ref, cand = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (reference, candidate))
            out = np.zeros((3, len(ref)))
            for i, (r, c) in enumerate(zip(ref, cand)):
                r, c = (r or "").replace(" ", ""), (c or "").replace(" ", "")
                n = lcs(r, c)
                p, q = n / len(c) if c else 0.0, n / len(r) if r else 0.0
                out[:, i] = (2 * p * q / (p + q) if p + q else 0.0, p, q)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], names=[*batch.schema.names, *(f.name for f in fields)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def answer_quality(answers: DataFrame) -> DataFrame:
    """answers: question_id, answer, gold, facts, expected_citations, known. All measures of an answer."""
    facts = fact_coverage(F.col("answer"), F.col("facts"))
    share = citations_in(F.col("answer"), F.col("expected_citations"))
    df = answers.withColumns({"fact": facts, "citation_precision": share, "citation_recall": share, "unsupported": unsupported(F.col("answer"), F.col("known"))})
    df = df.select("question_id", "answer", "gold", "fact.*", "citation_precision", "citation_recall", F.size("unsupported").alias("hallucinations"), F.length("answer").alias("answer_length"), F.round(F.when(F.length("gold") > 0, F.length("answer") / F.length("gold")).otherwise(0.0), 6).alias("length_ratio"))
    return rouge_l(df, "gold", "answer")


def stars(pct: Column) -> Column:
    return F.when(pct >= 90, 5).when(pct >= 75, 4).when(pct >= 60, 3).when(pct >= 40, 2).otherwise(1)


def bar(pct: Column, width: int = 20) -> Column:
    """Filled and empty cells, half to even."""
    n = F.bround(pct / 100 * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), width - n))


def merged_dataset(questions: DataFrame, gold: DataFrame, files: dict[str, str]) -> DataFrame:
    """Questions with their gold answers (none: empty), numbered EVAL-001 on, sources named by the mapping."""
    order = Window.orderBy("question_id")  # a set of evaluation questions is small
    names = F.create_map(*(F.lit(x) for kv in files.items() for x in kv)) if files else F.create_map().cast("map<string,string>")
    rows = questions.join(gold, "question_id", "left").withColumn("eval_id", F.format_string("EVAL-%03d", F.row_number().over(order)))
    return rows.withColumns({"gold_answer": F.coalesce("gold_answer", F.lit("")), "source_doc": F.coalesce(names[F.col("source_doc")], F.col("source_doc"))})


def smoke(hits: DataFrame) -> DataFrame:
    """hits: query_id, expected_domain, found_domain, expected_key, names (of the first three). By domain: queries, right domains, keys found."""
    return hits.groupBy("expected_domain").agg(F.count("*").alias("queries"), F.count_if(F.col("found_domain").eqNullSafe(F.col("expected_domain"))).alias("domain_hits"), F.count_if(F.exists("names", lambda n: F.contains(n, F.col("expected_key")))).alias("key_hits"))


def report(metrics: DataFrame, path: str) -> None:
    """The averages as JSON lines."""
    averages(metrics).coalesce(1).write.mode("overwrite").json(path)
