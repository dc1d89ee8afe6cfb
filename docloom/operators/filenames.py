"""Files that a query names: several strategies in order, the first to claim a file wins.

No strategy compares every query with every file: a string stands in another only if its first characters are among
the other's n-grams, so queries and files meet in an equi-join on such keys, and the strategies' exact tests look at the
pairs that share one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import config as C
from docloom.functions import text as t

NUMERAL = C.NUMERAL


def all_matches(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def candidates(query: Column) -> Column:
    """Names in 《》, in quotes, with an extension, or before 文件."""
    long = lambda xs: F.filter(F.transform(xs, t.strip), lambda x: F.length(x) >= 3)
    named = all_matches(query, C.NAMED_FILE)
    return F.concat(long(all_matches(query, C.QUOTED[0])), long(all_matches(query, C.QUOTED[1])), F.transform(named, t.strip), F.transform(all_matches(query, C.BEFORE_FILE), t.strip))


def digits(numeral: Column) -> Column:
    """A numeral up to twenty as two digits; others as they are."""
    known = F.create_map(*(F.lit(x) for i, n in enumerate(C.NUMERALS) for x in (n, str(i + 1))))
    plain = F.coalesce(known[numeral], numeral)
    return F.when(plain.rlike(r"(?U)^\d+$") & (F.length(plain) < 2), F.lpad(plain, 2, "0")).otherwise(plain)


def phrases(query: Column) -> Column:
    """Structs (score, phrase) of fragments that a file's name may hold, best first, the first of equal ones kept."""
    pair = lambda p, s: F.struct(F.lit(s).cast("double").alias("score") if isinstance(s, float) else s.alias("score"), p.alias("phrase"))
    meeting = F.coalesce(*(F.when(F.regexp_extract(query, f"(?U){p}", 0) != "", F.struct(F.regexp_extract(query, f"(?U){p}", 0).alias("whole"), F.regexp_extract(query, f"(?U){p}", 1).alias("seq"))) for p in (f"会议材料之({NUMERAL})", f"会议材料({NUMERAL})")))
    whole, seq = meeting["whole"], meeting["seq"]
    numbered = digits(seq).rlike(r"(?U)^\d+$")
    first = F.array(F.when(whole.isNotNull(), pair(whole, 0.88)), F.when(numbered, pair(F.concat(digits(seq), whole), 0.75)), *(F.when(whole.isNotNull(), pair(F.concat(F.lit(p), seq), s)) for p, s in (("会议材料之", 0.85), ("材料之", 0.80), ("材料", 0.70))))
    of_meeting = t.contains_any(query, ["材料", "会议"])
    each = lambda pattern, make: F.flatten(F.transform(all_matches(query, pattern), lambda s: F.array(*make(s))))
    after = each(f"(?U)之({NUMERAL})", lambda s: (pair(F.concat(F.lit("之"), s), 0.65), F.when(digits(s).rlike(r"(?U)^\d+$"), pair(F.concat(F.lit("材料之"), s), 0.68))))
    bare = each(f"(?U)材料({NUMERAL})", lambda s: (pair(F.concat(F.lit("材料"), s), 0.62), pair(F.concat(F.lit("材料之"), s), 0.65)))
    runs = F.transform(all_matches(query, r"(?U)[一-鿿\d]{4,}", 0), lambda p: pair(p, F.round(F.least(F.lit(0.7), 0.45 + F.length(p) * 0.02), 4)))
    short = F.transform(all_matches(query, r"(?U)\d{2}\s*(?:会议|材料|设计|电力|标准)", 0), lambda p: pair(F.regexp_replace(p, r"(?U)\s+", ""), 0.72))
    found = F.filter(F.concat(first, F.when(of_meeting, F.concat(after, bare)).otherwise(F.array().cast(after_type())), runs, short), lambda x: x.isNotNull())
    return F.transform(found, lambda x, i: F.struct((-x["score"]).alias("order"), i.alias("place"), x["phrase"].alias("phrase")))


def after_type() -> str:
    return "array<struct<score:double,phrase:string>>"


def candidate_score(c: Column, name: Column, bare: Column) -> Column:
    """All in lower case."""
    return F.when(c == name, 1.0).when(c == bare, 0.95).when((F.length(c) >= 6) & c.contains(name), 0.85).when((F.length(c) >= 4) & name.contains(c), 0.75)


def meeting_number(query: Column) -> Column:
    """Struct (number before it, its numeral) of a meeting paper that the query names."""
    p = F.coalesce(*(F.when(test & (F.regexp_extract(query, f"(?U){pattern}", 0) != ""), F.struct(F.regexp_extract(query, f"(?U){pattern}", a).alias("num"), F.regexp_extract(query, f"(?U){pattern}", b).alias("seq"))) for test, pattern, a, b in (
        (F.lit(True), rf"(\d{{2,4}})\s*会议材料之({NUMERAL})", 1, 2), (F.lit(True), f"会议材料之({NUMERAL})", 1, 1), (F.lit(True), rf"(\d{{2,4}})\s*会议材料({NUMERAL})", 1, 2), (F.lit(True), f"会议材料({NUMERAL})", 1, 1),
        (t.contains_any(query, ["材料", "会议"]), f"之({NUMERAL})", 1, 1), (t.contains_any(query, ["材料", "会议"]), f"材料({NUMERAL})", 1, 1),
    )))
    return p


def bare_number(numeral: Column) -> Column:
    return F.ltrim(digits(numeral), F.lit("0"))


def meeting_score(num: Column, seq: Column, name: Column, own: Column) -> Column:
    """num, seq: the number before a meeting paper that a query names, and its own, without zeros. own: that of the file's name, empty for none."""
    base = F.when(own == "", 0.6).when(own == seq, 0.95)
    score = F.when(F.startswith(name, F.lpad(num, 2, "0")), 1.0).when(F.contains(name, num), F.greatest(base, F.lit(0.85))).otherwise(base)
    return F.when(name.contains("材料") & seq.isNotNull() & base.isNotNull(), score)


def grams(c: Column, n: int) -> Column:
    """All pieces of n characters."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substr(c, i, F.lit(n)))).otherwise(t.strings([]))


def tagged(tag: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(f"{tag}:"), v))


def query_keys() -> Column:
    """Keys of a query of detect(): what a file must have one of for any strategy to claim it."""
    each = lambda xs, make: F.flatten(F.transform(xs, make))
    names, told = F.col("names"), F.transform("phrases", lambda x: x["phrase"])
    start = lambda xs, n: F.transform(F.filter(xs, lambda v: F.length(v) >= n), lambda v: F.substring(v, 1, n))
    parts = [tagged("same", names), tagged("in", each(names, lambda c: F.concat(*(grams(c, n) for n in (1, 2, 3, 4))))), tagged("holds", start(names, 4)), tagged("asked", grams(F.col("asked"), 6))]
    parts += [tagged("phrase", start(told, 4)), tagged("phrase", F.filter(told, lambda v: F.length(v) < 4)), tagged("number", start(F.col("numbers"), 4))]
    parts.append(F.when(F.col("seq").isNotNull(), tagged("paper", F.array(F.lit(""), F.col("seq")))).otherwise(t.strings([])))
    return F.array_distinct(F.concat(*parts))


def file_keys() -> Column:
    name, bare = F.col("lower_name"), F.col("bare_name")
    first = lambda c, n: F.array(F.substring(c, 1, n))
    parts = [tagged("same", F.array(name, bare)), tagged("in", first(name, 4)), tagged("holds", grams(name, 4)), tagged("asked", F.concat(first(bare, 6), first(name, 6)))]
    parts += [tagged("phrase", grams(bare, n)) for n in (1, 2, 3, 4)] + [tagged("number", grams(F.col("doc_number"), 4))]
    parts.append(F.when(F.contains("file_name", F.lit("材料")), tagged("paper", F.array("own"))).otherwise(t.strings([])))
    return F.array_distinct(F.concat(*parts))


def claims(pairs: DataFrame, least: float) -> DataFrame:
    """Of pairs with the columns of both sides those that a strategy claims."""
    lower, bare = F.col("lower_name"), F.col("bare_name")
    claim = F.get(F.filter(F.transform("names", lambda c: candidate_score(c, lower, bare)), lambda s: s.isNotNull()), 0)
    contained = F.when((F.length(bare) >= 6) & F.contains("asked", bare), 0.7).when((F.length(lower) >= 8) & F.contains("asked", lower), 0.65)
    phrase = -F.get(F.filter("phrases", lambda x: F.contains(bare, x["phrase"])), 0)["order"]
    numbered = F.when((F.col("doc_number") != "") & F.exists("numbers", lambda n: F.contains(F.col("doc_number"), n)), 0.8)
    steps = {"candidate": claim, "contained": contained, "phrase": phrase, "number": numbered, "meeting": meeting_score(F.col("num"), F.col("seq"), F.col("file_name"), F.col("own"))}
    first = F.coalesce(*(F.when(s.isNotNull(), F.struct(F.lit(k).alias("strategy"), s.cast("double").alias("match_score"))) for k, s in steps.items()))
    found = pairs.withColumn("claim", first).where(F.col("claim").isNotNull()).select("query_id", "file_hash", "file_name", "claim.strategy", F.round("claim.match_score", 4).alias("match_score"))
    return found.where(F.col("match_score") >= least)


def sides(queries: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What of a query and of a file alone the strategies look at."""
    name, query = F.col("file_name"), F.col("query")
    files = registry.select("file_hash", "file_name", F.coalesce("doc_number", F.lit("")).alias("doc_number"), F.lower(name).alias("lower_name"), F.lower(t.stem(name)).alias("bare_name"), bare_number(F.regexp_extract(name, f"(?U)之({NUMERAL})", 1)).alias("own"))
    numbers = F.concat(*(all_matches(query, p, 0) for p in C.QUESTION_NUMBERS))
    paper = meeting_number(query)
    asked = queries.select(
        "query_id", F.lower(query).alias("asked"), F.transform(candidates(query), lambda c: F.lower(t.strip(c))).alias("names"), F.array_sort(phrases(query)).alias("phrases"), numbers.alias("numbers"),
        F.when(paper["num"].rlike(r"(?U)^\d+$"), paper["num"]).alias("num"), bare_number(paper["seq"]).alias("seq"),
    )
    return asked, files


def detect(queries: DataFrame, registry: DataFrame, least: float = 0.4) -> DataFrame:
    """queries: query_id (unique), query. registry: file_hash, file_name, doc_number, one row a file. query_id, file_hash, file_name, strategy and match_score.

    Strategies, the first that claims a file counting: candidates, in their order; the file's name in the query; the
    query's phrases in the name; document numbers; meeting papers.
    """
    asked, files = sides(queries, registry)
    met = asked.select("query_id", F.explode(query_keys()).alias("key")).join(files.select("file_hash", F.explode(file_keys()).alias("key")), "key").select("query_id", "file_hash").distinct()
    return claims(met.join(files, "file_hash").join(asked, "query_id"), least)


def best_file(matches: DataFrame, least: float = 0.5) -> DataFrame:
    """Of each query the file of the best score, ties by hash."""
    order = Window.partitionBy("query_id").orderBy(F.desc("match_score"), "file_hash")
    return matches.where(F.col("match_score") >= least).withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
