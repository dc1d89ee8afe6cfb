"""Query analysis over a table of queries: one projection for all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import config as C
from docloom.functions import text as t
from docloom.operators import metadata as m


def keyword_tokens(c: Column) -> Column:
    """Tokens of a query: the longest configured keyword at each place, read from the left, and words of letters and digits.

    A dictionary segmenter would do as well: whatever gives array<string> can be put in its place.
    """
    known = sorted({w for ws in C.DOMAIN_KEYWORDS.values() for w in ws} | set(C.STRONG_SUBSTATION) | set(C.STRONG_LINE), key=lambda w: (-len(w), w))
    return F.regexp_extract_all(c, F.lit("(?:" + "|".join(known) + r"|[A-Za-z0-9_]+)"), F.lit(0))


def domain_of(tokens: Column) -> Column:
    """The domain with most keywords among the tokens; null where the best two are equal."""
    has = lambda words: F.arrays_overlap(tokens, t.strings(words))
    scores = {d: F.size(F.array_intersect(t.strings(ws), tokens)) for d, ws in C.DOMAIN_KEYWORDS.items()}
    sub, dist, line = (scores[d] for d in ("变电", "配电", "送电输电"))
    scores["送电输电"] = line + F.when((line > 0) & has(C.STRONG_LINE), 2).otherwise(0)
    scores["变电"] = sub + F.when((sub > 0) & (dist > 0) & has(C.STRONG_SUBSTATION), 2).otherwise(0)
    best = F.greatest(*scores.values())
    winners = F.filter(F.array(*(F.when(s == best, F.lit(d)) for d, s in scores.items())), lambda w: w.isNotNull())
    return F.when((best > 0) & (F.size(winners) == 1), F.get(winners, 0))


def any_of(c: Column, patterns) -> Column:
    return c.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns))


def expand(c: Column) -> Column:
    """The first three synonyms of each term that stands in the query."""
    return F.flatten(F.array(*(F.when(c.contains(k), t.strings(v[:3])).otherwise(t.strings([])) for k, v in C.SYNONYMS.items())))


def filter_text(parts: dict[str, Column]) -> Column:
    """The conditions that are set, joined by and; null without any."""
    quoted = [F.when(parts[k] != "", F.concat(F.lit(f'{k} == "'), parts[k], F.lit('"'))) for k in ("domain", "category", "voltage_level", "publish_level", "discipline", "equipment_type") if k in parts]
    if "year" in parts:
        quoted.append(F.when(parts["year"] != 0, F.concat(F.lit("year == "), parts["year"].cast("string"))))
    if "region" in parts:
        quoted.append(F.when(parts["region"] != "", F.concat(F.lit('region == "'), parts["region"], F.lit('"'))))
    if "exclude_drawings" in parts:
        quoted.append(F.when(parts["exclude_drawings"], F.lit("is_drawing == false")))
    if "doc_number" in parts:
        quoted.append(F.when(parts["doc_number"] != "", F.concat(F.lit('doc_number like "%'), parts["doc_number"], F.lit('%"'))))
    return t.blank_to_null(F.concat_ws(" and ", *quoted))


def analyze(queries: DataFrame, query: str = "query", tokens=keyword_tokens) -> DataFrame:
    """All analysis columns. A document number ends it: then nothing else is looked for."""
    c = F.col(query)
    df = queries.withColumn("doc_number", m.doc_number(c))
    other = F.col("doc_number").isNull()
    only = lambda x: F.when(other, x)
    df = df.withColumns({
        "domain": only(domain_of(tokens(c))), "voltage_level": only(m.voltage(c)), "discipline": only(t.first_label(c, C.DISCIPLINES)), "equipment_type": only(t.first_label(c, C.EQUIPMENT)),
        "publish_level": only(t.first_label(c, C.QUERY_PUBLISH_LEVELS)), "year": only(t.blank_to_null(F.regexp_extract(c, r"(?U)(20\d{2})年?", 1)).cast("int")),
    })
    kind = F.when(~other, "document_lookup").when(any_of(c, C.COMPARISONS), "cross_domain_comparison").when(t.contains_any(c, C.QUANTITIES), "specification_lookup").when(F.col("domain").isNotNull(), "domain_technical").otherwise("general_qa")
    df = df.withColumn("query_type", kind)
    named = F.filter(F.array(*(F.when(t.contains_any(c, ws), F.lit(d)) for d, ws in C.DOMAIN_KEYWORDS.items())), lambda d: d.isNotNull())
    spec = F.col("query_type") == "specification_lookup"
    df = df.withColumns({
        "exclude_drawings": spec, "boost_standards": spec | (F.col("query_type") == "domain_technical"), "category": F.when(spec, F.lit(C.STANDARDS)),
        "parallel_domains": F.when(F.col("query_type") == "cross_domain_comparison", named).otherwise(t.strings([])), "expanded_terms": F.when(other, expand(c)).otherwise(t.strings([])),
    })
    df = df.withColumn("expanded_query", F.concat_ws(" ", c, F.when(F.size("expanded_terms") > 0, F.array_join("expanded_terms", " "))))
    parts = {k: F.col(k) for k in ("domain", "category", "voltage_level", "publish_level", "discipline", "equipment_type", "year", "exclude_drawings", "doc_number")}
    return df.withColumn("filter_expr", filter_text(parts))


def scalar_filter(**wanted) -> Column:
    """The same conditions as a Column over chunks; what is empty is left out. doc_number is a substring."""
    tests: list[Column] = [F.col(k) == v for k, v in wanted.items() if v and k not in ("exclude_drawings", "doc_number")]
    if wanted.get("exclude_drawings"):
        tests.append(~F.col("is_drawing"))
    if wanted.get("doc_number"):
        tests.append(F.col("doc_number").contains(wanted["doc_number"]))
    return reduce(lambda a, b: a & b, tests, F.lit(True))
