"""Scores of a query with a text, for rerankers: late interaction of their words.

A scorer is any function (hits, asked, ready) -> hits with pair_score. hits: query_id, chunk_id, words (those of the chunk)
and whatever else; asked: query_id (each once) and words; ready: the index that the hits are from. A neural scorer of
pairs has the same form. lexical() needs no model: each word of a query meets the word of the text that is most like it,
by their character trigrams, and the likenesses are averaged by the rarity of the query's words. Words that share little
are likened by chance alone; under LIKE they count as unlike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.index import Index, ragged


#: Least likeness of two words (twice their common trigrams by all of theirs).
LIKE = 0.5


def trigrams(word: str) -> set[str]:
    """Of the word with a mark before and behind it, so that a word of one letter has one."""
    marked = f"^{word}$"
    return {marked[i : i + 3] for i in range(max(1, len(marked) - 2))}


def weighted(asked: DataFrame, ready: Index) -> DataFrame:
    """query_id and asked: the query's distinct words with ln(1 + chunks / (1 + chunks that hold the word)). A query without words has no row."""
    own = asked.select("query_id", F.explode(F.array_distinct("words")).alias("term")).where("term IS NOT NULL")
    seen = ready.postings.join(own.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum(F.size("rows")).alias("held"))
    weight = F.log(1 + F.lit(float(ready.chunks.count())) / (1 + F.coalesce("held", F.lit(0)))).alias("weight")
    return own.join(seen, "term", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", weight))).alias("asked"))


def likenesses(asked: pa.Array, words: pa.Array) -> np.ndarray:
    """Of each pair of a batch the score. Memory: the batch's distinct words with their trigrams, and for one query word at a time the words of its texts."""
    n = len(words)
    flat = words.flatten().dictionary_encode()
    code, kinds = flat.indices.fill_null(-1).to_numpy(zero_copy_only=False), len(flat.dictionary)
    of = np.repeat(np.arange(n), pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False))[code >= 0]
    text, word = np.divmod(np.unique(of * max(1, kinds) + code[code >= 0]), max(1, kinds))
    sizes = np.bincount(text, minlength=n)
    begin = np.cumsum(sizes) - sizes

    pair = np.repeat(np.arange(n), pc.list_value_length(asked).fill_null(0).to_numpy(zero_copy_only=False))
    terms = asked.flatten()
    weight = pc.struct_field(terms, "weight").to_numpy(zero_copy_only=False)
    coded = pc.struct_field(terms, "term").dictionary_encode()
    term, names = coded.indices.to_numpy(), [trigrams(w) for w in coded.dictionary.to_pylist()]
    holders: dict[str, list[int]] = {g: [] for grams in names for g in grams}
    width = np.zeros(kinds)
    for c, w in enumerate(flat.dictionary.to_pylist()):
        grams = trigrams(w)
        width[c] = len(grams)
        for g in grams & holders.keys():
            holders[g].append(c)
    held = {g: np.array(codes, np.int64) for g, codes in holders.items()}

    total, top = np.bincount(pair, weight, minlength=n), np.zeros(n)
    order = np.argsort(term, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(term[order])) + 1) if len(order) else ():
        mine = mine[sizes[pair[mine]] > 0]
        if not len(mine):
            continue
        grams = names[term[mine[0]]]
        common = np.bincount(np.concatenate([held[g] for g in grams]), minlength=kinds)
        like = 2 * common / (len(grams) + width)
        like[like < LIKE] = 0
        rows = pair[mine]
        best = np.maximum.reduceat(like[word[ragged(begin[rows], sizes[rows])]], np.cumsum(sizes[rows]) - sizes[rows])
        top += np.bincount(rows, weight[mine] * best, minlength=n)
    return np.divide(top, total, out=np.zeros(n), where=total > 0)


def late_interaction(pairs: DataFrame, digits: int = 6) -> DataFrame:
    """pairs: asked (array of term and weight), words, and other columns, which stay. Adds pair_score, 0 to 1; 0 where either side has no words."""
    kept = [f for f in pairs.schema.fields if f.name not in ("asked", "words")]

    def run(batches):
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            score = likenesses(batch.column(at["asked"]), batch.column(at["words"]))
            yield pa.RecordBatch.from_arrays([*(batch.column(at[f.name]) for f in kept), pa.array(score)], names=[*(f.name for f in kept), "pair_score"])

    scored = pairs.mapInArrow(run, T.StructType([*kept, T.StructField("pair_score", T.DoubleType())]))
    return scored.withColumn("pair_score", F.round("pair_score", digits))


def lexical(hits: DataFrame, asked: DataFrame, ready: Index) -> DataFrame:
    """hits with pair_score instead of words, by late interaction with weights of the index. One join by query; texts aren't shuffled where the queries are few."""
    return late_interaction(hits.join(weighted(asked, ready), "query_id", "left"))
