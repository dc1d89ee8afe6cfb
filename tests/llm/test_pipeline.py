import base64
from collections import Counter

import pytest

import corpus_pipeline
from docloom.llm import op1_mixing, op9_toxicity


def stages(spark, d, tmp):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, d).write.parquet(f"{tmp}/{k}")
        yield docs, (docs := spark.read.parquet(f"{tmp}/{k}"))


def test_stages(spark, sf, tmp_path):
    import public_tokenizers as P
    import tiktoken
    from test_ngram_join import brute

    steps = list(stages(spark, sf, tmp_path))
    (docs, clean), (_, once), (_, mixed), (_, coded) = steps
    assert clean.columns == once.columns == mixed.columns == docs.columns
    model = op9_toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in op9_toxicity.score(docs, model).collect() if not r.predicted}
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    assert {r.doc_id for r in once.collect()} == {c for _, _, c in brute(rows, 5, 80, 100)}
    texts, taken = {r.doc_id: r for r in once.collect()}, Counter(r.doc_id for r in mixed.collect())
    assert set(taken) <= set(texts) and max(taken.values()) <= 2
    sizes, got = Counter(), Counter()
    for i, r in texts.items():
        n = len(r.text.split())
        sizes[r.source] += n
        got[r.source] += n * taken[i]
    names = sorted(sizes)
    for s, t in zip(names, op1_mixing.targets([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))])):
        assert abs(got[s] - t) <= max(len(r.text.split()) for r in texts.values() if r.source == s)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert Counter(r.doc_id for r in coded.collect()) == taken
    assert all(r.exact and r.ids == library.encode_ordinary(texts[r.doc_id].text) and r.n_tokens == len(r.ids) for r in coded.collect())


@pytest.mark.parametrize("where", ["odd_docs", "empty_docs"])
def test_odd_rows(spark, where, request, tmp_path, empty_docs):
    d = request.getfixturevalue(where)
    if where == "odd_docs":
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{d}/labels.parquet")
    for k, (before, after) in enumerate(stages(spark, d, tmp_path)):
        if k < 3:
            assert after.columns == before.columns
        if k == 1 and where == "odd_docs":
            # repeated rows go down to one, those without id or words stay
            ids = Counter((r.doc_id, r.text) for r in after.collect())
            assert all(n == 1 for (i, t), n in ids.items() if i is not None and (t or "").split())
            assert sum(n for (i, _), n in ids.items() if i is None) == sum(r.doc_id is None for r in before.collect())
