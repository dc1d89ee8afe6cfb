"""Operators 2, 4 and 7 against the libraries on whole texts."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from docloom.llm import op2_token_counts as two
from docloom.llm import op4_token_files as four
from docloom.llm import op7_byte_bpe as seven
from docloom.llm.pieces import CONTROL_CUT, PieceCache, load_tokenizer, with_blanks, without_blanks


def docs(spark, d):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("where", ["sf", "odd_docs", "empty_docs"])
def test_counts(spark, where, request):
    d = request.getfixturevalue(where)
    library = load_tokenizer(P.path("byte_bpe_50k.json"))
    want = sorted(((i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 1024) for i, t in docs(spark, d)), key=str)
    assert sorted(map(tuple, two.op2_token_counts(spark, d).collect()), key=str) == want


@pytest.mark.parametrize("path, split, more", [("byte_bpe_50k.json", with_blanks, {}), ("word_bpe_49k.json", without_blanks, {}), ("word_bpe_49k.json", without_blanks, {"cut": CONTROL_CUT, "word_end": "</w>"})])
def test_neighbours_in_a_batch_change_nothing(path, split, more):
    library, rng = load_tokenizer(P.path(path)), random.Random(3)
    words = ["Hello", "world", "don't", "x", "\n", "\n\n", " ", "  ", "\t", "\r\n", "\u00a0", "<|endoftext|>", "<|startoftext|>", "é", "e\u0301", "\u0301", "İ", "ΟΔΟΣ", "'S", "12", "!?", "\x1f", "\u3000", "\x01", "Ñandú.", "ÀÉß", "end?!", "(x)", "ÿ\u0301"]
    batches = [["Hello world\n", "Hello world\n\nNext one", "Other\n\nNext one"], ["x \n", "\n y"], ["end.\n", "\n\nStart of"]]
    batches += [["".join(rng.choices(words, k=rng.randrange(12))) for _ in range(20)] for _ in range(1000)]
    cache = PieceCache(library, split, max_chars=20_000, **more)
    for batch in batches:
        want = [library.encode(x, add_special_tokens=False).ids for x in batch]
        assert cache.counts(batch) == list(map(len, want)), batch
        assert [x.tolist() for x in cache.encoded(batch)] == want


def test_splice_is_exact_whatever_the_chunks():
    library, rng = load_tokenizer(P.path("byte_bpe_50k.json")), random.Random(7)
    parts = ["the ", "don't", "  ", "\n\n \n", "<|endoftext|>", "é", "\U0001f600", "日本語", "12345", "...", " a", "x" * 40, " ", "\t", "'ll", " 's "]
    for k in range(60):
        text = "".join(rng.choice(parts) for _ in range(400))
        want = library.encode(text, add_special_tokens=False).ids
        for chunk, overlap in ((150, 80), (300, 70), (1000, 128)):
            assert [i for p in two.spliced(library, text, chunk, overlap) for i in p] == want, (k, chunk)


def test_splice_widens_until_it_can():
    library = load_tokenizer(P.path("byte_bpe_50k.json"))
    for text in ("x" * 3000, "ab " * 20 + "y" * 2000 + " end" * 300, " " * 2500 + "z"):
        assert [i for p in two.spliced(library, text, 300, 70) for i in p] == library.encode(text, add_special_tokens=False).ids


def test_splicing_is_linear():
    library, sent = load_tokenizer(P.path("byte_bpe_50k.json")), []

    class Counted:
        def encode(self, text, **more):
            sent.append(len(text))
            return library.encode(text, **more)

    for text in (" " * 300_000, "ab" * 60_000, "a b " * 5_000 + "\n" * 150_000 + "the end. " * 9_000, "word " * 60_000, "x" * 99_000 + " y" * 40_000 + "z" * 99_000):
        sent.clear()
        assert [i for p in two.spliced(Counted(), text, 2_000, 200) for i in p] == library.encode(text, add_special_tokens=False).ids
        assert sum(sent) < 6 * len(text)


@pytest.mark.parametrize("where", ["sf", "odd_docs", "empty_docs"])
def test_token_files(spark, where, request):
    d = request.getfixturevalue(where)
    library, start = load_tokenizer(P.path("word_bpe_49k.json")), 0
    got = sorted(map(tuple, four.op4_token_files(spark, d).collect()), key=lambda r: r[1])
    ids = [i for i, *_ in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    texts = {}
    for i, t in docs(spark, d):
        texts.setdefault(i, []).append(np.array(library.encode(t, add_special_tokens=False).ids + [1], "<u4"))
    for i, at, n, crc in got:
        assert at == start
        start += n
        k = next(k for k, x in enumerate(texts[i]) if len(x) == n and zlib.crc32(x.tobytes()) == crc)
        texts[i].pop(k)
    assert not any(texts.values())


def test_small_files_and_random_access(spark, sf, tmp_path):
    folder = str(tmp_path / "f")
    four.write_token_files(spark.read.parquet(f"{sf}/documents.parquet"), folder, P.path("word_bpe_49k.json"), None, file_ids=2000)
    files = [four.TokenFile(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).collect()]
    assert len(files) > 20
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    library, texts = load_tokenizer(P.path("word_bpe_49k.json")), {r.doc_id: r.text for r in rows}
    for f in files:
        assert f.doc_ids(1, f.n_docs) == f.doc_ids(0, f.n_docs)[1:]
        for i, doc in enumerate(f.doc_ids(0, f.n_docs)):
            assert f.document(i).tolist() == library.encode(texts[doc], add_special_tokens=False).ids


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 1, 7, 900, 900, 1 << 40], list(range(500)), [2**64 - 1], [0, 2**63, 2**64 - 1], [0, 5 << 57, 7 << 60]])
def test_elias_fano(values):
    coded, end = four.EliasFano.load(memoryview(four.EliasFano.of(np.array(values, np.uint64)).dump()), 0)
    assert coded.access(np.arange(len(values))).tolist() == values == coded.all().tolist()
    assert [int(coded.access(np.array([i]))[0]) for i in range(len(values))] == values


def test_elias_fano_over_many_blocks():
    rng = np.random.default_rng(2)
    values = np.sort(np.concatenate([rng.integers(0, 1 << 40, 30_000, dtype=np.uint64), np.full(40_000, 1 << 39, np.uint64), rng.integers(0, 1 << 20, 90_000, dtype=np.uint64)]))
    coded = four.EliasFano.of(values)
    at = rng.permutation(len(values))[:20_000]
    assert (coded.access(at) == values[at]).all() and (coded.all() == values).all()
    assert coded.spans.nbytes + coded.blocks.nbytes < 0.05 * len(coded.upper)


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(0, 2000, 5000))
    assert len(four.EliasFano.of(values).dump()) * 8 < 5000 * (3 + np.log2(1000)) + 200


@pytest.mark.parametrize("where", ["sf", "odd_docs", "empty_docs"])
def test_tiktoken(spark, where, request):
    import tiktoken

    d = request.getfixturevalue(where)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(i, len(x := library.encode_ordinary(t)), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in docs(spark, d)]
    assert sorted(map(tuple, seven.op7_byte_bpe(spark, d).collect()), key=str) == sorted(want, key=str)


def test_encode_then_decode(spark, odd_docs):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    df = seven.encode(spark.read.parquet(f"{odd_docs}/documents.parquet"), path, P.PATTERN, split_chars=50)
    for r in seven.decode(df, path, P.PATTERN).collect():
        assert r.decoded.decode() == (r.text or "")


def test_long_white_space_is_what_the_library_makes_of_it():
    codec = seven.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rng = random.Random(5)
    for text in ("a" + " " * 20_000 + "b", "\n" * 30_000, " " * 15_000 + "\n!", "x\u3000" * 3 + "\u3000 " * 9_000 + "y" + "\t" * 12_000 + "7", " \n\x85\u00a0" * 6_000 + " 's", "\x1c" * 20_000 + "z"):
        assert codec.encode(text) == codec.library.encode_ordinary(text)
    for _ in range(20):
        text = "".join(rng.choice(["word ", "\n" * rng.randrange(9_990, 10_020), " " * rng.randrange(9_990, 10_020), "'s", "9"]) for _ in range(12))
        assert codec.encode(text) == codec.library.encode_ordinary(text)
    for blank in " \n":
        text = "start" + blank * 5_000_000 + "end"
        ids = codec.encode(text)
        assert codec.decode(ids) == text.encode() and ids[-1:] == codec.library.encode_ordinary(blank + "end")[-1:]
