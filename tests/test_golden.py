"""Cases worked out by hand, and properties, for what SQL can't check."""

import io
import random
import zipfile
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as t
from docloom.operators import analysis, chunking, context, conversation, evaluation, filenames, metadata, registry, rerank, search
from docloom.sources import pdf, readers, settings, sinks
from docloom.streaming import index


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("c"))).collect()]


def test_voltage_and_numbers(spark):
    names = ["10kV", "110kV", "220KV站", "35千伏", "1000kV", "特高压", "x"]
    assert column(spark, names, metadata.voltage) == ["10kV", "10kV", "20kV", "35kV", "750kV+", "750kV+", None]
    assert column(spark, ["110kV", "220kV", "10kV"], lambda c: metadata.voltage(c, strict=True)) == ["110kV", "220kV", "10kV"]
    codes = ["GB50217-2018", "GB/T 50217-2018", "GB_50217-2018", "DL/T 5352-2018", "Q/GDW 1738-2012", "闽电发展〔2015〕241号", "none"]
    assert column(spark, codes, metadata.doc_number) == ["GB50217-2018", None, None, None, "Q/GDW 1738-2012", "闽电发展〔2015〕241号", None]
    assert column(spark, codes, lambda c: metadata.doc_number(c, fixed=True))[1:4] == ["GB/T 50217-2018", "GB_50217-2018", "DL/T 5352-2018"]


def test_white_space_and_names(spark):
    assert column(spark, ["　 a b \n", "\t", "３"], t.strip) == ["a b", "", "３"]
    assert column(spark, ["a.b.pdf", ".hidden", "noext", "x.PDF"], t.stem) == ["a.b", ".hidden", "noext", "x"]
    assert column(spark, ["a.b.pdf", ".hidden", "noext", "x.PDF"], t.extension) == [".pdf", "", "", ".pdf"]


@pytest.mark.parametrize("n", [0, 1, 1535, 1536, 1537, 2880, 2881, 50_000, 50_001, 60_000])
def test_forced_windows(spark, n):
    text = "".join(chr(97 + i % 26) for i in range(n))
    want = [text[a:b] for a, b in chunking.spans(0, len(text), 1536, 192)]
    got = chunking.forced_split(spark.createDataFrame([(text,)], "text string")).orderBy("chunk_index").collect()
    assert [r.chunk_text for r in got] == want
    assert "".join(w if i == 0 else w[192:] for i, w in enumerate(want)) == text


def test_split_by_hand():
    # the lead is added on the third level, and again on the two above it
    assert chunking.split("aaa\nbbb\nccc", 7, 2) == ["aaa\nbbb", "bb\nbb\nbb\nccc"]
    assert chunking.split("aaa\n\n\nbbbbb", 7, 2) == ["aaa", "aa\nbbbbb"]
    assert chunking.split("short", 7, 2) == ["short"] and chunking.split("", 7, 2) == [""]
    assert chunking.split("ab cd ef", 5, 0) == ["ab cd", "ef"]


def test_split_loses_nothing():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["甲", "乙。", "丙；", " ", "\n", "\n\n", "x", ". ", "，"]) for _ in range(rng.randrange(0, 400)))
        pieces = chunking.split(text, 40, 8)
        rest = iter("".join(pieces))
        assert all(c in rest for c in text if c not in " \n。；，.")


def test_blank_pieces_keep_their_index(spark):
    text = "a" * 1500 + "\n\n\n" + " " * 1600 + "\n\n\n" + "b" * 1500
    rows = chunking.semantic_chunks(spark.createDataFrame([("h", text)], "file_hash string, text string")).collect()
    assert rows[0].chunk_index == 0 and rows[-1].total_chunks >= len(rows) and len({r.chunk_index for r in rows}) == len(rows)


def test_query_analysis(spark):
    asked = ["GB50060-2008 适用范围", "变电站和配电室的区别", "变电站主变", "架空线路导线与配电网", "你好", "主变与围墙安全距离是多少 2019年"]
    df = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    got = {r.query_id: r for r in analysis.analyze(df).collect()}
    assert got[0].query_type == "document_lookup" and got[0].domain is None and got[0].filter_expr == 'doc_number like "%GB50060-2008%"'
    assert got[1].query_type == "cross_domain_comparison" and got[1].parallel_domains == ["变电", "配电"] and got[1].domain == "变电"
    assert got[2].domain == "变电" and got[3].domain == "送电输电" and got[4].query_type == "general_qa" and got[4].filter_expr is None
    assert got[5].query_type == "specification_lookup" and got[5].year == 2019 and got[5].expanded_query.endswith("净距 间距 安全净距")


def test_files_in_queries(spark):
    files = [("h1", "01会议材料之一2022年.docx", None), ("h2", "02会议材料之二2023年.docx", None), ("h3", "GB50060-2008 变电站设计规范.pdf", "GB50060-2008"), ("h4", "report.txt", "闽电发展〔2015〕241号")]
    asked = ["会议材料一讲了什么", "《GB50060-2008 变电站设计规范》", "看report.txt", "闽电发展〔2015〕241号", "02会议材料之二", "nothing"]
    matches = filenames.detect(spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"), spark.createDataFrame(files, "file_hash string, file_name string, doc_number string"))
    best = {r.query_id: (r.file_hash, r.strategy, r.match_score) for r in filenames.best_file(matches).collect()}
    assert best[0] == ("h1", "phrase", 0.85) and best[1] == ("h3", "candidate", 0.95) and best[3] == ("h4", "number", 0.8) and best[4][0] == "h2" and 5 not in best
    assert best[2][0] == "h4"


def test_detection_by_keys_finds_what_all_pairs_do(spark):
    parts = ["01", "02", "会议材料", "材料", "之一", "之三", "之12", "设计", "GB50060-2008", "闽电发展〔2015〕241号", " ", ".", "规范", "a", "report", "x1", "文件", "《", "》", '"', ".pdf", ".docx", "2022年"]
    rng = random.Random(8)
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 7))) for _ in range(500)]
    files = spark.createDataFrame([(f"h{i}", x + rng.choice([".pdf", ".docx", "", "之一.txt"]), rng.choice([None, "", "GB50060-2008", "榕闽电发展〔2015〕241号"])) for i, x in enumerate(texts[:250])], "file_hash string, file_name string, doc_number string")
    asked = spark.createDataFrame(list(enumerate(texts[250:])), "query_id int, query string")
    queries, sides = filenames.sides(asked, files)
    every = sorted(map(tuple, filenames.claims(queries.crossJoin(sides), 0.4).collect()))
    assert sorted(map(tuple, filenames.detect(asked, files).collect())) == every and len({r[3] for r in every}) == 5


def test_queries_in_blocks(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "chunk_id int, dense array<double>")
    near = lambda **most: sorted(map(tuple, search.dense_search(vectors.withColumnRenamed("chunk_id", "query_id"), vectors, 5, **most).collect()))
    assert near(block=7) == near() and len(near()) == 300


def test_searches_of_odd_rows(spark):
    chunks = spark.createDataFrame([("a", [1.0, 0.0], ["x", "y"], "p"), ("b", [0.0, 0.0], [], None), ("c", None, None, "p"), ("d", [1.0], ["x"], "q"), ("e", [None, 1.0], ["y", "y"], "q")], "chunk_id string, dense array<double>, words array<string>, domain string")
    asked = spark.createDataFrame([(1, [2.0, 0.0], ["x"], None), (2, [1.0, 1.0], ["y", "z"], "p"), (3, None, None, "q"), (4, [3.0], ["x"], "none")], "query_id int, dense array<double>, words array<string>, domain string")
    rows = lambda df: sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in df.collect())
    assert rows(search.dense_search(asked, chunks, 3)) == [(1, 1, "a", 1.0), (1, 2, "b", 0.0), (2, 1, "a", 0.7071), (2, 2, "b", 0.0), (4, 1, "d", 1.0)]
    assert rows(search.sparse_search(asked, chunks, 3)) == [(1, 1, "a", 1.0), (1, 2, "d", 1.0), (2, 1, "e", 1.6931), (2, 2, "a", 1.0), (4, 1, "a", 1.0), (4, 2, "d", 1.0)]
    assert rows(search.sparse_search(asked, chunks, 3, conditions={"domain": "equal"})) == [(1, 1, "a", 1.0), (1, 2, "d", 1.0), (2, 1, "a", 1.0)]
    assert search.dense_search(asked.limit(0), chunks, 3).count() == search.sparse_search(asked, chunks.limit(0), 3).count() == 0


def test_chunk_limit_is_of_each_file(spark):
    rows = spark.createDataFrame([(f"{f}", f"{f}_{i}", i, None) for f in "abc" for i in range(6)], "file_path string, chunk_id string, chunk_index int, page_num int")
    assert [r.chunk_id for r in search.ordered_chunks(rows, F.lit(True), 4).collect()] == [f"{f}_{i}" for f in "abc" for i in range(4)]


def test_rerank_keeps_short_lists(spark):
    rows = [(1, "q", None, None, i, 1.0 / i, f"c{i}", None, f"d/f{i}.pdf", "标准规范" if i == 3 else "", "", False, "", "") for i in range(1, 5)]
    df = spark.createDataFrame(rows, "query_id int, query string, asked_domain string, asked_voltage string, rank int, score double, chunk_id string, doc_number string, file_path string, category string, publish_level string, is_drawing boolean, domain string, voltage_level string")
    assert [r.chunk_id for r in rerank.rerank(df, 4).orderBy("fine_rank").collect()] == ["c1", "c2", "c3", "c4"]
    assert [r.fine_score for r in rerank.rerank(df, 3).orderBy("fine_rank").collect()] == [1.0, 0.5, round(1.03 / 3, 6)]


def test_series_and_answers(spark):
    assert column(spark, ["01会议材料之一", "第三章 设计", "x"], context.series_key) == ["会议材料之", "第三章", None]
    assert column(spark, ["<think>a\nb</think>\n答"], context.without_thoughts) == ["答"]
    short = column(spark, ["x" * 10, "x" * 11], lambda c: context.shortened(c, 10))
    assert short[0] == "x" * 10 and "（11字符），已截断至10字符" in short[1]


def test_conversations(spark):
    assert conversation.estimate("你好ab") == 1 and column(spark, ["你好ab", "汉" * 3 + "abcd", ""], conversation.tokens) == [1, 3, 0]
    for n in (6, 7, 40):
        turns = [("user" if i % 2 == 0 else "assistant", f"第{i}条消息的内容比较长一些。结束") for i in range(n)]
        kept, summary, total, times = conversation.fold(turns, 20)
        assert len(kept) == min(n, 6) or times == 0
        assert (times > 0) == (n > 6) and (not summary or len(summary.split("\n")) <= 20)
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"message number {i} is here") for i in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, content string")
    once = conversation.folded(df.where("turn < 7"), 40).first()
    assert once.compressions == 1 and once.kept == 6 and once.summary == "用户询问: message number 0 is here"


def test_rouge_and_facts(spark):
    rng = random.Random(2)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for _ in range(100):
        a, b = ("".join(rng.choice("abc甲") for _ in range(rng.randrange(0, 90))) for _ in range(2))
        assert evaluation.lcs(a, b) == slow(a, b) == evaluation.lcs(b, a)
    got = evaluation.rouge_l(spark.createDataFrame([("a b c", "abd"), ("", "x"), (None, None)], "r string, c string"), "r", "c").collect()
    assert got[0].rouge_l_f1 == pytest.approx(2 / 3) and got[1].rouge_l_f1 == 0 and got[2].rouge_l_f1 == 0
    assert column(spark, ["GB 50545-2010, 净距不小于 1.5m", "短"], evaluation.fact_parts)[1] == ["短"]


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, f"c{i}", i) for i in range(1, 51)] + [(2, "c1", 1)], "question_id int, chunk_id string, rank int")
    relevant = spark.createDataFrame([(1, "c1"), (1, "c10"), (1, "c60")], "question_id int, chunk_id string")
    got = {r.question_id: r for r in evaluation.layer1(spark.createDataFrame([(1,), (2,), (3,)], "question_id int"), ranked, relevant).collect()}
    assert got[1].recall_at_10 == pytest.approx(2 / 3, abs=1e-6) and got[1].precision_at_5 == 0.2 and got[1].mrr == 1 and got[2].mrr == got[3].hit_rate == 0
    assert column(spark, [12.5, 37.5, 100.0], lambda c: evaluation.bar(c, 4), "double") == ["░░░░", "██░░", "████"]


def test_registry_steps(spark):
    rows = [("a", "completed", "e", 0, "1"), ("b", "failed", "e", 0, "1")]
    base = spark.createDataFrame(rows, "file_hash string, status string, error_message string, reindex_count long, updated_at string")
    new = spark.createDataFrame([("a", "completed"), ("b", "completed"), ("c", None)], "file_hash string, status string")
    got = {r.file_hash: r for r in registry.upsert(base, new, F.lit("2")).collect()}
    assert (got["a"].reindex_count, got["a"].error_message, got["b"].reindex_count, got["c"].status, got["c"].updated_at) == (1, "", 0, None, "2")
    assert registry.batch_result(base.limit(0)).first().success_rate == 0
    iso, _ = registry.at_eight(F.lit(datetime(2024, 1, 1, 20)))
    assert spark.range(1).select(iso).first()[0] == "2024-01-02T04:00:00+08:00"


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_readers(spark, tmp_path):
    w = 'xmlns:w="w"'
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("文本\xff".encode("utf-8") + b"\xff")
    (tmp_path / "sub" / "b.docx").write_bytes(zipped({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>段落</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>一</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>二</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"}))
    (tmp_path / "c.xlsx").write_bytes(zipped({"xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="表" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/s1.xml"/></R>', "xl/sharedStrings.xml": "<sst><si><t>甲</t></si></sst>", "xl/worksheets/s1.xml": '<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row><c><v> </v></c></row></sheetData></worksheet>'}))
    (tmp_path / "d.ofd").write_bytes(zipped({f"Doc_0/Pages/Page_{i}/Content.xml": f"<P><TextCode>第{i}</TextCode></P>" for i in (2, 10)}))
    (tmp_path / "e.pptx").write_bytes(zipped({f"ppt/slides/slide{i}.xml": f"<s><p><t>片{i}</t></p></s>" for i in (2, 10)}))
    (tmp_path / "f.docx").write_bytes(b"broken")
    (tmp_path / "g.bin").write_bytes(b"\0")
    (tmp_path / "h.doc").write_bytes("\x00这是一个测试文档内容\x00ab".encode("utf-16-le"))
    got = {r.file_name: r for r in readers.parsed(readers.scan(spark, str(tmp_path))).collect()}
    assert got["a.txt"].text == "文本ÿ" and got["b.docx"].text == "段落\n[表格1]\n一 | 二" and got["c.xlsx"].text == "[Sheet: 表]\n甲 | 5"
    assert got["d.ofd"].text == "第10\n\n第2" and got["e.pptx"].text == "片2\n\n片10" and "BadZipFile" in got["f.docx"].error
    assert got["g.bin"].text is None and got["g.bin"].error is None and "测试文档" in got["h.doc"].text
    assert readers.scan(spark, str(tmp_path), [".docx"], 1).count() == 1


def test_stream_equals_batch(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("file_hash", F.sha2("text", 256))
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second start finds nothing new
        index.indexed(index.documents(spark, str(tmp_path / "in"), docs.schema, 1), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "chunks")).select("chunk_id", "chunk_text").collect()
    want = chunking.text_chunks(docs.dropDuplicates(["file_hash"])).select("chunk_id", "chunk_text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert spark.read.parquet(str(tmp_path / "out" / "registry")).count() == docs.select("file_hash").distinct().count()


def a_pdf(contents, packed=True):
    """A PDF of these pages' content streams; the second font maps its codes."""
    cmap = b"1 beginbfchar <0001> <4F60> endbfchar 1 beginbfrange <0002> <0004> <0061> endbfrange"
    flate = lambda raw: b"<< /Filter /FlateDecode >>\nstream\n" + zlib.compress(raw) + b"\nendstream"
    kids = b" ".join(b"%d 0 R" % (10 + i) for i in range(len(contents)))
    objects = {2: b"<< /Type /Pages /Kids [" + kids + b"] >>", 3: b"<< /F1 4 0 R /F2 5 0 R >>", 4: b"<< /Type /Font >>", 5: b"<< /Type /Font /ToUnicode 6 0 R >>", 6: flate(cmap)}
    for i, c in enumerate(contents):
        objects[10 + i] = b"<< /Type /Page /Parent 2 0 R /Resources << /Font 3 0 R >> /Contents %d 0 R >>" % (50 + i)
        objects[50 + i] = flate(c) if packed else b"<< >>\nstream\n" + c + b"\nendstream"
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % o for o in objects.items()) + b"trailer << >>\n%%EOF"


def test_pdf_pages(spark):
    one = rb"BT /F1 12 Tf 72 700 Td (Hello \(PDF\) w\157rld) Tj 0 -14 Td [(sec) -20 (ond)] TJ T* (third) Tj ET"
    two = b"BT /F2 9 Tf 1 0 0 1 5 5 Tm <000100020004> Tj ET"
    files = [("a", a_pdf([one, two, b""])), ("b", a_pdf([two] * 12, packed=False)), ("c", b"no pdf"), ("d", None)]
    rows = pdf.page_rows(spark.createDataFrame(files, "path string, content binary")).collect()
    got = {(r.path, r.page_num): r.text for r in rows}
    assert got["a", 1] == "Hello (PDF) world\nsecond\nthird" and got["a", 2] == "你ac" and got["a", 3] == ""
    assert [got["b", i] for i in range(1, 13)] == ["你ac"] * 12
    assert {r.path: r.error for r in rows if r.error} == {"c": "ValueError: not a PDF", "d": "ValueError: not a PDF"}
    scanned = {r.doc: (r.pages, r.is_scanned) for r in chunking.scan_rule(pdf.page_rows(spark.createDataFrame(files[:2], "path string, content binary")).withColumnRenamed("path", "doc")).collect()}
    assert scanned == {"a": (3, True), "b": (12, True)}


def test_fonts_of_ofd():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("Doc_0/PublicRes.xml", '<ofd:Font ID="7" FontName="FZ_GBK"/><ofd:Font ID="8" FontName="SimSun"/>')
        z.writestr("Doc_0/Pages/Page_0/Content.xml", b'<ofd:TextObject ID="1" Font="7"><ofd:TextCode X="1">' + "电缆".encode("gbk") + b'</ofd:TextCode></ofd:TextObject><ofd:TextObject Font="8"><ofd:TextCode>' + "a&lt;接地".encode() + b"</ofd:TextCode></ofd:TextObject>")
    assert readers.ofd(out.getvalue()) == "电缆\na<接地"


def test_chunk_table_and_reports(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("file_hash"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), "text")
    sinks.write_chunks(rows, str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert table.count() == rows.count() and set(table.columns) == {*sinks.CHUNK.fieldNames(), "bucket"}
    one = rows.first()
    assert [r.chunk_id for r in sinks.read_chunks(table, one.file_hash).collect()] == [one.chunk_id]
    averages = spark.createDataFrame([("a", 0.5, None)], "category string, mrr double, n int")
    assert sinks.markdown(averages, "T") == "# T\n\n| category | mrr | n |\n|---|---|---|\n| a | 0.5000 |  |\n"
    path = tmp_path / "c.json"
    path.write_text('{"paths": {"db": "x/y.db", "abs": "/z"}, "k": 1}')
    assert settings.load(str(path)) == {"paths": {"db": f"{tmp_path}/x/y.db", "abs": "/z"}, "k": 1, "_project_root": str(tmp_path)}
