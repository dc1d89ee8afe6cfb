import re

import duckdb
import pytest

from docloom.llm import op6_license_scan as six


def by_hand(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, n) for p, n in six.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({n for _, n in places}))


@pytest.mark.parametrize("where", ["sf", "odd_docs", "empty_docs"])
def test_places_and_oracle(spark, where, request):
    d = request.getfixturevalue(where)
    got = sorted(map(tuple, six.op6_license_scan(spark, d).collect()), key=str)
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    assert sorted((r[:6] for r in got), key=str) == sorted(((r.doc_id, *by_hand(r.text)) for r in rows), key=str)
    import glob

    con = duckdb.connect()
    files = f"{d}/documents.parquet" + ("/*.parquet" if len(glob.glob(f"{d}/documents.parquet/*")) else "")
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{files}'")
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(con.sql(f"SELECT {', '.join(names)} FROM ({six.ORACLE})").fetchall(), key=str) == got


def test_bands(spark):
    apache = "You may not use this file except in compliance with the License. You may obtain a copy of the License at"
    texts = {
        1: f"x y {apache} z", 2: "x " + apache.replace("file except", "file, please, except"), 3: apache[:40], 4: "", 5: None,
        6: "Licensed under CC BY-NC 4.0.", 7: " ".join([apache] * 3), 8: "Mit License; the MIT-license, apache\nlicense general public license",
        9: "use this file use this file use this file", 10: apache.replace(" ", " q "),
    }
    got = {r.doc_id: r for r in six.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark).collect()}
    assert got[1].labels == got[2].labels == got[7].labels == "apache" and got[1].score == 1.0 and 0.75 <= got[2].score < 1
    assert got[3].labels == got[4].labels == got[5].labels == got[9].labels == got[10].labels == "" and got[4].score == 0
    assert got[6].labels == "cc-by-nc" and got[6].base_labels == ""
    assert got[8].base_labels == "apache,gpl,mit" and got[8].n_base == 4 and got[8].score == 1
