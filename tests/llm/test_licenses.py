"""License scan by hand, and every operator's SQL."""

import duckdb
import pytest

from cutloom.llm import licenses, queries

TABLES = "documents embeddings pages benchmark labels conversations".split()
SCHEMA = "doc_id long, text string, n_words string, _words string, block string"


def test_odd_rows(spark):
    texts = [
        None, "", "...", "CC BY cc-by Cc\n\nby", "General Public License general PUBLIC license", "All rights reserved. all rights\nreserved all rights",
        "Released under the MIT License", "under the mit license", "x " * 20000 + "Licensed under the Apache License, Version 2.0. " + "y " * 20000,
        "Lİcensed under CC BY-NC 4.0", "ﬁ Kelvin K all rightſ reserved", "released\nunder\nthe\nmit\nlicense",
    ]
    rows = [(i, t, "a", "b", "c") for i, t in enumerate(texts)] + [(None, texts[6], "a", "b", "c"), (6, texts[6], "a", "b", "c")]
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and all(r["_words"] == "b" and r["block"] == "c" for r in got)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by[i].n_words for i in (0, 1, 2, 3)] == [0, 0, 0, 6]
    assert (by[0].n_base, by[0].first_word, by[0].base_labels, by[0].labels, by[0].score) == (0, None, "", "", 0.0)
    assert (by[3].n_base, by[3].first_word, by[3].last_word, by[3].base_labels) == (3, 0, 4, "cc-by")
    assert (by[4].n_base, by[4].base_labels, by[4].score) == (2, "gpl", 1.0)
    assert (by[5].n_base, by[5].first_word, by[5].last_word) == (2, 0, 3)
    assert (by[6].labels, by[6].score, by[6].n_base) == ("mit", 1.0, 0)
    assert (by[7].labels, by[7].score) == ("mit", 0.8)
    assert by[8].labels == "apache-2.0" and by[8].n_words == 40008
    assert "cc-by-nc" in by[9].labels and by[9].n_words == 7
    assert (by[10].n_base, by[10].n_words) == (0, 6)
    assert by[11].labels == "mit"  # line ends don't matter
    assert [r.labels for r in got if r.doc_id is None] == ["mit"]
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rare_word_order_does_not_change_results(spark):
    rows = [(i, "this work is licensed under the version " * 3) for i in range(30)] + [(99, "This work is licensed under the GNU General Public License, version 3.")]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99] == "gpl,gpl-notice" and got[0] == ""


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    got = sorted((list(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    assert got == sorted((list(r) for r in con.sql(f"SELECT {columns} FROM ({queries.ORACLE_SQL[name]})").fetchall()), key=repr)


def test_deciding_words_and_wrapped_notices(spark):
    bsd = licenses.TEMPLATES["bsd"].replace("without", "without\n#").replace("provided", "provided\n# ")
    texts = {
        "Licensed under CC BY-SA 4.0": "cc-by", "CC BY 4.0": "cc-by", "Creative Commons Attribution 4.0": "", "Released under the BSD license": "",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc-text",
        licenses.TEMPLATES["lgpl-text"]: "gpl,lgpl-text", "word " * 500 + bsd + " word" * 500: "bsd", licenses.TEMPLATES["mit-text"].upper(): "mit-text",
    }
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, `a.b` string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [got[i].labels for i in range(len(texts))] == list(texts.values()) and got[0]["a.b"] == "x"


def test_every_license_of_a_block(spark):
    two = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0."]
    texts = [" ".join(two), " ".join(two[::-1]), "\n\n".join(two), two[0] + " x" * 300 + " " + two[1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.labels for r in licenses.scan(df).collect()} == {"apache-2.0,mit"}
    # A label whose words all lie in a longer template's match goes; with a word of its own it stays.
    own = {"long": "alpha beta gamma delta epsilon zeta", "inner": "alpha beta gamma delta epsilon", "other": "alpha beta gamma delta omega"}
    got = {
        r.doc_id: r.labels
        for r in licenses.scan(
            spark.createDataFrame([(1, own["long"]), (2, own["inner"]), (3, own["long"] + " omega"), (4, "alpha beta gamma delta")], "doc_id long, text string"), templates=own, deciding={}
        ).collect()
    }
    assert got == {1: "long", 2: "long", 3: "long,other", 4: "inner"}
