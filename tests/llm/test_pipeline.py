"""Every stage of the pipeline against a plain reading of its rule, on its own input."""

import pathlib
import re
import shutil
import subprocess
import sys

from pyspark.sql import functions as F

import corpus_pipeline
from cutloom.llm import queries
from cutloom.llm.common import written

from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_near import brute as brute_near
from tests.llm.test_pii import brute as brute_pii
from tests.llm.test_tokens import packed_right

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "personal_data", "pack"]
    before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    states = [before]
    for _, stage in corpus_pipeline.STAGES:
        states.append(written(stage(spark, states[-1], sf_dir)))
    texts = [{r.doc_id: r.text for r in s.collect()} for s in states[:-1]]
    assert all(s.columns == COLUMNS for s in states[:-1])
    # Language: only texts without a letter go.
    assert {i for i in texts[0] if i not in texts[1]} == {i for i, t in texts[0].items() if not re.search(r"[^\W\d_]", t or "")}
    # Lines.
    want = {i: t for i, t, n, k, _ in brute_lines(list(texts[1].items()), 2, 4) if not (k and k == n)}
    assert {str(i): t for i, t in texts[2].items()} == want
    # Near-duplicates: one of each group, and nothing else goes.
    groups = {}
    for i, c, _ in brute_near(list(texts[2].items())):
        groups.setdefault(c, set()).add(i)
    kept = [len(g & set(texts[3])) for g in groups.values()]
    assert all(k >= 1 for k in kept) and sum(k > 1 for k in kept) <= 0.02 * len(kept)
    # Personal data.
    for i, t in texts[4].items():
        old = texts[3][i]
        if not brute_pii(old):
            # Only secrets and disclosing terms may have been replaced.
            plain = re.escape(t).replace(re.escape("[SECRET]"), r"[\w+/=-]{20,}").replace(re.escape("[TERM]"), r"[^\W\d_]+")
            assert t == old or re.fullmatch(plain, old)
        else:
            assert not brute_pii(t) and "[" in t
    # Packing.
    assert packed_right(states[-1].collect(), texts[4]) == 0


def test_odd_documents(spark):
    rows = [(None, "die katze und der hund", "de", "s", 1), (1, None, "en", "s", None), (2, "", None, None, 0), (3, "the cat and the dog a@b.de", "en", "s", 9)]
    rows += [rows[3], (4, "the cat " * 3000, "en", None, 5), (5, "123", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""))
        if name == "language_id":
            assert sorted(str(r.doc_id) for r in docs.collect()) == ["3", "3", "4", "None"]
    assert sorted({str(r.doc_id) for r in docs.collect()}) == ["3", "4", "None"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = written(stage(spark, empty, ""))
    assert empty.count() == 0


def test_columns_with_the_operators_names_stay(spark):
    names = ["score", "lang_pred", "n_lines", "n_removed", "n_runs", "base", "spans", "a.b", "row", "words"]
    rows = [(i, f"the cat and the dog {i} x{i}@mail.de\nand more words", "en", 1, *[f"{n}{i}" for n in names]) for i in range(20)]
    schema = "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.schema
        docs = written(stage(spark, docs, ""))
        assert docs.schema.simpleString() == before.simpleString()
        assert all(r[n] == f"{n}{r.doc_id}" for r in docs.collect() for n in names)


def test_the_rest_works_without_this_part(tmp_path):
    root = pathlib.Path(corpus_pipeline.__file__).parent
    for name in ("cutloom", "__spark_entry__.py", "corpus_pipeline.py"):
        copy = shutil.copytree if (root / name).is_dir() else shutil.copy
        copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and 'pipeline' not in q and not [k for k in q if k.startswith('op')]"
    shutil.rmtree(tmp_path / "cutloom" / "llm")
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0
    (tmp_path / "corpus_pipeline.py").unlink()
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0


def test_short_documents_stay(spark):
    plain = {"de": "die katze sitzt auf dem dach und der hund schläft im garten", "en": "the cat sat on the mat and the dog slept in the yard"}
    rows = [(i, f"{plain[k]} {k * (i % 5)}", k, "s", 1) for i in range(60) for k in plain]
    words = ["Avec.", "A.", "Von.", "Osrañ.", "Erö.", "Quxpf."]
    rows += [(1000 + i, w, "en", "s", 1) for i, w in enumerate(words)] + [(1100 + i, f"{w}\n" * 400, "en", "s", 1) for i, w in enumerate(words)]
    rows += [(2000, " ".join(chr(0x4E00 + 3 * i) + chr(0x5E00 + 7 * i) for i in range(600)), None, "s", 1), (2001, "1 2 3", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # The prototypes come from the long texts; the short ones are judged by them.
    learned = docs.withColumn("lang", F.when(F.col("doc_id") < 1000, F.col("lang")))
    left = {r.doc_id for r in corpus_pipeline.language_id(spark, learned, "").collect()}
    assert {r[0] for r in rows} - left == {2000, 2001}


def test_registered():
    import __spark_entry__

    named = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in named} and "pipeline" in named
    assert set(queries.ORACLE_SQL) <= set(named)


def test_near_copies_of_equal_ids(spark):
    body = [f"w{i}" for i in range(60)]
    a, other = " ".join(body), " ".join(f"v{i}" for i in range(60))
    near, b = " ".join(["x", *body]), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, near), (0, b), (5, b + " more"), (5, other), (5, other), (7, "..."), (7, ""), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.ngram_join(spark, docs, "").collect())
    assert len(got) == 7
    assert [i for i, _ in got] == ["0", "1", "5", "7", "7", "None", "None"]
    assert ("0", b) in got and ("5", other) in got and sum(t in (a, near) for i, t in got if i == "1") == 1
