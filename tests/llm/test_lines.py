"""Line dedup against a plain reading of its rule."""

import random

import pytest

from cutloom.llm import lines


def brute(rows, min_lines, min_words):
    def filled(x):
        return x.strip(" \t\r") != ""

    docs = sorted({((i is None, i or 0), t or "") for i, t, *_ in rows})
    seen, cut = set(), {}
    for key, t in docs:
        own = [(k, x) for k, x in enumerate(t.split("\n")) if filled(x)]
        texts = [x for _, x in own]
        gone = set()
        for n in range(len(own)):
            one = (texts[n],)
            if one in seen and len(texts[n].strip(" ")) - len(texts[n].strip(" ").replace(" ", "")) >= min_words - 1:
                gone.add(n)
            seen.add(one)
            run = tuple(texts[n : n + min_lines])
            if len(run) == min_lines and min_lines > 1:
                if run in seen:
                    gone |= set(range(n, n + min_lines))
                seen.add(run)
            elif min_lines == 1 and one in cut.setdefault("ones", set()):
                gone.add(n)
            cut.setdefault("ones", set()).add(one)
        cut[key, t] = ({own[n][0] for n in gone}, len(gone) == len(own), len(own), len(gone), sum(n - 1 not in gone for n in gone))
    out = []
    for i, t, *_ in rows:
        gone, all_gone, n, k, r = cut[(i is None, i or 0), t or ""]
        kept = "" if k and all_gone else "\n".join(x for j, x in enumerate((t or "").split("\n")) if j not in gone)
        out.append((str(i), t if not k else kept, n, k, r))
    return sorted(out, key=str)


SCHEMA = "doc_id long, text string, n_lines string, d string, `row` string"


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_random_lines(spark, min_lines):
    random.seed(min_lines)
    pool = ["a", "b", "c d", "one two three four", "five six seven eight nine", "", "  ", "\t"]
    rows = [(i, "\n".join(random.choices(pool, k=random.randint(0, 14))), "x", "y", "z") for i in range(60)]
    rows += [(None, "a\nb\none two three four", "x", "y", "z"), (70, None, "x", "y", "z"), (71, "", "x", "y", "z"), rows[5], rows[5], (7, rows[9][1], "x", "y", "z")]
    rows += [(80, "\n".join(f"line number {i} of this text" for i in range(3000)), "x", "y", "z")]
    rows += [(81, rows[-1][1] + "\nand one more line here", "x", "y", "z")]
    rows = [r for r in rows]
    got = lines.dedup(spark.createDataFrame(rows, SCHEMA), min_lines=min_lines).collect()
    ids = {}
    for i, t, *_ in rows:
        ids.setdefault(i, set()).add(t)
    plain = [r for r in rows if len(ids[r[0]]) == 1]  # two texts under one id have no order of their own
    if len(plain) == len(rows):
        assert sorted(((str(r.doc_id), r.text, r.n_lines, r.n_removed, r.n_runs) for r in got), key=str) == brute(rows, min_lines, 4)
    assert len(got) == len(rows)
    assert all(r.d == "y" and r.row == "z" for r in got)


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_unique_ids(spark, min_lines):
    random.seed(10 + min_lines)
    pool = ["a", "b", "c d", "one two three four", "five six seven eight nine", "", " \t"]
    rows = [(i, "\n".join(random.choices(pool, k=random.randint(0, 14))), "x", "y", "z") for i in range(60)]
    rows += [(None, "a\nb\none two three four", "x", "y", "z"), (70, None, "x", "y", "z"), (71, "", "x", "y", "z"), rows[5], rows[5]]
    got = lines.dedup(spark.createDataFrame(rows, SCHEMA), min_lines=min_lines).collect()
    assert sorted(((str(r.doc_id), r.text, r.n_lines, r.n_removed, r.n_runs) for r in got), key=str) == brute(rows, min_lines, 4)


def test_empty(spark):
    assert lines.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_runs_and_dotted_names(spark):
    long = [f"line number {i} stands here" for i in range(5000)]
    rows = [(1, "\n".join(long), "x"), (2, "\n".join(["first of all"] + long[100:] + ["end"]), "x"), (3, "\n".join(long[2000:2003]), "y")]
    got = {r.doc_id: r for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")).collect()}
    assert [(got[i].n_lines, got[i].n_removed, got[i].n_runs, got[i]["a.b"]) for i in (1, 2, 3)] == [(5000, 0, 0, "x"), (4902, 4900, 1, "x"), (3, 3, 1, "y")]
    assert got[2].text == "first of all\nend" and got[3].text == ""
