"""Queries against their SQL on small tables of odd texts."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from hushframe.queries import ORACLE_SQL, QUERIES


def both(spark, folder, name, texts):
    """Rows of a query, and of its SQL, over documents of these texts."""
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet')")
    told = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in told.description]
    return sorted(map(tuple, QUERIES[name](spark, str(folder)).select(*columns).collect())), sorted(told.fetchall())


def test_a_value_that_overlaps_itself_is_pushed_out(spark, tmp_path):
    from hushframe import asking_queries  # noqa: F401

    # the third part is there once, and four or five places before as well, at edges of words or within one, or with a blank at its end
    texts = ["Abcdefg de, de, de and more", "Abcdef (of) (of) (of).", "Abcdefg de, de, dex", "Abcdefgxde, de, de and more", "Abcdefg DE, de, DE,", "Abcdefghi of of of or", "Abcdefghijkl unlike it all"]
    texts = [t + "." * (len(t) % 5 == 0) for t in texts]
    got, want = both(spark, tmp_path, "model_detection_chunks", texts)
    assert got == want
    assert [[r[2] for r in got if r[0] == k] for k in range(len(texts))] == [[0], [0], [0], [0, 12], [0], [0, 12], [0, 12]]


def plan(spark, folder, name):
    """What is planned to run, without what a scan is told."""
    both(spark, folder, name, ["x"])
    text = QUERIES[name](spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    return "\n".join(line for line in text.split("\n") if "FileScan" not in line)


def test_steps_try_each_rule_once(spark, tmp_path):
    from hushframe import stage_queries  # noqa: F401

    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 20))
    told = plan(spark, tmp_path, "steps_in_a_row")
    assert told.count("regexp_extract_all(") == 6 and told.count(" split(") + told.count("(split(") == 6
    texts = ["", "a@b.cc 1.2.3.4", "1234567890123456 " * 3 + "https://x.yy/a@b.cc", "+49 123 456 78 and 10.0.0.1"]
    got, want = both(spark, tmp_path, "steps_in_a_row", texts)
    assert got == want == [(1, 2), (2, 4), (3, 2)]


def test_occurrences_are_searched_once(spark, tmp_path):
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 20))
    # one search for the span that is given, one for all, and one for the texts of many
    assert plan(spark, tmp_path, "expand_occurrences").count("(?iu)") == 3
    texts = ["and", "hand sand", "And AND and, and-and; land and\u00e9 and_ \U0001f600 and" * 40, "none", "", "and " * 5000]
    got, want = both(spark, tmp_path, "expand_occurrences", texts)
    assert got == want and [n for _, n in got][-1] == 5000


def test_lines_are_exchanged_once(spark):
    from hushframe import run_queries  # noqa: F401

    told = QUERIES["server_answers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert told.count("Exchange ") == 1


def test_answers_are_read_once_a_step(spark, tmp_path, monkeypatch):
    from hushframe import asking_queries
    from hushframe.operators import model

    pq.write_table(pa.table({"doc_id": pa.array([1], pa.int64()), "text": ["Abcdefghijklmnopqr some"]}), f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 22))
    told, answers = [], model.answers

    def seen(df, *a, **k):
        told.append(df._jdf.queryExecution().optimizedPlan().toString())
        return answers(df, *a, **k)

    monkeypatch.setattr(model, "answers", seen)
    asking_queries._run(spark, str(tmp_path))
    assert [plan.count("$.entities") for plan in told] == [0, 1, 1]


def test_language_batches_are_bounded_by_text():
    from hushframe.llm.langid import _pieces

    texts = ["x" * 300, None, "", "y" * 700, "z" * 5000, "a"] + ["b"] * 9
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "t"])
    got = [p.column(1).to_pylist() for p in _pieces(batch, 1, 4, 1000)]
    assert [len(p) for p in got] == [4, 1, 4, 4, 2] and sum(got, []) == texts
