from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from murmura import session
from murmura.plans import programs
from murmura.sources import lines as L


@pytest.fixture(params=["true", "false"])
def ansi(spark, request):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield
    spark.conf.set("spark.sql.ansi.enabled", before)


def write(tmp_path, text, name="data.txt"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_reviews(spark, tmp_path, ansi):
    path = write(tmp_path, "P1,U1,4.5,100\nP2,U1,1,7,more,columns\nP3,U2,2,9,,\n")
    assert [tuple(r) for r in L.read_reviews(spark, path).collect()] == [
        ("P1", "U1", 4.5, 100), ("P2", "U1", 1.0, 7), ("P3", "U2", 2.0, 9)
    ]


@pytest.mark.parametrize("line", ["P1,U1,bad,100", "P1,U1,1,late", "P1,U1,1", "P1,U1,1,1.5", ""])
def test_bad_reviews_fail_whatever_is_selected(spark, tmp_path, ansi, line):
    path = write(tmp_path, "P0,U0,1,1\n" + line + "\n")
    with pytest.raises(Exception, match="not a"):
        L.read_reviews(spark, path).select("product").collect()


def test_labelled_points(spark, tmp_path, ansi):
    path = write(tmp_path, "40.5,-74.25,1\n1,2,0\n")
    rows = L.read_labelled_points(spark, path).collect()
    assert [(list(r.x), r.cluster) for r in rows] == [([40.5, -74.25], 1), ([1.0, 2.0], 0)]
    assert len({r.id for r in rows}) == 2
    for line in ("1,2,0.5", "1,x,0"):
        with pytest.raises(Exception, match="not a"):
            L.read_labelled_points(spark, write(tmp_path, line)).collect()


def test_points_of_any_dimension(spark, tmp_path, ansi):
    path = write(tmp_path, "1 2.5 -3e2\n4 5 6 \n")
    rows = L.read_points(spark, path).collect()
    assert [list(r.x) for r in rows] == [[1.0, 2.5, -300.0], [4.0, 5.0, 6.0]]
    assert L.read_points(spark, write(tmp_path, "7\n8\n", "one.txt")).count() == 2
    with pytest.raises(Exception, match="not a"):
        L.read_points(spark, write(tmp_path, "1  2\n")).collect()


def test_numbers(spark, tmp_path, ansi):
    path = write(tmp_path, "1.5 2\n\n  3\t4\n   \n5\n")
    assert sorted(r.value for r in L.read_numbers(spark, path).collect()) == [1.5, 2, 3, 4, 5]
    with pytest.raises(Exception, match="not a"):
        L.read_numbers(spark, write(tmp_path, "1 two")).collect()


def test_documents_and_splits(spark, tmp_path):
    path = write(tmp_path, "".join(f"line {i}\n" for i in range(2000)))
    before = spark.conf.getAll
    docs = L.read_documents(spark, path, min_partitions=4)
    assert docs.select(F.countDistinct("doc_id")).first()[0] == 2000
    assert docs.rdd.getNumPartitions() == 4
    assert spark.conf.getAll == before


def test_top_products(spark, tmp_path):
    path = write(tmp_path, "P1,U1,5,1\nP2,U1,1,1\nP1,U2,4,1\nP3,U2,2,1\n")
    assert [r.line for r in programs.top_products(spark, path, 2).collect()] == [
        "P1: best normalized rating 2.0", "P3: best normalized rating -1.0"
    ]


def test_word_statistics_agree(spark, tmp_path):
    path = write(tmp_path, "a bb a\nccc bb\n\nd\n")
    rows = programs.word_statistics(spark, path).collect()
    assert len({tuple(r)[1:] for r in rows}) == 1
    assert tuple(rows[0])[1:] == (4, 4, 1, 10 / 6, 7 / 4)


def test_number_programs(spark, tmp_path):
    path = write(tmp_path, "1 2 3 4\n5 6 7 8 9 10\n")
    assert programs.sum_of_squares(spark, path).first()[0] == 385.0
    shown = [r.line for r in programs.histogram(spark, path).collect()]
    assert shown[0] == "[0,0.1] holds 1" and shown[-1] == "(0.9,1.0] holds 1"


def test_clustering_programs(spark, tmp_path):
    spots = [(0, 0), (0, 1), (9, 9), (9, 8), (0, 2), (8, 9)]
    labelled = write(tmp_path, "".join(f"{x},{y},{int(x > 5)}\n" for x, y in spots), "l.txt")
    plain = write(tmp_path, "".join(f"{x} {y}\n" for x, y in spots), "p.txt")
    row = programs.silhouettes(spark, labelled, 100).first()
    assert row.approximate == pytest.approx(row.exact_of_sample)
    assert row.line.startswith("silhouette by the sample 0.9")
    assert [r.k for r in programs.sweep(spark, plain, 1, 3, 5, 100).collect()] == [1, 2, 3]
    assert programs.kmedian(spark, plain, 2, 2, 2).first().objective < 2
    trials = programs.kmedian_trials(spark, plain, [1, 2], [0, 2], 3).collect()
    assert all(r.lowest <= r.average <= r.highest and r.trials == 3 for r in trials)


def test_print_report(spark, tmp_path, capsys):
    path = write(tmp_path, "P1,U1,5,1\nP2,U1,1,1\n")
    programs.print_report(programs.top_products(spark, path, 1))
    assert capsys.readouterr().out == "P1: best normalized rating 2.0\n"


def test_files_are_parsed_once(spark, tmp_path, monkeypatch):
    reviews = write(tmp_path, "P1,U1,5,1\nP2,U1,1,1\n", "r.txt")
    labelled = write(tmp_path, "".join(f"{i},{i % 2 * 9},{i % 2}\n" for i in range(6)), "l.txt")
    leaves, run = [], programs.taken

    def watched(df):
        with_cache = df._jdf.queryExecution().withCachedData().collectLeaves()
        leaves.extend(with_cache.apply(i).nodeName() for i in range(with_cache.size()))
        return run(df)

    monkeypatch.setattr(programs, "taken", watched)
    assert programs.top_products(spark, reviews, 1).count() == 1
    assert leaves and set(leaves) == {"InMemoryRelation"}
    assert programs.silhouettes(spark, labelled, 10).first().approximate > 0.5


def test_no_program_reads_its_file_again(spark, tmp_path, monkeypatch):
    """The file is taken away once it is parsed; what is parsed is released at the end."""
    spots = [(0, 0), (0, 1), (9, 9), (9, 8), (0, 2), (8, 9)]
    numbers, texts, points, labelled, reviews = (str(tmp_path / name) for name in "ntplr")
    contents = {
        numbers: "1 2 3 4\n5 6 7 8 9 10\n",
        texts: "a bb a\nccc bb\n",
        points: "".join(f"{x} {y}\n" for x, y in spots),
        labelled: "".join(f"{x},{y},{int(x > 5)}\n" for x, y in spots),
        reviews: "P1,U1,5,1\nP2,U1,1,1\n",
    }
    run = programs._from_parsed
    for path, program in (
        (numbers, lambda: programs.histogram(spark, numbers)),
        (texts, lambda: programs.word_statistics(spark, texts)),
        (points, lambda: programs.kmedian(spark, points, 2, 2, 2)),
        (labelled, lambda: programs.silhouettes(spark, labelled, 10)),
        (reviews, lambda: programs.top_products(spark, reviews, 1)),
    ):
        with open(path, "w") as file:
            file.write(contents[path])

        def once(parsed, report, path=path):
            parsed.persist().count()
            os.remove(path)
            return run(parsed, report)

        monkeypatch.setattr(programs, "_from_parsed", once)
        assert program().count() > 0 and not os.path.exists(path)
        assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_lines_in_enough_partitions_stay_where_they_are(spark, tmp_path):
    for name in "abc":
        write(tmp_path, "1\n2\n", f"{name}.txt")
    rows = L.read_lines(spark, str(tmp_path), 1)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert L.read_lines(spark, str(tmp_path), 50).rdd.getNumPartitions() == 50


def files_below(folder):
    return [name for _, _, names in os.walk(folder) for name in names]


def test_tables_between_steps_are_removed(spark, tmp_path):
    folder = session.checkpoint_folder(spark).removeprefix("file:")
    before = files_below(folder)
    spots = [(0, 0), (0, 1), (9, 9), (9, 8), (0, 2), (8, 9)]
    labelled = write(tmp_path, "".join(f"{x},{y},{int(x > 5)}\n" for x, y in spots), "l.txt")
    plain = write(tmp_path, "".join(f"{x} {y}\n" for x, y in spots), "p.txt")
    assert programs.kmedian(spark, plain, 2, 2, 2).first().centers == 2
    assert programs.silhouettes(spark, labelled, 100).count() == 1
    assert files_below(folder) == before


def test_chain_keeps_one_table(spark):
    folder = session.checkpoint_folder(spark).removeprefix("file:")
    before = len(os.listdir(folder))
    chain, rows = session.Chain(), spark.range(5)
    with session.scratch():
        for _ in range(3):
            rows = chain.cut(rows.withColumn("id", F.col("id") + 1))
            assert len(os.listdir(folder)) == before + 1
        assert sorted(r.id for r in rows.collect()) == [3, 4, 5, 6, 7]
    assert len(os.listdir(folder)) == before
