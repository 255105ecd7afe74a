"""Publication by company, versions of reports, and recovery from writers cut short."""

import itertools
import os

import pytest
from pyspark.sql import functions as F

from tallyframe import sources, streaming
from tallyframe.operators import checking, compiling
from tallyframe.sources import publishing
from tests.test_operators import SCHEMA, by, row

FIGURES = "slug string, v int"


class Cut(Exception):
    pass


def one(spark, slug, value, year=2020):
    return spark.createDataFrame([(slug, year, "income", [str(year)], [row("Revenue", "line", [value]), row("Net profit", "total", [value / 2])])], SCHEMA)


def published(spark, path, *names):
    return by(publishing.read_published(spark, path), *names)


def test_companies_are_replaced_one_by_one(spark, tmp_path):
    at = f"{tmp_path}/t"
    of = lambda *rows: spark.createDataFrame(list(rows), FIGURES)
    names = [f"firm {i}" for i in range(40)]
    assert publishing.replace_companies(of(*[(n, i) for i, n in enumerate(names)]), of(*[(n, 0) for n in names]), at, buckets=4) == 1
    assert publishing.replace_companies(of(("firm 3", 100), ("firm 3", 101), ("firm 4", 102), (None, 5)), of(("firm 3", 0), ("firm 5", 0), (None, 0)), at) == 2
    want = sorted([(n, i) for i, n in enumerate(names) if i not in (3, 5)] + [("firm 3", 100), ("firm 3", 101)], key=str)
    assert published(spark, at, "slug", "v") == want  # firm 4 wasn't given, firm 5 has no rows left
    assert by(publishing.read_published(spark, at, version=1), "slug", "v") == sorted([(n, i) for i, n in enumerate(names)], key=str)
    assert by(publishing.read_published(spark, at, only="firm 3"), "v") == [(100,), (101,)] and publishing.read_published(spark, at, only="nobody").count() == 0
    with pytest.raises(ValueError, match="columns"):
        publishing.replace_companies(of(("a", 1)).withColumn("w", F.lit(1)), of(("a", 1)), at)
    with pytest.raises(FileNotFoundError):
        publishing.read_published(spark, f"{tmp_path}/none")


def test_only_touched_buckets_are_read_and_written(spark, tmp_path):
    at = f"{tmp_path}/t"
    every = spark.range(20_000).select(F.concat(F.lit("c"), "id").alias("slug"), F.col("id").cast("int").alias("v"))
    publishing.replace_companies(every, every, at, buckets=16)
    first = publishing.manifest(spark, at)
    files = [f for _, _, fs in os.walk(f"{at}/data") for f in fs if f.endswith(".parquet")]
    assert len(first["folders"]) == 16 and len(files) <= 16  # not one for each company
    publishing.replace_companies(every.where("v = 7").withColumn("v", F.lit(-1)), every.where("v = 7"), at)
    second = publishing.manifest(spark, at)
    assert sum(first["folders"][b] != second["folders"][b] for b in first["folders"]) == 1
    assert publishing.read_published(spark, at).agg(F.sum("v")).first()[0] == sum(range(20_000)) - 8
    changed = next(f for b, f in second["folders"].items() if f != first["folders"][b])
    assert all(changed in f for f in publishing.read_published(spark, at, only="c7").inputFiles())
    gone = publishing.vacuum(spark, at, keep=1)
    assert len(gone) == 2 and publishing.read_published(spark, at).count() == 20_000 and publishing.versions(spark, at) == [2]


def test_a_writer_cut_short_changes_nothing(spark, tmp_path):
    at = f"{tmp_path}/t"
    a, b = spark.createDataFrame([("a", 1)], FIGURES), spark.createDataFrame([("a", 2), ("b", 3)], FIGURES)
    publishing.replace_companies(a, a, at, buckets=2)

    def cut():
        raise Cut

    with pytest.raises(Cut):
        publishing.replace_companies(b, b, at, before_publish=cut)
    assert published(spark, at, "slug", "v") == [("a", 1)]
    (tmp_path / "t/manifests/.half").write_text('{"version": 2, "bu')  # a manifest that was never renamed
    assert published(spark, at, "slug", "v") == [("a", 1)]
    publishing.replace_companies(b, b, at)
    assert published(spark, at, "slug", "v") == [("a", 2), ("b", 3)]
    assert any(g.startswith("data/") for g in publishing.vacuum(spark, at, keep=2)) and published(spark, at, "slug", "v") == [("a", 2), ("b", 3)]


def test_two_writers(spark, tmp_path):
    """The second to publish merges again on what the first published."""
    at = f"{tmp_path}/t"
    of = lambda slug, v: spark.createDataFrame([(slug, v)], FIGURES)
    publishing.replace_companies(of("a", 1), of("a", 1), at, buckets=1)
    others = iter([lambda: publishing.replace_companies(of("b", 2), of("b", 2), at)])
    publishing.replace_companies(of("c", 3), of("c", 3), at, before_publish=lambda: next(others, lambda: None)())
    assert published(spark, at, "slug", "v") == [("a", 1), ("b", 2), ("c", 3)] and publishing.versions(spark, at) == [1, 2, 3]
    count = itertools.count()
    with pytest.raises(publishing.Conflict):
        publishing.replace_companies(of("c", 4), of("c", 4), at, tries=2, before_publish=lambda: publishing.replace_companies(of("d", n := next(count)), of("d", n), at))
    assert published(spark, at, "slug", "v") == [("a", 1), ("b", 2), ("c", 3), ("d", 1)]


def test_statements_and_validation_by_company(spark, tmp_path):
    none = spark.createDataFrame([], "slug string, year int, url string")
    at, checks = f"{tmp_path}/statements", f"{tmp_path}/validation"

    def write(r, status, **options):
        c = compiling.compile_statements(r)
        s = spark.createDataFrame(status, "slug string, status string")
        sources.write_validation(checking.validate(c), s, checks, buckets=2)
        return sources.write_statements(c, sources.source_list(r, none), s, at, buckets=2, **options)

    write(one(spark, "a", 1.0).union(one(spark, "b", 2.0)), [("a", "pass"), ("b", "pass")])
    write(one(spark, "a", 5.0), [("a", "warning")])
    shown = lambda: sorted({(r.slug, r.status, tuple(r["values"])) for r in sources.read_statements(spark, at).where("key like 'rev%'").collect()})
    assert shown() == [("a", "warning", (5.0,)), ("b", "pass", (2.0,))]
    assert by(sources.read_validation(spark, checks), "slug", "status") == [("a", "warning"), ("b", "pass")]
    # a strict run: the company that failed keeps its former rows, the other one gets its new ones
    write(one(spark, "a", 7.0).union(one(spark, "b", 8.0)), [("a", "fail"), ("b", "pass")], strict=True)
    assert shown() == [("a", "warning", (5.0,)), ("b", "pass", (8.0,))]
    assert write(one(spark, "a", 9.0), [("a", "pass")], dry_run=True).count() == 2 and shown() == [("a", "warning", (5.0,)), ("b", "pass", (8.0,))]
    assert [r.slug for r in sources.read_statements(spark, at, "b").select("slug").distinct().collect()] == ["b"]


def test_the_later_version_of_a_report_counts(spark):
    """Whatever the order, the partitions and the batches."""
    rows = [("a", 2020, "income", ["2020"], [row("Revenue", "line", [v])], t, f) for v, t, f in ((1.0, 10, "x"), (2.0, 30, "a"), (3.0, 30, "b"), (4.0, 20, "z"), (5.0, None, "q"))]
    new = spark.createDataFrame(rows, SCHEMA + ", modified int, file string")
    for k in range(4):
        df = new.orderBy(F.xxhash64("file", F.lit(k))).repartition(k + 1)
        assert [r["rows"][0]["values"] for r in streaming.newest_versions(df).collect()] == [[3.0]]
    first, second = new.where("file in ('a', 'b')"), new.where("file not in ('a', 'b')")
    assert [r["rows"][0]["values"] for r in streaming.merge_reports(streaming.newest_versions(first), second).collect()] == [[3.0]]
    bare = new.drop("modified", "file")  # without versions the new one counts, and of two the greater content
    assert [r["rows"][0]["values"] for r in streaming.merge_reports(bare.where("rows[0].values[0] = 4"), bare.where("rows[0].values[0] < 3")).collect()] == [[2.0]]


def stamp(path, at):
    for folder, _, files in os.walk(path):
        for f in files:
            os.utime(f"{folder}/{f}", (at, at))


@pytest.mark.parametrize("step", ["reports data", "reports manifest", "compiled data", "compiled manifest", "done"])
def test_refresh_after_a_crash_equals_one_without(spark, tmp_path, step):
    def arrive(where, batch):
        base = {0: [("a", 1.0, 2020), ("b", 2.0, 2020)], 1: [("a", 3.0, 2020), ("a", 4.0, 2021)]}[batch]
        for n, (slug, value, year) in enumerate(base):
            one(spark, slug, value, year).coalesce(1).write.parquet(f"{where}/x{batch}{n}")
            stamp(f"{where}/x{batch}{n}", 1_600_000_000 + 10 * batch)
            for f in os.listdir(f"{where}/x{batch}{n}"):
                if f.endswith(".parquet"):
                    os.rename(f"{where}/x{batch}{n}/{f}", f"{where}/{batch}{n}.parquet")

    def run(name, crash_in):
        at = tmp_path / name
        (at / "new").mkdir(parents=True)
        where = [f"{at}/{n}" for n in ("new", "reports", "compiled", "checkpoint")]
        for batch in (0, 1):
            arrive(where[0], batch)
            if batch == crash_in:
                def crash(now):
                    if now == step:
                        raise Cut(step)

                with pytest.raises(Exception, match=step):
                    streaming.refresh_incremental(spark, *where, buckets=2, crash=crash)
            streaming.refresh_incremental(spark, *where, buckets=2)
            streaming.refresh_incremental(spark, *where, buckets=2)  # nothing new
        return published(spark, where[1], "slug", "report_year", "rows"), published(spark, where[2], "slug", "key", "period_year", "value")

    want = run("whole", None)
    assert ("a", "revenue", 2020, 3.0) in want[1] and ("b", "revenue", 2020, 2.0) in want[1] and len(want[0]) == 3
    assert run("cut", 1) == want and (step != "compiled data" or run("cut at once", 0) == want)


def test_a_batch_that_is_done_does_nothing(spark, tmp_path):
    at = [f"{tmp_path}/reports", f"{tmp_path}/compiled"]
    new = one(spark, "a", 1.0).withColumn("modified", F.lit(1)).withColumn("file", F.lit("f"))
    streaming.apply_batch(new, 3, *at)
    before = [publishing.versions(spark, p) for p in at]
    streaming.apply_batch(new, 3, *at)
    streaming.apply_batch(new.withColumn("file", F.lit("g")), 2, *at)
    assert [publishing.versions(spark, p) for p in at] == before == [[1], [1]]
