"""What loads and the reader leave on the executors' disks."""

import gzip
import re
import time

from conftest import flat_row, row_set, write_csv

from salestide.plans.refresh import refresh
from salestide.sources.shuffle_files import freed_shuffles
from salestide.sources.spanning_csv import records_of
from salestide.sources.store import SalesStore


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {name for name in names if name.startswith("shuffle_")}


def left_behind(spark, before: set[str]) -> set[str]:
    """Files that are deleted go in the background."""
    end = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    return left


def test_a_load_leaves_no_shuffle_files(spark, tmp_path):
    rows = [flat_row(order=f"o{i}", name="Lamp\n, red" if i % 3 else "Lamp") for i in range(40)]
    plain = write_csv(tmp_path / "x.csv", rows)
    packed = tmp_path / "x.csv.gz"
    packed.write_bytes(gzip.compress(open(plain, "rb").read()))
    before = shuffle_files(spark)
    report = refresh(spark, str(packed), str(tmp_path / "w"))
    assert report.counts["orders_inserted"] == 40
    assert not {f for f in left_behind(spark, before) if f.endswith(".data")}
    assert SalesStore(spark, str(tmp_path / "w")).products().first().ProductName == "Lamp"


def test_the_setting_is_put_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with freed_shuffles(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == before


def test_lines_dealt_by_file_are_not_shuffled_again(spark):
    """Records that cross one or two splits, and one that holds what looks like a record."""
    texts = {1: ['a,"b', 'c",d', 'e', '"f', '', 'g,h', '"'], 2: ["x", "y", 'z,"', '","', '"'], 3: ['"', '"', 'p,"q"']}
    lines = [(v, f, n // 2, n) for f, values in texts.items() for n, v in enumerate(values)]
    frame = spark.createDataFrame(lines, "value string, file long, block long, row long").repartition(4, "file")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        records = records_of(frame)
        found = row_set(records)
        plan = records._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
        )
    finally:
        spark.conf.set(threshold, before)
    assert found == {
        (1, 1, 0, 0, 'a,"b\nc",d'), (1, 2, 1, 2, "e"), (1, 3, 1, 3, '"f\n\ng,h\n"'),
        (2, 1, 0, 0, "x"), (2, 2, 0, 1, "y"), (2, 3, 1, 2, 'z,"\n","\n"'),
        (3, 1, 0, 0, '"\n"'), (3, 2, 1, 2, 'p,"q"'),
    }
    final = plan.split("Initial Plan")[0]
    assert len(re.findall(r"Exchange hashpartitioning", final)) == 1
