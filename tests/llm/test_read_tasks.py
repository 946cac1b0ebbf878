"""How reads of file ranges are dealt out to tasks."""

import pytest

from colframe.llm.store import read_tasks, setting


@pytest.mark.parametrize("most,least,total,tasks", [
    ("1m", "64k", 0, 1),
    ("1m", "64k", 1, 1),
    ("1m", "64k", 25 << 20, 25),
    ("1m", "64k", (25 << 20) + 1, 26),
    ("1g", "64k", 32 << 10, 1),
    ("134217728b", "4194304b", 1 << 40, 8192),
])
def test_read_tasks(spark, most, least, total, tasks):
    with setting(spark, "spark.sql.files.maxPartitionBytes", most), setting(spark, "spark.sql.files.openCostInBytes", least):
        # tiny targets of reshuffled tables don't split reads of files
        with setting(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k"):
            assert read_tasks(spark, total) == tasks
