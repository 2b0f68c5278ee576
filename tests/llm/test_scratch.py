from pathlib import Path

from wayfold.llm.scratch import clear, materialize, shared_root


def test_tables_live_in_the_shared_folder_until_cleared(spark):
    root = Path(shared_root(spark).removeprefix("file://"))
    table = materialize(spark.range(10), "probe", narrow=True)
    assert table.count() == 10 and list(root.glob("wayfold-probe-*"))
    clear(spark)
    assert not list(root.glob("wayfold-*"))
