"""Scratch tables live in the shared folder and go when they are released."""

from pathlib import Path

from tabloom.functions.lineage import release, shared_folder
from tabloom.functions.tables import materialise


def test_release_leaves_no_scratch_table(spark):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    release(spark)
    table = materialise(spark.range(5))
    made = Path(table.inputFiles()[0].removeprefix("file://")).parent
    assert table.count() == 5 and made.parent == folder
    assert release(spark) == 1 and not made.exists()
