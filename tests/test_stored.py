"""Tables on the shared folder: no more files, and so no more processes that set their modes, than needed."""

import os

from pyspark.sql import functions as F

from gridweave import session


def test_a_stored_table_has_no_checksum_files(spark):
    made = session.stored(spark.range(1000, numPartitions=3))
    names = os.listdir(made._gridweave_path.removeprefix("file:"))
    assert sum(n.startswith("part-") for n in names) == 3 and not [n for n in names if n.endswith(".crc")]
    assert made.agg(F.sum("id")).first()[0] == 499_500
    session.discard(made)
    assert not os.path.exists(made._gridweave_path.removeprefix("file:"))
