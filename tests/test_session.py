"""What the session's helpers promise."""

import pyarrow as pa

from trajectorium.session import BATCH_BYTES, ship


def test_python_functions_get_batches_of_bounded_bytes(spark):
    ship(spark)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    found = spark.range(0, 8000, 1, 1).selectExpr("repeat('abcdefgh', 300) AS text").mapInArrow(run, "n bigint, size bigint").collect()
    assert sum(x.n for x in found) == 8000 and max(x.size for x in found) < 1.1 * BATCH_BYTES
