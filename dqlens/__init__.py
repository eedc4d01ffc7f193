"""dqlens: a Spark-native data-quality profiler for tabular data.

Sub-packages
------------
functions   Column expressions (missing / blank / bad-type predicates, labels,
            percentages, display names, suggestion text).
operators   DataFrame -> DataFrame operators: the one-pass column profile,
            report folding and the dataset catalogue.
sources     Readers: typed / raw CSV scans, physical line counts, file
            listings, the driver's parquet tables and derived fixtures.
plans       Composite batch jobs (ingest-and-profile, reads, archive).
streaming   The same ingest job driven by a file stream (availableNow).
"""

from dqlens.session import get_spark, scratch_path

__all__ = ["get_spark", "scratch_path"]
