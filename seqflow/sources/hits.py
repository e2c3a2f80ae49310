"""Similarity-hit tables: header-less TSV in a few fixed layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqflow.session import scratch_path

# The column layouts of hit files.
LAYOUTS = {
    "blast12": "query string, target string, fident double, alnlen int, mismatch int, gapopen int, "
               "qstart int, qend int, tstart int, tend int, evalue double, bits double",
    "struct5": "query string, target string, fident double, bits double, alntmscore double",
    "bits3": "query string, target string, bits double",
    "tm3": "query string, target string, alntmscore double",
}
SCORE = {"blast12": "bits", "struct5": "alntmscore", "bits3": "bits", "tm3": "alntmscore"}


def read_hits(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """Each file is read with the layout it was written in; no inference."""
    return spark.read.schema(LAYOUTS[layout]).option("sep", "\t").csv(path)


def write_hits(hits: DataFrame, layout: str, path: str | None = None, mode: str = "overwrite") -> str:
    path = path or scratch_path(hits.sparkSession, "hits")
    names = [part.split()[0] for part in LAYOUTS[layout].split(", ")]
    hits.select(*names).write.mode(mode).option("sep", "\t").csv(path)
    return path
