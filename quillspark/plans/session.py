"""A session set up for the library: settings, and functions that SQL can call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark import share_code
from quillspark.functions import surface, udfs
from quillspark.operators import skills

SETTINGS = {
    "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(name: str = "quillspark", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS, the caller's settings (with _ for .) over them, and the functions of `register`."""
    builder = SparkSession.builder.appName(name)
    builder = builder.master(master) if master else builder
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return register(share_code(builder.getOrCreate()))


def register(spark: SparkSession, ontology: DataFrame | None = None) -> SparkSession:
    """skills_of(text), ratio(a, b), nfkc(text) and term_counts(lines, filled) as SQL functions, in Arrow batches."""
    from quillspark.operators.vectors import counted_terms

    forms = skills.surface_forms(skills.load_ontology(spark) if ontology is None else ontology)
    spark.udf.register("skills_of", surface.scanner(skills.declared(forms)))
    for name, f in (("ratio", udfs.ratcliff), ("nfkc", udfs.nfkc), ("term_counts", counted_terms)):
        spark.udf.register(name, f)
    return spark
