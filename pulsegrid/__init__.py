"""pulsegrid — vital-signs analytics on Spark.

Device messages (batch files or a stream) are validated into alerts and
severities, turned into FHIR R4 Observation documents and back into wide
tables, scored for anomalies and patient risk, and rolled up into patient,
device and hourly aggregates. Every operator is a Column or DataFrame
function; batch and Structured Streaming share them.

Layout:
  functions/  Column -> Column expressions (alert rules, scores, documents)
  operators/  DataFrame -> DataFrame operators (enrich, gold, search, ...)
  sources/    readers (JSON landing areas, topics, catalog, test tables)
  sinks/      writers (Parquet tables, quarantine, registry, metrics)
  plans/      whole jobs (batch ETL) and the query registry
  streaming/  Structured Streaming pipelines
"""

__version__ = "0.1.0"
