"""File sources: device-message and Observation JSON landing areas.

Explicit schemas (no inference), recursive lookup over nested date folders,
PERMISSIVE parsing with the raw text of unreadable records kept in
``_corrupt_record`` so they can be split off to quarantine instead of
failing the job. Blank lines are no records. A missing path is an error unless
the caller allows it; then it yields an empty frame with the right schema.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import OBSERVATION_WITH_CORRUPT, RAW_MESSAGE_WITH_CORRUPT

CORRUPT = "_corrupt_record"


def read_json(spark: SparkSession, path: str | list[str], schema: StructType,
              multiline: bool = False, recursive: bool = True,
              missing_ok: bool = False) -> DataFrame:
    """Read JSON text and parse it with ``from_json`` (PERMISSIVE).

    Lines (or, with ``multiline``, whole files) are read as text first: the
    raw text is then always at hand for quarantine, and unused fields are
    still pruned from the parser's schema by the optimizer.

    ``multiline``: every file is one document. A file that holds more than one
    is a reject as a whole (its text is kept), never just its first document.
    """
    try:
        # keyword arguments: text() would reset an earlier .option("wholetext")
        text = spark.read.text(path, wholetext=multiline,
                               recursiveFileLookup=str(recursive).lower())
    except AnalysisException as e:  # missing landing area: nothing to process
        if missing_ok and ("PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e)):
            return spark.createDataFrame([], schema)
        raise
    text = text.where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
    return parse_json_column(text, "value", schema, keep=False, single=multiline)


def parse_json_column(df: DataFrame, col: str, schema: StructType,
                      keep: bool = True, single: bool = False) -> DataFrame:
    """Decode a JSON string column into the schema's top-level columns.

    Unreadable text lands in ``_corrupt_record`` (when the schema has it): what
    does not parse, what is no JSON object, and with ``single`` also text that
    goes on after the first document."""
    parsed = F.from_json(F.col(col), schema,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rest = [c for c in df.columns if c != col] if keep else []
    out = df.select(*rest, F.col(col).alias("_text"), parsed.alias("_m"))
    if CORRUPT not in schema.names:
        return out.select(*rest, "_m.*")
    bad = F.col("_m").isNull() | F.col(f"_m.{CORRUPT}").isNotNull()
    if single:
        # the parser stops after the first document; as an array there must be one
        alone = F.json_array_length(F.concat(F.lit("["), F.col("_text"), F.lit("]"))) == 1
        bad = bad | ~F.coalesce(alone, F.lit(False))
    return out.select(*rest, *[F.when(~bad, F.col(f"_m.{c}")).alias(c) for c in schema.names
                               if c != CORRUPT],
                      F.when(bad, F.coalesce("_text", F.lit(""))).alias(CORRUPT))


def read_device_messages(spark: SparkSession, path: str | list[str],
                         missing_ok: bool = False) -> DataFrame:
    """Raw device messages (one JSON object per line)."""
    return read_json(spark, path, RAW_MESSAGE_WITH_CORRUPT, missing_ok=missing_ok)


def read_observations(spark: SparkSession, path: str | list[str], multiline: bool = False,
                      missing_ok: bool = False) -> DataFrame:
    """Observation documents below nested date folders: one per line, or with
    ``multiline`` one (indented) per file."""
    return read_json(spark, path, OBSERVATION_WITH_CORRUPT, multiline=multiline,
                     missing_ok=missing_ok)


def valid_rows(df: DataFrame) -> DataFrame:
    """Readable records only (unreadable ones are skipped and counted elsewhere)."""
    if CORRUPT not in df.columns:
        return df
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def corrupt_rows(df: DataFrame) -> DataFrame:
    if CORRUPT not in df.columns:
        return df.limit(0)
    return df.where(F.col(CORRUPT).isNotNull())


def parse_counts(df: DataFrame) -> DataFrame:
    """processed / errors over one read (one aggregate, one pass)."""
    bad = F.col(CORRUPT).isNotNull() if CORRUPT in df.columns else F.lit(False)
    return df.agg(F.count_if(~bad).alias("processed"), F.count_if(bad).alias("errors"))


def read_body_messages(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """Queue records: JSON-decode each message body with the message schema."""
    return parse_json_column(bodies, body_col, RAW_MESSAGE_WITH_CORRUPT)
