"""What several corpus operators share: shared folders, cut lineage, lookups that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietfield.tables import cut, scratch_path, shared_dir

__all__ = ["SPACE", "WORD", "at_places", "cut", "let", "placeable", "scratch_path", "shared_dir", "with_groups", "with_places", "without_places"]

#: White space of the text contracts (space and U+0009..U+000D), as a Java and RE2 class.
SPACE = r"[\x20\x09-\x0D]"
#: A word of the text contracts.
WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many (file, row) places, counted first, are sent to all executors: 140 MB with paths of 117 characters, 300 MB of 317.
MAX_PLACES = 400_000


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def with_groups(rows: DataFrame, groups: DataFrame, key: str, row_id: Sequence[str], salts: int = 64) -> DataFrame:
    """Left-join groups (one row per key, key not null) to rows, with hot keys dealt over many tasks.

    Rows are salted by a hash of row_id. A group's row is sent once to each (key, salt) that occurs,
    at most `salts` times, so neither side ever puts a hot key into one task, at any size. No side is
    broadcast: Spark sizes exploded rows like those before and files as they are compressed, and would
    send the driver tables many times its threshold. Names of the two sides must differ but for the key."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*row_id), F.lit(salts)).cast("int"))
    spread = salted.select(key, "_salt").distinct().join(groups.hint("merge"), key)
    return salted.join(spread.hint("merge"), [key, "_salt"], "left").drop("_salt")


def placeable(docs: DataFrame) -> DataFrame:
    """docs, or what it holds written once as Parquet where its rows have no place in files yet."""
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
        return docs
    except AnalysisException:
        return cut(docs)


def with_places(docs: DataFrame, *columns: Column) -> DataFrame:
    """The columns of placeable docs, with _file and _row, which tell rows apart whatever they hold."""
    place = docs.metadataColumn("_metadata")
    return docs.select(*columns, place["file_path"].alias("_file"), place["row_index"].alias("_row"))


def at_places(rows: DataFrame, places: DataFrame, how: str = "inner", max_places: int = MAX_PLACES) -> DataFrame:
    """Join (inner or left) of rows to places, both with _file and _row. Places are few beside rows, and a written table.

    Up to max_places are broadcast, so that rows stay where they lie; more are joined by a shuffle."""
    few = places.limit(max_places + 1).count() <= max_places
    return rows.join(F.broadcast(places) if few else places.hint("shuffle_hash"), ["_file", "_row"], how)


def without_places(docs: DataFrame, places: DataFrame, max_places: int = MAX_PLACES) -> DataFrame:
    """The rows of placeable docs, all columns, that are not at places (_file, _row: a written table)."""
    few = places.limit(max_places + 1).count() <= max_places
    at, longest = docs.metadataColumn("_metadata"), max(map(len, docs.columns))
    names = [f"_gone_{k}" + "_" * longest for k in range(2)]  # longer than any column of docs, so none clashes
    gone = places.select(F.col("_file").alias(names[0]), F.col("_row").alias(names[1]))
    gone = F.broadcast(gone) if few else gone.hint("shuffle_hash")
    return docs.join(gone, (at["file_path"] == gone[names[0]]) & (at["row_index"] == gone[names[1]]), "left_anti")
