"""Tables of configurations whose rows carry key-value pairs of their own, as documents in a column."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spark's name of a variant's type -> the column type of a lifted pair; others become JSON text.
_LIFTED = {"BIGINT": "bigint", "BOOLEAN": "boolean", "STRING": "string", "DOUBLE": "double", "FLOAT": "double"}


def pair_types(rows: DataFrame, pairs: str) -> dict[str, str]:
    """The keys of all rows' pairs and the type that holds a key's values: one row a key comes to the driver.

    Whole numbers are longs, mixed or broken numbers doubles, values of unlike
    kinds text; a key with both kinds of quotes is left out.
    """
    told = rows.select(F.try_parse_json(pairs).alias("v")).lateralJoin(
        rows.sparkSession.tvf.variant_explode(F.col("v").outer()).select("key", "value")
    )
    found = told.where("key is not null").groupBy("key").agg(F.schema_of_variant_agg("value").alias("t")).collect()
    types = {r["key"]: re.sub(r"\(.*", "", r["t"]).replace("DECIMAL", "DOUBLE") for r in found}
    # Spark's paths have no escapes: a key with both kinds of quotes cannot be named.
    return {k: _LIFTED.get(t, "string") for k, t in sorted(types.items()) if not {"'", '"'} <= set(k)}


def lift_pairs(rows: DataFrame, pairs: str = "key_value_pairs", keys: list[str] | None = None) -> DataFrame:
    """Rows with their pairs as typed columns in place of the document.

    A key that a row lacks is null there, as is everything where the document is
    null or no JSON.  A pair named like a column of the table is left out; ``keys`` names those wanted, else
    all that any row has.  Lists and objects become JSON text.
    """
    types = pair_types(rows, pairs)
    wanted = [k for k in (types if keys is None else keys) if k not in rows.columns]

    def lifted(key: str) -> Column:
        if key not in types:
            return F.lit(None).cast("string").alias(key)
        quote = '"' if "'" in key else "'"
        return F.try_variant_get("_v", f"$[{quote}{key}{quote}]", types[key]).alias(key)

    told = rows.withColumn("_v", F.try_parse_json(pairs))
    return told.select(*[c for c in rows.columns if c != pairs], *[lifted(k) for k in wanted])


def named_rows(rows: DataFrame, prefix: Column, seq: Column, name: str = "row_name") -> DataFrame:
    """Adds config_id: the row's own name, or prefix_seq for all rows where more than one of them lacks a name."""
    own = prefix.cast("string"), seq.cast("string")
    if name not in rows.columns:
        return rows.withColumn("config_id", F.concat_ws("_", *own))
    lacking = rows.agg((F.count_if(F.col(name).isNull()) > 1).alias("_unnamed"))  # one row
    plain = F.concat_ws("_", *own)
    told = rows.crossJoin(F.broadcast(lacking))
    return told.withColumn("config_id", F.when(F.col("_unnamed"), plain).otherwise(F.coalesce(name, plain))).drop("_unnamed")
