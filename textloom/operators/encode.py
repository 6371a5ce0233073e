"""Text encoders: a pluggable protocol and a deterministic default by signed feature hashing."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 64
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


class Encoder(Protocol):
    """Turns a text column into unit vectors; ``dim`` is their length."""

    dim: int

    def encode(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame: ...


def hash_terms(df: DataFrame, id_col: str, text_col: str, dim: int = DIM) -> DataFrame:
    """(id, bucket, value): non-zero parts of the unit hash vector, in long form."""
    token = F.explode(F.filter(F.split(F.lower(text_col), TOKEN_SPLIT), lambda t: t != ""))
    counted = df.select(F.col(id_col).cast("bigint").alias("id"), token.alias("t"))
    digest = F.md5("t")
    bucket = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % dim).cast("int")
    sign = F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    summed = counted.groupBy("id", bucket.alias("bucket")).agg(F.sum(sign).cast("double").alias("s"))
    length = F.sqrt(F.sum(F.col("s") * F.col("s")).over(_by_id()))
    return summed.select("id", "bucket", F.when(length > 0, F.col("s") / length).otherwise(0.0).alias("value"))


def _by_id():
    from pyspark.sql import Window

    return Window.partitionBy("id")


class HashEncoder:
    """Signed feature hashing: token -> bucket by MD5, sum of signs, unit length."""

    def __init__(self, dim: int = DIM):
        self.dim = dim

    def encode(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, vec); texts without tokens have no row."""
        terms = hash_terms(df, id_col, text_col, self.dim)
        packed = terms.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("m"))
        return packed.select("id", self._dense(F.col("m")).alias("vec"))

    def _dense(self, m: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)))
