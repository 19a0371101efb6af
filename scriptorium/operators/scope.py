"""Scopes of queries as sets of document numbers: bitmaps that many queries share, tested where documents are scored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bit_of(bits: Column, position: Column) -> Column:
    """Whether a bit of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(position, F.lit(8)).cast("int")) == 1


def bitmaps(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(scope_id, bucket, bits, n, key_sum) of rows (scope_id, key): a bitmap of 32,768 numbers a bucket. A pair may come more than once."""
    once = rows.where(F.col(key).isNotNull()).select("scope_id", F.col(key).cast("long").alias("k")).distinct()
    grouped = once.groupBy("scope_id", F.bitmap_bucket_number("k").alias("bucket"))
    return grouped.agg(F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("bits"), F.count(F.lit(1)).alias("n"), F.sum(F.col("k").cast("decimal(38,0)")).alias("key_sum"))


@dataclass
class Scopes:
    """members (query_id, scope_id): the sets that a query's scope is made of, none of which overlap; sets: as bitmaps() gives them."""

    members: DataFrame
    sets: DataFrame

    def keep(self, rows: DataFrame, key: str = "doc_id") -> DataFrame:
        """Those rows (query_id, key, …) whose document is in their query's scope."""
        k = F.col(key).cast("long")
        met = rows.withColumns({"_bucket": F.bitmap_bucket_number(k), "_bit": F.bitmap_bit_position(k)}).join(self.members, "query_id")
        sets = self.sets.select("scope_id", F.col("bucket").alias("_bucket"), "bits")
        return met.join(sets, ["scope_id", "_bucket"]).where(bit_of(F.col("bits"), F.col("_bit"))).select(*rows.columns)

    def sizes(self) -> DataFrame:
        """(query_id, n, key_sum): how many documents a scope holds, and the sum of their numbers; queries with an empty scope have no row."""
        whole = self.sets.groupBy("scope_id").agg(F.sum("n").alias("n"), F.sum("key_sum").alias("key_sum"))
        return self.members.join(whole, "scope_id").groupBy("query_id").agg(F.sum("n").alias("n"), F.sum("key_sum").alias("key_sum"))


def permitted_scopes(queries: DataFrame, named: DataFrame, permitted: DataFrame) -> Scopes:
    """Scopes of queries (query_id, user_id): the documents that they name (query_id, doc_id), if any, within what their user may see (permitted: doc_id, owner_id, shared).

    What all share is one set and what an owner alone sees another, so a query that names
    nothing takes two sets, and no row is made for a query and a document that it doesn't name.
    """
    asks = named.select("query_id", "doc_id").distinct().join(queries.select("query_id", "user_id"), "query_id")
    found = asks.join(permitted, "doc_id").where(F.col("shared") | (F.col("owner_id") == F.col("user_id")))
    of = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    rows = permitted.select(F.when(F.col("shared"), "shared").otherwise(of("owner:", "owner_id")).alias("scope_id"), "doc_id").unionByName(found.select(of("query:", "query_id").alias("scope_id"), "doc_id"))
    naming = named.select("query_id").distinct()
    free = queries.join(naming, "query_id", "left_anti").select("query_id", F.explode(F.array(F.lit("shared"), of("owner:", "user_id"))).alias("scope_id")).where("scope_id IS NOT NULL")
    own = queries.join(naming, "query_id", "left_semi").select("query_id", of("query:", "query_id").alias("scope_id"))
    return Scopes(free.unionByName(own), bitmaps(rows.where("scope_id IS NOT NULL")))
