"""Usage, feedback, conversation and account ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LIMITS


def exact_sum(amount: str | Column, digits: int = 4) -> Column:
    """Sum of amounts of up to nine decimals, rounded; the order in which they are added doesn't matter."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    return F.round(F.sum(amount.cast("decimal(28,9)")), digits).cast("double")


def exact_mean(amount: str, digits: int = 6) -> Column:
    total = F.sum(F.col(amount).cast("decimal(18,9)")).cast("decimal(26,9)")
    return F.round(total / F.count(amount).cast("decimal(12,0)"), digits).cast("double")


def active_sessions(sessions: DataFrame, users: DataFrame) -> DataFrame:
    return sessions.join(users.where("active"), "user_id")


def user_usage(users: DataFrame, traces: DataFrame, docs: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a user with runs, cost and last run, documents and conversations; each side is summed before it is joined."""
    runs = traces.groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), exact_sum("cost").alias("cost"), F.max("at").alias("last_at"))
    n = lambda df, name: df.groupBy("user_id").agg(F.count(F.lit(1)).alias(name))
    met = users.join(runs, "user_id", "left").join(n(docs, "docs"), "user_id", "left").join(n(convs, "convs"), "user_id", "left")
    return met.fillna({"runs": 0, "cost": 0.0, "docs": 0, "convs": 0})


def empty_parents(parents: DataFrame, children: DataFrame, by: str) -> DataFrame:
    """The latest parent (id, by) without children (id), of each `by`."""
    return parents.join(children, "id", "left_anti").groupBy(by).agg(F.max("id").alias("id"))


def conversation_list(messages: DataFrame, limit: int = 60) -> DataFrame:
    """Conversations with at least one question, the latest first."""
    asked = messages.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("questions"), F.count(F.lit(1)).alias("turns")).where("questions > 0")
    return asked.orderBy(F.desc("conv_id")).limit(limit)


def trace_summary(traces: DataFrame, *by: str) -> DataFrame:
    """Runs, cost and latency (cost, ms), in all or by columns; an empty ledger has zeros."""
    return traces.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), *(F.coalesce(c, F.lit(0.0)).alias(name) for c, name in ((exact_sum("cost"), "cost"), (exact_mean("cost"), "mean_cost"), (exact_mean("ms"), "mean_ms"))))


def trace_by(traces: DataFrame, *columns: str) -> DataFrame:
    """Counts by each of some columns, in one pass."""
    counted = traces.groupingSets([[F.col(c)] for c in columns], *map(F.col, columns)).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    names, flags = F.array(*map(F.lit, columns)), [(1 << len(columns)) - 1 - (1 << (len(columns) - 1 - i)) for i in range(len(columns))]
    kind, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        kind, value = F.when(F.col("g") == flags[i], names[i]).otherwise(kind), F.when(F.col("g") == flags[i], F.col(c).cast("string")).otherwise(value)
    return counted.select(kind.alias("by"), value.alias("value"), "n")


def feedback_stats(votes: DataFrame) -> DataFrame:
    return votes.agg(F.count(F.lit(1)).alias("votes"), F.count_if(F.col("vote") > 0).alias("up"), F.count_if(F.col("vote") < 0).alias("down"), F.count_if("corrected").alias("corrected"))


def node_profile(steps: DataFrame) -> DataFrame:
    """steps (node, ms, cost, tokens, error) by node."""
    return steps.groupBy("node").agg(F.count(F.lit(1)).alias("calls"), exact_sum("cost").alias("cost"), F.sum("tokens").alias("tokens"), F.round(F.median("ms"), 6).alias("median_ms"), F.max("ms").alias("max_ms"), F.count("error").alias("errors"))


def step_share(steps: DataFrame, least: float = 2.0) -> DataFrame:
    """Percent of a run's time that each step takes, at least `least` so that it can be drawn."""
    whole = F.sum("ms").over(Window.partitionBy("run_id"))
    return steps.withColumn("share", F.greatest(F.lit(least), F.round(F.when(whole > 0, 100 * F.col("ms") / whole).otherwise(0.0), 6)))


def run_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls (run_id, tier, tokens_in, tokens_out) at prices a million tokens (tier, price_in, price_out)."""
    cost = (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6
    return calls.join(F.broadcast(prices), "tier").groupBy("run_id").agg(exact_sum(cost, 8).alias("cost"), F.count(F.lit(1)).alias("calls"))  # prices: a row a tier


def budget_breach(steps: DataFrame, cost: float = LIMITS.run_cost, seconds: float = LIMITS.run_seconds) -> DataFrame:
    """The first step of each run at which its cost or its time so far is used up, and why."""
    order = Window.partitionBy("run_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    spent, took = F.round(F.sum("cost").over(order), 9), F.round(F.sum("ms").over(order) / 1000, 9)
    reason = F.when(spent >= cost, "cost").when(took >= seconds, "time")
    return steps.withColumn("reason", reason).where("reason IS NOT NULL").groupBy("run_id").agg(F.min(F.struct("step", "reason")).alias("b")).select("run_id", "b.step", "b.reason")


def nth_message(messages: DataFrame, n: int) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return messages.withColumn("at", at).where(F.col("at") == n).drop("at")


def replace_after(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """messages with all from an edit's turn on replaced by it; edits: (conv_id, turn, role, text), one a conversation."""
    cut = messages.join(edits.select("conv_id", F.col("turn").alias("cut")), "conv_id", "left").where("cut IS NULL OR turn < cut").drop("cut")
    return cut.unionByName(edits.join(messages.select("conv_id").distinct(), "conv_id", "left_semi"))


def history_tail(messages: DataFrame, n: int = 4) -> DataFrame:
    """The last n turns before each conversation's last question."""
    last = messages.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("asked"))
    before = messages.join(last, "conv_id").where("turn < asked")
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return before.withColumn("back", back).where(F.col("back") <= n).drop("asked")


def session_activity(events: DataFrame, gap: str) -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_seen")).select("user_id", F.col("w.start").alias("started"), "last_seen", "n")


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """tables: name to (rows, key column), parents first; rows of removed keys go, and with them what hangs on them.

    Each table's second column named `child` gives the keys that the next table is cut by.
    """
    gone, out = ids, {}
    for name, (df, key) in tables.items():
        out[name] = df.join(gone.withColumnRenamed(gone.columns[0], key), key, "left_anti")
        if "child" in df.columns:
            gone = df.join(gone.withColumnRenamed(gone.columns[0], key), key, "left_semi").select("child").distinct()
    return out


def backfill_owner(docs: DataFrame, admin: Column) -> DataFrame:
    """Rows without an owner go to the administrator and are shared."""
    return docs.withColumn("visibility", F.when(F.col("owner_id").isNull(), "ortak").otherwise(F.col("visibility"))).withColumn("owner_id", F.coalesce("owner_id", admin))


def constraint_violations(users: DataFrame, docs: DataFrame) -> DataFrame:
    """(kind, id): documents whose owner is unknown, and a group without an active administrator (users: user_id, group, role, active)."""
    lost = docs.join(users.select(F.col("user_id").alias("owner_id")), "owner_id", "left_anti").select(F.lit("owner").alias("kind"), F.col("doc_id").alias("id"))
    bare = users.groupBy("group").agg(F.count_if((F.col("role") == "admin") & F.col("active")).alias("n")).where("n = 0").select(F.lit("admin").alias("kind"), F.col("group").cast("long").alias("id"))
    return lost.unionByName(bare)
