"""Order-dependent operators: windows over time, last rows, trimming, event-sourced counters and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary.functions import fixed, text
from lapidary.operators.analytics import rule_dimension
from lapidary.operators.joins import split_join
from lapidary.session import durable


def last_rows(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each group with their position from the end. Spark keeps n rows per group before it shuffles."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("position") <= n)


def sliding_counts(df: DataFrame, by: str, seconds: int, at: str = "created_at") -> DataFrame:
    """``df`` with how many rows of the same ``by`` lie in the seconds before each row, itself included.

    Rows are cut into stretches of the window's length and each is also sent to the next stretch, so the counts of a
    hot group are made in as many tasks as it has stretches.
    """
    second = F.unix_micros(F.col(at).cast("timestamp"))
    width = seconds * 1_000_000
    rows = df.where(F.col(at).isNotNull() & F.col(by).isNotNull()).withColumn("_us", second).withColumn("_own", F.floor(F.col("_us") / width))
    sent = rows.withColumn("_stretch", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    w = Window.partitionBy(by, "_stretch").orderBy("_us").rangeBetween(-width, 0)
    counted = sent.withColumn("in_window", F.count("*").over(w)).where(F.col("_stretch") == F.col("_own"))
    return counted.drop("_us", "_own", "_stretch")


def previous_batch(df: DataFrame, by: str, order: list[str], passed: Column) -> DataFrame:
    """``df`` with mode ``first`` or ``supplement``: whether an earlier row of ``by`` passed. Only the first passing row of a group is needed."""
    keys = F.struct(*order)
    first = df.where(passed).groupBy(by).agg(F.min(keys).alias("_first"))
    joined = split_join(df, first, [by])
    return joined.withColumn("mode", F.when(F.coalesce(F.col("_first") < keys, F.lit(False)), "supplement").otherwise("first")).drop("_first")


def live_at(df: DataFrame, key: str, at: str, order: str, ttl: int, now: Column) -> DataFrame:
    """Last value of every key at a time, without those older than ``ttl`` seconds."""
    rest = [c for c in df.columns if c != key]
    last = df.where(F.col(at).isNotNull() & F.col(key).isNotNull() & (F.col(at) <= now)).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, order)).alias("_row"))
    out = last.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])
    return out.where(F.col(at) + F.make_dt_interval(secs=F.lit(ttl)) >= now)


def trimmed(df: DataFrame, by: str, order: list[str], starts: Column, longest: int = 40, tail: int = 24) -> DataFrame:
    """Conversations of more than ``longest`` rows cut to the first row and a tail that begins where ``starts`` holds.

    The tail is the last ``tail`` rows without those before its first start (all of them where none starts).
    """
    place, columns = F.struct(*order), df.columns
    # A null is a group like any other.
    df = df.withColumns({"_null": F.col(by).isNull(), "_by": F.coalesce(F.col(by).cast("string"), F.lit(""))})
    groups = df.groupBy("_null", "_by").agg(F.count("*").alias("_size"), F.min(place).alias("_first"))
    rows = split_join(df, groups, ["_null", "_by"])
    head = rows.where((F.col("_size") <= longest) | (place == F.col("_first"))).select(*columns)
    # Of a long conversation only the tail's rows are put side by side.
    back = Window.partitionBy("_null", "_by").orderBy(*[F.desc(o) for o in order])
    tails = df.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= tail)
    tails = tails.withColumn("_from", F.max(F.when(starts, F.col("_back"))).over(Window.partitionBy("_null", "_by"))).join(groups, ["_null", "_by"])
    kept = (F.col("_size") > longest) & (place != F.col("_first")) & (F.col("_back") <= F.coalesce("_from", F.lit(tail)))
    return head.unionByName(tails.where(kept).select(*columns))


def floored_sums(events: DataFrame, by: list[str], at: str, order: list[str], delta: str) -> DataFrame:
    """(by..., value): counters to which deltas are added in order, never falling below 0.

    A stretch of deltas maps x to max(x + s, m): s their sum, m the value reached from far below. Such maps compose, so
    the deltas of a group are folded by day in parallel and only the days of a group are folded in order.
    """
    day = F.to_date(at).alias("_day")
    w = Window.partitionBy(*by, "_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    daily = events.select(*by, day, *[c for c in order if c not in by], F.col(delta).cast("bigint").alias("_d"))
    running = daily.withColumn("_s", F.sum("_d").over(w))
    stretch = running.groupBy(*by, "_day").agg(F.sum("_d").alias("s"), F.min("_s").alias("least"))
    steps = stretch.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_day", "s", "least"))).alias("_days"))
    fold = F.aggregate("_days", F.lit(0).cast("bigint"), lambda x, d: F.greatest(x + d["s"], d["s"] - d["least"]))
    return steps.select(*by, fold.alias("value"))


def preference_deltas(log: DataFrame, user: str) -> DataFrame:
    """(user, kind, key, delta, created_at, id): a passed row adds 2 to its rule and 1 to its category, a failed one takes 1 from both."""
    rows = log.where(F.col(user).isNotNull() & F.col("rule_id").isNotNull() & F.col("passed").isNotNull() & F.col("created_at").isNotNull())
    rule = F.struct(F.lit("rule").alias("kind"), F.col("rule_id").alias("key"), F.when(F.col("passed"), 2).otherwise(-1).alias("delta"))
    tag = F.struct(F.lit("tag").alias("kind"), text.category("rule_id").alias("key"), F.when(F.col("passed"), 1).otherwise(-1).alias("delta"))
    spread = rows.select(F.col(user).alias("user_id"), "created_at", "id", F.explode(F.array(rule, tag)).alias("d"))
    return spread.select("user_id", "d.*", "created_at", "id").where("key is not null")


def profiles(log: DataFrame, user: str) -> DataFrame:
    """(user_id, kind, key, value) of the preferences after all events."""
    return floored_sums(preference_deltas(log, user), ["user_id", "kind", "key"], "created_at", ["created_at", "id"], "delta")


def recommendations(log: DataFrame, user: str, k: int = 3) -> DataFrame:
    """(user_id, position, rule_id, score, reason): the k best of all 25 rules for every user.

    score = 3 rule preference + category preference + 1.5 accepted - 0.75 rejected; ties by rule number.
    """
    values = profiles(log, user)
    counted = log.where(F.col(user).isNotNull() & F.col("passed").isNotNull()).groupBy(F.col(user).alias("user_id"), "rule_id")
    counted = counted.agg(F.count_if("passed").alias("accepted"), F.count_if(~F.col("passed")).alias("rejected"))
    users = log.where(F.col(user).isNotNull()).select(F.col(user).alias("user_id")).distinct()
    all_rules = F.array(*[F.lit(r) for r in fixed.RULES])
    grid = users.select("user_id", F.explode(all_rules).alias("rule_id")).withColumn("category", text.category("rule_id"))
    rule = values.where("kind = 'rule'").select("user_id", F.col("key").alias("rule_id"), F.col("value").alias("pref"))
    tag = values.where("kind = 'tag'").select("user_id", F.col("key").alias("category"), F.col("value").alias("tag_pref"))
    j = grid.join(rule, ["user_id", "rule_id"], "left").join(tag, ["user_id", "category"], "left").join(counted, ["user_id", "rule_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    score = 3.0 * zero("pref") + zero("tag_pref") + 1.5 * zero("accepted") - 0.75 * zero("rejected")
    reason = F.when(F.col("pref").isNotNull(), "requested rule").when(zero("tag_pref") > 0, "preferred category").otherwise("default")
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), F.col("rule_id").cast("int"))
    ranked = j.select("user_id", "rule_id", F.round(score, 3).alias("score"), reason.alias("reason")).withColumn("position", F.row_number().over(order))
    return ranked.where(F.col("position") <= k)


def retry_limit(df: DataFrame, by: str, order: list[str], passed: Column, most: int) -> DataFrame:
    """``df`` with failures since the last pass and whether the group was given up before this row (``most`` failures in a row)."""
    ok = F.coalesce(passed, F.lit(False))
    # Groups are cut along a range-partitioned sort; each part is counted by itself, and the parts of a group are then
    # put together by what each hands on: whether a row passed, the failures before and after its passes.
    ranged = df.withColumn("_ok", ok).repartitionByRange(by, *order).withColumn("_part", F.spark_partition_id())
    past = Window.partitionBy("_part", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = Window.partitionBy("_part", by, "_passes").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_passes", F.sum(F.col("_ok").cast("int")).over(past))
    local = durable(local.withColumn("_run", F.sum((~F.col("_ok")).cast("int")).over(run)))
    lead, later = F.max(F.when(F.col("_passes") == 0, F.col("_run"))), F.max(F.when(F.col("_passes") > 0, F.col("_run")))
    parts = local.groupBy(by, "_part").agg(F.max("_passes").alias("p"), F.coalesce(lead, F.lit(0)).alias("lead"), F.coalesce(later, F.lit(0)).alias("later"), F.max_by("_run", F.struct(*order)).alias("tail"))
    listed = F.array_sort(F.collect_list(F.struct("_part", "p", "lead", "later", "tail")))  # as many as partitions at most
    zero = F.struct(F.lit(0).cast("bigint").alias("carry"), F.lit(False).alias("gone"), F.array().cast("array<struct<_part:int,_carry:bigint,_gone:boolean>>").alias("out"))

    def step(x: Column, d: Column) -> Column:
        hit = (x["carry"] + d["lead"] >= most) | (d["later"] >= most)
        carry = F.when(d["p"] > 0, d["tail"]).otherwise(x["carry"] + d["tail"])
        out = F.concat(x["out"], F.array(F.struct(d["_part"].alias("_part"), x["carry"].alias("_carry"), x["gone"].alias("_gone"))))
        return F.struct(carry.alias("carry"), (x["gone"] | hit).alias("gone"), out.alias("out"))

    carried = parts.groupBy(by).agg(F.aggregate(listed, zero, step)["out"].alias("out")).select(by, F.inline("out"))
    keyed = carried.withColumnRenamed(by, "_by")
    rows = local.join(keyed, local[by].eqNullSafe(keyed["_by"]) & (local["_part"] == keyed["_part"])).drop(keyed["_part"]).drop("_by")
    rows = rows.withColumn("retries", F.col("_run") + F.when(F.col("_passes") == 0, F.col("_carry")).otherwise(0))
    before = Window.partitionBy("_part", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    gone = F.col("_gone") | F.coalesce(F.max(F.col("retries") >= most).over(before), F.lit(False))
    return rows.withColumn("given_up", gone).select(*df.columns, "retries", "given_up")


__all__ = ["floored_sums", "last_rows", "live_at", "preference_deltas", "previous_batch", "profiles", "recommendations", "retry_limit", "rule_dimension", "sliding_counts", "trimmed"]
