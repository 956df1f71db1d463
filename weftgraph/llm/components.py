"""Consolidating pairwise matches into groups: connected components by hash-to-min."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.lineage import discard, new_path
from weftgraph.plans.skew import salted_join

#: A vertex that gets more than this part of a round's messages is spread over SALTS tasks; at most 1 / HUB_SHARE can.
HUB_SHARE = 0.005
HUB_ROWS = 50_000
SALTS = 64
MESSAGES = "v string, u string, leaf int, state string"


def hash_to_min(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, hub_rows: int = HUB_ROWS) -> DataFrame:
    """(vertex, component): the smallest vertex of each vertex's connected component.

    Each round every vertex sends its cluster set to the set's minimum and that minimum to the set's members. Sets are
    rows (v, u), never arrays. A vertex that knows nothing but its minimum tells it so; once a minimum has heard that
    from all its members, the cluster is settled and leaves, so that later rounds carry only what is still growing.
    A round is one shuffle, written to the shared folder. Edges with a NULL end are ignored; a vertex with only a self
    loop is its own component; repeated edges count once; no edges give no rows.
    """
    spark = edges.sparkSession
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    both = F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u"))))
    paths = [new_path(spark)]
    ends.select(both.alias("e")).select("e.v", "e.u", F.lit(0).alias("leaf"), F.lit("open").alias("state")).write.partitionBy("state").parquet(paths[0])
    rows = [spark.read.schema(MESSAGES).parquet(paths[0])]
    for _ in range(max_rounds):
        messages = rows[-1].where("state = 'open'").select("v", "u", "leaf")
        count = messages.count()
        if not count:
            out = rows[0]
            for more in rows[1:]:
                out = out.unionByName(more)
            return out.where("state = 'settled'").select(F.col("v").alias("vertex"), F.col("u").alias("component"))
        paths.append(new_path(spark))
        _round(messages, max(hub_rows, int(count * HUB_SHARE))).write.partitionBy("state").parquet(paths[-1])
        rows.append(spark.read.schema(MESSAGES).parquet(paths[-1]))
        discard(spark, f"{paths[-2]}/state=open")
    raise RuntimeError(f"hash-to-min did not settle within {max_rounds} rounds")


def _round(messages: DataFrame, hub_rows: int) -> DataFrame:
    """What the vertices send next (state 'open'), and the members of settled clusters (state 'settled')."""
    # By counting, at most 1 / HUB_SHARE vertices are hubs: their names come to the driver.
    hubs = [r.v for r in messages.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hub_rows).select("v").collect()]
    is_hub = F.col("v").isin(hubs) if hubs else F.lit(False)
    salt = F.when(is_hub, F.pmod(F.xxhash64("u"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    sets = messages.withColumn("salt", salt).repartition("v", "salt").groupBy("v", "salt", "u").agg(F.max("leaf").alias("leaf"), F.min("leaf").alias("alive"))
    w = Window.partitionBy("v", "salt")
    other = F.col("u") != F.col("v")
    measures = {"m": F.min("u"), "others": F.count_if(other), "growing": F.count_if(other & (F.col("leaf") == 0)), "told": F.min("alive"), "least_u": F.min(F.when(other, F.col("u")))}
    known = sets.withColumns({k: f.over(w) for k, f in measures.items()})
    if hubs:
        whole = sets.where(is_hub).groupBy("v").agg(*(f.alias(f"hub_{k}") for k, f in measures.items()))
        known = known.join(F.broadcast(whole), "v", "left").withColumns({k: F.coalesce(f"hub_{k}", k) for k in measures})
    # A vertex that got nothing but word from its leaves has settled before.
    known = known.where("told = 0").withColumn("m", F.least("v", "m"))
    known = known.withColumn("first", other & (F.col("u") == F.col("least_u")))
    to = lambda v, u, leaf=0, state="open": F.struct(v.alias("v"), u.alias("u"), F.lit(leaf).alias("leaf"), F.lit(state).alias("state"))
    v, u, m = F.col("v"), F.col("u"), F.col("m")
    root, least, leaf = m == v, u == m, F.col("others") == 1
    sends = (
        F.when(root & (F.col("growing") == 0), F.when(F.col("first"), F.array(to(u, v, 0, "settled"), to(v, v, 0, "settled"))).when(other | (F.col("others") == 0), F.array(to(u, v, 0, "settled"))))
        .when(root, F.when(other, F.array(to(v, u), to(u, v))))
        .when(leaf, F.when(least, F.array(to(m, v, 1))))
        .when(least, F.array(to(m, m), to(m, v), to(v, m)))
        .when(other, F.array(to(m, u), to(u, m)))
    )
    sent = known.select(F.explode(sends).alias("s")).select("s.*")
    return sent


def latest_verdicts(pairs: DataFrame) -> DataFrame:
    """(lo, hi, status): the latest verdict on each unordered pair of different ids, ids in lower case and trimmed.

    Only labeled_match and labeled_not_match are verdicts. A verdict without labeled_at is older than any with one;
    of verdicts labeled at one time, labeled_not_match counts.
    """
    a, b = (F.lower(F.trim(F.col(c))) for c in ("node_a_id", "node_b_id"))
    told = pairs.where(F.col("status").isin("labeled_match", "labeled_not_match")).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), "labeled_at", "status", a.alias("_a"), b.alias("_b"))
    told = told.where(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("lo") != F.col("hi")))
    return told.groupBy("lo", "hi").agg(F.max(F.struct("labeled_at", "status")).alias("r")).select("lo", "hi", "r.status")


def tied_records(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b): pairs tied by a match verdict, and each record with the smallest id of its user, type and canonical id."""
    ids = nodes.where(F.col("id").isNotNull()).select("id").distinct()
    told = latest_verdicts(pairs).where(F.col("status") == "labeled_match").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    told = told.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    cid = F.col("properties")["canonical_id"]
    # 128 bits of hash stand for user, type and canonical id.
    keys = [F.xxhash64("user_id", "type", cid).alias("k1"), F.xxhash64(F.lit(5), cid, "type", "user_id").alias("k2")]
    keyed = nodes.where(F.col("id").isNotNull() & F.col("user_id").isNotNull() & F.col("type").isNotNull() & (F.trim(cid) != "")).select(*keys, "id")
    heads = keyed.groupBy("k1", "k2").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head <> last").drop("last")
    same = salted_join(keyed, heads, ["k1", "k2"], "inner", F.col("id")).where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    return told.select("a", "b").unionByName(same)


def record_groups(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node_id, group_id) of each id tied to another; group_id is the smallest id of the group."""
    return hash_to_min(tied_records(nodes, pairs)).select(F.col("vertex").alias("node_id"), F.col("component").alias("group_id"))


def group_sizes(groups: DataFrame) -> DataFrame:
    """(group_id, n_members), counted with partial sums."""
    return groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_members"))
