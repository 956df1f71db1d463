"""Filling containers of fixed capacity, each with the target mixture of sources, by deficit round-robin.

A window is one container. At its start every source's deficit grows by its share of the capacity; the turn goes to the
source that is owed most, which places its largest document that fits, if that is not much smaller than what others have;
a source that is owed nothing waits. When no owed source has such a document, the largest ones fill the room. Deficits carry from window to window, and from partition to partition:
since a partition packs all its documents, what it hands on follows from sums, so partitions need not wait for each other.
"""

from __future__ import annotations

import math
from bisect import bisect_right, insort
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.workers import by_value

by_value(__name__)

#: Tokens that one task packs at a time. A partition leaves at most about one container part empty.
PARTITION_TOKENS = 8_000_000
MAX_SPECS = 1000
#: How small against the largest piece that fits an owed source's piece may be, and any source's when none is owed.
NEAR_LARGEST, CLOSING = 0.5, 0.9
PACKED_SCHEMA = "spec_id string, container_id string, position int, doc_id bigint, source string, piece int, first_token bigint, tokens bigint"


class Queue:
    """The pieces of one source that wait, by size."""

    def __init__(self) -> None:
        self.by_size: dict[int, list] = {}
        self.sizes: list[int] = []

    def add(self, size: int, piece: tuple) -> None:
        if size not in self.by_size:
            insort(self.sizes, size)
            self.by_size[size] = []
        self.by_size[size].append(piece)

    def largest(self, room: float) -> int:
        """Size of the largest piece that fits, or 0."""
        i = bisect_right(self.sizes, room)
        return self.sizes[i - 1] if i else 0

    def take(self, size: int) -> tuple:
        own = self.by_size[size]
        piece = own.pop()
        if not own:
            del self.by_size[size]
            self.sizes.pop(bisect_right(self.sizes, size) - 1)
        return piece


def pack(pieces: Iterable[tuple[str, int, int]], capacity: int, weights: dict[str, float], deficits: dict[str, float]) -> list[list[tuple[int, str, int, int, int]]]:
    """Containers of (doc_id, source, piece, first_token, tokens). pieces: (source, doc_id, tokens) of whole documents.

    A document larger than the capacity fills whole containers of its own and goes on with the rest of it.
    """
    queues: dict[str, Queue] = {}
    containers: list[list[tuple[int, str, int, int, int]]] = []
    deficits = dict(deficits)
    for source, doc_id, tokens in pieces:
        queue = queues.setdefault(source, Queue())
        piece, at = 0, 0
        while tokens - at > capacity:
            containers.append([(doc_id, source, piece, at, capacity)])
            for s, w in weights.items():
                deficits[s] = deficits.get(s, 0.0) + w * capacity
            deficits[source] = deficits.get(source, 0.0) - capacity
            piece, at = piece + 1, at + capacity
        queue.add(tokens - at, (doc_id, piece, at))
    order = sorted(queues)
    while order:
        room, own = capacity, []
        for s, w in weights.items():
            deficits[s] = deficits.get(s, 0.0) + w * capacity

        def place(source: str, size: int) -> None:
            nonlocal room
            doc_id, piece, at = queues[source].take(size)
            own.append((doc_id, source, piece, at, size))
            room -= size
            deficits[source] = deficits.get(source, 0.0) - size

        # Turns go to the source that is owed most, as long as its piece is not much smaller than the largest that fits:
        # small pieces are kept for the room that large ones leave.
        while True:
            fits = {s: queues[s].largest(room) for s in order}
            best = max(fits.values(), default=0)
            if not best:
                break
            owed = [s for s in order if fits[s] >= NEAR_LARGEST * best and deficits.get(s, 0.0) > 0]
            source = max(owed or (s for s in order if fits[s] >= CLOSING * best), key=lambda s: (deficits.get(s, 0.0), s))
            place(source, fits[source])
        containers.append(own)
        order = [s for s in order if queues[s].sizes]
    return containers


def packed_containers(tokens: DataFrame, specs: DataFrame, weights: DataFrame | None = None, partition_tokens: int = PARTITION_TOKENS) -> DataFrame:
    """The pieces of each container: (spec_id, container_id, position, doc_id, source, piece, first_token, tokens).

    tokens: (doc_id, source, tokens), one row a document; specs: (spec_id, capacity_tokens), at most MAX_SPECS rows;
    weights: (source, weight), by default each source's share of all tokens. NULL source is a source of its own. Documents
    without tokens, and specs with NULL or no capacity, give nothing. A partition holds a hashed part of every source, so
    a source with a third of all rows is spread like the others.
    """
    spark = tokens.sparkSession
    wanted = [r for r in specs.where("spec_id is not null and capacity_tokens > 0").select("spec_id", F.col("capacity_tokens").cast("int").alias("c")).distinct().limit(MAX_SPECS + 1).collect()]
    if len(wanted) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} specs")
    items = tokens.where("doc_id is not null and tokens > 0").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "tokens")
    total = items.agg(F.sum("tokens")).first()[0] or 0
    if not wanted or not total:
        return spark.createDataFrame([], PACKED_SCHEMA)
    parts = math.ceil(total / partition_tokens)
    items = items.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(parts)).cast("int"))
    sums = items.groupBy("part", "source").agg(F.sum("tokens").alias("t"))
    # What a source is owed at the start of a partition: its weight times all tokens before, less its own before. Only
    # rows of (partition, source) that occur are needed, since a source without documents there has nothing to place.
    if weights is None:
        share = sums.groupBy("source").agg((F.sum("t") / F.lit(float(total))).alias("w"))
    else:
        share = weights.select(F.coalesce("source", F.lit("")).alias("source"), (F.col("weight") / F.lit(float(weights.agg(F.sum("weight")).first()[0] or 1))).alias("w"))
    earlier = lambda w: w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    of_parts = sums.groupBy("part").agg(F.sum("t").alias("part_t")).select("part", zero(F.sum("part_t").over(earlier(Window.partitionBy()))).alias("all_before"))
    own_before = sums.select("part", "source", zero(F.sum("t").over(earlier(Window.partitionBy("source")))).alias("own_before"))
    owed = own_before.join(of_parts, "part").join(share, "source", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    starts = owed.select("part", "source", "w", (F.col("w") * F.col("all_before") - F.col("own_before")).alias("deficit"))
    each = F.explode(F.array(*(F.struct(F.lit(r.spec_id).alias("spec_id"), F.lit(r.c).alias("capacity")) for r in wanted)))

    def fill(key: tuple, own: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        part, spec_id = key
        if not len(own):
            return pd.DataFrame({c.split()[0]: [] for c in PACKED_SCHEMA.split(", ")})
        own = own.sort_values("doc_id", ascending=False)
        weights = dict(zip(start["source"], start["w"]))
        containers = pack(zip(own["source"], own["doc_id"], own["tokens"]), int(own["capacity"].iloc[0]), weights, dict(zip(start["source"], start["deficit"])))
        flat = [(spec_id, f"{spec_id}-{part:06d}-{i:08d}", j, *p) for i, c in enumerate(containers) for j, p in enumerate(c)]
        out = pd.DataFrame(flat, columns=[c.split()[0] for c in PACKED_SCHEMA.split(", ")])
        return out.astype({"position": np.int32, "piece": np.int32})

    left = items.withColumn("s", each).select("part", "s.spec_id", "s.capacity", "doc_id", "source", "tokens").groupBy("part", "spec_id")
    # Columns that the left side has too are made anew, so that the two sides' can be told apart.
    right = starts.withColumn("s", each).select((F.col("part") + 0).alias("part"), "s.spec_id", F.concat("source", F.lit("")).alias("source"), "w", "deficit").groupBy("part", "spec_id")
    return left.cogroup(right).applyInPandas(fill, PACKED_SCHEMA)


def packing_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """One row a spec: containers, tokens placed, tokens of room, and the part of the room left unused."""
    sizes = packed.groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    own = sizes.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("tokens"), F.sum("n").alias("n_pieces"))
    room = F.col("n_containers") * F.col("capacity_tokens")
    return own.join(specs.select("spec_id", "capacity_tokens").distinct(), "spec_id").select("spec_id", "capacity_tokens", "n_containers", "n_pieces", "tokens", room.alias("room"), (1 - F.col("tokens") / room).alias("unused_share"))


def mixture_report(packed: DataFrame) -> DataFrame:
    """(spec_id, source, share, window_error, without): each source's share of a spec's tokens, the mean part of a container's
    tokens by which its share in the container differs from that, and the part of the tokens in containers without it.

    Sums by container and source come first: what is windowed over is one row a spec and source.
    """
    cells = packed.groupBy("spec_id", "container_id", "source").agg(F.sum("tokens").alias("x"))
    rooms = cells.groupBy("spec_id", "container_id").agg(F.sum("x").alias("room"))
    shares = cells.groupBy("spec_id", "source").agg(F.sum("x").alias("x"))
    shares = shares.withColumn("total", F.sum("x").over(Window.partitionBy("spec_id"))).select("spec_id", "source", "total", (F.col("x") / F.col("total")).alias("share"))
    # Sources are few: one row a spec and source.
    met = cells.join(rooms, ["spec_id", "container_id"]).join(F.broadcast(shares), ["spec_id", "source"])
    own = met.groupBy("spec_id", "source").agg(F.first("share").alias("share"), F.first("total").alias("total"), F.sum("room").alias("room"), F.sum(F.abs(F.col("x") - F.col("share") * F.col("room"))).alias("off"))
    without = 1 - F.col("room") / F.col("total")
    return own.select("spec_id", "source", "share", (F.col("off") / F.col("total") + F.col("share") * without).alias("window_error"), without.alias("without"))


def coverage_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, n_documents, n_pieces, tokens, n_split, n_overfull, n_loose): what a packing must keep: every document with tokens
    once and whole, none split that fits, no container above its capacity, no piece that does not go on where the last one ended."""
    own = packed.groupBy("spec_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.max(F.col("first_token") + F.col("tokens")).alias("end"), F.min("first_token").alias("start"))
    documents = own.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_pieces"), F.sum("t").alias("tokens"), F.count_if(F.col("n") > 1).alias("n_split"), F.count_if((F.col("end") != F.col("t")) | (F.col("start") != 0)).alias("n_loose"))
    rooms = packed.groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("t")).join(F.broadcast(specs.select("spec_id", "capacity_tokens").distinct()), "spec_id")
    full = rooms.groupBy("spec_id").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("n_overfull"))
    return documents.join(full, "spec_id").select("spec_id", "n_documents", "n_pieces", "tokens", "n_split", "n_overfull", "n_loose")
