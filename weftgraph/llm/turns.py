"""Conversations put together again from turns that arrive late, repeated and out of order.

A stateful Structured Streaming query is started once a batch on one checkpoint. Its state is a timing
wheel in each hash bucket of conversations: a conversation is filed in the slot of the batch in which it
closes unless it hears more; an arrival files it again under a new generation, and its earlier entry is
left where it is, void as its generation is past. A batch's tick visits its own slot only, the last tick
all. What a task first sends into the stateful operator is each conversation's name once, however many turns it
has, so a very long conversation costs a bucket no more than a short one.

The turns themselves stay out of that state. Each batch joins its arrivals with what the wheels decided
(accepted or rejected), keeps the earliest arrival of each turn, and finds how far the run of kept turns
without a gap reaches: a place is a gap if its turn is not kept but the one before is (or it is the first),
and a conversation's least gap is the end of its run. That is one grouping by (conversation, turn) and one
least number a conversation, so no conversation is gathered in one task; joins by conversation have a row
a conversation on one side, and Spark splits the other. Only numbers and roles take part; texts are joined
to the events in the end. Each batch's tables are written under spark.checkpoint.dir and replaced if a batch
is done again.

Rules: any arrival opens a conversation and is accepted; IDLE successive batches without an arrival (repeats
are arrivals) close it in the last of them, the end closes the others; every later arrival is rejected.
Turns are null: the row is dropped. Null roles and texts are empty; a null conversation is one of its own.
Equal rows, and several of one turn in a batch, count as that of the least payload (`role|text`, by bytes; of
equal payloads the least role). An empty table gives no events. Other columns are not read.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, on_workers, shared_folder

BATCHES, IDLE = 12, 2
#: Buckets of the state for each shuffle partition.
BUCKETS = 4
#: Names that a task remembers so as not to send one twice.
NAMES = 100_000
#: Rows of a batch's tables for each task, about, and tasks at least: a small batch is no work for very many.
ROWS, TASKS = 50_000, 8

_ARRIVAL = "conv string, turn long, first long, role string, text string, bucket int"


# ---- arrivals


def arrivals(rows: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(batch, conv, turn, first, role, text) of conversations(conv_id, turn, role, text): each row arrives in a batch by
    the hash of its name and turn, two of seven again in another with the role `user`; one row a batch and turn."""
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    plain = rows.where("turn is not null").select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    # The least turn of each conversation meets its rows by a shuffle, as there are as many as conversations.
    firsts = cut(plain.groupBy("conv").agg(F.min("turn").alias("first")))
    h = F.conv(F.substr(F.sha2(F.concat_ws(":", "conv", F.col("turn").cast("string")), 256), F.lit(1), F.lit(8)), 16, 10).cast("long")
    once = F.struct((F.col("h") % batches).alias("batch"), F.col("role"))
    again = F.struct(((F.col("h") + 5) % batches).alias("batch"), F.lit("user").alias("role"))
    each = F.explode(F.when(F.col("h") % 7 < 2, F.array(once, again)).otherwise(F.array(once)))
    dealt = plain.withColumn("h", h).select("conv", "turn", "text", each.alias("a")).select("a.batch", "conv", "turn", "a.role", "text")
    payload = F.concat("role", F.lit("|"), "text")
    least = dealt.groupBy("batch", "conv", "turn").agg(F.min(F.struct(payload.alias("payload"), F.col("role"))).alias("m"))
    least = least.select("batch", "conv", "turn", F.col("m.role").alias("role"), F.substr("m.payload", F.length("m.role") + 2).alias("text"))
    return least.join(firsts.hint("merge"), "conv").select(F.col("batch").cast("int"), "conv", "turn", "first", "role", "text")


def _bucket(conv: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(conv), F.lit(buckets)).cast("int")


# ---- the wheels


class Wheel:
    """A bucket's conversations: open ones with their generation, closed ones, and slots of (conversation, generation)."""

    def __init__(self) -> None:
        self.open: dict[str, int] = {}
        self.closed: set[str] = set()
        self.slots: dict[int, list[tuple[str, int]]] = {}

    def arrive(self, conv: str, batch: int, idle: int = IDLE) -> str:
        if conv in self.closed:
            return "reject"
        generation = self.open[conv] = self.open.get(conv, 0) + 1
        self.slots.setdefault(batch + idle, []).append((conv, generation))
        return "accept"

    def tick(self, batch: int, last: bool = False) -> list[str]:
        """Who closes: of the batch's slot (in the last tick of all) those that have not been filed again since."""
        due = [e for slot in sorted(self.slots) for e in self.slots[slot]] if last else self.slots.get(batch, [])
        self.slots = {} if last else {k: v for k, v in self.slots.items() if k != batch}
        gone = [conv for conv, generation in due if self.open.get(conv) == generation]
        for conv in gone:
            del self.open[conv]
        self.closed.update(gone)
        return gone


def _names_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, conv) of each conversation of a task once, and of each tick (no turn, no name)."""
    seen: set = set()
    for b in batches:
        new = set(zip(b.column("bucket").to_pylist(), b.column("conv").to_pylist())) - seen
        if len(seen) + len(new) > NAMES:
            seen = set()
        seen |= new
        buckets, names = zip(*new) if new else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(names, pa.string())], ["bucket", "conv"])


def _turned(batch: int, last: bool):
    """Of a bucket's names in a batch: what becomes of each arriving conversation, and which close."""
    import pandas as pd

    def run(key, frames, state):
        wheel = pickle.loads(state.get[0]) if state.exists else Wheel()
        names = sorted({c for f in frames for c in f["conv"] if c is not None})
        found = [(c, wheel.arrive(c, batch)) for c in names]
        found += [(c, "close") for c in wheel.tick(batch, last)]
        state.update((pickle.dumps(wheel),))
        yield pd.DataFrame({"conv": [c for c, _ in found], "event": [e for _, e in found]}, dtype=object)

    return run


def _verdicts(stream: DataFrame, batch: int, last: bool) -> DataFrame:
    """(conv, event) of a batch of the stream: accept or reject for those that arrive, close for those that close."""
    names = stream.select("bucket", "conv").mapInArrow(_names_once, "bucket int, conv string")
    state = T.StructType([T.StructField("wheel", T.BinaryType())])
    return names.groupBy("bucket").applyInPandasWithState(_turned(batch, last), "conv string, event string", state, "append", "NoTimeout")


# ---- a batch's turns


_DECIDED = "conv string, event string"
_FIRST = "struct<kept_in: int, role: string, first: bigint, until: bigint>"
_BEFORE = "struct<kept_in: int, role: string>"
_PLACES = f"conv string, place long, mine {_FIRST}, last {_BEFORE}, event string"
_KEPT = "conv string, turn long, first long, role string, kept_in int, before long, until long, repeats boolean, closing boolean"


def _places(joined: DataFrame) -> DataFrame:
    """(conv, place, mine, last, event): of each place in or after a kept turn what is kept there first, and what is kept
    before it.

    joined(conv, turn, first, role, kept_in, until, event): the turns kept so far and those that arrive.
    """
    none, nothing = F.lit(None).cast(_FIRST).alias("mine"), F.lit(None).cast(_BEFORE).alias("last")
    here = F.struct(F.col("turn").alias("place"), F.struct("kept_in", "role", "first", "until").alias("mine"), nothing)
    after = F.struct((F.col("turn") + 1).alias("place"), none, F.struct("kept_in", "role").alias("last"))
    start = F.struct(F.col("first").alias("place"), none, nothing)
    at = joined.select("conv", "event", F.explode(F.array(here, after, start)).alias("p")).select("conv", "event", "p.*")
    # The least struct is that of the earliest batch; of one turn there is one row a batch.
    return at.groupBy("conv", "place").agg(F.min("mine").alias("mine"), F.min("last").alias("last"), F.min("event").alias("event"))


class Reassembly:
    """The tables of one run under `root`: arrivals by batch, and for each batch what the wheels decided and what is kept."""

    def __init__(self, spark: SparkSession, rows: DataFrame, batches: int = BATCHES, buckets: int | None = None) -> None:
        on_workers(spark)
        self.spark, self.batches = spark, batches
        self.buckets = buckets or BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.root = f"{shared_folder(spark)}/turns-{uuid.uuid4()}"
        found = arrivals(rows, batches).withColumn("bucket", _bucket(F.col("conv"), self.buckets))
        # Every bucket's clock ticks in every batch, and once more in the end.
        ticks = spark.range(self.buckets).select(F.explode(F.sequence(F.lit(0), F.lit(batches))).alias("batch"), F.lit(None).cast("string").alias("conv"), *[F.lit(None).cast(k).alias(c) for c, k in (("turn", "long"), ("first", "long"), ("role", "string"), ("text", "string"))], F.col("id").cast("int").alias("bucket"))
        found.unionByName(ticks).repartition("batch", _bucket(F.coalesce("conv", F.col("bucket").cast("string")), 64)).write.partitionBy("batch").parquet(f"{self.root}/arrivals")
        # A number a batch comes to the driver.
        self.sizes = {r["batch"]: r["count"] for r in self.batch_rows().groupBy("batch").count().collect()}

    def _of(self, name: str, schema: str, batch: int | None = None) -> DataFrame:
        """A table of one batch or of all, with the batch. It is data, not a constant of the plan, so that all batches run
        the same code."""
        at = f"{self.root}/{name}"
        return self.spark.read.schema(f"{schema}, batch int").option("basePath", at).parquet(at if batch is None else f"{at}/batch={batch}")

    def batch_rows(self, batch: int | None = None) -> DataFrame:
        """What arrives in a batch (or in all), ticks left out."""
        return self._of("arrivals", _ARRIVAL, batch).where("turn is not null")

    def kept(self, batch: int | None = None) -> DataFrame:
        """Turns of the conversations that are open in a batch or close in it; `until` is where the run of turns ends."""
        return self._of("kept", _KEPT, batch)

    def feed(self, batch: int) -> None:
        """The streaming query over one more batch, from its start to its end."""
        last = batch == self.batches
        source = self.spark.readStream.schema(_ARRIVAL).parquet(f"{self.root}/arrivals/batch={{{','.join(map(str, range(batch + 1)))}}}")
        query = _verdicts(source, batch, last).writeStream.foreachBatch(lambda df, _: self._settled(df, batch)).outputMode("append").option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    def _settled(self, verdicts: DataFrame, batch: int) -> None:
        """Turns kept after a batch, from those kept before it, its arrivals and what the wheels decided."""
        tasks = max(TASKS, sum(n for b, n in self.sizes.items() if b <= batch) // ROWS)
        put = lambda df, name: df.coalesce(tasks).write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")
        put(verdicts, "verdicts")
        decided = self._of("verdicts", _DECIDED, batch).drop("batch")
        both = self.batch_rows(batch).select("conv", "turn", "first", "role", F.col("batch").alias("kept_in"), F.col("first").alias("until"))
        if batch:
            # Those that closed are gone from here on.
            both = both.unionByName(self.kept(batch - 1).where("not closing").select(*both.columns))
        both = both.join(decided.hint("merge"), "conv", "left")
        # Who neither hears anything nor closes stays as it is.
        put(_places(both.where("event in ('accept', 'close')")), "places")
        places = self._of("places", _PLACES, batch)
        # A place's own event is that of its conversation.
        ends = places.groupBy("conv").agg(F.min(F.when(F.col("mine").isNull(), F.col("place"))).alias("end"), F.bool_or(F.col("event") == "close").alias("closing"))
        put(ends, "ends")
        now = places.where("mine is not null").select("conv", "place", "mine", "last").join(self._of("ends", "conv string, end long, closing boolean", batch).drop("batch").hint("merge"), "conv")
        now = now.select("conv", F.col("place").alias("turn"), "mine.first", "mine.role", "mine.kept_in", F.col("mine.until").alias("before"), F.col("end").alias("until"), F.coalesce(F.col("last.role") == F.col("mine.role"), F.lit(False)).alias("repeats"), "closing")
        same = both.where("event is null").select("conv", "turn", "first", "role", "kept_in", F.col("until").alias("before"), "until", F.lit(False).alias("repeats"), F.lit(False).alias("closing"))
        put(now.unionByName(same), "kept")

    def run(self) -> Reassembly:
        for batch in range(self.batches + 1):
            self.feed(batch)
        return self

    def events(self) -> DataFrame:
        """(event, conv, turn, role, text, batch, unreleased, n_missing, n_breaks) of the whole run.

        A close carries the kept turns that were not released, in order, and the numbers of turns missing and
        of turns with the role of the one before.
        """
        kept = self.kept()
        released = kept.where("not closing and turn >= before and turn < until").select("conv", "turn", F.col("kept_in").alias("came_in"), "batch", F.lit("release").alias("event"))
        refused = self._of("verdicts", _DECIDED).where("event = 'reject'").select("conv", F.col("batch").alias("refused_in"))
        texts = self.batch_rows().select("conv", "turn", F.col("batch").alias("came_in"), "role", "text")
        released = texts.join(released.hint("merge"), ["conv", "turn", "came_in"])
        refused = texts.join(refused.hint("merge"), (texts["conv"] == refused["conv"]) & (F.col("came_in") == F.col("refused_in"))).select(texts["conv"], "turn", "role", "text", F.col("came_in").alias("batch"), F.lit("reject").alias("event"))
        none = [F.lit(None).cast("array<bigint>").alias("unreleased"), F.lit(None).cast("long").alias("n_missing"), F.lit(None).cast("long").alias("n_breaks")]
        turns = released.select("event", "conv", "turn", "role", "text", "batch", *none).unionByName(refused.select("event", "conv", "turn", "role", "text", "batch", *none))
        return turns.unionByName(self._closed(kept.where("closing")))

    def _closed(self, closing: DataFrame) -> DataFrame:
        """A row for each conversation that closed; its turns are first gathered by stretches of 1024."""
        left = F.when(F.col("turn") >= F.col("until"), F.col("turn"))
        part = closing.groupBy("conv", "batch", "first", F.shiftright("turn", 10).alias("stretch")).agg(F.sort_array(F.collect_list(left)).alias("left"), F.count("*").alias("n"), F.max("turn").alias("most"), F.sum(F.col("repeats").cast("long")).alias("breaks"))
        whole = part.groupBy("conv", "batch", "first").agg(F.sort_array(F.collect_list(F.struct("stretch", "left"))).alias("parts"), F.sum("n").alias("n"), F.max("most").alias("most"), F.sum("breaks").alias("breaks"))
        return whole.select(F.lit("close").alias("event"), "conv", F.lit(-1).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "batch", F.flatten(F.col("parts.left")).alias("unreleased"), (F.col("most") - F.col("first") + 1 - F.col("n")).alias("n_missing"), F.col("breaks").alias("n_breaks"))


def reassembled(rows: DataFrame) -> DataFrame:
    """The events of conversations(conv_id, turn, role, text)."""
    return Reassembly(rows.sparkSession, rows).run().events()


def digests(events: DataFrame) -> DataFrame:
    """(event, sha256, conv_id, turn, batch, n_missing, n_breaks) of events."""
    closing = F.col("event") == "close"
    said = F.when(closing, F.array_join(F.col("unreleased").cast("array<string>"), ",")).otherwise(F.concat("role", F.lit("|"), "text"))
    return events.select("event", F.sha2(said.cast("binary"), 256).alias("sha256"), F.expr("nullif(conv, '')").cast("long").alias("conv_id"), "turn", F.col("batch").cast("long").alias("batch"), "n_missing", "n_breaks")
