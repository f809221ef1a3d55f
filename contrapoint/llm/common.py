"""Shared helpers: staged tables, worker caches and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z and a-z, for lower-casing that leaves all other letters alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Edges of a node that one task works on; a node with more is a hub.
HUB_EDGES = 1_000_000
#: Bits of the filter before a join that moves texts, for each wanted id and at most: two million words of 64 bits.
BLOOM_PLACES, BLOOM_BITS = 64, 1 << 27

#: What is at least so large goes back to the system as soon as it is freed; the C library's numbers for that and for how
#: much it keeps at the heap's end.
LARGE, M_MMAP_THRESHOLD, M_TRIM_THRESHOLD = 8 << 20, -3, -1

_STAGED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where it is set.

    Where it is unset, a local master (tests) gets a temporary folder and a cluster the warehouse; on a cluster whose
    warehouse is a local path there is no such folder, which raises.
    """
    sc = spark.sparkContext
    if base := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return base
    if not (sc.master == "local" or sc.master.startswith("local[")):
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if "://" not in warehouse.replace("file:///", "file:/"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return warehouse.rstrip("/") + "/staged"
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="contrapoint-"))
    return sc.getCheckpointDir()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    The table cuts lineage and outlives executors; it is read by any number of later jobs. The shuffle files behind it
    are of no more use, but Spark keeps them until the driver's garbage is collected, so that is asked for here.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    df.write.parquet(path)
    del df  # else the collection would only move its shuffles to the old generation
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def staged_so_far() -> int:
    """How many staged tables there are, for ``drop_staged``."""
    return len(_STAGED)


def drop_staged(spark: SparkSession, since: int = 0, but: int = 0) -> int:
    """Delete the tables staged after the first ``since``, without the last ``but``, once nothing reads them; how many.

    An operator's own tables are needed until its result is written; then ``drop_staged(spark)`` frees them.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = _STAGED[since : len(_STAGED) - but]
    del _STAGED[since : len(_STAGED) - but]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    return len(gone)


def give_back() -> None:
    """Gives what the process has freed back to the system, else an idle worker keeps it while the JVM beside it grows."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def worker_cache(owner: str, hold: bool = False) -> dict:
    """A dictionary that lives as long as the Python process, for models and words that an operator's tasks share.

    Another operator that runs in the process later empties it first and gives its memory back to the system, so memory
    never adds up over operators. With ``hold`` the process keeps more of what it frees, which saves time.
    """
    cache = sys.__dict__.setdefault("_contrapoint_cache", {})
    if cache.get("owner") != owner:
        cache.clear()
        cache["owner"] = owner
        gc.collect()
        give_back()
        with contextlib.suppress(OSError, AttributeError):
            libc = ctypes.CDLL(None)
            if not hold:
                pa.set_memory_pool(pa.system_memory_pool())  # the default pool keeps what it frees
                libc.mallopt(M_MMAP_THRESHOLD, LARGE)
                libc.mallopt(M_TRIM_THRESHOLD, 8 * LARGE)  # else the heap's end would come and go with every small block
    return cache


def small_batches(docs: DataFrame, rows: int = 400) -> DataFrame:
    """``docs``, with the session's Arrow batches at ``rows`` rows where they are at Spark's default.

    Ten thousand whole texts at a time, in and out of each task, would take most of a small executor.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if docs.sparkSession.conf.get(name) == "10000":
        docs.sparkSession.conf.set(name, str(rows))
    return docs


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def held_out(doc_id, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % modulus == remainder, F.lit(False))


def labelled_sample(rows: DataFrame, most: int, most_bytes: int) -> list:
    """Rows (``label``, ``text``) of ``rows`` (``id``, ``label``, ``text``), whole texts: a sample bounded in rows and bytes.

    Rows come in the order of a hash of their ids; of the first ``most``, one that would take the texts over
    ``most_bytes`` together is passed over. Rows that are alike count once; null texts are empty.
    """
    keys = ["h", "id", "label", "size", "mark"]
    rows = rows.select(F.xxhash64("id").alias("h"), "id", "label", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("size", F.octet_length("text")).withColumn("mark", F.xxhash64("text"))
    chosen, total = [], 0
    for r in rows.select(keys).distinct().orderBy(*keys).limit(most).collect():
        if total + r["size"] <= most_bytes:
            chosen.append(tuple(r))
            total += r["size"]
    own = rows.sparkSession.createDataFrame(chosen, rows.select(keys).schema)
    return rows.join(F.broadcast(own), keys).groupBy(keys).agg(F.min("text").alias("text")).orderBy(*keys).select("label", "text").collect()


def tile_rows(df: DataFrame, keys: list[str], sizes: DataFrame, row_key: str, block: int) -> DataFrame:
    """Deal the rows of each group to square tiles of at most about 2 x ``block`` rows.

    ``sizes`` has ``keys`` and ``n``, each group's rows. A group of g blocks gets g (g + 1) / 2 tiles
    (``ti`` <= ``tj``); a row of block b (``tb``) goes to the g tiles that name b, so any two rows of a group meet in
    one tile and no task gets a whole hot group.
    """
    g = F.ceil(F.col("n") / block).cast("int")
    df = df.join(sizes, keys).withColumn("tg", g).withColumn("tb", F.pmod(F.xxhash64(row_key, F.lit(7)), F.col("tg")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tg") - 1)))
    return df.withColumn("ti", F.least("tb", "other")).withColumn("tj", F.greatest("tb", "other")).drop("other", "tg", "n")


def maybe_among(rows: DataFrame, key: str, ids: DataFrame, most: int = BLOOM_BITS) -> DataFrame:
    """The rows whose ``key`` may be one of ``ids`` (one column, written): all of those that are, and few others.

    A Bloom filter with one hash, as a table of 64-bit words, with ``BLOOM_PLACES`` bits an id up to ``most``, so it has at most
    ``most`` / 64 rows and can be broadcast however large the data are. Where ids are so many that such a filter would
    let most rows pass, there is none, and the join that follows has all rows. It comes before a join that moves whole texts.
    """
    n = ids.count()
    bits = min(most, 1 << max(10, (BLOOM_PLACES * n - 1).bit_length()))
    if n > bits // 2:
        return rows
    place = lambda c: F.pmod(F.xxhash64(c, F.lit(1)), F.lit(bits))
    own = ids.select(place(F.col(ids.columns[0])).alias("_p"))
    words = own.groupBy(F.shiftright("_p", 6).alias("_w")).agg(F.expr("bit_or(shiftleft(1L, cast(_p & 63 AS int)))").alias("_b"))
    marked = rows.withColumn("_p", place(F.col(key))).withColumn("_w", F.shiftright("_p", 6))
    hit = F.expr("shiftright(_b, cast(_p & 63 AS int)) & 1 = 1")
    return marked.join(F.broadcast(words), "_w").where(hit).select(*rows.columns)  # at most bits / 64 rows


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(``node``, ``component``) for the nodes of ``edges`` (``u``, ``v``); the component is its least node.

    Alternates large-star and small-star steps, each a partial minimum and an equi-join; every round is staged, and one
    that has not settled after ``rounds`` rounds, of which there are about twice the logarithm of the longest path, raises. A hub's
    edges are dealt to as many parts as its degree asks for; the hubs' parts are broadcast, one row for every ``HUB_EDGES``
    edges or fewer, and all else are plain shuffles. Nodes without edges are not returned; null ends are dropped.
    """

    def lowest(e: DataFrame, low: DataFrame) -> DataFrame:
        """The edges with their first node's ``m``."""
        if count <= HUB_EDGES:  # no node can be a hub
            return e.join(low.drop("degree"), "u")
        hubs = low.where(F.col("degree") > HUB_EDGES).select("u", (F.col("degree") / HUB_EDGES + 1).cast("int").alias("parts"))
        dealt = e.join(F.broadcast(hubs), "u", "left")  # a node for every HUB_EDGES edges at most
        dealt = dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64("v"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
        last = F.when(F.col("degree") > HUB_EDGES, (F.col("degree") / HUB_EDGES).cast("int")).otherwise(0)
        return dealt.join(low.withColumn("part", F.explode(F.sequence(F.lit(0), last))).drop("degree"), ["u", "part"]).drop("part")

    def stars(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
        large = lowest(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        small = lowest(large, low).select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.*")
        return small.where("u <> v").distinct()

    spark, before, since = edges.sparkSession, None, staged_so_far()
    edges = staged(edges.where("u <> v").select("u", "v").distinct(), "components")
    count = 2 * edges.count()  # both ways
    for _ in range(rounds):
        edges = staged(stars(edges), "components")
        drop_staged(spark, since, but=1)  # the round before
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, count = now, 2 * now[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
