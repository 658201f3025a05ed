"""What the operators of this subpackage share: reading tables, the shared work folder, word rules, components."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of bytes other than the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
_TO_LOWER = str.maketrans(UPPER, LOWER)


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only; any other letter stays as it is."""
    return text.lower() if text.isascii() else text.translate(_TO_LOWER)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(ascii_lower(text)) if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tessel-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        found = f"file://{_own[0]}"
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder. They cut lineage, survive lost executors, and can be dropped as soon as nothing reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/tessel/{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame, name: str = "t", codec: str = "zstd") -> DataFrame:
        """A written table; codec "none" also leaves out dictionaries, for columns of hashes that neither would make smaller."""
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.option("compression", codec).option("parquet.enable.dictionary", str(codec != "none").lower()).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def measured(self, df: DataFrame, name: str, **sums) -> tuple[DataFrame, dict]:
        """A written table and aggregates over its rows, taken while they are written."""
        seen = Observation()
        out = self.write(df.observe(seen, *(x.alias(k) for k, x in sums.items())), name)
        return out, seen.get

    def drop(self, *dfs: DataFrame) -> None:
        """Delete the files behind tables that write() returned, then let Spark remove shuffle files of plans nobody holds."""
        jvm = self.spark._jvm
        for df in dfs:
            for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
                path = jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        self.sweep()

    def sweep(self) -> None:
        """Shuffle files go once the driver has collected the plans that made them, which Python's own garbage may still hold."""
        for _ in range(2):  # the first round frees what holds the plans
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.1)
        trim(self.spark)


def trim(spark: SparkSession) -> None:
    """Memory that the driver's C library keeps after its threads have freed it goes back to the system, by the JVM's diagnostic
    command; JVMs that have no such command are left alone. Called by reflection, as the bean server's own class isn't public."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    of, text = jvm.java.lang.Class.forName, jvm.java.lang.String
    bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()

    def call(name: str, kinds: list[str], *values):
        types, given = gateway.new_array(jvm.java.lang.Class, len(kinds)), gateway.new_array(jvm.java.lang.Object, len(kinds))
        for i, (kind, value) in enumerate(zip(kinds, values, strict=True)):
            types[i], given[i] = of(kind), value
        return of("javax.management.MBeanServer").getMethod(name, types).invoke(server, given)

    key = "javax.management.ObjectName"
    if call("isRegistered", [key], bean) and any(x.getName() == "systemTrimNativeHeap" for x in call("getMBeanInfo", [key], bean).getOperations()):
        call("invoke", [key, "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"], bean, "systemTrimNativeHeap", gateway.new_array(jvm.java.lang.Object, 0), gateway.new_array(text, 0))


def crc_mod(column: str, n: int):
    """crc32 of an id's decimal text, modulo n (null id: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


class WordHash(dict):
    """64-bit hashes of words, remembered; forgets all beyond MOST words."""

    MOST = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.MOST:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def mix64(h):
    """A bijection on 64-bit numpy integers that spreads their bits."""
    import numpy as np

    u = np.uint64
    h = (h ^ (h >> u(32))) * u(0xD6E8FEB86659FD93)
    h = (h ^ (h >> u(29))) * u(0xBF58476D1CE4E5B9)
    return h ^ (h >> u(32))


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the smallest node of its component, by alternating stars.

    Every round halves the paths to the roots at least; rows stay at two an edge, and hubs are joined, not gathered. The
    rounds end when one leaves the edges as they are, told by their number and the sum of their hashes.
    """
    mark = {"n": F.count("*"), "x": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    now, before = scratch.measured(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", **mark)
    while before["n"]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.write(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v")))
        new, found = scratch.measured(small.distinct(), "edges", **mark)
        scratch.drop(now, large)
        now, before, ended = new, found, found == before
        if ended:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
