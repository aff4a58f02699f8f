"""Shared plumbing: reading tables, writing intermediate tables, word hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import itertools
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where that setting is absent, a session that runs in one process (tests) gets a temporary folder,
    which goes at exit; any other session is an error, as its executors could not see such a folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="kinlattice-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    The table goes when the driver's JVM ends, or by dropped(). Shuffle files of the plan that wrote it go at once: Spark
    removes them when the driver collects the plan, which on its own it does seldom, whatever the size of the files.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/kinlattice-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    gc.collect()
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    out.folder = folder
    return out


def dropped(df: DataFrame) -> None:
    """Remove the table that staged() wrote; no plan may read it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def nested(df: DataFrame, **added: Column) -> DataFrame:
    """A struct column row of all of df's columns beside the added ones, so that no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in added.items()])


def flattened(df: DataFrame, names: list[str], *more: Column) -> DataFrame:
    """The columns that nested() put into row."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in names], *more)


def hash128(*parts: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes; together wide enough that different values never meet."""
    return F.xxhash64(*parts), F.xxhash64(F.lit(0x5EED), *parts)


BATCH_ROWS = 4_000  # rows that go to a Python worker at a time: documents are longer than what the default counts on


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to BATCH_ROWS, where it has more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


class Slots:
    """Which of a fixed number of slots some hashes fall in: a bit each, handed to a plan as the only value of a subquery.

    A filter before a join: rows whose slot is empty can have no partner and need not be shuffled. Its
    size doesn't follow the data; with more hashes than slots it lets more rows through, never fewer.
    Seven bits go to a byte, so that every byte is a sign that ascii() reads.
    """

    def __init__(self, hashes: DataFrame, name: str, slots: int = 7 << 20):
        self.slots = slots
        at = hashes.select(self._slot(F.col(name)).alias("s")).distinct().toArrow().column("s").to_numpy()  # at most slots numbers
        held = np.zeros(-(-slots // 7), np.uint8)
        np.bitwise_or.at(held, at // 7, (1 << (at % 7)).astype(np.uint8))
        self.used = len(at)
        self.table = hashes.sparkSession.createDataFrame([(bytearray(held.tobytes()),)], "held binary")

    def _slot(self, h: Column) -> Column:
        return F.pmod(h, F.lit(self.slots)).cast("int")

    def has(self, h: Column) -> Column:
        at = self._slot(h)
        byte = F.ascii(F.substring(self.table.scalar(), ((at - F.pmod(at, F.lit(7))) / 7 + 1).cast("int"), F.lit(1)).cast("string"))
        return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(7)]), F.pmod(at, F.lit(7)) + 1)) != 0


def salted(counts: DataFrame, name: str, count: str, least: int):
    """A function from a key to its number of salts: 1, or 8, 64, ... for keys of more than least, 8 * least, ... rows.

    Both sides of a join use it: the one with the rows deals them over the salts, the other repeats its row for each.
    """
    most = counts.agg(F.max(count)).first()[0] or 0
    tiers = []
    while most > least * 8 ** len(tiers):
        tiers.append(Slots(counts.where(F.col(count) > least * 8 ** len(tiers)), name))

    def of(key: Column) -> Column:
        out = F.lit(1)
        for i, t in enumerate(tiers, 1):
            out = F.when(t.has(key), 8**i).otherwise(out)
        return out

    return of


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """Word to 64-bit hash, remembered up to a bounded number of words."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 77)
        return value


def shingle_sets(texts: list, words: WordHash, width: int = 5, chunk: int = 200_000) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles.

    Letters A-Z are lower-cased; words are what lies between ASCII white space. A text of fewer
    words than width has its whole word sequence as its only shingle; one without words has none.
    Texts are hashed together, up to about chunk words at a time.
    """
    out: list[np.ndarray] = []
    held: list[list[bytes]] = []
    size = 0

    def settle() -> None:
        nonlocal held, size
        n = [len(t) for t in held]
        h = np.fromiter(map(words.__getitem__, itertools.chain.from_iterable(held)), np.uint64, sum(n))
        acc = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for j in range(width):
            acc *= _MULTIPLIER
            acc += h[j : len(acc) + j]
        acc = mix(acc + np.uint64(width))
        at = 0
        for k in n:
            if k >= width:
                s = np.sort(acc[at : at + k - width + 1])
                new = np.empty(len(s), bool)
                new[0] = True
                np.not_equal(s[1:], s[:-1], out=new[1:])
                out.append(s[new])
            elif k:
                one = np.zeros(1, np.uint64)
                for x in h[at : at + k]:
                    one = one * _MULTIPLIER + x
                out.append(mix(one + np.uint64(k)))
            else:
                out.append(np.empty(0, np.uint64))
            at += k
        held, size = [], 0

    for t in texts:
        tokens = t.encode("utf-8", "surrogatepass").lower().split() if t else []
        held.append(tokens)
        size += len(tokens)
        if size >= chunk:
            settle()
    settle()
    return out


def shingle_set(text: str | None, words: WordHash, width: int = 5) -> np.ndarray:
    return shingle_sets([text], words, width)[0]


kept: list = []  # cached functions whose values a worker keeps from task to task, for work that is marked by keeping()


def trimmed(forget: bool = False) -> None:
    """Give freed memory back: a worker that is used again would else hold what its largest task took, beside the JVM's heap.

    forget: what the functions in kept hold goes too.
    """
    import pyarrow as pa

    for cache in kept if forget else []:
        cache.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def map_columns(df: DataFrame, inputs: list[Column], work, schema: str) -> DataFrame:
    """Run work over Arrow batches: it gets one list per input and gives a dict of columns named by schema.

    A generator is allowed too; ids keep all 64 bits, also where a column holds nulls.
    work may be a function of no arguments that returns the function, where it has attribute 'starts'.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    out_schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out_schema)
    starts, keeps = getattr(work, "starts", False), getattr(work, "keeps", False)

    def run(batches):
        trimmed(forget=not keeps)
        f = work() if starts else work
        for b in batches:
            made = f(*(c.to_pylist() for c in b.columns))
            for cols in [made] if isinstance(made, dict) else made:
                yield pa.RecordBatch.from_arrays([pa.array(cols[x.name], x.type, from_pandas=False) for x in arrow], schema=arrow)
        f = b = made = cols = None
        trimmed()

    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(inputs)]).mapInArrow(run, out_schema)


def rested(spark: SparkSession) -> None:
    """Let executors give back what they hold from work that is over: workers' memory and caches, and the JVM's heap.

    A JVM's heap stays as large as its busiest moment made it, until a full collection; the next work's Python workers
    would come on top of it. One short task for each core, which a full collection of a heap mostly empty ends.
    """
    cores = spark.sparkContext.defaultParallelism
    done = map_columns(spark.range(0, cores, 1, cores), [F.col("id")], lambda ids: {"id": ids}, "id long")
    done.select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()  # a row for each core


def columns(names, rows: list) -> dict[str, list]:
    """Rows as named lists, also where there is no row."""
    return {n: [r[i] for r in rows] for i, n in enumerate(names)}


def starting(f):
    """Mark a function that makes the function for map_columns, once per task."""
    f.starts = True
    return f


def keeping(f):
    """Mark a function for map_columns that uses what the functions in kept hold; other work lets a worker forget it."""
    f.keeps = True
    return f
