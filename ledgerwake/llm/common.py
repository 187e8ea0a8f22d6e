"""What the operators of this subpackage share: the shared folder, written tables, words."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"


#: Rows of a few numbers up to which a table is broadcast whatever Spark's own estimate.
MOST_BROADCAST = 500_000
_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder in spark.checkpoint.dir (or in what setCheckpointDir was given), which driver and executors share; deleted when the session's JVM ends. Only a local session, as in tests, may leave it unset: it gets a temporary one."""
    context = spark.sparkContext
    own = _folders.get(context.applicationId)
    if own is None:
        root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not root:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = f"file://{tempfile.mkdtemp(prefix='ledgerwake-')}"
            context.setCheckpointDir(root)
            spark.conf.set("spark.checkpoint.dir", root)
        own = _folders[context.applicationId] = f"{root.rstrip('/')}/ledgerwake-{uuid.uuid4().hex}"
        path = context._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back, so that a lost executor costs a reread and not a recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(table: DataFrame) -> DataFrame:
    """A written table of a few numbers a row as one side of a join: broadcast if it has at most MOST_BROADCAST rows, else as it is."""
    return F.broadcast(table) if table.count() <= MOST_BROADCAST else table


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the columns' values, the same on every run."""
    bits = F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % n


def joined_by_size(rows: DataFrame, sizes: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows joined with the one row that sizes has for each key, n being how many rows have that key and total their sum.

    Keys that one task should not get whole, those of more than 200 rows and of more than a ten-thousandth of the total, are
    at most 10,000: they are broadcast, and their rows stay where they are. All other rows are joined as usual.
    """
    if total <= 200:
        return rows.join(sizes, key)
    hot = F.col(n) > max(200, total // 10_000)
    heavy = F.broadcast(sizes.filter(hot))
    rest = rows.join(F.broadcast(sizes.filter(hot).select(key)), key, "left_anti").join(sizes.filter(~hot), key)
    return rows.join(heavy, key).unionByName(rest)


class Recent(dict):
    """What make gives for the keys met lately. At limit entries it starts anew, with those that it had until then at hand. Keys of over LONGEST characters are made each time, so that the entries have a bound in bytes too."""

    LONGEST = 256

    def __init__(self, make, limit: int = 100_000):
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        if len(key) > self.LONGEST:
            return self.make(key)
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def in_slices(texts, most_chars: int, most_rows: int = 1 << 30):
    """Lists of texts of about so many characters, and at most so many texts; a longer text is alone in its list, whole."""
    own, size = [], 0
    for x in texts:
        if own and (size + len(x or "") > most_chars or len(own) >= most_rows):
            yield own
            own, size = [], 0
        own.append(x)
        size += len(x or "")
    if own:
        yield own


def spare(name: str, columns: list[str]) -> str:
    """The name, with as many underscores before it as keep it apart from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
