"""Tables that outlive a run: a store of vectors by the content of their texts, and caches of reference log-probabilities.

Both lie in any file system that Spark reaches. Rows are written by Spark's own commit, so a task that is repeated leaves nothing
twice; what readers see changes by one rename.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, ContractError, DataError
from ..session import checkpointed


class Files:
    """The few file operations that the stores need, through Hadoop."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._path(folder).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def write(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name: str) -> str:
        data = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8")
        finally:
            data.close()

    def rename(self, name: str, to: str) -> bool:
        """Whether name has become to; never over something that is there."""
        return not self.exists(to) and self._fs.rename(self._path(name), self._path(to))

    def make(self, folder: str) -> None:
        self._fs.mkdirs(self._path(folder))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


# --- vectors by content -------------------------------------------------------------------------------------------------------


class VectorStore:
    """sha (of encoder and text), vector: what an encoder made of texts, kept over runs.

    Each generation is a table bucketed by sha, so that lookups shuffle texts and not the store. put() appends to the newest one;
    compact() writes the next one, with each sha once, and publishes it by renaming its marker. Contents never depend on who wrote
    them: a run that died half way leaves right rows, two runs at once leave some twice, and get() and compact() take one of each.
    """

    SCHEMA = "sha string, vector array<double>"

    def __init__(self, spark: SparkSession, folder: str, encoder: str, buckets: int = 64):
        self.spark, self.folder, self.encoder, self.buckets = spark, folder, encoder, buckets
        self.files = Files(spark, folder)
        header = f"{folder}/store.json"
        if not self.files.exists(header):
            self.files.make(folder)
            own = f"{folder}/.{uuid.uuid4().hex}"
            self.files.write(own, json.dumps({"encoder": encoder, "buckets": buckets}))
            if not self.files.rename(own, header):
                self.files.delete(own)
        found = json.loads(self.files.read(header))
        if found["encoder"] != encoder:
            raise ContractError(f"the store at {folder} is of encoder {found['encoder']!r}, not {encoder!r}")
        self.buckets = found["buckets"]

    def _generation(self) -> int:
        marks = [n for n in self.files.names(self.folder) if n.startswith("newest-")]
        return max((int(n.removeprefix("newest-")) for n in marks), default=0)

    def _table(self, generation: int) -> str:
        """The generation's name in this session's catalog; a new session learns of it here."""
        name = f"vectors_{uuid.uuid5(uuid.NAMESPACE_URL, self.folder).hex}_{generation}"
        at = f"{self.folder}/generation-{generation:06d}"
        self.spark.sql(f"create table if not exists {name} ({self.SCHEMA}) using parquet clustered by (sha) sorted by (sha) into {self.buckets} buckets location '{at}'")
        self.spark.catalog.refreshTable(name)
        return name

    def sha(self, text: str = "text"):
        """The address of a text's vector; a null text is an empty one."""
        return F.sha2(F.concat(F.lit(self.encoder), F.char(F.lit(0)), F.coalesce(F.col(text), F.lit(""))), 256)

    def rows(self) -> DataFrame:
        return self.spark.table(self._table(self._generation())).groupBy("sha").agg(F.first("vector").alias("vector"))

    def put(self, vectors: DataFrame) -> None:
        """Appends the different shas of vectors (sha, vector) that are not there."""
        name = self._table(self._generation())
        new = vectors.select("sha", F.col("vector").cast("array<double>").alias("vector")).dropDuplicates(["sha"])
        new.join(self.spark.table(name).select("sha"), "sha", "left_anti").write.insertInto(name)
        self.spark.catalog.refreshTable(name)

    def get(self, shas: DataFrame) -> DataFrame:
        """sha, vector of those of shas (a table with sha) that are there."""
        return self.rows().join(shas.select("sha").distinct(), "sha")

    def embed(self, rows: DataFrame, text: str, encode: Callable[[DataFrame], DataFrame], out: str = "vector") -> DataFrame:
        """rows with their vectors. encode(sha, text) sees, once, every different text that the store lacks; then it is there."""
        keyed = rows.withColumn("_sha", self.sha(text))
        asked = checkpointed(keyed.select(F.col("_sha").alias("sha"), F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["sha"]))
        missing = asked.join(self.spark.table(self._table(self._generation())).select("sha"), "sha", "left_anti")
        self.put(encode(checkpointed(missing)))
        found = self.get(asked)
        return keyed.join(found.select(F.col("sha").alias("_sha"), F.col("vector").alias(out)), "_sha", "left").drop("_sha")

    def compact(self) -> int:
        """Writes what is there as few sorted files, each sha once, and returns the new generation's number.

        What another run put meanwhile is not lost for good: it is encoded again where it is asked for. The generation before the last
        one stays for readers that have begun; older ones go.
        """
        now = self._generation()
        following = self._table(now + 1)
        self.rows().repartition(self.buckets, "sha").write.mode("overwrite").insertInto(following)
        own = f"{self.folder}/.{uuid.uuid4().hex}"
        self.files.write(own, "")
        if not self.files.rename(own, f"{self.folder}/newest-{now + 1:06d}"):
            self.files.delete(own)
            raise DataError(f"{self.folder} was compacted by another run")
        for old in range(now):
            self.spark.sql(f"drop table if exists {self._table(old)}")
            for name in (f"generation-{old:06d}", f"newest-{old:06d}"):
                self.files.delete(f"{self.folder}/{name}")
        return now + 1


# --- reference log-probabilities -------------------------------------------------------------------------------------------------

#: What a cache is bound to: the reference's fingerprint, the digest of the pairs, how log-probabilities are normalised.
HEADER = ("fingerprint", "data_digest", "length_norm")


def publish_cache(rows: DataFrame, path: str, header: dict[str, str], key: str = "uid") -> None:
    """Writes (key, chosen, rejected) with its header beside the place it is for, and moves both there by one rename.

    A cache that is there already stays: it is kept if it has the same header, else that is an error.
    """
    if missing := [h for h in HEADER if not header.get(h)]:
        raise ConfigError(f"a cache needs {', '.join(missing)}")
    files = Files(rows.sparkSession, path)
    own = f"{path}.{uuid.uuid4().hex}"
    rows.select(key, F.col("chosen").cast("double").alias("chosen"), F.col("rejected").cast("double").alias("rejected")).write.parquet(f"{own}/rows")
    files.write(f"{own}/header.json", json.dumps({h: header[h] for h in HEADER} | {"key": key, "rows": rows.sparkSession.read.parquet(f"{own}/rows").count()}))
    if not files.rename(own, path):
        files.delete(own)
        read_header(rows.sparkSession, path, header)


def read_header(spark: SparkSession, path: str, expected: dict[str, str]) -> dict:
    """The header of a cache that is this run's; ContractError says by what it is another's."""
    files = Files(spark, path)
    if not files.exists(f"{path}/header.json"):
        raise DataError(f"there is no cache at {path}")
    found = json.loads(files.read(f"{path}/header.json"))
    other = [f"{h} {found.get(h)!r} and not {expected.get(h)!r}" for h in HEADER if found.get(h) != expected.get(h)]
    if other:
        raise ContractError(f"the cache at {path} has {'; '.join(other)}")
    return found


def read_cache(spark: SparkSession, path: str, expected: dict[str, str]) -> DataFrame:
    """key, chosen, rejected of a cache that is this run's and whole."""
    header = read_header(spark, path, expected)
    rows = spark.read.parquet(f"{path}/rows")
    if rows.count() != header["rows"]:
        raise DataError(f"the cache at {path} should have {header['rows']} rows")
    return rows


def make_reference(pairs: DataFrame, path: str, score: Callable[[DataFrame], DataFrame], fingerprint: str, length_norm: str = "sum", key: str = "pair_uid") -> DataFrame:
    """pairs with ref_chosen and ref_rejected: of the cache at path, which score(pairs) (key, chosen, rejected) fills where there is none."""
    from ..operators.ledger import reference_lookup
    from ..operators.tokens import dataset_digest

    spark = pairs.sparkSession
    header = {"fingerprint": fingerprint, "data_digest": dataset_digest(pairs, key).first().digest, "length_norm": length_norm}
    if not Files(spark, path).exists(path):
        publish_cache(score(pairs), path, header, key)
    return reference_lookup(pairs, read_cache(spark, path, header), key)
