"""Occurrence and record counts of every term, kept up to date by signed deltas (problem 4).

A record holds items, an item holds one term. The store keeps, in the shared folder,

* ``ledger``: the items of all records, as a log; the last row of an item counts, a null term deletes it. A piece of more than
  ``LEDGER_ROWS`` rows is parted into buckets of records;
* ``counts``: term, occurrences and records: a base and the signed changes of later loads.

A load turns old and new images of the touched records into signed changes (term, change of occurrences,
change of records) and adds one file set with them: nothing that is there is rewritten, and the number of tasks follows the data.
Readers merge base and changes with one aggregate by term. Once the changes are ``COMPACT_PIECES`` sets, or half as many
rows as the base, a load merges them into a new base, and the log into the last rows of its items.

A manifest names what counts. It is written under a name of its own and then renamed to the next version, so that a
reader sees a load wholly or not at all; what a lost load left behind has names that no other load uses.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.session import materialize, new_path, require_columns

LEDGER_ROWS = 4_000_000
MOST_BUCKETS = 4096
COMPACT_PIECES = 8
COMPACT_SHARE = 0.5


def signed_deltas(images: DataFrame) -> DataFrame:
    """term, d_occ, d_rec from images (record, old, new) of items: null old is added, null new is deleted.

    All items of a touched record must be there, the unchanged ones too. Equal images cancel out.
    """
    sides = [F.struct(F.col(c).alias("term"), F.lit(sign).alias("sign")) for c, sign in (("old", -1), ("new", 1))]
    signed = images.select("record", F.explode(F.array(*sides)).alias("s")).select("record", "s.*")
    pairs = (
        signed.where(F.col("term").isNotNull())
        .groupBy("record", "term")
        .agg(F.sum("sign").alias("d_occ"), F.max("sign").alias("has_new"), F.min("sign").alias("has_old"))
    )
    d_rec = F.when(F.col("record").isNull(), 0).otherwise((F.col("has_new") == 1).cast("int") - (F.col("has_old") == -1).cast("int"))
    return (
        pairs.select("term", "d_occ", d_rec.alias("d_rec"))
        .groupBy("term")
        .agg(F.sum("d_occ").cast("bigint").alias("d_occ"), F.sum("d_rec").cast("bigint").alias("d_rec"))
        .where((F.col("d_occ") != 0) | (F.col("d_rec") != 0))
    )


class TermCountStore:
    """Persistent counts of terms over records that are added, changed and deleted.

    Items without a term are deletions, items without an id are left out, repeated items of a load
    count once (the largest record and term). Items without a record count as occurrences in no record.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or new_path(spark, "term-counts")
        self.manifest = self._read_manifest()

    # -- manifest ---------------------------------------------------------------------------------
    def _fs(self, name: str = ""):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        fs, p = self._fs()
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[9:-5]) for n in names if n.startswith("MANIFEST-") and n.endswith(".json"))

    def _read_manifest(self) -> dict:
        versions = self._versions()
        if not versions:
            return {"version": 0, "ledger": [], "counts": [], "types": None}
        _, p = self._fs(f"MANIFEST-{versions[-1]:08d}.json")
        return json.loads(self.spark.read.text(str(p.toString()), wholetext=True).first()[0])

    def _commit(self, manifest: dict) -> None:
        manifest = manifest | {"version": self.manifest["version"] + 1}
        fs, p = self._fs(f"MANIFEST-{manifest['version']:08d}.json")
        _, draft = self._fs(f"_draft-{uuid.uuid4().hex}")
        fs.mkdirs(p.getParent())
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(p) or not fs.rename(draft, p):
            fs.delete(draft, False)
            raise RuntimeError("another load was committed meanwhile: open the store again")
        self.manifest = manifest

    def vacuum(self) -> int:
        """Delete what no load committed and what was merged into newer pieces; not while another load runs or reads."""
        kept = {x["path"] for x in [*self.manifest["ledger"], *self.manifest["counts"]]}
        dropped = 0
        for part in ("ledger", "counts"):
            fs, p = self._fs(part)
            for x in fs.listStatus(p) if fs.exists(p) else []:
                if f"{part}/{x.getPath().getName()}" not in kept:
                    dropped += bool(fs.delete(x.getPath(), True))
        return dropped

    # -- reading ----------------------------------------------------------------------------------
    def _types(self) -> tuple[T.StructType, T.StructType]:
        record, item, term = (T._parse_datatype_string(t) for t in self.manifest["types"])
        ledger = T.StructType().add("record", record).add("item", item).add("term", term).add("version", "integer")
        counts = T.StructType().add("term", term).add("occ", "long").add("rec", "long")
        return ledger, counts

    def ledger(self, records: DataFrame | None = None) -> DataFrame:
        """record, item, term, version of all rows, or of the buckets that the given records are in."""
        schema, pieces = self._types()[0], self.manifest["ledger"]
        most = max((x["buckets"] for x in pieces), default=1)
        wanted = None
        if records is not None and most > 1:
            bucket = F.pmod(F.xxhash64("record"), F.lit(most)).cast("int").alias("b")
            wanted = [r[0] for r in records.select(bucket).distinct().collect()]  # MOST_BUCKETS rows at most
        out = self.spark.createDataFrame([], schema)
        for x in pieces:
            rows = self.spark.read.schema(schema if x["buckets"] == 1 else T.StructType(schema.fields).add("_bucket", "integer")).parquet(f"{self.path}/{x['path']}")
            if x["buckets"] > 1 and wanted is not None:  # powers of two: a bucket of more lies in one of fewer
                rows = rows.where(F.col("_bucket").isin(sorted({b % x["buckets"] for b in wanted})))
            out = out.unionByName(rows.select(*schema.names))
        return out

    def counts(self) -> DataFrame:
        """term, occ, rec of every term that occurs: the base merged with the later changes."""
        schema, pieces = self._types()[1], self.manifest["counts"]
        if not pieces:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{x['path']}" for x in pieces])
        if len(pieces) > 1:
            rows = rows.groupBy("term").agg(F.sum("occ").alias("occ"), F.sum("rec").alias("rec"))
        return rows.where(F.col("occ") > 0)

    # -- loading ----------------------------------------------------------------------------------
    def _write(self, part: str, rows: DataFrame) -> dict:
        """Write rows as a piece of this part; its path and number of rows, and for the ledger its buckets."""
        path = f"{part}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{path}")
        piece = {"path": path, "rows": self.spark.read.schema(rows.schema).parquet(f"{self.path}/{path}").count()}
        if part == "ledger":
            buckets = min(MOST_BUCKETS, 1 << max(0, -(-piece["rows"] // LEDGER_ROWS) - 1).bit_length())
            if buckets > 1:
                flat = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{path}")
                path = f"{part}/{uuid.uuid4().hex}"
                flat = flat.withColumn("_bucket", F.pmod(F.xxhash64("record"), F.lit(buckets)).cast("int"))
                # rows of null records, and of one hot record, are spread over several files of their bucket
                spread = F.pmod(F.xxhash64("item"), F.lit(8))
                flat.repartition("_bucket", spread).write.partitionBy("_bucket").parquet(f"{self.path}/{path}")
                piece["path"] = path
            piece["buckets"] = buckets
        return piece

    def apply(self, changes: DataFrame) -> DataFrame:
        """Merge changes (record, item, term); returns the deltas (term, d_occ, d_rec) of this load.

        A new item adds, a known one replaces, a null term deletes. A load that changes nothing leaves
        the counts as they are. A load that fails leaves the store as it was and can be made again.
        """
        require_columns(changes, ("record", "item", "term"))
        first = self.manifest["types"] is None
        types = [changes.schema[c].dataType.simpleString() for c in ("record", "item", "term")]
        if not first and types != self.manifest["types"]:
            raise ValueError(f"types of this store are {self.manifest['types']}")
        version = self.manifest["version"] + 1
        # an item's rows of one load are one row; fixed-width columns aggregate in hash maps
        new = (
            changes.where(F.col("item").isNotNull())
            .groupBy("item")
            .agg(F.max("record").alias("record"), F.max("term").alias("new"))
        )
        none = F.lit(None).cast(types[2])
        stamp = F.lit(version).alias("version")
        if first:
            # all images are new: those of the ledger just written, so that nothing is shuffled twice
            piece = self._write("ledger", new.where(F.col("new").isNotNull()).select("record", "item", F.col("new").alias("term"), stamp))
            manifest = self.manifest | {"types": types, "ledger": [piece]}
            before, self.manifest = self.manifest, manifest
            try:
                images = self.ledger().select("record", none.alias("old"), F.col("term").alias("new"))
            finally:
                self.manifest = before
        else:
            images = materialize(self._images(new), "images")
            piece = self._write("ledger", images.where("changed").select("record", "item", F.col("new").alias("term"), stamp))
            manifest = self.manifest | {"ledger": [*self.manifest["ledger"], *([piece] if piece["rows"] else [])]}
        deltas = signed_deltas(images).select("term", F.col("d_occ").alias("occ"), F.col("d_rec").alias("rec"))
        change = self._write("counts", deltas)
        written = self.spark.read.schema(deltas.schema).parquet(f"{self.path}/{change['path']}")
        self._commit(manifest | {"counts": [*manifest["counts"], *([change] if change["rows"] else [])]})
        base, *later = self.manifest["counts"] or [{"rows": 0}]
        if len(later) >= COMPACT_PIECES or sum(x["rows"] for x in later) > COMPACT_SHARE * base["rows"]:
            self.compact()
        return written.select("term", F.col("occ").alias("d_occ"), F.col("rec").alias("d_rec"))

    def compact(self) -> None:
        """Merge the changes into a new base, and the log into the last rows of its items."""
        counts = self._write("counts", self.counts())
        last = self._last(self.ledger()).where(F.col("l.term").isNotNull())
        ledger = self._write("ledger", last.select("l.record", "item", "l.term", F.lit(self.manifest["version"]).alias("version")))
        self._commit(self.manifest | {"counts": [counts] if counts["rows"] else [], "ledger": [ledger] if ledger["rows"] else []})

    @staticmethod
    def _last(log: DataFrame) -> DataFrame:
        return log.groupBy("item").agg(F.max_by(F.struct("record", "term"), F.struct("version", F.col("term").isNotNull())).alias("l"))

    def _images(self, new: DataFrame) -> DataFrame:
        """Old and new images of all items of every record that the changed items are or were in.

        Two columns of the ledger are read for the records that changed items were in, then the buckets of the touched
        records. Items without a record are touched one by one.
        """
        new = materialize(new, "changes")
        alone = F.when(F.col("record").isNull(), F.col("item"))
        was_in = self.ledger().join(new.select("item"), "item", "left_semi").select("record", "item")
        touched = materialize(was_in.unionByName(new.select("record", "item")).select("record", alone.alias("alone")).distinct(), "touched")
        keyed = self.ledger(touched).withColumn("alone", alone).alias("l")
        touched = touched.alias("t")
        same = F.col("l.record").eqNullSafe(F.col("t.record")) & F.col("l.alone").eqNullSafe(F.col("t.alone"))
        whole = keyed.join(touched, same, "left_semi")
        old = self._last(whole).where(F.col("l.term").isNotNull()).select("item", F.col("l.record").alias("old_record"), F.col("l.term").alias("old"))
        both = old.join(new.withColumn("given", F.lit(True)), "item", "full_outer").withColumn("given", F.coalesce("given", F.lit(False)))
        none = F.lit(None).cast(self.manifest["types"][2])
        moved = ~F.col("record").eqNullSafe(F.col("old_record"))
        changed = moved | ~F.col("new").eqNullSafe(F.col("old"))
        # an item that moves leaves a deletion in the record it was in
        before = F.struct(
            F.col("old_record").alias("record"), "old", F.when(~F.col("given"), F.col("old")).alias("new"), (F.col("given") & moved).alias("changed")
        )
        after = F.when(F.col("given"), F.struct("record", none.alias("old"), "new", changed.alias("changed")))
        images = both.select("item", F.explode(F.array(F.when(F.col("old").isNotNull(), before), after)).alias("i"))
        return images.where(F.col("i").isNotNull()).select("i.record", "item", "i.old", "i.new", "i.changed")


def mark_terms(counts: DataFrame, min_count: int | None, max_count: int | None) -> DataFrame:
    """term, occ, rec, mark: ``rare`` below min_count records, ``common`` above max_count occurrences.

    A term can have both marks, hence two rows; a null bound marks nothing.
    """
    none = F.lit(None).cast("string")
    rare = F.when(F.col("rec") < min_count, "rare") if min_count is not None else none
    common = F.when(F.col("occ") > max_count, "common") if max_count is not None else none
    return counts.select("term", "occ", "rec", F.explode(F.array(rare, common)).alias("mark")).where(F.col("mark").isNotNull())
