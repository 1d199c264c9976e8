"""Token counts kept as delta-maintained rollups.

A change to the corpus is a batch of documents as they were and as they are: an insert has only the latter, a
delete only the former, a revision both. Documents are counted, signed, and summed by source, language and tokenizer version
on the map side, so a batch becomes a few rows however many documents it holds; totals are the sum over
committed batches.

A batch is written to a staging folder and renamed to its own name; the rename fails if that name exists, so of any number of
attempts one is the batch, and one that dies leaves nothing that is read. A batch's folder is never removed and so tells for good that
it was committed, without a list of names. An empty file in ``live`` then shows it to readers; a retry makes up for a
file that was not written. ``compact`` folds the live batches into a snapshot that names these alone; readers skip what the latest
snapshot names. The next compaction first empties those batches' folders, so a retry that shows one of them again adds nothing.

Defined results: null text has no tokens but is a document; null sources and languages are groups of their own; repeated
rows count as often as they stand; rows deleted that never were inserted make totals negative, as deltas may come
in any order; groups that return to no documents and no tokens drop out; an empty batch commits; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import Scratch, scratch_dir
from siftline.sources.reading import table

TOKENIZERS = "/opt/tokenizers"
VERSION, OTHER = "byte_bpe_50k", "byte_bpe_multi_50k"
SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"
#: Characters of one text that are encoded at once; longer texts are cut after white space where there is some.
PART = 1 << 18
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


_ENCODINGS: dict = {}


def vocabulary(folder: str, version: str) -> bytes:
    with open(f"{folder}/{version}.tiktoken", "rb") as f:
        return f.read()


def encoding(version: str, data: bytes):
    """The byte-level vocabulary ``version`` from its file's bytes; made once a process."""
    import tiktoken

    if version not in _ENCODINGS:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}
        _ENCODINGS[version] = tiktoken.Encoding(version, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[version]


def parts(text: str) -> Iterator[str]:
    """A long text cut before a space, so that the pieces' tokens are the text's."""
    while len(text) > PART:
        cut = next((m.start() for m in re.finditer(r"(?<=\S) (?=\S)", text[PART:])), None)
        if cut is None:
            break
        yield text[: PART + cut]
        text = text[PART + cut :]
    yield text


def counted(docs: DataFrame, folder: str = TOKENIZERS, version: str = VERSION, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in ``keep`` and (source, lang, tokens) of each document. The vocabulary, under 2 MB, is read by the driver and broadcast."""
    data = docs.sparkSession.sparkContext.broadcast(vocabulary(folder, version))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(version, data.value).encode_ordinary
        for b in batches:
            n = [sum(len(encode(p)) for p in parts(x.as_py() or "")) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*b.schema.names[:-1], "tokens"])

    rows = docs.select(*keep, *(F.col(c).cast("string") for c in ("source", "lang", "text")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, tokens long")


def change(after: DataFrame | None, before: DataFrame | None = None, version: str = VERSION) -> DataFrame:
    """Signed rows of a change, from documents' counts (source, lang, tokens): those as they are count up, those as they were down."""
    sides = [x.select("source", "lang", "tokens", F.lit(s).alias("sign")) for x, s in ((after, 1), (before, -1)) if x is not None]
    rows = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    out = rows.groupBy("source", "lang").agg(F.sum("sign").cast("long").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens"))
    return out.select("source", "lang", F.lit(version).alias("tokenizer"), "documents", "tokens").where("documents <> 0 or tokens <> 0")


def delta(after: DataFrame | None, before: DataFrame | None = None, folder: str = TOKENIZERS, version: str = VERSION) -> DataFrame:
    """Signed rows of a change of documents."""
    return change(*(None if x is None else counted(x, folder, version) for x in (after, before)), version)


class Rollup:
    """Totals in a folder: ``batches``, the ``live`` ones, and ``snapshots`` of many."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        fs = spark._jvm.org.apache.hadoop.fs
        self._path = lambda *parts: fs.Path("/".join((self.folder, *parts)))
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path().getFileSystem(conf)
        for part in ("batches", "live", "snapshots", "stage"):
            self._fs.mkdirs(self._path(part))
        self._context = fs.FileContext.getFileContext(self._path().toUri(), conf)
        self._whole = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)

    def _names(self, part: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(part)))

    def _put(self, rows: DataFrame, part: str, name: str) -> bool:
        """Writes rows as ``part``/``name`` unless that exists, at whatever time it came to be."""
        if self._fs.exists(self._path(part, name)):
            return False
        stage = f"{name}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/stage/{stage}")
        try:
            self._context.rename(self._path("stage", stage), self._path(part, name), self._whole)
        except Py4JJavaError as e:
            self._fs.delete(self._path("stage", stage), True)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Adds a batch once; False if it was there."""
        name = hashlib.sha256(batch.encode()).hexdigest()[:32]
        fresh = self._put(rows, "batches", name)
        self._fs.create(self._path("live", name), True).close()
        return fresh

    def _latest(self) -> tuple[DataFrame | None, set[str], list[str]]:
        """The latest snapshot's rows, the batches that it names, and all snapshots."""
        names = self._names("snapshots")
        if not names:
            return None, set(), names
        rows = self.spark.read.schema(SCHEMA + ", folded string").parquet(f"{self.folder}/snapshots/{names[-1]}")
        # as many as were live at one compaction
        return rows.where("folded is null").drop("folded"), {r[0] for r in rows.where("folded is not null").select("folded").collect()}, names

    def _state(self) -> tuple[DataFrame, list[str]]:
        """All rows that count, and the live batches that no snapshot has."""
        old, folded, _ = self._latest()
        live = [x for x in self._names("live") if x not in folded]
        out = self.spark.createDataFrame([], SCHEMA)
        if live:
            out = self.spark.read.schema(SCHEMA).parquet(*(f"{self.folder}/batches/{x}" for x in live))
        return (out if old is None else out.unionByName(old)), live

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens), a row a group that holds something."""
        return self._summed(self._state()[0])

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("source", "lang", "tokenizer").agg(F.sum("documents").cast("long").alias("documents"), F.sum("tokens").cast("long").alias("tokens")).where("documents <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Folds live batches into a new snapshot; first drops what the latest one replaced. Of two at once, one wins."""
        _, folded, snapshots = self._latest()
        for x in sorted(folded):
            for f in self._fs.listStatus(self._path("batches", x)):
                self._fs.delete(f.getPath(), True)
            self._fs.delete(self._path("live", x), False)
        for x in snapshots[:-1]:
            self._fs.delete(self._path("snapshots", x), True)
        rows, live = self._state()
        if not live:
            return
        marks = self.spark.createDataFrame([(None, None, None, 0, 0, x) for x in live], SCHEMA + ", folded string")
        n = int(snapshots[-1].split("-")[1]) + 1 if snapshots else 1
        self._put(self._summed(rows).withColumn("folded", F.lit(None).cast("string")).unionByName(marks), "snapshots", f"snapshot-{n:09d}")


def op7_token_rollup(spark, sf_dir: str) -> DataFrame:
    """A corpus's life: all documents inserted under two tokenizer versions, a batch sent twice; under the first version the texts whose white space
    is not single spaces revised to have it so, and the documents labelled as bad deleted as they then are; a compaction between, and the totals read back.

    Counts of documents under the first version are kept by id, so that changes later take them from there and no text is counted again or shuffled.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.col("text").cast("string").alias("text"))
    bad = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 0").select("doc_id")
    rough = F.coalesce(F.col("text").rlike(r"[\x09-\x0D]|\x20\x20"), F.lit(False))
    scratch, rollup = Scratch(spark, "counts"), Rollup(spark, f"{scratch_dir(spark)}/rollup-{uuid.uuid4().hex}")
    first = scratch.table(counted(docs.withColumn("rough", rough), keep=("doc_id", "rough")))
    rollup.commit("documents", change(first))
    rollup.commit("documents, other tokenizer", delta(docs, version=OTHER))
    rollup.compact()
    rollup.commit("documents", change(first))
    revised = docs.where(rough).withColumn("text", F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    revised = scratch.table(counted(revised, keep=("doc_id",)))
    rollup.commit("revised", change(revised, first.where("rough")))
    now = first.where("not rough").drop("rough").unionByName(revised)
    rollup.commit("deleted", change(None, now.join(bad, "doc_id", "left_semi")))
    rollup.compact()
    return rollup.totals()
