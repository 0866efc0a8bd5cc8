"""Token counts as delta-maintained rollups.

A rollup keeps totals of documents and tokens by source, language and tokenizer version. A batch of changes (inserts,
revised texts, deletes) is turned into signed rows: an insert adds a document's count, a delete takes the recorded one
back, a revised count does both. The rows' sums by source, language and version are the batch's delta, and totals are
sums of deltas. No text is ever counted again and no total is ever overwritten.

A batch is computed from the state of one version and written under a folder of its own; it is committed by one small
file whose name is the next version's number, made by a rename that fails if the name is taken. Of two writers that
start from the same version one is thus told, and computes its batch anew from the other's state. A batch that comes
twice, or a writer that dies and tries again, counts once. The rename must be atomic, as it is in HDFS and in local file
systems; stores that copy to rename need a committer of their own.

Every SNAPSHOT-th version also writes the state, the totals and the batches' names as they are then, so that a commit
reads one snapshot and fewer than SNAPSHOT ledgers, whatever the number of batches.

Within a batch, of several changes to one document and version the greatest (order, op, tokens) holds; a document that is already there
is revised by an insert; deleting what is not there does nothing. Null texts have no tokens; null source and language
are groups of their own. Rows without an id or with an unknown op are refused by name, or, if the caller says so, set
aside and counted by reason (rejected()), while the others are committed. Further columns are ignored.

A load, which has no op and comes with the row keys of count_tokens, counts every row: rows without an id and rows that
repeat one are documents of their own. A later change to a repeated id replaces all its rows.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Callable
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm.common import raw, runs, shared_dir

#: Split pattern of the byte-level vocabularies (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the pattern's \s has it (fixed value); runs so long go to the merges directly.
BLANKS = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 10_000
#: Versions from one snapshot to the next.
SNAPSHOT = 16
STATE = ["doc_id", "source", "lang", "tokenizer", "tokens"]
ROW = "row"


_LONG = re.compile(f"[{BLANKS}]{{{LONG_RUN},}}")


def count_words(texts: list[bytes]) -> list[int]:
    """Version words-v1: runs of bytes other than ASCII blanks."""
    return [len(t.split()) for t in texts]


class BytePairCounter:
    """Counts the tokens of a byte-level vocabulary whose ranks are given as lines "base64 rank"."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        self.ranks, self.pattern = ranks, pattern

    @cache  # noqa: B019  one encoding for each process
    def encoding(self):
        import tiktoken

        return tiktoken.Encoding("vexel", pat_str=self.pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}, special_tokens={})

    def __call__(self, texts: list[bytes]) -> list[int]:
        return [self.count(t.decode()) for t in texts]

    def count(self, text: str) -> int:
        """The pattern gives a run of blanks as one piece, but for its last blank where a word follows, and no piece
        goes from a word on into a run. Long runs, on which its look-ahead runs out of stack, are therefore cut out."""
        e, n, at = self.encoding(), 0, 0
        for run in _LONG.finditer(text) if len(text) >= LONG_RUN else ():
            stop = run.end() if run.end() == len(text) else run.end() - 1
            n += len(e.encode_ordinary(text[at : run.start()])) + len(e._encode_single_piece(text[run.start() : stop]))
            at = stop
        return n + len(e.encode_ordinary(text[at:]))

    def __reduce__(self):
        return BytePairCounter, (self.ranks, self.pattern)


def byte_pair(path: str) -> BytePairCounter:
    """The file is read by the driver; executors get its contents."""
    return BytePairCounter(Path(path).read_bytes())


def count_tokens(docs: DataFrame, tokenizers: dict[str, Callable], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens, row: one row per document and version, from one reading of the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizers)

    def work(batches):
        counters = shared.value
        for big in batches:
            for b in runs(big, 3):
                texts = raw(b.column(3))
                for name, count in counters.items():
                    yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([name] * len(texts)), pa.array(count(texts), pa.int64()), b.column(4)], names=[*STATE, ROW])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias(ROW))
    return docs.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, lang string, tokenizer string, tokens bigint, {ROW} bigint")


class TokenRollup:
    """Totals under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or f"{shared_dir(spark)}/token_rollup").rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._files = self._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        at = self._path("log")
        names = [x.getPath().getName() for x in self._files.listStatus(at)] if self._files.exists(at) else []
        return max((int(x.removesuffix(".json")) for x in names if x[0] not in "._"), default=0)

    def _entries(self, version: int) -> list[dict]:
        """What the last snapshot up to a version and the commits after it say."""
        out = []
        for n in range(max(1, version - version % SNAPSHOT), version + 1):
            f = self._files.open(self._path("log", f"{n:012d}.json"))
            out.append(json.loads(bytes(f.readAllBytes()).decode()))
            f.close()
        return out

    def _read(self, entries: list[dict], part: str, whole: str) -> DataFrame | None:
        """That part of all commits: the snapshot's `whole`, if it begins with one, and the `part` of each after it."""
        paths = [f"{self.root}/{e['data']}/{whole if i == 0 and e['snapshot'] else part}" for i, e in enumerate(entries)]
        return self.spark.read.parquet(*paths) if paths else None

    def committed(self) -> list[str]:
        entries = self._entries(self.version())
        old = self._read(entries[:1], "", "batches") if entries and entries[0]["snapshot"] else None
        return sorted({e["batch"] for e in entries} | ({r.batch for r in old.toLocalIterator()} if old is not None else set()))

    def _has(self, entries: list[dict], batch_id: str) -> bool:
        """Entries name their batches; those before the last snapshot are in its table."""
        if any(e["batch"] == batch_id for e in entries):
            return True
        return bool(entries) and entries[0]["snapshot"] and not self._read(entries[:1], "", "batches").filter(F.col("batch") == batch_id).isEmpty()

    def state(self) -> DataFrame | None:
        """The counted documents as they are now; sign: how many rows are alike."""
        return self._state(self._entries(self.version()))

    def _state(self, entries: list[dict], of: DataFrame | None = None) -> DataFrame | None:
        ledger = self._read(entries, "ledger", "state")
        if ledger is not None and of is not None:  # documents that a batch names, before anything is added up
            ledger = ledger.join(of, ["doc_id", "tokenizer"], "left_semi")
        return ledger if ledger is None else ledger.groupBy(*STATE).agg(F.sum("sign").alias("sign")).filter("sign > 0")

    def totals(self, version: int | None = None) -> DataFrame:
        """source, lang, tokenizer, docs, tokens, now or as of a version; groups whose documents are all gone are left out."""
        return self._totals(self._entries(self.version() if version is None else version)).filter("docs > 0")

    def _totals(self, entries: list[dict]) -> DataFrame:
        d = self._read(entries, "delta", "totals")
        if d is None:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, docs bigint, tokens bigint")
        return d.groupBy("source", "lang", "tokenizer").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def rejected(self) -> DataFrame:
        """batch, reason, rows: what the commits since the last snapshot, that of the snapshot included, have set aside."""
        paths = [f"{self.root}/{e['data']}/rejected" for e in self._entries(self.version()) if e["rejects"]]
        return self.spark.read.parquet(*paths) if paths else self.spark.createDataFrame([], "batch string, reason string, rows bigint")

    def commit(self, batch_id: str, changes: DataFrame, set_aside: bool = False) -> bool:
        """changes: doc_id, source, lang, tokenizer, tokens and, if they are not all inserts, op (insert, revise,
        delete) and order; a load has no op and may have row. False if a batch of this name is there already.
        set_aside: rows that cannot be committed are counted and left out, else they are an error."""
        if not batch_id or "/" in batch_id or batch_id.startswith((".", "_")):
            raise ValueError(f"batch name {batch_id!r}")
        if "op" in changes.columns or ROW not in changes.columns:
            changes = changes.withColumn(ROW, F.lit(None).cast("long"))
        for c, default in (("op", F.lit("insert")), ("order", F.lit(0))):
            if c not in changes.columns:
                changes = changes.withColumn(c, default)
        reason = F.when(F.col("doc_id").isNull() & F.col(ROW).isNull(), "no doc_id").when(~F.coalesce(F.col("op").isin("insert", "revise", "delete"), F.lit(False)), "unknown op")
        if not set_aside:
            changes = changes.withColumn("op", F.when(reason.isNotNull(), F.raise_error(F.lit("a change needs doc_id and an op of insert, revise, delete"))).otherwise(F.col("op")))
        while True:
            version = self.version()
            if self._has(entries := self._entries(version), batch_id):
                return False
            staged = self._stage(batch_id, changes, reason if set_aside else None, entries, version + 1)
            if self._publish(staged, batch_id, version + 1):
                return True

    def _stage(self, batch_id: str, changes: DataFrame, reason: Column | None, entries: list[dict], version: int) -> str:
        """Writes what the batch comes to after the given commits; returns its folder. Changes are computed once."""
        data = f"data/{uuid.uuid4().hex}"
        at, read = f"{self.root}/{data}", self.spark.read.parquet
        changes = changes.select(*STATE, "op", "order", ROW, (F.lit(None).cast("string") if reason is None else reason).alias("reason"))
        fields = ["order", "op", "tokens", "source", "lang"]
        last = changes.groupBy("doc_id", ROW, "tokenizer", "reason").agg(F.max(F.struct(*fields)).alias("c"), F.count("*").alias("rows"))
        last.select("doc_id", ROW, "tokenizer", "reason", "rows", *(f"c.{f}" for f in fields)).write.parquet(f"{at}/changes")
        if reason is not None:
            bad = read(f"{at}/changes").filter("reason is not null").groupBy("reason").agg(F.sum("rows").alias("rows"))
            bad.select(F.lit(batch_id).alias("batch"), "reason", "rows").write.parquet(f"{at}/rejected")
        last = read(f"{at}/changes").filter("reason is null")
        new = last.filter("op <> 'delete'").select(*STATE, F.lit(1).cast("long").alias("sign"))
        if entries:
            before = self._state(entries, last.filter("doc_id is not null").select("doc_id", "tokenizer"))
            new = before.select(*STATE, (-F.col("sign")).alias("sign")).unionByName(new)
        new.write.parquet(f"{at}/ledger")
        ledger = read(f"{at}/ledger")
        delta = ledger.groupBy("source", "lang", "tokenizer").agg(F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens"))
        delta.write.parquet(f"{at}/delta")
        if version % SNAPSHOT == 0:
            before = self._read(entries, "ledger", "state").unionByName(ledger)
            before.groupBy(*STATE).agg(F.sum("sign").alias("sign")).filter("sign > 0").write.parquet(f"{at}/state")
            sums = self._totals(entries).unionByName(read(f"{at}/delta")).groupBy("source", "lang", "tokenizer")
            sums.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs > 0").write.parquet(f"{at}/totals")
            names = self.spark.createDataFrame([(e["batch"],) for e in entries] + [(batch_id,)], "batch string")
            if entries[0]["snapshot"]:
                names = names.unionByName(self._read(entries[:1], "", "batches"))
            names.distinct().write.parquet(f"{at}/batches")
        self._files.delete(self._path(data, "changes"), True)
        return data

    def _publish(self, staged: str, batch_id: str, version: int | None = None) -> bool:
        """Commits a staged batch as that version (the next one). False, and the batch's folder is gone, if another
        writer has it already, or has committed the batch."""
        if self._has(self._entries(self.version()), batch_id):
            self._files.delete(self._path(staged), True)
            return False
        version = version or self.version() + 1
        entry = self._path(f"_entry-{uuid.uuid4().hex}")
        f = self._files.create(entry, False)
        f.write(json.dumps({"batch": batch_id, "data": staged, "snapshot": version % SNAPSHOT == 0, "rejects": self._files.exists(self._path(staged, "rejected"))}).encode())
        f.close()
        self._files.mkdirs(self._path("log"))
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename").NONE
        try:
            files.rename(entry, self._path("log", f"{version:012d}.json"), options)
        except Exception:
            if self.version() < version:
                raise
            self._files.delete(entry, False)
            self._files.delete(self._path(staged), True)
            return False
        return True
