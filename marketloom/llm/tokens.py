"""Token counts: rollups by source, language and tokenizer version, kept up by signed deltas.

A batch of events (``insert``, ``revise``, ``delete``) becomes signed rows: the count that a document had is taken
away, its new one is added. Signed rows and their sums are written to folders of their own; last comes an entry in the
log, a file whose number is the next one. A number can be taken once: of two writers the second one finds it taken,
reads the log again and works its batch out anew. What no entry names is not seen, and a batch that an entry names is not
committed again, so a batch may be tried as often as need be. Totals never need a document counted again; every
``compact_every`` batches state and totals are summed up, so that neither reads all history.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
import tiktoken
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.shingles import split_words

EVENT = "doc_id long, op string, source string, lang string, tokenizer string, n_tokens long"
SIGNED = "doc_id long, source string, lang string, tokenizer string, sign int, n_tokens long"
STATE = "doc_id long, source string, lang string, tokenizer string, n long, n_tokens long"
ENTRY = "kind string, batch string, folder string, through long, n_events long, n_rejected long"
TOTAL = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


@lru_cache(maxsize=4)
def byte_bpe(ranks_file: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, tokenizers: Mapping[str, tuple[str, str] | None]) -> DataFrame:
    """``doc_id, source, lang, tokenizer, n_tokens``: one row for each row of ``docs`` and tokenizer version.

    A tokenizer is a (ranks file, pattern) of byte-level BPE, or None for words between ASCII white space. Null text
    has no tokens.
    """
    tokenizers = dict(tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                for name, spec in tokenizers.items():
                    if spec is None:
                        counts = [len(split_words(t)) for t in texts]
                    else:
                        counts = [len(byte_bpe(*spec).encode_ordinary(t)) for t in texts]
                    own = [part.column(c) for c in ("doc_id", "source", "lang")]
                    more = [pa.array([name] * len(texts)), pa.array(counts, pa.int64())]
                    yield pa.RecordBatch.from_arrays([*own, *more], ["doc_id", "source", "lang", "tokenizer", "n_tokens"])

    source = docs.select(*(F.col(c).cast(k).alias(c) for c, k in (("doc_id", "long"), ("source", "string"), ("lang", "string"), ("text", "string"))))
    return source.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


class Ledger:
    """Committed batches of signed counts below ``root``, a folder that driver and executors share.

    An entry of the log is a file that is renamed into it, which the file system has to do at once and only if no file of
    that name is there: HDFS does, object stores do not. The log is reached by the session's JVM, so a classic session is needed.
    """

    def __init__(self, spark: SparkSession, root: str, compact_every: int = 16):
        self.spark, self.root, self.compact_every = spark, root.rstrip("/"), compact_every

    def _log(self) -> list[dict]:
        """The entries in order: one line a batch or compaction."""
        path = self._path("log")
        if not path.getFileSystem(self._conf()).exists(path):
            return []
        found = self.spark.read.schema(ENTRY).json(f"{self.root}/log").select("*", F.col("_metadata.file_name").alias("at"))
        return [r.asDict() for r in sorted(found.collect(), key=lambda r: r["at"])]

    def _conf(self):
        return self.spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _claim(self, number: int, entry: dict) -> bool:
        """Add an entry to the log under this number, whole or not at all; False if another has it."""
        fs = self._path("log").getFileSystem(self._conf())
        draft, final = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(f"log/{number:012d}.json")
        fs.mkdirs(self._path("log"))
        out = fs.create(draft)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf()).rename(draft, final, options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        return True

    def _read(self, kind: str, folders: list[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{kind}/{f}" for f in folders))

    def _parts(self, log: list[dict]) -> tuple[list[str], list[str]]:
        """The folder of the last compaction, if any, and those of the batches after it."""
        at = max((k for k, e in enumerate(log) if e["kind"] == "compact"), default=-1)
        after = log[at]["through"] if at >= 0 else -1
        return [log[at]["folder"]] if at >= 0 else [], [e["folder"] for k, e in enumerate(log) if e["kind"] == "batch" and k > after]

    def committed(self) -> DataFrame:
        """``batch, n_events, n_rejected`` of every committed batch."""
        rows = [(e["batch"], e["n_events"], e["n_rejected"]) for e in self._log() if e["kind"] == "batch"]
        return self.spark.createDataFrame(rows, "batch string, n_events long, n_rejected long")

    def rejected(self) -> DataFrame:
        """Events of committed batches whose ``op`` is null or unknown."""
        return self._read("rejected", [e["folder"] for e in self._log() if e["kind"] == "batch" and e["n_rejected"]], EVENT)

    def _state(self, log: list[dict]) -> DataFrame:
        base, later = self._parts(log)
        rows = self._read("signed", later, SIGNED).filter(F.col("doc_id").isNotNull())
        more = rows.select("doc_id", "source", "lang", "tokenizer", F.col("sign").cast("long").alias("n"), (F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        every = self._read("state", base, STATE).unionByName(more)
        sums = every.groupBy("doc_id", "source", "lang", "tokenizer").agg(F.sum("n").alias("n"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n > 0")

    def state(self) -> DataFrame:
        """The counts in force: one row for each document and tokenizer version that is not deleted."""
        return self._state(self._log()).drop("n")

    def _totals(self, log: list[dict]) -> DataFrame:
        base, later = self._parts(log)
        every = self._read("totals", [*base, *later], TOTAL).groupBy("source", "lang", "tokenizer")
        return every.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens`` of what is in force."""
        return self._totals(self._log())

    def _signed(self, events: DataFrame, state: DataFrame) -> DataFrame:
        named = events.filter(F.col("doc_id").isNotNull())
        value = F.struct("op", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "source", "lang")
        last = named.groupBy("doc_id", "tokenizer").agg(F.max(value).alias("new"))
        old = state.select("doc_id", "tokenizer", F.struct("source", "lang", "n_tokens").alias("old"))
        both = last.join(old, (last.doc_id == old.doc_id) & last.tokenizer.eqNullSafe(old.tokenizer), "left").select(last.doc_id, last.tokenizer, "new", "old")
        row = lambda x, sign: F.struct(x["source"].alias("source"), x["lang"].alias("lang"), F.lit(sign).alias("sign"), x["n_tokens"].alias("n_tokens"))
        less = F.when(F.col("old").isNotNull(), row(F.col("old"), -1))
        more = F.when(F.col("new.op") != "delete", row(F.col("new"), 1))
        moved = both.select("doc_id", "tokenizer", F.explode(F.array_compact(F.array(less, more))).alias("x"))
        moved = moved.select("doc_id", "x.source", "x.lang", "tokenizer", "x.sign", "x.n_tokens")
        nameless = events.filter(F.col("doc_id").isNull() & (F.col("op") != "delete")).select(
            "doc_id", "source", "lang", "tokenizer", F.lit(1).alias("sign"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")
        )
        return moved.unionByName(nameless)

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Commit ``events`` as ``batch``, any name; False, and nothing changed, if it is committed already.

        Of several events for one document and tokenizer version, the largest by (op, count, source, language) counts:
        ``revise`` before ``insert`` before ``delete``. ``insert`` of a known document revises it; ``revise`` of an
        unknown one inserts it; ``delete`` of an unknown one does nothing. Events without ``doc_id`` insert a count
        that can't be revised; their deletes do nothing. Events with another ``op`` or none change nothing: they are
        counted in the entry and kept with ``rejected``.
        """
        log = self._log()
        if any(e["batch"] == batch for e in log):
            return False
        folder = uuid.uuid4().hex
        good = F.coalesce(F.col("op").isin("insert", "revise", "delete"), F.lit(False))
        columns = [f.split()[0] for f in EVENT.split(", ")]
        events.select(*columns, good.alias("good")).write.partitionBy("good").parquet(f"{self.root}/events/{folder}")
        every = self.spark.read.schema(f"{EVENT}, good boolean").parquet(f"{self.root}/events/{folder}")  # counted once
        known, odd = every.filter("good").drop("good"), every.filter("not good").drop("good")
        n_rejected = odd.count()
        if n_rejected:
            odd.write.parquet(f"{self.root}/rejected/{folder}")
        tries = 0
        while True:
            mine = f"{folder}-{tries}" if tries else folder
            self._signed(known, self._state(log)).write.parquet(f"{self.root}/signed/{mine}")
            rows = self._read("signed", [mine], SIGNED)
            sums = rows.groupBy("source", "lang", "tokenizer").agg(
                F.sum(F.col("sign").cast("long")).alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens")
            )
            sums.write.parquet(f"{self.root}/totals/{mine}")
            if n_rejected and tries:
                odd.write.parquet(f"{self.root}/rejected/{mine}")
            entry = {"kind": "batch", "batch": batch, "folder": mine, "n_events": rows.count(), "n_rejected": n_rejected}
            if self._claim(len(log), entry):
                break
            log, tries = self._log(), tries + 1
            if any(e["batch"] == batch for e in log):
                return False
        if len(self._parts([*log, entry])[1]) >= self.compact_every:
            self.compact()
        return True

    def compact(self) -> bool:
        """Sum up state and totals of all batches so far; False if another entry came first, which does no harm."""
        log, folder = self._log(), uuid.uuid4().hex
        self._state(log).write.parquet(f"{self.root}/state/{folder}")
        self._totals(log).write.parquet(f"{self.root}/totals/{folder}")
        return self._claim(len(log), {"kind": "compact", "folder": folder, "through": len(log) - 1})
