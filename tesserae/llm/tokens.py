"""Operator 8: token counts of flat, unindexed token files by separator scan.

A file is one run of token ids in which an end-of-document id closes every document;
nothing says where documents begin.  Files are read by byte ranges; blocks of equal size are searched for that id
vector-wise, each on its own; a block knows its inner documents at once and leaves a
summary.  A prefix scan over the summaries (in chunks of blocks, then over chunks)
gives each block the number of documents before it and the place of the last separator,
which stitches documents across any number of blocks.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_arrow, parts, scratch_dir, stored

BLOCK = 1 << 16  # tokens
CHUNK = 1024  # blocks whose summaries are scanned together
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
END = 50256  # the first id the vocabulary leaves free
#: Fixed value: the word pattern the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Fixed value: the characters of ``\\s`` in that pattern.
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LONG = 1 << 12  # blanks in a row that are cut out before the pattern, which enters them one level deeper a character
_RUN = re.compile(f"[{BLANK}]{{{LONG},}}+")

RANGE = 64  # blocks a task reads at a time


def vocabulary(path: str = TOKENIZER) -> bytes:
    """The ranks of a tiktoken file, read where the driver runs and sent along (under a megabyte)."""
    return Path(path).read_bytes()


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    found = re.fullmatch(r"(?:file:(?://)?)?(/[^/].*)", path)
    return (fs.LocalFileSystem(), found[1]) if found else fs.FileSystem.from_uri(path)


def encoded(encoding, body: str) -> list[int]:
    """The ids of a text.  The pattern takes a run of blanks whole at the end of a text and all but its last
    blank before a word; long runs are encoded as that one piece, so the ids are the same."""
    ids, done = [], 0
    for m in _RUN.finditer(body):
        end = m.end() if m.end() == len(body) else m.end() - 1
        ids += encoding.encode_ordinary(body[done : m.start()])
        ids += encoding._encode_single_piece(body[m.start() : end])
        done = end
    return ids + encoding.encode_ordinary(body[done:])


def encoded_files(docs: DataFrame, ranks: bytes, folder: str, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the texts of each partition as one flat file of 16-bit ids in ``folder``, which all executors share.

    Returns rows (``file``, ``seq``, ``length``, ``ids``), to be stored at once: the bytes of a
    stretch of the file and the writer's own list of the documents in it; a reader of the file
    does not have that list.  A task that runs again writes another file; only those of the
    stored rows count.  Null text is an empty document; repeated ids are documents of their
    own; a text of any length is encoded whole; an empty table gives no file.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        encoding = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        system, base = _opened(folder)
        system.create_dir(base)
        name, seq, out = f"{uuid.uuid4().hex}.ids", 0, None
        try:
            for batch in batches:
                for a in range(0, len(batch), 1024):
                    some = batch.slice(a, 1024)
                    out = out or system.open_output_stream(f"{base}/{name}")
                    size = 0
                    for body in some.column(1).to_pylist():
                        ids = np.array([*(encoded(encoding, body) if body else ()), end], dtype="<u2")
                        out.write(ids.tobytes())
                        size += ids.nbytes
                    held = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some.column(0))
                    yield pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([seq], pa.int64()), pa.array([size], pa.int64()), held], names=["file", "seq", "length", "ids"])
                    seq += 1
        finally:
            if out:
                out.close()

    schema = f"file string, seq bigint, length bigint, ids array<{docs.schema[key].dataType.simpleString()}>"
    return in_arrow(docs.select(F.col(key), F.col(text).cast("string")), encode, schema)


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``length`` in bytes of the files under a path or pattern; none is opened."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")


def token_counts(files: DataFrame, end: int = END, width: int = 2, block: int = BLOCK) -> DataFrame:
    """One row a document of flat files (``file``, ``length``) of ``width``-byte ids: ``file``, ``ordinal``,
    ``first_token``, ``n_tokens``, ``closed``.

    Files of any size are read by ranges of bytes, each by whatever task, through the file
    system their path names.  Two separators side by side enclose a document of no tokens;
    tokens after the last separator are a document that is not ``closed``; an empty file has
    none, and bytes at its end that make up no id are left out.  Separators are not counted.
    """
    summary = "file string, block bigint, size bigint, ends array<int>"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at, size in zip(*(batch.column(k).to_pylist() for k in range(3))):
                system, path = _opened(name)
                with system.open_input_file(path) as held:
                    body = held.read_at(size, at)
                ids = np.frombuffer(body, f"<u{width}", len(body) // width)
                cut = [ids[i : i + block] for i in range(0, len(ids), block)]
                ends = pa.array([np.flatnonzero(c == end).astype(np.int32) for c in cut], pa.list_(pa.int32()))
                first = at // (block * width)
                yield pa.record_batch([pa.array([name] * len(cut)), pa.array(np.arange(first, first + len(cut))), pa.array([len(c) for c in cut], pa.int64()), ends], names=["file", "block", "size", "ends"])

    step = RANGE * block * width
    ranges = files.where("length > 0").select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("at"))
    ranges = ranges.select("file", "at", F.least(F.lit(step), F.col("length") - F.col("at")).alias("size"))
    found = stored(in_arrow(ranges.repartition(parts(files.sparkSession)), search, summary), "separators")
    start = F.col("block") * block
    found = found.withColumn("start", start).withColumn("chunk", F.expr(f"block div {CHUNK}"))
    found = found.withColumn("n", F.size("ends").cast("long")).withColumn("last", F.when(F.col("n") > 0, start + F.element_at("ends", -1) + 1))
    found = found.withColumn("stop", start + F.col("size"))
    chunks = found.groupBy("file", "chunk").agg(F.sum("n").alias("cn"), F.max("last").alias("clast"), F.max("stop").alias("cstop"))
    over = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    chunks = chunks.select("file", "chunk", F.coalesce(F.sum("cn").over(over), F.lit(0)).alias("n0"), F.max("clast").over(over).alias("last0"), F.max("cstop").over(whole).alias("length"))
    inner = Window.partitionBy("file", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("n1", F.coalesce(F.sum("n").over(inner), F.lit(0))).withColumn("last1", F.max("last").over(inner))
    found = found.join(chunks, ["file", "chunk"]).withColumn("from", F.coalesce("last1", "last0", F.lit(0)))
    # a document runs from the place after one separator to the next; the file's last tokens may have none
    tail = F.when((F.col("stop") == F.col("length")) & (F.coalesce("last", "from") < F.col("stop")), F.array(F.col("stop"))).otherwise(F.expr("array()").cast("array<bigint>"))
    stops = F.concat(F.transform("ends", lambda e: e + F.col("start")), tail)
    docs = found.select("file", "n", "from", (F.col("n0") + F.col("n1")).alias("base"), stops.alias("stops")).where(F.size("stops") > 0)
    docs = docs.select("file", "n", "base", "from", "stops", F.posexplode("stops").alias("k", "stop"))
    first = F.when(F.col("k") == 0, F.col("from")).otherwise(F.get("stops", F.col("k") - 1) + 1)
    return docs.select("file", (F.col("base") + F.col("k")).alias("ordinal"), first.alias("first_token"), (F.col("stop") - first).alias("n_tokens"), (F.col("k") < F.col("n")).alias("closed"))


def written_ids(files: DataFrame) -> DataFrame:
    """``file``, ``ordinal``, ``id``: the writer's list of documents, numbered by the same two-level scan."""
    sized = files.select("file", "seq", F.expr(f"seq div {CHUNK}").alias("chunk"), "ids", F.size("ids").cast("long").alias("n"))
    chunks = sized.groupBy("file", "chunk").agg(F.sum("n").alias("cn"))
    over = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("file", "chunk", F.coalesce(F.sum("cn").over(over), F.lit(0)).alias("n0"))
    inner = Window.partitionBy("file", "chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("n1", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(chunks, ["file", "chunk"])
    sized = sized.select("file", (F.col("n0") + F.col("n1")).alias("base"), F.posexplode("ids").alias("k", "id"))
    return sized.select("file", (F.col("base") + F.col("k")).alias("ordinal"), "id")


def document_tokens(docs: DataFrame, ranks: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``n_tokens`` of every row: the texts are written as flat files, which are then counted without the writer's knowledge."""
    spark = docs.sparkSession
    written = stored(encoded_files(docs, ranks, f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}", key=key, text=text), "written")
    counts = token_counts(written.groupBy("file").agg(F.sum("length").alias("length")))
    return counts.join(written_ids(written), ["file", "ordinal"]).select(F.col("id").alias(key), "n_tokens")
