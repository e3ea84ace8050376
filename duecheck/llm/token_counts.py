"""Token counts by a separator scan over flat token files without an index.

``write_token_files`` encodes documents with a public byte-level BPE and appends
them, each closed by the end-of-document identifier, to flat files of 16-bit
integers, one file per task; only the order of documents per file is noted
beside them, no place and no length. ``count_tokens`` knows such files by path
and size alone: blocks of BLOCK_BYTES are read by many tasks, each finds all
separators of its block in one vectorised comparison, and a prefix scan over the
blocks of a file stitches what spans a boundary: it numbers the documents and
carries the tokens since the last separator, across any number of blocks.

Files go to the shared folder of the session. A retried task writes a file of a
new name; only files of successful attempts are noted, others are never read.

Defined results: a null or empty text has 0 tokens. Special tokens written out
in a text are ordinary text. Rows repeated or without an id are counted each.
Tokens after the last separator of a foreign file are a document of their own.
An empty table or file gives no rows; a file that ends within a token is an error.
"""

import base64
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duecheck.llm.common import small_batches
from duecheck.sources.tables import scratch_dir, stage

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEPARATOR = 50256
BLOCK_BYTES = 4 << 20
KIND = "<u2"
#: The splitting expression the vocabulary was made with (fixed, public).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CACHE_WORDS = 200_000


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in lines}


class FlatEncoder:
    """Texts to token bytes; the tokens of words met before are looked up.

    The splitting expression always ends a token before a single space between
    two other characters, so words can be encoded apart. Other texts go whole.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.encoding = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes | None] = {}

    def plain(self, text: str) -> bytes:
        return np.asarray(self.encoding.encode_ordinary(text), KIND).tobytes()

    def _word(self, word: str) -> bytes:
        """The tokens of " word"; empty if white space touches the cut."""
        apart = word and not word[0].isspace() and not word[-1].isspace()
        return self.plain(" " + word) if apart else b""

    def encode(self, text: str) -> bytes:
        words = text.split(" ")
        known = self.known
        if len(known) > _CACHE_WORDS:
            known.clear()
        found = [known.get(w) for w in words[1:]]
        if None in found:
            for i, f in enumerate(found):
                if f is None:
                    w = words[i + 1]
                    found[i] = known[w] = self._word(w)
        if b"" in found or (len(words) > 1 and (not words[0] or words[0][-1].isspace())):
            return self.plain(text)
        return self.plain(words[0]) + b"".join(found)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def write_token_files(docs: DataFrame, folder: str, ranks: str = RANKS) -> DataFrame:
    """Write flat files below ``folder``; note file, ordinal and doc_id of each document, and file and bytes of each file."""
    small_batches(docs.sparkSession)
    table = read_ranks(ranks)
    end = np.asarray([SEPARATOR], KIND).tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, place, stream, done, size = FlatEncoder(table), "", None, 0, 0
        for batch in batches:
            if stream is None and batch.num_rows:
                place = f"{folder}/{uuid.uuid4().hex}.tokens"
                system, path = _open(place)
                system.create_dir(path.rpartition("/")[0], recursive=True)
                stream = system.open_output_stream(path)
            for text in batch.column("text").to_pylist():
                size += stream.write(encoder.encode(text or "") + end)
            n = batch.num_rows
            order = pa.array(np.arange(done, done + n))
            done += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([place] * n, pa.string()), order, batch.column("doc_id"), pa.nulls(n, pa.int64())],
                ["file", "ordinal", "doc_id", "bytes"],
            )
        if stream is not None:
            stream.close()
            ids = pa.nulls(1, batch.column("doc_id").type)
            yield pa.RecordBatch.from_arrays(
                [pa.array([place]), pa.nulls(1, pa.int64()), ids, pa.array([size])],
                ["file", "ordinal", "doc_id", "bytes"],
            )

    noted = docs.select("doc_id", "text").mapInArrow(write, f"file string, ordinal long, doc_id {kind}, bytes long")
    return stage(noted, "token-files")


def _scan(parts: Iterator[pd.DataFrame], separator: int) -> Iterator[pd.DataFrame]:
    """Per block: token counts up to each separator in it, and the tokens after the last."""
    for part in parts:
        for r in part.itertuples():
            system, path = _open(r.file)
            with system.open_input_file(path) as file:
                tokens = np.frombuffer(file.read_at(r.size, r.offset), KIND)
            at = np.flatnonzero(tokens == separator)
            counts = np.diff(at, prepend=-1) - 1
            tail = len(tokens) - (at[-1] + 1 if len(at) else 0)
            yield pd.DataFrame(
                {"file": [r.file], "block": [r.block], "seps": [len(at)], "tail": [tail], "counts": [counts]}
            )


def count_tokens(files: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """file, ordinal, n_tokens of every document in the flat files (file, bytes)."""
    spark = files.sparkSession
    width = np.dtype(KIND).itemsize
    checked = F.when(F.col("bytes") % width == 0, F.col("bytes")).otherwise(
        F.raise_error(F.concat(F.lit("a token is cut off in "), F.col("file")))
    )
    blocks = (
        files.select("file", checked.alias("bytes"))
        .where("bytes > 0")
        .select("file", "bytes", F.posexplode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(BLOCK_BYTES))).alias("block", "offset"))
        .withColumn("size", F.least(F.lit(BLOCK_BYTES), F.col("bytes") - F.col("offset")))
    )
    spread = blocks.repartition(max(12, spark.sparkContext.defaultParallelism), "file", "block")
    found = spread.mapInPandas(
        lambda parts: _scan(parts, separator), "file string, block int, seps long, tail long, counts array<long>"
    )
    found = stage(found, "separators")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("seps").over(before), F.lit(0))
    tails = F.coalesce(F.sum("tail").over(before), F.lit(0))
    stitched = (
        found.withColumn("first", first)
        .withColumn("tails", tails)
        .withColumn("closed", F.last(F.when(F.col("seps") > 0, F.col("tails")), ignorenulls=True).over(before))
        .withColumn("carry", F.col("tails") - F.coalesce("closed", F.lit(0)))
        .withColumn("last", F.lead("block").over(order).isNull())
    )
    counts = stitched.select("file", "first", "carry", F.posexplode("counts").alias("n", "count")).select(
        "file",
        (F.col("first") + F.col("n")).alias("ordinal"),
        (F.col("count") + F.when(F.col("n") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"),
    )
    open_end = F.col("tail") + F.when(F.col("seps") == 0, F.col("carry")).otherwise(0)
    rest = stitched.where("last").select("file", (F.col("first") + F.col("seps")).alias("ordinal"), open_end.alias("n_tokens"))
    return counts.unionByName(rest.where("n_tokens > 0"))


def document_tokens(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id and n_tokens of every document, by way of flat token files."""
    spark: SparkSession = docs.sparkSession
    folder = f"{scratch_dir(spark)}/tokens-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
    noted = write_token_files(docs, folder, ranks)
    counts = count_tokens(noted.where("bytes is not null").select("file", "bytes"))
    named = noted.where("bytes is null").select("file", "ordinal", "doc_id")
    return named.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
