"""Token ids as length-delimited binary records with an offset index beside them.

A file is a run of frames, one a document::

    length      8 bytes  bytes of the payload, little-endian
    check       4 bytes  masked CRC-32 of the length
    payload              key (8 bytes, signed), flags (1 byte: 1 = null key), width (1 byte: 2 or 4), ids, little-endian
    check       4 bytes  masked CRC-32 of the payload

A mask rotates a CRC right by 15 bits and adds ``0xA282EAD8``, so that a CRC of
bytes that hold CRCs stays useful.  The index is a Parquet table of its own, with file, offset and
length of each frame, for shuffled reads of single records.

Documents are range-partitioned by key and each task encodes and writes its
range, so files are in ascending key order.  A task writes under a name of its
own and renames when done; the index, which Spark commits, names the files that
count, so a lost or repeated task leaves nothing that is read.

Ids are those of the tokenizers library without added special tokens: a text that
holds the string of a special token goes to the library whole (it gives that
token's id), any other text pre-token by pre-token, each distinct one once.

A null text has only the end id.  Null keys come first; repeated rows are
records of their own; texts of any length are one record; only key and text are
read, so further columns do not matter; an empty table gives no file and an
empty index.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesostate.llm.common import checkpoint, read, scratch
from mesostate.llm.pretokens import DIGIT, LETTER, OTHER, WordEncoder, per_text, split
from mesostate.llm.textops import buffers, runs

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
#: A file is closed and the next one begun at about so many bytes.
FILE_BYTES = 16 << 20
#: Bytes of text that a worker encodes at once.
RUN_BYTES = 1 << 20
#: File names that a broadcast may have.
MOST_FILES = 100_000

INDEX = "file string, part int, seq int, doc_id long, offset long, length long, n_tokens long, before long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(key: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = struct.pack("<qBB", key or 0, key is None, width) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """Key, ids and the end of the frame at an offset; a wrong check raises."""
    length = bytes(data[at : at + 8])
    (size,) = struct.unpack("<Q", length)
    payload = data[at + 12 : at + 12 + size]
    if masked(length) != struct.unpack("<I", data[at + 8 : at + 12])[0] or masked(payload) != struct.unpack("<I", data[at + 12 + size : at + 16 + size])[0]:
        raise ValueError(f"damaged record at byte {at}")
    key, unknown, width = struct.unpack("<qBB", payload[:10])
    return None if unknown else key, np.frombuffer(payload[10:], f"<u{width}"), at + 16 + size


class Encoder:
    """Ids of texts by one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.cut = ByteLevel(add_prefix_space=False)
        self.letters = self.byte_letters()
        self.words = WordEncoder(self.encode)

    def byte_letters(self) -> dict[int, str]:
        """The letter that stands for each byte in the vocabulary, as the library spells characters that hold it."""
        out: dict[int, str] = {}
        for c in (*range(0x800), 0xFFF, *range(0x1000, 0xD000, 0x1000), 0xD000, 0xE000, 0xF000, 0xFFFF, *range(0x10000, 0x110000, 0x10000)):
            spelled = "".join(piece for piece, _ in self.cut.pre_tokenize_str(chr(c)))
            out |= dict(zip(chr(c).encode(), spelled, strict=True))
        return out

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens by the library's model, each on its own."""
        return [[t.id for t in self.library.model.tokenize(w.decode("latin-1").translate(self.letters))] for w in words]

    def probe(self, char: str) -> int:
        for one, kind in (("a", LETTER), ("0", DIGIT)):
            if len(self.cut.pre_tokenize_str(one + char)) == 1:
                return kind
        return OTHER

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        data, offsets = buffers(column)
        starts, ends, first = split(data, offsets, self.probe)
        ids, counts = self.words(data, starts, ends)
        at = per_text(counts, first).tolist()
        out, whole = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], data.tobytes()
        for token in self.special:
            here = whole.find(token)
            while here >= 0:
                k = int(np.searchsorted(offsets, here, "right")) - 1
                if here + len(token) <= offsets[k + 1]:
                    out[k] = np.array(self.library.encode(whole[offsets[k] : offsets[k + 1]].decode(), add_special_tokens=False).ids, np.uint32)
                    here = int(offsets[k + 1]) - 1
                here = whole.find(token, here + 1)
        return out


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


def write(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Writes the records of ``df`` under ``folder`` in key order and returns the index, read back."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/data").getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/data"))
    ranged = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).repartitionByRange(parts, "key").sortWithinPartitions("key", "text")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_of(path)
        part = TaskContext.get().partitionId()
        store_at, root = fs.FileSystem.from_uri(f"{folder}/data")
        out, name, offset, seq, before = None, "", 0, 0, 0
        for batch in batches:
            for run in runs(batch, "text", RUN_BYTES):
                rows = []
                for doc, ids in zip(run.column("key").to_pylist(), encoder(run.column("text")), strict=True):
                    if out is None:
                        name = f"{part:06d}-{seq:09d}-{uuid.uuid4().hex}.records"
                        out, offset = store_at.open_output_stream(f"{root}/.{name}"), 0
                    own = np.append(ids, np.uint32(end_id))
                    raw = frame(doc, own, encoder.width)
                    out.write(raw)
                    rows.append((name, part, seq, doc, offset, len(raw), len(own), before))
                    offset, seq, before = offset + len(raw), seq + 1, before + len(own)
                    if offset >= FILE_BYTES:
                        out.close()
                        store_at.move(f"{root}/.{name}", f"{root}/{name}")
                        out = None
                yield pa.RecordBatch.from_pydict(dict(zip(("file", "part", "seq", "doc_id", "offset", "length", "n_tokens", "before"), map(list, zip(*rows, strict=True)), strict=True)), schema=_index_schema())
        if out is not None:
            out.close()
            store_at.move(f"{root}/.{name}", f"{root}/{name}")

    ranged.mapInArrow(store, INDEX).write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def _index_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in INDEX.split(", "))])


def scan(spark: SparkSession, folder: str, index: DataFrame, schema: str, digest) -> DataFrame:
    """``digest(key, ids)`` of every record of the files that the index names, with the file and its place there.

    Each task reads whole files of bounded size and checks every frame.  The list of files that count is broadcast
    while it has at most ``MOST_FILES`` names (8 MB); beyond that, files are joined to it by a shuffle.
    """
    files = checkpoint(index.select("file").distinct())
    few = files.count() <= MOST_FILES
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.records").load(f"{folder}/data")
    mine = raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(F.broadcast(files) if few else files, "file", "left_semi")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[c.split()[1]]) for n, c in zip(names, schema.split(", "), strict=True)])
        for batch in batches:
            for k in range(batch.num_rows):
                name, data, at, out = batch.column("file")[k].as_py(), memoryview(batch.column("content")[k].as_buffer()), 0, []
                while at < len(data):
                    begin = at
                    key, ids, at = unframe(data, at)
                    out.append((name, begin, *digest(key, ids)))
                for a in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out[a : a + 10_000], strict=True)), strict=True)), schema=kinds)

    return mine.mapInArrow(rows, schema)


def op6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids, reads the files back and returns what stands in them."""
    folder = scratch(spark, "records")
    index = write(read(spark, sf_dir, "documents"), folder)
    found = scan(
        spark, folder, index, "file string, offset long, doc_id long, n_tokens long, ids_crc32 long",
        lambda key, ids: (key, len(ids), zlib.crc32(ids.astype("<u4").tobytes())),
    )
    totals, base = [], 0
    for row in sorted(index.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        totals.append((row["part"], base))
        base += row["n"]
    bases = spark.createDataFrame(totals or [(0, 0)], "part int, base long")  # one row a partition
    placed = index.join(F.broadcast(bases), "part").select("file", "offset", (F.col("base") + F.col("before")).alias("start"))
    return found.join(placed, ["file", "offset"]).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op6_records": op6_records}
SQL: dict[str, str] = {}
