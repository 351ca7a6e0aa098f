"""Token ids as Arrow IPC files of fixed-size rows: zero-copy random access to equal-length sequences.

A file holds the ids of a range of doc_ids, one text after the other, in rows of `length` ids and as
many mask bits; only the last row is padded, with mask 0. A second small file has each document's place.
Read with a memory map, row i of a file is a slice of its pages.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import graph
from .bpe import SPACE, byte_symbols

SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
MANIFEST = "part int, path string, n_docs long, n_tokens long"
LENGTH, ROWS = 2048, 256
#: Files whose numbers of ids are summed together.
GROUP = 10_000
#: Bytes of pre-tokens that are kept encoded.
CACHE = 44_000_000


#: Fixed value of the public tokenizer: how it splits texts. Alternatives that can't start alike stand in order of use.
PATTERN = rf" ?\p{{L}}+| ?\p{{N}}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
ASCII_PATTERN = rb" ?[A-Za-z]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


class ByteCoder:
    """The tokenizers library, asked once for each distinct pre-token.

    Texts are split by the tokenizer's pattern and the parts are given to the library's model; a text
    with special tokens goes through the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenize, self.split, self.split_ascii = self.tokenizer.model.tokenize, regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.symbol = dict(enumerate(byte_symbols()))
        self.kept = C.Kept(self._part, CACHE)

    def _part(self, part: bytes) -> bytes:
        return array(self.code, [t.id for t in self.tokenize(part.decode("latin-1").translate(self.symbol))]).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out, kept = [], self.kept.__getitem__
        for text in texts:
            if any(s in text for s in self.special):
                out.append(array(self.code, self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes())
            elif text.isascii():
                out.append(b"".join(map(kept, self.split_ascii(text))))
            else:
                out.append(b"".join(map(kept, map(str.encode, self.split(text.decode())))))
        return out


_coders: dict[str, ByteCoder] = {}


def coder(path: str) -> ByteCoder:
    if path not in _coders:
        _coders[path] = ByteCoder(path)
    return _coders[path]


class Writer:
    """Puts ids into rows of `length`; batches of ROWS rows are written as they fill."""

    def __init__(self, sink, dtype: np.dtype, length: int):
        self.dtype, self.length, self.left = dtype, length, b""
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = ipc.new_file(sink, self.schema)

    def add(self, ids: bytes) -> None:
        self.left += ids
        step = self.length * ROWS * self.dtype.itemsize
        whole = len(self.left) // step * step
        for lo in range(0, whole, step):
            self._put(np.frombuffer(self.left[lo : lo + step], self.dtype), self.length * ROWS)
        self.left = self.left[whole:]

    def _put(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        rows = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.file.write_batch(pa.record_batch(rows, schema=self.schema))

    def close(self) -> None:
        ids = np.frombuffer(self.left, self.dtype)
        if len(ids):
            rows = -(-len(ids) // self.length)
            self._put(np.concatenate((ids, np.zeros(rows * self.length - len(ids), self.dtype))), len(ids))
        self.file.close()


def _open(path: str):
    where, name = fs.FileSystem.from_uri(path)
    return pa.memory_map(name) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(name)


def _sink(path: str):
    where, name = fs.FileSystem.from_uri(path)
    where.create_dir(os.path.dirname(name), recursive=True)
    return where.open_output_stream(name)


def write(docs: DataFrame, tokenizer: str, folder: str, end: int = 2, length: int = LENGTH, block_bytes: int = 32_000_000) -> DataFrame:
    """Writes the files in ascending doc_id order and returns their manifest, one row a file.

    Attempts of a task write files of their own names, and the manifest, which is saved, names those
    of the attempt that ended: a lost executor leaves at worst a file that nothing names. A null text is empty, so
    it has the end id alone; null ids come first, rows of one id by text; repeated rows are each written; no rows
    write no file. Texts of any length are whole. Other columns are left behind, whatever their names.
    """
    docs = C.documents(docs)
    parts = C.block_count(docs, block_bytes)
    # a text's first characters sort as the text does, and part rows of one id, or of none
    ordered = docs.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 16).asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def put(tables):
        from pyspark import TaskContext

        c, part = coder(tokenizer), TaskContext.get().partitionId()
        path = f"{folder}/ids-{part:06d}-{uuid.uuid4().hex}"
        writer, done, ids, starts, sizes = None, 0, [], [], []
        tail = np.array([end], c.dtype).tobytes()
        for t in tables:
            texts = C.encoded(pa.chunked_array([t.column("text")]))
            ids += t.column("doc_id").to_pylist()
            for lo in range(0, len(texts), 1000):
                for x in c.encode(texts[lo : lo + 1000]):
                    if writer is None:
                        sink = _sink(f"{path}.arrow")
                        writer = Writer(sink, c.dtype, length)
                    writer.add(x + tail)
                    starts.append(done)
                    sizes.append(len(x) // c.dtype.itemsize + 1)
                    done += sizes[-1]
        if writer:
            writer.close()
            sink.close()
            places = pa.table({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(sizes, pa.int64())})
            with _sink(f"{path}.places.arrow") as out, ipc.new_file(out, places.schema) as f:
                f.write_table(places)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([done], pa.int64())})

    return graph.saved(ordered.mapInArrow(put, MANIFEST))


def read(manifest: DataFrame) -> DataFrame:
    """Each document's place in the whole order and a checksum of its ids, from the files alone; a row for each row written.

    How many ids lie before a file is a running sum over the manifest, worked out by Spark: parts are
    summed in groups of GROUP, so no task has more than GROUP files or groups.
    """
    groups = manifest.withColumn("group", F.floor(F.col("part") / GROUP))
    ahead = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    sums = groups.groupBy("group").agg(F.sum("n_tokens").alias("n")).select("group", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("above"))
    own = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("above") + F.coalesce(F.sum("n_tokens").over(own), F.lit(0))
    files = groups.join(sums, "group").select("path", before.alias("before")).repartition("path")

    def get(tables):
        for t in tables:
            for path, before in zip(t.column("path").to_pylist(), t.column("before").to_pylist(), strict=True):
                with _open(f"{path}.places.arrow") as f:
                    places = ipc.open_file(f).read_all()
                    starts, sizes = places["start"].to_numpy().copy(), places["n_tokens"].to_numpy().copy()
                    ids = pa.array(places["doc_id"].to_pylist(), pa.int64())
                yield pa.record_batch({"doc_id": ids, "start": starts + before, "n_tokens": sizes, "ids_crc32": checksums(f"{path}.arrow", starts + sizes)}) if len(ids) else pa.RecordBatch.from_pylist([])

    return files.mapInArrow(get, SCHEMA)


def checksums(path: str, ends: np.ndarray) -> np.ndarray:
    """crc32 of the ids up to each end, as little-endian unsigned 32-bit integers."""
    out, crc, i, done = np.zeros(len(ends), np.int64), 0, 0, 0
    stops = ends.tolist()
    with _open(path) as f:
        reader = ipc.open_file(f)
        for b in range(reader.num_record_batches):
            batch = reader.get_batch(b)
            ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)
            real = int(batch.column(1).flatten().true_count)
            raw, at = memoryview(ids[:real].astype("<u4").tobytes()), 0
            while i < len(stops) and stops[i] <= done + real:
                to = 4 * (stops[i] - done)
                out[i], crc, at, i = zlib.crc32(raw[at:to], crc), 0, to, i + 1
            crc = zlib.crc32(raw[at:], crc)
            done += real
    return out
