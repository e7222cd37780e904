"""Token-ID output: framed binary records with masked checksums and an offset index.

A record file is a sequence of frames, all numbers little-endian:

    u64 length | u32 masked crc of the length | payload | u32 masked crc of the payload

The payload is one document: i64 doc_id, u8 flag (1: the document has no id),
u8 width of an id in bytes (2 where the vocabulary allows it, else 4), the ids.
The checksum is CRC-32 as zlib has it, rotated right by 15 bits, plus a constant.
The index file of a record file holds the u64 offset of each frame and, last,
the length of the record file, so that any record can be read on its own.

Files are written below one folder by the tasks of a range partition on doc_id.
The manifest, written by Spark after all of them, names the files that count;
what a lost or repeated attempt has left is in no manifest.

Defined results
* null and empty texts give the end id alone
* documents without an id come first; rows that share an id are ordered by text hash
* an empty table gives an empty manifest and no records
* a document that holds the text of a special token is ordinary text
"""

from __future__ import annotations

import os
import re
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MASK = 0xA282EAD8
_HEAD = "<qBB"
_HEAD_BYTES = 10
MANIFEST = "part int, records string, index string, n_records bigint, n_tokens bigint"

#: Pieces of text whose ids one Python worker remembers, about 200 bytes each.
CACHE_PIECES = 700_000
#: Text behind one record file, about; small tables get smaller files, one per core.
FILE_TEXT_BYTES = 48 << 20
#: Documents that are encoded at a time.
_SLICE = 128


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


# Encoding --------------------------------------------------------------------

#: Byte-level pre-tokenisation never crosses a single space between two characters
#: that are not white space, so the pieces between such spaces are encoded once each.
_SPLIT = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str) -> list[str]:
    """The text in pieces that are encoded independently.

    All but the first follow a space, or begin with a line feed where a line ends at a word.
    """
    plain = text.replace("\n", "").isprintable()  # then it has no white space but space and line feed
    odd = ("  ", " \n", "\n ", "\n\n")
    if plain and not text.startswith((" ", "\n")) and not text.endswith((" ", "\n")) and not any(x in text for x in odd):
        return text.replace("\n", " \n").split(" ")
    return _SPLIT.split(text)


class Encoder:
    """Encodes whole texts with a byte-level tokenizer file and remembers pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.opens = np.zeros(size, dtype=bool)  # ids that begin with a space
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
        self.breaks = np.zeros(size, dtype=bool)  # the line feed alone
        self.breaks[self.tokenizer.token_to_id("Ċ")] = True
        self.marks = dict(zip(".,;:!?", self._ids([*".,;:!?"])))
        self.known: dict[str, bytes] = {}  # ids of a piece and of the space before it
        self.first: dict[str, bytes] = {}  # ids of a piece that begins a text

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in found]

    def _learn(self, unknown: set[str]) -> None:
        """Encode what is new; a word of letters and the mark after it are tokens apart."""
        marked = [x for x in unknown if x[-1:] in self.marks and x[:-1].isalpha()]
        self._encode_new(unknown.difference(marked).union(x[:-1] for x in marked).difference(self.known))
        self.known.update((x, self.known[x[:-1]] + self.marks[x[-1]]) for x in marked)

    def _encode_joined(self, part: list[str], text: str, opens: np.ndarray) -> list[str]:
        """Learn the pieces of one text, each of which begins with an id of `opens`; gives back what it cannot tell apart."""
        (data,) = self._ids([text])
        starts = (np.flatnonzero(opens[np.frombuffer(data, dtype=self.dtype)]) * self.dtype.itemsize).tolist()
        if len(starts) != len(part):
            return part
        self.known.update(zip(part, map(data.__getitem__, map(slice, starts, [*starts[1:], len(data)]))))
        return []

    def _encode_new(self, unknown: set[str]) -> None:
        words = [x for x in unknown if x.isprintable()]  # and so without white space inside
        lines = [x for x in unknown if x[0] == "\n" and x[1:].isprintable()]
        other = list(unknown.difference(words, lines))
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            other += self._encode_joined(part, " " + " ".join(part), self.opens)
        for i in range(0, len(lines), 2000):
            part = lines[i : i + 2000]
            other += self._encode_joined(part, "".join(part), self.breaks)
        self.known.update(zip(other, self._ids([x if x[0] == "\n" else " " + x for x in other])))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text, as bytes of `dtype`."""
        cut = [pieces(x or "") for x in texts]
        rest = [x[1:] for x in cut]
        unknown = set().union(*rest).difference(self.known)
        if len(self.known) + len(unknown) > CACHE_PIECES:
            self.known, self.first = {}, {}
            unknown = set().union(*rest)
        if unknown:
            self._learn(unknown)
        opening = list({x[0] for x in cut}.difference(self.first))
        self.first.update(zip(opening, self._ids(opening)))
        known = self.known.__getitem__
        return [self.first[x[0]] + b"".join(map(known, y)) for x, y in zip(cut, rest)]


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker, kept from task to task.

    This package travels inside the task closure, so its own globals are new for every task.
    """
    kept = sys.modules.setdefault("_lodestone_encoders", ModuleType("_lodestone_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


# Writing ---------------------------------------------------------------------


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder given as Spark names it, and the folder's path there."""
    if re.match(r"file:/(?!//)", uri):
        uri = "file:///" + uri[len("file:") :].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    codec, part = worker_encoder(tokenizer), TaskContext.get().partitionId()
    end, width = np.array([end_id], codec.dtype).tobytes(), codec.dtype.itemsize
    store, base = open_store(folder)
    name = f"part-{part:06d}-{uuid.uuid4().hex}"
    out, offsets, at, n_tokens = None, [], 0, 0
    for batch in batches:
        for i in range(0, batch.num_rows, _SLICE):
            some = batch.slice(i, _SLICE)
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{name}.rec")
            for key, ids in zip(some.column(0).to_pylist(), codec.encode(some.column(1).to_pylist())):
                data = frame(b"".join((struct.pack(_HEAD, key or 0, key is None, width), ids, end)))
                out.write(data)
                offsets.append(at)
                at += len(data)
                n_tokens += len(ids) // width + 1
    if out is not None:
        out.close()
        with store.open_output_stream(f"{base}/{name}.idx") as index:
            index.write(np.array([*offsets, at], dtype="<u8").tobytes())
        row = ([part], [f"{name}.rec"], [f"{name}.idx"], [len(offsets)], [n_tokens])
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, _MANIFEST_ARROW)], schema=_MANIFEST_ARROW)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write all documents in ascending doc_id order; returns the manifest, one row per record file."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    order = ["id", F.xxhash64("text")]
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    n_files = max(1, -(-size // FILE_TEXT_BYTES), min(cores, size // (FILE_TEXT_BYTES // 16)))
    dealt = rows.repartitionByRange(n_files, *order).sortWithinPartitions(*order)
    done = dealt.mapInArrow(partial(_write, folder=folder, tokenizer=tokenizer, end_id=end_id), MANIFEST)
    done.write.parquet(f"{folder}/manifest")
    return read_manifest(docs.sparkSession, folder)


_MANIFEST_ARROW = pa.schema(
    [("part", pa.int32()), ("records", pa.string()), ("index", pa.string()), ("n_records", pa.int64()), ("n_tokens", pa.int64())]
)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder, with the number of ids before each; a row per file, however many records."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.select(F.lit(folder).alias("folder"), "*", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))


# Reading ---------------------------------------------------------------------


def _take(stream, n: int, what: str) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise ValueError(f"{what}: the record file ends early")
    return bytes(data)


def read_frame(stream, what: str) -> bytes:
    """The payload of the frame at the stream's position; both checksums must hold."""
    head = _take(stream, 12, what)
    if masked_crc(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError(f"{what}: the length is damaged")
    body = _take(stream, struct.unpack("<Q", head[:8])[0] + 4, what)
    if masked_crc(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
        raise ValueError(f"{what}: the record is damaged")
    return body[:-4]


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    key, nameless, width = struct.unpack_from(_HEAD, payload)
    return None if nameless else key, np.frombuffer(payload, f"<u{width}", offset=_HEAD_BYTES).astype("<u4")


_RECORDS_ARROW = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
_RECORDS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def _offsets(store, path: str) -> np.ndarray:
    with store.open_input_stream(path) as stream:
        return np.frombuffer(stream.read(), "<u8")


def _read(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        for file in batch.to_pylist():
            store, base = open_store(file["folder"])
            offsets, start = _offsets(store, f"{base}/{file['index']}"), file["start"]
            if len(offsets) != file["n_records"] + 1:
                raise ValueError(f"{file['index']}: the index does not fit the manifest")
            rows, at = [], 0
            with store.open_input_stream(f"{base}/{file['records']}", buffer_size=1 << 20) as stream:
                for offset in offsets[:-1]:
                    if at != offset:
                        raise ValueError(f"{file['index']}: an offset does not fit")
                    payload = read_frame(stream, file["records"])
                    at += len(payload) + 16
                    key, ids = parse(payload)
                    data = ids.tobytes()
                    rows.append((key, start, len(ids), zlib.crc32(data), data)[: len(schema)])
                    start += len(ids)
                    if len(rows) >= 1000:
                        yield made(rows)
                        rows = []
            if at != offsets[-1] or start != file["start"] + file["n_tokens"]:
                raise ValueError(f"{file['records']}: it does not end where it should")
            if rows:
                yield made(rows)


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per record: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids as little-endian u32 bytes."""
    schema = pa.schema(_RECORDS_ARROW + [("ids", pa.binary())] * with_ids)
    dealt = manifest.select("folder", "records", "index", "n_records", "n_tokens", "start").repartition(max(1, manifest.count()))
    return dealt.mapInArrow(partial(_read, schema=schema), _RECORDS + ", ids binary" * with_ids)


def _list_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.to_pylist():
            store, base = open_store(file["folder"])
            offsets = _offsets(store, f"{base}/{file['index']}")[:-1].astype(np.int64)
            names = [pa.array([file[c]] * len(offsets), pa.string()) for c in ("folder", "records")]
            yield pa.RecordBatch.from_arrays([*names, pa.array(offsets)], names=["folder", "records", "offset"])


def _seek_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        opened, keys, found = {}, [], []
        for row in batch.to_pylist():
            place = (row["folder"], row["records"])
            if place not in opened:
                store, base = open_store(row["folder"])
                opened[place] = store.open_input_file(f"{base}/{row['records']}")
            opened[place].seek(row["offset"])
            key, ids = parse(read_frame(opened[place], row["records"]))
            keys.append(key)
            found.append(ids.tobytes())
        for file in opened.values():
            file.close()
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "ids"])


def read_shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """(doc_id, ids) of all records in a seeded random order, each read by its offset in the index."""
    listed = manifest.select("folder", "records", "index").mapInArrow(_list_records, "folder string, records string, offset bigint")
    order = F.xxhash64(F.lit(seed), "records", "offset")
    return listed.repartitionByRange(order).sortWithinPartitions(order).mapInArrow(_seek_records, "doc_id bigint, ids binary")


def token_report(docs: DataFrame, folder: str, tokenizer: str, **options) -> DataFrame:
    """Write the files and read them back: doc_id, start, n_tokens, ids_crc32 per document."""
    return read_token_files(write_token_files(docs, folder, tokenizer, **options))
