"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is a run of zstandard frames that ends in the published seek table for such files: a skippable frame listing
compressed size, decompressed size and checksum (low 32 bits of XXH64) of every frame. Data frames hold ids as
little-endian unsigned 32-bit integers; the last frame is the index (document identifiers and lengths). A reader fetches
the table and the index from the end of the file and decompresses only the frames that hold the wanted documents.

Shards are ranges of documents, written by the tasks straight to the shared folder under a name of their own per
attempt; a manifest written by Spark names the files that count, so retried and duplicate attempts do no harm.

Defined cases: a null or empty text is one end id; null identifiers come first and are kept; rows that share an identifier
are ordered by a hash of their text and kept all; an empty table gives no file and no row; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivermeld.llm.shared import query, running_starts, table
from rivermeld.llm.tokens import default_path, encoder
from rivermeld.session import new_folder, written

# Fixed values of the published seekable format.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
INDEX = struct.Struct("<4sIQ")  # b"TIDX", version, documents

#: Ids after which a frame ends with the document; a longer document fills frames of this many ids.
FRAME_IDS = 65_536

#: Files of the manifest, which has one short row a shard.
MANIFEST_FILES = 8


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system, path


class TokenFile:
    """Writes one file to a binary stream; documents are added in order."""

    def __init__(self, stream, frame_ids: int = FRAME_IDS, level: int = 3):
        import zstandard

        self.stream, self.limit = stream, 4 * frame_ids
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.buffer, self.frames = bytearray(), []
        self.doc_ids, self.lengths = [], []

    def _frame(self, data: bytes) -> None:
        import xxhash

        packed = self.compressor.compress(data)
        self.stream.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.buffer and len(self.buffer) + len(ids) > self.limit:
            self._frame(bytes(self.buffer))
            self.buffer.clear()
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        while len(ids) > self.limit:
            self._frame(ids[:self.limit])
            ids = ids[self.limit:]
        self.buffer += ids

    def close(self) -> int:
        """Write what is left, the index and the seek table; returns the ids in the file."""
        import numpy as np

        if self.buffer:
            self._frame(bytes(self.buffer))
        n = len(self.doc_ids)
        null = np.fromiter((x is None for x in self.doc_ids), dtype=np.uint8, count=n)
        names = np.fromiter((x or 0 for x in self.doc_ids), dtype="<i8", count=n)
        self._frame(INDEX.pack(b"TIDX", 1, n) + names.tobytes() + np.array(self.lengths, dtype="<i8").tobytes() + null.tobytes())
        table_ = b"".join(struct.pack("<III", *x) for x in self.frames)
        foot = struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table_) + len(foot)) + table_ + foot)
        return sum(self.lengths)


class TokenReader:
    """Random access to the documents of one file."""

    def __init__(self, source):
        import numpy as np

        self.source = source
        size = source.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        length = 12 * frames + 9
        skip, told = struct.unpack("<II", self._at(size - length - 8, 8))
        if skip != SKIPPABLE or told != length:
            raise ValueError("the seek table is damaged")
        entries = np.frombuffer(self._at(size - length, 12 * frames), dtype="<u4").reshape(-1, 3).astype(np.int64)
        self.entries = entries
        self.places = np.concatenate([[0], np.cumsum(entries[:, 0])])
        self.bytes_before = np.concatenate([[0], np.cumsum(entries[:-1, 1])])  # of data frames
        index = self.frame(frames - 1)
        tag, _, n = INDEX.unpack_from(index)
        if tag != b"TIDX":
            raise ValueError("the last frame is no index")
        at = INDEX.size
        self.doc_ids = np.frombuffer(index, "<i8", n, at)
        self.lengths = np.frombuffer(index, "<i8", n, at + 8 * n)
        self.null = np.frombuffer(index, np.uint8, n, at + 16 * n).astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self._last = (-1, b"")

    def _at(self, place: int, length: int) -> bytes:
        self.source.seek(place)
        return self.source.read(length)

    def frame(self, k: int) -> bytes:
        """One frame, decompressed and held against its checksum."""
        import xxhash
        import zstandard

        data = zstandard.ZstdDecompressor().decompress(self._at(int(self.places[k]), int(self.entries[k, 0])))
        if len(data) != self.entries[k, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.entries[k, 2]:
            raise ValueError(f"frame {k} does not match its checksum")
        return data

    def document(self, k: int) -> bytes:
        """Packed ids of the k-th document; decompresses only the frames that hold it."""
        import numpy as np

        begin, end = 4 * int(self.starts[k]), 4 * int(self.starts[k + 1])
        f = int(np.searchsorted(self.bytes_before, begin, side="right")) - 1
        parts = []
        while begin < end:
            if self._last[0] != f:
                self._last = (f, self.frame(f))
            low = int(self.bytes_before[f])
            part = self._last[1][begin - low:end - low]
            parts.append(part)
            begin += len(part)
            f += 1
        return b"".join(parts)


def write_tokens(docs: DataFrame, folder: str, end_id: int = 2, tokenizer: str | None = None, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Write every document in ascending identifier order; returns the manifest: shard, path, n_docs, n_tokens, start.

    `start` is the number of ids in the shards before.
    """
    path, end = tokenizer or default_path(), end_id.to_bytes(4, "little")

    def shard(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encode, out, n = encoder(path), None, TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None:
                    name = f"{folder.rstrip('/')}/shard-{n:06d}-{uuid.uuid4().hex[:12]}.zst"
                    system, place = _open(name)
                    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    stream = system.open_output_stream(place, compression=None)
                    out = TokenFile(stream, frame_ids)
                out.add(doc_id, encode(text.as_py() or "") + end)
        if out is not None:
            n_tokens = out.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"shard": [n], "path": [name], "n_docs": [len(out.doc_ids)], "n_tokens": [n_tokens]})

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = named.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    # One row a task, so its place among the files hangs on the number of the task alone, also when the task is run again.
    rows = ordered.mapInArrow(shard, "shard long, path string, n_docs long, n_tokens long")
    shards = written(rows.repartition(MANIFEST_FILES), "manifest")
    return running_starts(shards, "shard", "n_tokens", "start")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def back(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for path, start in zip(frame["path"], frame["start"]):
                system, place = _open(path)
                with system.open_input_file(place) as source:
                    reader = TokenReader(source)
                    crc = [zlib.crc32(reader.document(k)) for k in range(len(reader.doc_ids))]
                    ids = pd.array(reader.doc_ids, dtype="Int64")
                    ids[reader.null] = pd.NA
                    yield pd.DataFrame({"doc_id": ids, "start": reader.starts[:-1] + start, "n_tokens": reader.lengths, "ids_crc32": crc})

    files = max(1, manifest.count())
    return manifest.select("shard", "path", "start").repartitionByRange(files, "shard").mapInPandas(
        back, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op9_token_files")
def op9(spark, sf_dir):
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), new_folder(spark, "token-files")))
