"""Token-ID files: length-delimited binary records with an offset index.

A record file is a run of records, each

    length   uint64   bytes of the payload
    check    uint32   masked CRC-32 of the eight length bytes
    payload
    check    uint32   masked CRC-32 of the payload

and a payload is ``id (int64), flags (uint8, 1: the id is null), width
(uint8: 2 or 4), token ids of that width``; all numbers are little-endian.  A
mask (rotate right by 15, add a constant) keeps checksums of data that holds
checksums apart.  The index file beside it lists the offset of every record
(uint64 each) and ends with their masked checksum, so records can be read in
any order: the reader's option ``shuffle_seed`` does that.

``write`` sorts by id over the whole corpus (range shuffle); the tasks of
the sink encode the texts and write one record and one index file each.  The manifest names each
partition's files, records and tokens; the reader turns the running sum of
tokens over partitions (one number per file) into each record's place in the
corpus.  A lost executor's partitions are encoded and written anew under new
names.

Edge cases: a null or empty text is its end id alone; null ids come first;
rows that repeat an id stand side by side, ordered by text; an empty table
gives files without records.  Other columns are ignored.
"""

from __future__ import annotations

import random
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)

from .files import new_name, open_folder, read_manifest, remove, write_manifest
from .memory import release
from .tokens import encoder

_HEAD = struct.Struct("<QI")
_TAIL = struct.Struct("<I")
_PAYLOAD = struct.Struct("<qBB")
READ_BYTES = 8 << 20
BATCH_RECORDS = 4096


def masked(data) -> int:
    c = zlib.crc32(data)
    return ((((c >> 15) | (c << 17)) & 0xFFFFFFFF) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, _TAIL.pack(masked(length)), payload, _TAIL.pack(masked(payload))))


@dataclass
class Written(WriterCommitMessage):
    partition: int
    records: int
    tokens: int
    file: str
    index: str


class TokenWriter(DataSourceArrowWriter):
    """Rows of id and text, in the order of the records."""

    def __init__(self, path: str, tokenizer: str, end_id: int):
        self.path, self.tokenizer, self.end_id = path, tokenizer, end_id

    def write(self, batches) -> Written:
        number = TaskContext.get().partitionId()
        system, folder = open_folder(self.path)
        system.create_dir(folder, recursive=True)
        file, index = new_name(number, ".tok"), new_name(number, ".idx")
        offsets, at, tokens = [], 0, 0
        enc = encoder(self.tokenizer)
        width = 2 if max(enc.tokenizer.get_vocab_size() - 1, self.end_id) < 1 << 16 else 4
        end = np.array([self.end_id], "<u4").tobytes()
        with system.open_output_stream(f"{folder}/{file}", buffer_size=1 << 20) as out:
            for batch in batches:
                names = batch["id"].to_pylist()
                for first, found in enc.encode(batch["text"]):
                    for k, x in enumerate(found, first):
                        ids = np.frombuffer(x + end, "<u4").astype(f"<u{width}").tobytes()
                        record = frame(_PAYLOAD.pack(names[k] or 0, names[k] is None, width) + ids)
                        out.write(record)
                        offsets.append(at)
                        at += len(record)
                        tokens += len(ids) // width
        release(now=True)
        raw = np.array(offsets, "<u8").tobytes()
        with system.open_output_stream(f"{folder}/{index}") as out:
            out.write(raw + _TAIL.pack(masked(raw)))
        return Written(number, len(offsets), tokens, file, index)

    def commit(self, messages) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        write_manifest(self.path, [vars(m) for m in parts])

    def abort(self, messages) -> None:
        remove(self.path, [n for m in messages if m is not None for n in (m.file, m.index)])


@dataclass
class Shard(InputPartition):
    file: str
    index: str
    tokens_before: int

    def __post_init__(self):
        super().__init__(self.file)


class TokenReader(DataSourceReader):
    def __init__(self, path: str, with_ids: bool, seed: int | None):
        self.path, self.with_ids, self.seed = path, with_ids, seed

    def partitions(self):
        out, before = [], 0
        for p in read_manifest(self.path):
            out.append(Shard(p["file"], p["index"], before))
            before += p["tokens"]
        if self.seed is not None:
            random.Random(self.seed).shuffle(out)
        return out or [Shard("", "", 0)]

    def _payloads(self, shard: Shard):
        """(place in the file, payload): in file order from one stream, or in
        shuffled order by the index."""
        system, folder = open_folder(self.path)
        if self.seed is not None:
            with system.open_input_stream(f"{folder}/{shard.index}") as source:
                raw = source.read()
            if masked(raw[:-4]) != _TAIL.unpack(raw[-4:])[0]:
                raise ValueError(f"{shard.index}: checksum differs")
            offsets = np.frombuffer(raw[:-4], "<u8").tolist()
            order = list(range(len(offsets)))
            random.Random(f"{self.seed} {shard.file}").shuffle(order)
            with system.open_input_file(f"{folder}/{shard.file}") as source:
                for k in order:
                    source.seek(offsets[k])
                    head = source.read(_HEAD.size)
                    n = self._length(head, shard)
                    yield k, self._checked(source.read(n + 4), shard)
            return
        k = 0
        with system.open_input_stream(f"{folder}/{shard.file}", buffer_size=READ_BYTES) as source:
            while True:
                head = source.read(_HEAD.size)
                if not head:
                    return
                n = self._length(head, shard)
                yield k, self._checked(source.read(n + 4), shard)
                k += 1

    @staticmethod
    def _length(head: bytes, shard: Shard) -> int:
        if len(head) != _HEAD.size:
            raise ValueError(f"{shard.file}: it ends inside a record")
        n, check = _HEAD.unpack(head)
        if masked(head[:8]) != check:
            raise ValueError(f"{shard.file}: a length's checksum differs")
        return n

    @staticmethod
    def _checked(raw: bytes, shard: Shard) -> memoryview:
        payload = memoryview(raw)[:-4]
        if masked(payload) != _TAIL.unpack(raw[-4:])[0]:
            raise ValueError(f"{shard.file}: a payload's checksum differs")
        return payload

    def read(self, shard: Shard):
        if not shard.file:
            return
        names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * self.with_ids
        rows: list[list] = [[] for _ in names]
        starts: dict[int, int] = {}
        if self.seed is not None:  # places in the corpus come from the file order
            at = shard.tokens_before
            for k, payload in TokenReader(self.path, False, None)._payloads(shard):
                starts[k] = at
                at += (len(payload) - _PAYLOAD.size) // payload[_PAYLOAD.size - 1]
        at = shard.tokens_before

        def batch():
            types = [pa.int64()] * 4 + [pa.binary()] * self.with_ids
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)
            for c in rows:
                c.clear()
            return out

        for k, payload in self._payloads(shard):
            i, null, width = _PAYLOAD.unpack_from(payload)
            raw = payload[_PAYLOAD.size:]
            wide = raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
            n = len(raw) // width
            rows[0].append(None if null else i)
            rows[1].append(starts[k] if self.seed is not None else at)
            rows[2].append(n)
            rows[3].append(zlib.crc32(wide))
            if self.with_ids:
                rows[4].append(bytes(wide))
            at += n
            if len(rows[0]) >= BATCH_RECORDS:
                yield batch()
        if rows[0]:
            yield batch()


class TokenFiles(DataSource):
    """``token_records``; options for reading: path, with_ids (true: also the
    ids as little-endian 32-bit bytes), shuffle_seed; for writing: path,
    tokenizer (its file), end_id."""

    @classmethod
    def name(cls):
        return "token_records"

    def schema(self):
        ids = ", ids binary" if self.options.get("with_ids", "").lower() == "true" else ""
        return "doc_id long, start long, n_tokens long, ids_crc32 long" + ids

    def reader(self, schema):
        seed = self.options.get("shuffle_seed")
        return TokenReader(self.options["path"], self.options.get("with_ids", "").lower() == "true",
                           None if seed is None else int(seed))

    def writer(self, schema, overwrite):
        return TokenWriter(self.options["path"], self.options["tokenizer"], int(self.options.get("end_id", "0")))


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id",
          text_col: str = "text") -> None:
    """Write every text's ids, ascending by id, to ``path``."""
    docs.sparkSession.dataSource.register(TokenFiles)
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .repartitionByRange("id").sortWithinPartitions("id", "text")
    ordered.write.format("token_records").option("tokenizer", tokenizer_path).option("end_id", str(end_id)) \
        .mode("append").save(path)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every record."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_records").options(**options).load(path)
