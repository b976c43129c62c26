"""BAM files as a Spark data source, in pure Python: ``spark.read.format("bam").load(path)``.

A file is cut by bytes. A partition owns the records that begin in the blocks of its block-gzip container that begin
in its range: it finds its first block by its header and checksum, and its first record at the first offset from
which a chain of whole records, each checked to its last byte, follows (or the end of the file). Whatever bytes
that takes are loaded, also beyond the range; nothing is accepted on bytes that are not there. No index is needed.

``option("content", "references")`` gives the reference list of each file instead of its records.
"""

from __future__ import annotations

import binascii
import posixpath
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from axisframe.sources.files import expand, open_file, place

SCHEMA = "qname string, flag int, rname string, pos bigint, mapq int, cigar string, rnext string, pnext bigint, tlen bigint, seq string, qual string, tags array<string>, source string"
REFERENCES = "path string, ord int, reference string, ref_length bigint"
#: Compressed bytes per partition.
SPLIT = 32 << 20
#: Whole records that must follow each other before an offset counts as a record's, and the largest record looked for.
CHAIN, LARGEST = 4, 1 << 28
#: Records and bytes of sequence per Arrow batch.
BATCH_RECORDS, BATCH_BYTES = 4096, 8 << 20
#: Fixed values of the format: codes of bases and of alignment operations, and layouts of numbers in tags.
_SEQ, _CIGAR = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_FIXED = struct.Struct("<iiBBHHHiiii")
_BASES = bytes.maketrans(b"0123456789abcdef", _SEQ.encode())
_CODES = {ord(b): f"{i:x}" for i, b in enumerate(_SEQ)} | {ord(b.lower()): f"{i:x}" for i, b in enumerate(_SEQ)}
_UP, _DOWN = bytes((i + 33) & 255 for i in range(256)), bytes((i - 33) & 255 for i in range(256))


def block_at(f, at: int) -> tuple[bytes, int] | None:
    """Content of the block that begins at ``at`` and the place of the next one; None at the end of the file."""
    f.seek(at)
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or head[:4] != b"\x1f\x8b\x08\x04":
        raise ValueError(f"no block-gzip block at byte {at}")
    extra = f.read(struct.unpack_from("<H", head, 10)[0])
    size, p = None, 0
    while p + 4 <= len(extra):
        if extra[p : p + 2] == b"BC":
            size = struct.unpack_from("<H", extra, p + 4)[0] + 1
        p += 4 + struct.unpack_from("<H", extra, p + 2)[0]
    rest = size - 12 - len(extra) if size else 0
    body = f.read(rest) if rest > 8 else b""
    if rest <= 8 or len(body) < rest:
        raise ValueError(f"the block at byte {at} is cut short")
    content = zlib.decompress(body[:-8], -15)
    if struct.unpack("<II", body[-8:]) != (zlib.crc32(content), len(content)):
        raise ValueError(f"the block at byte {at} is damaged")
    return content, at + size


def next_border(f, at: int, end: int) -> int | None:
    """First block that begins in [at, end): a header, a content that fits its checksum, and another block after it or the end."""
    f.seek(at)
    window = f.read(min(1 << 17, f.size() - at))
    i = -1
    while (i := window.find(b"\x1f\x8b\x08\x04", i + 1)) >= 0 and at + i < end:
        try:
            _, after = block_at(f, at + i)
            block_at(f, after)
            return at + i
        except (ValueError, zlib.error, struct.error):
            pass
    return None


def read_header(f) -> tuple[str, list[tuple[str, int]], int, int]:
    """Header text, references, and where records begin: block place and offset in its content."""
    data, places, at = b"", [], 0

    def more() -> bool:
        nonlocal data, at
        got = block_at(f, at)
        if got is None:
            return False
        places.append((len(data), at))
        data, at = data + got[0], got[1]
        return True

    def need(n: int) -> None:
        while len(data) < n:
            if not more():
                raise ValueError("the BAM header is cut short")

    need(8)
    if data[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    n = struct.unpack_from("<i", data, 4)[0]
    need(12 + n)
    text = data[8 : 8 + n].rstrip(b"\x00").decode()
    count, p, references = struct.unpack_from("<i", data, 8 + n)[0], 12 + n, []
    for _ in range(count):
        need(p + 4)
        size = struct.unpack_from("<i", data, p)[0]
        need(p + 8 + size)
        references.append((data[p + 4 : p + 3 + size].decode(), struct.unpack_from("<i", data, p + 4 + size)[0]))
        p += 8 + size
    while len(data) <= p and more():
        pass
    start = [x for x in places if x[0] <= p][-1]
    return text, references, start[1], p - start[0]


def _tags(data, p: int, end: int) -> list[str]:
    """Tags as text; a ValueError if they do not end at ``end``."""
    out = []
    while p < end:
        tag, kind = data[p : p + 2].decode("ascii"), chr(data[p + 2])
        p += 3
        if kind in _NUMBERS:
            value = struct.unpack_from("<" + _NUMBERS[kind], data, p)[0]
            p += struct.calcsize(_NUMBERS[kind])
            out.append(f"{tag}:f:{value:g}" if kind == "f" else f"{tag}:i:{value}")
        elif kind == "A":
            out.append(f"{tag}:A:{chr(data[p])}")
            p += 1
        elif kind in "ZH":
            stop = data.index(0, p, end)
            out.append(f"{tag}:{kind}:{data[p:stop].decode()}")
            p = stop + 1
        elif kind == "B":
            sub, n = chr(data[p]), struct.unpack_from("<i", data, p + 1)[0]
            if n < 0 or sub not in _NUMBERS or p + 5 + n * struct.calcsize(_NUMBERS[sub]) > end:
                raise ValueError("a tag runs over its record")
            values = struct.unpack_from(f"<{n}{_NUMBERS[sub]}", data, p + 5)
            p += 5 + n * struct.calcsize(_NUMBERS[sub])
            out.append(",".join([f"{tag}:B:{sub}", *(f"{v:g}" if sub == "f" else str(v) for v in values)]))
        else:
            raise ValueError(f"no tag type {kind!r}")
    if p != end:
        raise ValueError("a tag runs over its record")
    return out


def parse_record(data, p: int, size: int, references: list[str], source: str) -> tuple:
    """The record of ``size`` bytes at ``p`` (after its length)."""
    ref, pos, name_n, mapq, _bin, n_cigar, flag, n_seq, next_ref, next_pos, tlen = _FIXED.unpack_from(data, p)
    q = p + 32
    name = data[q : q + name_n - 1].decode()
    q += name_n
    cigar = "".join([f"{c >> 4}{_CIGAR[c & 15]}" for c in struct.unpack_from(f"<{n_cigar}I", data, q)]) or "*"
    q += 4 * n_cigar
    half = (n_seq + 1) // 2
    seq = binascii.hexlify(data[q : q + half]).translate(_BASES)[:n_seq].decode() or "*"
    q += half
    raw = bytes(data[q : q + n_seq])
    qual = "*" if not n_seq or raw[:1] == b"\xff" else raw.translate(_UP).decode("latin-1")
    tags = _tags(data, q + n_seq, p + size)
    if n_cigar == 2 and cigar.startswith(f"{n_seq}S") and cigar.endswith("N"):
        # More operations than the record's own field can count lie in a tag.
        long_ = [t for t in tags if t.startswith("CG:B:I,")]
        if long_:
            cigar = "".join([f"{c >> 4}{_CIGAR[c & 15]}" for c in map(int, long_[0].split(",")[1:])])
            tags = [t for t in tags if t not in long_]
    rname = references[ref] if ref >= 0 else "*"
    rnext = "*" if next_ref < 0 else "=" if next_ref == ref else references[next_ref]
    return name, flag, rname, pos + 1, mapq, cigar, rnext, next_pos + 1, tlen, seq, qual, tags, source


class _Stream:
    """Content of the blocks from ``at`` on; ``own`` bytes of it come from blocks that begin before ``end``."""

    def __init__(self, f, at: int, end: int):
        self.f, self.at, self.end = f, at, end
        self.data, self.own = bytearray(), 0

    def more(self) -> bool:
        got = block_at(self.f, self.at)
        if got is None:
            return False
        self.data += got[0]
        if self.at < self.end:
            self.own = len(self.data)
        self.at = got[1]
        return True

    def more_own(self) -> bool:
        return self.at < self.end and self.more()

    def need(self, n: int) -> bool:
        """Whether there are ``n`` bytes."""
        while len(self.data) < n:
            if not self.more():
                return False
        return True

    def trim(self, n: int) -> None:
        del self.data[:n]
        self.own -= n


def _candidates(data, low: int, high: int, n_references: int) -> np.ndarray:
    """Offsets in [low, high) where the fixed part of a record could stand; all of it must be in ``data``."""
    x = np.frombuffer(bytes(data[low : high + 36]), np.uint8).astype(np.int64)
    n = min(high - low, len(x) - 36 + 1)
    if n <= 0:
        return np.zeros(0, np.int64)
    word = lambda k: (x[k : k + n] | x[k + 1 : k + 1 + n] << 8 | x[k + 2 : k + 2 + n] << 16 | x[k + 3 : k + 3 + n] << 24).astype(np.uint32).view(np.int32).astype(np.int64)
    size, ref, pos, n_seq, next_ref, next_pos = (word(k) for k in (0, 4, 8, 20, 24, 28))
    name_n, n_cigar = x[12 : 12 + n], x[16 : 16 + n] | x[17 : 17 + n] << 8
    fine = (n_seq >= 0) & (name_n > 1) & (size < LARGEST) & (32 + name_n + 4 * n_cigar + (n_seq + 1) // 2 + n_seq <= size)
    fine &= (ref >= -1) & (ref < n_references) & (next_ref >= -1) & (next_ref < n_references) & (pos >= -1) & (next_pos >= -1)
    return np.flatnonzero(fine) + low


def _record_end(s: _Stream, p: int, references: list[str]) -> int | None:
    """Where the record at ``p`` ends, if every part of it is as a record's must be."""
    if not s.need(p + 36):
        return None
    size = struct.unpack_from("<i", s.data, p)[0]
    ref, pos, name_n, _mapq, _bin, n_cigar, _flag, n_seq, next_ref, next_pos, _tlen = _FIXED.unpack_from(s.data, p + 4)
    if not (n_seq >= 0 and name_n > 1 and 32 + name_n + 4 * n_cigar + (n_seq + 1) // 2 + n_seq <= size < LARGEST and -1 <= ref < len(references) and -1 <= next_ref < len(references) and pos >= -1 and next_pos >= -1):
        return None
    q = p + 36
    if not s.need(q + name_n + 4 * n_cigar):
        return None
    name = s.data[q : q + name_n]
    if name[-1] or any(c < 33 or c > 126 for c in name[:-1]):
        return None
    ops = struct.unpack_from(f"<{n_cigar}I", s.data, q + name_n)
    if any(c & 15 > 8 for c in ops) or (ops and n_seq and sum(c >> 4 for c in ops if (c & 15) in (0, 1, 4, 7, 8)) != n_seq):
        return None
    end = p + 4 + size
    if not s.need(end):
        return None
    try:
        _tags(s.data, q + name_n + 4 * n_cigar + (n_seq + 1) // 2 + n_seq, end)
    except (ValueError, IndexError, struct.error):
        return None
    return end


def _first_record(s: _Stream, references: list[str]) -> int | None:
    """Offset of the first record that begins in the stream's own bytes, or None."""
    looked = 0
    while looked < s.own or s.more_own():
        own = s.own  # looking further may load, and own, more
        s.need(own + 36)
        for p in _candidates(s.data, looked, own, len(references)).tolist():
            q: int | None = p
            for _ in range(CHAIN):
                q = _record_end(s, q, references)
                if q is None or not s.need(q + 1):  # broken, or the end of the file right after a whole record
                    break
            if q is not None:
                return p
        looked = own
    return None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in SCHEMA.split(", "))])


def record_batches(path: str, begin: int, end: int) -> Iterator[pa.RecordBatch]:
    """Records that begin in the blocks of [begin, end)."""
    schema, source = _arrow_schema(), posixpath.basename(path)
    with open_file(path) as f:
        _, refs, first, offset = read_header(f)
        names = [r for r, _ in refs]
        at = first if begin <= first else next_border(f, begin, end)
        if at is None or at >= end:
            return
        s = _Stream(f, at, end)
        p = offset if begin <= first else _first_record(s, names)
        rows: list[tuple] = []
        weight = 0
        while p is not None:
            if p >= s.own:
                if s.more_own():
                    continue
                break
            if not s.need(p + 4):
                raise ValueError(f"{path} ends within a record")
            size = struct.unpack_from("<i", s.data, p)[0]
            if size < 32 or not s.need(p + 4 + size):
                raise ValueError(f"{path} ends within a record, or is damaged")
            rows.append(parse_record(s.data, p + 4, size, names, source))
            p, weight = p + 4 + size, weight + size
            if len(rows) >= BATCH_RECORDS or weight >= BATCH_BYTES:
                yield _batch(rows, schema)
                rows, weight = [], 0
                s.trim(p)
                p = 0
        if rows:
            yield _batch(rows, schema)


def _reference_batch(path: str) -> pa.RecordBatch:
    with open_file(path) as f:
        _, refs, _, _ = read_header(f)
    return pa.RecordBatch.from_arrays([pa.array([path] * len(refs), pa.string()), pa.array(range(len(refs)), pa.int32()), pa.array([r for r, _ in refs], pa.string()), pa.array([n for _, n in refs], pa.int64())], ["path", "ord", "reference", "ref_length"])


class _Part(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        split = int(self.options.get("splitbytes", SPLIT))
        files = expand(self.options["path"], ".bam")
        if self.options.get("content") == "references":
            return [_Part(f, 0, 0) for f, _ in files]
        return [_Part(f, at, min(at + split, size)) for f, size in files for at in range(0, size, split)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        if self.options.get("content") == "references":
            return iter([_reference_batch(part.path)])
        return record_batches(part.path, part.begin, part.end)


class BamDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return REFERENCES if self.options.get("content") == "references" else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    from axisframe.session import ship

    ship(spark)
    spark.dataSource.register(BamDataSource)


def _number(value: str) -> bytes:
    v = int(value)
    return b"i" + struct.pack("<i", v) if -(1 << 31) <= v < 1 << 31 else b"I" + struct.pack("<I", v)


def _tag_bytes(text: str) -> bytes:
    tag, kind, value = text.split(":", 2)
    if kind == "B":
        sub, *values = value.split(",")
        body = b"B" + sub.encode() + struct.pack(f"<i{len(values)}{_NUMBERS[sub]}", len(values), *(float(v) if sub == "f" else int(v) for v in values))
    else:
        body = _number(value) if kind == "i" else b"f" + struct.pack("<f", float(value)) if kind == "f" else kind.encode() + value.encode() + (b"" if kind == "A" else b"\x00")
    return tag.encode() + body


def _ops(cigar: str) -> list[int]:
    ops, n = [], 0
    for c in "" if cigar == "*" else cigar:
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            ops.append(n << 4 | _CIGAR.index(c))
            n = 0
    return ops


def record_bytes(row: tuple, index: dict[str, int]) -> bytes:
    """A record (the columns of SCHEMA, source or not) as it stands in a file."""
    qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, tags, *_ = row
    ref = index.get(rname, -1)
    mate = ref if rnext == "=" else index.get(rnext, -1)
    s = "" if seq in ("*", None) else seq
    ops, tags = _ops(cigar), list(tags or [])
    if len(ops) > 65535:
        tags.append("CG:B:I," + ",".join(map(str, ops)))
        ops = [len(s) << 4 | 4, sum(c >> 4 for c in ops if (c & 15) in (0, 2, 3, 7, 8)) << 4 | 3]
    digits = s.translate(_CODES) + "0" * (len(s) % 2)
    try:
        packed = bytes.fromhex(digits)
    except ValueError:  # a letter that is no base counts as N
        packed = bytes.fromhex("".join(d if d in "0123456789abcdef" and ord(b) in _CODES else "f" for b, d in zip(s, digits)) + "0" * (len(s) % 2))
    quality = b"\xff" * len(s) if qual in ("*", None) else qual.encode("latin-1").translate(_DOWN)
    if len(quality) != len(s):
        raise ValueError(f"read {qname} has {len(s)} bases and {len(quality)} qualities")
    name = qname.encode() + b"\x00"
    body = _FIXED.pack(ref, pos - 1, len(name), mapq, 0, len(ops), flag, len(s), mate, pnext - 1, tlen) + name + struct.pack(f"<{len(ops)}I", *ops) + packed + quality + b"".join(map(_tag_bytes, tags))
    return struct.pack("<i", len(body)) + body


def header_bytes(header: str, references: list[tuple[str, int]]) -> bytes:
    text = header.encode()
    out = [b"BAM\x01", struct.pack("<i", len(text)), text, struct.pack("<i", len(references))]
    out += [struct.pack("<i", len(n) + 1) + n.encode() + b"\x00" + struct.pack("<i", size) for n, size in references]
    return b"".join(out)


def write_file(path: str, header: str, references: list[tuple[str, int]], rows: Iterable[tuple]) -> int:
    """One file, block by block; returns the number of records."""
    from axisframe.sources.sinks import BlockGzip

    index, n = {r: i for i, (r, _) in enumerate(references)}, 0
    system, plain = place(path)
    with system.open_output_stream(plain, compression=None) as raw, BlockGzip(raw) as out:
        out.write(header_bytes(header, references))
        for row in rows:
            out.write(record_bytes(row, index))
            n += 1
    return n


def sq_lines(references: list[tuple[str, int]]) -> str:
    return "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in references)


def write_bam(records: DataFrame, folder: str, references: list[tuple[str, int]], header: str | None = None) -> int:
    """``records`` as a folder of BAM files, one for each partition; returns their number.

    A task writes under a name of its own and renames the file when it is whole, so a repeated task does no harm.
    """
    from pyspark import TaskContext

    from axisframe.session import ship

    ship(records.sparkSession)
    columns = [x.split()[0] for x in SCHEMA.split(", ")][:-1]
    text = sq_lines(references) if header is None else header
    system, plain = place(folder)
    system.create_dir(plain)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder.rstrip('/')}/part-{task.partitionId():06d}"
        own = f"{name}-{task.taskAttemptId()}.part"
        n = write_file(own, text, references, (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))))
        target, path = place(own)
        target.move(path, place(f"{name}.bam")[1])
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return sum(r.n for r in records.select(*columns).mapInArrow(run, "n long").collect())
