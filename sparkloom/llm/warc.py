"""WARC records inside ZIP archives that are read in place.

Each archive stores (never compresses) one WARC member and one index member. Readers find members through the end
record, the ZIP64 locator and the central directory, take a record's range from the index, and read just that range."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import new_folder, read, save, shuffle_partitions

#: Fixed values of the ZIP format: signatures and the marks that send a reader to the ZIP64 fields.
LOCAL, CENTRAL, END, END_64, LOCATOR_64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
FULL_16, FULL_32 = 0xFFFF, 0xFFFFFFFF
RECORDS, INDEX = "archive/data.warc", "indexes/index.cdx"
#: Ranges that lie so near to each other are read at once, up to so many bytes.
GAP, MOST = 1 << 16, 1 << 23
#: Bits of the bitmap over repeated digests, at most. If they are very many, more payloads are shuffled than need be.
BITS = 1 << 20


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


def open_store(path: str):
    """(file system, path in it) for a path that Arrow can open: local files, hdfs and object stores."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def directory(file, size: int) -> list[Member]:
    """The members of an open archive of `size` bytes, from its central directory."""
    tail_at = max(0, size - 22 - FULL_16)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    at = tail.rfind(struct.pack("<I", END))
    if at < 0:
        raise ValueError("no end record: this is no ZIP archive")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if count == FULL_16 or length == FULL_32 or start == FULL_32:
        mark, _, end_64, _ = struct.unpack_from("<IIQI", tail, at - 20)
        if mark != LOCATOR_64:
            raise ValueError("the ZIP64 locator is missing")
        file.seek(end_64)
        record = file.read(56)
        if struct.unpack_from("<I", record)[0] != END_64:
            raise ValueError("the ZIP64 end record is missing")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    file.seek(start)
    data, at, found = file.read(length), 0, []
    for _ in range(count):
        mark, method, stored, full, n_name, n_extra, n_note, header = struct.unpack_from("<I6xH8xIIHHH8xI", data, at)
        if mark != CENTRAL:
            raise ValueError("a central directory entry is damaged")
        name, extra = data[at + 46 : at + 46 + n_name], data[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: holds only the fields that are full, in this order
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                full = next(values) if full == FULL_32 else full
                stored = next(values) if stored == FULL_32 else stored
                header = next(values) if header == FULL_32 else header
            extra = extra[4 + n :]
        found.append(Member(name.decode(), method, stored, header))
        at += 46 + n_name + n_extra + n_note
    return found


def data_start(file, member: Member) -> int:
    """Where a stored member's bytes begin; its local header can be longer than its central entry."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    file.seek(member.header)
    head = file.read(30)
    if struct.unpack_from("<I", head)[0] != LOCAL:
        raise ValueError(f"{member.name} has no local header")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


class Writer:
    """Writes stored members to a stream that can't seek, always with ZIP64 fields."""

    def __init__(self, out) -> None:
        self.out, self.at, self.members = out, 0, []

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, parts: Iterator[bytes]) -> None:
        import zlib

        header, raw = self.at, name.encode()
        self.write(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 1 << 3 | 1 << 11, 0, 0, 33, 0, 0, 0, len(raw), 0) + raw)
        start, crc = self.at, 0
        for part in parts:
            crc = zlib.crc32(part, crc)
            self.write(part)
        size = self.at - start
        self.write(struct.pack("<IIQQ", 0x08074B50, crc, size, size))
        self.members.append((raw, crc, size, header))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, header in self.members:
            self.write(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 1 << 3 | 1 << 11, 0, 0, 33, crc, FULL_32, FULL_32, len(raw), 28, 0, 0, 0, 0, FULL_32) + raw + struct.pack("<HHQQQ", 1, 24, size, size, header))
        end = self.at
        self.write(struct.pack("<IQHHIIQQQQ", END_64, 44, 45, 45, 0, 0, len(self.members), len(self.members), end - start, start))
        self.write(struct.pack("<IIQI", LOCATOR_64, 0, end, 1))
        self.write(struct.pack("<IHHHHIIH", END, 0, 0, FULL_16, FULL_16, FULL_32, FULL_32, 0))


def record(page_id, url: str, payload: bytes, n_bytes: int, digest: str, refers_to) -> bytes:
    """A WARC/1.1 record; a revisit (with refers_to) has no payload, its headers say which record has it."""
    kind = "response" if refers_to is None else "revisit"
    clean = "".join(c for c in url if c >= " ")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n_bytes}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(payload)}", "", ""]).encode() + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, body) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record begins here")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def base32_sha1(payload: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def bitmap(keys: DataFrame, bits: int) -> Column:
    """A test of the column key that is true for each key (a long) in keys, and for few others if they are few for the
    bits. Its bits are the only thing that goes through the driver."""
    place = lambda x: x.bitwiseAND(bits - 1)
    marks = keys.select(F.shiftright(place(F.col("key")), 6).alias("i"), F.expr(f"shiftleft(1L, cast(key & {bits - 1} & 63 as int))").alias("b"))
    words = [0] * (bits // 64)
    for row in marks.groupBy("i").agg(F.bit_or("b").alias("b")).collect():
        words[row.i] = row.b
    held = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    at = place(F.col("key"))
    return F.getbit(F.get(held, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1


def deduplicated(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, n_bytes, digest (hexadecimal SHA-1), refers_to of each record to write.

    Of the rows with one payload of at least so many bytes, that with the largest page_id is the response; of several
    such rows the one with the last url, and of rows that are equal in all this, one. The others are revisits: they have no payload and
    refer to its page_id. Smaller payloads, and rows without page_id, are responses all.

    Payloads that occur once are the most. They stay where they were read: only digests are grouped, and a bitmap of
    BITS bits at most over the repeated ones tells which rows can have one. Those alone are shuffled, by digest, page
    and url, and revisits come from the groups, without their payloads."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha1("payload").alias("digest"))
    joinable = (F.col("n_bytes") >= least) & F.col("page_id").isNotNull()
    each = rows.filter(joinable).groupBy("digest", "page_id", "url", "n_bytes").agg(F.count("*").alias("n"))
    each = save(each, "records")
    groups = each.groupBy("digest").agg(F.sum("n").alias("n"), F.max(F.struct("page_id", "url")).alias("last")).filter("n > 1")
    groups = save(groups.select("digest", "last"), "groups")

    key = F.xxhash64("digest").alias("key")
    bits = 1 << min(max(12, (32 * groups.count()).bit_length()), BITS.bit_length() - 1)
    rows = rows.withColumn("key", key)
    again = joinable & bitmap(groups.select(key), bits)
    nothing = F.lit(None).cast("long").alias("refers_to")
    out = ["page_id", "url", "payload", "n_bytes", "digest"]
    single = rows.filter(~again | F.col("page_id").isNull()).select(*out, nothing)

    members = each.join(groups, "digest")
    first = (F.col("page_id") == F.col("last.page_id")) & (F.col("url") == F.col("last.url"))
    others = members.filter(~first).select("digest", "page_id", "url")
    kept = rows.filter(again).join(others, ["digest", "page_id", "url"], "left_anti")
    kept = kept.groupBy("digest", "page_id", "url", "n_bytes").agg(F.first("payload").alias("payload")).select(*out, nothing)
    times = F.col("n") - F.when(first, 1).otherwise(0)
    revisits = members.select("*", times.alias("times")).filter("times > 0").select("*", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    revisits = revisits.select("page_id", "url", F.lit(b"").alias("payload"), "n_bytes", "digest", F.col("last.page_id").alias("refers_to"))
    return single.unionByName(kept).unionByName(revisits)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """path, n_bytes, n_records of the archives of records (as deduplicated() gives them), one for each partition.

    A task that runs again writes another file; the returned table names the files of those that ended well."""

    def run(batches):
        import base64

        import pyarrow as pa
        from pyspark import TaskContext

        at = TaskContext.get()
        name = f"{folder}/pages-{at.partitionId():05d}-{at.taskAttemptId()}.zip"
        store, path = open_store(name)
        index: list[str] = []

        def written() -> Iterator[bytes]:
            offset = 0
            for batch in batches:
                for row in batch.to_pylist():
                    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                    data = record(row["page_id"], row["url"], row["payload"], row["n_bytes"], digest, row["refers_to"])
                    index.append(f"{row['page_id']}\t{offset}\t{len(data)}\n")
                    offset += len(data)
                    yield data

        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(path) as out:
            zipped = Writer(out)
            zipped.member(RECORDS, written())
            zipped.member(INDEX, (line.encode() for line in index))
            zipped.close()
        yield pa.RecordBatch.from_pydict({"path": [name], "n_bytes": [zipped.at], "n_records": [len(index)]})

    return save(records.mapInArrow(run, "path string, n_bytes long, n_records long"), "archives")


def read_index(archives: DataFrame) -> DataFrame:
    """path, offset, length of each record in archives (path, n_bytes), by their directories and index members."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, size in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                store, path = open_store(name)
                with store.open_input_file(path) as file:
                    members = {m.name: m for m in directory(file, size)}
                    base = data_start(file, members[RECORDS])
                    start, left = data_start(file, members[INDEX]), members[INDEX].size
                    file.seek(start)
                    rest = b""
                    while left:
                        data = file.read(min(left, MOST))
                        left -= len(data)
                        *lines, rest = (rest + data).split(b"\n")
                        cells = [line.split(b"\t") for line in lines]
                        yield pa.RecordBatch.from_pydict({"path": [name] * len(cells), "offset": [base + int(c[1]) for c in cells], "length": [int(c[2]) for c in cells]})

    return archives.select("path", "n_bytes").mapInArrow(run, "path string, offset long, length long")


def read_records(index: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload for each range in index.

    Each task reads its ranges in order; the payloads' digests are verified."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = sorted(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            name = file = None
            out: list[tuple] = []
            held, held_at = b"", 0
            for i, (path, offset, length) in enumerate(rows):
                if path != name:
                    if file:
                        file.close()
                    store, inner = open_store(path)
                    name, file, held = path, store.open_input_file(inner), b""
                if not held_at <= offset <= offset + length <= held_at + len(held):
                    end = offset + length
                    for p, o, n in rows[i + 1 :]:
                        if p != path or o - end > GAP or o + n - offset > MOST:
                            break
                        end = o + n
                    file.seek(offset)
                    held, held_at = file.read(end - offset), offset
                headers, body = parse(held[offset - held_at : offset - held_at + length])
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = headers["WARC-Type"]
                if kind == "response" and base32_sha1(body) != digest:
                    raise ValueError(f"the record at {offset} in {path} is damaged")
                number = lambda key: None if (x := headers.get(key, "None")[10:-1]) in ("", "None") else int(x)
                out.append((number("WARC-Record-ID"), headers.get("WARC-Target-URI", ""), int(headers["X-Payload-Length"]), digest, kind, number("WARC-Refers-To"), body))
            if file:
                file.close()
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            columns = zip(*out, strict=True) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return index.select("path", "offset", "length").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_and_read(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC records in ZIP archives in the shared folder and reads them back.

    Null html and url are empty. See deduplicated() for which records are responses; repeated rows are records each.
    An empty table makes no records."""
    spark = pages.sparkSession
    archives = write_archives(deduplicated(pages, least), new_folder(spark, "archives"))
    index = read_index(archives.repartition(shuffle_partitions(spark), "path"))
    return read_records(index)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archive_and_read() of all pages, without payloads. Null and empty html are payloads of no bytes, which are
    equal; repeated rows are records each, one of them the response; no rows give none."""
    return archive_and_read(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
