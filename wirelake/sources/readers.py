"""Reading and writing packet files.

A file is read as one binary row of Spark's own source, so from any store that Spark reaches, and cut
into packets in Arrow batches; src_id numbers the files in order of their names. Hex text is written by
the text writer, captures and XPKT files by a data source that writes record bytes as they are.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from itertools import islice
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from wirelake.operators.edit import rows_of, table_of
from wirelake.schema import EMPTY_TAGS, PACKET, RAW
from wirelake.sources import formats


def _plain(path: str) -> str:
    """A file's address in one spelling."""
    return re.sub(r"^(\w+):/+", r"\1:/", unquote(path))


def _files(spark: SparkSession, path: str, cut) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("_metadata.file_path").alias("path"), "content")
    number = {p: k for k, p in enumerate(sorted(map(_plain, files.inputFiles())))}

    def fit(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = (r | {"src_id": number[_plain(name)]} for r in cut(content))
                while some := list(islice(rows, 5000)):
                    yield from table_of(some, PACKET).to_batches()

    return files.mapInArrow(fit, PACKET)


def read_xpkt(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, formats.read_xpkt)


def read_pcap(spark: SparkSession, path: str, iface: int = 0) -> DataFrame:
    return _files(spark, path, lambda b: formats.read_pcap(b, iface))


def read_hex(spark: SparkSession, path: str, linktype: int | None = formats.ETH, strict: bool = False) -> DataFrame:
    return _files(spark, path, lambda b: formats.read_hex(b.decode(), linktype, strict))


def read_raw(spark: SparkSession, path: str, linktype: int = RAW) -> DataFrame:
    """Every file is one packet."""
    return _files(spark, path, lambda b: [EMPTY_TAGS | {"pkt_no": 1, "dltype": linktype, "data": b}])


def encoded(packets: DataFrame, kind: str) -> DataFrame:
    """(pkt_no, record) of packets as xpkt, pcap or hex records."""
    make = {"xpkt": formats.write_xpkt, "pcap": formats.write_pcap, "hex": lambda r: formats.to_hex(r).encode()}[kind]

    def fit(batches):
        for batch in batches:
            made = [make(r) for r in rows_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("src_id"), batch.column("pkt_no"), pa.array(made, pa.binary())], names=["src_id", "pkt_no", "record"])

    return packets.select(*PACKET.names).mapInArrow(fit, "src_id int, pkt_no long, record binary")


def in_order(records: DataFrame) -> DataFrame:
    """Rows dealt to partitions and sorted in them by stream and place."""
    return records.repartitionByRange("src_id", "pkt_no").sortWithinPartitions("src_id", "pkt_no")


def write_packets(packets: DataFrame, path: str, kind: str = "xpkt", mode: str = "errorifexists") -> None:
    """Write packet files (``xpkt``, ``pcap`` or ``hex``) below a folder, in packet order over the sorted file names.

    XPKT records can be read one after another, so the parts of a large stream are one stream; every
    part of a capture is a capture.
    """
    rows = in_order(encoded(packets, kind))
    if kind == "hex":
        rows.select(F.decode("record", "UTF-8").alias("value")).write.mode(mode).text(path)
        return
    packets.sparkSession.dataSource.register(PacketFiles)
    rows.select("record").write.format("packets").option("kind", kind).option("mode", mode).mode("append").save(path)


def _place(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if ":/" in path else (pa.fs.LocalFileSystem(), path)


class PacketFiles(DataSource):
    """Files of records as they are: one for each partition, moved to their names when all are written."""

    @classmethod
    def name(cls) -> str:
        return "packets"

    def schema(self) -> str:
        return "record binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return PacketFilesWriter(self.options["path"], self.options.get("kind", "xpkt"), self.options.get("mode", "append"))


@dataclass
class Part(WriterCommitMessage):
    name: str
    partition: int


class PacketFilesWriter(DataSourceArrowWriter):
    """Attempts write under names of their own; only those that the driver commits get a final one."""

    def __init__(self, path: str, kind: str, mode: str):
        self.path, self.kind, self.run = path, kind, uuid.uuid4().hex
        fs, folder = self.place()
        found = fs.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True))
        if found and mode == "errorifexists":
            raise FileExistsError(path)
        if mode == "overwrite" and found:
            fs.delete_dir_contents(folder)

    def place(self) -> tuple[pa.fs.FileSystem, str]:
        return _place(self.path)

    def write(self, iterator) -> WriterCommitMessage:
        fs, folder = self.place()
        fs.create_dir(f"{folder}/_temporary", recursive=True)
        task = TaskContext.get()
        name = f"{folder}/_temporary/{self.run}-{task.taskAttemptId()}"
        with fs.open_output_stream(name) as out:
            out.write(formats.pcap_start() if self.kind == "pcap" else b"")
            for batch in iterator:
                for record in batch.column(0):
                    out.write(record.as_py())
        return Part(name, task.partitionId())

    def commit(self, messages) -> None:
        fs, folder = self.place()
        for m in messages:
            if m is not None:
                fs.move(m.name, f"{folder}/part-{m.partition:06d}-{self.run}.{self.kind}")
        fs.delete_dir(f"{folder}/_temporary")

    def abort(self, messages) -> None:
        fs, _ = self.place()
        for m in messages:
            if m is not None:
                fs.delete_file(m.name)


def write_by_name(packets: DataFrame, column: str, path: str, kind: str = "xpkt", append: bool = False) -> None:
    """One file for each value of a column, its packets in order; an existing folder is refused unless append.

    A file's packets go through one task, as a file has one end to write at.
    """
    fs, folder = _place(path)
    if not append and fs.get_file_info(folder).type != pa.fs.FileType.NotFound:
        raise FileExistsError(path)
    make = {"xpkt": formats.write_xpkt, "pcap": formats.write_pcap}[kind]
    first = formats.pcap_start() if kind == "pcap" else b""

    def fit(batches):
        out, name, n = None, None, 0
        fs, folder = _place(path)
        fs.create_dir(folder, recursive=True)
        for batch in batches:
            for row in rows_of(batch):
                if row[column] != name:
                    if out is not None:
                        out.close()
                        fs.move(f"{folder}/{name}.{kind}.part", f"{folder}/{name}.{kind}")
                    name, n = row[column], n + 1
                    target, held = f"{folder}/{name}.{kind}", b""
                    if append and fs.get_file_info(target).type == pa.fs.FileType.File:
                        with fs.open_input_stream(target) as old:
                            held = old.read()
                    out = fs.open_output_stream(f"{target}.part")
                    out.write(held or first)
                out.write(make(row))
        if out is not None:
            out.close()
            fs.move(f"{folder}/{name}.{kind}.part", f"{folder}/{name}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    rows = packets.repartition(column).sortWithinPartitions(column, "src_id", "pkt_no")
    rows.select(*PACKET.names, column).mapInArrow(fit, "files long").write.format("noop").mode("overwrite").save()


def read_written(spark: SparkSession, path: str, kind: str = "xpkt") -> DataFrame:
    """Read back what write_packets wrote."""
    return {"hex": read_hex, "xpkt": read_xpkt, "pcap": read_pcap}[kind](spark, path)
