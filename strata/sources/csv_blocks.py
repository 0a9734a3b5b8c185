"""Large CSV files read by many tasks, quoted newlines included.

A newline ends a record only outside quotes, and whether a block of a file begins
inside quotes is known only from all that stands before it.  Spark's text reader
splits a file into blocks and gives their lines; two passes turn these into records:

1. Per block, the quote state at its end is found for both states that it may begin
   in, with the pieces of records that cross its borders (up to ``PIECE_BYTES`` each).
   The states of a file's blocks are then composed in their order, one small row per
   block, which gives the true state at every block's start.
2. Each block emits the records that lie in it.  Records across borders are put
   together from their pieces; only these are shuffled.

Spark's ``from_csv`` parses the records, with the options of the reader of small
files, and the rows are written once as parquet to the shared folder: a CSV file is
read twice (a third time only if a crossing record is longer than ``PIECE_BYTES``) and
never again for types or results.

A quote opens a quoted cell only at the start of a cell; a doubled quote inside one
is a quote.  Records end with ``\\n`` or ``\\r\\n``; blank lines are skipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import scratch_path

#: longest piece of a crossing record that the first pass keeps
PIECE_BYTES = 1 << 20
#: bytes of lines in an Arrow batch, about
BATCH_BYTES = 16 << 20
#: bytes of a file whose blocks one task takes one after the other, about (tasks stay many enough for the cores)
TASK_BYTES = 32 << 20
#: what is known of a file: not valid UTF-8, lines end with a carriage return
_LATIN, _CRLF = 1, 2
#: what a cell holds up to its closing quote
_QUOTED = re.compile(rb'(?:[^"]++|"")*+')


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether the end of ``line`` lies in a quoted cell, if its start does (``inside``) or is a record's start."""
    at = 0
    if not inside:
        if line[:1] == b'"':
            at = 1
        else:
            at = line.find(b',"') + 2
            if at == 1:
                return False
    while True:
        at = _QUOTED.match(line, at).end()
        if at >= len(line):
            return True
        at = line.find(b',"', at + 1) + 2  # what follows the closing quote is no quoted cell
        if at == 1:
            return False


class _Piece:
    """Lines of one open record, given up beyond ``PIECE_BYTES``."""

    def __init__(self, bound: int):
        self.lines: list[bytes] | None = []
        self.size, self.bound = 0, bound

    def add(self, line: bytes) -> None:
        self.size += len(line) + 1
        if self.lines is not None:
            self.lines.append(line)
            if self.size > self.bound:
                self.lines = None

    @property
    def data(self) -> bytes | None:
        return None if self.lines is None else b"\n".join(self.lines)


class _Summary:
    """What pass 1 learns of one block: for both start states, the end state and the border pieces."""

    def __init__(self, file: str, block: int, bound: int):
        self.file, self.block, self.bound = file, block, bound
        self.out, self.in_ = False, True
        self.closed = False  # has a record ended, for a start inside?
        self.head, self.tail_out, self.tail_in = _Piece(bound), _Piece(bound), _Piece(bound)
        self.records, self.valid, self.crlf = 0, True, None

    def line(self, line: bytes) -> None:
        if self.crlf is None:
            self.crlf = line[-1:] == b"\r"
        quotes = b'"' in line
        same = self.out == self.in_
        was_in, was_out = self.in_, self.out
        if quotes:
            self.out = ends_inside(line, self.out)
            self.in_ = self.out if same else ends_inside(line, self.in_)
        if not self.closed:
            self.head.add(line)
            self.closed = not self.in_
        elif self.in_:
            self.tail_in.add(line)
        elif was_in:
            self.tail_in = _Piece(self.bound)
        if self.out:
            self.tail_out.add(line)
        else:
            self.records += 1
            if was_out:
                self.tail_out = _Piece(self.bound)

    def row(self) -> tuple:
        return (self.file, self.block, self.valid, self.crlf, self.records, self.out, self.in_, self.closed, self.head.data,
                self.tail_out.data if self.out else None, self.tail_in.data if self.in_ and self.closed else None)


_SUMMARY = ("file string, block long, valid boolean, crlf boolean, records long, from_out boolean, from_in boolean, closed boolean, "
            "head binary, tail_out binary, tail_in binary")
_SUMMARY_TYPES = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.binary(),
                  pa.binary(), pa.binary()]


def _valid(column: pa.Array) -> bool:
    try:
        column.cast(pa.string())
        return True
    except pa.ArrowInvalid:
        return False


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, block, lines) of stretches of one block, in file order."""
    for batch in batches:
        starts = batch.column(1).to_pylist()
        files = batch.column(0).dictionary_encode()
        codes = files.indices.to_pylist()
        at = 0
        while at < len(starts):
            end = at + 1
            if (starts[-1], codes[-1]) == (starts[at], codes[at]):
                end = len(starts)
            else:
                while (starts[end], codes[end]) == (starts[at], codes[at]):
                    end += 1
            yield files.dictionary[codes[at]].as_py(), starts[at], batch.column(2).slice(at, end - at)
            at = end


def _summarize(bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def done(s: _Summary) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(s.row(), _SUMMARY_TYPES)],
                                              [c.split()[0] for c in _SUMMARY.split(", ")])

        for file, block, lines in _blocks(batches):
            if now is None or (now.file, now.block) != (file, block):
                if now is not None:
                    yield done(now)
                now = _Summary(file, block, bound)
            now.valid = now.valid and _valid(lines)
            for line in lines.to_pylist():
                now.line(line)
        if now is not None:
            yield done(now)
    return run


def _records(states, pieces: bool):
    """Pass 2: the records inside each block, or (``pieces``) the pieces of those that cross its borders."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kinds = states.value
        now, open_, inside, owner, part, skip = None, [], False, 0, 0, False

        def emit(out: list[bytes], file: str, owners=(), parts=()) -> pa.RecordBatch:
            n = len(out)
            return pa.RecordBatch.from_arrays(
                [pa.array([file] * n, pa.string()), pa.array([kinds.get(file, 0)] * n, pa.int32()), pa.array(owners if pieces else [0] * n, pa.int64()),
                 pa.array(parts if pieces else [0] * n, pa.int64()), pa.array(out, pa.binary())],
                ["file", "how", "owner", "part", "record"])

        for file, block, lines in _blocks(batches):
            if now != (file, block):
                if pieces and open_:
                    yield emit([b"\n".join(open_)], now[0], [owner], [part])
                if (file, block) not in known:
                    raise RuntimeError(f"the blocks of {file} have moved between two passes; read it again")
                now, open_ = (file, block), []
                inside, owner = known[now]
                owner = owner if inside else block
                part, head, skip = block, inside, block == 0 and not inside
            out, owners, parts = [], [], []
            for line in lines.to_pylist():
                if b'"' in line:
                    inside = ends_inside(line, inside)
                if inside or open_ or head:
                    open_.append(line)
                    if inside:
                        continue
                    line, open_ = b"\n".join(open_), []
                    if head:  # the end of a record that began in an earlier block
                        head = False
                        if pieces:
                            out.append(line)
                            owners.append(owner)
                            parts.append(part)
                        owner = block
                        continue
                owner = block
                if line in (b"", b"\r"):
                    continue
                if not skip and not pieces:
                    out.append(line)
                skip = False  # the header has gone by
            if out:
                yield emit(out, file, owners, parts)
        if pieces and open_:
            yield emit([b"\n".join(open_)], now[0], [owner], [part])
    return run


@contextmanager
def _pinned(spark: SparkSession, block_bytes: int):
    """Settings under which every scan of the same files makes the same blocks."""
    names = {"spark.sql.files.maxPartitionBytes": str(block_bytes),
             "spark.sql.files.minPartitionNum": str(max(1, spark.sparkContext.defaultParallelism)),
             "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _composed(rows: list) -> dict[tuple[str, int], tuple[bool, int]]:
    """(file, block) -> does it start inside quotes, and the block in which the record open there began."""
    out, file, inside, owner = {}, None, False, 0
    for r in sorted(rows, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, inside, owner = r["file"], False, 0
        out[file, r["block"]] = inside, owner
        if r["closed"] or not inside:  # some record ends here, so the next open one begins here
            owner = r["block"]
        inside = r["from_in"] if inside else r["from_out"]
    return out


def read_blocks(spark: SparkSession, path: str | list[str], options: dict, block_bytes: int,
                fallback: str | None = "ISO-8859-1", piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Rows (string columns) of the CSV files under ``path``, all with the header of the first file.

    ``options`` are those of Spark's CSV reader.  Files that are not valid UTF-8 are read
    in ``fallback`` (None: ValueError).  What reaches the driver is one small row per block.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"))
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    # a task per block would cost more to start than its block to read, and leave a file per block
    lines = lines.coalesce(max(4 * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))
    with _pinned(spark, block_bytes):
        kept = scratch_path(spark, "csv-blocks")
        lines.mapInArrow(_summarize(piece_bytes), _SUMMARY).write.parquet(kept)
        blocks = spark.read.parquet(kept)
        rows = blocks.select("file", "block", "valid", "crlf", "from_out", "from_in", "closed").collect()
        latin = {r["file"] for r in rows if not r["valid"]}
        if latin and fallback is None:
            raise ValueError("File is not valid UTF-8 and no fallback encoding was allowed.")
        plain = sorted({r["file"] for r in rows} - latin)
        columns = spark.read.options(**options).option("encoding", "UTF-8" if plain else fallback or "UTF-8").csv(
            plain[:1] or path).schema
        crlf = {r["file"] for r in rows if r["block"] == 0 and r["crlf"]}
        starts = _composed(rows)
        how = {f: (f in latin) * _LATIN + (f in crlf) * _CRLF for f in latin | crlf}
        states = spark.sparkContext.broadcast((starts, how))
        schema = "file string, how int, owner long, part long, record binary"
        whole = lines.mapInArrow(_records(states, False), schema)
        table = spark.createDataFrame([(f, how.get(f, 0), b, i, o) for (f, b), (i, o) in starts.items()],
                                      "file string, how int, block long, inside boolean, owner long")
        pieces = blocks.join(table, ["file", "block"]).selectExpr(
            "file", "how", "block", "CASE WHEN inside THEN head END AS head", "inside", "owner",
            "CASE WHEN inside THEN tail_in ELSE tail_out END AS tail",
            "CASE WHEN inside THEN from_in AND closed ELSE from_out END AS open", "records")
        lost = pieces.where("(inside AND head IS NULL) OR (open AND tail IS NULL)")
        if lost.isEmpty():
            crossing = pieces.where("inside").selectExpr("file", "how", "owner", "block AS part", "head AS record").unionByName(
                pieces.where("open").selectExpr("file", "how", "block AS owner", "block AS part", "tail AS record"))
        else:
            crossing = lines.mapInArrow(_records(states, True), schema)
        joined = crossing.groupBy("file", "how", "owner").agg(F.sort_array(F.collect_list(F.struct("part", "record"))).alias("p"))
        # a header longer than the first block is such a record too
        headers = pieces.where("block = 0 AND NOT inside AND open AND records = 0").select("file", F.lit(0).alias("owner"))
        joined = joined.join(headers, ["file", "owner"], "left_anti").select(
            "how", F.unhex(F.expr("array_join(transform(p, x -> hex(x.record)), '0A')")).alias("record"))
        record = F.col("record").cast("string")
        if latin:
            record = F.when(F.col("how").bitwiseAND(_LATIN) > 0, F.decode("record", fallback)).otherwise(record)
        text = F.when(F.endswith(record, F.lit("\r")), F.left(record, F.length(record) - 1)).otherwise(record)
        text = F.when(F.col("how").bitwiseAND(_CRLF) > 0, F.replace(text, F.lit("\r\n"), F.lit("\n"))).otherwise(text)
        ddl = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in columns.fields)
        parsed = whole.select("how", "record").unionByName(joined).select(F.from_csv(text, ddl, options).alias("r")).select("r.*")
        out = scratch_path(spark, "csv-rows")
        parsed.write.parquet(out)
    return spark.read.schema(parsed.schema).parquet(out)
