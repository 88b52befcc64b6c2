"""Consolidating many small files: planning over file listings, and joining the bytes.

The plan never opens a file: it works on the listing.  The merge joins whole files
byte by byte, newline-delimited text at record ends and zstandard files at frame ends,
without parsing a record, and checks lengths and checksums.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodevec.sources.files import place

SMALL_BYTES = 16 * 1024 * 1024
TARGET_BYTES = 128 * 1024 * 1024
SPLIT_FILES = 4096

ZSTD_MAGIC = 0xFD2FB528
ZSTD_SKIPPABLE = range(0x184D2A50, 0x184D2A60)
# A frame of one segment of one byte, in one raw and last block: a line end.
NEWLINE_FRAME = struct.pack("<IBB", ZSTD_MAGIC, 0x20, 1) + (1 << 3 | 1).to_bytes(3, "little") + b"\n"
CHUNK = 1 << 20


def plain_path(path: Column, warehouse: str = "warehouse") -> Column:
    """Path relative to the warehouse, without scheme, prefix, double slashes or escapes.

    Escapes are undone where they are well formed (``+`` is no escape); null stays null.
    """
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    bare = F.regexp_replace(decoded, r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?", "")
    slashes = F.regexp_replace(F.regexp_replace(bare, r"(^|/)(\./)+", "$1"), "/+", "/")
    return F.regexp_replace(slashes, rf"^/?({warehouse}/)?", "")


def listed_files(index: DataFrame, path: str = "path", warehouse: str = "warehouse") -> DataFrame:
    """One row for each file, whatever its spellings; the listings of one file agree."""
    return index.withColumn(path, plain_path(F.col(path), warehouse)).dropDuplicates(["table_key", path])


def plan_merge(
    files: DataFrame,
    small: int = SMALL_BYTES,
    target: int = TARGET_BYTES,
    split: int = SPLIT_FILES,
    group: tuple[str, ...] = ("table_key", "partition_value"),
    path: str = "path",
    size: str = "file_size_bytes",
    rows: str = "record_count",
) -> DataFrame:
    """Assign every small file of a group of two or more to one target file.

    Result: the group's columns, path, size, rows, ``target_no``, ``target_offset`` (first byte in the target), and of the whole target ``target_files``, ``target_bytes``,
    ``target_rows`` (null if a count is unknown).  The files of a group lie end to end: a running sum within parts of about ``split`` files, by a hash of the path, on
    top of the sums of the parts before, one row each; so no task holds an unbounded group, and targets go on across parts.  A target closes when the
    next file begins at or after a multiple of ``target``, which must be twice ``small`` or more; a last target of a
    single file joins the one before it.  Files of unknown size, inactive or large ones, and
    those alone in their group are left out; null is one partition value.
    """
    if target < 2 * small:
        raise ValueError("a target must hold two small files")
    able = files.where(
        F.col("active") & (F.col(size) > 0) & (F.col(size) < small) & F.col(path).isNotNull()
    ).select(*group, path, size, rows)
    counts = able.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= 2)
    able = _with(able, counts, group)
    able = able.withColumn("__part", F.pmod(F.xxhash64(path), F.greatest(F.ceil(F.col("__n") / split), F.lit(1))))
    run = Window.partitionBy(*group, "__part").orderBy(F.col(size).desc(), F.col(path))
    able = able.withColumn("__inner", F.coalesce(F.sum(size).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # only groups of several parts have sums before a part
    parts = able.where(F.col("__n") > split).groupBy(*group, "__part").agg(F.sum(size).alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*group, "__part", F.coalesce(before, F.lit(0)).alias("__outer"))
    able = _with(able, parts, (*group, "__part"), "left").withColumn("__before", F.col("__inner") + F.coalesce("__outer", F.lit(0)))
    able = able.withColumn("__bin", F.floor(F.col("__before") / target))
    alone = F.count(F.lit(1)).over(Window.partitionBy(*group, "__bin")) == 1
    able = able.withColumn("target_no", F.when(alone & (F.col("__bin") > 0), F.col("__bin") - 1).otherwise(F.col("__bin")))
    whole = Window.partitionBy(*group, "target_no")  # bounded by the bytes of a target
    return able.select(
        *group,
        path,
        size,
        rows,
        "target_no",
        (F.col("__before") - F.min("__before").over(whole)).alias("target_offset"),
        F.count(F.lit(1)).over(whole).alias("target_files"),
        F.sum(size).over(whole).alias("target_bytes"),
        F.when(F.count(rows).over(whole) == F.count(F.lit(1)).over(whole), F.sum(rows).over(whole)).alias("target_rows"),
    )


def _with(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Join on keys of which null is one value; only the columns of the right side that are no keys are added."""
    more = [c for c in right.columns if c not in keys]
    right = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *more)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(right, same, how).select(*left.columns, *more)


def checked_plan(plan: DataFrame, path: str = "path", size: str = "file_size_bytes") -> DataFrame:
    """The plan, or an error if the files of a target do not lie end to end: two or more, none before its first byte, no gap and no overlap up to its last."""
    group = [c for c in plan.columns if c not in (path, size, "record_count", "target_no", "target_offset", "target_files", "target_bytes", "target_rows")]
    whole = Window.partitionBy(*group, "target_no")
    end = F.lag(F.col("target_offset") + F.col(size)).over(whole.orderBy("target_offset"))
    last = F.max(F.col("target_offset") + F.col(size)).over(whole)
    sound = (F.col("target_files") >= 2) & (F.col("target_offset") == F.coalesce(end, F.lit(0))) & (last == F.col("target_bytes"))
    return plan.withColumn("__sound", sound).where(F.when(F.col("__sound"), True).otherwise(F.raise_error(F.lit("files of a target do not lie end to end")))).drop("__sound")


def _frames(f) -> list[int]:
    """First bytes of the zstandard frames of an open file; an error unless it is a run of complete frames.  Only headers are read."""
    n, at, starts = f.size(), 0, []

    def part(at: int, length: int) -> bytes:
        f.seek(at)
        return f.read(length)

    while at < n:
        head = part(at, 8)
        if len(head) < 8:
            raise ValueError("cut frame header")
        magic = struct.unpack_from("<I", head)[0]
        if magic in ZSTD_SKIPPABLE:
            at += 8 + struct.unpack_from("<I", head, 4)[0]
            continue
        if magic != ZSTD_MAGIC:
            raise ValueError("no zstandard frame")
        starts.append(at)
        flags = head[4]
        single, checksum = flags >> 5 & 1, flags >> 2 & 1
        size_bytes = (single, 2, 4, 8)[flags >> 6]
        at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + size_bytes
        while True:
            block = part(at, 3)
            if len(block) < 3:
                raise ValueError("cut block")
            head = int.from_bytes(block, "little")
            last, kind, length = head & 1, head >> 1 & 3, head >> 3
            at += 3 + (1 if kind == 1 else length)
            if last:
                break
        at += 4 * checksum
    if at != n:
        raise ValueError("cut frame")
    return starts


def _last_byte(f, starts: list[int]) -> bytes:
    """The last byte of what the frames hold: only the last frame with content is expanded, block by block."""
    import zstandard

    for start in reversed(starts):
        f.seek(start)
        stream, last = zstandard.ZstdDecompressor().stream_reader(f, closefd=False), b""
        while block := stream.read(CHUNK):
            last = block[-1:]
        if last:
            return last
    return b""


def write_lines(rows: DataFrame, root: str) -> DataFrame:
    """Write the ``record`` of each row as a line of ``root/path``, by row_no; (table_key, path, record_count, file_size_bytes) of each file.

    Line ends inside a record become blanks.  A file is made from the rows of one path, which is one task's work; a task that runs
    again writes the same file.
    """

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row_no", "record"])
        name = key[1].lstrip("/")
        data = "".join(r.replace("\r", " ").replace("\n", " ") + "\n" for r in pdf["record"]).encode()
        files, at = place(f"{root}/{name}")
        files.create_dir(at.rpartition("/")[0], recursive=True)
        part = f"{at}.{uuid.uuid4().hex}.part"
        with files.open_output_stream(part) as f:
            f.write(data)
        files.move(part, at)
        return pd.DataFrame({"table_key": [key[0]], "path": [name], "record_count": [len(pdf)], "file_size_bytes": [len(data)]})

    return rows.groupBy("table_key", "path").applyInPandas(write, "table_key string, path string, record_count long, file_size_bytes long")


def join_files(sources: Iterable[str], out: str, header: bool = False, sizes: Iterable[int | None] | None = None, rows: Iterable[int | None] | None = None) -> dict:
    """Join files of one kind into ``out``; give the bytes, sources, line ends and CRC of the result.

    ``*.zst``: each source must be whole frames, which are appended as they are; where the last record has no newline, a frame with one follows. Headers
    would have to be expanded, so ``header`` is an error, and ``lines`` is null.  Other files: newline-delimited; a missing last newline is supplied, so
    that no record runs into the next, and with ``header`` the first line of all but the first file must be
    the same and is left out.  Empty files add nothing.  A source that has not the bytes or lines (``sizes``, ``rows``, where known) it is listed with is an error.  The
    result is read again and compared by length and CRC before it gets its name; on any failure nothing is left.  Files are read in blocks.
    """
    files, whole = place(out)
    part, total, crc, n, lines, first = f"{whole}.{uuid.uuid4().hex}.part", 0, 0, 0, 0, None
    packed = whole.endswith(".zst")
    if packed and header:
        raise ValueError("headers of compressed files cannot be left out")
    sources = list(sources)
    listed = list(zip(sources, sizes or [None] * len(sources), rows or [None] * len(sources), strict=True))
    try:
        with files.open_output_stream(part) as to:

            def write(data: bytes) -> None:
                nonlocal total, crc
                to.write(data)
                total += len(data)
                crc = zlib.crc32(data, crc)

            for source, size, count in listed:
                from_, at = place(source)
                with from_.open_input_file(at) as f:
                    if size is not None and f.size() != size:
                        raise ValueError(f"{source} has {f.size()} bytes, not {size}")
                    n += 1
                    if packed:
                        end = _last_byte(f, _frames(f))
                        f.seek(0)
                        while data := f.read(CHUNK):
                            write(data)
                        if end not in (b"", b"\n"):
                            write(NEWLINE_FRAME)
                        continue
                    held, last, skip = 0, b"", header
                    line = b""
                    while data := f.read(CHUNK):
                        last = data[-1:]
                        held += data.count(b"\n")
                        if skip:
                            line += data
                            if b"\n" not in line:
                                continue
                            head, _, data = line.partition(b"\n")
                            skip = False
                            if first is None:
                                first = head.rstrip(b"\r")
                                data = head + b"\n" + data
                            elif head.rstrip(b"\r") != first:
                                raise ValueError(f"header of {source} differs")
                        if data:
                            write(data)
                    if skip and line:  # a header without an end
                        if first is not None and line.rstrip(b"\r") != first:
                            raise ValueError(f"header of {source} differs")
                        if first is None:
                            first = line.rstrip(b"\r")
                            write(line + b"\n")
                        lines += 1
                        last = b""
                    elif last not in (b"", b"\n"):
                        write(b"\n")
                        held += 1
                    if count is not None and held != count + bool(header):
                        raise ValueError(f"{source} has {held} lines, not {count}")
                    lines += held
        again, length = 0, 0
        with files.open_input_stream(part) as f:
            while block := f.read(CHUNK):
                again = zlib.crc32(block, again)
                length += len(block)
        if length != total or again != crc:
            raise OSError(f"{out}: what was written differs from what was read")
        files.move(part, whole)
    except BaseException:
        try:
            files.delete_file(part)
        except OSError:
            pass
        raise
    return {"bytes": total, "sources": n, "lines": None if packed else lines, "crc32": crc}


def merge_files(plan: DataFrame, root: str, out: str, header: bool = False, count_lines: bool = False) -> DataFrame:
    """Carry out a plan over files below ``root`` (a folder that all executors see, by path or URI).

    One row for each target: the group's columns, path, bytes, number of sources, lines, CRC.  Each source must have the bytes it is listed with, and with
    ``count_lines`` its lines must be its record count.  The rows of a target are
    bounded by the plan (its bytes), so each is one task's work; a task that runs again
    writes the same file again under the same name.
    """
    own = ("path", "file_size_bytes", "record_count", "target_no", "target_offset", "target_files", "target_bytes", "target_rows")
    group = [c for c in plan.columns if c not in own]
    source = F.struct("target_offset", "path", "file_size_bytes", "record_count")
    targets = plan.groupBy(*group, "target_no").agg(F.sort_array(F.collect_list(source)).alias("__sources"))
    # null and the empty text must not give one name
    name = F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")), F.lit("null")) for g in group], "target_no")
    # targets are few and heavy: spread them evenly over the tasks
    targets = targets.select(*group, F.hex(name).alias("__name"), "__sources").repartition("__name")
    kinds = {f.name: f.dataType.simpleString() for f in plan.schema.fields}

    def run(batches: Iterator) -> Iterator:
        files, folder = place(out)
        files.create_dir(folder, recursive=True)
        for pdf in batches:
            done = []
            for key, sources in zip(pdf["__name"], pdf["__sources"]):
                suffixes = {os.path.splitext(s["path"])[1] for s in sources}
                if len(suffixes) != 1:
                    raise ValueError(f"files of several kinds in one target: {sorted(suffixes)}")
                to = f"{out}/merged-{key}{suffixes.pop()}"
                counts = [s["record_count"] for s in sources] if count_lines else None
                done.append({"path": to, **join_files([f"{root}/{s['path']}" for s in sources], to, header, [s["file_size_bytes"] for s in sources], counts)})
            got = pd.DataFrame(done, columns=["path", "bytes", "sources", "lines", "crc32"])
            got["lines"] = got["lines"].astype("Int64")
            yield pd.concat([pdf[group].reset_index(drop=True), got], axis=1)

    schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in group), "path string, bytes long, sources long, lines long, crc32 long"])
    return targets.mapInPandas(run, schema)
