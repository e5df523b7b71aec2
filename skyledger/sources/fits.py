"""FITS files as tables: listings, header cards, image planes.

Files are listed by Spark; tasks then open them through the file system of
their address (local, HDFS, S3 and others that Arrow knows) and read only the
header blocks, skipping data by seeking. Records are cut, parsed, joined over CONTINUE
and checked by native expressions (operators.headers).
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators import headers

BLOCK, CARD = 2880, 80
_HEADERS = "path string, file_bytes bigint, hdu int, header_offset bigint, header string, data_offset bigint, data_bytes bigint, issue string"
# Number types of BITPIX.
TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def list_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, file_bytes of the FITS files of a folder; hidden files and folders are left out, contents aren't read.

    Spark lists no files of zero bytes.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", F.col("length").alias("file_bytes"))
    # what of the path lies inside the folder, which may be given with or without its file system
    inside = F.substring_index("path", re.sub("^[a-z0-9]+:/*", "/", folder.rstrip("/")), -1)
    return found.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin("fit", "fits", "fts", "fz") & ~inside.rlike(r"/\.[^/]*"))


def _open(path: str):
    """The file at an address, for reading at any place."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(unquote("/" + path[5:].lstrip("/")))
    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


def _number(header: str, key: str, default: int = 0) -> int:
    for at in range(0, len(header), CARD):
        if header[at : at + 10] == f"{key:<8}= ":
            try:
                return int(float(header[at + 10 : at + CARD].split("/")[0]))
            except ValueError:
                return default
    return default


def resolve(spark: SparkSession, inputs: list[str], roots: list[str] | None = None, most: int = 10_000) -> DataFrame:
    """As list_files, of files and folders (of those the files inside, not below), each once, sorted by path.

    roots: where set, folders that every input must lie in. More than `most`
    files is an error, not a shorter list.
    """
    for given in inputs:
        parts = re.sub("^[a-z0-9]+:/*", "/", given).split("/")
        if roots is not None and (".." in parts or not any(f"{given.rstrip('/')}/".startswith(f"{r.rstrip('/')}/") for r in roots)):
            raise ValueError(f"{given} is in none of the allowed folders")
    found = None
    for given in inputs:
        one = list_files(spark, given, recursive=False)
        found = one if found is None else found.unionByName(one)
    found = found.dropDuplicates(["path"])
    if found.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} files")
    return found.orderBy("path")


#: Bytes outside the printable ones become ?.
PRINTABLE = bytes(b if 32 <= b <= 126 else 63 for b in range(256))


def _sizes(header: str):
    """Whole numbers of a header's keywords, read in one go; of a keyword given twice the first."""
    told: dict[str, str] = {}
    for at in range(0, len(header), CARD):
        if header[at + 8 : at + 10] == "= ":
            told.setdefault(header[at : at + 8].rstrip(), header[at + 10 : at + CARD])

    def number(key: str, default: int = 0) -> int:
        try:
            return int(float(told[key].split("/")[0])) if key in told else default
        except ValueError:
            return default

    return number


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The header text and the place of the data of each unit, one block at a time."""
    for files in batches:
        rows = []
        for path, size in zip(files["path"], files["file_bytes"]):
            with _open(path) as f:
                at, hdu = 0, 0
                while at < size:
                    f.seek(at)
                    head, ended = b"", False
                    while not ended and (block := f.read(BLOCK)):
                        if not head and not block.startswith(b"SIMPLE  = " if hdu == 0 else b"XTENSION= "):
                            break
                        head += block
                        ended = any(block[k : k + 8] == b"END     " for k in range(0, len(block), CARD))
                    if not head:
                        rows.append((path, size, hdu, at, "", at, 0, "not_fits" if hdu == 0 else "trailing_bytes"))
                        break
                    text = head.translate(PRINTABLE).decode("ascii")
                    size_of = _sizes(text)
                    axes = [size_of(f"NAXIS{i + 1}") for i in range(size_of("NAXIS"))]
                    n = int(np.prod(axes)) if axes else 0
                    data = abs(size_of("BITPIX")) // 8 * size_of("GCOUNT", 1) * (size_of("PCOUNT") + n) if axes else 0
                    start = at + len(head)
                    issue = "missing_end" if not ended else "truncated_data" if start + data > size else None
                    rows.append((path, size, hdu, at, text, start, data, issue))
                    if not ended:
                        break
                    at, hdu = start + -(-data // BLOCK) * BLOCK, hdu + 1
        yield pd.DataFrame(rows, columns=["path", "file_bytes", "hdu", "header_offset", "header", "data_offset", "data_bytes", "issue"])


def hdus(files: DataFrame) -> DataFrame:
    """path, file_bytes, hdu, header_offset, header, data_offset, data_bytes, issue of every unit."""
    return files.select("path", "file_bytes").mapInPandas(_walk, _HEADERS)


def layout_issues(units: DataFrame, cards_of: DataFrame) -> DataFrame:
    """path, hdu, code, what of the structural faults of each unit: those met while reading, required keywords that lack, keywords given twice, sizes that are no whole blocks."""
    met = units.filter("issue IS NOT NULL").select("path", "hdu", F.col("issue").alias("code"), F.lit("").alias("what"))
    required = F.when(F.col("hdu") == 0, F.array(*map(F.lit, ["SIMPLE", "BITPIX", "NAXIS"]))).otherwise(F.array(*map(F.lit, ["XTENSION", "BITPIX", "NAXIS", "PCOUNT", "GCOUNT"])))
    have = cards_of.filter(F.coalesce("value_type", F.lit("")) != "commentary").groupBy("path", "hdu").agg(F.collect_set("keyword").alias("have"))
    lacking = units.filter("header <> ''").select("path", "hdu").join(have, ["path", "hdu"], "left").select("path", "hdu", F.explode(F.array_except(required, F.coalesce("have", F.array().cast("array<string>")))).alias("what"))
    twice = cards_of.filter((F.coalesce("value_type", F.lit("")) != "commentary") & ~F.col("keyword").isin("", "COMMENT", "HISTORY")).groupBy("path", "hdu", F.col("keyword").alias("what")).count().filter("count > 1")
    odd = units.groupBy("path").agg(F.max("file_bytes").alias("n")).filter(F.col("n") % BLOCK != 0).select("path", F.lit(0).alias("hdu"), F.lit("size_not_block_multiple").alias("code"), F.lit("").alias("what"))
    parts = [met, lacking.select("path", "hdu", F.lit("missing_required").alias("code"), "what"), twice.select("path", "hdu", F.lit("duplicate_keyword").alias("code"), "what"), odd]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def listing(spark: SparkSession, folder: str, rules: list = (), recursive: bool = True) -> DataFrame:
    """A folder as the table that folder questions are asked of: one row a file, facts from its header and name, verdict, scale and night."""
    from skyledger.operators import canonical, classify
    from skyledger.session import cut

    units = cut(hdus(list_files(spark, folder, recursive)))
    own = cards(units).withColumnRenamed("path", "frame_id")
    shape = _shape(cards(units))
    heads = canonical.headers_of(own, shape)
    names = units.groupBy("path").agg(F.max("file_bytes").alias("bytes"), F.max(F.when(F.col("hdu") == 0, F.col("issue"))).alias("error"))
    image = shape.filter(F.size("shape") > 0).groupBy("frame_id").agg(F.min_by(F.struct("shape", "bitpix"), "hdu").alias("x"))
    files = names.select(F.col("path").alias("frame_id"), "path", F.regexp_replace("path", r"^.*[/\\]", "").alias("name"), "bytes", "error").join(image, "frame_id", "left")
    files = files.withColumns({"size": F.slice("x.shape", 1, 2), "planes": F.when(F.size("x.shape") > 2, F.get("x.shape", F.lit(2))).otherwise(1)}).drop("x")
    facts = canonical.facts(files.select("frame_id", "name", "planes"), heads, list(rules))
    told = facts.select("frame_id", F.col("exposure_s.value").alias("exposure_s"), F.col("stack_count.value").alias("stack_count"), F.col("object.value").alias("object")).join(files.select("frame_id", "name"), "frame_id")
    verdicts = classify.verdicts(told, own.select("frame_id", "hdu", "record", "keyword", "value_type", "value_text"), shape)
    return canonical.entries(facts, files.drop("planes"), verdicts)


def _shape(cards_of: DataFrame) -> DataFrame:
    """frame_id, hdu, kind, bitpix, shape of each unit, from its own or, of a compressed image, the image's keywords."""
    number = F.col("value_text").try_cast("bigint")
    of = lambda key: F.min_by(number, F.when(F.col("keyword") == key, F.col("record")))
    compressed = F.max(F.coalesce((F.col("keyword") == "ZIMAGE") & (F.trim("value_text") == "T"), F.lit(False)))
    table = F.max(F.coalesce((F.col("keyword") == "XTENSION") & F.col("value_text").contains("BINTABLE"), F.lit(False)))
    axes = lambda p: F.transform(F.array_sort(F.collect_list(F.when(F.col("keyword").rlike(f"^{p}[0-9]+$"), F.struct(F.regexp_extract("keyword", "([0-9]+)$", 1).cast("int").alias("i"), number.alias("n"))))), lambda x: x["n"])
    g = cards_of.groupBy(F.col("path").alias("frame_id"), "hdu").agg(compressed.alias("z"), table.alias("t"), of("BITPIX").alias("bits"), of("ZBITPIX").alias("zbits"), axes("NAXIS").alias("axes"), axes("ZNAXIS").alias("zaxes"))
    kind = F.when(F.col("z"), "compressed_image").when(F.col("t"), "bin_table").when(F.col("hdu") == 0, "primary").otherwise("image")
    shape = F.when(F.col("z"), F.col("zaxes")).when(~F.col("t"), F.col("axes")).otherwise(F.array().cast("array<bigint>"))
    return g.select("frame_id", "hdu", kind.alias("kind"), F.when(F.col("z"), F.col("zbits")).otherwise(F.col("bits")).alias("bitpix"), shape.alias("shape"))


def cards(units: DataFrame) -> DataFrame:
    """path, hdu, record, keyword, value_type, value_text, note, hierarch of every card before END; CONTINUE lines are joined on.

    All within a header's row: nothing is shuffled.
    """
    n = F.floor(F.length("header") / CARD).cast("int")
    lines = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(F.col("header"), (i - 1) * CARD + 1, F.lit(CARD)))
    cutup = units.filter(n > 0).select("path", "hdu", lines.alias("lines"))
    end = F.array_position(F.transform("lines", lambda x: F.rtrim(x)), "END").cast("int")
    cutup = cutup.select("path", "hdu", F.when(end > 0, F.slice("lines", F.lit(1), end - 1)).otherwise(F.col("lines")).alias("lines"))
    more = lambda x: F.coalesce(x.startswith("CONTINUE"), F.lit(False))

    def card(x: Column, i: Column) -> Column:
        # a card is its line and the run of CONTINUE lines behind it, which few have
        behind = F.slice("lines", i + 2, F.size("lines"))
        stop = F.array_position(F.transform(behind, lambda y: more(y)), False).cast("int")
        run = F.when(stop > 0, F.slice(behind, F.lit(1), stop - 1)).otherwise(behind)
        whole = F.when(more(F.get(F.col("lines"), i + 1)), F.concat(F.array(x), run)).otherwise(F.array(x))
        return F.when(~(more(x) & (i > 0)) & (F.trim(x) != ""), F.struct(i.cast("int").alias("record"), whole.alias("records")))

    told = cutup.select("path", "hdu", F.explode(F.array_compact(F.transform("lines", card))).alias("x")).select("path", "hdu", "x.record", headers.parse_records(F.col("x.records")).alias("c"))
    return told.select("path", "hdu", "record", "c.keyword", "c.value_type", "c.value_text", "c.note", "c.hierarch")


def planes(units: DataFrame) -> DataFrame:
    """path, hdu, width, height, plane, data (array of float): the images of plain units, a row a plane.

    Values are BZERO + BSCALE times the stored ones. Units without an image
    and those whose data is cut short give no row.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            for r in some.itertuples():
                bits, axes = _number(r.header, "BITPIX"), [_number(r.header, f"NAXIS{i + 1}") for i in range(_number(r.header, "NAXIS"))]
                if len(axes) < 2 or bits not in TYPES or r.issue or r.header.startswith("XTENSION= 'BINTABLE"):
                    continue
                scale, zero = _float(r.header, "BSCALE", 1.0), _float(r.header, "BZERO", 0.0)
                w, h = axes[:2]
                with _open(r.path) as f:
                    for plane in range(int(np.prod(axes[2:]))):
                        f.seek(r.data_offset + plane * w * h * abs(bits) // 8)
                        raw = np.frombuffer(f.read(w * h * abs(bits) // 8), dtype=TYPES[bits]).astype(np.float64)
                        yield pd.DataFrame({"path": [r.path], "hdu": [r.hdu], "width": [w], "height": [h], "plane": [plane], "data": [(zero + scale * raw).astype(np.float32)]})

    return units.mapInPandas(decode, "path string, hdu int, width int, height int, plane int, data array<float>")


def _float(header: str, key: str, default: float) -> float:
    for at in range(0, len(header), CARD):
        if header[at : at + 10] == f"{key:<8}= ":
            try:
                return float(header[at + 10 : at + CARD].split("/")[0].replace("D", "E"))
            except ValueError:
                return default
    return default
