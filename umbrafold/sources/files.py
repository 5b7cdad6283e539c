"""File sources and sinks: PNM and FITS images, .cube tables, CSV data sets, folder listings, journals."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DECODED = "path string, width int, height int, channels int, depth int, samples array<int>, error string"
# First bytes of image formats.
MAGIC = {"png": "89504E47", "jpeg": "FFD8FF", "gif": "47494638", "bmp": "424D", "tiff_le": "49492A00", "tiff_be": "4D4D002A", "psd": "38425053", "webp": "52494646", "fits": "53494D504C45"}


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files of one folder by name, not of those below it: (path, length, extension)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    return files.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))).orderBy("path")


def sniffed(binary: DataFrame) -> DataFrame:
    """binaryFile rows with the format that the first bytes tell, or null."""
    head = F.hex(F.substring("content", 1, 8))
    kind = F.coalesce(*[F.when(head.startswith(m), F.lit(k)) for k, m in MAGIC.items()], F.when(F.substring("content", 1, 2).cast("string").rlike("^P[1-6]$"), F.lit("pnm")))
    return binary.withColumn("format", kind)


_HEADER = re.compile(rb"(?:\s+|#[^\n]*\n)*([0-9]+)")


def decode_pnm(content: bytes) -> tuple[int, int, int, int, np.ndarray]:
    """Width, height, channels, the largest value and the samples of P1 to P6."""
    kind = content[:2]
    if len(content) < 3 or kind[:1] != b"P" or not b"1" <= kind[1:] <= b"6":
        raise ValueError("not a PNM file")
    fields, at = [], 2
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _HEADER.match(content, at)
        if not m:
            raise ValueError("the header ends early")
        fields.append(int(m[1]))
        at = m.end()
    width, height = fields[:2]
    most, channels = (fields[2] if len(fields) > 2 else 1), 3 if kind in (b"P3", b"P6") else 1
    n = width * height * channels
    if kind in (b"P1", b"P2", b"P3"):
        digits = re.findall(rb"[01]" if kind == b"P1" else rb"[0-9]+", re.sub(rb"#[^\n]*", b"", content[at:]))
        samples = np.array(digits[:n], np.int64)
    elif kind == b"P4":
        rows = np.frombuffer(content, np.uint8, (width + 7) // 8 * height, at + 1).reshape(height, -1)
        samples = np.unpackbits(rows, axis=1)[:, :width].ravel()
    else:
        samples = np.frombuffer(content, ">u2" if most > 255 else np.uint8, n, at + 1)
    if len(samples) < n:
        raise ValueError("the samples end early")
    return width, height, channels, most, 1 - samples if kind in (b"P1", b"P4") else samples


def decode_fits(content: bytes) -> tuple[int, int, int, int, np.ndarray]:
    """The first two axes of the primary array, stretched from their least and largest finite value to 0..65535."""
    cards, at = {}, 0
    while True:
        block = content[at : at + 2880]
        if len(block) < 2880:
            raise ValueError("the header ends early")
        at += 2880
        for k in range(0, 2880, 80):
            card = block[k : k + 80].decode("ascii", "replace")
            if card[8:10] == "= ":
                cards[card[:8].strip()] = card[10:].split("/")[0].strip()
        if any(block[k : k + 8] == b"END     " for k in range(0, 2880, 80)):
            break
    width, height = int(cards["NAXIS1"]), int(cards.get("NAXIS2", 1))
    kind = {8: np.dtype("u1"), 16: np.dtype(">i2"), 32: np.dtype(">i4"), 64: np.dtype(">i8"), -32: np.dtype(">f4"), -64: np.dtype(">f8")}[int(cards["BITPIX"])]
    raw = np.frombuffer(content, kind, width * height, at).astype(float) * float(cards.get("BSCALE", 1)) + float(cards.get("BZERO", 0))
    real = raw[np.isfinite(raw)]
    low, span = (real.min(), np.ptp(real)) if len(real) else (0.0, 0.0)
    stretched = np.where(np.isfinite(raw), (raw - low) / span if span else 0.0, 0.0)
    return width, height, 1, 65535, np.floor(stretched * 65535 + 0.5).astype(np.int64)


def read_images(spark: SparkSession, path: str, decode=decode_pnm) -> DataFrame:
    """DECODED rows; a file that can't be decoded has its reason in error and no samples."""

    def run(batches):
        for batch in batches:
            rows = []
            for content in batch.column("content").to_pylist():
                try:
                    w, h, c, d, s = decode(content)
                    rows.append((w, h, c, d, s.astype(np.int32), None))
                except (ValueError, KeyError, IndexError) as e:
                    rows.append((None, None, None, None, None, str(e)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string())
            yield pa.record_batch([batch.column("path"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["path", "width", "height", "channels", "depth", "samples", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, DECODED)


def encoded_pnm(images: DataFrame) -> DataFrame:
    """(name, width, height, channels, samples 0..255) to (name, content): binary P5 or P6."""
    samples = F.unhex(F.array_join(F.transform("samples", lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    head = F.concat(F.when(F.col("channels") == 3, "P6").otherwise("P5"), F.lit("\n"), F.col("width").cast("string"), F.lit(" "), F.col("height").cast("string"), F.lit("\n255\n"))
    return images.select("name", F.concat(F.encode(head, "UTF-8"), samples).alias("content"))


def cube_table(spark: SparkSession, path: str) -> DataFrame:
    """A .cube file's rows as (i, j, k, r, g, b), red fastest. One file holds one table; its size bounds the rows."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    lines = lines.select("n", F.trim("line").alias("line"))
    size = lines.where(F.col("line").startswith("LUT_3D_SIZE")).select(F.regexp_extract("line", r"(\d+)\s*$", 1).cast("int").alias("size"))
    values = lines.where(F.col("line").rlike(r"^[-+.0-9]")).select("n", F.split("line", r"\s+").cast("array<double>").alias("v"))
    first = values.agg(F.min("n").alias("n0"))
    rows = values.crossJoin(F.broadcast(size)).crossJoin(F.broadcast(first)).withColumn("at", F.col("n") - F.col("n0"))  # one row each
    s = F.col("size")
    return rows.select((F.col("at") % s).alias("i"), F.floor(F.col("at") / s % s).cast("int").alias("j"), F.floor(F.col("at") / (s * s)).cast("int").alias("k"), F.get("v", F.lit(0)).alias("r"), F.get("v", F.lit(1)).alias("g"), F.get("v", F.lit(2)).alias("b"))


def data_sets(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    """A CSV of data sets, a header with names of variables, as (set_no, variable, value). An unknown name is an error, so is a row of other length."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)
    unknown = [c for c in raw.columns if c not in variables]
    if unknown:
        raise ValueError(f"unknown variables: {', '.join(unknown)}")
    numbered = raw.withColumn("set_no", F.monotonically_increasing_id())
    return numbered.unpivot("set_no", raw.columns, "variable", "value")


JOURNAL = "seq long, kind string, payload string, document_hash string"


def journal(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines journal; lines that are no record have a null seq and their text in `torn`. Blank lines are skipped."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).select("value", F.from_json("value", JOURNAL).alias("r"))
    return lines.select("r.*", F.when(F.col("r.seq").isNull(), F.col("value")).alias("torn"))
