"""Fingerprints of whole texts by consistent weighted sampling of their words.

A word's weight is 1 + ln(times it occurs), so the share of equal parts of two fingerprints estimates
the generalised Jaccard similarity of the weighted words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlake.llm.textvec import Words, batches_of, kept_columns, per_text, utf8
from reachlake.llm.weighted_samples import signatures

SAMPLES = 64


def weighted_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different words of each text, their log weights, and where each text's begin."""
    data, offs = utf8(texts)
    words = Words(data, offs)
    term, doc, count = per_text(words.hash, words.doc)
    weight = np.log1p(np.log(count))
    return term * np.uint64(0x9E3779B97F4A7C15), weight, np.searchsorted(doc, np.arange(len(texts) + 1))


def fingerprint_array(texts: pa.Array, samples: int = SAMPLES) -> np.ndarray:
    """``[texts, samples]`` 16-bit parts; texts without words have the same, fixed fingerprint."""
    marks = signatures(*weighted_words(texts), samples)
    return ((marks * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def as_text(parts: np.ndarray) -> list[str]:
    """Four hexadecimal digits per part."""
    raw = parts.astype(">u2").tobytes().hex()
    n = 4 * parts.shape[1]
    return [raw[i : i + n] for i in range(0, len(raw), n)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1) if len(a) else np.zeros(0)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``id_col, fingerprint`` of every row. Null texts are empty; other columns are ignored."""
    rows = kept_columns(docs, {"id": id_col, "text": text_col})

    def run(stream):
        for b in batches_of(stream, 512, 1 << 20):
            parts = fingerprint_array(b.column("text").combine_chunks(), samples)
            yield pa.RecordBatch.from_arrays([b.column("id").combine_chunks(), pa.array(as_text(parts), pa.string())],
                                             [id_col, "fingerprint"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, fingerprint string")


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``_range, _guest, id, text`` sorted so that each row is followed by the next by id.

    Ids are dealt into ranges; the first row of a range is repeated as a guest at the end of the
    range before, and the very first at the end of the last. Only one id per range is known to the
    driver. Ids are whole numbers; a null id comes first, rows with equal ids are ordered by text.
    """
    rows = kept_columns(docs, {"id": id_col, "text": text_col}).withColumn("text", F.coalesce("text", F.lit("")))
    key = F.coalesce(F.col("id").cast("long"), F.lit(-(2**63)))
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    heads = sorted({
        r["k"] for r in rows.select(key.alias("k")).repartitionByRange(ranges, "k")
        .groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k")).collect()})
    if not heads:
        return rows.select(F.lit(0).alias("_range"), F.lit(0).alias("_guest"), "id", "text").where("false")
    known = F.array(*[F.lit(h).cast("long") for h in heads])
    at = F.size(F.filter(known, lambda h: h <= F.col("_key"))) - 1
    before = F.when(F.col("_range") == 0, F.lit(len(heads) - 1)).otherwise(F.col("_range") - 1)
    both = F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("g")), F.struct(before.alias("r"), F.lit(1).alias("g")))
    put = F.explode(F.when(F.array_contains(known, F.col("_key")), both).otherwise(F.slice(both, 1, 1)))
    placed = rows.withColumn("_key", key).withColumn("_range", at).select("id", "text", "_key", put.alias("p"))
    return (placed.select(F.col("p.r").alias("_range"), F.col("p.g").alias("_guest"), "id", "text", "_key")
            .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_range")
            .sortWithinPartitions("_range", "_guest", "_key", "text").drop("_key"))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprint of every text, of its edited text, and how alike they and the next text's are.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or
    all, of the next text by id; the last is followed by the first, a single one by itself. Null texts
    are empty. Repeated rows give a row each, one being the next of the other. Other columns are
    ignored, an empty table gives an empty result.
    """
    placed = beside_next(docs, id_col, text_col)
    id_type = placed.schema["id"].dataType.simpleString()
    schema = (f"`{id_col}` {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")

    def made(held):
        """Results of all rows in ``held`` but the last, which only serves as next."""
        texts = [t for *_, t in held]
        own = [i for i in range(len(held) - 1) if not held[i][1] and held[i][0] == held[i + 1][0]]
        cut = [len(texts[i]) // 2 for i in own]
        edited = [texts[i][: len(texts[i]) - c] + texts[i + 1][:c] for i, c in zip(own, cut)]
        parts = fingerprint_array(pa.array(texts, pa.large_string()), samples)
        changed = fingerprint_array(pa.array(edited, pa.large_string()), samples)
        at = np.array(own, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([held[i][2] for i in own], id_arrow), pa.array([len(texts[i]) for i in own], pa.int64()),
             pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
             pa.array(as_text(parts[at]), pa.string()), pa.array(as_text(changed), pa.string()),
             pa.array(likeness(parts[at], changed)), pa.array(likeness(parts[at], parts[at + 1]))],
            [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(placed.schema["id"].dataType)

    def run(stream):
        held: list[tuple] = []
        for b in batches_of(stream, 256, 1 << 20):
            held += zip(*[b.column(c).to_pylist() for c in ("_range", "_guest", "id", "text")])
            if len(held) > 1:
                yield made(held)
                held = held[-1:]

    return placed.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
