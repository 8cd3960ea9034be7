"""Flat token files with 64-bit document offsets.

Documents are range-partitioned by id; each partition writes three flat files

``part-N.tokens``  unsigned little-endian ids, 16 bit for vocabularies up to 65,536, else 32
``part-N.offsets`` signed 64-bit: where each document starts within the part, and the part's end
``part-N.ids``     signed 64-bit document ids (the smallest long stands for a null id)

and ``manifest.json`` has the parts in order with their bases: the prefix sums of documents and tokens of
the parts before. A task names its files after its attempt, so a repeated task never writes into
another's file, and only attempts that Spark accepted are in the manifest. Readers map the files into
memory and add the part's base.

Nulls: a null text is empty (end id only), null ids come first. Rows that share an id are written in no
particular order among them. An empty table gives a manifest without documents.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from logvigil.llm.common import partitions, ship, texts
from logvigil.llm.packing import encoder

NULL_ID = -(1 << 63)
KINDS = {"uint16": 2, "uint32": 4}


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_tokens(docs: DataFrame, path: str, end: int, folder: str, id: str = "doc_id", text: str = "text", batch: int = 256) -> list[dict]:
    """Write the files below ``folder`` (a URI all executors reach) and return the manifest's parts."""
    count = partitions(docs.sparkSession)
    source = texts(docs, id, text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    ordered = source.repartitionByRange(count, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    closing = np.array([end], "<u2").tobytes()
    where, top = _place(folder)
    where.create_dir(top, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part = encoder(path), TaskContext.get().partitionId()
        place, base = _place(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}"
        n_docs = n_tokens = 0
        with place.open_output_stream(f"{base}/{name}.tokens") as tokens, place.open_output_stream(f"{base}/{name}.offsets") as offsets, place.open_output_stream(f"{base}/{name}.ids") as ids:
            for rows in batches:
                for at in range(0, rows.num_rows, batch):
                    some = rows.slice(at, batch)
                    encoded = [x + closing for x in model.encode(some.column(1).to_pylist())]
                    sizes = np.fromiter((len(x) // 2 for x in encoded), np.int64, len(encoded))
                    tokens.write(b"".join(encoded))
                    offsets.write((n_tokens + np.cumsum(sizes) - sizes).astype("<i8").tobytes())
                    names = [NULL_ID if x is None else x for x in some.column(0).to_pylist()]
                    ids.write(np.array(names, "<i8").tobytes())
                    n_docs, n_tokens = n_docs + len(encoded), n_tokens + int(sizes.sum())
            offsets.write(np.array([n_tokens], "<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "docs": [n_docs], "tokens": [n_tokens]})

    rows = sorted(ordered.mapInArrow(run, "part long, name string, docs long, tokens long").collect())  # a row for each partition
    parts, doc_base, token_base = [], 0, 0
    for row in rows:
        parts.append({"name": row["name"], "docs": row["docs"], "tokens": row["tokens"], "doc_base": doc_base, "token_base": token_base})
        doc_base, token_base = doc_base + row["docs"], token_base + row["tokens"]
    with where.open_output_stream(f"{top}/manifest.json") as out:
        out.write(json.dumps({"kind": "uint16", "docs": doc_base, "tokens": token_base, "parts": parts}).encode())
    return parts


def mapped(place: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A flat file as an array: memory-mapped on a local or mounted file system, else read."""
    if isinstance(place, fs.LocalFileSystem):
        with pa.memory_map(path) as source:
            return np.frombuffer(source.read_buffer(), dtype=kind)
    with place.open_input_file(path) as source:
        return np.frombuffer(source.read_buffer(), dtype=kind)


def read_tokens(spark: SparkSession, folder: str, batch: int = 2048) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    ship(spark)
    where, top = _place(folder)
    with where.open_input_file(f"{top}/manifest.json") as source:
        manifest = json.loads(source.read())
    kind = "<u2" if manifest["kind"] == "uint16" else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = _place(folder)
        for rows in batches:
            for name, token_base in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                tokens = mapped(place, f"{base}/{name}.tokens", kind)
                offsets, ids = (mapped(place, f"{base}/{name}.{x}", "<i8") for x in ("offsets", "ids"))
                for at in range(0, len(ids), batch):
                    some, ends = ids[at : at + batch], offsets[at : at + batch + 1]
                    crc = [zlib.crc32(tokens[a:b].astype("<u4")) for a, b in zip(ends[:-1], ends[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, mask=some == NULL_ID), pa.array(ends[:-1] + token_base), pa.array(np.diff(ends)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = [(p["name"], p["token_base"]) for p in manifest["parts"] if p["docs"]]
    listed = spark.createDataFrame(parts, "name string, token_base long").repartition(max(1, len(parts)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
