"""Token-id output: flat unsigned integer files with 64-bit document offsets, and reading them back memory-mapped.

Documents are dealt by ranges of their id, so that the files follow each other in ascending id order. Each task streams its
range to one group of files in the shared folder under a name of its own and renames them when they are whole; the table of
files (the manifest) names those of the tasks that counted, and prefix sums over it give every file's base.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pretokens import PieceStore
from .shared import new_path, stored
from .wordhash import portions

END_ID = 2
_stores: dict[int, PieceStore] = {}


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def library_encoder(vocabulary: str):
    """Encodes pieces with the model of a tokenizers JSON file (given as text)."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(vocabulary).model
    letters = byte_alphabet()

    def encode(pieces: list[str]) -> list[list[int]]:
        return [[t.id for t in model.tokenize(p.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters))] for p in pieces]

    return encode


def _store(vocabulary: str) -> PieceStore:
    key = zlib.crc32(vocabulary.encode())
    if key not in _stores:
        _stores[key] = PieceStore(library_encoder(vocabulary))
    return _stores[key]


def added_tokens(vocabulary: str) -> dict[str, int]:
    """The added tokens of a tokenizers JSON file (given as text), by content."""
    found = json.loads(vocabulary).get("added_tokens") or []
    if any(t[k] for t in found for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("only added tokens that are matched to the letter are known")
    return {t["content"]: t["id"] for t in found}


def encoded(store: PieceStore, texts: list[str | None], added: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in order, and how many each text has; texts are cut at the ``added`` tokens first."""
    texts = ["" if t is None else t for t in texts]
    if not any(a in t for a in added for t in texts):
        return store.texts(texts)
    cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    parts = [cut.split(t) for t in texts]  # every second one is an added token
    flat, n = store.texts([x for p in parts for x in p[::2]])
    ends = np.cumsum(n)
    own = np.cumsum([len(p[::2]) for p in parts])
    inner = np.ones(len(n), bool)
    inner[own - 1] = False
    ids = np.insert(flat, ends[inner], [added[x] for p in parts for x in p[1::2]])
    return ids, np.diff(ends[own - 1], prepend=0) + np.array([len(p) // 2 for p in parts])


def write_tokens(docs: DataFrame, vocabulary_path: str, end_id: int = END_ID, with_added: bool = False) -> DataFrame:
    """Write the files; the manifest: ``part, path, width, n_docs, n_tokens, base``.

    Null text counts as empty (only the end id). Null ids come first. Rows that repeat an id follow each other, in the order of a text digest.
    An empty table gives an empty manifest; very long texts and words are encoded whole; other columns are not looked at. With ``with_added``, the contents of the file's added tokens in a text become
    their ids, as by the library's default settings; else they are split like other text. ``vocabulary_path`` is read on the driver; its text (a fixed file) goes to the tasks.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        text = f.read()
    from tokenizers import Tokenizer

    added = added_tokens(text) if with_added else {}
    width = 2 if max(Tokenizer.from_str(text).get_vocab_size(), end_id + 1, *(i + 1 for i in added.values())) <= 1 << 16 else 4
    vocabulary = spark.sparkContext.broadcast(text)
    root = new_path(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, part = _store(vocabulary.value), TaskContext.get().partitionId()
        store_fs, folder = pafs.FileSystem.from_uri(root)
        store_fs.create_dir(folder, recursive=True)
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        counts, ids, nulls = [], [], []
        out = None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if out is None and texts:
                out = store_fs.open_output_stream(f"{name}.tmp")
            for a, b in portions([len(t or "") for t in texts]):
                flat, n = encoded(store, texts[a:b], added)
                ends = np.cumsum(n)
                out.write(np.insert(flat, ends, end_id).astype(f"<u{width}").tobytes())
                counts.append(n + 1)
            ids.append(batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            nulls.append(batch.column("doc_id").is_null().to_numpy(zero_copy_only=False))
        if out is None:
            return
        out.close()
        sizes = np.concatenate(counts)
        for suffix, data in (("idx", np.concatenate(([0], np.cumsum(sizes))).astype("<u8")), ("doc", np.concatenate(ids)), ("null", np.concatenate(nulls).astype("u1"))):
            with store_fs.open_output_stream(f"{name}.{suffix}") as f:
                f.write(data.tobytes())
        store_fs.move(f"{name}.tmp", f"{name}.bin")
        yield pa.RecordBatch.from_pydict({"part": [part], "name": [name.rsplit("/", 1)[1]], "n_docs": [len(sizes)], "n_tokens": [int(sizes.sum())]}, schema=pa.schema([("part", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    files = stored(rows.mapInArrow(write, "part long, name string, n_docs long, n_tokens long"), "manifest")
    # one row per file, so a single task can add them up
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("part", F.concat(F.lit(root + "/"), "name").alias("path"), F.lit(width).alias("width"), "n_docs", "n_tokens", F.coalesce(F.sum("n_tokens").over(upto), F.lit(0)).alias("base"))


def open_mapped(uri: str, dtype: str) -> np.ndarray:
    """A flat file as an array: memory-mapped where the shared folder is mounted, else read."""
    store_fs, path = pafs.FileSystem.from_uri(uri)
    if isinstance(store_fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if store_fs.get_file_info(path).size else np.empty(0, dtype)
    with store_fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """From the files: ``doc_id, start, n_tokens, ids_crc32`` of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stem = row["path"]
                ids, offsets = open_mapped(f"{stem}.bin", f"<u{row['width']}"), open_mapped(f"{stem}.idx", "<u8").astype(np.int64)
                docs, nulls = open_mapped(f"{stem}.doc", "<i8"), open_mapped(f"{stem}.null", "u1")
                for a in range(0, len(docs), 10_000):
                    b = min(a + 10_000, len(docs))
                    own = offsets[a : b + 1]
                    crc = [zlib.crc32(ids[x:y].astype("<u4")) for x, y in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(docs[a:b], mask=nulls[a:b].astype(bool)), pa.array(row["base"] + own[:-1]), pa.array(np.diff(own)), pa.array(crc, pa.int64())], schema=schema)

    return manifest.select("path", "width", "base").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
