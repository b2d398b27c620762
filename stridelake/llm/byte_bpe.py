"""Byte-level BPE by corpus-level merge replay, and decoding.

The distinct pieces of the corpus are counted by a shuffle, and each is encoded once, wherever it stands. The pieces of a task
lie end to end as linked tokens. An inverted index leads from each mergeable
pair (by the rank of what it merges to) to the positions where it stands; merges are applied in rank order at all positions of the
index, and only the two neighbours of each position enter the index anew. No piece is replayed a second time: the codes of the commonest pieces, a bounded
number, go to all tasks that put texts together, and the codes of the rarer ones are joined by piece and laid ready for the tasks whose texts hold them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import PieceStore, split_pieces
from .shared import discard, new_path, stored
from .wordhash import portions

#: Most pieces, and most characters of one, whose codes are broadcast: some 10 MB at any size of the corpus.
COMMON_PIECES, COMMON_CHARS = 200_000, 40
#: Pieces that are replayed together.
LOT = 100_000
#: Distinct pieces that a task counts before it passes them on.
PIECES_AT_ONCE = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from lines of base64 and number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.pair_rank: dict[tuple[int, int], int] = {}

    def rank(self, a: int, b: int) -> int:
        """Rank of the token that two tokens merge to, -1 if there is none."""
        found = self.pair_rank.get((a, b))
        if found is None:
            if len(self.pair_rank) > 2_000_000:
                self.pair_rank.clear()
            found = self.pair_rank[a, b] = self.ranks.get(self.token[a] + self.token[b], -1)
        return found

    def encode(self, pieces: list[str]) -> list[list[int]]:
        whole = [p.encode("utf-8", "surrogatepass") for p in pieces]
        known = [self.ranks.get(w) for w in whole]
        byte, rank = self.byte, self.rank
        token: list[int] = []
        heads = []
        for w, r in zip(whole, known, strict=True):
            heads.append(len(token))
            if r is None:
                token += [byte[b] for b in w]
                token.append(-1)  # no pair crosses pieces
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        for at in range(n - 1):
            a, b = token[at], token[at + 1]
            if a >= 0 and b >= 0 and (r := rank(a, b)) >= 0:
                index.setdefault(r, []).append(at)
        order = list(index)
        heapify(order)
        while order:
            r = heappop(order)
            spots = index.pop(r)
            spots.sort()
            for k, at in enumerate(spots):
                a = token[at]
                if a < 0:
                    continue
                nxt = after[at]
                b = token[nxt]
                if b < 0 or rank(a, b) != r:
                    continue
                token[at], token[nxt] = r, -2  # merged away
                beyond = after[at] = after[nxt]
                before[beyond] = at
                lower = False
                c = token[beyond]
                if c >= 0 and (x := rank(r, c)) >= 0:
                    if x not in index:
                        index[x] = []
                        heappush(order, x)
                    index[x].append(at)
                    lower = x <= r
                left = before[at]
                if left >= 0 and token[left] >= 0 and (x := rank(token[left], r)) >= 0:
                    if x not in index:
                        index[x] = []
                        heappush(order, x)
                    index[x].append(left)
                    lower |= x <= r
                if lower:  # an earlier merge became possible: it goes first
                    rest = spots[k + 1 :]
                    if rest:
                        if r not in index:
                            index[r] = []
                            heappush(order, r)
                        index[r] += rest
                    break
        out = []
        for head, r in zip(heads, known, strict=True):
            if r is not None:
                out.append([r])
                continue
            ids, at = [], head
            while (t := token[at]) != -1:
                ids.append(t)
                at = after[at]
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_stores: dict[str, tuple[MergeReplay, PieceStore]] = {}


def _store(key: str, ranks: dict[bytes, int], seed: tuple[list[str], np.ndarray, np.ndarray] | None = None) -> tuple[MergeReplay, PieceStore]:
    """The worker's store for ``key``; an earlier one is dropped."""
    if key not in _stores:
        _stores.clear()
        replay = MergeReplay(ranks)
        _stores[key] = replay, PieceStore(replay.encode, seed)
    return _stores[key]


def task_pieces(docs: DataFrame) -> DataFrame:
    """``part, piece, n``: how often each piece stands in the texts of each task (a task with very many pieces gives several rows for one)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = TaskContext.get().partitionId(), {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), part)), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["part", "piece", "n"])
            counts.clear()
            return out

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in portions([len(t or "") for t in texts]):
                codes, names, _ = split_pieces(texts[a:b])
                for piece, n in zip(names, np.bincount(codes, minlength=len(names)).tolist(), strict=True):
                    counts[piece] = counts.get(piece, 0) + n
                if len(counts) > PIECES_AT_ONCE:
                    yield flush()
        yield flush()

    return docs.mapInArrow(count, "part long, piece string, n long")


def corpus_pieces(seen: DataFrame) -> DataFrame:
    """``piece, n``: the distinct pieces of all texts and how often each stands there."""
    return seen.groupBy("piece").agg(F.sum("n").alias("n"))


def encoded_pieces(pieces: DataFrame, ranks_path: str) -> DataFrame:
    """``piece, n`` with ``ids`` (little-endian 32-bit), every piece replayed once."""
    ranks = pieces.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = MergeReplay(ranks.value)
        for batch in batches:
            for a in range(0, batch.num_rows, LOT):
                part = batch.slice(a, LOT)
                ids = [np.array(x, "<u4").tobytes() for x in engine.encode(part.column("piece").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("piece"), part.column("n"), pa.array(ids, pa.binary())], names=["piece", "n", "ids"])

    return pieces.mapInArrow(replay, "piece string, n long, ids binary")


def common_codes(codes: DataFrame, most: int = COMMON_PIECES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The commonest pieces, at most ``most`` of at most COMMON_CHARS characters, with their ids: what the driver sees is bounded."""
    table = _common(codes, most).select("piece", "ids").toArrow()
    ids = b"".join(table.column("ids").to_pylist())
    return table.column("piece").to_pylist(), np.frombuffer(ids, "<u4"), np.array([len(x) // 4 for x in table.column("ids").to_pylist()], np.int64)


def _common(codes: DataFrame, most: int) -> DataFrame:
    short = codes.filter(F.length("piece") <= COMMON_CHARS)
    levels = short.groupBy(F.floor(F.log2("n")).alias("level")).count().collect()  # at most 64 rows
    least, total = 64, 0
    for level, n in sorted(levels, reverse=True):
        if total + n > most:
            break
        least, total = level, total + n
    return short.filter(F.col("n") >= F.lit(2.0) ** least)


def lay_ready(seen: DataFrame, codes: DataFrame, most: int) -> str:
    """Writes the codes of all pieces but the commonest, for each task's pieces, as ``part=N`` under the folder that is returned. A long piece may
    stand in the texts of very many tasks: the join is by shuffle, and split where it is skewed."""
    root = new_path(seen.sparkSession, "rare")
    common = F.broadcast(_common(codes, most).select(F.col("piece").alias("known")))  # at most ``most`` short pieces
    rare = codes.join(common, F.col("piece") == F.col("known"), "left_anti").select(F.col("piece").alias("name"), "ids")
    rows = seen.select("part", "piece").join(common, F.col("piece") == F.col("known"), "left_anti").hint("merge").join(rare, F.col("piece") == F.col("name")).select("part", "piece", "ids")
    rows.repartition("part").sortWithinPartitions("part", "piece").write.option("compression", "zstd").partitionBy("part").parquet(root)
    return root


def _laid_ready(root: str, part: int) -> pa.Table | None:
    store_fs, folder = pafs.FileSystem.from_uri(root)
    files = [f.path for f in store_fs.get_file_info(pafs.FileSelector(f"{folder}/part={part}", allow_not_found=True)) if f.path.endswith(".parquet")]
    return pa.concat_tables(pq.read_table(f, columns=["piece", "ids"], filesystem=store_fs, partitioning=None) for f in files) if files else None


def encode_documents(docs: DataFrame, ranks_path: str, with_ids: bool = False, most: int = COMMON_PIECES) -> DataFrame:
    """One row per row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` as little-endian bytes.

    Null and empty texts have no ids. Rows are independent, so null and repeated ids do no harm; an empty table gives none; very long texts
    and words are encoded whole; other columns are not looked at. ``ranks_path`` is read on the driver; the ranks (a fixed file) go to the tasks.
    Only the distinct pieces of each task are shuffled. What is laid ready goes by the number of a task in the plan of ``docs``; should texts come to
    another task when they are read again (a plan whose rows move from run to run), pieces that are not there are replayed by that task.
    """
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    seen = stored(task_pieces(rows), "seen", compression="zstd")
    codes = stored(encoded_pieces(corpus_pieces(seen), ranks_path), "pieces", compression="zstd")
    spark = docs.sparkSession.sparkContext
    ranks, seed, key = spark.broadcast(read_ranks(ranks_path)), spark.broadcast(common_codes(codes, most)), codes.stored_path
    ready = lay_ready(seen, codes, most)
    discard(codes, seen)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.binary())] * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, store = _store(key, ranks.value, seed.value)
        if len(store.known) > len(seed.value[0]) + store.most:
            store.clear()
        own = _laid_ready(ready, TaskContext.get().partitionId())
        if own is not None:
            fresh = {p: x for p, x in zip(own.column("piece").to_pylist(), own.column("ids").to_pylist()) if p not in store.known}
            store.put(list(fresh), np.frombuffer(b"".join(fresh.values()), "<u4"), np.array([len(x) // 4 for x in fresh.values()], np.int64))
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for a, b in portions([len(t or "") for t in texts]):
                flat, n = store.texts(texts[a:b])
                ends = np.cumsum(n).tolist()
                rows, begin = [], 0
                for end in ends:
                    own = flat[begin:end]
                    data = own.astype("<u4").tobytes()
                    rows.append((end - begin, hashlib.sha256(data).hexdigest(), hashlib.sha256(replay.decode(own.tolist())).hexdigest(), data))
                    begin = end
                columns = list(zip(*rows, strict=True))[: 3 + with_ids]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *[pa.array(c, kind) for c, (_, kind) in zip(columns, fields[1:], strict=True)]], schema=pa.schema(fields))

    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return rows.mapInArrow(encode, kinds)


def decode_ids(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids`` (little-endian 32-bit ids); broken UTF-8 is replaced, null ids give null."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, _ = _store(ranks_path, ranks.value)
        for batch in batches:
            texts = [None if x is None else replay.decode(np.frombuffer(x, "<u4").tolist()).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")
