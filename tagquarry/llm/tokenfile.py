"""Token-id output as directly addressable codes (DAC).

A file is a Parquet table that Spark commits, one row per block of whole documents in ascending
doc_id order. A block's ids are split into 8-bit levels: level 0 holds every id's low byte, and a
continuation bitmap says which ids go on in the next level. A rank directory counts the bitmap's
ones before every 512th bit, so token i of a block, or a run of tokens, is found with one rank per
level, without decoding the block; the blocks' starts lead from a token's number in the whole file to
its block (tokens_at). Documents are read back in this way too.

Defined cases: a null or empty text has the end id only; a null doc_id sorts first; rows that share
a doc_id are ordered by text, null first; a text of any length stays in one block; an empty table
gives an empty file; other columns are not written.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import ChunkTable
from .common import bound_batches

MAGIC = b"DAC1"
RANK_BITS = 512
#: A block is closed after the document with which it reaches this many ids.
BLOCK_IDS = 1 << 18
#: About as many bytes of text are encoded at a time.
BATCH_BYTES = 1 << 23
#: Entries of a worker's table of chunks before it starts anew, about 200 bytes each.
MAX_CHUNKS = 500_000
#: Letters of the plain words: one code point in either case, and composed already.
LETTERS = "".join(c for c in map(chr, range(65, 256)) if c.isalpha() and c.lower() in map(chr, range(97, 256)) and c not in "ªºµ")
#: The ASCII signs, which the splitter leaves together.
SIGNS = "!-/:-@\\[-`{-~"
PLAIN = re.compile(f"[{LETTERS}]+|[{SIGNS}]+")
#: Words in which the normaliser may change more than case, or that may hold a special token.
ODD = f"[^!-~{LETTERS}]|<\\|"


def pack(ids: np.ndarray) -> bytes:
    """The levels of unsigned 32-bit ids: per level its count, bytes, bitmap and rank directory."""
    parts, rest = [MAGIC], np.ascontiguousarray(ids, np.uint32)
    while len(rest) or len(parts) == 1:
        more = rest > 0xFF
        bitmap = np.packbits(more, bitorder="little")
        bitmap = np.pad(bitmap, (0, -len(bitmap) % (RANK_BITS // 8)))
        ones = np.bitwise_count(bitmap.reshape(-1, RANK_BITS // 8)).sum(axis=1, dtype=np.uint32)
        rank = np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])
        parts += (struct.pack("<I", len(rest)), (rest & 0xFF).astype(np.uint8).tobytes(), bitmap.tobytes(), rank.tobytes())
        rest = rest[more] >> 8
    return b"".join(parts)


class Block:
    """Random access into a packed block."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a block of this format")
        self.levels, at = [], 4
        while at < len(data):
            (n,) = struct.unpack_from("<I", data, at)
            size = -(-n // RANK_BITS) * RANK_BITS // 8
            low = np.frombuffer(data, np.uint8, n, at + 4)
            bitmap = np.frombuffer(data, np.uint8, size, at + 4 + n)
            rank = np.frombuffer(data, "<u4", size * 8 // RANK_BITS + 1, at + 4 + n + size)
            self.levels.append((low, bitmap, rank))
            at += 4 + n + size + rank.nbytes

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(level, i: int) -> int:
        """The number of ones before bit i of a level's bitmap."""
        _, bitmap, rank = level
        word = i // RANK_BITS
        ones = int(rank[word]) + int(np.bitwise_count(bitmap[word * RANK_BITS // 8 : i >> 3]).sum())
        return ones + (int(bitmap[i >> 3] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def token(self, i: int) -> int:
        """Id i, by one rank a level."""
        out = 0
        for shift, level in enumerate(self.levels):
            out |= int(level[0][i]) << (8 * shift)
            if not level[1][i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(level, i)
        return out

    def all(self) -> np.ndarray:
        return self.run(0, len(self))

    def run(self, i: int, n: int) -> np.ndarray:
        """The n ids from id i on, by one rank a level."""
        parts = []
        for level in self.levels:
            if not n:
                break
            low, bitmap, _ = level
            bits = bitmap[i >> 3 : (i + n + 7) >> 3]
            if not bits.any():
                parts.append((low[i : i + n], slice(0, 0)))
                break
            more = np.unpackbits(bits, bitorder="little")[i & 7 : (i & 7) + n].astype(bool)
            parts.append((low[i : i + n], more))
            i, n = self._rank(level, i), int(np.count_nonzero(more))
        out = np.zeros(0, np.uint32)
        for low, more in reversed(parts):
            ids = low.astype(np.uint32)
            ids[more] |= out << 8
            out = ids
        return out


def segmenter(tokenizer):
    """Plain chunks, all lower-case letters or all signs, skip the library's normaliser and splitter, which cannot
    change or divide them, and go to its model at once; all other chunks go through the whole library."""
    spelled = {ord(c): tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in LETTERS}
    model = tokenizer.model

    def segment(chunks: list[str]) -> list[bytes]:
        out = []
        for c in chunks:
            if PLAIN.fullmatch(c):
                ids = [t.id for t in model.tokenize(c if c.isascii() else c.translate(spelled))]
            else:
                ids = tokenizer.encode(c, add_special_tokens=False).ids
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out

    return segment


@lru_cache(maxsize=1)
def _table(spec: str) -> ChunkTable:
    """The worker's tokenizer with its chunk table, kept between tasks: bounded by MAX_CHUNKS."""
    from tokenizers import Tokenizer

    return ChunkTable(segmenter(Tokenizer.from_str(spec)), most=MAX_CHUNKS)


def words_of(texts: pa.Array) -> pa.Array:
    """The words of each text: the tokenizer drops white space and no token crosses it, so that they are encoded alone."""
    texts = pc.fill_null(texts, "")
    if not pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
        return pc.utf8_split_whitespace(texts)
    # white space to Arrow and Python, signs to the tokenizer
    odd = (t.replace("\n", " ").split(" ") if re.search("[\x1c-\x1f]", t) else t.split() for t in texts.to_pylist())
    return pa.array(odd, pa.list_(pa.string()))


def chunks_of(words: pa.Array) -> pa.Array:
    """The chunks of each word: cut between letters and the signs after them, where the tokenizer cuts as well, with
    letters in lower case. Odd words stay as they are."""
    cut = pc.replace_substring_regex(pc.utf8_lower(words), f"([{LETTERS}])([{SIGNS}])", r"\1 \2")
    return pc.split_pattern(pc.if_else(pc.match_substring_regex(words, ODD), words, cut), " ")


def _offsets(values: pa.Array) -> np.ndarray:
    """Where each list or binary value starts, and the end of the last one."""
    if pa.types.is_large_binary(values.type):
        return np.frombuffer(values.buffers()[1], np.int64, len(values) + 1)
    return np.asarray(values.offsets, np.int64)


def encode_texts(texts: pa.Array, table: ChunkTable, end: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, each text's followed by `end`, and the number of ids up to each text's end.

    Each distinct word is cut once and each distinct chunk looked up once; the ids are then taken by position.
    """
    lists = words_of(texts)
    words = lists.flatten().dictionary_encode()
    parts = chunks_of(words.dictionary)
    chunks = parts.flatten().dictionary_encode()
    known = table.look_up(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())
    # Every distinct word's ids, those of `end` last
    spelled = pa.array([*known, end], pa.large_binary()).take(pa.array(np.append(chunks.indices, len(known))))
    bounds = _offsets(spelled)[np.append(_offsets(parts), len(spelled))]
    spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), spelled.buffers()[2]])
    # Every word of the texts, and `end` after each text's
    ends = _offsets(lists)[1:]
    taken = spelled.take(pa.array(np.insert(words.indices, ends, len(words.dictionary))))
    upto = _offsets(taken)
    return np.frombuffer(taken.buffers()[2], "<u4", upto[-1] // 4), upto[ends + np.arange(1, len(ends) + 1)] // 4


def write_token_file(documents: DataFrame, path: str, tokenizer_path: str, end_id: int = 1) -> None:
    """Write all ids of `documents` (doc_id, text), each document followed by end_id, to `path`."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    bound_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(spec)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        table, part = _table(shared.value), TaskContext.get().partitionId()
        docs, lengths, ids, start = [], [], [], 0

        def block():
            nonlocal start
            row = {
                "part": part,
                "start_in_part": start,
                "n_tokens": sum(lengths),
                "doc_ids": list(docs),
                "lengths": list(lengths),
                "codes": pack(np.concatenate(ids)),
            }
            start += row["n_tokens"]
            docs.clear(), lengths.clear(), ids.clear()
            return pd.DataFrame([row])

        def gathered(batches):
            rows, size = [], 0
            for batch in batches:
                if rows and size + batch.nbytes > BATCH_BYTES:
                    yield pa.Table.from_batches(rows).combine_chunks()
                    rows, size = [], 0
                if batch.num_rows:
                    rows.append(batch)
                    size += batch.nbytes
            if rows:
                yield pa.Table.from_batches(rows).combine_chunks()

        held = 0
        for rows in gathered(batches):
            found, ends = encode_texts(rows.column(1).chunk(0), table, end)
            at = 0
            for doc, to in zip(rows.column(0).to_pylist(), ends.tolist()):
                ids.append(found[at:to])
                docs.append(doc)
                lengths.append(to - at)
                held += to - at
                at = to
                if held >= BLOCK_IDS:
                    held = 0
                    yield _record(block())
        if docs:
            yield _record(block())

    (
        documents.select("doc_id", "text")
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
        .mapInArrow(run, SCHEMA)
        .write.option("compression", "zstd")
        .parquet(path)
    )


SCHEMA = "part int, start_in_part long, n_tokens long, doc_ids array<long>, lengths array<long>, codes binary"


def _record(frame: pd.DataFrame):
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(frame[c].tolist(), k) for c, k in zip(frame.columns, kinds)], names=list(frame.columns)
    )


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with their global start: part, start, n_tokens, doc_ids, lengths, codes.

    Only a row per written partition is summed up in order; blocks are not sorted.
    """
    blocks = spark.read.schema(SCHEMA).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return blocks.join(parts, "part").withColumn("start", F.col("offset") + F.col("start_in_part"))


def _documents(batches):
    for b in batches:
        rows = []
        for start, docs, lengths, codes in zip(b["start"], b["doc_ids"], b["lengths"], b["codes"]):
            block, at = Block(codes), 0
            for doc, n in zip(docs, lengths):
                rows.append((doc, start + at, n, zlib.crc32(block.run(at, n).astype("<u4", copy=False))))
                at += n
        yield pd.DataFrame(
            {"doc_id": pd.array([r[0] for r in rows], "Int64")}
            | {c: np.array([r[i] for r in rows], np.int64) for i, c in enumerate(("start", "n_tokens", "ids_crc32"), 1)}
        )


def document_digests(blocks: DataFrame) -> DataFrame:
    """Per document of the file: doc_id, start, n_tokens, ids_crc32."""
    return blocks.select("start", "doc_ids", "lengths", "codes").mapInPandas(
        _documents, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def _tokens(batches):
    for b in batches:
        rows = []
        for start, numbers, codes in zip(b["start"], b["numbers"], b["codes"]):
            block = Block(codes)
            rows += [(int(i), block.token(int(i) - start)) for i in numbers]
        yield pd.DataFrame(rows, columns=["number", "token"], dtype=np.int64)


def tokens_at(blocks: DataFrame, numbers: DataFrame) -> DataFrame:
    """(number, token) of the tokens with these numbers in the whole file; numbers: one long column.

    Numbers meet the blocks' starts in stretches of BLOCK_IDS; then each block's codes meet the numbers
    asked of it, once. Numbers outside the file have no row; repeated ones have one.
    """
    stretch = F.explode(F.sequence(F.expr(f"start div {BLOCK_IDS}"), F.expr(f"(start + n_tokens - 1) div {BLOCK_IDS}")))
    starts = blocks.where("n_tokens > 0").select("part", "start_in_part", "start", "n_tokens", stretch.alias("stretch"))
    asked = numbers.toDF("number").where("number >= 0").distinct().withColumn("stretch", F.expr(f"number div {BLOCK_IDS}"))
    met = asked.join(starts, "stretch").where("number >= start AND number < start + n_tokens")
    met = met.groupBy("part", "start_in_part").agg(F.collect_list("number").alias("numbers"))  # BLOCK_IDS or so at most
    found = met.join(blocks.select("part", "start_in_part", "start", "codes"), ["part", "start_in_part"])
    return found.select("start", "numbers", "codes").mapInPandas(_tokens, "number long, token long")
