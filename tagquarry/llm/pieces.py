"""SentencePiece encoding and decoding through a distinct-chunk table.

No piece of the model crosses the start of a whitespace marker, so a text falls into marked words
that are segmented independently. A first pass counts the distinct words of the corpus with map-side
combining; the frequent ones (at most HEAD_ENTRIES and HEAD_BYTES, so that the table may be broadcast)
are segmented once each. Every task then looks its texts' words up in that table and joins the ids
back by position; a word outside the table is segmented where it stands, once per task (chunks.py).
A join of all word occurrences with the table of all words would move several times the input.

Defined cases: a null or empty text has no ids and decodes to an empty string; texts of any length
are encoded whole; repeated rows give repeated results; an empty table gives an empty result; all
other columns pass through, but columns named ids or decoded are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import ChunkTable
from .common import bound_batches, columns, materialize

MARK = "▁"
#: A chunk: spaces (markers) with the word after them, or a line end with the word after it.
CHUNK = re.compile(r" +[^ \n]*|\n[^ \n]*")
#: About as many characters are encoded before a record batch is handed on.
BATCH_CHARS = 1_000_000
#: Most entries and bytes of words and ids of the table that is broadcast, and the longest word in it.
HEAD_ENTRIES, HEAD_BYTES, HEAD_CHARS = 200_000, 8_000_000, 64


def check_model(sp) -> None:
    """Raise ValueError where marked words could not be segmented alone."""
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if not sp.is_byte(i) and (MARK in p.lstrip(MARK) or "\n" in p):
            raise ValueError(f"piece {p!r} crosses a marker or line end")
    if sp.encode("a") == sp.encode(" a") or sp.encode("\n")[0] != sp.piece_to_id(MARK):
        raise ValueError("the model must add a dummy prefix and keep white space")


def segmenter(sp):
    def segment(chunks: list[str]) -> list[bytes]:
        out = []
        for c, ids in zip(chunks, sp.encode([c if c[0] == "\n" else c[1:] for c in chunks], num_threads=1)):
            if c == " ":
                ids = [sp.piece_to_id(MARK)]  # the library encodes an empty string as nothing
            elif c[0] == "\n":
                ids = ids[1:]  # the dummy prefix, which never merges with a line end
            out.append(np.array(ids, "<i4").tobytes())
        return out

    return segment


def _load(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def chunks_of(text: str | None) -> list[str]:
    return CHUNK.findall(" " + text.replace(MARK, " ")) if text else []


def encode_texts(texts: list, table: ChunkTable) -> list[np.ndarray]:
    """All ids of each text."""
    return [np.frombuffer(ids, "<i4") for ids in table.encode([chunks_of(t) for t in texts])]


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n): how often each distinct word of at most HEAD_CHARS characters occurs."""
    words = F.split(F.translate("text", MARK + "\n", "  "), " ")
    words = documents.select(F.explode(words).alias("word")).where(F.char_length("word").between(1, HEAD_CHARS))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def head_table(documents: DataFrame, model) -> dict[str, bytes]:
    """Marked word -> ids of the most frequent words; model is a broadcast of the model's bytes.

    All words that occur at least 2^k times, for the least k that keeps within the bounds.
    """
    counts = materialize(word_counts(documents))
    level = F.floor(F.log2("n"))
    bins = counts.groupBy(level.alias("k")).agg(F.count("*"), F.sum(F.octet_length("word"))).collect()  # 64 at most
    entries = size = 0
    least = None
    for k, rows, chars in sorted(bins, reverse=True):
        entries, size = entries + rows, size + 4 * chars  # a byte of a word is one id at most
        if entries > HEAD_ENTRIES or size > 4 * HEAD_BYTES:
            break
        least = k
    if least is None:
        return {}

    def run(batches):
        segment = segmenter(_load(model.value))
        for batch in batches:
            words = batch.column(0).to_pylist()
            ids = segment([" " + w for w in words])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["word", "ids"])

    rows = counts.where(level >= least).select("word").mapInArrow(run, "word string, ids binary").collect()
    return {" " + r.word: bytes(r.ids) for r in rows}


def encode_and_decode(documents: DataFrame, model_path: str) -> DataFrame:
    """documents with `ids` array<int> and `decoded` string (decode(ids) of the library)."""
    bound_batches(documents.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    check_model(_load(model))
    own = [c for c in documents.columns if c not in ("ids", "decoded")]
    documents = documents.select(F.struct(*columns(own)).alias("own"), "text")
    context = documents.sparkSession.sparkContext
    shared = context.broadcast(model)
    head = context.broadcast(head_table(documents.select("text"), shared))
    fields = [documents.schema["own"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def run(batches):
        sp = _load(shared.value)
        table = ChunkTable(segmenter(sp), head.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            start = 0
            while start < batch.num_rows:
                part, chars, end = [], 0, start
                while end < batch.num_rows and chars < BATCH_CHARS:
                    part.append(texts[end].as_py())
                    chars += len(part[-1] or "")
                    end += 1
                ids = encode_texts(part, table)
                decoded = [sp.decode(x.tolist()) if len(x) else "" for x in ids]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                rows = batch.slice(start, end - start).column(batch.schema.get_field_index("own"))
                yield pa.RecordBatch.from_arrays([rows, lists, pa.array(decoded, pa.string())], names=["own", "ids", "decoded"])
                start = end

    encoded = documents.mapInArrow(run, T.StructType(fields))
    return encoded.select(*(F.col("own").getField(c).alias(c) for c in own), "ids", "decoded")


def joined_ids(c):
    """Decimal ids joined by commas."""
    return F.array_join(F.col(c).cast("array<string>"), ",")
