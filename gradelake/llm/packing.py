"""Best-fit packing planned on the histogram of lengths.

Documents are tokenized and cut into pieces of at most ``size`` ids; only the counts of the ``size``
possible lengths reach the driver. Best-fit decreasing runs over those counts: bins with the same content
are one group with a count, so the plan has at most a few groups per length however many documents there
are. Each piece then gets its rank among the pieces of its length, and takes the planned slot of that rank.

Ranks come from two levels: pieces of one length are dealt to chunks by a hash, ranked inside their chunk,
and shifted by the counts of the chunks before. A length that holds most pieces is so spread over many tasks.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradelake.llm.shared import staged

#: Pieces of one length per chunk that ranks are counted in, about, and chunks of one length at most: their counts are summed up in one task.
CHUNK_ROWS, MOST_CHUNKS = 500, 4096
_PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint"
_encoders: dict[tuple[int, bool], object] = {}


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            out[chr(256 + len(out) - len(plain))] = b
    return out


def encoder(vocabulary: bytes, added: bool = False):
    """encode(text) -> list of ids, for the content of a byte-level BPE file of the tokenizers library.

    tiktoken merges by rank; in such a file a token's id is its rank, so both give the same ids, and
    tiktoken takes a fifth of the time. Strings of added tokens in a text are ordinary text, or with ``added``
    their ids, as the library has it by default; texts that hold one then go to the library.
    """
    import tiktoken

    key = zlib.crc32(vocabulary), added
    if key not in _encoders:
        table = _byte_of_char()
        model = json.loads(vocabulary)
        special = {x["content"] for x in model.get("added_tokens", ())}
        ranks = {bytes(table[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        import public_tokenizers

        fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        _encoders[key] = lambda text: _encoded(text, fast, vocabulary, special if added else None)
    return _encoders[key]


def _encoded(text: str, fast, vocabulary: bytes, added: set[str] | None) -> list[int]:
    try:
        if not (added and any(x in text for x in added)):
            return fast(text)
    except BaseException as e:
        # Hundreds of thousands of blanks in a row overflow the stack of its regular expressions.
        if type(e).__name__ != "PanicException":
            raise
    return _library(vocabulary, added is None).encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=4)
def _library(vocabulary: bytes, ordinary: bool):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary.decode())
    tokenizer.encode_special_tokens = ordinary
    return tokenizer


def tokenized(df: DataFrame, vocabulary: str, size: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32 and, if with_ids, ids."""
    with open(vocabulary, "rb") as f:  # the file is small and on the driver; executors get its content
        content = df.sparkSession.sparkContext.broadcast(f.read())
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        encode = encoder(content.value, added=True)
        for batch in batches:
            kept, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                tokens = np.array(encode(text.as_py()) + [end_id], dtype="<u4")
                n = len(tokens)
                at = [0, *range(n % size or size, n, size)]
                for k, a in enumerate(at):
                    b = at[k + 1] if k + 1 < len(at) else n
                    kept.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(tokens[a:b].tobytes()))
                    if with_ids:
                        ids.append(tokens[a:b])
            out = [batch.column("doc_id").take(pa.array(kept, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return rows.mapInArrow(cut, f"doc_id {kind}, {_PIECE}" + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing over counts: (number of sequences, lengths in order) per group of equal sequences.

    The longest length left goes to the open bins with the least room that still holds it, a whole group
    at a time; a group is divided only where the count runs out, so each length adds at most three groups.
    """
    room: dict[int, list[tuple[int, list[int]]]] = {}
    open_rooms = np.zeros(size + 1, dtype=bool)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fits = np.flatnonzero(open_rooms[length:])
            if len(fits):
                r = int(fits[0]) + length
                n, bins = room[r].pop()
                if not room[r]:
                    open_rooms[r] = False
                take = min(n, left)
                if take < n:
                    room[r].append((n - take, bins))
                    open_rooms[r] = True
                room.setdefault(r - length, []).append((take, [*bins, length]))
                open_rooms[r - length] = True
                left -= take
            else:
                each = size // length
                whole, rest = divmod(left, each)
                for n, m in ((whole, each), (min(rest, 1), rest)):
                    if n:
                        room.setdefault(size - m * length, []).append((n, [length] * m))
                        open_rooms[size - m * length] = True
                left = 0
    return [group for r in sorted(room) for group in room[r]]


def slots(groups: list[tuple[int, list[int]]]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """By length: runs (first rank, sequences, copies per sequence, first sequence, first offset), in order of rank."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    first = 0
    for n, lengths in groups:
        offset, i = 0, 0
        while i < len(lengths):
            length, m = lengths[i], 1
            while i + m < len(lengths) and lengths[i + m] == length:
                m += 1
            at = ranks.get(length, 0)
            out.setdefault(length, []).append((at, n, m, first, offset))
            ranks[length] = at + n * m
            offset += m * length
            i += m
        first += n
    return out


def packed(pieces: DataFrame, size: int) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32, ...), read more than once."""
    spark = pieces.sparkSession
    # At most `size` rows come to the driver.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = spark.sparkContext.broadcast({k: np.array(v, dtype=np.int64) for k, v in slots(plan(counts, size)).items()})
    order = ["doc_id", "piece", "start", "ids_crc32"]
    chunks = ", ".join(f"{min(MOST_CHUNKS, max(1, -(-counts.get(k, 0) // CHUNK_ROWS)))}L" for k in range(1, size + 1))
    dealt = pieces.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.expr(f"element_at(array({chunks}), int(length))")))
    per = dealt.groupBy("length", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = per.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("length", "_chunk").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", "_chunk"]).withColumn("_rank", F.col("_before") + F.col("_k")).drop("_before", "_k", "_chunk").select(*pieces.columns, "_rank")

    def placed(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for one in np.unique(length):
                mine = length == one
                table = runs.value[int(one)]
                run = table[np.searchsorted(table[:, 0], rank[mine], side="right") - 1]
                k = rank[mine] - run[:, 0]
                sequence[mine] = run[:, 3] + k // run[:, 2]
                offset[mine] = run[:, 4] + (k % run[:, 2]) * one
            out = batch.drop_columns(["_rank"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(sequence), pa.array(offset)], names=[*out.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(placed, schema)


def pack(df: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    A document is its ids followed by end_id; only documents longer than ``size`` are cut, into pieces of
    ``size`` with the shorter one first. Null texts count as empty and become the end id alone; null or
    repeated document ids are packed like any other row; other columns are ignored; an empty table gives an
    empty result. Numbers of sequences start at 0 and the pieces of one fill it without gaps from 0. A text may be as
    long as one task can hold its ids.
    """
    return packed(staged(tokenized(df, vocabulary, size, end_id, id_col, text_col, with_ids), "pieces"), size)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed token arrays: sequence_id, ids, doc_ids, lengths, from pack(..., with_ids=True).

    A sequence has at most ``size`` ids, in the order of their places; pieces of null, empty and repeated rows are in it
    like any other, long texts in several sequences. No pieces: no sequences.
    """
    rows = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return pieces.groupBy("sequence_id").agg(rows.alias("_r")).select("sequence_id", F.expr("flatten(transform(_r, x -> x.ids))").alias("ids"), F.expr("transform(_r, x -> x.doc_id)").alias("doc_ids"), F.expr("transform(_r, x -> x.length)").alias("lengths"))


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_vocabulary(), with_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
