"""Token counts of a unigram tokenizer, without making the tokens.

An Aho-Corasick automaton lists all vocabulary pieces ending at each place of a word; dynamic programming
carries the best score and the piece count of its path. Ties go as in the tokenizers library: of paths with
equal score into a place, the one whose last piece is longest stays. A character that no piece covers costs
the lowest score less ten, and counts as many pieces as it has UTF-8 bytes (byte fallback).

Texts are cut before each space, as the library's Metaspace step does, so counts of words add up and each
worker remembers those it has met, in a table of bounded size.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words remembered by a worker at most, and the longest of them.
MEMORY, LONGEST = 400_000, 48


def unigram_vocabulary(model_file: str) -> list[tuple[str, float]]:
    """(piece, score) for a sentencepiece file: -ln(rank), by its order; special and byte pieces come last.

    The public files hold no unigram model; this rule turns the order of their pieces into scores.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.get_piece_size()
    out = []
    for i in range(n):
        special = sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        out.append((sp.id_to_piece(i), -math.log(n + 1) - 1 if special else -math.log(i + 1)))
    return out


class Counter:
    """count(text) -> (pieces, score)."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[int, float]] = {}

    def word(self, s: str) -> tuple[int, float]:
        """Pieces and score of a string that is cut no further."""
        n, unknown = len(s), self.unknown
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        at, top, pieces, single = 0, -math.inf, 0, False
        matches = self.automaton.iter(s)
        end, (length, score) = next(matches, (n, (0, 0.0)))
        for at in range(1, n + 1):
            top, single = -math.inf, False
            while end == at - 1:  # the longest piece comes first
                path = best[at - length] + score
                if path > top:
                    top, pieces = path, count[at - length] + 1
                single = single or length == 1
                end, (length, score) = next(matches, (n, (0, 0.0)))
            if not single and (path := best[at - 1] + unknown) > top:
                top, pieces = path, count[at - 1] + len(s[at - 1].encode("utf-8", "surrogatepass"))
            best[at], count[at] = top, pieces
        return count[n], best[n]

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        words = text.replace(SPACE, " ").split(" ")
        if not words[0]:  # the text's own leading space is the first mark
            del words[0]
        known, pieces, total = self.known, 0, 0.0
        for w in words:
            found = known.get(w)
            if found is None:
                found = self.word(SPACE + w)
                if len(w) <= LONGEST:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[w] = found
            pieces += found[0]
            total += found[1]
        return pieces, total


#: One counter per worker, kept from task to task.
_counters: dict[int, Counter] = {}


def token_counts(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, score) for each row: pieces of the best segmentation and its log score.

    Null and empty texts have 0 tokens and score 0. Null and repeated ids are kept; other columns are
    ignored, and an empty table gives no rows. A text may be of any length; memory is linear in its longest run without a space.
    """
    pieces = unigram_vocabulary(model_file)
    key = hash(tuple(pieces))
    vocabulary = df.sparkSession.sparkContext.broadcast(pieces)  # as large as the file
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def each(batches):
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(vocabulary.value)
        count = _counters[key].count
        for batch in batches:
            found = [count(x.as_py() or "") for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return rows.mapInArrow(each, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, score double")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
