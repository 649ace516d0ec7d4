"""Token counts of a sentencepiece BPE model, exact for texts of any length.

Encoding takes longer than linear time and much memory on huge texts, so those
are encoded in overlapping chunks with offsets. Two neighbouring chunks are
spliced where both have a token boundary that is proven stable: the two
characters around it stand next to each other in no piece of the vocabulary,
so no merge can cross it, and what is left of it can't change what is right of
it. If the overlap has no such boundary it is widened, at last to both chunks.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsift.llm.words import mapped, texts

SPACE = "▁"


class PieceCounter:
    def __init__(self, model_file: str, chunk: int = 16_384, overlap: int = 128):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.chunk, self.overlap = chunk, overlap
        self.widened = 0
        plain = [self.model.id_to_piece(i) for i in range(self.model.vocab_size()) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        self.joined = {a + b for piece in plain for a, b in zip(piece, piece[1:])}
        # The proof holds only if the model encodes characters as they are.
        seen = self.model.encode("a  ﬁ á", out_type=str)
        self.as_is = "".join(seen) == f"{SPACE}a{SPACE}{SPACE}ﬁ{SPACE}á"

    def stable(self, raw: bytes, at: int) -> bool:
        """Whether no piece can cover both characters around ``at``."""
        left, right = raw[max(0, at - 4) : at].decode(errors="ignore"), raw[at : at + 4].decode(errors="ignore")
        return (left[-1:] + right[:1]).replace(" ", SPACE) not in self.joined

    def _encoded(self, raw: bytes, start: int, end: int) -> list[int]:
        """Where the tokens of raw[start:end] begin, in bytes of the text."""
        return [start + p.begin for p in self.model.encode(raw[start:end].decode(), return_type="proto").pieces]

    def count_huge(self, raw: bytes) -> int:
        total, done, start, end = 0, 0, 0, _whole(raw, self.chunk)
        left = self._encoded(raw, start, end)
        while end < len(raw):
            overlap = self.overlap
            while True:
                start_next, end_next = max(start, _whole(raw, end - overlap)), _whole(raw, end + self.chunk)
                right = self._encoded(raw, start_next, end_next)
                # Boundaries at the very rim of either chunk prove nothing.
                both = set(left[bisect_left(left, max(start_next, done) + 1) :]) & set(right[: bisect_left(right, end)])
                at = max((p for p in both if self.stable(raw, p)), default=None)
                if at is not None or start_next <= start:
                    break
                overlap *= 2
                self.widened += 1
            if at is not None:  # else the right chunk holds all of the left one
                total += bisect_left(left, at) - bisect_left(left, done)
                done = at
            start, end, left = start_next, end_next, right
        return total + len(left) - bisect_left(left, done)

    def counts(self, values: list[bytes]) -> list[int]:
        huge = [self.as_is and len(v) > self.chunk + self.overlap for v in values]
        short = iter(self.model.encode([v.decode() for v, far in zip(values, huge) if not far], num_threads=1))
        return [self.count_huge(v) if far else len(next(short)) for v, far in zip(values, huge)]


def _whole(raw: bytes, at: int) -> int:
    """The end of the text, or ``at`` or up to three places before, where a character begins."""
    if at >= len(raw):
        return len(raw)
    at = max(at, 0)
    while raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, chunk: int = 16_384, overlap: int = 128) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text.

    A null text is an empty one: no bytes, no tokens. One row comes out for
    each that goes in; other columns are not read.
    """
    made = {}

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "c" not in made:
            made["c"] = PieceCounter(model_file, chunk, overlap)
        raw = [v or b"" for v in texts(batch)]
        n = made["c"].counts(raw)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(v) for v in raw], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(mapped(step), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
