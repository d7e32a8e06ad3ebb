"""Token counts by byte-pair merging with a heap and a linked list; no id is ever made."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintmark.llm.common import slices, texts
from glintmark.llm.encoding import PerWord, shared


def count_merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after merging: the adjacent pair of lowest rank, leftmost first, is merged until none has a rank."""
    n = len(symbols)
    if n < 2:
        return n
    heap = [(r, i, i + 1) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := ranks.get(pair)) is not None]
    if not heap:
        return n
    heapq.heapify(heap)
    text: list[str | None] = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    merges = 0
    while heap:
        rank, i, j = heapq.heappop(heap)
        left, right = text[i], text[j] if j < n else None
        if left is None or right is None or after[i] != j or ranks.get((left, right)) != rank:
            continue  # one of the two has been merged meanwhile
        merges += 1
        text[i], text[j] = left + right, None
        nxt = after[i] = after[j]
        if nxt < n:
            before[nxt] = i
            if (r := ranks.get((text[i], text[nxt]))) is not None:
                heapq.heappush(heap, (r, i, nxt))
        prev = before[i]
        if prev >= 0 and (r := ranks.get((text[prev], text[i]))) is not None:
            heapq.heappush(heap, (r, prev, i))
    return n - merges


class Counter(PerWord):
    """``count(text)`` for a byte-pair vocabulary file of the tokenizers library."""

    def __init__(self, path: str, most: int = 800_000):
        super().__init__(path, most)
        model = json.loads(self.library.to_str())["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain byte-pair vocabularies are counted")
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.end = model.get("end_of_word_suffix") or ""

    def part(self, pretoken: str) -> int:
        symbols = list(pretoken)
        if symbols and self.end:
            symbols[-1] += self.end
        return count_merged(symbols, self.ranks)

    def word(self, word: str) -> int:
        """Any text: special strings count one, the rest is cut by the library's own steps."""
        total, library = 0, self.library
        for i, piece in enumerate(re.split("(" + "|".join(map(re.escape, self.specials)) + ")", word) if self.specials else [word]):
            if i % 2:
                total += 1
            elif piece:
                piece = library.normalizer.normalize_str(piece) if library.normalizer else piece
                total += sum(self.part(p) for p, _ in library.pre_tokenizer.pre_tokenize_str(piece)) if library.pre_tokenizer else self.part(piece)
        return total

    def count(self, text: str) -> int:
        return sum(self.values(text))


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens) of every row, without a shuffle.

    ``vocabulary`` is a file that every executor can open. Special strings inside texts count as one token. Null text
    counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids are counted each; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared(Counter, vocabulary)
        for b in slices(batches):
            counts = [counter.count(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = texts(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
