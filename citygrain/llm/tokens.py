"""Token counts of whole texts with a public tokenizer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: Rank file of a byte-level BPE; any file of base64 tokens and ranks with the pattern below will do.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORDS = re.compile(r"\s*\S+|\s+")
#: Words whose counts a worker remembers at a time; beyond it the memory starts anew.
REMEMBERED = 400_000
_SENT: set[tuple[str, str]] = set()


class _Counts(dict):
    """Token count by word. White space begins a new piece of the pattern, so a text's count is the sum of its words'."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> int:
        n = len(self.encode(word))
        if len(word) < 40:
            self[word] = n
        return n


@lru_cache(maxsize=4)
def token_counter(path: str = TOKENIZER):
    """A function from text to its number of tokens; one per worker and file."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    counts = _Counts(tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)

    def count(text: str | None) -> int:
        if not text:
            return 0
        if len(counts) > REMEMBERED:
            counts.clear()
        return sum(map(counts.__getitem__, _WORDS.findall(text)))

    return count


def with_token_counts(docs: DataFrame, keep: list[str], text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` and n_tokens of the whole text; null and empty texts have 0. A narrow scan, no shuffle.

    Only ``keep`` and the text column are read, so other columns do not matter. The text itself goes no further. The
    rank file is sent to the executors, which need not have it at ``path``.
    """
    sc = docs.sparkSession.sparkContext
    if (sc.applicationId, path) not in _SENT:
        sc.addFile(path)
        _SENT.add((sc.applicationId, path))
    name = Path(path).name
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(SparkFiles.get(name))
        for batch in batches:
            n = pa.array([count(t.as_py()) for t in batch.column(len(keep))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n], names=[*keep, "n_tokens"])

    return docs.select(*keep, text).mapInArrow(kernel, f"{fields}, n_tokens long")
