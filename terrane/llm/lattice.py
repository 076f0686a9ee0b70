"""Token counts by trie-shared dynamic programming: one forward pass for each prefix that pre-tokens share."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from terrane.llm.shared import text_slices

#: Scores are whole millionths of a nat, so that ties are exact.
UNIT = 1_000_000


class Unigram:
    """Best segmentations of byte strings into tokens of highest total score, of fewest tokens among equals.

    The vocabulary file has ranks, not probabilities: a token of rank r has the probability that Zipf's law
    gives it, in proportion to 1 / (r + 1). Every byte must be a token, so every string has a segmentation.
    """

    def __init__(self, scores: dict[bytes, int]):
        self.scores = scores
        self.longest = max(map(len, scores), default=0)
        if missing := [b for b in range(256) if bytes([b]) not in scores]:
            raise ValueError(f"no token for the bytes {missing}")
        #: Lengths that tokens with a given last byte have, longest first.
        ends: dict[int, set[int]] = {}
        for token in scores:
            ends.setdefault(token[-1], set()).add(len(token))
        self.lengths = {b: sorted(n) for b, n in ends.items()}

    @classmethod
    def from_ranks(cls, path: str) -> Unigram:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        total = math.log(sum(1 / (r + 1) for r in ranks.values()))
        return cls({token: round(-UNIT * (math.log(r + 1) + total)) for token, r in ranks.items()})

    def counts(self, strings: Iterable[bytes]) -> dict[bytes, int]:
        """Tokens of the best segmentation of each distinct string.

        In sorted order the strings are the terminals of their trie as a depth-first walk meets them. The
        forward scores of the current path stay on a stack; a string keeps those of the prefix that it shares
        with the one before it and adds one for each new node, so no node is scored twice.
        """
        scores, lengths, out = self.scores, self.lengths, {}
        best, tokens = [0], [0]
        before = b""
        for string in sorted(set(strings)):
            shared = 0
            for a, b in zip(before, string, strict=False):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(string) + 1):
                top, fewest = None, 0
                for n in lengths[string[end - 1]]:
                    if n > end:
                        break
                    score = scores.get(string[end - n : end])
                    if score is not None:
                        score += best[end - n]
                        count = tokens[end - n] + 1
                        if top is None or score > top or (score == top and count < fewest):
                            top, fewest = score, count
                best.append(top)
                tokens.append(fewest)
            out[string] = tokens[len(string)]
            before = string
        return out


_models: dict[str, Unigram] = {}


def token_counts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of each whole text, cut into pre-tokens by `pattern`.

    Distinct pre-tokens of a slice of documents are counted once. A null text counts as empty, with no
    tokens; what the pattern leaves out has none. Repeated rows are kept; an empty table gives an empty one;
    other columns are left out. Every executor has the file `ranks_path`. A text is worked on whole: a task takes about 10
    bytes for each byte of its longest one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        if ranks_path not in _models:
            _models[ranks_path] = Unigram.from_ranks(ranks_path)
        model, find = _models[ranks_path], regex.compile(pattern).findall
        for batch in text_slices(batches):
            split = [find(t or "") for t in batch.column(1).to_pylist()]
            distinct = {w for words in split for w in words}
            known = model.counts([w.encode() for w in distinct])
            by_word = {w: known[w.encode()] for w in distinct}
            counts = [sum(map(by_word.__getitem__, words)) for words in split]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, split)), pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long")
