"""Byte-level BPE: overlapping chunks are cut into pre-tokens, stitched, encoded and decoded."""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillgraph.llm.common import documents

#: Characters of a chunk, and of what it shares with the next.
CHUNK, OVERLAP = 1 << 15, 1 << 8
#: Entries of a worker's memo of encoded pieces; it starts anew beyond.
MEMO = 500_000


class _Memo(dict):
    """Packed 32-bit ids of pre-tokens."""

    def __init__(self, coder: Bpe):
        self.coder = coder

    def __missing__(self, piece: str) -> bytes:
        found = self[piece] = array("I", self.coder.merge(piece.encode())).tobytes()
        return found


class Bpe:
    """Encoder and decoder for one table of byte strings to ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.token[rank] = piece
        self.text_of = [str(i) for i in range(len(self.token))]
        self.memo = _Memo(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the adjacent pair of the lowest rank merges, leftmost first, until none is left."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > 256:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low == 1 << 60:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap over a linked list, for pieces in which a scan for each merge would be too slow."""
        ranks, n = self.ranks, len(piece)
        part = [piece[i : i + 1] for i in range(n)]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            j = right[i] if part[i] else n
            if not part[i] or j >= n or len(part[i]) + len(part[j]) != size or ranks.get(part[i] + part[j]) != r:
                continue
            part[i] += part[j]
            part[j] = b""
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for a in (left[i], i):
                if a >= 0 and right[a] < n and (r := ranks.get(part[a] + part[right[a]])) is not None:
                    heapq.heappush(heap, (r, a, len(part[a]) + len(part[right[a]])))
        return [ranks[p] for p in part if p]

    def pre_tokens(self, text: str) -> list[str]:
        """The pattern's matches, which cover a text without gaps, in a text of any length.

        Chunks that overlap are matched each by itself, from its own start, so
        they could be matched anywhere and in any order. A chunk's first matches
        may be wrong, as it can begin within a word; from the first place in the
        overlap at which the chunk before also ends a match, both agree, and the
        later chunk takes over. Where two have no such place (a pre-token longer
        than the overlap) what follows the earlier one's last sure match is
        matched anew.
        """
        size = len(text)
        found: list[str] = []
        end = 0  # of what is found
        for start in range(0, max(size, 1), CHUNK):
            high = min(size, start + CHUNK + OVERLAP)
            low = max(0, start - OVERLAP)
            own = self.pattern.findall(text[low:high])
            if start:
                # ends of the last matches found and of the first ones here, within the overlap
                known, n = {end: len(found)}, len(found)
                at = end
                while n and at > low:
                    n -= 1
                    at -= len(found[n])
                    known[at] = n
                at, skip = low, 0
                while at not in known and skip < len(own):
                    at += len(own[skip])
                    skip += 1
                if at in known and at > low:
                    del found[known[at] :]
                    own = own[skip:]
                else:
                    own = self.pattern.findall(text[end:high])
                    at = end
                low = at
            found += own
            end = high
            while found and high < size and end >= high - 2:  # the last match may go on beyond the chunk, and one just before it may hang on what follows
                end -= len(found.pop())
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, as unsigned 32-bit integers; pre-tokens are memoised."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.pre_tokens(text))), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, joined; they need not be whole characters."""
        return b"".join(map(self.token.__getitem__, ids.tolist()))

    def digits(self, ids: np.ndarray) -> str:
        """Decimal ids joined by one space."""
        return " ".join(map(self.text_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def from_ranks(path: str, pattern: str) -> Bpe:
    """An encoder from a file of base64 byte strings and ranks."""
    with open(path, "rb") as lines:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


@lru_cache(maxsize=4)
def from_json(path: str, pattern: str) -> tuple[Bpe, dict[str, int]]:
    """An encoder from a tokenizer's JSON file, and its added tokens.

    The file writes bytes as printable characters. A merge's rank is the order
    of the ids that merges make.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}
    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(shown[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in added}
    return Bpe(ranks, pattern), added


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text of docs(doc_id, text).

    path is a rank file that every executor can open; pattern cuts pre-tokens.
    Null and empty texts have no tokens; their digests are those of nothing.
    Each row of docs gives one row, repeated ones too. No shuffle; memory is
    that of one Arrow batch and a bounded memo.
    """

    def run(batches):
        coder = from_ranks(path, pattern)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                ids = coder.encode(text) if text else np.empty(0, np.uint32)
                out.append((len(ids), hashlib.sha256(coder.digits(ids).encode()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
            n, coded, decoded = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
