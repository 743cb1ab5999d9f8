"""Packing token streams into fixed windows by order-preserving dynamic programming."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillgraph.llm.bpe import from_json
from quillgraph.llm.common import documents

#: What a cut costs, in tokens of padding: after a document, after a sentence; and, as a share of the window, inside a sentence.
CUT_DOCUMENT, CUT_SENTENCE, CUT_INSIDE = 0.0, 0.5, 1 / 20
#: Sentences of over this share of the window have places to cut, one every STRIDE tokens; shorter ones have none.
LONGEST, STRIDE = 1 / 18, 8
#: Tokens that are planned at once.
BLOCK = 1 << 18
#: Sequence ids of a task begin at its number times this.
TASK = 1 << 40

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ends string"


def plan(places: np.ndarray, penalty: np.ndarray, width: int) -> list[int]:
    """Indices of places at which windows of at most width tokens end, at the least cost.

    places ascend from 0; neighbours are at most width apart. A window from i to
    j costs its padding, width - (places[j] - places[i]), and penalty[j]. So
    cost(j) = penalty(j) + width - places(j) + min over i of (cost(i) +
    places(i)), a minimum over a window that slides with j: a queue of rising
    keys holds it, and all is linear. Of equal keys the later place wins.
    """
    at, extra = places.tolist(), penalty.tolist()
    n = len(at)
    key, back = [0.0] * n, [0] * n
    queue: deque[int] = deque([0])
    for j in range(1, n):
        here = at[j]
        low = here - width
        while at[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        back[j] = i
        k = key[j] = extra[j] + width + key[i]
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    if n > 1:
        open_end = range(bisect_left(at, at[-1] - width, 0, n - 1), n - 1)
        back[-1] = min(open_end, key=lambda i: (key[i] - at[i], -i))
    ends, j = [], n - 1
    while j > 0:
        ends.append(j)
        j = back[j]
    return ends[::-1]


def _places(lengths: np.ndarray, sentence: np.ndarray, width: int, inside: float = CUT_INSIDE, longest: float = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end, and what it costs: sentence ends, document ends, and places within sentences that are too long to be moved whole."""
    ends = np.cumsum(lengths)
    sure = np.unique(np.concatenate(([0], sentence, ends)))
    gaps, most, stride = np.diff(sure), max(longest * width, 1), max(1, min(STRIDE, int(longest * width)))
    extra = [np.arange(a + stride, b, stride) for a, b in zip(sure[:-1][gaps > most], sure[1:][gaps > most])]
    places = np.unique(np.concatenate([sure, *extra]))
    penalty = np.full(len(places), inside * width)
    penalty[np.searchsorted(places, sentence)] = CUT_SENTENCE
    penalty[np.searchsorted(places, ends)] = CUT_DOCUMENT
    return places, penalty


def _halved(low: int, high: int, width: int) -> list[int]:
    """Ends of a partition's last window, cut into powers of two: sequences of such a length need no padding."""
    ends, size = [], width
    while low < high:
        while size > high - low:
            size //= 2
        low += size
        ends.append(low)
    return ends


#: Texts of so many characters are looked through for runs of RUN characters that are all or none white space.
LONG, RUN = 1 << 15, re.compile(r"\s{4096}|\S{4096}")


@lru_cache(maxsize=2)
def library(path: str, pattern: str):
    """A function from a text to its ids, by the byte-level BPE library that is fastest here, from the tokenizer file's vocabulary.

    That library gives up on white space of half a million characters in a row,
    and may be slow on very long words; texts with such runs are cut into
    pre-tokens by overlapping chunks and merged by `Bpe`, which gives the same ids.
    """
    import tiktoken

    coder, _ = from_json(path, pattern)
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=coder.ranks, special_tokens={}).encode_ordinary

    def encode(text: str) -> list[int]:
        return coder.encode(text).tolist() if len(text) >= LONG and RUN.search(text) else fast(text)

    return encode


def pack(docs: DataFrame, path: str, pattern: str, width: int = 2048, end_id: int = 1, end_marks: bytes = b".!?\n", inside: float = CUT_INSIDE, longest: float = LONGEST) -> DataFrame:
    """Pieces of docs(doc_id, text) in sequences of at most width tokens.

    Each text's ids, by the tokenizer file at path, and end_id follow one
    another in the order of the input's partitions; cuts fall where `plan` says.
    Every id lies in one piece; ends says if that stops at its document's or a
    sentence's end or inside one. A null or empty text is end_id alone. Each
    partition packs its own rows, block by block, with what is left of a block
    carried into the next: no shuffle, memory of one block, and a few short
    sequences a partition at most, of powers of two of tokens. The input's order in a partition fixes the
    result, so a task that runs again gives the same rows. Rows with the same or
    a null doc_id are packed as separate documents.
    """

    def run(batches):
        coder, added = from_json(path, pattern)
        encode = library(path, pattern)
        ends_sentence = np.array([t.rstrip(b" ")[-1:] in [end_marks[i : i + 1] for i in range(len(end_marks))] for t in coder.token] + [False] * 4096)
        special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        first = TaskContext.get().partitionId() * TASK

        def ids_of(text):
            if special is not None and special.search(text):
                ids, at = [], 0
                for m in special.finditer(text):
                    ids += [*encode(text[at : m.start()]), added[m[0]]]
                    at = m.end()
                return np.array([*ids, *encode(text[at:]), end_id], np.uint32)
            ids = encode(text)
            ids.append(end_id)
            return np.array(ids, np.uint32)

        held: list[tuple] = []  # (doc_id, ids, start of these in the document, its tokens)
        waiting = 0

        def flush(last: bool):
            nonlocal held, waiting, first
            if not held:
                return None
            ids = np.concatenate([x[1] for x in held])
            lengths = np.array([len(x[1]) for x in held])
            doc_at = np.concatenate(([0], np.cumsum(lengths)))
            sentence = np.flatnonzero(ends_sentence[np.minimum(ids, len(ends_sentence) - 1)]) + 1
            places, penalty = _places(lengths, sentence, width, inside, longest)
            windows = places[[0, *plan(places, penalty, width)]]
            if last:
                windows = np.concatenate((windows[:-1], _halved(int(windows[-2]), int(windows[-1]), width)))
            if not last and len(windows) > 2:
                windows = windows[:-1]
            elif not last:
                return None
            stop = windows[-1]
            cuts = np.unique(np.concatenate((windows, doc_at[doc_at < stop])))
            begin, length = cuts[:-1], np.diff(cuts)
            doc = np.searchsorted(doc_at, begin, "right") - 1
            seq = np.searchsorted(windows, begin, "right") - 1
            data = ids.astype("<u4").tobytes()
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([held[d][0] for d in doc], pa.int64()),
                    pa.array(np.array([held[d][2] for d in doc], np.int64) + begin - doc_at[doc]),
                    pa.array(length.astype(np.int64)),
                    pa.array([zlib.crc32(data[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), length.tolist())], pa.int64()),
                    pa.array([held[d][3] for d in doc], pa.int64()),
                    pa.array(seq.astype(np.int64) + first),
                    pa.array((begin - windows[seq]).astype(np.int64)),
                    pa.array(np.where(np.isin(cuts[1:], doc_at), "document", np.where(np.isin(cuts[1:], sentence), "sentence", "inside")), pa.string()),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ends"],
            )
            first += len(windows) - 1
            rest, d = [], int(np.searchsorted(doc_at, stop, "right")) - 1
            for k in range(d, len(held)):
                skip = max(0, int(stop - doc_at[k]))
                if skip < len(held[k][1]):
                    rest.append((held[k][0], held[k][1][skip:], held[k][2] + skip, held[k][3]))
            held, waiting = rest, int(len(ids) - stop)
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = ids_of(text or "")
                held.append((doc_id, ids, 0, len(ids)))
                waiting += len(ids)
                if waiting >= BLOCK and (out := flush(False)) is not None:
                    yield out
        if (out := flush(True)) is not None:
            yield out

    return documents(docs).mapInArrow(run, SCHEMA)
