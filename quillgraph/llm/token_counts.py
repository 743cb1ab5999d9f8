"""Token counts by a finite-state transducer compiled from a subword vocabulary."""

from __future__ import annotations

import heapq
import re
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import documents

MARK = "▁"
#: States of a worker's transducer, and memoised words; beyond, it is compiled anew.
STATES, WORDS = 300_000, 500_000
#: Characters of a chunk whose state map is computed by itself.
CHUNK = 1 << 15

_RUNS = re.compile(" +[^ ]*")


class Transducer:
    """Deterministic transducer over characters that counts the tokens of one pre-token.

    After a prefix of a pre-token, the tokens of the whole follow from the last
    token of each shorter prefix, as far back as a vocabulary entry can still be
    continued. That is a state. A transition reads a character and carries the
    change of the number of tokens, which falls where tokens join. Two tokens may
    stand side by side exactly if the merges of their joined text leave them so;
    a sequence is the merges' result exactly if all its neighbours may, so the
    last token of a prefix is the longest one that may follow what precedes it.
    States are made when first reached and kept.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.starts = {p[:k] for p in scores for k in range(1, len(p) + 1)}
        self.made_of: dict[str, tuple[str, str] | None] = {}
        self.beside: dict[tuple, bool] = {}
        self.words: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [("", (None,), (0,))]
        self.number = {self.states[0]: 0}
        self.step: dict[tuple[int, str], tuple[int, int]] = {}

    def merges(self, text: str) -> list[str]:
        """The best-scored adjacent pair joins, leftmost of equals, until none is in the vocabulary."""
        score, n = self.scores.get, len(text)
        part, right, left = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, i, 2) for i in range(n - 1) if (s := score(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = right[i]
            if not part[i] or j >= n or len(part[i]) + len(part[j]) != size:  # one of the two has joined another
                continue
            part[i] += part[j]
            part[j] = ""
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for a in (left[i], i):
                if a >= 0 and right[a] < n and (s := score(part[a] + part[right[a]])) is not None:
                    heapq.heappush(heap, (-s, a, len(part[a]) + len(part[right[a]])))
        return [p for p in part if p]

    def cost(self, part: str) -> int:
        """Tokens of a part: one, or its bytes where the vocabulary lacks it."""
        return 1 if part in self.scores else len(part.encode())

    def halves(self, part: str) -> tuple[str, str] | None:
        """The two parts whose joining makes an entry; None for a single character, or if merges never make it."""
        if part in self.made_of:
            return self.made_of[part]
        found = None
        if len(part) > 1 and self.merges(part) == [part]:
            low = self.scores[part]
            # without the entry itself, merges stop at its two halves
            del self.scores[part]
            rest = self.merges(part)
            self.scores[part] = low
            found = (rest[0], rest[1]) if len(rest) == 2 else None
        self.made_of[part] = found
        return found

    def may_follow(self, before: str | None, part: str) -> bool:
        """Whether merges leave the two side by side.

        Their last merges are undone, the worse-scored first. What then meets at
        the border must not form an entry that scores better than the merge that
        was undone last: that pair would have joined before. Of equal scores the
        left pair joins first.
        """
        if len(part) > 1 and not self.halves(part):
            return False
        if before is None:
            return True
        key = (before, part)
        if (found := self.beside.get(key)) is not None:
            return found
        score = self.scores.get
        a, b = before, part
        over, ties = float("-inf"), False  # a border pair above this score would have joined, or at it, with ties
        while True:
            s = score(a + b)
            if s is not None and (s > over or ties and s == over):
                found = False
                break
            left, right = self.halves(a), self.halves(b)
            if left is None and right is None:
                found = True
                break
            if right is None or left is not None and self.scores[a] < self.scores[b]:
                over, ties, a = self.scores[a], False, left[1]
            else:
                over, ties, b = self.scores[b], True, right[0]
        if len(self.beside) > 2 * STATES:
            self.beside.clear()
        self.beside[key] = found
        return found

    def make(self, state: int, char: str) -> tuple[int, int]:
        """The transition from a state on a character: (next state, change of the count)."""
        text, last, count = self.states[state]
        text += char
        size = len(text)
        for k in range(size):  # longest first
            part = text[k:]
            if (size - k == 1 or part in self.scores) and self.may_follow(last[k], part):
                break
        more = count[k] + self.cost(part) - count[-1]
        last, count = last + (part,), count + (count[-1] + more,)
        drop = 0
        while drop < size and text[drop:] not in self.starts:
            drop += 1
        base = count[-1]
        key = (text[drop:], last[drop:], tuple(c - base for c in count[drop:]))
        if (to := self.number.get(key)) is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        self.step[state, char] = to, more
        return to, more

    def run(self, word: str, state: int = 0) -> tuple[int, int]:
        """(state, tokens) after reading a word."""
        tokens, step = 0, self.step
        for char in word:
            found = step.get((state, char)) or self.make(state, char)
            state = found[0]
            tokens += found[1]
        return state, tokens

    def word(self, word: str) -> int:
        """Tokens of a pre-token, given without its first space; with all its spaces if it has several."""
        if len(self.states) > STATES:
            self.reset()
        if len(self.words) > WORDS:
            self.words.clear()
        if word[:1] == " ":  # runs of spaces: their entries share one score, so order decides and the merges themselves are run
            n = sum(map(self.cost, self.merges(word.replace(" ", MARK))))
        else:
            n = self.run(MARK + word)[1]
        self.words[word] = n
        return n

    # A space after another character starts the transducer anew, whatever its
    # state was. So the map of a chunk is: what it adds to the pre-token that is
    # open before it, the tokens of those within, and the pre-token that it
    # leaves open. None for the middle: the chunk has no such space.

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        first = re.search("(?<=[^ ]) ", chunk)
        if not first:
            return chunk, None, ""
        last = len(chunk) - len(re.search(" +[^ ]*$", chunk)[0])
        return chunk[: first.start()], self.inner(chunk[first.start() : last]), chunk[last:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of a chunk and its right neighbour; associative, so chunks can be joined in any grouping."""
        if a[1] is None and b[1] is None:
            return self.chunk_map(a[0] + b[0])
        if a[1] is None:
            head, n, tail = self.chunk_map(a[0] + b[0])
            return (head, b[1], b[2]) if n is None else (head, n + self.inner(tail) + b[1], b[2])
        if b[1] is None:
            head, n, tail = self.chunk_map(a[2] + b[0]) if a[2] else self.chunk_map(b[0])
            return (a[0], a[1], head) if n is None else (a[0], a[1] + self.inner(head) + n, tail)
        return a[0], a[1] + self.inner(a[2] + b[0]) + b[1], b[2]

    def inner(self, text: str) -> int:
        """Tokens of a stretch that begins and ends at pre-token boundaries, first space included."""
        if not text:
            return 0
        words = self.words
        if "  " in text or text[0] != " " or text[-1] == " ":
            pieces = [p if p[1:2] == " " or p == " " else p[1:] for p in _RUNS.findall(text if text[0] == " " else " " + text)]
        else:
            pieces = text[1:].split(" ")
        try:
            return sum(map(words.__getitem__, pieces))
        except KeyError:
            return sum(words[p] if p in words else self.word(p) for p in pieces)

    def count(self, text: str) -> int:
        """Tokens of a text, to which one space is prefixed unless it is empty."""
        if not text:
            return 0
        text = " " + text.replace(MARK, " ")
        if len(text) <= CHUNK:
            return self.inner(text)
        maps = [self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:  # neighbours join, round by round, as a scan over processors would
            maps = [reduce(self.compose, maps[i : i + 2]) for i in range(0, len(maps), 2)]
        head, n, tail = maps[0]
        return self.inner(head) if n is None else self.inner(head) + n + self.inner(tail)


@lru_cache(maxsize=2)
def from_model(path: str) -> Transducer:
    """The transducer of a BPE model file with byte fallback and no normalisation."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return Transducer({model.id_to_piece(i): model.get_score(i) for i in plain})


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every text of docs(doc_id, text).

    path: a model file that every executor can open. A null text counts as
    empty: no bytes, no tokens. Each row gives one row, repeated ones too. No
    shuffle; a worker holds one Arrow batch and a bounded transducer.
    """

    def run(batches):
        count = from_model(path).count
        for batch in batches:
            n = [count(t) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes")
    return documents(docs, size).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
