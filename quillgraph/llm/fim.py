"""Fill-in-middle: texts cut into prefix, middle and suffix between code points, by rank and select over packed bits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import documents

#: What stands before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Words of 64 bits in a block of the directory.
WORDS = 8


class Boundaries:
    """Rank and select over the bytes of UTF-8 that begin a code point.

    One bit a byte, packed into 64-bit words; a directory holds how many bits
    are set before each block of WORDS words. Both answer arrays of questions.
    """

    def __init__(self, data: np.ndarray):
        packed = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        whole = np.zeros(-(-max(len(packed), 1) // (8 * WORDS)) * 8 * WORDS, np.uint8)
        whole[: len(packed)] = packed
        self.words = whole.view("<u8").reshape(-1, WORDS)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).sum(1, dtype=np.int64))))

    @property
    def total(self) -> int:
        return int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many code points begin before each byte."""
        block = np.minimum(at // (64 * WORDS), len(self.words) - 1)
        left = at - block * 64 * WORDS  # bits of the block before the byte; all of them after the last block
        bits = np.clip(left[:, None] - 64 * np.arange(WORDS), 0, 64).astype(np.uint64)
        full = np.uint64(2**64 - 1)
        mask = np.where(bits == 64, full, ~(full << np.minimum(bits, np.uint64(63))))
        return self.before[block] + np.bitwise_count(self.words[block] & mask).sum(1, dtype=np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte that begins the k-th code point, counted from 0; k is less than the total."""
        block = np.searchsorted(self.before, k, "right") - 1
        words = self.words[block]
        up_to = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        rest = k - self.before[block]
        word = (up_to <= rest[:, None]).sum(1)
        rows = np.arange(len(k))
        rest = rest - np.where(word > 0, up_to[rows, np.maximum(word - 1, 0)], 0)
        bits = np.unpackbits(np.ascontiguousarray(words[rows, word])[:, None].view(np.uint8), axis=1, bitorder="little")
        bit = (np.cumsum(bits, axis=1, dtype=np.int64) <= rest[:, None]).sum(1)
        return (block * WORDS + word) * 64 + bit


def _draw(seed: str, n: int) -> Column:
    """The n-th group of eight hex digits of the digest of seed, a colon and the id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * n + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: str = "1", plain: int = 10, spm: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, prefix_bytes, middle_bytes, output of every row of docs(doc_id, text).

    Of a text of n code points, two draws modulo n + 1 give where the prefix and
    the middle end; bytes are where that is in UTF-8. output is the text under
    form ``plain``, marks before prefix, suffix and middle under ``psm``, before
    suffix, prefix and middle under ``spm``. plain percent of all texts, empty
    ones and those that hold a mark stay plain, with null cuts; spm percent of
    the others are ``spm``. Draws are digests of seed and doc_id, so rows with
    one id are cut alike, and a null id counts as empty. A null text is empty.
    One row a row; no shuffle.

    The boundaries of all texts of an Arrow batch lie in one bit vector: ranks at
    a text's ends give n, and select of two ranks gives the cuts in bytes.
    """
    start, second, third = (m.encode() for m in marks)

    def run(batches):
        for batch in batches:
            column = batch.column("text").cast(pa.large_binary())
            size = batch.num_rows
            _, offsets, data = column.buffers()
            at = np.frombuffer(offsets, np.int64, size + 1, 8 * column.offset) if size else np.zeros(1, np.int64)
            view = np.frombuffer(data, np.uint8, at[-1]) if data is not None and at[-1] else np.zeros(0, np.uint8)
            view, at = view[at[0] :], at - at[0]
            bits = Boundaries(view)
            before = bits.rank(at)
            n = np.diff(before)
            h1, h2 = (batch.column(c).to_numpy() % (n + 1) for c in ("h1", "h2"))
            low, high = np.minimum(h1, h2), np.maximum(h1, h2)
            cuts = [np.where(x < n, bits.select(np.minimum(before[:-1] + x, max(bits.total - 1, 0))) if bits.total else 0, at[1:]) for x in (low, high)]
            raw, never, other = view.tobytes(), batch.column("never").to_numpy(zero_copy_only=False), batch.column("other").to_numpy(zero_copy_only=False)
            forms, outputs = [], []
            for a, p, m, e, count, stays, turned in zip(at[:-1].tolist(), cuts[0].tolist(), cuts[1].tolist(), at[1:].tolist(), n.tolist(), never.tolist(), other.tolist()):
                if stays or not count or any(raw.find(mark, a, e) >= 0 for mark in (start, second, third)):
                    forms.append("plain")
                    outputs.append(raw[a:e])
                elif turned:
                    forms.append("spm")
                    outputs.append(b"".join((second, raw[m:e], start, raw[a:p], third, raw[p:m])))
                else:
                    forms.append("psm")
                    outputs.append(b"".join((start, raw[a:p], second, raw[m:e], third, raw[p:m])))
            as_is = np.array([f == "plain" for f in forms], bool)
            measures = [pa.array(x, pa.int64(), mask=as_is) for x in (low, high - low, cuts[0] - at[:-1], cuts[1] - cuts[0])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(forms, pa.string()), *measures, pa.array(outputs, pa.binary()).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes", "output"],
            )

    rows = documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    drawn = rows.select("*", _draw(seed, 0).alias("h1"), _draw(seed, 1).alias("h2"), (_draw(seed, 2) % 100 >= 100 - plain).alias("never"), (_draw(seed, 3) % 100 < spm).alias("other"))
    return drawn.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long, output string")


def restored(output: Column | str = "output", form: Column | str = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output and its form were made from; exact, as no text with a mark in it is cut."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    escaped = "|".join("\\Q" + m + "\\E" for m in marks)
    part = F.split(output, escaped, -1)
    psm = F.concat(F.get(part, 1), F.get(part, 3), F.get(part, 2))
    spm = F.concat(F.get(part, 2), F.get(part, 3), F.get(part, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
