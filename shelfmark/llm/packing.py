"""Harmonic packing of tokenised documents into sequences of a fixed capacity."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import cut

END = 1
CACHED_BYTES = 200_000_000  # of units with their ids that a worker keeps
ENTRY_BYTES = 200  # an entry takes that beside its text and ids
BLOCK = 64
# Slots of rank below this many are taken as they are: cutting such short rests further saves nothing.
SHORT = 48
# Tokens before each unit never change its ids: white space attaches only forward, one space at most.
_UNIT = re.compile(r" ?\S+|\s+(?!\S)|\s+")
# Characters that Python counts as white space and the tokenizer does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_TAIL = ".,;:!?*&%$#|"
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, with the ids of frequent units kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.held = 0
        # In the vocabulary's own alphabet each byte is one character.
        size = self.tokenizer.get_vocab_size()
        self.width = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)])

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _units(self, units: list[str]) -> dict[str, bytes]:
        """Ids of each unit, from one pass over all of them in a row.

        Units that open with a space follow each other directly; others are set off by a line end, which is a token
        of its own. Units of white space alone are read singly. Tokens are cut where the units' bytes end."""
        found = {u: self._ids(u).tobytes() for u in units if u.isspace()}
        rest = [u for u in units if u not in found]
        if rest:
            joined = [u if u[0] == " " else "\n" + u for u in rest]
            ids = self._ids("".join(joined))
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(u.encode()) for u in joined])) + 1
            data, lo = ids.tobytes(), 0
            for u, hi in zip(rest, (4 * ends).tolist()):
                found[u] = data[lo if u[0] == " " else lo + 4:hi]
                lo = hi
        return found

    def encode(self, text: str) -> bytes:
        if _ODD_SPACE.search(text):
            return self._ids(text).tobytes()
        units, known = _UNIT.findall(text), self.known
        try:
            return b"".join(map(known.__getitem__, units))
        except KeyError:
            # A word and the marks after it are tokens apart: words are looked up without them.
            split = {}
            for u in dict.fromkeys(units):
                if u not in known:
                    word = u.rstrip(_TAIL)
                    split[u] = (word, u[len(word):]) if len(word) < len(u) and word[-1:].isalpha() else (u,)
            parts = dict.fromkeys(p for ps in split.values() for p in ps)
            fresh = self._units([p for p in parts if p not in known])
            for u, ps in split.items():
                if len(ps) > 1:
                    fresh[u] = b"".join([known.get(p) or fresh[p] for p in ps])
            grown = sum(len(u) + len(v) + ENTRY_BYTES for u, v in fresh.items())
            if self.held + grown <= CACHED_BYTES:
                self.held += grown
                known.update(fresh)
                return b"".join(map(known.__getitem__, units))
            return b"".join([known.get(u) or fresh[u] for u in units])


def pieces(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(size, class) of a document's pieces in order. Class k holds k pieces of at most capacity // k in a bin.

    A rest that fills its class's share to a thirtieth stays whole; another gives up a piece that fills the next
    share exactly, and what is left goes on."""
    while length:
        k = max(1, capacity // length)
        share = capacity // k
        if length > capacity:
            yield capacity, 1
            length -= capacity
        elif length < SHORT or share - length <= length // 30:
            yield length, k
            return
        else:
            size = capacity // (k + 1)
            yield size, k + 1
            length -= size


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("doc_tokens", pa.int64()), ("fit", pa.int32()), ("worker", pa.int64()), ("bin", pa.int64()),
                     ("offset", pa.int64())])


def _pack(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, bins, encoder = TaskContext.get().partitionId(), 0, Encoder.of(path)
        waiting: dict[int, list] = {}

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + END.to_bytes(4, "little")
                total, start = len(ids) // 4, 0
                for size, fit in pieces(total, capacity):
                    crc = zlib.crc32(ids[4 * start:4 * (start + size)])
                    queue = waiting.setdefault(fit, [])
                    queue.append((doc, start, size, crc, total))
                    start += size
                    if len(queue) == fit:
                        offset = 0
                        for one in queue:
                            rows.append((*one, fit, worker, bins, offset))
                            offset += one[2]
                        bins += 1
                        queue.clear()
            if rows:
                yield batch_of(rows)
        rest = [(*one, fit, worker, None, None) for fit, queue in sorted(waiting.items()) for one in queue]
        if rest:
            yield batch_of(rest)
    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Pieces of every document with their sequence and offset, no sequence over the capacity.

    A document's ids are its tokens and an end id. Lengths fall into classes by the reciprocal of the capacity: a bin
    of class k takes k pieces of at most capacity / k. Each worker fills its own bins class by class, which needs no
    exchange; the few pieces left in its open bins (under k for a class) are packed again over BLOCK workers
    at a time, by the same rule. Null and empty texts are the end id alone. Repeated rows are packed as often as they
    come; other columns are not read. An empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, fit int, worker long, bin long, "
              "offset long")
    placed = cut(base.mapInArrow(_pack(tokenizer_path, capacity), schema))
    full = placed.where("bin IS NOT NULL").withColumn("sequence_id", F.shiftleft("worker", 36) + F.col("bin"))
    rest = placed.where("bin IS NULL").withColumn("block", F.floor(F.col("worker") / BLOCK))
    order = ["worker", "doc_id", "start", "ids_crc32"]
    rest = rest.withColumn("bin", F.floor(
        (F.row_number().over(Window.partitionBy("fit", "block").orderBy(*order)) - 1) / F.col("fit")))
    before = Window.partitionBy("fit", "block", "bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = rest.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    # Fewer than BLOCK bins a class and block: 6 bits; classes up to the capacity: 16 bits; the sign bit sets them apart.
    rest = rest.withColumn("sequence_id", -1 - ((F.col("block") * 65536 + F.col("fit")) * BLOCK + F.col("bin")))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return full.select(columns).union(rest.select(columns))
