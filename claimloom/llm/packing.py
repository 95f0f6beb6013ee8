"""Sequence packing: shortest-pack-first over the histogram of piece lengths.

1. Every document is tokenised and cut into pieces: whole sequences, then what is left; from that the last
   bits below `grain` are cut off, so that large pieces are multiples of the grain and small ones fill gaps.
2. The histogram of piece lengths (at most `capacity` rows, whatever the corpus) is packed on the driver, the
   longest lengths first, each into the packs that are shortest so far; packs are kept as patterns with counts.
3. Pieces get their rank among those of their length, and the pattern table, as intervals of ranks, is joined
   back by rank.

Ranks need no global sort: each task of step 1 numbers its own pieces of a length, and the offsets of
(task, length) come from counts. Step 1 is written once, so ranks stay the same however often a task is rerun.

Token ids are those of the tokenizer file at `path`, without added special tokens; a special token that a text
spells is that token.

Defined cases: a null text is empty and is one end token; repeated rows are packed each on its own; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, saved, table

#: white space of this length is left to the tokenizer itself
WHITE = 10_000
_WHITE = re.compile(rf"\s{{{WHITE}}}")
#: The pattern by which the tokenizer splits words (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of() -> dict[str, int]:
    """The byte for which each character of a byte-level vocabulary stands: printable ones for themselves, the others
    in order for the characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Encoder:
    """Token ids of a text as little-endian 32-bit integers: those of the tokenizer file.

    Where the file's merges go by the order of the ids they make, the same vocabulary runs in tiktoken, at a third of the
    time; otherwise the tokenizer itself encodes, as it does texts with characters that Unicode has not assigned, which
    libraries may split apart otherwise, and texts with very long white space, on which tiktoken's pattern backtracks
    until its stack is full."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok, self.fast, self.assigned = Tokenizer.from_file(path), None, {}
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        added = self.tok.get_added_tokens_decoder()
        special = {t.content: i for i, t in added.items()}
        bytes_ = byte_of()
        ranks = {bytes(map(bytes_.__getitem__, t)): i for t, i in told["model"]["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        made = [told["model"]["vocab"][x + y] for x, y in merges]
        plain = all(not (t.lstrip or t.rstrip or t.single_word or t.normalized) for t in added.values())
        if plain and made == sorted(made) and not told.get("normalizer"):
            self.fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)

    def _usual(self, text: str) -> bool:
        kinds = set(text)
        self.assigned |= {c: unicodedata.category(c) != "Cn" for c in kinds.difference(self.assigned)}
        return all(map(self.assigned.__getitem__, kinds))

    def _slow(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.fast is None or not (text.isascii() or self._usual(text)) or (len(text) >= WHITE and _WHITE.search(text)):
            return self._slow(text)
        try:
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special=self.special, disallowed_special=()), "<u4").tobytes()
        except ValueError:  # its pattern gave up
            return self._slow(text)


def cuts(n: int, capacity: int, grain: int) -> list[int]:
    """Lengths of the pieces of n tokens."""
    out, left = [capacity] * (n // capacity), n % capacity
    small = left % grain
    return out + [x for x in (left - small, small) if x]


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


def _cut(path: str, capacity: int, grain: int, end_id: int, with_ids: bool):
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, seen = Encoder(path), np.array([end_id], "<u4").tobytes(), Counter()
        for batch in batches:
            for b in pieces(batch, 1000):
                cols = [[] for _ in schema]
                for doc, text, part in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    ids = encode(text or "") + end
                    n, at = len(ids) // 4, 0
                    for length in cuts(n, capacity, grain):
                        piece = ids[4 * at : 4 * (at + length)]
                        for c, v in zip(cols, (doc, at, length, zlib.crc32(piece), n, part, seen[length], piece), strict=False):
                            c.append(v)
                        seen[length] += 1
                        at += length
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    return run


def cut_documents(docs: DataFrame, path: str | None = None, capacity: int = 1024, grain: int = 256, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of every document with the crc32 of their ids (and the ids, if asked for), the task that made
    them and their number among that task's pieces of their length."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(_cut(path or vocabulary(), capacity, grain, end_id, with_ids), _PIECES + ", ids binary" * with_ids)


def pack_histogram(histogram: dict[int, int], capacity: int = 1024) -> list[tuple[list[int], int]]:
    """(lengths in the pack, number of such packs), by shortest-pack-first with lengths from the longest down.
    Each step uses up a length or a pattern, so patterns stay few whatever the counts."""
    by_room: dict[int, list[tuple[list[int], int]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        made: list[tuple[int, list[int], int]] = []
        while left:
            room = max((r for r, packs in by_room.items() if packs and r >= length), default=None)
            if room is None:
                each = max(1, capacity // length)
                if left >= each:
                    n = left // each
                    made.append((capacity - each * length, [length] * each, n))
                    left -= n * each
                else:
                    made.append((capacity - left * length, [length] * left, 1))
                    left = 0
                continue
            lengths, count = by_room[room].pop()
            each = min(room // length, max(1, -(-left // count)))
            n = min(count, left // each)
            if count > n:
                by_room[room].append((lengths, count - n))
            made.append((room - each * length, lengths + [length] * each, n))
            left -= n * each
        for room, lengths, n in made:
            by_room.setdefault(room, []).append((lengths, n))
    return [(lengths, n) for room in sorted(by_room) for lengths, n in by_room[room]]


def slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset): ranks of a length from the first on go, one for each
    sequence, to this offset. Equal neighbours in a pack have slots of their own."""
    out, taken, first = [], Counter(), 0
    for lengths, n in patterns:
        at = 0
        for length in lengths:
            out.append((length, taken[length], n, first, at))
            taken[length] += n
            at += length
        first += n
    return out


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 1024, grain: int = 256, end_id: int = 0) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece."""
    spark = docs.sparkSession
    made = saved(cut_documents(docs, path, capacity, grain, end_id), "pieces")
    counts = saved(made.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = counts.select("length", "part", (F.sum("n").over(_running()) - F.col("n")).alias("before"))
    ranked = made.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    by_length: dict[int, list] = {}
    for length, *slot in slots(pack_histogram(histogram, capacity)):
        by_length.setdefault(length, []).append(slot)
    plan = {length: np.array(sorted(x), np.int64).T for length, x in by_length.items()}  # at most `capacity` entries of a few slots
    return ranked.mapInArrow(_place(plan), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _running():
    from pyspark.sql import Window

    return Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)


def _place(plan: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty_like(length), np.empty_like(length)
            for n in np.unique(length):
                here = np.nonzero(length == n)[0]
                first, _, to, at = plan[int(n)]
                slot = np.searchsorted(first, rank[here], side="right") - 1
                sequence[here], offset[here] = to[slot] + rank[here] - first[slot], at[slot]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return run


def write_sequences(docs: DataFrame, placed: DataFrame, out: str, path: str | None = None, capacity: int = 1024, grain: int = 256, end_id: int = 0) -> None:
    """The sequences themselves as Parquet: sequence_id and input_ids, padded with end_id except at a power of two."""
    ids = cut_documents(docs, path, capacity, grain, end_id, with_ids=True).select("doc_id", "start", "ids_crc32", "ids").dropDuplicates(["doc_id", "start", "ids_crc32"])
    rows = placed.join(ids, ["doc_id", "start", "ids_crc32"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = []
            for parts in b.column(1).to_pylist():
                x = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int32)
                n = len(x)
                whole.append(x if n & (n - 1) == 0 else np.pad(x, (0, capacity - n), constant_values=end_id))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(whole, pa.list_(pa.int32()))], names=["sequence_id", "input_ids"])

    rows.mapInArrow(run, "sequence_id long, input_ids array<int>").write.parquet(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
