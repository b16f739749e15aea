"""Vector bin packing of tokenised documents into training sequences.

Examples are vectors of tokens, segments and loss-bearing tokens; a sequence is a bin with a limit on
each. Per partition, pieces of open documents wait in a pool of bounded size. A sequence takes the
piece with the largest dot product of its size and the room left (both as shares of the limits) that
fits whole, again and again; when none fits, the piece with the largest product is cut to fill the rest.
A piece as long as a sequence is one. So a sequence ends short of its tokens only at another limit or
at the end of the partition. Nothing is shuffled, and memory is bounded by the pool and one document.

Texts are encoded by byte-pair merging (tiktoken) with the vocabulary of the tokenizer file, whose ids are the ranks
of its merges; another kind of file is refused. Long runs of white space, which overflow the stack of the splitting
pattern, are cut out and merged as the one piece that they are. A document may have a prompt, whose tokens come first
and bear no loss. Null or empty text: the end id alone. A repeated row is packed again.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.bpe import SPACE, byte_symbols
from tarmac.llm.common import kept, table

LENGTH, SEGMENTS, POOL, END_ID = 2048, 256, 64, 1
#: Fixed value: how byte-level BPE of this kind splits text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = re.compile(f"[{SPACE}]{{4096,}}")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, split = file["model"], file["pre_tokenizer"] or {}
        vocab, merged = model["vocab"], ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        order = [vocab[m] for m in merged]
        if file["normalizer"] or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or order != sorted(order):
            raise ValueError(f"{path} isn't byte-level BPE with ids in the order of its merges")
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items() if t not in special}
        self.model = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.special = tuple(special)

    def encode(self, text: str) -> bytes:
        parts, at = [], 0
        for m in LONG.finditer(text):
            # the run is one piece, but that its last character goes to what follows
            end = m.end() if m.end() == len(text) or text.startswith(self.special, m.end()) else m.end() - 1
            parts += [self._encoded(text[at : m.start()]), np.array(self.model._encode_single_piece(text[m.start() : end]), "<u4")]
            at = end
        return b"".join(p.tobytes() for p in [*parts, self._encoded(text[at:])])

    def _encoded(self, text: str) -> np.ndarray:
        return self.model.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


class Packer:
    """Fills sequences from pieces; limits are (tokens, segments, loss-bearing tokens)."""

    def __init__(self, limits: tuple[int, int, int], pool: int, emit: Callable):
        self.limits, self.size, self.emit, self.n = limits, pool, emit, 0
        self.keys: list[tuple] = []  # of each piece that waits: key, start, tokens that bear no loss
        self.tokens, self.loss = np.zeros(4 * pool), np.zeros(4 * pool)  # a place that is free holds infinity tokens
        self.free: list[int] = list(range(4 * pool))[::-1]
        self.tokens[:] = np.inf
        self.at: dict[int, tuple] = {}

    def add(self, key, start: int, tokens: int, prompt: int = 0) -> None:
        """prompt: the first tokens of this piece that bear no loss."""
        most, _, loss = self.limits
        while tokens > 0:
            n, quiet = min(tokens, most), min(tokens, prompt, most)
            if n == most and n - quiet <= loss:
                self.emit(key, start, n, self.n, 0)
                self.n += 1
            else:
                self._wait(key, start, n, quiet)
                if len(self.at) > 2 * self.size:
                    while len(self.at) > self.size:
                        self.fill()
            start, tokens, prompt = start + n, tokens - n, prompt - quiet

    def close(self) -> None:
        while self.at:
            self.fill()

    def _wait(self, key, start: int, n: int, quiet: int) -> None:
        i = self.free.pop()
        self.at[i] = (key, start, n, quiet)
        self.tokens[i], self.loss[i] = n, n - quiet

    def _leave(self, i: int) -> tuple:
        self.free.append(i)
        self.tokens[i] = np.inf
        return self.at.pop(i)

    def fill(self) -> None:
        """Emits one sequence."""
        most, segments, loss = self.limits
        room, left, quiet_room, at = most, segments, loss, 0
        while room and left:
            gain = self.tokens * (room / most**2)
            gain += self.loss * (quiet_room / loss**2)  # a segment is one for every piece
            fits = (self.tokens <= room) & (self.loss <= quiet_room)
            i = int(np.where(fits, gain, -1.0).argmax())
            if fits[i]:
                key, start, take, quiet = self._leave(i)
            else:
                if not self.at:
                    break
                i = int(np.where(np.isfinite(self.tokens), gain, -1.0).argmax())
                _, _, n, quiet = self.at[i]
                take = min(n, room, quiet + quiet_room)
                if not take:  # all room for loss is used: a piece that begins with a prompt may still go on
                    i = max(self.at, key=lambda j: (self.at[j][3], -j))
                    _, _, n, quiet = self.at[i]
                    take = min(n, room, quiet)
                    if not take:
                        break
                key, start, n, quiet = self._leave(i)
                if take < n:
                    self._wait(key, start + take, n - take, max(0, quiet - take))
            self.emit(key, start, take, self.n, at)
            at += take
            room, left, quiet_room = room - take, left - 1, quiet_room - max(0, take - quiet)
        self.n += 1


def pack(docs: DataFrame, path: str | None = None, limits: tuple[int, int, int] = (LENGTH, SEGMENTS, LENGTH), pool: int = POOL, end_id: int = END_ID, keep_ids: bool = False, prompt: str | None = None) -> DataFrame:
    """A row per piece of each row of docs (doc_id, text); see op8. keep_ids adds the ids themselves.

    prompt: the column whose text comes first and bears no loss; without it, all tokens of a document do,
    and the limit on such tokens is one on tokens. A sequence_id is the number of the partition and of the sequence in it.
    """
    path = path or tokenizer_path()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        out: list[tuple] = []
        ids: dict[int, list] = {}  # row number: doc_id, ids, tokens not yet in a sequence

        def emit(key: int, start: int, n: int, seq: int, at: int) -> None:
            doc, raw, left = ids[key]
            own = raw[4 * start : 4 * (start + n)]
            out.append((doc, start, n, zlib.crc32(own), len(raw) // 4, base + seq, at) + ((own,) if keep_ids else ()))
            ids[key][2] = left - n
            if left == n:
                del ids[key]

        def flush() -> pa.RecordBatch:
            names = [x.split()[0] for x in schema.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary() if name == "ids" else pa.int64()) for name, c in zip(names, zip(*out, strict=True), strict=True)], names)
            out.clear()
            return batch

        enc, packer, n_rows = kept(("encoder", path), lambda: Encoder(path)), Packer(limits, pool, emit), 0
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                for doc, text, first in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    quiet = enc.encode(first) if first else b""
                    raw = quiet + enc.encode(text or "") + end
                    ids[n_rows] = [doc, raw, len(raw) // 4]
                    packer.add(n_rows, 0, len(raw) // 4, len(quiet) // 4)
                    n_rows += 1
                if len(out) > 4096:
                    yield flush()
        packer.close()
        if out:
            yield flush()

    first = F.col(f"`{prompt}`") if prompt else F.lit(None)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), first.cast("string")).mapInArrow(run, schema)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
