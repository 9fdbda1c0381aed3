"""Vector bin packing of training examples into sequences.

A sequence has three limits: tokens, segments and loss-bearing tokens. The open sequence takes, again and again, the
waiting example with the largest dot product of its size and the room left, both as shares of the limits, among those
that fit; if none fits, the best is cut to the room. Whole sequences are cut off an example's front first. An example's
leading `prompt` tokens bear no loss.

Each partition packs its own rows in pools of bounded tokens and hands the open sequence on from pool to pool, so
nothing is shuffled; a sequence's id has the partition in its upper bits. What is left at a partition's end is cut into
sequences whose lengths are powers of two, which need no padding.

Defined cases: a null text is empty and has the end token alone; rows with equal or null ids are packed each on its own;
an empty table gives no rows; other columns are ignored; a text's special-token strings are the vocabulary's own.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
END = "<|endoftext|>"


class Ids:
    """Token ids of byte_bpe_50k.json, by its vocabulary's ranks: the same ids, found several times as fast."""

    def __init__(self, vocabulary: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END: len(ranks)})

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            ids = []
        elif END in text:
            ids = self.encoding.encode(text, allowed_special="all")
        else:
            ids = self.encoding.encode_ordinary(text)
        return np.asarray([*ids, 1], "<u4")


class Packer:
    """Packs examples in the order they come; take() yields pieces (example, start, length, sequence, offset, loss)."""

    def __init__(self, tokens: int = 2048, segments: int = 256, loss: int = 2048):
        self.limit = np.array([tokens, segments, loss], np.float64)
        self.room = self.limit.copy()
        self.sequence = 0
        self.waiting: list[list] = []  # example, start, end, prompt

    def size(self, item: list) -> tuple[int, int]:
        _, a, b, prompt = item
        return b - a, max(0, b - max(a, prompt))

    def most(self, item: list) -> int:
        """Tokens from the item's front that fit into the room."""
        _, a, b, prompt = item
        free = max(0, prompt - a)
        return int(min(b - a, self.room[0], free + self.room[2])) if self.room[1] >= 1 else 0

    def place(self, item: list, length: int) -> tuple:
        example, a, _, prompt = item
        loss = max(0, a + length - max(a, prompt))
        piece = (example, a, length, self.sequence, int(self.limit[0] - self.room[0]), loss)
        self.room -= (length, 1, loss)
        item[1] = a + length
        if self.room[0] == 0:
            self.close()
        return piece

    def close(self) -> None:
        if self.room[0] < self.limit[0]:
            self.sequence += 1
            self.room = self.limit.copy()

    def pack(self, items: list[list]) -> Iterator[tuple]:
        """Packs all items; at most the last sequence stays open."""
        rest = []
        for item in items:
            while self.room[0] == self.limit[0] and self.most(item) == self.limit[0]:
                yield self.place(item, int(self.limit[0]))
            if item[2] - item[1] >= self.limit[0]:  # a sequence is open: this item first fills it
                while item[1] < item[2] and (n := self.most(item)):
                    if n < item[2] - item[1] < self.limit[0] and n < self.room[0]:
                        break
                    yield self.place(item, n)
            if item[1] < item[2]:
                rest.append(item)
        sizes = np.array([self.size(x) for x in rest], np.float64).reshape(-1, 2)
        left = np.ones(len(rest), bool)
        while left.any():
            share = self.room / self.limit
            value = share[0] / self.limit[0] * sizes[:, 0] + share[1] / self.limit[1] + share[2] / self.limit[2] * sizes[:, 1]
            fits = left & (sizes[:, 0] <= self.room[0]) & (sizes[:, 1] <= self.room[2]) if self.room[1] >= 1 else np.zeros(len(rest), bool)
            i = int(np.where(fits if fits.any() else left, value, -1).argmax())
            n = self.most(rest[i])
            if not n:
                self.close()
                continue
            yield self.place(rest[i], n)
            if rest[i][1] == rest[i][2]:
                left[i] = False
            else:
                sizes[i] = self.size(rest[i])
                self.close()


def tail(pieces: list[tuple], first: int) -> Iterator[tuple]:
    """The pieces of one open sequence, cut into sequences of power-of-two lengths from number first."""
    total, sequence, used = sum(p[2] for p in pieces), first, 0
    lengths = [1 << i for i in reversed(range(total.bit_length())) if total >> i & 1]
    for example, start, length, _, _, loss in pieces:
        prompt = start + length - loss
        while length:
            n = min(length, lengths[0] - used)
            yield example, start, n, sequence, used, max(0, start + n - max(start, prompt))
            start, length, used = start + n, length - n, used + n
            if used == lengths[0]:
                lengths.pop(0)
                sequence, used = sequence + 1, 0


def packer(tokenizer: Callable[[], Callable], tokens: int, segments: int, loss: int, pool: int) -> Callable:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, bins = tokenizer(), Packer(tokens, segments, loss)
        base = TaskContext.get().partitionId() << 33
        opened: list[tuple] = []  # pieces of the open sequence, each example held as (doc_id, ids)
        items: list[list] = []
        held = 0

        def flush(last: bool) -> pd.DataFrame:
            nonlocal opened, items, held
            found = opened + list(bins.pack(items))
            cut = bins.sequence if bins.room[0] < bins.limit[0] else bins.sequence + 1
            done, opened = [p for p in found if p[3] < cut], [p for p in found if p[3] >= cut]
            if last:
                done, opened = done + list(tail(opened, cut)), []
            items, held = [], 0
            return pd.DataFrame([(e[0], a, n, zlib.crc32(e[1][a : a + n].tobytes()), len(e[1]), base + s, o, x) for e, a, n, s, o, x in done], columns=[c.split()[0] for c in SCHEMA.split(", ")])

        for part in parts:
            for doc_id, text, prompt in zip(part["doc_id"], part["text"], part["prompt"]):
                ids = encode(text)
                items.append([(None if pd.isna(doc_id) else doc_id, ids), 0, len(ids), int(prompt)])
                held += len(ids)
                if held >= pool or len(items) >= 4096:
                    yield flush(False)
        yield flush(True)

    return run


def pack(docs: DataFrame, tokens: int = 2048, segments: int = 256, loss: int = 2048, pool: int = 1 << 20, tokenizer: Callable[[], Callable] = Ids, prompt_tokens: str | None = None) -> DataFrame:
    """Pieces of the rows (doc_id, text). prompt_tokens: a column with the number of leading tokens without loss."""
    prompt = F.coalesce(F.col(prompt_tokens).cast("long"), F.lit(0)) if prompt_tokens else F.lit(0).cast("long")
    return docs.select("doc_id", "text", prompt.alias("prompt")).mapInPandas(packer(tokenizer, tokens, segments, loss, pool), SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
