"""Texts into containers of a fixed number of tokens, packed hierarchically.

Each text is sized once in tokens of a public tokenizer; one that alone exceeds the capacity is cut
into pieces. Items are routed to context-size tiers. A tier's items are packed into windows of the
tier's length, so that a short text never takes part in a longer context than it needs; the gaps that
remain are filled from shorter tiers, from the longest windows down, before those tiers are packed.
Windows of all lengths are then laid side by side into containers of the capacity, and containers of
like windows are dealt to step groups of like cost.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.session import map_arrow, materialise

CAPACITY = 2048
#: Upper sizes of the tiers, shortest first; the last is the capacity.
TIERS = (512, 1024, 2048)
#: Items meant for one packing task. Each task leaves one container partly filled.
SHARD_ITEMS = 50_000
#: Containers of one step group.
GROUP = 16
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _encoder(vocabulary: str):
    """The byte-level tokenizer of a rank file that was shipped with the job, with the pattern published beside it."""
    import base64
    import os

    import tiktoken
    from pyspark import SparkFiles

    with open(SparkFiles.get(os.path.basename(vocabulary)), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    # fixed value: the splitting pattern that goes with the public byte-level vocabularies
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _sized(vocabulary: str, capacity: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        enc = _encoder(vocabulary)
        part, count = TaskContext.get().partitionId(), 0
        for b in batches:
            ids, pieces, sizes, lots = [], [], [], []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, t in zip(b.column(0).to_pylist(), texts):
                n = len(enc.encode_ordinary(t))
                piece = 0
                while True:
                    ids.append(i)
                    pieces.append(piece)
                    sizes.append(min(n, capacity))
                    lots.append(hash((part, count)))
                    count += 1
                    n -= capacity
                    piece += 1
                    if n <= 0:
                        break
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pieces, pa.int32()), pa.array(sizes, pa.int32()), pa.array(lots, pa.int64())], names=["doc_id", "piece", "tokens", "lot"])

    return run


def token_sizes(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, tokens, lot)``; a null or empty text is one piece of no tokens.

    ``lot`` spreads the rows evenly whatever their ids. The vocabulary file is sent to the executors.
    """
    documents.sparkSession.sparkContext.addFile(vocabulary)
    return map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _sized(vocabulary, capacity), "doc_id long, piece int, tokens int, lot long")


class _Stock:
    """Items by size; the largest that fits is found in one bit operation. Equal sizes keep their order."""

    def __init__(self, capacity: int):
        self.of: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, size: int, item: int) -> None:
        self.of[size].append(item)
        self.mask |= 1 << size

    def take(self, room: int) -> tuple[int, int] | None:
        """``(size, item)`` of the largest item of at most ``room`` tokens."""
        fits = self.mask & ((2 << room) - 1)
        if not fits:
            return None
        size = fits.bit_length() - 1
        item = self.of[size].pop()
        if not self.of[size]:
            self.mask ^= 1 << size
        return size, item


def windows(sizes: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[int]]]:
    """``(length, items)`` of the windows, tier by tier from the longest.

    A tier's items go into windows of its length, each into the fullest that takes it; every gap then
    takes the largest items of shorter tiers that fit, until none does.
    """
    stocks = [_Stock(t) for t in tiers]
    for i in range(len(sizes) - 1, -1, -1):
        k = next(k for k, t in enumerate(tiers) if sizes[i] <= t)
        stocks[k].add(sizes[i], i)
    out: list[tuple[int, list[int]]] = []
    for k in range(len(tiers) - 1, -1, -1):
        length, base = tiers[k], len(out)
        free: list[list[int]] = [[] for _ in range(length + 1)]
        mask = 0
        while (got := stocks[k].take(length)) is not None:
            size, item = got
            up = mask >> size
            if up:
                room = size + (up & -up).bit_length() - 1
                w = free[room].pop()
                if not free[room]:
                    mask ^= 1 << room
            else:
                room, w = length, len(out)
                out.append((length, []))
            out[w][1].append(item)
            free[room - size].append(w)
            mask |= 1 << (room - size)
        rooms = {w: room for room, ws in enumerate(free) for w in ws}
        for w in range(base, len(out)):
            room, least = rooms[w], k - 1
            while least >= 0:
                got = stocks[least].take(min(room, tiers[least]))
                if got is None:
                    least -= 1
                else:
                    room -= got[0]
                    out[w][1].append(got[1])
    return out


def lay(lengths: list[int], capacity: int = CAPACITY) -> list[int]:
    """The container of each window, longest windows first, each into the first container with room for it."""
    out = [0] * len(lengths)
    open_: dict[int, list[int]] = {}
    n = 0
    for w in sorted(range(len(lengths)), key=lambda w: -lengths[w]):
        room = min((r for r, cs in open_.items() if cs and r >= lengths[w]), default=0)
        if room:
            c = open_[room].pop()
        else:
            room, c, n = capacity, n, n + 1
        out[w] = c
        open_.setdefault(room - lengths[w], []).append(c)
    return out


def pack(sizes: list[int], capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS) -> list[tuple[int, int, int]]:
    """``(container, window, window's length)`` of each item; windows are numbered throughout."""
    ws = windows(sizes, tiers)
    box = lay([length for length, _ in ws], capacity)
    out = [(0, 0, 0)] * len(sizes)
    for w, (length, items) in enumerate(ws):
        for i in items:
            out[i] = (box[w], w, length)
    return out


def balance(costs: list[int], group: int = GROUP) -> list[int]:
    """The step group of each container: dealt in order of cost, forth and back, so sums come close."""
    n_groups = max(1, -(-len(costs) // group))
    out = [0] * len(costs)
    for rank, c in enumerate(sorted(range(len(costs)), key=lambda c: -costs[c])):
        lap, at = divmod(rank, n_groups)
        out[c] = at if lap % 2 == 0 else n_groups - 1 - at
    return out


def _pack_shard(capacity: int, tiers: tuple[int, ...], group: int):
    def run(key, part):
        import pyarrow as pa

        part = part.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("lot", "ascending")])
        sizes = part["tokens"].to_pylist()
        where = pack(sizes, capacity, tiers)
        cost: dict[int, int] = {}
        longest: dict[int, int] = {}
        for (c, _, length), s in zip(where, sizes):
            cost[c] = cost.get(c, 0) + s * s  # attention within items
            longest[c] = max(longest.get(c, 0), length)
        groups, n_groups = {}, 0
        for length in sorted(set(longest.values())):  # steps of one context size
            mine = [c for c in sorted(longest) if longest[c] == length]
            dealt = balance([cost[c] for c in mine], group)
            groups.update((c, n_groups + g) for c, g in zip(mine, dealt))
            n_groups += max(dealt) + 1
        base = key[0].as_py() << 32
        return pa.table(
            {
                "doc_id": part["doc_id"], "piece": part["piece"], "tokens": part["tokens"], "tier": pa.array([next(t for t in tiers if s <= t) for s in sizes], pa.int32()),
                "window": pa.array([base + w for _, w, _ in where], pa.int64()), "window_tokens": pa.array([n for _, _, n in where], pa.int32()),
                "container": pa.array([base + c for c, _, _ in where], pa.int64()), "step_group": pa.array([base + groups[c] for c, _, _ in where], pa.int64()),
            }
        )

    return run


def containers(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """``(doc_id, piece, tokens, tier, window, window_tokens, container, step_group)``, one row per item or piece.

    Texts of no tokens have a container too, and so do rows without ``doc_id``. Repeated rows are items of
    their own. Shards are drawn evenly from all rows and sized by count, so none grows with the data. An
    empty table gives an empty result.
    """
    if tiers[-1] != capacity:
        raise ValueError("the last tier must be the capacity")
    items = materialise(token_sizes(documents, vocabulary, capacity))
    shards = max(1, -(-items.count() // SHARD_ITEMS))
    return (
        items.withColumn("shard", F.pmod(F.xxhash64("lot"), F.lit(shards)).cast("int"))
        .groupBy("shard")
        .applyInArrow(_pack_shard(capacity, tiers, GROUP), "doc_id long, piece int, tokens int, tier int, window long, window_tokens int, container long, step_group long")
    )


def packing_summary(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens, unused share and the spread of the step groups' cost, in one row."""
    by = packed.groupBy("container", "step_group").agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens").cast("long") * F.col("tokens")).alias("cost"))
    total = by.agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    return total.select("containers", "tokens", "fullest", (1 - F.col("tokens") / (F.col("containers") * capacity)).alias("unused_share"))
