"""The prefix trie of conversations by vertical bitmaps.

1. Every turn becomes a digest of its role and text and the length of the text; no text takes
   part from here on. Turns are dealt by ranges of conversation ids, so that a conversation and
   the one it is rebuilt from lie together, and go through a task as a sorted stream.
2. A shard is a run of neighbouring ids, closed at SHARD_CONVERSATIONS or SHARD_TURNS. Its index
   maps (position, turn) to the bitset of its conversations that have this turn there.
   Depth first, the bitset of a node is intersected with the postings of its members' next
   turns: each gives a child, its popcount the members, and those of them that have no further
   turn the end list. So a turn that all conversations share costs one row a shard.
3. Nodes of all shards meet by the digest of their path, with map-side sums: members, ends, the
   least conversation, and the first shard that has the node, which owns it.
4. What is summed over subtrees goes back to the shards: a shard sums, up its own trie, what the
   nodes it owns have to give. Every node is owned once, by a shard that has all its ancestors,
   so these sums add up. The work is linear in the nodes, however deep they lie.
5. End lists stay pieces of one shard each. They are digested in one pass over pieces in the
   order of shards; no list is ever held as a whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaloom.llm.common import batches_of, stored

# Conversations of c - c % FAMILY on give others the turns they start with.
FAMILY = 5
MOST_SHARED = 9
SHARD_CONVERSATIONS = 4096
SHARD_TURNS = 1 << 16
_ROOT = bytes(16)

_LOCAL = pa.schema(
    [
        ("shard", pa.int64()),
        ("place", pa.int64()),
        ("node", pa.binary()),
        ("depth", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_ends", pa.int64()),
        ("conv_id", pa.int64()),
        ("ends", pa.string()),
    ]
)
_LOCAL_DDL = (
    "shard bigint, place bigint, node binary, depth bigint, n_bytes bigint, n_convs bigint,"
    " n_ends bigint, conv_id bigint, ends string"
)

# A turn is (digest, length of its text).
Turn = tuple[bytes, int]


def shared_turns(conv_id: int) -> int:
    """How many turns a conversation takes from the first of its family."""
    return zlib.crc32(str(conv_id).encode()) % MOST_SHARED


def base_of(conv_id: Column) -> Column:
    """The first of the family, by the remainder that has the sign of the id."""
    return conv_id - conv_id % FAMILY


def trie(conversations: list[tuple[int, list[Turn]]]) -> Iterator[tuple]:
    """(node, depth, n_bytes, n_convs, n_ends, conv_id, ends) of every node in preorder.

    Conversations come in the order of their ids. A bit stands for a conversation of the list.
    """
    postings: list[dict[bytes, int]] = []
    ended: dict[int, int] = {}
    for i, (_, turns) in enumerate(conversations):
        bit = 1 << i
        while len(postings) < len(turns):
            postings.append({})
        for at, (turn, _) in zip(postings, turns):
            at[turn] = at.get(turn, 0) | bit
        ended[len(turns)] = ended.get(len(turns), 0) | bit
    open_ = [(_ROOT, 0, 0, (1 << len(conversations)) - 1)]
    while open_:
        node, depth, n_bytes, members = open_.pop()
        ends = members & ended.get(depth, 0)
        yield (
            node,
            depth,
            n_bytes,
            members.bit_count(),
            ends.bit_count(),
            conversations[_lowest(members)][0],
            ",".join(str(conversations[i][0]) for i in _bits(ends)),
        )
        left = members & ~ends
        children = []
        while left:
            turn, length = conversations[_lowest(left)][1][depth]
            child = members & postings[depth][turn]
            left &= ~child
            path = hashlib.blake2b(node + turn, digest_size=16).digest()
            children.append((path, depth + 1, length, child))
        open_ += reversed(children)


def _lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


def _bits(bits: int) -> Iterator[int]:
    while bits:
        yield _lowest(bits)
        bits &= bits - 1


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[Turn]]]]:
    """(base, turns by conversation) of a stream sorted by base, conversation and turn."""
    base, family = None, {}
    for batch in batches:
        for of, conv_id, turn, length in zip(*(c.to_pylist() for c in batch.columns)):
            if of != base:
                if family:
                    yield base, family
                base, family = of, {}
            family.setdefault(conv_id, []).append((turn, length))
    if family:
        yield base, family


def rebuilt(base: int, family: dict[int, list[Turn]]) -> Iterator[tuple[int, list[Turn]]]:
    """The conversations of a family with the turns they share put in place."""
    first = family.get(base, [])
    for conv_id, turns in family.items():
        h = shared_turns(conv_id)
        yield conv_id, first[:h] + turns[h:]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        held, n_turns, shard = [], 0, None
        for base, family in _families(batches):
            if shard is None:
                shard = base
            for conversation in rebuilt(base, family):
                held.append(conversation)
                n_turns += len(conversation[1])
            if len(held) >= SHARD_CONVERSATIONS or n_turns >= SHARD_TURNS:
                yield from numbered(shard, held)
                held, n_turns, shard = [], 0, None
        if held:
            yield from numbered(shard, held)

    def numbered(shard, held):
        for place, node in enumerate(trie(held)):
            yield shard, place, *node

    yield from batches_of(rows(), _LOCAL)


def local_nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of every shard; `shard` is its first family, so shards follow the ids."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The length of the role keeps (role, text) apart from other pairs of the same letters.
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    ).where("conv_id IS NOT NULL")
    dealt = (
        turns.withColumn("base", base_of(F.col("conv_id")))
        .repartitionByRange("base")
        .sortWithinPartitions("base", "conv_id", F.col("turn").asc_nulls_first(), "digest", "n_bytes")
    )
    return dealt.select("base", "conv_id", "digest", "n_bytes").mapInArrow(_shards, _LOCAL_DDL)


# --- sums over subtrees --------------------------------------------------------------------

_SUMMED = pa.schema(
    [
        ("node", pa.binary()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("parent_conv_id", pa.int64()),
    ]
)
_SUMMED_DDL = (
    "node binary, n_children bigint, n_leaves bigint, saved_tokens bigint, parent_conv_id bigint"
)


def _up_the_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of what owned nodes give, over the local subtree of each node, in preorder.

    Only the path from the root to the present node is held.
    """

    def rows():
        path: list[list] = []
        shard = None

        def close(depth: int):
            while len(path) > depth:
                node, children, leaves, saved, parent, _ = path.pop()
                if path:
                    path[-1][2] += leaves
                    path[-1][3] += saved
                yield node, children, leaves, saved, parent

        for batch in batches:
            for of, node, depth, conv_id, owned, leaf, saved in zip(
                *(c.to_pylist() for c in batch.columns)
            ):
                if of != shard:
                    yield from close(0)
                    shard = of
                yield from close(depth)
                parent = path[-1] if path else None
                if owned and parent:
                    parent[1] += 1
                path.append(
                    [
                        node,
                        0,
                        int(owned and leaf),
                        saved if owned else 0,
                        parent[5] if owned and parent else None,
                        conv_id,
                    ]
                )
        yield from close(0)

    yield from batches_of(rows(), _SUMMED)


# --- end lists -----------------------------------------------------------------------------

_DIGEST = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])


def _digest_of_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends) in the order of node and shard -> a digest of the joined pieces."""

    def rows():
        node, state = None, None
        for batch in batches:
            for of, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if of == node:
                    state.update(b",")
                else:
                    if node is not None:
                        yield node, state.hexdigest()
                    node, state = of, hashlib.sha256()
                state.update(ends.encode())
        if node is not None:
            yield node, state.hexdigest()

    yield from batches_of(rows(), _DIGEST)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of the rebuilt conversations.

    `conversations` has conv_id, turn, role and text; other columns do not matter. Turns are
    ordered by `turn`, null first, and those of one number by a digest of role and text;
    repeated rows are turns of their own. A null role or text counts as empty. Rows without a
    conv_id belong to no conversation. Conversation c starts with the first h turns of
    conversation c - c % 5 (all if that has fewer, none if there is no such conversation; h is
    the crc32 of c's decimal, modulo 9) and goes on with its own turns behind its first h.

    Columns: conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, node (digest of the path). An empty table gives no row. A text of
    any length is read once and goes no further; a conversation is held as 24 bytes a turn.
    """
    local = stored(local_nodes(conversations), "trie")
    nodes = stored(
        local.groupBy("node").agg(
            F.first("depth").alias("depth"),
            F.first("n_bytes").alias("n_bytes"),
            F.sum("n_convs").alias("n_convs"),
            F.sum("n_ends").alias("n_ends"),
            F.min("conv_id").alias("conv_id"),
            F.min("shard").alias("owner"),
        ),
        "nodes",
    )
    given = (
        local.select("shard", "place", "node")
        .join(nodes, "node")
        .repartition("shard")
        .sortWithinPartitions("shard", "place")
        .select(
            "shard",
            "node",
            "depth",
            "conv_id",
            (F.col("owner") == F.col("shard")).alias("owned"),
            (F.col("n_ends") == F.col("n_convs")).alias("leaf"),
            ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
        )
    )
    sums = (
        given.mapInArrow(_up_the_tries, _SUMMED_DDL)
        .groupBy("node")
        .agg(
            F.sum("n_children").alias("n_children"),
            F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved_tokens").alias("saved_tokens"),
            F.max("parent_conv_id").alias("parent_conv_id"),
        )
    )
    ends = (
        local.where("n_ends > 0")
        .select("node", "shard", "ends")
        .repartition("node")
        .sortWithinPartitions("node", "shard")
        .select("node", "ends")
        .mapInArrow(_digest_of_pieces, "node binary, ends_sha256 string")
    )
    empty = F.lit(hashlib.sha256().hexdigest())
    return (
        nodes.join(sums, "node")
        .join(ends, "node", "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", empty).alias("ends_sha256"),
            "node",
        )
    )
