"""The trie of conversation prefixes, merged from families.

Conversations of a family (ids of one stretch of ``family``) meet in one sorted run: the family's base, which comes first,
lends its first turns to the others, each conversation is rebuilt turn by turn, and the family's own small trie is
kept while its rows pass. Only its combined nodes are shuffled, to be merged by their prefix.

Texts are never shuffled: a turn is known by 128 bits of SHA-256 over its role and text, a prefix by 128 bits of SHA-256 over the prefix
before it and the turn. Sums over subtrees come from pointer doubling: in round i a node's sums go to its ancestor at
distance 2^i, so a trie of depth d takes about log2(d) rounds, and only nodes of such depth take part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annulus.llm.common import durable

ROOT = bytes(16)
FAMILY_NODES = "node binary, up array<binary>, depth bigint, turn_key binary, words bigint, n_convs bigint, conv_id bigint, kin bigint, ends bigint"
BLOCK = 1024  # families whose ends are put together before they are shuffled by node


def words(text: Column) -> Column:
    """How many runs of other characters than white space of ASCII a text has."""
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("bigint")


def turns(conversations: DataFrame, family: int) -> DataFrame:
    """kin, place, conv_id, turn, turn_key, words: a row for each row with a conv_id; null role or text is empty.

    conv_id is kin * family + place, with a place from 0 on.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    c = F.col("conv_id").cast("bigint")
    place = F.pmod(c, F.lit(family).cast("bigint"))
    kin = F.expr(f"cast(conv_id as bigint) div {family}") - F.when((c < 0) & (place > 0), 1).otherwise(0)
    return conversations.where("conv_id is not null").select(kin.alias("kin"), place.cast("int").alias("place"), c.alias("conv_id"), "turn", key.alias("turn_key"), words(text).alias("words"))


def head(conv_id: int, most: int) -> int:
    """How many turns a conversation takes from its family's base."""
    return zlib.crc32(str(conv_id).encode()) % most


class Trie:
    """The trie of one family: node -> what is known of it."""

    def __init__(self, kin: int):
        self.kin = kin
        self.nodes: dict[bytes, list] = {}

    def add(self, conv_id: int, path: list[bytes], turn_key: bytes | None, n_words: int, ends: int) -> None:
        """One more member of the node at the end of ``path``, whose first prefix is the root. ends: the bit of a conversation that ends there, or 0."""
        node, depth = path[-1], len(path) - 1
        held = self.nodes.get(node)
        if held is None:
            up = []
            step = 1
            while step <= depth:
                up.append(path[depth - step])
                step *= 2
            held = self.nodes[node] = [up, depth, turn_key, n_words, 0, conv_id, 0]
        held[4] += 1
        held[5] = min(held[5], conv_id)
        held[6] |= ends

    def rows(self) -> list[tuple]:
        out = [(node, up, depth, key, n_words, n, conv, self.kin, ends) for node, (up, depth, key, n_words, n, conv, ends) in self.nodes.items()]
        self.nodes = {}
        return out


def family_tries(batches: Iterator[pa.RecordBatch], most: int, room: int = 50_000) -> Iterator[list[tuple]]:
    """Rows of FAMILY_NODES from rows (kin, place, conv_id, turn_key, words) by kin, place and order of turns.

    A family's trie is given out when the family ends, or before when it has ``room`` nodes: nodes are merged later in any
    case. A task remembers the first turns of one base, and 16 bytes for each turn of one conversation.
    """
    trie: Trie | None = None
    conv: int | None = None
    place = 0
    lent: list[tuple[bytes, int]] = []  # the first turns of the base
    path: list[bytes] = []
    held: tuple[bytes | None, int] = (None, 0)  # the last turn of the path, not added before it is known whether it ends there
    seen = first = 0
    out: list[tuple] = []

    def grow(key: bytes, n: int) -> None:
        nonlocal held
        trie.add(conv, path, *held, 0)
        path.append(hashlib.sha256(path[-1] + key).digest()[:16])
        held = (key, n)

    def finish() -> None:
        if conv is not None:
            trie.add(conv, path, *held, 1 << place)

    for batch in batches:
        for kin, at, c, key, n in zip(*(batch.column(x).to_pylist() for x in ("kin", "place", "conv_id", "turn_key", "words"))):
            if c != conv:
                finish()
                if trie is None or kin != trie.kin:
                    out += trie.rows() if trie else []
                    trie, lent = Trie(kin), []
                conv, place, path, held, seen = c, at, [ROOT], (None, 0), 0
                first = head(c, most)
                if place:
                    for turn in lent[:first]:
                        grow(*turn)
            if not place and seen < most - 1:
                lent.append((key, n))
            if not place or seen >= first:
                grow(key, n)
            seen += 1
            if len(trie.nodes) >= room:
                out += trie.rows()
            if len(out) >= room:
                yield out
                out = []
    finish()
    yield out + (trie.rows() if trie else [])


def prefix_trie(conversations: DataFrame, *, family: int = 20, most: int = 4) -> DataFrame:
    """node, parent, depth, turn_key, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: the nodes.

    conversations: conv_id, turn, role, text and more, which is ignored; turns are ordered by turn, null first, and where it ties by
    a hash of role and text. Conversation c takes its first h turns (all if there are fewer, none if it is absent) from the
    base of its family, the multiple of ``family`` at or below c, and its own from the h-th on; h is crc32(c) modulo ``most``. Null role
    or text is empty; rows without conv_id are left out; a repeated row is a turn of its own; an empty table has no node, not even a
    root. A node is a prefix of rebuilt conversations; members are those that begin with it. conv_id: the smallest member; saved_tokens:
    over the subtree, words of each node's last text for each member but one; ends_sha256: over the ids of members that end at the node.
    """
    if not 0 < family < 64:
        raise ValueError("ends of a family are kept as bits of a long")
    t = turns(conversations, family)
    run = t.repartition("kin").sortWithinPartitions("kin", "place", F.asc_nulls_first("turn"), "turn_key").drop("turn")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "up", "depth", "turn_key", "words", "n_convs", "conv_id", "kin", "ends"]
        kinds = [pa.binary(), pa.list_(pa.binary()), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        for rows in family_tries(batches, most):
            for at in range(0, len(rows), 10_000):
                columns = zip(*rows[at : at + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    families = durable(run.mapInArrow(merge, FAMILY_NODES))
    nodes = durable(families.groupBy("node").agg(
        F.first("up").alias("up"), F.first("depth").alias("depth"), F.first("turn_key").alias("turn_key"), F.first("words").alias("words"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
    ))
    children = nodes.where("depth > 0").groupBy(F.get("up", F.lit(0)).alias("node")).agg(F.count("*").alias("n_children"))
    own = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    sums = subtree_sums(own.select("node", "up", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.select("node", F.get("up", F.lit(0)).alias("parent"), "depth", "turn_key", "conv_id", "n_convs").join(sums, "node").join(children, "node", "left").join(ended(families, family), "node", "left").join(parents, "parent", "left")
    return full.select(
        "node", "parent", "depth", "turn_key", "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def subtree_sums(nodes: DataFrame, names: list[str]) -> DataFrame:
    """node, names: each name summed over a node's subtree. nodes: node, up (ancestors at distances 1, 2, 4, ...), depth, names."""
    at = durable(nodes)
    deepest = at.agg(F.max("depth").alias("d")).first()["d"] or 0
    i = 0
    while 1 << i <= deepest:
        # sums so far reach down to distance 2^i - 1; each node hands them to the ancestor at distance 2^i
        more = at.where(F.col("depth") >= 1 << i).groupBy(F.get("up", F.lit(i)).alias("node")).agg(*[F.sum(n).alias(f"__{n}") for n in names])
        at = durable(at.join(more, "node", "left").select("node", "up", "depth", *[(F.col(n) + F.coalesce(f"__{n}", F.lit(0).cast("bigint"))).alias(n) for n in names]))
        i += 1
    return at.select("node", *names)


def ended(families: DataFrame, family: int) -> DataFrame:
    """node, ends_sha256: for nodes at which conversations end, the hash of their ids, ascending and joined by commas.

    Ends come as bits of families; up to BLOCK of these are put together before they are shuffled by node. A node's blocks
    then pass in order through a running hash, so a node where any number of conversations end takes no memory for them.
    """
    span = F.shiftright("kin", BLOCK.bit_length() - 1)
    blocks = families.where("ends <> 0").groupBy("node", span.alias("block")).agg(F.sort_array(F.collect_list(F.struct("kin", "ends"))).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for key, held in zip(batch.column("node").to_pylist(), batch.column("held").to_pylist()):
                if key != node:
                    done += [(node, state.hexdigest())] if state else []
                    node, state, joint = key, hashlib.sha256(), b""
                ids = sorted(x["kin"] * family + i for x in held for i in range(x["ends"].bit_length()) if x["ends"] >> i & 1)
                state.update(joint + ",".join(map(str, ids)).encode())
                joint = b","
            yield _rows(done)
        yield _rows([(node, state.hexdigest())] if state else [])

    def _rows(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=["node", "ends_sha256"])

    return blocks.repartition("node").sortWithinPartitions("node", "block").select("node", "held").mapInArrow(run, "node binary, ends_sha256 string")


def labelled(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` with role and text of their last turn, null for the root."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    known = conversations.where("conv_id is not null").select(key.alias("turn_key"), role.alias("role"), text.alias("text")).dropDuplicates(["turn_key"])
    return nodes.drop("role", "text").join(known, "turn_key", "left")
