"""The trie of conversation prefixes, by blocks of turns first and by turns where siblings part.

A node is a distinct sequence of first turns. Conversations are cut into blocks of ``BLOCK`` turns,
and one row per conversation and block carries the digest of its block and the digest of all blocks
up to it. ``block_groups`` puts together the conversations that agree up to a block. Where all of
them have the same block, the nodes inside it have the same members, and one row stands for them
all. Only inside a block where they part are turn boundaries refined: there a row per turn is made,
with the digest of the prefix that ends at it, and grouped.

What a node needs of its subtree is a sum over its members, so no level has to wait for
another. A node belongs to its smallest member, the owner. A conversation owns the nodes of its
path from some depth on (``_owned``), so the nodes below a node are counted by the owners among
its members: a member has a leaf there if it owns one, a child if it owns the node one deeper,
and saves the words of its turns that others own.

Turns are numbered by running totals over parts of a range partitioning, so a conversation may
hold any share of the rows; prefixes are grouped with partial sums before the shuffle, and facts of
prefixes that many share return by ``left_join_hot``. SHA-256 over the ids of a node's ends runs
front to back by its nature: ids that end at a hot node are joined to pieces of text in parallel, and
one task streams through the pieces, holding one.

Defined results: turns are ordered by ``turn``, null first, equal ones by digest; a null role or text
is empty; rows without ``conv_id`` belong to no conversation; repeated rows are turns of their own;
an empty table has no nodes, not even a root; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import text_of, words_of, written
from casewright.llm.hot_join import hot_bound, left_join_hot
from casewright.operators.ranking import running_totals

BLOCK = 4            # turns of a block
FAMILY = 20          # conversations that may borrow from the same one
BORROWED = 4         # they borrow fewer turns than this
PIECE_IDS = 10_000   # ids in a piece of the list of a hot node's ends
LIMBS = 4            # 32-bit parts of a digest that are added up

ROOT = hashlib.sha256(b"root").digest()
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _hash(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


# --- turns ------------------------------------------------------------------------


def numbered(conversations: DataFrame) -> DataFrame:
    """``(conv_id, place, digest, words, size)``: all turns in order, from 0, and how many there are."""
    role, text = text_of("role"), text_of("text")
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.filter("conv_id is not null").select(
        "conv_id", F.struct("turn", digest.alias("digest"), F.size(words_of(text)).cast("bigint").alias("words")).alias("at")
    )
    ordered = running_totals(turns.groupBy("conv_id", "at").agg(F.count("*").alias("n")), ["conv_id"], "at", ["n"])
    return ordered.select(
        "conv_id",
        F.explode(F.sequence(F.col("cum_n") - F.col("n"), F.col("cum_n") - 1)).alias("place"),
        "at.digest",
        "at.words",
        F.col("total_n").alias("size"),
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns after borrowing, and ``conv_id`` of all conversations.

    A conversation begins with the first turns of the first of its family, as many as its id's
    hash says, and goes on with its own turns after that many. It is the number of turns really
    borrowed that shifts them.
    """
    convs = written(turns.filter("place = 0").select("conv_id", "size"), "trie-convs")
    wanted = F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    sizes = convs.select(F.col("conv_id").alias("_first"), F.col("size").alias("_there"))
    plan = convs.select("conv_id", family.alias("_first"), wanted.alias("wanted")).join(sizes, "_first", "left")
    plan = written(
        plan.select("conv_id", "_first", F.least("wanted", F.coalesce("_there", F.lit(0))).alias("lent"), "wanted"), "trie-plan"
    )
    firsts = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("place") < BORROWED - 1))
    lent = plan.filter("lent > 0").join(firsts.withColumnRenamed("conv_id", "_first"), "_first").filter("place < lent")
    own = turns.join(plan, "conv_id").filter("place >= wanted").withColumn("place", F.col("place") - F.col("wanted") + F.col("lent"))
    columns = ["conv_id", "place", "digest", "words"]
    return lent.select(*columns).unionByName(own.select(*columns)), convs.select("conv_id")


# --- blocks -----------------------------------------------------------------------


def blocks(turns: DataFrame) -> DataFrame:
    """One row per conversation and block, written: what is in it, before it, and up to its end.

    ``before`` and ``after`` are digests of the whole prefix: each block's digest, together with
    its number, adds to sums of 32-bit parts, and the sums are hashed.
    """
    cut = turns.groupBy("conv_id", F.floor(F.col("place") / BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("place", "digest", "words"))).alias("turns")
    )
    own = F.hex(_hash(F.col("block").cast("string").cast("binary"), F.array_join(F.transform("turns.digest", F.hex), "").cast("binary")))
    limb = lambda i: F.conv(F.substring("_own", 8 * i + 1, 8), 16, 10).cast("bigint")
    measured = cut.withColumn("_own", own).select(
        "conv_id",
        "block",
        "turns",
        F.size("turns").cast("bigint").alias("n"),
        F.aggregate("turns.words", F.lit(0).cast("bigint"), lambda total, w: total + w).alias("w"),
        *[limb(i).alias(f"l{i}") for i in range(LIMBS)],
    )
    measured = written(measured, "trie-blocks")
    sums = ["n", "w", *[f"l{i}" for i in range(LIMBS)]]
    totals = running_totals(measured.select("conv_id", "block", *sums), ["conv_id"], "block", sums)

    def key(value) -> Column:
        return _hash(F.concat_ws(",", value("n"), *[value(f"l{i}") for i in range(LIMBS)]).cast("binary"))

    known = totals.select(
        "conv_id",
        "block",
        F.when(F.col("block") == 0, F.lit(ROOT)).otherwise(key(lambda m: F.col(f"cum_{m}") - F.col(m))).alias("before"),
        key(lambda m: F.col(f"cum_{m}")).alias("after"),
        (F.col("cum_n") - F.col("n")).alias("depth"),
        (F.col("cum_w") - F.col("w")).alias("words_before"),
        F.col("total_n").alias("size"),
    )
    return written(measured.select("conv_id", "block", "turns").join(known, ["conv_id", "block"]), "trie-prefixes")


def block_groups(rows: DataFrame) -> DataFrame:
    """``(before, members, owner, longest, parted)``: the conversations that have a block after the same prefix."""
    return rows.groupBy("before").agg(
        F.count("*").alias("members"),
        F.min("conv_id").alias("owner"),
        F.max("size").alias("longest"),
        (F.min("after") != F.max("after")).alias("parted"),
    )


def _refined(rows: DataFrame) -> DataFrame:
    """A row per turn of the blocks in which siblings part, with the digest of the prefix up to it."""
    digests = F.transform("turns.digest", F.hex)
    until = lambda i: _hash(F.hex("before").cast("binary"), F.array_join(F.slice(digests, 1, i), "").cast("binary"))
    # The end of a whole block is the start of the next one.
    key = lambda i: F.when(i == BLOCK, F.col("after")).when(i == 0, F.col("before")).otherwise(until(i))
    steps = F.transform(
        "turns",
        lambda t, i: F.struct(
            key(i + 1).alias("key"),
            (F.col("depth") + i + 1).alias("depth"),
            (F.col("words_before") + F.aggregate(F.slice("turns.words", 1, i), F.lit(0).cast("bigint"), lambda a, w: a + w)).alias("read"),
            key(i).alias("parent"),
        ),
    )
    return rows.select("conv_id", "size", F.inline(steps))


# --- nodes ------------------------------------------------------------------------


NODE = ["key", "parent", "top", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def _total(words: str | Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda total, w: total + w)


def _owned(parted: DataFrame, alike: DataFrame) -> DataFrame:
    """``(conv_id, own_from, leaf)``: the depth from which a conversation owns its path, if it does, and whether it ends in a leaf."""
    nodes = parted.groupBy("key", "depth").agg(F.min("conv_id").alias("owner"), F.max("size").alias("longest"))
    fine = nodes.select("owner", F.col("depth").alias("at"), (F.col("longest") == F.col("depth")).alias("leaf"))
    # Where nobody parts, the owner of the first node of the block owns the others.
    ends = F.col("longest") == F.col("depth") + F.size("turns")
    whole = alike.filter("conv_id = owner").select("owner", (F.col("depth") + 1).alias("at"), ends.alias("leaf"))
    return fine.unionByName(whole).groupBy(F.col("owner").alias("conv_id")).agg(
        F.min("at").alias("own_from"), F.max("leaf").cast("bigint").alias("leaf")
    )


def _members(rows: DataFrame, owned: DataFrame) -> DataFrame:
    """``(conv_id, own_from, leaf, alien)``, written; ``alien`` are the words of turns that others own.

    Who owns nothing would own from behind the end.
    """
    told = rows.join(owned, "conv_id", "left").withColumn("own_from", F.coalesce("own_from", F.col("size") + 1))
    others = F.greatest(F.least(F.col("own_from") - 1 - F.col("depth"), F.size("turns")), F.lit(0)).cast("int")
    alien = _total(F.slice("turns.words", 1, others))
    per_conv = told.groupBy("conv_id", "own_from").agg(F.coalesce(F.max("leaf"), F.lit(0)).alias("leaf"), F.sum(alien).alias("alien"))
    return written(per_conv, "trie-members")


def _sums(depth: Column, read: Column) -> list[Column]:
    """What a node at ``depth`` knows by its members, who have ``read`` words up to where it saves from."""
    child = (F.col("own_from") <= depth + 1) & (depth < F.col("size"))
    return [
        F.min("conv_id").alias("_conv"),
        F.min_by("own_from", "conv_id").alias("_from"),
        F.count("*").alias("n_convs"),
        F.count_if(child).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("alien") - read, F.lit(0))).alias("saved_tokens"),
    ]


def _fine(parted: DataFrame) -> DataFrame:
    """Nodes of the blocks in which siblings part."""
    nodes = parted.groupBy("key", "parent", "depth").agg(*_sums(F.col("depth"), F.col("read")))
    return nodes.withColumns({"conv_id": F.col("_conv"), "top": F.col("_from") == F.col("depth")}).select(*NODE)


def _whole(alike: DataFrame) -> DataFrame:
    """Nodes of the blocks that all members share: one group, told apart by turn only at the end."""
    end, read = F.col("depth") + F.size("turns"), F.col("words_before") + _total("turns.words")
    groups = alike.groupBy("before", "after", "depth").agg(*_sums(end, read), F.min_by("turns.words", "conv_id").alias("_words"))
    n = F.size("_words")
    nodes = F.transform(
        "_words",
        lambda _, i: F.struct(
            F.when(i + 1 == n, F.col("after")).alias("key"),
            F.when(i == 0, F.col("before")).alias("parent"),
            ((i == 0) & (F.col("_from") == F.col("depth") + 1)).alias("top"),
            F.col("_conv").alias("conv_id"),
            (F.col("depth") + i + 1).alias("depth"),
            F.col("n_convs"),
            F.when(i + 1 == n, F.col("n_children")).otherwise(1).alias("n_children"),
            F.col("n_leaves"),
            (F.col("saved_tokens") + (F.col("n_convs") - 1) * _total(F.slice("_words", i + 1, n))).alias("saved_tokens"),
        ),
    )
    return groups.select(F.inline(nodes))


def _root(convs: DataFrame, members: DataFrame) -> DataFrame:
    """The node without turns; a leaf if no conversation has any."""
    every = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    below = members.agg(
        F.count_if(F.col("own_from") == 1).alias("n_children"),
        F.coalesce(F.sum("leaf"), F.lit(1)).alias("n_leaves"),
        F.coalesce(F.sum("alien"), F.lit(0)).alias("saved_tokens"),
    )
    facts = every.select("*", F.lit(1).alias("_one")).join(F.broadcast(below.select("*", F.lit(1).alias("_one"))), "_one")
    return facts.select(
        F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(False).alias("top"), "conv_id",
        F.lit(0).cast("bigint").alias("depth"), "n_convs", "n_children", "n_leaves", "saved_tokens",
    )


def _piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of each node, joined in order, in pieces."""
    for batch in batches:
        at = 0
        keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out = []
        while at < len(keys):
            stop = at
            while stop < len(keys) and stop - at < PIECE_IDS and keys[stop] == keys[at]:
                stop += 1
            out.append({"key": keys[at], "first": ids[at], "piece": ",".join(map(str, ids[at:stop]))})
            at = stop
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.binary()), ("first", pa.int64()), ("piece", pa.string())]))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node over its pieces, which come in order."""
    fields = pa.schema([("key", pa.binary()), ("ends", pa.string())])
    held, state = None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if state is not None and row["key"] == held:
                state.update(b"," + row["piece"].encode())
                continue
            if state is not None:
                out.append({"key": held, "ends": state.hexdigest()})
            held, state = row["key"], hashlib.sha256(row["piece"].encode())
        if out:
            yield pa.RecordBatch.from_pylist(out, fields)
    if state is not None:
        yield pa.RecordBatch.from_pylist([{"key": held, "ends": state.hexdigest()}], fields)


def ends_digest(ends: DataFrame, total: int) -> DataFrame:
    """``(key, ends)``: SHA-256 of the ids that end at a node, in order, joined by commas."""
    sized = ends.groupBy("key").agg(F.count("*").alias("n"))
    told = written(left_join_hot(ends, sized, "key", "n", total), "trie-ends")
    hot = F.col("n") > hot_bound(total)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    few = told.filter(~hot).groupBy("key").agg(F.sha2(listed, 256).alias("ends"))
    rows = told.filter(hot).select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = written(rows.mapInArrow(_piece, "key binary, first bigint, piece string"), "trie-pieces")
    many = pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digested, "key binary, ends string")
    return few.unionByName(many)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    changed, convs = rebuilt(written(numbered(conversations), "trie-turns"))
    rows = blocks(changed)
    told = written(left_join_hot(rows, block_groups(rows), "before", "members", rows.count()), "trie-told")
    parted, alike = _refined(told.filter("parted")), told.filter("not parted")
    members = _members(rows, _owned(parted, alike))
    nodes = written(
        _fine(parted.join(members, "conv_id"))
        .unionByName(_whole(alike.join(members, "conv_id")))
        .unionByName(_root(convs, members)),
        "trie-nodes",
    )
    # Only the first node that a conversation owns hangs on one of another owner.
    known = nodes.filter("key is not null").select(F.col("key").alias("parent"), F.col("conv_id").alias("_above"), F.col("n_children").alias("_n"))
    tops = left_join_hot(nodes.filter("top"), known, "parent", "_n", nodes.count()).drop("_n")
    same = F.when(F.col("depth") > 0, F.col("conv_id"))
    placed = tops.unionByName(nodes.filter("not top").withColumn("_above", same))
    ends = (
        parted.filter("depth = size").select("key", "conv_id")
        .unionByName(alike.filter(F.col("depth") + F.size("turns") == F.col("size")).select(F.col("after").alias("key"), "conv_id"))
        .unionByName(convs.join(members, "conv_id", "left_anti").select(F.lit(ROOT).alias("key"), "conv_id"))
    )
    digests = ends_digest(ends, convs.count())
    # A node inside a shared block has no key, and none can end there.
    inner = placed.filter("key is null").withColumn("ends", F.lit(None).cast("string"))
    found = placed.filter("key is not null").join(digests, "key", "left").unionByName(inner)
    return found.select(
        "conv_id", "depth", F.col("_above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),"
    " lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),"
    " lambda x, z: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"
)

ORACLE = rf"""
WITH t AS (
    SELECT conv_id, turn, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), o AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(said)) - 1 AS place, sha256(said) AS digest,
        len(list_filter(regexp_split_to_array(text, '[ 	-
]+'), lambda w: w <> '')) AS words
    FROM t
), p AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS family, {_CRC} % {BORROWED} AS h FROM o GROUP BY 1),
r AS (
    SELECT p.conv_id, 0 AS part, o.place, o.digest, o.words FROM p JOIN o ON o.conv_id = p.family AND o.place < p.h
    UNION ALL
    SELECT p.conv_id, 1, o.place, o.digest, o.words FROM p JOIN o ON o.conv_id = p.conv_id AND o.place >= p.h
), s AS (
    SELECT conv_id, row_number() OVER w AS depth, words, string_agg(digest, ',') OVER w AS path,
        count(*) OVER (PARTITION BY conv_id) AS size
    FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, place ROWS UNBOUNDED PRECEDING)
), every AS (
    SELECT conv_id, depth, words, path, size FROM s
    UNION ALL
    SELECT p.conv_id, 0, 0, '', coalesce(max(size), 0) FROM p LEFT JOIN s USING (conv_id) GROUP BY 1
), n AS (
    SELECT path, depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) = depth AS leaf,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
    FROM every GROUP BY 1, 2
), up AS (
    SELECT a.path, count(*) FILTER (WHERE d.leaf) AS n_leaves, count(*) FILTER (WHERE d.depth = a.depth + 1) AS n_children,
        sum((d.n_convs - 1) * d.words) AS saved_tokens
    FROM n d JOIN every a ON a.conv_id = d.conv_id AND a.depth <= d.depth GROUP BY 1
)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, q.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
    up.n_children::BIGINT AS n_children, up.n_leaves::BIGINT AS n_leaves, up.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN up USING (path) LEFT JOIN every e ON e.conv_id = n.conv_id AND e.depth = n.depth - 1 LEFT JOIN n q ON q.path = e.path
"""
