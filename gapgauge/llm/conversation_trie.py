"""Prefix trie of conversations and its subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns. It is named by the smallest
conversation that begins with it and by its depth, which is unique, and found
by sums: the key of the first d turns is the sum of the hashes of (place, turn)
of each, in four lanes of 32 bits. Sums can be built up in blocks, so neither a
long conversation nor a common beginning has to pass through one task.

Subtree totals need no walk from the leaves up, which would take as many rounds
as the longest conversation has turns. Every round

* rakes: all leaves hand their totals to their parents and are finished,
* compresses: of the nodes with one child left, an independent set is taken out
  and the child is hung on the node above, with what lay between.

A node is taken out if the round's bit of its depth is 0 and that of its child
is 1; so two neighbours never go together, and since the child is deeper, some
bit fits every pair. A chain loses about half its nodes in every round, hence
the rounds grow with the logarithm of the depth. Afterwards the rounds are gone
through backwards: the total of a node taken out is what it held plus the total
of its child, known by then.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from gapgauge.llm.common import runs, settled

LANES = ["k1", "k2", "k3", "k4"]
ABOVE = [f"above_{k}" for k in LANES]
#: Turns of one conversation that one task adds up.
BLOCK = 4096
#: Characters of the joined ids that are passed on as one row.
ID_TEXT = 16_384
NONE_ENDS = hashlib.sha256(b"").hexdigest()


def _turn_hashes(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, two numbers from the SHA-256 of (role, text), bytes of the text."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    return turns.select("conv_id", "turn", "bytes", part(1).alias("d1"), part(17).alias("d2"))


def placed_turns(conversations: DataFrame) -> DataFrame:
    """Turns with their place (from 1) in the conversation and its number of turns.

    Turns are ordered by number, NULL first, equal numbers by the hash of role
    and text. Rows are dealt by ranges of that order, so a conversation may lie
    in several; it is numbered in each, and counts give what comes before.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("d1"), F.col("d2")]
    ranged = _turn_hashes(conversations).repartitionByRange(F.col("conv_id"), *order)
    rows = settled(ranged.withColumn("part", F.spark_partition_id()), "trie-turns")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("here"))
    before = counts.select(
        "conv_id",
        "part",
        F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"),
        F.sum("here").over(Window.partitionBy("conv_id")).alias("n"),
    )
    numbered = rows.withColumn("local", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)))
    return numbered.join(before, ["conv_id", "part"]).select(
        "conv_id", (F.col("before") + F.col("local")).alias("place"), "n", "d1", "d2", "bytes"
    )


def rebuilt(turns: DataFrame, borrowed: Column, lender: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are taken from another one.

    ``borrowed`` is how many of its first turns a conversation exchanges for
    those of the conversation ``lender``, both expressions on conv_id. Of the
    lender all turns are taken if it has fewer, none if it does not exist.
    Returns the turns (conv_id, depth, d1, d2, bytes, is_last) and one row per
    conversation (conv_id, length), those without turns included.
    """
    own = turns.groupBy("conv_id").agg(F.max("n").alias("n")).withColumns({"h": borrowed.cast("long"), "lender": lender})
    lenders = own.select(F.col("conv_id").alias("lender"), F.col("n").alias("lent"))
    taken = F.least("h", F.coalesce("lent", F.lit(0)))
    plan = own.join(lenders, "lender", "left").select(
        "conv_id", "lender", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")
    )
    plan = settled(plan, "trie-plan")
    kept = turns.join(plan, "conv_id").filter(F.col("place") > F.col("h"))
    kept = kept.select("conv_id", (F.col("taken") + F.col("place") - F.col("h")).alias("depth"), "length", "d1", "d2", "bytes")
    most = plan.agg(F.max("taken")).first()[0] or 0
    first = turns.filter(F.col("place") <= most).withColumnRenamed("conv_id", "lender")
    lent = first.join(plan, "lender").filter(F.col("place") <= F.col("taken"))
    lent = lent.select("conv_id", F.col("place").alias("depth"), "length", "d1", "d2", "bytes")
    rows = kept.unionByName(lent).withColumn("is_last", F.col("depth") == F.col("length")).drop("length")
    return rows, plan.select("conv_id", "length")


def keyed_prefixes(rows: DataFrame) -> DataFrame:
    """Every first d turns of a conversation with its key and that of one turn less."""
    halves = {}
    for k, seed in enumerate((1, 2)):
        of_turn = F.xxhash64(F.lit(seed), F.col("depth").cast("long"), "d1", "d2")
        halves[LANES[2 * k]] = of_turn.bitwiseAND(F.lit(0xFFFFFFFF))
        halves[LANES[2 * k + 1]] = F.shiftrightunsigned(of_turn, 32)
    block = F.floor((F.col("depth") - 1) / BLOCK)
    rows = rows.withColumns({**halves, "block": block}).drop("d1", "d2")
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "block").agg(*[F.sum(k).alias(k) for k in LANES])
    offsets = totals.select("conv_id", "block", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"o_{k}") for k in LANES])
    sums = rows.withColumns({f"s_{k}": F.sum(k).over(inside) for k in LANES}).join(offsets, ["conv_id", "block"])
    return sums.select(
        "conv_id",
        "depth",
        "bytes",
        "is_last",
        *[(F.col(f"s_{k}") + F.col(f"o_{k}")).alias(k) for k in LANES],
        *[(F.col(f"s_{k}") + F.col(f"o_{k}") - F.col(k)).alias(a) for k, a in zip(LANES, ABOVE, strict=True)],
    )


def _with_root(prefixes: DataFrame, lengths: DataFrame) -> DataFrame:
    zero = {c: F.lit(0).cast("long") for c in ("depth", "bytes", *LANES, *ABOVE)}
    root = lengths.select("conv_id", (F.col("length") == 0).alias("is_last"), *[v.alias(c) for c, v in zero.items()])
    return prefixes.unionByName(root)


def trie_nodes(prefixes: DataFrame) -> DataFrame:
    """One row per node: key, conv_id, parent_conv_id, n_convs, bytes of the last text, n_children."""
    nodes = prefixes.groupBy("depth", *LANES).agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("bytes").alias("bytes"),
        *[F.max(c).alias(c) for c in ABOVE],
    )
    nodes = settled(nodes, "trie-nodes")
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), *[F.col(k).alias(a) for k, a in zip(LANES, ABOVE, strict=True)], F.col("conv_id").alias("parent_conv_id")
    )
    # Written, so that the children of one node, however many, are an ordinary skewed join.
    parents = settled(parents, "trie-parents")
    linked = settled(nodes.filter("depth > 0").join(parents, ["depth", *ABOVE]).unionByName(nodes.filter("depth = 0"), allowMissingColumns=True).drop(*ABOVE), "trie-links")
    children = linked.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    return linked.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def _written(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict]:
    """Like ``settled``, with numbers counted while writing."""
    seen = Observation()
    return settled(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), name), seen.get


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """Sums of ``values`` over the subtree of every node, by rake and compress.

    ``tree`` has conv_id, depth (the name of the node), parent_conv_id (NULL for
    the root), leaf and the values, which are whole numbers. Returns conv_id,
    depth and the sums. The driver sees two counts of every round.
    """
    between = [f"between_{v}" for v in values]
    live, start = _written(
        tree.select(
            F.col("conv_id").alias("c"),
            F.col("depth").alias("d"),
            F.col("parent_conv_id").alias("pc"),
            F.when(F.col("parent_conv_id").isNotNull(), F.col("depth") - 1).alias("pd"),
            "leaf",
            *values,
            *[F.lit(0).cast("long").alias(b) for b in between],
        ),
        "trie-live",
        deepest=F.coalesce(F.max("d"), F.lit(0)),
        inner=F.coalesce(F.count_if(~F.col("leaf")), F.lit(0)),
    )
    bits, inner, round_no = max(1, int(start["deepest"]).bit_length()), start["inner"], 0
    rounds: list[tuple[DataFrame, bool]] = [(live, False)]
    while inner:
        bit = round_no % bits
        handed = [F.sum(F.when(F.col("leaf"), F.col(v) + F.col(b))).alias(f"r_{v}") for v, b in zip(values, between, strict=True)]
        below = live.filter(F.col("pc").isNotNull()).groupBy(F.col("pc").alias("c"), F.col("pd").alias("d")).agg(
            F.count_if(~F.col("leaf")).alias("n_inner"), F.max(F.when(~F.col("leaf"), F.col("d"))).alias("child"), *handed
        )
        one = (F.col("n_inner") == 1) & F.col("pc").isNotNull()
        fits = (F.shiftright("d", bit) % 2 == 0) & (F.shiftright("child", bit) % 2 == 1)
        raked = live.filter(~F.col("leaf")).join(below, ["c", "d"]).select(
            "c",
            "d",
            "pc",
            "pd",
            (F.col("n_inner") == 0).alias("leaf"),
            *[(F.col(v) + F.coalesce(f"r_{v}", F.lit(0))).alias(v) for v in values],
            *between,
            F.coalesce(one & fits, F.lit(False)).alias("out"),
        )
        raked, seen = _written(raked, "trie-raked", inner=F.count_if(~F.col("leaf")), out=F.count_if("out"))
        inner, round_no = seen["inner"] - seen["out"], round_no + 1
        if not seen["out"]:
            live = raked.drop("out")
            rounds.append((live, False))
            continue
        gone = raked.filter("out").select(F.col("c").alias("pc"), F.col("d").alias("pd"), F.col("pc").alias("g_pc"), F.col("pd").alias("g_pd"), *[F.col(x).alias(f"g_{x}") for x in (*values, *between)])
        hung = F.col("g_pc").isNotNull()
        live = settled(
            raked.filter("not out").join(gone, ["pc", "pd"], "left").select(
                "c",
                "d",
                F.when(hung, F.col("g_pc")).otherwise(F.col("pc")).alias("pc"),
                F.when(hung, F.col("g_pd")).otherwise(F.col("pd")).alias("pd"),
                "leaf",
                *values,
                *[(F.col(b) + F.coalesce(F.col(f"g_{v}") + F.col(f"g_{b}"), F.lit(0))).alias(b) for v, b in zip(values, between, strict=True)],
                # The node taken out above this one, and what it held beside this one.
                F.when(hung, F.col("pc")).alias("out_c"),
                F.when(hung, F.col("pd")).alias("out_d"),
                *[(F.col(f"g_{v}") + F.col(b)).alias(f"out_{v}") for v, b in zip(values, between, strict=True)],
            ),
            "trie-live",
        )
        rounds.append((live, True))
    known = None
    for live, compressed in reversed(rounds):
        finished = live.filter("leaf").select("c", "d", *values)
        known = finished if known is None else known.unionByName(finished)
        if compressed:
            events = live.filter(F.col("out_c").isNotNull()).drop(*values).select("c", "d", "out_c", "out_d", *[f"out_{v}" for v in values])
            opened = events.join(known, ["c", "d"]).select(
                F.col("out_c").alias("c"), F.col("out_d").alias("d"), *[(F.col(v) + F.col(f"out_{v}")).alias(v) for v in values]
            )
            known = known.unionByName(settled(opened, "trie-opened"))
    return known.withColumnsRenamed({"c": "conv_id", "d": "depth"})


def _joined_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted ids of a node as texts of bounded length, in order."""
    node, ids, size, first = None, [], 0, 0
    done: list[tuple] = []

    def close() -> None:
        if ids:
            done.append((*node, first, ",".join(ids)))

    for batch in batches:
        if not len(batch):
            continue
        names, depths, members = (batch[c].to_numpy() for c in ("conv_id", "depth", "member"))
        edges = sorted({*runs(names)[0].tolist(), *runs(depths)[0].tolist(), len(batch)})
        for begin, end in zip(edges, edges[1:]):
            at = (int(names[begin]), int(depths[begin]))
            for member in members[begin:end].tolist():
                if at != node or size > ID_TEXT:
                    close()
                    node, ids, size, first = at, [], 0, member
                ids.append(str(member))
                size += len(ids[-1]) + 1
        yield pd.DataFrame(done, columns=["conv_id", "depth", "first", "ids"])
        done = []
    close()
    yield pd.DataFrame(done, columns=["conv_id", "depth", "first", "ids"])


def _hashed_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 over the texts of a node, one after the other."""
    node, digest = None, hashlib.sha256()
    for batch in batches:
        done = []
        for name, depth, text in zip(batch["conv_id"], batch["depth"], batch["ids"], strict=True):
            if (name, depth) != node:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = (name, depth), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
        yield pd.DataFrame(done, columns=["conv_id", "depth", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, digest.hexdigest())], columns=["conv_id", "depth", "ends_sha256"])


def hashed_ends(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined, sorted ids of the conversations that end at a node.

    ``ends`` has conv_id, depth (the node) and member. Ids are joined where a
    range of them lies; the task that hashes a node reads the joined texts one
    batch after the other and holds none of them longer.
    """
    ranged = ends.repartitionByRange("conv_id", "depth", "member").sortWithinPartitions("conv_id", "depth", "member")
    texts = ranged.select("conv_id", "depth", "member").mapInPandas(_joined_ids, "conv_id long, depth long, first long, ids string")
    dealt = texts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
    return dealt.mapInPandas(_hashed_ids, "conv_id long, depth long, ends_sha256 string")


def conversation_trie(conversations: DataFrame, borrowed: Column | None = None, lender: Column | None = None) -> DataFrame:
    """One row per node of the prefix trie of (rebuilt) conversations.

    ``conversations`` has conv_id, turn, role and text; ``borrowed`` and
    ``lender`` are those of ``rebuilt``, by default every conversation is taken
    as it is. Columns: conv_id (smallest member), depth, parent_conv_id (NULL
    for the root), n_convs, n_children, n_leaves, saved_tokens (over the subtree
    the bytes of a node's last text for every member but one) and ends_sha256.

    NULL roles and texts are empty ones. Rows without conv_id take no part.
    Turns of one number, repeated rows included, are all kept, ordered by the
    hash of role and text. An empty table has no nodes, not even a root. Other
    columns play no part, whatever their names.
    """
    turns = settled(placed_turns(conversations), "trie-placed")
    rows, lengths = rebuilt(turns, F.lit(0) if borrowed is None else borrowed, F.col("conv_id") if lender is None else lender)
    prefixes = settled(_with_root(keyed_prefixes(rows), lengths), "trie-prefixes")
    tree = settled(trie_nodes(prefixes), "trie-tree")
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    leaf = F.col("n_children") == 0
    totals = subtree_totals(
        tree.select("conv_id", "depth", "parent_conv_id", leaf.alias("leaf"), leaf.cast("long").alias("n_leaves"), saved.alias("saved_tokens")),
        ["n_leaves", "saved_tokens"],
    )
    names = tree.select("depth", *LANES, "conv_id")
    ends = prefixes.filter("is_last").select("depth", *LANES, F.col("conv_id").alias("member")).join(names, ["depth", *LANES])
    return (
        tree.join(totals, ["conv_id", "depth"])
        .join(hashed_ends(ends), ["conv_id", "depth"], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(NONE_ENDS)).alias("ends_sha256"),
        )
    )
