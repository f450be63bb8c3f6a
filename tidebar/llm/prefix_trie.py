"""The trie of all conversation prefixes, by truncation peeling.

A conversation is the path of its turns, a turn a code of 24 bytes: half of the SHA-256 of role and text, and the size of
the text. Paths are dealt out in order, so a task has a stretch of the trie. It starts at the deepest turn, merges the
conversations that end at a depth with the nodes that survived from below, closes the nodes, strips the last turn and
groups again, up to the root. Nodes that touch the edge of a stretch stay open: they travel as the two
paths at its edges with what is known at each depth, and are peeled in a further pass over the far fewer edges.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.sources.scratch import drop, materialize

CODE = 24
#: Turns of the paths that one task peels, and conversation ids in one row of a node's list of ends.
TURNS, IDS = 1 << 20, 1 << 16
_NONE = np.iinfo(np.int64).max
_EMPTY = hashlib.sha256(b"").hexdigest()
_SUMS = ("convs", "children", "leaves", "saved")
_KIND = ("kind string, conv_id bigint, depth bigint, parent_conv_id bigint, parent_key binary, node_key binary, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
         "ends_sha256 string, path binary, at_lo array<bigint>, at_convs array<bigint>, at_children array<bigint>, at_leaves array<bigint>, at_saved array<bigint>, ids binary")
_FIELDS = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
_SCHEMA = pa.schema([(c.split()[0], _FIELDS[c.split()[1]]) for c in _KIND.split(", ")])


def turn_code(role: Column, text: Column) -> Column:
    """Null counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    name = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.substring(name, 1, 2 * (CODE - 8)), F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0"))


def turn_lists(conversations: DataFrame) -> DataFrame:
    """``(conv_id, codes array<string>)`` in hexadecimal, ordered by turn, null first, and among equal turns by code.
    Only codes are gathered, never texts. Rows without ``conv_id`` belong to no conversation and are left out."""
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", turn_code(F.col("role"), F.col("text")).alias("code")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.col("t.code").alias("codes"))


def shared_heads(lists: DataFrame, every: int = 5, most: int = 8) -> DataFrame:
    """Conversations rebuilt: the first h turns of conversation ``c - c % every``, as far as there are any, then the own
    turns after the first h, with h = crc32 of the id as text, modulo ``most + 1``."""
    heads = lists.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("codes", 1, most).alias("head"))
    own = lists.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), "codes", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int").alias("h"))
    none = F.array().cast("array<string>")
    return own.join(heads, "base", "left").select("conv_id", F.concat(
        F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("codes", F.col("h") + 1, F.size("codes"))).alias("codes"))


class _Rows:
    """The sorted rows of a task: paths as one array of turns, and what each row adds at which depth."""

    def __init__(self, batches: Iterator[pa.RecordBatch], edges: bool):
        batches = list(batches)
        self.n = sum(b.num_rows for b in batches)
        if not self.n:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        paths = table.column("path").to_pylist()
        self.length = np.array([len(p) // CODE for p in paths])
        self.start = np.cumsum(self.length) - self.length
        self.codes = np.frombuffer(b"".join(paths), ">u8").reshape(-1, CODE // 8)
        self.paths = paths
        row = np.arange(self.n)
        if edges:
            take = {k: table.column(f"at_{k}").combine_chunks().flatten().to_numpy() for k in ("lo", *_SUMS)}
            row = np.repeat(row, self.length + 1)
            depth = np.arange(len(row)) - np.repeat(np.cumsum(self.length + 1) - self.length - 1, self.length + 1)
        else:
            self.conv_id = table.column("conv_id").to_numpy()
            zero = np.zeros(self.n, np.int64)
            take = {"lo": self.conv_id, "convs": zero + 1, "children": zero, "leaves": zero, "saved": zero}
            depth = self.length
        order = np.lexsort((row, -depth))
        self.row, self.depth = row[order], depth[order]
        self.adds = {k: v[order] for k, v in take.items()}
        self.common = self._common()

    def _common(self) -> np.ndarray:
        """Turns that each row has in common with the row before it; -1 for the first."""
        most = np.minimum(self.length[1:], self.length[:-1])
        pair = np.repeat(np.arange(self.n - 1), most)
        pos = np.arange(len(pair)) - np.repeat(np.cumsum(most) - most, most)
        differ = (self.codes[self.start[pair + 1] + pos] != self.codes[self.start[pair] + pos]).any(1)
        first = most.copy()
        np.minimum.at(first, pair[differ], pos[differ])
        return np.concatenate(([-1], first))


def _key(path: bytes, depth: int) -> bytes:
    return hashlib.sha256(path[: CODE * depth]).digest()[:16]


def _ends(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def peel(edges: bool, last: bool):
    """Peels the stretch of a task. ``edges``: its rows are edges of an earlier pass, not conversations; ``last``: it is the
    only stretch, so that nothing stays open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(batches, edges)
        if not rows.n:
            return
        out: dict[str, list] = {c: [] for c in _SCHEMA.names}
        held = 0

        def put(**columns) -> None:
            nonlocal held
            n = len(next(iter(columns.values())))
            for c in _SCHEMA.names:
                out[c].extend(columns.get(c, [None] * n))
            held += n

        def batch() -> pa.RecordBatch:
            nonlocal held
            made = pa.record_batch([pa.array(out[f.name], f.type) for f in _SCHEMA], schema=_SCHEMA)
            for c in out.values():
                c.clear()
            held = 0
            return made

        end = rows.n - 1
        none = np.zeros(0, np.int64)
        alive = {k: none for k in ("first", "last", "lo", *_SUMS)} | {"open": none.astype(bool), "ends": []}
        chains = [{k: np.full(rows.length[r] + 1, _NONE if k == "lo" else 0, np.int64) for k in ("lo", *_SUMS)} for r in (0, end)]
        bounds = np.searchsorted(-rows.depth, -np.arange(rows.length.max(), -2, -1))  # where the rows of each depth begin

        for k, d in enumerate(range(int(rows.length.max()), -1, -1)):
            ended = slice(bounds[k], bounds[k + 1])
            met = rows.row[ended]
            # what ends here joins the nodes that survive from below, in the order of their first rows
            first = np.concatenate((alive["first"], met))
            order = np.argsort(first, kind="stable")
            first = first[order]
            below = np.concatenate((~alive["open"], np.zeros(len(met), bool)))[order]
            idle = np.concatenate((alive["open"], np.zeros(len(met), bool)))[order]  # open nodes add nothing yet
            last_row = np.concatenate((alive["last"], met))[order]
            adds = {c: np.concatenate((alive[c], rows.adds[c][ended]))[order] for c in ("lo", *_SUMS)}
            new = rows.common[first] < d
            new[1:] &= first[1:] != first[:-1]
            at = np.flatnonzero(new)
            node = {"first": first[at], "last": np.maximum.reduceat(last_row, at), "lo": np.minimum.reduceat(np.where(idle, _NONE, adds["lo"]), at)}
            for c in _SUMS:
                part = np.where(idle, 0, adds[c])
                node[c] = np.add.reduceat(np.where(below, 1, part) if c == "children" else part, at)
            node["open"] = np.zeros(len(at), bool) if last else (node["first"] == 0) | (node["last"] == end)
            group = np.cumsum(new) - 1
            # the nodes below are done: their parent is known, or open and known by its key
            rank = np.empty(len(order), np.int64)
            rank[order] = group
            parent = rank[: len(alive["first"])]
            _put_nodes(put, rows, alive, node, parent, d, edges)
            node["ends"] = [None if edges else _EMPTY] * len(at)
            if not edges and len(met):
                where = rank[len(alive["first"]):]
                cut = np.flatnonzero(np.diff(where, prepend=-1))
                for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(met)]):
                    g, ids = int(where[a]), rows.conv_id[met[a:b]]
                    if node["open"][g]:
                        key = _key(rows.paths[met[a]], d)
                        for s in range(0, len(ids), IDS):
                            put(kind=["ids"], node_key=[key], conv_id=[int(ids[s])], ids=[_ends(ids[s:s + IDS])])
                    else:
                        node["ends"][g] = hashlib.sha256(_ends(ids)).hexdigest()
            for g in np.flatnonzero(node["open"]).tolist():
                edge = chains[0 if node["first"][g] == 0 else 1]
                for c in ("lo", *_SUMS):
                    edge[c][d] = node[c][g]
            shut = ~node["open"]
            weight = rows.codes[rows.start[node["first"]] + d - 1, -1].astype(np.int64) if d else np.zeros(len(at), np.int64)
            node["saved"] = node["saved"] + np.where(shut, (node["convs"] - 1) * weight, 0)
            node["leaves"] = np.where(shut & (node["children"] == 0), 1, node["leaves"])
            alive = node
            if held >= 1 << 16:
                yield batch()
        if last:
            _put_nodes(put, rows, alive, None, np.zeros(1, np.int64), -1, edges)
        else:
            edge_rows = [(0, chains[0])] + ([(end, chains[1])] if rows.paths[end] != rows.paths[0] else [])
            put(kind=["edge"] * len(edge_rows), path=[rows.paths[r] for r, _ in edge_rows], **{f"at_{c}": [x[c] for _, x in edge_rows] for c in ("lo", *_SUMS)})
        yield batch()
    return run


def _put_nodes(put, rows: _Rows, below: dict, node: dict | None, parent: np.ndarray, d: int, edges: bool) -> None:
    """Rows of the closed nodes at depth ``d + 1``; a parent that is open is named by its key."""
    done = np.flatnonzero(~below["open"])
    if not len(done):
        return
    parent = parent[done]
    open_above = node["open"][parent] if node else np.zeros(len(done), bool)
    paths = [rows.paths[r] for r in below["first"][done].tolist()] if edges or open_above.any() else None
    known = [None] * len(done) if node is None else [None if o else v for o, v in zip(open_above.tolist(), node["lo"][parent].tolist())]
    keys = {}
    for g, i in zip(parent[open_above].tolist(), np.flatnonzero(open_above).tolist()):
        if g not in keys:
            keys[g] = _key(paths[i], d)
    put(kind=["node"] * len(done), conv_id=below["lo"][done].tolist(), depth=[d + 1] * len(done), parent_conv_id=known,
        parent_key=[keys[g] if o else None for g, o in zip(parent.tolist(), open_above.tolist())],
        node_key=[_key(p, d + 1) for p in paths] if edges else [None] * len(done),
        n_convs=below["convs"][done].tolist(), n_children=below["children"][done].tolist(), n_leaves=below["leaves"][done].tolist(), saved_tokens=below["saved"][done].tolist(),
        ends_sha256=[below["ends"][k] for k in done.tolist()])


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's list of ends; the parts of a list stream by in order."""
    key, digest = None, None
    for batch in batches:
        keys, done = [], []
        for k, ids in zip(batch.column("node_key").to_pylist(), batch.column("ids").to_pylist()):
            if k == key:
                digest.update(b"," + ids)
                continue
            if key is not None:
                keys.append(key)
                done.append(digest.hexdigest())
            key, digest = k, hashlib.sha256(ids)
        yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(done, pa.string())], ["node_key", "ends"])
    if key is not None:
        yield pa.record_batch([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], ["node_key", "ends"])


def _tasks(spark, turns: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // TURNS))


def prefix_nodes(lists: DataFrame) -> DataFrame:
    """The nodes of the trie of ``lists (conv_id, codes)``, one row each, all numbers long: ``conv_id``, the smallest member; ``depth``; ``parent_conv_id``, null for
    the root; ``n_convs``; ``n_children``; ``n_leaves``, childless nodes at or below it; ``saved_tokens``, over itself and all below, the bytes of the last text
    for each member but one; ``ends_sha256`` of the comma-joined ids that end here.

    Ids are distinct. A list without turns is a member of the root alone; an empty table has no nodes. Equal
    conversations are dealt out by id, so a path that a third of all rows share is no task of its own. A conversation's codes stand together in a row,
    24 bytes a turn. A task holds about ``TURNS`` of them. The list of ends of an open node is hashed as it streams by, in parts of ``IDS``."""
    spark = lists.sparkSession
    paths = materialize(lists.select("conv_id", F.unhex(F.array_join("codes", "")).alias("path"), F.size("codes").cast("long").alias("turns")), "paths")
    total = paths.agg(F.sum(F.col("turns") + 1).alias("n")).first().n or 0
    tasks = _tasks(spark, total)
    dealt = paths.repartitionByRange(tasks, "path", "conv_id").sortWithinPartitions("path", "conv_id").select("path", "conv_id")
    first = materialize(dealt.mapInArrow(peel(False, tasks == 1), _KIND), "peeled")
    drop(paths)
    passes, peeled = [], first
    while tasks > 1:
        edge = peeled.filter("kind = 'edge'").select("path", *[f"at_{c}" for c in ("lo", *_SUMS)])
        turns = edge.agg(F.sum(F.octet_length("path") / CODE + 1).alias("n")).first().n or 0
        tasks = max(1, min(-(-int(turns) // TURNS), tasks // 8))
        dealt = edge.repartitionByRange(tasks, "path") if tasks > 1 else edge.repartition(1)
        peeled = materialize(dealt.sortWithinPartitions("path").mapInArrow(peel(True, tasks == 1), _KIND), "peeled")
        passes.append(peeled)
    if not passes:
        return _nodes(first).select(*NODE)
    late = _nodes(passes[0])
    for more in passes[1:]:
        late = late.unionByName(_nodes(more))
    ends = (first.filter("kind = 'ids'").select("node_key", "conv_id", "ids").repartition("node_key").sortWithinPartitions("node_key", "conv_id")
            .mapInArrow(_hash_ids, "node_key binary, ends string"))
    late = materialize(late.drop("ends_sha256").join(ends, "node_key", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(_EMPTY))), "late")
    above = late.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("above"))
    every = _nodes(first).drop("node_key").unionByName(late.drop("node_key", "ends"))
    # nodes under an open parent look its smallest member up; the planner broadcasts the parents only if they are few
    found = every.filter("parent_key IS NOT NULL").join(above, "parent_key").withColumn("parent_conv_id", F.col("above"))
    return every.filter("parent_key IS NULL").select(*NODE).unionByName(found.select(*NODE))


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _nodes(peeled: DataFrame) -> DataFrame:
    return peeled.filter("kind = 'node'").select(*NODE, "parent_key", "node_key")


def conversation_trie(conversations: DataFrame, shared: bool = False) -> DataFrame:
    """``prefix_nodes`` of ``conversations (conv_id, turn, role, text)``, as they are or, with ``shared``, rebuilt by
    ``shared_heads``. Null roles and texts count as empty, equal turn numbers are ordered by the turn's code, and repeated
    rows are turns of their own. Other columns are ignored."""
    lists = turn_lists(conversations)
    if shared:
        lists = shared_heads(materialize(lists, "turns"))
    return prefix_nodes(lists)
