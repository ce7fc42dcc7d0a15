"""Merkle manifest of a dataset by bitmap ranks: each row is a leaf, groups are trees of fan-out 3, their roots are one more.

A leaf's place in its group comes from the group's bitmap of ids (see ``bitmaps``); no row is sorted. Places key slots: 243
successive places make one slot array, which one task reduces by five levels; arrays of the reduced nodes are reduced in turn
until a group has one node, its subroot. Subroots, ordered by group, form the last tree. The way up, computed once for a whole
slot array, and the siblings inside the array are a leaf's proof, and a leaf given with the row is folded along it to a root.

Defined results: rows of a null group are a group, ordered first; a null id comes before all others of its group. Rows of equal
group and id stand in the order of their leaves, so equal rows are neighbours and the root does not depend on how rows are stored.
A single leaf is its group's subroot; a single subroot is the root, and the proof of a lone row is the digest of nothing. Null
fields are ``-``, an empty text is ``0:``; long texts are hashed whole. An empty table gives no rows. Other columns are ignored,
and none can clash, as only the named ones are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored, written
from .bitmaps import places

#: Children of a node (fixed), and the levels that one slot array reduces.
FAN = 3
LEVELS = 5
SLOTS = FAN**LEVELS

_STEPS = "array<struct<slot:int,others:array<binary>>>"


def field(value: Column) -> Column:
    """Unambiguous text of a value: its bytes and their number."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields."""
    return F.sha2(F.concat(*map(field, fields)).cast("binary"), 256)


def node(children: list[bytes]) -> bytes:
    return sha256("".join(c.hex() for c in children).encode()).digest()


def reduce_slots(digests: list[bytes], alone: bool) -> tuple[bytes, list[list[tuple[int, list[bytes]]]]]:
    """The node over a slot array and each slot's steps to it: its own slot in its run and the run's other digests.

    ``alone``: the array is all its tree has, and levels end at one node. Otherwise every array is reduced by all levels.
    """
    steps: list[list[tuple[int, list[bytes]]]] = [[] for _ in digests]
    here, width = digests, 1
    for _ in range(LEVELS):
        if alone and len(here) == 1:
            break
        for i, way in enumerate(steps):
            place = i // width
            first = place - place % FAN
            way.append((place % FAN, here[first:place] + here[place + 1 : first + FAN]))
        here = [node(here[i : i + FAN]) for i in range(0, len(here), FAN)]
        width *= FAN
    return here[0], steps


def fold(digest: bytes, steps: list[tuple[int, list[bytes]]]) -> bytes:
    """The node that the digest and its siblings lead to."""
    for slot, others in steps:
        digest = node([*others[:slot], digest, *others[slot:]])
    return digest


def _as_steps(way) -> list[tuple[int, list[bytes]]]:
    return [(s["slot"], s["others"]) for s in way]


def _as_rows(way: list[tuple[int, list[bytes]]]) -> list[dict]:
    return [{"slot": slot, "others": others} for slot, others in way]


def _packed(nodes: DataFrame) -> DataFrame:
    """Slot arrays of successive nodes of a tree: at most ``SLOTS`` entries each."""
    slots = F.sort_array(F.collect_list(F.struct((F.col("place") % SLOTS).alias("slot"), "digest")))
    return nodes.groupBy("tree", F.floor(F.col("place") / SLOTS).alias("block")).agg(
        F.first("n").alias("n"), F.transform(slots, lambda s: s["digest"]).alias("digests"))


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tops, steps = [], []
        for n, digests in zip(batch.column("n").to_pylist(), batch.column("digests").to_pylist(), strict=True):
            top, ways = reduce_slots(digests, n <= SLOTS)
            tops.append(top)
            steps.append([_as_rows(way) for way in ways])
        kind = pa.list_(pa.list_(pa.struct([("slot", pa.int32()), ("others", pa.list_(pa.binary()))])))
        yield pa.RecordBatch.from_pydict({
            "tree": batch.column("tree"), "block": batch.column("block"), "n": [-(-n // SLOTS) for n in batch.column("n").to_pylist()],
            "digest": pa.array(tops, pa.binary()), "steps": pa.array(steps, kind)})


def climb(nodes: DataFrame) -> DataFrame:
    """Nodes (``tree``, ``place``, ``n`` of their tree, ``digest``) with their ``steps`` to the ``top`` of the tree.

    Each round reduces the number of nodes ``SLOTS`` times; there are at most eight for 64-bit places.
    """
    done = nodes.where("n = 1").select("tree", "place", F.expr(f"cast(array() as {_STEPS})").alias("steps"), F.col("digest").alias("top"))
    more = nodes.where("n > 1")
    if more.isEmpty():
        return done
    kind = nodes.schema["tree"].dataType.simpleString()
    blocks = stored(_packed(more).mapInArrow(_reduced, f"tree {kind}, block long, n long, digest binary, steps array<{_STEPS}>"))
    above = climb(blocks.select("tree", F.col("block").alias("place"), "n", "digest")).select(
        F.col("tree").alias("_tree"), F.col("place").alias("_block"), F.col("steps").alias("_above"), "top")
    inner = blocks.select("tree", "block", F.posexplode("steps").alias("slot", "_inner"))
    up = inner.join(above, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block")))
    return stored(done.unionByName(up.select(
        "tree", (F.col("block") * SLOTS + F.col("slot")).alias("place"), F.concat("_inner", "_above").alias("steps"), "top")))


def _proven(with_proof: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, ways = reduce_slots(row["leaves"], row["n"] <= SLOTS)
                above = [*_as_steps(row["block_steps"]), *_as_steps(row["tree_steps"])]
                rest = "".join(o.hex() for _, others in above for o in others)
                folded: dict[bytes, bytes] = {}
                out: dict[str, list] = {"proof_sha256": [], "folded_root": [], "proof": []}
                for way, claim in zip(ways, row["claims"], strict=True):
                    siblings = "".join(o.hex() for _, others in way for o in others) + rest
                    out["proof_sha256"].append(sha256(siblings.encode()).hexdigest())
                    top = fold(claim, way)
                    if top not in folded:
                        folded[top] = fold(top, above)
                    out["folded_root"].append(folded[top].hex())
                    if with_proof:
                        out["proof"].append(_as_rows([*way, *above]))
                size = len(row["ids"])
                columns = {
                    "id": pa.array(row["ids"], batch.schema.field("ids").type.value_type),
                    "tree": pa.array([row["tree"]] * size, batch.schema.field("tree").type),
                    "place": pa.array(range(row["block"] * SLOTS, row["block"] * SLOTS + size), pa.int64()),
                    "leaf": [x.hex() for x in row["leaves"]], "subroot": [row["subroot"].hex()] * size, "root": [row["root"].hex()] * size,
                    "proof_sha256": out["proof_sha256"], "folded_root": out["folded_root"],
                    "verified": [f == row["root"].hex() for f in out["folded_root"]],
                }
                if with_proof:
                    kind = pa.list_(pa.struct([("slot", pa.int32()), ("others", pa.list_(pa.binary()))]))
                    columns["proof"] = pa.array(out["proof"], kind)
                yield pa.RecordBatch.from_pydict(columns)

    return run


def manifest(
    docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    copy: dict[str, Column] | None = None, with_proof: bool = False,
) -> DataFrame:
    """Per row its ``key`` and ``group``, ``place``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    ``copy`` gives columns of the copy that is held against the manifest, where they are not the row's own. ``with_proof`` adds
    ``proof``, the steps from leaf to root: the slot of the way up in its run and the digests of the run's others.
    """
    copy = copy or {}
    own = docs.select(
        F.col(key).cast("long").alias("id"), F.col(group).alias("tree"), F.unhex(leaf(*(F.col(f) for f in fields))).alias("leaf"),
        F.unhex(leaf(*(copy.get(f, F.col(f)) for f in fields))).alias("claim"),
    ).withColumn("first", F.conv(F.substring(F.hex("leaf"), 1, 15), 16, 10).cast("long"))
    placed = places(own, ["tree"], ["id", "first"]).withColumnsRenamed({"_place": "place", "_total": "n"})
    slots = F.sort_array(F.collect_list(F.struct((F.col("place") % SLOTS).alias("slot"), "id", "leaf", "claim")))
    blocks = written(
        placed.groupBy("tree", F.floor(F.col("place") / SLOTS).alias("block")).agg(F.first("n").alias("n"), slots.alias("slots")).select(
            "tree", "block", "n", F.transform("slots", lambda s: s["id"]).alias("ids"),
            F.transform("slots", lambda s: s["leaf"]).alias("leaves"), F.transform("slots", lambda s: s["claim"]).alias("claims")),
        "slots")
    kind = blocks.schema["tree"].dataType.simpleString()
    reduced = blocks.select("tree", "block", "n", F.col("leaves").alias("digests")).mapInArrow(
        _reduced, f"tree {kind}, block long, n long, digest binary, steps array<{_STEPS}>")
    ways = climb(stored(reduced.select("tree", F.col("block").alias("place"), "n", "digest")))
    trees = _forest(ways.where("place = 0").select("tree", F.col("top").alias("digest")))
    up = ways.select(F.col("tree").alias("_t"), F.col("place").alias("_b"), F.col("steps").alias("block_steps"), F.col("top").alias("subroot"))
    met = blocks.join(up, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("block") == F.col("_b"))).join(trees, F.col("tree").eqNullSafe(F.col("_g")))
    id_kind = "long"
    schema = f"id {id_kind}, tree {kind}, place long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    found = met.select("tree", "block", "n", "ids", "leaves", "claims", "block_steps", "subroot", "tree_steps", "root").mapInArrow(
        _proven(with_proof), schema + (f", proof {_STEPS}" if with_proof else ""))
    return found.withColumnsRenamed({"id": key, "tree": group})


def _forest(subroots: DataFrame) -> DataFrame:
    """For every group (``_g``) its ``tree_steps`` to the ``root`` over all groups.

    Groups, far fewer than rows, are sorted over all tasks; numbers that rise with their order are keys of one more bitmap.
    """
    ordered = stored(subroots.orderBy(F.asc_nulls_first("tree"))).select(F.col("tree").alias("_g"), "digest", F.monotonically_increasing_id().alias("id"))
    nodes = stored(places(stored(ordered), [], ["id"]).select(F.lit(0).alias("tree"), F.col("_place").alias("place"), F.col("_total").alias("n"), "digest", "_g"))
    ways = climb(nodes.drop("_g")).select(F.col("place").alias("_p"), F.col("steps").alias("tree_steps"), F.col("top").alias("root"))
    return nodes.join(ways, F.col("place") == F.col("_p")).select("_g", "tree_steps", "root")
