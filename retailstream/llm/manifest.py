"""A Merkle manifest of a dataset, and what becomes of its root when leaves are tampered with.

The leaves of each tree, in order, are cut into aligned blocks of BLOCK = 3^7 leaves.
A block is a whole subtree, so a task builds it alone; the roots of blocks are the
leaves of the next layer, which is cut alike, until one node per tree is left. The
roots of the trees, in order, are the leaves of one more tree.

Then the layers are gone through from the top down. Each block learns the way from
its own root to the root of all: the siblings at each level, as one row, not one per
leaf. A tampered leaf makes a version of the block by path copying: the nodes above
the leaf are new, all others are those of the block itself. The way up goes on with
copies of the nodes above the block, from the siblings that it has learnt. So versions
meet nowhere and cost their height each, however many there are.

Ranks come from a sort by ranges, written once: a place within its partition and
the counts of the partitions before, so that a tree with most of the leaves is
spread like any other.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, stored

FAN = 3
HEIGHT = 7
BLOCK = FAN**HEIGHT  # leaves of a block
PIECE = 16 << 20  # bytes of proofs that a task hands on at once
ROWS = 4096  # rows, likewise
_PART_BITS = 33  # of monotonically_increasing_id() count rows within a partition


def digest(*parts: bytes) -> bytes:
    """SHA-256 as lowercase hex digits."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def encoded(value: Column) -> Column:
    """A value for hashing: how many bytes, a colon, the bytes; a dash for NULL."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256)


class Block:
    """A subtree over consecutive leaves; `copied` makes versions of it.

    Its levels are never changed: a version has new nodes for the ancestors of its leaf
    and shares all others.
    """

    def __init__(self, leaves: list[bytes], whole: bool):
        """`whole` if its tree goes on above: then even a single node goes up all levels."""
        self.levels = [leaves]
        while len(self.levels) <= HEIGHT if whole else len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([digest(*below[i : i + FAN]) for i in range(0, len(below), FAN)])

    @property
    def root(self) -> bytes:
        return self.levels[-1][0]

    def way(self, at: int) -> list[tuple[list[bytes], list[bytes]]]:
        """The siblings before and after, level by level, from a leaf to the root."""
        steps = []
        for level in self.levels[:-1]:
            first = at - at % FAN
            steps.append((level[first:at], level[at + 1 : first + FAN]))
            at //= FAN
        return steps


def copied(leaf: bytes, way: list[tuple[list[bytes], list[bytes]]]) -> list[bytes]:
    """The nodes of a version from its leaf up: a copy of each ancestor, with the other
    children those of the tree that it is a version of."""
    nodes = [leaf]
    for before, after in way:
        nodes.append(digest(*before, nodes[-1], *after))
    return nodes


def ranked(rows: DataFrame, tree: list[str], order: list[str]) -> DataFrame:
    """The rows with `at`, their rank in their tree from 0, and `n`, the rows of the tree.

    Rows that agree in all of `order` keep some order. The result is written, so that
    ranks stay as they are whoever reads them.
    """
    apart = rows.withColumn("_row", F.monotonically_increasing_id())  # equal rows in bulk can be split
    by = [*tree, *order, "_row"]
    placed = stored(
        apart.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in by])
        .drop("_row").withColumn("_place", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_place", _PART_BITS))
    # One row per partition and tree in it: as many as partitions and trees at most.
    spans = placed.groupBy(*tree, "_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_count"))
    own = Window.partitionBy(*tree)
    before = F.sum("_count").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    spans = checkpointed(spans.select(
        *[F.col(c).alias(f"_t{i}") for i, c in enumerate(tree)], F.col("_part").alias("_p"),
        (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_count").over(own).alias("n"),
    ))
    same = [F.col(c).eqNullSafe(F.col(f"_t{i}")) for i, c in enumerate(tree)] + [F.col("_part") == F.col("_p")]
    joined = placed.join(spans, same).withColumn("at", F.col("_place") + F.col("_shift"))
    return joined.select(*rows.columns, "at", "n")


def _blocks(batches):
    """Columns as lists of each whole group (tree, block), which come sorted and one after another."""
    held, key = None, None
    for batch in batches:
        columns = batch.to_pydict()
        keys = list(zip(columns["tree"], columns["block"], strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            if held is not None and keys[start] == key:
                for name, values in columns.items():
                    held[name].extend(values[start:i])
            else:
                if held is not None:
                    yield held
                held, key = {name: values[start:i] for name, values in columns.items()}, keys[start]
            start = i
    if held is not None:
        yield held


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "at")


def _placed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.call_function("div", F.col("at"), F.lit(BLOCK)))


def _batches(rows, fields: list[tuple[str, pa.DataType]]):
    """Rows as record batches of a bounded size; a row is (its bytes, its values)."""
    held, size = [], 0

    def batch():
        columns = zip(zip(*held, strict=True), fields, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in columns], [name for name, _ in fields])

    for weight, row in rows:
        held.append(row)
        size += weight
        if size > PIECE or len(held) >= ROWS:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def roots(nodes: DataFrame) -> DataFrame:
    """(tree, at, n, hash) -> the same of the next layer: one node per block."""
    fields = [("tree", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("hash", pa.binary())]

    def made(group):
        n = group["n"][0]
        return 0, (group["tree"][0], group["block"][0], -(-n // BLOCK), Block(group["hash"], n > BLOCK).root)

    def run(batches):
        yield from _batches(map(made, _blocks(batches)), fields)

    rows = _by_block(_placed(nodes).select("tree", "block", "at", "n", F.col("hash").cast("binary").alias("hash")))
    return rows.mapInArrow(run, "tree long, at long, n long, hash binary")


_WAY = "array<struct<before:array<binary>,after:array<binary>>>"


def _with_ways(nodes: DataFrame, above: DataFrame | None) -> DataFrame:
    """Nodes by block, behind a row (at -1) with the way from the block's root up, where there is one."""
    rows = _placed(nodes).withColumn("way", F.lit(None).cast(_WAY))
    if above is None:
        return _by_block(rows)
    heads = above.select("tree", F.col("at").alias("block"), F.lit(-1).cast("long").alias("at"), "way")
    return _by_block(rows.unionByName(heads, allowMissingColumns=True))


def _split(group: dict):
    """(way up, the other rows) of a block."""
    if group["at"][0] != -1:
        return [], group
    return [(step["before"], step["after"]) for step in group["way"][0]], {name: values[1:] for name, values in group.items()}


def ways(nodes: DataFrame, above: DataFrame | None) -> DataFrame:
    """(tree, at, way) of the nodes of an upper layer, given the ways of the layer above it."""
    step = pa.struct([("before", pa.list_(pa.binary())), ("after", pa.list_(pa.binary()))])
    fields = [("tree", pa.int64()), ("at", pa.int64()), ("way", pa.list_(step))]

    def made(groups):
        for group in groups:
            up, rows = _split(group)
            block = Block(rows["hash"], rows["n"][0] > BLOCK)
            for i, at in enumerate(rows["at"]):
                way = block.way(i) + up
                yield 200 * len(way), (rows["tree"][i], at, [{"before": b, "after": a} for b, a in way])

    def run(batches):
        yield from _batches(made(_blocks(batches)), fields)

    own = nodes.select("tree", "at", "n", F.col("hash").cast("binary").alias("hash"))
    return _with_ways(own, above).select("tree", "block", "at", "n", "hash", "way").mapInArrow(run, f"tree long, at long, way {_WAY}")


def _layers(leaves: DataFrame) -> list[DataFrame]:
    """The nodes (tree, at, n, hash) of each layer, up to one per tree."""
    layers, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        layers.append(checkpointed(roots(layers[-1])))
        most = -(-most // BLOCK) if most > BLOCK else 1
    return layers


def _top_down(layers: list[DataFrame], above: DataFrame | None) -> DataFrame | None:
    """The ways of the lowest of `layers`, which are in order from below."""
    for nodes in reversed(layers):
        above = checkpointed(ways(nodes, above))
    return above


def _versions(leaves: DataFrame, above: DataFrame) -> DataFrame:
    """What `manifest` returns, of leaves (tree, at, n, hash, doc_id, changed) and the ways above their blocks."""
    text = pa.string()
    fields = [
        ("doc_id", pa.int64()), ("leaf", text), ("subroot", text), ("root", text), ("proof", pa.list_(text)), ("at", pa.list_(pa.int32())),
        ("width", pa.list_(pa.int32())), ("tampered_leaf", text), ("folded_root", text), ("copied", pa.int32()),
    ]

    def made(groups):
        for group in groups:
            up, rows = _split(group)
            n = rows["n"][0]
            block = Block(rows["hash"], n > BLOCK)
            # Levels of the tree itself; what is above them belongs to the tree of trees.
            own = _height(n) - (len(block.levels) - 1)
            ancestors = copied(block.root, up)
            subroot, root = ancestors[own].decode(), ancestors[-1].decode()
            for i, (number, leaf, changed) in enumerate(zip(rows["doc_id"], rows["hash"], rows["changed"], strict=True)):
                way = block.way(i) + up
                version = copied(leaf if changed is None else changed, way)
                proof = [s.decode() for before, after in way for s in (*before, *after)]
                yield 64 * len(proof), (
                    number, leaf.decode(), subroot, root, proof, [len(b) for b, _ in way], [len(b) + 1 + len(a) for b, a in way],
                    None if changed is None else changed.decode(), version[-1].decode(),
                    0 if changed is None or changed == leaf else len(version) - 1,
                )

    def run(batches):
        yield from _batches(made(_blocks(batches)), fields)

    own = leaves.select("tree", "at", "n", F.col("hash").cast("binary").alias("hash"), "doc_id", F.col("changed").cast("binary").alias("changed"))
    return _with_ways(own, above).select("tree", "block", "at", "n", "hash", "way", "doc_id", "changed").mapInArrow(
        run,
        "doc_id long, leaf string, subroot string, root string, proof array<string>, at array<int>, width array<int>,"
        " tampered_leaf string, folded_root string, copied int",
    )


def refolded(leaf: str, proof: list[str], at: list[int], width: list[int]) -> str:
    """The root that a leaf and its proof lead to."""
    node, rest = leaf.encode(), iter(proof)
    for place, nodes in zip(at, width, strict=True):
        siblings = [next(rest).encode() for _ in range(nodes - 1)]
        node = digest(*siblings[:place], node, *siblings[place:])
    return node.decode()


def _height(n: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def manifest(
    docs: DataFrame, tampered: Column, changed_text: Column, key: str = "doc_id", tree: str = "source", text: str = "text",
    others: tuple[str, ...] = ("lang", "n_chars"),
) -> DataFrame:
    """One row per document: its place in the manifest, and the root if it alone were changed.

    A leaf is the hash of id, tree, other columns and text. `proof` holds the siblings
    of the leaf and of its ancestors up to the root, each level from left to right;
    `at` and `width` tell, per level, the node's place in its run and the nodes of the
    run, so that `refolded` gets the root from a leaf and its proof. `tampered` says
    which documents are changed, to `changed_text`: their `tampered_leaf` (NULL for all
    others) makes a version of the tree of which `copied` nodes are new, none if the
    leaf is what it was, and `folded_root` is its root. Of others it is the root folded
    from the leaf.

    The leaves of a tree ascend by id, a NULL id first; rows that repeat an id follow
    each other by their hashes, and each is a leaf. A NULL tree is one of its own, the
    first. NULL in `tampered` is false; NULL texts stay NULL. Other columns are left
    out; an empty table gives an empty result.
    """
    col = lambda c: F.col(f"`{c}`")
    leaf = lambda body: leaf_of(col(key), col(tree), *[col(c) for c in others], body)
    rows = docs.select(
        col(tree).alias("name"), col(key).cast("long").alias("doc_id"), leaf(col(text)).alias("hash"),
        F.when(tampered, leaf(changed_text)).alias("changed"),
    )
    leaves = ranked(rows, ["name"], ["doc_id", "hash", "changed"])
    trees = ranked(leaves.filter("at = 0").select("name"), [], ["name"]).select("name", F.col("at").alias("tree"), F.col("n").alias("trees"))
    trees = checkpointed(trees)
    leaves = leaves.join(trees.drop("trees"), leaves["name"].eqNullSafe(trees["name"])).select("tree", "at", "n", "hash", "doc_id", "changed")

    layers = _layers(leaves.select("tree", "at", "n", "hash"))
    single = layers[-1] if len(layers) > 1 else leaves
    # Layers go on until the largest tree is one node; by then all others are one each.
    subroots = single.select("tree", F.col("hash").cast("binary").alias("hash")).join(trees, "tree").select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.col("trees").alias("n"), "hash"
    )
    upper = _layers(checkpointed(subroots))
    # A tree is the only node of its last layer: the way above it is that of its place among trees.
    above = _top_down(upper, None).select(F.col("at").alias("tree"), F.lit(0).cast("long").alias("at"), "way")
    return _versions(leaves, _top_down(layers[1:-1], above))


def digests(found: DataFrame) -> DataFrame:
    """The manifest with the proof as a digest, and whether the folded root is the root."""
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", "").cast("binary"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
