"""Merkle manifest of a dataset, by blocks below and a small broadcast tree above.

Leaves are numbered inside their group through ranges of (group, order, leaf): a range's rows are counted by group, and sums
over the ranges of a group are the offsets, so no task sorts a group. Blocks of ``8 ** levels`` consecutive nodes are
then reduced to one node each, block by block on the executors and again over their tops, until few tops remain. The driver
builds the upper tree over these, broadcasts it, and every block reads from it the path from its own top to the root; rows end
their proofs with that path. Where several rounds were needed, the paths of the lower blocks travel as a table.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved

ARITY, HEX = 8, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NULL_GROUP = "-"  # sorts before the "=" that begins every other group's key
Path = list[tuple[bytes, bytes]]  # a level: the run's digests before the own one, and after it


def field(x: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*columns: Column) -> Column:
    return F.sha2(F.concat(*(field(c) for c in columns)).cast("binary"), 256)


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def height(n: int) -> int:
    """How many levels stand above ``n`` nodes of one tree."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def reduced(level: bytes) -> bytes:
    step = ARITY * HEX
    return b"".join(digest(level[i : i + step]) for i in range(0, len(level), step))


def climbed(level: bytes, levels: int) -> list[bytes]:
    """The digests of a block, and of the ``levels`` levels above it."""
    out = [level]
    for _ in range(levels):
        out.append(reduced(out[-1]))
    return out


def path_in(levels: list[bytes], place: int) -> Path:
    """From a node of the first level up to the last one."""
    out = []
    for level in levels[:-1]:
        run, own = place // ARITY * ARITY * HEX, place * HEX
        out.append((level[run:own], level[own + HEX : run + ARITY * HEX]))
        place //= ARITY
    return out


def folded(node: bytes, path: Path) -> bytes:
    for before, after in path:
        node = digest(before + node + after)
    return node


class UpperTree:
    """Over the tops of the blocks: each group's levels up to its subroot, and the levels over the subroots."""

    def __init__(self, tops: list[tuple[str, int, str]]):
        held: dict[str, list[str]] = {}
        for group, _, top in sorted(tops):
            held.setdefault(group, []).append(top)
        self.groups = {g: climbed("".join(x).encode(), height(len(x))) for g, x in held.items()}
        self.place = {g: i for i, g in enumerate(sorted(held, key=str.encode))}
        self.over = climbed(b"".join(self.groups[g][-1] for g in self.place), height(len(self.place)))

    def path(self, group: str, place: int) -> tuple[Path, str, str]:
        """From a top to the root; the subroot; the root."""
        own = self.groups[group]
        return path_in(own, place) + path_in(self.over, self.place[group]), own[-1].decode(), self.over[-1].decode()


PLACED = "g string, at long, n long, top string"


def _block(table: pa.Table, levels: int) -> tuple[pa.Table, list[bytes]]:
    """One block of a group of ``n`` nodes in order, and its digests up to ``levels`` levels above, or to the group's subroot."""
    table = table.sort_by("at")
    return table, climbed("".join(table.column("top").to_pylist()).encode(), min(levels, height(table.column("n")[0].as_py())))


def _tops(levels: int):
    def run(table: pa.Table) -> pa.Table:
        table, held = _block(table, levels)
        n, at, size = table.column("n")[0].as_py(), table.column("at")[0].as_py(), ARITY**levels
        return pa.table({"g": table.column("g")[:1], "at": pa.array([at // size]), "n": pa.array([-(-n // size)]), "top": pa.array([held[-1].decode()])})

    return run


def _packed(path: Path) -> list[dict]:
    return [{"before": a, "after": b} for a, b in path]


PATHS = "g string, at long, subroot string, root string, path array<struct<before:binary,after:binary>>"


def _paths(table: pa.Table, above: tuple[Path, str, str], levels: int) -> pa.Table:
    """The whole path of each node of a block."""
    table, held = _block(table, levels)
    rest, subroot, root = above
    m = table.num_rows
    rows = [_packed(path_in(held, i) + rest) for i in range(m)]
    kind = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))
    return pa.table([table.column("g"), table.column("at"), pa.array([subroot] * m), pa.array([root] * m), pa.array(rows, kind)], ["g", "at", "subroot", "root", "path"])


def _proofs(table: pa.Table, above: tuple[Path, str, str], levels: int, whole: bool) -> pa.Table:
    """Each row of a block of leaves with its proof and what its offered leaf folds to."""
    table, held = _block(table, levels)
    rest, subroot, root = above
    tail = b"".join(a + b for a, b in rest)
    proof, fold, told = [], [], []
    for i, offered in enumerate(table.column("offered").to_pylist()):
        low = path_in(held, i)
        proof.append(hashlib.sha256(b"".join(a + b for a, b in low) + tail).hexdigest())
        fold.append(folded(folded(offered.encode(), low), rest).decode())
        if whole:
            told.append(_packed(low + rest))
    m = table.num_rows
    named = {"g": table.column("g"), "id": table.column("id"), "leaf": table.column("top"), "subroot": pa.array([subroot] * m), "root": pa.array([root] * m), "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(fold, pa.string())}
    if whole:
        named["proof"] = pa.array(told, pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())])))
    return pa.table(named)


def placed(leaves: DataFrame, rows_per_range: int = 1_000_000) -> DataFrame:
    """``at``: the place of each row (g, id, leaf, ...) in its group, by id (null first) and leaf; ``n``: the group's size."""
    spark = leaves.sparkSession
    leaves = saved(leaves, "leaves")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // rows_per_range))
    order = ["g", "id", "leaf", "tie"]  # the last parts rows that agree in all else
    ranged = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("tie")
    rows = saved(ranged.withColumn("row", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("row", 33)
    runs = rows.groupBy("g", part.alias("part")).agg(F.min("row").alias("first"), F.count("*").alias("held"))
    own = Window.partitionBy("g")
    runs = runs.withColumn("before", F.sum("held").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("held")).withColumn("n", F.sum("held").over(own))
    return rows.withColumn("part", part).join(runs, ["g", "part"]).withColumn("at", F.col("before") + F.col("row") - F.col("first")).drop("row", "part", "first", "held", "before")


def manifest(rows: DataFrame, leaf: Column, group: str = "lang", order: str = "doc_id", offered: Column | None = None, proofs: bool = False, levels: int = 4, most_tops: int = 50_000, most_groups: int = 1_000_000) -> DataFrame:
    """One row per input row: the group and order columns, leaf, subroot, root, proof_sha256, folded_root, verified, and with ``proofs``
    the proof itself, from leaf to root (of each level the run's digests before and after the own one).

    ``leaf`` is the digest of a row (``leaf_of``); ``offered`` the digest that is held against the proof (default: ``leaf``).
    In a group leaves ascend by ``order``; runs of 8 become one node until one remains, the subroot; the subroots by group (null
    first, bytewise) likewise give the root. ``most_tops``: nodes that the driver builds the upper tree from, and broadcasts;
    more of them are reduced by another round on the executors, in blocks of 8 ** ``levels``.
    Defined cases: null columns have a digest of their own; null ids come first; rows that repeat an id are ordered by their
    leaves, rows that agree in all are leaves one by one; one row alone is leaf, subroot and root, with an empty proof;
    an empty table gives no rows; columns that ``leaf`` and ``offered`` do not name are not read. More than ``most_groups`` groups
    are refused: the upper tree holds a subroot of each.
    """
    spark = rows.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`")), F.lit(NULL_GROUP))
    leaves = rows.select(key.alias("g"), F.col(f"`{order}`").alias("id"), leaf.alias("leaf"), (leaf if offered is None else offered).alias("offered"))
    nodes = saved(placed(leaves).withColumnRenamed("leaf", "top"), "placed")
    rounds, tops, block = [nodes], nodes, F.expr(f"at div {ARITY**levels}")
    while True:
        tops = saved(tops.withColumn("b", block).select("b", "g", "at", "n", "top").groupBy("g", "b").applyInArrow(_tops(levels), PLACED), "tops")
        held, groups, higher = tops.agg(F.count("*"), F.count(F.when(F.col("at") == 0, 1)), F.coalesce(F.max("n"), F.lit(0))).first()
        if groups > most_groups:
            raise ValueError(f"{groups} groups; a manifest has {most_groups} at most")
        if held <= max(most_tops, groups) or higher <= 1:
            break
        rounds.append(tops)
    tree = spark.sparkContext.broadcast(UpperTree([(r["g"], r["at"], r["top"]) for r in tops.toLocalIterator()]) if held else None)

    def under_tree(f, *more):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            return f(table, tree.value.path(table.column("g")[0].as_py(), key[1].as_py()), *more)

        return run

    def under_paths(f, *more):
        def run(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
            r = above.to_pylist()[0]
            return f(table, ([(x["before"], x["after"]) for x in r["path"]], r["subroot"], r["root"]), *more)

        return run

    id_type = rows.schema[order].dataType.simpleString()
    out_type = f"g string, id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + ", proof array<struct<before:binary,after:binary>>" * proofs
    above = None
    for depth in range(len(rounds) - 1, -1, -1):
        f, schema, more = (_paths, PATHS, (levels,)) if depth else (_proofs, out_type, (levels, proofs))
        blocks = rounds[depth].withColumn("b", block).groupBy("g", "b")
        if above is None:
            above = blocks.applyInArrow(under_tree(f, *more), schema)
        else:
            above = blocks.cogroup(saved(above, "paths").withColumn("b", F.col("at")).groupBy("g", "b")).applyInArrow(under_paths(f, *more), schema)
    named = F.when(F.col("g") != NULL_GROUP, F.expr("substr(g, 2)"))
    return above.select(named.alias(group), F.col("id").alias(order), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *["proof"] * proofs)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof of ``manifest`` lead to, as an expression: for whoever checks a row later on."""
    return F.aggregate(proof, leaf, lambda node, x: F.sha2(F.concat(x["before"], node.cast("binary"), x["after"]), 256))


def document_leaf(text: Column | None = None) -> Column:
    return leaf_of(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), F.col("text") if text is None else text)


def tampered_leaf() -> Column:
    """The leaf with A-Z of the text in lower case, where 3 divides the checksum of the id."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return document_leaf(F.when(F.coalesce(chosen, F.lit(False)), F.translate("text", UPPER, LOWER)).otherwise(F.col("text")))


def _oracle(levels: int = 7, top_levels: int = 3) -> str:
    """Level by level: per group up to 8 ** ``levels`` leaves, up to 8 ** ``top_levels`` groups. A level of one node passes it on."""
    enc = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    table = "[" + ", ".join(f"list_reduce([{i}, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)" for i in range(256)) + "]"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)"
    parts = [
        f"k AS (SELECT {table} AS t)",
        f"x AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, {leaf('text')} AS leaf, {leaf('''(CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END)''')} AS offered FROM (SELECT *, {crc} AS crc FROM documents, k))",
        "l0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS d FROM x)",
    ]
    run = "list(d ORDER BY pos)"
    for i in range(levels):
        parts.append(f"r{i} AS (SELECT g, pos // 8 AS q, {run} AS run, count(*) OVER (PARTITION BY g) > 1 OR len({run}) > 1 AS up FROM {f'n{i}' if i else 'l0'} GROUP BY g, pos // 8)")
        parts.append(f"n{i + 1} AS (SELECT g, q AS pos, CASE WHEN up THEN sha256(array_to_string(run, '')) ELSE run[1] END AS d FROM r{i})")
    parts.append(f"s0 AS (SELECT g, d, row_number() OVER (ORDER BY encode(g)) - 1 AS pos FROM n{levels})")
    for i in range(top_levels):
        parts.append(f"t{i} AS (SELECT pos // 8 AS q, {run} AS run, count(*) OVER () > 1 OR len({run}) > 1 AS up FROM s{i} GROUP BY pos // 8)")
        parts.append(f"s{i + 1} AS (SELECT q AS pos, CASE WHEN up THEN sha256(array_to_string(run, '')) ELSE run[1] END AS d FROM t{i})")
    step = "CASE WHEN r.up THEN f.proof || array_to_string(r.run[1:p], '') || array_to_string(r.run[p + 2:], '') ELSE f.proof END AS proof, CASE WHEN r.up THEN sha256(array_to_string(r.run[1:p], '') || f.node || array_to_string(r.run[p + 2:], '')) ELSE f.node END AS node"
    parts.append("f0 AS (SELECT doc_id, g, leaf, pos, '' AS proof, offered AS node FROM l0)")
    for i in range(levels):
        parts.append(f"f{i + 1} AS (SELECT f.doc_id, f.g, f.leaf, f.pos // 8 AS pos, {step.replace('p]', '(f.pos % 8)]').replace('p + 2', '(f.pos % 8) + 2')} FROM f{i} f JOIN r{i} r ON f.g = r.g AND f.pos // 8 = r.q)")
    parts.append(f"h0 AS (SELECT f.doc_id, f.g, f.leaf, s.d AS subroot, s.pos, f.proof, f.node FROM f{levels} f JOIN s0 s ON f.g = s.g)")
    for i in range(top_levels):
        parts.append(f"h{i + 1} AS (SELECT f.doc_id, f.g, f.leaf, f.subroot, f.pos // 8 AS pos, {step.replace('p]', '(f.pos % 8)]').replace('p + 2', '(f.pos % 8) + 2')} FROM h{i} f JOIN t{i} r ON f.pos // 8 = r.q)")
    return "WITH " + ",\n".join(parts) + f"\nSELECT h.doc_id, h.leaf, h.subroot, s.d AS root, sha256(h.proof) AS proof_sha256, h.node AS folded_root, h.node = s.d AS verified FROM h{top_levels} h, s{top_levels} s"


ORACLE = _oracle()
