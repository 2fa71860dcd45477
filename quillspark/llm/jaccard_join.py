"""N-gram Jaccard self-join by T-occurrence search (DivideSkip), exact at any threshold.

A document that links with ``x`` must share at least ``T = ceil(t * |x|)`` of x's shingles, so it stands in T of x's
inverted lists. DivideSkip sets the ``L`` longest lists aside, merges the short ones, keeps the documents that stand in
at least ``T - L`` of those, and probes the long lists for them by binary search. Here this is done twice:

* *over the corpus*, to find which sets can link at all. A sketch of fixed size counts all shingles, and one order - rare
  before common - holds everywhere. Each set sends only its short lists, the first ``|x| - T + l`` shingles of that order
  with ``l = T - L = min(T, 8 + T / 8)``, to the owners of their ranges, which return those that two sets hold. A set with fewer
  than ``l`` of them ends there. Two linked sets share ``l`` of them, so if those are dealt into fewer than ``l`` buckets, two
  fall into one bucket: sets meet on such pairs of shingles, each list of sets is tied to its smallest one, and the connected
  *groups* hold every link. Lists are never unfolded into pairs of sets.
* *inside each group*, where every set is sent once: the group's inverted lists are merged run by run and probed per set, occurrences
  are counted up to T, and links, classes and numbers of links come out of one search. A group beyond a chunk's size is first
  narrowed: its sets meet again by size - one of ``n`` shingles and one of ``m`` must share ``t / (1 + t) * (n + m)``, so one of the first
  ``n - that + 1`` - which parts sets that share long passages without being similar. What is still larger is cut
  into chunks by a hash, and each two chunks are searched, so no group is a single task's.

Equal sets are one node from the start. Shingles that more than ``nodes_per_slice`` texts hold count as shared without being
gathered: they are dealt out by (shingle, node), so no owner ever gets a list longer than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, ODD, Filter, bounded_filter, mix, saved, shingle_sets, small_batches, string_blocks, word_hashes

SKETCH_BITS, PIECE = 20, 1 << 16  # counters of the sketch; so many a row of it
LOW = 39  # bits of a shingle that travel; the range's number adds the rest
HOT = 128  # marks a level of the sketch whose shingles are too common to be gathered


def _node(s: np.ndarray) -> int:
    """A 64-bit name of a set of shingles."""
    with np.errstate(over="ignore"):
        return int((mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mix(s).sum(dtype=np.uint64)).astype(np.int64)) if len(s) else 0


def _sets(batch: pa.RecordBatch, k: int, size: int = BLOCK_BYTES) -> Iterator[tuple[int, list[np.ndarray]]]:
    for at, _, data, off in string_blocks(batch.column(batch.num_columns - 1), size):
        yield at, shingle_sets(*word_hashes(data, off), k)


def _once(batches: Iterator[pa.RecordBatch], k: int, most: int = 500_000) -> Iterator[dict[int, np.ndarray]]:
    """A task's different sets by name, about ``most`` shingles at a time."""
    sent: set[int] = set()
    held: dict[int, np.ndarray] = {}
    size = 0
    for batch in batches:
        for _, sets in _sets(batch, k):
            for s in sets:
                if len(s) and (name := _node(s)) not in sent:
                    sent.add(name)
                    held[name] = s
                    size += len(s)
            if size >= most:
                yield held
                held, size = {}, 0
    if held:
        yield held


def _named(k: int):
    """Rows (id, n, node) of all texts, then the task's sketch in pieces (piece, counts): shingles of its different sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sent, sketch, ids = ["id", "n", "node", "piece", "counts"], set(), np.zeros(1 << SKETCH_BITS, np.int64), None
        for batch in batches:
            n, node, ids = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), batch.schema.field(0).type
            for at, sets in _sets(batch, k):
                new = []
                for i, s in enumerate(sets, at):
                    n[i], node[i] = len(s), _node(s)
                    if len(s) and node[i] not in sent:
                        sent.add(node[i])
                        new.append(s)
                if new:
                    sketch += np.bincount((np.concatenate(new) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(node), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        pieces = [(i, x) for i, x in enumerate(sketch.reshape(-1, PIECE)) if x.any()]
        if pieces:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(pieces), ids), *[pa.nulls(len(pieces), pa.int64())] * 2, pa.array([i for i, _ in pieces], pa.int32()), pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for _, x in pieces], pa.binary())], names)

    return run


def _levels(limit: int):
    """Of one piece of the sketch: how many binary digits each counter has, marked where it exceeds ``limit``."""

    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.uint32).astype(np.float64) for x in table.column("counts").to_pylist())
        level = np.frexp(total)[1].astype(np.uint8) | np.where(total > limit, HOT, 0).astype(np.uint8)
        return pa.table({"piece": table.column("piece")[:1], "level": pa.array([level.tobytes()], pa.binary())})

    return run


def required(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """T: how many of its n shingles a set shares with any set it links with."""
    return -(-num * n // den)


def merged(t: np.ndarray) -> np.ndarray:
    """l = T - L: in how many short lists a candidate stands. It grows by at most 1 where T grows by 1, so the first l
    shared shingles of two linked sets are in the short lists of both, with the l of either."""
    return np.minimum(t, 8 + t // 8)


def _cut(key: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin and, last, end."""
    return np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)] if len(key) else np.zeros(1, np.int64)


def _short_lists(k: int, ranges: int, levels: np.ndarray, num: int, den: int, entries_at_once: int = 8_000_000):
    """Rows (cell, low, high, nodes, heads, sizes): entries of short lists by range of shingle, and sets with their sizes by home.

    An entry takes 13 bytes; a task gathers ``entries_at_once`` (about all of an input split of 128 MB) before it packs them.
    """
    wide = np.uint64((1 << 64) // ranges + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        size = 0
        for held in _once(batches, k):
            names, sets = np.array(list(held), np.int64), list(held.values())
            n = np.array([len(s) for s in sets], np.int64)
            need = required(n, num, den)
            token, owner = np.concatenate(sets), np.repeat(np.arange(len(n)), n)
            level = levels[(token >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            order = np.argsort(owner << 8 | level, kind="stable")  # within a level by hash, as sets are sorted
            place = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
            order = order[place < np.repeat(n - need + merged(need), n)]
            token, owner, hot = token[order], names[owner[order]], level[order] >= HOT
            with np.errstate(over="ignore"):
                cell = np.where(hot, mix(token ^ mix(owner.view(np.uint64))) % np.uint64(ranges), token // wide).astype(np.int32)
            low, high = (token & np.uint64(0xFFFFFFFF)).astype(np.uint32), ((token >> np.uint64(32)) & np.uint64(0x7F)).astype(np.uint8) | np.where(hot, HOT, 0).astype(np.uint8)
            home = (mix(names.view(np.uint64)) % np.uint64(ranges)).astype(np.int32)
            parts.append((cell, low, high, owner, home, names, n))
            size += len(cell)
            if size >= entries_at_once:
                yield from _by_cell(parts)
                parts, size = [], 0
        if parts:
            yield from _by_cell(parts)

    return run


def _by_cell(parts: list[tuple], batch_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Entries of many sets, packed a row a cell: the more sets at once, the less the rows themselves weigh."""
    cell, low, high, owner, home, heads, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(cell, kind="stable")
    cell, low, high, owner = cell[order], low[order], high[order], owner[order]
    order = np.argsort(home, kind="stable")
    home, heads, sizes = home[order], heads[order], sizes[order]
    every = np.union1d(cell, home)
    a, b, c, d = (np.searchsorted(x, every, side) for x in (cell, home) for side in ("left", "right"))
    rows = max(1, min(10_000, len(every) * batch_bytes // (13 * len(cell) + 16 * len(home))))
    for at in range(0, len(every), rows):
        some = range(at, min(at + rows, len(every)))
        of = lambda x, lo, hi: pa.array([x[lo[i] : hi[i]].tobytes() for i in some], pa.binary())  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([pa.array(every[at : at + rows].astype(np.int32)), of(low, a, b), of(high, a, b), of(owner, a, b), of(heads, c, d), of(sizes, c, d)], ["cell", "low", "high", "nodes", "heads", "sizes"])


def _glued(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table.column(column).to_pylist() if x), kind)


def _shared(ranges: int):
    """Of one cell: (to, tokens, nodes, heads, sizes): the entries whose shingle another set holds too, by home of the set."""

    def run(table: pa.Table) -> pa.Table:
        cell = table.column("cell")[0].as_py()
        node, high = _glued(table, "nodes", np.int64), _glued(table, "high", np.uint8)
        token, hot = _glued(table, "low", np.uint32).astype(np.uint64) | (high & np.uint8(HOT - 1)).astype(np.uint64) << np.uint64(32), high >= HOT
        token |= np.where(hot, np.uint64(ranges), np.uint64(cell)) << np.uint64(LOW)
        order = np.lexsort((node, token))
        token, node, hot = token[order], node[order], hot[order]
        fresh = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])] if len(token) else np.zeros(0, bool)
        token, node, hot = token[fresh], node[fresh], hot[fresh]  # several tasks may send one set
        size = np.diff(_cut(token))
        several = hot | (np.repeat(size, size) > 1)
        token, node = token[several], node[several]
        to = (mix(node.view(np.uint64)) % np.uint64(ranges)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        token, node, to = token[order], node[order], to[order]
        at = _cut(to)
        homes = [*to[at[:-1]].tolist(), cell]
        of = lambda x: pa.array([*(x[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)), b""], pa.binary())
        last = lambda c: pa.array([b""] * (len(homes) - 1) + [b"".join(x for x in table.column(c).to_pylist() if x)], pa.binary())
        return pa.table({"to": pa.array(homes, pa.int32()), "tokens": of(token), "nodes": of(node), "heads": last("heads"), "sizes": last("sizes")})

    return run


def steps(x: np.ndarray) -> np.ndarray:
    """The largest of 0, 1, 2, 3, 4, 6, 8, 12, 16, ... that is not above x."""
    p = 1 << (np.frexp(np.maximum(x, 1))[1] - 1).astype(np.int64)
    return np.where(x < 1, 0, np.where((p > 1) & (2 * x >= 3 * p), p + p // 2, p))


def _meetings(num: int, den: int):
    """Of one home: (meet, node): where the sets with enough shared shingles meet others.

    Two sets that link share at least the smaller l of the two. Dealt into ``steps(l - 1)`` buckets, two of these shingles share a
    bucket, and both sets name that pair of shingles (where l is 1, that shingle). A set knows which l its partners may have.
    """

    def run(table: pa.Table) -> pa.Table:
        heads, sizes = _glued(table, "heads", np.int64), _glued(table, "sizes", np.int64)
        names, first = np.unique(heads, return_index=True)
        need = required(sizes[first], num, den)
        token, node = _glued(table, "tokens", np.uint64), _glued(table, "nodes", np.int64)
        order = np.lexsort((token, node))
        token, node = token[order], node[order]
        fresh = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])] if len(token) else np.zeros(0, bool)
        token, owner = token[fresh], np.searchsorted(names, node[fresh])
        own, least = merged(need), merged(required(need, num, den))  # no partner has fewer than ``need`` shingles
        live = np.bincount(owner, minlength=len(names)) >= own
        token, owner = token[live[owner]], owner[live[owner]]
        top, low = steps(own - 1)[owner], steps(least - 1)[owner]
        meet, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for step in np.unique(np.r_[top, low, steps(np.arange(1, 1 + int(top.max(initial=0))))]).tolist():
            some = (low <= step) & (step <= top)
            t, o = token[some], owner[some]
            if not step:
                meet.append(mix(t))
                at.append(o)
                continue
            bucket = (mix(t ^ np.uint64(step)) % np.uint64(step)).astype(np.int64)
            order = np.lexsort((t, bucket, o))
            t, o, bucket = t[order], o[order], bucket[order]
            ahead = 1
            while len(t) > ahead:
                same = np.flatnonzero((o[ahead:] == o[:-ahead]) & (bucket[ahead:] == bucket[:-ahead]))
                if not len(same):
                    break
                with np.errstate(over="ignore"):
                    meet.append(mix(t[same] * np.uint64(ODD[0]) + t[same + ahead] * np.uint64(ODD[1]) + np.uint64(step)))
                at.append(o[same])
                ahead += 1
        return pa.table({"meet": pa.array(np.concatenate(meet).astype(np.int64)), "node": pa.array(names[np.concatenate(at)])})

    return run


def classes(edges: DataFrame) -> DataFrame | None:
    """(node, root) of the nodes of ``edges`` (a, b): the smallest node of each connected class, by label passing with jumps."""
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    if not both.head(1):
        return None
    inside = saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        jumped = inside.alias("x").join(inside.select(F.col("node").alias("via"), F.col("root").alias("far")), F.col("x.root") == F.col("via")).select("x.node", F.col("far").alias("root"))
        passed = both.join(jumped.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("other"))
        after = saved(jumped.join(passed, jumped["node"] == passed["a"]).select("node", F.least("root", "other").alias("root")), "labels")
        moved = after.join(inside.withColumnRenamed("root", "was"), "node").where("root <> was").head(1)
        inside = after
        if not moved:
            return inside


def _chosen(k: int, marks: Filter):
    """(node, n, tokens): the sets that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _once(batches, k):
            names, sets = np.array(list(held), np.int64), list(held.values())
            ok = marks.passes(names)
            sets = [sets[i] for i in np.flatnonzero(ok)]
            yield pa.RecordBatch.from_arrays([pa.array(names[ok]), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "n", "tokens"])

    return run


def divide_skip(a: tuple, b: tuple, num: int, den: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs (place in ``a``, place in ``b``) of two sides (sizes, all tokens, numbers of tokens), each by size.

    Per set of ``a``: its inverted lists over ``b``; the L longest are set aside (L = T / (log2 of the longest + 1), T - 1 at most), the others are
    merged; sets of a fitting size with T - L occurrences or more are looked up in the long lists by binary search, and those
    whose occurrences reach the overlap link. ``own``: both sides are one, and a pair is given once.
    """
    (na, ta, ca), (nb, tb, cb) = a, b
    words, code = np.unique(tb, return_inverse=True)
    owner = np.repeat(np.arange(len(nb)), cb)
    order = np.argsort(code, kind="stable")
    entry = code[order] * len(nb) + owner[order]  # all lists one after the other, each by place
    begin = np.searchsorted(code[order], np.arange(len(words) + 1))
    at = np.minimum(np.searchsorted(words, ta), len(words) - 1)
    at[words[at] != ta] = -1
    ends = np.cumsum(ca)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, n in enumerate(na.tolist()):
        lo, hi = np.searchsorted(nb * den, n * num, "left"), np.searchsorted(nb * num, n * den, "right")
        lists, t = at[ends[i] - ca[i] : ends[i]], -(-num * n // den)
        lists = lists[lists >= 0]
        lo = max(lo, i + 1) if own else lo
        if lo >= hi or len(lists) < t:
            continue
        size = begin[lists + 1] - begin[lists]
        skip = min(t - 1, int(t / (np.log2(size.max()) + 1)))  # a candidate stands in a short list at least
        rank = np.argsort(size, kind="stable")
        short, long = rank[: len(rank) - skip], lists[rank[len(rank) - skip :]]
        size = size[short]
        spots = np.repeat(begin[lists[short]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        runs = np.sort(owner[order[spots]], kind="stable")  # lists are sorted, so a stable sort merges their runs
        cut = _cut(runs)
        found, times = runs[cut[:-1]], np.diff(cut)
        some = (times >= t - skip) & (found >= lo) & (found < hi)
        found, times = found[some], times[some]
        if not len(found):
            continue
        sought = long[:, None] * len(nb) + found
        hit = entry[np.minimum(np.searchsorted(entry, sought), len(entry) - 1)] == sought
        ok = (den + num) * (times + hit.sum(0)) >= num * (n + nb[found])
        left.append(np.full(int(ok.sum()), i))
        right.append(found[ok])
    return np.concatenate(left), np.concatenate(right)


def _united(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number of each of ``m`` places that is the same for connected ones."""
    label = np.arange(m)
    while True:
        low, after = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


LINKS = "node long, links long, others long, top long"


def _told(node: np.ndarray, rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Of each node: its links, the rows behind them, the smallest node connected with it."""
    m = len(node)
    links = np.bincount(a, minlength=m) + np.bincount(b, minlength=m)
    others = np.bincount(a, rows[b], m) + np.bincount(b, rows[a], m)
    label, top = _united(m, a, b), np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(top, label, node)
    return [node, links, others.astype(np.int64), top[label]]


def _linked(num: int, den: int):
    """Of whole groups: each node's links, the rows behind them and the smallest node of its class."""

    def run(table: pa.Table) -> pa.Table:
        root, node, n, rows = (table.column(c).to_numpy() for c in ("root", "node", "n", "rows"))
        held = table.column("tokens").to_pylist()
        order = np.lexsort((n, root))
        out: list[list[np.ndarray]] = [[] for _ in range(4)]
        for group in np.split(order, _cut(root[order])[1:-1]):
            side = n[group], np.frombuffer(b"".join(held[i] for i in group), np.int64), np.array([len(held[i]) // 8 for i in group])
            for x, y in zip(out, _told(node[group], rows[group], *divide_skip(side, side, num, den, True)), strict=True):
                x.append(y)
        return pa.table([pa.array(np.concatenate(x)) for x in out], ["node", "links", "others", "top"])

    return run


def _chunk(table: pa.Table) -> pa.Table:
    """One row of a chunk's sets, by size."""
    table = table.sort_by("n")
    held = table.column("tokens").to_pylist()
    of = lambda c: [table.column(c).to_numpy().tobytes()]
    return pa.table([table.column("root")[:1], table.column("chunk")[:1], table.column("chunks")[:1], *(pa.array(x, pa.binary()) for x in (of("node"), of("n"), of("rows"), [np.array([len(x) // 8 for x in held], np.int64).tobytes()], [b"".join(held)]))], ["root", "chunk", "chunks", "nodes", "sizes", "rows", "counts", "tokens"])


def _linked_between(num: int, den: int):
    """Of one chunk, or two of one group: what ``_linked`` gives, as far as these sets tell."""

    def run(table: pa.Table) -> pa.Table:
        if table.num_rows == 1 and table.column("lo")[0].as_py() != table.column("hi")[0].as_py():  # the other chunk is empty
            return pa.table([pa.array([], pa.int64())] * 4, ["node", "links", "others", "top"])
        side = lambda i: [np.frombuffer(table.column(c)[i].as_py(), np.int64) for c in ("nodes", "rows", "sizes", "tokens", "counts")]
        (node, rows, *one), (mate, mate_rows, *two) = side(0), side(table.num_rows - 1)
        a, b = divide_skip(tuple(one), tuple(two), num, den, table.num_rows == 1)
        if table.num_rows > 1:
            node, rows, b = np.r_[node, mate], np.r_[rows, mate_rows], b + len(node)
        return pa.table([pa.array(x) for x in _told(node, rows, a, b)], ["node", "links", "others", "top"])

    return run


BAND = 1.06  # sizes of sets that are looked at together differ by this factor at most


def band(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / np.log(BAND)).astype(np.int64)


def _met_by_size(levels: np.ndarray, num: int, den: int):
    """(meet, node, side): where a set of a group (root, node, n, tokens) may meet others of each fitting band of sizes; side is 0 for the
    band of smaller sets, 1 for that of larger ones, 2 where both are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root, node, size = (batch.column(c).to_numpy().astype(np.int64) for c in (0, 1, 2))
            meet, at, side = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int8)]
            for r, name, n, held in zip(root.tolist(), node.tolist(), size.tolist(), batch.column(3), strict=True):
                token = np.frombuffer(held.as_py(), np.uint64)
                token = token[np.argsort(levels[(token >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")]
                partners = np.arange(required(np.int64(n), num, den), n * den // num + 1)
                of = band(partners)
                first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                own = int(band(np.array([n]))[0])
                for b, least in zip(of[first].tolist(), partners[first].tolist(), strict=True):
                    some = token[: n + 1 - -(-num * (n + least) // (num + den))]
                    with np.errstate(over="ignore"):
                        pair = np.uint64(min(own, b) << 32 | max(own, b)) * np.uint64(ODD[1]) ^ np.int64(r).view(np.uint64) * np.uint64(ODD[2])
                    meet.append(mix(some ^ mix(np.array([pair]))).view(np.int64))
                    at.append(np.full(len(some), name))
                    side.append(np.full(len(some), 2 if own == b else own > b, np.int8))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (meet, at, side)], ["meet", "node", "side"])

    return run


def narrowed(groups: DataFrame, levels: np.ndarray, num: int, den: int) -> DataFrame | None:
    """(node, root): the parts of ``groups`` that links can lie in; sets that no other can link with are left out."""
    meetings = saved(groups.select("root", "node", "n", "tokens").mapInArrow(_met_by_size(levels, num, den), "meet long, node long, side byte"), "size-meetings")
    sides = (F.min("side") != F.max("side")) | (F.min("side") == 2)
    heads = meetings.groupBy("meet").agg(F.min("node").alias("head"), F.max("node").alias("last"), sides.alias("both")).where("both AND head <> last").select("meet", "head")
    return classes(meetings.join(heads, "meet").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct())


def search_groups(texts: DataFrame, sets: DataFrame, label: DataFrame, levels: np.ndarray, k: int, num: int, den: int, sets_per_chunk: int, tokens_per_chunk: int = 500_000, tokens_per_task: int = 3_000_000) -> DataFrame:
    """(node, links, others, root): of each node of ``label`` (node, root of its group) its links, their rows and its class."""
    spark = texts.sparkSession
    members = saved(label.join(sets, "node").select("node", "root", "rows", "n"), "groups")
    chunks = F.greatest(F.ceil(F.col("m") / sets_per_chunk), F.ceil(F.col("held") / tokens_per_chunk)).cast("int")
    sizes = saved(members.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("held")).select("root", "held", chunks.alias("chunks")), "group-sizes")
    most, total = sizes.agg(F.max("chunks"), F.coalesce(F.sum(F.when(F.col("chunks") == 1, F.col("held"))), F.lit(0))).first()
    chosen = texts.select("text").mapInArrow(_chosen(k, bounded_filter(label, "node")), "node long, n long, tokens binary")
    chosen = chosen.groupBy("node").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    own = saved(chosen.join(members.drop("n").join(sizes.drop("held"), "root"), "node"), "group-sets")
    if most > 1:
        large = own.where("chunks > 1")
        own, parts = own.where("chunks = 1"), narrowed(large, levels, num, den)
        if parts is not None:
            again = large.drop("root", "chunks").join(parts, "node")
            sizes = again.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("held")).select("root", chunks.alias("chunks"))
            own = saved(own.unionByName(again.join(sizes, "root")), "narrowed-sets")
        most, total = own.agg(F.coalesce(F.max("chunks"), F.lit(1)), F.coalesce(F.sum(F.when(F.col("chunks") == 1, F.col("n"))), F.lit(0))).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // tokens_per_task))
    small = own.where("chunks = 1").withColumn("task", F.pmod(F.xxhash64("root"), F.lit(tasks)))
    out = small.groupBy("task").applyInArrow(_linked(num, den), LINKS)
    if most > 1:
        large = own.where("chunks > 1").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
        packed = large.groupBy("root", "chunk").applyInArrow(_chunk, "root long, chunk int, chunks int, nodes binary, sizes binary, rows binary, counts binary, tokens binary")
        met = packed.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"lo": F.least("chunk", "mate"), "hi": F.greatest("chunk", "mate")})
        parts = saved(met.groupBy("root", "lo", "hi").applyInArrow(_linked_between(num, den), LINKS), "chunk-links")
        joined = classes(parts.where("node <> top").select(F.col("node").alias("a"), F.col("top").alias("b")))
        parts = parts.groupBy("node").agg(F.sum("links").alias("links"), F.sum("others").alias("others"), F.min("top").alias("top"))
        if joined is not None:
            parts = parts.join(joined, "node", "left").select("node", "links", "others", F.coalesce("root", "top").alias("top"))
        out = out.unionByName(parts)
    return out.withColumnRenamed("top", "root")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, shingles_per_range: int = 3_000_000, nodes_per_slice: int = 1_000_000, count_links: bool = True, sets_per_chunk: int = 1000) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id reachable by links), n_links, n_linked_rows.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z as a-z; a set holds the distinct ``k``-word shingles of the whole text, or
    the whole sequence as one if it has fewer words. Two rows link when den * |intersection| >= num * |union|. n_links is
    the number of different sets that link with the row's, n_linked_rows that of other rows (those of the same set too);
    both are exact. ``count_links=False`` leaves the two out, for callers that read classes only.
    ``shingles_per_range``: entries of short lists that one owner gathers, about; ``nodes_per_slice``: texts beyond which a shingle
    is too common to be gathered; ``sets_per_chunk``: sets of a group that one task compares with as many others.
    Defined cases: null, empty and blank texts have the empty set and link with nothing; null ids are ranked last and
    never name a class that has another id; repeated rows have equal sets and link; an empty table gives no rows; other
    columns of the input are not read.
    """
    spark = docs.sparkSession
    texts = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = saved(texts.mapInArrow(_named(k), f"id {docs.schema[id_col].dataType.simpleString()}, n long, node long, piece int, counts binary"), "members")
    members = rows.where("piece IS NULL").select("id", "n", "node")
    sets = members.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.min("id").alias("least"), F.count("*").alias("rows"))
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in rows.where("piece IS NOT NULL").select("piece", "counts").groupBy("piece").applyInArrow(_levels(nodes_per_slice), "piece int, level binary").toLocalIterator():
        levels[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(r["level"], np.uint8)
    need = F.ceil(F.lit(num) * F.col("n") / F.lit(den))
    entries = members.agg(F.coalesce(F.sum(F.col("n") - need + F.least(need, 8 + need / 8)), F.lit(0)).cast("long")).first()[0]
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // shingles_per_range))

    short = texts.select("text").mapInArrow(_short_lists(k, ranges, levels, num, den), "cell int, low binary, high binary, nodes binary, heads binary, sizes binary")
    shared = short.groupBy("cell").applyInArrow(_shared(ranges), "to int, tokens binary, nodes binary, heads binary, sizes binary")
    meetings = saved(shared.groupBy("to").applyInArrow(_meetings(num, den), "meet long, node long"), "meetings")
    heads = meetings.groupBy("meet").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last").select("meet", "head")
    label = classes(meetings.join(heads, "meet").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct())

    counts = ["n_links", "n_linked_rows"] if count_links else []
    if label is None:
        table = sets.select("node", F.col("least").alias("component_id"), F.lit(0).cast("long").alias("n_links"), (F.col("rows") - 1).alias("n_linked_rows"))
    else:
        found = saved(search_groups(texts, sets, label, levels, k, num, den, sets_per_chunk), "links-of-sets")
        named = found.join(sets, "node").groupBy("root").agg(F.min("least").alias("named"))
        table = sets.join(found.join(named, "root"), "node", "left").select("node", F.coalesce("named", "least").alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"), (F.coalesce("others", F.lit(0)) + F.col("rows") - 1).alias("n_linked_rows"))
    out = members.where("n > 0").join(table, "node").select("id", "n", "component_id", *counts)
    blank = members.where("n = 0").select("id", "n", F.col("id").alias("component_id"), *(F.lit(0).cast("long").alias(c) for c in counts))
    return out.unionByName(blank).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", *counts)
