"""N-gram Jaccard join with signature trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .components import components
from .shared import staged

#: Similarity as a fraction of whole numbers: shared / union >= NUM / DEN.
NUM, DEN = 3, 4
#: Documents of one group that a task takes at once; larger groups are dealt into pairs of blocks.
GROUP_DOCS = 4096
#: Documents, and tokens of their sets, of one block in which a component's links are counted.
LINK_DOCS, LINK_TOKENS = 1024, 1_000_000
#: Ranges of the hash space that give larger sets their keys; sets from SMALL tokens on use them.
BINS, SMALL = 24, 48
#: Entries of a tree node.
FAN = 16
#: Node pairs of a tree traversal that are opened at once (each gives FAN x FAN pairs at most), and candidates that a group holds before they are thinned.
SLAB, HELD = 1024, 1 << 17
#: Bits of the table of ids that take part in a verification.
FLAG_BITS = 1 << 23


# -- signatures ---------------------------------------------------------------------------------------------------


def prefix_size(n: int) -> int:
    """Of two sets that reach the similarity, the first so many tokens (in any common order) share one."""
    return n - (-(-n * NUM // DEN)) + 1 if n else 0


def meeting_keys(s: np.ndarray) -> np.ndarray:
    """Tokens under which two sets that link meet.

    Small sets use the first prefix_size tokens, which cannot miss. Larger ones use the smallest token of each of
    BINS ranges of the hash space: each agrees with the odds of the similarity, so a link at the very threshold has
    no meeting with odds of (1/4)^BINS, 1e-14. Sizes between belong to both, since partners differ by at most 4/3.
    """
    keys = []
    if len(s) < 2 * SMALL:
        keys.append(s[: prefix_size(len(s))])
    if len(s) >= SMALL:
        bins = (s >> np.uint64(40)) % np.uint64(BINS)  # of bits that do not decide the order
        order = np.argsort(bins, kind="stable")
        keys.append(s[order[np.flatnonzero(np.r_[True, np.diff(bins[order].astype("i8")) != 0])]])
    return np.unique(np.concatenate(keys)) if len(keys) > 1 else keys[0]


def bitmap(s: np.ndarray) -> np.ndarray:
    """A power of two of at least 8 bits a token (64 at least), one set for each token by its low bits."""
    bits = max(64, 1 << (8 * len(s) - 1).bit_length()) if len(s) else 64
    out = np.zeros(bits, "u1")
    out[(s & np.uint64(bits - 1)).astype("i8")] = 1
    return np.packbits(out, bitorder="little").view("u8")


def fold(bm: np.ndarray, width: int) -> np.ndarray:
    while bm.shape[-1] > width:
        half = bm.shape[-1] // 2
        bm = bm[..., :half] | bm[..., half:]
    return bm


def _count(bm: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bm).sum(-1, dtype="i8")


class Tree:
    """Levels of nodes over documents: each node holds the OR of its entries' bitmaps, its size range and the most
    tokens by which an entry outnumbers its own bits. Level 0 are the documents themselves."""

    def __init__(self, n: np.ndarray, maps: list[np.ndarray], width: int):
        bm = np.stack([fold(m, width) for m in maps])
        self.order = np.lexsort((bm[:, 0], n // 8))  # sizes alike first, then alike bits
        bm, n = bm[self.order], n[self.order]
        self.levels = [(bm, n, n, n - _count(bm))]
        while len(self.levels[-1][1]) > FAN:
            bm, lo, hi, over = self.levels[-1]
            cut = np.arange(0, len(lo), FAN)
            self.levels.append((np.bitwise_or.reduceat(bm, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(over, cut)))


def hopeful(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which node pairs remain, and of those the greatest possible overlap as a share of both sizes: pairs whose greatest possible overlap reaches NUM/DEN: a + b <= overlap * (NUM + DEN) / NUM for some sizes in range."""
    width = x[0].shape[1]
    lo_x, lo_y, hi_x, hi_y = x[1][i], y[1][j], x[2][i], y[2][j]
    ok = (hi_x * DEN >= lo_y * NUM) & (hi_y * DEN >= lo_x * NUM)
    most = np.zeros(0)
    if ok.any():
        i, j = i[ok], j[ok]
        same = np.empty(len(i), "i8")
        step = max(1, (1 << 19) // width)
        a, b = x[0], y[0]
        for s in range(0, len(i), step):
            same[s : s + step] = _count(a[i[s : s + step]] & b[j[s : s + step]])
        most = np.minimum(same + np.minimum(x[3][i], y[3][j]), np.minimum(hi_x[ok], hi_y[ok]))
        # shared * DEN >= (a + b - shared) * NUM, least for the smallest sizes
        both = lo_x[ok] + lo_y[ok]
        keep = most * (NUM + DEN) >= both * NUM
        most = most[keep] / both[keep]
        ok[ok] = keep
    return ok, most


def dual(x: Tree, y: Tree | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document pairs that no node pair above them rules out, with their greatest possible overlap; of one tree with itself if y is None.

    Depth first, a slab of node pairs at a time: a level is never held whole, as few bits in common rule little out.
    """
    own = y is None
    y = x if own else y
    i, j = (z.ravel().astype("i8") for z in np.meshgrid(np.arange(len(x.levels[-1][1])), np.arange(len(y.levels[-1][1])), indexing="ij"))
    open_ = [(len(x.levels) - 1, len(y.levels) - 1, i, j)]
    while open_:
        top_x, top_y, i, j = open_.pop()
        if own:
            keep = i <= j if top_x or top_y else i < j
            i, j = i[keep], j[keep]
        keep, most = hopeful(x.levels[top_x], i, y.levels[top_y], j)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if not top_x and not top_y:
            yield x.order[i], y.order[j], most
            continue
        if len(i) > SLAB:
            cuts = range(0, len(i), SLAB)
            open_ += [(top_x, top_y, i[c : c + SLAB], j[c : c + SLAB]) for c in reversed(cuts)]
            continue
        if top_x >= top_y:
            top_x -= 1
            i, j = _children(i, j, len(x.levels[top_x][1]))
        if top_y > top_x or (own and top_y):
            top_y -= 1
            j, i = _children(j, i, len(y.levels[top_y][1]))
        open_.append((top_x, top_y, i, j))


def _children(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    c = (i[:, None] * FAN + np.arange(FAN)).ravel()
    j = np.repeat(j, FAN)
    return c[c < n], j[c < n]


#: Further orders of the tokens besides that of the hashes themselves.
ORDERS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F), np.uint64(0x2545F4914F6CDD1D))

def similar_parts(n: np.ndarray, maps: list[np.ndarray], left: np.ndarray | None = None, right: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs that trees do not rule out, within all documents or between left and right (positions), a slab at a time.

    One tree a size class, as wide as its smallest bitmap; classes are a little wider than the similarity, so only
    a class and its neighbours meet. Neighbours meet at the width of the narrower one.
    """
    kind = (np.log(np.maximum(n, 1)) / np.log(DEN / NUM + 1e-4)).astype("i8")
    own = left is None
    sides = [np.arange(len(n))] if own else [left, right]
    parts = [{c: side[kind[side] == c] for c in np.unique(kind[side])} for side in sides]
    width = {c: min(len(maps[i]) for p in parts for i in p.get(c, ())) for p in parts for c in p}
    trees: dict[tuple, Tree] = {}

    def tree(side: int, c: int, w: int) -> Tree:
        if (side, c, w) not in trees:
            at = parts[side][c]
            trees[side, c, w] = Tree(n[at], [maps[i] for i in at], w)
        return trees[side, c, w]

    for c, at in parts[0].items():
        for d in (c, c + 1) if own else (c - 1, c, c + 1):
            there = parts[-1].get(d)
            if there is None or (own and c == d and len(at) < 2):
                continue
            w = min(width[c], width[d])
            for a, b, most in dual(tree(0, c, w), None if own and c == d else tree(len(parts) - 1, d, w)):
                yield at[a], there[b], most


def similar(n: np.ndarray, maps: list[np.ndarray], left: np.ndarray | None = None, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of similar_parts() whole; for blocks of bounded size."""
    out = list(similar_parts(n, maps, left, right))
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, "f8" if k == 2 else "i8") for k in range(3))


# -- distributed steps ----------------------------------------------------------------------------------------------

SIGNED = "id long, n long, k1 long, k2 long, low array<long>, keys array<long>, bits binary"


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytescan.claim("jaccard")
        for b in batches:
            for part in bytescan.slices(b, 1):
                sets = bytescan.shingle_sets(part.column(1), width)
                full = [s if len(s) else np.zeros(1, "u8") for s in sets]
                mixed = [[s, *(bytescan.mix(s ^ c) for c in ORDERS)] for s in full]
                pre = [meeting_keys(s) for s in sets]
                low = np.array([[m.min() for m in ms] for ms in mixed]).ravel().view("i8")
                flat = np.concatenate(pre).view("i8")
                off = np.r_[0, np.cumsum([len(p) for p in pre])].astype("i4")
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(np.array([s.sum(dtype="u8") for s in full]).view("i8")),
                        pa.array(np.array([m[1].sum(dtype="u8") for m in mixed]).view("i8")),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype="i4") * (1 + len(ORDERS))), pa.array(low)),
                        pa.ListArray.from_arrays(pa.array(off), pa.array(flat)),
                        pa.array([bitmap(s).tobytes() for s in sets], pa.binary()),
                    ],
                    names=["id", "n", "k1", "k2", "low", "keys", "bits"],
                )

    return run


def _pack(s: np.ndarray) -> bytes:
    """The upper 40 bits of each hash."""
    return s.view("u1").reshape(-1, 8)[:, 3:].tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), "u1")
    out[:, 3:] = np.frombuffer(b, "u1").reshape(-1, 5)
    return out.view("u8").ravel()


def _sets(flags: bytes, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(np.frombuffer(flags, "u1"), bitorder="little")
        for b in batches:
            at = b.column(2).to_numpy(zero_copy_only=False)
            b = b.take(pa.array(np.flatnonzero(table[at])))
            for part in bytescan.slices(b, 1):
                sets = bytescan.shingle_sets(part.column(1), width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_pack(s) for s in sets], pa.binary())], names=["id", "tokens"])

    return run


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column(2), b.column(3)):
            x, y = _unpack(x.as_py()), _unpack(y.as_py())
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both * DEN >= (len(x) + len(y) - both) * NUM)
        yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        bytescan.trim()


def verified(pairs: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The pairs(a, b) whose shingle sets reach the similarity, counted from the whole texts of docs(id, text).

    A table of FLAG_BITS bits (1 MB whatever the input) lets only texts that may occur in a pair be cut into
    shingles again and shuffled. Token hashes travel with 40 bits: within one pair, two unlike tokens agree with
    odds of about 1e-8.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(FLAG_BITS)).cast("long")
    pairs = staged(pairs, "pairs")
    marks = pairs.select(spot("a").alias("h")).union(pairs.select(spot("b"))).groupBy(F.bitmap_bucket_number(F.col("h") + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("h") + 1)).alias("m"))
    flags = bytearray(FLAG_BITS // 8)
    for k, m in marks.collect():
        flags[(k - 1) * 4096 : k * 4096] = bytes(m)
    sets = docs.select("id", "text", spot("id").alias("h")).mapInArrow(_sets(bytes(flags), width), "id long, tokens binary")
    got = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
    return staged(got.select("a", "b", "x", "y").mapInArrow(_linked, "a long, b long"), "links")


def _groups(key: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows come sorted by key; whole groups at a time, several to a table."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        cut = len(b)
        last = [b.column(k)[len(b) - 1] for k in key]
        same = np.ones(len(b), bool)
        for k, v in zip(key, last):
            same &= b.column(k).to_numpy(zero_copy_only=False) == v.as_py()
        cut = len(b) - int(same[::-1].argmin() if not same.all() else len(b))
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        elif held and any(held[-1].column(k)[len(held[-1]) - 1].as_py() != v.as_py() for k, v in zip(key, last)):
            yield pa.Table.from_batches(held)
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (token, id) sorted by token: rows of tokens that two rows or more hold; for a token beyond GROUP_DOCS rows one row without id."""
    token, ids, count = None, [], 0

    def out(t: np.ndarray, i: np.ndarray, big: bool = False) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.nulls(len(t), pa.int64()) if big else pa.array(i, pa.int64())], names=["token", "id"])

    def close() -> Iterator[pa.RecordBatch]:
        if count > GROUP_DOCS:
            yield out(np.array([token]), np.array([0]), True)
        elif count > 1:
            i = np.concatenate(ids)
            yield out(np.full(len(i), token), i)

    for b in batches:
        t, i = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(t):
            continue
        at = np.r_[0, np.flatnonzero(t[1:] != t[:-1]) + 1, len(t)]
        size = np.diff(at)
        if token is not None and t[0] != token:
            yield from close()
            token, ids, count = None, [], 0
        if len(size) > 1:
            if token is not None:  # the first group here ends what was held
                ids, count = [*ids, i[: at[1]]] if count <= GROUP_DOCS else [], count + int(size[0])
            else:
                token, ids, count = t[0], [i[: at[1]]], int(size[0])
            yield from close()
            whole = size.copy()
            whole[0] = whole[-1] = 0
            big = np.flatnonzero(whole > GROUP_DOCS)
            if len(big):
                yield out(t[at[big]], t[at[big]], True)
                whole[big] = 0
            keep = np.repeat(whole > 1, size)
            if keep.any():
                yield out(t[keep], i[keep])
            token, ids, count = t[-1], [i[at[-2] :]], int(size[-1])
        elif token is None:
            token, ids, count = t[0], [i], len(i)
        else:
            count += len(i)
            ids = [*ids, i] if count <= GROUP_DOCS else []
    if token is not None:
        yield from close()
    bytescan.trim()


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of the pairs (a, b), earlier ones preferred, that connect all that the pairs connect, and no circle: each tree takes its first pair that leads out, until none does."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root, left, kept = np.arange(len(names)), np.arange(len(a)), [np.zeros(0, "i8")]
    while True:
        left = left[root[x[left]] != root[y[left]]]
        if not len(left):
            return np.sort(np.concatenate(kept))
        first = np.full((2, len(names)), len(a))
        for f, z in zip(first, (x, y)):
            f[root[z[left[::-1]]]] = left[::-1]  # the last to be written is the first pair
        first = first.min(0)
        tree = np.flatnonzero(first < len(a))
        pick, up = first[tree], np.arange(len(names))
        to = root[x[pick]] + root[y[pick]] - tree
        up[tree] = to
        both = (up[to] == tree) & (tree < to)  # two trees that take the same pair
        up[tree[both]] = tree[both]
        kept.append(np.unique(pick))
        while (up[up] != up).any():
            up = up[up]
        root = up[root]


def thinned(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], comp: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of slabs of pairs of positions with their hope, those of different comp: a forest over `of`, the most hopeful first.

    The forest of what is kept so far and of what comes next is the forest of all, so no more than HELD pairs, a slab's and the forest are held.
    """
    held = [(np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))]
    more = True
    while more:
        part = next(parts, None)
        more = part is not None
        if more:
            a, b, most = part
            keep = np.flatnonzero(comp[a] != comp[b])
            held.append((a[keep], b[keep], most[keep]))
        if not more or sum(len(h[0]) for h in held[1:]) > HELD:
            a, b, most = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(-most, kind="stable")
            keep = order[forest(of[a[order]], of[b[order]])]
            held = [(a[keep], b[keep], most[keep])]
    return held[0][:2]


def _candidates(best: bool):
    """Of (token, p, q, id, n, comp, bits, block) sorted by token, p, q: of the pairs of different components that the trees keep, a forest,
    the most hopeful first: with `best` one that connects the components, else one that connects the documents. Each group gives fewer pairs than it has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(["token", "p", "q"], batches):
            key = [t[k].to_numpy() for k in ("token", "p", "q")]
            at = np.r_[0, np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1, len(t)]
            ids, n, comp, block = (t[k].to_numpy() for k in ("id", "n", "comp", "block"))
            bits = t["bits"].combine_chunks() if t["bits"].num_chunks != 1 else t["bits"].chunk(0)
            found: list[np.ndarray] = []
            for s, e in zip(at[:-1], at[1:]):
                maps = [np.frombuffer(bits[r].as_buffer(), "u8") for r in range(s, e)]
                p, q = key[1][s], key[2][s]
                if p == q:
                    parts = similar_parts(n[s:e], maps)
                else:
                    one, two = np.flatnonzero(block[s:e] == p), np.flatnonzero(block[s:e] == q)
                    if not len(one) or not len(two):
                        continue
                    parts = similar_parts(n[s:e], maps, one, two)
                a, b = thinned(parts, comp[s:e], (comp if best else ids)[s:e])
                found.append(np.stack([ids[s:e][a], ids[s:e][b]]))
            if found:
                both = np.unique(np.sort(np.concatenate(found, 1), 0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])
        bytescan.trim()

    return run


def _whole_sets(flags: bytes, width: int):
    """id, n, k1, tokens of the texts whose flag is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(np.frombuffer(flags, "u1"), bitorder="little")
        for b in batches:
            at = b.column(2).to_numpy(zero_copy_only=False)
            b = b.take(pa.array(np.flatnonzero(table[at])))
            for part in bytescan.slices(b, 1):
                sets = bytescan.shingle_sets(part.column(1), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.array([s.sum(dtype="u8") for s in sets], "u8").view("i8")), pa.array([_pack(s) for s in sets], pa.binary())],
                    names=["id", "n", "k1", "tokens"],
                )

    return run


def links_between(sets: list[np.ndarray], left: np.ndarray | None = None, right: np.ndarray | None = None, comp: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets that reach the similarity, within all of them or between left and right (positions), counted exactly.

    With components of the sets, only as many as join them: pairs that components so far hold together are not counted.
    """
    n = np.array([len(s) for s in sets], "i8")
    if left is None and len(sets) <= 64:
        a, b = np.triu_indices(len(sets), 1)
    else:
        a, b, _ = similar(n, [bitmap(s) for s in sets], left, right)
    fit = (n[a] * DEN >= n[b] * NUM) & (n[b] * DEN >= n[a] * NUM)
    if comp is not None:
        comp = comp.copy()
        fit &= comp[a] != comp[b]
    a, b = a[fit], b[fit]
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    if not len(a):
        return a, b
    kinds, token = np.unique(np.concatenate(sets), return_inverse=True)
    off = np.cumsum(n) - n
    mark, keep = np.zeros(len(kinds), bool), np.zeros(len(a), bool)
    at = np.r_[0, np.flatnonzero(a[1:] != a[:-1]) + 1, len(a)]
    for s, e in zip(at[:-1], at[1:]):
        pair = np.arange(s, e)
        if comp is not None:
            pair = pair[comp[b[s:e]] != comp[a[s]]]
            if not len(pair):
                continue
        own = token[off[a[s]] : off[a[s]] + n[a[s]]]
        mark[own] = True
        size = n[b[pair]]
        begin = np.cumsum(size) - size
        here = np.repeat(off[b[pair]] - begin, size) + np.arange(size.sum())
        both = np.add.reduceat(mark[token[here]], begin, dtype="i8")
        hit = pair[both * DEN >= (len(own) + size - both) * NUM]
        mark[own] = False
        if comp is not None:
            joined, once = np.unique(comp[b[hit]], return_index=True)
            hit = hit[once]
            comp[np.isin(comp, joined)] = comp[a[s]]
        keep[hit] = True
    return a[keep], b[keep]


def _within(pairs: bool, joins: bool = False):
    """Of (comp, p, q, id, n, k1, more, block, tokens) sorted by comp, p, q: the links of two blocks of a component, as pairs or
    as id, n, k1, links (documents that a set's links lead to). `more` is a set's number of documents or, for `joins`, what it belongs to
    so far; of the links then only as many are given as join these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(["comp", "p", "q"], batches):
            comp, p, q, ids, n, k1, more, block = (t[k].to_numpy() for k in ("comp", "p", "q", "id", "n", "k1", "more", "block"))
            at = np.r_[0, np.flatnonzero((comp[1:] != comp[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1, len(t)]
            tokens = t["tokens"].combine_chunks() if t["tokens"].num_chunks != 1 else t["tokens"].chunk(0)
            found: list[list[np.ndarray]] = []
            for s, e in zip(at[:-1], at[1:]):
                # rows that repeat a document with the same text are one
                rows = s + np.unique(np.stack([ids[s:e], n[s:e], k1[s:e]], 1), axis=0, return_index=True)[1]
                sets = [_unpack(tokens[int(r)].as_buffer()) >> np.uint64(24) for r in rows]
                so_far = more[rows] if joins else None
                if p[s] == q[s]:
                    a, b = links_between(sets, comp=so_far)
                else:
                    one, two = np.flatnonzero(block[rows] == p[s]), np.flatnonzero(block[rows] == q[s])
                    if not len(one) or not len(two):
                        continue
                    a, b = links_between(sets, one, two, so_far)
                a, b = rows[a], rows[b]
                other = ids[a] != ids[b]  # two texts of one document are no link
                a, b = a[other], b[other]
                if not len(a):
                    continue
                if pairs:
                    found.append([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])])
                else:
                    near = np.bincount(a - s, more[b], e - s) + np.bincount(b - s, more[a], e - s)
                    some = np.flatnonzero(near)
                    found.append([ids[s + some], n[s + some], k1[s + some], near[some].astype("i8")])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a", "b"] if pairs else ["id", "n", "k1", "links"])
        bytescan.trim()

    return run


def _blocks(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """The sets of nodes(comp, id, n, k1, more) whole, each comp dealt into pairs of blocks: comp, p, q, id, n, k1, more, block, tokens."""
    spark = docs.sparkSession
    blocks = nodes.groupBy("comp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / LINK_DOCS), F.ceil(F.sum("n") / LINK_TOKENS)).cast("int").alias("blocks"))
    nodes = nodes.join(blocks, "comp").withColumn("block", F.pmod(F.xxhash64("id", "n", "k1"), F.col("blocks").cast("long")).cast("int"))
    nodes = staged(nodes, "component-classes")
    spot = F.pmod(F.xxhash64("id"), F.lit(FLAG_BITS)).cast("long")
    marks = nodes.select(spot.alias("h")).groupBy(F.bitmap_bucket_number(F.col("h") + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("h") + 1)).alias("m"))
    flags = bytearray(FLAG_BITS // 8)
    for k, m in marks.collect():
        flags[(k - 1) * 4096 : k * 4096] = bytes(m)
    sets = docs.select("id", "text", spot.alias("h")).mapInArrow(_whole_sets(bytes(flags), width), "id long, n long, k1 long, tokens binary")
    rows = sets.join(nodes, ["id", "n", "k1"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("comp", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "id", "n", "k1", "more", "block", "tokens")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    return rows.repartition(parts, "comp", "p", "q").sortWithinPartitions("comp", "p", "q")


def _joining(pairs: DataFrame, docs: DataFrame, classes: DataFrame, comps: DataFrame, width: int) -> DataFrame:
    """(a, b): as many links as join the components of comps(id, component) that link, where pairs(a, b) connect all candidates."""
    spans = staged(components(pairs), "spans").select("id", F.col("component").alias("comp"))
    nodes = classes.select(F.col("rep").alias("id"), "n", "k1").join(spans, "id").join(comps, "id", "left").select("comp", "id", "n", "k1", F.coalesce("component", "id").alias("more"))
    return staged(_blocks(docs, nodes, width).mapInArrow(_within(True, True), "a long, b long"), "joins")


def jaccard_join(docs: DataFrame, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, links): doc_id, n_shingles, class_id, component_id and n_links of every row; links(a, b) between class representatives.

    Components are those of near_components(). All links lie within them, so each component's classes are compared
    whole, in pairs of blocks of LINK_DOCS classes: trees as there, then exact counts of what remains. Every link is
    counted. n_links is how many other documents a row's set links with, those with an equal set included; a document
    with several different texts counts once for each of them. The links themselves are made when they are read.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    named, classes, comps = _components(docs, width)
    nodes = classes.join(comps, classes["rep"] == comps["id"]).select(F.col("component").alias("comp"), F.col("rep").alias("id"), "n", "k1", F.col("size").alias("more"))
    blocks = _blocks(docs.where("id is not null"), nodes, width)
    near = blocks.mapInArrow(_within(False), "id long, n long, k1 long, links long").groupBy("id", "n", "k1").agg(F.sum("links").alias("links"))
    near = classes.join(near.withColumnRenamed("id", "rep"), ["rep", "n", "k1"], "left").select("n", "k1", "k2", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = named.join(near, ["n", "k1", "k2"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).alias("n_links"))
    return out, blocks.mapInArrow(_within(True), "a long, b long").distinct()


def near_components(docs: DataFrame, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of every row.

    Two documents link when their sets of distinct `width`-word shingles have a Jaccard similarity of NUM/DEN or more.

    1. One pass over the texts hashes the sets; equal sets form a class, represented by its smallest doc_id.
    2. Representatives that share a set's smallest token (under any of four orders) are counted against one of the
       group. These links make most components of large groups of copies, in linear work.
    3. meeting_keys() brings every two sets that link together under some token. Groups inside one component have
       nothing left to find and go; in each of the others documents form a signature tree (OR-combined bitmaps, size ranges) whose dual traversal drops node pairs by
       their greatest possible overlap. A group beyond GROUP_DOCS documents is dealt into pairs of blocks.
    4. Of what remains, a group first gives the most hopeful pairs that connect its components, fewer than it has
       components; they are counted exactly from the whole texts, and links join components.
    5. Groups that are still open give pairs that connect all documents with a candidate in another component. What
       these connect is compared whole, in pairs of blocks of LINK_DOCS, where candidates are found again and counted
       exactly; only links that join components leave a task, so rows grow with documents and not with their pairs.

    No cap is set on partners or candidates. Links inside a component that step 2 has already made are not counted
    here, as they change no component; jaccard_join() counts them all.

    Null or wordless texts have an empty set and link with nothing, not even with each other: n_shingles 0, component
    is the own doc_id. Rows without doc_id are returned with null class and component. Rows that repeat a doc_id are
    one document to the links (any of their texts counts). Empty tables give empty results. Other columns are ignored.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return _components(docs, width)[0].select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id")


def _same_id(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) of the representatives of classes that hold different texts of one doc_id."""
    some, own = signed.where("n > 0 and id is not null"), F.struct("n", "k1", "k2")
    several = some.groupBy("id").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo <> hi").select("id")
    reps = some.join(several, "id", "left_semi").join(classes.select("n", "k1", "k2", "rep"), ["n", "k1", "k2"]).select("id", F.col("rep").alias("a")).distinct()
    return reps.join(reps.groupBy("id").agg(F.min("a").alias("b")), "id").where("a <> b").select("a", "b").distinct()


def _components(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row of docs(id, text) with class and component; the classes; component of every class that links."""
    signed = staged(docs.mapInArrow(_sign(width), SIGNED), "signatures")
    classes = signed.where("n > 0 and id is not null").groupBy("n", "k1", "k2", "id").agg(F.first("low").alias("low"))
    classes = classes.groupBy("n", "k1", "k2").agg(F.min("id").alias("rep"), F.first("low").alias("low"), F.count(F.lit(1)).alias("size"))
    classes = staged(classes, "classes")
    lows = classes.select(F.col("rep").alias("a"), "n", F.posexplode("low").alias("order", "token"))
    pick = F.when(F.col("order") < 2, F.col("a")).otherwise(F.xxhash64("a", "order"))  # half of the groups' leaders by id, half at random
    first = lows.groupBy("order", "token").agg(F.min(F.struct(pick.alias("k"), F.col("a").alias("b"), F.col("n").alias("m"))).alias("l"), F.count(F.lit(1)).alias("c")).where("c > 1").select("order", "token", "l.b", "l.m")
    near = lows.join(first, ["order", "token"]).where(f"a <> b and n * {DEN} >= m * {NUM} and m * {DEN} >= n * {NUM}").select("a", "b")
    texts = docs.where("id is not null")
    links = verified(near.distinct(), texts, width).unionByName(staged(_same_id(signed, classes), "same-id"))
    comps = staged(components(links), "components")

    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    tokens = signed.where("n > 0 and id is not null").select(F.explode("keys").alias("token"), "id")
    met = staged(tokens.repartition(parts, "token").sortWithinPartitions("token").mapInArrow(_shared, "token long, id long"), "shared-tokens")
    large = met.where("id is null").select("token").distinct()
    met = met.where("id is not null").unionByName(tokens.join(large, "token").select("token", "id"))
    for best in (True, False):
        reps = classes.select("rep", "n").join(comps, classes["rep"] == comps["id"], "left").select(F.col("rep").alias("id"), "n", F.coalesce("component", "rep").alias("comp"))
        held = staged(met.join(reps, "id").distinct(), "groups")
        open_ = held.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo <> hi").select("token", F.ceil(F.col("c") / GROUP_DOCS).cast("int").alias("blocks"))
        rows = held.join(open_, "token").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("token", "id", "n", "comp", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
        rows = staged(rows, "open-groups")
        bits = signed.where("n > 0").join(rows.select("id").distinct(), "id", "left_semi").groupBy("id", "n", "k1").agg(F.first("bits").alias("bits")).drop("k1")
        rows = rows.join(bits, ["id", "n"]).select("token", "p", "q", "id", "n", "comp", "bits", "block")
        pairs = rows.repartition(parts, "token", "p", "q").sortWithinPartitions("token", "p", "q").mapInArrow(_candidates(best), "a long, b long").distinct()
        links = links.unionByName(verified(pairs, texts, width) if best else _joining(pairs, texts, classes, comps, width))
        comps = staged(components(links), "components")
    named = signed.select("id", "n", "k1", "k2").join(classes.select("n", "k1", "k2", "rep"), ["n", "k1", "k2"], "left")
    named = named.withColumn("rep", F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("rep", "id")))
    out = named.join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    out = out.select(F.col("id").alias("doc_id"), "n", "k1", "k2", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
    return out, classes, comps
