"""Work on arrays of whole graphs and shuffles, for tasks that each take a share of roots or permutations."""

from __future__ import annotations

import os
from urllib.parse import unquote

import numpy as np

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hash_long(values: np.ndarray, seed: int) -> np.ndarray:
    """``xxhash64`` of longs as Spark gives it, after columns whose hash is ``seed``."""
    with np.errstate(over="ignore"):
        x = _turned(values.view(np.uint64) * _P2, 31) * _P1
        x ^= np.array([seed], np.int64).view(np.uint64) + _P5 + np.uint64(8)
        x = _turned(x, 27) * _P1 + _P4
        x ^= x >> np.uint64(33)
        x *= _P2
        x ^= x >> np.uint64(29)
        x *= _P3
        x ^= x >> np.uint64(32)
    return x.view(np.int64)


def shuffled(source: np.ndarray, seed: int, group: np.ndarray | None = None) -> np.ndarray:
    """The places of the rows in the order of their hashes, inside each group if there are groups (in ascending order)."""
    order = np.argsort(hash_long(source, seed))
    if group is not None:
        order = order[np.argsort(group[order], kind="stable")]
    return order


_ARROWS = np.array(
    [
        [[(ax & 1) * (xy & 1) * (ay & 1) + (ay & 1) * (xy >> 1) * (ax & 1) + (ax >> 1) * (ay & 1) * (xy & 1) + (xy & 1) * (ay >> 1) * (ax >> 1) + (ay >> 1) * (ax & 1) * (xy >> 1) + (xy >> 1) * (ax >> 1) * (ay >> 1) for ay in range(4)] for xy in range(4)]
        for ax in range(4)
    ],
    np.int64,
)


def motifs(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[int, int]:
    """Reciprocal dyads and transitive triples of edges between ``n`` numbered nodes; repeated edges count once, loops never.

    Links run from their end of less degree to the other; a link a–x and a link x–y of that kind make a triangle where a–y is
    one, which is looked up in a table of the nodes a of a block.
    """
    apart = src != dst
    src, dst = src[apart].astype(np.int64), dst[apart].astype(np.int64)
    key = np.sort(np.minimum(src, dst) * (2 * n) + np.maximum(src, dst) * 2 + (src > dst))
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    if not len(key):
        return 0, 0
    link = key >> 1
    twice = np.r_[link[1:] == link[:-1], False]
    first = np.r_[True, link[1:] != link[:-1]]
    code = np.where(key & 1, 2, 1) | np.where(twice, 2, 0)
    link, code = link[first], code[first].astype(np.uint8)
    u, v = link // n, link % n
    degree = np.bincount(u, minlength=n) + np.bincount(v, minlength=n)
    rank = np.empty(n, np.int64)
    rank[np.argsort(degree, kind="stable")] = np.arange(n)
    a, z = rank[u], rank[v]
    flipped = a > z
    code = np.where(flipped & (code < 3), 3 - code, code).astype(np.uint8)
    a, z = np.where(flipped, z, a), np.where(flipped, a, z)
    by = np.argsort(a * n + z)
    a, z, code = a[by], z[by], code[by]
    out = np.bincount(a, minlength=n)
    start = np.cumsum(out) - out
    wedges = np.cumsum(np.where(out[a] > 1, out[z], 0))
    rows = max(1, 16_000_000 // n)
    mark = np.zeros((rows, n), np.uint8)
    triples, i = 0, 0
    while i < len(a):
        # A block: whole nodes a, as many as the table has rows and some two million wedges.
        below = wedges[i - 1] if i else 0
        last = min(np.searchsorted(a, a[i] + rows), np.searchsorted(wedges, below + 2_000_000))
        j = int(start[a[last]]) if last < len(a) else len(a)
        if j <= i:
            j = int(start[a[i]] + out[a[i]])
        row = a[i:j] - a[i]
        mark[row, z[i:j]] = code[i:j]
        for lo, hi in _runs(wedges, i, j):
            each = np.where(out[a[lo:hi]] > 1, out[z[lo:hi]], 0)
            edge = np.repeat(np.arange(lo, hi), each)
            far = np.arange(len(edge)) - np.repeat(np.cumsum(each) - each, each) + start[z[edge]]
            ay = mark[a[edge] - a[i], z[far]]
            hit = np.flatnonzero(ay)
            triples += int(_ARROWS[code[edge[hit]], code[far[hit]], ay[hit]].sum())
        mark[row, z[i:j]] = 0
        i = j
    return int((code == 3).sum()), triples


def _runs(wedges: np.ndarray, i: int, j: int, most: int = 4_000_000):  # noqa: ANN202
    """Cuts of i … j of some ``most`` wedges."""
    while i < j:
        k = min(j, max(i + 1, int(np.searchsorted(wedges, (wedges[i - 1] if i else 0) + most))))
        yield i, k
        i = k


def hub_paths(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> tuple:
    """A graph of ``n`` nodes with distance 1/weight, as ``betweenness`` takes it: its parts that no edge joins and their hubs (the node of most
    edges of each), its edges by start without those of hubs, then for the ways to the hub and those from it their distances,
    numbers of shortest paths and edges of such paths.
    """
    step = 1.0 / np.maximum(weight.astype(float), 1.0)
    part = np.arange(n)
    while (part[src] != part[dst]).any():
        least = part.copy()
        np.minimum.at(least, part[src], part[dst])
        np.minimum.at(least, part[dst], part[src])
        while (least != least[least]).any():
            least = least[least]
        part = least[part]
    order = np.lexsort((np.bincount(src, minlength=n) + np.bincount(dst, minlength=n), part))
    hub = np.zeros(n, bool)
    hub[order[np.r_[part[order][1:] != part[order][:-1], True]]] = True
    ways = []
    for a, b in ((dst, src), (src, dst)):
        by = np.argsort(b, kind="stable")
        a, b, length = a[by], b[by], step[by]
        dist = np.full(n, np.inf)
        dist[hub] = 0.0
        changed = hub
        while len(e := np.flatnonzero(changed[a])):
            heads = np.flatnonzero(np.r_[True, b[e][1:] != b[e][:-1]])
            new, at = np.minimum.reduceat(dist[a[e]] + length[e], heads), b[e][heads]
            changed = np.zeros(n, bool)
            changed[at[new < dist[at] - 1e-12]] = True
            dist[at] = np.minimum(new, dist[at])
        with np.errstate(invalid="ignore"):
            e = np.flatnonzero(np.abs(dist[a] + length - dist[b]) <= 1e-12)
        paths = hub.astype(float)
        for x in _hops(a[e], b[e], paths):
            paths += x
        ways.append((dist, paths, a[e], b[e]))
    e = np.flatnonzero(~hub[src] & ~hub[dst])
    e = e[np.argsort(src[e], kind="stable")]
    return part, hub, np.r_[0, np.cumsum(np.bincount(src[e], minlength=n))], dst[e].astype(np.int64), step[e], *ways


def betweenness(graph: tuple, roots: np.ndarray) -> np.ndarray:
    """What the shortest paths from ``roots`` add to the betweenness of the nodes of ``hub_paths``, by Brandes' sums.

    Paths by way of the hub are not walked one by one: a root has as many as nodes are reached from the hub, less those that it
    reaches as soon without. Only the latter are looked for, by a search that ends where the way by the hub is shorter; many roots go at once.
    What goes by the hub then flows along the shortest paths to it and from it. Distances are equal up to 1e-12.
    """
    part, hub, begin, end, step, (to, to_paths, *to_edges), (far, far_paths, *far_edges) = graph
    n = len(to)
    total, lost = np.zeros(n), np.zeros(n)
    out, into = np.zeros(n), np.zeros(n)
    others = roots[~hub[roots]]
    width = int(np.clip(4_000_000 // n, 1, 256))
    place = np.zeros(min(width, max(len(others), 1)) * n, np.int64)
    dist = np.full(len(place), np.inf)
    degree = np.diff(begin)

    def spread(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All edges from ``keys``: place among the keys, key of the end and its distance this way."""
        node = keys % n
        each = degree[node]
        at = np.repeat(np.arange(len(keys)), each)
        edge = np.arange(len(at)) + np.repeat(begin[node] - (np.cumsum(each) - each), each)
        return at, (keys - node)[at] + end[edge], dist[keys][at] + step[edge]

    for first in range(0, len(others), width):
        own = others[first : first + width]
        home = np.arange(len(own)) * n + own
        dist[home] = 0.0
        met, now = [home], home
        while len(now):
            _, key, new = spread(now)
            some = np.flatnonzero(new < dist[key] - 1e-12)
            key, new = key[some], new[some]
            some = np.flatnonzero(new <= to[own[key // n]] + far[key % n] + 1e-12)
            key, new = key[some], new[some]
            fresh = np.isinf(dist[key])
            np.minimum.at(dist, key, new)
            place[key] = np.arange(len(key))
            once = place[key] == np.arange(len(key))
            now = key[once]
            met.append(key[once & fresh])
        keys = np.concatenate(met)
        place[keys] = np.arange(len(keys))
        up, key, new = spread(keys)
        with np.errstate(invalid="ignore"):
            some = np.flatnonzero(np.abs(new - dist[key]) <= 1e-12)
        up, down = up[some], place[key[some]]
        paths = np.zeros(len(keys))
        paths[: len(own)] = 1.0
        for x in _hops(up, down, paths):
            paths += x
        root, node = own[keys // n], keys % n
        way = to[root] + far[node]
        tied = np.where(dist[keys] >= way - 1e-12, to_paths[root] * far_paths[node], 0.0)
        every = paths + tied
        back = np.zeros(len(keys))
        for x in _hops(down, up, 1.0 / every):
            back += x
        back *= paths
        back[: len(own)] = 0.0
        total += np.bincount(node, back, n)
        less = np.where(np.isinf(way), 0.0, 1.0 - tied / every)
        less[: len(own)] = ~np.isinf(way[: len(own)])
        lost += np.bincount(node, less, n)
        out += np.bincount(root, less, n)
        dist[keys] = np.inf
    reached = ~np.isinf(far) & ~hub
    starts = others[~np.isinf(to[others])]
    out = -out
    out[starts] += np.bincount(part[reached], minlength=n)[part[starts]]
    into[reached] = (np.bincount(part[starts], minlength=n)[part] - lost)[reached]
    total[hub] = np.bincount(part[starts], out[starts], n)[part[hub]]
    out[starts] += 1.0
    into[reached] += np.bincount(part[roots[hub[roots]]], minlength=n)[part[reached]]
    for mass, paths, edges in ((out, to_paths, to_edges), (into, far_paths, far_edges)):
        share = np.divide(mass, paths, out=np.zeros(n), where=mass != 0)
        flow = np.zeros(n)
        for x in _hops(edges[1], edges[0], share):
            flow += x
        flow *= paths
        flow[hub] = 0.0
        total += flow
    return total


def _hops(start: np.ndarray, end: np.ndarray, x: np.ndarray):  # noqa: ANN202
    """What ``x`` is after one hop along the edges, after two, and so on until nothing is left."""
    while True:
        moved = x[start]
        some = np.flatnonzero(moved)
        if not len(some):
            return
        x = np.bincount(end[some], moved[some], len(x))
        yield x


_STORED: dict[str, tuple] = {}


def store_vectors(folder: str, n: int, terms: int) -> tuple:
    """``split_vectors`` of the Parquet table of ``_i``, ``_t`` and ``w`` in a folder that all executors share, which in a file system are left beside it."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    local = _local(folder)
    system, path = (fs.LocalFileSystem(), local) if local else fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
    batches = ds.dataset(path, format="parquet", filesystem=system).to_batches(batch_readahead=1, fragment_readahead=1)
    vectors = split_vectors(n, terms, (tuple(x.column(c).to_numpy() for c in ("_i", "_t", "w")) for x in batches))
    for k, x in enumerate(vectors if local else ()):
        np.save(f"{local}/_part-{k}.npy", x)
    return vectors


def stored_vectors(folder: str, n: int, terms: int) -> tuple:
    """What ``store_vectors`` has left, mapped into memory; without a file system each worker makes its own and keeps the last."""
    if folder not in _STORED:
        _STORED.clear()
        local = _local(folder)
        files = [f"{local}/_part-{k}.npy" for k in range(7)]
        _STORED[folder] = tuple(np.asarray(np.load(f, mmap_mode="r" if os.path.getsize(f) > 1_000_000 else None)) for f in files) if local else store_vectors(folder, n, terms)
    return _STORED[folder]


def _local(folder: str) -> str | None:
    return unquote("/" + folder[5:].lstrip("/")) if folder.startswith("file:") else None


def split_vectors(n: int, terms: int, parts, cells: int = 36_000_000) -> tuple:  # noqa: ANN001
    """Unit vectors out of parts of (sender, term, weight): the first terms, which are used most, as a matrix of up to ``cells``, the others by sender and by term."""
    dense = int(min(terms, 600, max(1, cells // n)))
    matrix, square, rest = np.zeros((n, dense)), np.zeros(n), [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))]
    for at, term, w in parts:
        square += np.bincount(at, w * w, n)
        common = term < dense
        matrix[at[common], term[common]] = w[common]
        rest.append((at[~common], term[~common], w[~common]))
    norm = np.sqrt(np.where(square > 0, square, 1.0))
    matrix /= norm[:, None]
    at, term, w = (np.concatenate(x) for x in zip(*rest))
    w /= norm[at]
    by, to = np.argsort(at, kind="stable"), np.argsort(term, kind="stable")
    ends = lambda x, k: np.r_[0, np.cumsum(np.bincount(x, minlength=k))]
    return matrix, ends(at, n), term[by], w[by], ends(term, terms), at[to], w[to]


def _rare(vectors: tuple, block: np.ndarray, among: tuple, out: np.ndarray) -> None:
    """Of each row of ``block`` what the terms outside the matrix add to its similarities with some senders, of which ``among`` has those terms."""
    of, term, weight = vectors[1:4]
    by, sender, other = among
    for k, i in enumerate(block):
        terms, x = term[of[i] : of[i + 1]], weight[of[i] : of[i + 1]]
        each = by[terms + 1] - by[terms]
        place = np.arange(each.sum()) + np.repeat(by[terms] - (np.cumsum(each) - each), each)
        out[k] = np.bincount(sender[place], np.repeat(x, each) * other[place], out.shape[1])


def _terms_among(vectors: tuple, columns: np.ndarray) -> tuple:
    """The terms outside the matrix of some senders, who get their places among ``columns`` as numbers."""
    by, sender, other = vectors[4:]
    place = np.full(len(vectors[0]), -1)
    place[columns] = np.arange(len(columns))
    new = place[sender]
    kept = np.flatnonzero(new >= 0)
    return np.searchsorted(kept, by), new[kept], other[kept]


def best_labels(vectors: tuple, rows: np.ndarray, labels: np.ndarray, at_least: float, parts: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the label of most similarity (to nine digits) around it, its own on ties and then the smallest; and whether anything is near.

    Where many senders have one label, these come last and a part at a time, at first by the matrix alone, which gives no more than
    the similarity: a row for which that is already more than for any other label needs no more of them. The few other rows are done as
    a whole, as without ``parts``.
    """
    matrix = vectors[0]
    n = len(matrix)
    names, held = np.unique(labels, return_inverse=True)
    largest = int(np.argmax(np.bincount(held)))
    last = np.flatnonzero(held == largest)
    split = parts and len(last) > 0.3 * n
    rest, last = (np.flatnonzero(held != largest), np.concatenate([last[k::16] for k in range(16)])) if split else (np.arange(n), last[:0])
    among, doubtful = _terms_among(vectors, rest) if split else vectors[4:], []
    best, some = labels[rows].copy(), np.zeros(len(rows), bool)
    width = int(np.clip(6_000_000 // n, 16, 400))
    lines, held_by = np.empty((min(width, len(rows)), len(rest))), held[rest]
    at = np.full(n, -1)
    at[rest] = np.arange(len(rest))
    for first in range(0, len(rows), width):
        block = rows[first : first + width]
        own, near = matrix[block], lines[: len(block)]
        _rare(vectors, block, among, near)
        for c in range(0, len(rest), 2048):
            near[:, c : c + 2048] += own @ (matrix[rest[c : c + 2048]] if split else matrix[c : c + 2048]).T
        inside = np.flatnonzero(at[block] >= 0)
        near[inside, at[block[inside]]] = 0.0  # a sender isn't near itself
        most, high = np.zeros(len(block)), [(last[:0], last[:0])] * len(block)
        for k, line in enumerate(near):
            close = np.flatnonzero(line >= at_least)
            if len(close):
                sums = np.bincount(held_by[close], line[close], len(names))
                most[k] = sums.max()
                top = np.flatnonzero(sums >= most[k] - 2e-9)
                high[k] = (top, sums[top])
        gathered, open_ = np.zeros(len(block)), np.arange(len(block))
        for c in range(0, len(last), 1024):
            columns = last[c : c + 1024]
            part = own[open_] @ matrix[columns].T
            part[(part < at_least) | (columns == block[open_, None])] = 0.0
            gathered[open_] += part.sum(axis=1)
            open_ = open_[gathered[open_] <= most[open_] + 1e-8]
            if len(open_) <= len(block) // 16:
                break
        if split:
            doubtful.append(first + open_)
        for k in range(len(block)):
            top, sums = high[k]
            if gathered[k] > most[k] + 1e-8:
                top, sums = np.array([largest]), gathered[k : k + 1]
            if len(top):
                some[first + k] = True
                sums = np.round(sums, 9)
                tied = names[top[sums == sums.max()]]
                if best[first + k] not in tied:
                    best[first + k] = tied.min()
    if doubtful:
        whole = np.concatenate(doubtful)
        best[whole], some[whole] = best_labels(vectors, rows[whole], labels, at_least, parts=False)
    return best, some
