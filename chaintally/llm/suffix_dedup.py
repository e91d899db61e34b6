"""Exact removal of repeated passages by suffix arrays.

A byte goes if it lies in a string of ``SPAN`` bytes that also starts in a document with a
smaller doc_id. Every window of ``SPAN`` bytes is keyed by its anchor, the least hash of the
``GRAM``-byte strings inside it, so equal windows have equal keys wherever they stand. Runs of
neighbouring windows with one key form a region, and the work goes in four steps:

1. Texts are dealt to shards by content, copies within a task folded before they are dealt, so a
   text reaches its shard at most once per batch of rows, however many copies it has. Each shard's distinct keys are counted across shards.
2. Per shard, equal texts fold into one. Regions whose key occurs in another text or shard are
   kept, equal regions fold into the one of the smallest doc_id, and the rest go on by key.
3. Regions of a key meet in one task, in blocks of bounded size. A block is sorted as a suffix
   array by Larsson-Sadakane refinement (as many bytes as fit a number, then doubling, unsorted
   groups only), Kasai's method gives the common prefixes, walking all regions in step, and runs
   of at least ``SPAN`` common bytes give each window its smallest document. A key whose regions
   are all equal needs no array; one with more regions than a block is cut into several suffix
   arrays, merged by binary search in sorted windows.
4. The removals found return to the shards of the texts and are applied once per text. Documents
   get the result of their text by a join on its hash, in which a text of many copies can be split.

Hashes only choose what is compared: equality of windows is decided by bytes. A text is named by
64 bits, and these are checked first: of texts that share a name but not their SHA-256, all but
one get another. A key found in
more than ``HOT`` documents is dealt by its single windows, so no task gathers more of one key
than that, and equal windows have folded into one row per shard before they meet.

Defined results: NULL texts count as empty; texts shorter than a window lose nothing; rows with
the same doc_id never remove each other; NULL ids come after all others; an empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chaintally.llm import common
from chaintally.session import stored

common.travels(__name__)

SPAN = 50
GRAM = 16
#: Bytes of text to a shard, fewest shards, bytes hashed together, bytes of a suffix array.
SHARD, FEWEST, TOGETHER, BLOCK = 16_000_000, 32, 250_000, 2_000_000
#: Bytes of a suffix array over several keys: as many as stay in a core's cache.
FILL = 250_000
#: Windows to a region at most; documents with a key above which its windows are dealt singly.
WIDTH, HOT = 200, 1_000_000
LAST = np.iinfo(np.int64).max
#: Bits of a position in a suffix array.
PLACES = 21
DDL = "dest int, kind int, a binary, b binary, c binary, d binary"
SCHEMA = pa.schema([("dest", pa.int32()), ("kind", pa.int32()), *[(c, pa.binary()) for c in "abcd"]])
TEXTS, COUNTED, SHARED, REGIONS, REMOVED = range(5)


def squeeze(data):
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data if isinstance(data, bytes) else data.tobytes())


def expand(data, kind=None):
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw if kind is None else np.frombuffer(raw, kind)


def rows(found):
    """A record batch of (dest, kind, a, b, c, d) tuples."""
    columns = list(zip(*found)) if found else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)


def window_keys(text, ends):
    """The key of every window of a run of texts laid end to end, and which windows lie in one text."""
    if len(text) < SPAN:
        return np.empty(0, np.uint64), np.empty(0, bool)
    word = np.lib.stride_tricks.sliding_window_view(text, 8).copy().view("<u8").ravel()
    n = len(text) - GRAM + 1
    least = word[:n] * np.uint64(0x9E3779B97F4A7C15)
    least ^= least >> np.uint64(29)
    least += word[8:8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    least ^= least >> np.uint64(32)
    least *= np.uint64(0xD6E8FEB86659FD93)
    least ^= least >> np.uint64(29)
    wide, need = 1, SPAN - GRAM + 1
    while wide < need:
        step = min(wide, need - wide)
        least = np.minimum(least[:-step], least[step:])
        wide += step
    inside = np.ones(len(least), bool)
    for back in range(1, SPAN):  # a window may not reach over the end of its text
        at = ends[:-1] - back
        inside[at[(at >= 0) & (at < len(least))]] = False
    return least, inside


def regions(texts):
    """For parts of a list of byte texts: (number of the first text, bytes, starts, key, first, windows) of the regions."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (size < TOGETHER or j == i):
            size += len(texts[j])
            j += 1
        part = texts[i:j]
        starts = np.concatenate([[0], np.cumsum([len(t) for t in part])])
        text = np.frombuffer(b"".join(part), np.uint8)
        key, inside = window_keys(text, starts[1:])
        if len(key):
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (inside[1:] != inside[:-1])])
            first = np.flatnonzero(new)
            windows = np.diff(np.append(first, len(key)))
            good = inside[first]
            first, windows = first[good], windows[good]
            pieces = -(-windows // WIDTH)
            if len(pieces) and pieces.max() > 1:  # long runs of one key are cut
                which = np.repeat(np.arange(len(first)), pieces)
                place = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first, windows = first[which] + place * WIDTH, np.minimum(WIDTH, windows[which] - place * WIDTH)
            yield i, text, starts, key[first], first, windows
        i = j


def once(key, text):
    """Distinct (key, text) pairs, by key; the numbers of the texts ascend."""
    order = np.argsort(key, kind="stable")
    key, text = key[order], text[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    return key[new], text[new]


def unpack(table):
    """(doc ids, text hashes, byte texts) of a shard's rows of texts; NULL ids are ``LAST``."""
    ids, hashes, texts = [], [], []
    for r in table:
        ids.append(expand(r["a"], np.int64))
        hashes.append(expand(r["b"], np.int64))
        data, lengths = expand(r["d"]), expand(r["c"], np.int64)
        at = np.concatenate([[0], np.cumsum(lengths)]).tolist()
        texts += [data[x:y] for x, y in zip(at[:-1], at[1:])]
    return np.concatenate(ids), np.concatenate(hashes), texts


def pack(shards):
    """Texts to rows (shard, TEXTS, ids, hashes, lengths, bytes), compressed; a copy only goes out under a smaller id."""
    def run(batches):
        given = {}
        for batch in batches:
            ids = batch["doc_id"].fill_null(LAST).to_numpy(zero_copy_only=False)
            hashes = batch["hash"].to_numpy(zero_copy_only=False)
            keep = [k for k in distinct(ids, hashes) if hashes[k] not in given or ids[k] < given[hashes[k]]]
            if not keep:
                continue
            ids, hashes, texts = ids[keep], hashes[keep], batch["data"].take(pa.array(keep)).to_pylist()
            given.update(zip(hashes.tolist(), ids.tolist()))
            shard = hashes.view(np.uint64) % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            found = []
            for at in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                of = [texts[k] for k in at]
                found.append((int(shard[at[0]]), TEXTS, squeeze(ids[at]), squeeze(hashes[at]),
                              squeeze(np.array([len(t) for t in of], np.int64)), squeeze(b"".join(of))))
            yield rows(found)
    return run


def count_keys(shards):
    """Keys of the texts to rows (bucket, COUNTED, low halves, shards, documents)."""
    def run(batches):
        for batch in batches:
            hashes = batch["hash"].to_numpy(zero_copy_only=False)
            shard = (hashes.view(np.uint64) % np.uint64(shards)).astype(np.uint64)
            order = np.argsort(shard, kind="stable")
            data = batch["data"].to_pylist()
            texts, shard = [data[k] for k in order], shard[order]
            keys, homes = [], []
            for first, _, starts, key, at, _ in regions(texts):
                text = first + np.searchsorted(starts, at, side="right") - 1
                key, text = once(key, text)
                keys.append(key)
                homes.append(shard[text])
            if not keys:
                continue
            key, home = np.concatenate(keys), np.concatenate(homes)
            bucket, low = (key >> np.uint64(32)) % np.uint64(shards), key & np.uint64(0xFFFFFFFF)
            order = np.lexsort((home, bucket << np.uint64(32) | low))
            bucket, low, home = bucket[order], low[order], home[order]
            new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (home[1:] != home[:-1])])
            at = np.flatnonzero(new)
            times = np.minimum(np.diff(np.append(at, len(new))), 255).astype(np.uint8)
            bucket, low, home = bucket[at], low[at], home[at]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            yield rows([(int(bucket[x]), COUNTED, squeeze(np.diff(low[x:y], prepend=np.uint64(0)).astype(np.uint32)),
                         squeeze(home[x:y].astype(np.uint32)), squeeze(times[x:y]), b"") for x, y in zip(cut[:-1], cut[1:])])
    return run


def share_keys(hot):
    """The counts of one bucket to rows (shard, SHARED, keys found in several shards, hot keys)."""
    def run(table):
        found = table.to_pylist()
        low = np.concatenate([np.cumsum(expand(r["a"], np.uint32), dtype=np.uint64) for r in found])
        home = np.concatenate([expand(r["b"], np.uint32) for r in found])
        times = np.concatenate([expand(r["c"], np.uint8) for r in found]).astype(np.int64)
        order = np.lexsort((home, low))
        low, home, times = low[order], home[order], times[order]
        first = np.concatenate([[True], low[1:] != low[:-1]])
        of = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(low)) - 1
        several, many = (home[starts] != home[ends])[of], (np.add.reduceat(times, starts) > hot)[of]
        new = np.concatenate([[True], (low[1:] != low[:-1]) | (home[1:] != home[:-1])])
        keep = new & (several | many)
        key, home, many = low[keep] | np.uint64(found[0]["dest"]) << np.uint64(32), home[keep], many[keep]
        order = np.argsort(home, kind="stable")
        out = []
        for at in np.split(order, np.flatnonzero(np.diff(home[order])) + 1) if len(order) else ():
            out.append((int(home[at[0]]), SHARED, squeeze(key[at]), squeeze(key[at][many[at]]), b"", b""))
        return pa.Table.from_batches([rows(out)])
    return run


def runs(first, last):
    """Sorted ranges of bytes, those that touch or overlap made one; sorted by first."""
    if not len(first):
        return first, last
    reach = np.maximum.accumulate(last)
    new = np.concatenate([[True], first[1:] > reach[:-1]])
    return first[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)]


def removed_row(shard, texts, first, last):
    order = np.lexsort((first, texts))
    return (int(shard), REMOVED, squeeze(texts[order].astype(np.int64)), squeeze(first[order].astype(np.int64)), squeeze(last[order].astype(np.int64)), b"")


def distinct(ids, hashes):
    """Numbers of the rows that stand for their text, the one with the smallest id."""
    best = {}
    for k, h in enumerate(hashes.tolist()):
        if h not in best or ids[k] < ids[best[h]]:
            best[h] = k
    return list(best.values())


def local(shards):
    """One shard's texts and shared keys to regions by key, and removals settled here."""
    def run(table):
        import xxhash

        found = table.to_pylist()
        shard = found[0]["dest"]
        of = [r for r in found if r["kind"] == TEXTS]
        ids, hashes, texts = unpack(of)
        keep = distinct(ids, hashes)
        ids, hashes, texts = ids[keep].tolist(), hashes[keep], [texts[k] for k in keep]
        shared = [r for r in found if r["kind"] == SHARED]
        known = np.sort(np.concatenate([expand(r["a"], np.uint64) for r in shared])) if shared else np.empty(0, np.uint64)
        hot = set(np.concatenate([expand(r["b"], np.uint64) for r in shared]).tolist()) if shared else set()
        parts = list(regions(texts))
        if not parts:
            return pa.Table.from_batches([rows([])])
        # keys that occur in several texts of this shard
        each = np.sort(np.concatenate([once(key, n + np.searchsorted(starts, at, side="right") - 1)[0] for n, _, starts, key, at, _ in parts]))
        here = np.unique(each[1:][each[1:] == each[:-1]])
        best, lost = {}, []
        for n, text, starts, key, at, windows in parts:
            name = ((key >> np.uint64(32)) % np.uint64(shards)) << np.uint64(32) | (key & np.uint64(0xFFFFFFFF))
            want = np.zeros(len(key), bool)
            for table_, value in ((known, name), (here, key)):
                if len(table_):
                    want |= table_[np.minimum(np.searchsorted(table_, value), len(table_) - 1)] == value
            at, windows, key, name = at[want], windows[want], key[want], name[want]
            number = np.searchsorted(starts, at, side="right") - 1
            data = text.tobytes()
            for k, a, w, t, b, m in zip(key.tolist(), at.tolist(), windows.tolist(), (n + number).tolist(), (at - starts[number]).tolist(), name.tolist()):
                single = m in hot
                for d in range(w if single else 1):
                    size = SPAN if single else w + SPAN - 1
                    region = data[a + d:a + d + size]
                    entry = (xxhash.xxh64_intdigest(region) if single else k, region)
                    old, new = best.get(entry), (t, b + d)
                    if old is None:
                        best[entry] = new
                    elif ids[t] == ids[old[0]]:
                        best[(*entry, new)] = new  # the same doc_id again: looked up for itself
                    else:
                        if ids[t] < ids[old[0]]:
                            best[entry], new = new, old
                        lost.append((new[0], new[1], new[1] + size))
        out = []
        if lost:
            t, first, last = np.array(lost, np.int64).T
            out.append(removed_row(shard, hashes[t], first, last))  # keeps its destination through the next step
        if best:
            key = np.fromiter((e[0] for e in best), np.uint64, len(best))
            at, owner = np.array(list(best.values()), np.int64), np.array(ids, np.int64)
            bodies = [e[1] for e in best]
            bucket = (key % np.uint64(shards)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for x in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                head = np.stack([key[x].view(np.int64), owner[at[x, 0]], hashes[at[x, 0]], at[x, 1]], 1)
                out.append((int(bucket[x[0]]), REGIONS, squeeze(head), squeeze(np.array([len(bodies[k]) for k in x], np.int32)),
                            squeeze(b"".join([bodies[k] for k in x])), str(shard).encode()))
        return pa.Table.from_batches([rows(out)])
    return run


def suffix_array(text, starts):
    """Positions of all suffixes in order; a suffix ends with its region, equal ones stand in text order.

    Group, rank behind and position share one 64-bit number, so a round is a plain sort of numbers.
    """
    n = len(text)
    if n >= 1 << PLACES:
        raise ValueError("a block must be shorter than 2 ** 21 bytes")
    place, low = np.uint64(PLACES), np.uint64((1 << PLACES) - 1)
    sizes = np.diff(starts)
    rest = np.repeat(starts[1:], sizes) - np.arange(n)  # bytes to the end of the region
    used = np.bincount(text, minlength=256) > 0
    base, depth = max(2, int(used.sum()) + 1), 4
    while base ** (depth + 1) < 1 << (64 - PLACES):
        depth += 1
    wide = np.zeros(n + depth, np.uint64)
    wide[:n] = np.cumsum(used)[text]
    first = np.zeros(n, np.uint64)
    for j in range(depth):
        first *= np.uint64(base)
        first += np.where(rest > j, wide[j:j + n], np.uint64(0))
    first = np.sort((first << place) | np.arange(n, dtype=np.uint64))
    order = (first & low).astype(np.int64)
    first >>= place
    new = np.concatenate([[True], first[1:] != first[:-1]])
    rank = np.empty(n, np.uint64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.uint64), np.uint64(0)))  # a group's rank is the place of its first suffix
    longest = int(sizes.max(initial=0))
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in groups of several suffixes
    while depth < longest and len(open_):
        at = order[open_]
        behind = np.where(rest[at] > depth, rank.take(at + depth, mode="clip") + np.uint64(1), np.uint64(0))
        key = (rank[at] << np.uint64(2 * PLACES + 1)) | (behind << place) | at.view(np.uint64)
        key.sort()
        at = (key & low).astype(np.int64)
        key >>= place
        order[open_] = at
        parted = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = np.maximum.accumulate(np.where(parted, open_, 0)).view(np.uint64)
        depth *= 2
        open_ = open_[~(parted & np.append(parted[1:], True))]
    return order


def common_prefixes(text, starts, order, least=1):
    """Kasai's method, all regions walked in step: the common bytes of each suffix and the one before it in order.

    Positions are laid out step by step, so a step reads slices, and bytes are compared eight at a time. A region
    is walked as far as its suffixes have ``least`` bytes; the shorter ones get 0.
    """
    n = len(text)
    sizes = np.diff(starts)
    lanes = np.argsort(-sizes, kind="stable")
    begin, sizes = starts[:-1][lanes], np.maximum(0, sizes[lanes] - least + 1)
    alive = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), side="left")  # regions longer than the step
    at = np.concatenate([np.empty(0, np.int64), *[begin[:k] + t for t, k in enumerate(alive.tolist())]])
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[:1]] = n
    before = before[at]
    rest = np.append(np.repeat(starts[1:], np.diff(starts)) - np.arange(n), 0)  # bytes to the end of the region
    limit = np.minimum(rest[at], rest[before])
    word = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(8, np.uint8)), 8).copy().view("<u8").ravel()
    same, shared, x = np.zeros(len(begin), np.int64), np.zeros(n, np.int64), 0
    for k in alive.tolist():
        a, b, most = at[x:x + k], before[x:x + k], limit[x:x + k]
        same = np.minimum(np.maximum(same[:k] - 1, 0), most)
        go = np.flatnonzero(same < most)
        while len(go):
            of = same[go]
            other = word[a[go] + of] ^ word[b[go] + of]
            low = other & (~other + np.uint64(1))  # the first bit that differs
            of += np.where(other == 0, 8, (np.frexp(low.astype(np.float64))[1] - 1) >> 3)
            of = np.minimum(of, most[go])
            same[go] = of
            go = go[(other == 0) & (of < most[go])]
        shared[a] = same
        x += k
    return shared[order]


class Block:
    """The windows of some regions in order, equal ones together, with their smallest documents."""

    def __init__(self, bodies, docs):
        self.starts = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
        self.text = np.frombuffer(b"".join(bodies), np.uint8)
        order = suffix_array(self.text, self.starts)
        shared = common_prefixes(self.text, self.starts, order, SPAN)
        region = np.repeat(np.arange(len(bodies)), np.diff(self.starts))
        whole = np.repeat(self.starts[1:], np.diff(self.starts))[order] - order >= SPAN
        # no suffix shorter than a window stands between two equal windows, so leaving them out parts no group
        order, shared = order[whole], shared[whole]
        first = shared < SPAN
        if len(first):
            first[0] = True
        self.at, self.group = order, np.cumsum(first) - 1
        self.heads = order[first]
        self.least = np.minimum.reduceat(docs[region[order]], np.flatnonzero(first)) if len(order) else np.empty(0, np.int64)

    def grams(self):
        """The distinct windows in order."""
        every = np.lib.stride_tricks.sliding_window_view(self.text, SPAN)[self.heads]
        return np.ascontiguousarray(every).view(f"S{SPAN}").ravel()

    def smallest(self):
        """The smallest document of the window at each position, ``LAST`` where none starts."""
        out = np.full(len(self.text), LAST)
        out[self.at] = self.least[self.group]
        return out


def merge(blocks):
    """Give equal windows of several blocks the smallest document of all, by binary search in sorted windows."""
    known, least = np.empty(0, f"S{SPAN}"), np.empty(0, np.int64)
    for b in blocks:
        grams = b.grams()
        at = np.searchsorted(known, grams)
        old = at < len(known)
        old[old] = known[at[old]] == grams[old]
        least[at[old]] = np.minimum(least[at[old]], b.least[old])
        known, least = np.insert(known, at[~old], grams[~old]), np.insert(least, at[~old], b.least[~old])
    for b in blocks:
        b.least = least[np.searchsorted(known, b.grams())]


def compare(block):
    """The regions of some keys to removals by shard."""
    def run(table):
        found = table.to_pylist()
        passed = [tuple(r[c] for c in SCHEMA.names) for r in found if r["kind"] == REMOVED]
        of = [r for r in found if r["kind"] == REGIONS]
        if not of:
            return pa.Table.from_batches([rows(passed)])
        heads = [expand(r["a"], np.int64).reshape(-1, 4) for r in of]
        home = np.repeat([int(r["d"]) for r in of], [len(h) for h in heads])
        head = np.concatenate(heads)
        bodies, windows = [], np.concatenate([expand(r["b"], np.int32) for r in of]).astype(np.int64) - SPAN + 1
        for r in of:
            data, at = expand(r["c"]), np.concatenate([[0], np.cumsum(expand(r["b"], np.int32))]).tolist()
            bodies += [data[x:y] for x, y in zip(at[:-1], at[1:])]
        # equal regions fold into one of the smallest document
        number = {}
        member = np.array([number.setdefault(e, len(number)) for e in zip(head[:, 0].tolist(), bodies)])
        unique = [body for _, body in number]
        least, keys, wide = np.full(len(unique), LAST), np.empty(len(unique), np.int64), np.empty(len(unique), np.int64)
        np.minimum.at(least, member, head[:, 1])
        keys[member], wide[member] = head[:, 0], windows
        # the smallest document of each window of the distinct regions, to begin with the least of its own region
        smallest, spot = np.repeat(least, wide), np.cumsum(wide) - wide
        order = np.argsort(keys, kind="stable")
        new = np.concatenate([[True], np.diff(keys[order]) != 0, [True]])
        order = order[~(new[:-1] & new[1:])]  # the windows of a key's only region have no equals elsewhere
        size = wide[order] + SPAN - 1

        def solve(parts):
            blocks = [Block([unique[k] for k in p], least[p]) for p in parts]
            if len(blocks) > 1:
                merge(blocks)
            for p, b in zip(parts, blocks):
                at = np.arange(wide[p].sum()) - np.repeat(np.cumsum(wide[p]) - wide[p], wide[p])
                smallest[np.repeat(spot[p], wide[p]) + at] = b.smallest()[np.repeat(b.starts[:-1], wide[p]) + at]

        edge = np.append(np.flatnonzero(np.diff(keys[order])) + 1, len(order)) if len(order) else np.empty(0, np.int64)
        begin, filled, start = 0, 0, 0
        for e in edge.tolist():  # small keys are put together; a key larger than a block is cut into blocks
            mine = int(size[start:e].sum())
            if filled and filled + mine > min(FILL, block):
                solve([order[begin:start]])
                begin, filled = start, 0
            filled += mine
            if filled > block:
                part = (np.cumsum(size[begin:e]) - 1) // block
                solve(np.split(order[begin:e], np.flatnonzero(np.diff(part)) + 1))
                begin, filled = e, 0
            start = e
        if filled:
            solve([order[begin:]])
        which = np.repeat(np.arange(len(member)), windows)
        place = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
        gone = smallest[spot[member][which] + place] < head[which, 1]
        which, place = which[gone], place[gone]
        if len(which):
            new = np.concatenate([[True], (which[1:] != which[:-1]) | (place[1:] != place[:-1] + 1)])
            a = np.flatnonzero(new)
            z = np.append(a[1:], len(which)) - 1
            k = which[a]
            first, last = head[k, 3] + place[a], head[k, 3] + place[z] + SPAN
            shard, text = home[k], head[k, 2]
            by = np.argsort(shard, kind="stable")
            passed += [removed_row(shard[x[0]], text[x], first[x], last[x]) for x in np.split(by, np.flatnonzero(np.diff(shard[by])) + 1)]
        return pa.Table.from_batches([rows(passed)])
    return run


OUT = pa.schema([("hash", pa.int64()), ("least", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                 ("kept_sha256", pa.string()), ("kept", pa.binary())])


def apply_removals(with_bytes):
    """One shard's texts and removals to a row for each text, as its smallest document keeps it."""
    def run(table):
        found = table.to_pylist()
        of = [r for r in found if r["kind"] == TEXTS]
        if not of:
            return pa.Table.from_pylist([], OUT)
        ids, hashes, texts = unpack(of)
        keep = distinct(ids, hashes)
        gone = [r for r in found if r["kind"] == REMOVED]
        text, first, last = (np.concatenate([np.empty(0, np.int64), *[expand(r[c], np.int64) for r in gone]]) for c in "abc")
        order = np.lexsort((first, text))
        text, first, last = text[order], first[order], last[order]
        out = []
        for doc, h, data in zip(ids[keep].tolist(), hashes[keep].tolist(), [texts[k] for k in keep]):
            x, y = np.searchsorted(text, h), np.searchsorted(text, h, side="right")
            a, z = runs(first[x:y], last[x:y])
            kept, at = [], 0
            for p, q in zip(a.tolist(), z.tolist()):
                kept.append(data[at:p])
                at = q
            rest = b"".join([*kept, data[at:]])
            out.append((h, doc, len(data), len(data) - len(rest), len(a), hashlib.sha256(rest).hexdigest(), rest if with_bytes else None))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), OUT)], schema=OUT)
    return run


def text_hash(data):
    return F.xxhash64(data)


def named(source, rounds=10):
    """``source (doc_id, data)`` with ``hash``, 64 bits that name a text: equal for equal texts and for no others.

    The distinct pairs of name and SHA-256 are a slim table. Names that several texts share are rare, so few
    texts are renamed, by their SHA-256, until every name stands for one text.
    """
    whole = source.withColumn("hash", text_hash(F.col("data")))
    sha = F.unhex(F.sha2("data", 256))
    names = stored(whole.select("hash", sha.alias("sha")).distinct(), "text-names")
    renamed = None
    for k in range(rounds):
        shared = names.groupBy("hash").agg(F.count("*").alias("n"), F.min("sha").alias("first")).filter("n > 1").drop("n")
        again = stored(names.join(shared, "hash").filter("sha <> first").select("sha", F.xxhash64("sha", F.lit(k)).alias("new")), "text-renamed")
        if not again.head(1):
            break
        names = stored(names.join(again, "sha", "left").select(F.coalesce("new", "hash").alias("hash"), "sha"), "text-names")
        renamed = again if renamed is None else renamed.join(again, "sha", "left_anti").unionByName(again)
    else:
        raise RuntimeError("no names keep the texts apart")
    if renamed is None:
        return whole
    return whole.withColumn("sha", sha).join(renamed, "sha", "left").select("doc_id", "data", F.coalesce("new", "hash").alias("hash"))


def deduplicate(docs, with_bytes=True, hot=HOT, block=BLOCK, shard_bytes=SHARD, fewest=FEWEST):
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (on demand) the kept bytes."""
    source = named(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.as_bytes().alias("data")))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(fewest, -(-size // shard_bytes))

    def meet(rows_, function, ddl=DDL):
        return rows_.groupBy("dest").applyInArrow(function, ddl)

    texts = source.mapInArrow(pack(shards), DDL)
    shared = meet(source.mapInArrow(count_keys(shards), DDL), share_keys(hot))
    removals = meet(meet(texts.unionByName(shared), local(shards)), compare(block))
    of = meet(texts.unionByName(removals), apply_removals(with_bytes),
              "hash bigint, least bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    # of the documents of one text, those after the smallest lose all of it, if it fills a window
    copy = (F.coalesce("doc_id", F.lit(LAST)) > F.col("least")) & (F.col("n_bytes") >= SPAN)
    out = source.select("doc_id", "hash").join(of, "hash").select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("bigint")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256().hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    return out if with_bytes else out.drop("kept")


def digest(docs):
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return deduplicate(docs, with_bytes=False)
