"""Similarity join of documents on the Jaccard similarity of their word n-gram sets, exact.

Method: universe partition and pigeonhole. Sets lie in size bands such that linked sets are in one band or in two
neighbouring ones; each pair of neighbouring bands is a group. In a group of sets of up to r tokens, linked sets
differ in at most H = 2r (100 - p) / (100 + p) tokens. The tokens are hashed into segments. With H + 1 + E segments
linked sets agree in at least E + 1 of them; a set with at most E segments that many unlinked sets share (up to c
tokens, or none but common tokens) therefore needs no entry for those, and a set with more has entries for all.
Agreeing segments are equal, so both sets leave out the same ones. A segment can also be indexed with its one-deletion neighbourhood,
which counts for two. A cost model chooses for each group how many segments of either kind there are, E and c
(`allocate`).

Equal entries join sets into candidate clusters. Entries are combined in each task before the shuffle (it sends each
entry once, and links its sets), so a group of copies of any size is a few rows. What tasks tell are forests: links that
connect nothing more are left out, so links follow the sets, not their equal entries. Entries are sent in blocks, sorted and
as differences, with as many bits as keep chance meetings rare at the table's size (`widths`); what meets by chance is
only verified in vain. Clusters larger than a block are divided by their sets' prefixes: in any order of the tokens,
linked sets share one of the first size - needed + 1 of each (`prefix`); with the frequent tokens last, sets that have
no more than a common passage share none, so these clusters don't grow with the table. Clusters are verified exactly,
in blocks of bounded size and of like set sizes; a block pair is one task's work, pairs are never rows. Only texts of
clusters are kept for it, and the block pairs are dealt to rounds, so that what a round moves follows the table even
where a cluster's block pairs grow with its square. Where only classes are asked for (`first_of_each`), the sets of a
very large cluster are first verified in a few blocks each; most sets of a group of near copies are then known to be one
class, and block pairs remain only for the others. Sets that are equal are one set throughout, known by the hash of its
tokens.

Defined results: a text without words has an empty set and no links; with fewer words than n the whole sequence is
its only token; A-Z are lower-cased and nothing else; null text counts as without words; a null id has no component
(null) and takes no part; equal rows are copies; rows that share an id but not the text are documents of their own,
each with its own set and links; whole texts count, however long (a set's tokens lie in one task's memory); an empty
table gives an empty result; other columns are not read. Tokens and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import discard, over_batches, slices, written
from glossa.llm.components import attached, components

#: Sets in a verifying block, and tokens.
BLOCK_SETS, BLOCK_TOKENS = 512, 400_000
#: A cluster of more blocks than this is looked at for one large class before its block pairs are dealt.
MANY_BLOCKS = 16
#: Tokens that a round of verification moves, about, where the table doesn't have more.
ROUND_TOKENS = 1 << 24
#: Frequent tokens that are sent to every task, at most, and how often each occurs at least.
COMMON, MIN_COMMON = 1 << 15, 20
#: The cost of a false candidate's token, in entries (moving it, times the share of sets that have a common passage), and
#: the tokens that such sets share.
FALSE_COST, PASSAGE = 0.15, 50

#: Entries that a task combines and sends at once, and those that meet in one block, at least and at most, about.
SENT_ENTRIES, FEW_ENTRIES, MET_ENTRIES = 1 << 19, 1 << 16, 1 << 21
#: Tasks in which entries meet, whatever the table's size: each tells a forest over the sets, so links follow the sets.
MEET_TASKS = 24
#: Links that a task holds before it drops those that connect nothing more.
HELD_LINKS = 1 << 20
_GAP = 0xFFFFFFFF
#: Bytes of text whose words are hashed together, and whose sets are made together.
PART, SLICE = 1 << 19, 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input bears on every bit of the output."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cuts(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Parts of data of about PART bytes that end before white space or with a text."""
    cuts, n = [0], len(data)
    while cuts[-1] < n:
        at = cuts[-1] + PART
        while at < n:
            blank = np.flatnonzero(_SPACE[data[at : at + 4096]])
            if len(blank):
                at += int(blank[0])
                break
            at += 4096
        end = offsets[np.searchsorted(offsets, min(cuts[-1] + PART, n))]  # of the text that lies there
        cuts.append(int(min(at, end, n)))
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _words(data: np.ndarray, a: int, b: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of data[a:b] begin, and their hashes."""
    part = data[a:b]
    space = _SPACE[part]
    begins = np.empty(len(part), dtype=bool)
    begins[0] = True
    begins[1:] = space[:-1]
    inside = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
    begins[inside] = True
    starts = np.flatnonzero(begins & ~space)
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    letters = np.flatnonzero(~space).astype(np.int32)
    first = np.searchsorted(letters, starts)
    sizes = np.diff(np.append(first, len(letters)))
    place = np.arange(len(letters), dtype=np.int32) - np.repeat(first, sizes).astype(np.int32)
    powers = np.cumprod(np.full(int(sizes.max()), _ODD[0], dtype=np.uint64))
    words = np.add.reduceat((_LOWER[part[letters]].astype(np.uint64) + np.uint64(1)) * powers[place], first)
    return starts + a, mixed(words + sizes.astype(np.uint64) * _ODD[1])


def token_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    none = np.zeros(0, dtype=np.uint64)
    if not len(data):
        return [none] * len(texts)
    found = [_words(data, a, b, offsets) for a, b in _cuts(data, offsets)]
    starts, words = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(starts):
        return [none] * len(texts)
    border = np.searchsorted(starts, offsets)
    grams = np.zeros(max(len(words) - n + 1, 0), dtype=np.uint64)
    for i in range(n):
        grams += words[i : len(words) - n + 1 + i] * _ODD[i] if len(grams) else grams
    grams = mixed(grams + np.uint64(n))
    out = []
    for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(mixed((words[a:b] * _ODD[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(none)
    return out


def set_key(tokens: np.ndarray) -> int:
    return _signed(int(mixed(tokens ^ _ODD[2]).sum(dtype=np.uint64)) + len(tokens) * int(_ODD[3]))


def _signed(x: int) -> int:
    """The low 64 bits of x as a signed number."""
    return ((x + (1 << 63)) & ((1 << 64) - 1)) - (1 << 63)


@lru_cache(maxsize=None)
def bands(percent: int) -> np.ndarray:
    """The largest size of each band; sizes linked at percent are at most one band apart."""
    tops, low = [], 1
    while low < 1 << 40:
        tops.append(100 * low // percent)
        low = tops[-1] + 1
    return np.array(tops)


def _up_to(c: int, k: float) -> float:
    """The chance of c tokens at most in a segment of k on average."""
    return math.exp(-k) * sum(k**j / math.factorial(j) for j in range(c + 1))


@lru_cache(maxsize=None)
def allocate(group: int, percent: int) -> tuple[int, int, int, int]:
    """For the group of bands group - 1 and group: segments indexed as they are, segments with deletions, the number of
    small segments that a set may leave out, and the most tokens of a small segment.

    The cheapest in entries plus the cost of the false candidates that common passages make, over the group's sizes.
    """
    tops = bands(percent)
    top, low = int(tops[group]), int(tops[group - 2]) + 1 if group > 1 else 1
    need = 2 * top * (100 - percent) // (100 + percent) + 1
    sizes = [low, (low + top) / 2, top]
    found = []
    for deletions in sorted({need // 2, (need + 1) // 2} - {0}):
        m = max(need - 2 * deletions, 0) + deletions
        cost = 0.0
        for size in sizes:
            k = size / m
            x = min(PASSAGE / size, 0.5)
            false = (m - deletions) * x**k + deletions * (x**k + k * x ** max(k - 1, 0) * (1 - x))
            cost += m + deletions * k + FALSE_COST * size * false
        found.append((cost, m - deletions, deletions, 0, -1))

    def left_out(m: int, size: float, small: int) -> float:
        """The segments of m that are small or lie within a passage, on average."""
        k = size / m
        x = min(PASSAGE / size, 0.5) * k
        inside = math.exp(-k) * (math.exp(x) - sum(x**j / math.factorial(j) for j in range(small + 1)))
        return m * (_up_to(small, k) + inside)

    for small, base in [(-1, top), *((c, size) for c in range(4) for size in sizes)]:
        extra = 0
        for _ in range(30):
            few = left_out(need + extra, base, small) if small >= 0 else 0.0
            extra = math.ceil(few + 2 * math.sqrt(few))
            if extra > need:
                break
        if extra > need:
            continue
        m, cost = need + extra, 0.0
        for size in sizes:
            k = size / m
            few = left_out(m, size, small) if small >= 0 else 0.0
            fits = small >= 0 and few <= extra
            x = min(PASSAGE / size, 0.5) * k
            cost += m - few if fits else m + FALSE_COST * size * m * math.exp(x - k)
        found.append((cost, m, 0, extra, small))
    return min(found)[1:]


def node_of(keys: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Sets in groups, each as one number."""
    return mixed(keys.astype(np.uint64) * _ODD[4] + (groups + 1).astype(np.uint64) * _ODD[5]).astype(np.int64)


def entries(tokens: np.ndarray, group: int, percent: int, common: np.ndarray) -> np.ndarray:
    """The index entries of a set in a group. common: sorted tokens; a segment of nothing else may be left out like a small one."""
    plain, deletions, extra, small = allocate(group, percent)
    m = plain + deletions
    segment = (mixed(tokens + np.uint64(group)) % np.uint64(m)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    segment, values = segment[order], mixed(tokens[order] ^ _ODD[6])
    first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    sums, which = np.add.reduceat(values, first), segment[first]
    each = np.diff(np.append(first, len(segment)))
    few = each <= small
    if small >= 0 and len(common):
        at = np.minimum(np.searchsorted(common, tokens[order]), len(common) - 1)
        few |= np.logical_and.reduceat(common[at] == tokens[order], first)
    gone = np.zeros(0, dtype=np.int64)
    if m - len(first) + np.count_nonzero(few) > extra:  # too many are small: those count too, the empty ones included
        gone = np.setdiff1d(np.arange(m), which)
        few[:] = False
    out = [(sums[~few], which[~few]), (np.zeros(len(gone), dtype=np.uint64), gone)]
    if deletions:
        per_token = np.repeat(sums, each)
        at = segment < deletions
        out.append(((per_token - values)[at], segment[at]))
    total = np.concatenate([x for x, _ in out])
    where = np.concatenate([x for _, x in out]).astype(np.uint64)
    return mixed(total * _ODD[0] + where * _ODD[1] + np.uint64(group * int(_ODD[7]) & (1 << 64) - 1)).astype(np.int64)


def prefix(tokens: np.ndarray, percent: int, common: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first tokens of a set, of which it shares one with every set linked to it: the frequent ones come last, by place, others by hash."""
    first = len(tokens) + percent * len(tokens) // -100 + 1  # linked sets share percent of the larger one's tokens at least
    at = np.minimum(np.searchsorted(common, tokens), max(len(common) - 1, 0))
    last = np.where(common[at] == tokens, place[at], 0) if len(common) else np.zeros(len(tokens), dtype=np.int64)
    return tokens[np.lexsort((tokens, last))[:first]]


def set_keys(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """doc_id, h (the text's hash), n_shingles and k (the set's key) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for part in slices(batch, "x", SLICE) for s in token_sets(part.column("x"), n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64())], names=["doc_id", "h", "n_shingles", "k"])

    return over_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("x")), run, "doc_id long, h long, n_shingles long, k long")


def common_tokens(docs: DataFrame, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The COMMON most frequent tokens, of those found at least three times in some batch and MIN_COMMON times in all, sorted;
    and the place of each, from 1, the most frequent last.

    Any choice gives the same links: it only says which segments are worth an entry, and in which order prefixes are taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "x", SLICE):
                sets = [t for t in token_sets(part.column("x"), n) if len(t)]
                if sets:
                    token, times = np.unique(np.concatenate(sets), return_counts=True)
                    often = times >= 3
                    yield pa.RecordBatch.from_arrays([pa.array(token[often].astype(np.int64)), pa.array(times[often].astype(np.int64))], names=["token", "times"])

    counted = over_batches(docs.select(F.col(text).alias("x")).where(F.col("x").isNotNull()), run, "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    top = counted.where(F.col("times") >= MIN_COMMON).orderBy(F.col("times").desc(), "token").limit(COMMON)
    tokens = np.array(top.toArrow().sort_by([("times", "descending"), ("token", "ascending")]).column("token").to_pylist(), dtype=np.int64).astype(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], len(tokens) - order


def widths(sets: int, tokens: int) -> tuple[int, int]:
    """The bits of an entry and the bytes of a node that keep chance meetings under a thousandth of the sets."""
    entries_, sets = max(tokens + 8 * sets, 2), max(sets, 1)
    bits = math.ceil(2 * math.log2(entries_) - math.log2(sets) + 9)
    return min(max(bits, 40), 64), min(max(math.ceil((math.log2(2 * sets) + 10) / 8), 4), 8)


def _blocks(sig: np.ndarray, node: np.ndarray, bucket: np.ndarray, node_bytes: int) -> pa.RecordBatch:
    """Sorted entries and their nodes, a row for each bucket: the first entry, the differences of the next ones, the nodes."""
    head = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    step = np.diff(sig, prepend=sig[:1])
    step[head] = 0
    gaps = step // np.uint64(_GAP)  # a difference of four bytes and more is led by so many marks
    size = gaps.astype(np.int64) + 1
    size[head] = 0
    steps = np.full(int(size.sum()), _GAP, dtype=np.uint32)
    ends = np.cumsum(size)
    rest = size > 0
    steps[ends[rest] - 1] = (step % np.uint64(_GAP))[rest]
    at = np.append(head, len(sig))
    step_at = np.append(0, ends)[at]
    blob = lambda data, offsets: pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data)])
    nodes = np.ascontiguousarray(node.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :node_bytes]).tobytes()
    return pa.RecordBatch.from_arrays([pa.array(bucket[head].astype(np.int64)), pa.array(sig[head].view(np.int64)), blob(steps.tobytes(), step_at * 4), blob(nodes, at * node_bytes)], names=_BLOCK)


_BLOCK = ["bucket", "first", "steps", "nodes"]


def _read(first: int, steps: bytes, nodes: bytes, node_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries and nodes of a block."""
    step = np.frombuffer(steps, dtype=np.uint32)
    sig = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(step, dtype=np.uint64)]) + np.uint64(first & (1 << 64) - 1)
    if len(step) and step.max() == _GAP:
        sig = sig[np.concatenate([[True], step != _GAP])]
    wide = np.zeros((len(sig), 8), dtype=np.uint8)
    wide[:, :node_bytes] = np.frombuffer(nodes, dtype=np.uint8).reshape(-1, node_bytes)
    return sig, wide.view("<u8")[:, 0]


def _forest(links: np.ndarray) -> np.ndarray:
    """Links that connect the same nodes: of each node to the smallest one that it is connected with, so fewer than nodes."""
    nodes, at = np.unique(links, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while not np.array_equal(root, after := root[root]):
            root = after
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    moved = root != np.arange(len(nodes))
    return np.stack([nodes[moved], nodes[root[moved]]], axis=1)


def _led(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each entry in order, for each the smallest node that its nodes are connected with here, and links of the other nodes to those."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    head = np.concatenate([[True], sig[1:] != sig[:-1]])
    first = np.repeat(node[head], np.diff(np.append(np.flatnonzero(head), len(sig))))
    apart = first != node
    links, leader = _forest(np.stack([node[apart], first[apart]], axis=1)), node[head]
    if not len(links):
        return sig[head], leader, links
    at = np.minimum(np.searchsorted(links[:, 0], leader), len(links) - 1)
    return sig[head], np.where(links[at, 0] == leader, links[at, 1], leader), links


def _thinned(found: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Links that connect what all found links connect, as a, b; so many are held at most that memory is bounded."""

    def told(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, i].astype("<u8").view(np.int64)) for i in (0, 1)], names=["a", "b"])

    links, many = [], 0
    for more in found:
        links.append(more)
        many += len(more)
        if many >= HELD_LINKS:
            links = [_forest(np.concatenate(links))]
            many = len(links[0])
            if 2 * many >= HELD_LINKS:
                yield told(links[0])
                links, many = [], 0
    if many:
        yield told(_forest(np.concatenate(links)))


def _met(rows: DataFrame, index: Callable, number: Callable, sets: int, tokens: int, bits: int, node_bytes: int) -> DataFrame:
    """Links a, b that connect the nodes whose entries meet: in each task every node to the smallest that it is connected with there.

    So a group of like sets has a link or two for a set, not one for each of its entries' leaders.

    The tasks' links are dealt by their greater node and thinned once more.

    index: of batches of rows, the entries of each set and whose they are; number: the nodes of a list of the latter.
    """
    many = tokens + 8 * sets
    # every task sends a row to each bucket: few entries are not dealt to many
    buckets = max(min(16 * MEET_TASKS, many // FEW_ENTRIES), many // MET_ENTRIES, 1)
    cut = np.uint64(64 - bits), np.uint64(64 - 8 * node_bytes)

    def sent(sigs: list[np.ndarray], nodes: list, counts: list[int]) -> Iterator[pa.RecordBatch]:
        node = np.repeat(number(np.array(nodes, dtype=np.int64)).view(np.uint64) >> cut[1], counts)
        sig, node, links = _led(np.concatenate(sigs).view(np.uint64) >> cut[0], node)
        top = sig >> np.uint64(bits - 32)
        yield _blocks(sig, node, top * np.uint64(buckets) >> np.uint64(32), node_bytes)
        parts = [links[i : i + 4096] for i in range(0, len(links), 4096)]
        if parts:
            deal = [int(x[0, 0]) % buckets for x in parts]
            yield pa.RecordBatch.from_arrays([pa.array(deal, pa.int64()), pa.array([None] * len(parts), pa.int64()), pa.array([None] * len(parts), pa.binary()), pa.array([x.astype("<u8").tobytes() for x in parts], pa.binary())], names=_BLOCK)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, nodes, counts, many = [], [], [], 0
        for e, node in index(batches):
            sigs.append(e)
            nodes.append(node)
            counts.append(len(e))
            many += len(e)
            if many >= SENT_ENTRIES:
                yield from sent(sigs, nodes, counts)
                sigs, nodes, counts, many = [], [], [], 0
        if many:
            yield from sent(sigs, nodes, counts)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[np.ndarray]:
            now, held = None, []
            for batch in batches:
                for bucket, first, steps, nodes in zip(*(batch.column(c).to_pylist() for c in _BLOCK), strict=True):
                    if bucket != now and held:
                        yield _led(*map(np.concatenate, zip(*held, strict=True)))[2]
                        held = []
                    now = bucket
                    if steps is None:
                        yield np.frombuffer(nodes, dtype="<u8").reshape(-1, 2)
                    else:
                        held.append(_read(first, steps, nodes, node_bytes))
            if held:
                yield _led(*map(np.concatenate, zip(*held, strict=True)))[2]

        return _thinned(found())

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _thinned(np.stack([np.asarray(batch.column(c)).view(np.uint64) for c in ("a", "b")], axis=1) for batch in batches)

    blocks = over_batches(rows, emit, "bucket long, first long, steps binary, nodes binary")
    links = over_batches(blocks.repartition(MEET_TASKS, "bucket").sortWithinPartitions("bucket"), meet, "a long, b long")
    return over_batches(links.repartition("a"), again, "a long, b long")


def candidate_links(docs: DataFrame, text: str, n: int, percent: int, sets: int, tokens: int, common: np.ndarray) -> DataFrame:
    """Links a, b between nodes (a set in a group, cut to the width of a node) whose entries meet, directly or by others."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, tuple[int, int]]]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "x", SLICE):
                for found in token_sets(part.column("x"), n):
                    if not len(found) or (key := set_key(found)) in seen:
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(key)
                    band = int(np.searchsorted(bands(percent), len(found)))
                    for group in (band, band + 1):
                        yield entries(found, group, percent, common), (key, group)

    rows = docs.select(F.col(text).alias("x")).where(F.col("x").isNotNull())
    return _met(rows, index, lambda nodes: node_of(*nodes.T), sets, tokens, *widths(sets, tokens))


def prefix_links(rows: DataFrame, n: int, percent: int, sets: int, tokens: int, common: np.ndarray, place: np.ndarray) -> DataFrame:
    """rows: node, cluster, x (a text with the node's set). Links a, b between nodes of a cluster whose prefixes meet, directly or by others."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
        for batch in batches:
            for part in slices(batch, "x", SLICE):
                found = token_sets(part.column("x"), n)
                for node, cluster, own in zip(part.column("node").to_pylist(), part.column("cluster").to_pylist(), found, strict=True):
                    of_cluster = np.uint64(cluster & (1 << 64) - 1)
                    yield mixed(prefix(own, percent, common, place) * _ODD[0] + of_cluster).astype(np.int64), node

    return _met(rows, index, lambda nodes: nodes, sets, tokens, widths(sets, tokens)[0], 8)


def _verified(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """rows: task, side, k, copies, band, group, x (a text with this set). Links that connect the sets of a task, and links counted per set.

    Of a pair only the group of the larger set's band counts, so each pair is told once.
    """

    def verify(sets: list[dict]) -> Iterator[tuple[int, int, int]]:
        sets.sort(key=lambda r: (len(r["tokens"]), r["k"]))
        m = len(sets)
        tokens = [r["tokens"] for r in sets]
        size = np.array([len(t) for t in tokens])
        distinct, index = np.unique(np.concatenate(tokens), return_inverse=True)
        starts = np.cumsum(size) - size
        band, side, key, copies = (np.array([r[c] for r in sets]) for c in ("band", "side", "k", "copies"))
        group, two = sets[0]["group"], len({r["side"] for r in sets}) > 1
        mark = np.zeros(len(distinct), dtype=np.int64)
        degree = np.zeros(m, dtype=np.int64)
        parent = list(range(m))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i in range(m - 1):
            # partners are larger (or equal and later), near enough in size, of the group's upper band
            j0, j1 = i + 1, int(np.searchsorted(size, 100 * size[i] // percent, side="right"))
            if j1 <= j0:
                continue
            own = index[starts[i] : starts[i] + size[i]]
            mark[own] = 1
            common = np.add.reduceat(mark[index[starts[j0] : starts[j1 - 1] + size[j1 - 1]]], starts[j0:j1] - starts[j0])
            mark[own] = 0
            linked = 100 * common >= percent * (size[i] + size[j0:j1] - common)
            linked &= band[j0:j1] == group
            if two:
                linked &= side[j0:j1] != side[i]
            for j in (np.flatnonzero(linked) + j0).tolist():
                degree[i] += copies[j]
                degree[j] += copies[i]
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    yield int(key[i]), int(key[j]), 0
        for i in np.flatnonzero(degree).tolist():
            yield int(key[i]), 0, int(degree[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []

        def told(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
            a, b, links = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], names=["a", "b", "links"])

        out: list[tuple[int, int, int]] = []
        for batch in batches:
            for part in slices(batch, "x", SLICE):
                found = token_sets(part.column("x"), n)
                for r, tokens in zip(part.drop_columns(["x"]).to_pylist(), found, strict=True):
                    if r["task"] != task:
                        if len(held) > 1:
                            out += verify(held)
                        task, held = r["task"], []
                    if not held or held[-1]["k"] != r["k"]:  # repeated rows of a document come one after another
                        held.append(r | {"tokens": tokens})
            if len(out) > 10_000:
                yield told(out)
                out = []
        if len(held) > 1:
            out += verify(held)
        if out:
            yield told(out)

    return over_batches(rows.repartition("task").sortWithinPartitions("task", "k"), run, "a long, b long, links long")


def _parted(placed: DataFrame, whole: DataFrame, chosen: DataFrame, n: int, percent: int, common: np.ndarray, place: np.ndarray) -> DataFrame:
    """placed (with small, that of its cluster) with the sets of clusters larger than a block in clusters of their own by prefixes; those that meet no other go."""
    sets, tokens = whole.where("NOT small").agg(F.sum("all_sets"), F.sum("all_tokens")).head()
    plain = placed.where("small").drop("small")
    if not sets:
        return plain
    large = placed.where("NOT small").drop("small").withColumn("node", F.xxhash64("k", "cluster"))
    rows = chosen.join(large.select("rep", "h", "node", "cluster").hint("merge"), ["rep", "h"]).select("node", "cluster", "x")
    parts = components(prefix_links(rows, n, percent, sets, tokens, common, place), "a", "b")
    # nodes of different clusters may have one number
    parted = large.join(parts, "node").withColumn("cluster", F.xxhash64("component", "cluster")).drop("node", "component")
    return plain.unionByName(parted.select(*plain.columns))


def _main_classes(parted: DataFrame, chosen: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """parted with main: whether a set of a cluster of many blocks is known to be in the cluster's largest class; and the links that say so.

    The sets are dealt to blocks of like sizes three times, and each block is verified within itself, which costs so much
    for a set whatever the cluster's size. Two sets of one class needn't meet, so block pairs remain for the others only.
    """
    blocks = F.greatest(F.count("*") / BLOCK_SETS, F.sum("size") / BLOCK_TOKENS)
    large = written(parted.groupBy("cluster").agg(blocks.alias("blocks")).where(F.col("blocks") > MANY_BLOCKS).select("cluster"))
    if large.isEmpty():
        return parted.withColumn("main", F.lit(False)), None
    within = written(parted.join(large, "cluster"))
    tasks = None
    for i, step in enumerate((F.col("step"), F.floor(F.col("step") / 2), F.floor((F.col("step") + 1) / 2))):
        now = within.withColumn("like", step.cast("int"))
        salts = now.groupBy("cluster", "like").agg(F.ceil(blocks).cast("int").alias("salts"))
        now = now.join(salts, ["cluster", "like"])
        task = F.xxhash64("cluster", F.lit(i), "like", F.pmod(F.xxhash64("k", F.lit(i)), "salts"))
        now = now.select("k", "rep", "h", "copies", "band", "group", task.alias("task"), F.lit(0).alias("side"))
        tasks = now if tasks is None else tasks.unionByName(now)
    tasks = written(tasks)
    found = written(_verified(chosen.join(tasks.hint("merge"), ["rep", "h"]).select("task", "side", "k", "copies", "band", "group", "x"), n, percent).where("links = 0"))
    known = components(found, "a", "b").select(F.col("node").alias("k"), "component")
    sized = within.join(known, "k").groupBy("cluster", "component").agg(F.count("*").alias("sets"))
    largest = sized.groupBy("cluster").agg(F.max_by("component", "sets").alias("component"))
    main = written(within.select("k", "cluster").join(known, "k").join(largest, ["cluster", "component"]).select("k", "cluster").withColumn("main", F.lit(True)))
    marked = written(parted.join(main, ["k", "cluster"], "left").select(*parted.columns, F.coalesce("main", F.lit(False)).alias("main")))
    discard(large, within, tasks, main)
    return marked, found


def _classes(docs: DataFrame, doc_id: str, text: str, n: int, percent: int, degrees: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, h, n_shingles, k), and of each set k, n_shingles, its class (the smallest key of its sets), the class's least_id, and links.

    Without degrees links is not the number of a set's links, and pairs within what is known to be one class aren't verified.
    """
    keys = written(set_keys(docs, doc_id, text, n))
    sound = docs.where(F.col(doc_id).isNotNull())
    # a set's text is that of its row with the smallest id
    sets = keys.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("h", "doc_id").alias("h"), F.count("*").alias("copies"))
    sets = written(sets)
    many, tokens = sets.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).head()
    common, place = common_tokens(sound, text, n)
    candidates = written(candidate_links(sound, text, n, percent, many, tokens, common))
    clusters = written(components(candidates, "a", "b"))
    cut = np.uint64(64 - 8 * widths(many, tokens)[1])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each set's node in either group of its band."""
        for batch in batches:
            k, size = np.asarray(batch.column("k")), np.asarray(batch.column("n_shingles"))
            band = np.searchsorted(bands(percent), size)
            for more in (0, 1):
                node = (node_of(k, band + more).view(np.uint64) >> cut).view(np.int64)
                own = [batch.column(c) for c in ("k", "rep", "h", "copies", "n_shingles")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(band.astype(np.int32)), pa.array((band + more).astype(np.int32)), pa.array(node)], names=["k", "rep", "h", "copies", "size", "band", "group", "node"])

    placed = over_batches(sets.select("k", "rep", "h", "copies", "n_shingles"), nodes, "k long, rep long, h long, copies long, size long, band int, group int, node long").join(clusters, "node")
    # nodes of different groups may have one number
    placed = placed.withColumn("cluster", F.xxhash64("component", "group")).drop("node", "component")
    # blocks of like sizes; the step is a quarter of the linked sizes' ratio
    step = F.floor(F.log("size") * (4 / math.log(100 / percent))).cast("int")
    placed = written(placed.withColumn("step", step))
    # pairs count in the group of the larger set's band: a cluster without such a set has none of its own
    totals = [F.count("*").alias("all_sets"), F.sum("size").alias("all_tokens"), F.max((F.col("band") == F.col("group")).cast("int")).alias("any_upper")]
    small = (F.col("all_sets") <= BLOCK_SETS) & (F.col("all_tokens") <= BLOCK_TOKENS)
    whole = written(placed.groupBy("cluster").agg(*totals).where("any_upper = 1 AND all_sets > 1").withColumn("small", small))
    # every text moves once, at any size: these sets grow with the table, so they aren't sent to all
    texts = sound.select(F.col(doc_id).cast("long").alias("rep"), F.xxhash64(text).alias("h"), F.col(text).alias("x"))
    chosen = written(texts.join(placed.join(whole, "cluster").select("rep", "h").hint("merge"), ["rep", "h"], "left_semi"))
    divided = written(_parted(placed.join(whole.select("cluster", "small"), "cluster"), whole, chosen, n, percent, common, place))
    parted, early = (divided.withColumn("main", F.lit(False)), None) if degrees else _main_classes(divided, chosen, n, percent)
    counted = parted.groupBy("cluster", "step", "main").agg(F.count("*").alias("sets"), F.sum("size").alias("tokens"))
    counted = written(counted.withColumn("salts", F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("tokens") / BLOCK_TOKENS)).cast("int")))
    worth = parted.groupBy("cluster").agg(*totals).where("any_upper = 1 AND all_sets > 1")
    cells = written(counted.join(worth, "cluster").select("cluster", "step", "main", "salts", small.alias("small")))
    # the blocks of the main class are numbered behind the others of their step
    others = cells.where("NOT main").select("cluster", "step", F.col("salts").alias("before"))
    cells = written(cells.join(others, ["cluster", "step"], "left").withColumn("before", F.when(F.col("main"), F.coalesce("before", F.lit(0))).otherwise(0)))
    blocks = cells.where(~F.col("small")).withColumn("salt", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("salts") - 1))).select("cluster", "step", "main", "salt")
    other = blocks.select("cluster", F.col("step").alias("step2"), F.col("main").alias("main2"), F.col("salt").alias("salt2"))
    # a block meets itself and the later blocks that hold sizes near enough, of its own step and the next five
    near = blocks.withColumn("ahead", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("step2", F.col("step") + F.col("ahead"))
    near = near.join(other, ["cluster", "step2"]).where("(ahead > 0 OR salt2 >= salt) AND NOT (main AND main2)")
    near = near.withColumn("task", F.xxhash64("cluster", "step", "salt", "step2", "salt2"))
    alone = F.col("step").eqNullSafe(F.col("step2")) & F.col("salt").eqNullSafe(F.col("salt2"))
    meets = written(near.select("cluster", "step", "salt", "task", F.lit(0).alias("side")).unionByName(near.where(~alone).select("cluster", F.col("step2").alias("step"), F.col("salt2").alias("salt"), "task", F.lit(1).alias("side"))))
    dealt = parted.join(cells, ["cluster", "step", "main"]).withColumn("salt", (F.col("before") + F.pmod(F.xxhash64("k"), F.col("salts"))).cast("int"))
    own = ["k", "rep", "h", "copies", "size", "band", "group"]
    tasks = dealt.where("small").select(*own, F.col("cluster").alias("task"), F.lit(0).alias("side"))
    tasks = written(tasks.unionByName(dealt.where("not small").join(meets, ["cluster", "step", "salt"]).select(*own, "task", "side")))
    moved = tasks.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0]
    rounds = max(1, math.ceil(moved / max(tokens, ROUND_TOKENS)))
    found = [] if early is None else [early]
    for i in range(rounds):
        now = tasks.where(F.pmod("task", F.lit(rounds)) == i).hint("merge")
        found.append(written(_verified(chosen.join(now, ["rep", "h"]).select("task", "side", "k", "copies", "band", "group", "x"), n, percent)))
    discard(candidates, clusters, placed, whole, chosen, divided, counted, cells, meets, tasks)
    tables, found = found, reduce(DataFrame.unionByName, found)
    linked = components(found.where("links = 0"), "a", "b").select(F.col("node").alias("k"), "component")
    degrees = found.where("links > 0").groupBy(F.col("a").alias("k")).agg(F.sum("links").alias("links"))
    of_set = sets.join(linked, "k", "left").join(degrees, "k", "left").select("k", "n_shingles", "rep", F.coalesce("component", "k").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    of_set = written(of_set)
    least = written(of_set.groupBy("class").agg(F.min("rep").alias("least_id"), F.count("*").alias("n_")))
    classes = written(attached(of_set.drop("rep"), least, "class", many))
    discard(*tables, sets, of_set, least)
    return keys, classes


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id and n_links (rows linked to it, copies included)."""
    keys, classes = _classes(docs, doc_id, text, n, percent)
    whose = keys.join(classes, ["k", "n_shingles"], "left")
    own = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return whose.select("doc_id", "n_shingles", F.when(own, F.col("least_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(own, F.col("links")).otherwise(0).cast("long").alias("n_links"))


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near duplicates: of each class the row with the smallest id, once. Rows without an id or without words stay."""
    keys, classes = _classes(docs, doc_id, text, n, percent, degrees=False)
    own = keys.where("n_shingles > 0 AND doc_id IS NOT NULL").join(classes.select("k", "n_shingles", "class", "least_id"), ["k", "n_shingles"])
    # of rows with the smallest id but different texts of the class, the first by the texts' hashes
    first = own.where("doc_id = least_id").groupBy("class").agg(F.min("doc_id").alias("id_"), F.min("h").alias("h_")).select("id_", "h_")
    first = written(first)
    plain = keys.where("n_shingles = 0 OR doc_id IS NULL")
    named = docs.withColumn("h_", F.xxhash64(text)).withColumn("id_", F.col(doc_id).cast("long"))
    kept = named.join(first, ["id_", "h_"], "left_semi").dropDuplicates(["id_", "h_"])
    if plain.isEmpty():
        return kept.select(*docs.columns)
    empty = written(plain.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id_"), F.col("h").alias("h_")).distinct())
    return kept.unionByName(named.join(empty, ["id_", "h_"], "left_semi")).unionByName(named.where("id_ IS NULL")).select(*docs.columns)
