"""Removal of repeated byte strings by external induced sorting of sparse suffixes.

Sorting one tuple per byte takes more than thirty times the input on disk, so only suffixes at anchors are sorted: positions
that the text itself picks (the smallest hash of a short string within each window), so that equal windows hold equal
anchors. Spark's shuffle is the external queue: suffix tuples go to the bucket of the string at their anchor, are sorted there by
what follows, with the lengths of common prefixes between neighbours, and induce the order of the suffixes that begin one
byte further left, again and again: a stable sort by the byte in front keeps the order, and a minimum over the common
prefixes carries their lengths on. A window is repeated if its suffix agrees with a neighbour over the whole window.

Suffixes whose anchor string occurs once never travel, contexts that occur more than once as a whole are settled by
their digest and send one representative, and anchors with very many different contexts (the edges of very common
passages) are settled window by window: each distinct window goes to a bucket of its own digest.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from trialframe.llm.chunks import chunked, compare, finish, parts_by_bucket, resend, send
from trialframe.llm.common import mixed
from trialframe.llm.substring_dedup import covered, spans

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: text bytes whose suffixes share a bucket, and the least number of buckets
BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 64
#: different contexts of one anchor string in one chunk, and in all, above which windows are settled one by one
CHUNK_CONTEXTS, ALL_CONTEXTS = 16, 256
#: text bytes whose anchors are looked for at a time, and suffixes that are induced at a time
SEGMENT_BYTES, SORT_ROWS = 1 << 20, 16_384
#: no byte of valid UTF-8: ends a context
STOP = 255
UNIQUE, ALONE, REPEATED, SENT, CROWDED = 0, 1, 2, 3, 4


def anchors(text: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """``key, at, low, high``: anchors of the concatenated texts and the first and last window that each stands for."""
    n, steps = len(text), window - gram + 1
    if n < window:
        return tuple(np.array([], dtype=t) for t in (np.uint64, np.int64, np.int64, np.int64))
    base = 0x9E3779B97F4A7C15
    power = np.empty(n, dtype=np.uint64)
    power[0] = 1
    power[1:] = np.uint64(base)
    power = np.multiply.accumulate(power)
    codes = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(codes[text] * power, dtype=np.uint64)])
    # the string's polynomial, moved to one common power by the inverse of its first power
    inverse = np.empty(n, dtype=np.uint64)
    inverse[0] = 1
    inverse[1:] = np.uint64(pow(base, -1, 1 << 64))
    key = mixed((sums[gram:] - sums[:-gram]) * np.multiply.accumulate(inverse)[: n - gram + 1])
    owner_end = np.repeat(ends, np.diff(ends, prepend=0))
    value = (key >> np.uint64(32) << np.uint64(32)) | np.arange(len(key), dtype=np.uint64)
    # smallest value of every run of ``steps``, from running minima of blocks of that size in both directions
    pad = -len(value) % steps
    blocks = np.concatenate([value, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, steps)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - window + 1)
    whole = starts + window <= owner_end[: n - window + 1]
    least = (np.minimum(back[: n - window + 1], ahead[steps - 1: steps - 1 + n - window + 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts, least = starts[whole], least[whole]
    if not len(starts):
        return key[:0], starts, starts, starts
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.append(first[1:], len(starts)) - 1
    return key[least[first]], least[first], starts[first], starts[last]


def all_anchors(texts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of a chunk, found some megabytes at a time; positions count from the chunk's first byte."""
    found, begin, shift = [], 0, 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= SEGMENT_BYTES):
            size += len(texts[end])
            end += 1
        part = np.frombuffer(b"".join(texts[begin:end]), dtype=np.uint8)
        key, *places = anchors(part, np.cumsum([len(t) for t in texts[begin:end]]), window, gram)
        found.append((key, *(p + shift for p in places)))
        begin, shift = end, shift + size
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def contexts(texts: list[bytes], window: int, gram: int) -> dict:
    """The anchors of a chunk and their distinct contexts, in the order in which they are sent.

    A context is the text from an anchor's first window to the end of its last one, with the anchor's place in it.
    """
    key, at, low, high = all_anchors(texts, window, gram)
    whole = b"".join(texts)
    digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(whole[a:b], x - a) for a, b, x in
                                    zip(low.tolist(), (high + window).tolist(), at.tolist(), strict=True)), dtype="<u8").reshape(-1, 2)
    order = np.lexsort((digest[:, 1], digest[:, 0], key))
    k, d = key[order], digest[order]
    fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1]).any(axis=1)])[: len(order)]
    one = order[fresh]
    of = np.empty(len(order), dtype=np.int64)
    of[order] = np.cumsum(fresh) - 1
    return {"whole": whole, "at": at, "low": low, "high": high, "of": of, "one": one, "key": key[one], "digest": digest[one],
            "twice": np.bincount(of, minlength=len(one)) > 1}


def crowded_here(found: dict) -> np.ndarray:
    """Contexts whose anchor string has too many others in this chunk."""
    _, back, n = np.unique(found["key"], return_inverse=True, return_counts=True)
    return n[back] > CHUNK_CONTEXTS


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (key % np.uint64(buckets)).astype(np.int64)


def context_states(parts: dict[int, tuple]) -> dict[int, tuple]:
    """What to do with each context that the chunks sent (a bucket's first round)."""
    key, one, two, twice = (np.concatenate([p[i] for p in parts.values()]) for i in range(4))
    crowd = np.unique(np.concatenate([p[4] for p in parts.values()]))
    order = np.lexsort((two, one, key))
    k, a, b = key[order], one[order], two[order]
    fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(k)]
    context = np.cumsum(fresh) - 1
    often = np.bincount(context, weights=1 + twice[order]) > 1
    name = np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
    group = np.cumsum(name) - 1
    different = np.bincount(group[fresh])[group] if len(k) else group
    state = np.where(often[context], np.where(fresh & (different > 1), SENT, REPEATED), np.where(different > 1, ALONE, UNIQUE))
    state[(different > ALL_CONTEXTS) | np.isin(k, crowd)] = CROWDED
    back = np.empty(len(k), dtype=np.uint8)
    back[order] = state
    ends = np.cumsum([len(p[0]) for p in parts.values()])
    return {c: (x,) for c, x in zip(parts, np.split(back, ends[:-1]), strict=True)}


def range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Smallest of ``values[first..last]`` for each pair, from a table of runs of powers of two."""
    out, span = np.empty(len(first), dtype=values.dtype), last - first + 1
    level, table = 0, values
    power = np.zeros(len(first), dtype=np.int64)
    power[:] = np.floor(np.log2(span))
    for level in range(int(power.max()) + 1 if len(first) else 0):
        if level:
            half = 1 << (level - 1)
            table = np.minimum(table[:-half], table[half:])
        at = power == level
        out[at] = np.minimum(table[first[at]], table[last[at] - (1 << level) + 1])
    return out


def induce(group: np.ndarray, right: np.ndarray, left: np.ndarray, least: np.ndarray, most: np.ndarray, window: int) -> np.ndarray:
    """Windows that other suffixes of the group share: one row per suffix, one column per byte that they begin left of the anchor.

    ``right`` holds what follows each anchor (``window`` bytes), ``left`` what stands before it, nearest first; both end in
    ``STOP``. ``least`` and ``most`` bound the windows that a suffix stands for.
    """
    shared = np.zeros((len(group), left.shape[1] + 1), dtype=bool)
    rows = np.argsort(right.copy().view(f"S{window}").ravel(), kind="stable")
    rows = rows[np.argsort(group[rows], kind="stable")]
    sorted_right = right[rows]
    differs = sorted_right[1:] != sorted_right[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), window)
    cls = group[rows]
    # lengths of the prefix that each suffix has in common with the one before it in its class
    prefix = np.concatenate([[0], np.where(cls[1:] == cls[:-1], common, 0)]).astype(np.int32)
    for step in range(left.shape[1] + 1):
        need = window - step
        hit = prefix >= need
        hit[:-1] |= prefix[1:] >= need
        own = rows[hit]
        own = own[(least[own] <= step) & (step <= most[own])]
        shared[own, step] = True
        if step == left.shape[1]:
            break
        front = left[rows, step]
        live = front != STOP
        order = np.lexsort((front, cls))
        order = order[live[order]]
        same = (cls[order][1:] == cls[order][:-1]) & (front[order][1:] == front[order][:-1])
        member = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(order) else same
        if not member.any():
            break
        pairs = np.flatnonzero(same)
        carried = np.zeros(len(order), dtype=np.int32)
        carried[pairs + 1] = range_minima(prefix, order[pairs] + 1, order[pairs + 1])
        # the order inside a class is the old one, so a class is known by its first suffix
        cls = np.cumsum(np.concatenate([[True], ~same]))[member]
        rows, prefix = rows[order][member], carried[member]
    return shared


def windows_of(found: dict, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of the given anchors, and the row of each."""
    n = found["high"][rows] - found["low"][rows] + 1
    shift = np.cumsum(n) - n
    return np.arange(int(n.sum())) + np.repeat(found["low"][rows] - shift, n), np.repeat(np.arange(len(rows)), n)


def window_digests(found: dict, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of crowded contexts: starts, distinct digests in sending order, each start's digest, and whether it is there twice."""
    rows = np.flatnonzero(found["state"][found["of"]] == CROWDED)
    starts, _ = windows_of(found, rows)
    whole = found["whole"]
    digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(whole[p: p + window]) for p in starts.tolist()), dtype="<u8").reshape(-1, 2)
    distinct, of, n = np.unique(digest.view([("a", "<u8"), ("b", "<u8")]).ravel(), return_inverse=True, return_counts=True)
    return starts, distinct, of.ravel(), n > 1


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400, gram: int = 64) -> DataFrame:
    """``doc_id, n_bytes, n_removed, kept, kept_sha256, spans``: one row per row of ``docs``.

    ``spans`` are the maximal runs of removed bytes (first byte and end), ``kept`` the bytes that stay. A byte is removed if a
    string of ``window`` bytes over it starts anywhere else too, in this text or another; strings are judged on the input and
    never cross texts. Null texts count as empty, repeated rows repeat each other's strings, null ids are kept as they
    are, an empty table gives no rows, and other columns are ignored. A window settled by digests is compared by 128 bits.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must lie between 1 and window")
    chunks, size = chunked(docs, id_col, text_col)
    buckets, reach = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)), window - gram

    def by_bucket(found):
        return np.argsort(bucket_of(found["key"], buckets), kind="stable")

    def tell(chunk, ids, texts):
        found = contexts(texts, window, gram)
        crowd, order, out = crowded_here(found), by_bucket(found), {}
        for k, at in parts_by_bucket(bucket_of(found["key"], buckets)[order]):
            rows = order[at]
            calm = rows[~crowd[rows]]
            out[k] = (found["key"][calm], found["digest"][calm, 0], found["digest"][calm, 1], found["twice"][calm], np.unique(found["key"][rows[crowd[rows]]]))
        return out

    def stated(texts, replies):
        found = contexts(texts, window, gram)
        crowd, order = crowded_here(found), by_bucket(found)
        found["state"] = np.full(len(found["one"]), CROWDED, dtype=np.uint8)
        for k, at in parts_by_bucket(bucket_of(found["key"], buckets)[order]):
            rows = order[at]
            found["state"][rows[~crowd[rows]]] = replies[k][0]
        return found, order

    def tell_contexts(chunk, ids, texts, replies):
        found, order = stated(texts, replies)
        whole, out = found["whole"], {}
        go = order[(found["state"][order] == ALONE) | (found["state"][order] == SENT)]
        for k, at in parts_by_bucket(bucket_of(found["key"], buckets)[go]):
            rows = go[at]
            x, low, high = (found[n][found["one"][rows]] for n in ("at", "low", "high"))
            out[k] = [found["key"][rows], x - low, x - high, b"".join(whole[a: b + window] for a, b in zip(low.tolist(), high.tolist(), strict=True))]
        _, distinct, _, twice = window_digests(found, window)
        crowded = bucket_of(distinct["a"], buckets)
        rank = np.argsort(crowded, kind="stable")
        for k, at in parts_by_bucket(crowded[rank]):
            none = [found["key"][:0], found["at"][:0], found["at"][:0], b""]
            out[k] = [*out.get(k, none), distinct[rank[at]], twice[rank[at]]]
        empty = np.empty(0, dtype=[("a", "<u8"), ("b", "<u8")])
        return {k: tuple(v) if len(v) == 6 else (*v, empty, np.empty(0, dtype=bool)) for k, v in out.items()}

    def settle(parts):
        key, before, least = (np.concatenate([p[i] for p in parts.values()]) for i in range(3))
        text = np.frombuffer(b"".join(p[3] for p in parts.values()), dtype=np.uint8)
        # a context is as long as its windows reach: from the first start to the end of the last one
        length = before - least + window
        begin = np.cumsum(length) - length
        anchor, end = begin + before, begin + length
        shared = np.zeros((len(key), reach + 1), dtype=bool)
        order = np.argsort(key, kind="stable")
        names = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.array([], dtype=np.int64)
        a = 0
        while a < len(names):
            # whole groups, as many as are sorted at a time
            b = max(a + 1, int(np.searchsorted(names, names[a] + SORT_ROWS, side="right")) - 1)
            b = len(names) if names[a] + SORT_ROWS >= len(order) else b
            rows = order[names[a]: names[b] if b < len(names) else len(order)]
            right = anchor[rows, None] + np.arange(window)
            left = anchor[rows, None] - 1 - np.arange(reach)
            right = np.where(right < end[rows, None], text[np.minimum(right, len(text) - 1)], STOP).astype(np.uint8)
            left = np.where(left >= begin[rows, None], text[np.maximum(left, 0)], STOP).astype(np.uint8)
            shared[rows] = induce(np.unique(key[rows], return_inverse=True)[1], right, left, least[rows], before[rows], window)
            a = b
        digests = np.concatenate([p[4] for p in parts.values()])
        twice = np.concatenate([p[5] for p in parts.values()])
        _, of = np.unique(digests, return_inverse=True)
        often = (np.bincount(of.ravel(), weights=1 + twice) > 1)[of.ravel()] if len(digests) else twice
        out, i, j = {}, 0, 0
        for c, p in parts.items():
            m, n = len(p[0]), len(p[4])
            out[c] = (np.packbits(shared[i: i + m], axis=1), np.packbits(often[j: j + n]))
            i, j = i + m, j + n
        return out

    def repeated_starts(found, order, replies):
        starts = []
        rows = np.flatnonzero(np.isin(found["state"][found["of"]], (REPEATED, SENT)))
        starts.append(windows_of(found, rows)[0])
        go = order[(found["state"][order] == ALONE) | (found["state"][order] == SENT)]
        shared = np.zeros((len(found["one"]), reach + 1), dtype=bool)
        for k, at in parts_by_bucket(bucket_of(found["key"], buckets)[go]):
            shared[go[at]] = np.unpackbits(replies[k][0], axis=1, count=reach + 1).astype(bool)
        rows = np.flatnonzero(found["state"][found["of"]] == ALONE)
        row, step = np.nonzero(shared[found["of"][rows]])
        starts.append(found["at"][rows][row] - step)
        places, distinct, of, _ = window_digests(found, window)
        crowded = bucket_of(distinct["a"], buckets)
        rank, often = np.argsort(crowded, kind="stable"), np.zeros(len(distinct), dtype=bool)
        for k, at in parts_by_bucket(crowded[rank]):
            often[rank[at]] = np.unpackbits(replies[k][1], count=at.stop - at.start).astype(bool)
        starts.append(places[often[of]] if len(places) else places)
        return np.concatenate(starts)

    def result(ids, texts, states, replies):
        found, order = stated(texts, states)
        gone = covered(len(found["whole"]), repeated_starts(found, order, replies), window)
        out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "kept", "kept_sha256", "spans")}
        begin = 0
        for doc, text in zip(ids, texts, strict=True):
            mask = gone[begin: begin + len(text)]
            begin += len(text)
            first, end = spans(mask)
            kept = np.frombuffer(text, dtype=np.uint8)[~mask].tobytes() if len(first) else text
            for k, v in zip(out, (doc, len(text), int(mask.sum()), kept, hashlib.sha256(kept).hexdigest(),
                                  [{"first": int(x), "end": int(y)} for x, y in zip(first, end, strict=True)]), strict=True):
                out[k].append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))]
        return pa.table({k: pa.array(v, type=t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    states = compare(send(chunks, tell), context_states)
    settled = compare(resend(chunks, states, tell_contexts), settle)
    # both rounds' answers come to the last step; buckets of the second round are told apart by a shift
    replies = states.union(settled.selectExpr("chunk", f"bucket + {buckets} as bucket", "data"))

    def finished(ids, texts, found):
        one = {k: v for k, v in found.items() if k < buckets}
        return result(ids, texts, one, {k - buckets: v for k, v in found.items() if k >= buckets})

    return finish(chunks, replies, finished,
                  "doc_id long, n_bytes long, n_removed long, kept binary, kept_sha256 string, spans array<struct<first:long,end:long>>")
