"""Harmonic packing of tokenized documents into sequences of one capacity.

Class ``k`` holds pieces longer than ``capacity / (k + 1)`` and at most ``capacity / k`` tokens; each of its bins takes ``k``
pieces, whatever their exact length. Documents are cut so that their pieces nearly fill their class: whole sequences first,
then, for the rest, the largest class length that fits until the last piece wastes at most ``tolerance`` of its share. Every
worker fills the bins of its own documents, so nothing is shuffled; the pieces of the few bins that a worker leaves half
filled are strung together and cut at powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame

from trialframe.llm.common import batches, give_back, id_and_text, worker_state

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, class int"
#: bytes of lines and their ids that a worker remembers
MEMO_BYTES = 24 << 20
# the split of text before merging, as byte-level BPE files that use their own expression define it
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_encoder(path: str):
    """A function from texts to arrays of ids.

    A byte-level BPE whose merges make their tokens in the order of ids gives the same ids as a rank table, which
    encodes several times faster; any other file is run by ``tokenizers`` itself.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
             and before.get("use_regex", True) and not spec.get("normalizer") and not model.get("dropout")
             and not model.get("byte_fallback") and not model.get("ignore_merges"))
    if plain:
        vocab, alphabet = model["vocab"], byte_alphabet()
        merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
        plain = all(c in vocab for c in alphabet) and merged == sorted(merged) and merged[:1] > [max(vocab[c] for c in alphabet)]
    if not plain:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [np.array(e.ids, dtype="<u4") for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    import tiktoken

    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if token not in special}
    table = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    memo: dict[str, bytes] = {}
    held = 0
    # the pre-tokenizer always cuts between a visible character and a single line break before another one
    lines = re.compile(r"(?<=\S)(?=\n\S)")

    def encode(texts: list[str]) -> list[np.ndarray]:
        nonlocal held
        out = []
        for text in texts:
            parts = []
            for line in lines.split(text):
                ids = memo.get(line)
                if ids is None:
                    ids = np.array(table.encode_ordinary(line), dtype="<u4").tobytes()
                    if len(line) <= 4096:
                        # two objects and their place in the dictionary take about 200 bytes
                        held += len(line) + len(ids) + 200
                        if held > MEMO_BYTES:
                            memo.clear()
                            held = len(line) + len(ids) + 200
                        memo[line] = ids
                parts.append(ids)
            out.append(np.frombuffer(b"".join(parts), dtype="<u4"))
        return out

    return encode


def class_sizes(capacity: int) -> list[int]:
    """Documents per bin of each class: every count up to 16, then steps of a quarter up to single tokens."""
    counts, k = [], 1
    while k <= capacity:
        counts.append(k)
        k += max(1, k // 4) if k >= 16 else 1
    return counts


def cuts(rest: int, capacity: int, counts: list[int], tolerance: float) -> list[tuple[int, int]]:
    """Lengths and classes of the pieces of a document's last ``rest`` tokens."""
    out = []
    while rest:
        k = max(c for c in counts if rest * c <= capacity)
        if capacity - rest * k > tolerance * capacity:
            k = min(c for c in counts if capacity // c <= rest)
        length = min(rest, capacity // k)
        out.append((length, k))
        rest -= length
    return out


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
                   end_id: int | None = 1, tolerance: float = 0.01) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset, class``.

    ``ids`` are the piece's tokens as little-endian unsigned 32-bit numbers; pieces of a sequence lie gapless from
    offset 0. A sequence whose length is a power of two stands as it is; any other is to be padded to ``capacity``.
    A null text counts as empty (its only token is ``end_id``; without one it has no piece), a null id stays null.
    Repeated rows are packed once each, ties need no order, an empty table gives no rows, and other columns are ignored.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    counts = class_sizes(capacity)

    def fill(stream):
        state = worker_state()
        give_back()
        if ("encoder", tokenizer) not in state:
            state["encoder", tokenizer] = load_encoder(tokenizer)
            give_back()
        encode = state["encoder", tokenizer]
        end = np.array([] if end_id is None else [end_id], dtype="<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        plan: dict[int, list] = {}
        bins: dict[int, list] = {k: [] for k in counts}
        rows: list[tuple] = []

        def close(pieces: list, k: int) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, tokens in pieces:
                rows.append((doc, start, len(ids) // 4, ids, tokens, sequence, offset, k))
                offset += len(ids) // 4
            sequence += 1

        def flush():
            names = [f.split()[0] for f in PIECES.split(", ")]
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3 + [pa.int32()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            out = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=names)
            rows.clear()
            return out

        for ids, texts in batches(stream):
            for doc, tokens in zip(ids, encode([t.decode("utf-8", "replace") for t in texts]), strict=True):
                data = tokens.tobytes() + end
                n = len(data) // 4
                whole = n - n % capacity
                for start in range(0, whole, capacity):
                    close([(doc, start, data[4 * start: 4 * (start + capacity)], n)], 1)
                start = whole
                if n - whole not in plan:
                    plan[n - whole] = cuts(n - whole, capacity, counts, tolerance)
                for length, k in plan[n - whole]:
                    bins[k].append((doc, start, data[4 * start: 4 * (start + length)], n))
                    start += length
                    if len(bins[k]) == k:
                        close(bins[k], k)
                        bins[k] = []
            yield flush()
        yield from tail(bins, close, flush)

    def tail(bins, close, flush):
        """String the pieces of unfinished bins together and cut them at powers of two."""
        left = [p for k in counts for p in bins[k]]
        total = sum(len(p[2]) // 4 for p in left)
        sizes = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if total % capacity >> b & 1]
        at, begin = 0, 0
        for size in sizes:
            room, pieces = size, []
            while room:
                doc, start, ids, tokens = left[at]
                length = min(room, len(ids) // 4 - begin)
                pieces.append((doc, start + begin, ids[4 * begin: 4 * (begin + length)], tokens))
                room, begin = room - length, begin + length
                if begin == len(ids) // 4:
                    at, begin = at + 1, 0
            close(pieces, 0)
        yield flush()

    return id_and_text(docs, id_col, text_col).mapInArrow(fill, PIECES)
