import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trialframe.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def ids_of(b):
    return [int.from_bytes(b[i: i + 4], "little") for i in range(0, len(b), 4)]


def test_ids_equal_the_tokenizer():
    texts = ["", " ", "  a\n\nb  \n", "\n", "a \n b", "x\n\n\ny z's 'S's  ", "a\x85\nb\x1c\nc", "<|endoftext|>\n<|endoftext|>",
             "日本 éß\n123 4a'll I'm\r\nok \n—", "tab\tin\nline\n\tnext\n next", " \nx \ny"]
    t = plain()
    assert [list(x) for x in packing.load_encoder(PATH)(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("capacity", [64, 2048])
def test_every_id_lies_in_one_piece(docs, rows, capacity):
    pieces = packing.pack_documents(docs, PATH, capacity=capacity).collect()
    t, wanted = plain(), {}
    for r in rows:
        wanted.setdefault((r[0], tuple(t.encode(r[1] or "", add_special_tokens=False).ids + [1])), 0)
        wanted[r[0], tuple(t.encode(r[1] or "", add_special_tokens=False).ids + [1])] += 1
    for (doc, ids), times in wanted.items():
        count = [0] * len(ids)
        for p in pieces:
            if p.doc_id == doc:
                assert ids_of(p.ids) == list(ids[p.start: p.start + p.length]) and p.doc_tokens == len(ids)
                for i in range(p.start, p.start + p.length):
                    count[i] += 1
        assert set(count) == {times}
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length, p["class"]))
    padding = 0
    for parts in by.values():
        end = 0
        for offset, length, k in sorted(parts):
            assert offset == end
            end += length
            assert k == 0 or capacity // (k + 1 if k < 16 else 2 * k) <= length <= capacity // k
        assert end <= capacity
        padding += 0 if end & (end - 1) == 0 else capacity - end
        assert all(k == 0 or len(parts) == k for _, _, k in parts)
    assert padding <= 0.02 * sum(p.length for p in pieces)


def test_no_rows_and_no_end(nothing, docs):
    assert packing.pack_documents(nothing, PATH).count() == 0
    bare = packing.pack_documents(docs.where("text is null or text = ''"), PATH, end_id=None)
    assert bare.count() == 0


def test_bins_are_filled_without_a_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert "Exchange" not in packing.pack_documents(docs, PATH)._jdf.queryExecution().toString()
