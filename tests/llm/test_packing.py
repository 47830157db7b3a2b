import collections
import zlib

import numpy as np
import public_tokenizers
from graphloom.llm import packing
from tokenizers import Tokenizer


def ids(text):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def test_pieces_and_places(awkward):
    rows = packing.pack(awkward, capacity=256, keep_ids=True).collect()
    texts = [(r.doc_id, r.text) for r in awkward.collect()]
    want = collections.Counter()
    for doc_id, text in texts:
        own = ids(text)
        for k in range(0, len(own), 256):
            piece = own[k : k + 256]
            want[doc_id, k // 256, k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert all(len(r.ids) == r.length for r in rows)
    used = collections.defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end  # gapless from 0
            end += length
        assert end <= 256


def test_nothing_packs_into_nothing(nothing):
    assert packing.pack(nothing).count() == 0


def test_sweeps_equal_row_by_row_best_fit():
    rng = np.random.default_rng(0)
    for capacity in (8, 64):
        lengths = sorted(rng.integers(1, capacity + 1, 500).tolist(), reverse=True)
        gaps = []
        for n in lengths:
            fit = [g for g in gaps if g >= n]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - n)
            else:
                gaps.append(capacity - n)
        plan = packing.best_fit(np.bincount(lengths, minlength=capacity + 1), capacity)
        assert len(gaps) == (plan["sequence"] + plan["n"]).max()
        assert plan["n"].sum() == 500


def test_words_equal_the_whole_tokenizer():
    coder = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Don't stop, ΟΔΟΣ Été é", "a\x1cb  c", "<|endoftext|> 12.5%", "", "x" * 500, "　wide space"]
    assert [[*np.frombuffer(coder.ids(t), "<u4").tolist(), 0] for t in texts] == [ids(t) for t in texts]
