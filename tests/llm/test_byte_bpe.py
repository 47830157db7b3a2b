import hashlib

import public_tokenizers as tokens
import tiktoken
from graphloom.llm import byte_bpe
from hypothesis import given, settings
from hypothesis import strategies as st

CODEC = byte_bpe.codec(tokens.path("byte_bpe_50k.tiktoken"), tokens.PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'ab1.,<|>"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_ids_equal_the_library(text):
    ids = CODEC.encode(text)
    assert ids == " ".join(map(str, REFERENCE.encode_ordinary(text)))
    assert CODEC.decode(ids) == text.encode()


def test_perfect_hash_is_minimal_and_confirms():
    assert all(CODEC.whole.get(k) == v for k, v in CODEC.ranks.items())
    assert CODEC.whole.get(b"no such token at all") == -1 and len(set(CODEC.whole.keys)) == len(CODEC.ranks)


def test_columns(awkward, nothing):
    for r, d in zip(sorted(byte_bpe.digests(awkward).collect(), key=str), sorted(awkward.collect(), key=lambda r: 0)):
        assert len(r.ids_sha256) == 64 and d is not None
    got = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in byte_bpe.digests(awkward).collect()}
    want = {(r.doc_id, len(REFERENCE.encode_ordinary(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in awkward.collect()}
    assert got == want
    back = byte_bpe.decode(byte_bpe.encode(awkward.select("doc_id", "text")), to="raw").collect()
    assert all(bytes(r.raw) == (r.text or "").encode() for r in back)
    assert byte_bpe.digests(nothing).count() == 0
