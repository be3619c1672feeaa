import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from panelgrid.llm import tokens

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())


def check(df, library, **kw):
    rows = df.collect()
    want = sorted((str(r.doc_id), *expected(library, r.text)) for r in rows)
    got = [tuple(r) for r in tokens.encode_digests(df, PATH, P.PATTERN, **kw).collect()]
    assert sorted((str(i), *x) for i, *x in got) == want


def test_same_as_library(library, sf_docs):
    check(sf_docs, library)


@pytest.mark.parametrize("chunk,overlap", [(7, 3), (16, 12), (64, 8)])
def test_any_chunk_size(library, table, awkward, sf_docs, chunk, overlap):
    odd = ["it's we'll  \n\n  x" * 9, " " * 50 + "a", "a" * 90 + "'re", "1234567 \t\n" * 12,
           "\x1c\x1d \x85 \xa0 　᠎ x" * 5, "'" * 40 + "ll"]
    check(table(odd).unionByName(awkward), library, chunk=chunk, overlap=overlap)
    check(sf_docs.limit(20), library, chunk=chunk * 10, overlap=overlap)


def test_empty_table(library, table):
    assert tokens.encode_digests(table([]), PATH, P.PATTERN).count() == 0


def test_known_pieces_are_not_encoded_or_decoded_again(library):
    class Counting(tokens.Vocabulary):
        done = 0

        def piece(self, piece):
            self.done += 1
            return super().piece(piece)

        def decode(self, ids):
            self.done += len(ids)
            return super().decode(ids)

    with open(PATH, "rb") as f:
        v = Counting(f.read(), P.PATTERN)
    text = "unlikelyword 12 \u8a9e!\n" * 40
    pieces = v.pattern.findall(text)
    assert tokens.digests(v, iter([pieces])) == expected(library, text)
    once = v.done
    assert once <= 40 and tokens.digests(v, iter([pieces, pieces])) == expected(library, text * 2)
    assert v.done == once


def test_full_memory_of_pieces(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 3)
    with open(PATH, "rb") as f:
        v = tokens.Vocabulary(f.read(), P.PATTERN)
    for text in ["one two three four", "", "two five", "one two three four"]:
        assert tokens.digests(v, iter([v.pattern.findall(text)])) == expected(library, text)


def test_list_and_heap_of_pairs_agree(library):
    rnd = random.Random(5)
    with open(PATH, "rb") as f:
        v = tokens.Vocabulary(f.read(), P.PATTERN)
    for size in (1, 2, 3, 9, 63, 64, 65, 300):
        for letters in ("ab", "etaoin shr", "\u00e9\u8a9e\U0001f600x"):
            piece = "".join(rnd.choice(letters) for _ in range(size)).replace(" ", "")
            raw = piece.encode()
            assert v._short(raw) == v._long(raw)
            assert v.piece(piece) == library._encode_single_piece(raw)
