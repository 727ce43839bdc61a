"""Alignment of two tokenizers against whole texts encoded at once and all pairs compared."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rankmill.llm import alignment
from rankmill.llm.alignment import Aligner, Alignment, byte_level
from tests.llm.helpers import documents, texts, words

with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as lines:
    A_JSON = lines.read()
with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as raw:
    B_MODEL = raw.read()
A = Tokenizer.from_str(A_JSON)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_proto=B_MODEL)
BYTE = byte_level()


def bytes_a(i):
    return bytes(BYTE[c] for c in A.id_to_token(i))


def bytes_b(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def ranges(tokens):
    ends = np.cumsum([len(t) for t in tokens]).tolist()
    return list(zip([0, *ends[:-1]], ends))


def brute(rows):
    found, docs = [], Counter()
    for key, text in rows:
        raw = (" " + (text or "")).encode()
        a, b = A.encode(raw.decode(), add_special_tokens=False).ids, B.encode(text or "")
        in_a, in_b = [bytes_a(i) for i in a], [bytes_b(i) for i in b]
        if not text or b"".join(in_a) != raw or b"".join(in_b) != raw:
            found.append((key, 0, 0, [], []))
            continue
        at_a, at_b = ranges(in_a), ranges(in_b)
        cuts = sorted({e for _, e in at_a} & {e for _, e in at_b})
        ids = [[",".join(str(i) for i, (s, e) in zip(own, at) if low <= s and e <= high) for own, at in ((a, at_a), (b, at_b))] for low, high in zip([0, *cuts], cuts)]
        links = [(i, j) for i, (s, e) in zip(a, at_a) for j, (f, g) in zip(b, at_b) if s < g and f < e]
        docs.update(set(links))
        found.append((key, len(a), len(b), links, ["|".join(g) for g in ids]))
    best = defaultdict(int)
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    out = Counter((k, a, b, len(g), len(ls), sum(docs[x] == best[x[0]] for x in ls), sum(docs[x] for x in ls), ";".join(g)) for k, a, b, ls, g in found)
    return out, docs


def awkward():
    draw = random.Random(9)
    bits = [" ", "  ", "\n", "\r\n", "\t", "\xa0", "　", "\x1c", "\x85", "a", "word", "The", "ing", "don't", "1234", "é", "ß", "日本語", "😀", "é", "<s>", "</s>", "<0x41>", "<|endoftext|>", "▁", "\x00", "ﬁ", "—", "...", "_", "AKIA", "​"]
    rows = [(1000 + i, "".join(draw.choice(bits) for _ in range(draw.randint(1, 25)))) for i in range(250)]
    rows += [(3000 + i, draw.choice(["word", "x"]) + end) for i, end in enumerate(["\n\n", "  ", " \n ", "\t", "\n  b", "  \n   c"] * 2)]
    return [(i, t) for i, t in rows if draw.random() < 0.7 or "▁" not in t]


@pytest.mark.parametrize("limits", [(4_000_000, 50_000), (300, 5)])  # one block of all; many blocks, little remembered
def test_alignment(spark, monkeypatch, limits):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", limits[0])
    monkeypatch.setattr(alignment, "KNOWN", limits[1])
    rows = [(i, t) for i, t in texts() if len(t or "") < 2000] + awkward()
    want, docs = brute(rows)
    made = Alignment(documents(spark, rows), A_JSON, B_MODEL)
    assert Counter(tuple(r) for r in made.documents().collect()) == want
    assert {(r.a, r.b): r.docs for r in made.pair_counts().collect()} == docs
    assert sum(n for key, n in want.items() if key[1]) > 150  # most of them have tokens


def test_digest_and_long_texts(spark):
    rows = [(1, words(1, 20_000)), (2, "a" * 30_000), (3, " " * 5000 + "end"), (4, "x\n" * 4000)]
    plain = {r.doc_id: r for r in Alignment(documents(spark, rows), A_JSON, B_MODEL).documents().collect()}
    for r in Alignment(documents(spark, rows), A_JSON, B_MODEL, digest=True).documents().collect():
        assert r.groups == hashlib.sha256(plain[r.doc_id].groups.encode()).hexdigest()
        assert r.n_a == len(A.encode(" " + dict(rows)[r.doc_id]).ids) and r.n_b == len(B.encode(dict(rows)[r.doc_id]))
        assert r.asDict() | {"groups": ""} == plain[r.doc_id].asDict() | {"groups": ""}


def test_identity_map():
    own = Aligner(A_JSON, B_MODEL)
    known = np.flatnonzero(own.same >= 0)
    assert len(known) > 10_000
    assert all(own.a_bytes[a] == own.b_bytes[own.same[a]] for a in known)
    assert all(own.a_bytes[i] == bytes_a(i) for i in range(0, 50_256, 97))


def test_no_space_is_inside_a_token_behind_a_word():
    pieces = [B.id_to_piece(i) for i in range(B.get_piece_size())]
    assert not [p for p in pieces if any(x != "▁" and y == "▁" for x, y in zip(p, p[1:]))]
    assert not [t for t in A.get_vocab() if any(x != "Ġ" and y == "Ġ" for x, y in zip(t, t[1:])) and set(t) - {"Ġ", "Ċ", "ĉ", "č", "ł", "Â", "ċ", "Č"}]


def test_no_documents(spark):
    none = Alignment(documents(spark, []), A_JSON, B_MODEL)
    assert none.documents().count() == 0 and none.pair_counts().count() == 0
