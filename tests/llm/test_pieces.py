import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from convolytics.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_digests(docs, library):
    rows = docs.collect()
    got = pieces.token_digests(docs, PATH).collect()
    want = []
    for r in rows:
        ids = library.encode(r.text or "", add_eos=True)
        want.append(
            (
                r.doc_id or -1,
                len(ids),
                hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(library.decode(ids).encode()).hexdigest(),
                len((r.text or "").encode()),
            )
        )
    assert sorted((r[0] or -1, *r[1:]) for r in got) == sorted(want)


def test_spans_and_random_texts(library, monkeypatch):
    rng = random.Random(2)
    letters = "ab Zé日\U0001f600\t\n▁\x00 the<s></s><unk><0x41>0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    for limit in (pieces.CACHE, 40):  # a table that is full again and again
        monkeypatch.setattr(pieces, "CACHE", limit)
        table = pieces.Units(pieces.Model(PATH))
        for low in range(0, len(texts), 100 if limit > 40 else 1):
            part = texts[low : low + (100 if limit > 40 else 1)]
            e = pieces.Encoded(table, part)
            for i, text in enumerate(part):
                at = slice(e.first[i], e.first[i + 1])
                assert e.ids[at].tolist() == library.encode(text, add_eos=True)
                assert e.decoded[i] == library.decode(e.ids[at].tolist())
                assert table.model.decode(e.ids[at].tolist()) == e.decoded[i]
                spans = list(zip(e.starts[at].tolist(), e.ends[at].tolist(), strict=True))
                end = len(text.encode())
                assert spans[-1] == (end, end)
                assert all(a <= b for a, b in spans)
                assert all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
    known = library.encode("Hello  wörld 日本", return_type="proto").pieces
    e = pieces.Encoded(pieces.Units(pieces.Model(PATH)), ["Hello  wörld 日本"])
    assert [(p.begin, p.end) for p in known] == list(
        zip(e.starts[:-1].tolist(), e.ends[:-1].tolist(), strict=True)
    )


def charmap(rules: dict[bytes, bytes]) -> bytes:
    """A compiled map of a few rules: each trie node at its own block of 256 units."""
    nodes: dict[bytes, int] = {b"": 0}
    for key in rules:
        for i in range(1, len(key) + 1):
            nodes.setdefault(key[:i], len(nodes))
    units = np.zeros(256 * (len(nodes) + 1), np.uint32)
    texts, place = b"", {}
    for key, out in rules.items():
        place[key] = len(texts)
        texts += out + b"\0"
    base = {node: 256 * (i + 1) for node, i in nodes.items()}
    where = {b"": 0}
    for node in sorted(nodes, key=len):
        if node:
            where[node] = base[node[:-1]] ^ node[-1]
        offset = where[node] ^ base[node]
        assert offset < 1 << 21
        units[where[node]] = (offset << 10) | (256 if node in rules else 0) | (node[-1] if node else 0)
        if node in rules:
            units[base[node]] = 0x80000000 | place[node]
    return len(units.tobytes()).to_bytes(4, "little") + units.tobytes() + texts


def test_charmap_keeps_offsets():
    """The longest known prefix is replaced, and each byte that comes out knows its source."""
    m = pieces.Model(PATH)
    m.charmap = pieces.CharMap(
        charmap({"ﬁ".encode(): b"fi", b"a": b"A", b"ab": b"", "１".encode(): b"1", "　".encode(): b" "})
    )
    m.plain = False
    assert m.charmap.longest(b"abc", 0) == (2, b"")
    assert m.charmap.longest(b"ac", 0) == (1, b"A")
    assert m.charmap.longest(b"c", 0) == (0, b"")
    text, at = m.normalise("aﬁ ab１")
    assert text == "▁Afi▁1"
    assert at.tolist() == [0, 0, 0, 0, 1, 1, 4, 4, 4, 7, 10]
    m.squeeze = True
    text, at = m.normalise("  c　 　d ")
    assert text == "▁c▁d"
    assert at.tolist() == [2, 2, 2, 2, 3, 3, 3, 10, 11]
    assert m.normalise("   ")[0] == ""


def test_tokens(docs, empty):
    row = pieces.tokens(docs.where("doc_id = 4"), PATH).first()
    assert row.ids[-1] == 2 and len(row.ids) == len(row.starts) == len(row.ends)
    assert pieces.tokens(empty, PATH).count() == 0
    assert pieces.token_digests(empty, PATH).count() == 0
