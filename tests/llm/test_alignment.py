import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from convolytics.llm import alignment

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def byte_table():
    """Printable stand-ins of bytes, from the vocabulary's own rule."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {}, 0
    for b in range(256):
        if b in keep:
            table[chr(b)] = b
        else:
            table[chr(256 + extra)] = b
            extra += 1
    return table


def cut(pieces, ids):
    out, end = [], 0
    for i, p in zip(ids, pieces, strict=True):
        end += len(p)
        out.append((end, i))
    return out


def brute(rows):
    table = byte_table()
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    found = []
    for r in rows:
        text = r.text or ""
        want = (" " + text).encode()
        ea = a.encode(" " + text, add_special_tokens=False)
        ia, pa = ea.ids, [bytes(table[c] for c in t) for t in ea.tokens]
        ib = b.encode(text)
        pb = [
            bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in zip(ib, map(b.id_to_piece, ib), strict=True)
        ]
        if not text or b"".join(pa) != want or b"".join(pb) != want:
            found.append((r.doc_id, 0, 0, [], ""))
            continue
        ends_a, ends_b = dict(cut(pa, ia)), dict(cut(pb, ib))
        common = sorted(set(ends_a) & set(ends_b))
        links = [(ends_a[e], ends_b[e]) for e in common]
        groups, low = [], 0
        for e in common:
            inside = lambda ends: ",".join(str(i) for k, i in sorted(ends.items()) if low < k <= e)  # noqa: B023, E731
            groups.append(f"{inside(ends_a)}|{inside(ends_b)}")
            low = e
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        found.append((r.doc_id, len(ia), len(ib), links, digest))
    counts = Counter(x for f in found for x in f[3])
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    return [
        (d, na, nb, len(l), len(l), sum(counts[x] == best[x[1]] for x in l), sum(counts[x] for x in l), h)
        for d, na, nb, l, h in found
    ]


ODD = [
    " two  spaces ", "▁ own mark", "<|endoftext|> and <s> </s> <unk> <0x41>", "\x00\x01\x7f", "日本語テキスト",
    "\U0001f469‍\U0001f680 naïve café", "a" * 3000, "\n\n\ttab\r\n", "é" * 500, "é", " 　x", "﻿bom",
]


def result(frame):
    got = alignment.alignments(frame, A, B)
    assert got.columns == [
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    ]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_all_columns(spark):
    rng = random.Random(6)
    rows = [(i, t) for i, t in enumerate(ODD)]
    rows += [(100 + i, " ".join(rng.choice(["the", "Häuser", "x1", "déjà", "..."]) for _ in range(60))) for i in range(50)]
    rows += [(None, "no id"), (7, None), (7, ""), (100, rows[12][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    a, b = alignment.sides(A, B)
    digits = alignment._digits(60_000)
    assert result(frame) == sorted(brute(frame.collect()), key=repr)
    # The same rows in other slices: partial counts add up to the same.
    table = frame.select("doc_id", F.col("text")).toArrow().combine_chunks().to_batches()[0]
    parts = [
        alignment.aligned(a, b, table.column(0).slice(i, 5), table.column(1).slice(i, 5), digits)
        for i in range(0, table.num_rows, 5)
    ]
    whole = alignment.aligned(a, b, table.column(0), table.column(1), digits)
    total = lambda bs: sum(
        (Counter({c["pair"]: c["n"] for x in p.column(6).to_pylist() for c in x}) for p in bs), Counter()
    )
    assert total(parts) == total([whole])


def test_rank_encoder_gives_the_ids_of_the_library():
    """Every code point after a letter, before one, twice, and by a digit; long runs."""
    a, _ = alignment.sides(A, B)
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{c}b {c}{c}1{c}. " for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    texts += [" " * 100_000, "x" * 100_000, "ab" * 50_000 + "\n" * 5000, "<|endoftext|>"]
    want = library.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
    assert a.encode(texts) == [e.ids for e in want]


def test_odd_rows(docs, empty):
    assert result(docs) == sorted(brute(docs.collect()), key=repr)
    assert result(empty) == []
    nothing = docs.where("text is null")
    assert [r[1:] for r in result(nothing)] == [(0, 0, 0, 0, 0, 0, "")] * nothing.count()
