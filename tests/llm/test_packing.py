"""Packing: ids against the tokenizer's own library, plans and places against plain checks."""

import collections
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from wayfare.llm import packing as P
from wayfare.llm import queries, token_counts

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
SCHEMA = "doc_id long, text string, length int, task string"


def library():
    from tokenizers import Tokenizer

    path, pattern = token_counts.vocabulary("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return path, pattern, lambda text: own.encode(text, add_special_tokens=False).ids


def test_ids_equal_those_of_the_tokenizer():
    path, pattern, ids = library()
    encode, rng = P.coder(P.ranks(path), pattern), random.Random(4)
    signs = "a'sdtmrevl 1\n\t!é中̀  \x1c\x85ǅⅣ²'<|>endoftx𝒳​"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["<|endoftext|>", "", " ", "a" * 3000, " \n" * 500, "".join(chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000)]
    for text in texts:
        assert encode(text).tolist() == ids(text), text


def plain(rows, room):
    ids = library()[2]
    out = []
    for doc, text in rows:
        all_ids = [*ids(text or ""), 0]
        cut = [all_ids[max(0, e - room) : e] for e in range(len(all_ids), 0, -room)][::-1]
        at = 0
        for i, piece in enumerate(cut):
            out.append((doc, i, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
            at += len(piece)
    return collections.Counter(out)


def gapless(rows, room):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= room
    return len(by)


def test_pieces_and_places(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["the", " of", "\n", "é", "12", " zq"])
    rows = [(i, "".join(word() for _ in range(rng.randint(0, 90)))) for i in range(300)]
    rows += [(7, rows[3][1])] * 150 + [(None, None), (301, ""), (302, "a b " * 2000)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA).repartition(6)
    path, pattern, _ = library()
    found = P.pack(P.pieces(df, path, pattern, room=64), room=64).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == plain(rows, 64)
    used = gapless(found, 64)
    assert used <= max(-(-sum(r.length for r in found) // 64), sum(r.length > 32 for r in found)) * 1.02 + 1


def test_no_rows(spark):
    path, pattern, _ = library()
    assert P.pack(P.pieces(spark.createDataFrame([], SCHEMA), path, pattern)).collect() == []


@given
def test_query_over_the_given_documents(spark):
    rows = queries.op13_pack(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == plain(docs, 2048)
    assert gapless(rows, 2048) <= -(-sum(r.length for r in rows) // 2048) + 2


def test_plans_use_every_piece_and_few_sequences():
    rng = random.Random(8)
    shapes = [
        [0, 5000] + [0] * 2047,
        [0] + [rng.randint(0, 50) for _ in range(2048)],
        [0] + [rng.randint(0, 5000) for _ in range(60)] + [0] * 1988,
        [0] * 1200 + [rng.randint(0, 5) for _ in range(849)],
        [0] * 2049,
    ]
    for count in shapes:
        used, made = collections.Counter(), P.plan(count, 2048)
        for times, lengths in made:
            assert sum(n * k for n, k in lengths.items()) <= 2048
            for n, k in lengths.items():
                used[n] += k * times
        assert used == collections.Counter({n: k for n, k in enumerate(count) if k})
        assert len(made) <= 2048
        least = max(-(-sum(n * k for n, k in enumerate(count)) // 2048), sum(count[1025:]))
        assert sum(times for times, _ in made) <= least * 1.02 + 1


def test_combinations_fill_a_gap_exactly():
    count = [0] * 101
    for n in (70, 30, 60, 25, 15, 55, 20, 14, 11):
        count[n] = 2
    assert P.plan(count, 100) == [(2, {70: 1, 30: 1}), (2, {60: 1, 25: 1, 15: 1}), (2, {55: 1, 20: 1, 14: 1, 11: 1})]
