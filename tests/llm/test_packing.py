"""Packing: exact pieces, gapless sequences, best fit."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing
from tests.llm.helpers import edge_docs, edge_rows, no_docs

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("window", [2048, 64])
def test_edges(spark, window):
    got = packing.pack(edge_docs(spark), PATH, window=window).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for r in edge_rows():
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), window):
            part = ids[at : at + window]
            want.append((r[0], at, len(part), zlib.crc32(part.tobytes()), len(ids)))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= window


def test_shards_number_sequences_apart(spark):
    got = packing.pack(edge_docs(spark), PATH, window=64, shard_pieces=50).collect()
    places = [(r["sequence_id"], r["offset"]) for r in got]
    assert len(set(places)) == len(places)


def test_best_fit_is_tightest():
    rng = random.Random(3)
    lengths = sorted((rng.randint(1, 64) for _ in range(500)), reverse=True)
    which, offset = packing.best_fit(np.array(lengths), 64)
    room = []
    for need, w, at in zip(lengths, which.tolist(), offset.tolist(), strict=True):
        fits = [r for r in room if r >= need]
        if w == len(room):
            assert not fits and at == 0
            room.append(64)
        else:
            assert room[w] == min(fits) and at == 64 - room[w]
        room[w] -= need
    assert sum(room) < 64 + 0.05 * sum(lengths)


def test_empty(spark):
    assert packing.pack(no_docs(spark), PATH).collect() == []
