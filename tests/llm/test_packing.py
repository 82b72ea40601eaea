import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarrylight.llm import packing
from quarrylight.llm.tokens import encode

ODD = ["", "<|endoftext|> x", "x<|endoftext|><|endoftext|>y  <|endoftext|>  z", "<|endoftext|", "a\n<|endoftext|>\nb", "a  b c\u0085d᠎e﻿f", "  lead\n\n\n tail  ", "it's IT'S we'll", "日本語テキスト😀👩‍👩‍👧", "x" * 3000, "é" * 500, "1234567 ١٢٣ ²³", "\x00\x1f\x7f"]


def plain():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizers_library():
    t = plain()
    for text in ODD:
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids, text

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60))
    def same(text):
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids

    same()


def test_long_runs_of_blanks(spark):
    t = plain()
    for text in ("a" + " " * 2_000_000 + "b", "\n \t" * 500_000, "x" * 200_000):
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
    text = "word. " * 60_000 + " " * 1_200_000 + "end"
    out = packing.packed(spark.createDataFrame([(1, text), (2, "<|endoftext|>")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.doc_tokens for r in out} == {1: len(t.encode(text, add_special_tokens=False).ids) + 1, 2: 2}
    assert sum(r.length for r in out) == sum({r.doc_id: r.doc_tokens for r in out}.values())


def test_cuts_are_optimal():
    rng = random.Random(0)
    for powers in (False, True):
        for _ in range(60):
            size = 16
            x = [0]
            for _ in range(rng.randint(1, 14)):
                x.append(x[-1] + rng.randint(1, size))
            pay = [0.0] + [rng.choice([0, 2, 5]) for _ in x[1:]]
            best = [0.0]
            for j in range(1, len(x)):
                best.append(min(best[i] + pay[j] + (0 if powers and (x[j] - x[i]) & (x[j] - x[i] - 1) == 0 else size - x[j] + x[i]) for i in range(j) if x[j] - x[i] <= size))
            found = packing.cuts(np.array(x), np.array(pay), size, powers)
            cost = 0
            for a, b in zip([0, *found], found):
                cost += pay[x.index(b)] + (0 if powers and (b - a) & (b - a - 1) == 0 else size - b + a)
                assert b - a <= size
            assert cost == best[-1]


def test_pieces_cover_all_ids(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["wordy", "thing.", "é", "more\n"]) for _ in range(rng.randint(0, 900)))) for i in range(150)]
    rows += [(150, None), (151, ""), (3, rows[3][1]), (None, "some text."), (152, "a " * 9000), (153, ODD[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS start", "'x' AS offset")
    out = packing.packed(df, block=20000).collect()
    t = plain()
    ids = {}
    for d, text in rows:
        ids.setdefault(d, []).append(np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4"))
    seen, filled, by = {}, {}, {}
    for r in out:
        own = ids[r.doc_id][0]
        assert r.doc_tokens == len(own)
        assert zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {d: sum(map(len, x)) for d, x in ids.items()}
    waste = 0
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 2048
        waste += packing.padding(at)
    assert waste < 0.01 * sum(seen.values())
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string")).collect() == []
