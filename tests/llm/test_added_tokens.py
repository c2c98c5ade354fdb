import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from loomgraph.llm import packing, token_counts
from loomgraph.llm.tokenize import encoder, segments, vocabulary

from .conftest import DOC, doc, sentence

END = "<|endoftext|>"
TEXTS = [f"a{END}b", f"a {END} b", END, END + END, f"don{END}'t {END}'ll", f"  {END}  x\n{END}\n", f"é{END}\U0001f600<|endoftext|", f"<|endo{END}ftext|>", "", "plain"]


@pytest.fixture(scope="module")
def loaded():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_added_tokens_are_those_of_the_library_as_loaded(loaded):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choices([END, "a", " ", "'s", "\n", "1", "é", "<|", "|>", "."], k=rng.randint(0, 30))) for _ in range(300)]
    # Texts that only together hold the token.
    texts += ["x<|endof", "text|>y"]
    own = encoder(vocabulary(), added=True)
    ids, off = own.encode(texts)
    _, a, b, _ = own.encode_spans(texts)
    for i, t in enumerate(texts):
        want = loaded.encode(t, add_special_tokens=False)
        assert ids[off[i] : off[i + 1]].tolist() == want.ids, t
        assert list(zip(a[off[i] : off[i + 1]].tolist(), b[off[i] : off[i + 1]].tolist(), strict=True)) == want.offsets, t


def test_segments_keep_added_tokens_whole(loaded):
    text = sentence(random.Random(5), 1500).replace(" ", END, 400)
    own = encoder(vocabulary(), added=True)
    parts = own.segments(text, 500)
    assert len(parts) > 5 and "".join(parts) == text
    assert own.encode(parts)[0].tolist() == loaded.encode(text, add_special_tokens=False).ids
    assert segments("ab <x y> cd ef", 3, regex.compile("<x y>")) == ["ab <x y>", " cd", " ef"]


def test_packing_and_counts_take_added_tokens(spark, loaded):
    docs = spark.createDataFrame([doc(i, t) for i, t in enumerate(TEXTS)], DOC)
    ids = {i: loaded.encode(t, add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    got = Counter((r.doc_id, r.doc_tokens, r.ids_crc32) for r in packing.pack(docs).collect())
    assert got == Counter((i, len(t) + 1, zlib.crc32(np.array([*t, 0], "<u4").tobytes())) for i, t in ids.items())
    counts = {r.doc_id: r.n for r in token_counts.attribute(docs).groupBy("doc_id").agg({"tokens": "sum"}).toDF("doc_id", "n").collect()}
    assert counts == {i: len(t) for i, t in ids.items()}
