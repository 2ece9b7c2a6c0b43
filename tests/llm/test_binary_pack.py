"""Power-of-two packing against the tokenizers library and a greedy cut in plain Python."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from embedlens.llm import binary_pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


def cut(n, most):
    """The longest power of two that fits, again and again."""
    at = 0
    while at < n:
        size = most
        while size > n - at:
            size //= 2
        yield at, size
        at += size


@pytest.mark.parametrize("most", [2048, 64, 1])
def test_decomposition(most):
    lengths = [1, 2, 3, 2047, 2048, 2049, 5000, 63, 64, 65, 1, 4096]
    doc, start, size = binary_pack.decomposition(np.array(lengths), most)
    assert list(zip(doc.tolist(), start.tolist(), size.tolist())) == [(d, a, s) for d, n in enumerate(lengths) for a, s in cut(n, most)]
    for bad in (0, 3, 2047, -2):
        with pytest.raises(ValueError):
            binary_pack.decomposition(np.array([5]), bad)


@pytest.mark.parametrize("most", [2048, 32])
def test_pack(documents, rows, empty, most):
    from tokenizers import Tokenizer

    library, want, texts = Tokenizer.from_file(PATH), Counter(), Counter()
    for doc, text, *_ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        texts[doc, tuple(ids.tolist())] += 1
        for a, n in cut(len(ids), most):
            want[doc, a, n, zlib.crc32(ids[a : a + n].tobytes()), len(ids)] += 1
    got = binary_pack.pack(documents, PATH, max_tokens=most, with_ids=True).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    assert all(r.length == 1 << r.bucket == len(r.ids) and r.offset == 0 for r in got)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    order = sorted(got, key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in order] == list(range(len(got))), "one piece a sequence, no gaps"
    assert [r.bucket for r in order] == sorted((r.bucket for r in got), reverse=True)
    ranks = defaultdict(list)
    for r in order:
        ranks[r.bucket].append(r.rank)
    assert all(x == list(range(len(x))) for x in ranks.values())
    plain = binary_pack.pack(documents, PATH, max_tokens=most)
    assert plain.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "rank"]
    assert binary_pack.pack(empty, PATH, max_tokens=most).count() == 0
