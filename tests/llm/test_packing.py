import os
import random

import numpy as np
import pytest

from weftgrid.llm import packing

pytestmark = pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no tokenizer files")


@pytest.fixture(scope="module")
def encoder():
    with open(packing.TOKENIZER, "rb") as file:
        return packing.Encoder(file.read())


def texts():
    rng = random.Random(6)
    words = ["alpha", "Beta,", "it's", "é", "日本", "12", "x" * 80, "a\nb", "tab\tbed"]
    spaces = [" ", " ", " ", " ", "  ", " \n", "\n", " ", "　 "]
    return [None, "", " ", "\n", " lead", "trail ", "a  b"] + ["".join(rng.choice(words) + rng.choice(spaces[:4] if k % 2 else spaces)
            for _ in range(rng.randint(1, 700))) for k in range(40)]


def test_remembered_pieces_give_the_same_ids(encoder):
    for text in filter(None, texts()):
        assert encoder(text).tolist() == encoder.encoding.encode_ordinary(text), text[:80]


@pytest.mark.parametrize("window", [300, 1 << 20])
def test_round_trip(documents, encoder, window):
    found = texts() + ["same text"] * 30
    rows = packing.pack_tokens(documents([(i % 5 if i % 4 else None, t, "s") for i, t in enumerate(found)], extra=("rows", "row")), length=64, window=window).collect()
    pieces = {}
    for r in rows:
        ids, positions = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")
        cuts = r["cu_seqlens"]
        assert len(ids) == len(positions) == 64 and cuts[0] == 0 and cuts[-1] == r["n_tokens"] <= 64
        assert (ids[cuts[-1]:] == 50256).all()
        assert len(cuts) - 1 == len(r["doc_ids"]) == len(r["rows"]) == len(r["starts"])
        for k, row in enumerate(r["rows"]):
            a, b = cuts[k], cuts[k + 1]
            assert positions[a:b].tolist() == list(range(b - a))
            pieces.setdefault((row, r["doc_ids"][k]), {})[r["starts"][k]] = ids[a:b].tolist()
    got = sorted((repr(doc), [i for at in sorted(p) for i in p[at]]) for (_, doc), p in pieces.items())
    want = sorted((repr(i % 5 if i % 4 else None), [*encoder.encoding.encode_ordinary(t), 50256]) for i, t in enumerate(found) if t)
    assert got == want


def brute_fit(sizes, length):
    free = []
    for s in sorted(sizes, reverse=True):
        fits = [f for f in free if f >= s]
        if fits:
            free.remove(min(fits))
        free.append((min(fits) if fits else length) - s)
    return sorted(free)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_matches_a_plain_search(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 50) for _ in range(300)]
    rows = packing.best_fit_decreasing(sizes, 50)
    assert sorted(i for r in rows for i in r) == list(range(300))
    assert sorted(50 - sum(sizes[i] for i in r) for r in rows) == brute_fit(sizes, 50)


def test_empty_frame_and_length(documents):
    assert packing.pack_tokens(documents([])).count() == 0
    assert packing.pack_tokens(documents([None, ""])).count() == 0
    with pytest.raises(ValueError):
        packing.pack_tokens(documents([]), length=70000)


def test_written_rows(documents, tmp_path, spark):
    packed = packing.pack_tokens(documents(["a b c", "d"]), length=8)
    packing.write_packed(packed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == packed.count()
