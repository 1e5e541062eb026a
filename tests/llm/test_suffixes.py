import hashlib
import random

import pytest

from weftgrid.llm import suffixes


def brute(texts, length=200):
    bodies, seen = [(t or "").encode() for t in texts], {}
    for b in bodies:
        for i in range(len(b) - length + 1):
            seen[b[i:i + length]] = seen.get(b[i:i + length], 0) + 1
    out = []
    for number, b in enumerate(bodies):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((number, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed, n=80):
    rng = random.Random(seed)
    noise = lambda k: "".join(rng.choice("abcdefgh é") for _ in range(k))
    passages = [noise(k) for k in (190, 199, 200, 201, 215, 260, 300, 500, 1200)]
    out = [None, "", "x" * 500, "ab" * 400, noise(150), noise(199), "y" * 200, "y" * 201]
    for _ in range(n):
        t = noise(rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, max(0, len(p) - 150))
            t += p[a:a + rng.randint(150, 1300)] + noise(rng.randint(0, 80))
        out.append(t)
    return out + [out[20]] * 5


def test_cover_reaches_every_difference():
    found = {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER}
    assert found == set(range(suffixes.PERIOD))


@pytest.mark.parametrize("seed, options", [(1, {"chunk_bytes": 5000, "bucket_hashes": 300}), (2, {}), (3, {"chunk_bytes": 900})])
def test_removes_what_brute_force_removes(documents, rows, seed, options):
    found = texts(seed)
    docs = documents(found, extra=("chunk", "seq", "body", "bucket"))
    assert rows(suffixes.remove_repeats(docs, **options)) == sorted(brute(found), key=repr)


def test_other_length_and_kept_bytes(documents):
    found = texts(4, 30)
    got = sorted(suffixes.remove_repeats(documents(found), length=120, keep=True).collect(), key=lambda r: r["doc_id"])
    want = brute(found, 120)
    assert [tuple(r)[:5] for r in got] == want
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got)


def test_empty_frame_and_short_length(documents):
    assert suffixes.remove_repeats(documents([])).count() == 0
    assert suffixes.remove_repeats(documents([None, "", "a"])).count() == 3
    with pytest.raises(ValueError):
        suffixes.remove_repeats(documents(["a"]), length=100)


def test_surroundings_with_half_a_hash_in_common_are_different(documents):
    # Texts that share only a rank, and the upper 32 bits of the hash of their surroundings; found by trying 400,000 texts.
    begin = ("the same beginning of a hundred and ten bytes " * 3)[:110]
    found = [begin + f"{i:090d}" for pair in ((235192, 324848), (46121, 322241), (10703, 106405)) for i in pair]
    got = suffixes.remove_repeats(documents(found)).collect()
    assert [r["n_removed"] for r in got] == [0] * len(found)
