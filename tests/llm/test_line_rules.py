import random
import re

from weftgrid.llm import line_rules


def brute(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i:i + 5]), []).append(i)
    repeat = {p for found in places.values() if len(found) > 1 for i in found for p in range(i, i + 5)}
    n, r = len(words), len(repeat)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, r, n < 10 or 100 * r > 20 * n


def counts(row):
    return tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))


def test_counts_match_brute_force(documents):
    rng = random.Random(2)
    texts = [None, "", "\n\n", " \t \x0b\x0c\r\n", "a", "a b c d e", "a b c d e a b c d e", "é 😀 | # <x>\n\n#", "x " * 400, "same line\nsame line\n same line\nsame line"]
    for _ in range(80):
        w = [rng.choice("abcdé#|") * rng.randint(1, 2) for _ in range(rng.randint(0, 120))]
        texts.append("".join(x + rng.choice([" ", "  ", "\n", "\t", " ", "\x0b", " "]) for x in w))
    texts.append(" ".join(rng.choice("ab") for _ in range(20000)))
    got = {r["doc_id"]: r for r in line_rules.quality_rules(documents(texts, extra=("kept", "_words"))).collect()}
    for i, t in enumerate(texts):
        assert counts(got[i]) == brute(t), t


def test_lines_that_fail_go_and_thin_documents_with_them(documents):
    prose = "The cat sat on the mat and looked out of the window for a while."
    more = "Later that day it went down to the river, where nobody had seen it before."
    menu, notice, symbols, shout = "Home | News | Sport | About", "All rights reserved.", "a%%% b$$$ c*** d###", "BUY!! NOW!! CHEAP!!"
    runon = " ".join(f"w{i}" for i in range(60))
    texts = [f"{menu}\n{prose}\n\n{notice}\n{symbols}\n{shout}\n{more}", f"{prose}\n{runon}", f"{menu}\n{menu} | {menu}\n{runon}", prose, None]
    got = {r["doc_id"]: r for r in line_rules.quality_rules(documents(texts)).collect()}
    assert got[0]["clean_text"] == f"{prose}\n\n{more}" and got[0]["kept"]
    assert got[1]["clean_text"] == prose and not got[1]["kept"] and not got[1]["base_failed"]
    assert got[2]["clean_text"] == "" and not got[2]["kept"]
    assert got[3]["kept"] and got[3]["clean_text"] == prose
    assert got[4]["clean_text"] is None and not got[4]["kept"]
    assert got[0]["clean_word_chars"] == len((prose + more).replace(" ", ""))


def test_empty_frame_and_no_python(documents):
    out = line_rules.quality_rules(documents([]))
    assert out.count() == 0 and "Python" not in out._jdf.queryExecution().toString()
