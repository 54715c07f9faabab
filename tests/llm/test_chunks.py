import random
import re
from itertools import groupby

import numpy as np
import pytest
from helpers_llm import DOCS, prose, with_clashes

from waypost.llm import chunks


def test_chunks_are_whole_and_resist_shifts():
    rng = random.Random(1)
    for text in ("", "x", "é" * 4000, "a" * 9000, prose(rng, 3000), "😀ñ " * 500):
        raw = text.encode()
        if not raw:
            continue
        ends = chunks.chunk_ends(np.frombuffer(raw, np.uint8)).tolist()
        assert ends[-1] == len(raw) and ends == sorted(set(ends))
        assert "".join(raw[a:b].decode() for a, b in zip([0, *ends[:-1]], ends, strict=True)) == text
        assert max(b - a for a, b in zip([0, *ends[:-1]], ends, strict=True)) <= chunks.LONGEST + 4
    text = prose(rng, 2000)
    cut = lambda t: {t.encode()[a:b] for e in [chunks.chunk_ends(np.frombuffer(t.encode(), np.uint8)).tolist()] for a, b in zip([0, *e[:-1]], e, strict=True)}
    whole, shifted = cut(text), cut("inserted " + text[:5000] + "more" + text[5000:])
    assert len(whole - shifted) <= 6


def test_planted_passages(spark, folder):
    rng = random.Random(2)
    clean = [(i, prose(rng, 120, 100_000), "en", "s", 1) for i in range(150)]
    passages = [prose(rng, rng.randint(52, 80), 100_000) for _ in range(25)]
    planted = [(1000 + 10 * k + j, f"{prose(rng, 30, 100_000)} {p} {prose(rng, 30, 100_000)}", "en", "s", 1) for k, p in enumerate(passages) for j in range(3)]
    short = [(5000 + i, f"{prose(rng, 60, 100_000)}\nThis line of nine words ends many of the texts.", "en", "s", 1) for i in range(20)]
    got = chunks.op10_chunks(spark, folder(documents=(clean + planted + short, DOCS))).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in planted}
    texts = {r[0]: r[1] for r in planted}
    for r in got:
        passage = passages[(r["doc_id"] - 1000) // 10]
        assert texts[r["doc_id"]][r["start"] : r["end"]] in passage
        assert r["first_doc_id"] == r["doc_id"] - r["doc_id"] % 10 and r["kept"] == (r["doc_id"] % 10 == 0)


def cut(raw):
    """Ends of chunks by the rolling hash itself, byte by byte."""
    gear, h, ends, before = [int(x) for x in chunks.H.GEAR], 0, [], -chunks.SHORTEST
    for i, b in enumerate(raw):
        h = (2 * h + gear[b]) % (1 << 32)
        if h >> 27 == 0 and (i + 1 == len(raw) or raw[i + 1] & 0xC0 != 0x80):
            if i + 1 - before >= chunks.SHORTEST:
                ends.append(i + 1)
            before = i + 1
    ends = [e for e in ends if e < len(raw)] + [len(raw)]
    out, last = [], 0
    for e in ends:
        at = last + chunks.LONGEST
        while at < e:
            to = at
            while to < len(raw) and raw[to] & 0xC0 == 0x80:
                to += 1
            out.append(to)
            at += chunks.LONGEST
        out.append(e)
        last = e
    return sorted(set(out))


def brute(rows, least, words):
    """(doc_id, start, end, n_chunks, first_doc_id, kept), an id that is null as the lowest."""
    low = -(1 << 63)
    docs = {(low if r[0] is None else r[0], r[1]) for r in rows if r[1]}
    parts = {d: [raw[a:b].decode() for raw in [d[1].encode()] for e in [cut(raw)] for a, b in zip([0, *e[:-1]], e, strict=True)] for d in docs}
    owners = {}
    for d, ps in parts.items():
        for p in ps:
            owners.setdefault(p, set()).add(d)
    out = []
    for d, ps in parts.items():
        ends = [0]
        for p in ps:
            ends.append(ends[-1] + len(p))
        begun = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", d[1])]
        at = [0]
        for p in ps:
            at.append(at[-1] + len(p.encode()))
        places = [len(d[1][:x].encode()) for x in begun]
        between = lambda a, b: sum(a <= x < b for x in places)  # noqa: E731, B023
        i = 0
        while i < len(ps):
            j = i
            while j < len(ps) and len(owners[ps[j]]) > 1:
                j += 1
            if j > i and ends[j] - ends[i] >= least and between(max(0, at[max(0, i - 1)] - 31), at[min(j + 1, len(ps))]) >= words:
                firsts = [min(owners[p])[0] for p in ps[i:j]]
                for kept, group in groupby(range(i, j), lambda k: firsts[k - i] == d[0]):  # noqa: B023
                    ks = list(group)
                    if not kept or ends[ks[-1] + 1] - ends[ks[0]] >= least:
                        out.append((d[0], ends[ks[0]], ends[ks[-1] + 1], len(ks), min(firsts[k - i] for k in ks), kept))
            i = max(j, i + 1)
    return sorted(out)


def told(df):
    of = lambda x: -(1 << 63) if x is None else x
    return sorted((of(r["doc_id"]), r["start"], r["end"], r["n_chunks"], of(r["first_doc_id"]), r["kept"]) for r in df.collect())


def family(rng):
    """Documents that hold overlapping parts of one text, copies, and a line that all share."""
    text, line = prose(rng, 400, 100_000).split(), prose(rng, 20, 100_000)
    parts = [(rng.randrange(0, 200), rng.randrange(60, 200)) for _ in range(12)]
    out = [(3000 + rng.randrange(8), " ".join(text[a : a + n]) + f"\n{line}\n" + prose(rng, 30, 100_000)) for a, n in parts]
    return [(i, t, "en", "s", 1) for i, t in out + out[:2] + [(None, out[3][1]), (2999, line)]]


@pytest.mark.parametrize(("least", "words"), [(40, 0), (60, 50), (60, 25)])
def test_as_brute_force(spark, rows, docs, least, words):
    assert told(chunks.repeats(docs, least, words)) == brute(rows, least, words)
    more = family(random.Random(least + words))
    assert told(chunks.repeats(spark.createDataFrame(more, DOCS), least, words)) == brute(more, least, words)


def test_every_repeated_chunk_stays_once(spark):
    """With overlapping parts of a text in many documents, no sentence is gone from all of them."""
    for seed in range(3):
        rows = family(random.Random(seed))
        left = [r["text"] or "" for r in chunks.without_repeats(spark.createDataFrame(rows, DOCS)).collect()]
        assert len(left) == len(rows)
        for text in {r[1] for r in rows}:
            raw = text.encode()
            ends = cut(raw)
            assert all(any(raw[a:b].decode() in t for t in left) for a, b in zip([0, *ends[:-1]], ends, strict=True))


@pytest.mark.parametrize("letters", [3, 4, 5, 7])
def test_passages_of_51_short_words(letters):
    """However short their words, passages of just over 50 are found but for a few."""
    rng = random.Random(letters)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(letters))
    text = lambda n: " ".join(word() for _ in range(n))
    missed = 0
    for i in range(150):
        p = text(51)
        rows = [(k, f"{text(40)} {p} {text(40)}") for k in (1, 2)]
        missed += not brute(rows, chunks.LEAST_RUN, chunks.LEAST_WORDS)
    assert missed <= (12 if letters == 3 else 2), missed  # 200 letters in all, of which the sums and two chunks may take most


def test_removal(spark, docs, rows):
    more = with_clashes(docs)
    left = chunks.without_repeats(more)
    assert left.columns == more.columns and left.count() == len(rows)
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert texts[7] == rows[7][1] and texts[100] is None
    assert all(len(texts[200 + i]) < 0.3 * len(rows[7][1]) + 60 for i in range(5))
    assert chunks.repeats(docs.limit(0)).count() == 0 and chunks.without_repeats(docs.limit(0)).count() == 0


def test_every_piece_keeps_its_lowest_document(spark):
    rng = random.Random(6)
    line, text = prose(rng, 70, 100_000), [prose(rng, 150, 100_000) for _ in range(3)]
    whole = f"{text[0]} {line} {text[1]}"
    docs = spark.createDataFrame([(1, f"{text[2]} {line}"), (3, whole), (5, whole)], "doc_id long, text string")
    got = chunks.repeats(docs).collect()
    assert {(r["doc_id"], r["first_doc_id"]) for r in got if r["doc_id"] > 1} == {(3, 1), (3, 3), (5, 1)}
    assert all(r["kept"] == (r["doc_id"] == r["first_doc_id"]) for r in got)
    left = {r["doc_id"]: r["text"] for r in chunks.without_repeats(docs).collect()}
    assert left[1] == f"{text[2]} {line}" and left[5] == ""
    assert left[3].startswith(text[0]) and left[3].endswith(text[1][100:])
