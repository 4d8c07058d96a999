import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline

WORDS = "It was a long and rather quiet evening when the old clock on the wall of the little house stopped for no reason that anyone could name or see".split()
BLANK = " \t\r\x0b\x0c"


def broken(words, width):
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


def sound(text):
    """Prose of the fixture passes the quality rules unless more than half of it lies in repeated runs of three words."""
    w = (text or "").split()
    runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(runs)
    return len(w) >= 50 and set(w) <= {*WORDS, "Title"} and 2 * len({i + j for i, r in enumerate(runs) if often[r] > 1 for j in range(3)}) <= len(w)


def within(a, b, k):
    if abs(len(a) - len(b)) > k or sum(((Counter(a) - Counter(b)) + (Counter(b) - Counter(a))).values()) > 2 * k:
        return False
    p = list(range(len(b) + 1))
    for i, c in enumerate(a):
        q = [i + 1]
        for j, d in enumerate(b):
            q.append(min(p[j] + (c != d), p[j + 1] + 1, q[-1] + 1))
        p = q
    return p[-1] <= k


def roots(n, linked):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if root[i] != root[j] and linked(i, j):
                root = [root[j] if r == root[i] else r for r in root]
    return root


def without_repeats(rows):
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is not None, rows[r][0] or 0, r))
    own = sorted({x for _, t in rows for x in (t or "").split("\n") if x.strip(BLANK)})
    comp = dict(zip(own, roots(len(own), lambda i, j: min(len(own[i]), len(own[j])) >= 40 and within(own[i], own[j], 2)), strict=True))
    seen, out = set(), {}
    for r in order:
        kept, lines = [], (rows[r][1] or "").split("\n")
        for x in lines:
            if not x.strip(BLANK) or comp[x] not in seen:
                kept.append(x)
                seen |= {comp[x]} if x.strip(BLANK) else set()
        if len(kept) == len(lines):
            out[r] = rows[r]
        elif "".join(kept).strip(BLANK):
            out[r] = (rows[r][0], "\n".join(kept))
    return [out[r] for r in sorted(out)]


def one_of_each_group(rows):
    words = [(t or "").lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for w in words]
    comp = roots(len(rows), lambda i, j: bool(sets[i] and sets[j]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    seen, out = set(), []
    for r in sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, r)):
        if comp[r] not in seen:
            seen.add(comp[r])
            out.append(rows[r])
    return out


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(40)
    prose = [[rng.choice(WORDS) for _ in range(80)] for _ in range(200)]
    junk = [" ".join(rng.choice("qxzj") * rng.randint(4, 8) for _ in range(80)) for _ in range(40)]
    for k in (19, 39, 59, 79):
        prose[7][k] = "on"
    edited = ["no" if k in (19, 39, 59, 79) else w for k, w in enumerate(prose[7])]
    rows = [(i, broken(w, 20)) for i, w in enumerate(prose)] + [(200 + i, t) for i, t in enumerate(junk)]
    rows += [(400, rows[0][1]), (401, broken(prose[1], 13)), (402, broken(edited, 20)), (403, "Title\n\n" + broken(prose[8][::-1], 20)), (404, "Title\n\n" + broken(prose[9][::-1], 20))]
    rows += [(405, "Title\n \t\r\n" + rows[10][1])]  # only a blank line is left of it
    rows += [(None, rows[2][1]), (None, rows[2][1]), (None, broken(prose[3], 13)), rows[5], (6, broken(prose[6][::-1], 20)), (11, broken(prose[12], 13)), (406, None), (407, ""), (None, None)]
    table = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 200), 0) for i in range(0, 240, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")

    kept = [r for r in rows if sound(r[1])]
    deduped = without_repeats(kept)
    left = one_of_each_group(deduped)
    assert len(rows) > len(kept) > len(deduped) > len(left)
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    expected = []
    for i, text in left:
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        expected += [(i, k, x, len(ids[x : x + 4096]), zlib.crc32(np.array(ids[x : x + 4096], "<u4").tobytes())) for k, x in enumerate(range(0, len(ids), 4096))]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(expected, key=str)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(o == sum(n for _, n in sorted(s)[:k]) for s in by.values() for k, (o, _) in enumerate(sorted(s))) and all(sum(n for _, n in s) <= 4096 for s in by.values())
