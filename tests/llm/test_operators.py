import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from lumenframe.llm import bpe, chat, jaccard, licenses, lines, neighbours, packing, quality, urls, warc, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids long"
BASE = "It was a long and rather quiet evening when the old clock on the wall of the little house stopped for no reason that anyone could name or see"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 7) for i, t in enumerate(texts)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- licences


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("SPDX-License-Identifier: MIT OR GPL-3.0-only", "gpl,mit", 0.2),
        ("spdx-license-identifier: (mit AND gpl-2.0+) or Apache-2.0 and so on", "apache,gpl,mit", 0.2),
        ("SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0", "gpl", 0.5),
        ("SPDX-License-Identifier: (MIT and", "mit", 0.2),
        ("SPDX-License-Identifier: what", "", 0.0),
        ("under CC-BY, all Rights reserved. all rights reserved", "cc-by,reserved", 1.0),
        ("accc by xs", "", 0.0),
        (None, "", 0.0),
        ("", "", 0.0),
    ],
)
def test_licences(text, labels, score):
    got = licenses.scan(text)
    assert (got[5], got[6]) == (labels, pytest.approx(score))


def test_licence_places():
    assert licenses.scan("cc by x All RIGHTS-reserved é cc by")[:5] == (9, 3, 0, 7, "cc-by,reserved")
    text = " ".join(["cc by"] * 20_000)
    assert licenses.scan(text)[:4] == (40_000, 20_000, 0, 39_998)


def test_licences_against_word_by_word(spark):
    rng = random.Random(1)
    for _ in range(300):
        words = [rng.choice(["cc", "by", "general", "public", "license", "all", "rights", "reserved", "lesser", "mit"]) for _ in range(30)]
        places = [i for p in licenses.BASE for i in range(30) if words[i : i + len(p.split())] == p.split()]
        got = licenses.scan(", ".join(words))
        assert got[1:4] == (len(places), min(places, default=None), max(places, default=None))
    assert licenses.license_scan(empty(spark)).count() == 0


# --- warc


def test_warc_round_trip(spark):
    rows = [(3, "http://a/", "x"), (1, "http://b/\r\ny", "x"), (2, None, None), (5, "u", ""), (9, "é", "long " * 90_000), (7, "z", "x"), (None, "n", "alone")]
    got = {r["page_id"]: r for r in warc.warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).withColumnRenamed("record_id", "page_id").collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("response", None), 3: ("revisit", 1), 7: ("revisit", 1), 2: ("response", None), 5: ("revisit", 2), 9: ("response", None), None: ("response", None)}
    assert all(r["payload_digest"] == warc.digest_of((dict((a, c) for a, _, c in rows)[k] or "").encode()) for k, r in got.items())
    assert got[9]["payload_bytes"] == 450_000
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_archive_has_a_dictionary_and_a_frame_a_record():
    records = [warc.record(i, f"http://h/{i}", (f"<p>{i}</p>" * 300 + str(random.Random(i).random())).encode(), None, False, "d") for i in range(200)]
    data = warc.archive(records)
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little") and list(warc.frames(data)) == records
    with pytest.raises(ValueError):
        list(warc.frames(data[:-5]))
    with pytest.raises(ValueError):
        warc.parse(records[0][:-1])
    with pytest.raises(ValueError):
        warc.row(*warc.parse(records[0].replace(b"<p>0", b"<p>1")))


# --- lines


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, c in enumerate(a):
        q = [i + 1]
        for j, d in enumerate(b):
            q.append(min(p[j] + (c != d), p[j + 1] + 1, q[-1] + 1))
        p = q
    return p[-1]


def edited(rng, a, edits, letters="abc"):
    b = list(a)
    for _ in range(edits):
        k, r = rng.randrange(len(b)), rng.random()
        if r < 0.33:
            b.insert(k, rng.choice(letters))
        elif r < 0.66:
            del b[k]
        else:
            b[k] = rng.choice(letters)
    return "".join(b)


def test_banded_distance_and_keys_miss_nothing():
    rng = random.Random(2)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(4, 9)))
        b = edited(rng, a, rng.randint(0, 3))
        assert all(lines.edit_distance_within(a, b, k) == (distance(a, b) <= k) for k in (1, 2, 3))
    for _ in range(500):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(44, 60)))
        b = edited(rng, a, 2)
        assert set(lines.line_keys(a)) & set(lines.line_keys(b)) and lines.near(lines.character_counts(a), [lines.character_counts(b)])[0]


def brute_lines(texts, k=2, least=40):
    own = {x for t in texts for x in (t or "").split("\n") if len(x) >= least}
    parent = {x: x for x in own}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = sorted(own)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if abs(len(a) - len(b)) <= k and distance(a, b) <= k:
                parent[root(a)] = root(b)
    seen, out = set(), []
    for t in texts:
        gone = []
        for j, x in enumerate((t or "").split("\n")):
            if len(x) >= least:
                if root(x) in seen:
                    gone.append(j)
                seen.add(root(x))
        out.append(gone)
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(40, 70))) for _ in range(8)]
    texts = ["\n".join(edited(rng, rng.choice(base), rng.randint(0, 3)) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    texts += [None, "", "short\nshort", base[0], base[0], "x" * 50_000 + "\n" + base[0]]
    got = {r["doc_id"]: r["dropped"] for r in lines.line_report(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts)


def test_line_dedup_rewrites_texts(spark):
    a, b = "first line, long enough to take part in it all", "second line, quite another one, and long enough"
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.dedup_lines(docs(spark, [a, f"{a}\nok\n{b}", a + "!", None])).collect()}
    assert got == {0: (a, len(a)), 1: (f"ok\n{b}", 3 + len(b)), 3: (None, None)}
    assert lines.dedup_lines(empty(spark)).count() == 0


# --- bpe


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_bpe_as_the_library_does(codec):
    rng = random.Random(4)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks.rank, special_tokens={})
    texts = ["", " ", None, "a" * 4000, "ab" * 900, "漢" * 500, "\n" * 300] + ["".join(rng.choice(["a", "b", " ", "  ", "\n", "\t", "the", "é", "漢", "🙂", "ing", "1", "'s", "\u00a0"]) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    got = list(codec.encode_all(texts))
    assert got == [own.encode_ordinary(t or "") for t in texts]
    assert all(codec.decode(ids) == (t or "").encode() for t, ids in zip(texts, got, strict=True))


def test_joint_queue_merges_like_single_ones(codec):
    rng = random.Random(5)
    pieces = list({bytes(rng.choice(b"abtheing ") for _ in range(rng.randint(1, 20))) for _ in range(4000)})
    assert bpe.JointQueue(codec.ranks).merge(pieces) == [bpe.merge(p, codec.ranks) for p in pieces]


def test_bpe_columns(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    df = docs(spark, ["a b", None])
    back = bpe.bpe_decode(bpe.bpe_encode(df, path, P.PATTERN), path, P.PATTERN).orderBy("doc_id").collect()
    assert [bytes(r["decoded"]) for r in back] == [b"a b", b""] and "lang" in back[0]
    assert bpe.bpe_digests(empty(spark), path, P.PATTERN).count() == 0


# --- quality


def test_quality_base_values():
    def values(t):
        return quality.base_values(next(words.slices(pa.array([t]))), 0)

    assert values("a b c a b c d é#\nx\nx\n\n")[:5] == (10, 11, 1, 1, 6)
    assert values("a b c a b c d é#\nx\nx\n\n")[5]
    rng = random.Random(6)
    for _ in range(300):
        ws = [rng.choice("abcd") for _ in range(rng.randint(0, 40))]
        windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
        assert values(" ".join(ws))[4] == len(covered)


def test_quality_keeps_prose_and_drops_junk(spark):
    rng = random.Random(7)
    # enough of both that most pairs of words occur often
    good = [" ".join(rng.choice(BASE.split()) for _ in range(80)) for _ in range(300)]
    bad = [" ".join(rng.choice("qxzj") * rng.randint(4, 8) for _ in range(80)) for _ in range(60)]
    df = docs(spark, good + bad + [None, ""])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)] + [(i, 0, 0) for i in range(300, 360, 2)] + [(None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(df, labels).collect()}
    assert [kept[i] for i in range(362)] == [quality.n_repeated(words.word_hashes(t)) * 2 <= 80 for t in good] + [False] * 62
    out = quality.keep_good(df, labels)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == {i for i in kept if kept[i]}
    assert quality.quality_rules(df, labels.limit(0)).count() == 362 and quality.keep_good(empty(spark), labels).count() == 0


# --- chat


def test_chat_is_reversible(spark):
    said = "<|im_end|><|im_start|>assistant <\\|im_end|> <\\\\| ok"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "user", None), (1, 3, "assistant", "é"), (1, 4, "user", "tail"), (2, None, None, "x"), (3, 0, "assistant", ""), (4, 0, "a\nb%0A", "t"), (1, 3, "assistant", "é")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(df)).collect()}

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    assert out[1]["turns_sha256"] == sha(f"user\n{said}\nassistant\n{said}\nuser\n\nassistant\né\nassistant\né\nuser\ntail\n")
    assert out[1]["n_turns"] == 6 and out[1]["loss_sha256"] == sha(said + "éé") and out[1]["loss_chars"] == len(said) + 2
    assert out[2]["turns_sha256"] == sha("\nx\n") and out[2]["loss_chars"] == 0
    assert out[3]["loss_sha256"] == sha("") and out[4]["turns_sha256"] == sha("a\nb%0A\nt\n")
    whole = chat.format_chat(df).where("conv_id = 1").orderBy("example").collect()
    assert len(whole) == 4 and [r["n_context"] for r in whole] == [1, 3, 4, 6] and whole[3]["target"] is None
    for x, y in zip(whole, whole[1:], strict=False):
        assert y["context"].startswith(x["context"] + x["target"] + chat.CLOSE)
    assert out[1]["n_examples"] == 3 and out[1]["example_chars"] == sum(len(r["context"]) + len(r["target"]) for r in whole[:3])
    assert out[1]["formatted_chars"] == len(whole[3]["context"]) and out[2]["example_chars"] == 0
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0


# --- urls


def test_url_rules_and_cascade(spark):
    rules = [urls.Rule.read(*r) for r in (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"))]
    rows = ["http://WWW.Example.com/en/x?y", "https://m.example.com/en/1", "http://example.com/de/#a", "http://notexample.com/en/", "x", None, "http://a.org", "http://b.org/?utm_source=1", "://?", "a://b.org/\nq"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(rows)], "page_id long, url string, host string")
    got = [tuple(r[c] for c in ("host", "path", "rule", "verdict")) for r in urls.judge_urls(df, rules, urls.tracking_hosts(df)).orderBy("page_id").collect()]
    assert got[:4] == [("www.example.com", "/en/x", "www.example.com/en/", "allow"), ("m.example.com", "/en/1", "example.com/en/", "block"), ("example.com", "/de/", "com/", "allow"), ("notexample.com", "/en/", "com/", "allow")]
    assert got[4:] == [("", "", None, "allow"), ("", "", None, "allow"), ("a.org", "", None, "allow"), ("b.org", "/", None, "block"), ("", "", None, "allow"), ("b.org", "/\nq", None, "block")]
    assert urls.judge_urls(df.limit(0), rules, urls.tracking_hosts(df.limit(0))).count() == 0


def test_cascade_is_exact_and_its_bound_leads_to_the_join(spark):
    universe = spark.range(4000).selectExpr("CAST(id AS STRING) AS key", "id % 7 = 0 AS listed")
    cascade = urls.build_cascade(universe)
    assert universe.where(cascade.lists(universe.key) != universe.listed).count() == 0 and len(cascade.levels) > 1
    assert urls.build_cascade(universe, max_bits=100) is None
    # beyond the bound: cascades of parts of the keys, the same verdicts
    df = spark.createDataFrame([(i, f"a://h{i % 400}.org/" + ("?utm_x=1" if i % 400 % 3 == 0 else ""), i) for i in range(1200)] + [(-1, None, 0)], "page_id long, url string, _rule long")
    whole, parts = (urls.judge_urls(df, [], urls.tracking_hosts(df), max_bits=m) for m in (1 << 20, 300))
    assert parts.columns == ["page_id", "url", "_rule", "host", "path", "rule", "verdict"]
    got = sorted(tuple(r) for r in parts.drop("url").collect())
    assert got == sorted(tuple(r) for r in whole.drop("url").collect())
    assert all((r[-1] == "block") == (r[0] >= 0 and r[0] % 400 % 3 == 0) for r in got)


# --- packing


def test_packing_against_the_tokenizer(spark):
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["Hello, world. It's", None, "", "a\u1c89b \ua7cb \u0c5c \U0002ebf0x", "x\u0378y 1\U000105c0", "word " * 9000, "É é ... _. <|endoftext|> Σσς", "x" * 3000, "same", "same"]
    got = packing.pack_documents(docs(spark, texts), path).collect()
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        mine = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == i)
        assert mine == [(k, x, len(ids[x : x + 4096]), zlib.crc32(np.array(ids[x : x + 4096], "<u4").tobytes())) for k, x in enumerate(range(0, len(ids), 4096))]
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(o == sum(n for _, n in sorted(s)[:k]) for s in by.values() for k, (o, _) in enumerate(sorted(s))) and all(sum(n for _, n in s) <= 4096 for s in by.values())
    assert packing.pack_documents(empty(spark), path).count() == 0


def test_sum_of_squares_is_near_the_bound():
    rng = random.Random(8)
    sizes = sorted((rng.randint(1, 100) for _ in range(4000)), reverse=True)
    bins, _ = packing.sum_of_squares(sizes, 100)
    # even sizes of 1 to the capacity are the hardest mix: half of them pair up with one other at most
    assert len(set(bins)) <= 1.05 * sum(sizes) / 100 + 2


# --- jaccard


def brute_components(texts):
    def grams(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    s = [grams(t) for t in texts]
    comp = list(range(len(texts)))
    changed = True
    pairs = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])]
    while changed:
        changed = False
        for i, j in pairs:
            m = min(comp[i], comp[j])
            if comp[i] != m or comp[j] != m:
                comp[i] = comp[j] = m
                changed = True
    return [(len(g), c) for g, c in zip(s, comp, strict=True)]


def test_jaccard_against_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    texts = []
    for size in (1, 3, 4, 5, 7, 9, 10, 12, 15, 20, 40, 120):
        base = [rng.choice(vocab) for _ in range(size)]
        for _ in range(8):
            copy = list(base)
            if rng.random() < 0.8:
                k = rng.randrange(len(copy))
                copy[k : k + rng.choice([0, 1])] = [rng.choice(vocab)]
            texts.append(" ".join(copy))
    texts += [" ".join(passage + [rng.choice(vocab) for _ in range(rng.randint(0, 40))]) for _ in range(40)]
    texts += [None, "", "  \n", "A b C d E", "a B c D e", texts[0], " ".join(vocab * 30)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_sets(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_jaccard_keeps_one_of_each_group(spark):
    got = jaccard.keep_one(docs(spark, [BASE, BASE.upper(), "another text altogether, with its own words", None, ""]))
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 2, 3, 4] and "lang" in got.columns
    assert jaccard.keep_one(empty(spark)).count() == 0


# --- neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[100:300] = x[100]  # many equal vectors
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(700, None), (750, [0.0] * 8), (800, [float("nan")] * 8), (850, [None] * 8), (None, [1.0] * 8), (5, [float(v) for v in x[5]])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hit = 0
    for q in range(0, 600, 50):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        best = np.lexsort((np.arange(600), -s))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == [1, 2, 3, 4, 5] and np.allclose(mine.score, s[mine.vec_id])
        hit += len(set(mine.vec_id) & set(best))
        if 100 <= q < 300:
            assert list(mine.vec_id) == [i for i in range(100, 106) if i != q][:5]
    assert hit >= 54
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    few = neighbours.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r["query_id"], r["vec_id"], r["rank"]) for r in few] == [(0, 1, 1)]


def brute_nearest(ids, x, q, k=5):
    s = x @ x[q] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]))
    s[q] = -9
    return [ids[i] for i in np.lexsort((ids, -s))[:k]]


def test_neighbours_of_several_lengths(spark):
    rng = np.random.default_rng(11)
    tables = {d: rng.normal(size=(60, d)) for d in (2, 3, 7)}
    rows = [(1000 * d + 10 * i, [float(v) for v in r]) for d, t in tables.items() for i, r in enumerate(t)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    for d, t in tables.items():
        ids = np.array([1000 * d + 10 * i for i in range(60)])
        for q in range(0, 60, 5):
            assert list(got[got.query_id == ids[q]].sort_values("rank").vec_id) == brute_nearest(ids, t, q)


def test_neighbours_found_in_a_part_of_the_table(spark):
    """A search that meets a tenth of 6,000 rows finds nine of ten neighbours where these stand out."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(200, 24))
    x = np.repeat(centres, 30, axis=0) + 0.25 * rng.normal(size=(6000, 24))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), enough=600, share=0.0).toPandas()
    hits = sum(len(set(got[got.query_id == q].vec_id) & set(brute_nearest(np.arange(6000), x, q))) for q in range(0, 6000, 50))
    assert hits >= 0.9 * 5 * 120
    assert (got.groupby("query_id").size() == 5).all()


def test_frames_are_read_in_linear_time_and_checked():
    rng = random.Random(13)
    records = [bytes(rng.choice(b"abcdef \n") for _ in range(rng.choice([0, 1, 90, 5000]))) for _ in range(300)] + [b"z" * 400_000, bytes(range(256)) * 1200]
    data = warc.archive(records)
    assert list(warc.frames(data)) == records
    for one in ([b""], [b"x"], [b"only one record, too little to train on" * 3]):
        alone = warc.archive(one)
        assert alone[:4] == b"\x5d\x2a\x4d\x18" and list(warc.frames(alone)) == one
    # foreign archives: no dictionary, checksums, no content size, skippable frames between
    import zstandard

    c = zstandard.ZstdCompressor(write_checksum=True, write_content_size=False)
    foreign = b"".join(c.compress(r) + b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc" for r in records)
    assert list(warc.frames(foreign)) == records
    for broken in (data[:-1], data[:-400_000 // 1000], data[:40], data + b"junk!", foreign[:-20]):
        with pytest.raises(ValueError):
            list(warc.frames(broken))
    many = warc.archive([b"WARC/1.1 %d" % i for i in range(60_000)])
    began = time.perf_counter()
    assert sum(1 for _ in warc.frames(many)) == 60_000 and time.perf_counter() - began < 5


def brute_scan(text):
    """n_words, n_base, first, last and base labels by the contract's own words."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_license_base_against_brute_force():
    rng = random.Random(14)
    pool = ["cc", "by", "CC", "general", "Public", "license", "all", "rights", "reserved", "mit", "é", "x1", "SPDX-License-Identifier:", "lesser", "\n", "gpl-3.0"]
    for _ in range(4000):
        text = rng.choice([" ", "-", "  \t"]).join(rng.choice(pool) for _ in range(rng.randint(0, 30)))
        assert licenses.scan(text)[:5] == brute_scan(text)


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("SPDX-License-Identifier: Artistic-2.0 OR MIT", "mit", 0.2),
        ("SPDX-License-Identifier: Beerware AND MIT", "mit", 0.7),
        ("SPDX-License-Identifier: Artistic-2.0", "", 0.7),
        ("the SPDX license identifier is required here", "", 0.0),
        ("xspdx license identifier: agpl-3.0 and SPDX-License-Identifier: MIT", "mit", 0.2),
        ("SPDX-License-Identifier: isc2x", "", 0.7),
        ("SPDX-License-Identifier: GPLv3+ OR (BSD3 AND cc-by-sa-4.0)", "bsd,cc-by,cc-by-sa,gpl", 0.6),
    ],
)
def test_license_expressions_behind_the_automatons_tags(text, labels, score):
    assert licenses.scan(text)[5:] == (labels, score)
