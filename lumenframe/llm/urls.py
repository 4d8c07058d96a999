"""URL filters, with DataFrame functions only: fixed rules, and a cascade of Bloom filters for the rest.

The cascade holds a list of keys exactly, over a known universe of keys: level 1 encodes the listed keys, level 2 the
unlisted ones that level 1 takes by mistake, level 3 the listed ones that level 2 takes by mistake, and so on until a
level makes no mistake. A key of the universe is listed if the first level that turns it down is an even one, or all
levels take it and their number is odd. Keys outside the universe get an answer that may be wrong.

A level is an array of 64-bit words that travels as a scalar of the plan. Its size is a known number of bits per key
(``BITS``) and is checked: where a level would pass ``MAX_BITS``, keys are halved by hash, as often as it takes, and each
part has a cascade of its own, built and applied one after the other, so one part's levels are all that is held.

Edge cases: null urls, and urls without ``://``, have an empty host and path; no rule fits them. A key that occurs many
times is judged once per row and built in once. An empty table builds empty levels and gives no rows. Columns host,
path, rule and verdict of the input are replaced, all others pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.batches import fresh
from lumenframe.plans.scratch import cut

BITS, HASHES, MAX_BITS = 10, 4, 1 << 28
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and all its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @classmethod
    def read(cls, verdict: str, text: str) -> Rule:
        h, slash, p = text.partition("/")
        return cls(verdict, h, slash + p)


def longest_rule(rules: list[Rule], h: Column, p: Column) -> Column:
    """Struct (name, verdict) of the longest rule that fits, or null; equal lengths: by name."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest comes last and so wins
        fits = ((h == r.host) | h.endswith("." + r.host)) & p.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _places(key: Column, level: int, bits: int) -> list[Column]:
    """Double hashing: HASHES bit places of a key."""
    a, b = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits)) for seed in (level, ~level))
    return [F.pmod(a + F.lit(i) * b, F.lit(bits)) for i in range(HASHES)]


@dataclass
class Level:
    bits: int
    words: DataFrame  # one row, one array

    def takes(self, key: Column, level: int) -> Column:
        words = self.words.scalar()
        hit = F.lit(True)
        for at in _places(key, level, self.bits):
            hit = hit & (F.getbit(F.get(words, F.shiftrightunsigned(at, 6).cast("int")), (at % 64).cast("int")) == 1)
        return hit


def build_level(keys: DataFrame, n: int, level: int) -> Level:
    """``keys``: one column ``key``, distinct, ``n`` rows."""
    words = max(1, math.ceil(n * BITS / 64))
    set_bits = keys.select(F.explode(F.array(*_places(F.col("key"), level, words * 64))).alias("at"))
    ones = set_bits.select(F.shiftrightunsigned("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bits"))
    zeros = keys.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    filled = ones.unionByName(zeros).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    packed = filled.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w")).select(F.transform("w", lambda x: x["bits"]).alias("words"))
    return Level(words * 64, cut(packed, "bloom"))


@dataclass
class Cascade:
    levels: list[Level]

    def lists(self, key: Column) -> Column:
        """True if ``key`` is listed, for every key of the universe."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            # turned down at level k+1 (from 1): listed if that number is even
            verdict = F.when(self.levels[k].takes(key, k), verdict).otherwise(F.lit(k % 2 == 1))
        return verdict


def build_cascade(universe: DataFrame, max_bits: int = MAX_BITS) -> Cascade | None:
    """``universe``: key (distinct, not null), listed (boolean). None: a level would be larger than ``max_bits``."""
    levels: list[Level] = []
    side = {True: universe.where("listed").select("key"), False: universe.where("not listed").select("key")}
    now = True  # level 1 encodes the listed keys
    while True:
        n = side[now].count()
        if n * BITS > max_bits:
            return None
        if levels and not n:
            return Cascade(levels)
        levels.append(build_level(side[now], n, len(levels)))
        k, level = len(levels) - 1, levels[-1]
        side[not now] = cut(side[not now].where(level.takes(F.col("key"), k)), "bloom-mistakes")
        now = not now


def judge_urls(pages: DataFrame, rules: list[Rule], universe: DataFrame, url: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """``pages`` with host, path, rule and verdict; where no rule fits, a listed host is blocked.

    ``universe`` holds every host of ``pages`` as key, and whether it is listed."""
    universe = cut(universe, "universe")
    rows = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    (fit,) = fresh(rows, "_rule")
    names = rows.columns

    def judged(cascade: Cascade, where: Column | None) -> DataFrame:
        part = rows if where is None else rows.where(where)
        own = F.when(cascade.lists(F.col("host")), "block").otherwise("allow")
        part = part.withColumn(fit, longest_rule(rules, F.col("host"), F.col("path")))
        return part.select(*names, F.col(f"{fit}.name").alias("rule"), F.coalesce(F.col(f"{fit}.verdict"), own).alias("verdict"))

    whole = build_cascade(universe, max_bits)
    if whole:
        return judged(whole, None)
    out, todo = None, [(0, 2), (1, 2)]
    while todo:
        part, of = todo.pop()

        def here(key: str, part: int = part, of: int = of) -> Column:
            return F.pmod(F.xxhash64(F.col(key), F.lit("part")), F.lit(of)) == part

        cascade = build_cascade(universe.where(here("key")), max_bits)
        if cascade is None:
            todo += [(part, 2 * of), (part + of, 2 * of)]
            continue
        done = cut(judged(cascade, here("host")), "judged")
        out = done if out is None else out.unionByName(done)
    return out


def tracking_hosts(pages: DataFrame, url: str = "url", share: float = 0.5) -> DataFrame:
    """The universe: every host, listed if at least ``share`` of its urls carry a tracking parameter."""
    rows = pages.select(host(F.col(url)).alias("key"), F.coalesce(F.col(url).rlike(r"[?&]utm_[a-z]+="), F.lit(False)).cast("int").alias("tracks"))
    return rows.groupBy("key").agg((F.sum("tracks") >= F.lit(share) * F.count("*")).alias("listed"))
